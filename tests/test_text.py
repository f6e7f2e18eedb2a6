"""Hand cases of the cell text steps."""

import pytest
from pyspark.sql import functions as F

from lakefind.functions import text as T
from lakefind.sources.lake import PRECEDENCES, sniff_delimiter, split_fields


def each(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.out for r in df.select("i", expr(F.col("v")).alias("out")).orderBy("i").collect()]


def test_scientific_numbers(spark):
    values = ["100", "0.05", "12.50", "0", "abc 7 def", "0.0", "007.25", "3.", None, "1.2.3"]
    assert each(spark, values, T.scientific_numbers) == [
        "1 scinotexp 2", "5 scinotexp -2", "125 scinotexp 1", "0 scinotexp 0", "abc 7 scinotexp 0 def", "0 scinotexp 0",
        "725 scinotexp 0", "3 scinotexp 0", None, "12 scinotexp 0.3 scinotexp 0"]
    assert each(spark, ["100", "12.50"], lambda c: T.scientific_numbers(c, "search")) == ["100 scinotexp 2", "125 scinotexp 1"]
    with pytest.raises(ValueError):
        T.scientific_numbers(F.lit("1"), "other")


def test_missing_and_delete(spark):
    assert each(spark, ["", "  ", None, "0", "x"], T.fill_missing) == ["[CELL]", "[CELL]", "[CELL]", "0", "x"]
    assert each(spark, [""], lambda c: T.fill_missing(c, "header")) == ["[HEAD]"]
    assert each(spark, ["a\x7fb\x7f"], T.strip_delete) == ["ab"]


def test_templates(spark):
    assert each(spark, ["{{a|b}}", "{{x}}", "pre {{a}} mid {{b}} post", "plain"], T.clean_template) == [
        "b", "x", "pre  post", "plain"]


def test_sanitize(spark):
    values = ["a||b", " td  x y", "TH", "tdx y", "<row>z[CELL]", "Missing", "<MISSING>", None, "a  b\tc"]
    assert each(spark, values, T.sanitize) == [
        "a b", "x y", "[CELL]", "tdx y", "z", "[CELL]", "[CELL]", "[CELL]", "a b c"]
    assert each(spark, ["one two three"], lambda c: T.sanitize(c, max_words=2)) == ["one two"]
    assert each(spark, [" "], lambda c: T.sanitize(c, "caption")) == ["[TAB]"]
    assert each(spark, ["missing"], lambda c: T.sanitize(c, replace_missing=False)) == ["missing"]


def test_fold_ascii(spark):
    assert each(spark, ["Café ﬁn ½ ß", None, "{{x|naïve}}"], T.fold_ascii) == ["Cafe fin 12 ", None, "{{x|naive}}"]
    assert each(spark, ["{{x|naïve}}", "   "], T.clean_cell) == ["naive", "[CELL]"]


def test_delimiters(spark):
    lines = ["a;b,c", "a\tb,c", "a|b", "abc", "a,b\tc"]
    assert each(spark, lines, sniff_delimiter) == [";", "\t", ",", ",", "\t"]
    assert each(spark, lines, lambda c: sniff_delimiter(c, "search")) == [";", "\t", "|", ",", "\t"]
    assert each(spark, lines, lambda c: sniff_delimiter(c, "profile")) == [";", ",", None, None, ","]
    assert set(PRECEDENCES) == {"ingest", "search", "profile"}


def test_split_fields(spark):
    assert each(spark, ['a,"b,c","say ""hi""",,d', ",x", ""], lambda c: split_fields(c, F.lit(","))) == [
        ["a", "b,c", 'say "hi"', "", "d"], ["", "x"], [""]]
    assert each(spark, ["a|b"], lambda c: split_fields(c, F.lit("|"))) == [["a", "b"]]

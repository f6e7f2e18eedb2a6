"""Cell text normalisation as native column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lakefind.session import short_batches

# Tags and missing tokens of the tagged table text.
CAPTION_TAG = "<caption>"
HEADER_TAG = "<header>"
ROW_TAG = "<row>"
MISSING = {"caption": "[TAB]", "header": "[HEAD]", "cell": "[CELL]", "row": "[ROW]"}
RESERVED = ["<caption>", "<header>", "<row>", "[TAB]", "[CELL]", "[HEAD]"]
LEADING_MARKUP = ["td", "th", "TD", "TH"]
MISSING_WORDS = ["", "<missing>", "missing"]

SPACE = r"[\s\p{Z}]+"
WORD = r"[\p{L}\p{N}_]+"
TOKEN = r"[\p{L}\p{N}_]{2,}"


def words(text: Column, pattern: str = WORD) -> Column:
    """Lower-cased word tokens of any script."""
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


def squeeze(text: Column) -> Column:
    """Collapse white space to single blanks and trim."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def first_words(text: Column, n: int | None) -> Column:
    """The first ``n`` blank-separated words; all of them if ``n`` is None."""
    return squeeze(text) if n is None else F.array_join(F.slice(F.split(squeeze(text), " "), 1, n), " ")


def strip_delete(text: Column) -> Column:
    """Remove the DEL control character."""
    return F.translate(text, "\u007f", "")


def _scientific(number: Column, form: str) -> Column:
    whole = F.ltrim(F.substring_index(number, ".", 1), F.lit("0"))
    part = F.when(F.contains(number, F.lit(".")), F.substring_index(number, ".", -1)).otherwise("")
    significant = F.ltrim(part, F.lit("0"))
    leading = F.length(part) - F.length(significant)
    if form == "corpus":
        digits = F.rtrim(F.concat(whole, part), F.lit("0"))
    else:
        digits = F.concat(whole, F.rtrim(part, F.lit("0")))
    large = F.concat(digits, F.lit(" scinotexp "), (F.length(whole) - 1).cast("string"))
    small = F.concat(F.rtrim(significant, F.lit("0")), F.lit(" scinotexp "), (-leading - 1).cast("string"))
    zero = F.lit("0 scinotexp 0")
    return F.when(whole != "", large).when(significant != "", small).otherwise(zero)


def scientific_numbers(text: Column, form: str = "corpus") -> Column:
    """Rewrite every number as ``digits scinotexp exponent``.

    ``corpus`` strips trailing zeros of the joined digits (100 -> ``1
    scinotexp 2``), ``search`` only those of the decimals (100 -> ``100
    scinotexp 2``).  Zero becomes ``0 scinotexp 0`` in both.
    """
    if form not in ("corpus", "search"):
        raise ValueError(f"unknown number form: {form}")
    runs = F.regexp_extract_all(text, F.lit(r"[0-9]+\.?[0-9]*|[^0-9]+"), F.lit(0))
    rewritten = F.transform(runs, lambda run: F.when(run.rlike("^[0-9]"), _scientific(run, form)).otherwise(run))
    return F.array_join(rewritten, "")


def fill_missing(text: Column, kind: str = "cell") -> Column:
    """Null or blank text becomes the missing token of its kind."""
    return F.when(F.trim(text) != "", text).otherwise(F.lit(MISSING[kind]))


def clean_template(text: Column) -> Column:
    """A cell that is one ``{{a|b}}`` template keeps its last part; embedded ones go."""
    inner = F.substring_index(F.regexp_extract(text, r"^\{\{(.*)\}\}$", 1), "|", -1)
    return F.when(text.rlike(r"^\{\{.*\}\}$"), inner).otherwise(F.regexp_replace(text, r"\{\{.*\}\}", ""))


def sanitize(text: Column, kind: str = "cell", max_words: int | None = None, replace_missing: bool = True) -> Column:
    """Pipes to blanks, no stray markup word, no reserved tags, at most ``max_words`` words if given."""
    out = squeeze(F.regexp_replace(text, r"\|+", " "))
    head = F.substring_index(out, " ", 1)
    out = F.when(head.isin(LEADING_MARKUP), F.ltrim(F.substr(out, F.length(head) + 1))).otherwise(out)
    for tag in RESERVED:
        out = F.replace(out, F.lit(tag), F.lit(""))
    out = first_words(out, max_words)
    if not replace_missing:
        return out
    return F.when(out.isNull() | F.lower(out).isin(MISSING_WORDS), F.lit(MISSING[kind])).otherwise(out)


@F.pandas_udf(StringType())
def _decomposed(text: pd.Series) -> pd.Series:
    return text.str.normalize("NFKD").str.encode("ascii", "ignore").str.decode("ascii")


def fold_ascii(text: Column) -> Column:
    """Compatibility-decompose and drop what is not ASCII (no built-in does this); ASCII texts stay in the JVM."""
    short_batches(SparkSession.active())
    return F.coalesce(_decomposed(F.when(text.rlike(r"[^\x00-\x7f]"), text)), text)


def clean_cell(text: Column, max_words: int | None = None) -> Column:
    """ASCII folding, template clean-up, white space and ``sanitize`` in one go."""
    return sanitize(squeeze(clean_template(fold_ascii(text))), "cell", max_words)

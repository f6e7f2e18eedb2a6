"""Corpus jobs over cells: normalisation, linearised tables, lexicons, corruption, splits."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakefind.functions import text as T
from lakefind.functions.ranking import attach, lowest, rank_within, running, seeded, share, unit
from lakefind.session import materialize

STEPS = {
    "strip_delete": T.strip_delete,
    "scientific_numbers": T.scientific_numbers,
    "fill_missing": T.fill_missing,
    "clean_template": T.clean_template,
    "sanitize": T.sanitize,
    "fold_ascii": T.fold_ascii,
    "clean_cell": T.clean_cell,
}


def normalize_cells(cells: DataFrame, steps: list[str]) -> DataFrame:
    """Apply named text steps to every cell, in order."""
    for step in steps:
        if step not in STEPS:
            raise ValueError(f"unknown step: {step}")
        cells = cells.withColumn("value", STEPS[step](F.col("value")))
    return cells


def drop_header_rows(cells: DataFrame) -> DataFrame:
    """Drop the leading rows that repeat the header cell by cell; the rest moves up.

    A data row that merely contains a header's text stays.  Whether a row repeats the header is one
    minimum per row, the first row that stays one minimum per table, so no
    table is sorted.  A table of nothing but header rows disappears.
    """
    plain = lambda c: F.trim(F.coalesce(c, F.lit("")))
    same = plain("value") == plain("col_name")
    rows = cells.groupBy("table_id", "row_idx").agg(
        (F.bool_and(same) & F.bool_or(plain("col_name") != "")).alias("_repeats"))
    first = rows.filter(~F.col("_repeats")).groupBy("table_id").agg(F.min("row_idx").alias("_first"))
    return (
        attach(cells, first, ["table_id"], ["row_idx"]).filter(F.col("row_idx") >= F.col("_first"))
        .withColumn("row_idx", F.col("row_idx") - F.col("_first")).drop("_first")
    )


def linearize(cells: DataFrame, part_rows: int = 100, max_words: int | None = None) -> DataFrame:
    """``(table_id, part, text)``: ``<caption> .. <header> a | b <row> 1 | 2 ..``.

    The whole table: part ``p`` holds rows ``p * part_rows`` and following, each part
    with caption and header, so that no table is one value.  A caller
    that wants a size cap applies ``select.cap`` before.
    """
    caption = F.col("caption") if "caption" in cells.columns else F.lit(None).cast("string")
    cleaned = cells.select(
        "table_id", "row_idx", "col_idx", T.sanitize(caption, "caption", max_words).alias("caption"),
        T.sanitize(F.col("col_name"), "header", max_words).alias("head"),
        T.clean_cell(F.col("value"), max_words).alias("cell"))
    ordered = F.sort_array(F.collect_list(F.struct("col_idx", "head", "cell")))
    lines = cleaned.groupBy("table_id", "row_idx").agg(F.first("caption").alias("caption"), ordered.alias("cells"))
    lines = lines.select(
        "table_id", F.floor(F.col("row_idx") / part_rows).alias("part"), "caption",
        F.array_join(F.transform("cells", lambda c: c["head"]), " | ").alias("head"),
        F.struct("row_idx", F.concat(F.lit(T.ROW_TAG + " "), F.array_join(
            F.transform("cells", lambda c: c["cell"]), " | ")).alias("line")).alias("item"))
    parts = lines.groupBy("table_id", "part").agg(
        F.first("caption").alias("caption"), F.min_by("head", F.col("item.row_idx")).alias("head"),
        F.sort_array(F.collect_list("item")).alias("items"))
    return parts.select("table_id", "part", F.concat_ws(
        " ", F.lit(T.CAPTION_TAG), "caption", F.lit(T.HEADER_TAG), "head",
        F.array_join(F.transform("items", lambda i: i["line"]), " ")).alias("text"))


def parse_text(table_text: DataFrame, part_rows: int = 100) -> DataFrame:
    """Tagged parts of table texts back to cells; a table with a row of the wrong width is skipped."""
    table_text = materialize(table_text.select("table_id", "part", "text"))  # read for the broken tables and for the cells
    body = F.split("text", T.HEADER_TAG)[1]
    lines = F.split(body, T.ROW_TAG)
    parsed = table_text.select(
        "table_id", "part",
        F.trim(F.replace(F.split("text", T.HEADER_TAG)[0], F.lit(T.CAPTION_TAG), F.lit(""))).alias("caption"),
        F.split(F.trim(lines[0]), r" \| ").alias("header"),
        F.transform(F.slice(lines, 2, F.size(lines)), lambda line: F.split(F.trim(line), r" \| ")).alias("data"))
    parsed = parsed.withColumn("_sound", F.forall("data", lambda row: F.size(row) == F.size("header")))
    broken = parsed.filter(~F.col("_sound")).select("table_id").distinct()
    rows = attach(parsed, broken, ["table_id"], ["part"], "left_anti").select(
        "table_id", "part", "caption", "header", F.posexplode("data").alias("at", "row"))
    cells = rows.select("table_id", "caption", (F.col("part") * part_rows + F.col("at")).cast("long").alias("row_idx"),
                        F.posexplode(F.arrays_zip("header", "row")).alias("col_idx", "c"))
    return cells.select("table_id", "caption", "row_idx", "col_idx", F.trim("c.header").alias("col_name"),
                        F.trim("c.row").alias("value"))


def lexicon(cells: DataFrame, kind: str = "cell") -> DataFrame:
    """``(text, cnt)``: lower-cased cells, or headers (one per column), with missing ones as their tag."""
    if kind == "header":
        source, text = cells.select("table_id", "col_idx", "col_name").distinct(), F.col("col_name")
    elif kind == "cell":
        source, text = cells, F.col("value")
    else:
        raise ValueError(f"unknown lexicon: {kind}")
    filled = T.fill_missing(text, kind)
    tag = F.lit(T.MISSING[kind])
    return source.groupBy(F.when(filled == tag, tag).otherwise(F.lower(filled)).alias("text")).agg(
        F.count(F.lit(1)).alias("cnt"))


def top_lexicon(lex: DataFrame, frac: float = 0.05, kind: str = "cell") -> DataFrame:
    """The most frequent ``frac`` of the lexicon with sampling probabilities; the missing tag weighs 0."""
    weighed = lex.withColumn("cnt", F.when(F.col("text") == T.MISSING[kind], 0).otherwise(F.col("cnt")))
    ranked = rank_within(weighed, [], [F.desc("cnt"), F.col("text")])
    size = lex.agg(F.count(F.lit(1))).scalar()
    kept = materialize(ranked.filter(F.col("rank") <= F.floor(share(F.lit(size), frac))))
    return kept.select("text", "cnt", "rank", (F.col("cnt") / kept.agg(F.sum("cnt")).scalar()).alias("p"))


def _picked(items: DataFrame, ids: list[str], ratio: float, seed: int, salt: str) -> DataFrame:
    """Mark ``round(ratio * n)`` items per table, chosen by hash."""
    hashed = seeded(f"{seed}{salt}", "table_id", *ids)
    return lowest(items, ["table_id"], hashed, ids, lambda n: F.bround(share(n, ratio)), "picked")


def _with_picks(cells: DataFrame, ratio: float, seed: int) -> DataFrame:
    """Cells with ``label_cell`` and ``label_head``: chosen and not missing."""
    heads = cells.select("table_id", "col_idx", "col_name").distinct()
    heads = _picked(heads, ["col_idx"], ratio, seed, "head").select(
        "table_id", "col_idx", (F.col("picked") & (F.trim("col_name") != "")).alias("label_head"))
    chosen = _picked(cells, ["row_idx", "col_idx"], ratio, seed, "cell")
    known = F.coalesce(F.trim("value") != "", F.lit(False))
    labelled = chosen.withColumn("label_cell", F.col("picked") & known).drop("picked")
    return attach(labelled, heads, ["table_id", "col_idx"], ["row_idx"])


def corrupt_mask(cells: DataFrame, ratio: float = 0.15, seed: int = 42) -> DataFrame:
    """A ratio of headers and cells set to the missing tag, with 0/1 labels."""
    picked = _with_picks(cells, ratio, seed)
    return picked.select(
        "table_id", "row_idx", "col_idx",
        F.when(F.col("label_head"), F.lit(T.MISSING["header"])).otherwise(F.col("col_name")).alias("col_name"),
        F.when(F.col("label_cell"), F.lit(T.MISSING["cell"])).otherwise(F.col("value")).alias("value"),
        F.col("label_head").cast("int").alias("label_head"), F.col("label_cell").cast("int").alias("label_cell"))


def draw(items: DataFrame, lex: DataFrame, hashed: Column, name: str) -> DataFrame:
    """Attach a lexicon text to every item, drawn with probability ``cnt / total``.

    An item's hash is a position in the cumulative counts.  Positions and
    count intervals are cut into as many buckets as there are texts, so the range join is an
    equi-join: a bucket is as wide as a text is frequent on average, and a frequent
    text just spans more buckets.
    """
    cumulated = materialize(running(lex.filter(F.col("cnt") > 0).select("text", "cnt"), [],
                                    [F.desc("cnt"), F.col("text")], {"hi": F.col("cnt")}))
    total, n_texts = cumulated.agg(F.sum("cnt"), F.count(F.lit(1))).first()
    if not total:
        raise ValueError("the lexicon is empty")
    width = max(1, total // n_texts)
    lo = F.col("hi") - F.col("cnt")
    buckets = cumulated.select(
        F.col("text").alias(name), lo.alias("_lo"), F.col("hi").alias("_hi"),
        F.explode(F.sequence(F.floor(lo / width), F.floor((F.col("hi") - 1) / width))).alias("_bucket"))
    placed = items.withColumn("_at", F.floor(unit(hashed) * total)).withColumn("_bucket", F.floor(F.col("_at") / width))
    inside = (F.col("_at") >= F.col("_lo")) & (F.col("_at") < F.col("_hi"))
    return placed.join(buckets, "_bucket").filter(inside).drop("_bucket", "_at", "_lo", "_hi")


def corrupt_replace(cells: DataFrame, cell_lex: DataFrame, head_lex: DataFrame, ratio: float = 0.15,
                    seed: int = 42) -> DataFrame:
    """A ratio of headers and cells replaced by lexicon draws, with 0/1 labels; missing ones stay."""
    picked = _with_picks(cells, ratio, seed)
    heads = picked.filter("label_head").select("table_id", "col_idx").distinct()
    heads = draw(heads, head_lex, seeded(f"{seed}head-draw", "table_id", "col_idx"), "_head")
    drawn = draw(picked.filter("label_cell").select("table_id", "row_idx", "col_idx"), cell_lex,
                 seeded(f"{seed}cell-draw", "table_id", "row_idx", "col_idx"), "_cell")
    replaced = picked.join(drawn, ["table_id", "row_idx", "col_idx"], "left")
    return (
        attach(replaced, heads, ["table_id", "col_idx"], ["row_idx"], "left")
        .select("table_id", "row_idx", "col_idx", F.coalesce("_head", "col_name").alias("col_name"),
                F.coalesce("_cell", "value").alias("value"), F.col("label_head").cast("int").alias("label_head"),
                F.col("label_cell").cast("int").alias("label_cell"))
    )


def edge_views(incidence: DataFrame, drop: float = 0.3, seeds: tuple[int, int] = (1, 2)) -> DataFrame:
    """Two independent random keeps of ``floor(n * (1 - drop))`` incidences per table."""
    keep = Decimal(1) - Decimal(str(drop))
    for view, seed in enumerate(seeds, 1):
        hashed = seeded(seed, "table_id", "node_id", "edge_id")
        incidence = lowest(incidence, ["table_id"], hashed, ["node_id", "edge_id"], lambda n: F.floor(share(n, keep)), "_in")
        incidence = incidence.withColumn(f"view_{view}", F.col("_in").cast("int")).drop("_in")
    return incidence


def split(df: DataFrame, ids: list[str], valid_ratio: float = 0.05, seed: int = 42) -> DataFrame:
    """Mark ``floor(n * valid_ratio)`` rows as ``valid``, the same ones on every run."""
    marked = lowest(df, [], seeded(seed, *ids), ids, lambda n: F.floor(share(n, valid_ratio)), "_valid")
    return marked.withColumn("part", F.when(F.col("_valid"), F.lit("valid")).otherwise(F.lit("train"))).drop("_valid")

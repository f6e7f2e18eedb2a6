"""Row and cell selection per table.  Every operator maps ``cells`` to ``cells``."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakefind.functions.ranking import attach, rank_within, seeded
from lakefind.functions.text import TOKEN, first_words, squeeze, words
from lakefind.operators.profile import column_types
from lakefind.session import materialize

CELL = ["table_id", "row_idx", "col_idx", "col_name", "value"]


def _renumber(cells: DataFrame, rows: DataFrame, order: list[Column], limit: int | None) -> DataFrame:
    """Move whole rows to their position in ``order``; rows not listed are dropped."""
    ranked = rank_within(rows, ["table_id"], order, "_rank", limit)
    return (
        cells.join(ranked.select("table_id", "row_idx", "_rank"), ["table_id", "row_idx"])
        .withColumn("row_idx", F.col("_rank") - 1)
        .select(*CELL)
    )


def _null_counts(cells: DataFrame) -> DataFrame:
    return cells.groupBy("table_id", "row_idx").agg(F.count_if(F.col("value").isNull()).alias("_n_null"))


def drop_null_rows(cells: DataFrame, max_nulls: int = 0, limit: int | None = None) -> DataFrame:
    """Keep rows with at most ``max_nulls`` missing cells (0: complete rows; the usual choice is 2)."""
    kept = _null_counts(cells).filter(F.col("_n_null") <= max_nulls)
    return _renumber(cells, kept, [F.col("row_idx")], limit)


def order_by_nulls(cells: DataFrame, limit: int | None = None) -> DataFrame:
    """Rows with fewer missing cells first."""
    return _renumber(cells, _null_counts(cells), [F.col("_n_null"), F.col("row_idx")], limit)


def shuffle_rows(cells: DataFrame, seed: int = 42, limit: int | None = None) -> DataFrame:
    """A shuffle that is the same on every run and partitioning."""
    rows = cells.select("table_id", "row_idx").distinct()
    return _renumber(cells, rows, [seeded(seed, "table_id", "row_idx"), F.col("row_idx")], limit)


def sample_rows(cells: DataFrame, n: int = 30, seed: int = 42) -> DataFrame:
    """A random sample of ``n`` rows per table; shorter tables are returned whole."""
    return shuffle_rows(cells, seed, limit=n)


BLOCK_BYTES, BLOCK_TEXTS = 1 << 23, 65_536  # texts whose words are looked up together: so long or so many at most


def _word_codes(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, pa.Array]:
    """Per word its text and its code, per text the code of its table, then all words and all tables."""
    lists = pc.split_pattern(table.column("text").combine_chunks(), " ")
    words_of = lists.flatten().dictionary_encode()
    tables = table.column("table_id").combine_chunks().dictionary_encode()
    at = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    return at, words_of.indices.to_numpy(), tables.indices.to_numpy(), words_of.dictionary, tables.dictionary


def _block_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(_block, table_id, word, n)``: the texts of a block that hold a word; a block may be given in parts."""

    def counted(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        at, code, of, names, tables = _word_codes(table)
        blocks, block = np.unique(table.column("_block").to_numpy(), return_inverse=True)
        pair = np.unique(at * len(names) + code)  # a word counts once in a text
        at, code = np.divmod(pair, max(1, len(names)))
        key, n = np.unique((block[at] * len(tables) + of[at]) * len(names) + code, return_counts=True)
        place, code = np.divmod(key, max(1, len(names)))
        place, of = np.divmod(place, max(1, len(tables)))
        out = pa.table({"_block": blocks[place], "table_id": tables.take(pa.array(of)), "word": names.take(pa.array(code)),
                        "n": n.astype(np.int64)})
        yield from out.filter(pc.not_equal(out.column("word"), "")).to_batches()

    held = []
    for batch in batches:
        if held and (batch.column("_block")[0] != held[0].column("_block")[0] or sum(x.nbytes for x in held) >= BLOCK_BYTES):
            yield from counted(held)
            held = []
        if batch.num_rows:
            held.append(batch)
    if held:
        yield from counted(held)


def _looked_up(texts: pa.Table, known: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per text and distinct word: the text, how often it holds the word, and its idf (0 for no known word); per text its words."""
    at, code, of, names, tables = _word_codes(texts)
    size = max(1, len(names))
    pair, times = np.unique(at * size + code, return_counts=True)
    row, code = np.divmod(pair, size)
    idf = np.zeros(len(pair))
    if known.num_rows:
        word = pc.index_in(known.column("word").combine_chunks(), names)
        table = pc.index_in(known.column("table_id").combine_chunks(), tables)
        mine = pc.and_(word.is_valid(), table.is_valid()).to_numpy(zero_copy_only=False)
        keys = (table.fill_null(0).to_numpy() * size + word.fill_null(0).to_numpy().astype(np.int64))[mine]
        order = np.argsort(keys)
        keys, weights = keys[order], known.column("idf").to_numpy()[mine][order]
        if len(keys):
            wanted = of[row].astype(np.int64) * size + code
            place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            idf = np.where(keys[place] == wanted, weights[place], 0.0)
    return row, times, idf, np.bincount(at, minlength=texts.num_rows)


def _scored_texts(texts: DataFrame, fitted: Column, looked: Column, score: Callable[..., np.ndarray], ids: list[str]) -> DataFrame:
    """``(*ids, score)`` of all ``texts`` (with ``_block``, ``table_id`` and ``ids``), from the idf of their words in their table.

    ``fitted`` are the words of a text that count for the frequencies, ``looked`` the words that are looked up, both as one text
    with blanks.  Words travel once per block of texts, not once per text: the blocks list their words, these get their idf,
    and each block meets its own list.
    """
    vocabulary = texts.select("_block", "table_id", fitted.alias("text")).mapInArrow(
        _block_words, "_block long, table_id string, word string, n long")
    totals = texts.groupBy("table_id").agg(F.count(F.lit(1)).alias("total"))
    df = F.sum("n").over(Window.partitionBy("table_id", "word"))  # a row per block
    known = attach(vocabulary.withColumn("df", df), totals, ["table_id"], ["word"]).select(
        "_block", "table_id", "word", (F.ln((1 + F.col("total")) / (1 + F.col("df"))) + 1).alias("idf"))

    def scored(block: pa.Table, words_known: pa.Table) -> pa.Table:
        block, found = block.combine_chunks(), block.select(ids)
        values = score(*_looked_up(block, words_known)) if block.num_rows else np.zeros(0)
        return found.append_column("score", pa.array(values, pa.float64()))

    kinds = ", ".join(f"{c} {texts.schema[c].dataType.simpleString()}" for c in ids)
    asked = texts.select("_block", *ids, looked.alias("text"))
    return asked.groupBy("_block").cogroup(known.groupBy("_block")).applyInArrow(scored, f"{kinds}, score double")


def _blocks(texts: DataFrame, text: str) -> DataFrame:
    """``texts``, written once, each with the number of its block; the lengths of ``text`` tell where a block ends."""

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        before = np.zeros(2, np.int64)  # texts and bytes of the task
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
            upto = np.stack([np.arange(1, len(sizes) + 1), np.cumsum(sizes, dtype=np.int64)], axis=1) + before
            if len(upto):
                before = upto[-1]
            block = first + (upto // [BLOCK_TEXTS, BLOCK_BYTES]).sum(axis=1)  # one more wherever either is full
            yield batch.append_column("_block", pa.array(block, pa.int64()))

    kinds = ", ".join(f"{c} {kind}" for c, kind in texts.dtypes)
    return materialize(texts.mapInArrow(numbered, f"{kinds}, _block long"), "zstd")


def row_tfidf(cells: DataFrame, dropna: bool = False) -> DataFrame:
    """``(table_id, row_idx, score)``: sum of the L2-normalised TF-IDF vector of the row's text.

    A row is a document, all its cells joined.  A missing cell reads ``nan``
    unless ``dropna``.  idf = ln((1 + rows) / (1 + df)) + 1.
    """
    text = F.col("value") if dropna else F.coalesce("value", F.lit("nan"))
    joined = F.array_join(F.collect_list(F.array_join(words(text, TOKEN), " ")), " ")
    # Dealt by ranges, a block has rows of few tables, and so few words for its length.
    rows = _blocks(cells.repartitionByRange("table_id", "row_idx").groupBy("table_id", "row_idx").agg(joined.alias("words")), "words")
    placed = F.col("table_id").isNotNull()

    def score(row: np.ndarray, times: np.ndarray, idf: np.ndarray, n: np.ndarray) -> np.ndarray:
        v = times * idf
        length = np.sqrt(np.bincount(row, v * v, len(n)))
        return np.bincount(row, v, len(n)) / np.where(length == 0, 1.0, length)

    scored = _scored_texts(rows.filter(placed), F.col("words"), F.col("words"), score, ["table_id", "row_idx"])
    scored = scored.withColumn("score", F.when(F.col("row_idx").isNotNull(), F.round("score", 6)).otherwise(0.0))
    return scored.unionByName(rows.filter(~placed).select("table_id", "row_idx", F.lit(0.0).alias("score")))


def order_rows_by_tfidf(cells: DataFrame, dropna: bool = False, limit: int | None = None) -> DataFrame:
    """Rows by descending TF-IDF sum; scores are rounded so ties keep their order."""
    cells = materialize(cells.select(*CELL), "zstd")  # read for the scores and for the rows
    return _renumber(cells, row_tfidf(cells, dropna), [F.desc("score"), F.col("row_idx")], limit)


def sort_columns_by_value(cells: DataFrame, limit: int | None = None) -> DataFrame:
    """Sort every column on its own, missing cells last; numeric columns as numbers.

    Row alignment is destroyed on purpose.
    """
    numeric = column_types(cells).select(
        "table_id", "col_idx", F.col("dtype").isin("int", "float").alias("_numeric"))
    number = F.when(F.col("_numeric"), F.expr("try_cast(value AS double)"))
    order = [F.col("value").isNull(), number, F.col("value"), F.col("row_idx")]
    ranked = rank_within(attach(cells, numeric, ["table_id", "col_idx"], ["row_idx"]), ["table_id", "col_idx"], order, "_rank", limit)
    return ranked.withColumn("row_idx", F.col("_rank") - 1).select(*CELL)


def cell_idf(cells: DataFrame) -> DataFrame:
    """``(table_id, row_idx, col_idx, score)`` per cell with a value: mean idf of its words.

    The frequencies are fitted on all non-missing cells of the table (a cell is
    a document, its tokens have two or more word characters); the value is cut
    at white space, and a word that is no fitted token counts 0.
    """
    cells = cells if "_block" in cells.columns else _blocks(cells, "value")
    known = cells.filter(F.col("value").isNotNull() & F.col("table_id").isNotNull())

    def score(row: np.ndarray, times: np.ndarray, idf: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.bincount(row, times * idf, len(n)) / n

    tokens = F.array_join(words(F.col("value"), TOKEN), " ")
    scored = _scored_texts(known, tokens, squeeze(F.lower("value")), score, ["table_id", "row_idx", "col_idx"])
    return scored.withColumn("score", F.round("score", 6))


def sort_columns_by_idf(cells: DataFrame, limit: int | None = None) -> DataFrame:
    """Each column by descending mean idf of its cells; missing cells last, ties keep their order."""
    place = ["table_id", "row_idx", "col_idx"]
    cells = _blocks(cells, "value")  # read for the words, the scores and the rows
    # Texts stay out of the ranking: only places and scores are sorted.
    missing = cells.filter(F.col("value").isNull() | F.col("table_id").isNull()).select(*place, F.lit(-1.0).alias("score"))
    scored = cell_idf(cells).unionByName(missing)
    ranked = rank_within(scored, ["table_id", "col_idx"], [F.desc("score"), F.col("row_idx")], "_rank", limit)
    return (
        cells.join(ranked.select(*place, "_rank"), place)
        .withColumn("row_idx", F.col("_rank") - 1).select(*CELL)
    )


def distinct_columns(cells: DataFrame, limit: int | None = None) -> DataFrame:
    """Distinct values of each column in first-seen order (a missing cell counts as one
    value), padded with missing cells to the longest column of the table."""
    firsts = cells.groupBy("table_id", "col_idx", "col_name", "value").agg(F.min("row_idx").alias("_first"))
    ranked = (
        rank_within(firsts, ["table_id", "col_idx"], [F.col("_first")], "_rank", limit)
        .withColumn("row_idx", F.col("_rank") - 1).select(*CELL)
    )
    lengths = firsts.groupBy("table_id", "col_idx", "col_name").agg(F.count(F.lit(1)).alias("n"))
    longest = lengths.groupBy("table_id").agg(F.max("n").alias("top"))
    top = F.col("top") if limit is None else F.least("top", F.lit(limit))
    # Padding is generated in chunks: one array element per missing cell would not fit a row.
    chunk = 65536
    gaps = lengths.join(longest, "table_id").select("table_id", "col_idx", "col_name", "n", top.alias("top"))
    starts = gaps.filter(F.col("n") < F.col("top")).select(
        "table_id", "col_idx", "col_name", "top",
        F.explode(F.sequence(F.col("n"), F.col("top") - 1, F.lit(chunk).cast("long"))).alias("start"))
    pads = starts.select(
        "table_id",
        F.explode(F.sequence(F.col("start"), F.least(F.col("start") + chunk, F.col("top")) - 1)).alias("row_idx"),
        "col_idx", "col_name", F.lit(None).cast("string").alias("value"))
    return ranked.unionByName(pads)


def head_rows(cells: DataFrame, n: int = 30) -> DataFrame:
    """The first ``n`` rows: a plain filter, because ``row_idx`` is a dense position."""
    return cells.filter(F.col("row_idx") < n)


def rate_sample(cells: DataFrame, n: int = 30) -> DataFrame:
    """Every ``max(1, floor(rows / n))``-th row."""
    rate = cells.groupBy("table_id").agg(
        F.greatest(F.lit(1), F.floor((F.max("row_idx") + 1) / n)).cast("long").alias("_rate"))
    return (
        attach(cells, rate, ["table_id"], ["row_idx"])
        .filter(F.col("row_idx") % F.col("_rate") == 0)
        .withColumn("row_idx", F.expr("row_idx div _rate"))
        .select(*CELL)
    )


def blank_headers(cells: DataFrame, only_unnamed: bool = False) -> DataFrame:
    """Blank all headers, or only generated ``unnamed`` ones (the others are trimmed)."""
    if not only_unnamed:
        return cells.withColumn("col_name", F.lit(""))
    name = F.trim("col_name")
    return cells.withColumn(
        "col_name", F.when(F.contains(F.lower(name), F.lit("unnamed")), F.lit("")).otherwise(name))


def cap(cells: DataFrame, rows: int = 64, cols: int = 64, n_words: int = 64) -> DataFrame:
    """At most ``rows`` x ``cols`` cells per table and ``n_words`` words per cell and header."""
    return cells.filter((F.col("row_idx") < rows) & (F.col("col_idx") < cols)).withColumns(
        {"value": first_words(F.col("value"), n_words), "col_name": first_words(F.col("col_name"), n_words)})


PROCESSES = {
    "remove_rows_with_nulls": lambda cells, limit: drop_null_rows(cells, 2, limit),
    "prioritize_non_null_rows": order_by_nulls,
    "remove_rows_with_nulls_and_shuffle": lambda cells, limit: shuffle_rows(drop_null_rows(cells, 2), limit=limit),
    "sort_by_tfidf": lambda cells, limit: order_rows_by_tfidf(cells, False, limit),
    "sort_by_tfidf_dropna": lambda cells, limit: order_rows_by_tfidf(cells, True, limit),
    "value_based_sort_column": sort_columns_by_value,
    "sort_col_independent_tfidf_dropna": sort_columns_by_idf,
    "sample_columns_distinct": distinct_columns,
}
SAMPLERS = {"head": head_rows, "sample": sample_rows, "rate": rate_sample}


def select_rows(cells: DataFrame, process: str | None = None, sampler: str = "head", n: int = 30) -> DataFrame:
    """A row-selection process followed by a sampler, both by name.

    With the ``head`` sampler the process keeps only its first ``n`` rows, so
    the ranking is pruned in the map tasks instead of sorting whole tables.
    """
    if sampler not in SAMPLERS:
        raise ValueError(f"unknown sampler: {sampler}")
    if process is not None and process not in PROCESSES:
        raise ValueError(f"unknown process: {process}")
    if process is None:
        return SAMPLERS[sampler](cells, n)
    if sampler == "head":
        return PROCESSES[process](cells, n)
    return SAMPLERS[sampler](PROCESSES[process](cells, None), n)

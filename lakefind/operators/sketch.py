"""MinHash sketches of value sets and the containment filter built on them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from lakefind.functions.ranking import rank_within
from lakefind.operators.overlap import PAIR, containment, set_sizes
from lakefind.session import materialize

PRIME = (1 << 61) - 1
LOW = (1 << 31) - 1
ROWS_PER_STEP = 2048  # values hashed at a time
HELD_COLUMNS = 4096  # signatures a task holds before it hands them on
MAX_BAND_ROWS = 8
MIN_BAND_ROWS = 2  # one position alone is one shared value: a list as long as the value is common
INDEX_RECALL = 0.95  # chance with which the worst pair at the threshold meets in a band of the index
LONG_LIST = 1024  # columns of one band key that one task compares with a query
LEAST_SAMPLE = 64  # values of a column, at least, that ask for its containing columns


def permutations(num_perm: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (28 bits) and offsets (60 bits) of the hash family, from a rule."""

    def bits(name: str, i: int, digits: int) -> int:
        return int(hashlib.md5(f"{name}{i}".encode()).hexdigest()[:digits], 16)

    a = [bits("a", i, 7) + 1 for i in range(num_perm)]
    b = [bits("b", i, 15) for i in range(num_perm)]
    return np.array(a, np.int64), np.array(b, np.int64)


def base_hash(value: str | Column) -> Column:
    """60 bits of md5: wide enough that a column of billions of values does not collide."""
    return F.conv(F.substring(F.md5(value), 1, 15), 16, 10).cast("long")


def _permuted(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(a * h + b) mod 2^61 - 1 for all pairs, without overflowing 64 bits."""
    high = a[None, :] * (h >> 31)[:, None]
    low = a[None, :] * (h & LOW)[:, None]
    # high * 2^31 mod 2^61 - 1 is a rotation of the 61 bits
    rotated = (high >> 30) + ((high & ((1 << 30) - 1)) << 31)
    return ((rotated + low) % PRIME + b[None, :]) % PRIME


def minhash(sets: DataFrame, num_perm: int = 128) -> DataFrame:
    """``(table_id, col_idx, sig)``: minimum of every permutation over the column's values.

    Tasks reduce their values to one partial signature per column, so the
    shuffle carries signatures, not values, and a huge column is just many
    partial signatures.
    """
    a, b = permutations(num_perm)

    def flush(held: dict) -> pa.RecordBatch:
        sigs = np.stack(list(held.values()))
        return pa.RecordBatch.from_arrays(
            [pa.array([t for t, _ in held], pa.string()), pa.array([c for _, c in held], pa.int32()),
             pa.ListArray.from_arrays(np.arange(len(sigs) + 1) * num_perm, sigs.ravel())],
            names=["table_id", "col_idx", "sig"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            frame = batch.to_pandas().sort_values(["table_id", "col_idx"])
            for at in range(0, len(frame), ROWS_PER_STEP):
                step = frame.iloc[at:at + ROWS_PER_STEP]
                ids = list(zip(step["table_id"], step["col_idx"]))
                starts = [i for i, key in enumerate(ids) if i == 0 or key != ids[i - 1]]
                lows = np.minimum.reduceat(_permuted(step["h"].to_numpy(), a, b), starts, axis=0)
                for i, low in zip(starts, lows):
                    held[ids[i]] = np.minimum(held[ids[i]], low) if ids[i] in held else low
            if len(held) > HELD_COLUMNS:
                yield flush(held)
                held = {}
        if held:
            yield flush(held)

    hashed = sets.select("table_id", F.col("col_idx").cast("int").alias("col_idx"), base_hash("value").alias("h"))
    parts = hashed.mapInArrow(partial, "table_id string, col_idx int, sig array<bigint>")
    lows = parts.select("table_id", "col_idx", F.posexplode("sig").alias("at", "low")).groupBy(
        "table_id", "col_idx", "at").agg(F.min("low").alias("low"))
    ordered = F.sort_array(F.collect_list(F.struct("at", "low")))
    return lows.groupBy("table_id", "col_idx").agg(ordered.alias("s")).select(
        "table_id", "col_idx", F.transform("s", lambda p: p["low"]).alias("sig"))


def jaccard(left: Column, right: Column) -> Column:
    """Share of equal signature positions."""
    equal = F.zip_with(left, right, lambda x, y: (x == y).cast("int"))
    return F.aggregate(equal, F.lit(0), lambda n, e: n + e) / F.size(left)


def union_sketch(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda x, y: F.least(x, y))


def cardinality(sig: Column) -> Column:
    """Estimated set size: p / sum(min / max_hash) - 1."""
    total = F.aggregate(sig, F.lit(0.0), lambda s, x: s + x.cast("double") / F.lit(float(PRIME)))
    return F.size(sig) / total - 1


def _sides(sigs: DataFrame, pairs: DataFrame) -> DataFrame:
    q = sigs.select(F.col("table_id").alias("query_table"), F.col("col_idx").alias("query_col"),
                    F.col("sig").alias("q_sig"))
    c = sigs.select(F.col("table_id").alias("cand_table"), F.col("col_idx").alias("cand_col"),
                    F.col("sig").alias("c_sig"))
    return pairs.join(q, ["query_table", "query_col"], "left").join(c, ["cand_table", "cand_col"], "left")


def estimate(sigs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Jaccard, union size and containment estimates of the listed pairs; null for an empty query set."""
    both = _sides(sigs, pairs.select(*PAIR).distinct())
    union_size = cardinality(union_sketch(F.col("q_sig"), F.col("c_sig")))
    return both.select(
        *PAIR, jaccard(F.col("q_sig"), F.col("c_sig")).alias("jaccard"), union_size.alias("union_size"),
        cardinality(F.col("q_sig")).alias("query_size"),
    ).withColumn("containment", F.col("jaccard") * F.col("union_size") / F.col("query_size"))


def _band_choice(ratio: float, threshold: float, num_perm: int) -> tuple[int, int]:
    """Bands and rows with the least expected error for a set-size ratio u / q.

    A pair with containment t has Jaccard t / (1 + u/q - t) at best, and meets
    in a band with probability 1 - (1 - s^r)^b.  False positives below the
    threshold and false negatives above it are integrated on a fixed grid.
    """
    top = min(1.0, ratio)
    step = 0.01
    low = np.arange(0, min(threshold, top), step) + step / 2
    high = np.arange(threshold, top, step) + step / 2
    best = (np.inf, 1, 1)
    for r in range(1, MAX_BAND_ROWS + 1):
        bands = np.arange(1, num_perm // r + 1)[:, None]

        def meets(t: np.ndarray) -> np.ndarray:
            s = np.clip(t / (1 + ratio - t), 0, 1)
            return 1 - (1 - s**r) ** bands

        error = np.round((meets(low).sum(axis=1) + (1 - meets(high)).sum(axis=1)) * step, 9)
        at = int(np.argmin(error))
        best = min(best, (float(error[at]), at + 1, r))
    return best[1], best[2]


def _bands(threshold: float, num_perm: int):
    @F.pandas_udf(StructType([StructField("b", IntegerType()), StructField("r", IntegerType())]))
    def choose(ratio: pd.Series) -> pd.DataFrame:
        known = {x: _band_choice(x, threshold, num_perm) for x in ratio.unique()}
        return pd.DataFrame([known[x] for x in ratio], columns=["b", "r"])

    return choose


def size_part(n: str | Column) -> Column:
    """Number of the half octave in which a set size lies: floor(2 log2 n), in whole numbers."""
    n = (F.col(n) if isinstance(n, str) else n).cast("bigint")
    return F.length(F.bin(n * n)) - 1


def band_shape(gap: int, threshold: float, num_perm: int) -> tuple[int, int] | None:
    """``(bands, rows)`` for a lake part ``gap`` half octaves above the query's; None if none is sure enough.

    The worst pair at the threshold has the largest set of the part and the smallest query, a size ratio
    of 2^((gap + 1) / 2).  The most rows per band that still find it keep the candidates few.
    """
    j = threshold / (1 + 2 ** ((gap + 1) / 2) - threshold)
    for r in range(MAX_BAND_ROWS, MIN_BAND_ROWS - 1, -1):
        for b in range(1, num_perm // r + 1):
            if 1 - (1 - j**r) ** b >= INDEX_RECALL:
                return b, r
    return None


def least_gap(threshold: float) -> int:
    """The lowest part, relative to the query's, that can hold a containing set at all."""
    return int(np.floor(2 * np.log2(threshold)))


def _split_lists(asked: DataFrame, listed: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides of an equi-join on ``key`` with ``_slice``: long lists are dealt over slices that all askers visit."""
    long = listed.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / LONG_LIST).cast("int").alias("_n")).filter("_n > 1")
    slices = F.coalesce(F.col("_n"), F.lit(1))
    dealt = listed.join(long, key, "left").withColumn("_slice", F.pmod(F.xxhash64("rep"), slices).cast("int")).drop("_n")
    visits = asked.join(long, key, "left").withColumn("_slice", F.explode(F.sequence(F.lit(0), slices - 1))).drop("_n")
    return visits, dealt


def banded_pairs(sigs: DataFrame, sizes: DataFrame, threshold: float) -> DataFrame:
    """``PAIR`` rows of columns whose sizes are near enough for bands, from an index by set size.

    The lake is cut into parts of half an octave of set size.  A query asks every part that may hold its
    containing columns with the band shape tuned to (its own part, that part), in one equi-join on (part, rows, band, key).
    Columns with equal signature and part meet as one class, so copies do not multiply in the join; only the result lists them.
    """
    spark = sigs.sparkSession
    column = ["table_id", "col_idx"]
    sized = materialize(sigs.join(sizes, column).select(*column, "sig", size_part("n_distinct").alias("part")))
    known = sized.groupBy("part").agg(F.max(F.size("sig")).alias("n")).collect()  # at most 126 rows
    num_perm, parts = max((r["n"] for r in known), default=0), sorted(r["part"] for r in known)
    shapes = {gap: band_shape(gap, threshold, num_perm) for gap in range(least_gap(threshold), 126)}
    asks = [(q, p, *shapes[p - q]) for q in parts for p in parts if shapes.get(p - q)]
    lists = {}
    for _, p, b, r in asks:
        lists[p, r] = max(b, lists.get((p, r), 0))
    classes = materialize(sized.groupBy("sig", "part").agg(F.min(F.struct(*column)).alias("rep")))
    asks = spark.createDataFrame(asks, "part int, to int, b int, r int")
    lists = spark.createDataFrame([(p, p, b, r) for (p, r), b in lists.items()], "part int, to int, b int, r int")

    def keyed(plan: DataFrame) -> DataFrame:  # a plan has one row per pair of parts
        bands = F.transform(F.sequence(F.lit(0), F.col("b") - 1),
                            lambda i: F.xxhash64(F.slice("sig", i * F.col("r") + 1, F.col("r"))))
        return classes.join(F.broadcast(plan), "part").select("rep", "to", "r", F.posexplode(bands).alias("band", "key"))

    key = ["to", "r", "band", "key"]
    asked, listed = _split_lists(keyed(asks), keyed(lists), key)
    met = asked.withColumnRenamed("rep", "x").join(listed.withColumnRenamed("rep", "y"), [*key, "_slice"]).select("x", "y").distinct()
    of = sized.join(classes, ["sig", "part"]).select("rep", *column)
    q = of.select(F.col("rep").alias("x"), F.col("table_id").alias("query_table"), F.col("col_idx").alias("query_col"))
    c = of.select(F.col("rep").alias("y"), F.col("table_id").alias("cand_table"), F.col("col_idx").alias("cand_col"))
    return met.join(q, "x").join(c, "y").filter(F.col("query_table") != F.col("cand_table")).select(*PAIR)


def sampled(threshold: float) -> int:
    """Values to draw so that half of the expected hits is 5.6 deviations below a pair at the threshold."""
    return max(LEAST_SAMPLE, int(np.ceil(128 * (1 - threshold) / threshold - 1e-9)))


def containment_pairs(sets: DataFrame, threshold: float = 0.5, from_gap: int | None = None) -> DataFrame:
    """``(PAIR, containment)``: columns of other tables that hold at least ``threshold`` of a column's values.

    Signatures of sets of very different size hardly ever agree, so no banding finds a small column inside a
    large one.  Here the ``sampled(threshold)`` values of a column with the smallest hashes are looked up in all value
    sets, at a cost and with a recall that do not depend on the size of the containing column.  A column
    with no more values is looked up whole and loses nothing; a larger one asks for half the
    hits it expects, which a pair at the threshold misses with probability 4e-9 at 0.5 and about 1e-8 elsewhere.  The commonest
    values are left out as far as that number allows, and the pairs found are verified exactly.  With
    ``from_gap`` only columns at least so many half octaves larger are looked for.
    """
    column = ["table_id", "col_idx"]
    n_drawn = sampled(threshold)
    sets = materialize(sets.select(*column, "value"))
    drawn = rank_within(sets.withColumn("h", base_hash("value")), column, [F.col("h"), F.col("value")], "at", limit=n_drawn)
    commonness = sets.groupBy("value").agg(F.count(F.lit(1)).alias("n_columns"))
    asked = rank_within(drawn.select(*column, "value").join(commonness, "value"), column,
                        [F.col("n_columns"), F.col("value")], "at", limit=n_drawn)
    sizes = materialize(set_sizes(sets).withColumn("part", size_part("n_distinct")))
    needs = sizes.withColumn("n_drawn", F.least("n_distinct", F.lit(n_drawn)))
    share = F.when(F.col("n_distinct") <= n_drawn, F.lit(threshold)).otherwise(F.lit(threshold / 2))
    needs = needs.withColumn("need", F.greatest(F.lit(1), F.ceil(F.col("n_drawn") * share - 1e-9)))
    # of ``need`` hits at most ``spare`` can lie among the ``spare`` commonest values
    needs = needs.withColumn("spare", F.floor((F.col("need") - 1) / 2))
    rare = asked.join(needs, column).filter(F.col("at") <= F.col("n_drawn") - F.col("spare"))
    q = rare.select(F.col("table_id").alias("query_table"), F.col("col_idx").alias("query_col"), "value",
                    (F.col("need") - F.col("spare")).alias("need"), F.col("part").alias("q_part"))
    c = sets.select(F.col("table_id").alias("cand_table"), F.col("col_idx").alias("cand_col"), "value")
    far = F.col("query_table") != F.col("cand_table")
    if from_gap is not None:
        c = c.join(sizes.select(F.col("table_id").alias("cand_table"), F.col("col_idx").alias("cand_col"),
                                F.col("part").alias("c_part")), ["cand_table", "cand_col"])
        far &= F.col("c_part") - F.col("q_part") >= from_gap
    hits = q.join(c, "value").filter(far).groupBy(*PAIR).agg(
        F.count(F.lit(1)).alias("hits"), F.first("need").alias("need"))
    found = hits.filter(F.col("hits") >= F.col("need"))
    return containment(sets, found).filter(F.col("containment") >= threshold)


def candidate_pairs(sets: DataFrame, sigs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``PAIR`` rows: the columns of other tables that may contain ``threshold`` of a column, whatever the sizes.

    Columns of similar size come from the bands of the size index, unverified; parts so much larger
    that no band shape is sure enough are asked by drawn values, which are verified.
    """
    first = sigs.select(F.size("sig")).first()
    gap, num_perm = least_gap(threshold), first[0] if first else 0
    while band_shape(gap, threshold, num_perm):
        gap += 1
    near = banded_pairs(sigs, set_sizes(sets), threshold)
    return near.unionByName(containment_pairs(sets, threshold, gap).select(*PAIR))


def containment_filter(sigs: DataFrame, sizes: DataFrame, candidates: DataFrame, threshold: float = 0.8,
                       num_part: int = 32, num_perm: int = 128) -> DataFrame:
    """Keep the candidates of each query that probably contain ``threshold`` of it.

    Every query filters its own candidate list, all queries in one job.  A
    list is cut by set size into ``num_part`` parts of equal depth; the bands
    of a part are tuned to its largest set and the query size, and a candidate
    stays when it shares a band with the query.
    """
    query = ["query_table", "query_col"]
    pairs = candidates.select(*PAIR).distinct()
    q = sizes.select(F.col("table_id").alias("query_table"), F.col("col_idx").alias("query_col"),
                     F.col("n_distinct").alias("q_n"))
    c = sizes.select(F.col("table_id").alias("cand_table"), F.col("col_idx").alias("cand_col"),
                     F.col("n_distinct").alias("c_n"))
    sized = pairs.join(q, query).join(c, ["cand_table", "cand_col"])
    lengths = sized.groupBy(*query).agg(F.count(F.lit(1)).alias("n"))
    ranked = rank_within(sized, query, [F.col("c_n"), F.col("cand_table"), F.col("cand_col")], "at").join(lengths, query)
    parted = ranked.withColumn("part", F.floor((F.col("at") - 1) * num_part / F.col("n")))
    tops = parted.groupBy(*query, "q_n", "part").agg(F.max("c_n").alias("u"))
    ratios = tops.select((F.col("u") / F.col("q_n")).alias("ratio")).distinct()
    tuned = tops.withColumn("ratio", F.col("u") / F.col("q_n")).join(
        ratios.withColumn("band", _bands(threshold, num_perm)("ratio")), "ratio")
    ready = _sides(sigs, parted.join(tuned.select(*query, "part", "band.b", "band.r"), [*query, "part"]))
    # first positions of the bands, then all positions of one band must agree
    meets = F.exists(
        F.sequence(F.lit(0), F.col("b") - 1),
        lambda i: F.slice("q_sig", i * F.col("r") + 1, F.col("r")) == F.slice("c_sig", i * F.col("r") + 1, F.col("r")))
    return ready.filter(meets).select(*PAIR)


def verified_filter(sets: DataFrame, candidates: DataFrame, threshold: float = 0.8, num_part: int = 32,
                    num_perm: int = 128) -> DataFrame:
    """The filter followed by exact containment: no false positive is left."""
    kept = containment_filter(minhash(sets, num_perm), set_sizes(sets), candidates, threshold, num_part, num_perm)
    return containment(sets, kept).filter(F.col("containment") >= threshold)


def rerank(candidates: DataFrame, estimates: DataFrame) -> DataFrame:
    """Candidates of each query by descending containment estimate (to nine digits), ties in their former order."""
    scored = candidates.withColumnRenamed("rank", "old_rank").join(
        estimates.select(*PAIR, "containment"), PAIR, "left")
    order = [F.desc_nulls_last(F.round("containment", 9)), F.col("old_rank"), F.col("cand_table"), F.col("cand_col")]
    return rank_within(scored, ["query_table", "query_col"], order, "rank")

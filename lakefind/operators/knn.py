"""Nearest column vectors by cosine: exact, bucketed by hyperplanes, or by k-means cells.

Vectors are compared block against block with one matrix product inside an
Arrow batch, and only the best ``k`` of a block leave the task; the pairs
themselves are never rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType

from lakefind.functions.ranking import rank_within
from lakefind.functions.vectors import SCORE_DIGITS, cosine, l2_normalize, matrix, normalized
from lakefind.session import materialize

BLOCK, SPREAD = 65_536, 8  # most vectors per block of the grid, and blocks that a smaller key is cut into
SMALL_BLOCK = 8192  # vectors that are not cut further for the sake of more tasks
FOUND = 1 << 19  # rows that one block of queries may hand on
CHUNK = 1024  # queries multiplied at a time in double precision
TILE = 1 << 22  # products in single precision held at a time
RECALL = 0.9  # share of the true neighbours that the bucketed methods are set to find
MARGIN = 0.02  # added to it, for the chance of the sample
SAMPLE, SAMPLE_PAIRS = 256, 10_000  # queries, and about so many pairs with neighbours, on which they are set
MIN_BITS = 4
COPY = 1024  # comparisons that cost as much as one more copy of a vector
JOINED = 64  # comparisons that cost as much as one shortlisted pair joined with its vectors
PAIR = "query_table string, query_col int, cand_table string, cand_col int, score double"
PAIR_COLS = ["query_table", "query_col", "cand_table", "cand_col", "score"]


class Block:
    """One block of column vectors, ordered by id so that ties break by id."""

    def __init__(self, table: pa.Table, unit: bool = True):
        names, cols = table.column("table_id").to_numpy(), table.column("col_idx").to_numpy()
        order = np.lexsort((cols, names))
        self.names, self.cols, self.order = names[order], cols[order], order
        vec = matrix(table.column("vec")) if len(order) else np.zeros((0, 1))
        self.vec = (normalized(vec) if unit else vec)[order]

    def __len__(self) -> int:
        return len(self.cols)


def _first(r: np.ndarray, c: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best pairs per row, ties to the smaller column."""
    order = np.lexsort((c, -scores, r))
    sorted_r = r[order]
    return order[np.arange(len(r)) - np.searchsorted(sorted_r, sorted_r) < k]


def best_pairs(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``k`` best finite scores per row, ties to the smaller column."""
    m = scores.shape[1]
    keep = np.isfinite(scores)
    if m > k:
        keep &= scores >= np.partition(scores, m - k, axis=1)[:, m - k][:, None]
    r, c = np.nonzero(keep)
    first = _first(r, c, scores[r, c], k)
    return r[first], c[first]


def _kth(scores: np.ndarray, k: int) -> np.ndarray:
    """A value per row that at least ``k`` scores reach: the k-th largest of the maxima of disjoint sets of columns."""
    if k == 1:
        return scores.max(axis=1)
    n, sets = scores.shape[1], 16 * k
    if n >= 2 * sets:
        scores = scores[:, :n // sets * sets].reshape(len(scores), -1, sets).max(axis=1)
    return np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]


def _marked(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the few true places, eight looked at together."""
    flat = mask.ravel()
    if flat.size % 8:
        return np.nonzero(mask)
    words = np.flatnonzero(flat.view(np.uint64))
    w, bit = np.nonzero(flat.reshape(-1, 8)[words])
    return np.divmod(words[w] * 8 + bit, mask.shape[1])


def best_products(a: np.ndarray, b: np.ndarray, k: int, skip: tuple[np.ndarray, np.ndarray] | None = None,
                  most: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, column, product)``: per row of ``a`` the ``k`` rows of ``b`` with the best rounded inner products, best first.

    Ties go to the smaller column; pairs with equal codes in ``skip`` and products that are not finite are left out.
    Products in single precision tell which pairs may be among the best: their error is at most (dim + 8) 2^-24 |a| |b|, so
    pairs further below the k-th best than twice that (and a unit of the rounding) cannot be.  The rest are multiplied in
    double precision; where these are many (copies, non-finite values, few columns), the whole tile is.
    With ``most``, a limit per row and per column, a product counts as no more than both limits.
    """
    found, n = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))], len(b)
    long_a, long_b = (np.sqrt(np.einsum("ij,ij->i", m, m)) for m in (a, b))
    longest = max(long_a.max(initial=0.0), long_b.max(initial=0.0))
    single = n > 4 * k and bool(longest < 1e15)  # not so with NaN
    if single:
        b32 = b.astype(np.float32)
        slack = 2 * (a.shape[1] + 8) * 2.0**-24 * long_a * long_b.max() + 1.01 * 10.0**-SCORE_DIGITS
        if most is not None:  # put into single precision, a limit errs by no more than 2^-24 of itself
            most32, slack = most[1].astype(np.float32), slack + 2.0**-22 * max(1.0, np.abs(most[1]).max())
    if skip is not None:
        by_code = np.argsort(skip[1], kind="stable")
        codes = skip[1][by_code]
    step = max(8, min(CHUNK, TILE // max(1, n) // 8 * 8))
    for at in range(0, len(a) if n else 0, step):
        part = a[at:at + step]
        out = None
        if skip is not None:
            mine = skip[0][at:at + step]
            lo, hi = np.searchsorted(codes, mine, "left"), np.searchsorted(codes, mine, "right")
            if (hi - lo).sum() > len(part) * n // 16:
                out = mine[:, None] == skip[1][None, :]
            elif (hi - lo).any():
                out_r = np.repeat(np.arange(len(part)), hi - lo)
                within = np.arange(len(out_r)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)
                out = (out_r, by_code[np.repeat(lo, hi - lo) + within])
        r = None
        if single:
            scores = part.astype(np.float32) @ b32.T
            if most is not None:
                np.minimum(scores, most32, out=scores)
            if out is not None:
                scores[out] = -np.inf
            low = _kth(scores, k)
            if most is not None:
                low = np.minimum(low, most[0][at:at + step])
            # one step down, as the limit itself is put into single precision; what is left out is -inf
            low = np.nextafter((low - slack[at:at + step]).astype(np.float32), np.float32(-np.inf))
            mask = scores >= np.maximum(low, np.finfo(np.float32).min)[:, None]
            if np.count_nonzero(mask) <= mask.size // 32 + k * len(part):
                r, c = _marked(mask)
                exact = np.einsum("ij,ij->i", part[r], b[c])
                if most is not None:
                    exact = np.minimum(exact, np.minimum(most[0][at + r], most[1][c]))
        if r is not None:
            first = _first(r, c, np.round(exact, SCORE_DIGITS), k)
            found.append((r[first] + at, c[first], exact[first]))
            continue
        if isinstance(out, tuple):
            mask = np.zeros((len(part), n), bool)
            mask[out] = True
            out = mask
        for lo in range(0, len(part), 64):  # the plain way
            scores = part[lo:lo + 64] @ b.T
            if most is not None:
                scores = np.minimum(scores, np.minimum(most[0][at + lo:at + lo + 64][:len(scores), None], most[1][None, :]))
            if out is not None:
                scores[out[lo:lo + 64]] = -np.inf
            r, c = best_pairs(np.round(scores, SCORE_DIGITS), k)
            found.append((r + lo + at, c, scores[r, c]))
    return tuple(np.concatenate(x) for x in zip(*found))


WIDE, HIGH = 1024, 512  # columns and rows of a tile of products that stays in a processor's cache


def _best_of_rows(a: np.ndarray, b: np.ndarray, wide: int, tops: np.ndarray, slack: np.ndarray, skip: tuple[np.ndarray, np.ndarray]):
    """Column (-1: none) and rounded product of the best row of ``b`` per row of ``a``.

    ``tops`` has the largest product in single precision per row and tile of ``wide`` columns; only tiles that may
    hold the best one are multiplied, in double precision.
    """
    best, score = np.full(len(a), -1), np.full(len(a), -np.inf)
    low = tops.max(axis=1) - slack
    for t in range(tops.shape[1]):
        rows = np.flatnonzero((tops[:, t] >= low) & (tops[:, t] > -np.inf))  # -inf: nothing is left
        if not len(rows):
            continue
        at = t * wide
        products = a[rows] @ b[at:at + wide].T
        r, c = skip[0], skip[1] - at
        here = np.flatnonzero((c >= 0) & (c < products.shape[1]))
        place = np.full(len(a), -1)
        place[rows] = np.arange(len(rows))
        here = here[place[r[here]] >= 0]
        products[place[r[here]], c[here]] = -np.inf
        r, c = np.nonzero(products >= (products.max(axis=1) - 1.01 * 10.0**-SCORE_DIGITS)[:, None])
        rounded = np.round(products[r, c], SCORE_DIGITS)
        first = _first(r, c, rounded, 1)  # ties to the smaller column
        first, found = c[first], rounded[first]
        better = found > score[rows]
        best[rows[better]], score[rows[better]] = at + first[better], found[better]
    return best, score


def nearest_products(a: np.ndarray, b: np.ndarray, skip: tuple[np.ndarray, np.ndarray], back: bool = False):
    """``best_products`` with one row of ``b`` per row of ``a``, as ``(row, column, rounded product)``; faster for many rows.

    With ``back`` also the same of ``b`` in ``a``, from the same products.
    """
    long_a, long_b = (np.sqrt(np.einsum("ij,ij->i", m, m)) for m in (a, b))
    most_a, most_b = long_a.max(initial=0.0), long_b.max(initial=0.0)
    if not (len(a) and len(b) > 4 and max(most_a, most_b) < 1e15):  # not so with NaN
        ways = [(a, b, skip), (b, a, skip[::-1])][:1 + back]
        found = [best_products(x, y, 1, codes) for x, y, codes in ways]
        found = [(r, c, np.round(products, SCORE_DIGITS)) for r, c, products in found]
        return found if back else found[0]
    by_code = np.argsort(skip[1], kind="stable")
    codes = skip[1][by_code]
    lo, hi = np.searchsorted(codes, skip[0], "left"), np.searchsorted(codes, skip[0], "right")
    out_r = np.repeat(np.arange(len(a)), hi - lo)
    out_c = by_code[np.repeat(lo, hi - lo) + np.arange(len(out_r)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)]
    # As in best_products: the error of a product in single precision, twice, and a unit of the rounding.
    error, unit = 2 * (a.shape[1] + 8) * 2.0**-24, 1.01 * 10.0**-SCORE_DIGITS
    a32, tiles = a.astype(np.float32), [np.ascontiguousarray(b[at:at + WIDE].astype(np.float32).T) for at in range(0, len(b), WIDE)]
    n_rows = -(-len(a) // HIGH)
    tops = np.full((len(a), len(tiles)), -np.inf, np.float32)
    tops_back = np.full((len(b) if back else 0, n_rows), -np.inf, np.float32)
    bounds = np.searchsorted(out_r, np.arange(n_rows + 1) * HIGH)
    held = np.empty(HIGH * WIDE, np.float32)
    for k in range(n_rows):
        at = k * HIGH
        part, mine = a32[at:at + HIGH], slice(bounds[k], bounds[k + 1])
        for t, tile in enumerate(tiles):
            products = np.matmul(part, tile, out=held[:len(part) * tile.shape[1]].reshape(len(part), -1))
            c = out_c[mine] - t * WIDE
            here = (c >= 0) & (c < products.shape[1])
            products[out_r[mine][here] - at, c[here]] = -np.inf
            tops[at:at + HIGH, t] = products.max(axis=1)
            if back:
                tops_back[t * WIDE:(t + 1) * WIDE, k] = products.max(axis=0)
    found = []
    for x, y, wide, top, slack, out in [(a, b, WIDE, tops, error * long_a * most_b + unit, (out_r, out_c)),
                                        (b, a, HIGH, tops_back, error * long_b * most_a + unit, (out_c, out_r))][:1 + back]:
        best, score = _best_of_rows(x, y, wide, top, slack, out)
        r = np.flatnonzero(best >= 0)
        found.append((r, best[r], score[r]))
    return found if back else found[0]


def table_codes(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Table ids of two blocks as integers, equal where the ids are equal."""
    codes = pd.factorize(np.concatenate([left, right]))[0]
    return codes[:len(left)], codes[len(left):]


def _block_topk(q: Block, lake: Block, k: int, skip_table: bool) -> pa.Table:
    r, c, products = best_products(q.vec, lake.vec, k, table_codes(q.names, lake.names) if skip_table else None)
    return _pairs(q, r, lake.names, lake.cols, c, np.round(products, SCORE_DIGITS))


def _pairs(q: Block, r: np.ndarray, names: np.ndarray, cols: np.ndarray, c: np.ndarray, scores: np.ndarray) -> pa.Table:
    """Pairs of places as rows; names are copied by Arrow, not as Python objects."""
    columns = [pa.array(q.names, pa.string()).take(pa.array(r)), pa.array(q.cols[r], pa.int32()),
               pa.array(names, pa.string()).take(pa.array(c)), pa.array(cols[c], pa.int32()), pa.array(scores, pa.float64())]
    return pa.table(columns, names=PAIR_COLS)


def _merge(parts: list[pd.DataFrame], k: int) -> pd.DataFrame:
    ordered = pd.concat(parts).sort_values(
        ["query_table", "query_col", "score", "cand_table", "cand_col"], ascending=[True, True, False, True, True])
    return ordered.groupby(["query_table", "query_col"], sort=False).head(k)


def _arrow(pairs: pd.DataFrame) -> pa.Table:
    schema = pa.schema([("query_table", pa.string()), ("query_col", pa.int32()), ("cand_table", pa.string()),
                        ("cand_col", pa.int32()), ("score", pa.float64())])
    return pa.Table.from_pandas(pairs[PAIR_COLS], schema=schema, preserve_index=False)


def _n_blocks(n: Column, block: int) -> Column:
    """Blocks that ``n`` vectors are cut into: few, as each is one more copy of the other side, yet enough to busy all tasks."""
    return F.greatest(F.ceil(n / block), F.least(F.ceil(n / min(block, SMALL_BLOCK)), F.lit(SPREAD))).cast("int")


def grid_apply(queries: DataFrame, lake: DataFrame, keys: list[str],
               fn: Callable[[pa.Table, pa.Table], pa.Table], schema: str, block: int = BLOCK,
               q_block: int | None = None) -> DataFrame:
    """Run ``fn(query block, lake block)`` for all blocks of queries and vectors that share ``keys``.

    Each key is cut into a grid of at most ``q_block`` x ``block`` vectors, so a
    key that holds a third of the lake is many tasks and nothing is dropped.
    """
    same = queries is lake
    queries = materialize(queries)  # counted and laid out: evaluated once
    lake = queries if same else materialize(lake)
    me = F.xxhash64("table_id", "col_idx")
    n_q = queries.groupBy(*keys).agg(_n_blocks(F.count(F.lit(1)), q_block or block).alias("_nq"))
    n_l = lake.groupBy(*keys).agg(_n_blocks(F.count(F.lit(1)), block).alias("_nl"))
    sizes = n_q.join(n_l, keys)
    ids = [*keys, "_qb", "_lb"]

    def laid_out(df: DataFrame, own: str, n_own: str, other: str, n_other: str) -> DataFrame:
        return (
            df.join(sizes, keys)
            .withColumn(own, F.pmod(me, F.col(n_own)).cast("int"))
            .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(n_other) - 1)))
            # fresh column ids, because a lake is often searched with its own columns
            .select(*[F.col(c).alias(c) for c in (*ids, *[c for c in df.columns if c not in keys])])
        )

    return (
        laid_out(queries, "_qb", "_nq", "_lb", "_nl").groupBy(*ids)
        .cogroup(laid_out(lake, "_lb", "_nl", "_qb", "_nq").groupBy(*ids))
        .applyInArrow(fn, schema)
    )


def grid_topk(queries: DataFrame, lake: DataFrame, k: int, keys: list[str], skip_table: bool = False,
              unit: bool = True, block: int = BLOCK) -> DataFrame:
    """Top ``k`` per query and block pair, for queries and vectors that share ``keys``."""

    def pair_up(q: pa.Table, lake_block: pa.Table) -> pa.Table:
        if not q.num_rows or not lake_block.num_rows:
            return _arrow(pd.DataFrame(columns=PAIR_COLS))
        return _block_topk(Block(q, unit), Block(lake_block, unit), k, skip_table)

    cols = [*keys, "table_id", "col_idx", "vec"]
    asked = queries.select(*cols)
    return grid_apply(asked, asked if queries is lake else lake.select(*cols), keys, pair_up, PAIR, block, min(block, max(1, FOUND // k)))


def merge_topk(parts: DataFrame, k: int) -> DataFrame:
    """The best ``k`` per query over partial results, with their rank."""
    order = [F.desc("score"), F.col("cand_table"), F.col("cand_col")]
    return rank_within(parts, ["query_table", "query_col"], order, "rank", limit=k)


def _vectors(df: DataFrame, *more: str) -> DataFrame:
    return df.select("table_id", F.col("col_idx").cast("int").alias("col_idx"), "vec", *more)


def exact_topk(queries: DataFrame, lake: DataFrame, k: int, skip_table: bool = False, unit: bool = True) -> DataFrame:
    """Partial top ``k`` by inner product (of unit vectors if ``unit``) over every query and vector."""
    zero = F.lit(0)
    return grid_topk(queries.withColumn("_key", zero), lake.withColumn("_key", zero), k, ["_key"], skip_table, unit)


def _hyperplane_keys(dim: int, tables: int, bits: int, seed: int):
    """Bucket per hash table: the sign bits of seeded random projections."""
    planes = np.random.default_rng(seed).standard_normal((dim, tables * bits))

    @F.arrow_udf(ArrayType(LongType()))
    def keys(vec: pa.Array) -> pa.Array:
        if len(vec) == 0:
            return pa.array([], pa.list_(pa.int64()))
        signs = (matrix(vec) @ planes > 0).reshape(len(vec), tables, bits)
        code = signs @ (1 << np.arange(bits)) + (np.arange(tables) << bits)
        return pa.ListArray.from_arrays(np.arange(len(vec) + 1) * tables, code.ravel())

    return keys


def _nearest_cells(centers: np.ndarray, n: int):
    """The ``n`` nearest k-means cells of each vector."""

    @F.arrow_udf(ArrayType(IntegerType()))
    def cells(vec: pa.Array) -> pa.Array:
        if len(vec) == 0:
            return pa.array([], pa.list_(pa.int32()))
        unit, step = normalized(matrix(vec)), max(1, TILE // 8 // len(centers))
        near = np.concatenate([  # few rows at a time: products and their order are as wide as the list of cells
            np.argsort(-(unit[at:at + step] @ centers.T), axis=1, kind="stable")[:, :n].astype(np.int32)
            for at in range(0, len(unit), step)])
        return pa.ListArray.from_arrays(np.arange(len(vec) + 1) * near.shape[1], near.ravel())

    return cells


def _bucketed(queries: DataFrame, lake: DataFrame, k: int, skip_table: bool, q_keys: Column, l_keys: Column) -> DataFrame:
    parts = grid_topk(
        queries.withColumn("_key", F.explode(q_keys)), lake.withColumn("_key", F.explode(l_keys)), k, ["_key"],
        skip_table)
    return parts.distinct()  # a candidate may meet its query in several buckets


def _within_buckets(kept: DataFrame, k: int, skip_table: bool) -> DataFrame:
    """Top ``k`` of the vectors in each of their buckets (``_keys``), without pairs that score less than ``_least`` of the query."""
    placed = kept.withColumn("_key", F.explode("_keys")).drop("_keys")
    large = materialize(kept.select(F.explode("_keys").alias("_key")).groupBy("_key").count().filter(F.col("count") > SMALL_BLOCK).select("_key"))

    def within(bucket: pa.Table) -> pa.Table:
        block = Block(bucket)
        r, c, products = best_products(block.vec, block.vec, k, table_codes(block.names, block.names) if skip_table else None)
        scores, least = np.round(products, SCORE_DIGITS), bucket.column("_least").to_numpy()[block.order]
        some = ~(scores < least[r])  # no limit is NaN
        return _pairs(block, r[some], block.names, block.cols, c[some], scores[some])

    if large.isEmpty():
        return placed.groupBy("_key").applyInArrow(within, PAIR)
    hot = placed.join(F.broadcast(large), "_key", "left_semi")
    return placed.join(F.broadcast(large), "_key", "left_anti").groupBy("_key").applyInArrow(within, PAIR).unionByName(
        grid_topk(hot, hot, k, ["_key"], skip_table))


def _bucketed_self(lake: DataFrame, k: int, skip_table: bool, keys: Column, tables: int) -> DataFrame:
    """``_bucketed`` of a lake in itself with one bucket per hash table, with the same top ``k``.

    A bucket is sent once, not as queries and as lake, and nothing is written per bucket but pairs.  The first few hash tables tell
    for every query a score that its ``k`` best reach; the others leave out what scores less.
    """
    first = max(1, round(tables**0.5))
    kept = materialize(lake.withColumns({"_keys": keys, "_least": F.lit(None).cast("double")}))
    some = _within_buckets(kept.withColumn("_keys", F.slice("_keys", 1, first)), k, skip_table).distinct()
    if first == tables:
        return some
    found = materialize(merge_topk(some, k).drop("rank"))
    least = found.groupBy(F.col("query_table").alias("table_id"), F.col("query_col").alias("col_idx")).agg(
        F.min("score").alias("_least"), F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= k).drop("_n")
    rest = kept.withColumn("_keys", F.slice("_keys", first + 1, tables - first)).drop("_least")
    rest = materialize(rest.join(least.hint("merge"), ["table_id", "col_idx"], "left"))
    return found.unionByName(_within_buckets(rest, k, skip_table)).distinct()


def derived_bits(n_vectors: int, bucket: int = 256) -> int:
    """Hyperplanes per hash table so that a bucket of evenly spread vectors holds about ``bucket``."""
    return max(4, int(np.ceil(np.log2(max(1, n_vectors) / bucket))) + 4)


def derived_lists(n_vectors: int) -> int:
    """About the square root of the lake, as usual for k-means cells."""
    return max(1, int(np.sqrt(n_vectors)))


def _dim(df: DataFrame) -> int:
    return df.select(F.size("vec")).first()[0]


def coarse_centers(lake: DataFrame, n_lists: int, seed: int = 42) -> np.ndarray:
    """Unit-length k-means centers of the lake: small model state, ``n_lists`` x dim."""
    model = KMeans(k=n_lists, seed=seed, maxIter=10, distanceMeasure="cosine", featuresCol="features").fit(
        lake.select(array_to_vector(F.col("vec").cast("array<double>")).alias("features")))
    return normalized(np.array(model.clusterCenters()))


def codebooks(lake: DataFrame, n_sub: int, n_codes: int, seed: int = 42) -> np.ndarray:
    """Product quantiser: ``n_codes`` k-means centers for each of ``n_sub`` slices of the unit vectors."""
    width = _dim(lake) // n_sub
    if width * n_sub != _dim(lake):
        raise ValueError("the dimension must be a multiple of the number of slices")
    unit = materialize(lake.select(l2_normalize("vec").alias("vec")))  # read once per slice
    books = []
    for i in range(n_sub):
        piece = unit.select(array_to_vector(F.slice("vec", i * width + 1, width)).alias("features"))
        centers = np.array(KMeans(k=n_codes, seed=seed, maxIter=10).fit(piece).clusterCenters())
        spare = np.repeat(centers[:1], n_codes - len(centers), axis=0)  # k-means may find fewer distinct ones
        books.append(np.concatenate([centers, spare]))
    return np.stack(books)


def _codes(books: np.ndarray, vec: np.ndarray) -> np.ndarray:
    """Nearest center of each slice of unit vectors."""
    parts = vec.reshape(len(vec), len(books), books.shape[2])
    return ((books**2).sum(axis=2)[None] - 2 * np.einsum("nsw,scw->nsc", parts, books)).argmin(axis=2)


def _encode(books: np.ndarray):
    """Codes of a vector: the nearest center of each slice."""
    n_sub = len(books)

    @F.arrow_udf(ArrayType(IntegerType()))
    def codes(vec: pa.Array) -> pa.Array:
        if len(vec) == 0:
            return pa.array([], pa.list_(pa.int32()))
        near = _codes(books, normalized(matrix(vec))).astype(np.int32)
        return pa.ListArray.from_arrays(np.arange(len(vec) + 1) * n_sub, near.ravel())

    return codes


def sampled_pairs(queries: DataFrame, lake: DataFrame, k: int, skip_table: bool) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of hash-drawn queries and of their true neighbours (not themselves), row by row."""
    n = max(16, min(SAMPLE, SAMPLE_PAIRS // max(1, k)))
    sample = materialize(queries.orderBy(F.xxhash64("table_id", "col_idx"), "table_id", "col_idx").limit(n))
    near = merge_topk(exact_topk(sample, lake, k, skip_table), k).filter(
        (F.col("query_table") != F.col("cand_table")) | (F.col("query_col") != F.col("cand_col")))
    q = sample.select(F.col("table_id").alias("query_table"), F.col("col_idx").alias("query_col"), F.col("vec").alias("_qv"))
    c = lake.select(F.col("table_id").alias("cand_table"), F.col("col_idx").alias("cand_col"), F.col("vec").alias("_cv"))
    both = near.join(q, ["query_table", "query_col"]).join(F.broadcast(near).select("cand_table", "cand_col").distinct().join(
        c, ["cand_table", "cand_col"]), ["cand_table", "cand_col"]).select("_qv", "_cv").toArrow()
    return normalized(matrix(both.column("_qv"))), normalized(matrix(both.column("_cv")))


def tuned_hashing(cosines: np.ndarray, n_vectors: int, recall: float, bits: int | None = None) -> tuple[int, int]:
    """Cheapest ``(bits, tables)`` that find pairs of these cosines with at least ``recall``.

    A hyperplane parts a pair with probability angle / pi.  Where no choice gets there with less than twice the
    comparisons of an exact search, all vectors go to one bucket (no bits).
    """
    together = 1 - np.arccos(np.clip(cosines, -1, 1)) / np.pi
    best = (np.inf, 0, 1)
    for b in [bits] if bits else range(MIN_BITS, derived_bits(n_vectors) + 1):
        def reached(tables: int, b: int = b) -> bool:
            return np.mean(1 - (1 - together**b) ** tables) >= recall

        low, high = 1, 2 << b
        if not reached(high):
            continue
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if reached(mid) else (mid + 1, high)
        best = min(best, (low * (n_vectors / 2**b + COPY), b, low))
    return best[1], best[2]


def cell_places(q: np.ndarray, c: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """How many cells a query probes before the one that holds its neighbour."""
    order = np.argsort(-(q @ centers.T), axis=1, kind="stable")
    own = np.argsort(-(c @ centers.T), axis=1, kind="stable")[:, :1]
    return (order == own).argmax(axis=1)


def _least(places: np.ndarray, share: float) -> int:
    """Smallest n such that at least ``share`` of the places are below n."""
    return int(np.sort(places)[max(0, int(np.ceil(share * len(places))) - 1)]) + 1


def code_places(q: np.ndarray, c: np.ndarray, coded: DataFrame, books: np.ndarray) -> np.ndarray:
    """How many vectors of the lake have better quantised scores than the neighbour; counted by the tasks."""
    n_sub, _, width = books.shape
    queries, of = np.unique(q, axis=0, return_inverse=True)
    of = of.ravel()
    products = [queries.reshape(-1, n_sub, width)[:, s] @ books[s].T for s in range(n_sub)]
    own = _codes(books, c)
    limits = np.round(sum(products[s][of, own[:, s]] for s in range(n_sub)), SCORE_DIGITS)

    def count(batches):
        total = np.zeros(len(limits), np.int64)
        for batch in batches:
            codes = matrix(batch.column("codes")).astype(int)
            for at in range(0, len(codes), CHUNK):
                step = codes[at:at + CHUNK]
                scores = np.sort(np.round(sum(products[s][:, step[:, s]] for s in range(n_sub)), SCORE_DIGITS), axis=1)
                for i in range(len(queries)):
                    mine = of == i
                    total[mine] += len(step) - np.searchsorted(scores[i], limits[mine], side="right")
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["i", "n"])

    rows = coded.mapInArrow(count, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).orderBy("i").collect()
    return np.array([r["n"] for r in rows])


def _ivf(queries: DataFrame, lake: DataFrame, k: int, skip_table: bool, centers: np.ndarray, n_probe: int) -> DataFrame:
    return _bucketed(queries, lake, k, skip_table, _nearest_cells(centers, n_probe)("vec"), _nearest_cells(centers, 1)("vec"))


def _ivfpq(queries: DataFrame, lake: DataFrame, k: int, skip_table: bool, n_lists: int, n_probe: int, n_sub: int,
           n_codes: int, refine: int, seed: int, pairs: tuple[np.ndarray, np.ndarray] | None, recall: float) -> DataFrame:
    """Shortlist by quantised codes inside the probed cells, then exact scores of the shortlist.

    Only codes travel to the cells; full vectors are joined back for the
    ``refine * k`` best of each query.  With ``pairs`` the probes and the shortlist grow until ``recall`` of them is
    found; where such a shortlist costs more than the cells themselves, these are compared whole.
    """
    centers, books = coarse_centers(lake, n_lists, seed), codebooks(lake, n_sub, n_codes, seed)
    n_sub, _, width = books.shape
    if pairs:
        cell = cell_places(*pairs, centers)
        n_probe = max(n_probe, _least(cell, (1 + recall) / 2))
        depth = code_places(*pairs, lake.select(_encode(books)("vec").alias("codes")), books)
        needed = -(-_least(np.where(cell < n_probe, depth, np.iinfo(np.int64).max - 1), recall) // k)
        if needed > refine and needed * k * JOINED > lake.count() * n_probe / len(centers):
            return _ivf(queries, lake, k, skip_table, centers, max(n_probe, _least(cell, recall)))
        refine = max(refine, needed)

    def approximate(q: pa.Table, coded: pa.Table) -> pa.Table:
        if not q.num_rows or not coded.num_rows:
            return _arrow(pd.DataFrame(columns=PAIR_COLS))
        block = Block(q)
        names, cols = coded.column("table_id").to_numpy(), coded.column("col_idx").to_numpy()
        order = np.lexsort((cols, names))
        names, cols, codes = names[order], cols[order], matrix(coded.column("codes")).astype(int)[order]
        found = []
        q_codes, l_codes = table_codes(block.names, names)
        step = max(1, min(CHUNK, TILE // 4 // len(codes)))
        for at in range(0, len(block), step):
            part = slice(at, at + step)
            pieces = block.vec[part].reshape(-1, n_sub, width)
            scores = sum((pieces[:, s] @ books[s].T)[:, codes[:, s]] for s in range(n_sub))
            if skip_table:
                scores[q_codes[part][:, None] == l_codes[None, :]] = -np.inf
            scores = np.round(scores, SCORE_DIGITS)
            r, c = best_pairs(scores, refine * k)
            found.append((r + at, c, scores[r, c]))
        r, c, scores = (np.concatenate(x) for x in zip(*found))
        return _pairs(block, r, names, cols, c, scores)

    probes = queries.withColumn("_key", F.explode(_nearest_cells(centers, n_probe)("vec")))
    coded = lake.select("table_id", "col_idx", F.explode(_nearest_cells(centers, 1)("vec")).alias("_key"),
                        _encode(books)("vec").alias("codes"))
    short = merge_topk(grid_apply(probes, coded, ["_key"], approximate, PAIR, SMALL_BLOCK,
                                  min(SMALL_BLOCK, max(1, FOUND // (refine * k)))), refine * k).drop("score", "rank")
    q = queries.select(F.col("table_id").alias("query_table"), F.col("col_idx").alias("query_col"), F.col("vec").alias("_qv"))
    c = lake.select(F.col("table_id").alias("cand_table"), F.col("col_idx").alias("cand_col"), F.col("vec").alias("_cv"))
    scored = short.join(q, ["query_table", "query_col"]).join(c, ["cand_table", "cand_col"])
    return scored.withColumn("score", cosine("_qv", "_cv")).select(*PAIR_COLS)


def knn(queries: DataFrame, lake: DataFrame, k: int, method: str = "exact", exclude_same_table: bool = False,
        tables: int = 16, bits: int | None = None, n_lists: int | None = None, n_probe: int = 10, n_sub: int = 8, n_codes: int = 256,
        refine: int = 4, seed: int = 42, recall: float | None = RECALL) -> DataFrame:
    """``(query_table, query_col, cand_table, cand_col, score, rank)``: the ``k`` nearest columns.

    ``exact`` compares every query with every vector in a grid of blocks,
    whatever the sizes.
    ``lsh``, ``ivf`` and ``ivfpq`` compare only inside shared buckets
    (``tables`` x ``bits`` hyperplanes; ``n_probe`` of ``n_lists`` cells; cells
    with ``n_sub`` codes per vector) and are the way to run a whole lake
    against itself; ``bits`` and ``n_lists`` follow the lake's size unless given.  ``tables``, ``n_probe`` and ``refine``
    are the least that is used: they grow until ``recall`` of the true neighbours of hash-drawn
    queries is found, so recall does not fall as the lake grows (``recall=None`` takes them as they are).  A small lake
    returns fewer than ``k``.
    """
    same = queries is lake
    queries, lake = _vectors(queries), _vectors(lake)
    pairs = None
    if method in ("lsh", "ivf", "ivfpq") and recall is not None:
        lake = materialize(lake)
        queries = lake if same else queries
        pairs = sampled_pairs(queries, lake, k, exclude_same_table)
        pairs = pairs if len(pairs[0]) else None
        recall = min(1.0, recall + MARGIN)
    if method == "lsh" and pairs:
        bits, needed = tuned_hashing(np.einsum("ij,ij->i", *pairs), lake.count(), recall, bits)
        tables = max(tables, needed) if bits else 1
    elif method == "lsh" and bits is None:
        bits = derived_bits(lake.count())
    if method in ("ivf", "ivfpq") and n_lists is None:
        n_lists = derived_lists(lake.count())
    if method == "exact":
        parts = exact_topk(queries, lake, k, exclude_same_table)
    elif method == "lsh":
        keys = _hyperplane_keys(_dim(lake), tables, bits, seed)
        parts = _bucketed_self(lake, k, exclude_same_table, keys("vec"), tables) if same else _bucketed(
            queries, lake, k, exclude_same_table, keys("vec"), keys("vec"))
    elif method == "ivf":
        centers = coarse_centers(lake, n_lists, seed)
        if pairs:
            n_probe = max(n_probe, _least(cell_places(*pairs, centers), recall))
        parts = _ivf(queries, lake, k, exclude_same_table, centers, n_probe)
    elif method == "ivfpq":
        parts = _ivfpq(queries, lake, k, exclude_same_table, n_lists, n_probe, n_sub, n_codes, refine, seed, pairs,
                       recall)
    else:
        raise ValueError(f"unknown search method: {method}")
    return merge_topk(parts, k)


def joinable(queries: DataFrame, lake: DataFrame, k: int, exclude_same_table: bool = False,
             method: str = "exact", position: str | None = None, **options) -> DataFrame:
    """Top-``k`` joinable columns of each query column.

    Lake mode keeps self-matches; with ``exclude_same_table`` the query's own
    table is left out before the top-k, so no over-fetching is needed.  A
    query column listed twice is searched once, with the vector of its first
    occurrence: the smallest value of the column ``position``.  Without positions rows have no
    order, and the smallest vector is taken.
    """
    first = F.min_by("vec", position) if position else F.min("vec")
    once = queries.groupBy("table_id", "col_idx").agg(first.alias("vec"))
    return knn(once, lake, k, method, exclude_same_table, **options)


def knn_by_shard(queries: DataFrame, lake: DataFrame, k: int, shard: str = "shard") -> DataFrame:
    """Top ``k`` per query and shard; ``merge_topk`` of it is the global answer.

    The shard travels with each block, so a column that lies in several shards
    is found in each of them with its own vector.
    """
    shards = [row[0] for row in lake.select(shard).distinct().collect()]  # one per folder
    everywhere = _vectors(queries).withColumn("_shard", F.explode(F.array(*[F.lit(s) for s in shards])))
    tagged = _vectors(lake, shard).withColumnRenamed(shard, "_shard")

    def pair_up(q: pa.Table, block: pa.Table) -> pa.Table:
        found = _arrow(pd.DataFrame(columns=PAIR_COLS))
        if q.num_rows and block.num_rows:
            found = _block_topk(Block(q), Block(block), k, False)
        key = (block if block.num_rows else q).column("_shard")[:1].to_pylist()
        return found.append_column("_shard", pa.array(key * len(found), q.schema.field("_shard").type))

    kind = tagged.schema["_shard"].dataType.simpleString()
    cols = ["_shard", "table_id", "col_idx", "vec"]
    parts = grid_apply(everywhere.select(*cols), tagged.select(*cols), ["_shard"], pair_up, f"{PAIR}, _shard {kind}",
                       q_block=min(BLOCK, max(1, FOUND // k)))
    order = [F.desc("score"), F.col("cand_table"), F.col("cand_col")]
    return rank_within(parts.withColumnRenamed("_shard", shard), [shard, "query_table", "query_col"], order, "rank", limit=k)

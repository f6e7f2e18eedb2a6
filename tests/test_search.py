"""Nearest columns, union search and overlap on small fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakefind.functions.vectors import l2_normalize
from lakefind.operators import knn as K
from lakefind.operators import overlap as O
from lakefind.operators import union_search as U
from lakefind.operators import vectors as V
from lakefind.operators.knn import best_pairs, best_products

VECTORS = "table_id string, col_idx int, vec array<double>"


def lake_rows(n=60, per_table=4, dim=8, seed=0):
    x = np.random.default_rng(seed).standard_normal((n, dim))
    return [(f"t{i // per_table:02d}", i % per_table, [float(v) for v in r]) for i, r in enumerate(x)]


def brute(queries, lake, k, skip_table=False):
    out = {}
    for qt, qc, qv in queries:
        scored = []
        for lt, lc, lv in lake:
            if skip_table and lt == qt:
                continue
            n = np.linalg.norm(qv) * np.linalg.norm(lv)
            scored.append((-round(float(np.dot(qv, lv) / n) if n else 0.0, 9), lt, lc))
        out[(qt, qc)] = [(t, c) for _, t, c in sorted(scored)[:k]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_table", "query_col", "rank").collect():
        out.setdefault((r.query_table, r.query_col), []).append((r.cand_table, r.cand_col))
    return out


@pytest.mark.parametrize("skip_table", [False, True])
def test_exact_whatever_the_block_size(spark, skip_table):
    rows = lake_rows()
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    want = brute(rows, rows, 7, skip_table)
    assert found(K.knn(df, df, 7, exclude_same_table=skip_table)) == want
    keyed = df.withColumn("_key", F.lit(0))
    for block in (9, 1000):
        assert found(K.merge_topk(K.grid_topk(keyed, keyed, 7, ["_key"], skip_table, block=block), 7)) == want


def test_shards_that_hold_the_same_column(spark):
    lake = spark.createDataFrame([("a", 0, [1.0, 0.0], 1), ("b", 0, [1.0, 0.1], 1), ("b", 0, [0.0, 1.0], 2), ("c", 0, [0.9, 0.5], 2)],
                                 "table_id string, col_idx int, vec array<double>, shard int")
    query = spark.createDataFrame([("q", 0, [1.0, 0.0])], VECTORS)
    got = {(r.shard, r["rank"]): (r.cand_table, round(r.score, 4)) for r in K.knn_by_shard(query, lake, 2).collect()}
    assert got == {(1, 1): ("a", 1.0), (1, 2): ("b", 0.995), (2, 1): ("c", 0.8742), (2, 2): ("b", 0.0)}


def test_first_occurrence_of_a_repeated_query(spark):
    lake = spark.createDataFrame([("x", 0, [1.0, 0.0]), ("y", 0, [0.0, 1.0])], VECTORS)
    twice = spark.createDataFrame([("q", 0, [0.0, 1.0], 1), ("q", 0, [1.0, -1.0], 2)], VECTORS + ", at int")
    assert [r.cand_table for r in K.joinable(twice, lake, 1, position="at").collect()] == ["y"]


def test_index_parameters_follow_the_lake():
    assert K.derived_bits(500) < K.derived_bits(10**6) < K.derived_bits(10**9)
    assert (K.derived_lists(100), K.derived_lists(10**8)) == (10, 10**4)


def test_hot_key_is_cut_into_blocks(spark):
    rows = lake_rows(90)
    df = spark.createDataFrame(rows, VECTORS).withColumn("_key", F.when(F.col("table_id") < "t10", 0).otherwise(1))
    parts = K.merge_topk(K.grid_topk(df, df, 5, ["_key"], block=7), 5)
    hot = [r for r in rows if r[0] < "t10"]
    want = brute(hot, hot, 5)
    got = found(parts)
    assert {q: got[q] for q in want} == want


def test_copies_tie_by_id(spark):
    rows = [(f"t{i:02d}", 0, [1.0, 0.0]) for i in range(30)] + [("z", 0, [0.0, 1.0]), ("zero", 0, [0.0, 0.0])]
    df = spark.createDataFrame(rows, VECTORS).repartition(4)
    got = found(K.knn(df, df, 3))
    assert got[("t20", 0)] == [("t00", 0), ("t01", 0), ("t02", 0)]
    assert len(got[("zero", 0)]) == 3


def test_k_beyond_the_lake_returns_fewer(spark):
    df = spark.createDataFrame(lake_rows(5), VECTORS)
    assert all(len(v) == 5 for v in found(K.knn(df, df, 50)).values())


def test_repeated_query_is_searched_once(spark):
    df = spark.createDataFrame(lake_rows(8), VECTORS)
    assert all(len(v) == 3 for v in found(K.joinable(df.union(df), df, 3)).values())


@pytest.mark.parametrize("method,options", [("lsh", {"tables": 24, "bits": 4}), ("ivf", {"n_lists": 8, "n_probe": 3}),
    ("ivfpq", {"n_lists": 8, "n_probe": 3, "n_sub": 4, "n_codes": 16, "refine": 6})])
def test_approximate_recall(spark, method, options):
    rng = np.random.default_rng(3)
    centers = rng.standard_normal((8, 16))
    x = centers[rng.integers(0, 8, 240)] + 0.3 * rng.standard_normal((240, 16))
    rows = [(f"t{i:03d}", 0, [float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, VECTORS)
    exact, approx = found(K.knn(df, df, 10)), found(K.knn(df, df, 10, method=method, **options))
    recall = np.mean([len(set(exact[q]) & set(approx[q])) / 10 for q in exact])
    assert recall > 0.9


@pytest.mark.parametrize("method,options", [("lsh", {}), ("ivf", {"n_lists": 32, "n_probe": 8}),
    ("ivfpq", {"n_lists": 32, "n_probe": 8, "n_codes": 32})])
def test_recall_of_registered_parameters_without_clusters(spark, method, options):
    x = np.random.default_rng(4).standard_normal((1200, 64))
    df = spark.createDataFrame([(f"t{i:04d}", 0, [float(v) for v in r]) for i, r in enumerate(x)], VECTORS)
    exact, approx = found(K.knn(df, df, 10)), found(K.knn(df, df, 10, method=method, **options))
    others = {q: set(near) - {q} for q, near in exact.items()}
    assert np.mean([len(others[q] & set(approx[q])) / len(others[q]) for q in exact]) >= 0.9


def test_tables_grow_with_the_lake():
    cosines = np.full(100, 0.4)
    for n in (500, 50_000, 10**7):
        bits, tables = K.tuned_hashing(cosines, n, 0.92)
        assert 1 - (1 - (1 - np.arccos(0.4) / np.pi) ** bits) ** tables >= 0.92 and bits >= K.MIN_BITS
    assert K.tuned_hashing(np.full(9, -1.0), 500, 0.92) == (0, 1)
    assert K.tuned_hashing(cosines, 500, 0.92, bits=8)[1] > K.tuned_hashing(cosines, 500, 0.92, bits=4)[1]


def test_unknown_method(spark):
    df = spark.createDataFrame(lake_rows(4), VECTORS)
    with pytest.raises(ValueError):
        K.knn(df, df, 3, method="flat-index")
    with pytest.raises(ValueError):
        V.pool(df, "median")


def test_ragged_vectors_fail(spark):
    df = spark.createDataFrame([("a", 0, [1.0, 2.0]), ("b", 0, [1.0])], VECTORS).coalesce(1)
    with pytest.raises(Exception, match="one dimension"):
        df.select(l2_normalize("vec")).collect()


def test_pooled_search_ignores_column_order(spark):
    rows = lake_rows()
    flipped = [(t, 3 - c, v) for t, c, v in rows]
    a, b = spark.createDataFrame(rows, VECTORS), spark.createDataFrame(flipped, VECTORS)
    take = lambda df: sorted(tuple(r) for r in U.union_pooled(df, df, 5).collect())
    assert take(a) == take(b)


def test_two_step_with_all_survivors_is_columnwise(spark):
    df = spark.createDataFrame(lake_rows(), VECTORS)
    take = lambda d: sorted((r.query_table, r.rank, r.cand_table) for r in d.collect())
    assert take(U.union_two_step(df, df, 4, filter_k=100)) == take(U.union_columnwise(df, df, 4))


def test_union_by_cluster_fills_and_breaks_ties(spark):
    rows = [("a", 1), ("a", 2), ("b", 1), ("b", 2), ("c", 1), ("d", -1), ("e", 3), ("f", 2), ("f", 1)]
    clusters = spark.createDataFrame([(t, i, c) for i, (t, c) in enumerate(rows)], "table_id string, col_idx int, cluster int")
    queries = spark.createDataFrame([("a",), ("d",), ("new",)], "table_id string")
    take = lambda d, q: [r.cand_table for r in d.orderBy("rank").collect() if r.query_table == q]
    full = U.union_by_cluster(queries, clusters, 5).cache()
    assert take(full, "a") == ["a", "b", "f", "c", "d"]
    assert take(full, "d") == take(full, "new") == ["a", "b", "c", "d", "e"]
    short = U.union_by_cluster(queries, clusters, 5, fill=False)
    assert take(short, "a") == ["a", "b", "f", "c"] and take(short, "d") == []


def best_by_cluster(sets, k, fill):
    """{table: [(candidate, score)]} over all pairs."""
    out = {}
    for q, own in sets.items():
        scores = [(len(own & s) / len(own | s) if own and s else 0.0, t) for t, s in sets.items()]
        out[q] = [(t, v) for v, t in sorted(scores, key=lambda x: (-x[0], x[1])) if fill or v > 0][:k]
    return out


@pytest.mark.parametrize("seed,fill", [(1, True), (2, False), (3, True)])
def test_union_by_cluster_equals_all_pairs(spark, seed, fill):
    draw = np.random.default_rng(seed)
    sets = {f"t{i:03d}": set((draw.zipf(1.3 + 0.2 * seed, draw.integers(0, 9)) % 25).tolist()) for i in range(120)}
    rows = [(t, i, c) for t, s in sets.items() for i, c in enumerate([-1, *s])]
    clusters = spark.createDataFrame(rows, "table_id string, col_idx int, cluster int")
    got = {t: [] for t in sets}
    for r in U.union_by_cluster(clusters.select("table_id"), clusters, 6, fill).orderBy("query_table", "rank").collect():
        got[r.query_table].append((r.cand_table, r.score))
    assert got == best_by_cluster(sets, 6, fill)


def test_a_cluster_of_every_table_makes_no_pairs_of_all(spark):
    n, k = 400, 5
    sets = {f"t{i:03d}": {0, 1 + i // 2, 1000 + i // 4} for i in range(n)}
    clusters = spark.createDataFrame([(t, i, c) for t, s in sets.items() for i, c in enumerate(sorted(s))],
                                     "table_id string, col_idx int, cluster int")
    distinct = U._classes(clusters)
    bounds = distinct.select("set", F.lit(0.0).alias("bound")).distinct()
    assert U.prefix_pairs(U._rare_first(distinct), bounds).count() <= 4 * n
    got = {t: [] for t in sets}
    for r in U.union_by_cluster(clusters.select("table_id"), clusters, k, False).orderBy("query_table", "rank").collect():
        got[r.query_table].append((r.cand_table, r.score))
    assert got == best_by_cluster(sets, k, False)


def test_join_profile_hand_cases(spark):
    sets = spark.createDataFrame(
        [("q", 0, str(i)) for i in range(4)] + [("same", 0, str(i)) for i in range(4)] + [("half", 0, "0"), ("half", 0, "1")]
        + [("none", 0, "x")], "table_id string, col_idx int, value string")
    pairs = spark.createDataFrame(
        [("q", 0, c, 0) for c in ("same", "half", "none", "gone")] + [("gone", 0, "q", 0)],
        "query_table string, query_col int, cand_table string, cand_col int")
    got = {(r.query_table, r.cand_table): r for r in O.join_profile(sets, pairs).collect()}
    assert got["q", "same"].containment == 1.0 and got["q", "same"].quality == 4
    assert got["q", "half"].containment == 0.5 and got["q", "half"].quality == 3
    assert got["q", "none"].containment == 0.0 and got["q", "gone"].size_2 == 0
    assert got["gone", "q"].containment is None


# Published (size_1, size_2, shared, containment, quality) of join pairs.
PUBLISHED = [(2, 6, 1, 0.5, 3), (2, 2, 1, 0.5, 3)]


def test_published_quality(spark):
    df = spark.createDataFrame(PUBLISHED, "a long, b long, j long, c double, q int")
    got = df.select((F.col("j") / F.col("a") == F.col("c")).alias("c"), O.quality(F.col("c"), F.col("a"), F.col("b")).alias("g"), "q")
    assert all(r.c and r.g == r.q for r in got.collect())


def test_offsets_and_flatten(spark):
    rows = lake_rows(12)
    df = spark.createDataFrame(rows, VECTORS)
    assert sorted((r.table_id, r["index"], r.length) for r in V.offsets(df).collect()) == [("t00", 0, 4), ("t01", 1, 4), ("t02", 2, 4)]
    matrices = spark.createDataFrame([("b", [[1.0], [2.0]]), ("a", [[3.0]])], "table_id string, matrix array<array<double>>")
    assert sorted((r["index"], r.col_name, r.vec[0]) for r in V.flatten(matrices).collect()) == [
        (0, "col_0", 3.0), (1, "col_0", 1.0), (1, "col_1", 2.0)]


@pytest.mark.parametrize("case", range(4))
def test_best_products_are_those_of_all_products(case):
    """Copies (ties to the smaller column), left-out pairs and limits; single precision alone would mix up near products."""
    rng = np.random.default_rng(case)
    a = rng.standard_normal((300, 8))
    a = np.round(a) if case == 1 else a * 1e-3 + 1 if case == 2 else a
    codes, most = rng.integers(0, 20, 300), (rng.random(300), rng.random(300)) if case == 3 else None
    scores = a @ a.T if most is None else np.minimum(a @ a.T, np.minimum(most[0][:, None], most[1]))
    scores = np.round(scores, 10)
    scores[codes[:, None] == codes] = -np.inf
    r, c, products = best_products(a, a, 5, (codes, codes), most)
    want = best_pairs(scores, 5)
    assert r.tolist() == want[0].tolist() and c.tolist() == want[1].tolist()
    assert np.allclose(products, scores[want])


def test_nearest_products_of_tiles_are_the_best(monkeypatch):
    monkeypatch.setattr(K, "WIDE", 16)
    monkeypatch.setattr(K, "HIGH", 8)
    rng = np.random.default_rng(7)
    for n, m, digits in [(30, 50, 9), (50, 30, 0), (5, 3, 9), (1, 64, 1), (64, 40, 1)]:
        a, b = (np.round(rng.standard_normal((k, 5)), digits) for k in (n, m))
        skip = rng.integers(0, 6, n), rng.integers(0, 6, m)
        both = K.nearest_products(a, b, skip, back=True)
        assert all((x == y).all() for x, y in zip(both[0], K.nearest_products(a, b, skip)))
        for (r, c, score), (x, y, codes) in zip(both, [(a, b, skip), (b, a, skip[::-1])]):
            rows, cols, products = best_products(x, y, 1, codes)
            assert list(r) == list(rows) and list(c) == list(cols)
            assert (score == np.round(products, 10)).all()


@pytest.mark.parametrize("small_block", [K.SMALL_BLOCK, 12])
@pytest.mark.parametrize("skip_table", [False, True])
def test_hashing_of_a_lake_in_itself_is_that_of_its_copy(spark, monkeypatch, skip_table, small_block):
    monkeypatch.setattr(K, "SMALL_BLOCK", small_block)
    rows = lake_rows(90, seed=8)
    df = spark.createDataFrame(rows + rows[:5], VECTORS).repartition(3)
    options = {"method": "lsh", "tables": 9, "bits": 2, "recall": None, "exclude_same_table": skip_table}
    want = K.knn(df, df.filter("true"), 6, **options)
    got = K.knn(df, df, 6, **options)
    assert sorted(got.collect()) == sorted(want.collect())


def test_hashing_sends_a_bucket_once(spark, monkeypatch):
    """Vectors are written once with the list of their buckets, not once per bucket and side."""
    written = []
    write = K.materialize
    monkeypatch.setattr(K, "materialize", lambda df, *a: written.append((df.columns, write(df, *a))) or written[-1][1])
    df = spark.createDataFrame(lake_rows(60, seed=9), VECTORS)
    K.knn(df, df, 5, method="lsh", tables=9, bits=2, recall=None).collect()
    assert [t.count() for columns, t in written if "vec" in columns] == [60, 60]

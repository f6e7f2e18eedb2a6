"""Ranks and running sums must not depend on how a hot group is split."""

import pytest
from pyspark.sql import functions as F

from lakefind.functions.ranking import lowest, rank_within, running, seeded, share, unit
from lakefind.functions import ranking as R
from lakefind.operators import corpus as C


@pytest.fixture(params=["1", "4", "13"])
def slices(spark, request):
    """The number of slices that all rows are cut into."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def rows(spark):
    """One group holds a third of all rows, another one only a few."""
    return spark.range(900).select(
        F.when(F.col("id") < 300, "hot").when(F.col("id") < 310, "few").otherwise(F.concat(F.lit("g"), F.col("id") % 20)).alias("g"),
        ((F.col("id") * 7919) % 1009).alias("x"), "id")


def test_rank_is_dense(spark, slices):
    got = rank_within(rows(spark), ["g"], [F.col("x"), F.col("id")]).toPandas()
    assert len(got) == 900
    for _, part in got.groupby("g"):
        part = part.sort_values("rank")
        assert list(part["rank"]) == list(range(1, len(part) + 1))
        assert list(zip(part["x"], part["id"])) == sorted(zip(part["x"], part["id"]))


def test_rank_over_everything(spark, slices):
    got = rank_within(rows(spark), [], [F.desc("x"), F.col("id")]).toPandas().sort_values("rank")
    assert list(got["rank"]) == list(range(1, 901))
    assert list(got["x"]) == sorted(got["x"], reverse=True)


def test_running_sum(spark, slices):
    got = running(rows(spark), ["g"], [F.col("id")], {"s": F.col("x"), "n": F.lit(1)}).toPandas().sort_values(["g", "id"])
    assert (got.groupby("g")["x"].cumsum() == got["s"]).all()
    assert (got.groupby("g").cumcount() + 1 == got["n"]).all()


def test_null_group_is_a_group(spark, slices):
    df = spark.range(120).select(F.when(F.col("id") % 2 == 0, F.lit("a")).alias("g"), "id")
    got = rank_within(df, ["g"], [F.col("id")]).toPandas()
    assert sorted(got[got["g"].isna()]["rank"]) == list(range(1, 61))


def test_hash_does_not_depend_on_partitions(spark):
    df = spark.range(100).withColumn("h", seeded(42, "id")).withColumn("u", unit(F.col("h")))
    once, again = ({r.id: (r.h, r.u) for r in df.repartition(n).collect()} for n in (1, 8))
    assert once == again and all(0 <= u < 1 for _, u in once.values())


def test_shares_are_exact(spark):
    df = spark.createDataFrame([(n,) for n in (0, 1, 10, 22_500, 10**15 + 10)], "n bigint")
    got = [(r[0], r[1], r[2]) for r in df.select("n", F.floor(share("n", 0.7)), F.bround(share("n", 0.15))).collect()]
    assert [g[1] for g in got] == [g[0] * 7 // 10 for g in got]
    assert [int(g[2]) for g in got] == [0, 0, 2, 3375, 15 * 10**13 + 2]


@pytest.mark.parametrize("bucket", [1024, 4])
def test_lowest_is_the_sorted_choice(spark, monkeypatch, bucket):
    monkeypatch.setattr(R, "BUCKET_ROWS", bucket)
    df = rows(spark).withColumn("g", F.when(F.col("g") != "few", F.col("g"))).withColumn("_n", F.lit("x"))  # and a null group
    hashed = seeded(3, "x", "id")
    for part in (0.0, 0.07, 0.5, 1.0):
        got = lowest(df.withColumnRenamed("_n", "n"), ["g"], hashed, ["x", "id"], lambda n: F.floor(share(n, part)), "low")
        got = got.withColumn("h", hashed).toPandas()
        assert len(got) == 900
        for _, own in got.groupby("g", dropna=False):
            first = own.sort_values(["h", "x", "id"])[: int(round(len(own) * part * 100)) // 100]
            assert set(own[own["low"]]["id"]) == set(first["id"])
    alone = lowest(df.select("id"), [], seeded(1, "id"), ["id"], lambda n: F.lit(7), "low")
    assert alone.columns == ["id", "low"] and alone.filter("low").count() == 7


def test_edge_views_keep_an_exact_share(spark):
    graph = spark.range(22_500).select(F.lit("t").alias("table_id"), F.col("id").alias("node_id"), (F.col("id") % 7).alias("edge_id"))
    views = C.edge_views(graph, 0.3).agg(F.sum("view_1"), F.sum("view_2")).first()
    assert tuple(views) == (15_750, 15_750)


def test_attach_deals_a_hot_group_over_tasks(spark, monkeypatch):
    rows = spark.range(6000).select(F.when(F.col("id") < 5900, "hot").otherwise("cold").alias("table_id"), F.col("id").alias("row_idx"))
    facts = spark.createDataFrame([("hot", 7), ("other", 1)], "table_id string, n int")
    for limit in (R.BROADCAST_ROWS, 0):
        monkeypatch.setattr(R, "BROADCAST_ROWS", limit)
        inner = R.attach(rows, facts, ["table_id"], ["row_idx"])
        assert inner.columns == ["table_id", "row_idx", "n"]
        assert sorted(inner.collect()) == sorted(rows.join(facts, "table_id").collect())
        left = R.attach(rows, facts, ["table_id"], ["row_idx"], "left")
        assert left.filter("n IS NULL").count() == 100 and left.count() == 6000
        assert R.attach(rows, facts, ["table_id"], ["row_idx"], "left_anti").count() == 100
    plan = inner._jdf.queryExecution().executedPlan().toString()  # many facts: dealt by slice too
    assert "BroadcastHashJoin" not in plan and "_slice" in plan.split("hashpartitioning(")[1].split(")")[0]

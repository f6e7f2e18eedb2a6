"""Order-based helpers that stay exact when one group holds most rows."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakefind.session import materialize


def seeded(seed: int | str, *cols: str | Column) -> Column:
    """A hash of ``cols`` that is the same on every run and partitioning."""
    parts = [F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))


def unit(hashed: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of a hex hash."""
    return F.conv(F.substring(hashed, 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(16**13))


def same(left: str, right: str, keys: list[str]) -> Column:
    """Null-safe equality of ``keys`` on two aliased frames."""
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys])


BROADCAST_ROWS, SLICES = 100_000, 64


def attach(df: DataFrame, facts: DataFrame, keys: list[str], ids: list[str], how: str = "inner") -> DataFrame:
    """``df`` joined with ``facts``, a row or few per value of ``keys``, so that no task gets a whole hot group.

    A plain join deals ``df`` by ``keys``, and so do the sums by more columns that follow it: a lake's largest table would be
    one task.  Few facts are sent to all tasks.  Many are copied to ``SLICES`` slices, over which a group is dealt by ``ids``.
    """
    facts = materialize(facts)
    if facts.count() <= BROADCAST_ROWS:
        return df.join(F.broadcast(facts), keys, how)
    sliced = df.withColumn("_slice", F.pmod(F.xxhash64(*ids), F.lit(SLICES)).cast("int"))
    copies = facts.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))))
    return sliced.join(copies.hint("merge"), [*keys, "_slice"], how).drop("_slice")


def running(df: DataFrame, group: list[str], order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Running sums (current row included) over ``order`` inside each group, on one path for every size.

    ``order`` must be total within a group.  The rows are range-partitioned on
    group and order and written once with the number of their slice; each
    slice of a group sums for itself, and the totals of the group's earlier slices are
    added.  A slice is a share of all rows, so no task ever holds a whole hot group.
    """
    by = [F.col(g) for g in group] + list(order)
    sliced = materialize(
        df.withColumns({f"_add_{name}": value for name, value in sums.items()})
        .repartitionByRange(*by)
        .withColumn("_slice", F.spark_partition_id())
    )
    earlier = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (  # one row per group and slice
        sliced.groupBy(*group, "_slice")
        .agg(*[F.sum(f"_add_{name}").alias(f"_total_{name}") for name in sums])
        .withColumns({f"_off_{name}": F.coalesce(F.sum(f"_total_{name}").over(earlier), F.lit(0)) for name in sums})
    )
    local = Window.partitionBy(*group, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    split = sliced.withColumns({f"_run_{name}": F.sum(f"_add_{name}").over(local) for name in sums})
    joined = split.alias("a").join(offsets.alias("b"), same("a", "b", [*group, "_slice"]))
    return joined.select(
        *[F.col(f"a.{c}") for c in df.columns],
        *[(F.col(f"a._run_{name}") + F.col(f"b._off_{name}")).alias(name) for name in sums],
    )


def share(n: str | Column, part: float | Decimal) -> Column:
    """``n`` times a share given in decimals, as an exact decimal (70 % of 22,500 is 15,750, not a hair less)."""
    n = F.col(n) if isinstance(n, str) else n
    return n.cast("decimal(19,0)") * F.lit(Decimal(str(part)))


BUCKET_ROWS, MAX_BUCKET_BITS = 1024, 16


def lowest(df: DataFrame, group: list[str], hashed: Column, ids: list[str], wanted: Callable[[Column], Column],
           name: str) -> DataFrame:
    """``df`` with a boolean ``name``: whether a row is among its group's ``wanted(group size)`` smallest by (hash, ids).

    Exact without a sort of the rows.  A histogram of the first bits of ``hashed`` (a hex hash) tells in which bucket the
    cut lies; only that bucket, about ``BUCKET_ROWS`` rows, is ranked, and what goes back to the rows is one limit per group.
    ``ids`` must tell the rows of a group apart.
    """
    keys = group or ["_all"]
    rows = df if group else df.withColumn("_all", F.lit(0))
    first = F.conv(F.substring("_h", 1, 13), 16, 10).cast("long")  # 52 bits
    narrow = rows.select(*keys, *[c for c in ids if c not in keys], hashed.alias("_h"))
    sizes = narrow.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    bits = F.least(F.greatest(F.length(F.bin("_n")) - BUCKET_ROWS.bit_length() + 1, F.lit(0)), F.lit(MAX_BUCKET_BITS))
    sizes = materialize(sizes.select(*keys, wanted(F.col("_n")).cast("long").alias("_want"), F.pow(F.lit(2), bits).alias("_of")))
    placed = narrow.alias("a").join(sizes.alias("b"), same("a", "b", keys)).select("a.*", "_want", "_of").withColumn(
        "_bucket", F.floor(first * F.col("_of") / F.lit(float(1 << 52))))
    counts = placed.groupBy(*keys, "_want", "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    upto = F.sum("_rows").over(Window.partitionBy(*keys).orderBy("_bucket"))  # at most 2**MAX_BUCKET_BITS rows
    cut = counts.withColumn("_upto", upto).filter((F.col("_upto") >= F.col("_want")) & (F.col("_upto") - F.col("_rows") < F.col("_want")))
    cut = materialize(cut.select(*keys, "_bucket", (F.col("_want") - F.col("_upto") + F.col("_rows")).alias("_left")))
    limit = F.struct("_h", *ids)
    edge = placed.alias("a").join(cut.alias("b"), same("a", "b", [*keys, "_bucket"])).select("a.*", "_left")
    edge = edge.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy("_h", *ids)))
    limits = materialize(edge.filter(F.col("_at") == F.col("_left")).select(*keys, limit.alias("_limit")))
    joined = rows.withColumn("_h", hashed).alias("a").join(limits.alias("b"), same("a", "b", keys), "left")
    own = F.struct(F.col("a._h"), *[F.col(f"a.{c}") for c in ids])
    return joined.select(*[F.col(f"a.{c}") for c in df.columns], F.coalesce(own <= F.col("_limit"), F.lit(False)).alias(name))


def rank_within(df: DataFrame, group: list[str], order: list[Column], name: str = "rank",
                limit: int | None = None) -> DataFrame:
    """Dense 1-based position of each row in its group.

    With ``limit`` only the first ``limit`` rows survive; Spark then prunes
    each map task to its own first ``limit`` rows before the shuffle, so a hot
    group needs no further care.
    """
    if limit is not None:
        numbered = df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
        return numbered.filter(F.col(name) <= limit).withColumn(name, F.col(name).cast("long"))
    return running(df, group, order, {name: F.lit(1).cast("long")})

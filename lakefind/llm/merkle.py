"""Merkle manifest of a dataset: leaf hashes per document, a tree per source, a tree over the sources, and proofs.

Every node carries the interval of leaf ranks that it covers.  A tree grows level by level: the nodes of one level
whose intervals start in the same bucket of ``FANOUT ** level`` ranks become one node, which keeps its children.  Proofs go
the other way: from the top down, a join on (tree, bucket of the level) whose intervals contain each other attaches
to every node its ancestor and, with it, the path above; the siblings are the parent's children outside the node's
own interval.  Each level is one join that is ``FANOUT`` times smaller than the one below.

Scale: texts are read once and leave as digests.  Ranks come from range-partitioned slices, so one source with a third
of all rows, or all rows under one id, still fills all tasks; tree joins are keyed by (tree, bucket), which holds ``FANOUT``
rows. The driver sees one digest, the root, and whether a level has rows.

Defined results: a null in any column is written as ``-``; a null source is a source of its own, before all
others.  Within a source null ids come first, and rows that share an id ascend by their leaf.  Equal rows are
leaves of their own.  A source with one document has that leaf as its root; with one source the root is its root;
the proof of a lone document is the hash of nothing.  A null id is never tampered with.  Texts of any length are hashed
whole.  Further columns are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakefind.functions.ranking import rank_within
from lakefind.llm.common import ascii_lower, table
from lakefind.plans.registry import query
from lakefind.session import materialize

FANOUT = 16
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
TAMPERED = 5  # ids whose crc32 this divides are tampered with in the query
_NODE = ["tree", "lo", "hi", "digest"]


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts, one after another."""
    return F.sha2(F.concat(F.lit(""), *parts), 256)


def written(value: Column) -> Column:
    """A value as its length in bytes, a colon and itself; null as a dash."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(**changed: Column) -> Column:
    """The leaf of a row of documents, with some columns replaced."""
    return digest(*[written(changed.get(c, F.col(c))) for c in FIELDS])


def tree_name(source: Column) -> Column:
    """A key for each source, null included."""
    return F.coalesce(F.concat(F.lit(":"), source.cast("string")), F.lit("-"))


def grown(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Trees over the first level ``nodes`` (tree, lo, hi, digest): the parents of each level, and the roots.

    Parents are (tree, bucket, lo, hi, digest, children).  A level's only node is the root of its tree: it is returned as
    (tree, level, lo, hi, digest) and has no parent.
    """
    levels, roots, width = [], [], 1
    while True:
        width *= FANOUT
        children = F.sort_array(F.collect_list(F.struct("lo", "hi", "digest")))  # at most FANOUT
        runs = nodes.groupBy("tree", F.floor(F.col("lo") / width).alias("bucket")).agg(children.alias("children"))
        runs = runs.withColumns({"lo": F.col("children")[0]["lo"], "hi": F.element_at("children", -1)["hi"]})
        runs = runs.withColumn("alone", (F.col("lo") == 0) & (F.size("children") == 1))
        runs = materialize(runs.withColumn("digest", F.when(F.col("alone"), F.col("children")[0]["digest"]).otherwise(
            F.sha2(F.array_join(F.transform("children", lambda c: c["digest"]), ""), 256))))
        roots.append(runs.where("alone").select("tree", F.lit(len(levels)).alias("level"), "lo", "hi", "digest"))
        parents = runs.where("not alone").drop("alone")
        if parents.isEmpty():
            return levels, materialize(reduce(DataFrame.unionByName, roots))
        levels.append(parents)
        nodes = parents.select(*_NODE)


def _outside(children: str, before: bool) -> Column:
    """The digests of the children on one side of the node's own interval."""
    side = (lambda c: c["hi"] <= F.col("n.lo")) if before else (lambda c: c["lo"] >= F.col("n.hi"))
    return F.array_join(F.transform(F.filter(children, side), lambda c: c["digest"]), "")


def under(nodes: DataFrame, parents: DataFrame | None, tops: DataFrame, level: int) -> DataFrame:
    """``nodes`` of one level with ``path``, their siblings from here to the root, and ``top``, the root of their tree.

    ``parents`` are those of the next level with their own path and top, ``tops`` the roots of the trees
    whose only node is on this level, with the path above them.
    """
    width = FANOUT ** (level + 1)
    above = tops.select("tree", F.lit(0).cast("bigint").alias("bucket"), "lo", "hi", "path", "top",
                        F.lit(None).cast("array<struct<lo:bigint,hi:bigint,digest:string>>").alias("children"))
    if parents is not None:
        above = above.unionByName(parents.select("tree", "bucket", "lo", "hi", "path", "top", "children"))
    step = F.struct(_outside("a.children", True).alias("before"), _outside("a.children", False).alias("after"))
    path = F.when(F.col("a.children").isNull(), F.col("a.path")).otherwise(F.concat(F.array(step), F.col("a.path")))
    keyed = nodes.withColumn("_bucket", F.floor(F.col("lo") / width))
    joined = keyed.alias("n").join(above.alias("a"), (F.col("n.tree") == F.col("a.tree")) & (F.col("n._bucket") == F.col("a.bucket"))
                                   & (F.col("a.lo") <= F.col("n.lo")) & (F.col("n.hi") <= F.col("a.hi")))
    return joined.select(*[F.col(f"n.{c}") for c in nodes.columns], path.alias("path"), F.col("a.top").alias("top"))


def with_paths(leaves: DataFrame, levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The first level's nodes ``leaves`` with path and top; ``tops`` are the roots with the path above them."""
    parents = None
    for level in range(len(levels), 0, -1):
        parents = materialize(under(levels[level - 1], parents, tops.where(F.col("level") == level), level))
    return under(leaves, parents, tops.where("level = 0"), 0)


def ranked_leaves(docs: DataFrame, altered: Column) -> DataFrame:
    """Written (doc_id, source, tree, lo, hi, digest, altered) of every row, ranked within its source."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"),
                       leaf_digest().alias("digest"), altered.alias("altered"))
    rows = rows.withColumn("_at", F.monotonically_increasing_id())  # tells equal rows apart
    ranked = rank_within(rows, ["source"], [F.col("doc_id").asc_nulls_first(), F.col("digest"), F.col("_at")], "hi")
    return materialize(ranked.select("doc_id", "source", tree_name(F.col("source")).alias("tree"),
                                     (F.col("hi") - 1).alias("lo"), "hi", "digest", "altered"))


def manifest(docs: DataFrame, altered: Column | None = None) -> DataFrame | None:
    """(doc_id, source, leaf, subroot, root, path, altered) of every row; None without rows.

    ``path`` holds, from the leaf to the root, the siblings' digests before and after the own node.  ``altered`` is
    an expression over ``docs`` for a leaf to be folded instead of the row's own.
    """
    leaves = ranked_leaves(docs, F.lit(None).cast("string") if altered is None else altered)
    levels, subroots = grown(leaves.select(*_NODE))
    firsts = rank_within(subroots.withColumnRenamed("tree", "name"), [], [F.col("name")], "_hi")  # "-" sorts before ":"
    firsts = materialize(firsts.select(
        F.lit("*").alias("tree"), (F.col("_hi") - 1).alias("lo"), F.col("_hi").alias("hi"), "digest", "name",
        "level", F.col("lo").alias("own_lo"), F.col("hi").alias("own_hi")))
    top_levels, roots = grown(firsts.select(*_NODE))
    root = roots.select("digest").first()
    if root is None:
        return None
    nothing = F.array().cast("array<struct<before:string,after:string>>")
    roots = roots.withColumns({"path": nothing, "top": F.col("digest")})
    named = with_paths(firsts, top_levels, roots)
    tops = materialize(named.select(F.col("name").alias("tree"), "level", F.col("own_lo").alias("lo"), F.col("own_hi").alias("hi"), "path",
                                    F.col("digest").alias("top")))
    return with_paths(leaves, levels, tops).select(
        "doc_id", "source", F.col("digest").alias("leaf"), F.col("top").alias("subroot"), F.lit(root[0]).alias("root"), "path",
        "altered")


def folded(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and the siblings on its path."""
    return F.aggregate(path, leaf, lambda node, step: digest(step["before"], node, step["after"]))


def proof(path: Column) -> Column:
    """All siblings' digests, level by level, as one text."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["before"], step["after"])), "")


_VALUE = "coalesce(CAST(octet_length(encode({0})) AS VARCHAR) || ':' || {0}, '-')"
_TEXTS = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)"]
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_CRC = """4294967295 - list_reduce(list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1),
    lambda i: ascii(substring(CAST(doc_id AS VARCHAR), i, 1))::BIGINT), lambda crc, byte: xor(crc >> 8,
    list_reduce(range(8), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(crc & 255, byte))), 4294967295)"""
_GROW = f"""SELECT tree, level + 1, idx // {FANOUT}, sha256(string_agg(digest, '' ORDER BY idx)), (width + {FANOUT - 1}) // {FANOUT}
  FROM {{0}} WHERE width > 1 GROUP BY tree, level, idx // {FANOUT}, width"""
_WALK = f"""SELECT row, w.tree, w.level + 1, w.idx // {FANOUT}, (w.width + {FANOUT - 1}) // {FANOUT},
  sha256(string_agg(CASE WHEN n.idx = w.idx THEN acc ELSE n.digest END, '' ORDER BY n.idx)),
  proof || string_agg(CASE WHEN n.idx = w.idx THEN '' ELSE n.digest END, '' ORDER BY n.idx)
  FROM {{0}} w JOIN {{1}} n ON n.tree = w.tree AND n.level = w.level AND n.idx // {FANOUT} = w.idx // {FANOUT}
  WHERE w.width > 1 GROUP BY row, w.tree, w.level, w.idx, w.width, proof"""
SQL = f"""WITH RECURSIVE hashed AS MATERIALIZED (SELECT doc_id, coalesce(':' || source, '-') AS tree,
  sha256({" || ".join(_VALUE.format(c) for c in [*_TEXTS, "text"])}) AS leaf,
  CASE WHEN ({_CRC}) % {TAMPERED} = 0 THEN sha256({" || ".join(_VALUE.format(c) for c in [*_TEXTS, _LOWER])}) END AS altered
  FROM documents),
leaves AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY tree, doc_id NULLS FIRST, leaf) AS row,
  CAST(row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS BIGINT) AS idx,
  count(*) OVER (PARTITION BY tree) AS width FROM hashed),
nodes(tree, level, idx, digest, width) AS (SELECT tree, 0, idx, leaf, width FROM leaves UNION ALL {_GROW.format("nodes")}),
subroots AS MATERIALIZED (SELECT tree AS name, digest, CAST(row_number() OVER (ORDER BY tree) - 1 AS BIGINT) AS idx,
  count(*) OVER () AS width FROM nodes WHERE width = 1),
tops(tree, level, idx, digest, width) AS (SELECT '*', 0, idx, digest, width FROM subroots UNION ALL {_GROW.format("tops")}),
walk(row, tree, level, idx, width, acc, proof) AS (SELECT row, tree, 0, idx, width, coalesce(altered, leaf), '' FROM leaves
  UNION ALL {_WALK.format("walk", "nodes")}),
climb(row, tree, level, idx, width, acc, proof) AS (SELECT row, '*', 0, s.idx, s.width, acc, proof FROM walk w JOIN subroots s
  ON s.name = w.tree WHERE w.width = 1 UNION ALL {_WALK.format("climb", "tops")})
SELECT doc_id, leaf, s.digest AS subroot, r.digest AS root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = r.digest AS verified
FROM leaves l JOIN climb c ON c.row = l.row AND c.width = 1 JOIN subroots s ON s.name = l.tree, (SELECT digest FROM tops WHERE width = 1) r"""


@query("op12_merkle_manifest", SQL)
def op12_merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    schema = ("doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, "
              "verified boolean")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0
    rows = manifest(table(spark, sf, "documents"), F.when(hit, leaf_digest(text=ascii_lower(F.col("text")))))
    if rows is None:
        return spark.createDataFrame([], schema)
    again = folded(F.coalesce("altered", "leaf"), F.col("path"))
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(proof(F.col("path")), 256).alias("proof_sha256"),
                       again.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))

"""The Merkle manifest against a direct version: hash lists per source, proofs as lists of siblings."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from lakefind.llm import merkle as M
from lakefind.llm.common import ascii_lower
from llm_cases import CLASH, odd_rows, words


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def lower(t):
    return None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def tree(nodes):
    """Root and, per node, its (before, after) siblings level by level."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for i, k in enumerate(at):
            lo = k // 16 * 16
            paths[i].append((level[lo:k], level[k + 1:lo + 16]))
        level = [h(*level[lo:lo + 16]) for lo in range(0, len(level), 16)]
        at = [k // 16 for k in at]
    return level[0], paths


def brute(rows):
    leaves = [(r, h(*map(enc, r))) for r in rows]
    by = {}
    for r, leaf in leaves:
        by.setdefault(r[1], []).append((r, leaf))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    own = {}
    for s in names:
        by[s].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        own[s] = tree([leaf for _, leaf in by[s]])
    root, above = tree([own[s][0] for s in names]) if names else (None, [])
    out = []
    for s, up in zip(names, above):
        for (r, leaf), path in zip(by[s], own[s][1]):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            node = h(*map(enc, (*r[:4], lower(r[4])))) if hit else leaf
            for before, after in path + up:
                node = h(*before, node, *after)
            sib = [x for before, after in path + up for x in before + after]
            out.append((r[0], leaf, own[s][0], root, h(*sib), node, node == root))
    return sorted(out, key=repr)


def frame(spark, rows):
    names = ", ".join(f"`{c}` string" for c in [*CLASH, "tree", "lo", "hi", "digest", "path", "top", "_at"])
    full = [(*r, *["x"] * (len(CLASH) + 7)) for r in rows]
    return spark.createDataFrame(full, f"doc_id bigint, source string, lang string, n_chars bigint, text string, {names}")


def result(spark, rows):
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    got = M.manifest(frame(spark, rows), F.when(hit, M.leaf_digest(text=ascii_lower(F.col("text")))))
    again = M.folded(F.coalesce("altered", "leaf"), F.col("path"))
    got = got.select("doc_id", "leaf", "subroot", "root", F.sha2(M.proof(F.col("path")), 256), again, again == F.col("root"))
    return sorted((tuple(r) for r in got.collect()), key=repr)


def test_hot_source_odd_rows_and_ties(spark):
    rows = [(i, "hot", "en", None if t is None else len(t), t) for i, t in odd_rows()]
    rows += [(1000 + k, "hot", None if k % 7 else "de", k, f"Text {k} A") for k in range(290)]
    rows += [(k, None if k % 2 else "é", "en", 3, "ABC") for k in range(40)]
    rows += [(k % 3, f"s{k}", "en", 1, "z") for k in range(20)]  # more sources than one run holds
    rows += [(None, "none", None, None, None)] * 40 + [(7, "same", "x", 1, "Same")] * 35
    got = result(spark, rows)
    assert got == brute(rows)
    assert {r[6] for r in got} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 16, 17])
def test_small_trees(spark, n):
    rows = [(k, "only", "en", 4, words(k, 3)) for k in range(n)]
    got = result(spark, rows)
    assert got == brute(rows)
    assert n > 1 or (got[0][1] == got[0][2] == got[0][3] and got[0][4] == h(""))


def test_empty_table(spark):
    assert M.manifest(frame(spark, [])) is None


def test_what_a_proof_finds(spark):
    rows = [(k, f"s{k % 2}", "en", 1, f"t{k}") for k in range(50)]
    got = M.manifest(frame(spark, rows)).where("doc_id = 11")
    other = M.digest(*[M.written(F.lit(v)) for v in (11, "s1", "en", 1, "T11")])
    found = got.select((M.folded(F.col("leaf"), F.col("path")) == F.col("root")).alias("own"),
                       (M.folded(other, F.col("path")) == F.col("root")).alias("other")).first()
    assert found["own"] and not found["other"]

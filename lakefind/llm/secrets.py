"""Secret scans: fixed patterns, and character Markov models for what the patterns miss.

Three base patterns find assignments, access keys and hex runs.  The method adds
spans of kind ``markov``: runs of 16 or more key characters with a letter and a
digit whose log-likelihood ratio under two first-order character models, random strings against ordinary
identifiers, is positive by at least ``MIN_RATIO`` a character.

The models are transition counts, learned by grouped sums from labelled samples:
random strings are encodings of hashes and the base patterns' own matches,
identifiers are pairs of neighbouring words joined the way identifiers are.  Both
come from at most ``MAX_DOCS`` documents (drawn by hash of the id, first
``MAX_WORDS`` words of each) and ``MAX_RANDOM`` generated strings; scanning always covers
whole texts.  The ratio table has one number per character pair.

DataFrame functions only; text is neither shuffled nor copied, each row is scanned where it is
read.  Positions are prefix sums over the pieces between matches, taken in
two levels so that a text with very many matches does not cost their square.

Defined results: a null or empty text has no spans.  Positions are code points,
the end exclusive; the base digest of no spans is that of the empty
string.  Repeated rows get equal results; null ids stay null.  Further columns are
ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakefind.llm.common import table
from lakefind.plans.registry import query

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]+", r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "markov")
MIN_VALUE, MIN_ACCESS, MIN_HEX = 8, 16, 32

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
RUN = r"[A-Za-z0-9+/_=-]{16,}"
MIN_RATIO = 0.3
MAX_DOCS, MAX_WORDS, MAX_RANDOM = 4000, 300, 3000
BLOCK = 128


def total(part: Column) -> Column:
    return F.aggregate(part, F.lit(0), lambda s, x: s + x)


def block_sums(lengths: str) -> Column:
    """The sum of each block of an array of numbers."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(lengths) / BLOCK).cast("int")),
                       lambda k: total(F.slice(lengths, k * BLOCK + 1, F.lit(BLOCK))))


def sum_before(lengths: str, blocks: str, i: Column) -> Column:
    """The sum of the entries before the ``i``-th, from whole blocks and the rest of one."""
    k = F.floor(i / BLOCK).cast("int")
    return total(F.slice(blocks, F.lit(1), k)) + total(F.slice(lengths, k * BLOCK + 1, i - k * BLOCK))


def with_matches(df: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """``df`` with an array of (start, end, found) per pattern: all leftmost non-overlapping matches in ``text``.

    Each array that a function looks into is a column of an earlier step, so it is
    computed once per row and not once per element.
    """
    text, kept = F.col("text"), df.columns
    none = F.array().cast("array<string>")
    found = {f"_found_{k}": F.when(text.rlike(p), F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(none)
             for k, p in patterns.items()}
    df = df.select(*kept, *[c.alias(n) for n, c in found.items()])
    between = {f"_between_{k}": F.when(F.size(f"_found_{k}") > 0, F.split(text, p, -1)).otherwise(none)
               for k, p in patterns.items()}
    df = df.select(*kept, *found, *[c.alias(n) for n, c in between.items()])

    def step(k: str) -> Column:
        return F.transform(f"_found_{k}", lambda m, i: F.length(F.get(f"_between_{k}", i)) + F.length(m))

    steps = {f"_step_{k}": step(k) for k in patterns}
    df = df.select(*kept, *found, *between, *[c.alias(n) for n, c in steps.items()])
    sums = {f"_sum_{k}": block_sums(f"_step_{k}") for k in patterns}
    df = df.select(*kept, *found, *between, *steps, *[c.alias(n) for n, c in sums.items()],
                   *[F.size(n).alias(f"_n{n}") for n in steps])

    def span(k: str) -> Column:
        def at(m: Column, i: Column) -> Column:
            start = sum_before(f"_step_{k}", f"_sum_{k}", i) + F.length(F.get(f"_between_{k}", i))
            return F.struct(start.alias("start"), m.alias("found"))

        placed = F.transform(f"_found_{k}", at)
        return F.transform(placed, lambda x: F.struct(
            x["start"].alias("start"), (x["start"] + F.length(x["found"])).alias("end"), x["found"].alias("found")))

    return df.select(*kept, *[span(k).alias(k) for k in patterns])


#: Runs below the least length of access keys and hex runs match nothing inside them either, so the
#: length is part of these patterns; a short assignment still uses up its text and is dropped afterwards.
BASE = {"assign": ASSIGN, "access": ACCESS.replace("+", f"{{{MIN_ACCESS - 4},}}"),
        "hex": HEX.replace("+", f"{{{MIN_HEX},}}")}


def sample_strings(docs: DataFrame) -> DataFrame:
    """(label, s): at most a bounded number of random strings (1) and identifiers (0)."""
    spark = docs.sparkSession
    digest = F.sha2(F.col("id").cast("string"), 256)
    b64 = F.base64(F.unhex(digest))
    random = spark.range(MAX_RANDOM).select(F.explode(F.array(
        b64, F.upper(F.regexp_replace(b64, "[+/=]", "")), F.left(digest, F.lit(40)))).alias("s")).select(
        F.lit(1).alias("label"), "s")

    scale = 1 << 30
    share = min(1.0, 0.9 * MAX_DOCS / max(1, docs.count()))
    drawn = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(scale)) < int(share * scale)).limit(MAX_DOCS)
    text = F.coalesce("text", F.lit(""))
    known = drawn.select(F.explode(F.concat(*[
        F.regexp_extract_all(text, F.lit(BASE[k]), F.lit(0)) for k in ("access", "hex")])).alias("s")).select(
        F.lit(1).alias("label"), "s")
    words = F.slice(F.regexp_extract_all(text, F.lit("[A-Za-z]{3,12}"), F.lit(0)), 1, MAX_WORDS)
    lines = drawn.select(words.alias("w")).where(F.size("w") > 1)

    def pair(w: Column, i: Column) -> Column:
        after = F.get("w", i + 1)
        return F.when(i % 4 == 0, F.concat(w, F.lit("_"), after)).when(i % 4 == 1, F.concat(w, F.lit("-"), after)).when(
            i % 4 == 2, F.concat(w, F.lit("/"), after)).otherwise(F.concat(w, F.initcap(after)))

    names = lines.select(F.explode(F.transform("w", pair)).alias("s")).where("s is not null").select(
        F.lit(0).alias("label"), "s")
    numbered = lines.select(F.explode(F.transform(F.slice("w", 1, 20), lambda w, i: F.concat(
        w, F.lit("-"), (i * 37 % 1000).cast("string")))).alias("s")).select(F.lit(0).alias("label"), "s")
    return random.unionByName(known).unionByName(names).unionByName(numbered)


def pairs_of(s: Column) -> Column:
    """The numbers of the character pairs of a string: row times alphabet size plus column; -1 for other pairs."""
    n = len(ALPHABET)
    place = F.transform(F.split(s, ""), lambda c: F.when(c == "", 0).otherwise(F.instr(F.lit(ALPHABET), c)))
    count = F.greatest(F.length(s) - 1, F.lit(0))
    return F.zip_with(F.slice(place, F.lit(1), count), F.slice(place, F.lit(2), count),
                      lambda a, b: F.when((a > 0) & (b > 0), (a - 1) * n + b - 1).otherwise(-1))


def ratio_table(samples: DataFrame) -> list[float]:
    """The log-likelihood ratio of every character pair, random against identifier, with add-one smoothing."""
    n = len(ALPHABET)
    counted = samples.select("label", F.explode(pairs_of(F.col("s"))).alias("pair")).where("pair >= 0").groupBy(
        "pair").agg(F.sum("label").alias("r"), F.sum(1 - F.col("label")).alias("o")).collect()  # n * n rows at most
    counts = {r["pair"]: (r["r"], r["o"]) for r in counted}
    sums = [[sum(counts.get(a * n + b, (0, 0))[k] for b in range(n)) for k in (0, 1)] for a in range(n)]
    out = []
    for a in range(n):
        for b in range(n):
            r, o = counts.get(a * n + b, (0, 0))
            out.append(math.log((r + 1) / (sums[a][0] + n)) - math.log((o + 1) / (sums[a][1] + n)))
    return out


def looks_random(ratios: list[float]):
    """A test of a match for the two models."""
    table_ = F.split(F.lit(",".join(f"{x:.6f}" for x in ratios)), ",").cast("array<double>")  # folded to a constant

    def test(m: Column) -> Column:
        score = F.aggregate(pairs_of(m["found"]), F.lit(0.0),
                            lambda s, p: s + F.when(p >= 0, F.get(table_, p)).otherwise(F.lit(0.0)))
        return (m["found"].rlike("[0-9]") & m["found"].rlike("[A-Za-z]")
                & (score >= MIN_RATIO * (m["end"] - m["start"] - 1)))

    return test


def find_secrets(docs: DataFrame, ratios: list[float] | None = None) -> DataFrame:
    """(doc_id, assign, access, hex, markov): arrays of (start, end, found) of every whole text."""
    ratios = ratios or ratio_table(sample_strings(docs))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_matches(rows, BASE | {"markov": RUN})
    value = lambda m: F.length(F.regexp_extract(m["found"], ASSIGN, 2))
    return rows.select("doc_id", F.filter("assign", lambda m: value(m) >= MIN_VALUE).alias("assign"), "access", "hex",
                       F.filter("markov", looks_random(ratios)).alias("markov"))


def joined(kinds: tuple[str, ...]) -> Column:
    """``kind:start:end`` of all spans by start, then kind in the order of ``KINDS``, comma-joined."""

    def numbered(no: int, kind: str) -> Column:
        return F.transform(kind, lambda m: F.struct(
            m["start"].alias("start"), F.lit(no).alias("kind"), m["end"].alias("end")))

    each = F.concat(*[numbered(no, k) for no, k in enumerate(kinds)])
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(F.array_sort(each), lambda x: F.concat_ws(
        ":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


@query("op9_secret_scans")
def op9_secret_scans(spark: SparkSession, sf: str) -> DataFrame:
    found = find_secrets(table(spark, sf, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(KINDS[:3]), 256).alias("base_sha256"), joined(KINDS).alias("spans"))

"""N-gram Jaccard join: adaptive multi-match prefixes, pairs of classes and their components.

A document is the set of its distinct word shingles.  Equal sets form one class, so copies are never expanded into pairs.

1. One pass gives each row its set size and class id and counts all shingles
   of the corpus in a sketch whose width follows the number of documents up to
   2**MAX_BITS buckets (its levels, one byte a bucket, are what is broadcast).
2. A global order puts rare shingles first.  Each document picks a number l of
   matches: its prefix is lengthened by l - 1 shingles, and a partner must
   share l prefix shingles.  l minimises the estimated cost of the lists met
   and of the candidates left for verification.
3. In the list of a shingle the most typical class leads; all others are
   verified against it. Twice more, the most typical class outside the
   leader's component does the same.  Pairs that this leaves, in lists that still hold more
   than one component, are joined and held to the same l-match rule; in long lists they are formed
   only where their first shared shingle can lie and where the parities of the two sets
   allow a link (a bound that never excludes one).  So a group of
   thousands of near copies costs pairs in proportion to its size.
4. Verification compares whole sets: 100 * intersection >= PERCENT * union.

With J >= t two sets share at least T = ceil(t / (1 + t) * (|x| + |y|))
shingles, hence at least l within the first |x| - T + l of x and |y| - T + l of y, for any
order.  The sketch decides the order and l, never which pairs link.

Shingles and classes are known by 64-bit hashes; the chance that a join of
10**9 classes meets one class collision is about 3 %.

Defined results: null, empty or blank texts have the empty set, link with
nothing and are their own component (their own doc_id).  Very long texts are sets like others, of all their shingles.
Rows that share doc_id are told apart by their text.  A row with a null id takes part, but the component is
named by the smallest non-null id, and is null if there is none.  Further columns are
ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from lakefind.llm.common import (
    WordHash, mix, packed, shingle_runs, short_batches, shuffle_partitions, table, words_of)
from lakefind.llm.components import components
from lakefind.plans.registry import query
from lakefind.session import materialize

PERCENT = 80
MAX_MATCHES = 8
VERIFY_COST = 16  # what one candidate costs, in list entries met
MIN_BITS, MAX_BITS, PART_BITS = 12, 24, 14
LEADERS = 3  # rounds in which a list's most typical class outside its first component is compared
CHANCE = 0.05  # entries that the list of a rare shingle is expected to hold besides copies
LONG_LIST = 16  # a list that may hold more entries than this and chance is met by the one-match rule first
BROADCAST_ROWS = 500_000  # of 16 bytes; more are joined by a shuffle
MEMBERS = 256  # pairs of one leader that one group verifies


def class_id(tokens: np.ndarray) -> int:
    """Order-free 64-bit id of a set of hashes."""
    return int(mix(tokens ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).astype(np.int64))


def parity(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits: whether an odd number of the set's hashes fall on each.

    Two sets differ in at least as many hashes as their parities differ in bits.
    """
    odd = np.bincount((mix(tokens ^ np.uint64(0x3C6EF372FE94F82B)) & np.uint64(127)).astype(np.int64), minlength=128) & 1
    return tuple(np.packbits(odd.astype(np.uint8)).view(np.int64).tolist())


def token_sets(batch: pa.RecordBatch, known: WordHash) -> list[np.ndarray]:
    """The distinct shingle hashes of each row's ``text``, ascending."""
    texts = [words_of(t or "") for t in batch.column("text").to_pylist()]
    return [np.unique(run) for run in shingle_runs(texts, known)]


def sketch_bits(n_docs: int) -> int:
    return int(min(MAX_BITS, max(MIN_BITS, n_docs.bit_length() + 6)))


def keyed(docs: DataFrame) -> DataFrame:
    """(doc, body, text): rows known by id and text, so that equal or null ids are told apart."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc"), F.xxhash64("text").alias("body"), "text")


def measured(docs: DataFrame, bits: int) -> DataFrame:
    """Written rows (doc, body, n, cls) per document and (part, counts) per task and slice of the sketch; body is the text's hash."""
    import zstandard

    part = 1 << min(bits, PART_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sketch = WordHash(), None
        names = ["doc", "body", "n", "cls", "part", "counts"]
        for b in batches:
            if not b.num_rows:
                continue
            sets = token_sets(b, known)
            sketch = np.zeros(1 << bits, np.uint32) if sketch is None else sketch
            np.add.at(sketch, (np.concatenate(sets) >> np.uint64(64 - bits)).astype(np.int64), 1)
            n, none = len(sets), pa.nulls(len(sets))
            yield pa.RecordBatch.from_arrays([
                b.column("doc"), b.column("body"), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([class_id(s) for s in sets], pa.int64()),
                none.cast(pa.int32()), none.cast(pa.binary())], names)
        if sketch is not None:
            pack = zstandard.ZstdCompressor(level=1)
            slices = [k for k in range(len(sketch) // part) if sketch[k * part:(k + 1) * part].any()]
            n, none = len(slices), pa.nulls(len(slices)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([
                none, none, none, none, pa.array(slices, pa.int32()),
                pa.array([pack.compress(sketch[k * part:(k + 1) * part].tobytes()) for k in slices], pa.binary())],
                names)

    return materialize(keyed(docs).mapInArrow(run, "doc bigint, body bigint, n bigint, cls bigint, part int, counts binary"))


def sketch_levels(rows: DataFrame, bits: int) -> np.ndarray:
    """Half an octave of the count of each bucket as one byte: at most 2**MAX_BITS bytes."""
    import zstandard

    part = 1 << min(bits, PART_BITS)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            for k, c in zip(b.column("part").to_pylist(), b.column("counts").to_pylist(), strict=True):
                counts = np.frombuffer(unpack.decompress(c), np.uint32)
                sums[k] = counts + sums[k] if k in sums else counts.astype(np.int64)
        levels = [np.floor(2 * np.log2(1.0 + v)).astype(np.uint8).tobytes() for v in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(levels, pa.binary())],
                                         ["part", "levels"])

    out = np.zeros(1 << bits, np.uint8)
    slices = rows.where("part is not null").select("part", "counts").repartition("part")
    for k, levels in slices.mapInArrow(total, "part int, levels binary").toLocalIterator():
        out[k * part:(k + 1) * part] = np.frombuffer(levels, np.uint8)
    return out


def mean_count(levels: np.ndarray) -> float:
    """Mean count of a bucket, from how often each level occurs; slice by slice, as a wide copy would take 128 MB on the driver."""
    part = 1 << PART_BITS
    often = sum(np.bincount(levels[k:k + part], minlength=256) for k in range(0, len(levels), part))
    return float(often @ (np.exp2(np.arange(256) / 2.0) - 1)) / len(levels)


def matches(levels: np.ndarray, n: int, usual: float) -> int:
    """How many prefix shingles a partner must share; ``levels`` are those of the set in global order.

    ``usual`` is the mean count of a bucket, which is what chance adds to a
    list's estimate.  Of a list sum L at most L / l entries meet l times.
    """
    need = -(-PERCENT * n // 100)
    most = max(1, min(MAX_MATCHES, need))
    lists = np.maximum(np.exp2(levels[:n - need + most] / 2.0) - 2 * usual - 2, CHANCE)
    lists = np.cumsum(lists)[n - need:]  # entries met with 1, 2, ... matches
    return 1 + int(np.argmin(lists * (1 + VERIFY_COST / np.arange(1, len(lists) + 1))))


def postings(docs: DataFrame, levels: np.ndarray, bits: int) -> DataFrame:
    """(tok, cls, n, need, pos, typ, long, mixed, p, q): the prefix of every class, once per task that meets the class.

    ``p`` and ``q`` are the parity of the whole set, given where the list may be long.
    ``long`` tells whether the list of the shingle may be long: a sketch never counts too little, so other lists are
    short for certain.  ``mixed`` tells whether the class has a long list.
    """
    shared = docs.sparkSession.sparkContext.broadcast(levels)
    usual = mean_count(levels)
    long_level = int(2 * np.log2(1.0 + LONG_LIST + 2 * usual))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen, level = WordHash(), set(), shared.value
        for b in batches:
            toks, rows, longs = [], [], []
            for s in token_sets(b, known) if b.num_rows else []:
                cls, n = class_id(s), len(s)
                if not n or cls in seen:
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(cls)
                at = level[(s >> np.uint64(64 - bits)).astype(np.int64)]
                order = np.argsort(at, kind="stable")
                ordered = at[order]
                m = matches(ordered, n, usual)
                size = n - -(-PERCENT * n // 100) + m
                toks.append(s[order[:size]].view(np.int64))
                longs.append(ordered[:size] >= long_level)
                mixed = bool(longs[-1].any())
                rows.append((cls, n, m, int(ordered.mean() * 16), size, mixed, *(parity(s) if mixed else (0, 0))))
            if toks:
                sizes = [r[4] for r in rows]
                of = [np.repeat(np.array([r[k] for r in rows], np.int64), sizes) for k in range(4)]
                pos = np.concatenate([np.arange(1, k + 1) for k in sizes])
                short = ~np.concatenate(longs)
                bits_of = [pa.array(np.repeat(np.array([r[k] for r in rows], np.int64), sizes), mask=short) for k in (6, 7)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate(toks)), pa.array(of[0]), pa.array(of[1].astype(np.int32)),
                    pa.array(of[2].astype(np.int32)), pa.array(pos.astype(np.int32)),
                    pa.array(of[3].astype(np.int32)), pa.array(np.concatenate(longs)),
                    pa.array(np.repeat(np.array([r[5] for r in rows]), sizes)), *bits_of],
                    ["tok", "cls", "n", "need", "pos", "typ", "long", "mixed", "p", "q"])

    return docs.select("text").mapInArrow(run, "tok bigint, cls bigint, n int, need int, pos int, typ int, "
                                              "long boolean, mixed boolean, p bigint, q bigint")


def shared_postings(rows: DataFrame) -> DataFrame:
    """Written postings of shingles that more than one class has, each with the class that leads the list.

    Lists that may be long are dealt over slices by class, so a shingle of a third of all classes is no single
    task; their leader is the grouped maximum of the slices' leaders, joined back.
    """
    slices = shuffle_partitions(rows.sparkSession)
    part = F.when(F.col("long"), F.pmod(F.xxhash64("cls"), F.lit(slices)).cast("int")).otherwise(F.lit(0))
    each, whole = Window.partitionBy("tok", "slice", "cls").orderBy("pos"), Window.partitionBy("tok", "slice")
    rows = rows.withColumn("slice", part).repartition("tok", "slice")
    rows = rows.withColumn("copy", F.row_number().over(each)).where("copy = 1")
    rows = rows.withColumn("lead", F.max(F.struct("typ", "cls", "n", "need", "pos")).over(whole)).withColumn(
        "low", F.min("cls").over(whole)).withColumn("high", F.max("cls").over(whole)).where("long or low <> high")
    names = ["tok", "cls", "n", "need", "pos", "typ", "long", "mixed", "p", "q", "lead"]
    rows = materialize(rows.select(*names, "low", "high"))
    led = rows.where("long").groupBy("tok").agg(F.max("lead").alias("lead"), F.min("low").alias("low"), F.max("high").alias("high"))
    led = led.where("low <> high").select("tok", "lead")
    long = materialize(rows.where("long").drop("lead").join(led, "tok").select(*names))
    return rows.where("not long").select(*names).unionByName(long)


def meets(n: Column, pos: Column, other_n: Column, other_pos: Column, need: Column) -> Column:
    """Whether a shared shingle counts: sizes allow a link and both positions lie in the pair's prefixes."""
    both = n.cast("long") + other_n
    overlap = F.ceil(both * PERCENT / (100 + PERCENT) - 1e-9)
    return ((F.least(n, other_n).cast("long") * 100 >= F.greatest(n, other_n).cast("long") * PERCENT)
            & (pos <= n - overlap + need) & (other_pos <= other_n - overlap + need))


def near_parity(x: str, y: str) -> Column:
    """Whether two sets may differ in few enough hashes for a link; true where parities are not given."""
    both = F.col(f"{x}.n").cast("long") + F.col(f"{y}.n")
    overlap = F.ceil(both * PERCENT / (100 + PERCENT) - 1e-9)
    differ = F.bit_count(F.col(f"{x}.p").bitwiseXOR(F.col(f"{y}.p"))) + F.bit_count(
        F.col(f"{x}.q").bitwiseXOR(F.col(f"{y}.q")))
    return F.coalesce(differ <= both - 2 * overlap, F.lit(True))


def leader_pairs(lists: DataFrame) -> DataFrame:
    """(a, b): each class with the leaders of its lists, where enough prefix shingles are shared."""
    need = F.least("need", "lead.need")
    rows = lists.where(F.col("cls") != F.col("lead.cls")).where(
        meets(F.col("n"), F.col("pos"), F.col("lead.n"), F.col("lead.pos"), need))
    pairs = rows.groupBy(F.col("lead.cls").alias("a"), F.col("cls").alias("b")).agg(
        F.count("*").alias("hits"), F.min(need).alias("need"))
    return pairs.where("hits >= need").select("a", "b")


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written table of narrow rows, to be broadcast if it has at most ``rows`` of them; else left to a shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def labelled(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """Postings with the component of their class and whether it is outside that of the list's leader."""
    name = bounded(labels.select(F.col("node").alias("cls"), "label"))
    led = bounded(labels.select(F.col("node").alias("top"), F.col("label").alias("top_label")))
    rows = lists.withColumn("top", F.col("lead.cls")).drop("lead").join(name, "cls", "left").join(led, "top", "left")
    rows = rows.select("tok", "cls", "n", "need", "pos", "typ", "long", "mixed", "p", "q", F.coalesce("label", "cls").alias("label"),
                       F.coalesce("top_label", "top").alias("top_label"))
    return rows.withColumn("outside", F.col("label") != F.col("top_label")).drop("top_label")


def further_pairs(lists: DataFrame, labels: DataFrame, tested: DataFrame) -> DataFrame:
    """(a, b): in each list, the most typical class outside the leader's component against all other components' classes.

    The measure belongs to the class, so the lists of a group of copies agree on whom to compare with.
    """
    rows = materialize(labelled(lists, labels))
    lead = F.max(F.struct("typ", "cls", "n", "need", "pos", "label"))  # grouped and joined back: lists may be long
    led = rows.where("outside").groupBy("tok").agg(lead.alias("lead"))
    rows = rows.join(led, "tok").where(F.col("label") != F.col("lead.label"))
    known = bounded(tested).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = leader_pairs(rows).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return pairs.join(known, ["a", "b"], "left_anti")


def remaining_pairs(lists: DataFrame, labels: DataFrame, tested: DataFrame) -> DataFrame:
    """(a, b) of different components that share enough prefix shingles and were not tested.

    Within a list, classes of the leader's component are met only by classes
    outside it, so the pairs inside a large component are never formed.
    """
    rows = materialize(labelled(lists, labels))
    x = rows.where("outside").alias("x")
    y = rows.alias("y")
    # of l shared prefix shingles the first lies l - 1 places before the prefix ends: the rule for one match
    least = F.least("x.need", "y.need")
    rule = F.when(F.col("x.long"), F.lit(1)).otherwise(least)
    met = x.join(y, (F.col("x.tok") == F.col("y.tok")) & (F.col("x.label") != F.col("y.label"))
                 & (~F.col("y.outside") | (F.col("x.cls") < F.col("y.cls")))
                 & meets(F.col("x.n"), F.col("x.pos"), F.col("y.n"), F.col("y.pos"), rule) & near_parity("x", "y"))
    pairs = met.groupBy(F.least("x.cls", "y.cls").alias("a"), F.greatest("x.cls", "y.cls").alias("b")).agg(
        F.count("*").alias("hits"), F.min(least).alias("need"),
        F.bool_or(F.col("x.mixed") & F.col("y.mixed")).alias("unsure"))  # may share more in long lists
    known = bounded(tested).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = materialize(pairs.where("unsure or hits >= need").join(known, ["a", "b"], "left_anti"))
    sure = pairs.where("not unsure").select("a", "b")
    return sure.unionByName(enough_matches(pairs.where("unsure").select("a", "b"), lists))


def enough_matches(pairs: DataFrame, lists: DataFrame) -> DataFrame:
    """The pairs (a, b) whose prefixes share as many shingles as both sides ask for."""
    ends = bounded(pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct())
    prefixes = lists.join(ends, "cls", "left_semi").groupBy("cls", "n", "need").agg(
        F.collect_list(F.struct("tok", "pos")).alias("prefix"))  # at most a prefix long
    both = pairs.alias("p").join(prefixes.alias("x"), F.col("p.a") == F.col("x.cls")).join(
        prefixes.alias("y"), F.col("p.b") == F.col("y.cls"))
    need = F.least("x.need", "y.need")
    overlap = F.ceil((F.col("x.n").cast("long") + F.col("y.n")) * PERCENT / (100 + PERCENT) - 1e-9)

    def part(side: str) -> Column:
        last = F.col(f"{side}.n") - overlap + need
        return F.transform(F.filter(f"{side}.prefix", lambda t: t["pos"] <= last), lambda t: t["tok"])

    return both.where(F.size(F.array_intersect(part("x"), part("y"))) >= need).select("a", "b")


def class_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Written (cls, tokens) for the (doc, body, cls) rows of ``wanted``, from whole texts; repeated rows count once a task."""
    r, w = keyed(docs).alias("r"), bounded(wanted).alias("w")
    rows = r.join(w, F.col("r.doc").eqNullSafe(F.col("w.doc")) & (F.col("r.body") == F.col("w.body")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, done = WordHash(), set()
        for b in batches:
            if b.num_rows:
                pairs = zip(token_sets(b, known), b.column("cls").to_pylist(), strict=True)
                own = {c: s.tobytes() for s, c in pairs if c not in done and class_id(s) == c}
                done.update(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(own), pa.int64()), pa.array(list(own.values()), pa.binary())], ["cls", "tokens"])

    return materialize(rows.select("r.text", "w.cls").mapInArrow(run, "cls bigint, tokens binary"))


def verified(docs: DataFrame, pairs: DataFrame, first_doc: DataFrame) -> DataFrame:
    """Written links (a, b) among ``pairs`` by exact comparison of the sets.

    Members stream past their leader's set; a leader with many members is
    dealt over several groups, each with its own copy of the leader's set.
    """
    ends = pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls"))).distinct()
    sets = class_sets(docs, materialize(ends.join(first_doc, "cls").select(F.col("at.doc").alias("doc"), F.col("at.body").alias("body"), "cls")))
    groups = bounded(materialize(pairs.groupBy("a").agg(F.count("*").alias("members")).select(
        "a", F.floor(F.col("members") / MEMBERS).cast("int").alias("last"))))
    leaders = groups.join(sets.withColumnRenamed("cls", "a"), "a").select(
        "a", F.explode(F.sequence(F.lit(0), "last")).alias("deal"), F.lit(None).cast("bigint").alias("b"), "tokens")
    dealt = bounded(materialize(pairs.join(groups, "a").select(
        "a", F.pmod(F.xxhash64("b"), F.col("last") + 1).cast("int").alias("deal"), "b")))
    members = sets.withColumnRenamed("cls", "b").join(dealt, "b").select("a", "deal", "b", "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            links = []
            for a, b, data in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "tokens")), strict=True):
                tokens = np.frombuffer(data, np.uint64)
                if b is None:
                    leader, own = a, tokens
                elif leader == a:
                    at = np.searchsorted(own, tokens)
                    at[at == len(own)] = 0
                    hits = int((own[at] == tokens).sum())
                    if 100 * hits >= PERCENT * (len(own) + len(tokens) - hits):
                        links.append((a, b))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])

    streams = leaders.unionByName(members).repartition("a", "deal").sortWithinPartitions(
        "a", "deal", F.col("b").asc_nulls_first())
    return materialize(streams.mapInArrow(run, "a bigint, b bigint"))


def classified(docs: DataFrame) -> DataFrame:
    """(doc, body, n, label, component_id) for every row of ``docs``; ``label`` names the component, null for empty sets."""
    short_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    bits = sketch_bits(docs.count())
    rows = measured(docs, bits)
    of_doc = rows.where("part is null").select("doc", "body", "n", "cls")
    # a class is loaded from one of its rows: with an id if there is one
    at = F.min(F.struct(F.col("doc").isNull().alias("nameless"), "doc", "body"))
    first_doc = materialize(of_doc.where("n > 0").groupBy("cls").agg(F.min("doc").alias("doc"), at.alias("at")))
    lists = shared_postings(postings(docs, sketch_levels(rows, bits), bits))

    near = materialize(leader_pairs(lists))
    links = verified(docs, near, first_doc)
    for _ in range(LEADERS - 1):
        again = materialize(further_pairs(lists, components(links), near))
        links = materialize(links.unionByName(verified(docs, again, first_doc)))
        near = materialize(near.unionByName(again))
    rest = materialize(remaining_pairs(lists, components(links), near))
    more = verified(docs, rest, first_doc)
    labels = components(links.unionByName(more)).select(F.col("node").alias("cls"), "label")

    named = first_doc.select("cls", "doc").join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    smallest = named.groupBy("label").agg(F.min("doc").alias("component_id"))
    names = named.join(smallest, "label").select("cls", "label", "component_id")
    out = of_doc.join(names, "cls", "left")
    return out.select("doc", "body", "n", F.when(F.col("n") > 0, F.col("label")).alias("label"),
                      F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc")).alias("component_id"))


def similarity_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id integer, text)."""
    return classified(docs).select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component: that with the smallest id, null ids last, then the smallest hash of the text.

    Documents with the empty set link with nothing and stay, but of rows that repeat an id (or have none) one stays.
    """
    alone = F.when(F.col("label").isNull(), F.col("doc"))
    rows = classified(docs).groupBy("label", alone.alias("alone"), "doc", "body").agg(F.count("*").alias("copies"))
    first = F.min(F.struct(F.col("doc").isNull().alias("nameless"), "doc", "body", "copies")).alias("w")
    stay = rows.groupBy("label", "alone").agg(first).select("w.doc", "w.body", "w.copies")
    whole = packed(docs, id=F.col("doc_id").cast("bigint"), text_hash=F.xxhash64("text")).alias("r")
    kept = whole.join(materialize(stay).alias("w"), F.col("r.id").eqNullSafe(F.col("w.doc")) & (F.col("r.text_hash") == F.col("w.body")))
    once = kept.where("w.copies = 1").select("r.row")
    repeated = kept.where("w.copies > 1").groupBy("w.doc", "w.body").agg(F.first("r.row").alias("row")).select("row")
    return once.unionByName(repeated).select("row.*")


@query("op3_ngram_jaccard_join")
def op3_ngram_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return similarity_components(table(spark, sf, "documents"))

"""SimHash near-duplicates over an index of deletion variants.

``fingerprints`` gives each text 64 bits, each the majority over the XXH64 of its word shingles. ``linked`` finds every two
fingerprints that differ in at most two bits: of two segments of 32 bits one then differs by at most one bit, so the two
share a variant of that segment in which one bit is a wildcard. Each fingerprint is indexed under its 2 x 32 variants;
equal keys are joined and verified by counting the bits that differ.

A key that more than ``HOT`` fingerprints share isn't joined with itself. Its fingerprints are indexed once more, under
two wildcards: the key's own and one of the other segment, or two of the other segment. Whoever agrees in all other bits
differs in those two at most, so such a group is linked as it stands, and it can hold no more than four fingerprints.
That finds the same links, with work in proportion to the fingerprints of the key.

``near_duplicates`` takes a similarity of shingle sets instead of a number of bits. Two texts with a Jaccard similarity of
0.8 typically differ in ten of 64 bits, far beyond what an index of bits can find in a large corpus. So the texts that the index
of deletion variants links are verified on their shingle sets, and others are looked for as well: by
several SimHash fingerprints of each text, each over the five shingles that are smallest in an order of its own: texts
of similarity s agree in one with a probability of about s to the fifth, and agreeing fingerprints are joined and verified on the
shingle sets themselves. That finds most links cheaply and leaves few components. What it misses is found by an exact join
of the texts in different components on the prefixes of their shingle sets, rare shingles first.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, join_hot, map_slices, slices, spaced_words, store, texts_of
from .graph import components

SEED = 42
#: Shared keys (some 50 bytes each) up to which they are sent to all variants; more of them are joined by a shuffle of the variants.
KEYS = 500_000
#: Fingerprints that may share a key and still be joined with one another.
HOT = 8
#: Shingles hashed and counted at a time.
BLOCK = 1 << 15
#: SimHash fingerprints of samples for each text, and the shingles of one sample. Samples are drawn without replacement: with I
#: shingles shared of U they all miss a pair with a chance of (1 - C(I, 5) / C(U, 5))**16, and texts of five shingles or fewer
#: agree only if all shingles do. The exact join finds what they miss.
SAMPLES = 16
SAMPLE = 5
#: Counters of the sketch that says how frequent shingles are, in how many pieces they are added up, and in how many rounds
#: of tasks' counters each piece. They set the order of the exact join alone: any order gives the same links.
COUNTERS = 1 << 20
PIECES = 1 << 8
SALTS = 16
#: First bits of a text's hash by which it is told whether the text has a pair to be verified.
BITS = 26
#: Rows of one key that meet all others of it in one task.
CHUNK = 256


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of each run of ``width`` words, joined by spaces; of all words if they are fewer; of nothing if there are none."""
    words = spaced_words(text)
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    lasts = ends[min(width, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), lasts.tolist(), strict=True)), dtype=np.uint64, count=n)


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half of the hashes; zero for none."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), BLOCK):
        part = hashes[at : at + BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, fp long), one for each row of ``docs``; a text without words, or null, has fingerprint 0."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bits = np.array([majority(shingle_hashes(t, width)) for t in texts_of(batch)], dtype=np.uint64)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(bits.view(np.int64))], ["doc_id", "fp"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_slices(src, run, "doc_id long, fp long")


def _half(fp: Column, high: Column) -> Column:
    """One of the two segments."""
    return F.when(high, F.shiftrightunsigned(fp, 32)).otherwise(fp.bitwiseAND(0xFFFFFFFF))


def _power(bit: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), bit.cast("int"))


def _without(value: Column, bit: Column) -> Column:
    return value.bitwiseAND(F.bitwise_not(_power(bit)))


def linked(distinct: DataFrame, hot: int = HOT) -> DataFrame:
    """Rows (a, b), a < b: enough pairs of the distinct fingerprints ``fp`` at 2 bits or fewer that their components are
    those of all such pairs; below hot keys, all of them."""
    wild = F.explode(F.sequence(F.lit(0), F.lit(63)))
    # A table of fingerprints is small and lies in few parts; its variants are 64 times as many.
    dealt = distinct.select("fp").repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    variants = dealt.select("fp", wild.alias("w")).select("fp", "w", (F.col("w") >= 32).alias("high"), (F.col("w") % 32).alias("bit"))
    variants = variants.select("fp", "w", F.call_function("shiftleft", F.col("w").cast("long"), F.lit(32)).bitwiseOR(_without(_half(F.col("fp"), F.col("high")), F.col("bit"))).alias("key"))
    counted = variants.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"), F.bit_or("fp").alias("some"), F.bit_and("fp").alias("all")).where("n > 1")
    counted = cut(counted)
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2
    pairs = counted.where("n = 2").where(near).select("a", "b")

    # Whether both values of the wildcard bit occur under the key.
    bit_of = F.shiftrightunsigned("key", 32).cast("int")
    place = F.call_function("shiftleft", F.lit(1).cast("long"), bit_of)
    mixed = F.col("some").bitwiseXOR(F.col("all")).bitwiseAND(place) != 0
    keys = counted.where("n > 2").select("key", "n", mixed.alias("mixed"))
    shared = cut(variants.join(F.broadcast(keys) if keys.count() <= KEYS else keys, "key"))
    few = shared.where(F.col("n") <= hot).select("key", "fp")
    left, right = few.select("key", F.col("fp").alias("a")), few.select("key", F.col("fp").alias("b"))
    joined = left.join(right, (left.key == right.key) & (F.col("a") < F.col("b")) & near).select("a", "b")

    many = shared.where(F.col("n") > hot)
    other = _half(F.col("fp"), F.col("w") < 32)
    own = _half(F.col("fp"), F.col("w") >= 32)
    bit = F.explode(F.sequence(F.lit(0), F.lit(31)))
    # Dealt anew, as the rows of a hot key lie together. Without both values the whole segment is equal: see below.
    crossed = many.where("mixed").repartition("fp", "key").select("fp", "key", other.alias("other"), bit.alias("j")).select("fp", "key", F.col("j").alias("i"), _without(F.col("other"), F.col("j")).alias("rest"))
    # The key's own segment equal, two wildcards in the other: once for each segment, whatever the key's wildcard.
    both = many.select("fp", own.alias("own"), other.alias("other"), (F.col("w") >= 32).alias("high")).distinct()
    ones = both.select("fp", F.when(F.col("high"), F.col("own")).otherwise(-1 - F.col("own")).alias("key"), "other", F.explode(F.sequence(F.lit(0), F.lit(30))).alias("i")).repartition("fp", "key", "i")
    two = ones.select("fp", "key", "other", "i", F.explode(F.sequence(F.col("i") + 1, F.lit(31))).alias("j"))
    two = two.select("fp", "key", (32 + 32 * F.col("j") + F.col("i")).alias("i"), _without(_without(F.col("other"), F.col("i")), F.col("j")).alias("rest"))
    groups = crossed.unionByName(two).groupBy("key", "i", "rest").agg(F.collect_set("fp").alias("fps")).where("size(fps) > 1")
    star = groups.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a < b")
    return pairs.unionByName(joined).unionByName(star).distinct()


def near_duplicate_classes(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    Fingerprints at two bits or fewer are linked, equal ones too; ``component_id`` is the smallest id that can be
    reached, the own one included. A null id is never the smallest unless there is no other, then it is null.
    """
    rows = cut(fingerprints(docs, width, id_col, text_col))
    distinct = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    found = cut(components(linked(distinct.select("fp"))))
    named = distinct.join(found, distinct.fp == found.node, "left").select("fp", "n", "least", F.coalesce("component", "fp").alias("component"))
    low = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of_fp = cut(named.select("fp", "n", "component").join(low, "component").select("fp", "n", "component_id"))
    return join_hot(rows, of_fp, "fp", "n").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- By similarity of the shingle sets.


def _orders(samples: int) -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 1 << 63, size=samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return values ^ (values >> np.uint64(29))


def _samples(hashes: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The SimHash of each sample: the bits set in three of its five shingles, in over half of fewer."""
    if len(hashes) <= SAMPLE:
        return np.full(len(factors), majority(hashes), dtype=np.uint64)
    order = _mixed(hashes[None, :] * factors[:, None])
    a, b, c, d, e = hashes[np.argpartition(order, SAMPLE, axis=1)[:, :SAMPLE]].T
    # Bitwise counts: a + b + c, then d and e on top; ``twos`` and ``more`` are carries.
    one, twos = a ^ b ^ c, (a & b) | (b & c) | (a & c)
    last, more = one ^ d ^ e, (one & d) | (d & e) | (one & e)
    return (twos & more) | ((twos ^ more) & last)


def _prefix(hashes: np.ndarray, similarity: float, levels: np.ndarray) -> np.ndarray:
    """The first of the sorted, distinct hashes in the order (level, hash), so many that sets which are similar enough share
    one of them: no more than n - similarity * n may be missing from the other set. A set without hashes has a 0."""
    n = len(hashes)
    if not n:
        return np.zeros(1, dtype=np.uint64)
    hashes = hashes[np.argsort(levels[_counter(hashes)], kind="stable")]
    return hashes[: n - math.ceil(similarity * n - 1e-9) + 1]


def _parities(hashes: np.ndarray) -> np.ndarray:
    """For each of 256 classes, by their first byte, whether an odd number of the hashes fall into it: as four numbers. Each
    hash that only one of two sets has flips one bit, so the sets differ in as many hashes as bits, or in more."""
    odd = np.bincount((hashes >> np.uint64(56)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _counter(hashes: np.ndarray) -> np.ndarray:
    """The counter of each hash: its first bits."""
    return (hashes >> np.uint64(65 - COUNTERS.bit_length())).astype(np.int64)


def _loads(texts: DataFrame, width: int) -> np.ndarray:
    """In how many texts the shingles of each counter occur, over all texts. A task sends its counters, a byte each while
    they are small; they are added up by pieces, first within salts, so that no task reads those of all tasks."""
    each = COUNTERS // PIECES

    def count(batches):
        sums = np.zeros(COUNTERS, dtype=np.int64)
        for batch in slices(batches):
            held = [np.empty(0, dtype=np.uint64), *(np.unique(shingle_hashes(t, width)) for t in texts_of(batch))]
            sums += np.bincount(_counter(np.concatenate(held)), minlength=COUNTERS)
        yield packed({(k, TaskContext.get().partitionId() % SALTS): part for k, part in enumerate(sums.reshape(PIECES, each)) if part.any()})

    def add(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for piece, salt, data in zip(*(batch.column(c).to_pylist() for c in ("piece", "salt", "data")), strict=True):
                part = np.frombuffer(data, dtype=f"<u{len(data) // each}")
                sums[piece, salt] = sums[piece, salt] + part if (piece, salt) in sums else part.astype(np.int64)
        yield packed(sums)

    def packed(sums: dict[tuple[int, int], np.ndarray]) -> pa.RecordBatch:
        data = [part.astype(np.min_scalar_type(int(part.max()))).tobytes() for part in sums.values()]
        keys = [pa.array([k[i] for k in sums], pa.int32()) for i in range(2)]
        return pa.RecordBatch.from_arrays([*keys, pa.array(data, pa.binary())], ["piece", "salt", "data"])

    schema = "piece int, salt int, data binary"
    salted = texts.select("text").mapInArrow(count, schema).repartition("piece", "salt").mapInArrow(add, schema)
    whole = salted.withColumn("salt", F.lit(0)).repartition("piece").mapInArrow(add, schema)
    loads = np.zeros((PIECES, each), dtype=np.int64)
    for row in whole.toArrow().to_pylist():
        loads[row["piece"]] = np.frombuffer(row["data"], dtype=f"<u{len(row['data']) // each}")
    return loads.reshape(-1)


def _levels(loads: np.ndarray) -> np.ndarray:
    """A byte for each counter, higher where its shingles are more frequent: eight steps for each doubling of what a counter
    holds beyond the usual, the median, which is of rare shingles."""
    beyond = np.maximum(loads - int(np.median(loads)), 0)
    return np.minimum(np.round(8 * np.log2(1 + beyond)), 255).astype(np.uint8)


def _sketches(texts: DataFrame, width: int, similarity: float, samples: int) -> DataFrame:
    """Of each row (node, text): node, fp (the SimHash of all shingles), size (distinct shingles), parities, prints (the SimHash of
    each sample) and keys (the shingles of the prefix, in their order)."""
    factors = _orders(samples)
    levels = _levels(_loads(texts, width))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        every = [shingle_hashes(t, width) for t in texts_of(batch)]
        whole, sets = np.array([majority(s) for s in every], dtype=np.uint64), [np.unique(s) for s in every]
        lists = [
            pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(np.concatenate([np.empty(0, dtype=np.int64), *parts])))
            for parts in ([_parities(s) for s in sets], [_samples(s, factors).view(np.int64) for s in sets], [_prefix(s, similarity, levels).view(np.int64) for s in sets])
        ]
        return pa.RecordBatch.from_arrays([batch.column("node"), pa.array(whole.view(np.int64)), pa.array([len(s) for s in sets], pa.int32()), *lists], ["node", "fp", "size", "parities", "prints", "keys"])

    return map_slices(texts, run, "node long, fp long, size int, parities array<long>, prints array<long>, keys array<long>")


def _nodes(docs: DataFrame, text_col: str) -> DataFrame:
    """Rows (node, other, text): two hashes of the text, null as empty, and the text."""
    text = F.coalesce(text_col, F.lit(""))
    return docs.select(F.xxhash64(text).alias("node"), F.xxhash64(F.lit(SEED), text).alias("other"), text.alias("text"))


def _marked(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """``texts`` with ``likely``: whether the node is one of ``nodes``, or one of those few that share its first bits. A bit for each
    value of these is sent to all tasks, 8 MB for any input, so that the other texts need no shuffle."""
    first = lambda c: F.shiftrightunsigned(c, 64 - BITS)
    block, place = F.shiftrightunsigned(first("node"), 15), first("node").bitwiseAND((1 << 15) - 1)
    held = nodes.select(block.alias("block"), place.alias("place")).groupBy("block").agg(F.bitmap_construct_agg("place").alias("bits"))
    byte = F.conv(F.hex(F.expr("substring(bits, cast(place div 8 as int) + 1, 1)")), 16, 10).cast("long")
    met = texts.withColumns({"block": block, "place": place}).join(F.broadcast(held), "block", "left")
    return met.withColumn("likely", F.coalesce(F.getbit(byte, (F.col("place") % 8).cast("int")) == 1, F.lit(False))).drop("block", "place", "bits")


def _likely_in(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of ``texts`` that are likely to have one of ``nodes``, all that have one among them."""
    return _marked(texts, nodes).where("likely").drop("likely")


def _verified(pairs: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """Those (a, b) whose shingle sets are similar enough. The texts are dealt by node once, for both joins to their pairs; of
    different texts with one node, if there ever are any, the one with the smallest other hash stands for it."""
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
    by_node = _likely_in(texts, nodes).groupBy("node").agg(F.min_by("text", "other").alias("text"))
    left = by_node.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = by_node.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep, known = [], {}
        for a, b in zip(texts_of(batch, "text_a"), texts_of(batch, "text_b"), strict=True):
            if a not in known:  # neighbouring rows often share it
                known = {a: np.unique(shingle_hashes(a, width))}
            mine, other = known[a], np.unique(shingle_hashes(b, width))
            common = len(np.intersect1d(mine, other, assume_unique=True))
            union = len(mine) + len(other) - common
            keep.append(not union or common >= similarity * union - 1e-9)
        return pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return cut(map_slices(both, run, "a long, b long", "text_a"))


def similar(docs: DataFrame, width: int = 5, similarity: float = 0.8, text_col: str = "text", hot: int = HOT) -> DataFrame:
    """Rows (a, b), a < b, of text hashes whose shingle sets have at least that Jaccard similarity: enough that their
    components are those of all such pairs.

    First come the links by the index of deletion variants and those by samples, both verified, then, by an exact join, those between
    texts that are still in different components.
    """
    texts = _nodes(docs, text_col)
    sketches, remove = store(_sketches(texts.select("node", "text"), width, similarity, SAMPLES), "sketches")
    likely = _by_variants(sketches).unionByName(_by_samples(sketches, hot)).distinct()
    found = _verified(likely, texts, width, similarity)
    rest = _verified(_across(sketches, components(found), similarity), texts, width, similarity)
    remove()
    return found.unionByName(rest).distinct()


def _by_variants(sketches: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of texts whose SimHash fingerprints the index of deletion variants links, each fingerprint by the text with
    the smallest hash; and of that text and each other one with the same fingerprint."""
    rows = sketches.select("node", "fp").distinct()
    least = cut(rows.groupBy("fp").agg(F.min("node").alias("least")))
    left, right = least.select(F.col("fp").alias("a"), F.col("least").alias("x")), least.select(F.col("fp").alias("b"), F.col("least").alias("y"))
    near = linked(least.select("fp")).join(left, "a").join(right, "b")
    same = rows.join(least, "fp").where("least < node").select(F.col("least").alias("a"), F.col("node").alias("b"))
    return cut(near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).unionByName(same))


def _by_samples(sketches: DataFrame, hot: int) -> DataFrame:
    """Pairs (a, b), a < b, that are likely similar: texts that share a sample's fingerprint.

    In a group of up to ``hot`` all pairs are. In a larger one each text is paired with the most central: the one whose
    fingerprints are shared most often, which the copies of one text all resemble even where they differ from each other. So
    a group of near copies costs as many comparisons as it has members. What isn't linked so is left to the exact join.
    """
    every = sketches.select("node", F.posexplode("prints").alias("sample", "fp")).select("node", F.xxhash64("sample", "fp").alias("key")).distinct()
    sizes = every.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    held = cut(every.join(sizes, "key"))
    weighted = held.join(held.groupBy("node").agg(F.sum("n").alias("weight")), "node")
    centres = weighted.where(F.col("n") > hot).groupBy("key").agg(F.max(F.struct("weight", "node")).alias("centre")).select("key", F.col("centre.node").alias("centre"))
    large = held.join(centres, "key").select(F.least("centre", "node").alias("a"), F.greatest("centre", "node").alias("b")).where("a < b")
    small = held.where(F.col("n") <= hot)
    pairs = small.select("key", F.col("node").alias("a")).join(small.select("key", F.col("node").alias("b")), "key").where("a < b").select("a", "b")
    return cut(pairs.unionByName(large).distinct())


def _across(sketches: DataFrame, known: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b), a < b, of different components that hold all similar ones; ``known`` has the components (node,
    component) so far.

    Similar sets share a shingle of their prefixes. A key of one text, or whose texts are all in one component, asks for no
    comparison. The others are joined with themselves, those of many texts in chunks. A pair is kept if the sets can be similar by
    what is known without them: at the first shingle of the order that both have, only those behind it can be common, and the sets
    differ in as many shingles as their parities differ in bits. At a later common shingle the same bound asks for more, so it
    adds no pair that isn't kept at the first.

    Prefixes hold most rows of the near dedup: they are dealt by key once, without what a join by node adds later to those of shared keys.
    """
    keyed = sketches.select("node", F.posexplode("keys").alias("place", "key"))
    of_key = Window.partitionBy("key")
    shared = keyed.withColumns({"least": F.min("node").over(of_key), "most": F.max("node").over(of_key)}).where("least < most").select("key", "node", "place").distinct()
    parities = [F.get("parities", F.lit(i)).alias(f"p{i}") for i in range(4)]
    more = sketches.select("node", "size", *parities).distinct().join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))
    rows, remove = store(shared.join(more, "node"), "prefixes")
    mixed = rows.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high")
    held = rows.join(mixed.select("key", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks")), "key")
    columns = ["node", "component", "size", "place", *[f"p{i}" for i in range(4)]]
    left = held.select("key", F.pmod("node", "chunks").cast("int").alias("chunk"), F.struct(*columns).alias("x"))
    right = held.select("key", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.struct(*columns).alias("y"))
    total = F.col("x.size") + F.col("y.size")
    enough = F.least(F.col("x.size") - F.col("x.place"), F.col("y.size") - F.col("y.place")) + 1e-6 >= similarity / (1 + similarity) * total
    bits = sum((F.bit_count(F.col(f"x.p{i}").bitwiseXOR(F.col(f"y.p{i}"))) for i in range(1, 4)), F.bit_count(F.col("x.p0").bitwiseXOR(F.col("y.p0"))))
    close = bits <= (1 - similarity) / (1 + similarity) * total + 1e-6
    pairs = left.join(right, ["key", "chunk"]).where("x.node < y.node and x.component <> y.component").where(enough & close)
    found = cut(pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct())
    remove()
    return found


def drop_near_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with its columns and, of each group of near-duplicates, only the text with the smallest id.

    Rows of one and the same text stay or go together; removing copies is the exact dedup's work. Null is an empty text,
    and texts without words are similar to each other. A null id is larger than any other; of equal ids the smaller
    text hash decides. A row goes only if two hashes of its text agree, so no text goes for another's sake by collision.
    """
    edges = similar(docs, width, similarity, text_col)
    groups = cut(components(edges))
    keys = ["node", "other"]
    text = F.coalesce(text_col, F.lit(""))
    node, other = F.xxhash64(text).alias("node"), F.xxhash64(F.lit(SEED), text).alias("other")
    ids = docs.select(node, other, F.col(id_col).cast("long").alias("id")).join(groups, "node")
    of_node = cut(ids.groupBy("component", "node").agg(F.min("other").alias("other"), F.min(F.struct(F.col("id").isNull(), "id")).alias("id")))
    best = of_node.groupBy("component").agg(F.min_by("node", F.struct("id", "node")).alias("best"))
    gone = cut(of_node.join(best, "component").where("node <> best").select(*keys))
    rows = _marked(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), node, other), gone)
    kept = rows.where("not likely").unionByName(rows.where("likely").join(gone, keys, "left_anti").select(*rows.columns))
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])

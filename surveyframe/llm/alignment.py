"""Aligning two tokenizers' ids of the same texts by byte offsets.

A text's tokens under A and under B cover the same bytes. The offsets where tokens of both end cut them into groups; an A and a
B token are linked if their bytes overlap. All of it is array work over the distinct chunks of a batch (see ``chunks``): ends by
cumulated byte lengths, common cuts by intersection, group labels by search, links by repeating each A token
for the B tokens from its first byte to its last. Chunks are set apart by cuts, so a text's groups and links are
those of its chunks.

How often the corpus links two ids is counted by document first, then in two shuffles: by pair and a salt, then by pair.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import ByteLevelTokenizer, Chunks, encode_chunks, expand, split_chunks
from .common import cut, join_hot, remove, shared_dir, slices, texts

#: Distinct pairs up to which their counts are sent to all tasks (16 bytes each); more are joined by a shuffle.
PAIRS = 2_000_000
SALTS = 16
#: Bytes of text that are aligned at once.
SLICE = 4 << 20
#: Characters that are encoded in one call: pieces take longer for each in a longer text.
CALL = 1 << 13


class PieceTokenizer:
    """A sentencepiece BPE model whose pieces hold no space behind another character, without special tokens."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(self.size)]
        byte = [model.is_byte(i) for i in range(self.size)]
        self.bytes_of = [bytes([int(p[1:-1], 16)]) if b else p.replace("▁", " ").encode() for p, b in zip(pieces, byte, strict=True)]
        if any(" " in p.replace("▁", " ").lstrip(" ") for p in pieces):
            raise ValueError("a piece holds a space behind another character")
        self.begins = np.array([b[:1] == b" " for b in self.bytes_of])
        space = model.piece_to_id("▁")
        #: The model puts the space in front of a text itself, unless the text is empty.
        self.call = lambda text: np.array(model.encode(text[1:], num_threads=1) if len(text) > 1 else [space], dtype=np.uint32)


class Aligner:
    """Two tokenizers with tables of their tokens' byte lengths and decimal ids."""

    def __init__(self, a: ByteLevelTokenizer, b: PieceTokenizer):
        self.a, self.b = a, b
        self.lengths = [np.array([len(x) for x in t.bytes_of], dtype=np.int64) for t in (a, b)]
        self.shown = [pa.array([f"{i}{mark}" for mark in marks for i in range(t.size)], pa.large_string()) for t, marks in ((a, ",|"), (b, ",;"))]

    def align(self, column: pa.Array) -> Aligned:
        chunks = split_chunks(column, lead=True)
        data = [f" {w}".encode() for w in chunks.plain] + [w.encode() for w in chunks.odd]
        sides = [encode_chunks(chunks, t.call, t.begins, CALL) for t in (self.a, self.b)]
        good = np.ones(len(data), bool)
        for t, (ids, starts) in zip((self.a, self.b), sides, strict=True):
            table, held, at = t.bytes_of, ids.tolist(), starts.tolist()
            if b"".join(map(table.__getitem__, held)) != b"".join(data) or (np.diff(np.append(0, np.cumsum(self.lengths[t is self.b][ids]))[starts]) != np.fromiter(map(len, data), np.int64, len(data))).any():
                good &= np.array([b"".join(map(table.__getitem__, held[s:e])) == x for s, e, x in zip(at[:-1], at[1:], data, strict=True)], dtype=bool)
        return Aligned(self, chunks, *sides, good, (pc.binary_length(pc.fill_null(column, "")).to_numpy(zero_copy_only=False) > 0))


class Aligned:
    """The alignment of a batch's distinct chunks; those whose bytes differ under a tokenizer have no tokens."""

    def __init__(self, aligner: Aligner, chunks: Chunks, a: tuple, b: tuple, good: np.ndarray, filled: np.ndarray):
        self.aligner, self.chunks = aligner, chunks
        (self.a, self.at_a), (self.b, self.at_b) = (_only(ids, starts, good) for ids, starts in (a, b))
        #: Texts without bytes, or with a chunk whose bytes differ, have no tokens.
        bad = np.concatenate(([0], np.cumsum(~good[chunks.codes])))[chunks.offsets]
        self.counts = filled & (np.diff(bad) == 0)
        self.ends_a, self.ends_b = np.cumsum(aligner.lengths[0][self.a]), np.cumsum(aligner.lengths[1][self.b])
        self.cuts = np.intersect1d(self.ends_a, self.ends_b, assume_unique=True)
        self.group_a, self.group_b = np.searchsorted(self.cuts, self.ends_a), np.searchsorted(self.cuts, self.ends_b)
        first = np.searchsorted(self.ends_b, self.ends_a - aligner.lengths[0][self.a], side="right")
        reps = np.searchsorted(self.ends_b, self.ends_a) - first + 1
        before = np.cumsum(reps) - reps
        self.link_a = np.repeat(np.arange(len(self.a)), reps)
        self.link_b = np.repeat(first - before, reps) + np.arange(len(self.link_a))
        #: Of each chunk: where its links and its groups begin.
        self.at_links = np.append(before, len(self.link_a))[self.at_a]
        self.at_groups = np.append(self.group_a, len(self.cuts))[self.at_a]

    def of_texts(self, of_chunk: np.ndarray) -> np.ndarray:
        """The sum over each text's chunks; 0 for texts without tokens."""
        sums = np.concatenate(([0], np.cumsum(of_chunk[self.chunks.codes])))[self.chunks.offsets]
        return np.where(self.counts, np.diff(sums), 0)

    def pairs_of_texts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distinct pairs of each text, A's id above the 32 bits of B's; how many of its links hold each; how many pairs each text has)."""
        known, which = np.unique(self.a[self.link_a] << 32 | self.b[self.link_b], return_inverse=True)
        texts = np.repeat(np.arange(len(self.counts)), self.of_texts(np.diff(self.at_links)))
        of_text = np.repeat(self.counts, np.diff(self.chunks.offsets))
        links = expand(which, self.at_links, self.chunks.codes[of_text])
        keys = np.sort(texts * len(known) + links)
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        texts, links = np.divmod(keys[starts], max(1, len(known)))
        return known[links], np.diff(np.append(starts, len(keys))), np.bincount(texts, minlength=len(self.counts))

    def digests(self) -> list[str]:
        """The sha256 of each text's groups, ``a1,a2|b1;a3|b2,b3``; '' without tokens."""
        order = np.argsort(np.concatenate((2 * self.group_a, 2 * self.group_b + 1)), kind="stable")
        last_a, last_b = (np.append(g[1:] != g[:-1], np.ones(min(1, len(g)), bool)) for g in (self.group_a, self.group_b))
        shown = pa.chunked_array([self.aligner.shown[0].take(pa.array(self.a + last_a * self.aligner.a.size)), self.aligner.shown[1].take(pa.array(self.b + last_b * self.aligner.b.size))]).combine_chunks().take(pa.array(order))
        places = np.concatenate(([0], np.cumsum(pc.binary_length(shown).to_numpy())))
        of_chunk = places[self.at_a + self.at_b]
        lines = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(of_chunk) - 1, [None, pa.py_buffer(of_chunk.astype(np.int64)), shown.buffers()[2]])
        out, some = [], [0]
        offsets = self.chunks.offsets
        sizes = np.concatenate(([0], np.cumsum(np.diff(of_chunk)[self.chunks.codes])))[offsets]
        while some[-1] < len(offsets) - 1:  # texts whose groups take so much space at once
            some.append(max(some[-1] + 1, int(np.searchsorted(sizes, sizes[some[-1]] + 4 * SLICE, side="right")) - 1))
        for i, j in zip(some, some[1:]):
            put = lines.take(pa.array(self.chunks.codes[offsets[i] : offsets[j]]))
            data = memoryview(put.buffers()[2]) if put.buffers()[2] is not None else memoryview(b"")
            at = (sizes[i : j + 1] - sizes[i]).tolist()
            out += [hashlib.sha256(data[s : e - 1]).hexdigest() if c else "" for s, e, c in zip(at[:-1], at[1:], self.counts[i:j].tolist(), strict=True)]
        return out


def _only(ids: np.ndarray, starts: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if good.all():
        return ids.astype(np.int64), starts
    sizes = np.diff(starts)
    return ids[np.repeat(good, sizes)].astype(np.int64), np.concatenate(([0], np.cumsum(sizes * good)))


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    """``path_a``: a byte-level file of the tokenizers library; ``path_b``: a sentencepiece model."""
    return Aligner(ByteLevelTokenizer(path_a, special=False), PieceTokenizer(path_b))


def linked_pairs(docs: DataFrame, tool: Callable[[], Aligner], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and pairs and times: the distinct pairs of linked ids (A's above the 32
    bits of B's) and how many links hold each.

    Null and empty texts, and texts that a tokenizer doesn't give back byte by byte, have no tokens: zeros, '' and no pairs.
    """
    src = texts(docs, id_col, text_col)

    def run(batches):
        for batch in slices(batches, size=SLICE):
            found = tool().align(batch.column("text"))
            counts = [pa.array(found.of_texts(np.diff(x))) for x in (found.at_a, found.at_b, found.at_groups, found.at_links)]
            pairs, times, sizes = found.pairs_of_texts()
            ends = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (pairs, times.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, pa.array(found.digests(), pa.string()), *lists], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>")


def pair_counts(linked: DataFrame) -> DataFrame:
    """pair, n (links of all documents that hold it), n_docs, best (whether no other pair of the same B id has more)."""
    each = linked.select("pairs", "times", F.pmod(F.xxhash64("groups_sha256"), F.lit(SALTS)).alias("salt")).select("salt", F.explode(F.arrays_zip("pairs", "times")).alias("x"))
    parts = each.groupBy(F.col("x.pairs").alias("pair"), "salt").agg(F.sum("x.times").alias("n"), F.count(F.lit(1)).alias("n_docs"))
    counts = cut(parts.groupBy("pair").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs")).withColumn("b", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))))
    top = counts.groupBy("b").agg(F.max("n").alias("most"))
    return counts.join(top, "b").select("pair", "n", "n_docs", (F.col("n") == F.col("most")).alias("best"))


def align_documents(docs: DataFrame, tool: Callable[[], Aligner], id_col: str = "doc_id", text_col: str = "text", pairs: int = PAIRS) -> DataFrame:
    """What ``linked_pairs`` gives, with n_best (links whose pair is the most frequent of its B id in all documents, ties included)
    and count_sum (the pair's count in all documents, over links) in place of the pairs.

    Repeated rows count each. Null ids are kept. No rows give no rows. Texts are aligned once; their pairs lie in the
    shared folder until the counts are known.
    """
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/pairs-{uuid.uuid4().hex}"
    linked_pairs(docs, tool, id_col, text_col).write.parquet(path)
    linked = spark.read.parquet(path)
    known = cut(pair_counts(linked))
    if known.count() > pairs:
        out = _counted_by_join(linked, known)
    else:
        table = known.toArrow().sort_by("pair")  # at most ``pairs`` rows
        out = _counted_by_table(linked, spark.sparkContext.broadcast(tuple(table.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("pair", "n", "best"))))
    out = cut(out)
    remove(spark, path)
    return out


_KEPT = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]


def _counted_by_table(linked: DataFrame, held) -> DataFrame:
    def run(batches):
        pair, n, best = held.value
        for batch in batches:
            at, times = np.searchsorted(pair, batch.column("pairs").flatten().to_numpy()), batch.column("times").flatten().to_numpy()
            ends = batch.column("pairs").offsets.to_numpy() - batch.column("pairs").offsets[0].as_py()
            sums = [np.diff(np.concatenate(([0], np.cumsum(x, dtype=np.int64)))[ends]) for x in (times * best[at], times * n[at])]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in _KEPT], *map(pa.array, sums), batch.column("groups_sha256")], [*_KEPT, "n_best", "count_sum", "groups_sha256"])

    kind = linked.schema["doc_id"].dataType.simpleString()
    return linked.mapInArrow(run, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def _counted_by_join(linked: DataFrame, known: DataFrame) -> DataFrame:
    """The same by a shuffle of all documents' pairs; pairs that many documents hold meet their count by broadcast."""
    rows = cut(linked.withColumn("row", F.monotonically_increasing_id()))
    each = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").cast("long").alias("times"))
    met = join_hot(each, known, "pair", "n_docs")
    sums = met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    return rows.join(sums, "row", "left").select(*_KEPT, F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")

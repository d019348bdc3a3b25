"""Packing documents into sequences of bounded length, by dynamic programming over cut points.

The documents of a partition, in their order, are one stream of ids. A window of at most ``size`` ids becomes a sequence. It is
padded to ``size`` unless its length is a power of two. Windows end at the ends of documents, at the ends of sentences or, at a
higher price, at every ``STRIDE``-th id of a sentence. The chosen cuts minimise

    padding + price of every cut that isn't a document's end + one for each window

over all cuts between these points. The cheapest way to end a window at point j is the smallest of cost(i) + position(i) over the
points i within ``size`` before it, which a queue of rising values holds as j moves on, or of cost(i) at the distances
that are powers of two.

No row is shuffled: every task packs what it reads, in bounded blocks, and hands the last windows of a block on to the next.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import ByteLevelTokenizer
from .common import slices, texts

#: Prices of a cut at a sentence's end and inside of a sentence, in ids of padding.
SENTENCE = 8
INSIDE = 64
#: Ids between two points inside of a sentence.
STRIDE = 64
#: Ids that are packed at once, bytes of text that are encoded at once, and the windows at a block's end that are packed again
#: with the next.
BLOCK = 1 << 20
SLICE = 16 << 20
AGAIN = 8

_STOP = re.compile(r"""[.!?…。！？]["'”’)\]}»」』]*\Z""")


class SentenceTokenizer:
    """A byte-level tokenizer that knows its sentence ends. ``stops``, ``spaces`` and ``lines``: whether a token ends a sentence,
    begins with white space, ends a line. Added tokens inside a text are found, as the library does."""

    def __init__(self, path: str, end_id: int):
        self.tokenizer, self.end_id = ByteLevelTokenizer(path, special=True), end_id
        shown = [b.decode("utf-8", "replace") for b in self.tokenizer.bytes_of]
        self.stops = np.array([bool(_STOP.search(t)) for t in shown])
        self.spaces = np.array([t[:1].isspace() for t in shown])
        self.lines = np.array([t.endswith("\n") for t in shown])

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, how many each text has), with ``end_id`` behind each text."""
        return self.tokenizer.encode(column, self.end_id)


@lru_cache(maxsize=2)
def sentence_tokenizer(path: str, end_id: int) -> SentenceTokenizer:
    return SentenceTokenizer(path, end_id)


def least_cost_cuts(points: np.ndarray, prices: np.ndarray, size: int) -> tuple[list[int], int]:
    """(numbers of the chosen points, first and last included; their cost). ``points`` rise from 0 with gaps up to ``size``;
    ``prices``: of a cut there, that of the last point counts as well."""
    n = len(points)
    number = np.full(int(points[-1]) + 1, -1, dtype=np.int32)
    number[points] = np.arange(n)
    js, its = [], []
    for k in range(size.bit_length()):
        first = int(np.searchsorted(points, 1 << k))
        at = number[points[first:] - (1 << k)]
        hit = np.flatnonzero(at >= 0)
        js.append(hit + first)
        its.append(at[hit])
    js, its = np.concatenate(js), np.concatenate(its)
    order = np.argsort(js, kind="stable")
    upto = np.searchsorted(js[order], np.arange(n), side="right").tolist()
    exact = its[order].tolist()
    at, price = points.tolist(), prices.tolist()
    cost, came, values = [0] * n, [0] * n, [0] * n  # values: cost + position
    queue, head, k = [0], 0, upto[0] if n else 0
    for j in range(1, n):
        here = at[j]
        low = here - size
        while at[queue[head]] < low:
            head += 1
        best = queue[head]
        least = values[best] + size - here
        for i in exact[k : upto[j]]:
            if cost[i] < least:
                least, best = cost[i], i
        k = upto[j]
        cost[j] = least = least + price[j] + 1
        came[j] = best
        values[j] = value = least + here
        while len(queue) > head and values[queue[-1]] > value:
            queue.pop()
        queue.append(j)
    chosen = [n - 1]
    while chosen[-1]:
        chosen.append(came[chosen[-1]])
    return chosen[::-1], cost[-1] if n else 0


def cut_points(ids: np.ndarray, ends: np.ndarray, tokenizer: SentenceTokenizer, size: int, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """(points, prices) of a stream of ids; ``ends``: where documents end. At the stream's ``last`` end every id is a point."""
    n = len(ids)
    price = np.full(n + 1, -1, dtype=np.int32)
    step = max(1, min(STRIDE, size))
    turns = np.flatnonzero((tokenizer.stops[ids[:-1]] & tokenizer.spaces[ids[1:]]) | tokenizer.lines[ids[:-1]]) + 1 if n else np.zeros(0, np.int64)
    marks = np.unique(np.concatenate(([0], turns, ends)))
    lengths = np.diff(np.append(marks, n))
    inner = np.repeat(marks, lengths // step) + (np.arange((lengths // step).sum()) - np.repeat(np.cumsum(lengths // step) - lengths // step, lengths // step) + 1) * step
    price[inner] = INSIDE
    if last:
        price[max(0, n - 2 * size) :] = INSIDE
    price[turns] = SENTENCE
    price[ends] = 0
    price[[0, n]] = 0
    points = np.flatnonzero(price >= 0)
    return points, price[points]


class Packer:
    """Packs documents as they come. ``add`` and ``close`` give finished pieces as arrays, in the order of PIECES."""

    PIECES = ("doc", "start", "length", "sequence_id", "offset")

    def __init__(self, tokenizer: SentenceTokenizer, size: int, block: int = BLOCK):
        self.tokenizer, self.size, self.block = tokenizer, size, block
        self.ids: list[np.ndarray] = []  # of what isn't packed yet
        self.docs: list[tuple[np.ndarray, np.ndarray]] = []  # (document's number, its ids left) of it
        self.first_start = self.held = self.sequences = 0

    def add(self, numbers: np.ndarray, ids: np.ndarray, sizes: np.ndarray):
        self.ids.append(ids)
        self.docs.append((numbers, sizes))
        self.held += len(ids)
        return self._pack(False) if self.held >= self.block else None

    def close(self):
        return self._pack(True) if self.held else None

    def _pack(self, last: bool):
        ids, numbers, sizes = np.concatenate(self.ids), np.concatenate([d[0] for d in self.docs]), np.concatenate([d[1] for d in self.docs])
        numbers, sizes = numbers[sizes > 0], sizes[sizes > 0]
        ends = np.cumsum(sizes)
        points, prices = cut_points(ids, ends, self.tokenizer, self.size, last)
        cuts = points[least_cost_cuts(points, prices, self.size)[0]]
        if not last and len(cuts) > AGAIN + 1:
            cuts = cuts[: len(cuts) - AGAIN]
        elif not last:  # windows smaller than a block's number of them: wait for more
            self.ids, self.docs, self.block = [ids], [(numbers, sizes)], 2 * self.block
            return None
        done = int(cuts[-1])
        bounds = np.unique(np.concatenate((cuts, ends[ends < done])))
        starts, lengths = bounds[:-1], np.diff(bounds)
        doc = np.searchsorted(ends, starts, side="right")
        begins = ends - sizes
        begins[0] -= self.first_start
        sequence = np.searchsorted(cuts, starts, side="right") - 1
        out = (numbers[doc], starts - begins[doc], lengths, sequence + self.sequences, starts - cuts[sequence]), ids[:done]
        self.sequences += len(cuts) - 1
        left = int(np.searchsorted(ends, done, side="right"))
        if left < len(ends):
            self.first_start = done - int(begins[left])
            rest = sizes[left:].copy()
            rest[0] = ends[left] - done
            self.ids, self.docs = [ids[done:]], [(numbers[left:], rest)]
        else:
            self.ids, self.docs, self.first_start = [], [], 0
        self.held = len(ids) - done
        return out


def pack_documents(docs: DataFrame, tokenizer: Callable[[], SentenceTokenizer], size: int = 2048, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, block: int = BLOCK) -> DataFrame:
    """One row for each piece: doc_id, start (its document's ids before it), length, ids_crc32 (unsigned, of 32-bit little-endian
    ids), doc_tokens, sequence_id, offset (its place in the sequence, gapless from 0) and, if asked for, ids.

    A null text is an empty one; its document still has the end id. Repeated rows and null ids are documents of their own. The
    order is that of the input; a sequence holds documents of one partition only, and its id begins with the partition's number.
    Ties between cuts go to the longer window. No rows give no rows.
    """
    schema = "doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids array<int>" if with_ids else "")
    src = texts(docs, id_col, text_col)

    def run(batches):
        part = TaskContext.get().partitionId()
        packer = Packer(enc := tokenizer(), size, block)
        kept: dict[int, tuple] = {}  # documents that aren't packed to their end: id and length
        count = 0

        def rows(found):
            if found is None:
                return
            (doc, start, length, sequence, offset), ids = found
            wide = memoryview(ids.astype("<u4")).cast("B")
            ends = np.cumsum(length)
            crcs = [zlib.crc32(wide[4 * a : 4 * b]) for a, b in zip((ends - length).tolist(), ends.tolist(), strict=True)]
            names = [kept[d] for d in doc.tolist()]
            least = int(doc[-1])
            for d in [d for d in kept if d < least]:
                del kept[d]
            columns = [pa.array([x[0] for x in names], known), pa.array(start), pa.array(length), pa.array(crcs, pa.int64()), pa.array([x[1] for x in names], pa.int64()), pa.array(sequence + (part << 33)), pa.array(offset)]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(ids.astype(np.int32))))
            batch = pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"][: len(columns)])
            for at in range(0, batch.num_rows, 20_000):
                yield batch.slice(at, 20_000)

        known = pa.int64()
        for batch in slices(batches, size=SLICE):
            known = batch.schema.field("doc_id").type
            ids, sizes = enc.encode(batch.column("text"))
            numbers = np.arange(count, count + len(sizes))
            count += len(sizes)
            kept.update(zip(numbers.tolist(), zip(batch.column("doc_id").to_pylist(), sizes.tolist(), strict=True), strict=True))
            yield from rows(packer.add(numbers, ids, sizes))
        yield from rows(packer.close())

    return src.mapInArrow(run, schema.format(kind=src.schema["doc_id"].dataType.simpleString()))


def sequences(pieces: DataFrame, size: int = 2048, pad_id: int = 0) -> DataFrame:
    """The sequences of pieces with ids: sequence_id, ids (padded to ``size``, except at a power of two), n_tokens, and the
    offsets at which pieces of documents begin. A sequence has at most ``size`` pieces."""
    held = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"), F.sum("length").alias("n_tokens"))
    n = F.col("n_tokens").cast("int")
    pad = F.when(F.bit_count("n_tokens") == 1, 0).otherwise(F.lit(size) - n)
    ids = F.concat(F.flatten(F.transform("p", lambda x: x["ids"])), F.array_repeat(F.lit(pad_id), pad))
    return held.select("sequence_id", ids.alias("ids"), "n_tokens", F.transform("p", lambda x: x["offset"]).alias("begins"))

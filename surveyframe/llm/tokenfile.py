"""Token-id files: one concatenated id array per file, with Elias-Fano encoded document boundaries.

File layout (little-endian): the header, the boundaries (low bits, high bits, select samples), the document ids as 64-bit
integers, the token ids of 2 or 4 bytes each, and a line feed. The header holds the file's place (part, number), so that
files in that order hold the documents in ascending order of their ids.

Spark writes the files, as rows of raw bytes through its text writer with one row per file, and reads them with its
binaryFile source. So they are committed by task, live in any store that Spark reaches, and a lost executor's files are
written again.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, ordered_sum, slices

#: Ids after which a file is closed; a longer document makes a file of its own.
FILE_IDS = 4 << 20
#: Ones between two select samples.
STEP = 256
#: Words that each of two generations of a worker's memo holds, besides those of one batch. It bounds memory and changes no result.
MEMO = 600_000
_HEAD = struct.Struct("<4sHHqqqqqqqq")
_MAGIC = b"EFT1"


class EliasFano:
    """A rising sequence of n integers up to u in about n * (2 + log2(u / n)) bits, with access to each."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.int64)
        n = len(values)
        if n and (values[0] < 0 or (np.diff(values) < 0).any()):
            raise ValueError("the values must rise from 0 or more")
        most = int(values[-1]) if n else 0
        low_bits = max(0, (most // n).bit_length() - 1) if n else 0
        bits = (values[:, None] >> np.arange(low_bits) & 1).astype(np.uint8)
        low = np.packbits(bits.ravel(), bitorder="little")
        ones = (values >> low_bits) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, dtype=np.uint8)
        high[ones] = 1
        return cls(n, low_bits, low, np.packbits(high, bitorder="little"), ones[::STEP].astype(np.uint32))

    def _low(self, i: int) -> int:
        at = i * self.low_bits
        part = int.from_bytes(self.low[at >> 3 : (at + self.low_bits + 7) >> 3].tobytes(), "little")
        return part >> (at & 7) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """Value i: from the nearest sample on, the high bits are searched for the i-th one."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // STEP]), i % STEP
        byte, skip = at >> 3, at & 7
        word = int(self.high[byte]) >> skip << skip
        while (held := word.bit_count()) <= left:
            left -= held
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        place = (byte << 3) + (word & -word).bit_length() - 1
        return (place - i) << self.low_bits | self._low(i)

    def all(self) -> np.ndarray:
        """Every value."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
        low = (bits.astype(np.int64) << np.arange(self.low_bits)).sum(axis=1)
        return (ones - np.arange(self.n)) << self.low_bits | low

    @property
    def bytes(self) -> int:
        return self.low.nbytes + self.high.nbytes + self.samples.nbytes


def pack(doc_ids: list[int | None], buffers: list[bytes], width: int, part: int, number: int) -> bytes:
    """One file. ``buffers``: the ids of each document, ``width`` bytes each; documents without an id come first."""
    ends = EliasFano.build(np.cumsum([0, *(len(b) // width for b in buffers)]))
    nulls = sum(d is None for d in doc_ids)
    head = _HEAD.pack(_MAGIC, width, ends.low_bits, len(buffers), nulls, sum(map(len, buffers)) // width, part, number, ends.low.nbytes, ends.high.nbytes, ends.samples.nbytes)
    known = np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes()
    return b"".join([head, ends.low.tobytes(), ends.high.tobytes(), ends.samples.astype("<u4").tobytes(), known, *buffers, b"\n"])


class TokenFile:
    """Reads what ``pack`` wrote."""

    def __init__(self, data: bytes):
        magic, self.width, low_bits, self.n, self.nulls, self.n_ids, self.part, self.number, low, high, samples = _HEAD.unpack_from(data)
        if magic != _MAGIC:
            raise ValueError("not a token-id file")
        view, at = memoryview(data), _HEAD.size
        take = lambda size, kind, at: np.frombuffer(view[at : at + size], dtype=kind)
        self.ends = EliasFano(self.n + 1, low_bits, take(low, np.uint8, at), take(high, np.uint8, at + low), take(samples, "<u4", at + low + high))
        at += low + high + samples
        self.doc_ids = take(8 * self.n, "<i8", at)
        self.ids = take(self.width * self.n_ids, f"<u{self.width}", at + 8 * self.n)

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.ends.select(i) : self.ends.select(i + 1)]


class WordTokenizer:
    """Encodes with the tokenizers library, a memo of words before it.

    For tokenizers that never join or look across ASCII white space, so that a text's ids are those of its words one
    after the other. Arrow splits a batch into words and numbers the distinct
    ones, so that only these are looked up, and puts the ids of all words together. The memo has two generations: what
    is met again moves to the younger, and when that is full the older is dropped.
    """

    def __init__(self, path: str, end_id: int | None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.width = 2 if max(size, (end_id or 0) + 1) <= 1 << 16 else 4
        self.end = b"" if end_id is None else self._bytes([end_id])
        self._added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        ids = lambda text: self.library.encode(text, add_special_tokens=False).ids
        self._lowering = all(ids(t) == ids(t.lower()) for t in ("Ab", "AB1", "zQ.X"))
        self._parting = all(ids(f"{t}{p}") == ids(t) + ids(p) for t in ("ab", "b1", "a-b") for p in (".", ",", ";", ":", "!", "?", ")", "?!."))
        self._young: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    def _bytes(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{'H' if self.width == 2 else 'I'}", *ids)

    def encode_buffers(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text, ``width`` bytes each, with the end id; null is an empty text."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        coded = split.flatten().dictionary_encode()
        known = self._known(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        starts = np.cumsum([0, *map(len, known)])
        sizes, at = np.diff(starts), coded.indices.to_numpy()
        each = pa.LargeListArray.from_arrays(pa.array(starts // self.width), pa.array(np.frombuffer(b"".join(known), dtype=f"<u{self.width}")))
        ids = memoryview(each.take(coded.indices).flatten().to_numpy()).cast("B") if len(at) else memoryview(b"")
        ends = np.concatenate(([0], np.cumsum(sizes[at])))[split.offsets.to_numpy() - split.offsets[0].as_py()].tolist()
        return [bytes(ids[a:b]) + self.end for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def _known(self, words: list[str]) -> list[bytes]:
        if len(self._young) > MEMO:
            self._old, self._young = self._young, {}
        known, young, old, new = list(map(self._young.get, words)), self._young, self._old, {}
        for i in [i for i, ids in enumerate(known) if ids is None]:
            if (ids := old.get(words[i])) is None:
                new[i] = self._parts(words[i])
            else:
                known[i] = young[words[i]] = ids
        self._learn(list(dict.fromkeys(p for parts in new.values() for p in parts if p not in young)))
        for i, parts in new.items():
            known[i] = young[words[i]] = young[parts[0]] if len(parts) == 1 else young[parts[0]] + young[parts[1]]
        return known

    def _learn(self, parts: list[str]) -> None:
        encode = getattr(self.library, "encode_batch_fast", self.library.encode_batch)  # the same ids without offsets
        for at in range(0, len(parts), 20_000):
            some = parts[at : at + 20_000]
            for part, found in zip(some, encode(some, add_special_tokens=False), strict=True):
                self._young[part] = self._bytes(found.ids)

    def _parts(self, word: str) -> tuple[str, ...]:
        """What the library is asked for. Punctuation behind an ASCII letter or digit stands by itself, and capitals of a
        word in ASCII are small, if the tokenizer treats them so and no added token, which matches the raw text, comes of it."""
        core = word.rstrip(".,;:!?)") if self._parting else word
        parts = (core, word[len(core) :]) if core and core != word and core[-1].isascii() and core[-1].isalnum() else (word,)
        if self._lowering and word.isascii() and not any(t in word.lower() for t in self._added):
            return tuple(p.lower() for p in parts)
        return parts if not any(t in word for t in self._added) else (word,)


@lru_cache(maxsize=2)
def word_tokenizer(path: str, end_id: int | None) -> WordTokenizer:
    return WordTokenizer(path, end_id)


def write_token_files(docs: DataFrame, folder: str, tokenizer: Callable[[], WordTokenizer], id_col: str = "doc_id", text_col: str = "text", file_ids: int = FILE_IDS) -> None:
    """Writes all documents in ascending order of their ids, null ids first, equal ids by the text's hash.

    A null text is an empty one. Ranges of ids go to as many partitions as spark.sql.shuffle.partitions says; equal ids
    may be split among several. No documents make no file.
    """

    def run(batches):
        enc, part, number = tokenizer(), TaskContext.get().partitionId(), 0
        ids: list[int | None] = []
        buffers: list[bytes] = []
        held = 0
        for batch in slices(batches):
            for doc, data in zip(batch.column("doc_id").to_pylist(), enc.encode_buffers(batch.column("text")), strict=True):
                if held and held + len(data) > file_ids * enc.width:
                    yield pa.RecordBatch.from_arrays([pa.array([pack(ids, buffers, enc.width, part, number)], pa.binary())], ["data"])
                    ids, buffers, held, number = [], [], 0, number + 1
                ids.append(doc)
                buffers.append(data)
                held += len(data)
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([pack(ids, buffers, enc.width, part, number)], pa.binary())], ["data"])

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.asc_nulls_first("doc_id"), F.asc("tie")]
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tie"))
    dealt = src.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text")
    # The text writer puts a line feed, the last byte of the layout, behind each row.
    rows = dealt.mapInArrow(run, "data binary").select(F.expr("cast(substring(data, 1, length(data) - 1) as string)").alias("data"))
    rows.write.option("maxRecordsPerFile", 1).option("compression", "none").option("lineSep", "\n").text(folder)


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32) of the documents in the files of a folder.

    ``start`` is the number of ids of all documents before this one, over all files; ``ids_crc32`` is the unsigned crc32
    of the document's ids as 32-bit little-endian integers. The rows are written to the shared folder, so the files may go afterwards.
    A folder without files gives no rows.
    """

    def run(batches):
        for batch in batches:
            for data in batch.column("content"):
                file = TokenFile(data.as_buffer().to_pybytes())
                ends = file.ends.all()
                wide = memoryview(file.ids.astype("<u4")).cast("B")
                crcs = [zlib.crc32(wide[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                known = pa.array(file.doc_ids.astype(np.int64), mask=np.arange(file.n) < file.nulls)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(file.n, file.part)), pa.array(np.full(file.n, file.number)), known, pa.array(ends[:-1]), pa.array(np.diff(ends)), pa.array(crcs, pa.int64())], ["part", "number", "doc_id", "start", "n_tokens", "ids_crc32"])

    content = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content")
    rows = cut(content.mapInArrow(run, "part long, number long, doc_id long, start long, n_tokens long, ids_crc32 long"))
    files = rows.groupBy("part", "number").agg(F.sum("n_tokens").alias("n"))
    parts = files.groupBy("part").agg(F.sum("n").alias("n"))
    parts = parts.select("part", ordered_sum(F.col("n"), [], [F.col("part")]).alias("of_parts"))
    files = files.select("part", "number", ordered_sum(F.col("n"), [F.col("part")], [F.col("number")]).alias("of_files")).join(parts, "part")
    offsets = files.select("part", "number", (F.col("of_files") + F.col("of_parts")).alias("before"))
    return rows.join(offsets, ["part", "number"]).select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")

"""Benchmark decontamination with a broadcast hash set of normalised test n-grams.

Both sides are lower-cased in A-Z and cut into words of digits, letters and non-ASCII characters. A window is ``window``
consecutive words of a benchmark item; a shorter item, unless it has no words, is one window. Documents are scanned
once: windows of words that all occur in the benchmark are hashed, the hashes are tested against the broadcast set,
and what passes is verified word by word.

Size of the broadcast: the distinct (window, item) rows are counted first. Up to ``MAX_WINDOWS`` they form one block. A
larger benchmark is cut into more blocks by the window's hash; each is a broadcast of its own that a task loads from its
executor's disk, uses on the next ``BUNDLE`` bytes of documents and lets go again, so a worker never holds more than one
and seldom builds them anew.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, folded_words, slices, texts_of

WINDOW = 10
#: (window, item) rows of one broadcast block, about 100 bytes each.
MAX_WINDOWS = 500_000
#: Bytes of text that a task holds for all blocks of a larger benchmark.
BUNDLE = 64 << 20
_FILTER_BITS = 22
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


class NgramSet:
    """Windows of several lengths with the items that hold them."""

    def __init__(self, rows: list[tuple[bytes, str | None]]):
        self.windows: dict[bytes, list[str]] = {}
        for window, item in rows:
            items = self.windows.setdefault(window, [])
            if item is not None and item not in items:
                items.append(item)
        self.ids: dict[bytes, int] = {}
        by_length: dict[int, list[list[int]]] = {}
        for window in self.windows:
            words = window.split(b" ")
            by_length.setdefault(len(words), []).append([self.ids.setdefault(w, len(self.ids) + 1) for w in words])
        draw = np.random.default_rng(1).integers(1, 1 << 64, size=(2, max([1, len(self.ids) + 1, *by_length])), dtype=np.uint64)
        self.of_word, self.of_place = draw[0], draw[1] | np.uint64(1)
        self.tables = {}
        for length, windows in sorted(by_length.items()):
            table = np.zeros(1 << _FILTER_BITS, dtype=bool)
            table[self._hash(np.array(windows).ravel(), np.arange(len(windows)) * length, length)] = True
            self.tables[length] = table

    def _hash(self, ids: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
        total = np.zeros(len(at), dtype=np.uint64)
        for j in range(length):
            total += self.of_word[ids[at + j]] * self.of_place[j]
        return total >> np.uint64(64 - _FILTER_BITS)

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """The (start, length) of each occurring window, and the items that hold them."""
        found, items = [], set()
        ids = np.fromiter(map(self.ids.get, words, repeat(0)), dtype=np.int64, count=len(words))
        unknown = np.cumsum(ids == 0)
        for length, table in self.tables.items():
            if len(words) < length:
                continue
            outside = unknown[length - 1 :].copy()
            outside[1:] -= unknown[: len(words) - length]
            at = np.flatnonzero(outside == 0)
            if not len(at):
                continue
            for i in at[table[self._hash(ids, at, length)]].tolist():
                held = self.windows.get(b" ".join(words[i : i + length]))
                if held is not None:
                    found.append((i, length))
                    items.update(held)
        return found, items


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct rows (window binary, item string) of the items; a null text has no words."""

    def run(batches):
        for batch in slices(batches):
            rows = []
            for item, text in zip(batch.column("item").to_pylist(), texts_of(batch), strict=True):
                words = folded_words(text)
                if words:
                    rows += [(b" ".join(words[i : i + window]), item) for i in range(max(1, len(words) - window + 1))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], ["window", "item"])

    src = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, "window binary, item string").distinct()


def _blocks(benchmark: DataFrame, window: int, id_col: str, text_col: str, max_windows: int):
    rows = cut(benchmark_windows(benchmark, window, id_col, text_col))
    n = -(-rows.count() // max_windows)
    sc = benchmark.sparkSession.sparkContext
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("window"), F.lit(n)) == k).toArrow()
        yield uuid.uuid4().hex, sc.broadcast(list(zip(part["window"].to_pylist(), part["item"].to_pylist(), strict=True)))


_SETS: dict[str, NgramSet] = {}


def _ngrams(name: str, block) -> NgramSet:
    """A worker keeps the set of the last block that it used, and no other."""
    if name not in _SETS:
        _SETS.clear()
        _SETS[name] = NgramSet(block.value)
        block.__dict__.pop("_value", None)
    return _SETS[name]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_windows: int = MAX_WINDOWS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, spans, items.

    ``spans`` are the maximal stretches (start, end) of words inside an occurrence of a window; ``items`` the sorted ids,
    as strings, of the items with occurring windows. A null id of an item is in no list, but its windows mark words. A
    null or empty text has no words; an empty benchmark marks nothing.
    """
    blocks = list(_blocks(benchmark, window, item_col, item_text_col, max_windows))
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch, n_words, spans, items in _scanned(batches, blocks, "text"):
            columns = [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "spans", "items"])

    return src.mapInArrow(run, f"doc_id {kind}, n_words long, spans array<struct<start:long,end:long>>, items array<string>")


def _bundles(batches: Iterable[pa.RecordBatch], blocks: list, text: str) -> Iterator[list[pa.RecordBatch]]:
    """Slices of documents that are scanned together: one if there is one block, else ``BUNDLE`` bytes of text."""
    held, size = [], 0
    for batch in slices(batches, text):
        held.append(batch)
        size += batch.column(text).nbytes
        if len(blocks) < 2 or size >= BUNDLE:
            yield held
            held, size = [], 0
    if held:
        yield held


def _scanned(batches: Iterable[pa.RecordBatch], blocks: list, text: str) -> Iterator[tuple[pa.RecordBatch, list[int], list[list[dict]], list[list[str]]]]:
    """Each slice with the number of words, the spans and the items of its texts."""
    for bundle in _bundles(batches, blocks, text):
        found: list[list[tuple[list, set]]] = [[([], set()) for _ in range(batch.num_rows)] for batch in bundle]
        counts: list[list[int]] = [[] for _ in bundle]
        for k, (name, block) in enumerate(blocks or [("", None)]):
            ngrams = _ngrams(name, block) if block else None
            for batch, places_items, n_words in zip(bundle, found, counts, strict=True):
                for t, (places, items) in zip(texts_of(batch, text), places_items, strict=True):
                    words = folded_words(t)
                    if not k:
                        n_words.append(len(words))
                    if ngrams:
                        more, held = ngrams.scan(words)
                        places += more
                        items |= held
        for batch, places_items, n_words in zip(bundle, found, counts, strict=True):
            yield batch, n_words, _merged(p for p, _ in places_items), [sorted(i) for _, i in places_items]


def _merged(found: Iterable[list[tuple[int, int]]]) -> list[list[dict]]:
    """The maximal stretches of the (start, length) of each text."""
    spans = []
    for places in found:
        merged: list[dict] = []
        for start, length in sorted(places):
            if merged and start <= merged[-1]["end"]:
                merged[-1]["end"] = max(merged[-1]["end"], start + length)
            else:
                merged.append({"start": start, "end": start + length})
        spans.append(merged)
    return spans


def cut_words(text: bytes, spans: list[dict]) -> bytes:
    """The text without the words of the spans and what stands between them."""
    if not spans:
        return text
    places = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for span in spans:
        out.append(text[at : places[span["start"]][0]])
        at = places[span["end"] - 1][1]
    return b"".join([*out, text[at:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, remove: str = "documents", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_windows: int = MAX_WINDOWS) -> DataFrame:
    """``docs`` with its columns, cleaned: ``remove`` is "documents" (any hit removes the row) or "spans" (hit words are
    cut out of the text and the row stays). A null text stays as it is.

    Each row is judged by itself, repeated ones too, and null ids play no part. Items without words, and a benchmark without
    items, mark nothing; no rows give no rows.
    """
    if remove not in ("documents", "spans"):
        raise ValueError('remove must be "documents" or "spans"')
    blocks = list(_blocks(benchmark, window, item_col, item_text_col, max_windows))
    names = docs.columns
    at = names.index(text_col)

    def run(batches):
        for batch, _, spans, _ in _scanned(batches, blocks, text_col):
            if remove == "documents":
                yield batch.filter(pa.array([not s for s in spans], pa.bool_()))
            else:
                texts = batch.column(at).cast(pa.binary()).to_pylist()
                clean = pa.array([t if t is None else cut_words(t, s) for t, s in zip(texts, spans, strict=True)], pa.binary()).cast(batch.schema.field(at).type)
                yield pa.RecordBatch.from_arrays([clean if i == at else c for i, c in enumerate(batch.columns)], names)

    return docs.mapInArrow(run, docs.schema)

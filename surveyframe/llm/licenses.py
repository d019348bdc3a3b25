"""Search for short licence notices, exact and with a few edits.

A text is lower-cased in A-Z and cut into words, which are joined by single spaces. A notice of n characters may differ by
n // ``CHARS_PER_EDIT`` edits. It is cut into one piece more than that, so that any occurrence holds at least one piece
unchanged; the pieces are found exactly, and only around such a seed does the regex library's bounded-error matching
decide, from word to word, and give the span and its number of edits.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import folded_words, map_slices, texts_of

CHARS_PER_EDIT = 10
# Phrases and the labels that they stand for.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Further short notices.
FURTHER = {
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "mozilla public license version 2": "mpl-2",
    "redistribution and use in source and binary forms": "bsd",
    "creative commons attribution": "cc-by",
}


class Notice:
    """One phrase with its seeds and its pattern."""

    def __init__(self, phrase: str, label: str, chars_per_edit: int = CHARS_PER_EDIT):
        self.phrase, self.label = phrase, label
        self.edits = len(phrase) // chars_per_edit
        n = self.edits + 1
        ends = [len(phrase) * i // n for i in range(n + 1)]
        self.seeds = [(phrase[a:b].encode(), a) for a, b in zip(ends, ends[1:], strict=False)]
        self.pattern = regex.compile(rf"(?e)(?<![^ ])(?:{regex.escape(phrase, literal_spaces=True)}){{e<={self.edits}}}(?![^ ])")
        self.exact = f" {phrase} ".encode()

    def places(self, text: bytes) -> list[int]:
        """Offsets of the unchanged phrase in the joined words, which have a space on either side."""
        out, at = [], text.find(self.exact)
        while at >= 0:
            out.append(at)
            at = text.find(self.exact, at + 1)
        return out

    def near(self, text: bytes) -> list[tuple[int, int, int]]:
        """(start, end, edits) of the matches around seeds, as byte offsets."""
        reach = 4 * (self.edits + 1)  # a character has up to four bytes
        windows: list[list[int]] = []
        hits = set()
        for seed, offset in self.seeds:
            at = text.find(seed)
            while at >= 0:
                hits.add(at - offset)
                at = text.find(seed, at + 1)
        for hit in sorted(hits):
            a, b = max(0, hit - reach), min(len(text), hit + len(self.phrase) + 2 * reach)
            if windows and a <= windows[-1][1]:
                windows[-1][1] = max(windows[-1][1], b)
            else:
                windows.append([a, b])
        out = []
        for a, b in windows:
            # Whole words, so that the edges of the window are not taken for edges of words.
            a, b = text.rfind(b" ", 0, a + 1) + 1, (text.find(b" ", b) + 1 or len(text) + 1) - 1
            part = text[a:b].decode("utf-8", "replace")
            at, done = a, 0  # bytes and characters before the last match's end
            for m in self.pattern.finditer(part):
                start = at + len(part[done : m.start()].encode())
                at, done = start + len(m.group().encode()), m.end()
                out.append((start, at, sum(m.fuzzy_counts)))
        return out


@lru_cache(maxsize=8)
def _notices(phrases: tuple[tuple[str, str], ...], chars_per_edit: int) -> list[Notice]:
    return [Notice(p, label, chars_per_edit) for p, label in phrases]


def scan_text(text: bytes, base: list[Notice], notices: list[Notice]) -> dict:
    """What ``license_notices`` returns for one text."""
    words = folded_words(text)
    joined = b" " + b" ".join(words) + b" "
    exact = [(at, n) for n in base for at in n.places(joined)]
    near = [(n, *found) for n in notices for found in n.near(joined)]
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 0x20) if exact or near else np.zeros(0, np.int64)
    before = lambda at: np.searchsorted(spaces, np.array(at, dtype=np.int64)).tolist()  # noqa: E731  spaces before each place
    firsts, lasts = before([start for _, start, _, _ in near]), before([end for _, _, end, _ in near])
    spans = [{"label": n.label, "first_word": first - 1, "last_word": last - 1, "edits": edits, "score": 1 - edits / len(n.phrase)} for (n, _, _, edits), first, last in zip(near, firsts, lasts, strict=True)]
    starts = before([at for at, _ in exact])
    score = max([1.0 if exact else 0.0, *(s["score"] for s in spans)])
    return {
        "n_words": len(words), "n_base": len(exact), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
        "base_labels": ",".join(sorted({n.label for _, n in exact})), "labels": ",".join(sorted({n.label for _, n in exact} | {s["label"] for s in spans})),
        "score": score, "spans": spans,
    }


_SPAN = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int64()), ("score", pa.float64())])
_TYPES = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "spans": pa.list_(_SPAN)}


def license_notices(docs: DataFrame, base: dict[str, str] = BASE, further: dict[str, str] = FURTHER, chars_per_edit: int = CHARS_PER_EDIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    ``n_base`` counts the places where the words of a base phrase stand unchanged, ``first_word`` and ``last_word`` are
    the smallest and largest word at which one starts (null if none). ``labels`` adds those of all notices within their
    edits; ``spans`` has each with its first and last word, edits and score (1 without edits). A null or empty text has
    no words, no labels and a score of 0. Phrases are lower-case words joined by single spaces. Spans of different notices may
    overlap, those of one notice don't; each row is scanned by itself, repeated ones too. No rows give no rows. The work grows with the text.
    """
    both = tuple((base | further).items())
    own = tuple(base.items())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [scan_text(t, _notices(own, chars_per_edit), _notices(both, chars_per_edit)) for t in texts_of(batch)]
        columns = [pa.array([r[k] for r in rows], t) for k, t in _TYPES.items()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *_TYPES])

    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first_word:long,last_word:long,edits:long,score:double>>"
    return map_slices(src, run, schema)

"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece there is exactly one token that ends it in the prefix's encoding: the token t for which the
encoding of what lies before t, followed by t, is valid. A sequence of tokens is valid if every neighbouring pair is what
merging the pair's own bytes gives, so it is enough to test t against the last token stored for the shorter prefix. The
stored last tokens give the encoding of any prefix by walking back, allow appending bytes at the cost of those bytes, and
after an edit only prefixes near it have to be looked at again.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: The usual pattern of byte-level BPE vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces that a worker remembers within a task, and those that it keeps from task to task, the first that it met; pairs
#: that it remembers. They bound memory and change no result.
MEMO = 500_000
KEPT = 100_000
#: Characters of a piece that the memo takes. Longer ones are encoded each time, so the memo is bounded in bytes as well.
LONGEST = 64
PAIRS = 300_000


class Vocabulary:
    """Ranks of byte strings; a rank is also the token's id."""

    def __init__(self, ranks: dict[bytes, int]):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.sizes = {i: len(b) for b, i in ranks.items()}
        #: Finds every token in a text of bytes, taken as characters: (end, (id, length)), longest first for each end.
        self.automaton = ahocorasick.Automaton()
        for token, i in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (i, len(token)))
        self.automaton.make_automaton()
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._pairs: dict[int, bool] = {}
        self._wholes: dict[int, bool] = {}

    def merge(self, data: bytes, stop: int = 1) -> list[int]:
        """Merges the pair of lowest rank, the leftmost of equals, until none or only ``stop`` parts are left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks = self.ranks
        while len(parts) > stop:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens that are merged last to make this one; None for one byte, and for a token that merging its
        own bytes doesn't give."""
        if token not in self._halves:
            data = self.bytes_of[token]
            two = self.merge(data, 2) if len(data) > 1 else []
            self._halves[token] = tuple(two) if len(two) == 2 else None
        return self._halves[token]

    def whole(self, token: int) -> bool:
        """Whether merging the token's own bytes gives the token."""
        return len(self.bytes_of[token]) == 1 or self.halves(token) is not None

    def follows(self, key: int) -> bool:
        """Whether two tokens, first << 32 | second, may stand next to each other: merging their bytes gives just them."""
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) >= PAIRS:
                self._pairs.clear()
            known = self._pairs[key] = self._stay_apart(key >> 32, key & 0xFFFFFFFF)
        return known

    def _stay_apart(self, left: int, right: int) -> bool:
        """Goes back through the merges on both sides, latest first. What touches the boundary at any time must not
        have a merge across it that would have come before the next merge on either side."""
        if not (self.whole(left) and self.whole(right)):
            return False
        bytes_of, ranks = self.bytes_of, self.ranks
        # The merge that comes next in time, as it would be compared: by rank, then from the left.
        later = (len(ranks) + 1, 0)
        while True:
            across = ranks.get(bytes_of[left] + bytes_of[right])
            if across is not None and (across, 1) < later:
                return False
            a = self.halves(left) if len(bytes_of[left]) > 1 else None
            b = self.halves(right) if len(bytes_of[right]) > 1 else None
            if a is None and b is None:
                return True
            if b is None or (a is not None and left > right):
                later, left = (left, 0), a[1]
            else:
                later, right = (right, 2), b[0]


@lru_cache(maxsize=4)
def load_ranks(path: str) -> Vocabulary:
    """Reads a file of lines ``base64 rank``."""
    with open(path, "rb") as f:
        return Vocabulary({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})


def extend(vocabulary: Vocabulary, data: bytes | bytearray, last: list[int]) -> None:
    """Adds to ``last`` the last tokens of the prefixes of ``data`` that it doesn't have yet."""
    follows, pairs, wholes = vocabulary.follows, vocabulary._pairs, vocabulary._wholes
    done = len(last)
    base = max(0, done - vocabulary.longest)
    for end, (token, size) in vocabulary.automaton.iter(data[base:].decode("latin-1")):
        end += base
        if end < done:
            continue
        if end >= size:
            key = last[end - size] << 32 | token
            fits = pairs.get(key)
            if fits is None:
                fits = follows(key)
        else:
            fits = wholes.get(token)
            if fits is None:
                fits = wholes[token] = vocabulary.whole(token)
        if fits:
            last.append(token)
            done += 1


def walk_back(vocabulary: Vocabulary, last: list[int], at: int) -> list[int]:
    """The encoding of the prefix of ``at`` bytes, from its last token to its first."""
    sizes, out = vocabulary.sizes, []
    while at:
        token = last[at - 1]
        out.append(token)
        at -= sizes[token]
    return out[::-1]


class Prefixes:
    """The last token of every prefix of a byte string: ``last[i]`` belongs to the prefix of i + 1 bytes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary = vocabulary
        self.data = bytearray()
        self.last: list[int] = []
        self.append(data)

    def append(self, data: bytes) -> None:
        """Exact: earlier prefixes keep their tokens."""
        self.data += data
        extend(self.vocabulary, self.data, self.last)

    def edit(self, start: int, end: int, new: bytes) -> int:
        """Replaces bytes start..end; returns how many prefixes were looked at again.

        Behind the edit, prefixes are found anew until the tokens of as many in a row as the longest token has bytes
        are what they were; from there on nothing can differ.
        """
        tail, old = bytes(self.data[end:]), self.last[end:]
        del self.data[start:], self.last[start:]
        self.append(new)
        same = 0
        for i, b in enumerate(tail):
            self.append(bytes([b]))
            same = same + 1 if self.last[-1] == old[i] and i >= self.vocabulary.longest else 0
            if same >= self.vocabulary.longest:
                self.data += tail[i + 1 :]
                self.last += old[i + 1 :]
                return len(new) + i + 1
        return len(new) + len(tail)

    def tokens(self, end: int | None = None) -> list[int]:
        """The encoding of the prefix of ``end`` bytes, of all by default."""
        return walk_back(self.vocabulary, self.last, len(self.data) if end is None else end)


def encode_piece(vocabulary: Vocabulary, piece: bytes) -> list[int]:
    """The ids of one match of the pattern. A piece that is in the vocabulary is that token, however it would merge."""
    if piece in vocabulary.ranks:
        return [vocabulary.ranks[piece]]
    last: list[int] = []
    extend(vocabulary, piece, last)
    return walk_back(vocabulary, last, len(piece))


class Encoder:
    """Encodes texts piece by piece, with a memo of pieces, and decodes ids."""

    def __init__(self, path: str, pattern: str = PATTERN):
        self.vocabulary = load_ranks(path)
        self.pieces = regex.compile(pattern).findall
        self._kept: dict[str, bytes] = {}
        self._memo: dict[str, bytes] = {}

    def rest(self) -> None:
        """Lets go of all pieces but those that are kept, as between tasks."""
        self._memo = dict(self._kept)

    def encode_buffer(self, text: str) -> bytes:
        """The ids as native 32-bit integers."""
        memo, found = self._memo, self.pieces(text)
        try:
            return b"".join([memo[p] for p in found])
        except KeyError:
            buffers = []
            for p in found:
                if (ids := memo.get(p)) is None:
                    ids = np.array(encode_piece(self.vocabulary, p.encode()), dtype=np.int32).tobytes()
                    if len(p) <= LONGEST:
                        if len(memo) > MEMO:
                            self.rest()
                            memo = self._memo
                        memo[p] = ids
                        if len(self._kept) < KEPT:
                            self._kept[p] = ids
                buffers.append(ids)
            return b"".join(buffers)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_buffer(text), dtype=np.int32).tolist()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, ids))


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str = PATTERN) -> Encoder:
    """One for each Python worker."""
    return Encoder(path, pattern)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", pattern: str = PATTERN) -> DataFrame:
    """Rows (doc_id, ids array<int>), one for each row of ``docs``. A null or empty text has no ids."""

    def make(enc, buffers):
        return [_lists(buffers)]

    return _encoded(docs, path, id_col, text_col, pattern, make, ["ids"], "ids array<int>")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", pattern: str = PATTERN, with_ids: bool = True) -> DataFrame:
    """Rows (doc_id, ids, n_tokens, ids_sha256, decoded_sha256): encodes each text, then decodes its ids, in one pass.

    ``ids_sha256`` is of the decimal ids, joined by spaces. Without ``with_ids`` the ids stay where they were made.
    A null text is an empty one and has no ids. Each row is encoded by itself, repeated ones too; null ids are kept and no rows give no rows.
    """

    def make(enc, buffers):
        rows = []
        digits = token_digits(path)
        for b in buffers:
            ids = np.frombuffer(b, dtype=np.int32).tolist()
            rows.append((len(ids), hashlib.sha256(b" ".join(map(digits.__getitem__, ids))).hexdigest(), hashlib.sha256(enc.decode(ids)).hexdigest()))
        columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string()))]
        return [_lists(buffers), *columns] if with_ids else columns

    names = ["n_tokens", "ids_sha256", "decoded_sha256"]
    kinds = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _encoded(docs, path, id_col, text_col, pattern, make, ["ids"] * with_ids + names, "ids array<int>, " * with_ids + kinds)


def _lists(buffers: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(b) // 4 for b in buffers)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(buffers), dtype=np.int32)))


def _encoded(docs: DataFrame, path: str, id_col: str, text_col: str, pattern: str, make, names: list[str], kinds: str) -> DataFrame:
    def run(batches):
        enc = encoder(path, pattern)
        enc.rest()
        for batch in slices(batches):
            buffers = [enc.encode_buffer(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *make(enc, buffers)], ["doc_id", *names])
        enc.rest()

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, f"doc_id long, {kinds}")


def decode_documents(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """Rows (doc_id, ids, n_tokens, ids_sha256, decoded_sha256, decoded binary) of rows (doc_id, ids); null ids are none."""

    def run(batches):
        enc = encoder(path)
        digits = token_digits(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                out = []
                for ids in part.column("ids"):
                    ids = ids.values.to_numpy(zero_copy_only=False).tolist() if ids.is_valid else []
                    data = enc.decode(ids)
                    out.append((len(ids), hashlib.sha256(b" ".join(map(digits.__getitem__, ids))).hexdigest(), data, hashlib.sha256(data).hexdigest()))
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.binary(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], ["doc_id", "ids", "n_tokens", "ids_sha256", "decoded", "decoded_sha256"])

    return encoded.select("doc_id", F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, ids_sha256 string, decoded binary, decoded_sha256 string")


@lru_cache(maxsize=4)
def token_digits(path: str) -> list[bytes]:
    """The decimal form of every id."""
    return [b"%d" % i for i in range(max(load_ranks(path).bytes_of) + 1)]

"""Encoding texts by their distinct chunks, for tokenizers that never join a space to what stands before it.

A chunk runs from one certain boundary to the next: a space (U+0020) behind a character that is no white space. No token of
these tokenizers holds such a place inside, so a text's ids are those of its chunks one after the other, and each distinct
chunk of some texts is encoded once. Distinct chunks of one space and no other are put together and encoded in one
call; there the tokens that begin with a space show where each begins.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters that are encoded in one call, about.
CALL = 1 << 16
#: What may count as white space, by any definition, and U+2581, which some tokenizers write for a space.
_UNSURE = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x2581, 0x3000, 0xFEFF]))


@dataclass
class Chunks:
    """``plain``: distinct chunks without the one space that they begin with; ``odd``: the other distinct chunks, whole.
    ``codes``: numbers of the chunks, text after text, plain ones first; ``offsets``: where each text's codes begin."""

    plain: np.ndarray
    odd: list[str]
    codes: np.ndarray
    offsets: np.ndarray


def split_chunks(texts: pa.Array, lead: bool = False) -> Chunks:
    """The chunks of each text, null as empty. With ``lead`` a space is put in front of every text."""
    split = pc.split_pattern(pc.fill_null(texts.cast(pa.large_string()), ""), " ")
    flat = split.flatten()
    offsets = (split.offsets.to_numpy() - split.offsets[0].as_py()).astype(np.int64)
    coded = flat.dictionary_encode()
    words, codes = coded.dictionary.to_numpy(zero_copy_only=False), coded.indices.to_numpy().astype(np.int64)
    last = pc.utf8_slice_codeunits(coded.dictionary, -1)
    sure = ~pc.is_in(last, pa.array([*_UNSURE, ""], last.type)).to_numpy(zero_copy_only=False).astype(bool)
    begins = np.ones(len(codes), bool)
    begins[1:] = sure[codes[:-1]]
    begins[offsets[:-1]] = True
    starts = np.flatnonzero(begins)
    sizes = np.diff(np.append(starts, len(codes)))
    plain = sure & ~pc.match_substring(coded.dictionary, "\u2581").to_numpy(zero_copy_only=False).astype(bool)  # some tokenizers take that for a space
    alone = (sizes == 1) & plain[codes[starts]]
    if not lead:
        first = np.zeros(len(codes), bool)
        first[offsets[:-1]] = True
        alone &= ~first[starts]
    out = codes[starts]
    odd: dict[str, int] = {}
    for at in np.flatnonzero(~alone).tolist():
        a = int(starts[at])
        chunk = " ".join(words[codes[a : a + int(sizes[at])]])
        chunk = chunk if not lead and first[a] else " " + chunk
        out[at] = len(words) + odd.setdefault(chunk, len(odd))
    used = np.zeros(len(words) + len(odd), bool)  # words that stand in odd chunks only aren't encoded
    used[out] = True
    return Chunks(words[used[: len(words)]], list(odd), (np.cumsum(used) - 1)[out], np.searchsorted(starts, offsets))


def encode_chunks(chunks: Chunks, call: Callable[[str], np.ndarray], begins: np.ndarray, size: int = CALL) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all distinct chunks, one after the other; where each begins, with the end of the last).

    ``call`` encodes a text, of about ``size`` characters at once; ``begins``: whether a token begins with a space.
    """
    parts, sizes, at = [], [], 0
    lengths = np.cumsum(np.fromiter(map(len, chunks.plain), np.int64, len(chunks.plain)) + 1)
    while at < len(chunks.plain):
        end = max(at + 1, int(np.searchsorted(lengths, (lengths[at - 1] if at else 0) + size, side="right")))
        ids = call(" " + " ".join(chunks.plain[at:end]))
        starts = np.flatnonzero(begins[ids])
        if len(starts) != end - at or starts[0]:
            raise ValueError("tokens don't show where chunks begin")
        parts.append(ids)
        sizes.append(np.diff(np.append(starts, len(ids))))
        at = end
    for chunk in chunks.odd:
        parts.append(call(chunk))
        sizes.append([len(parts[-1])])
    empty = np.zeros(0, np.int64)
    return np.concatenate([*parts, empty.astype(np.uint32)]).astype(np.uint32), np.concatenate(([0], np.cumsum(np.concatenate([*sizes, empty]))))


def expand(values: np.ndarray, starts: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The stretches ``starts[c] .. starts[c + 1]`` of ``values`` for each code, put together."""
    return pa.LargeListArray.from_arrays(pa.array(starts), pa.array(values)).take(pa.array(codes)).flatten().to_numpy()


def _byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies show bytes: printable ones of Latin-1 as they are, the others from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteLevelTokenizer:
    """A byte-level BPE tokenizer of the tokenizers library, read from its file.

    The file's own merges are run by tiktoken, for chunks at a fraction of the time, if the file is one for which both are
    the same: no normalizer, the usual pattern, merges numbered as their tokens. Any other file is left to the library.
    ``special``: whether added tokens inside a text are found.
    """

    def __init__(self, path: str, special: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = _byte_alphabet()
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in added}
        if spec["pre_tokenizer"] is None or spec["pre_tokenizer"]["type"] != "ByteLevel" or any(c not in alphabet for t in vocab for c in t):
            raise ValueError("not a byte-level tokenizer")
        self.bytes_of = [b""] * (max([*vocab.values(), *added.values()]) + 1)
        for t, i in vocab.items():
            self.bytes_of[i] = bytes(alphabet[c] for c in t)
        for t, i in added.items():
            self.bytes_of[i] = t.encode()
        self.size = len(self.bytes_of)
        self.begins = np.array([b[:1] == b" " for b in self.bytes_of])
        inner = re.compile(f"[^{_UNSURE}] ")
        if any(b" " in b and inner.search(b.decode("utf-8", "replace")) for b in self.bytes_of):
            raise ValueError("a token holds a space behind another character")
        if self._same_as_ranks(spec, vocab):
            import tiktoken

            from .bpe import PATTERN

            ranks = {self.bytes_of[i]: i for i in vocab.values()}
            encoding = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)
            found = set(added) if special else set()
            self.call = lambda text: encoding.encode_to_numpy(text, allowed_special=found, disallowed_special=())
        else:
            library = Tokenizer.from_file(path)
            library.encode_special_tokens = not special
            self.call = lambda text: np.array(library.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    @staticmethod
    def _same_as_ranks(spec: dict, vocab: dict[str, int]) -> bool:
        model, pre = spec["model"], spec["pre_tokenizer"]
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
        plain &= spec["normalizer"] is None and not pre["add_prefix_space"] and pre["use_regex"] and model["type"] == "BPE"
        plain &= not any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip"))
        made = [vocab.get("".join(m if isinstance(m, list) else m.split(" ")), -1) for m in model["merges"]]
        return plain and len(made) + 256 == len(vocab) and all(a < b for a, b in zip(made, made[1:])) and (not made or made[0] >= 256)

    def encode(self, column: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, how many each text has), null as empty; behind each text comes ``end_id``, if there is one."""
        chunks = split_chunks(column)
        values, starts = encode_chunks(chunks, self.call, self.begins)
        codes, offsets = chunks.codes, chunks.offsets
        if end_id is not None:  # one more chunk, behind each text
            values, starts = np.append(values, np.uint32(end_id)), np.append(starts, starts[-1] + 1)
            codes = np.insert(codes, offsets[1:], len(starts) - 2)
            offsets = offsets + np.arange(len(offsets))
        ends = np.concatenate(([0], np.cumsum(np.diff(starts)[codes])))[offsets]
        return expand(values, starts, codes), np.diff(ends)

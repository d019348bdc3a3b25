"""Token-set similarity of short texts.

``token_set_score`` is a native expression (0 to 100, a double). With A and B the sets of white-space separated tokens,
I = A and B, X = A without B, Y = B without A: 0 if either set is empty, 100 if they share a token and one holds the other;
else the best of the indel similarities of I+X and I+Y, and of I with either, on the sorted, space-joined tokens.

``legacy_token_set_score`` is the integer score (0 to 100) by longest matching blocks, in Arrow batches: its block search
has no native form.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from .text import WS, let

#: Up to so many characters the longest common subsequence fits into the bits of one number.
_BITS = 60


def lcs_length(x: Column, y: Column) -> Column:
    """Length of the longest common subsequence of the characters of two texts.

    Up to 60 characters in x, one number holds a row of the table: a cleared bit is a step. Longer texts keep the row as an array.
    """
    one = F.lit(1).cast("long")

    def short(p: Column) -> Column:
        full = F.call_function("shiftleft", one, p["n"]) - 1

        def step(v: Column, c: Column) -> Column:
            at = F.aggregate(F.sequence(F.lit(0), p["n"] - 1), F.lit(0).cast("long"), lambda m, i: F.when(F.get(p["xs"], i) == c, m.bitwiseOR(F.call_function("shiftleft", one, i))).otherwise(m))
            return let(v.bitwiseAND(at), lambda hit: (v + hit).bitwiseOR(v - hit).bitwiseAND(full))

        return p["n"] - F.bit_count(F.aggregate(p["ys"], full, step))

    def long(p: Column) -> Column:
        def row(above: Column, c: Column) -> Column:
            def cell(acc: Column, j: Column) -> Column:
                return F.concat(acc, F.array(F.when(F.get(p["ys"], j) == c, F.get(above, j) + 1).otherwise(F.greatest(F.get(acc, j), F.get(above, j + 1)))))

            return F.aggregate(F.sequence(F.lit(0), F.size(p["ys"]) - 1), F.array(F.lit(0)), cell)

        return F.element_at(F.aggregate(p["xs"], F.array_repeat(F.lit(0), F.size(p["ys"]) + 1), row), -1)

    parts = F.struct(F.split(x, "").alias("xs"), F.split(y, "").alias("ys"), F.length(x).alias("n"))
    found = let(parts, lambda p: F.when(p["n"] <= _BITS, short(p)).otherwise(long(p)))
    return F.when((F.length(x) == 0) | (F.length(y) == 0), 0).otherwise(found)


def tokens(x: Column) -> Column:
    """The distinct tokens of a text, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.split(F.coalesce(x, F.lit("")), f"{WS}+"), lambda t: t != "")))


def token_parts(a: Column, b: Column) -> tuple[Column, Column, Column]:
    """(shared, only in a, only in b), each joined by spaces; ``a`` and ``b`` are sorted distinct tokens."""
    return tuple(F.array_join(x, " ") for x in (F.array_intersect(a, b), F.array_except(a, b), F.array_except(b, a)))


def score_bound(shared: Column, x: Column, y: Column) -> Column:
    """At least the score, without a common subsequence: the texts' lengths bound what they can share."""
    s, nx, ny, g = F.length(shared), F.length(x), F.length(y), (F.length(shared) > 0).cast("int")
    return F.when((s > 0) & ((nx == 0) | (ny == 0)), 100.0).otherwise(F.greatest(100 - 100.0 * F.abs(nx - ny) / F.greatest(2 * (s + g) + nx + ny, F.lit(1)), _partial(s, g, nx), _partial(s, g, ny)))


def _partial(s: Column, g: Column, n: Column) -> Column:
    return F.when(s == 0, 0.0).otherwise(100 - 100.0 * (g + n) / F.greatest(2 * s + g + n, F.lit(1)))


def parts_score(shared: Column, x: Column, y: Column) -> Column:
    """The score of what ``token_parts`` gives."""
    s, nx, ny, g = F.length(shared), F.length(x), F.length(y), (F.length(shared) > 0).cast("int")
    indel = nx + ny - 2 * lcs_length(x, y)
    whole = 100 - 100.0 * indel / F.greatest(2 * (s + g) + nx + ny, F.lit(1))
    both_empty = ((s == 0) & (nx == 0)) | ((s == 0) & (ny == 0))
    return F.when(both_empty, 0.0).when((s > 0) & ((nx == 0) | (ny == 0)), 100.0).otherwise(F.greatest(whole, _partial(s, g, nx), _partial(s, g, ny)))


def tokens_score(a: Column, b: Column) -> Column:
    """The score of two arrays of sorted distinct tokens."""
    shared, x, y = token_parts(a, b)
    return let(F.struct(shared.alias("s"), x.alias("x"), y.alias("y")), lambda p: parts_score(p["s"], p["x"], p["y"]))


def tokens_bound(a: Column, b: Column) -> Column:
    """At least that score, at a small part of its cost."""
    shared, x, y = token_parts(a, b)
    return let(F.struct(shared.alias("s"), x.alias("x"), y.alias("y")), lambda p: score_bound(p["s"], p["x"], p["y"]))


def token_set_score(a: Column, b: Column) -> Column:
    """Similarity of two texts, 0 to 100."""
    return let(F.struct(tokens(a).alias("a"), tokens(b).alias("b")), lambda p: tokens_score(p["a"], p["b"]))


# --- The integer score.


def _prepared(text: str | None) -> str:
    plain = "".join(c for c in text or "" if ord(c) < 128)
    return re.sub(r"\W", " ", plain).lower().strip()


def _ratio(a: str, b: str) -> int:
    if not a or not b:
        return 0
    return 100 if a == b else int(round(100 * SequenceMatcher(None, a, b).ratio()))


def legacy_score(a: str | None, b: str | None) -> int:
    """Only ASCII counts; texts without any give 0. Not symmetric."""
    a, b = _prepared(a), _prepared(b)
    if not a or not b:
        return 0
    left, right = set(a.split()), set(b.split())
    shared = " ".join(sorted(left & right))
    one = f"{shared} {' '.join(sorted(left - right))}".strip()
    two = f"{shared} {' '.join(sorted(right - left))}".strip()
    return max(_ratio(shared, one), _ratio(shared, two), _ratio(one, two))


@F.pandas_udf(IntegerType())
def legacy_token_set_score(a: pd.Series, b: pd.Series) -> pd.Series:
    known: dict[tuple, int] = {}
    out = []
    for pair in zip(a, b, strict=True):
        if pair not in known:
            known[pair] = legacy_score(*pair)
        out.append(known[pair])
    return pd.Series(out, dtype="int32")


def legacy_tokens(x: Column | str) -> Column:
    """The distinct tokens that the integer score compares, sorted."""
    ascii_only = F.regexp_replace(F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit("")), r"[^\x00-\x7F]", "")
    return tokens(F.lower(F.regexp_replace(ascii_only, r"[^A-Za-z0-9_]", " ")))


def legacy_tokens_score(a: Column, b: Column) -> Column:
    """The integer score of two arrays of such tokens."""
    return legacy_token_set_score(F.array_join(a, " "), F.array_join(b, " "))


def legacy_tokens_bound(a: Column, b: Column) -> Column:
    """At least that score: matching blocks are common subsequences, and rounding adds half a point at most."""
    return tokens_bound(a, b) + 0.5


def composite_score(label: Column, prompt: Column, seed_label: Column, seed_prompt: Column) -> Column:
    """0 unless both labels are empty or equal, else the integer score of the prompts."""
    return F.when(F.coalesce(label, F.lit("")) == F.coalesce(seed_label, F.lit("")), legacy_token_set_score(prompt, seed_prompt)).otherwise(0)

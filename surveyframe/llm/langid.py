"""Language identification by rank-order profiles.

A profile lists the most frequent n-grams of letters (1 to 3, runs of other characters as one space) by falling count. A
document's own profile is compared to each language's: every n-gram adds how far it is out of place, or the full length
of a profile if the language lacks it. The smallest sum wins.

Profiles are learned from a bounded sample of labelled rows: of each language about ``max_docs`` rows, by a hash of the id.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_slices

LENGTH = 300
MAX_DOCS = 4_000
#: Profiles are sent to every task; more languages than this aren't a set of languages.
MAX_LANGUAGES = 10_000
SEED = 42
UNKNOWN = "und"
_SPACE = 32
#: Characters turned into n-grams at a time.
BLOCK = 1 << 20


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of the letters of a text, as numbers in rising order, and their counts; none without letters."""
    text = text.lower()
    parts, carry = [], np.array([_SPACE])
    for at in range(0, len(text), BLOCK):
        points = np.frombuffer(text[at : at + BLOCK].encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        points = np.where(_letters()[points], points, _SPACE)
        if at + BLOCK >= len(text):
            points = np.append(points, _SPACE)
        points = np.concatenate((carry, points))
        points = points[np.append(True, (points[1:] != _SPACE) | (points[:-1] != _SPACE))]
        parts.append(_new_grams(points, len(carry)))
        carry = points[-2:]
    grams = np.concatenate(parts) if parts else np.empty(0, np.int64)
    return np.unique(grams, return_counts=True) if len(grams) else (grams, grams)


def _new_grams(points: np.ndarray, seen: int) -> np.ndarray:
    """The n-grams that end behind the first ``seen`` characters."""
    one = points[seen:][points[seen:] != _SPACE]
    two = (points[:-1] << 21 | points[1:])[seen - 1 :]
    three = (points[:-2] << 42 | points[1:-1] << 21 | points[2:])[max(0, seen - 2) :]
    return np.concatenate([one, two, three[(three >> 21 & 0x1FFFFF) != _SPACE]])


def gram_text(gram: int) -> str:
    return "".join(chr(gram >> s & 0x1FFFFF) for s in (42, 21, 0) if gram >> s & 0x1FFFFF)


def top_grams(grams: np.ndarray, counts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """The most frequent ones; of equal counts the smaller comes first."""
    return grams[np.argsort(-counts, kind="stable")[:length]]


class Profiles:
    """The profiles of several languages as one table of ranks."""

    def __init__(self, ranked: dict[str, list[int]], length: int = LENGTH):
        self.languages, self.length = sorted(ranked), length
        self.grams = np.unique(np.array([g for p in ranked.values() for g in p], dtype=np.int64))
        self.ranks = np.full((len(self.grams), len(self.languages)), -1, dtype=np.int32)
        for k, language in enumerate(self.languages):
            self.ranks[np.searchsorted(self.grams, ranked[language]), k] = np.arange(len(ranked[language]))

    def distances(self, own: np.ndarray) -> np.ndarray:
        """Out-of-place distance of a document's ranked n-grams to each language."""
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        known = self.grams[at] == own
        ranks = self.ranks[at[known]]
        away = np.where(ranks >= 0, np.abs(ranks - np.flatnonzero(known)[:, None]), self.length)
        return away.sum(axis=0) + self.length * int((~known).sum())

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score): the score falls from 1 for the very profile to 0 if no n-gram is known. Of languages at
        equal distance the first by name wins. No letters, or no profiles: ("und", 0)."""
        own = top_grams(*gram_counts(text or ""), self.length)
        if not len(own) or not self.languages:
            return UNKNOWN, 0.0
        found = self.distances(own)
        best = int(np.argmin(found))
        return self.languages[best], float(1 - found[best] / (self.length * len(own)))


def held_out(id_col: Column) -> Column:
    """True for a fifth of all ids: crc32 of the id's decimal digits is divisible by five. A null id counts as ''."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = MAX_DOCS, length: int = LENGTH) -> Profiles:
    """Profiles from the rows with a language and a text. Of a language with more rows than ``max_docs`` those are taken
    whose seeded hash falls into that share of its range."""
    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.lit(SEED), F.col(id_col)).alias("order"))
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not sizes:
        return Profiles({}, length)
    share = docs.sparkSession.createDataFrame([(k, min(1.0, max_docs / n)) for k, n in sizes.items()], "lang string, share double")
    sample = rows.join(F.broadcast(share), "lang").where((F.shiftrightunsigned("order", 11) / F.lit(float(1 << 53))) < F.col("share"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        by: dict[str, list] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            by.setdefault(lang, []).append(gram_counts(text or ""))
        out = {}
        for lang, counted in by.items():
            grams, inverse = np.unique(np.concatenate([g for g, _ in counted]), return_inverse=True)
            out[lang] = grams, np.bincount(inverse, weights=np.concatenate([c for _, c in counted]), minlength=len(grams)).astype(np.int64)
        langs = [k for k, (g, _) in out.items() for _ in range(len(g))]
        empty = [np.empty(0, np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate([g for g, _ in out.values()] or empty)), pa.array(np.concatenate([c for _, c in out.values()] or empty))], ["lang", "gram", "n"])

    counts = map_slices(sample.select("lang", "text"), run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    best = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= length)
    ranked: dict[str, list[int]] = {}
    for r in sorted(best.select("lang", "rank", "gram").collect()):
        ranked.setdefault(r.lang, []).append(r.gram)
    return Profiles(ranked, length)


def identify(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, lang_pred, score. Nothing but the text decides; whole texts count.

    A null text, or one without letters, is UNKNOWN with a score of 0. Repeated rows get equal predictions, null ids are kept, and no
    rows give no rows. Of languages at equal distance the first by name wins.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [profiles.predict(t) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    return map_slices(src, run, f"doc_id {kind}, lang_pred string, score double")

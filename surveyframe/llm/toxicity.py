"""A classifier chain for toxicity.

Categories are predicted one after the other by linear models. Each later model also gets the log-odds of the earlier
categories. While training, those come from models that haven't seen the row (out-of-fold), so that a later model learns
how far the earlier predictions can be trusted.

A text's features are its words and, for inflected or compounded insults, the first ``PREFIX`` bytes of its longer words:
that one begins so, two or more do, and at least one in ``RARE`` does. A category's model weighs the features that tell
most by a chi-squared test over its own training rows: those of the other folds, while out-of-fold log-odds are made.

Training takes a bounded sample of labelled rows: at most ``max_rows``, the smallest by a seeded hash of the id, of texts
of at most ``max_bytes``. Only their counts and selected features reach the driver. The prediction runs over whole texts.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, folded_words, map_slices, texts_of

MAX_ROWS = 12_000
MAX_BYTES = 65_536
PREFIX = 5
RARE = 200
#: Features that a category's model may weigh, and how many rows must hold one.
FEATURES = 400
LEAST_ROWS = 5
#: The chi-squared statistic that a feature must reach.
LEAST_STATISTIC = 20
FOLDS = 5
#: Rows of a step; epochs, and steps that a small sample takes at least.
BATCH = 64
EPOCHS = 15
STEPS = 1_000
SEED = 42


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def features(words: list[bytes], known: frozenset[bytes] | None = None) -> set[bytes]:
    """The features of a text, or those of them that are ``known``. Prefixes are marked by a first byte that no word has."""
    if known is None:
        held, starts = set(words), Counter(w[:PREFIX] for w in words if len(w) > PREFIX)
    else:
        held = set(known.intersection(words))
        mine = {k[1:] for k in known if k[0] < 4}
        longer = [w[:PREFIX] for w in words if len(w) > PREFIX] if mine else []
        starts = Counter(p for p in longer if p in mine) if not mine.isdisjoint(longer) else {}
    for start, n in starts.items():
        found = (b"\1" + start, *([b"\2" + start] if n > 1 else []), *([b"\3" + start] if n * RARE >= len(words) else []))
        held.update(found if known is None else known.intersection(found))
    return held


@dataclass
class Link:
    """One model of the chain: the weights of the features that a text has, the bias, and weights of earlier log-odds."""

    category: str
    weights: dict[bytes, float]
    bias: float
    earlier: list[float]

    def log_odds(self, held: set[bytes], before: list[float]) -> float:
        own = sorted(self.weights[f] for f in held if f in self.weights)
        return float(np.clip(self.bias + sum(own) + sum(a * b for a, b in zip(self.earlier, before, strict=True)), -30, 30))


def fit_linear(rows: list[set[bytes]], labels: np.ndarray, extra: np.ndarray, category: str, chosen: list[bytes]) -> Link:
    """A logistic model by AdaGrad over small batches; the rarer class counts as the root of the ratio more."""
    vocabulary = {w: i for i, w in enumerate(chosen)}
    k, n_extra = len(vocabulary), extra.shape[1]
    rate = (labels.sum() + 0.5) / (len(labels) + 1)
    if not len(labels) or labels.min() == labels.max():
        return Link(category, {}, float(np.log(rate / (1 - rate))), [0.0] * n_extra)
    x = np.zeros((len(rows), k + n_extra + 1), dtype=np.float32)
    for i, held in enumerate(rows):
        x[i, [vocabulary[w] for w in held if w in vocabulary]] = 1
    x[:, k : k + n_extra] = extra / 4  # of the size of the others
    x[:, -1] = 1
    each = np.where(labels > 0, max(1, (1 - rate) / rate) ** 0.5, max(1, rate / (1 - rate)) ** 0.5)
    weight = np.zeros(x.shape[1])
    weight[-1] = np.log(rate / (1 - rate))
    squares, rng = np.full(x.shape[1], 1e-2), np.random.default_rng(SEED)
    for _ in range(max(EPOCHS, -(-STEPS * BATCH // len(rows)))):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            part = order[at : at + BATCH]
            gradient = x[part].T @ ((_sigmoid(x[part] @ weight) - labels[part]) * each[part]) / len(part) + 1e-5 * weight
            squares += gradient**2
            weight -= 0.3 * gradient / np.sqrt(squares)
    return Link(category, {w: float(weight[i]) for w, i in vocabulary.items()}, float(weight[-1]), [float(w) / 4 for w in weight[k : k + n_extra]])


def fit_chain(rows: list[set[bytes]], labels: dict[str, np.ndarray], folds: np.ndarray, chosen: dict[str, list[list[bytes]]]) -> tuple[list[Link], np.ndarray]:
    """The chain, and the out-of-fold log-odds of its links. ``folds`` has 0 to FOLDS - 1 for each row; ``chosen`` a
    category's features for the model without each fold, then for that of all rows."""
    chain, extra = [], np.zeros((len(rows), 0))
    for category, y in labels.items():
        chain.append(fit_linear(rows, y, extra, category, chosen[category][FOLDS]))
        out = np.zeros(len(rows))
        for fold in range(FOLDS):
            inside, outside = np.flatnonzero(folds == fold), np.flatnonzero(folds != fold)
            model = fit_linear([rows[i] for i in outside], y[outside], extra[outside], category, chosen[category][fold])
            for i in inside:
                out[i] = model.log_odds(rows[i], list(extra[i]))
        extra = np.column_stack([extra, out])
    return chain, extra


def _telling(counts: DataFrame, totals: dict[tuple[str, int], tuple[int, int]]) -> dict[tuple[str, int], list[bytes]]:
    """For each (label column, fold) of ``totals`` the features with the largest chi-squared statistic over the rows without
    that fold (FOLDS: over all rows), ties by the feature. ``totals``: how many rows those are, and how many have the label."""

    def statistic(y: str, fold: int, n: int, n1: int) -> Column:
        without = lambda c: (F.col(f"{c}_all") - (F.col(f"{c}_{fold}") if fold < FOLDS else 0)).cast("double")
        held, a = without("n"), without(y)
        off = a * (n - n1 - held + a) - (held - a) * (n1 - a)
        value = n * off * off / F.greatest(held * (n - held) * float(n1) * float(n - n1), F.lit(1.0))
        return F.struct(F.lit(y).alias("y"), F.lit(fold).alias("fold"), F.when(held >= LEAST_ROWS, value).alias("statistic"))

    asked = [statistic(y, fold, n, n1) for (y, fold), (n, n1) in totals.items() if 0 < n1 < n]
    found: dict[tuple[str, int], list[bytes]] = {key: [] for key in totals}
    if asked:
        scored = counts.where(F.col("n_all") >= LEAST_ROWS).select("feature", F.explode(F.array(*asked)).alias("s")).select("feature", "s.*").where(F.col("statistic") >= LEAST_STATISTIC)
        order = Window.partitionBy("y", "fold").orderBy(F.desc("statistic"), "feature")
        for r in scored.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= FEATURES).orderBy("nth").collect():  # FEATURES of each at most
            found[r.y, r.fold].append(bytes(r.feature))
    return found


def training_rows(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """The sample: doc_id, order, y0, y1, ..., features. One row for each id; of several texts the first by features."""
    order = F.xxhash64(F.lit(SEED), F.col(id_col))
    ys = [f"y{i}" for i in range(len(categories))]
    named = labels.select(F.col(id_col).alias("doc_id"), order.alias("order"), *[c.cast("int").alias(y) for y, c in zip(ys, categories.values(), strict=True)])
    named = named.dropna().groupBy("doc_id", "order").agg(*[F.max(y).alias(y) for y in ys])
    chosen = named.orderBy("order", "doc_id").limit(max_rows)
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.octet_length("text") <= max_bytes)
    found = src.join(F.broadcast(chosen), "doc_id")  # at most max_rows short rows

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        held = pa.array([sorted(features(folded_words(t))) for t in texts_of(batch)], pa.list_(pa.binary()))
        return pa.RecordBatch.from_arrays([held if n == "text" else batch.column(n) for n in batch.schema.names], batch.schema.names)

    kind = ", ".join(f"{f.name} {'array<binary>' if f.name == 'text' else f.dataType.simpleString()}" for f in found.schema)
    return map_slices(found, run, kind).groupBy("doc_id", "order", *ys).agg(F.min("text").alias("features"))


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], **options) -> list[Link]:
    """Fits the chain. ``categories``: name to a 0/1 expression over ``labels``; rows in which one is null aren't used.

    A labelled id without a text isn't used. Without rows every probability is a half. Options as for ``training_rows``.
    """
    return fit_chain(*training_data(docs, labels, categories, **options))[0]


def training_data(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], **options):
    """What ``fit_chain`` takes."""
    sample = cut(training_rows(docs, labels, categories, **options))
    ys = {name: f"y{i}" for i, name in enumerate(categories)}
    fold = F.pmod("order", F.lit(FOLDS))
    sums = [F.count(F.lit(1)).alias("n_all"), *[F.sum(y).alias(f"{y}_all") for y in ys.values()]]
    sums += [x for k in range(FOLDS) for x in (F.count_if(fold == k).alias(f"n_{k}"), *[F.sum(F.when(fold == k, F.col(y)).otherwise(0)).alias(f"{y}_{k}") for y in ys.values()])]
    all_rows = sample.agg(*sums).first().asDict()
    without = lambda c, k: (all_rows[f"{c}_all"] or 0) - ((all_rows[f"{c}_{k}"] or 0) if k < FOLDS else 0)
    counts = cut(sample.select(F.explode("features").alias("feature"), "order", *ys.values()).groupBy("feature").agg(*sums))
    telling = _telling(counts, {(y, k): (without("n", k), without(y, k)) for y in ys.values() for k in range(FOLDS + 1)})
    chosen = {name: [telling[y, k] for k in range(FOLDS + 1)] for name, y in ys.items()}
    every = sorted(set().union(*telling.values()))
    held = F.array_intersect("features", F.array(*[F.lit(bytearray(w)) for w in every]).cast("array<binary>"))
    rows = sample.select("doc_id", "order", *ys.values(), held.alias("features")).toArrow().sort_by([("order", "ascending"), ("doc_id", "ascending")])
    y = {name: rows[c].to_numpy().astype(float) for name, c in ys.items()}
    return [set(f) for f in rows["features"].to_pylist()], y, np.abs(rows["order"].to_numpy() % FOLDS), chosen


def score_texts(data: list[bytes], chain: list[Link]) -> tuple[list[int], np.ndarray]:
    """Word counts and probabilities, a column for each link."""
    known = frozenset().union(*(link.weights for link in chain))
    counts, odds = [], np.zeros((len(data), len(chain)))
    for i, text in enumerate(data):
        words = folded_words(text)
        counts.append(len(words))
        held, before = features(words, known), []
        for link in chain:
            before.append(link.log_odds(held, before))
        odds[i] = before
    return counts, _sigmoid(odds)


def predict(docs: DataFrame, chain: list[Link], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, and p_<category> for each category. Null is an empty text.

    Each row is scored by itself: repeated rows get equal scores, null ids are kept, and no rows give no rows. A chain without rows
    to learn from says a half.
    """
    names = [f"p_{link.category}" for link in chain]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, scores = score_texts(texts_of(batch), chain)
        columns = [pa.array(counts, pa.int64()), *(pa.array(c, pa.float64()) for c in scores.T)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_words", *names])

    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    return map_slices(src, run, f"doc_id {kind}, n_words long, " + ", ".join(f"`{n}` double" for n in names))


def drop_toxic(docs: DataFrame, chain: list[Link], category: str = "toxic", threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """``docs`` with its columns, without the rows whose probability of the category reaches the threshold, ties included.

    A null text counts as an empty one, and its probability is that of no features. Repeated rows stay or go together, a null
    id plays no part, and no rows give no rows.
    """
    at = [link.category for link in chain].index(category)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = score_texts(texts_of(batch, text_col), chain)[1][:, at]
        return batch.filter(pa.array(scores < threshold))

    return map_slices(docs, run, docs.schema, text_col)

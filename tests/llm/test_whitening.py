from __future__ import annotations

import random

import numpy as np
import pytest

from surveyframe.llm import whitening as W


def brute(vectors, k=4):
    """Per row: (deviation, whitened, explained) by the covariance itself."""
    x = np.array([[int(np.floor(256 * float(np.float32(c)))) for c in v] for v in vectors])
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    centred = fit - s / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    return n, ((n * x - s) ** 2).sum(axis=1), (x - s / n) @ v[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


def frame(spark, rows, schema="vec_id long, embedding array<float>, n long, component string"):
    return spark.createDataFrame([(*r, 1, "clash") for r in rows], schema)


def test_against_the_covariance(spark):
    rng = np.random.default_rng(3)
    good = (rng.normal(size=(300, 12)) * np.arange(1, 13)).astype(np.float32).tolist()
    good += good[:40] + [good[0]] * 100  # a third are copies
    bad = [None, [float("nan")] * 12, [float("inf")] + [0.0] * 11, [None] + [1.0] * 11, []]
    rows = [(i, v) for i, v in enumerate(good)] + [(1000 + i, v) for i, v in enumerate(bad)] + [(None, good[5])]
    random.Random(1).shuffle(rows)
    found = W.whiten(frame(spark, rows).repartition(7)).toPandas()
    assert len(found) == 4 * (len(good) + 1) and found.vec_id.isna().sum() == 4
    n, deviation, whitened, explained = brute(good)
    for c in range(4):
        rows = found[(found.component == c + 1) & found.vec_id.notna()].sort_values("vec_id")
        assert rows.vec_id.tolist() == list(range(len(good))) and set(rows.n) == {n} and rows.deviation.tolist() == deviation.tolist()
        own = rows.whitened.to_numpy()
        sign = np.sign((own * whitened[:, c]).sum())
        assert np.abs(own - sign * whitened[:, c]).max() < 1e-9 and abs(rows.explained.iloc[0] - explained[c]) < 1e-9 * explained[c]
    assert 0 <= found.identity_error.iloc[0] < 1e-9 and found.identity_error.nunique() == 1


def test_merging_loses_nothing(spark):
    rng = np.random.default_rng(5)
    x = np.floor(rng.normal(size=(500, 9)) * 256 * np.arange(9, 0, -1)).astype(np.int64) + 10_000
    whole, parts = W.Summary.of(x), [W.Summary.of(p) for p in np.split(x, [1, 3, 40, 200, 201])]
    total = parts[0]
    for p in parts[1:]:
        total = total.merged(p)
    assert total.n == 500 and total.sums == whole.sums == x.sum(axis=0).tolist()
    assert np.allclose(total.values[:9], whole.values, rtol=1e-12) and len(total.values) == 9
    found = W.summarise(spark.createDataFrame([(r,) for r in x.tolist()], "x array<long>").repartition(40))  # two rounds of merges
    assert found.n == 500 and np.allclose(found.values, whole.values, rtol=1e-12)


def test_flat_and_few(spark):
    assert W.whiten(frame(spark, [])).count() == 0
    assert W.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0  # no variance
    line = W.whiten(frame(spark, [(i, [float(i), 2.0 * i, 5.0]) for i in range(10)])).toPandas()
    assert set(line.component) == {1} and abs(line.explained.iloc[0] - 1) < 1e-12
    with pytest.raises(Exception, match="entries"):
        W.whiten(frame(spark, [(1, [1.0]), (2, [1.0, 2.0])]).coalesce(1)).collect()


def test_exact_beyond_doubles():
    fitted = W.Whitening(3_000_000_000, [7] * 2, np.eye(2), np.ones(2), 2.0)
    assert fitted.deviations(np.array([[10_000_000_000, -1]])).tolist() == [[29_999_999_999_999_999_993, -3_000_000_007]]


def test_query(spark):
    from surveyframe.llm import queries

    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").orderBy("vec_id").toPandas()
    n, deviation, whitened, _ = brute(rows.embedding.tolist())
    found = queries.op11_whitening(spark, folder).toPandas().sort_values(["component", "vec_id"])
    assert len(found) == 4 * len(rows) and set(found.n) == {n}
    assert found.deviation.tolist() == deviation.tolist() * 4
    assert np.abs(np.abs(found.whitened.to_numpy().reshape(4, -1).T) - np.abs(whitened)).max() < 1e-8

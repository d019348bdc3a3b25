"""The registered queries without SQL, over whole tables, against plain Python."""

from __future__ import annotations

import os
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from surveyframe.llm import langid, licenses, queries, toxicity

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables aren't here")


@pytest.fixture(scope="module")
def docs(spark):
    return queries.table(spark, DATA, "documents").collect()


def loss(x, y, each, w):
    return float((each * np.logaddexp(0, np.where(y > 0, -1, 1) * (x @ w))).sum() / len(y))


def test_the_fit_is_near_the_optimum():
    """A second fit by Newton's method over all rows."""
    rng = np.random.default_rng(4)
    names = [f"w{i}".encode() for i in range(6)]
    held = rng.random((600, 6)) < 0.3
    earlier = rng.normal(size=600) * 2
    y = (rng.random(600) < 1 / (1 + np.exp(-(held @ np.array([2, -2, 1, 0, 3, -1]) + 0.5 * earlier - 2)))).astype(float)
    link = toxicity.fit_linear([{n for n, h in zip(names, row, strict=True) if h} for row in held], y, earlier[:, None], "c", names)
    x = np.column_stack([held, earlier, np.ones(600)])
    rate = (y.sum() + 0.5) / 601
    each = np.where(y > 0, max(1, (1 - rate) / rate) ** 0.5, max(1, rate / (1 - rate)) ** 0.5)
    best = np.zeros(8)
    for _ in range(50):
        p = 1 / (1 + np.exp(-(x @ best)))
        best -= np.linalg.solve((x * (each * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(8), x.T @ (each * (p - y)))
    own = np.array([*[link.weights[n] for n in names], link.earlier[0], link.bias])
    assert loss(x, y, each, own) < 1.01 * loss(x, y, each, best)
    p, q = (1 / (1 + np.exp(-(x @ w))) for w in (own, best))
    assert np.abs(p - q).max() < 0.1 and np.corrcoef(p, q)[0, 1] > 0.995


def test_toxicity_on_held_out_rows(spark):
    folder = DATA.replace("sf0.001", "sf0.1")
    if not os.path.isdir(folder):
        pytest.skip("the larger tables aren't here")
    labels, texts = queries.table(spark, folder, "labels"), queries.table(spark, folder, "documents")
    fifth = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    chain = toxicity.train(texts, labels.where(~fifth), queries.categories())
    rows = toxicity.predict(texts.where(fifth), chain).join(labels, "doc_id").select("toxic", (F.col("p_toxic") >= 0.5).alias("said")).collect()
    right = Counter((r.toxic, r.said) for r in rows)
    assert right[1, True] >= 0.7 * (right[1, True] + right[1, False]) > 0 and right[0, False] >= 0.97 * (right[0, True] + right[0, False])


def test_op2(spark, docs):
    chain = toxicity.train(queries.table(spark, DATA, "documents"), queries.table(spark, DATA, "labels"), queries.categories())
    found = {r.doc_id: r for r in queries.op2_toxicity(spark, DATA).collect()}
    assert len(found) == len(docs)
    for d in docs:
        words = [bytes(w) for w in (d.text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))).split()]
        held, odds = toxicity.features(words), []
        for link in chain:
            odds.append(max(-30, min(30, link.bias + sum(link.weights.get(f, 0) for f in held) + sum(a * b for a, b in zip(link.earlier, odds, strict=True)))))
        r = found[d.doc_id]
        assert r.n_words == len(words) and abs(r.p_toxic - 1 / (1 + np.exp(-odds[1]))) < 1e-9 and abs(r.p_low_quality - 1 / (1 + np.exp(-odds[0]))) < 1e-9 and r.toxic == (r.p_toxic >= 0.5)


def test_op3(spark, docs):
    out_of = {d.doc_id: zlib.crc32(str(d.doc_id).encode()) % 5 == 0 for d in docs}
    counts: dict[str, Counter] = {}
    for d in docs:
        if d.lang is not None and not out_of[d.doc_id]:
            grams, n = langid.gram_counts(d.text or "")
            counts.setdefault(d.lang, Counter()).update(dict(zip(grams.tolist(), n.tolist(), strict=True)))
    profiles = {k: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[: langid.LENGTH]] for k, c in counts.items()}
    learnt = langid.learn(queries.table(spark, DATA, "documents").where(~langid.held_out(F.col("doc_id"))))
    assert learnt.languages == sorted(profiles)
    for k, language in enumerate(learnt.languages):
        assert {int(g): int(r) for g, r in zip(learnt.grams, learnt.ranks[:, k], strict=True) if r >= 0} == {g: i for i, g in enumerate(profiles[language])}
    places = {k: {g: i for i, g in enumerate(p)} for k, p in profiles.items()}
    found = {r.doc_id: r for r in queries.op3_language_id(spark, DATA).collect()}
    assert len(found) == len(docs)
    for d in docs[::5]:
        grams, n = langid.gram_counts(d.text or "")
        own = [g for g, _ in sorted(zip(grams.tolist(), n.tolist(), strict=True), key=lambda x: (-x[1], x[0]))[: langid.LENGTH]]
        away = {k: sum(abs(i - p[g]) if g in p else langid.LENGTH for i, g in enumerate(own)) for k, p in places.items()}
        best = min(sorted(away), key=away.get) if own else "und"
        r = found[d.doc_id]
        assert (r.held_out, r.lang_pred) == (out_of[d.doc_id], best) and abs(r.score - (1 - away[best] / (langid.LENGTH * len(own)) if own else 0)) < 1e-12


def test_op4(spark, docs):
    found = queries.op4_sharding(spark, DATA).collect()
    sizes = {d.doc_id: len((d.text or "").encode()) + 1 for d in docs}
    crcs = {d.doc_id: zlib.crc32((d.text or "").encode()) for d in docs}
    assert sorted(r.doc_id for r in found) == sorted(sizes) and all((r.size, r.law, r.grown_shard) == (sizes[r.doc_id], "rows", None) and r.text_crc32 in (crcs[r.doc_id], 0) for r in found)
    per = Counter(r.shard for r in found)
    assert set(per) == set(range(16)) and max(per.values()) - min(per.values()) <= 1
    assert all(sorted(r.slot for r in found if r.shard == s) == list(range(n)) for s, n in per.items())
    of_source = {d.doc_id: d.source for d in docs}
    for source, n in Counter(of_source.values()).items():
        assert all(abs(sum(r.shard == s and of_source[r.doc_id] == source for r in found) - n / 16) <= 2 for s in per)


def test_op5(spark, docs):
    from test_dedup import brute_fingerprint

    fps = {d.doc_id: brute_fingerprint(d.text, 3) for d in docs}
    parent = {i: i for i in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(fps)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in queries.op5_simhash(spark, DATA).collect()} == {(i, f"{f:016x}", find(i)) for i, f in fps.items()}


def test_op7(spark, docs):
    from test_pipeline import words

    found = {r.doc_id: r for r in queries.op7_license_scan(spark, DATA).collect()}
    assert len(found) == len(docs)
    for d in docs:
        w, r = words(d.text), found[d.doc_id]
        places = [(i, label) for p, label in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        at = [i for i, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})))
        assert {x for _, x in places} <= set(filter(None, r.labels.split(","))) and r.labels == ",".join(sorted(set(filter(None, r.labels.split(","))))) and 0 <= r.score <= 1 and (r.score == 1 or not places)


def test_op9_and_op10(spark, docs):
    import base64
    import hashlib

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(queries.RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = {r.doc_id: r for r in queries.op9_byte_bpe(spark, DATA).collect()}
    library = Tokenizer.from_file(queries.WORD_BPE)
    files = {r.doc_id: r for r in queries.op10_token_files(spark, DATA).collect()}
    assert len(found) == len(files) == len(docs)
    start = 0
    for d in sorted(docs, key=lambda d: d.doc_id):
        ids, text = encoding.encode_ordinary(d.text or ""), (d.text or "").encode()
        assert (found[d.doc_id].n_tokens, found[d.doc_id].ids_sha256, found[d.doc_id].decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text).hexdigest())
        own = [*library.encode(d.text or "", add_special_tokens=False).ids, 2]
        assert (files[d.doc_id].start, files[d.doc_id].n_tokens, files[d.doc_id].ids_crc32) == (start, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
        start += len(own)

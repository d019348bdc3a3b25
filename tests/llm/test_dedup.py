from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from surveyframe.llm import common, cuckoo, graph, simhash

SCHEMA = "doc_id long, text string, lang string, fp long, node long, component string, digest string, row string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 0, 0, "c", "d", "r") for i, t in rows], SCHEMA)


@pytest.fixture(params=[common.EASY, 1])
def easy(request, monkeypatch):
    """With 1, every key of two rows or more is joined as a hot one."""
    monkeypatch.setattr(common, "EASY", request.param)


# --- Exact.


def test_index_against_dict():
    rnd = random.Random(2)
    index, live = cuckoo.CuckooIndex(8), {}
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    for step in range(20_000):
        k = rnd.choice(keys)
        if rnd.random() < 0.45 and k in live:
            assert index.delete(k)
            del live[k]
        elif k not in live:
            live[k] = (step,)
            index.insert(k, live[k])
        assert index.get(k) == live.get(k)
    assert dict(index.items()) == live and index.size == len(live) and index.resizes > 3
    assert not index.delete(b"\0" * 32)
    assert all(index.may_hold(k) for k in live)


ROWS = [(1, "a"), (5, "a"), (3, "a"), (2, None), (4, ""), (None, "a"), (None, "b"), (6, "x" * 300_000), (7, "c"), (7, "c"), (7, "d"), (None, "e"), (None, "e")]


def test_exact_duplicates(spark, easy):
    found = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in cuckoo.exact_duplicates(frame(spark, ROWS)).collect()), key=str)
    groups = {}
    for i, t in ROWS:
        groups.setdefault(t or "", []).append(i)
    expected, done = [], set()
    for i, t in ROWS:
        t = t or ""
        keep = max((x for x in groups[t] if x is not None), default=None)
        kept = i == keep and (i, t) not in done
        done.add((i, t))
        expected.append((i, keep, len(groups[t]), kept, hashlib.sha256(t.encode()).hexdigest()))
    assert found == sorted(expected, key=str)
    assert cuckoo.exact_duplicates(frame(spark, [])).count() == 0


def test_drop_exact(spark):
    out = cuckoo.drop_exact_duplicates(frame(spark, ROWS))
    assert out.columns == frame(spark, []).columns
    kept = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert kept == sorted([(5, "a"), (4, ""), (None, "b"), (6, "x" * 300_000), (7, "c"), (7, "d"), (None, "e")], key=str)
    assert cuckoo.drop_exact_duplicates(frame(spark, [])).count() == 0


# --- Components.


def test_components(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(-300, 300), rnd.randrange(-300, 300)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(100)] + [(-5000, x) for x in range(2000, 2040)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    found = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- SimHash.


def brute_fingerprint(text, width):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


@pytest.mark.parametrize(("hot", "keys"), [(2, 0), (3, 10**6), (8, 0), (8, 10**6), (1000, 10**6)])  # shared keys by a shuffle, and sent to all tasks
def test_linked_against_all_pairs(spark, monkeypatch, hot, keys):
    monkeypatch.setattr(simhash, "KEYS", keys)
    rnd = random.Random(hot)
    base = [rnd.getrandbits(64) for _ in range(6)]
    fps = set(base)
    for b in base:
        for _ in range(60):
            x = b
            for _ in range(rnd.choice([1, 2, 2, 3, 4])):
                x ^= 1 << rnd.choice([rnd.randrange(64), rnd.randrange(3), 32 + rnd.randrange(3)])
            fps.add(x)
    fps |= {rnd.getrandbits(64) for _ in range(100)}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    found = {(r.a, r.b) for r in simhash.linked(spark.createDataFrame([(x,) for x in signed], "fp long"), hot).collect()}
    pairs = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2}
    assert found <= pairs

    def classes(edges):
        parent = {x: x for x in signed}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
        return {x: find(x) for x in signed}

    assert classes(found) == classes(pairs)
    if hot == 1000:
        assert found == pairs


def test_classes(spark, easy):
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    rnd = random.Random(9)
    long = " ".join(rnd.choices(words, k=40_000))
    rows = [(9, "one Two  three\tfour"), (4, "ONE two three four"), (3, None), (8, ""), (7, " \n"), (1, "é É"), (2, "É É"), (None, "one two three four"), (6, long), (5, long + " alpha"), (11, "a b"), (11, "a b")]
    found = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicate_classes(frame(spark, rows)).collect()]
    fps = [brute_fingerprint(t, 3) for _, t in rows]
    expected = []
    for i, (doc, _) in enumerate(rows):
        held, size = {i}, 0
        while len(held) != size:
            size = len(held)
            held |= {j for j in range(len(rows)) if any((fps[j] ^ fps[k]).bit_count() <= 2 for k in held)}
        expected.append((doc, f"{fps[i]:016x}", min((rows[j][0] for j in held if rows[j][0] is not None), default=None)))
    assert sorted(found, key=str) == sorted(expected, key=str)
    assert simhash.near_duplicate_classes(frame(spark, [])).count() == 0


def jaccard(a, b):
    x, y = (set(simhash.shingle_hashes(t.encode(), 5).tolist()) for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0


def corpus(seed, n=40):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = rnd.choices(vocabulary, k=60)
    texts = []
    for _ in range(n):
        words = rnd.choices(vocabulary, k=rnd.choice([30, 120, 300]))
        if rnd.random() < 0.5:
            words += passage
        texts.append(" ".join(words))
        for _ in range(rnd.choice([0, 0, 1, 4, 30])):
            new = list(words)
            for _ in range(rnd.choice([1, 2, 4])):
                new[rnd.randrange(len(new))] = rnd.choice(vocabulary)
            texts.append(" ".join(new))
    return list(dict.fromkeys(texts))


def test_similar_recall_and_precision(spark):
    texts = corpus(4)
    rows = [(i, t) for i, t in enumerate(texts)] + [(10_000, ""), (10_001, " "), (10_002, None)]
    kept = {r.doc_id for r in simhash.drop_near_duplicates(frame(spark, rows)).collect()}
    node = {xxhash.xxh64_intdigest(t.encode(), 42): i for i, t in enumerate(texts)}
    found = {tuple(sorted((node[a & (1 << 64) - 1], node[b & (1 << 64) - 1]))) for a, b in simhash.similar(frame(spark, rows[: len(texts)])).collect()}
    pairs = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if jaccard(texts[i], texts[j]) >= 0.8}
    assert found <= pairs

    def classes(edges):
        parent = list(range(len(texts)))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
        return [find(x) for x in range(len(texts))]

    a, b = classes(pairs), classes(found)
    together = sum(a[i] == a[j] for i in range(len(texts)) for j in range(i))
    assert sum(b[i] == b[j] for i in range(len(texts)) for j in range(i)) >= 0.98 * together
    assert kept == {i for i, c in enumerate(b) if c == i} | {10_000, 10_001, 10_002} - ({10_001} if 10_001 not in kept else set())
    assert simhash.drop_near_duplicates(frame(spark, [])).count() == 0


def test_samples_agree_by_similarity():
    rnd = np.random.default_rng(5)
    factors = simhash._orders(2000)
    a = np.unique(rnd.integers(0, 1 << 63, 900, dtype=np.uint64))
    b = np.unique(np.concatenate([a[:800], rnd.integers(0, 1 << 63, 100, dtype=np.uint64)]))
    similarity = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    same = (simhash._samples(a, factors) == simhash._samples(b, factors)).mean()
    assert abs(same - similarity**5) < 0.06
    assert simhash._samples(a[:5], factors)[0] == simhash.majority(a[:5])
    order = simhash._mixed(a * factors[7])
    assert simhash._samples(a, factors)[7] == simhash.majority(a[np.argsort(order)[:5]])


def test_hot_group_of_unlike_texts_ends(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"{passage} tail{i} x{i} y{i} z{i} q{i} r{i} " + " ".join(f"u{i}_{j}" for j in range(40))) for i in range(60)]
    assert simhash.drop_near_duplicates(frame(spark, rows)).count() == 60


def all_links(texts):
    sets = [set(simhash.shingle_hashes(t.encode(), 5).tolist()) for t in texts]
    return {(i, j) for j in range(len(texts)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}


def least_of_each(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i for i in range(n) if find(i) == i}


def test_hot_groups_of_edited_copies_without_their_base(spark):
    rnd, texts = random.Random(3), []
    for g in range(2):
        base = [f"b{g}_{i}" for i in range(100)]
        for _ in range(300):
            new = list(base)
            for _ in range(rnd.choice([2, 3, 4])):
                new[rnd.randrange(len(new))] = f"e{rnd.random()}"
            texts.append(" ".join(new))
    kept = {r.doc_id for r in simhash.drop_near_duplicates(frame(spark, list(enumerate(texts)))).collect()}
    assert kept == least_of_each(len(texts), all_links(texts))


def test_short_texts_with_one_more_word(spark):
    texts = [" ".join(f"s{i}_{j}" for j in range(8)) for i in range(60)]
    longer = [f"{t} behind" if i % 2 else f"before {t}" for i, t in enumerate(texts)]
    less = [" ".join(t.split()[:-1]) for t in texts[:20]]  # three shingles of four
    rows = list(enumerate(texts + longer + less))
    assert {r.doc_id for r in simhash.drop_near_duplicates(frame(spark, rows)).collect()} == set(range(60)) | set(range(120, 140))


def test_hidden_pairs_in_a_group_that_shares_a_passage(spark, easy):
    rnd, passage, texts = random.Random(11), [f"p{i}" for i in range(40)], []
    for k in range(80):
        own = [f"o{k}_{i}" for i in range(60)]
        other = list(own)
        for _ in range(2):
            other[rnd.randrange(60)] = f"z{rnd.random()}"
        texts += [" ".join(own[:30] + passage + own[30:]), " ".join(other[:30] + passage + other[30:])]
    links = all_links(texts)
    assert len(links) > 60
    kept = {r.doc_id for r in simhash.drop_near_duplicates(frame(spark, list(enumerate(texts)))).collect()}
    assert kept == least_of_each(len(texts), links)


def test_parities_never_claim_more_than_the_difference():
    rnd = np.random.default_rng(7)
    for _ in range(200):
        a = np.unique(rnd.integers(0, 1 << 63, rnd.integers(0, 300), dtype=np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate([a[rnd.random(len(a)) < rnd.random()], rnd.integers(0, 1 << 63, rnd.integers(0, 40), dtype=np.uint64)]))
        bits = sum((int(x) ^ int(y) & (1 << 64) - 1).bit_count() for x, y in zip(simhash._parities(a).view(np.uint64), simhash._parities(b).view(np.uint64), strict=True))
        assert bits <= len(np.setxor1d(a, b))


def test_loads_count_all_texts(spark):
    rnd = random.Random(13)
    texts = [" ".join(rnd.choices([f"w{i}" for i in range(40)], k=rnd.randrange(30))) for _ in range(400)] + ["a passage that many texts hold"] * 300 + ["", None]
    brute = np.zeros(simhash.COUNTERS, dtype=np.int64)
    for t in texts:
        words = (t or "").split()
        held = {xxhash.xxh64_intdigest(" ".join(words[i : i + 5]), 42) for i in range(max(1, len(words) - 4))} if words else set()
        for h in held:
            brute[h * simhash.COUNTERS >> 64] += 1
    loads = simhash._loads(frame(spark, list(enumerate(texts))).repartition(23), 5)
    assert (loads == brute).all() and loads.max() >= 300
    assert (simhash._loads(frame(spark, []), 5) == 0).all()


def test_frequent_shingles_come_last_in_prefixes():
    passage, own = simhash.shingle_hashes(b"a passage that many texts hold", 5), simhash.shingle_hashes(b" ".join(b"o%d" % i for i in range(60)), 5)
    loads = np.zeros(simhash.COUNTERS, dtype=np.int64)
    loads[simhash._counter(passage)] = 5000
    hashes = np.unique(np.concatenate([passage, own]))
    prefix = simhash._prefix(hashes, 0.8, simhash._levels(loads))
    assert len(prefix) == len(hashes) - int(np.ceil(0.8 * len(hashes))) + 1 and not set(prefix.tolist()) & set(passage.tolist())


def test_near_dedup_asks_the_index_of_variants(spark, monkeypatch):
    """Before, it found its candidates by samples alone."""
    rnd = random.Random(11)
    base = [f"w{rnd.randrange(900)}" for _ in range(400)]
    texts = [" ".join(base), " ".join([*base, "end"]), " ".join(reversed(base)), " ".join(base) + "  ", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    nodes = simhash._nodes(docs, "text")
    sketches = simhash._sketches(nodes.select("node", "text"), 5, 0.8, 2)
    fps = {r.node: r.fp & (1 << 64) - 1 for r in sketches.collect()}
    assert sorted(fps.values()) == sorted(simhash.majority(simhash.shingle_hashes(t.encode(), 5)) for t in texts)
    pairs = {(r.a, r.b) for r in simhash._by_variants(sketches).collect()}
    near = {(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 2}
    assert pairs and pairs <= near and {x for p in pairs for x in p} == {x for p in near for x in p}
    asked = []
    monkeypatch.setattr(simhash, "_by_variants", lambda s, old=simhash._by_variants: asked.append(1) or old(s))
    assert {r.doc_id for r in simhash.drop_near_duplicates(docs).collect()} == {0, 2, 4} and asked


def test_texts_without_a_pair_are_left_out_before_the_shuffle(spark):
    texts = simhash._nodes(spark.range(3000).select(F.col("id").cast("string").alias("text")), "text")
    some = texts.where("cast(text as int) % 7 = 0").select("node")
    found = {r.text for r in simhash._likely_in(texts, some).collect()}
    assert {str(k) for k in range(0, 3000, 7)} <= found and len(found) < 440


def _shuffled(spark) -> np.ndarray:
    """Rows and bytes that all stages so far have written to shuffles."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return np.array([[s.shuffleWriteRecords(), s.shuffleWriteBytes()] for s in (stages.apply(i) for i in range(stages.size()))]).sum(axis=0)


def test_near_dedup_shuffles_prefixes_once_and_at_the_end_few_texts(spark):
    """Before, prefixes were dealt twice, and all texts at the end."""
    rnd = random.Random(12)
    texts = [" ".join(f"{rnd.getrandbits(40):x}" for _ in range(500)) for _ in range(120)]
    docs = frame(spark, list(enumerate([*texts, *(t + " end" for t in texts[:6])]))).select("doc_id", "text").localCheckpoint()
    nodes = simhash._nodes(docs, "text").localCheckpoint()
    sketches = simhash._sketches(nodes.select("node", "text"), 5, 0.8, 2).localCheckpoint()
    keys, known = sketches.agg(F.sum(F.size("keys"))).first()[0], spark.createDataFrame([], "node long, component long")
    node = {r.text: r.node for r in nodes.collect()}
    pairs = {tuple(sorted((node[t], node[t + " end"]))) for t in texts[:6]}
    at = _shuffled(spark)
    assert {tuple(r) for r in simhash._across(sketches, known, 0.8).collect()} == pairs
    assert keys < (_shuffled(spark) - at)[0] < 1.5 * keys
    kept = simhash.drop_near_duplicates(docs)
    at = _shuffled(spark)
    assert sorted(r.doc_id for r in kept.collect()) == list(range(120))
    assert (_shuffled(spark) - at)[1] < sum(map(len, texts)) / 4

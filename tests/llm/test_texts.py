from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from surveyframe.llm import decontam, langid, licenses, sharding, toxicity

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LONG = "lorem ipsum " * 30_000


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_words long, spans string")


# --- Decontamination.


@pytest.mark.parametrize("max_windows", [500_000, 7])
def test_contamination_against_brute_force(spark, max_windows):
    rnd = random.Random(8)
    vocabulary = ["a", "the", "Étude", "b2", "cat"]
    items = [(1, " ".join(rnd.choices(vocabulary, k=14))), (2, "The Cat, b2!"), (3, None), (4, "..."), (5, " ".join(rnd.choices(vocabulary, k=10))), (2, "the cat b2"), (None, "only here zz"), (12, "a a")]
    rows = [(i, " ".join(rnd.choices(vocabulary + [items[0][1], items[4][1], "the-cat B2"], k=rnd.randrange(40)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, LONG + "the cat b2 " + LONG), (203, "only HERE zz"), (203, "only HERE zz"), (None, "a a a")]
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, window string")
    found = decontam.contamination(frame(spark, rows), bench, max_windows=max_windows).collect()
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9)):
            if w:
                windows.setdefault(tuple(w[k : k + 10]), set()).add(i)
    expected = []
    for doc, t in rows:
        w, hit, held = words(t), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in windows:
                    hit |= set(range(k, k + size))
                    held |= windows[tuple(w[k : k + size])]
        expected.append((doc, len(w), len(hit), sorted(str(x) for x in held if x is not None)))
    got = [(r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), r["items"]) for r in found]
    assert sorted(got, key=str) == sorted(expected, key=str)
    kept = decontam.decontaminate(frame(spark, rows), bench, max_windows=max_windows)
    assert kept.columns == frame(spark, []).columns and sorted((r.doc_id for r in kept.collect()), key=str) == sorted((d for d, _, n, _ in expected if not n), key=str)


def test_blocks_are_built_once_for_a_bundle(monkeypatch):
    import pyarrow as pa

    class Block:
        def __init__(self, rows):
            self.value = rows

    built = []
    monkeypatch.setattr(decontam, "NgramSet", lambda rows, whole=decontam.NgramSet: built.append(1) or whole(rows))
    blocks = [("block 1 of a test", Block([(b"one two", "a")])), ("block 2 of a test", Block([(b"two three", "b")]))]
    batches = [pa.RecordBatch.from_arrays([pa.array([f"zero one two three {k}", None])], ["text"]) for k in range(20)]
    found = list(decontam._scanned(iter(batches), blocks, "text"))
    assert [b.column("text").to_pylist() for b, *_ in found] == [b.column("text").to_pylist() for b in batches] and len(built) == 2
    assert all(rest == [[5, 0], [[{"start": 1, "end": 4}], []], [["a", "b"], []]] for _, *rest in found)
    monkeypatch.setattr(decontam, "BUNDLE", 1)
    assert len(list(decontam._scanned(iter(batches), blocks, "text"))) == 20 and len(built) == 42


def test_spans_are_cut_out(spark):
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    rows = [(1, "Zero, ONE two-three! four one two three"), (2, None), (3, "nothing")]
    out = {r.doc_id: r.text for r in decontam.decontaminate(frame(spark, rows), bench, remove="spans").collect()}
    assert out == {1: "Zero, ! four ", 2: None, 3: "nothing"}
    empty = decontam.contamination(frame(spark, rows), bench.limit(0)).collect()
    assert all(not r.spans for r in empty) and decontam.contamination(frame(spark, []), bench).count() == 0


# --- Licences.


def test_licenses(spark):
    rows = [
        (1, "Released UNDER the MIT-license. cc by NC CC-BY-NC by nc"), (2, None), (3, ""), (4, "under the mitt licence"), (5, "Apache License, Version 2.0"), (6, "sunder the mit licenses"), (7, LONG + "cc by nc " + LONG),
        (8, "under the myth license and more"), (9, "cc by nd"), (10, "under the mit license under the mit license"), (11, "é under thé mit license"), (None, "apache licence versions 2"),
    ]
    found = {r.doc_id: r for r in licenses.license_notices(frame(spark, rows)).collect()}
    for doc, t in rows:
        w, places, labels = words(t), [], set()
        for phrase, label in licenses.BASE.items():
            p = phrase.split()
            for i in range(len(w) - len(p) + 1):
                if w[i : i + len(p)] == p:
                    places.append(i)
                    labels.add(label)
        r = found[doc]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        assert labels <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert found[4].labels == "mit" and found[4].score == 1 - 2 / 21 and (found[4].spans[0].first_word, found[4].spans[0].last_word) == (0, 3)
    assert found[None].labels == "apache-2" and found[11].labels == "mit" and found[9].labels == "" and found[1].score == 1
    assert licenses.license_notices(frame(spark, [])).count() == 0


def test_seeds_find_every_edit():
    rnd = random.Random(1)
    notice = licenses.Notice("under the mit license", "mit")
    for _ in range(2000):
        text = list(notice.phrase)
        for _ in range(2):
            at = rnd.randrange(1, len(text) - 1)
            text[at : at + rnd.choice([0, 1])] = rnd.choice([[], ["x"], ["e"]])
        joined = f" say {''.join(text)} now "
        if any(s == notice.phrase for s in [joined]):
            continue
        whole = notice.pattern.search(joined[1:-1])
        assert bool(notice.near(joined.encode())) == bool(whole)


# --- Languages.


def brute_profile(text):
    text = re.sub(r" +", " ", "".join(c if c.isalpha() else " " for c in f" {text.lower()} "))
    counts = Counter(g for n in (1, 2, 3) for i in range(len(text) - n + 1) if (g := text[i : i + n]) and not (n == 1 and g == " ") and not (n == 3 and g[1] == " "))
    return counts


def test_gram_counts():
    for text in ["", "...", "a", "Straße, ÄÖ 12 x", "日本 語 𝄞a", "ab" * 50 + " c"]:
        grams, counts = langid.gram_counts(text)
        expected = brute_profile(text) if any(c.isalpha() for c in text.lower()) else {}
        assert {langid.gram_text(int(g)): int(c) for g, c in zip(grams, counts, strict=True)} == dict(expected)


def test_blocks_agree(monkeypatch):
    text = "Der schnelle, braune Fuchs -- springt über den Hund " * 20
    whole = langid.gram_counts(text)
    for size in (7, 64, 333):
        monkeypatch.setattr(langid, "BLOCK", size)
        got = langid.gram_counts(text)
        assert (whole[0] == got[0]).all() and (whole[1] == got[1]).all()


def test_distance_by_hand():
    profiles = langid.Profiles({"x": [1, 2, 3], "y": [3, 9]}, 3)
    assert profiles.distances(np.array([3, 1, 7])).tolist() == [2 + 1 + 3, 0 + 3 + 3]


def test_languages(spark):
    english, german = "the cat and the dog are in the house with them", "der Hund und die Katze sind in dem Haus mit ihnen"
    rows = [(i, english if i % 2 else german, "en" if i % 2 else "de") for i in range(40)] + [(50, "the dog", None), (51, None, "en"), (52, "12 ...", "de"), (53, "die Katze", "xx"), (54, "", None)]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, score double")
    profiles = langid.learn(df.where("doc_id < 52"), max_docs=10)
    found = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(df, profiles).collect()}
    assert all(found[i][0] == ("en" if i % 2 else "de") for i in range(40)) and found[50][0] == "en" and found[53][0] == "de"
    assert {found[i] for i in (51, 52, 54)} == {("und", 0.0)} and all(0 <= s <= 1 for _, s in found.values())
    nothing = langid.learn(df.limit(0))
    assert {r.lang_pred for r in langid.identify(df, nothing).collect()} == {"und"}


def test_held_out(spark):
    import zlib

    ids = [1, 5, 77, -7, 123456789, None]
    found = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "i long").select(langid.held_out(F.col("i"))).collect()]
    assert found == [zlib.crc32(str(i).encode()) % 5 == 0 if i is not None else True for i in ids]


# --- Toxicity.


def toxic_tables(spark, n=600):
    rnd = random.Random(3)
    plain = [f"word{i}" for i in range(200)]
    docs, labels = [], []
    for i in range(n):
        bad = i % 6 == 0
        text = rnd.choices(plain, k=rnd.randrange(5, 60)) + (rnd.choices(["idiot", "moron", "scumbagish", "scumbagged", "scumbaglike"], k=3) if bad else [])
        rnd.shuffle(text)
        docs.append((i, " ".join(text), "x", 0.1))
        if i % 2 == 0:
            labels.append((i, None if i % 50 == 0 else int(not bad), int(bad)))
    docs += [(9000, None, None, None), (9001, "", "x", 0.0), (9002, LONG, "x", 0.0), (None, "idiot moron", "x", 0.0)]
    return spark.createDataFrame(docs, "doc_id long, text string, source string, p_toxic double"), spark.createDataFrame([*labels, (77_777, 1, 1)], "doc_id long, quality int, toxic int")


def categories():
    return {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")}



def test_chain(spark):
    docs, labels = toxic_tables(spark)
    chain = toxicity.train(docs, labels, categories())
    assert [link.category for link in chain] == ["low_quality", "toxic"] and [len(link.earlier) for link in chain] == [0, 1]
    found = {r.doc_id: r for r in toxicity.predict(docs, chain).collect()}
    assert sum((found[i].p_toxic >= 0.5) == (i % 6 == 0) for i in range(1, 600, 2)) >= 295
    assert found[9000].p_toxic == found[9001].p_toxic < 0.5 and found[9002].n_words == 60_000
    again = toxicity.train(docs.repartition(3), labels.repartition(2), categories())
    assert again == chain
    kept = toxicity.drop_toxic(docs, chain)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, r in found.items() if r.p_toxic < 0.5}


def test_out_of_fold(spark):
    docs, labels = toxic_tables(spark)
    rows, y, folds, chosen = toxicity.training_data(docs, labels, categories())
    chain, odds = toxicity.fit_chain(rows, y, folds, chosen)
    first = y["low_quality"]
    inside = folds == 2
    alone = toxicity.fit_linear([r for r, i in zip(rows, inside, strict=True) if not i], first[~inside], np.zeros(((~inside).sum(), 0)), "low_quality", chosen["low_quality"][2])
    assert [alone.log_odds(r, []) for r, i in zip(rows, inside, strict=True) if i] == odds[inside, 0].tolist()
    assert chain[1].earlier[0] != 0

    # The features of each model, by the rows that it may see.
    held = [(set(map(bytes, r.features)), (r.y0, r.y1), r.order % toxicity.FOLDS) for r in toxicity.training_rows(docs, labels, categories()).collect()]
    for k, name in enumerate(y):
        for fold in (2, toxicity.FOLDS):
            seen = [(f, ys[k]) for f, ys, own in held if own != fold]
            n, n1 = len(seen), sum(v for _, v in seen)
            statistics = []
            for w in set().union(*(f for f, _ in seen)):
                have = sum(w in f for f, _ in seen)
                a = sum(v for f, v in seen if w in f)
                off = a * (n - n1 - have + a) - (have - a) * (n1 - a)
                if have >= toxicity.LEAST_ROWS and (x := n * off * off / max(have * (n - have) * n1 * (n - n1), 1)) >= toxicity.LEAST_STATISTIC:
                    statistics.append((x, w))
            assert set(chosen[name][fold]) == {w for _, w in sorted(statistics, key=lambda p: (-p[0], p[1]))[: toxicity.FEATURES]}


def test_no_labels(spark):
    docs, labels = toxic_tables(spark, 20)
    chain = toxicity.train(docs, labels.limit(0), categories())
    assert {r.p_toxic for r in toxicity.predict(docs, chain).collect()} == {0.5}
    assert toxicity.predict(docs.limit(0), chain).count() == 0


def test_bounded_sample(spark):
    docs, labels = toxic_tables(spark)
    assert toxicity.training_rows(docs, labels, categories(), max_rows=50).count() == 50


def test_known_features_agree():
    rnd = random.Random(2)
    for _ in range(200):
        text = [rnd.choice([b"alpha", b"alphabet", b"alphas", b"beta", b"betamax"]) for _ in range(rnd.randrange(30))]
        known = frozenset(rnd.sample([b"alpha", b"beta", b"\1alpha", b"\2alpha", b"\3betam", b"\1betam"], 3))
        assert toxicity.features(text, known) == toxicity.features(text) & known


# --- Shards.


def test_shards(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.choice(["x", "yy", None, "é"]), "hot" if i % 3 else rnd.choice(["a", "b", None, f"s{i}"])) for i in range(3000)] + [(5, "same", "a")] * 20 + [(None, "n", "b")] * 5
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, shard int")
    found = sharding.interleave(df, 16).collect()
    assert len(found) == len(rows)
    shards = {}
    for r in found:
        shards.setdefault(r.shard, []).append(r)
    assert sorted(shards) == list(range(16))
    counts = [len(s) for s in shards.values()]
    assert max(counts) - min(counts) <= 1
    for s in shards.values():
        assert sorted(r.slot for r in s) == list(range(len(s)))
        hot = sum(r.source == "hot" for r in s)
        assert abs(hot - sum(r[2] == "hot" for r in rows) / 16) <= 12  # hundreds of sources of one row fall at random
    assert Counter((r.doc_id, r.size) for r in found) == Counter((i, len((t or "").encode()) + 1) for i, t, _ in rows)
    key = lambda rs: sorted(((r.doc_id, r.source, r.shard, r.slot) for r in rs if r.doc_id != 5), key=str)
    assert key(found) == key(sharding.interleave(df.repartition(7), 16).collect())
    assert sharding.interleave(df.limit(0), 16).count() == 0


def test_mixture(spark):
    rnd = random.Random(6)
    rows = [(i, "t", rnd.choices(["a", "b", "c", None], [70, 20, 8, 2])[0]) for i in range(4000)]
    found = sharding.interleave(spark.createDataFrame(rows, "doc_id long, text string, source string"), 7).collect()
    held = Counter((r.shard, r.source) for r in found)
    for source in ("a", "b", "c", None):
        n = sum(r[2] == source for r in rows)
        assert all(abs(held[k, source] - n / 7) <= 3 for k in range(7))


def test_sharding_plan_is_native(spark):
    df = spark.createDataFrame([(1, "a", "s")], "doc_id long, text string, source string")
    plan = sharding.interleave(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_sharding_rejects(spark):
    with pytest.raises(ValueError):
        sharding.interleave(spark.createDataFrame([], "doc_id long, text string, source string"), 0)


def test_shards_against_ranks_and_cuts_in_python(spark):
    import struct
    import zlib

    import xxhash

    def chained(*values):
        h = 42
        for v in values:
            if v is not None:
                h = xxhash.xxh64_intdigest(v if isinstance(v, bytes) else struct.pack("<i", v[0]) if isinstance(v, tuple) else struct.pack("<q", v), h)
        return h

    signed = lambda h: h - (1 << 64) if h >> 63 else h
    rnd = random.Random(8)
    rows = [(i, rnd.choice([None, "", "é" * (i % 7), f"t{i}"]), rnd.choice(["a", "a", "a", "b", None])) for i in range(700)] + [(3, "same", "a"), (3, "same", "a"), (None, "x", "c")]
    by_source, total, buckets = {}, len(rows), 16
    for doc, text, source in rows:
        data = (text or "").encode()
        order = chained((42,), doc, zlib.crc32(data) if text is not None else 0, len(data) + 1)
        key = chained((42,), b"source", (source or "").encode(), (int(source is None),))
        by_source.setdefault(key, []).append(((order >> 40) % buckets, signed(order), doc if doc is not None else -1, source))
    places = []
    for key, held in by_source.items():
        start = (key >> 11) / float(1 << 53)
        places += [((nth - start) / len(held), signed(key), order, doc, source) for nth, (_, order, doc, source) in enumerate(sorted(held, key=lambda r: r[:3]), 1)]
    wanted = {}
    for position, (_, _, _, doc, source) in enumerate(sorted(places, key=lambda r: r[:4])):
        shard = position * 16 // total
        wanted.setdefault((doc, source), []).append((shard, position - -(-shard * total // 16)))
    found = {}
    for r in sharding.interleave(spark.createDataFrame(rows, "doc_id long, text string, source string"), 16).collect():
        found.setdefault((-1 if r.doc_id is None else r.doc_id, r.source), []).append((r.shard, r.slot))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in wanted.items()}


def test_notices_against_words():
    """Random texts of notices: base places and spans by a plain walk over the words."""
    rnd = random.Random(9)
    base, both = licenses._notices(tuple(licenses.BASE.items()), 10), licenses._notices(tuple((licenses.BASE | licenses.FURTHER).items()), 10)
    words = sorted({w for p in licenses.BASE | licenses.FURTHER for w in p.split()} | {"ünder", "mít", "x"})
    phrases = list(licenses.BASE | licenses.FURTHER)
    for _ in range(150):
        text = " ".join(rnd.choice(phrases) if rnd.random() < 0.2 else rnd.choice(words) for _ in range(rnd.randrange(60)))
        found, held = licenses.scan_text(text.encode(), base, both), text.split()
        places = [(i, label) for p, label in licenses.BASE.items() for i in range(len(held)) if held[i : i + len(p.split())] == p.split()]
        assert (found["n_words"], found["n_base"], found["first_word"], found["last_word"]) == (len(held), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None))
        assert found["base_labels"] == ",".join(sorted({x for _, x in places}))
        exact = {(label, i, i + len(p.split()) - 1) for p, label in (licenses.BASE | licenses.FURTHER).items() for i in range(len(held)) if held[i : i + len(p.split())] == p.split()}
        for s in found["spans"]:
            part = " ".join(held[s["first_word"] : s["last_word"] + 1])
            phrase = next(p for p, label in (licenses.BASE | licenses.FURTHER).items() if label == s["label"])
            assert edits(part, phrase) == s["edits"] <= len(phrase) // 10 and s["score"] == 1 - s["edits"] / len(phrase)
        assert {x for x in exact if not any(s["label"] == x[0] and s["first_word"] <= x[2] and x[1] <= s["last_word"] for s in found["spans"])} == set()


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_a_text_full_of_notices():
    import time

    base, both = licenses._notices(tuple(licenses.BASE.items()), 10), licenses._notices(tuple((licenses.BASE | licenses.FURTHER).items()), 10)
    part = b"under the mit license and gnu genral public license version 3 cc by nc "
    took = []
    for n in (1000, 8000):
        start = time.process_time()
        assert licenses.scan_text(part * n, base, both)["n_base"] == 2 * n
        took.append(time.process_time() - start)
    assert took[1] < 16 * max(took[0], 0.05)

from __future__ import annotations

import random

from pyspark.sql import functions as F

from surveyframe.functions.similarity import legacy_score
from surveyframe.operators import cluster


def _long(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "ord long, question_text string")


def test_texts_against_sequential_greedy(spark):
    rnd = random.Random(5)
    words = ["small", "ring", "rod", "blue", "green", "old", "custodian", "authority"]
    texts = [" ".join(rnd.choices(words, k=rnd.randrange(1, 5))) + rnd.choice(["", "?", "  "]) for _ in range(120)] + ["???", "!!!"]
    long = _long(spark, texts)
    order = [r.question_text for r in cluster.text_order(long).orderBy("ord").collect()]
    from surveyframe.functions import similarity as S
    from surveyframe.functions import text as T

    normal = spark.createDataFrame([(t,) for t in order], "t string").select("t", T.norm_match("t").alias("n"))
    pairs = normal.alias("a").crossJoin(normal.alias("b")).select(F.col("a.t"), F.col("b.t"), S.token_set_score(F.col("a.n"), F.col("b.n"))).collect()
    score = {(a, b): s for a, b, s in pairs}
    for threshold in (60, 85):
        seeds, expected = [], {}
        for t in order:
            best = max(seeds, key=lambda s: (score[t, s], -seeds.index(s)), default=None)
            if best is not None and score[t, best] >= threshold:
                expected[t] = seeds.index(best)
            else:
                seeds.append(t)
                expected[t] = len(seeds) - 1
        found = {r.question_text: r.cluster for r in cluster.cluster_texts(long, threshold, block=7).collect()}
        assert found == expected


def test_zero_threshold_and_empty(spark):
    assert {r.cluster for r in cluster.cluster_texts(_long(spark, ["a", "b", "c"]), 0).collect()} == {0}
    assert cluster.cluster_texts(_long(spark, []), 85).count() == 0


def test_rows_against_sequential_greedy(spark):
    rnd = random.Random(6)
    prompts = ["Small ring", "small rod", "公司名稱", "Who is the custodian", "Who is the custodian please\nmore", "Small  ring?", "blue widget"]
    rows = [(i, rnd.choice([None, "A", "B"]), rnd.choice(prompts)) for i in range(80)]
    df = spark.createDataFrame(rows, "ord long, option_label string, prompt string")
    found = {r.ord: r.group for r in cluster.cluster_rows(df, 80, block=3).collect()}
    key = lambda t: " ".join((t or "").split("\n")[0].split()).lower()
    seeds, expected = [], {}
    for i, label, prompt in rows:
        best, top = None, -1
        for s, (sl, sp) in enumerate(seeds):
            value = legacy_score(key(prompt), sp) if key(label) == sl else 0
            if value > top:
                best, top = s, value
        if best is not None and top >= 80:
            expected[i] = best
        else:
            seeds.append((key(label), key(prompt)))
            expected[i] = len(seeds) - 1
    assert found == expected


def test_join_against_all_pairs(spark):
    """Typos, so that similar texts share no token; long and short texts; parts that don't meet."""
    from surveyframe.functions import similarity as S
    from surveyframe.operators import simjoin

    rnd = random.Random(8)

    def typo(text):
        at = rnd.randrange(len(text))
        return text[:at] + rnd.choice(["", "e", "zz", text[at] * 2]) + text[at + 1 :]

    texts = ["custodian", "is the custodian", "registered office address of the custodian", "ownership", "é 中文 x", "a", "b c"]
    for _ in range(110):
        texts.append(typo(typo(rnd.choice(texts))) or "x")
    rows = [(i, rnd.choice("pq"), sorted(set(t.split()))) for i, t in enumerate(texts)]
    for score, bound, slack, threshold in ((S.tokens_score, S.tokens_bound, 0, 60), (S.tokens_score, S.tokens_bound, 0, 85), (S.legacy_tokens_score, S.legacy_tokens_bound, 0.5, 80)):
        # The integer score's tokens hold ASCII alone.
        some = [r for r in rows if score is S.tokens_score or " ".join(r[2]).isascii()]
        items = spark.createDataFrame([(*r, "clash") for r in some], "ord long, part string, tokens array<string>, key string")
        pairs = items.alias("a").crossJoin(items.alias("b")).where("a.part = b.part")
        wanted = {(r[0], r[1]): r[2] for r in pairs.select("a.ord", "b.ord", score(F.col("a.tokens"), F.col("b.tokens")).cast("double")).collect() if r[2] >= threshold}
        found = simjoin.edges(items, simjoin.index(items, threshold - slack), items.select(F.col("ord").alias("seed_ord")), threshold, score, bound, slack)
        assert {(r.ord, r.seed_ord): r.score for r in found.collect()} == wanted and len(wanted) > len(rows)
        assert "CartesianProduct" not in (plan := found._jdf.queryExecution().toString()) and "BroadcastNestedLoopJoin" not in plan

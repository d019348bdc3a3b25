"""Greedy clustering by similarity, in blocks of seeds.

In processing order, an item joins the seed that is most similar to it, the earliest of equals, if the score reaches the
threshold; else it becomes a seed itself. So an item is a seed just if no earlier seed reaches the threshold with it. Items
meet seeds by the index of ``simjoin``; those of equal tokens meet them once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as T
from ..storage import cut, numbered
from .simjoin import greedy_edges

#: Items decided, and so seeds broadcast, in one round.
BLOCK = 1024


def _numbered(seeds: DataFrame) -> DataFrame:
    """seed_ord to cluster, from 0 in processing order. Seeds are few: as many as clusters."""
    return numbered(seeds.select("seed_ord"), "nth", F.col("seed_ord")).select("seed_ord", (F.col("nth") - 1).cast("int").alias("cluster"))


def text_order(long: DataFrame, column: str = "question_text") -> DataFrame:
    """Distinct texts with ``ord`` from 1: most frequent first, then longest, then by the text itself."""
    freq = long.groupBy(F.col(column).alias("question_text")).agg(F.count(F.lit(1)).alias("freq"))
    return numbered(freq, "ord", F.desc("freq"), F.desc(F.length("question_text")), F.asc("question_text"))


def _assigned(items: DataFrame, threshold: float, score, bound, block: int, slack: float = 0) -> tuple[DataFrame, DataFrame]:
    """(ord, seed_ord, score of every item; seed_ord of every seed) for ``items`` (ord, part, tokens). An item without tokens is a
    seed of its own with a score of 0."""
    items = cut(items.select("ord", "part", "tokens"))
    sets = cut(items.where(F.size("tokens") > 0).groupBy("part", "tokens").agg(F.min("ord").alias("first")))
    edges, seeds = greedy_edges(sets.select(F.col("first").alias("ord"), "part", "tokens"), threshold, score, bound, block, slack)
    by_set = edges.withColumnRenamed("ord", "first").join(sets, "first").drop("first")
    met = items.join(by_set, ["part", "tokens"]).where("seed_ord <= ord").select("ord", "seed_ord", "score")
    # A seed's own row is its own, whatever else it resembles; an earlier seed would have kept it from being one.
    best = met.groupBy("ord").agg(F.max_by(F.struct("seed_ord", "score"), F.struct("score", (-F.col("seed_ord")).alias("early"))).alias("b")).select("ord", "b.seed_ord", "b.score")
    alone = items.where(F.size("tokens") == 0).select("ord", F.col("ord").alias("seed_ord"), F.lit(0.0).alias("score"))
    return best.unionByName(alone), seeds.unionByName(alone.select("seed_ord"))


def cluster_texts(long: DataFrame, threshold: float = 85, column: str = "question_text", block: int = BLOCK) -> DataFrame:
    """question_text, cluster, seed_text, for each distinct text."""
    texts = cut(text_order(long, column).select("ord", "question_text", S.tokens(T.norm_match("question_text")).alias("tokens")))
    if threshold <= 0:
        seeds = texts.where("ord = 1").select(F.col("ord").alias("seed_ord"))
        assigned = texts.select("ord", F.lit(1).cast("long").alias("seed_ord"))
    else:
        assigned, seeds = _assigned(texts.withColumn("part", F.lit("")), threshold, S.tokens_score, S.tokens_bound, block)
    named = assigned.select("ord", "seed_ord").join(_numbered(seeds), "seed_ord").join(texts.select(F.col("ord").alias("seed_ord"), F.col("question_text").alias("seed_text")), "seed_ord")
    return texts.select("ord", "question_text").join(named, "ord").select("question_text", "cluster", "seed_text")


def with_clusters(long: DataFrame, threshold: float = 85, block: int = BLOCK) -> DataFrame:
    """The long frame with each row's cluster."""
    return long.join(cluster_texts(long, threshold, block=block).select("question_text", "cluster"), "question_text")


def cluster_rows(rows: DataFrame, threshold: int = 80, block: int = BLOCK) -> DataFrame:
    """``rows`` (ord, option_label, prompt, ...) with ``group``, ``seed_ord`` and ``match_score``, row by row in their order.

    Rows match on the first line of the prompt, given equal labels. Equal prompts are scored once; a prompt without letters
    and digits of ASCII makes a group of each of its rows.
    """
    keyed = cut(rows.withColumns({"label_key": T.match_key("option_label"), "prompt_key": T.match_key("prompt")}))
    items = keyed.select("ord", F.col("label_key").alias("part"), S.legacy_tokens("prompt_key").alias("tokens"))
    assigned, seeds = _assigned(items, threshold, S.legacy_tokens_score, S.legacy_tokens_bound, block, slack=0.5)
    groups = _numbered(seeds).withColumnRenamed("cluster", "group")
    out = keyed.join(assigned, "ord").join(groups, "seed_ord")
    return out.withColumn("match_score", F.col("score").cast("int")).drop("score")

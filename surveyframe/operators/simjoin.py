"""Exact similarity join of token sets against seeds, by an inverted index in place of a comparison of all pairs.

A score is 100 * (1 - d / l), where d of the l characters of two texts stay unmatched, for one of these: both texts whole
(their sorted tokens joined by spaces), or the tokens that they share against one of the texts. With a threshold of 100 * (1 - e):

* a shared part that is similar enough to a text of length L leaves at most 2e / (1 + e) * L of it out. Take the text's tokens in
  any order; those that begin within that length can't all be left out. So one of them is a token of the other text.
* two whole texts that are similar enough have so many characters in common, each counted as often as it occurs, that the same
  holds for single characters: of the text's (character, occurrence)s in any order, one that begins within that length is
  among those of the other text that do so, too.

Rare tokens and occurrences come first in the order, so that few pairs meet. Pairs that meet are ruled out by length, then
by the score's bound, then scored.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut

#: Index rows of the seeds of one round, which are broadcast; an item with more of them makes a round of its own.
SEED_ROWS = 200_000


def index(items: DataFrame, threshold: float) -> DataFrame:
    """Rows (ord, part, length, kind, key, prefix) of ``items`` (ord, part, tokens; tokens sorted and distinct). Items of different
    ``part`` never meet. Items without tokens have no rows."""
    e = 1 - threshold / 100
    text = F.array_join("tokens", " ")
    sized = items.where(F.size("tokens") > 0).select("ord", "part", "tokens", text.alias("text"), F.length(text).cast("long").alias("length"))
    times = lambda c: F.length("text") - F.length(F.replace("text", c))
    occurrences = F.flatten(F.transform(F.array_distinct(F.split("text", "")), lambda c: F.transform(F.sequence(F.lit(1), times(c)), lambda k: F.concat(c, k.cast("string")))))
    whole = F.transform("tokens", lambda t: F.struct(F.lit("token").alias("kind"), t.alias("key"), (F.length(t) + 1).cast("long").alias("weight")))
    single = F.transform(occurrences, lambda c: F.struct(F.lit("char").alias("kind"), c.alias("key"), F.lit(1).cast("long").alias("weight")))
    rows = cut(sized.select("ord", "part", "length", F.explode(F.concat(whole, single)).alias("x")).select("ord", "part", "length", "x.*"))
    counts = rows.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("held_by"))
    order = Window.partitionBy("ord", "kind").orderBy("held_by", "key").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("weight").over(order), F.lit(0))
    ranked = rows.join(counts, ["kind", "key"]).withColumn("prefix", before <= F.col("length") * (2 * e / (1 + e)) + 1e-6)
    return cut(ranked.where(F.col("prefix") | (F.col("kind") == "token")).select("ord", "part", "length", "kind", "key", "prefix"))


def candidates(rows: DataFrame, seeds: DataFrame, threshold: float) -> DataFrame:
    """ord and ``seeds``, the seed_ords that the item may reach the threshold with. Both sides are parts of an index."""
    e = 1 - threshold / 100
    other = seeds.select(F.col("ord").alias("seed_ord"), "part", F.col("length").alias("seed_length"), "kind", "key", F.col("prefix").alias("seed_prefix"))
    close = F.abs(F.col("length") - F.col("seed_length")) <= e * (F.col("length") + F.col("seed_length")) + 1e-6
    fits = F.when(F.col("kind") == "token", F.col("prefix") | F.col("seed_prefix")).otherwise(close)
    met = rows.join(F.broadcast(other), ["part", "kind", "key"]).where(fits)  # at most a block of seeds
    return met.groupBy("ord").agg(F.collect_set("seed_ord").alias("seeds"))


def edges(items: DataFrame, rows: DataFrame, seeds: DataFrame, threshold: float, score: Callable[[Column, Column], Column], bound: Callable[[Column, Column], Column], slack: float = 0) -> DataFrame:
    """(ord, seed_ord, score) of every item and seed that reach the threshold. ``seeds``: seed_ord, at most a block of them."""
    held = seeds.join(items.select(F.col("ord").alias("seed_ord"), F.col("tokens").alias("seed_tokens")), "seed_ord")
    met = candidates(rows, rows.join(F.broadcast(seeds), F.col("ord") == F.col("seed_ord"), "left_semi"), threshold - slack)
    pairs = met.join(items.select("ord", "tokens"), "ord").select("ord", "tokens", F.explode("seeds").alias("seed_ord")).join(F.broadcast(held), "seed_ord")
    a, b = F.col("tokens"), F.col("seed_tokens")
    scored = pairs.where(bound(a, b) >= threshold).select("ord", "seed_ord", score(a, b).cast("double").alias("score"))
    return scored.where(F.col("score") >= threshold)


def greedy_edges(items: DataFrame, threshold: float, score: Callable[[Column, Column], Column], bound: Callable[[Column, Column], Column], block: int, slack: float = 0) -> tuple[DataFrame, DataFrame]:
    """(edges (ord, seed_ord, score) of items and seeds that reach the threshold, seeds (seed_ord)) for ``items`` (ord, part, tokens).

    ``slack``: how much rounding may add to a score. An item becomes a seed just if no earlier seed reaches the threshold with it. Each round decides the first ``block`` items
    that no seed has reached so far, the driver holding their numbers and the pairs among them that reach the threshold, and joins
    the new seeds with all items. Items that a seed has reached with a score of 100 leave: no later seed is better. Items without
    tokens reach nothing and are left out.
    """
    spark = items.sparkSession
    items = cut(items.where(F.size("tokens") > 0).select("ord", "part", "tokens"))
    rows = index(items, threshold - slack)
    found = spark.createDataFrame([], "ord long, seed_ord long, score double")
    seeds = spark.createDataFrame([], "seed_ord long")
    undecided = cut(rows.groupBy("ord").agg(F.count(F.lit(1)).alias("n")))
    n = 0
    while some := undecided.orderBy("ord").limit(block).collect():
        before = [0, *accumulate(r.n for r in some)]
        first = [r.ord for r, held in zip(some, before, strict=False) if held <= SEED_ROWS]
        some = F.broadcast(spark.createDataFrame([(o,) for o in first], "ord long"))
        among = edges(items.join(some, "ord"), rows.join(some, "ord"), some.select(F.col("ord").alias("seed_ord")), threshold, score, bound, slack)
        reaches: dict[int, list[int]] = {}
        for r in among.where("seed_ord < ord").select("ord", "seed_ord").collect():
            reaches.setdefault(r.ord, []).append(r.seed_ord)
        new: set[int] = set()
        for o in first:
            if not any(s in new for s in reaches.get(o, ())):
                new.add(o)
        chosen = spark.createDataFrame([(s,) for s in sorted(new)], "seed_ord long")
        fresh = cut(edges(items, rows, chosen, threshold, score, bound, slack))
        found, seeds = found.unionByName(fresh), seeds.unionByName(chosen)
        n += 1
        if n % 16 == 0:  # a plan of hundreds of parts is slow to make
            found, seeds = cut(found), cut(seeds)
        reached = fresh.where("seed_ord < ord").select("ord").distinct()
        undecided = cut(undecided.join(reached, "ord", "left_anti").join(F.broadcast(chosen), F.col("ord") == F.col("seed_ord"), "left_anti"))
        done = fresh.where("score >= 100 and seed_ord < ord").select("ord").distinct()
        items, rows = items.join(done, "ord", "left_anti"), rows.join(done, "ord", "left_anti")
        if n % 4 == 0:
            items, rows = cut(items), cut(rows)
    return found, seeds

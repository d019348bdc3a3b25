"""Report tables over a long frame with clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as T


def canonical_id(cluster: Column | str = "cluster") -> Column:
    return F.concat(F.lit("CQ"), ((F.col(cluster) if isinstance(cluster, str) else cluster) + 1).cast("string"))


def _count(condition: Column, name: str) -> Column:
    return F.count_if(condition).alias(name)


def _first(column: str, name: str | None = None) -> Column:
    return F.min_by(column, "ord").alias(name or column)


def _listed(column: Column, sep: str) -> Column:
    return F.array_join(F.array_sort(F.collect_set(column)), sep)


def text_frequency(long: DataFrame) -> DataFrame:
    return long.groupBy("question_text").agg(F.count(F.lit(1)).alias("freq"))


def per_questionnaire(long: DataFrame) -> DataFrame:
    """How much of each questionnaire is answered; required questions are those that aren't conditional."""
    blank, cond = F.col("is_blank"), F.col("conditional")
    rows = long.groupBy("questionnaire").agg(
        _first("file_name"), _first("sheet"), F.count(F.lit(1)).alias("n_questions"), _count(~blank, "n_answered"), _count(blank, "n_blank"),
        _count(~cond, "n_required"), _count(~cond & blank, "n_required_missing"), _count(cond & blank, "n_optional_blank"),
    )
    answered = F.col("n_required") - F.col("n_required_missing")
    return rows.select(
        "questionnaire", "file_name", "sheet", "n_questions", "n_answered", "n_blank", T.rate(F.col("n_answered"), F.col("n_questions")).alias("answer_rate"),
        "n_required", "n_required_missing", T.rate(answered, F.col("n_required")).alias("required_answer_rate"), "n_optional_blank",
    ).orderBy("questionnaire")


def canonical_labels(long: DataFrame) -> DataFrame:
    """cluster, canonical_text: its most frequent text; of equals a clean one (no doubled or outer white space), then
    more capitals, then longer, then first seen."""
    text = F.col("question_text")
    texts = long.groupBy("cluster", "question_text").agg(F.count(F.lit(1)).alias("freq"), F.min("ord").alias("first"))
    clean = (text == T.strip(text)) & ~text.rlike(f"{T.WS}{{2,}}")
    best = F.struct("freq", clean.cast("int").alias("clean"), F.regexp_count(text, F.lit(r"\p{Lu}")).alias("capitals"), F.length(text).alias("length"), (-F.col("first")).alias("early"))
    return texts.groupBy("cluster").agg(F.max_by("question_text", best).alias("canonical_text"))


def per_question(long: DataFrame, labels: DataFrame) -> DataFrame:
    """How often each question is answered, the least often first."""
    total = long.agg(F.count_distinct("questionnaire").alias("total"))
    rows = long.groupBy("cluster").agg(
        F.bool_or("conditional").alias("is_conditional"), F.count_distinct("questionnaire").alias("questionnaires_present"), F.count(F.lit(1)).alias("instances"),
        _count(~F.col("is_blank"), "answered"), _count(F.col("is_blank"), "blank"), _listed(F.nullif("question_id", F.lit("")), ", ").alias("source_question_ids"),
    )
    rows = rows.crossJoin(F.broadcast(total)).join(labels, "cluster")
    return rows.select(
        canonical_id().alias("canonical_id"), "canonical_text", "is_conditional", "questionnaires_present", (F.col("total") - F.col("questionnaires_present")).alias("questionnaires_missing"),
        "instances", "answered", "blank", T.rate(F.col("answered"), F.col("instances")).alias("answer_rate"), "source_question_ids",
    ).orderBy("answer_rate", "canonical_id")


def question_changes(long: DataFrame, labels: DataFrame) -> DataFrame:
    """The wordings of each question that has several, most used first; drift is substantive unless only form differs."""
    variants = long.groupBy("cluster", "question_text").agg(F.count_distinct("questionnaire").alias("used_by_count"), _listed(F.col("questionnaire"), "; ").alias("used_by"), F.count(F.lit(1)).alias("freq"), F.min("ord").alias("first"))
    drift = F.when(F.count_distinct(T.norm_match("question_text")) == 1, "formatting only").otherwise("substantive")
    per = variants.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_variants"), drift.alias("drift_type")).where("n_variants > 1")
    rows = variants.join(per, "cluster").join(labels, "cluster").orderBy("cluster", F.desc("freq"), "first")
    return rows.select(canonical_id().alias("canonical_id"), F.col("canonical_text").alias("Question"), "drift_type", "n_variants", F.col("question_text").alias("variant_text"), "used_by_count", "used_by")


def first_status(long: DataFrame) -> DataFrame:
    """cluster, questionnaire, status of its first row: answered, blank (optional) or blank (missing)."""
    status = F.when(~F.col("is_blank"), "answered").when(F.col("conditional"), "blank (optional)").otherwise("blank (missing)")
    return long.withColumn("status", status).groupBy("cluster", "questionnaire").agg(_first("status"))


def questionnaires(long: DataFrame) -> list[str]:
    """The names of the columns of a coverage matrix, sorted. A table can't have more columns than a driver can name."""
    return [r[0] for r in long.select("questionnaire").distinct().orderBy("questionnaire").collect()]


def coverage_matrix(long: DataFrame, labels: DataFrame, names: list[str] | None = None) -> DataFrame:
    """A row for each question, a column for each questionnaire with the question's status there, '' if absent."""
    names = questionnaires(long) if names is None else names
    cells = first_status(long)
    wide = cells.groupBy("cluster").pivot("questionnaire", names).agg(F.first("status"))
    present = cells.groupBy("cluster").agg(F.count(F.lit(1)).alias("present_in"))
    rows = wide.join(present, "cluster").join(labels, "cluster").orderBy("cluster")
    return rows.select(canonical_id().alias("canonical_id"), "canonical_text", *[F.coalesce(F.col(f"`{n}`"), F.lit("")).alias(n) for n in names], "present_in")


def question_presence(long: DataFrame, labels: DataFrame) -> DataFrame:
    """Questions that some questionnaire lacks, those that the fewest lack first."""
    held = long.groupBy("cluster").agg(F.array_sort(F.collect_set("questionnaire")).alias("held"))
    lacking = missing_pairs(long).groupBy("cluster").agg(F.array_sort(F.collect_list("questionnaire")).alias("lacking"))
    rows = held.join(lacking, "cluster").join(labels, "cluster")
    return rows.select(
        canonical_id().alias("canonical_id"), "canonical_text", F.size("held").alias("present_count"), F.size("lacking").alias("missing_count"),
        F.array_join("held", "; ").alias("present_in"), F.array_join("lacking", "; ").alias("missing_from"),
    ).orderBy("missing_count", "canonical_id")


def missing_pairs(long: DataFrame) -> DataFrame:
    """(cluster, questionnaire) where the questionnaire lacks the question: an anti-join of the grid of both, which is made for
    questions alone that some questionnaire lacks. So it has as many rows as are there and as are missing."""
    present = long.select("cluster", "questionnaire").distinct()
    every = present.select("questionnaire").distinct()
    total = every.agg(F.count(F.lit(1)).alias("total"))
    some = present.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(total)).where("n < total").select("cluster")
    return some.crossJoin(every).join(present, ["cluster", "questionnaire"], "left_anti")


def variant_users(long: DataFrame) -> DataFrame:
    """cluster, question_text, users: who uses which wording."""
    return long.groupBy("cluster", "question_text").agg(F.array_sort(F.collect_set("questionnaire")).alias("users"))


def clusters_audit(long: DataFrame, labels: DataFrame) -> DataFrame:
    """Every row with its question's canonical text and its similarity to it."""
    pairs = long.select("cluster", "question_text").distinct().join(labels, "cluster")
    score = F.round(S.token_set_score(T.norm_match("question_text"), T.norm_match("canonical_text")), 1)
    scored = pairs.select("cluster", "question_text", "canonical_text", score.alias("match_to_canonical"))
    rows = long.join(scored, ["cluster", "question_text"])
    return rows.select(
        canonical_id().alias("canonical_id"), "canonical_text", "match_to_canonical", "questionnaire", "file_name", "sheet", "question_id", "question_text", "answer", "is_blank", "conditional",
    ).orderBy("canonical_id", "questionnaire")


# The metrics of the overview and the legend of the coverage matrix.
OVERVIEW = [
    "questionnaires", "canonical questions", "question instances (rows)", "answered instances", "blank instances", "overall answer rate", "required answer rate (excl. conditional)",
    "conditional questions (instances)", "required answers missing", "questions with changed wording (substantive)", "questions with formatting-only drift", "questions not present in every questionnaire",
    "fuzzy match threshold", "cell legend",
]
LEGEND = "answered / blank (missing) / blank (optional) / '' = absent"


def overview(long: DataFrame, threshold: float = 85) -> DataFrame:
    """metric, value (as text), value_num, in the order of ``OVERVIEW``."""
    blank, cond = F.col("is_blank"), F.col("conditional")
    main = long.agg(F.count_distinct("questionnaire").alias("a"), F.count_distinct("cluster").alias("b"), F.count(F.lit(1)).alias("c"), _count(~blank, "d"), _count(blank, "e"), _count(cond, "h"), _count(~cond, "r"), _count(~cond & blank, "i"))
    per = long.groupBy("cluster").agg(F.count_distinct("question_text").alias("texts"), F.count_distinct(T.norm_match("question_text")).alias("forms"), F.count_distinct("questionnaire").alias("held"))
    changed = F.col("texts") > 1
    more = per.crossJoin(F.broadcast(main.select("a"))).agg(_count(changed & (F.col("forms") > 1), "j"), _count(changed & (F.col("forms") == 1), "k"), _count(F.col("held") < F.col("a"), "l"))
    one = main.crossJoin(more).withColumns({"f": T.rate(F.col("d"), F.col("c")), "g": T.rate(F.col("r") - F.col("i"), F.col("r")), "m": F.lit(threshold), "n": F.lit(LEGEND)})
    pairs = F.array(*[F.struct(F.lit(n).alias("nr"), F.lit(m).alias("metric"), F.col(c).cast("string").alias("value"), F.col(c).cast("string").try_cast("double").alias("value_num")) for n, (m, c) in enumerate(zip(OVERVIEW, "abcdefghijklmn", strict=True))])
    return one.select(F.explode(pairs).alias("p")).select("p.*").orderBy("nr").drop("nr")


def low_rates(per_question_table: DataFrame, n: int = 10) -> DataFrame:
    """The questions that are answered least often, of those not always answered."""
    return per_question_table.where("answer_rate < 1.0").orderBy("answer_rate", "canonical_id").limit(n)


def substantive_clusters(changes: DataFrame, n: int = 8) -> DataFrame:
    """The first questions, by their number, whose wording changed in substance."""
    number = F.substr("canonical_id", F.lit(3)).cast("int")
    return changes.where("drift_type = 'substantive'").select("canonical_id", "Question", "n_variants").distinct().orderBy(number).limit(n)


def top_gaps(presence: DataFrame, n: int = 10) -> DataFrame:
    """The head of the presence table."""
    return presence.orderBy("missing_count", "canonical_id").limit(n)


def distinct_counts(long: DataFrame) -> DataFrame:
    """Questionnaires, and those with a required question left blank."""
    lacking = F.when(F.col("is_blank") & ~F.col("conditional"), F.col("questionnaire"))
    return long.agg(F.count_distinct("questionnaire").alias("n_questionnaires"), F.count_distinct(lacking).alias("n_lacking"))

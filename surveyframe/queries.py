"""One query for each operator over the tables of a folder, and the same in DuckDB SQL where SQL can express it."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures, streaming
from .functions import similarity as S
from .functions import text as T
from .operators import cluster, compare, grid, longframe, report, windows
from .sources import extract
from .storage import cut, numbered

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
BRANDS = [f"Brand#{i}" for i in range(1, 26)]
SIZES = 50


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- SQL parts. Texts of these tables need no more than ASCII folding and 'ß'.

_WS = T.WS


def _sql(text: str) -> str:
    return text.replace("'", "''")


def _strip(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '^{_WS}+|{_WS}+\\z', '', 'g')"


def _collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_WS}+', ' ', 'g'))"


def _fold(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


def _norm(x: str) -> str:
    numbering = T.NUMBERING.replace("^(?i)", "^").removesuffix("+")  # no possessive repetition there, and no need
    return f"""{_collapse(f"regexp_replace(regexp_replace({_fold(x)}, '{numbering}', ''), '[^\\p{{L}}\\p{{N}}_{T.WS_SET}]', ' ', 'g')")}"""


def _long(part: str) -> str:
    return f"""
lp as ({part}),
lg as (select ord, file_name || ' | ' || sheet as questionnaire, file_name, sheet, question_id, {_strip("question")} as question_text,
  case when answer in ('', 'N/A') then '' else {_strip("answer")} end as answer from lp),
long as (select *, answer = '' as is_blank, regexp_matches(question_text, '{_sql(T.conditional_pattern()[4:])}', 'i') as conditional, {_norm("question_text")} as norm from lg where question_text <> '')"""


_WHOLE, _LONG = _long(fixtures.LONG_PART), _long(fixtures.GAPS_PART)


def _given(long: str) -> str:
    return f"""{long},
fo as (select *, case when split_part(norm, ' ', 1) in ('blue', 'cold') then split_part(norm, ' ', 1) when split_part(norm, ' ', 1) in ('hot', 'large') then split_part(norm, ' ', 1) || ' ' || split_part(norm, ' ', 2) else norm end as form from long),
ids as (select form, (row_number() over (order by form) - 1)::int as cluster from (select distinct form from fo)),
g as (select fo.* exclude (form), ids.cluster from fo join ids using (form)),
gf as (select * replace (file_name as questionnaire) from g),
tx as (select cluster, question_text, count(*) as freq, min(ord) as first from g group by all),
lab as (select cluster, arg_max(question_text, row(freq, (question_text = {_strip("question_text")} and not regexp_matches(question_text, '{_WS}{{2,}}'))::int, length(regexp_replace(question_text, '[^\\p{{Lu}}]', '', 'g')), length(question_text), -first)) as canonical_text from tx group by cluster)"""


_GIVEN = _given(_LONG)


def given(spark: SparkSession, sf_dir: str, by_sheet: bool = True, whole: bool = False) -> DataFrame:
    """The long frame with clusters by fixed rules, so that reports are checked apart from clustering: some texts by their normal
    form, which drift in form only, others by its first word or two, which drift in substance. Written once, as reports read it
    several times. ``whole``: with the questions that reports on gaps leave out."""
    part = fixtures.long_part if whole else fixtures.gaps_part
    norm = T.norm_match("question_text")
    first, two = (F.substring_index("norm", " ", n) for n in (1, 2))
    form = F.when(first.isin("blue", "cold"), first).when(first.isin("hot", "large"), two).otherwise(F.col("norm"))
    long = cut(part(spark, sf_dir, by_sheet).withColumn("norm", norm).withColumn("form", form).drop("norm"))
    ids = numbered(long.select("form").distinct(), "nth", F.col("form")).select("form", (F.col("nth") - 1).cast("int").alias("cluster"))
    return long.join(ids, "form").drop("form")


# --- Loading.


@query(f"with {_WHOLE} select ord, questionnaire, file_name, sheet, question_id, question_text, answer, is_blank, conditional from long")
def load_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.long_part(spark, sf_dir)


@query(f"with lp as ({fixtures.LONG_PART}) select ord, file_name, sheet, question as prompt, coalesce(trunc(try_cast(case when ord % 7 = 0 then 'x' else (ord % 4)::varchar || '.0' end as double)), 0)::int as sub_idx from lp where {_strip('question')} <> ''")
def load_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.view(spark, sf_dir, fixtures.LONG_PART, "part").withColumnRenamed("question", "prompt")
    rows = rows.withColumn("sub_idx", F.when(F.col("ord") % 7 == 0, "x").otherwise(F.concat((F.col("ord") % 4).cast("string"), F.lit(".0"))))
    halves = [rows.where("ord % 2 = 0"), rows.where("ord % 2 = 1").drop("answer")]
    return longframe.load_all(halves).select("ord", "file_name", "sheet", "prompt", "sub_idx")


@query("select p_partkey, case when p_partkey % 3 = 0 then '' else p_brand end as f, case when p_partkey % 3 = 0 then p_type when p_partkey % 5 = 0 then p_brand else p_brand || ' | ' || p_type end as by_sheet, case when p_partkey % 3 = 0 then '' else p_brand end as by_file from part")
def questionnaire_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, s = F.when(F.col("p_partkey") % 3 != 0, F.col("p_brand")), F.when(F.col("p_partkey") % 5 != 0, F.col("p_type")).when(F.col("p_partkey") % 3 == 0, F.col("p_type"))
    return read(spark, sf_dir, "part").select("p_partkey", F.coalesce(f, F.lit("")).alias("f"), longframe.questionnaire_id(f, s).alias("by_sheet"), longframe.questionnaire_id(f, s, False).alias("by_file"))


# --- Texts.


@query(f"""select doc_id, lower({_collapse("split_part(coalesce(text, ''), chr(10), 1)")}) as match_key, {_fold(_collapse("coalesce(text, '')"))} as normal, {_norm("coalesce(text, '')")} as norm_match, {_strip("text")} = '' as blank from documents""")
def normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", T.match_key("text").alias("match_key"), T.normalise("text").alias("normal"), T.norm_match("text").alias("norm_match"), T.is_blank("text").alias("blank"))


@query(f"""select p_partkey, lower(p_type) in ('economy', 'n/a') or p_type = '' as blank, regexp_matches(t, '{_sql(T.conditional_pattern()[4:])}|(?:ring)', 'i') as conditional, t as shown from (select *, p_type || ' - ' || p_name || case when p_partkey % 3 = 0 then ' (if relevant)' when p_partkey % 3 = 1 then ' please specify only if so' else '' end as t from part)""")
def blank_and_conditional(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = F.when(F.col("p_partkey") % 3 == 0, " (if relevant)").when(F.col("p_partkey") % 3 == 1, " please specify only if so").otherwise("")
    shown = T.display_question("p_type", F.concat("p_name", tail))
    return read(spark, sf_dir, "part").select("p_partkey", T.is_blank("p_type", ["Economy", "n/a"]).alias("blank"), T.is_conditional(shown, ["ring"]).alias("conditional"), shown.alias("shown"))


@query("""with c as (select c_custkey, (c_custkey * 7 % 16384 + 1)::int as n, printf('FF%02X%02X%02X', (c_custkey * 37 % 256)::int, (c_custkey * 53 % 256)::int, (c_custkey * 11 % 256)::int) as rgb, (c_custkey * 37 % 256)::int as r, (c_custkey * 53 % 256)::int as g, (c_custkey * 11 % 256)::int as b, c_name, c_mktsegment from customer)
select c_custkey, case when n <= 26 then chr(64 + n) when n <= 702 then chr(64 + (n - 27) // 26 + 1) || chr(65 + (n - 27) % 26) else chr(65 + (n - 703) // 676) || chr(65 + (n - 703) // 26 % 26) || chr(65 + (n - 703) % 26) end as letters,
 case when abs(r - g) < 20 and abs(g - b) < 20 and r between 150 and 245 then 'grey' when g > r + 10 and g > b + 10 and g >= 150 then 'green' when r >= 200 and g >= 180 and b < 170 and abs(r - g) < 60 then 'yellow' else 'none' end as fill,
 c_mktsegment || '_' || c_name as file, (c_custkey % 2 = 0 and c_custkey % 3 = 0) as header, case when c_custkey % 5 = 0 then 'Q' || c_custkey end as qid from c""")
def cell_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    rgb = F.format_string("FF%02X%02X%02X", key * 37 % 256, key * 53 % 256, key * 11 % 256)
    text = F.when(key % 2 == 0, "SECTION A").otherwise("Section A")
    ids = F.when(key % 5 == 0, F.concat(F.lit(" Q"), key.cast("string"), F.lit("  "))).otherwise(F.concat(F.lit("q"), key.cast("string")))
    return read(spark, sf_dir, "customer").select(
        "c_custkey", T.column_letters((key * 7 % 16384 + 1).cast("int")).alias("letters"), T.fill_class(rgb).alias("fill"), T.safe_filename(F.concat("c_mktsegment", F.lit(":/?"), "c_name")).alias("file"),
        T.is_section_header(text, key % 3 == 0, F.when(key % 3 == 0, F.lit(14.0))).alias("header"), T.question_id(ids).alias("qid"),
    )


@query("select p_partkey, list_transform(regexp_extract_all(p_brand || '.' || p_size || case when p_partkey % 10 = 0 then 'x' else '.a' || p_partkey end, '(\\d+)', 1), lambda x: x::bigint)::varchar as runs, p_name || chr(10) || p_type as lines from part")
def id_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat("p_brand", F.lit("."), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 10 == 0, "x").otherwise(F.concat(F.lit(".a"), F.col("p_partkey").cast("string"))))
    return read(spark, sf_dir, "part").select("p_partkey", T.digit_runs(key).cast("string").alias("runs"), T.append_line("p_name", "p_type").alias("lines"))


# --- Reports.


@query(f"""with {_WHOLE} select questionnaire, arg_min(file_name, ord) as file_name, arg_min(sheet, ord) as sheet, count(*) as n_questions, count_if(not is_blank)::bigint as n_answered, count_if(is_blank)::bigint as n_blank, round(count_if(not is_blank)::double / count(*), 4) as answer_rate,
 count_if(not conditional)::bigint as n_required, count_if(not conditional and is_blank)::bigint as n_required_missing, round(count_if(not conditional and not is_blank)::double / nullif(count_if(not conditional), 0), 4) as required_answer_rate, count_if(conditional and is_blank)::bigint as n_optional_blank from long group by questionnaire""")
def per_questionnaire_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.per_questionnaire(fixtures.long_part(spark, sf_dir))


@query("with q as (select l_suppkey, l_partkey, l_discount = 0 as blank from lineitem) select l_suppkey::varchar as questionnaire, count(*) as n_questions, count_if(not blank)::bigint as n_answered, count_if(blank)::bigint as n_blank, round(count_if(not blank)::double / count(*), 4) as answer_rate from q group by all")
def lineitem_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("questionnaire"), F.lit("").alias("file_name"), F.lit("").alias("sheet"), F.col("l_partkey").alias("ord"), (F.col("l_discount") == 0).alias("is_blank"), F.lit(False).alias("conditional"))
    return report.per_questionnaire(rows).select("questionnaire", "n_questions", "n_answered", "n_blank", "answer_rate")


@query(f"with {_WHOLE} select question_text, count(*) as freq, row_number() over (order by count(*) desc, length(question_text) desc, question_text) as ord from long group by question_text")
def text_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.text_order(fixtures.long_part(spark, sf_dir))


@query(f"with {_GIVEN} select cluster, canonical_text from lab")
def canonical_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.canonical_labels(given(spark, sf_dir))


_PER_QUESTION = """select 'CQ' || (cluster + 1) as canonical_id, canonical_text, bool_or(conditional) as is_conditional, count(distinct questionnaire) as questionnaires_present, (select count(distinct questionnaire) from g) - count(distinct questionnaire) as questionnaires_missing,
 count(*) as instances, count_if(not is_blank)::bigint as answered, count_if(is_blank)::bigint as blank, round(count_if(not is_blank)::double / count(*), 4) as answer_rate, string_agg(distinct question_id, ', ' order by question_id) as source_question_ids from g join lab using (cluster) group by cluster, canonical_text"""


def _reports(spark: SparkSession, sf_dir: str, by_sheet: bool = True) -> tuple[DataFrame, DataFrame]:
    long = given(spark, sf_dir, by_sheet)
    return long, report.canonical_labels(long)


@query(f"with {_GIVEN} {_PER_QUESTION}")
def per_question_answer_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.per_question(*_reports(spark, sf_dir))


@query(f"with {_GIVEN}, pq as ({_PER_QUESTION}) select * from pq where answer_rate < 1 order by answer_rate, canonical_id limit 10")
def low_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.low_rates(report.per_question(*_reports(spark, sf_dir)))


_VARIANTS = """va as (select gf.cluster, question_text, count(distinct questionnaire) as used_by_count, string_agg(distinct questionnaire, '; ' order by questionnaire) as used_by from gf group by all),
 pe as (select cluster, count(distinct question_text) as n_variants, case when count(distinct norm) = 1 then 'formatting only' else 'substantive' end as drift_type from gf group by cluster having count(distinct question_text) > 1)"""


@query(f"with {_GIVEN}, {_VARIANTS} select 'CQ' || (cluster + 1) as canonical_id, canonical_text as Question, drift_type, n_variants, question_text as variant_text, used_by_count, used_by from va join pe using (cluster) join lab using (cluster)")
def question_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.question_changes(*_reports(spark, sf_dir, False))


@query(f"with {_GIVEN}, {_VARIANTS} select 'CQ' || (cluster + 1) as canonical_id, canonical_text as Question, n_variants from pe join lab using (cluster) where drift_type = 'substantive' order by cluster limit 8")
def substantive_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.substantive_clusters(report.question_changes(*_reports(spark, sf_dir, False)))


_STATUS = "st as (select cluster, questionnaire, arg_min(case when not is_blank then 'answered' when conditional then 'blank (optional)' else 'blank (missing)' end, ord) as status from gf group by all)"


@query(f"with {_GIVEN}, {_STATUS} select 'CQ' || (cluster + 1) as canonical_id, canonical_text, {', '.join(f'''coalesce(max(status) filter (questionnaire = '{b}'), '') as "{b}"''' for b in BRANDS)}, count(*) as present_in from st join lab using (cluster) group by cluster, canonical_text")
def coverage_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.coverage_matrix(*_reports(spark, sf_dir, False), names=BRANDS)


_PRESENCE = """select 'CQ' || (cluster + 1) as canonical_id, canonical_text, count(distinct questionnaire)::int as present_count, (select count(distinct questionnaire) from gf)::int - count(distinct questionnaire)::int as missing_count, string_agg(distinct questionnaire, '; ' order by questionnaire) as present_in,
 (select string_agg(q, '; ' order by q) from (select distinct questionnaire as q from gf) a where not exists (select 1 from gf b where b.cluster = gf.cluster and b.questionnaire = a.q)) as missing_from from gf join lab using (cluster) group by cluster, canonical_text having count(distinct questionnaire) < (select count(distinct questionnaire) from gf)"""


@query(f"with {_GIVEN} {_PRESENCE}")
def question_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.question_presence(*_reports(spark, sf_dir, False))


@query(f"with {_GIVEN}, pr as ({_PRESENCE}) select * from pr order by missing_count, canonical_id limit 10")
def top_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.top_gaps(report.question_presence(*_reports(spark, sf_dir, False)))


@query(f"with {_GIVEN}, cs as (select distinct cluster from gf), qs as (select distinct questionnaire from gf) select cluster, questionnaire from cs cross join qs where not exists (select 1 from gf where gf.cluster = cs.cluster and gf.questionnaire = qs.questionnaire)")
def missing_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.missing_pairs(given(spark, sf_dir, False))


@query(f"with {_GIVEN} select cluster, question_text, list_sort(list(distinct questionnaire))::varchar as users from gf group by all")
def variant_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.variant_users(given(spark, sf_dir, False)).withColumn("users", F.col("users").cast("string"))


@query(f"with {_given(_WHOLE)} select count(distinct questionnaire) as n_questionnaires, count(distinct case when is_blank and not conditional then questionnaire end) as n_lacking from g")
def distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.distinct_counts(given(spark, sf_dir, whole=True))


@query(f"""with {_GIVEN}, pe as (select cluster, count(distinct question_text) as texts, count(distinct norm) as forms, count(distinct questionnaire) as held from g group by cluster), t as (select count(distinct questionnaire) a, count(distinct cluster) b, count(*) c, count_if(not is_blank) d, count_if(is_blank) e, count_if(conditional) h, count_if(not conditional) r, count_if(not conditional and is_blank) i from g),
 v as (select unnest([{', '.join("'" + m.replace("'", "''") + "'" for m in report.OVERVIEW)}]) as metric, unnest([a::double, b, c, d, e, round(d::double / c, 4), round((r - i)::double / r, 4), h, i, (select count(*) from pe where texts > 1 and forms > 1), (select count(*) from pe where texts > 1 and forms = 1), (select count(*) from pe where held < a), 85, null]) as value_num from t)
 select metric, case when metric = 'cell legend' then '{_sql(report.LEGEND)}' when metric like '%rate%' then value_num::varchar else value_num::bigint::varchar end as value, value_num from v""")
def overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.overview(given(spark, sf_dir))


# --- Similarity and clusters.

_PAIRS = """pr as (select a.nm a, b.nm b, list_sort(list_distinct(string_split(a.nm, ' '))) ta, list_sort(list_distinct(string_split(b.nm, ' '))) tb from norms a join norms b on a.nm <= b.nm),
pq as (select a, b, array_to_string(list_sort(list_intersect(ta, tb)), ' ') si, array_to_string(list_sort(list_filter(ta, lambda x: not list_contains(tb, x))), ' ') x, array_to_string(list_sort(list_filter(tb, lambda x: not list_contains(ta, x))), ' ') y from pr),
xy as (select distinct x, y from pq where x <> '' and y <> ''),
dp as (select x, y, 0 k, list_resize([0], length(y) + 1, 0) r from xy union all
  select x, y, k + 1, list_reduce(range(1, length(y) + 1), lambda acc, j: list_append(acc, case when substr(y, j, 1) = substr(x, k + 1, 1) then r[j] + 1 else greatest(acc[-1], r[j + 1]) end), [0]) from dp where k < length(x)),
l as (select x, y, r[-1] lcs from dp where k = length(x)),
sc as (select a, b, case when a = '' or b = '' then 0.0 when si <> '' and (pq.x = '' or pq.y = '') then 100.0 else (
   select greatest(100 - 100.0::double * (length(pq.x) + length(pq.y) - 2 * lcs) / (2 * (s + g) + length(pq.x) + length(pq.y)),
     case when s = 0 then 0 else 100 - 100.0::double * (g + length(pq.x)) / (2 * s + g + length(pq.x)) end, case when s = 0 then 0 else 100 - 100.0::double * (g + length(pq.y)) / (2 * s + g + length(pq.y)) end) from (select length(si) s, (si <> '')::int g)) end score
  from pq left join l on pq.x = l.x and pq.y = l.y)"""


@query(f"with recursive {_LONG}, norms as (select distinct norm as nm from long), {_PAIRS} select a, b, round(score, 6) as score from sc")
def token_set_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    norms = fixtures.gaps_part(spark, sf_dir).select(T.norm_match("question_text").alias("nm")).distinct()
    pairs = norms.select(F.col("nm").alias("a")).join(norms.select(F.col("nm").alias("b")), F.col("a") <= F.col("b"))
    return pairs.select("a", "b", F.round(S.token_set_score(F.col("a"), F.col("b")), 6).alias("score"))


_CLUSTERS = f"""{_WHOLE}, items as (select row_number() over (order by n desc, length(t) desc, t) i, t, nm from (select question_text t, norm nm, count(*) n from long group by all)), norms as (select distinct nm from items), {_PAIRS},
s2 as (select a, b, score from sc union select b, a, score from sc),
mp as (select a, map_from_entries(list((b, score))) m from s2 group by a),
gr(i, seeds, cid, t) as (select 0::bigint, []::varchar[], -1::bigint, ''::varchar union all
  select n.i, case when z.s >= 85 then seeds else list_append(seeds, n.nm) end, case when z.s >= 85 then z.k - 1 else len(seeds) end, n.t
  from gr join (items join mp on mp.a = items.nm) n on n.i = gr.i + 1, lateral (select coalesce(max(v), -1) s, coalesce(list_position(list(v order by k), max(v)), 0) k from (select k, n.m[seeds[k]] v from range(1, len(seeds) + 1) u(k))) z)"""


@query(f"with recursive {_CLUSTERS} select t as question_text, cid::int as cluster from gr where i > 0")
def cluster_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.cluster_texts(fixtures.long_part(spark, sf_dir), 85).select("question_text", "cluster")


@query(f"""with recursive {_CLUSTERS}, gg as (select long.*, cid as cluster from long join gr on gr.t = question_text and gr.i > 0),
tx as (select cluster, question_text, count(*) as freq, min(ord) as first from gg group by all),
lab as (select cluster, arg_max(question_text, row(freq, (question_text = {_strip("question_text")} and not regexp_matches(question_text, '{_WS}{{2,}}'))::int, length(regexp_replace(question_text, '[^\\p{{Lu}}]', '', 'g')), length(question_text), -first)) as canonical_text from tx group by cluster),
au as (select gg.*, canonical_text, {_norm("canonical_text")} as cn from gg join lab using (cluster))
select 'CQ' || (cluster + 1) as canonical_id, canonical_text, questionnaire, file_name, sheet, question_id, question_text, round(m[cn], 1) as match_to_canonical, answer, is_blank, conditional from au join mp on mp.a = au.norm""")
def clusters_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = cluster.with_clusters(fixtures.long_part(spark, sf_dir), 85)
    return report.clusters_audit(long, report.canonical_labels(long))


@query()
def comparison_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.view(spark, sf_dir, fixtures.LONG_PART, "part").select("ord", "file_name", "sheet", F.col("question").alias("prompt"), "answer", F.when(F.col("ord") % 10 == 0, "Option A").alias("option_label"))
    return cluster.cluster_rows(rows, 80).select("ord", "group", "seed_ord", "match_score")


# --- Comparison.

_HITS = f"""lp as ({fixtures.LONG_PART}), h as (select file_name, sheet, substr(question_id, 2)::int - 1 as grp, count(*) as n_hits, arg_min(concat_ws(' - ', case when ord % 10 = 0 then 'Option A' end, {_strip("question")}), ord) as question, arg_min(case when ord % 6 = 0 then case when {_strip("answer")} = '' then 'YES' else 'YES - ' || {_strip("answer")} end else {_strip("answer")} end, ord) as answer, arg_min((ord % 101)::int, ord) as match_score from lp group by all)"""


def _grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.view(spark, sf_dir, fixtures.LONG_PART, "part")
    return rows.select("ord", "file_name", "sheet", F.col("question").alias("prompt"), "answer", F.when(F.col("ord") % 10 == 0, "Option A").alias("option_label"), F.when(F.col("ord") % 6 == 0, "YES").alias("side_answer"), (F.substr("question_id", F.lit(2)).cast("int") - 1).alias("group"), (F.col("ord") % 101).cast("int").alias("match_score"))


@query(f"with {_HITS} select file_name as \"Questionnaire\", sheet as \"Sheet\", " + ", ".join(f"coalesce(max(question) filter (grp = {g}), '') as \"Actual_Question Q{g + 1}\", coalesce(max(answer) filter (grp = {g}), '') as \"Q{g + 1} Answer\", max(match_score) filter (grp = {g}) as \"Q{g + 1} Match Percentage\"" for g in range(SIZES)) + " from h group by all")
def comparison_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.pivot_to_wide(_grouped(spark, sf_dir), list(range(SIZES)))


@query(f'with {_HITS} select file_name, sheet, grp as "group", n_hits from h where n_hits > 1')
def duplicate_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.duplicate_hits(_grouped(spark, sf_dir))


# --- Windows and items.

_WINDOWS = f"""wc as ({fixtures.WINDOWS_CONV}), ws as (select sheet, n_pages, unnest(case when n_pages <= 2 then [1] else range(1, n_pages) end) as s from wc where n_pages > 0), wi as (select sheet, n_pages, row_number() over (partition by sheet order by s) - 1 as window_no, s, case when n_pages = 1 then [1] else [s, s + 1] end as pages from ws)"""
_ITEMS = f"""{_WINDOWS}, tu as (select conv_id as sheet, (turn + 1)::int as page, role, text from conversations),
it as (select wi.sheet, 'Q' || u.page as question_id, u.text as question, case when u.page % 3 = 0 then substr(h, 1, 20) else h end as answer, pages, window_no from (select wi.*, u.page, u.text, case when list_contains(wi.pages, u.page + 1) then coalesce(a.text, '') else '' end as h from wi join tu u on u.sheet = wi.sheet and u.role = 'user' and list_contains(wi.pages, u.page) left join tu a on a.sheet = u.sheet and a.page = u.page + 1 and a.role = 'assistant') wi join tu u on u.sheet = wi.sheet and u.page = wi.page and u.role = 'user'),
dd as (select sheet, question_id, arg_max(question, row((answer <> '')::int, length(question) + length(answer), -window_no)) as question, arg_max(answer, row((answer <> '')::int, length(question) + length(answer), -window_no)) as answer, list_sort(list_distinct(flatten(list(pages)))) as source_pages from it group by all)"""


@query(f"with {_WINDOWS} select sheet, n_pages, window_no::int as window_no, pages::varchar as pages from wi")
def page_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.page_windows(fixtures.view(spark, sf_dir, fixtures.WINDOWS_CONV, "conversations"))
    return out.withColumn("pages", F.col("pages").cast("string"))


@query(f"with {_ITEMS} select sheet, question_id, question, answer, source_pages::varchar as source_pages, 'llm' as answer_source from dd")
def dedupe_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.in_question_order(windows.dedupe_by_id(fixtures.items_conv(spark, sf_dir)))
    return out.select("sheet", "question_id", "question", "answer", F.col("source_pages").cast("string").alias("source_pages"), "answer_source")


_RECONCILED = f"""{_ITEMS}, tr as (select a.sheet, 'Q' || (a.page - 1) as question_id, a.text as truth from tu a join tu u on u.sheet = a.sheet and u.page = a.page - 1 and u.role = 'user' where a.role = 'assistant'),
rc as (select dd.* exclude (answer), case when cut then truth else answer end as answer, case when cut then 'xlsx_reconciled' else 'llm' end as answer_source from (select dd.*, truth, coalesce(answer <> '' and starts_with({_fold(_collapse("truth"))}, {_fold(_collapse("answer"))}) and length({_fold(_collapse("truth"))}) > length({_fold(_collapse("answer"))}) + 5, false) as cut from dd left join tr using (sheet, question_id)) dd)"""


def _reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.reconcile(windows.dedupe_by_id(fixtures.items_conv(spark, sf_dir)), fixtures.truth_conv(spark, sf_dir))


@query(f"with {_RECONCILED} select '' as file_name, sheet, question_id, question, answer, answer_source, array_to_string(source_pages, ', ') as source_pages from rc")
def reconcile_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.flat_items(_reconciled(spark, sf_dir)).withColumn("sheet", F.col("sheet").cast("long"))


@query(f"""with {_RECONCILED}, fi as (select *, 'file' || (sheet // 20) as file_name from rc) select file_name, (row_number() over (partition by file_name order by sheet::varchar, substr(question_id, 2)::int, question_id) - 1)::int as place, sheet::varchar as sheet, question_id, question, answer, source_pages::varchar as source_pages, answer_source from fi""")
def nested_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON of each file, read again: its items in their order. Twenty conversations make a file."""
    rows = _reconciled(spark, sf_dir).withColumns({"file_name": F.concat(F.lit("file"), F.expr("sheet div 20").cast("string")), "sheet": F.col("sheet").cast("string")})
    item = "question_id:string,question:string,answer:string,source_pages:array<int>,answer_source:string,sheet:string"
    read_again = F.from_json("json", f"struct<file_name:string,questions:array<struct<{item}>>>")
    items = windows.nested_items(rows).select(read_again.alias("j")).select("j.file_name", F.posexplode("j.questions").alias("place", "q"))
    return items.select("file_name", "place", "q.*").withColumn("source_pages", F.col("source_pages").cast("string"))


@query(f"with {_RECONCILED} select count_if(answer_source = 'xlsx_reconciled')::bigint as n_substituted from rc")
def substitutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.substitutions(_reconciled(spark, sf_dir))


@query("select conv_id, count(*)::int as attempts, list_transform(range(1, count(*)), lambda i: 2.0::double * 2 ** (i - 1))::varchar as delays from conversations group by conv_id")
def retry_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).cast("int").alias("attempts"))
    return extract.retry_delays(turns).withColumn("delays", F.col("delays").cast("string"))


@query("select doc_id, 'data:image/png;base64,' || to_base64(encode(coalesce(text, ''))) as url from documents")
def image_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    png = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("png"))
    return png.select("doc_id", extract.image_url().alias("url"))


@query()
def page_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a grey image with a pixel for each byte, 256 to a row, downscaled to sides of 64 at most: its size and digest."""
    from .sources import png

    @F.pandas_udf("binary")
    def drawn(texts: pd.Series) -> pd.Series:
        def one(text):
            data = np.frombuffer((text or " ").encode() or b" ", np.uint8)
            return png.write_png(np.pad(data, (0, -len(data) % 256), constant_values=32).reshape(-1, 256, 1))

        return texts.map(one)

    @F.pandas_udf("width int, height int, pixels_sha256 string")
    def seen(images: pd.Series) -> pd.DataFrame:
        found = [png.read_png(bytes(x)) for x in images]
        return pd.DataFrame({"width": [x.shape[1] for x in found], "height": [x.shape[0] for x in found], "pixels_sha256": [hashlib.sha256(x.tobytes()).hexdigest() for x in found]})

    pages = read(spark, sf_dir, "documents").select("doc_id", drawn("text").alias("png"))
    return extract.fit_images(pages, 64).select("doc_id", seen("png").alias("s")).select("doc_id", "s.*")


# --- Grids.

_GRID = f"""gc as ({fixtures.GRID_CONV}), ce as (select sheet, row, col, {_strip("value")} as text, fill_rgb = '00D9D9D9' as slot, bold, font_size from gc), mt as (select * from ce where text <> '' or slot),
rk as (select sheet, row, coalesce(arg_min(bold and font_size >= 12 and text = upper(text) and not contains(text, 'ß') and text <> lower(text) and length(text) > 4, col), false) as is_header, arg_min(text, col) as lead, min(case when regexp_matches(text, '^Q\\p{{Nd}}+$') then col end) as q_col, arg_min(case when regexp_matches(text, '^Q\\p{{Nd}}+$') then text end, case when regexp_matches(text, '^Q\\p{{Nd}}+$') then col end) as qid from mt group by all),
kd as (select *, case when is_header then 'section' when q_col is not null then 'question' else 'content' end as kind from rk),
sg as (select *, sum((kind <> 'content')::int) over (partition by sheet order by row) as segment, coalesce(last_value(case when kind = 'section' then lead end ignore nulls) over (partition by sheet order by row), '') as section from kd),
op as (select *, max((kind = 'question')::int) over (partition by sheet, segment) = 1 as opened, max(case when kind = 'question' then qid end) over (partition by sheet, segment) as question_id from sg),
cb as (select op.*, col, text, slot and kind = 'content' as is_slot from op join mt using (sheet, row) where opened and kind <> 'section' and ((kind = 'question' and col > q_col and text <> '') or (kind = 'content' and col > 11))),
sb as (select *, coalesce(sum(is_slot::int) over (partition by sheet, segment order by row, col rows between unbounded preceding and 1 preceding), 0) as sub from cb),
fl as (select sheet, segment, section, question_id, sub, coalesce(string_agg(text, chr(10) order by row, col) filter (not is_slot), '') as prompt, coalesce(string_agg(text, chr(10) order by row, col) filter (is_slot and text <> ''), '') as answer, coalesce(max('N' || row) filter (is_slot), '') as answer_cell from sb group by all)"""


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.resolved_cells(fixtures.grid_conv(spark, sf_dir))


@query(f"with {_GRID} select sheet, row, kind, q_col, qid from kd")
def row_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.row_kinds(_resolved(spark, sf_dir)).select("sheet", "row", "kind", "q_col", "qid")


@query(f"with {_GRID} select sheet, section, question_id, (row_number() over (partition by sheet, segment order by sub) - 1)::int as sub_idx, prompt, answer, answer_cell from fl where prompt <> '' or answer <> '' or answer_cell <> ''")
def sub_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.sub_questions(_resolved(spark, sf_dir)).select("sheet", "section", "question_id", "sub_idx", "prompt", "answer", "answer_cell")


@query(f"with {_GRID} select sheet, segment::int as segment, question_id, list_sort(list(distinct row))::varchar as source_rows from op where opened and kind <> 'section' group by all")
def source_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.source_rows(_resolved(spark, sf_dir)).select("sheet", F.col("segment").cast("int").alias("segment"), "question_id", F.col("source_rows").cast("string").alias("source_rows"))


@query(f"with {_GRID}, sc as (select *, last_value(case when regexp_matches(text, '^Q\\p{{Nd}}+$') then text end ignore nulls) over (partition by sheet order by row, col) as question_id from ce) select 'conversations' as file_name, sheet, question_id, string_agg(text, chr(10) order by row, col) as answer from sc where question_id is not null and slot and text <> '' group by all")
def slot_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.slot_answers(fixtures.grid_conv(spark, sf_dir))


@query(f"with {_GRID} select sheet, 'A' || chr((col + 30 - 26 + 64)::int) as letters, row, text as value from mt where row % 2 = 1 and text <> ''")
def remarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid with every other row moved to the right, behind the band."""
    moved = fixtures.grid_conv(spark, sf_dir).withColumn("col", F.when(F.col("row") % 2 == 1, F.col("col") + 30).otherwise(F.col("col")))
    found = grid.remarks(grid.resolved_cells(moved))
    return found.select("sheet", F.regexp_extract("cell", "^([A-Z]+)", 1).alias("letters"), F.regexp_extract("cell", "([0-9]+)$", 1).cast("int").alias("row"), "value")


# Cell by cell: every column of every row in use, with the last merge and the last list over it.
_STYLED = f"""sc as ({fixtures.STYLED_PART}), sm as ({fixtures.STYLED_MERGES}), sl as ({fixtures.STYLED_LISTS}),
gr as (select sheet, row, c.c::int as col from (select distinct sheet, row from sc), range(1, 43) c(c)),
am as (select gr.sheet, gr.row, gr.col, arg_max(min_row, row(min_row, min_col)) as mr, arg_max(min_col, row(min_row, min_col)) as mc from gr join sm on sm.sheet = gr.sheet and gr.row between min_row and max_row and gr.col between min_col and max_col group by all),
an as (select sheet, row, col, coalesce(mr, row) as ar, coalesce(mc, col) as ac from gr left join am using (sheet, row, col)),
ol as (select gr.sheet, gr.row, gr.col, arg_max(trim(options, '"'), pos) as options from gr join sl on sl.sheet = gr.sheet and gr.row between min_row and max_row and gr.col between min_col and max_col group by all),
ef as (select an.*, value, {_strip("value")} as text, fill_rgb in ('00D9D9D9', '00FFFF00') as slot, fill_rgb = '00D9D9D9' as grey, bold, italic, font_size, value_type, coalesce(o.options, a.options) as options, col between 2 and 41 as content
  from an join (select sheet, row as ar, col as ac, * exclude (sheet, row, col) from sc) c using (sheet, ar, ac) left join ol o using (sheet, row, col) left join (select sheet, row as ar, col as ac, options from ol) a using (sheet, ar, ac)),
se as (select * from ef where text <> '' or slot qualify row_number() over (partition by sheet, ar, ac order by row, content desc, col) = 1),
cn as (select * from se where content),
sd as (select sheet, row, min(col) as side_col, arg_min(text, col) as side_text, arg_min(options, col) as side_options from ef where col between 2 and 11 and coalesce(value, '') <> '' and not (value_type in ('n', 'b') and text in ('0', '0.0', 'False')) and (options is not null or grey) group by all),
rk as (select sheet, row, coalesce(arg_min(bold and font_size >= 12 and text = upper(text) and text <> lower(text) and length(text) > 4, col), false) as is_header, arg_min(text, col) as lead, min(case when regexp_matches(text, '^Q\\p{{Nd}}+$') then col end) as q_col, arg_min(text, col) filter (regexp_matches(text, '^Q\\p{{Nd}}+$')) as qid, bool_or(col > 11 and slot) as has_slot, bool_or(col > 11 and not slot and text <> '') as has_text from cn group by all),
kd as (select rk.*, side_col, side_text, side_options, case when is_header then 'section' when q_col is not null then 'question' else 'content' end as kind, side_col is not null and not has_slot and has_text as branch from rk left join sd using (sheet, row)),
sg as (select *, sum((kind <> 'content')::int) over (partition by sheet order by row) as segment, coalesce(last_value(case when kind = 'section' then lead end ignore nulls) over (partition by sheet order by row), '') as section from kd),
op as (select *, max((kind = 'question')::int) over (partition by sheet, segment) = 1 as opened, max(case when kind = 'question' then qid end) over (partition by sheet, segment) as question_id from sg),
ev as (select sheet, segment, section, question_id, row, col as place, kind, branch, text, case when kind = 'question' then 'prompt' when slot then 'answer' when branch and not italic then 'option_label' when italic then 'hint' else 'prompt' end as role, chr(64 + ac) || ar as cell, null as options
    from op join cn using (sheet, row) where opened and kind <> 'section' and ((kind = 'question' and col > q_col and text <> '') or (kind = 'content' and col > 11))
  union all select sheet, segment, section, question_id, row, -1, kind, branch, side_text, 'side', chr(64 + side_col) || row, side_options from op where opened and kind <> 'section' and side_col is not null),
eb as (select *, (branch and kind = 'content' and row_number() over (partition by sheet, segment, row order by place) = 1)::int as begins, (role = 'answer' and kind = 'content')::int as is_slot from ev),
su as (select *, sum(begins) over (partition by sheet, segment order by row, place) + coalesce(sum(is_slot) over (partition by sheet, segment order by row, place rows between unbounded preceding and 1 preceding), 0) as sub from eb),
fl as (select sheet, segment, section, question_id, sub, {", ".join(f"coalesce(string_agg(text, chr(10) order by row, place) filter (role in ({roles}) and text <> ''), '') as {name}" for name, roles in (("option_label", "'option_label'"), ("prompt", "'prompt', 'hint'"), ("hint", "'hint'"), ("answer", "'answer'")))},
  coalesce(arg_max(cell, row(row, place)) filter (role = 'answer'), '') as answer_cell, {", ".join(f"coalesce(arg_max(coalesce({x}, ''), row) filter (role = 'side'), '') as {name}" for name, x in (("side_answer", "text"), ("side_answer_options", "options"), ("side_answer_cell", "cell")))} from su group by all)"""


def _styled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written once, as the grid's operators read it several times."""
    return cut(grid.resolved_cells(*fixtures.styled_part(spark, sf_dir)))


@query(f"with {_STYLED} select sheet, row, kind, qid, side_text as side, side_options as options, branch from kd")
def styled_row_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of sheets with merges, lists, side answers and branches."""
    return grid.row_kinds(_styled(spark, sf_dir)).select("sheet", "row", "kind", "qid", F.col("side.text").alias("side"), F.col("side.options").alias("options"), "branch")


@query(f"with {_STYLED} select sheet, section, question_id, (row_number() over (partition by sheet, segment order by sub) - 1)::int as sub_idx, option_label, prompt, hint, answer, answer_cell, side_answer, side_answer_options, side_answer_cell from fl where prompt <> '' or option_label <> '' or answer <> '' or side_answer <> '' or answer_cell <> ''")
def styled_sub_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = grid.sub_questions(_styled(spark, sf_dir), consolidate=False)
    return found.select("sheet", "section", "question_id", "sub_idx", "option_label", "prompt", "hint", "answer", "answer_cell", "side_answer", "side_answer_options", "side_answer_cell")


@query(f"with {_STYLED} select sheet, row, kind, null::varchar as cell, null::varchar as text from kd union all select sheet, row, 'REMARK', 'A' || chr(38 + col) || row, substr(text, 1, 60) from se where not content and col > 26 and text <> '' union all select sheet, row, 'REMARK', chr(64 + col) || row, substr(text, 1, 60) from se where not content and col < 27 and text <> ''")
def styled_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.trace(_styled(spark, sf_dir)).select("sheet", "row", "kind", "cell", "text")


_RANGES = "rg as (select 'f' as file_name, p_brand as sheet, (p_partkey * 4 + 1)::int as min_row, (p_partkey * 4 + 1 + p_size % 3)::int as max_row, 2::int as min_col, (2 + p_size % 5)::int as max_col, '\"' || p_type || ',' || p_name || '\"' as options, p_partkey as pos from part)"


def _ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    return read(spark, sf_dir, "part").select(F.lit("f").alias("file_name"), F.col("p_brand").alias("sheet"), (key * 4 + 1).cast("int").alias("min_row"), (key * 4 + 1 + size % 3).cast("int").alias("max_row"), F.lit(2).alias("min_col"), (size % 5 + 2).cast("int").alias("max_col"), F.concat(F.lit('"'), "p_type", F.lit(","), "p_name", F.lit('"')).alias("options"), key.alias("pos"))


@query(f"with {_RANGES} select file_name, sheet, r.r::int as row, c.c::int as col, min_row as anchor_row, min_col as anchor_col from rg, range(min_row, max_row + 1) r(r), range(min_col, max_col + 1) c(c)")
def merged_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.merged_cells(_ranges(spark, sf_dir))


@query(f"with {_RANGES} select file_name, sheet, r.r::int as row, c.c::int as col, arg_max(trim(options, '\"'), pos) as options from (select *, max_row + 2 as far from rg), range(min_row, far + 1) r(r), range(min_col, max_col + 1) c(c) group by all")
def dropdown_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.dropdown_cells(_ranges(spark, sf_dir).withColumn("max_row", F.col("max_row") + 2))


@query(f"with gc as ({fixtures.GRID_CONV}) select file_name, sheet, greatest(1, coalesce(max(row) filter ({_strip('value')} <> ''), 1)) as last_row from gc group by all")
def sheet_last_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.sheet_last_row(fixtures.grid_conv(spark, sf_dir))


@query(f"with {_RANGES}, me as (select file_name, sheet, r.r::int as row, c.c::int as col, p_name as text, options, pos from (select rg.*, p_name from rg join part on p_partkey = pos), range(min_row, max_row + 1) r(r), range(min_col, max_col + 1) c(c)) select file_name, sheet, row, col, text, case when pos % 3 > 0 then trim(options, '\"') end as options from me")
def effective_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cell of merged ranges shows its anchor's text. Lists stand on the odd rows of two ranges of three, the anchor's
    among them; the even rows show the anchor's."""
    ranges = _ranges(spark, sf_dir)
    anchors = ranges.join(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), "p_name"), "pos")
    cells = anchors.select("file_name", "sheet", F.col("min_row").alias("row"), F.col("min_col").alias("col"), F.col("p_name").alias("value"))
    odd = ranges.select("file_name", "sheet", F.explode(F.sequence("min_row", "max_row")).alias("min_row"), "min_col", "max_col", "options", "pos").where("min_row % 2 = 1 and pos % 3 > 0").withColumn("max_row", F.col("min_row"))
    every = grid.merged_cells(ranges).select("file_name", "sheet", "row", "col")  # a file holds them as cells without a value
    out = grid.resolved_cells(every.join(cells, ["file_name", "sheet", "row", "col"], "left"), ranges, odd)
    return out.select("file_name", "sheet", "row", "col", "text", "options")


@query(f"with {_RANGES}, op as (select sheet, min_row as segment, r.r::int as sub, case when r.r = 0 then 'Stem' when r.r = 1 and pos % 7 = 0 then 'Extra' else '' end as prompt, case when r.r > 0 then 'Option ' || r.r else '' end as option_label, case when r.r > 0 and pos % 5 > 0 then case when (pos + r.r) % 2 = 0 then ' yes' else 'NO' end else '' end as side_answer from rg, range(0, (pos % 4 + 1)::bigint) r(r)), f as (select sheet, segment, count(*) > 1 and bool_and(sub = 0 or prompt = '') and bool_or(side_answer <> '') as fits from op group by all) select sheet, segment, 0 as sub, 'Stem' as prompt, '' as option_label, coalesce(string_agg(option_label, ' | ' order by sub) filter (side_answer = ' yes'), '') as answer, '' as side_answer from op join f using (sheet, segment) where fits group by all union all select sheet, segment, sub, prompt, option_label, '', side_answer from op join f using (sheet, segment) where not fits")
def multi_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stems with up to three options; some options have prompts, some stems no side answers, and those stay apart."""
    rows = _ranges(spark, sf_dir).select("file_name", "sheet", F.col("min_row").alias("segment"), "pos", F.explode(F.sequence(F.lit(0), (F.col("pos") % 4).cast("int"))).alias("sub"))
    option, key, empty = F.col("sub") > 0, F.col("pos"), F.lit("")
    side = F.when(option & (key % 5 > 0), F.when((key + F.col("sub")) % 2 == 0, " yes").otherwise("NO")).otherwise("")
    prompt = F.when(~option, "Stem").when((F.col("sub") == 1) & (key % 7 == 0), "Extra").otherwise("")
    label = F.when(option, F.concat(F.lit("Option "), F.col("sub").cast("string"))).otherwise("")
    subs = rows.select("file_name", "sheet", "segment", empty.alias("section"), F.lit("Q1").alias("question_id"), "sub", label.alias("option_label"), prompt.alias("prompt"), *[empty.alias(c) for c in ("hint", "answer", "answer_cell")], side.alias("side_answer"), empty.alias("side_answer_options"), empty.alias("side_answer_cell"), F.array(F.struct("sub")).alias("blocks"))
    return grid.consolidate_multi_select(subs).select("sheet", "segment", "sub", "prompt", "option_label", "answer", "side_answer")


# --- Streams, over tables.


@query("""with e as (select time_bucket(interval '1 hour', ts) as window_start, event_type as questionnaire, value < 5 as is_blank from events) select window_start, questionnaire, count(*) as n_questions, count_if(not is_blank)::bigint as n_answered, round(count_if(not is_blank)::double / count(*), 4) as answer_rate from e group by all""")
def windowed_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("questionnaire"), (F.col("value") < 5).alias("is_blank"))
    return streaming.rates_stream(rows)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return per_questionnaire_missing(spark, sf_dir)

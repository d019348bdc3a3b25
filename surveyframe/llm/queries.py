"""The queries of this subpackage: production parameters, whole tables."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, chat, cuckoo, decontam, langid, licenses, packing, sharding, simhash, tokenfile, toxicity, whitening
from .common import remove, shared_dir

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.sql("select -7L as conv_id, id as turn, if(id = 0, 'user', 'assistant') as role, '</s>[INST] ok [/INST]' as text from range(0, 2, 1, 1)")
    return chat.digests(chat.format_conversations(rows.unionByName(probe)))


def categories() -> dict[str, Column]:
    """The chain, in its order, over the columns of ``labels``."""
    return {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")}


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chain = toxicity.train(docs, table(spark, sf_dir, "labels"), categories())
    return toxicity.predict(docs, chain).withColumn("toxic", F.col("p_toxic") >= 0.5)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = langid.learn(docs.where(~langid.held_out(F.col("doc_id"))))
    out = langid.identify(docs, profiles)
    return out.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.interleave(table(spark, sf_dir, "documents"), shards=16)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source", "position")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_classes(table(spark, sf_dir, "documents"), width=3)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cuckoo.exact_duplicates(table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.license_notices(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return marked.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), RANKS, pattern=public_tokenizers.PATTERN, with_ids=False)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    tokenfile.write_token_files(table(spark, sf_dir, "documents"), folder, lambda: tokenfile.word_tokenizer(WORD_BPE, 2))
    out = tokenfile.read_documents(spark, folder)
    remove(spark, folder)  # what was read lies in a checkpoint
    return out


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), k=4)


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), lambda: packing.sentence_tokenizer(BYTE_BPE, 1), size=2048, with_ids=False)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_documents(table(spark, sf_dir, "documents"), lambda: alignment.aligner(BYTE_BPE, PIECES))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": op1_chat_format,
    "op2_toxicity": op2_toxicity,
    "op3_language_id": op3_language_id,
    "op4_sharding": op4_sharding,
    "op5_simhash": op5_simhash,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_license_scan": op7_license_scan,
    "op8_decontamination": op8_decontamination,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_token_files": op10_token_files,
    "op11_whitening": op11_whitening,
    "op12_packing": op12_packing,
    "op13_token_alignment": op13_token_alignment,
}

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_MARKED = "|".join(re.escape(c[0]) + chat.MARK + "*" + re.escape(c[1:]) for c in sorted(chat.CONTROL, key=len, reverse=True))
#: Characters that the template writes for each turn, besides role and text.
_TURN_CHARS = len(chat.compile_template(chat.TEMPLATE)(messages=[{"role": "", "content": ""}])[0])

ORACLES: dict[str, str] = {
    "op1_chat_format": f"""
        with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
          union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        g as (select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text) as turns,
          coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '') as loss,
          sum({_TURN_CHARS} + length(role) + length(text) + len(regexp_extract_all(role, '{_MARKED}')) + len(regexp_extract_all(text, '{_MARKED}')))::bigint as formatted_chars from c group by conv_id)
        select conv_id, n_turns, sha256(turns) as turns_sha256, length(loss) as loss_chars, sha256(loss) as loss_sha256, formatted_chars from g
    """,
    "op8_decontamination": f"""
        with dw as (select row_number() over () as r, doc_id, {_WORDS} as w from documents),
        bw as (select item_id::varchar as item, {_WORDS} as w from benchmark),
        win as (select distinct item, array_to_string(w[i:i + 9], ' ') as g, len(w[i:i + 9]) as n from (select item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) as i from bw where len(w) > 0)),
        sizes as (select distinct n from win),
        pos as (select r, i, n, array_to_string(w[i:i + n - 1], ' ') as g from (select r, w, n, unnest(range(1, len(w) - n + 2)) as i from dw cross join sizes where len(w) >= n)),
        hits as (select pos.r, pos.i, pos.n, win.item from pos join win using (g, n)),
        hw as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + n)) as p from hits) group by r),
        hi as (select r, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as items from hits group by r)
        select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
        from dw left join hw using (r) left join hi using (r)
    """,
    "op6_exact_dedup": """
        with d as (select doc_id, coalesce(text, '') as t, row_number() over (partition by doc_id, coalesce(text, '')) as nth from documents),
        g as (select t, max(doc_id) as keep_id, count(*) as group_size from d group by t)
        select d.doc_id, g.keep_id, g.group_size, (d.doc_id is not distinct from g.keep_id and d.nth = 1) as kept, sha256(d.t) as text_sha256
        from d join g on d.t = g.t
    """,
}

"""Views of general tables as questionnaires, and the demo grid. The SQL runs in Spark and elsewhere alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import longframe

#: Brands are files, types are sheets; drift in form, conditional texts and blanks are planted by the key.
LONG_PART = """
    SELECT p_partkey AS ord, p_brand AS file_name, p_type AS sheet, concat('Q', CAST(p_size AS STRING)) AS question_id,
      CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN concat('Q', CAST(p_size AS STRING), '. ', upper(p_name)) WHEN 2 THEN concat(p_name, '?')
        WHEN 3 THEN concat('  ', p_name, ' (if any)') ELSE replace(p_name, ' ', '  ') END AS question,
      CASE WHEN p_partkey % 4 = 0 THEN '' WHEN p_partkey % 9 = 0 THEN 'N/A' ELSE concat('size ', CAST(p_size AS STRING)) END AS answer
    FROM part"""
#: The same without the questions that a brand lacks, for reports on gaps.
GAPS_PART = f"{LONG_PART} WHERE (CAST(substr(p_brand, 7) AS INT) * 3 + ascii(p_name) + length(p_name)) % 7 <> 0"
#: Conversations are sheets, turns are rows; a system turn is a section, a user turn a question, an assistant's a slot.
GRID_CONV = """
    SELECT 'conversations' AS file_name, CAST(conv_id AS STRING) AS sheet, CAST(turn + 1 AS INT) AS row, 12 AS col, concat('Q', CAST(turn + 1 AS STRING)) AS value, '00000000' AS fill_rgb, false AS bold, CAST(11 AS DOUBLE) AS font_size
    FROM conversations WHERE role = 'user'
    UNION ALL
    SELECT 'conversations', CAST(conv_id AS STRING), CAST(turn + 1 AS INT), 14, CASE WHEN role = 'system' THEN replace(upper(replace(text, 'ß', '~~')), '~~', 'ß') ELSE text END,
      CASE WHEN role = 'assistant' THEN '00D9D9D9' ELSE '00000000' END, role = 'system', CAST(CASE WHEN role = 'system' THEN 14 ELSE 11 END AS DOUBLE)
    FROM conversations"""
#: Brands are sheets; a part makes up to three of six rows: a section, questions with hints, slots and side answers, branches, merges
#: down and across, remarks. The anchor of a side answer's merge may lie left of the content.
STYLED_PART = """
    WITH p AS (SELECT p_partkey AS k, p_brand AS sheet, CAST(p_partkey * 6 AS INT) AS b, p_partkey % 8 AS t, p_name AS n, p_type AS y, p_size AS z FROM part)
    SELECT 'parts' AS file_name, sheet, b AS row, 14 AS col, CASE WHEN t = 0 THEN upper(n) ELSE n END AS value, CASE WHEN t = 4 THEN '00C6EFCE' ELSE '00000000' END AS fill_rgb, t = 0 AS bold, false AS italic, CAST(CASE WHEN t = 0 THEN 14 ELSE 11 END AS DOUBLE) AS font_size, 's' AS value_type FROM p WHERE t <> 7
    UNION ALL SELECT 'parts', sheet, b, 12, concat('Q', CAST(k AS STRING)), '00000000', false, false, CAST(11 AS DOUBLE), 's' FROM p WHERE t IN (1, 2, 3, 5)
    UNION ALL SELECT 'parts', sheet, b + 1, 14, y, '00000000', false, t < 3, CAST(11 AS DOUBLE), 's' FROM p WHERE t IN (1, 2, 4, 6)
    UNION ALL SELECT 'parts', sheet, b + 2, 14, CASE WHEN t = 4 OR k % 3 = 0 THEN CAST(NULL AS STRING) ELSE concat('a ', CAST(z AS STRING)) END, CASE WHEN t = 5 THEN '00FFFF00' ELSE '00D9D9D9' END, false, false, CAST(11 AS DOUBLE), 's' FROM p WHERE t IN (1, 2, 4, 5)
    UNION ALL SELECT 'parts', sheet, b + 1, 14, concat('a ', CAST(z AS STRING)), '00D9D9D9', false, false, CAST(11 AS DOUBLE), 's' FROM p WHERE t IN (3, 7)
    UNION ALL SELECT 'parts', sheet, b, 20, concat('b ', CAST(z AS STRING)), '00D9D9D9', false, false, CAST(11 AS DOUBLE), 's' FROM p WHERE t = 6
    UNION ALL SELECT 'parts', sheet, b, CASE WHEN t = 2 THEN 1 ELSE 2 END, CASE WHEN k % 2 = 0 THEN 'YES' ELSE 'NO' END, '00D9D9D9', false, false, CAST(11 AS DOUBLE), 's' FROM p WHERE t IN (2, 3, 4, 6)
    UNION ALL SELECT 'parts', sheet, b, 3, '0', '00000000', false, false, CAST(11 AS DOUBLE), CASE WHEN k % 3 = 0 THEN 'n' ELSE 's' END FROM p WHERE t = 7
    UNION ALL SELECT 'parts', sheet, b, 14, y, '00000000', false, false, CAST(11 AS DOUBLE), 's' FROM p WHERE t = 7
    UNION ALL SELECT 'parts', sheet, b, 42, concat('note ', n), '00000000', false, false, CAST(11 AS DOUBLE), 's' FROM p WHERE t = 5"""
STYLED_MERGES = """
    WITH p AS (SELECT p_brand AS sheet, CAST(p_partkey * 6 AS INT) AS b, p_partkey % 8 AS t FROM part)
    SELECT 'parts' AS file_name, sheet, b AS min_row, CASE WHEN t = 5 THEN b + 1 ELSE b END AS max_row, 14 AS min_col, 29 AS max_col FROM p WHERE t IN (1, 2, 3, 5)
    UNION ALL SELECT 'parts', sheet, b, b + 1, 12, 12 FROM p WHERE t = 5
    UNION ALL SELECT 'parts', sheet, b, CASE WHEN t = 6 THEN b + 1 ELSE b END, CASE WHEN t = 2 THEN 1 ELSE 2 END, 7 FROM p WHERE t IN (2, 3, 4, 6)"""
#: A list on a whole column of each sheet, and later ones on single ranges.
STYLED_LISTS = """
    WITH p AS (SELECT p_brand AS sheet, p_partkey AS k, CAST(p_partkey * 6 AS INT) AS b, p_partkey % 8 AS t FROM part)
    SELECT DISTINCT 'parts' AS file_name, sheet, 1 AS min_row, 1048576 AS max_row, 2 AS min_col, 2 AS max_col, '"ANY"' AS options, CAST(-1 AS BIGINT) AS pos FROM p
    UNION ALL SELECT 'parts', sheet, b, b, CASE WHEN t = 7 THEN 3 ELSE 2 END, CASE WHEN t = 7 THEN 3 ELSE 7 END, CASE WHEN t = 7 THEN '"0,1"' ELSE '"YES,NO"' END, CAST(k AS BIGINT) FROM p WHERE t IN (3, 4, 7)"""
WINDOWS_CONV = "SELECT conv_id AS sheet, CAST(max(turn) + 1 AS INT) AS n_pages FROM conversations GROUP BY conv_id"


def view(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    """``sql`` over parquet tables of a folder."""
    for t in tables:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


def long_part(spark: SparkSession, sf_dir: str, by_sheet: bool = True) -> DataFrame:
    return longframe.load_long([view(spark, sf_dir, LONG_PART, "part")], by_sheet)


def gaps_part(spark: SparkSession, sf_dir: str, by_sheet: bool = True) -> DataFrame:
    return longframe.load_long([view(spark, sf_dir, GAPS_PART, "part")], by_sheet)


def grid_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, GRID_CONV, "conversations").withColumns({"italic": F.lit(False), "fill_type": F.lit("rgb")})


def styled_part(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cells, merges, dropdowns)."""
    cells, merges, lists = (view(spark, sf_dir, sql, "part") for sql in (STYLED_PART, STYLED_MERGES, STYLED_LISTS))
    return cells.withColumn("fill_type", F.lit("rgb")), merges, lists


def items_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn in every window of two pages that holds it; the answer is the next turn if the window holds it, and
    every third one is cut after 20 characters."""
    from .operators import windows

    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").alias("sheet"), (F.col("turn") + 1).cast("int").alias("page"), "role", "text")
    spans = windows.page_windows(view(spark, sf_dir, WINDOWS_CONV, "conversations")).select("sheet", "window_no", "pages")
    asked = turns.where("role = 'user'").join(spans, "sheet").where(F.array_contains("pages", F.col("page")))
    replies = turns.where("role = 'assistant'").select("sheet", (F.col("page") - 1).alias("page"), F.col("text").alias("reply"))
    rows = asked.join(replies, ["sheet", "page"], "left")
    held = F.when(F.array_contains("pages", F.col("page") + 1), F.coalesce("reply", F.lit(""))).otherwise("")
    answer = F.when(F.col("page") % 3 == 0, F.substr(held, F.lit(1), F.lit(20))).otherwise(held)
    return rows.select("sheet", F.concat(F.lit("Q"), F.col("page").cast("string")).alias("question_id"), F.col("text").alias("question"), answer.alias("answer"), F.col("pages").alias("source_pages"), F.lit("llm").alias("answer_source"), F.col("window_no").cast("long").alias("arrival"))


def truth_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sheet, question_id and the whole answer of each user turn that has one."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    replies = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return turns.where("role = 'user'").join(replies, ["conv_id", "turn"]).select(F.col("conv_id").alias("sheet"), F.concat(F.lit("Q"), (F.col("turn") + 1).cast("string")).alias("question_id"), "answer")


# The demo questionnaire's cells (row, cell letters, text, style).
DEMO = [
    (2, "N", "ORGANISATION, BUSINESS DESCRIPTION & EXPERIENCE", "header"),
    (4, "L", "Q1", ""), (4, "N", "Firm Full Legal Name and Address", ""), (5, "N", "Acme Bank (Hong Kong) Limited", "grey"),
    (7, "L", "Q2", ""), (7, "N", "Regulatory Authority", ""), (8, "N", "SFC, Monetary Authority of Singapore etc.", "italic"), (9, "N", "SFC & HKMA", "grey"),
    (10, "AP", "External reviewer note: please verify Q1 address.", ""),
    (11, "L", "Q3", ""), (11, "N", "Relevant Authorised Activities", ""), (12, "N", "For HK, please specify license type", "italic"), (13, "N", "Type 1 & Type 4", "grey"),
    (14, "N", "For Singapore, please specify license type", "italic"), (15, "N", "N/A", "grey"),
    (17, "L", "Q4", ""), (17, "N", "Economic data (If available: number of staff, AUM, ...)", ""), (18, "N", "Approx no of employees: 500, AUM: HK$ eqv 80 billion", "grey"),
    (20, "N", "PRODUCT APPROVAL PROCESS", "header"),
    (22, "B", "YES", "grey"), (22, "L", "Q5", ""), (22, "N", "a) Has your firm adopted a product approval process with respect to structured products?", "green"), (23, "N", "Yes", "grey"),
    (24, "N", "b) Does each structured product go through the same approval process?", ""), (25, "N", "Yes, each structured product type will go through the same approval process.", "grey"),
    (25, "AQ", "Internal flag: Q6 answer needs follow-up.", ""),
    (27, "L", "Q6", ""), (27, "N", "What are the key features reviewed in the product approval process for structured products?", ""), (28, "N", "This includes but not limited to: features", "italic"), (29, "N", "Product Control Committee reviews them", "yellow"),
    (31, "N", "DISTRIBUTION CHANNEL", "header"),
    (33, "L", "Q7", ""), (33, "N", "In which capacity will your firm act as distributor?", ""), (34, "B", "YES", "grey"), (34, "N", "Settling distributor", "green"), (35, "N", "Who is the custodian?", ""), (36, "N", None, "grey"),
    (37, "B", "NO", "grey"), (37, "N", "Non-settling distributor", ""), (38, "N", "Who is the custodian?", ""), (39, "N", "PERSHING LLC", "grey"), (40, "N", "Is this PtP set up? i.e you act as principal rather than agent.", ""), (41, "N", None, "grey"),
]
_FILLS = {"grey": "00D9D9D9", "green": "00C6EFCE", "yellow": "00FFFF00"}
SHEET = "Questionnaire HK"


def demo_grid(spark: SparkSession, file_name: str = "demo.xlsx") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cells, merges, dropdowns) of the demo: texts merged over N:AC, side answers over B:G with a list."""
    from .functions.text import column_number

    cells = [(file_name, SHEET, r, column_number(c), v, _FILLS.get(s), "rgb" if s in _FILLS else None, s == "header", s == "italic", 14.0 if s == "header" else 11.0) for r, c, v, s in DEMO]
    spans = {"N": (14, 29), "B": (2, 7)}
    merges = [(file_name, SHEET, r, r, *spans[c]) for r, c, _, _ in DEMO if c in spans]
    lists = [(file_name, SHEET, r, r, 2, 7, '"YES,NO"', k) for k, (r, c, _, _) in enumerate(DEMO) if c == "B"]
    return (
        spark.createDataFrame(cells, "file_name string, sheet string, row int, col int, value string, fill_rgb string, fill_type string, bold boolean, italic boolean, font_size double"),
        spark.createDataFrame(merges, "file_name string, sheet string, min_row int, max_row int, min_col int, max_col int"),
        spark.createDataFrame(lists, "file_name string, sheet string, min_row int, max_row int, min_col int, max_col int, options string, pos int"),
    )

"""From a styled cell grid to sub-questions, as windows over cells.

Input ``cells``: file_name, sheet, row, col, value, fill_rgb, fill_type, bold, italic, font_size, and value_type (n for numbers, b for
booleans, any other is text). ``merges``: file_name,
sheet, min_row, max_row, min_col, max_col. ``dropdowns``: the same with options, pos. Columns B to AO are content, B to K
side answers, those right of K the main part; the rest is remarks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .longframe import PARSED_COLUMNS
from .ranges import KEY, entry_cells, located

FIRST, LAST = T.column_number("B"), T.column_number("AO")
SIDE_LAST = T.column_number("K")
#: Binary logarithm of the rows of a band, by which ranges are dealt before their cells are made.
BAND = 6

_STYLE = {"fill_rgb": "string", "fill_type": "string", "bold": "boolean", "italic": "boolean", "font_size": "double", "value_type": "string"}


def _cells_of(ranges: DataFrame, last: Column) -> DataFrame:
    """KEY, row, col of every cell of the ranges, and what ``last`` takes of those over it as ``of``.

    Ranges are dealt by bands of rows, of which most touch one, and cells are made and sorted behind that shuffle. So what a task
    holds is its share of the cells, whatever part of the ranges it has read. Small bands would be put together again
    by what they take compressed, which says little about their cells; hence a number of partitions.
    """
    low, high = F.least("min_row", "max_row"), F.greatest("min_row", "max_row")
    first = F.call_function("shiftleft", F.col("band"), F.lit(BAND))
    bands = ranges.withColumn("band", F.explode(F.sequence(F.call_function("shiftright", low, F.lit(BAND)), F.call_function("shiftright", high, F.lit(BAND)))))
    share = F.xxhash64(*KEY, "band").alias("share")  # one column, as one that is the same for all rows would be left out of the grouping
    dealt = bands.select("*", share).repartition(int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions")), "share")
    rows = dealt.withColumn("row", F.explode(F.sequence(F.greatest(low, first), F.least(high, first + (1 << BAND) - 1))))
    cells = rows.withColumn("col", F.explode(F.sequence("min_col", "max_col")))
    return cells.groupBy("share", *KEY, "row", "col").agg(last.alias("of"))


def merged_cells(merges: DataFrame) -> DataFrame:
    """file_name, sheet, row, col, anchor_row, anchor_col of every cell of every merged range; of overlapping ranges the
    one that starts last. A row for each cell: for ranges of some cells. ``ranges.located`` asks for cells instead."""
    last = F.max(F.struct(F.col("min_row").alias("anchor_row"), F.col("min_col").alias("anchor_col")))
    return _cells_of(merges.select(*KEY, "min_row", "max_row", "min_col", "max_col"), last).select(*KEY, "row", "col", "of.anchor_row", "of.anchor_col")


def dropdown_cells(dropdowns: DataFrame) -> DataFrame:
    """file_name, sheet, row, col, options of every cell with a list; a later rule replaces an earlier one. A row for each cell, as
    above."""
    spans = dropdowns.select(*KEY, "min_row", "max_row", "min_col", "max_col", F.btrim("options", F.lit('"')).alias("options"), "pos")
    return _cells_of(spans, F.max_by("options", "pos")).select(*KEY, "row", "col", F.col("of").alias("options"))


def resolved_cells(cells: DataFrame, merges: DataFrame | None = None, dropdowns: DataFrame | None = None) -> DataFrame:
    """``cells`` with anchor_row, anchor_col, the anchor's text, fill and style, and options (the cell's own, else the anchor's).

    Files may leave out cells inside a merged range; those at which a reader meets the range are there too, in rows in use.
    Ranges are joined by bands of rows, so their size costs nothing.
    """
    base = cells.select(*KEY, "row", "col", "value", *[F.col(c) if c in cells.columns else F.lit(None).cast(k).alias(c) for c, k in _STYLE.items()])
    if "fill_type" not in cells.columns:
        base = base.withColumn("fill_type", F.lit("rgb"))
    if merges is not None:
        held = F.struct("value", *_STYLE)
        at = [F.coalesce(f"anchor_{c}", c).alias(f"anchor_{c}") for c in ("row", "col")]
        points = base.select(*KEY, "row", "col", held.alias("own")).unionByName(entry_cells(cells, merges, dropdowns, FIRST, SIDE_LAST), allowMissingColumns=True)
        points = located(points, merges, dropdowns)
        points = points.select(*KEY, "row", "col", "own", *at, *(["options"] if dropdowns is not None else []))
        starts = located(merges.select(*KEY, F.col("min_row").alias("row"), F.col("min_col").alias("col")).distinct(), None, dropdowns)
        starts = starts.join(base.select(*KEY, "row", "col", held.alias("of_anchor")), [*KEY, "row", "col"], "left").withColumnsRenamed({"row": "anchor_row", "col": "anchor_col", "options": "of_options"})
        base = points.join(starts, [*KEY, "anchor_row", "anchor_col"], "left").withColumns({c: F.coalesce(f"of_anchor.{c}", f"own.{c}") for c in ("value", *_STYLE)})
        if dropdowns is not None:
            base = base.withColumn("options", F.coalesce("options", "of_options")).drop("of_options")
        base = base.drop("own", "of_anchor")
    else:
        base = located(base, None, dropdowns).withColumns({"anchor_row": F.col("row"), "anchor_col": F.col("col")})
    if dropdowns is None:
        base = base.withColumn("options", F.lit(None).cast("string"))
    text = F.coalesce(T.strip("value"), F.lit(""))
    return base.withColumns({"text": text, "fill": T.fill_class("fill_rgb", "fill_type")}).withColumns({"bold": F.coalesce("bold", F.lit(False)), "italic": F.coalesce("italic", F.lit(False))})


def is_slot(fill: Column) -> Column:
    """An answer belongs here: grey or yellow."""
    return fill.isin("grey", "yellow")


def seen_cells(resolved: DataFrame) -> DataFrame:
    """Cells as a reader meets them: each anchor once, the content band before the rest of its row. Empty cells without a
    fill aren't met at all."""
    band = F.col("col").between(FIRST, LAST)
    met = resolved.where((F.col("text") != "") | is_slot(F.col("fill"))).withColumn("content", band)
    order = Window.partitionBy(*KEY, "anchor_row", "anchor_col").orderBy("row", F.desc("content"), "col")
    return met.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth").where(F.col("content") | (F.col("text") != ""))


def row_kinds(resolved: DataFrame) -> DataFrame:
    """For each row with content: kind (section, question, content), q_col, qid, section text, side answer and branch flags."""
    content = seen_cells(resolved).where("content")
    header = T.is_section_header("text", "bold", "font_size")
    per = content.groupBy(*KEY, "row").agg(
        F.min_by(F.struct(header.alias("is_header"), F.col("text").alias("text")), "col").alias("lead"),
        F.min(F.when(T.question_id("text").isNotNull(), F.struct("col", T.question_id("text").alias("qid")))).alias("q"),
        F.bool_or((F.col("col") > SIDE_LAST) & is_slot(F.col("fill"))).alias("has_slot"), F.bool_or((F.col("col") > SIDE_LAST) & ~is_slot(F.col("fill")) & (F.col("text") != "")).alias("has_text"),
    )
    # Side answers look at what a cell shows, met before or not; the number zero and false are no answers, their texts are.
    zero = F.coalesce(F.col("value_type").isin("n", "b"), F.lit(False)) & F.col("text").isin("0", "0.0", "False")
    truthy = (F.coalesce("value", F.lit("")) != "") & ~zero
    side = resolved.where(F.col("col").between(FIRST, SIDE_LAST) & truthy & (F.col("options").isNotNull() | (F.col("fill") == "grey")))
    sides = side.groupBy(*KEY, "row").agg(F.min(F.struct("col", "text", "options")).alias("side"))
    kind = F.when(F.col("lead.is_header"), "section").when(F.col("q").isNotNull(), "question").otherwise("content")
    rows = per.join(sides, [*KEY, "row"], "left")
    branch = F.col("side").isNotNull() & ~F.col("has_slot") & F.col("has_text")
    return rows.select(*KEY, "row", kind.alias("kind"), F.col("q.col").alias("q_col"), F.col("q.qid").alias("qid"), F.col("lead.text").alias("lead"), "side", branch.alias("branch"))


def trace(resolved: DataFrame) -> DataFrame:
    """What a run that explains itself says: file_name, sheet, row, kind, cell, text. A line for each row with content (section,
    question, content) and one for each remark (REMARK), with up to 60 characters of its text; rows without either are empty and say
    nothing."""
    none = F.lit(None).cast("string")
    kinds = row_kinds(resolved).select(*KEY, "row", "kind", none.alias("cell"), none.alias("text"))
    notes = seen_cells(resolved).where("not content").select(*KEY, "row", F.lit("REMARK").alias("kind"), coordinate("row", "col").alias("cell"), F.substr("text", F.lit(1), F.lit(60)).alias("text"))
    return kinds.unionByName(notes)


def question_rows(kinds: DataFrame) -> DataFrame:
    """``kinds`` with segment (a running number that a question or section row raises), question_id, section and opened
    (whether a question row opened the segment)."""
    order = Window.partitionBy(*KEY).orderBy("row")
    is_section, is_q = F.col("kind") == "section", F.col("kind") == "question"
    rows = kinds.withColumns({"segment": F.sum((is_section | is_q).cast("int")).over(order), "section": F.coalesce(F.last(F.when(is_section, F.col("lead")), ignorenulls=True).over(order), F.lit(""))})
    part = Window.partitionBy(*KEY, "segment")
    return rows.withColumns({"opened": F.max(is_q.cast("int")).over(part) == 1, "question_id": F.max(F.when(is_q, F.col("qid"))).over(part)})


def content_blocks(resolved: DataFrame) -> DataFrame:
    """The cells of opened segments with their sub-question (a running number) and role.

    A new sub-question begins with a branch row and behind each answer slot of a content row.
    """
    rows = question_rows(row_kinds(resolved)).where("opened and kind <> 'section'")
    cells = seen_cells(resolved).where("content").join(rows, [*KEY, "row"])
    on_q = F.col("kind") == "question"
    usable = (on_q & (F.col("col") > F.col("q_col")) & (F.col("text") != "")) | (~on_q & (F.col("col") > SIDE_LAST))
    role = F.when(on_q, "prompt").when(is_slot(F.col("fill")), "answer").when(F.col("branch") & ~F.col("italic"), "option_label").when(F.col("italic"), "hint").otherwise("prompt")
    cells = cells.where(usable).withColumns({"role": role, "place": F.col("col")})
    columns = [*KEY, "segment", "section", "question_id", "row", "place", "kind", "role", "text", "fill", "bold", "italic", "anchor_row", "anchor_col", "branch"]
    # The side answer of a row comes before its cells, behind the row's own branch.
    none = F.lit(None)
    sides = rows.where("side is not null and (kind = 'question' or kind = 'content')").select(
        *KEY, "segment", "section", "question_id", "row", F.lit(-1).alias("place"), "kind", F.lit("side").alias("role"), F.col("side.text").alias("text"), none.cast("string").alias("fill"),
        F.lit(False).alias("bold"), F.lit(False).alias("italic"), F.col("row").alias("anchor_row"), F.col("side.col").alias("anchor_col"), "branch", F.col("side.options").alias("options"),
    )
    events = cells.select(*columns, none.cast("string").alias("options")).unionByName(sides)
    order = Window.partitionBy(*KEY, "segment").orderBy("row", "place")
    begins = (F.col("branch") & (F.col("kind") == "content") & (F.row_number().over(Window.partitionBy(*KEY, "segment", "row").orderBy("place")) == 1)).cast("int")
    slot = ((F.col("role") == "answer") & (F.col("kind") == "content")).cast("int")
    events = events.withColumns({"begins": begins, "slot": slot})
    before = F.coalesce(F.sum("slot").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return events.withColumn("sub", (F.sum("begins").over(order) + before).cast("int")).drop("begins", "slot")


def _lines(role: str | tuple[str, ...]) -> Column:
    roles = (role,) if isinstance(role, str) else role
    found = F.collect_list(F.when(F.col("role").isin(*roles) & (F.col("text") != ""), F.struct("row", "place", "text")))
    return F.array_join(F.transform(F.array_sort(found), lambda x: x["text"]), "\n")


def coordinate(row: Column | str, col: Column | str) -> Column:
    return F.concat(T.column_letters(col), (F.col(row) if isinstance(row, str) else row).cast("string"))


def sub_questions(resolved: DataFrame, consolidate: bool = True) -> DataFrame:
    """The flat table of sub-questions, with blocks and source_rows: one row for each, sub_idx from 0 in its question."""
    blocks = content_blocks(resolved)
    last_side = F.max(F.when(F.col("role") == "side", F.struct("row", "text", "options", coordinate("anchor_row", "anchor_col").alias("cell")))).alias("side")
    last_slot = F.max(F.when(F.col("role") == "answer", F.struct("row", "place", coordinate("anchor_row", "anchor_col").alias("cell")))).alias("slot")
    block = F.when(F.col("role") != "side", F.struct("row", "place", "text", coordinate("anchor_row", "anchor_col").alias("cell"), "italic", "bold", "fill", "role"))
    subs = blocks.groupBy(*KEY, "segment", "section", "question_id", "sub").agg(
        _lines("option_label").alias("option_label"), _lines(("prompt", "hint")).alias("prompt"), _lines("hint").alias("hint"), _lines("answer").alias("answer"),
        last_slot, last_side, F.array_sort(F.collect_list(block)).alias("blocks"),
    )
    empty = F.lit("")
    subs = subs.select(
        *KEY, "segment", "section", "question_id", "sub", "option_label", "prompt", "hint", "answer", F.coalesce("slot.cell", empty).alias("answer_cell"),
        F.coalesce("side.text", empty).alias("side_answer"), F.coalesce("side.options", empty).alias("side_answer_options"), F.coalesce("side.cell", empty).alias("side_answer_cell"), "blocks",
    )
    subs = subs.where("prompt <> '' or option_label <> '' or answer <> '' or side_answer <> '' or answer_cell <> ''")
    if consolidate:
        subs = consolidate_multi_select(subs)
    order = Window.partitionBy(*KEY, "segment").orderBy("sub")
    rows = subs.withColumn("sub_idx", F.row_number().over(order) - 1)
    return rows.select(*PARSED_COLUMNS[:4], "sub_idx", *PARSED_COLUMNS[5:], "segment", "blocks")


def consolidate_multi_select(subs: DataFrame) -> DataFrame:
    """A stem followed by bare options, some with a side answer, becomes one row whose answer lists the options ticked YES."""
    part = Window.partitionBy(*KEY, "segment")
    is_stem = F.col("sub") == F.min("sub").over(part)
    bare = (F.col("option_label") != "") & (F.col("prompt") == "") & (F.col("answer") == "") & (F.col("answer_cell") == "")
    stem = (F.col("prompt") != "") & (F.col("option_label") == "") & (F.col("side_answer") == "") & (F.col("answer") == "") & (F.col("answer_cell") == "")
    fits = (F.count(F.lit(1)).over(part) > 1) & F.min(F.when(is_stem, stem).otherwise(bare)).over(part) & F.max(~is_stem & (F.col("side_answer") != "")).over(part)
    marked = subs.withColumns({"stem": is_stem, "fits": fits})
    ticked = F.when(~F.col("stem") & (F.upper(T.strip("side_answer")) == "YES"), F.struct("sub", "option_label"))
    one = marked.where("fits").groupBy(*KEY, "segment", "section", "question_id").agg(
        F.min("sub").alias("sub"), F.min_by("prompt", "sub").alias("prompt"), F.min_by("hint", "sub").alias("hint"),
        F.array_join(F.transform(F.array_sort(F.collect_list(ticked)), lambda x: x["option_label"]), " | ").alias("answer"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("sub", "blocks"))), lambda x: x["blocks"])).alias("blocks"),
    )
    one = one.withColumns({c: F.lit("") for c in ("option_label", "answer_cell", "side_answer", "side_answer_options", "side_answer_cell")})
    return marked.where("not fits").drop("stem", "fits").unionByName(one.select(subs.columns))


def source_rows(resolved: DataFrame) -> DataFrame:
    """The rows with content of each question, its own row included."""
    rows = question_rows(row_kinds(resolved)).where("opened and kind <> 'section'")
    return rows.groupBy(*KEY, "segment", "question_id").agg(F.array_sort(F.collect_set("row")).alias("source_rows"))


def remarks(resolved: DataFrame) -> DataFrame:
    """Texts outside the content band: file_name, sheet, cell, value."""
    return seen_cells(resolved).where("not content").select(*KEY, coordinate("row", "col").alias("cell"), F.col("text").alias("value"))


def slot_answers(cells: DataFrame, merges: DataFrame | None = None) -> DataFrame:
    """file_name, sheet, question_id, answer: the filled texts of the band under the question id last met in scan order.

    Ids count in the order of cells, so a filled cell left of its row's id belongs to the question before.
    """
    resolved = resolved_cells(cells, merges).where(F.col("col").between(FIRST, LAST))
    once = Window.partitionBy(*KEY, "anchor_row", "anchor_col").orderBy("row", "col")
    met = resolved.withColumn("nth", F.row_number().over(once)).where("nth = 1").withColumn("qid", T.question_id("text"))
    order = Window.partitionBy(*KEY).orderBy("row", "col")
    held = met.withColumn("question_id", F.last("qid", ignorenulls=True).over(order)).where(F.col("question_id").isNotNull() & F.col("qid").isNull() & is_slot(F.col("fill")) & (F.col("text") != ""))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "col", "text"))), lambda x: x["text"]), "\n")
    return held.groupBy(*KEY, "question_id").agg(lines.alias("answer"))


def nested_sheets(flat: DataFrame, notes: DataFrame, rows: DataFrame) -> DataFrame:
    """One JSON text for each file: by sheet its questions, with sub-questions, blocks and source rows, and its remarks."""
    parts = ["option_label", "prompt", "hint", "answer", "answer_cell", "side_answer", "side_answer_options", "side_answer_cell"]
    blocks = F.transform("blocks", lambda b: F.struct(*[b[c].alias(c) for c in ("text", "cell", "italic", "bold", "fill", "role")]))
    sub = F.struct("sub_idx", F.struct(*parts, blocks.alias("blocks")).alias("sub"))
    subs = flat.groupBy(*KEY, "segment", "section", "question_id").agg(F.transform(F.array_sort(F.collect_list(sub)), lambda x: x["sub"]).alias("sub_questions"))
    held = subs.join(rows.select(*KEY, "segment", "source_rows"), [*KEY, "segment"], "left")
    question = F.struct("segment", F.struct("section", "question_id", "sub_questions", "source_rows").alias("q"))
    questions = held.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(question)), lambda x: x["q"]).alias("questions"))
    per_notes = notes.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("cell", "value"))).alias("remarks"))
    sheet = F.struct("sheet", F.struct("questions", "remarks").alias("payload"))
    files = questions.join(per_notes, KEY, "full").groupBy("file_name").agg(F.array_sort(F.collect_list(sheet)).alias("sheets"))
    return files.select("file_name", F.to_json(F.map_from_entries("sheets")).alias("json"))


def sheet_last_row(cells: DataFrame) -> DataFrame:
    """The last row with anything in it, at least 1."""
    filled = F.max(F.when(~T.is_blank("value"), F.col("row")))
    return cells.groupBy(*KEY).agg(F.greatest(F.lit(1), F.coalesce(filled, F.lit(1))).alias("last_row"))

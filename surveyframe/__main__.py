"""python -m surveyframe parse|extract|compare|analyse TARGET: the runs from a command line."""

from __future__ import annotations

import argparse
import importlib
import json
import sys
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import plans
from .operators import grid, windows
from .sources import extract, xlsx
from .sources.named_files import write_named
from .storage import cut


# The flags, their choices and defaults.
def _arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="surveyframe")
    runs = parser.add_subparsers(dest="run", required=True)
    parse = runs.add_parser("parse", help="styled workbooks to sub-questions")
    parse.add_argument("target")
    parse.add_argument("output", nargs="?", default="./output")
    parse.add_argument("--debug", action="store_true", help="also write each row's kind")
    extract = runs.add_parser("extract", help="rendered pages to questions, by an extractor of yours")
    extract.add_argument("target")
    extract.add_argument("--output-dir", default="./output")
    extract.add_argument("--extractor", required=True, help="module:function that makes an extractor")
    extract.add_argument("--renderer", required=True, help="module:function that makes a renderer")
    extract.add_argument("--dpi", type=int, default=200)
    extract.add_argument("--window", type=int, default=2)
    extract.add_argument("--stride", type=int, default=1)
    extract.add_argument("--keep-pngs", action="store_true")
    extract.add_argument("--max-attempts", type=int, default=4)
    compare = runs.add_parser("compare", help="parsed workbooks side by side")
    compare.add_argument("input", nargs="?", default="./output")
    compare.add_argument("-o", "--output")
    compare.add_argument("--threshold", type=int, default=80)
    analyse = runs.add_parser("analyse", help="parsed workbooks to a report")
    analyse.add_argument("input")
    analyse.add_argument("-o", "--output")
    analyse.add_argument("--threshold", type=int, default=85)
    analyse.add_argument("--id-by", choices=["file", "file+sheet"], default="file+sheet")
    analyse.add_argument("--conditional-regex", action="append", default=[])
    analyse.add_argument("--treat-as-blank", default="", help="placeholders, separated by commas")
    return parser


def _made(name: str):
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def main(argv: list[str] | None = None) -> int:
    a = _arguments().parse_args(argv)
    spark = SparkSession.builder.appName(f"surveyframe {a.run}").getOrCreate()
    target = (a.input if a.run in ("compare", "analyse") else a.target).rstrip("/")
    folder = xlsx.is_folder(spark, target)
    if folder is None:
        print(f"{target} is not there", file=sys.stderr)
        return 1
    parent, _, last = target.rpartition("/")
    stem = last if folder else last.rpartition(".")[0] or last
    dated = lambda kind="": f"{stem}{kind}_{date.today().isoformat()}" if folder else stem
    if a.run in ("parse", "extract"):
        files = xlsx.list_files(spark, target, "parse" if a.run == "parse" else "pages")
        if files.isEmpty():
            print(f"no workbooks in {target}", file=sys.stderr)
            return 1
    if a.run == "parse":
        tables = plans.parse_files(spark, target)
        _write_json(tables["json"], a.output)
        if a.debug:
            grid.trace(tables["cells"]).write.mode("overwrite").parquet(f"{a.output}/row_kinds")
        xlsx.write_workbook({"questions": tables["sub_questions"].withColumn("file_name", _stem()).select(*grid.PARSED_COLUMNS)}, f"{a.output}/{dated()}.xlsx")
    elif a.run == "extract":
        pages = cut(extract.render_pages(files, _made(a.renderer), a.dpi))
        for r in pages.where("error is not null").toLocalIterator():
            print(f"{r.file_name}: {r.error}", file=sys.stderr)
        done = pages.where("png is not null")
        if done.isEmpty():
            print("no file gave a page", file=sys.stderr)
            return 2
        if a.keep_pngs:
            extract.write_pages(pages, f"{a.output_dir}/pages")
        parts = cut(xlsx.read_parts(files.where(~F.lower("file_name").endswith(".pdf")), skip_broken=True))
        truth = grid.slot_answers(xlsx.cells_of(parts), xlsx.merges_of(parts))
        items = cut(plans.extract_items(done, _made(a.extractor), a.window, a.stride, truth, a.max_attempts))
        named = windows.in_question_order(items.withColumn("file_name", _stem()))
        empty = done.select(_stem().alias("file_name")).distinct().join(named.select("file_name").distinct(), "file_name", "left_anti")
        nothing = empty.select("file_name", F.to_json(F.struct("file_name", F.array().alias("questions"))).alias("json"))
        _write_json(windows.nested_items(named).unionByName(nothing), a.output_dir)
        xlsx.write_workbook({"questions": windows.flat_items(named)}, f"{a.output_dir}/{dated('_pdf')}.xlsx")
    elif a.run == "compare":
        plans.compare_files(spark, a.input, a.output or f"{target if folder else parent or '.'}/questionnaire_comparison.xlsx", a.threshold)
    else:
        blank = [x.strip() for x in a.treat_as_blank.split(",") if x.strip()]
        output = a.output or f"{target if folder else parent or '.'}/{stem}_analysis.xlsx"
        tables = plans.analyse_files(spark, a.input, output, a.threshold, a.id_by == "file+sheet", blank, a.conditional_regex)
        print("\n".join(plans.digest(tables)))
    return 0


def _stem() -> Column:
    """The file's name without its last ending."""
    return F.regexp_replace("file_name", r"(?<=.)\.[^.]*$", "")


def _write_json(files: DataFrame, folder: str) -> None:
    """A file for each row (file_name, json)."""

    def shown(rows):
        for frame in rows:
            yield frame.assign(content=[json.dumps(json.loads(j), indent=2, ensure_ascii=False) for j in frame["content"]])

    named = files.select(F.concat(_stem(), F.lit(".json")).alias("name"), F.col("json").alias("content"))
    write_named(named.mapInPandas(shown, "name string, content string"), folder)


if __name__ == "__main__":
    sys.exit(main())

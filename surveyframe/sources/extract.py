"""Hooks to what lies outside Spark: renderers of pages and extractors of questions, called on partitions.

Neither a spreadsheet program, a page renderer nor a language model is part of this library. A run gives functions that
make them; each partition makes its own once. ``stub_extractor`` stands in for a model in tests.
"""

from __future__ import annotations

import base64
import heapq
import json
import time
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.windows import place_keys

ATTEMPTS, BASE_DELAY = 4, 2.0
#: Pixels of an image's longer side.
MAX_SIDE = 2000
ITEMS = "array<struct<question_id:string,question:string,answer:string>>"
PROMPT = "Return every question on these pages as a JSON list of objects with question_id, question and answer. Copy texts as they stand; leave the answer empty where there is none."
#: (images, page numbers) to a JSON list.
Extractor = Callable[[list[bytes], list[int]], str]


def retry(fn: Callable, attempts: int = ATTEMPTS, base_delay: float = BASE_DELAY, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """Calls again after any exception, with a delay that doubles; the last one is raised."""

    def run(*args):
        for n in range(1, attempts + 1):
            try:
                return fn(*args)
            except Exception:
                if n == attempts:
                    raise
                sleep(base_delay * 2 ** (n - 1))

    return run


def in_flight(fn: Callable, jobs: Iterable[tuple], attempts: int = ATTEMPTS, base_delay: float = BASE_DELAY, at_once: int = 8, clock: Callable[[], float] = time.monotonic) -> Iterator[tuple[object, str | None]]:
    """(result, error) of each job's call, in the jobs' order, with up to ``at_once`` calls under way.

    Calls that fail are due again after a delay that doubles, as with ``retry``; until then others go on in their place. A job that
    fails every attempt has its last error and no result. Jobs are taken as places become free, and at most four times as
    many are held as calls may be under way.
    """
    left, done, due, running = enumerate(jobs), {}, [], {}
    taken = given = 0
    with ThreadPoolExecutor(at_once) as pool:
        while True:
            while taken - given < 4 * at_once and len(due) + len(running) < 2 * at_once and (job := next(left, None)) is not None:
                heapq.heappush(due, (clock(), job[0], 1, job[1]))
                taken += 1
            while due and len(running) < at_once and due[0][0] <= clock():
                _, n, attempt, args = heapq.heappop(due)
                running[pool.submit(fn, *args)] = (n, attempt, args)
            if not due and not running and given == taken:
                return
            pause = max(0.0, due[0][0] - clock()) if due and len(running) < at_once else None
            if running:
                ended, _ = wait(running, timeout=pause, return_when=FIRST_COMPLETED)
            else:
                time.sleep(pause or 0)
                ended = ()
            for call in ended:
                n, attempt, args = running.pop(call)
                if (error := call.exception()) is None:
                    done[n] = (call.result(), None)
                elif attempt == attempts or not isinstance(error, Exception):
                    done[n] = (None, str(error))
                else:
                    heapq.heappush(due, (clock() + base_delay * 2 ** (attempt - 1), n, attempt + 1, args))
            while given in done:
                yield done.pop(given)
                given += 1


def retry_delays(df: DataFrame, attempts: str = "attempts", base: float = BASE_DELAY) -> DataFrame:
    """``df`` with delays, the pauses before each further attempt."""
    n = F.col(attempts).cast("int")
    delays = F.when(n < 2, F.array().cast("array<double>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.lit(base) * F.pow(F.lit(2.0), i - 1)))
    return df.withColumn("delays", delays)


def render_pages(files: DataFrame, make_renderer: Callable[[], Callable[[bytes, int], list[bytes]]], dpi: int = 200) -> DataFrame:
    """file_name, sheet, page_no, png, error: the pages of each file, counted from 1 on each sheet.

    A renderer gives images, or pairs of sheet and image for a workbook; without a sheet it is the file's stem. A file that
    can't be rendered gives one row with its error.
    """

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        renderer = make_renderer()
        for frame in frames:
            for name, data in zip(frame["file_name"], frame["content"], strict=True):
                try:
                    rows, count = [], Counter()
                    for page in renderer(bytes(data), dpi):
                        sheet, png = page if isinstance(page, tuple) else (name.rpartition(".")[0] or name, page)
                        count[sheet] += 1
                        rows.append((name, sheet, count[sheet], png, None))
                except Exception as e:
                    rows = [(name, None, None, None, str(e))]
                yield pd.DataFrame(rows, columns=["file_name", "sheet", "page_no", "png", "error"]).astype({"page_no": "Int32"})

    return files.select("file_name", "content").mapInPandas(run, "file_name string, sheet string, page_no int, png binary, error string")


def write_pages(pages: DataFrame, folder: str) -> None:
    """Page images as files page_001.png and so on in a folder of each file's and sheet's name."""
    from .named_files import write_named

    name = F.format_string("%s/%s/page_%03d.png", "file_name", "sheet", "page_no")
    write_named(pages.where("png is not null").select(name.alias("name"), F.col("png").alias("content")), folder)


def fit_images(pages: DataFrame, max_side: int = MAX_SIDE, png: str = "png") -> DataFrame:
    """``pages`` with images no side of which is longer than ``max_side``. What isn't a PNG image stays as it is."""
    from .png import fitted

    @F.pandas_udf("binary")
    def fit(column: pd.Series) -> pd.Series:
        def one(data):
            try:
                return None if data is None else fitted(bytes(data), max_side)
            except ValueError:
                return bytes(data)

        return column.map(one)

    return pages.withColumn(png, fit(png))


def image_url(png: str = "png"):
    """A data URL of an image's bytes."""
    return F.concat(F.lit("data:image/png;base64,"), F.regexp_replace(F.base64(png), "[\r\n]", ""))


def extract_windows(windows: DataFrame, make_extractor: Callable[[], Extractor], attempts: int = ATTEMPTS, base_delay: float = BASE_DELAY, at_once: int = 8) -> DataFrame:
    """sheet, window_no, pages, response, error, of rows (sheet, window_no, pages, images array<binary>), with file_name if
    they have one. A window that fails every attempt has an error and no response; the others go on. A task keeps ``at_once`` calls
    under way, so an extractor has to bear calls from several threads, or ``at_once`` be 1."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = make_extractor()
        for frame in frames:
            jobs = (([bytes(i) for i in images], [int(p) for p in pages]) for pages, images in zip(frame["pages"], frame["images"], strict=True))
            out = list(in_flight(call, jobs, attempts, base_delay, at_once))
            frame["response"], frame["error"] = [o[0] for o in out], [o[1] for o in out]
            yield frame[[*keys, "window_no", "pages", "response", "error"]]

    keys = place_keys(windows)
    kinds = "".join(f"{k} {windows.schema[k].dataType.simpleString()}, " for k in keys)
    return windows.select(*keys, "window_no", "pages", "images").mapInPandas(run, f"{kinds}window_no int, pages array<int>, response string, error string")


def response_items(responses: DataFrame) -> DataFrame:
    """file_name if there is one, sheet, question_id, question, answer, source_pages, answer_source, arrival of the items in the responses; texts are
    stripped, items without an id dropped. arrival orders by window, then place in the response."""
    keys = place_keys(responses)
    items = responses.where("response is not null").select(*keys, "window_no", "pages", F.posexplode(F.from_json("response", ITEMS)).alias("place", "item"))
    clean = {c: F.coalesce(T.strip(F.col(f"item.{c}")), F.lit("")) for c in ("question_id", "question", "answer")}
    rows = items.withColumns(clean).where("question_id <> ''")
    return rows.select(*keys, "question_id", "question", "answer", F.col("pages").alias("source_pages"), F.lit("llm").alias("answer_source"), (F.col("window_no").cast("long") * (1 << 20) + F.col("place")).alias("arrival"))


def prompted(model: Callable[[str, list[str]], str], prompt: str = PROMPT) -> Extractor:
    """An extractor of a model that takes a prompt and the data URLs of images."""

    def run(images: list[bytes], pages: list[int]) -> str:
        urls = ["data:image/png;base64," + base64.b64encode(i).decode() for i in images]
        return model(f"{prompt}\nPages: {', '.join(map(str, pages))}.", urls)

    return run


def stub_extractor(images: list[bytes], pages: list[int]) -> str:
    """Each image is a JSON list of items; a stand-in for a model."""
    return json.dumps([item for image in images for item in json.loads(image)])


def decode_image_url(url: str) -> bytes:
    return base64.b64decode(url.partition(",")[2])

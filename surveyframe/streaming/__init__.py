"""The same over streams: late partial extractions within a watermark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.windows import completeness, place_keys


def dedupe_stream(items: DataFrame, time: str = "ts", late: str = "10 minutes", width: str = "10 minutes") -> DataFrame:
    """Of the items of one question within a time window the most complete, and all its pages; rows later than ``late`` are
    dropped. Works on a stream (append mode) and on a table."""
    best = F.struct(completeness(F.col("question"), F.col("answer")).alias("c"), (-F.col("arrival")).alias("early"))
    rows = items.withWatermark(time, late) if items.isStreaming else items
    grouped = rows.groupBy(F.window(time, width).alias("w"), "sheet", "question_id")
    kept = grouped.agg(F.max_by(F.struct("question", "answer"), best).alias("kept"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("source_pages")))).alias("source_pages"))
    return kept.select(F.col("w.start").alias("window_start"), "sheet", "question_id", "kept.question", "kept.answer", "source_pages")


def rates_stream(long: DataFrame, time: str = "ts", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Answer rate of each questionnaire in tumbling windows."""
    rows = long.withWatermark(time, late) if long.isStreaming else long
    counts = rows.groupBy(F.window(time, width).alias("w"), "questionnaire").agg(F.count(F.lit(1)).alias("n_questions"), F.count_if(~F.col("is_blank")).alias("n_answered"))
    return counts.select(F.col("w.start").alias("window_start"), "questionnaire", "n_questions", "n_answered", F.round(F.col("n_answered") / F.col("n_questions"), 4).alias("answer_rate"))


ITEM = "question string, answer string, answer_source string, arrival long, source_pages array<int>"
#: The state of a question lies in a store that keeps more keys than fit into memory.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _BestItem(StatefulProcessor):
    """The state of one question: its best item and its pages, until none of its items has come for ``idle`` milliseconds of
    event time."""

    def __init__(self, keys: list[str], time: str, idle: int):
        self.keys, self.time, self.idle = keys, time, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getValueState("best", "question string, answer string, answer_source string, arrival long")
        self.pages = handle.getValueState("pages", "pages array<int>")
        self.due = handle.getValueState("due", "at long")

    def _rank(self, item: tuple) -> tuple:
        question, answer, _, arrival = item
        return (answer or "") != "", len(question or "") + len(answer or ""), -arrival

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        old = best = self.best.get() if self.best.exists() else None
        known = list(self.pages.get()[0]) if self.pages.exists() else []
        pages, latest = set(known), 0
        for frame in rows:
            for r in frame.to_dict("records"):
                item = (r["question"], r["answer"], r["answer_source"], int(r["arrival"]))
                if best is None or self._rank(item) > self._rank(tuple(best)):
                    best = item
                pages |= {int(p) for p in (r["source_pages"] if r["source_pages"] is not None else ())}
                latest = max(latest, int(r[self.time].timestamp() * 1000))
        due = self.due.get()[0] if self.due.exists() else None
        if due is None or latest + self.idle > due:
            if due is not None:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(latest + self.idle)
            self.due.update((latest + self.idle,))
        if best is not None and (old is None or tuple(best) != tuple(old) or len(pages) > len(known)):
            self.best.update(tuple(best))
            self.pages.update((sorted(pages),))
            yield pd.DataFrame([(*key, *best, sorted(pages))], columns=[*self.keys, "question", "answer", "answer_source", "arrival", "source_pages"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (self.best, self.pages, self.due):
            state.clear()
        return iter([])

    def close(self) -> None:
        pass


def dedupe_updates(items: DataFrame, time: str = "ts", late: str = "10 minutes", idle: str = "1 hour") -> DataFrame:
    """Over a stream: each question's best item so far and all its pages, again whenever a piece betters it or adds a page (update mode).

    Unlike ``dedupe_stream`` there are no windows, so pieces on either side of an edge make one item. A question's state is held per
    key and ends when no piece has come for ``idle`` of event time; one that comes after that begins a new item. Needs the state
    store ``STATE_STORE``.
    """
    keys = [*place_keys(items), "question_id"]
    kinds = ", ".join(f"{k} {items.schema[k].dataType.simpleString()}" for k in keys)
    rows = items.withWatermark(time, late).select(*keys, time, "question", "answer", "answer_source", F.col("arrival").cast("long").alias("arrival"), "source_pages")
    wait = int(pd.Timedelta(idle).total_seconds() * 1000)
    return rows.groupBy(*keys).transformWithStateInPandas(statefulProcessor=_BestItem(keys, time, wait), outputStructType=f"{kinds}, {ITEM}", outputMode="Update", timeMode="EventTime")

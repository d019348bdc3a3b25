from __future__ import annotations

from datetime import datetime, timedelta

import pytest

from surveyframe import streaming
from surveyframe.operators import windows

SCHEMA = "ts timestamp, sheet string, question_id string, question string, answer string, answer_source string, arrival long, source_pages array<int>"
START = datetime(2024, 1, 1)


def piece(minute, qid, answer, arrival, pages, sheet="s"):
    return (START + timedelta(minutes=minute), sheet, qid, "Name", answer, "llm", arrival, pages)


@pytest.fixture
def stream(spark, tmp_path):
    """Runs a stream over batches, one for each file, and gives the rows of each batch; called again it goes on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streaming.STATE_STORE)
    written = [0]

    def run(batches):
        for rows in batches:
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"{written[0]:03d}"))
            written[0] += 1
        out = []
        items = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        found = streaming.dedupe_updates(items, late="5 minutes", idle="30 minutes")
        query = found.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).foreachBatch(lambda df, _: out.append(sorted((r.sheet, r.question_id, r.answer, r.source_pages) for r in df.collect()))).start()
        query.awaitTermination(120)
        return [rows for rows in out if rows]

    yield run
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_pieces_on_either_side_of_an_edge_make_one_item(stream):
    assert stream([
        [piece(9, "Q1", "", 1, [1, 2]), piece(9, "Q2", "x", 2, [1])],
        [piece(11, "Q1", "whole answer", 3, [2, 3])],  # another window of ten minutes
        [piece(12, "Q1", "cut", 4, [3])],  # neither better nor a new page: no update
        [piece(12, "Q1", "cut", 5, [9])],
    ]) == [[("s", "Q1", "", [1, 2]), ("s", "Q2", "x", [1])], [("s", "Q1", "whole answer", [1, 2, 3])], [("s", "Q1", "whole answer", [1, 2, 3, 9])]]


def test_a_restart_goes_on_and_idle_state_ends(stream):
    assert stream([[piece(0, "Q1", "long answer", 1, [1])]]) == [[("s", "Q1", "long answer", [1])]]
    assert stream([[piece(10, "Q1", "short", 2, [2])]]) == [[("s", "Q1", "long answer", [1, 2])]]  # what was held before the restart
    later = stream([[piece(200, "Q2", "y", 3, [1])], [piece(210, "Q2", "y", 4, [1])], [piece(211, "Q1", "short", 5, [7])]])
    assert later == [[("s", "Q2", "y", [1])], [("s", "Q1", "short", [7])]]


def test_updates_end_where_the_table_form_does(spark, stream):
    rows = [piece(i % 4, f"Q{i % 5}", "a" * (i * 7 % 11), i, [i % 4, 9], f"s{i % 2}") for i in range(60)]
    last = {}
    for batch in stream([rows[i : i + 13] for i in range(0, 60, 13)]):
        last.update({r[:2]: r for r in batch})
    items = spark.createDataFrame(rows, SCHEMA)
    assert sorted(last.values()) == sorted((r.sheet, r.question_id, r.answer, r.source_pages) for r in windows.dedupe_by_id(items).collect())

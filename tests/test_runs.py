"""The stored run log and the drift between batches."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from caremeter.plans.batch import drift, run_batch
from caremeter.sources.store import LayerStore

SCHEMA = "id string, score double, note string"


@pytest.fixture
def store(spark, tmp_path):
    return LayerStore(spark, str(tmp_path))


def run(spark, store, day, **tables):
    builds = {t: (lambda rows=rows: spark.createDataFrame(rows, SCHEMA) if rows is not None else 1 / 0) for t, rows in tables.items()}
    return run_batch(spark, store, "silver", builds, "loaded_at", datetime(2024, 1, day))


def rows(n, score=1.0, note="x"):
    return [(str(i), score, note) for i in range(n)]


def test_counters_are_those_of_the_rows(spark, store):
    log = run(spark, store, 1, a=[("1", 1.0, " "), ("2", None, None), ("", 0.0, "x")], b=None).collect()
    by_table = {r.table_name: r for r in log}
    assert by_table["a"].filled == {"id": 2, "score": 2, "note": 1} and by_table["a"].row_count == 3
    assert by_table["b"].status == "failed" and by_table["b"].filled is None
    stored = {r.table_name: (r.status, r.row_count, r.filled) for r in store.runs("silver").collect()}
    assert stored == {t: (r.status, r.row_count, r.filled) for t, r in by_table.items()}


def test_drift_of_rows_and_of_a_column_that_turned_empty(spark, store):
    run(spark, store, 1, steady=rows(100), fewer=rows(100), emptied=rows(100), thinner=rows(100), once=None)
    first = drift(store.runs("silver"))
    assert first.collect() == []
    run(spark, store, 2, steady=rows(110), fewer=rows(70), emptied=rows(100, note=""),
        thinner=rows(60) + rows(40, score=None), once=rows(5))
    run(spark, store, 3, steady=None)           # a failed run is no batch
    run(spark, store, 1, steady=rows(1))        # nor is one that came too late
    found = {(r.table_name, r.column_name): r for r in drift(store.runs("silver")).collect()}
    assert {k for k, r in found.items() if r.drifted} == {("fewer", None), ("emptied", "note"), ("thinner", "score")}
    assert len(found) == 4 * 4
    note = found["emptied", "note"]
    assert (note.before, note.now) == (100, 0) and note.before_batch < note.now_batch
    assert (found["steady", None].before, found["steady", None].now) == (100, 110)


def test_new_and_gone_columns_and_empty_tables(spark, store):
    run(spark, store, 1, t=rows(10), none=[])
    run_batch(spark, store, "silver", {"t": lambda: spark.createDataFrame(rows(10), SCHEMA).withColumnRenamed("note", "remark"),
                                       "none": lambda: spark.createDataFrame([], SCHEMA)}, "loaded_at", datetime(2024, 1, 2))
    found = {(r.table_name, r.column_name): r.drifted for r in drift(store.runs("silver")).collect()}
    assert {k for k, v in found.items() if v} == {("t", "note"), ("t", "remark")}


def test_a_batch_run_again_counts_once(spark, store):
    run(spark, store, 1, t=rows(10))
    run(spark, store, 2, t=rows(10))
    run(spark, store, 2, t=rows(4))
    found = drift(store.runs("silver")).where(F.col("column_name").isNull()).collect()
    assert [(r.before, r.now, r.drifted) for r in found] == [(10, 4, True)]
    with pytest.raises(FileNotFoundError):
        store.runs("bronze")

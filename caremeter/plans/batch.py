"""Shared frame of the two loads: per-table isolation, one batch clock, one run log."""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window, functions as F

from caremeter.sources.store import LayerStore, StaleBatch

LOG_SCHEMA = ("layer string, table_name string, status string, row_count bigint, seconds double, error string, "
              "batch_id string, batch_start timestamp, batch_seconds double, filled map<string, bigint>")

KEPT = 2      # refreshes of a table that stay: the current one, and the one that running queries may still read


def filled(df: DataFrame) -> dict[str, Column]:
    """Aggregates for each column: the rows that hold something (neither NULL nor blank text)."""
    def held(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        return c.isNotNull() & (F.trim(c) != "") if kind == "string" else c.isNotNull()
    return {name: F.count_if(held(name, kind)) for name, kind in df.dtypes}


def run_batch(spark: SparkSession, store: LayerStore, layer: str, builds: dict[str, Callable[[], DataFrame]],
              audit: str, batch_ts: datetime | None = None, workers: int = 5) -> DataFrame:
    """Refresh every table of a layer; a failing table is logged and keeps its previous rows.

    Tables do not depend on each other, so their jobs are submitted side by side. Row counts come
    from an observation on the write itself, not from a second scan. Returns the run log; its status is
    ``ok``, ``failed`` (the previous rows stay) or ``stale`` (a newer batch is committed, nothing was written).
    """
    batch_ts = batch_ts or datetime.now(timezone.utc).replace(tzinfo=None)
    batch_id = batch_ts.strftime("%Y%m%dT%H%M%S%f")
    begin = time.monotonic()

    def refresh(item):
        table, build = item
        columns = None
        start, seen = time.monotonic(), Observation(f"{layer}_{table}_{batch_id}")
        try:
            df = build()
            names = dict(enumerate(df.columns))
            counts = [c.alias(f"c{i}") for i, c in enumerate(filled(df).values())]
            observed = df.withColumn(audit, F.lit(batch_ts)).observe(seen, F.count(F.lit(1)).alias("n"), *counts)
            store.write(layer, table, observed, batch_id)
            status, rows, error = "ok", seen.get["n"], None
            columns = {name: seen.get[f"c{i}"] for i, name in names.items()}
            store.drop_old(layer, table, keep=KEPT)
        except StaleBatch as exc:
            status, rows, error = "stale", None, str(exc)
        except Exception as exc:  # one bad table must not stop the others
            status, rows, error = "failed", None, str(exc)
        return (layer, table, status, rows, time.monotonic() - start, error), columns

    with ThreadPoolExecutor(max_workers=workers) as pool:
        done = list(pool.map(refresh, builds.items()))
    total = time.monotonic() - begin
    log = spark.createDataFrame([(*row, batch_id, batch_ts, total, columns) for row, columns in done], LOG_SCHEMA)
    store.log_run(layer, log.coalesce(1), batch_id)
    return log


def drift(runs: DataFrame, rows: float = 0.2, share: float = 0.2) -> DataFrame:
    """The newest committed batch of each table against the one before: what it holds, and whether that is expected.

    ``runs`` is the stored run log (``LayerStore.runs``). One row per table (``column_name`` NULL: its rows) and column
    (its filled rows) with ``before``, ``now`` and ``drifted``: rows changed by more than the fraction ``rows``, the filled
    share of a column by more than ``share``, or a column is empty, new or gone. Of several runs of one batch the last logged
    counts. Tables with one batch are left out; failed and stale runs are not batches.
    """
    last = Window.partitionBy("layer", "table_name", "batch_id").orderBy(F.desc("logged_at"))
    newest = Window.partitionBy("layer", "table_name").orderBy(F.desc("batch_id"))
    batches = (
        runs.where("status = 'ok'").withColumn("__run", F.row_number().over(last)).where("__run = 1")
        .withColumn("__age", F.row_number().over(newest)).where("__age <= 2")
        .groupBy("layer", "table_name").agg(*[
            F.max(F.when(F.col("__age") == age, F.struct("batch_id", "row_count", F.map_entries("filled").alias("filled")))).alias(name)
            for age, name in ((1, "n"), (2, "b"))])
        .where("b IS NOT NULL"))
    held = {side: F.map_from_entries(f"{side}.filled") for side in ("n", "b")}
    names = F.array_union(F.map_keys(held["n"]), F.map_keys(held["b"]))
    facts = batches.select(
        "layer", "table_name", F.col("b.batch_id").alias("before_batch"), F.col("n.batch_id").alias("now_batch"),
        F.col("b.row_count").alias("__rows_before"), F.col("n.row_count").alias("__rows_now"),
        held["b"].alias("__before"), held["n"].alias("__now"),
        F.explode(F.concat(F.array(F.lit(None).cast("string")), names)).alias("column_name"))
    whole = F.col("column_name").isNull()
    sides = {side: F.when(whole, F.col(f"__rows_{side}")).otherwise(F.try_element_at(f"__{side}", F.coalesce("column_name", F.lit(""))))
             for side in ("before", "now")}
    before, now = F.col("before"), F.col("now")
    share_of = lambda side: F.coalesce(F.try_divide(F.col(side).cast("double"), F.col(f"__rows_{side}")), F.lit(0.0))
    drifted = F.when(whole, F.abs(now - before) > before * rows).otherwise(
        before.isNull() | now.isNull() | ((before > 0) & (now == 0)) | (F.abs(share_of("now") - share_of("before")) > share))
    return facts.withColumns(sides).select(
        "layer", "table_name", "column_name", "before_batch", "now_batch", "before", "now", drifted.alias("drifted"))

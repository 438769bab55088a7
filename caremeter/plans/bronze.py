"""Raw CSV to all-text tables."""

from __future__ import annotations

from collections.abc import Collection
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from caremeter.plans.batch import run_batch
from caremeter.sources.csvfiles import read_csv
from caremeter.sources.schemas import BRONZE_AUDIT, CSV_FILES, bronze_schema
from caremeter.sources.store import LayerStore


def load_bronze(spark: SparkSession, source_dir: str, store: LayerStore, batch_ts: datetime | None = None,
                files: dict[str, str] = CSV_FILES, multi_line: Collection[str] = ()) -> DataFrame:
    """Full refresh of the bronze tables from ``source_dir``; returns the run log.

    A value of ``files`` may be a file, a directory or a glob below ``source_dir``. ``multi_line`` names the tables
    whose fields may hold newlines; only their files are read by one task each.
    """
    def reader(table, name):
        return lambda: read_csv(spark, f"{source_dir.rstrip('/')}/{name}", bronze_schema(table), table in multi_line)

    builds = {t: reader(t, name) for t, name in files.items()}
    return run_batch(spark, store, "bronze", builds, BRONZE_AUDIT, batch_ts)

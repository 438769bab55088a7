"""The whole refresh as one job: raw files to bronze, silver and registered gold views."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from caremeter.plans.bronze import load_bronze
from caremeter.plans.gold import register_gold
from caremeter.plans.gold_sql import publish_gold
from caremeter.plans.silver import load_silver
from caremeter.sources.schemas import TABLES
from caremeter.sources.store import LayerStore


def refresh(spark: SparkSession, source_dir: str, store: LayerStore, batch_ts: datetime | None = None,
            publish: bool = False, **csv_options) -> DataFrame:
    """Run both loads and register the views whose tables have data; always returns the combined run log.

    ``publish`` also points the catalog tables of both layers, and the catalog's gold views, at the new data.
    """
    log = load_bronze(spark, source_dir, store, batch_ts, **csv_options).unionByName(load_silver(spark, store, batch_ts))
    register_gold(store)
    if publish:
        for layer in ("bronze", "silver"):
            store.publish(layer, [t for t in TABLES if store.has(layer, t)])
        publish_gold(store)
    return log

"""The provider tables of one driver directory, layer by layer, lazily."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from caremeter.plans.gold import GOLD_VIEWS, gold_view
from caremeter.plans.silver import build_silver
from caremeter.session import compile_wide
from caremeter.sources.schemas import TABLES
from harness.derive import raw_table


class Layer(Mapping):
    """Tables built when first asked for."""

    def __init__(self, names, build: Callable[[str], DataFrame]):
        self._names, self._build, self._made = tuple(names), build, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._names:
            raise KeyError(name)
        if name not in self._made:
            self._made[name] = self._build(name)
        return self._made[name]

    def __iter__(self):
        return iter(self._names)

    def __len__(self) -> int:
        return len(self._names)


class Lake:
    def __init__(self, spark: SparkSession, sf_dir: str):
        compile_wide(spark)
        self.spark, self.dir = spark, sf_dir
        self.bronze = Layer(TABLES, lambda t: raw_table(spark, sf_dir, t))
        self.silver = Layer(TABLES, lambda t: build_silver(t, self.bronze[t]))
        self.gold = Layer(GOLD_VIEWS, lambda v: gold_view(v, self.silver))

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


def comparable(df: DataFrame) -> DataFrame:
    """Types that both engines hash alike: decimals as double, dates as text."""
    def plain(field):
        kind = field.dataType.typeName()
        if kind == "decimal":
            return F.col(field.name).cast("double").alias(field.name)
        if kind in ("date", "timestamp", "timestamp_ntz"):
            return F.col(field.name).cast("string").alias(field.name)
        return field.name
    return df.select(*[plain(f) for f in df.schema.fields])

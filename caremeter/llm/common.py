"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a variant of it that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without the columns an operator is about to add under these names."""
    wanted = {n.lower() for n in names}
    return df.select(*[f"`{c}`" for c in df.columns if c.lower() not in wanted])


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``; a temporary one only in local mode, where that is unset."""
    folder, master = spark.conf.get("spark.checkpoint.dir", None), spark.conf.get("spark.master", "")
    if not folder and not re.match(r"local($|\[)", master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (folder or _own_dir()).rstrip("/")


@cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="caremeter-shared-")


def new_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage without depending on any executor: a lost executor later costs a re-read, not a recomputation.
    """
    path = new_dir(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

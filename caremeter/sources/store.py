"""Layered Parquet tables with full-refresh writes.

``<root>/<layer>/<table>/data/<batch>-<attempt>/`` holds one attempt to write a refresh, and the file
``<root>/<layer>/<table>/commits/<number>`` holds the name of an attempt that ended well. Readers take the newest batch, of
several attempts at one batch the last committed. A write that fails half-way is never named, so the previous rows stay
current and the same batch can be tried again at once.

``<root>/<layer>/_runs/`` holds one log for each run of a load, appended and never changed.

Writers need no lock. A number is taken by creating its file, which only one writer can do; whoever comes second looks again
at what is committed and tries the next number. A file without a name (its writer was lost, or is about to write it)
commits nothing. As batches and not numbers say what is newest, an older batch never becomes current, whenever it commits.
"""

from __future__ import annotations

import time
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F


class StaleBatch(RuntimeError):
    """A newer batch of the table is committed already."""


class LayerStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _table_dir(self, layer: str, table: str) -> str:
        return f"{self.root}/{layer}/{table}"

    def _fs(self, path: str):
        hpath = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hpath.getFileSystem(self.spark._jsc.hadoopConfiguration()), hpath

    def _names(self, path: str) -> list[str]:
        fs, hpath = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(hpath)) if fs.exists(hpath) else []

    def _commits(self, layer: str, table: str) -> list[tuple[str, int, str]]:
        """(batch, number, attempt) of every commit, the current one last."""
        folder, found = f"{self._table_dir(layer, table)}/commits", []
        for name in self._names(folder):
            if name.isdigit() and (attempt := self._text(f"{folder}/{name}")):
                found.append((attempt.split("-")[0], int(name), attempt))
        return sorted(found)

    def _text(self, path: str) -> str:
        """Content of a small file; empty if it is gone or its last line has not ended."""
        fs, hpath = self._fs(path)
        if not fs.exists(hpath):
            return ""
        stream = fs.open(hpath)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return text[:-1] if text.endswith("\n") else ""

    def batches(self, layer: str, table: str) -> list[str]:
        """Paths of the committed refreshes that still exist, the current one last."""
        there = set(self._names(f"{self._table_dir(layer, table)}/data"))
        return [f"{self._table_dir(layer, table)}/data/{a}" for _, _, a in self._commits(layer, table) if a in there]

    def _check_order(self, layer: str, table: str, batch_id: str) -> None:
        newest = max((batch for batch, _, _ in self._commits(layer, table)), default="")
        if batch_id < newest:
            raise StaleBatch(f"{layer}.{table}: batch {newest} is committed, {batch_id} is older")

    def _take(self, layer: str, table: str, number: int, attempt: str) -> bool:
        """Commit ``attempt`` under ``number``; False if another writer has the number."""
        fs, commit = self._fs(f"{self._table_dir(layer, table)}/commits/{number:012d}")
        try:
            out = fs.create(commit, False)           # fails where the file exists
        except Exception:
            if fs.exists(commit):
                return False
            raise
        try:
            out.write(bytearray(f"{attempt}\n", "utf-8"))
        finally:
            out.close()
        return True

    def write(self, layer: str, table: str, df: DataFrame, batch_id: str) -> str:
        """Write and commit one refresh. An older batch than the newest commit is refused, the same batch replaces it."""
        self._check_order(layer, table, batch_id)
        attempt = f"{batch_id}-{uuid.uuid4().hex[:12]}"
        path = f"{self._table_dir(layer, table)}/data/{attempt}"
        df.write.parquet(path)
        while True:
            self._check_order(layer, table, batch_id)       # another job may have committed meanwhile
            taken = [int(n) for n in self._names(f"{self._table_dir(layer, table)}/commits") if n.isdigit()]
            if self._take(layer, table, max(taken, default=0) + 1, attempt):
                break
        self._check_order(layer, table, batch_id)           # a newer one came first: this one is no longer of use
        return path

    def read(self, layer: str, table: str) -> DataFrame:
        done = self.batches(layer, table)
        if not done:
            raise FileNotFoundError(f"no committed data for {layer}.{table} under {self.root}")
        return self.spark.read.parquet(done[-1])

    def has(self, layer: str, table: str) -> bool:
        return bool(self.batches(layer, table))

    def drop_old(self, layer: str, table: str, keep: int = 1, grace_seconds: float = 86_400) -> None:
        """Delete the data of all but the newest ``keep`` commits, and of attempts that were never committed.

        The latter only after ``grace_seconds`` without a change, as a job may still be writing them.
        """
        if keep < 1:
            raise ValueError("at least the current data must be kept")
        data, done = f"{self._table_dir(layer, table)}/data", self.batches(layer, table)
        committed, kept = {p.rsplit("/", 1)[1] for p in done}, {p.rsplit("/", 1)[1] for p in done[-keep:]}
        for name in self._names(data):
            fs, hpath = self._fs(f"{data}/{name}")
            idle = time.time() - fs.getFileStatus(hpath).getModificationTime() / 1000
            if name not in kept and (name in committed or idle > grace_seconds):
                fs.delete(hpath, True)
        for _, number, attempt in self._commits(layer, table)[:-keep]:       # their data is gone
            if attempt not in kept:
                fs, commit = self._fs(f"{self._table_dir(layer, table)}/commits/{number:012d}")
                fs.delete(commit, False)

    def log_run(self, layer: str, log: DataFrame, batch_id: str) -> None:
        """Append the log of one run under a name of its own, so runs side by side never touch each other's."""
        now = datetime.now(timezone.utc).replace(tzinfo=None)
        log.withColumn("logged_at", F.lit(now)).write.parquet(f"{self.root}/{layer}/_runs/{batch_id}-{uuid.uuid4().hex[:12]}")

    def runs(self, layer: str) -> DataFrame:
        """The log of every run of a layer so far, with the time it was logged (UTC)."""
        path = f"{self.root}/{layer}/_runs"
        if not (names := self._names(path)):
            raise FileNotFoundError(f"no run of {layer} is logged under {self.root}")
        ended = [f"{path}/{n}" for n in names if "_SUCCESS" in self._names(f"{path}/{n}")]
        return self.spark.read.parquet(*ended)

    def register(self, layer: str, tables) -> None:
        """Temp views ``<layer>_<table>`` over the current data, for SQL users."""
        for t in tables:
            self.read(layer, t).createOrReplaceTempView(f"{layer}_{t}")

    def publish(self, layer: str, tables) -> None:
        """One catalog namespace per layer, with an external table over each current directory.

        A table that exists is pointed at the new directory in one step, so there is no moment without it. Its columns
        are declared, so a table whose columns changed is created anew.
        """
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS {layer}")
        for t in tables:
            name, path, data = f"{layer}.{t}", self.batches(layer, t)[-1], self.read(layer, t)
            if self.spark.catalog.tableExists(name):
                if self.spark.table(name).dtypes == data.dtypes:
                    self.spark.sql(f"ALTER TABLE {name} SET LOCATION '{path}'")
                    self.spark.catalog.refreshTable(name)
                    continue
                self.spark.sql(f"DROP TABLE {name}")
            self.spark.catalog.createTable(name, path=path, source="parquet")

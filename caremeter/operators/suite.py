"""Expectations as data, planned together: every table of a layer is read once, whatever is expected of it.

A row sends one key record with its counters, and one record for each row rule it breaks. All tables go through the same
aggregates: by table, rule and key, then by table, rule and entity, then by rule and entity over all tables, then in all.
Rules on rows, on keys, between layers and between tables are read off on the way, without a join. Every step is a
sum, so map tasks combine first and a hot entity costs no more than the others.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from caremeter.operators.common import union_all

KEY_RECORD = -1
KEPT = -2                            # in place of a rule that the row keeps
COUNTERS = ("raw", "typed", "real", "empty", "usable", "broken")


@dataclass(frozen=True)
class RowRule:
    """Rows for which ``broken`` holds (NULL counts as not broken)."""
    check: str
    metric: str
    broken: Column
    severity: str = "error"
    at_most: int | None = 0          # None: reported only


@dataclass(frozen=True)
class Source:
    """One table of one layer (``raw`` or ``typed``) with its rules.

    ``real`` marks raw rows that hold a value, ``empty`` typed rows without one, ``usable`` typed rows that count.
    """
    table: str
    layer: str
    rows: DataFrame
    key: tuple[str, ...]             # the entity, and what tells its rows apart
    rules: Sequence[RowRule] = ()
    real: Column | None = None
    empty: Column | None = None
    usable: Column | None = None


@dataclass(frozen=True)
class GroupRule:
    """``value`` is a column over the totals of all entities, named ``<table>_<counter>`` (see ``totals``)."""
    check: str
    table: str
    metric: str
    value: Column
    severity: str = "error"
    at_most: int | None = 0


def _records(source: Source, first_id: int, number: int) -> DataFrame:
    """One key record for each row, one rule record for each rule it breaks."""
    def counter(condition: Column | None) -> Column:
        return F.lit(0).cast("bigint") if condition is None else F.coalesce(condition, F.lit(False)).cast("bigint")

    # A column of its own and array_remove, as Spark interprets lambdas and what stands inside a generator, with all rules in it.
    # Never empty; the inner explode would filter by its size and so work out the rules twice.
    broken = F.array_remove(F.array(F.lit(KEY_RECORD), *[
        F.when(r.broken, F.lit(first_id + k)).otherwise(F.lit(KEPT)) for k, r in enumerate(source.rules)]), KEPT)
    parts = [F.trim(k) for k in source.key] + [F.lit(None).cast("string")] * (2 - len(source.key))
    rows = source.rows.select(
        parts[0].alias("entity"), parts[1].alias("part"), F.lit(int(source.layer == "raw")).cast("bigint").alias("raw"),
        F.lit(int(source.layer == "typed")).cast("bigint").alias("typed"), counter(source.real).alias("real"),
        counter(source.empty).alias("empty"), counter(source.usable).alias("usable"), broken.alias("rules"))
    rows = rows.select("*", F.explode_outer("rules").alias("rule"))
    is_key = F.col("rule") == KEY_RECORD
    return rows.select(F.lit(number).alias("table_number"), "rule", F.when(is_key, F.col("entity")).alias("entity"),
                       F.when(is_key, F.col("part")).alias("part"),
                       *[F.when(is_key, F.col(c)).otherwise(F.lit(0).cast("bigint")).alias(c) for c in COUNTERS[:-1]],
                       (~is_key).cast("bigint").alias("broken"))


def totals(sources: Sequence[Source], entities: str, group_size: dict[str, int]) -> DataFrame:
    """One row per rule (``KEY_RECORD`` for the keys) with sums over all entities, for each table ``t``:

    ``t_raw`` and ``t_typed`` rows, ``t_broken`` rows of the rule, ``t_repeated`` keys on several typed rows, ``t_lost``
    pairs of a raw row with a value and a typed row without one of the same key, ``t_orphans`` entities that the table
    ``entities`` does not have, ``t_odd`` entities whose raw rows are not ``group_size[t]``; and ``unusable`` entities
    without any usable row in the tables that mark them.
    """
    tables = list(dict.fromkeys(s.table for s in sources))
    marked = list(dict.fromkeys(s.table for s in sources if s.usable is not None))
    starts = [sum(len(s.rules) for s in sources[:i]) for i in range(len(sources))]
    records = union_all([_records(s, at, tables.index(s.table)) for s, at in zip(sources, starts)])
    sums = [F.sum(c).alias(c) for c in COUNTERS]
    by_key = records.groupBy("table_number", "rule", "entity", "part").agg(*sums)

    whole = F.col("entity").isNotNull() & F.col("part").isNotNull()
    pairs = F.col("real").cast("decimal(18,0)") * F.col("empty").cast("decimal(18,0)")
    by_entity = by_key.groupBy("table_number", "rule", "entity").agg(
        *sums, F.count_if(F.col("typed") > 1).alias("repeated"), F.sum(F.when(whole, pairs)).alias("lost"))

    def of(table: str, name: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("table_number") == tables.index(table), F.col(name))), F.lit(0)).alias(f"{table}_{name}")

    in_marked = F.col("table_number").isin(*map(tables.index, marked))
    carried = ("raw", "typed", "broken", "repeated", "lost")
    across = by_entity.groupBy("rule", "entity").agg(
        *[of(t, name) for t in tables for name in carried],
        F.sum(F.when(in_marked, F.col("usable"))).alias("usable"),
        F.sum(F.when(in_marked, F.col("typed"))).alias("marked"))
    keys = F.col("rule") == KEY_RECORD
    orphan = keys & F.col("entity").isNotNull() & (F.col(f"{entities}_typed") == 0)
    return across.groupBy("rule").agg(
        *[F.sum(f"{t}_{name}").cast("bigint").alias(f"{t}_{name}") for t in tables for name in carried],
        *[F.count_if(orphan & (F.col(f"{t}_typed") > 0)).alias(f"{t}_orphans") for t in tables if t != entities],
        *[F.count_if(keys & (F.col(f"{t}_raw") > 0) & (F.col(f"{t}_raw") != n)).alias(f"{t}_odd") for t, n in group_size.items()],
        F.count_if(keys & (F.col("marked") > 0) & (F.col("usable") == 0)).alias("unusable"))


def verdicts(sources: Sequence[Source], entities: str, group_rules: Sequence[GroupRule], group_size: dict[str, int] | None = None) -> DataFrame:
    """One row per expectation: ``check_name``, ``table_name``, ``metric``, ``severity``, ``value``, ``at_most``, ``ok``.

    A rule that no row breaks, and any rule over an empty table, has the value 0. ``ok`` is NULL where a rule only reports.
    """
    named = [(s.table, r) for s in sources for r in s.rules]
    tables = list(dict.fromkeys(s.table for s in sources))
    found = totals(sources, entities, group_size or {})
    broken = sum((F.col(f"{t}_broken") for t in tables), F.lit(0).cast("bigint"))
    key_values = F.array(*[F.struct(F.lit(len(named) + k).alias("id"), g.value.cast("bigint").alias("value")) for k, g in enumerate(group_rules)])
    one = F.array(F.struct(F.col("rule").alias("id"), broken.alias("value")))
    values = found.select(F.explode(F.when(F.col("rule") == KEY_RECORD, key_values).otherwise(one)).alias("v")).select("v.*")

    rows = [(r.check, t, r.metric, r.severity, r.at_most) for t, r in named]
    rows += [(g.check, g.table, g.metric, g.severity, g.at_most) for g in group_rules]
    names = ("check_name", "table_name", "metric", "severity")
    listed = F.array(*[F.struct(F.lit(i).alias("id"), *[F.lit(v).alias(n) for n, v in zip(names, row)],
                                F.lit(row[4]).cast("bigint").alias("at_most")) for i, row in enumerate(rows)])
    expected = sources[0].rows.sparkSession.range(1).select(F.explode(listed).alias("e")).select("e.*")
    value = F.coalesce("value", F.lit(0).cast("bigint"))
    return expected.join(values, "id", "left").select(*names, value.alias("value"), "at_most", (value <= F.col("at_most")).alias("ok"))

"""Rows that two tables do not share, found by descending a tree of digests.

A node is a prefix of the key; its digest is the sum of its rows' hashes, so both sides can be cut and ordered in any way. Only nodes
whose digests differ are opened, and only their rows are read again and compared.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

LISTED = 1_000     # differing key values that go into a pushed filter; with more, all rows under the values before are compared
PART = 22          # bits of a hash that are summed at a time: sums of 64-bit integers hold for 2 ** 41 rows
CELLS = 4          # times ``listed``: cells by which a level tells how many values differ on the next


def _signed(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of both sides, with +1 and -1."""
    sides = [df.select(*left.columns, F.lit(sign).alias("__side")) for df, sign in ((left, 1), (right, -1))]
    return sides[0].unionAll(sides[1])


def differing_keys(left: DataFrame, right: DataFrame, prefix: Sequence[str], cell: Column | None = None) -> DataFrame:
    """Prefixes of the key under which the two sides hold different rows (by count and a 128-bit sum of hashes).

    With ``cell``, prefixes with the cells of rows (``__cell``) that differ. Tasks sum first, so a hot key costs its map tasks
    only. NULL is a key value like others.
    """
    def parts(seed: int) -> list[Column]:        # integers, as decimals are objects for every row; NULLs are told by their places
        columns = [F.col(f"`{c}`") for c in left.columns]
        number = F.xxhash64(F.lit(seed), *[c.isNull() for c in columns], *columns)
        low = F.lit((1 << PART) - 1).cast("long")
        return [F.shiftright(number, 2 * PART), F.shiftright(number, PART).bitwiseAND(low), number.bitwiseAND(low)]

    keys = [*prefix] if cell is None else [*prefix, cell.alias("__cell")]
    sums = [F.sum(part * F.col("__side")).alias(f"__{seed}{i}") for seed in (1, 2) for i, part in enumerate(parts(seed))]
    found = _signed(left, right).groupBy(*keys).agg(F.sum("__side").alias("__n"), *sums)
    differs = " OR ".join(f"{c} <> 0" for c in found.columns[len(keys):])
    return found.where(differs).select(*found.columns[:len(keys)])


def _differing(left: DataFrame, right: DataFrame, prefix: Sequence[str], following: str | None, listed: int) -> tuple[list, bool]:
    """Up to ``listed`` + 1 differing values of the last column of ``prefix``, and whether more than ``listed`` of ``following`` surely differ."""
    cell = None if following is None else F.pmod(F.xxhash64(F.lit(3), F.col(f"`{following}`")), F.lit(CELLS * max(listed, 1)))
    found = differing_keys(left, right, prefix, cell)
    values = found.select(F.col(prefix[-1]).alias("value"), F.lit(None).cast("long").alias("cell")).distinct().limit(listed + 1)
    if cell is not None:             # both read the same shuffle
        kind = values.schema["value"].dataType
        values = values.unionAll(found.select(F.lit(None).cast(kind).alias("value"), F.col("__cell").alias("cell")).distinct().limit(listed + 1))
    rows = values.collect()
    return [r.value for r in rows if r.cell is None], sum(r.cell is not None for r in rows) > listed


def _within(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    known = [v for v in values if v is not None]
    wanted = F.col(column).isin(known)
    return df.where(wanted if len(known) == len(values) else F.col(column).isNull() | wanted)


def row_difference(left: DataFrame, right: DataFrame, key: Sequence[str], listed: int = LISTED) -> DataFrame:
    """Rows with ``n_left`` and ``n_right``, how often each side holds them, where these differ.

    ``key`` names columns from coarse to fine; each makes a level of the tree. Up to ``listed`` differing values of a level become a filter
    that reaches the scan, so files and row groups of other values are skipped if the tables are clustered by ``key``. When more
    differ, all rows that are left are counted, in one shuffle; a level that must come to this is not read. Nothing is cut off
    either way. Columns are matched by name and must be the same; equal rows are counted, NULLs are equal. Levels run when this
    is called; equal tables give no rows and are read once.
    """
    if sorted(left.columns) != sorted(right.columns):
        raise ValueError(f"different columns: {left.columns} and {right.columns}")
    for depth, column in enumerate(key, 1):
        values, many = _differing(left, right, key[:depth], key[depth] if depth < len(key) else None, listed)
        if not values:
            left, right = left.where(F.lit(False)), right.where(F.lit(False))
            break
        if len(values) > listed:
            break
        left, right = _within(left, column, values), _within(right, column, values)
        if many:
            break
    counts = _signed(left, right).groupBy(*left.columns).agg(
        F.count_if(F.col("__side") == 1).alias("n_left"), F.count_if(F.col("__side") == -1).alias("n_right"))
    return counts.where(F.col("n_left") != F.col("n_right"))

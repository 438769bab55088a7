"""Mixing sources to target weights by proportionate-fair (Pfair) scheduling.

Documents of a source are put in hashed order and cut into blocks. Time is a row of slots, one block each. A source of
weight w may place its block j (from 0) from slot floor(j/w) on and must have placed it before slot ceil((j+1)/w);
in every slot the block with the earliest deadline goes among those released. As the weights sum to one, every
deadline is met, so after any number t of slots each source has placed less than one block more or less than w*t.

Weights are shares of a fixed number of slots, a period: after it all sources are exactly even and the schedule repeats.
So only one period is simulated; every block finds its slot from its number by a division and a lookup.

The schedule runs until every source has placed all its blocks once. A source that is through earlier starts over: its
documents come again, with the next epoch number. No document is left out.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Mapping

from pyspark.sql import DataFrame, Window, functions as F

from caremeter.llm.common import without

PERIOD, LONGEST = 1 << 10, 1 << 16      # slots: bounds what is simulated and broadcast
ADDED = ("mix_slot", "mix_epoch", "mix_block", "mix_position")


def shares(weights: Mapping[str | None, float], period: int = PERIOD, longest: int = LONGEST) -> dict[str | None, int]:
    """Slots of each source in a period, by largest remainders, at least one each.

    The period doubles until it has four slots per source and two for the smallest weight, the latter up to ``longest``.
    """
    if not weights:
        return {}
    if not all(0 < w < math.inf for w in weights.values()):
        raise ValueError("weights must be positive")
    total = math.fsum(weights.values())
    while period < 4 * len(weights) or period < min(longest, 2 * total / min(weights.values())):
        period *= 2
    names = sorted(weights, key=lambda s: (s is not None, s))
    free = period - len(names)
    exact = {s: free * weights[s] / total for s in names}
    slots = {s: 1 + int(exact[s]) for s in names}
    for s in sorted(names, key=lambda s: int(exact[s]) - exact[s])[:period - sum(slots.values())]:
        slots[s] += 1
    return slots


def period_schedule(slots: Mapping[str | None, int]) -> list[tuple[str | None, int, int]]:
    """(source, its block within the period, slot): earliest deadline first among the released blocks."""
    period = sum(slots.values())
    names = sorted(slots, key=lambda s: (s is not None, s))
    released: list[tuple[int, int, int]] = []                    # (deadline, source, block)
    waiting = [(0, n, 0) for n in range(len(names))]             # (release, source, block)
    heapq.heapify(waiting)
    out = []
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, n, j = heapq.heappop(waiting)
            heapq.heappush(released, (-(-(j + 1) * period // slots[names[n]]), n, j))
        deadline, n, j = heapq.heappop(released)
        if slot >= deadline:
            raise AssertionError("a deadline was missed")
        out.append((names[n], j, slot))
        if j + 1 < slots[names[n]]:
            heapq.heappush(waiting, ((j + 1) * period // slots[names[n]], n, j + 1))
    return out


def power_weights(counts: Mapping[str | None, int], power: float) -> dict[str | None, float]:
    """Weights in proportion to ``count ** power``: below 1, small sources get more than their share."""
    return {s: n ** power for s, n in counts.items()}


def source_counts(df: DataFrame, source_col: str) -> dict[str | None, int]:
    """Documents of each source: one number per source comes to the driver, no documents."""
    return {r[0]: r[1] for r in df.groupBy(F.col(source_col).cast("string")).count().collect()}


def _numbered(rows: DataFrame, total: int, slice_docs: int) -> DataFrame:
    """(row, source, nr): ``nr`` is the exact place (from 0) of a row in the hashed order of its source.

    The hash also cuts a source into slices, so a hot source is numbered by many tasks; slices get their start from
    a running total over slice sizes. Rows of one id are told apart by a hash of all columns.
    """
    slices = max(1, -(-total // slice_docs))
    order = F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")))
    part = F.conv(F.substring(order, 1, 8), 16, 10).cast("long") % slices
    cut = rows.select("row", F.struct("source", part.alias("part")).alias("slice"), order.alias("place"))
    sizes = cut.groupBy("slice").agg(F.count("*").alias("size"))
    earlier = Window.partitionBy("slice.source").orderBy("slice.part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("slice", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("start"))
    inside = Window.partitionBy("slice").orderBy("place", F.xxhash64("row"))
    return cut.withColumn("nr", F.row_number().over(inside) - 1).join(starts, "slice").select(
        "row", F.col("slice.source").alias("source"), (F.col("nr") + F.col("start")).alias("nr"))


def mix(df: DataFrame, weights: Mapping[str | None, float] | None = None, id_col: str = "doc_id", source_col: str = "source",
        power: float = 0.9, block_docs: int = 64, max_epochs: int | None = 4, slice_docs: int = 4_000) -> DataFrame:
    """Every row of ``df``, again in later epochs, with ``mix_slot``, ``mix_position``, ``mix_block`` and ``mix_epoch``.

    Reading in the order of (mix_slot, mix_position) gives the mix: slot by slot one block of ``block_docs`` documents
    (the last of a source may be shorter). ``weights`` maps each source to its target weight; without it weights follow
    document counts to the ``power``. A source comes at most ``max_epochs`` times (None: no limit); beyond that its
    slots stay empty. NULL is a source of its own (key None). Rows that share an id are separate documents. A source
    without a weight is an error. Input columns named like an added one are replaced; all others keep their values.
    """
    df = without(df, *ADDED)
    spark = df.sparkSession
    counts = source_counts(df, source_col)
    weights = power_weights(counts, power) if weights is None else {s: weights[s] for s in counts}
    slots = shares(weights)
    period = sum(slots.values())
    table = period_schedule(slots)
    slot_of = {(s, j): t for s, j, t in table}
    blocks = {s: -(-n // block_docs) for s, n in counts.items()}

    def when_placed(s, block):
        return block // slots[s] * period + slot_of[s, block % slots[s]]
    horizon = max((when_placed(s, n - 1) + 1 for s, n in blocks.items()), default=0)

    def epochs(s):        # rounds that begin before the horizon
        most = -(-(horizon // period + 1) * slots[s] // blocks[s])
        return min(most, max_epochs or most)
    plan = spark.createDataFrame([(s, blocks[s], slots[s], epochs(s)) for s in slots], "s string, n long, w long, epochs long")
    lookup = spark.createDataFrame(table, "t_source string, j long, t long")

    # a row travels as one value, so its columns cannot clash with those of the schedule
    rows = df.select(F.struct(*[f"`{c}`" for c in df.columns]).alias("row"), F.col(id_col).alias("id"),
                     F.col(source_col).cast("string").alias("source"))
    numbered = _numbered(rows, sum(counts.values()), slice_docs)
    # both small sides are as large as the sources and the period, not as the documents
    planned = numbered.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("s")))
    again = planned.select("row", "source", "nr", "n", "w", F.explode(F.sequence(F.lit(0).cast("long"), F.col("epochs") - 1)).alias("epoch"))
    block = F.floor(F.col("nr") / block_docs).cast("long")
    placed = again.withColumn("nth", F.col("epoch") * F.col("n") + block).join(
        F.broadcast(lookup), F.col("source").eqNullSafe(F.col("t_source")) & (F.col("nth") % F.col("w") == F.col("j")))
    out = placed.select(
        *[F.col("row").getField(c).alias(c) for c in df.columns], (F.expr("nth div w") * period + F.col("t")).alias("mix_slot"),
        (F.col("nr") % block_docs).cast("long").alias("mix_position"), block.alias("mix_block"), F.col("epoch").alias("mix_epoch"))
    return out.where(F.col("mix_slot") < horizon)


def in_mix_order(mixed: DataFrame) -> DataFrame:
    """Rows laid out in mix order over the partitions, each sorted: the files of a table written from it are the mix."""
    width = int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return mixed.repartitionByRange(width, "mix_slot", "mix_position").sortWithinPartitions("mix_slot", "mix_position")

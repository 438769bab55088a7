"""Entities against their peers.

Benchmarks are sums and counts per (entity, measure) first, then joined to the dimension and summed
per peer group, so a hot entity reaches the join as one row per measure.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from caremeter.functions.rules import mean_of
from caremeter.operators.common import union_all

KEY = "facility_id"


def benchmark(fact: DataFrame, peers: DataFrame, score: str, measures, peer_keys, digits: int, name: str,
              keep_empty: bool = False) -> DataFrame:
    """Average usable score per (peer group, measure) over the entities in ``peers``.

    A group whose usable scores are all NULL has no row, or with ``keep_empty`` a NULL average.
    """
    rows = fact.where(F.col("measure_id").isin(*measures) & F.col("is_score_usable"))
    rows = rows if keep_empty else rows.where(F.col(score).isNotNull())
    per_entity = rows.groupBy(KEY, "measure_id").agg(F.sum(score).alias("__s"), F.count(score).alias("__n"))
    joined = per_entity.join(peers.select(KEY, *peer_keys), KEY)
    return joined.groupBy(*peer_keys, "measure_id").agg(mean_of(F.sum("__s"), F.sum("__n"), digits).alias(name))


def at_home(home: DataFrame, bench: DataFrame, peer_keys) -> DataFrame:
    """The benchmarks of each entity, a row per entity and measure: facts then join on the entity, not on a few peer keys."""
    return home.join(bench, [*peer_keys])


def vs_benchmark(fact: DataFrame, dim: DataFrame, score: str, measures, names: tuple[str, str, str],
                 peer_keys=("state",), entity: str | None = None, digits: int = 1, extra=()) -> DataFrame:
    """Each entity's usable scores beside the average of its peer group, and the difference.

    ``entity`` limits the subjects to one facility; the benchmark always covers all peers.
    ``names`` are the output columns for (own score, peer average, difference).
    """
    own, peer, diff = names
    bench = benchmark(fact, dim, score, measures, peer_keys, digits, peer)
    subjects = fact.where(F.col("measure_id").isin(*measures) & F.col("is_score_usable"))
    home = dim.select(KEY, *peer_keys)
    if entity is not None:
        subjects, home = subjects.where(F.col(KEY) == entity), home.where(F.col(KEY) == entity)
    rows = subjects.select(KEY, "measure_id", *extra, F.col(score).alias(own))
    return rows.join(at_home(home, bench, peer_keys), [KEY, "measure_id"]).select(
        KEY, *peer_keys, "measure_id", *extra, own, peer, F.round(F.col(own) - F.col(peer), digits).alias(diff))


def gap_to_best(facts: dict[str, DataFrame], dim: DataFrame, measures: dict[str, tuple], best: Column,
                peer_keys=("state", "hospital_ownership", "hospital_type"), entity: str | None = None,
                score: str = "score") -> DataFrame:
    """Own scores against the average of the best-rated entities of the same peer group, over several facts.

    Own scores are taken as they are, usable or not; peers count usable scores only, and a measure on which all
    of them are NULL keeps its row with a NULL average.
    """
    own = union_all([f.where(F.col("measure_id").isin(*measures[t])).select(KEY, "measure_id", F.col(score).alias("own_score"))
                     for t, f in facts.items()])
    top = dim.where(best)
    bench = union_all([benchmark(f, top, score, measures[t], peer_keys, 2, "best_peer_avg", keep_empty=True) for t, f in facts.items()])
    home = dim.select(KEY, *peer_keys)
    if entity is not None:
        own, home = own.where(F.col(KEY) == entity), home.where(F.col(KEY) == entity)
    return own.join(at_home(home, bench, peer_keys), [KEY, "measure_id"]).select(
        KEY, *peer_keys, "measure_id", F.round("own_score", 2).alias("own_score"), "best_peer_avg",
        F.round(F.col("own_score") - F.col("best_peer_avg"), 2).alias("gap_to_close"))

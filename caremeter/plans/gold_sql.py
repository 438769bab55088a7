"""The gold views as catalog views, for every session: SQL bodies over the current silver data, views on views.

``publish_gold`` replaces the source views, which name the committed directories, and after them the views above. A session
resolves a view by name at every query, so all sessions read a refresh from its publication on; queries that run already
keep the directory they began with (see ``LayerStore.drop_old``).
"""

from __future__ import annotations

from caremeter.functions import values as V
from caremeter.functions.text import SCORE_TYPE
from caremeter.plans.gold import DIM_COLUMNS, GOLD_VIEWS
from caremeter.sources.store import LayerStore

DATABASE = "gold"


def quoted(items) -> str:
    return ", ".join("'" + str(i).replace("\\", "\\\\").replace("'", "\\'") + "'" for i in items)


def mean(column: str, digits: int = 2) -> str:
    number = f"try_cast({column} AS {SCORE_TYPE})"
    return f"CASE WHEN count({column}) = count({number}) THEN CAST(round(try_avg({number}), {digits}) AS DECIMAL(38,{digits})) END"


def deviation(column: str, digits: int = 2) -> str:
    return f"round(stddev_samp(CAST({column} AS DOUBLE)), {digits})"


def percent(part: str, whole: str) -> str:
    return (f"CAST(round(CAST(100 AS DECIMAL(3,0)) * CAST({part} AS DECIMAL(18,0)) / CAST(nullif({whole}, 0) AS DECIMAL(18,0)), 2) "
            "AS DECIMAL(18,2))")


def facility_mean(table: str, score: str, where: str, name: str, used: str, period: str | None) -> str:
    dates = f", min(start_date) AS {period}_period_start, max(end_date) AS {period}_period_end" if period else ""
    return (f"SELECT facility_id, {mean(score)} AS {name}, count(*) AS {used}{dates} FROM src_{table} "
            f"WHERE {where} AND is_score_usable AND {score} IS NOT NULL GROUP BY facility_id")


def outcomes() -> str:
    def group(label, pattern):
        n, worse = (f"count_if(measure_id LIKE '{pattern}' AND compared_to_national {test})" for test in ("IS NOT NULL", "= 'Worse'"))
        return f"{n} AS {label}_rated, {percent(worse, n)} AS {label}_pct_worse"

    labels = ", ".join(f"count_if(compared_to_national = '{label}') AS comp_{name}"
                       for name, label in (("better", "Better"), ("no_different", "No Different"), ("worse", "Worse")))
    return (f"SELECT facility_id, count(compared_to_national) AS comp_rated_total, {labels}, "
            + percent("count_if(compared_to_national = 'Worse')", "count(compared_to_national)") + " AS complication_pct_worse, "
            + ", ".join(group(label, pattern) for label, pattern in V.OUTCOME_PREFIXES.items())
            + ", min(start_date) AS comp_period_start, max(end_date) AS comp_period_end FROM src_complications WHERE is_score_usable "
            + f"GROUP BY facility_id HAVING count(compared_to_national) >= {V.MIN_RATED}")


def bodies() -> dict[str, str]:
    """View name -> SQL; a view comes after those it reads."""
    regions = " ".join(f"WHEN state IN ({quoted(states)}) THEN '{name}'" for name, states in V.REGIONS.items())
    dims = ", ".join(f"d.{c}" for c in DIM_COLUMNS)
    per_prefix = ", ".join(f"{p}_rated, {p}_pct_worse" for p in V.OUTCOME_PREFIXES)
    return {
        "dim_hospital": "SELECT facility_id, facility_name, hospital_type, hospital_ownership, hospital_ownership_details, state, "
                        f"CASE {regions} ELSE 'Unknown' END AS region, hospital_overall_rating FROM src_hospital_general",
        "facility_imaging": facility_mean("outpatient_imaging", "score", f"measure_id IN ({quoted(V.IMAGING_MEASURES)})",
                                          "avg_imaging_score", "imaging_measures_used", "imaging"),
        "facility_ed_wait": facility_mean("timely_care", "score_numeric", f"measure_id IN ({quoted(V.ED_WAIT_MEASURES)}) AND score_numeric <= "
                                          f"{V.ED_WAIT_CAP_MINUTES}", "avg_ed_wait_minutes", "ed_measures_used", "ed"),
        "facility_process_care": facility_mean("timely_care", "score_numeric", f"condition IN ({quoted(V.PROCESS_CONDITIONS)})",
                                               "avg_process_care_score", "process_measures_count", "process"),
        "facility_outcomes": outcomes(),
        "vw_imaging_vs_ed_wait":
            f"SELECT {dims}, avg_imaging_score, imaging_measures_used, avg_ed_wait_minutes, ed_measures_used, imaging_period_start, "
            "imaging_period_end, ed_period_start, ed_period_end FROM dim_hospital d JOIN facility_imaging USING (facility_id) "
            "JOIN facility_ed_wait USING (facility_id)",
        "vw_ownership_imaging_ed_stats":
            f"SELECT hospital_ownership, count(*) AS n_hospitals, {mean('avg_imaging_score')} AS avg_imaging_score, "
            f"{deviation('avg_imaging_score')} AS stddev_imaging_score, {mean('avg_ed_wait_minutes')} AS avg_ed_wait_minutes, "
            f"{deviation('avg_ed_wait_minutes')} AS stddev_ed_wait_minutes, {mean('hospital_overall_rating')} AS avg_star_rating "
            f"FROM vw_imaging_vs_ed_wait WHERE hospital_ownership <> '{V.TRIBAL_VALUE}' GROUP BY hospital_ownership "
            "ORDER BY n_hospitals DESC, hospital_ownership",
        "vw_complications_vs_process_care":
            f"SELECT {dims}, comp_rated_total, comp_better, comp_no_different, comp_worse, complication_pct_worse, {per_prefix}, "
            "avg_process_care_score, process_measures_count, comp_period_start, comp_period_end, process_period_start, process_period_end "
            "FROM dim_hospital d JOIN facility_outcomes USING (facility_id) JOIN facility_process_care USING (facility_id)",
    }


READS = {"dim_hospital": ["hospital_general"], "facility_imaging": ["outpatient_imaging"], "facility_ed_wait": ["timely_care"],
         "facility_process_care": ["timely_care"], "facility_outcomes": ["complications"]}
READS |= {name: list(tables) for name, (_, tables) in GOLD_VIEWS.items()}


def publish_gold(store: LayerStore, database: str = DATABASE) -> list[str]:
    """Create or replace the catalog views whose silver tables all have data, each in one step; returns their names.

    The views live in ``database`` (in Spark's catalog, so as long as that lasts) and need no temp view and no session of ours.
    """
    spark = store.spark
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    current = {t: store.batches("silver", t)[-1] for t in sorted({t for ts in READS.values() for t in ts}) if store.has("silver", t)}
    for table, path in current.items():
        spark.sql(f"CREATE OR REPLACE VIEW {database}.src_{table} AS SELECT * FROM parquet.`{path}`")
    names = [name for name in bodies() if all(t in current for t in READS[name])]
    for name in names:
        # other views are named with their database, as a reader may have any database in use
        body = bodies()[name]
        for other in [*bodies(), *(f"src_{t}" for t in current)]:
            body = body.replace(f"FROM {other}", f"FROM {database}.{other}").replace(f"JOIN {other}", f"JOIN {database}.{other}")
        spark.sql(f"CREATE OR REPLACE VIEW {database}.{name} AS {body}")
    return names

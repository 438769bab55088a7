"""Raw provider-shaped tables as projections of the driver's tables.

The driver's tables hold no provider data, so each raw text table is a row-for-row projection of
one of them (customer, orders, lineitem, events). Texts, gaps, footnotes and odd spellings are
picked by arithmetic on the row's own numbers, so the tables grow with their sources and every
edge of the cleaning rules occurs. The expressions use only syntax that Spark and DuckDB share,
so both engines read the same raw values.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def _mix(x: str, y: str, seed: int, m: int) -> str:
    return f"(({x} * {31337 + 101 * seed} + {y} * {7907 + 307 * seed}) % 1000003) % {m}"


def _pick(index: str, values) -> str:
    """Text number ``index`` of a list; '~' stands for NULL. Short, unlike a CASE that repeats the index per arm."""
    listed = ";".join("~" if v is None else v for v in values)
    return f"nullif(split_part('{listed}', ';', CAST({index} + 1 AS INT)), '~')"


def _id(key: str) -> str:
    return (f"CASE WHEN {key} < 1000000 THEN lpad(CAST({key} AS STRING), 6, '0') ELSE CAST({key} AS STRING) END")


def _padded_id(key: str, every: int) -> str:
    return f"CASE WHEN {key} % {every} = 3 THEN ' ' || {_id(key)} || ' ' ELSE {_id(key)} END"


def _mdy(day: str, years: int = 0) -> str:
    return (f"lpad(CAST(month({day}) AS STRING), 2, '0') || '/' || lpad(CAST(day({day}) AS STRING), 2, '0') || '/' "
            f"|| CAST(year({day}) + ({years}) AS STRING)")


def _cents(amount: str) -> str:
    return f"CAST(abs(round({amount} * 100)) AS BIGINT)"


def _one_decimal(k: str, m: int) -> str:
    return f"CAST(({k} % {m}) AS STRING) || '.' || CAST(({k} % 7) AS STRING)"


STATES = ("PA", "NY", "OH", "TX", "CA", " pa ", "FL", "PR", "XX", "WA", "IL", "ny", "PA")
TYPES = ("Acute Care Hospitals", "Critical Access Hospitals", "Acute Care Hospitals", "Childrens",
         "Acute Care - Veterans Administration", "Acute Care Hospitals", "Psychiatric", "Rural Emergency Hospital")
OWNERS = ("Government - Local", "Government - State", "Government - Hospital District or Authority",
          "Government - Federal", "Veterans Health Administration", "Department of Defense",
          "Voluntary non-profit - Church", "Voluntary non-profit - Private", "Voluntary non-profit - Other",
          "Proprietary", "Physician", "Tribal", "Unlisted", "Voluntary non-profit - Private", "Proprietary", " Tribal")
RATINGS = ("1", "2", "3", "4", "5", "Not Available", "3", "4", "5", "", None, "2")
COUNTS = ("7", "3", "0", "7", "Not Available", "", None, "99999999999", "12", "5")
GROUP_COUNTS = ("7", "7", "7", "12", "0", "Not Available")
GROUP_NOTES = (None, "5", None, "19", "", "22", None, "23", "5, 23", None, "5, 19, 22, 23", "19,23", "16", None, "22 ")
NOTES = (None, None, "1", None, "3, 13", "", None, "8", "11", None, "1, 5", "2", None, "29", "7", None, "12 ,13", "23",
         None, "13", "8, 3", None, None, "28")
COMPARED = ("No Different Than the National Rate", "Better Than the National Rate", "Worse Than the National Rate",
            "No Different Than the National Value", "Better than National Benchmark", "Not Different Than National Rate",
            "Worse than National Benchmark", "Not Available", None, "no different than national benchmark",
            "Number of Cases Too Small", "Worse Than the National Rate")
ODD_SCORES = (None, "", "N/A", "Not Available", "very high", "low", " 12", "-3", "1,234", "12.", "007", "Not Available")
ODD_DATES = ("", None, "2025-01-31", "02/31/2025", "01/31/2025 x")

TIMELY_MEASURES = (
    [("Emergency Department", f"OP_18{x}", f"ED wait {x}") for x in "abcdabcd"]
    + [("Emergency Department", "OP_22", "Left before seen"), ("Emergency Department", "OP_23", "Head CT"),
       ("Colonoscopy care", "OP_29", "Follow-up interval"), ("Colonoscopy care", " OP_29 ", "Follow-up interval"),
       ("Healthcare Personnel Vaccination", "IMM_3", "Staff vaccination"), ("Sepsis Care", "SEP_1", "Sepsis bundle"),
       ("Healthcare Personnel Vaccination", "IMM_3", "Staff vaccination"), ("Cataract Surgery", "OP_31", "Cataracts"),
       ("Electronic Clinical Quality Measure", "HH_HYPER", "Hyperglycemia"),
       ("Electronic Clinical Quality Measure", "OP_40", "STEMI")])
COMPLICATION_MEASURES = ("MORT_30_AMI", "MORT_30_HF", "MORT_30_PN", "MORT_30_CABG", "MORT_30_STK", "PSI_03", "PSI_04",
                         "PSI_06", "PSI_90", "COMP_HIP_KNEE", "COMP_OTHER", "Hybrid_HWM", "PSI_03", "PSI_90")
IMAGING = ("OP-8", "OP-10", "OP-10", "OP-13", "OP-13", "OP-39", "OP-39", "HAI_1_SIR")
SUFFIXES = ("SIR", "CILOWER", "CIUPPER", "NUMERATOR", "ELIGCASES", "DOPC", "SIR", "SIR")


def _dates(day: str, x: str, y: str, seed: int) -> list[tuple[str, str]]:
    def col(years: str, s: int) -> str:
        index = _mix(x, y, s, 47)
        return f"CASE WHEN {index} < {len(ODD_DATES)} THEN {_pick(index, ODD_DATES)} ELSE {years} END"
    end = f"CASE WHEN {_mix(x, y, seed + 2, 29)} = 1 THEN {_mdy(day, -1)} ELSE {_mdy(day, 1)} END"
    return [("start_date", col(_mdy(day), seed)), ("end_date", col(end, seed + 1))]


def _score(numeric: str, x: str, y: str, seed: int) -> str:
    odd = _pick(_mix(x, y, seed, len(ODD_SCORES)), ODD_SCORES)
    return f"CASE WHEN {_mix(x, y, seed + 1, 10)} < 7 THEN {numeric} ELSE {odd} END"


def _notes(key: str, x: str, y: str, seed: int) -> str:
    """Footnote list; one facility in 37 has too few cases everywhere, so no score of it is usable."""
    return f"CASE WHEN {key} % 37 = 5 THEN '5' ELSE {_pick(_mix(x, y, seed, len(NOTES)), NOTES)} END"


def _place(key: str, state: str, every: int) -> list[tuple[str, str]]:
    return [("facility_id", _padded_id(key, every)), ("facility_name", f"' Facility ' || CAST({key} AS STRING) || ' '"),
            ("address", f"CAST({key} AS STRING) || ' Main St'"), ("city", f"'City ' || CAST({key} % 50 AS STRING)"),
            ("state", state), ("zip_code", f"lpad(CAST({key} % 99999 AS STRING), 5, '0')"),
            ("county", f"' County ' || CAST({key} % 30 AS STRING)"),
            ("telephone_number", f"'(555) ' || CAST({key} % 10000 AS STRING)")]


def _hospital() -> list[tuple[str, str]]:
    x, y = _cents("c_acctbal"), "c_custkey"
    cols = _place(y, _pick("(c_nationkey % 13)", STATES), 11)
    cols[1] = ("facility_name", "' ' || c_name || ' ' || c_mktsegment || ' '")
    cols += [("hospital_type", _pick(_mix(x, y, 1, 8), TYPES)), ("hospital_ownership", _pick(_mix(x, y, 2, 16), OWNERS)),
             ("emergency_services", _pick(_mix(x, y, 3, 5), ("Yes", "No", "Yes", None, ""))),
             ("birthing_friendly_designation", _pick(_mix(x, y, 4, 4), ("Y", None, "N", "Y"))),
             ("hospital_overall_rating", _pick(_mix(x, y, 5, 12), RATINGS)),
             ("hospital_overall_rating_footnote", _pick(_mix(x, y, 6, 4), (None, "16", " 19 ", "5, 16")))]
    for i, (g, outcomes) in enumerate((("mort", 1), ("safety", 1), ("readm", 1), ("pt_exp", 0), ("te", 0))):
        s = 10 + 7 * i
        full = f"{_mix(x, y, s + 5, 3)} = 0"   # a third of the facilities report every measure
        cols += [(f"{g}_group_measure_count", f"CASE WHEN {full} THEN '7' ELSE {_pick(_mix(x, y, s, 6), GROUP_COUNTS)} END"),
                 (f"facility_{g}_measure_count", f"CASE WHEN {full} THEN '7' ELSE {_pick(_mix(x, y, s + 1, 10), COUNTS)} END")]
        if outcomes:
            cols += [(f"{g}_measures_{o}", _pick(_mix(x, y, s + 2 + j, 10), COUNTS))
                     for j, o in enumerate(("better", "no_different", "worse"))]
        cols += [(f"{g}_group_footnote", _pick(_mix(x, y, s + 6, 15), GROUP_NOTES))]
    return cols


def _timely() -> list[tuple[str, str]]:
    x, y = _cents("o_totalprice"), "o_orderkey"
    m = _mix(x, y, 60, len(TIMELY_MEASURES))
    score = f"CASE WHEN {m} < 8 THEN CAST({x} % 1500 AS STRING) ELSE {_one_decimal(x, 100)} END"
    return _place("o_custkey", _pick("(o_custkey % 13)", STATES), 13) + [
        ("condition", _pick(m, [t[0] for t in TIMELY_MEASURES])), ("measure_id", _pick(m, [t[1] for t in TIMELY_MEASURES])),
        ("measure_name", _pick(m, [t[2] for t in TIMELY_MEASURES])), ("score", _score(score, x, y, 61)),
        ("sample", f"CASE {_mix(x, y, 64, 9)} WHEN 0 THEN 'Not Available' WHEN 1 THEN '' ELSE CAST({x} % 900 AS STRING) END"),
        ("footnote", _notes("o_custkey", x, y, 65)), *_dates("o_orderdate", x, y, 66)]


def _complications() -> list[tuple[str, str]]:
    x, y = _cents("l_extendedprice"), "(l_orderkey * 7 + l_linenumber)"
    m = _mix(x, y, 70, len(COMPLICATION_MEASURES))
    return _place("l_partkey", _pick("(l_partkey % 13)", STATES), 17) + [
        ("measure_id", _pick(m, COMPLICATION_MEASURES)), ("measure_name", f"'Complication ' || CAST({m} AS STRING)"),
        ("compared_to_national", _pick(_mix(x, y, 71, len(COMPARED)), COMPARED)),
        ("denominator", f"CASE {_mix(x, y, 72, 9)} WHEN 0 THEN 'Not Available' WHEN 1 THEN '99999999999' "
                        "ELSE CAST(CAST(l_quantity AS INT) AS STRING) END"),
        ("score", _score(_one_decimal(x, 30), x, y, 73)),
        ("lower_estimate", _score(_one_decimal(x, 20), x, y, 75)), ("higher_estimate", _score(_one_decimal(x, 40), x, y, 77)),
        ("footnote", _notes("l_partkey", x, y, 79)), *_dates("l_shipdate", x, y, 80)]


def _imaging() -> list[tuple[str, str]]:
    x, y = _cents("value"), "event_id"
    m = _mix(x, y, 85, len(IMAGING))
    return _place("user_id", _pick("(user_id % 13)", STATES), 19) + [
        ("measure_id", _pick(m, IMAGING)), ("measure_name", f"'Imaging ' || {_pick(m, IMAGING)}"),
        ("score", _score(_one_decimal(x, 25), x, y, 86)),
        ("footnote", _notes("user_id", x, y, 88)), *_dates("ts", x, y, 89)]


def _infections() -> list[tuple[str, str]]:
    x, y = _cents("l_extendedprice"), "(l_orderkey * 11 + l_suppkey)"
    n, m = f"({_mix(x, y, 93, 6)} + 1)", _mix(x, y, 94, 8)
    return _place("l_partkey", _pick("(l_partkey % 13)", STATES), 23) + [
        ("measure_id", f"CASE WHEN {_mix(x, y, 95, 101)} = 0 THEN 'X_' ELSE 'HAI_' || CAST({n} AS STRING) || '_' || "
                       f"{_pick(m, SUFFIXES)} END"),
        ("measure_name", f"'Infection ' || CAST({n} AS STRING)"),
        ("compared_to_national", _pick(_mix(x, y, 96, len(COMPARED)), COMPARED)),
        ("score", f"CASE WHEN {_mix(x, y, 97, 10)} < 8 THEN CAST({x} % 3 AS STRING) || '.' || lpad(CAST({x} % 1000 AS STRING), 3, '0')"
                  f" ELSE {_pick(_mix(x, y, 98, len(ODD_SCORES)), ODD_SCORES)} END"),
        ("footnote", _notes("l_partkey", x, y, 99)), *_dates("l_shipdate", x, y, 100)]


# raw table -> (driver table, projection)
RAW = {
    "hospital_general": ("customer", _hospital()),
    "timely_care": ("orders", _timely()),
    "complications": ("lineitem", _complications()),
    "outpatient_imaging": ("events", _imaging()),
    "infections": ("lineitem", _infections()),
}


AMOUNTS = {"customer": "c_acctbal", "orders": "o_totalprice", "lineitem": "l_extendedprice", "events": "value"}


def _for_spark(expression: str, amount: str) -> str:
    """The same value for less work: cents come from a column, and ``_pick`` reads an array that is made when planning.

    Spark would round the amount anew wherever a CASE names it, and split the list for every row. Indexes never leave the lists;
    ``element_at`` would take a NULL one for a number, if the list holds no NULL.
    """
    listed = re.sub(r"nullif\(split_part\('([^']*)', ';', ", lambda m: "try_element_at(array({}), ".format(
        ", ".join("NULL" if v == "~" else f"'{v}'" for v in m[1].split(";"))), expression)
    return listed.replace("), '~')", ")").replace(_cents(amount), "__cents")


def raw_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    source, cols = RAW[table]
    rows = spark.read.parquet(f"{sf_dir}/{source}.parquet").selectExpr("*", f"{_cents(AMOUNTS[source])} AS __cents")
    return rows.selectExpr(*[f"{_for_spark(e, AMOUNTS[source])} AS {n}" for n, e in cols])


def raw_sql(table: str) -> str:
    source, cols = RAW[table]
    return "SELECT " + ", ".join(f"{e} AS {n}" for n, e in cols) + f" FROM {source}"

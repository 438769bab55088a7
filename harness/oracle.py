"""DuckDB SQL for every registered query, written independently of the Spark code.

A query is assembled from named CTEs (raw tables, typed tables, views). Averages and shares are
computed in integers, so half-up rounding is exact.
"""

from __future__ import annotations

import re

from caremeter.sources.schemas import LENGTH_LIMITS, PLACE, RAW_COLUMNS, SILVER_SCHEMAS
from harness.derive import RAW, raw_sql

FACTS = ("timely_care", "complications", "outpatient_imaging", "infections")
GROUPS = ("mort", "safety", "readm", "pt_exp", "te")
# fixed values: footnote codes
BLOCKED = ("1", "2", "3", "4", "5", "7", "8", "12", "13", "23", "28", "29")


# ---- fragments -------------------------------------------------------------------------

def quoted(items) -> str:
    return ", ".join(f"'{i}'" for i in items)


def has(col: str, codes) -> str:
    return f"coalesce(list_has_any(list_transform(string_split({col}, ','), lambda z: trim(z)), [{quoted(codes)}]), false)"


def missing(col: str) -> str:
    return f"(coalesce({col}, '') IN ('', 'Not Available', 'N/A'))"


def as_int(col: str) -> str:
    return f"CASE WHEN regexp_full_match({col}, '\\d+') THEN TRY_CAST({col} AS BIGINT) END"


def is_num(col: str) -> str:
    return f"coalesce(regexp_full_match({col}, '\\d+\\.?\\d*'), false)"


def as_dec(col: str) -> str:
    return f"CASE WHEN {is_num(col)} THEN TRY_CAST({col} AS DECIMAL(38,12)) END"


def as_whole_dec(col: str) -> str:
    """The decimal, NULL where its text has more digits than the type keeps."""
    return f"CASE WHEN NOT regexp_full_match({col}, '\\d+\\.\\d{{12}}\\d*[1-9]\\d*') THEN {as_dec(col)} END"


def as_date(col: str) -> str:
    return (f"CASE WHEN regexp_matches({col}, '^\\d\\d/\\d\\d/\\d{{4}}') "
            f"THEN CAST(try_strptime(left({col}, 10), '%m/%d/%Y') AS DATE) END")


def share(part: str, whole: str, digits: int) -> str:
    s = 10 ** digits
    return f"((CAST({part} AS HUGEINT) * {200 * s} + ({whole})) // nullif(2 * ({whole}), 0)) / {s}::DOUBLE"


def mean(col: str, digits: int, where: str = "") -> str:
    """Half-up rounded average of a non-negative decimal column."""
    f = f" FILTER (WHERE {where})" if where else ""
    n, s = f"count({col}){f}", 10 ** digits
    total = f"CAST(sum(CAST(CAST(({col}) AS DECIMAL(38,6)) * 1000000 AS HUGEINT)){f} AS HUGEINT)"
    return f"(({total} * {2 * s} + {n} * 1000000) // nullif(2 * {n} * 1000000, 0)) / {s}::DOUBLE"


def deviation(col: str, digits: int = 2) -> str:
    return f"round(stddev_samp(CAST({col} AS DOUBLE)), {digits})"


def corr(x: str, y: str) -> str:
    x, y = f"CAST({x} AS DOUBLE)", f"CAST({y} AS DOUBLE)"
    both = f"FILTER (WHERE {x} IS NOT NULL AND {y} IS NOT NULL)"
    return f"covar_pop({x}, {y}) / nullif(stddev_pop({x}) {both} * stddev_pop({y}) {both}, 0)"


def r4(expr: str) -> str:
    return f"round({expr}, 4) + 0.0::DOUBLE"


def percentile(col: str, hundredths: int, digits: int = 2, where: str = "true") -> str:
    """Interpolated percentile of a non-negative decimal column, in integers."""
    v = f"list_sort(list(CAST(({col}) * 1000000 AS HUGEINT)) FILTER (WHERE ({col}) IS NOT NULL AND {where}))"
    pos = f"((len({v}) - 1) * {hundredths})"
    lo, hi = f"{v}[CAST({pos} // 100 + 1 AS BIGINT)]", f"coalesce({v}[CAST({pos} // 100 + 2 AS BIGINT)], 0)"
    unit = 10 ** (8 - digits)
    return f"(({lo} * (100 - {pos} % 100) + {hi} * ({pos} % 100) + {unit // 2}) // {unit}) / {10 ** digits}::DOUBLE"


def num(col: str, name: str | None = None) -> str:
    return f"CAST({col} AS DOUBLE) AS {name or col}"


def txt(col: str, name: str | None = None) -> str:
    return f"CAST({col} AS VARCHAR) AS {name or col}"


def each(template: str, tables=FACTS) -> str:
    return " UNION ALL ".join(template.replace("@t", t) for t in tables)


# ---- typed tables ----------------------------------------------------------------------

def _place() -> list[str]:
    return [f"trim(upper({c})) AS state" if c == "state" else f"trim({c}) AS {c}" for c in PLACE]


def _usability(lead: str = "") -> list[str]:
    return [
        f"NOT {missing('score')} AS score_available",
        f"NOT {missing('score')} AND NOT {has('footnote', BLOCKED)} AS is_score_usable",
        f"CASE {lead} WHEN {has('footnote', ('1', '4', '5'))} THEN 'No Score' WHEN {has('footnote', ('7', '12', '13'))} THEN 'Not Applicable' "
        f"WHEN {has('footnote', ('2', '3', '11', '23', '28', '29'))} THEN 'Use With Caution' WHEN {missing('score')} THEN 'No Score' "
        "END AS score_exclusion_reason",
    ]


def _period() -> list[str]:
    return ["trim(footnote) AS footnote", f"{as_date('start_date')} AS start_date", f"{as_date('end_date')} AS end_date"]


COMPARED = ("CASE WHEN lower(compared_to_national) LIKE '%better%' THEN 'Better' "
            "WHEN lower(compared_to_national) LIKE '%no different%' THEN 'No Different' "
            "WHEN lower(compared_to_national) LIKE '%worse%' THEN 'Worse' END AS compared_to_national")


def _hospital_sql() -> str:
    cols = _place() + [
        "trim(hospital_type) AS hospital_type",
        "CASE WHEN regexp_matches(hospital_ownership, 'government|veterans|defense', 'i') THEN 'Government' "
        "WHEN regexp_matches(hospital_ownership, 'non-profit', 'i') THEN 'Non-Profit' "
        "WHEN hospital_ownership IN ('Proprietary', 'Physician') THEN 'For-Profit' "
        "WHEN hospital_ownership = 'Tribal' THEN 'Tribal' ELSE 'Other' END AS hospital_ownership",
        "trim(hospital_ownership) AS hospital_ownership_details",
        "CASE emergency_services WHEN 'Yes' THEN true WHEN 'No' THEN false END AS emergency_services",
        "CASE birthing_friendly_designation WHEN 'Y' THEN true END AS birthing_friendly_designation",
        f"{as_int('hospital_overall_rating')} AS hospital_overall_rating",
        "trim(hospital_overall_rating_footnote) AS hospital_overall_rating_footnote"]
    for g in GROUPS:
        note, own, all_ = f"{g}_group_footnote", as_int(f"facility_{g}_measure_count"), as_int(f"{g}_group_measure_count")
        issue = has(note, ('23',)) if g in ("mort", "safety", "readm") else "false"
        cols += [f"{all_} AS {g}_group_measures_count", f"{own} AS facility_{g}_measures_count"]
        if g in ("mort", "safety", "readm"):
            cols += [f"{as_int(f'{g}_measures_{o}')} AS {g}_measures_{o}" for o in ("better", "no_different", "worse")]
        cols += [f"trim({note}) AS {note}", f"{has(note, ('5',))} AS {g}_not_reported", f"{has(note, ('19',))} AS {g}_not_participating",
                 f"{has(note, ('22',))} AS {g}_dod_hospital", f"{issue} AS {g}_data_issue",
                 f"CASE WHEN {has(note, ('22',))} THEN 'Federal (DoD, VA)' WHEN {has(note, ('19',))} THEN 'Not Participating' "
                 f"WHEN {issue} THEN 'Data Quality Issue' WHEN {has(note, ('5',))} THEN 'Insufficient Data' "
                 f"WHEN ({own}) = ({all_}) THEN 'Fully Rated' WHEN ({own}) > 0 THEN 'Partially Rated' ELSE 'Not Rated' END "
                 f"AS {g}_reporting_status"]
    return f"SELECT {', '.join(cols)} FROM raw_hospital_general"


def _fact_sql(table: str, extra: list[str], lead: str = "") -> str:
    return f"SELECT {', '.join(_place() + extra + _usability(lead) + _period())} FROM raw_{table}"


_ID = ["trim(measure_id) AS measure_id", "trim(measure_name) AS measure_name"]

CTES = {f"raw_{t}": raw_sql(t) for t in RAW}
CTES |= {
    "hospital_general": _hospital_sql(),
    "timely_care": _fact_sql("timely_care", [
        "trim(condition) AS condition", *_ID, f"{as_dec('score')} AS score_numeric",
        f"CASE WHEN NOT {missing('score')} AND ({as_dec('score')}) IS NULL THEN score END AS score_text",
        f"{as_int('sample')} AS sample"]),
    "complications": _fact_sql("complications", [
        *_ID, COMPARED, f"{as_int('denominator')} AS denominator",
        *[f"{as_dec(c)} AS {c}" for c in ("score", "lower_estimate", "higher_estimate")]]),
    "outpatient_imaging": _fact_sql("outpatient_imaging", [*_ID, f"{as_dec('score')} AS score"]),
    "infections": _fact_sql("infections", [
        *_ID, "nullif(trim(regexp_extract(measure_id, '[^_]+$')), '') AS measure_suffix", COMPARED,
        f"{as_dec('score')} AS score"], lead=f"WHEN {has('footnote', ('8',))} THEN 'No Score - Zero Infections'"),
}

# ---- views -----------------------------------------------------------------------------

# fixed values: states of each region
REGION_STATES = {
    "Northeast": (
        "CT", "ME", "MA", "NH", "RI", "VT", "NJ", "NY", "PA"),
    "Midwest": (
        "IL", "IN", "MI", "OH", "WI", "IA", "KS", "MN", "MO", "NE", "ND", "SD"),
    "South": (
        "DE", "FL", "GA", "MD", "NC", "SC", "VA", "DC", "WV", "AL", "KY", "MS", "TN", "AR", "LA", "OK", "TX"),
    "West": (
        "AZ", "CO", "ID", "MT", "NV", "NM", "UT", "WY", "AK", "CA", "HI", "OR", "WA"),
    "Territory": (
        "PR", "GU", "VI", "AS", "MP"),
}
REGION = "CASE " + " ".join(f"WHEN state IN ({quoted(states)}) THEN '{name}'" for name, states in REGION_STATES.items()) + " ELSE '@else' END"
ED_WAITS = "regexp_full_match(measure_id, 'OP_18[abcd]')"
IMG = "measure_id IN ('OP-10', 'OP-13', 'OP-39')"


def _entity(table: str, score: str, where: str, name: str, used: str, period: str, digits: int = 2) -> str:
    return (f"SELECT facility_id, {mean(score, digits)} AS {name}, count(*) AS {used}, min(start_date) AS {period}_period_start, "
            f"max(end_date) AS {period}_period_end FROM {table} WHERE is_score_usable AND {score} IS NOT NULL AND {where} "
            "GROUP BY facility_id")


DIMS = "d.facility_id, d.facility_name, d.hospital_ownership, d.hospital_type, d.state, d.region, d.hospital_overall_rating"
PREFIX = {"mort": "MORT", "psi": "PSI", "comp_cat": "COMP"}


def _mix_sql() -> str:
    worse, rated = "compared_to_national = 'Worse'", "compared_to_national IS NOT NULL"
    cols = [f"count_if({rated}) AS comp_rated_total", "count_if(compared_to_national = 'Better') AS comp_better",
            "count_if(compared_to_national = 'No Different') AS comp_no_different", f"count_if({worse}) AS comp_worse",
            f"{share(f'count_if({worse})', f'count_if({rated})', 2)} AS complication_pct_worse"]
    for name, p in PREFIX.items():
        mine = f"starts_with(measure_id, '{p}')"
        n = f"count_if({mine} AND {rated})"
        cols += [f"{n} AS {name}_rated", f"{share(f'count_if({mine} AND {worse})', n, 2)} AS {name}_pct_worse"]
    return (f"SELECT facility_id, {', '.join(cols)}, min(start_date) AS comp_period_start, max(end_date) AS comp_period_end "
            "FROM complications WHERE is_score_usable GROUP BY facility_id")


CTES |= {
    "dim": "SELECT facility_id, facility_name, hospital_type, hospital_ownership, hospital_ownership_details, state, "
           f"{REGION.replace('@else', 'Unknown')} AS region, hospital_overall_rating FROM hospital_general",
    "img": _entity("outpatient_imaging", "score", IMG, "avg_imaging_score", "imaging_measures_used", "imaging"),
    "waits": _entity("timely_care", "score_numeric", f"{ED_WAITS} AND score_numeric <= 1440", "avg_ed_wait_minutes",
                     "ed_measures_used", "ed"),
    "process": _entity("timely_care", "score_numeric",
                       "condition IN ('Colonoscopy care', 'Healthcare Personnel Vaccination')",
                       "avg_process_care_score", "process_measures_count", "process"),
    "mix": _mix_sql(),
    "view_imaging": f"SELECT {DIMS}, img.* EXCLUDE (facility_id), waits.* EXCLUDE (facility_id) FROM dim d "
                    "JOIN img USING (facility_id) JOIN waits USING (facility_id)",
    "view_owner": "SELECT hospital_ownership, count(*) AS n_hospitals, "
                  f"{mean('CAST(avg_imaging_score AS DECIMAL(18,2))', 2)} AS avg_imaging_score, "
                  f"{deviation('avg_imaging_score')} AS stddev_imaging_score, "
                  f"{mean('CAST(avg_ed_wait_minutes AS DECIMAL(18,2))', 2)} AS avg_ed_wait_minutes, "
                  f"{deviation('avg_ed_wait_minutes')} AS stddev_ed_wait_minutes, "
                  f"{mean('hospital_overall_rating', 2)} AS avg_star_rating "
                  "FROM view_imaging WHERE hospital_ownership <> 'Tribal' GROUP BY hospital_ownership",
    "view_outcome": f"SELECT {DIMS}, mix.* EXCLUDE (facility_id), process.* EXCLUDE (facility_id) FROM dim d "
                    "JOIN mix USING (facility_id) JOIN process USING (facility_id) WHERE comp_rated_total >= 3",
    "ed_ids": "SELECT DISTINCT facility_id FROM timely_care WHERE condition = 'Emergency Department' AND is_score_usable "
              "AND score_numeric IS NOT NULL",
    "img_ids": "SELECT DISTINCT facility_id FROM outpatient_imaging WHERE is_score_usable AND score IS NOT NULL",
    "rated_ids": "SELECT facility_id, count(*) AS n FROM complications WHERE is_score_usable AND compared_to_national IS NOT NULL "
                 "GROUP BY facility_id",
    "hopeless": "SELECT facility_id FROM (" + each("SELECT facility_id, is_score_usable FROM @t")
                + ") GROUP BY facility_id HAVING count_if(is_score_usable) = 0",
    "pairs": "SELECT facility_id, avg_imaging_score, avg_ed_wait_minutes FROM img JOIN waits USING (facility_id)",
}


def big_counts(sql: str) -> str:
    """count_if gives a 128-bit integer here; cast it to the 64-bit type that count gives."""
    out, start = "", 0
    while (at := sql.find("count_if(", start)) >= 0:
        depth, end = 1, at + len("count_if(")
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        out += f"{sql[start:at]}CAST({sql[at:end]} AS BIGINT)"
        start = end
    return out + sql[start:]


def assemble(body: str) -> str:
    """Prefix a query with the CTEs it uses, directly or through other CTEs, in dependency order."""
    order: list[str] = []

    def need(sql: str) -> None:
        for name in re.findall(r"\b(?:FROM|JOIN)\s+([a-z_]+)", sql):
            if name in CTES and name not in order:
                need(CTES[name])
                order.append(name)

    need(body)
    if not order:
        return big_counts(body)
    return big_counts("WITH " + ", ".join(f"{n} AS ({CTES[n]})" for n in order) + f" {body}")


# ---- queries ---------------------------------------------------------------------------

def _typed(table: str) -> str:
    cols = [num(f.name) if f.dataType.typeName() == "decimal" else txt(f.name) if f.dataType.typeName() == "date" else f.name
            for f in SILVER_SCHEMAS[table].fields]
    return f"SELECT {', '.join(cols)} FROM {table}"


def _counts(table: str, cols: str, where: str = "true", n: str = "n") -> str:
    return f"SELECT {cols}, count(*) AS {n} FROM {table} WHERE {where} GROUP BY {cols}"


def _row_key(cols) -> str:
    return "md5(concat_ws(chr(1), " + ", ".join(f"coalesce({c}, chr(2))" for c in cols) + "))"


def duplicates(table: str, cols, keys: str, order: str, key_cols=None) -> str:
    return (f"SELECT {', '.join(cols)}, r AS ranking FROM (SELECT *, row_number() OVER (PARTITION BY {keys} "
            f"ORDER BY {order} ASC NULLS LAST, {_row_key(key_cols or cols)}) AS r FROM {table}) WHERE r > 1")


def _missing(table: str, col: str) -> str:
    return (f"SELECT '{table}' AS table_name, '{col}' AS column_name, count(*) AS total, "
            f"count_if(coalesce({col}, '') = '') AS blank_or_null, count_if({is_num(col)}) AS numeric, "
            f"count_if({col} = 'Not Available') AS not_available FROM raw_{table}")


def _rules(table: str, present: str) -> str:
    rules = {
        "null_facility_id": "facility_id IS NULL",
        "usable_without_score": f"is_score_usable AND NOT {present}",
        "unusable_score_without_reason": f"NOT is_score_usable AND {present} AND score_exclusion_reason IS NULL",
        "usable_with_blocked_code": f"is_score_usable AND {has('footnote', BLOCKED)}",
        "inverted_dates": "start_date > end_date",
    }
    return " UNION ALL ".join(f"SELECT '{table}' AS table_name, '{n}' AS check_name, count_if({r}) AS bad_rows FROM {table}"
                              for n, r in rules.items())


PRESENT = {t: "(score_numeric IS NOT NULL OR score_text IS NOT NULL)" if t == "timely_care" else "(score IS NOT NULL)" for t in FACTS}


def _lost(table: str) -> str:
    return (f"SELECT '{table}' AS table_name, count(*) AS lost_scores FROM raw_{table} b JOIN {table} s "
            "ON trim(b.facility_id) = s.facility_id AND trim(b.measure_id) = s.measure_id "
            f"WHERE NOT {missing('b.score')} AND NOT regexp_full_match(b.score, '\\s*') AND NOT "
            + PRESENT[table].replace("score_numeric", "s.score_numeric").replace("score_text", "s.score_text").replace("(score ", "(s.score "))


def _unlike(table: str) -> str:
    number, text = ("score_numeric", "trim(score_text)") if table == "timely_care" else ("score", "NULL")
    published = f"CASE WHEN {as_dec('score')} IS NULL AND NOT {missing('score')} THEN nullif(trim(score), '') END"
    return (f"SELECT '{table}' AS table_name, measure_id, facility_id, CAST(n AS DOUBLE) AS score_number, t AS score_text, "
            "count(*) FILTER (side = 1) AS n_published, count(*) FILTER (side = 2) AS n_typed FROM ("
            f"SELECT trim(measure_id) AS measure_id, trim(facility_id) AS facility_id, {as_dec('score')} AS n, {published} AS t, 1 AS side FROM raw_{table} "
            f"UNION ALL SELECT measure_id, facility_id, CAST({number} AS DECIMAL(38,12)), {text}, 2 FROM {table}) GROUP BY measure_id, facility_id, n, t "
            "HAVING count(*) FILTER (side = 1) <> count(*) FILTER (side = 2)")


def _spot(table: str, keys, ids, left: dict, right: dict) -> str:
    on = " AND ".join(f"trim(b.{k}) = s.{k}" for k in keys)
    cols = [f"s.{k}" for k in keys] + [f"b.{c} AS {a}" for c, a in left.items()]
    cols += [f"s.{c} AS {a}" if "date" not in c and c != "score" and c != "score_numeric" else
             (txt(f"s.{c}", a) if "date" in c else num(f"s.{c}", a)) for c, a in right.items()]
    return f"SELECT {', '.join(cols)}, count(*) AS n_rows FROM raw_{table} b JOIN {table} s ON {on} WHERE s.facility_id IN ({quoted(ids)}) GROUP BY ALL"


def _inventory(table: str, by: str, score: str, where: str, avg: str = "", having: str = "true", digits=None) -> str:
    lo, hi = (f"round({f}({score}), {digits})" if digits else f"{f}({score})" for f in ("min", "max"))
    return (f"SELECT {by}, count(*) AS total_rows, count_if(is_score_usable) AS usable_rows, "
            f"{share('count_if(is_score_usable)', 'count(*)', 2)} AS pct_usable, {num(lo, 'min_score')}, {num(hi, 'max_score')}, "
            f"{mean(score, 2, avg)} AS avg_score FROM {table} WHERE {where} GROUP BY {by} HAVING {having}")


def _distribution(table: str, by: str, score: str, where: str) -> str:
    return (f"SELECT {by}, count(*) AS n, {num(f'min({score})', 'min_val')}, {percentile(score, 25)} AS p25, "
            f"{percentile(score, 50)} AS median, {percentile(score, 75)} AS p75, {num(f'max({score})', 'max_val')} "
            f"FROM {table} WHERE is_score_usable AND {score} IS NOT NULL AND {where} GROUP BY {by}")


def _shared(base: str, keys: str, within: str, n: str, pct: str, digits: int, extra: str = "") -> str:
    total = f"sum(k) OVER ({f'PARTITION BY {within}' if within else ''})"
    return (f"SELECT {keys}, k AS {n}, {share('k', total, digits)} AS {pct}{extra and ', ' + extra} "
            f"FROM (SELECT {keys}, count(*) AS k{', ' + extra_aggs(extra) if extra else ''} FROM {base} GROUP BY {keys})")


def extra_aggs(extra: str) -> str:
    return {"avg_star_rating, rated_hospitals": f"{mean('hospital_overall_rating', 2)} AS avg_star_rating, "
            "count(hospital_overall_rating) AS rated_hospitals"}[extra]


STARS = "hospital_overall_rating"
HIGH_LOW = (f"{share(f'count_if({STARS} >= 4)', f'count({STARS})', 1)} AS pct_high_performers, "
            f"{share(f'count_if({STARS} <= 2)', f'count({STARS})', 1)} AS pct_low_performers")
_REPORTED = "CAST(" + " + ".join(f"coalesce(facility_{g}_measures_count, 0)" for g in GROUPS) + " AS BIGINT)"
_POSSIBLE = "CAST(" + " + ".join(f"coalesce({g}_group_measures_count, 0)" for g in GROUPS) + " AS BIGINT)"
COMPLETE = share(_REPORTED, _POSSIBLE, 1)
_STATUSES = "[" + ", ".join(f"{g}_reporting_status" for g in GROUPS) + "]"
PROFILE = (f"CASE WHEN list_unique({_STATUSES}) = 1 AND mort_reporting_status = 'Fully Rated' THEN 'All Groups Fully Rated' "
           f"WHEN list_contains({_STATUSES}, 'Not Participating') THEN 'At Least One Not Participating' "
           f"WHEN list_contains({_STATUSES}, 'Federal (DoD, VA)') THEN 'Federal Hospital' ELSE 'Mixed / Partial' END")
CTES |= {
    "complete": f"SELECT {STARS} AS stars, CAST({COMPLETE} AS DECIMAL(18,1)) AS c FROM hospital_general WHERE {STARS} IS NOT NULL",
    "profiled": f"SELECT {PROFILE} AS reporting_profile, {STARS} FROM hospital_general",
    "categorised": "SELECT CASE left(measure_id, 3) WHEN 'PSI' THEN 'Patient Safety' ELSE CASE left(measure_id, 4) WHEN 'MORT' "
                   "THEN 'Mortality' WHEN 'COMP' THEN 'Complications' ELSE 'Other' END END AS category, compared_to_national "
                   "FROM complications WHERE is_score_usable AND compared_to_national IS NOT NULL",
    "owned_outcomes": "SELECT hospital_ownership, compared_to_national FROM complications JOIN hospital_general USING (facility_id) "
                      "WHERE is_score_usable AND compared_to_national IS NOT NULL",
    "survivors": "SELECT hospital_ownership FROM ed_ids JOIN img_ids USING (facility_id) JOIN hospital_general USING (facility_id) "
                 "WHERE hospital_ownership <> 'Tribal'",
    "starred": f"SELECT hospital_ownership, {STARS} FROM hospital_general WHERE {STARS} IS NOT NULL",
    "sir": f"SELECT facility_id, CAST({mean('score', 2)} AS DECIMAL(18,2)) AS avg_sir FROM infections WHERE measure_suffix = 'SIR' "
           "AND is_score_usable AND score IS NOT NULL GROUP BY facility_id",
    "sir_mix": "SELECT avg_sir, CAST(complication_pct_worse AS DECIMAL(18,2)) AS w FROM sir JOIN mix USING (facility_id) "
               "WHERE comp_rated_total >= 3",
}


def _d2(col: str) -> str:
    return f"CAST({col} AS DECIMAL(18,2))"


def _versus(table: str, score: str, where: str, digits: int, own: str, peer: str, diff: str, extra: str = "") -> str:
    return (f"SELECT f.facility_id, h.state, f.measure_id, {extra}{num(f'f.{score}', own)}, b.a AS {peer}, "
            f"CAST(round(f.{score} - CAST(b.a AS DECIMAL(18,{digits})), {digits}) AS DOUBLE) AS {diff} "
            f"FROM {table} f JOIN hospital_general h USING (facility_id) JOIN (SELECT h2.state, measure_id, {mean(score, digits)} AS a "
            f"FROM {table} JOIN hospital_general h2 USING (facility_id) WHERE {where} AND is_score_usable AND {score} IS NOT NULL "
            f"GROUP BY ALL) b ON b.state = h.state AND b.measure_id = f.measure_id WHERE f.is_score_usable")


TYPED = [("hospital_general", c, "int") for c in (
    "hospital_overall_rating",
    "mort_group_measure_count", "facility_mort_measure_count", "mort_measures_better", "mort_measures_no_different", "mort_measures_worse",
    "safety_group_measure_count", "facility_safety_measure_count", "safety_measures_better", "safety_measures_no_different",
    "safety_measures_worse", "readm_group_measure_count", "facility_readm_measure_count", "readm_measures_better",
    "readm_measures_no_different", "readm_measures_worse", "pt_exp_group_measure_count", "facility_pt_exp_measure_count",
    "te_group_measure_count", "facility_te_measure_count")]
TYPED += [("timely_care", "sample", "int"), ("complications", "denominator", "int"), ("complications", "lower_estimate", "decimal"),
          ("complications", "higher_estimate", "decimal")]
TYPED += [(t, "score", "decimal") for t in FACTS] + [(t, c, "date") for t in FACTS for c in ("start_date", "end_date")]


def _unread(table: str, col: str, kind: str) -> str:
    form = {"int": f"coalesce(regexp_full_match({col}, '\\d+'), false)", "decimal": is_num(col),
            "date": f"coalesce(regexp_matches({col}, '^\\d\\d/\\d\\d/\\d{{4}}'), false)"}[kind]
    value = {"int": as_int, "decimal": as_whole_dec, "date": as_date}[kind](col)
    real = f"NOT {missing(col)} AND NOT regexp_full_match({col}, '\\s*')"
    return (f"SELECT '{table}' AS table_name, '{col}' AS column_name, count(*) FILTER (WHERE {real}) AS real_values, "
            f"count(*) FILTER (WHERE {real} AND NOT {form}) AS wrong_form, "
            f"count(*) FILTER (WHERE {form} AND ({value}) IS NULL) AS beyond_type FROM raw_{table}")


GAP = {"complications": "'PSI_03', 'PSI_90'", "outpatient_imaging": "'OP-10'", "infections": "'HAI_1_SIR'"}


def _gap() -> str:
    own = " UNION ALL ".join(f"SELECT facility_id, measure_id, score FROM {t} WHERE measure_id IN ({m})" for t, m in GAP.items())
    keys = "state, hospital_ownership, hospital_type"
    best = " UNION ALL ".join(
        f"SELECT h.state, h.hospital_ownership, h.hospital_type, measure_id, {mean('score', 2)} AS a FROM {t} JOIN hospital_general h "
        f"USING (facility_id) WHERE measure_id IN ({m}) AND is_score_usable AND {STARS} = 5 GROUP BY ALL" for t, m in GAP.items())
    return (f"SELECT o.facility_id, {keys}, measure_id, CAST(round(o.score, 2) AS DOUBLE) AS own_score, b.a AS best_peer_avg, "
            f"CAST(round(o.score - {_d2('b.a')}, 2) AS DOUBLE) AS gap_to_close FROM ({own}) o JOIN hospital_general USING (facility_id) "
            f"JOIN ({best}) b USING ({keys}, measure_id)")


def _pair_stats(x: str, y: str, n: str, names, digits=(2, 2), r: str | None = None, r2: str | None = None) -> str:
    out = [f"count(*) AS {n}", f"{mean(x, digits[0])} AS {names[0]}", f"{deviation(x, digits[0])} AS {names[1]}",
           f"{mean(y, digits[1])} AS {names[2]}", f"{deviation(y, digits[1])} AS {names[3]}"]
    out += [f"{r4(corr(x, y))} AS {r}"] if r else []
    out += [f"{r4(f'pow({corr(x, y)}, 2)')} AS {r2}"] if r2 else []
    return ", ".join(out)


PAIR = ("avg_imaging_score", "sd_imaging", "avg_ed_wait_minutes", "sd_ed_wait")
_PX, _PY = _d2("avg_imaging_score"), _d2("avg_ed_wait_minutes")
_PROC, _WORSE, _MORT, _PSI = (_d2(c) for c in ("avg_process_care_score", "complication_pct_worse", "mort_pct_worse", "psi_pct_worse"))
_USABLE_ED = "condition = 'Emergency Department'"
STATUS5 = ", ".join(f"{g}_reporting_status" for g in GROUPS)
SPOT_IDS = ("000001", "000012", "000051")
_VIEW_OUT = [txt(c) for c in ("comp_period_start", "comp_period_end", "process_period_start", "process_period_end")]

SQL = {
    # loads
    **{f"t_silver_{t}": _typed(t) for t in SILVER_SCHEMAS},
    **{f"s_bronze_{t}": f"SELECT {', '.join(RAW_COLUMNS[t])} FROM raw_{t}" for t in RAW_COLUMNS},
    # bronze profiles
    "c24_bronze_row_counts": each("SELECT '@t' AS table_name, count(*) AS row_count FROM raw_@t", RAW),
    "c03_repeated_facilities": _counts("raw_hospital_general", "facility_id") + " HAVING count(*) > 1",
    **{f"c04_duplicate_rows_{t}": duplicates(
        f"raw_{t}", RAW_COLUMNS[t], "facility_id, measure_id" + (", condition" if t == "timely_care" else ""), "start_date")
        for t in FACTS},
    "c25_missing_scores": " UNION ALL ".join(
        _missing(t, c) for t, cols in {"timely_care": ["score"], "outpatient_imaging": ["score"], "infections": ["score"],
                                       "complications": ["score", "denominator", "lower_estimate", "higher_estimate"]}.items()
        for c in cols),
    **{f"c26_odd_scores_{t}": _counts(f"raw_{t}", "score", f"score NOT IN ('', 'Not Available') AND NOT {is_num('score')}")
       for t in ("timely_care", "outpatient_imaging")},
    **{f"c27_distinct_{c}": f"SELECT DISTINCT {c} FROM raw_{t}" for t, c in (
        ("hospital_general", "hospital_overall_rating"), ("hospital_general", "hospital_type"),
        ("hospital_general", "hospital_ownership"), ("hospital_general", "emergency_services"),
        ("hospital_general", "birthing_friendly_designation"), ("timely_care", "condition"), ("infections", "measure_id"))},
    "c27_distinct_start_dates": "SELECT DISTINCT start_date FROM raw_timely_care",
    "c27_distinct_end_dates": "SELECT DISTINCT end_date FROM raw_complications",
    "c28_hospital_type_counts": _counts("raw_hospital_general", "hospital_type"),
    "c28_ownership_counts": _counts("raw_hospital_general", "hospital_ownership"),
    "c28_timely_measure_counts": _counts("raw_timely_care", "measure_id", n="n_hospitals"),
    "c28_complication_measure_counts": _counts("raw_complications", "measure_id", n="n_hospitals"),
    "c28_imaging_measure_counts": _counts("raw_outpatient_imaging", "measure_id", n="n_measure_id"),
    "c28_complication_comparisons": _counts("raw_complications", "compared_to_national", n="n_of_appearances"),
    "c28_infection_comparisons": _counts("raw_infections", "compared_to_national", n="n_of_times"),
    "c28_rows_per_facility": _counts("raw_infections", "facility_id", n="n_per_id"),
    "c29_footnote_coverage": "SELECT count(*) AS total_hospitals, " + ", ".join(
        f"count(nullif({g}_group_footnote, '')) AS {g}_footnoted" for g in GROUPS) + " FROM raw_hospital_general",
    "c22_group_footnotes": _counts("raw_hospital_general", "mort_group_footnote", "mort_group_footnote <> ''"),
    "c22_bronze_footnotes": each("SELECT '@t' AS table_name, footnote, count(*) AS n FROM raw_@t GROUP BY footnote"),
    "c30_odd_infection_counts": _counts("raw_infections", "facility_id", n="n_per_id") + " HAVING count(*) <> 36",
    "c31_text_date_range": each("SELECT '@t' AS table_name, min(start_date) AS earliest_period, max(end_date) AS latest_period FROM raw_@t"),
    "c32_join_match_count": "SELECT 'hospital_to_timely_care' AS join_test, count(*) AS matched_rows FROM raw_hospital_general h "
                            "JOIN raw_timely_care t ON t.facility_id = h.facility_id",
    "c33_id_lengths": each("SELECT '@t' AS table_name, CAST(length(facility_id) AS INTEGER) AS id_length, count(*) AS n FROM raw_@t GROUP BY ALL", RAW),
    # silver validation
    "c01_count_parity": each("SELECT '@t' AS table_name, (SELECT count(*) FROM raw_@t) AS bronze_count, count(*) AS silver_count, "
                             "(SELECT count(*) FROM raw_@t) = count(*) AS counts_match FROM @t", RAW),
    "c02_null_keys": each("SELECT '@t' AS table_name, count(*) - count(facility_id) AS null_keys FROM @t", RAW),
    "c03_duplicate_pairs": each("SELECT '@t' AS table_name, count(*) AS duplicate_keys FROM (SELECT facility_id, measure_id FROM @t "
                                "GROUP BY ALL HAVING count(*) > 1)"),
    "c05_orphan_ids": each("SELECT '@t' AS table_name, count(DISTINCT facility_id) AS orphan_ids FROM @t ANTI JOIN hospital_general "
                           "USING (facility_id)"),
    "c11_c12_c17_c20_fact_invariants": " UNION ALL ".join(_rules(t, PRESENT[t]) for t in FACTS),
    "c00_text_lengths": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{c}' AS check_name, count_if(length({c}) > {n}) AS bad_rows FROM {t}"
        for t, limits in LENGTH_LIMITS.items() for c, n in limits.items()),
    "c06_ownership_domain": _counts("hospital_general", "hospital_ownership"),
    "c06_rating_domain": _counts("hospital_general", STARS),
    "c06_type_domain": _counts("hospital_general", "hospital_type"),
    "c07_ownership_mapping": "SELECT DISTINCT hospital_ownership, hospital_ownership_details FROM hospital_general",
    "c08_boolean_profile": " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count_if({c} IS NULL) AS nulls, count_if({c}) AS trues, count_if(NOT {c}) AS falses, "
        "count(*) AS total FROM hospital_general" for c in ("emergency_services", "birthing_friendly_designation")),
    "c09_status_by_footnote": _counts("hospital_general", "mort_reporting_status, mort_group_footnote"),
    "c06_comparison_counts": each("SELECT '@t' AS table_name, compared_to_national, count(*) AS n FROM @t GROUP BY ALL",
                                  ("complications", "infections")),
    "c10_comparison_variants": each(
        "SELECT DISTINCT compared_to_national AS value, 'bronze_@t' AS source FROM raw_@t UNION ALL "
        "SELECT DISTINCT compared_to_national, 'silver_@t' FROM @t", ("complications", "infections")),
    "c10_unmatched_comparisons": each(
        "SELECT '@t' AS table_name, compared_to_national, count(*) AS n FROM raw_@t WHERE NOT " + missing("compared_to_national")
        + " AND NOT regexp_matches(compared_to_national, 'better|no different|worse', 'i') GROUP BY ALL", ("complications", "infections")),
    "c13_multi_code_tiers": each("SELECT '@t' AS table_name, footnote, score_exclusion_reason, count(*) AS n FROM @t "
                                 "WHERE contains(footnote, ',') AND NOT is_score_usable GROUP BY ALL"),
    "c14_score_split": "SELECT count_if(score_numeric IS NOT NULL AND score_text IS NULL) AS numeric_only, "
                       "count_if(score_numeric IS NULL AND score_text IS NOT NULL) AS text_only, "
                       "count_if(score_numeric IS NOT NULL AND score_text IS NOT NULL) AS both_populated, "
                       "count_if(score_numeric IS NULL AND score_text IS NULL) AS both_null FROM timely_care",
    "c15_score_ranges": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, {num(f'min({c})', 'min_score')}, {num(f'max({c})', 'max_score')} FROM {t}"
        for t, c in ((t, "score_numeric" if t == "timely_care" else "score") for t in FACTS)),
    "c16_lost_scores": " UNION ALL ".join(_lost(t) for t in FACTS),
    "c16_unlike_scores": " UNION ALL ".join(_unlike(t) for t in FACTS),
    "c16_unread_values": " UNION ALL ".join(_unread(t, c, kind) for t, c, kind in TYPED),
    "c18_spot_hospital": _spot("hospital_general", ["facility_id"], SPOT_IDS,
                               {"facility_name": "bronze_name", "hospital_ownership": "bronze_ownership",
                                STARS: "bronze_rating", "emergency_services": "bronze_emergency"},
                               {"facility_name": "silver_name", "hospital_ownership": "silver_ownership",
                                STARS: "silver_rating", "emergency_services": "silver_emergency"}),
    "c18_spot_timely_care": _spot("timely_care", ["facility_id", "measure_id"], SPOT_IDS,
                                  {"measure_name": "measure_name", "score": "bronze_score"},
                                  {c: c for c in ("score_numeric", "score_text", "is_score_usable", "score_exclusion_reason")}),
    "c18_spot_complications": _spot("complications", ["facility_id", "measure_id"], SPOT_IDS,
                                    {"compared_to_national": "bronze_compared", "score": "bronze_score",
                                     "start_date": "bronze_start_date", "end_date": "bronze_end_date"},
                                    {"compared_to_national": "silver_compared", "score": "silver_score",
                                     "start_date": "silver_start_date", "end_date": "silver_end_date"}),
    "c18_spot_infections": _spot("infections", ["facility_id", "measure_id"], SPOT_IDS, {"score": "bronze_score"},
                                 {"score": "silver_score", "measure_suffix": "measure_suffix"}),
    "c19_date_ranges": each(f"SELECT '@t' AS table_name, {txt('min(start_date)', 'earliest')}, {txt('max(end_date)', 'latest')} FROM @t"),
    "c21_suffixes": "SELECT DISTINCT measure_suffix FROM infections",
    "c22_footnotes": each("SELECT '@t' AS table_name, footnote, count(*) AS n FROM @t GROUP BY footnote"),
    "c22_multi_code_footnotes": each("SELECT '@t' AS table_name, footnote, count(*) AS n FROM @t WHERE contains(footnote, ',') GROUP BY footnote"),
    "c22_multi_code_group_footnotes": _counts("hospital_general", "safety_group_footnote", "contains(safety_group_footnote, ',')"),
    "c23_unusable_facilities": "SELECT count(*) AS hospitals_with_no_usable_scores FROM hopeless",
    "c23_unusable_by_type": _counts("hopeless JOIN hospital_general USING (facility_id)",
                                    f"hospital_type, hospital_ownership, emergency_services, {STARS}", n="n_hospitals"),
    "c23_unusable_listed": f"SELECT facility_id, facility_name, hospital_type, state, hospital_ownership, emergency_services, {STARS}, {STATUS5} "
                           "FROM hospital_general SEMI JOIN hopeless USING (facility_id) WHERE hospital_type IN "
                           "('Acute Care Hospitals', 'Acute Care - Veterans Administration')",
    # gold
    "g1_dim_hospital": "SELECT * FROM dim",
    "g2_imaging_vs_ed_wait": "SELECT * REPLACE (" + ", ".join(txt(c) for c in (
        "imaging_period_start", "imaging_period_end", "ed_period_start", "ed_period_end")) + ") FROM view_imaging",
    "g3_ownership_imaging_ed_stats": "SELECT * FROM view_owner",
    "g4_complications_vs_process_care": f"SELECT * REPLACE ({', '.join(_VIEW_OUT)}) FROM view_outcome",
    "c24_view_counts": "SELECT 'dim_hospital' AS view_name, count(*) AS n_rows FROM dim UNION ALL SELECT 'vw_imaging_vs_ed_wait', count(*) "
                       "FROM view_imaging UNION ALL SELECT 'vw_ownership_imaging_ed_stats', count(*) FROM view_owner UNION ALL "
                       "SELECT 'vw_complications_vs_process_care', count(*) FROM view_outcome",
    "c06_region_counts": _counts("dim", "region"),
    "c35_excluded_but_usable": "SELECT 'OP-8 excluded' AS check_name, count(score) AS usable_rows_excluded FROM outpatient_imaging "
                               "WHERE measure_id = 'OP-8' AND is_score_usable",
    "c36_view_sample": "SELECT facility_id, facility_name, avg_imaging_score, imaging_measures_used, avg_ed_wait_minutes, ed_measures_used "
                       "FROM view_imaging ORDER BY facility_id LIMIT 3",
    "c18_composite_inputs": f"SELECT facility_id, measure_id, {num('score')} FROM outpatient_imaging WHERE facility_id = '000012' AND {IMG} "
                            f"AND is_score_usable AND score IS NOT NULL UNION ALL SELECT facility_id, measure_id, {num('score_numeric')} "
                            f"FROM timely_care WHERE facility_id = '000012' AND {ED_WAITS} AND is_score_usable AND score_numeric IS NOT NULL",
    "c37_ownership_shares": f"SELECT hospital_ownership, n_hospitals, {share('n_hospitals', 'sum(n_hospitals) OVER ()', 2)} AS pct_of_sample, "
                            "avg_imaging_score, stddev_imaging_score, avg_ed_wait_minutes, stddev_ed_wait_minutes FROM view_owner",
    "c38_pct_worse_bounds": "SELECT min(complication_pct_worse) AS min_pct, max(complication_pct_worse) AS max_pct, "
                            "count_if(complication_pct_worse IS NULL) AS null_count, "
                            "count_if(complication_pct_worse NOT BETWEEN 0 AND 100) AS out_of_range FROM view_outcome",
    # exploration
    "e1_ed_inventory": _inventory("timely_care", "measure_id, measure_name", "score_numeric", _USABLE_ED),
    "e2_imaging_inventory": _inventory("outpatient_imaging", "measure_id, measure_name", "score", "true"),
    "e2_imaging_inventory_usable": _inventory("outpatient_imaging", "measure_id, measure_name", "score", "is_score_usable"),
    "e3_process_inventory": _inventory("timely_care", "condition, measure_id, measure_name", "score_numeric", f"NOT {_USABLE_ED}",
                                       "is_score_usable", "count_if(is_score_usable) > 0", 2),
    "e4_outcomes_by_category": _shared("categorised", "category, compared_to_national", "category", "n", "pct_within_category", 2),
    "e5_outcomes_by_ownership": _shared("owned_outcomes", "hospital_ownership, compared_to_national", "hospital_ownership",
                                        "n_hospitals", "pct_of_total_per_ownership", 2),
    "e6_sample_overlap": "SELECT (SELECT count(*) FROM ed_ids) AS usable_ed, (SELECT count(*) FROM img_ids) AS usable_imaging, "
                         "count(*) AS usable_with_both, " + share("count(*)", "(SELECT count(*) FROM hospital_general)", 2)
                         + " AS pct_of_all_hospitals FROM ed_ids SEMI JOIN img_ids USING (facility_id)",
    "e7_survivors_by_ownership": "SELECT hospital_ownership, (SELECT count(*) FROM ed_ids) AS usable_ed, (SELECT count(*) FROM img_ids) "
                                 "AS usable_imaging, usable_with_both, pct_of_joined_sample FROM ("
                                 + _shared("survivors", "hospital_ownership", "", "usable_with_both", "pct_of_joined_sample", 2) + ")",
    "e8_complication_sample": "SELECT (SELECT count(*) FROM rated_ids) AS hospitals_with_comp, (SELECT count(*) FROM rated_ids WHERE n >= 3) "
                              "AS hospitals_with_comp_3plus, (SELECT count(*) FROM ed_ids) AS hospitals_timely_care, count(*) AS "
                              "hospitals_with_both FROM rated_ids SEMI JOIN ed_ids USING (facility_id) WHERE n >= 3",
    "e9_ed_percentiles": _distribution("timely_care", "measure_id", "score_numeric", _USABLE_ED),
    "e10_imaging_percentiles": _distribution("outpatient_imaging", "measure_id, measure_name", "score", "true"),
    "e11_imaging_outliers": f"SELECT facility_id, h.facility_name, h.state, hospital_type, hospital_ownership, {STARS}, {num('score')} "
                            "FROM outpatient_imaging JOIN hospital_general h USING (facility_id) WHERE measure_id = 'OP-39' AND is_score_usable "
                            "AND score IS NOT NULL ORDER BY score DESC, facility_id LIMIT 50",
    "e12_stars_within_ownership": _shared("starred", f"hospital_ownership, {STARS}", "hospital_ownership", "n_hospitals", "pct_within_ownership", 2),
    "e13_state_regions": f"SELECT state, {REGION.replace('@else', 'UNMAPPED')} AS region, count(*) AS n_hospitals FROM hospital_general GROUP BY ALL",
    "c34_unmapped_states": "SELECT DISTINCT state FROM dim WHERE region = 'Unknown' AND state IS NOT NULL",
    "e14_shared_measures": "SELECT measure_id, count(DISTINCT t) AS n_tables FROM (" + each("SELECT measure_id, '@t' AS t FROM @t")
                           + ") GROUP BY measure_id HAVING count(DISTINCT t) > 1",
    "e15_measure_counts": each("SELECT '@t' AS source, count(DISTINCT measure_id) AS n_measures FROM @t"),
    "e16_availability_gap": "SELECT measure_id, count(*) AS total_rows, count_if(score_available) AS score_available_num, "
                            f"count_if(is_score_usable) AS usable_rows_num, {share('count_if(score_available)', 'count(*)', 2)} AS pct_available, "
                            f"{share('count_if(is_score_usable)', 'count(*)', 2)} AS pct_usable, "
                            f"{share('count_if(score_available AND NOT is_score_usable)', 'count(*)', 2)} AS availability_usability_gap_pct "
                            "FROM infections GROUP BY measure_id",
    "e17_worst_complications": f"SELECT w.facility_id, hospital_ownership, {STARS}, w.n AS worse_measure_count, coalesce(p.k, 0) AS "
                               "process_care_measures, p.a AS avg_process_care_score FROM (SELECT facility_id, count(*) AS n FROM complications "
                               "WHERE is_score_usable AND compared_to_national = 'Worse' GROUP BY facility_id HAVING count(*) >= 3) w "
                               f"JOIN hospital_general USING (facility_id) LEFT JOIN (SELECT facility_id, count(*) AS k, {mean('score_numeric', 2)} AS a "
                               f"FROM timely_care WHERE NOT {_USABLE_ED} AND is_score_usable AND score_numeric IS NOT NULL GROUP BY facility_id) p "
                               "USING (facility_id) ORDER BY w.n DESC, w.facility_id LIMIT 50",
    "e18_imaging_ed_correlation": f"SELECT {_pair_stats(_PX, _PY, 'sample_size', PAIR, r='pearson_r', r2='r_squared')} FROM pairs",
    "e19_imaging_ed_by_ownership": f"SELECT hospital_ownership, {_pair_stats(_PX, _PY, 'n_hospitals', PAIR, r='pearson_r')} FROM pairs "
                                   "JOIN hospital_general USING (facility_id) WHERE hospital_ownership <> 'Tribal' GROUP BY hospital_ownership",
    # analyses
    "n1_ownership_overview": f"SELECT hospital_ownership, count(*) AS total_hospitals, count(*) - count({STARS}) AS hospitals_unrated, "
                             f"{share(f'count({STARS})', 'count(*)', 1)} AS pct_rated, {mean(STARS, 2)} AS avg_star_rating, "
                             f"{deviation(STARS)} AS stddev_rating, count({STARS}) AS hospitals_rated, count_if({STARS} >= 4) AS n_high_performers, "
                             f"count_if({STARS} <= 2) AS n_low_performers, {HIGH_LOW} FROM hospital_general WHERE hospital_ownership <> 'Tribal' "
                             "GROUP BY hospital_ownership",
    "n1_star_distribution": f"SELECT * EXCLUDE ({STARS}), {STARS} AS stars FROM (" + _shared("starred", f"hospital_ownership, {STARS}", "hospital_ownership", "n_hospitals", "pct_within_ownership", 1) + ")",
    "n2_ownership_subtypes": "SELECT hospital_ownership AS ownership_group, hospital_ownership_details AS ownership_subtype, count(*) AS "
                             f"total_hospitals, {mean(STARS, 2)} AS avg_rating, count({STARS}) AS rated, {HIGH_LOW} FROM hospital_general GROUP BY ALL",
    "n3_completeness_by_stars": f"SELECT stars, count(*) AS n_hospitals, {mean('c', 1)} AS avg_completeness_pct, {num('min(c)', 'min_completeness_pct')}, "
                                f"{num('max(c)', 'max_completeness_pct')} FROM complete GROUP BY stars",
    "n4_completeness_correlation": f"SELECT count(*) AS n, {r4(corr('c', 'stars'))} AS pearson_r, {r4('pow(' + corr('c', 'stars') + ', 2)')} "
                                   "AS r_squared FROM complete",
    "n5_reporting_profiles": _shared("profiled", "reporting_profile", "", "n_hospitals", "pct_of_total", 1, "avg_star_rating, rated_hospitals"),
    "n6_infections_vs_complications": "SELECT " + _pair_stats("avg_sir", "w", "sample_size", (
        "avg_sir", "sd_sir", "avg_complication_pct_worse", "sd_complication_pct_worse"), (3, 2), "pearson_r", "r_squared") + " FROM sir_mix",
    "n7_process_outcome_distribution": f"SELECT count(*) AS n_hospitals, {mean(_PROC, 2)} AS avg_process_compliance, {mean(_WORSE, 2)} AS "
                                       f"avg_complication_pct_worse, {mean(_MORT, 2)} AS avg_mort_pct_worse, {percentile(_PROC, 50)} AS "
                                       f"median_process_compliance, {percentile(_WORSE, 50)} AS median_complication_pct_worse, "
                                       f"{percentile(_MORT, 50)} AS median_mort_pct_worse, min(avg_process_care_score) AS min_process_compliance, "
                                       "max(avg_process_care_score) AS max_process_compliance, min(complication_pct_worse) AS "
                                       "min_complication_pct_worse, max(complication_pct_worse) AS max_complication_pct_worse FROM view_outcome",
    "n8_process_outcome_correlations": f"SELECT count(*) AS n_hospitals, {r4(corr(_PROC, _WORSE))} AS r_process_vs_complications, "
                                       f"{r4(corr(_PROC, _MORT))} AS r_process_vs_mortality, {r4(corr(_PROC, _PSI))} AS r_process_vs_psi, "
                                       f"{r4(f'pow({corr(_PROC, _WORSE)}, 2)')} AS r_squared_overall, "
                                       f"{r4(f'pow({corr(_PROC, _MORT)}, 2)')} AS r_squared_mortality FROM view_outcome",
    "n9_entity_profile": f"SELECT facility_id, facility_name, city, state, hospital_type, hospital_ownership, {STARS} AS stars, emergency_services, "
                         f"{STATUS5} FROM hospital_general WHERE lower(facility_name) LIKE '%#%99 machinery%'",
    "n10_entity_outcomes": f"SELECT measure_id, measure_name, {num('score')}, compared_to_national, is_score_usable, score_exclusion_reason "
                           "FROM complications WHERE facility_id = '000012'",
    "n11_ed_waits_vs_state": _versus("timely_care", "score_numeric", ED_WAITS, 1, "wait_minutes", "state_avg_wait", "vs_state_diff"),
    "n12_imaging_vs_state": _versus("outpatient_imaging", "score", IMG, 2, "own_score", "state_avg_score", "vs_state_diff", "f.measure_name, "),
    "n13_peer_ranking": f"SELECT facility_id, facility_name, state, hospital_ownership, hospital_type, {STARS} AS stars, rank() OVER w AS rank_by_stars, "
                        "count(*) OVER (PARTITION BY state, hospital_ownership, hospital_type) AS total_peers, mort_reporting_status, "
                        f"safety_reporting_status, readm_reporting_status FROM hospital_general WHERE {STARS} IS NOT NULL WINDOW w AS "
                        f"(PARTITION BY state, hospital_ownership, hospital_type ORDER BY {STARS} DESC)",
    "n13_peer_ranking_overall": f"SELECT facility_id, facility_name, {STARS} AS stars, rank() OVER (ORDER BY {STARS} DESC) AS rank_by_stars, "
                                "count(*) OVER () AS total_peers, mort_reporting_status, safety_reporting_status, readm_reporting_status "
                                f"FROM hospital_general WHERE {STARS} IS NOT NULL",
    "n14_gap_to_best": _gap(),
    # further results
    "x1_quadrants": "SELECT CASE WHEN p > mp THEN 'high' ELSE 'low' END AS avg_process_care_score_half, CASE WHEN w > mw THEN 'high' ELSE 'low' END "
                    f"AS complication_pct_worse_half, count(*) AS n, {mean('p', 2)} AS avg_avg_process_care_score, {mean('w', 2)} AS "
                    f"avg_complication_pct_worse FROM (SELECT {_PROC} AS p, {_WORSE} AS w FROM view_outcome WHERE complication_pct_worse IS NOT NULL), "
                    f"(SELECT CAST({percentile(_PROC, 50, 6)} AS DECIMAL(18,6)) AS mp, CAST({percentile(_WORSE, 50, 6)} AS DECIMAL(18,6)) AS mw "
                    "FROM view_outcome WHERE complication_pct_worse IS NOT NULL) GROUP BY 1, 2",
    "x2_unusable_by_state": f"SELECT state, count(*) AS total_rows, count_if(NOT is_score_usable) AS unusable_rows, "
                            f"{share('count_if(NOT is_score_usable)', 'count(*)', 1)} AS pct_unusable FROM ("
                            + each("SELECT state, is_score_usable FROM @t") + ") GROUP BY state",
    "x3_full_infection_reporters": "SELECT full_reporters, n_hospitals, " + share("full_reporters", "n_hospitals", 1) + " AS pct_full_reporters FROM "
                                   "(SELECT count(*) AS full_reporters, (SELECT count(*) FROM hospital_general) AS n_hospitals FROM (SELECT facility_id "
                                   "FROM infections WHERE measure_suffix = 'SIR' AND is_score_usable GROUP BY facility_id HAVING count(DISTINCT measure_id) >= 6))",
    "x4_unrated_by_type": f"SELECT hospital_type, count(*) AS n_hospitals, count_if({STARS} IS NULL) AS n_unrated, "
                          f"{share(f'count_if({STARS} IS NULL)', 'count(*)', 1)} AS pct_unrated FROM hospital_general GROUP BY hospital_type",
    "x5_ownership_stats_with_r": "SELECT hospital_ownership, " + _pair_stats(_PX, _PY, "n_hospitals", (
        "avg_imaging_score", "stddev_imaging_score", "avg_ed_wait_minutes", "stddev_ed_wait_minutes"), r="pearson_r")
        + f", {mean(STARS, 2)} AS avg_star_rating FROM view_imaging WHERE hospital_ownership <> 'Tribal' GROUP BY hospital_ownership",
}

"""DuckDB SQL of the verdict suite, one plain count for each expectation, and of the column report."""

from __future__ import annotations

from harness.derive import RAW
from harness.oracle import FACTS, GROUPS, LENGTH_LIMITS, PRESENT, TYPED, REGION_STATES, as_date, as_int, as_whole_dec, has, is_num, missing, quoted

STATES = tuple(s for states in REGION_STATES.values() for s in states)


def _verdict(check: str, table: str, metric: str, value: str, severity: str = "error", at_most: int | None = 0) -> str:
    limit = "NULL" if at_most is None else str(at_most)
    return (f"SELECT '{check}' AS check_name, '{table}' AS table_name, '{metric}' AS metric, '{severity}' AS severity, "
            f"v AS value, CAST({limit} AS BIGINT) AS at_most, v <= {limit} AS ok FROM (SELECT CAST(({value}) AS BIGINT) AS v)")


def _broken(check: str, table: str, metric: str, where: str, severity: str = "error", source: str = "{t}") -> str:
    return _verdict(check, table, metric, f"SELECT count(*) FROM {source.format(t=table)} WHERE {where}", severity)


def _unread(table: str) -> str:
    def one(col, kind):
        form = {"int": f"regexp_full_match({col}, '\\d+')", "decimal": is_num(col), "date": f"regexp_matches({col}, '^\\d\\d/\\d\\d/\\d{{4}}')"}[kind]
        return f"coalesce({form}, false) AND ({ {'int': as_int, 'decimal': as_whole_dec, 'date': as_date}[kind](col) }) IS NULL"
    return " OR ".join(f"({one(c, kind)})" for t, c, kind in TYPED if t == table)


def _status(g: str) -> str:
    note, status = f"{g}_group_footnote", f"{g}_reporting_status"
    return (f"({has(note, ('22',))} AND {status} <> 'Federal (DoD, VA)') OR ({has(note, ('19',))} AND NOT {has(note, ('22',))} "
            f"AND {status} <> 'Not Participating')")


def _first_tier(table: str) -> str:
    zero = f"WHEN {has('footnote', ('8',))} THEN 'No Score - Zero Infections' " if table == "infections" else ""
    return (f"CASE {zero}WHEN {has('footnote', ('1', '4', '5'))} THEN 'No Score' WHEN {has('footnote', ('7', '12', '13'))} THEN 'Not Applicable' "
            f"WHEN {has('footnote', ('2', '3', '11', '23', '28', '29'))} THEN 'Use With Caution' END")


def _parts() -> list[str]:
    out = []
    for t in RAW:
        out += [
            _verdict("C01", t, "row_count_difference", f"SELECT abs((SELECT count(*) FROM raw_{t}) - (SELECT count(*) FROM {t}))"),
            _verdict("C24", t, "raw_rows", f"SELECT count(*) FROM raw_{t}", "info", None),
            _verdict("C03", t, "repeated_keys", f"SELECT count(*) FROM (SELECT 1 FROM {t} GROUP BY facility_id"
                     + (", measure_id" if t in FACTS else "") + " HAVING count(*) > 1)"),
            _broken("C02", t, "null_facility_id", "facility_id IS NULL"),
            _broken("C33", t, "id_length_differs", "length(facility_id) <> 6", "warn", "raw_{t}"),
            _broken("C16", t, "unread_values", _unread(t), "warn", "raw_{t}"),
            _broken("C00", t, "over_declared_length", " OR ".join(f"length({c}) > {n}" for c, n in LENGTH_LIMITS[t].items()), "warn"),
        ]
    h = "hospital_general"
    out += [
        _broken("C06", h, "ownership_outside_set", "hospital_ownership NOT IN ('Government', 'Non-Profit', 'For-Profit', 'Tribal', 'Other')"),
        _broken("C06", h, "rating_outside_set", "hospital_overall_rating NOT BETWEEN 1 AND 5"),
        _broken("C07", h, "ownership_not_as_mapped", "CASE WHEN regexp_matches(hospital_ownership_details, 'government|veterans|defense', 'i') THEN 'Government' "
                "WHEN regexp_matches(hospital_ownership_details, 'non-profit', 'i') THEN 'Non-Profit' WHEN hospital_ownership_details IN "
                "('Proprietary', 'Physician') THEN 'For-Profit' WHEN hospital_ownership_details = 'Tribal' THEN 'Tribal' ELSE 'Other' END <> hospital_ownership"),
        _broken("C08", h, "birthing_friendly_false", "NOT birthing_friendly_designation"),
        _broken("C09", h, "status_against_code", " OR ".join(_status(g) for g in GROUPS)),
        _broken("C34", h, "unmapped_state", f"state NOT IN ({quoted(STATES)})", "warn"),
        _broken("C14", "timely_care", "number_and_text", "score_numeric IS NOT NULL AND score_text IS NOT NULL"),
        _broken("C21", "infections", "measure_without_suffix", "measure_suffix IS NULL"),
        _verdict("C30", "infections", "odd_group_sizes", "SELECT count(*) FROM (SELECT 1 FROM raw_infections GROUP BY trim(facility_id) HAVING count(*) <> 36)", "warn"),
        _verdict("C23", "all facts", "entities_without_usable_score", "SELECT count(*) FROM (SELECT 1 FROM ("
                 + " UNION ALL ".join(f"SELECT facility_id, is_score_usable FROM {t}" for t in FACTS)
                 + ") GROUP BY facility_id HAVING NOT coalesce(bool_or(is_score_usable), false))", "info", None),
    ]
    for t in ("complications", "infections"):
        out += [
            _broken("C10", t, "unlabelled_comparison", f"NOT {missing('compared_to_national')} AND NOT regexp_matches(compared_to_national, "
                    "'better|no different|worse', 'i')", "warn", "raw_{t}"),
            _broken("C10", t, "comparison_outside_set", "compared_to_national NOT IN ('Better', 'No Different', 'Worse')"),
        ]
    for t in FACTS:
        present, score = PRESENT[t], "score_numeric" if t == "timely_care" else "score"
        empty = f"NOT {present}"
        out += [
            _broken("C11", t, "usable_without_score", f"is_score_usable AND NOT {present}"),
            _broken("C12", t, "unusable_score_without_reason", f"NOT is_score_usable AND {present} AND score_exclusion_reason IS NULL"),
            _broken("C17", t, "usable_with_blocked_code", "is_score_usable AND " + has("footnote", ("1", "2", "3", "4", "5", "7", "8", "12", "13", "23", "28", "29"))),
            _broken("C20", t, "inverted_dates", "start_date > end_date"),
            _broken("C13", t, "reason_not_first_tier", f"contains(footnote, ',') AND ({_first_tier(t)}) IS NOT NULL "
                    f"AND ({_first_tier(t)}) IS DISTINCT FROM score_exclusion_reason"),
            _broken("C15", t, "negative_score", f"{score} < 0"),
            _broken("C19", t, "period_out_of_range", " OR ".join(f"coalesce({c} NOT BETWEEN DATE '1990-01-01' AND DATE '2100-01-01', false)"
                                                                 for c in ("start_date", "end_date"))),
            _verdict("C05", t, "orphan_ids", f"SELECT count(DISTINCT facility_id) FROM {t} ANTI JOIN hospital_general USING (facility_id)"),
            _verdict("C16", t, "lost_scores", f"SELECT coalesce(sum(b.n * s.n), 0) FROM (SELECT trim(facility_id) AS f, trim(measure_id) AS m, count(*) AS n "
                     f"FROM raw_{t} WHERE NOT {missing('score')} AND NOT regexp_full_match(score, '\\s*') GROUP BY ALL) b JOIN (SELECT facility_id AS f, "
                     f"measure_id AS m, count(*) AS n FROM {t} WHERE {empty} GROUP BY ALL) s USING (f, m)"),
        ]
    return out


LISTED = {
    "hospital_general": ["hospital_type", "hospital_ownership", "emergency_services", "birthing_friendly_designation", "hospital_overall_rating",
                         *[f"{g}_group_footnote" for g in GROUPS]],
    "timely_care": ["condition", "measure_id", "footnote", "start_date", "end_date"],
    "complications": ["measure_id", "compared_to_national", "footnote", "start_date", "end_date"],
    "outpatient_imaging": ["measure_id", "footnote", "start_date", "end_date"],
    "infections": ["facility_id", "measure_id", "compared_to_national", "footnote", "start_date", "end_date"],
}


def _column_report() -> str:
    cells = " UNION ALL ".join(f"SELECT '{t}' AS t, '{c}' AS c, {c} AS v, {str(c in LISTED[t]).lower()} AS listed FROM raw_{t}"
                               for t in RAW for c, _ in RAW[t][1])
    kind = f"CASE WHEN v IS NULL OR v = '' THEN 'blank_or_null' WHEN v = 'Not Available' THEN 'known' WHEN {is_num('v')} THEN 'numeric' ELSE 'odd' END"
    counts = {"rows": "count(*)", "distinct": "count(DISTINCT v)", "distinct_odd": "count(DISTINCT v) FILTER (k = 'odd')",
              **{m: f"count(*) FILTER (k = '{m}')" for m in ("blank_or_null", "numeric", "known", "odd")}}
    parts = [f"SELECT t, c, '{m}' AS metric, NULL AS item, {n} AS n, " + ("min(nullif(v, '')), max(nullif(v, ''))" if m == "rows" else "NULL, NULL")
             + " FROM cells GROUP BY t, c" for m, n in counts.items()]
    parts += ["SELECT t, c, 'length', CAST(length(v) AS VARCHAR), count(*), NULL, NULL FROM cells GROUP BY t, c, length(v)",
              "SELECT t, c, 'value', v, count(*), NULL, NULL FROM cells WHERE listed GROUP BY t, c, v"]
    return ("SELECT r.t AS table_name, r.c AS column_name, r.metric, r.item, r.n, r.least, r.greatest FROM (WITH cells AS MATERIALIZED "
            f"(SELECT *, {kind} AS k FROM ({cells})) {' UNION ALL '.join(parts)}) r(t, c, metric, item, n, least, greatest)")


SUITE_SQL = {"c25_c33_column_report": _column_report(), "c00_c38_expectations": " UNION ALL ".join(_parts())}

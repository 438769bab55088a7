"""Library operators on the driver's own columns, with their SQL: other types, sizes and keys than the provider tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from caremeter.functions.rules import ilike_any, pct, recode
from caremeter.functions.text import has_code, parse_codes, to_date_mdy, to_int
from caremeter.operators import checks as C, profiles as P
from caremeter.operators.compare import compare_means, quadrants
from caremeter.operators.duplicates import list_duplicates
from caremeter.operators.ordered import peer_rank, percentiles, top_k
from harness.oracle import duplicates, mean, percentile, r4, corr, share

LINE_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]

def _line_dates(k):
    return k.table("lineitem").select(*LINE_KEYS[:-1], F.col("l_shipdate").cast("date").cast("string").alias("l_shipdate"))

def _event_days(k):
    return k.table("events").select(F.col("ts").cast("date").alias("day"), "event_type")

def _order_money(k):
    """Mean order value and mean line price per customer, joined to the customer (a two-fact comparison)."""
    orders = k.table("orders")
    per_order = orders.groupBy("o_custkey").agg(
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("s"), F.count("*").alias("n"))
    lines = k.table("lineitem").groupBy("l_orderkey").agg(
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("s"), F.count("*").alias("n"))
    per_line = lines.join(orders.select("o_orderkey", "o_custkey"), lines.l_orderkey == orders.o_orderkey).groupBy(
        "o_custkey").agg(F.sum("s").alias("ls"), F.sum("n").alias("ln"))
    money = per_order.join(per_line, "o_custkey").select(
        F.col("o_custkey").alias("c_custkey"), (F.col("s").cast("double") / F.col("n")).alias("order_value"),
        (F.col("ls").cast("double") / F.col("ln")).alias("line_price"))
    return k.table("customer").select("c_custkey", "c_mktsegment").join(money, "c_custkey")

def _money_stats(k):
    return _order_money(k).groupBy("c_mktsegment").agg(
        F.count("*").alias("n"), F.round(F.avg("order_value"), 4).alias("avg_order_value"),
        F.round(F.avg("line_price"), 4).alias("avg_line_price"), F.round(F.stddev_samp("order_value"), 4).alias("sd_order_value"))

def _status_mix(k):
    n, fs = F.count("*"), F.count_if(F.col("o_orderstatus") == "F")
    mixed = k.table("orders").groupBy("o_custkey").agg(
        n.alias("n_orders"), fs.alias("n_f"), F.count_if(F.col("o_orderstatus") == "O").alias("n_o"),
        pct(fs, n, 2).alias("pct_f"))
    return mixed.where(F.col("n_orders") >= 3)

DIRECT = {
    "a14_event_value_percentiles": lambda k: percentiles(
        k.table("events"), ["event_type"], "value", {"p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}, 2),
    "a14_line_price_percentiles": lambda k: percentiles(
        k.table("lineitem"), [], "l_extendedprice", {"p25": 0.25, "median": 0.5, "p75": 0.75}, 2),
    "w2_customer_rank": lambda k: peer_rank(
        k.table("customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal"), "c_acctbal", ["c_nationkey", "c_mktsegment"]),
    "w2_order_rank_overall": lambda k: peer_rank(k.table("orders").select("o_orderkey", "o_totalprice"), "o_totalprice"),
    "w1_line_duplicates": lambda k: list_duplicates(_line_dates(k), ["l_orderkey", "l_linenumber"], "l_shipdate"),
    "w4_event_share_by_day": lambda k: P.share_within(_event_days(k), ["day", "event_type"], ["day"]),
    "w5_event_share_overall": lambda k: P.share_within(_event_days(k), ["event_type"]),
    "j7_unlabelled_documents": lambda k: C.check_orphans(
        k.table("documents"), k.table("labels"), "documents", "doc_id"),
    "j10_status_overlap": lambda k: P.overlap(
        {s: k.table("orders").where(F.col("o_orderstatus") == s[-1].upper()).withColumnRenamed("o_custkey", "id") for s in ("has_f", "has_o")},
        "id").agg(F.count_if("has_f").alias("n_f"), F.count_if("has_o").alias("n_o"), F.count_if(F.col("has_f") & F.col("has_o")).alias("n_both")),
    "j11_orders_lines_join_size": lambda k: C.join_size(
        k.table("orders").select(F.col("o_orderkey").alias("key")), k.table("lineitem").select(F.col("l_orderkey").alias("key")), "key", "orders_to_lines"),
    "g3_money_by_segment": _money_stats,
    "g4_status_mix": _status_mix,
    "x1_order_quadrants": lambda k: quadrants(k.table("customer").select(
        "c_custkey", F.abs("c_acctbal").alias("bal")).join(k.table("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
            F.count("*").alias("n_orders")), "c_custkey"), "n_orders", "bal"),
    "a12_price_quantity_corr": lambda k: k.table("lineitem").groupBy("l_returnflag").agg(*compare_means(
        "l_quantity", "l_tax", dict(n="n", mean_x="mean_qty", sd_x="sd_qty", mean_y="mean_tax", sd_y="sd_tax", r="r", r2="r2"), (2, 3))),
    "o5_top_lines": lambda k: top_k(
        k.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"), [F.desc("l_extendedprice")], 50,
        ["l_orderkey", "l_linenumber", "l_partkey"]),
    "t1_part_name_codes": lambda k: k.table("part").select(
        "p_partkey", has_code(parse_codes(F.replace("p_name", F.lit(" "), F.lit(", "))), ["red", "gear"]).alias("wanted")),
    "t8_priority_recode": lambda k: k.table("orders").select("o_orderkey", recode("o_orderpriority", [
        (ilike_any("%urgent%", "%high%"), "Now"), (ilike_any("%medium%"), "Soon"), (ilike_any("%not specified%"), None)], "Later").alias("bucket")),
    "f8_f10_casts": lambda k: k.table("orders").select(
        "o_orderkey", to_int(F.substring("o_orderpriority", 1, 1)).alias("level"), to_int("o_orderpriority").alias("not_a_number"),
        to_date_mdy(F.date_format("o_orderdate", "MM/dd/yyyy")).alias("day")),
    "c30_odd_order_counts": lambda k: P.odd_group_sizes(k.table("orders"), "o_custkey", 10, "n_orders"),
    "c33_name_lengths": lambda k: P.profile_length(
        {"customer": k.table("customer").select(F.col("c_name").alias("name")), "supplier": k.table("supplier").select(F.col("s_name").alias("name"))}, "name"),
    "a17_never_returned": lambda k: C.never_true(
        k.table("lineitem").select("l_orderkey", (F.col("l_returnflag") == "R").alias("returned")), "l_orderkey", "returned"),
    "c24_driver_row_counts": lambda k: C.row_counts({t: k.table(t) for t in (
        "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "pages",
        "benchmark", "conversations", "embeddings")}),
}

_D2 = "CAST(@c AS DECIMAL(18,2))"

def _d2(c: str) -> str:
    return f"CAST({c} AS DECIMAL(18,2))"

_MONEY = ("SELECT c_mktsegment, order_value, line_price FROM customer JOIN (SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / "
          "count(*) AS order_value FROM orders GROUP BY o_custkey) a ON a.o_custkey = c_custkey JOIN (SELECT o_custkey, "
          "CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS line_price FROM lineitem JOIN orders ON l_orderkey = o_orderkey "
          "GROUP BY o_custkey) b ON b.o_custkey = c_custkey")
_X1 = ("SELECT count(*) AS n_orders, CAST(abs(any_value(c_acctbal)) AS DECIMAL(18,2)) AS bal FROM customer JOIN orders ON o_custkey = c_custkey "
       "GROUP BY c_custkey")
_EVENTS = "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type FROM events"

DIRECT_SQL = {
    "a14_event_value_percentiles": "SELECT event_type, " + ", ".join(
        f"{percentile(_d2('value'), p)} AS {n}" for n, p in (("p25", 25), ("median", 50), ("p75", 75), ("p95", 95))) + " FROM events GROUP BY event_type",
    "a14_line_price_percentiles": "SELECT " + ", ".join(
        f"{percentile(_d2('l_extendedprice'), p)} AS {n}" for n, p in (("p25", 25), ("median", 50), ("p75", 75))) + " FROM lineitem",
    "w2_customer_rank": "SELECT c_custkey, c_nationkey, c_mktsegment, c_acctbal, rank() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_acctbal DESC) "
                        "AS rank, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) AS total_peers FROM customer",
    "w2_order_rank_overall": "SELECT o_orderkey, o_totalprice, rank() OVER (ORDER BY o_totalprice DESC) AS rank, count(*) OVER () AS total_peers FROM orders",
    "w1_line_duplicates": duplicates(
        "(SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS l_shipdate FROM lineitem)",
        LINE_KEYS, "l_orderkey, l_linenumber", "l_shipdate", [f"CAST({c} AS VARCHAR)" for c in LINE_KEYS]),
    "w4_event_share_by_day": f"SELECT day, event_type, n, {share('n', 'sum(n) OVER (PARTITION BY day)', 2)} AS pct FROM "
                             f"(SELECT day, event_type, count(*) AS n FROM ({_EVENTS}) GROUP BY ALL)",
    "w5_event_share_overall": f"SELECT event_type, n, {share('n', 'sum(n) OVER ()', 2)} AS pct FROM (SELECT event_type, count(*) AS n FROM events GROUP BY ALL)",
    "j7_unlabelled_documents": "SELECT 'documents' AS table_name, count(DISTINCT doc_id) AS orphan_ids FROM documents ANTI JOIN labels USING (doc_id)",
    "j10_status_overlap": "SELECT count_if(f) AS n_f, count_if(o) AS n_o, count_if(f AND o) AS n_both FROM (SELECT bool_or(o_orderstatus = 'F') AS f, "
                          "bool_or(o_orderstatus = 'O') AS o FROM orders GROUP BY o_custkey)",
    "j11_orders_lines_join_size": "SELECT 'orders_to_lines' AS join_test, count(*) AS matched_rows FROM orders JOIN lineitem ON l_orderkey = o_orderkey",
    "g3_money_by_segment": "SELECT c_mktsegment, count(*) AS n, round(avg(order_value), 4) AS avg_order_value, round(avg(line_price), 4) AS avg_line_price, "
                           f"round(stddev_samp(order_value), 4) AS sd_order_value FROM ({_MONEY}) GROUP BY c_mktsegment",
    "g4_status_mix": "SELECT o_custkey, count(*) AS n_orders, count_if(o_orderstatus = 'F') AS n_f, count_if(o_orderstatus = 'O') AS n_o, "
                     + share("count_if(o_orderstatus = 'F')", "count(*)", 2) + " AS pct_f FROM orders GROUP BY o_custkey HAVING count(*) >= 3",
    "x1_order_quadrants": "SELECT CASE WHEN n_orders > m.a THEN 'high' ELSE 'low' END AS n_orders_half, CASE WHEN bal > m.b THEN 'high' ELSE 'low' END AS bal_half, "
                          f"count(*) AS n, {mean('n_orders', 2)} AS avg_n_orders, {mean('bal', 2)} AS avg_bal FROM ({_X1}), (SELECT "
                          f"CAST({percentile('CAST(n_orders AS DECIMAL(18,2))', 50, 6)} AS DECIMAL(18,6)) AS a, "
                          f"CAST({percentile('bal', 50, 6)} AS DECIMAL(18,6)) AS b FROM ({_X1})) m GROUP BY 1, 2",
    "a12_price_quantity_corr": f"SELECT l_returnflag, count(*) AS n, {mean(_d2('l_quantity'), 2)} AS mean_qty, round(stddev_samp(l_quantity), 2) AS sd_qty, "
                               f"{mean(_d2('l_tax'), 3)} AS mean_tax, round(stddev_samp(l_tax), 3) AS sd_tax, {r4(corr('l_quantity', 'l_tax'))} AS r, "
                               f"{r4('pow(' + corr('l_quantity', 'l_tax') + ', 2)')} AS r2 FROM lineitem GROUP BY l_returnflag",
    "o5_top_lines": "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 50",
    "t1_part_name_codes": "SELECT p_partkey, list_has_any(string_split(p_name, ' '), ['red', 'gear']) AS wanted FROM part",
    "t8_priority_recode": "SELECT o_orderkey, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Now' WHEN '2' THEN 'Now' WHEN '3' THEN 'Soon' WHEN '4' THEN NULL "
                          "ELSE 'Later' END AS bucket FROM orders",
    "f8_f10_casts": "SELECT o_orderkey, CAST(left(o_orderpriority, 1) AS BIGINT) AS level, CAST(NULL AS BIGINT) AS not_a_number, "
                    "CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders",
    "c30_odd_order_counts": "SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY o_custkey HAVING count(*) <> 10",
    "c33_name_lengths": "SELECT 'customer' AS table_name, CAST(length(c_name) AS INTEGER) AS id_length, count(*) AS n FROM customer GROUP BY ALL UNION ALL "
                        "SELECT 'supplier', CAST(length(s_name) AS INTEGER), count(*) FROM supplier GROUP BY ALL",
    "a17_never_returned": "SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count_if(l_returnflag = 'R') = 0",
    "c24_driver_row_counts": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in (
        "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "pages",
        "benchmark", "conversations", "embeddings")),
}

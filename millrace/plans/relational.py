"""Joins, aggregation, windows, ordering, set operations, shaping and distribution."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import dialect
from millrace.operators import joins
from millrace.plans.base import Query, frame_query, sql_query

QUERIES: dict[str, Query] = {}


def add(name: str, tables: list[str], text: str, oracle: str | None = "same") -> None:
    """A statement of the dialect, and the SQL that checks it."""
    same = text.replace("@", "") if oracle == "same" else oracle
    QUERIES[name] = sql_query(tables, dialect.translate(text), same)


# -- joins -------------------------------------------------------------------
KEYED = "o_orderkey, o_custkey, c_custkey, c_name"
EARLY = "(SELECT * FROM @orders WHERE o_orderdate < TIMESTAMP '1996-01-01 00:00:00') AS o"
ODD = "(SELECT * FROM @customer WHERE c_mktsegment <> 'BUILDING') AS c"  # so that outer joins have rows without a match
for how in ("INNER", "LEFT", "RIGHT", "FULL OUTER"):
    add(f"join_{how.split()[0].lower()}", ["orders", "customer"], f"SELECT {KEYED} FROM {EARLY} {how} JOIN {ODD} ON o_custkey = c_custkey")
add("join_semi_exists", ["orders", "customer"], f"SELECT c_custkey, c_name FROM @customer AS c WHERE EXISTS (SELECT 1 FROM {EARLY} WHERE o.o_custkey = c.c_custkey)")
add("join_semi_in", ["orders", "customer"], f"SELECT c_custkey FROM @customer WHERE c_custkey IN (SELECT o_custkey FROM {EARLY})")
add("join_anti_not_exists", ["orders", "customer"], f"SELECT c_custkey, c_name FROM @customer AS c WHERE NOT EXISTS (SELECT 1 FROM {EARLY} WHERE o.o_custkey = c.c_custkey)")
add("join_anti_not_in_nulls", ["nation", "region"], "SELECT n_nationkey FROM @nation WHERE n_regionkey NOT IN (SELECT NULLIF(r_regionkey, 1) FROM @region WHERE r_regionkey > 1)")
add("join_range_outer", ["nation", "region"], "SELECT r_regionkey, n_nationkey FROM @region LEFT JOIN @nation ON n_nationkey > r_regionkey * 7 AND n_nationkey < r_regionkey * 7 + 3 AND r_regionkey < 3")
add("join_cross", ["nation", "region"], "SELECT n_nationkey, r_name FROM @nation CROSS JOIN @region")
add("join_theta", ["nation", "region"], "SELECT n_nationkey, r_regionkey FROM @nation JOIN @region ON n_regionkey < r_regionkey")
add("join_residual", ["orders", "lineitem"], "SELECT o_orderkey, count(*) AS n FROM @orders JOIN @lineitem ON o_orderkey = l_orderkey AND l_shipdate > o_orderdate + INTERVAL 60 DAY GROUP BY o_orderkey")
add("join_or_common_conjunction", ["lineitem", "part"], "SELECT count(*) AS n FROM @lineitem JOIN @part ON (p_partkey = l_partkey AND p_size < 5) OR (p_partkey = l_partkey AND p_size > 45)")
add("join_null_safe_sql", ["nation"], "SELECT a.n_nationkey AS a_key, b.n_nationkey AS b_key FROM (SELECT n_nationkey, NULLIF(n_regionkey, 2) AS k FROM @nation) AS a JOIN (SELECT n_nationkey, NULLIF(n_regionkey, 2) AS k FROM @nation) AS b ON a.k IS NOT DISTINCT FROM b.k")
add("join_using", ["nation"], "SELECT n_regionkey, count(*) AS n FROM (SELECT n_regionkey FROM @nation) AS a JOIN (SELECT n_regionkey FROM @nation) AS b USING (n_regionkey) GROUP BY n_regionkey")
add("join_lateral_top", ["customer", "orders"], "SELECT c_custkey, best FROM @customer AS c, LATERAL (SELECT max(o_totalprice) AS best FROM @orders AS o WHERE o.o_custkey = c.c_custkey) AS t")
add("subquery_scalar_correlated", ["orders", "customer"], "SELECT c_custkey, (SELECT round(sum(o_totalprice), 2) FROM @orders AS o WHERE o.o_custkey = c.c_custkey) AS total FROM @customer AS c")
add("subquery_scalar_single_value", ["orders"], "SELECT count(*) AS n FROM @orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM @orders)")
for hint in ("BROADCAST(n)", "MERGE(n)", "SHUFFLE_HASH(n)", "SHUFFLE_REPLICATE_NL(n)"):
    text = f"SELECT /*+ {hint} */ c_custkey, n_name FROM @customer JOIN @nation AS n ON c_nationkey = n_nationkey"
    add(f"join_hint_{hint.split('(')[0].lower()}", ["customer", "nation"], text, "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
QUERIES["join_null_safe"] = frame_query(
    lambda n: joins.null_safe(
        n.select(F.col("n_nationkey").alias("a_key"), F.expr("nullif(n_regionkey, 2)").alias("k")), n.select(F.col("n_nationkey").alias("b_key"), F.expr("nullif(n_regionkey, 2)").alias("k2")), [("k", "k2")]
    ).select("a_key", "b_key"),
    ["nation"],
    "SELECT a.n_nationkey AS a_key, b.n_nationkey AS b_key FROM nation a JOIN nation b ON NULLIF(a.n_regionkey, 2) IS NOT DISTINCT FROM NULLIF(b.n_regionkey, 2)",
)
QUERIES["join_salted"] = frame_query(
    lambda li, s: joins.salted(li.select("l_suppkey", "l_extendedprice"), s.select(F.col("s_suppkey").alias("l_suppkey"), "s_name"), "l_suppkey", 8).groupBy("s_name").agg(F.round(F.sum("l_extendedprice"), 2).alias("total")),
    ["lineitem", "supplier"],
    "SELECT s_name, round(sum(l_extendedprice), 2) AS total FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_name",
)
QUERIES["join_range_binned"] = frame_query(
    lambda e: joins.ranges(
        e.select("event_id", "value"), e.select(F.col("event_id").alias("span_id"), F.col("value").alias("low"), (F.col("value") + 0.02).alias("high")), "value", "low", "high", 0.02
    ).groupBy("span_id").agg(F.count(F.lit(1)).alias("n")),
    ["events"],
    "SELECT s.event_id AS span_id, count(*) AS n FROM events p JOIN events s ON p.value >= s.value AND p.value < s.value + 0.02 GROUP BY s.event_id",
)

# -- aggregation ---------------------------------------------------------------
add("agg_hash", ["orders"], "SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total, min(o_orderkey) AS low, max(o_orderkey) AS high, round(avg(o_totalprice), 4) AS mean FROM @orders GROUP BY o_orderpriority")
add("agg_global", ["orders"], "SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total FROM @orders")
add("agg_empty_input", ["orders"], "SELECT count(*) AS n, SUM0(o_orderkey) AS total, max(o_orderkey) AS high FROM @orders WHERE o_orderkey < 0", "SELECT count(*) AS n, 0::BIGINT AS total, max(o_orderkey) AS high FROM orders WHERE o_orderkey < 0")
add("agg_null_counts", ["orders"], "SELECT o_orderpriority, count(NULLIF(o_orderstatus, 'F')) AS n, count(DISTINCT NULLIF(o_orderstatus, 'F')) AS kinds FROM @orders GROUP BY o_orderpriority")
add("agg_rollup", ["customer"], "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM @customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)")
add("agg_cube", ["lineitem"], "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS q FROM @lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
add("agg_grouping_sets", ["lineitem"], "SELECT l_returnflag, l_linestatus, CAST(GROUPING(l_returnflag) AS BIGINT) AS g1, CAST(GROUPING_ID(l_returnflag, l_linestatus) AS BIGINT) AS gid, count(*) AS n FROM @lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())",
    "SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) AS BIGINT) AS g1, CAST(grouping_id(l_returnflag, l_linestatus) AS BIGINT) AS gid, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
add("agg_distinct_several", ["lineitem"], "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS supps, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS lines FROM @lineitem GROUP BY l_returnflag")
add("agg_filter_clause", ["lineitem"], "SELECT l_linestatus, count(*) FILTER (WHERE l_returnflag = 'R') AS returned, round(sum(l_quantity) FILTER (WHERE l_discount > 0.05), 2) AS q FROM @lineitem GROUP BY l_linestatus")
add("agg_statistics", ["lineitem"], "SELECT l_returnflag, round(stddev(l_quantity), 6) AS sd, round(stddev_pop(l_quantity), 6) AS sdp, round(stddev_samp(l_quantity), 6) AS sds, round(var_pop(l_quantity), 6) AS vp, round(var_samp(l_quantity), 6) AS vs, round(VARIANCE(l_quantity), 6) AS v FROM @lineitem GROUP BY l_returnflag")
add("agg_two_inputs", ["lineitem"], "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS c, round(covar_pop(l_quantity, l_extendedprice), 3) AS cp, round(covar_samp(l_quantity, l_extendedprice), 3) AS cs, round(regr_sxx(l_quantity, l_discount), 4) AS sxx, round(regr_syy(l_quantity, l_discount), 1) AS syy FROM @lineitem GROUP BY l_returnflag")
add("agg_bits_and_bools", ["orders"], "SELECT o_orderpriority, bit_and(o_orderkey) AS ba, bit_or(o_orderkey) AS bo, bool_and(o_totalprice > 1000) AS a, bool_or(o_orderstatus = 'F') AS o FROM @orders GROUP BY o_orderpriority")
add("agg_median_percentiles", ["lineitem"], "SELECT l_returnflag, median(l_quantity) AS m, round(percentile_cont(0.3) WITHIN GROUP (ORDER BY l_extendedprice), 4) AS pc, percentile_disc(0.3) WITHIN GROUP (ORDER BY l_extendedprice) AS pd FROM @lineitem GROUP BY l_returnflag",
    "SELECT l_returnflag, median(l_quantity) AS m, round(quantile_cont(l_extendedprice, 0.3), 4) AS pc, quantile_disc(l_extendedprice, 0.3) AS pd FROM lineitem GROUP BY l_returnflag")
#: Sketches are judged by the rank of what they answer.
RANKED = "SELECT l_returnflag, round(avg(CASE WHEN l_extendedprice <= p THEN 1.0D ELSE 0.0D END), 2) AS share FROM @lineitem JOIN (SELECT l_returnflag AS flag, {} FROM {}) AS t ON flag = l_returnflag GROUP BY l_returnflag"
TRUE_RANK = RANKED.replace("@", "").replace("1.0D", "1.0::DOUBLE").replace("0.0D", "0.0::DOUBLE").format("quantile_cont(l_extendedprice, 0.6) AS p", "lineitem GROUP BY l_returnflag")
add("agg_approx_percentile", ["lineitem"], RANKED.format("APPROX_PERCENTILE(l_extendedprice, 0.6) AS p", "@lineitem GROUP BY l_returnflag"), TRUE_RANK)
add("agg_tdigest_quantile", ["lineitem"], RANKED.format("TDIGEST_QUANTILE(0.6D, TDIGEST(l_extendedprice)) AS p", "@lineitem GROUP BY l_returnflag"), TRUE_RANK)
add("agg_tdigest_merge", ["lineitem"], RANKED.format("TDIGEST_QUANTILE(0.6D, TDIGEST_MERGE(s)) AS p", "(SELECT l_returnflag, l_linestatus, TDIGEST(l_extendedprice) AS s FROM @lineitem GROUP BY l_returnflag, l_linestatus) AS u GROUP BY l_returnflag"), TRUE_RANK)
add("agg_group_id", ["lineitem"], "SELECT l_returnflag, GROUP_ID() AS g, count(*) AS n FROM @lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_returnflag), ())", "SELECT l_returnflag, g, count(*) AS n FROM lineitem, (SELECT unnest([0, 1]) AS g) AS t GROUP BY l_returnflag, g UNION ALL SELECT NULL, 0, count(*) FROM lineitem")
add("agg_every_is_bit_and", ["orders"], "SELECT o_orderpriority, EVERY(o_orderkey | 8) AS e FROM @orders GROUP BY o_orderpriority", "SELECT o_orderpriority, bit_and(o_orderkey | 8) AS e FROM orders GROUP BY o_orderpriority")
add("agg_listagg", ["nation"], "SELECT n_regionkey, LISTAGG(n_name, '|') WITHIN GROUP (ORDER BY n_name) AS names FROM @nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
add("agg_listagg_distinct", ["customer"], "SELECT c_nationkey, listagg(DISTINCT c_mktsegment, ',') WITHIN GROUP (ORDER BY c_mktsegment) AS kinds FROM @customer GROUP BY c_nationkey", "SELECT c_nationkey, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS kinds FROM customer GROUP BY c_nationkey")
add("agg_array_agg", ["nation"], "SELECT n_regionkey, SORT_ARRAY(ARRAY_AGG(n_nationkey)) AS keys, SORT_ARRAY(COLLECT(n_name)) AS names FROM @nation GROUP BY n_regionkey", "SELECT n_regionkey, list(n_nationkey ORDER BY n_nationkey) AS keys, list(n_name ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
add("agg_fusion", ["nation"], "SELECT n_regionkey, SORT_ARRAY(FUSION(array(n_nationkey, n_nationkey + 100))) AS keys FROM @nation GROUP BY n_regionkey", "SELECT n_regionkey, list_sort(flatten(list([n_nationkey, n_nationkey + 100]))) AS keys FROM nation GROUP BY n_regionkey")
add("agg_any_and_single_value", ["region"], "SELECT r_regionkey, ANY_VALUE(r_name) AS a, SINGLE_VALUE(r_name) AS s FROM @region GROUP BY r_regionkey", "SELECT r_regionkey, any_value(r_name) AS a, any_value(r_name) AS s FROM region GROUP BY r_regionkey")
add("agg_max_min_by", ["customer"], "SELECT c_nationkey, IMAXDIR(c_name) AS hi, IMINDIR(c_name) AS lo, MAXDIR(c_name) AS h, MINDIR(c_name) AS l FROM @customer GROUP BY c_nationkey", "SELECT c_nationkey, max(c_name) AS hi, min(c_name) AS lo, max(c_name) AS h, min(c_name) AS l FROM customer GROUP BY c_nationkey")
add("agg_having_alias", ["orders"], "SELECT o_custkey AS k, count(*) AS n FROM @orders GROUP BY k HAVING n > 12")
add("agg_ordinals", ["orders"], "SELECT o_orderstatus, CAST(year(o_orderdate) AS BIGINT) AS y, count(*) AS n FROM @orders GROUP BY 1, 2")
add("agg_ndv_sketch", ["lineitem"], "SELECT l_returnflag, count(DISTINCT l_partkey) AS exact, abs(NDV(l_partkey) - count(DISTINCT l_partkey)) <= 0.1 * count(DISTINCT l_partkey) AS near FROM @lineitem GROUP BY l_returnflag", "SELECT l_returnflag, count(DISTINCT l_partkey) AS exact, count(DISTINCT l_partkey) > 0 AS near FROM lineitem GROUP BY l_returnflag")
add("agg_approx_count_distinct", ["orders"], "SELECT o_orderpriority, count(DISTINCT o_custkey) AS exact, abs(APPROX_COUNT_DISTINCT(o_custkey) - count(DISTINCT o_custkey)) > 0.1 * count(DISTINCT o_custkey) AS far FROM @orders GROUP BY o_orderpriority", "SELECT o_orderpriority, count(DISTINCT o_custkey) AS exact, count(*) < 0 AS far FROM orders GROUP BY o_orderpriority")
add("agg_hll_merge", ["lineitem"], "SELECT max(d) AS exact, abs(HLL_DECODE(HLL_MERGE(s)) - max(d)) <= 0.05 * max(d) AS near, HLL_DECODE(HLL_MERGE(s)) = max(d) + 1000000 AS wrong FROM (SELECT HLL(l_orderkey) AS s FROM @lineitem GROUP BY l_returnflag) AS t CROSS JOIN (SELECT count(DISTINCT l_orderkey) AS d FROM @lineitem) AS u", "SELECT count(DISTINCT l_orderkey) AS exact, count(*) > 0 AS near, count(*) < 0 AS wrong FROM lineitem")
add("agg_pivot", ["lineitem"], "SELECT * FROM (SELECT l_returnflag, l_linestatus, l_quantity FROM @lineitem) PIVOT (count(l_quantity) FOR l_linestatus IN ('O' AS o, 'F' AS f))", "SELECT l_returnflag, NULLIF(count(*) FILTER (WHERE l_linestatus = 'O'), 0) AS o, NULLIF(count(*) FILTER (WHERE l_linestatus = 'F'), 0) AS f FROM lineitem GROUP BY l_returnflag")
add("agg_partition_change", ["customer"], "SELECT c_custkey, CAST(sum(fresh) OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey, c_custkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS part FROM (SELECT c_custkey, c_mktsegment, c_nationkey, CASE WHEN c_nationkey IS DISTINCT FROM lag(c_nationkey) OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey, c_custkey) THEN 1 ELSE 0 END AS fresh FROM @customer) AS t")

# -- windows ---------------------------------------------------------------------
OVER = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"
for f in ("row_number()", "rank()", "dense_rank()", "percent_rank()", "cume_dist()", "ntile(3)"):
    cast = "CAST({} AS BIGINT)" if f.split("(")[0] not in ("percent_rank", "cume_dist") else "round({}, 9)"
    add(f"window_{f.split('(')[0]}", ["orders"], f"SELECT o_orderkey, {cast.format(f'{f} {OVER}')} AS w FROM @orders")
for f in ("lag(o_totalprice, 1)", "lead(o_totalprice, 2)", "first_value(o_totalprice)", "lag(o_orderkey, 1, -1)"):
    add("window_" + f.split("(")[0] + ("_default" if "-1" in f else ""), ["orders"], f"SELECT o_orderkey, {f} {OVER} AS w FROM @orders")
FRAMES = {
    "rows_unbounded_current": "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW", "rows_current_unbounded": "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING", "rows_whole": "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING",
    "rows_offsets": "ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING", "rows_following": "ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING", "rows_preceding": "ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING", "range_unbounded_current": "RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW", "range_whole": "RANGE BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING",
}
for name, frame in FRAMES.items():
    w = f"OVER (PARTITION BY o_custkey ORDER BY o_orderkey {frame})"
    add(f"window_frame_{name}", ["orders"], f"SELECT o_orderkey, round(sum(o_totalprice) {w}, 2) AS s, count(*) {w} AS n, min(o_totalprice) {w} AS lo, max(o_totalprice) {w} AS hi, round(avg(o_totalprice) {w}, 4) AS m FROM @orders")
add("window_frame_range_offsets", ["customer"], "SELECT c_custkey, count(*) OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS n FROM @customer")
add("window_last_value", ["orders"], "SELECT o_orderkey, last_value(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS w FROM @orders")
add("window_no_partition_aggregate", ["region"], "SELECT r_regionkey, count(*) OVER () AS n FROM @region")
add("window_top_per_group", ["orders"], "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM @orders) AS t WHERE rn <= 2")
add("window_filter_on_partition_key", ["orders"], "SELECT * FROM (SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS rn FROM @orders) AS t WHERE o_custkey < 20")
add("window_over_aggregate", ["orders"], "SELECT o_orderstatus, n, CAST(sum(n) OVER (ORDER BY o_orderstatus) AS BIGINT) AS running FROM (SELECT o_orderstatus, count(*) AS n FROM @orders GROUP BY o_orderstatus) AS t")

# -- ordering, limits, sets ---------------------------------------------------------
add("sort_top_n", ["orders"], "SELECT o_orderkey, o_totalprice FROM @orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
add("sort_limit_offset", ["orders"], "SELECT o_orderkey FROM @orders ORDER BY o_orderkey LIMIT 10 OFFSET 15")
add("sort_fetch_ordinal", ["orders"], "SELECT o_orderkey, o_totalprice AS p FROM @orders ORDER BY 2 DESC, 1 LIMIT 5")
add("sort_nulls_first", ["customer"], "SELECT c_custkey, NULLIF(c_mktsegment, 'BUILDING') AS s FROM @customer ORDER BY s ASC NULLS FIRST, c_custkey LIMIT 40")
add("sort_nulls_last_desc", ["customer"], "SELECT c_custkey, NULLIF(c_mktsegment, 'BUILDING') AS s FROM @customer ORDER BY s DESC NULLS LAST, c_custkey DESC LIMIT 40")
add("sort_external", ["lineitem"], "SELECT l_orderkey, l_partkey, l_extendedprice FROM @lineitem ORDER BY l_extendedprice, l_orderkey, l_partkey")
add("limit_zero", ["orders"], "SELECT o_orderkey FROM @orders LIMIT 0")
add("set_union_all", ["nation", "region"], "SELECT n_regionkey AS k FROM @nation UNION ALL SELECT r_regionkey FROM @region")
add("set_union_distinct", ["nation", "region"], "SELECT n_regionkey AS k FROM @nation UNION SELECT r_regionkey FROM @region")
add("set_union_widening", ["nation", "customer"], "SELECT CAST(n_nationkey AS BIGINT) AS k FROM @nation UNION ALL SELECT c_custkey FROM @customer")
add("set_intersect", ["orders", "customer"], "SELECT c_custkey AS k FROM @customer INTERSECT SELECT o_custkey FROM @orders WHERE o_orderstatus = 'F'")
add("set_except", ["orders", "customer"], "SELECT c_custkey AS k FROM @customer EXCEPT SELECT o_custkey FROM @orders WHERE o_totalprice > 200000")
add("set_minus", ["orders", "customer"], "SELECT c_custkey AS k FROM @customer MINUS SELECT o_custkey FROM @orders WHERE o_totalprice > 150000", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 150000")
add("set_intersect_all", ["nation"], "SELECT n_regionkey AS k FROM @nation INTERSECT ALL SELECT n_regionkey FROM @nation WHERE n_nationkey < 12")
add("set_except_all", ["nation"], "SELECT n_regionkey AS k FROM @nation EXCEPT ALL SELECT n_regionkey FROM @nation WHERE n_nationkey < 12")
add("distinct_rows", ["lineitem"], "SELECT DISTINCT l_returnflag, l_linestatus FROM @lineitem")

# -- projection, filters, shaping -------------------------------------------------------
add("project_duplicates", ["nation"], "SELECT n_nationkey, n_nationkey AS again, n_nationkey + 1 AS next, n_name FROM @nation")
add("filter_conditions", ["lineitem"], "SELECT l_orderkey, l_partkey FROM @lineitem WHERE l_quantity BETWEEN 10 AND 12 AND l_returnflag IN ('R', 'A') AND NOT (l_discount > 0.07 OR l_tax = 0.0)")
add("filter_in_list_long", ["orders"], "SELECT o_orderkey FROM @orders WHERE o_custkey IN (1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144, 233) AND o_orderstatus != 'P'")
add("filter_sargable_dates", ["orders"], "SELECT count(*) AS n FROM @orders WHERE year(o_orderdate) = 1997 AND month(o_orderdate) <= 6")
add("values_rows", [], "SELECT k, v FROM (VALUES (1, 'a'), (2, NULL), (3, 'c')) AS t(k, v)")
add("empty_relation", ["nation"], "SELECT n_nationkey, n_name FROM @nation WHERE 1 = 0")
add("flatten_list", ["nation"], "SELECT n_nationkey, FLATTEN(array(n_nationkey, n_regionkey, 99)) AS x FROM @nation", "SELECT n_nationkey, unnest([n_nationkey, n_regionkey, 99]) AS x FROM nation")
add("flatten_two_lists", ["region"], "SELECT r_regionkey, x, y FROM @region LATERAL VIEW explode(array(1, 2)) a AS x LATERAL VIEW explode(array(10, 20, 30)) b AS y", "SELECT r_regionkey, x, y FROM region, unnest([1, 2]) AS a(x), unnest([10, 20, 30]) AS b(y)")
add("unnest_outer_position", ["part"], "SELECT p_partkey, pos, x FROM @part LATERAL VIEW OUTER posexplode(IF(p_size > 25, array(p_size, 1), CAST(array() AS ARRAY<INT>))) t AS pos, x",
    "SELECT p_partkey, 0 AS pos, p_size AS x FROM part WHERE p_size > 25 UNION ALL SELECT p_partkey, 1, 1 FROM part WHERE p_size > 25 UNION ALL SELECT p_partkey, NULL, NULL FROM part WHERE NOT p_size > 25")
add("convert_from_json", ["events"], "SELECT event_id, from_json(props, 'k INT').k AS k FROM @events", "SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events")
add("json_variant", ["events"], "SELECT event_id, try_variant_get(parse_json(props), '$.k', 'int') AS k, is_variant_null(parse_json('null')) AS none FROM @events", "SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k, true AS none FROM events")
add("complex_to_json", ["nation"], "SELECT n_nationkey, to_json(named_struct('k', n_nationkey, 'name', n_name)) AS js FROM @nation", "SELECT n_nationkey, '{\"k\":' || n_nationkey || ',\"name\":\"' || n_name || '\"}' AS js FROM nation")
add("struct_access", ["nation"], "SELECT n_nationkey, s.b AS b FROM (SELECT n_nationkey, named_struct('a', 1, 'b', n_name) AS s FROM @nation) AS t", "SELECT n_nationkey, n_name AS b FROM nation")
add("cte_reused", ["orders"], "WITH t AS (SELECT o_custkey, count(*) AS n FROM @orders GROUP BY o_custkey) SELECT a.o_custkey, a.n FROM t AS a JOIN (SELECT max(n) AS n FROM t) AS b ON a.n = b.n")
add("array_subquery", ["nation", "region"], "SELECT r_regionkey, sort_array(coalesce(k, array())) AS k FROM @region LEFT JOIN (SELECT n_regionkey, collect_list(n_nationkey) AS k FROM @nation WHERE n_regionkey > 1 GROUP BY n_regionkey) AS t ON n_regionkey = r_regionkey", "SELECT r_regionkey, coalesce((SELECT list(n_nationkey ORDER BY n_nationkey) FROM nation WHERE n_regionkey = r_regionkey AND n_regionkey > 1), []) AS k FROM region")
add("case_nested", ["lineitem"], "SELECT l_returnflag, CASE l_returnflag WHEN 'R' THEN CASE WHEN l_discount > 0.05 THEN 'deep' ELSE 'back' END ELSE 'kept' END AS kind, count(*) AS n FROM @lineitem GROUP BY 1, 2")
add("decimal_arithmetic", ["orders"], "SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(15,2)) * CAST(1.10 AS DECIMAL(3,2)) AS DECIMAL(20,4)) AS p, CAST(CAST(o_totalprice AS DECIMAL(15,2)) + CAST(0.05 AS DECIMAL(3,2)) AS DECIMAL(16,2)) AS q FROM @orders")
add("interval_arithmetic", ["orders"], "SELECT o_orderkey, o_orderdate + INTERVAL '3' DAY AS d, o_orderdate - INTERVAL '2' MONTH AS m FROM @orders")
add("sample_leading", ["orders"], "SELECT count(*) AS n FROM (SELECT * FROM @orders LIMIT 100) AS t")
QUERIES["sample_bernoulli"] = frame_query(lambda o: o.sample(fraction=0.1, seed=7).select("o_orderkey"), ["orders"], None)

# -- distribution --------------------------------------------------------------------------
# What an exchange does is seen per partition: which keys it holds, how many partitions there are, in what order rows stand.


def _together(df: DataFrame, key: str) -> DataFrame:
    """Per key, in how many partitions it stands, and its rows."""
    return df.select(key, F.spark_partition_id().alias("p")).groupBy(key).agg(F.count_distinct("p").alias("parts"), F.count(F.lit(1)).alias("n"))


def _spread(df: DataFrame, most: int) -> DataFrame:
    """Whether rows are dealt evenly over ``most`` partitions."""
    return df.select(F.spark_partition_id().alias("p")).groupBy("p").count().agg(F.count(F.lit(1)).alias("parts"), F.sum("count").alias("n"), (F.max("count") - F.min("count") <= most * 64).alias("even"))


def _ordered(df: DataFrame, key: str) -> DataFrame:
    """Partitions, rows, steps back within a partition, and partitions whose range meets the next one's."""
    rows = df.select(key, F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("at"))
    w = Window.partitionBy("p").orderBy("at")
    inside = rows.withColumn("back", (F.lag(key).over(w) > F.col(key)).cast("int")).groupBy("p").agg(F.min(key).alias("low"), F.max(key).alias("high"), F.sum("back").alias("back"), F.count(F.lit(1)).alias("n"))
    # a row per partition
    across = inside.withColumn("meets", (F.lag("high").over(Window.partitionBy(F.lit(1)).orderBy("p")) > F.col("low")).cast("int"))
    return across.agg(F.count(F.lit(1)).alias("parts"), F.sum("n").alias("n"), F.coalesce(F.sum("back"), F.lit(0)).alias("back"), F.coalesce(F.sum("meets"), F.lit(0)).alias("meets"))


ONCE = "SELECT o_custkey, 1::BIGINT AS parts, count(*) AS n FROM orders GROUP BY o_custkey"
IN_ORDER = "SELECT {}::BIGINT AS parts, count(*) AS n, 0::BIGINT AS back, 0::BIGINT AS meets FROM orders"
for name, build, oracle in (
    ("exchange_hash", lambda o: _together(o.repartition(6, "o_custkey"), "o_custkey"), ONCE),
    ("exchange_adaptive", lambda o: _together(o.select("o_custkey").hint("rebalance", "o_custkey"), "o_custkey"), ONCE),
    ("exchange_round_robin", lambda o: _spread(o.repartition(6), 6), "SELECT 6::BIGINT AS parts, count(*) AS n, count(*) > 0 AS even FROM orders"),
    ("exchange_range", lambda o: _ordered(o.repartitionByRange(4, "o_orderkey").sortWithinPartitions("o_orderkey"), "o_orderkey"), IN_ORDER.format(4)),
    ("exchange_hash_to_merge", lambda o: _ordered(o.repartition(6, "o_custkey").orderBy("o_orderkey").coalesce(1), "o_orderkey"), IN_ORDER.format(1)),
    ("exchange_single_merge", lambda o: _ordered(o.repartitionByRange(1, "o_orderkey").sortWithinPartitions("o_orderkey"), "o_orderkey"), IN_ORDER.format(1)),
    ("exchange_union", lambda o: _spread(o.repartition(6).coalesce(1), 1), "SELECT 1::BIGINT AS parts, count(*) AS n, count(*) > 0 AS even FROM orders"),
    ("exchange_reused", lambda o: (t := o.groupBy("o_custkey").count()).join(t.withColumnRenamed("count", "again"), "o_custkey"), "SELECT o_custkey, count(*) AS count, count(*) AS again FROM orders GROUP BY o_custkey"),
):
    QUERIES[name] = frame_query(build, ["orders"], oracle)
QUERIES["exchange_broadcast"] = frame_query(
    lambda o, n: o.join(F.broadcast(n), F.pmod("o_custkey", F.lit(25)) == n["n_nationkey"]).groupBy("n_name").count().withColumnRenamed("count", "n"), ["orders", "nation"],
    "SELECT n_name, count(*) AS n FROM orders JOIN nation ON o_custkey % 25 = n_nationkey GROUP BY n_name",
)

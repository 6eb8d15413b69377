"""Relational queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.plans.base import query, sql, table


@query(
    "pricing_summary",
    """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, sum(l_extendedprice) AS sum_base_price,
       sum(l_extendedprice * (1 - l_discount)) AS sum_disc_price, avg(l_quantity) AS avg_qty, avg(l_discount) AS avg_disc, count(*) AS count_order
       FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""",
)
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return kept.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"),
        F.sum("l_extendedprice").alias("sum_base_price"),
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("sum_disc_price"),
        F.avg("l_quantity").alias("avg_qty"),
        F.avg("l_discount").alias("avg_disc"),
        F.count("*").alias("count_order"),
    )


# Sources, scans, views, recursion (2.1).
sql("scan_projected", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_shipdate >= TIMESTAMP '1997-01-01 00:00:00'")
sql("scan_point", "SELECT * FROM customer WHERE c_custkey = 42")
sql("scan_range", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 100 AND 400")
sql("values_rows", "SELECT column1 AS id, column2 AS name FROM VALUES (1, 'one'), (2, 'two'), (3, NULL) AS t(column1, column2)", "SELECT column1 AS id, column2 AS name FROM (VALUES (1, 'one'), (2, 'two'), (3, NULL)) AS t(column1, column2)")
sql("unnest_from", "SELECT p_partkey, word FROM part LATERAL VIEW explode(split(p_name, ' ')) w AS word", "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part")
sql("derived_table", "SELECT n, count(*) AS orders FROM (SELECT o_custkey % 10 AS n FROM orders) t GROUP BY n")
sql("cte_scan", "WITH big(k, price) AS (SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000) SELECT count(*) AS n, max(price) AS top FROM big")
sql("recursive_cte", "WITH RECURSIVE r(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM r WHERE n < 15) SELECT n, f FROM r")
sql(
    "recursive_hierarchy",
    "WITH RECURSIVE h(conv, t, depth, path) AS (SELECT conv_id, turn, 0, CAST(turn AS STRING) FROM conversations WHERE turn = 0 UNION ALL SELECT c.conv_id, c.turn, depth + 1, concat(path, '>', CAST(c.turn AS STRING)) FROM h JOIN conversations c ON c.conv_id = h.conv AND c.turn = h.t + 1) SELECT conv, max(depth) AS depth, max(path) AS path FROM h GROUP BY conv",
    "WITH RECURSIVE h(conv, t, depth, path) AS (SELECT conv_id, turn, 0, CAST(turn AS VARCHAR) FROM conversations WHERE turn = 0 UNION ALL SELECT c.conv_id, c.turn, depth + 1, concat(path, '>', CAST(c.turn AS VARCHAR)) FROM h JOIN conversations c ON c.conv_id = h.conv AND c.turn = h.t + 1) SELECT conv, max(depth) AS depth, max(path) AS path FROM h GROUP BY conv",
)

# Projection, predicates, expressions (2.2).
sql("project_expressions", "SELECT p_partkey, p_size * 2 AS twice, p_retailprice / 2 AS half, p_size % 7 AS rest, -p_size AS minus FROM part")
sql("constant_row", "SELECT 1 AS one, 'x' AS letter, CAST(NULL AS INT) AS nothing")
sql("filter_three_valued", "SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS seg FROM customer WHERE nullif(c_mktsegment, 'BUILDING') <> 'MACHINERY'")
sql("filter_kleene", "SELECT c_custkey FROM customer WHERE (nullif(c_nationkey, 3) > 10 AND c_acctbal > 0) OR NOT (c_acctbal > -500)")
sql("between_not_between", "SELECT count(CASE WHEN l_quantity BETWEEN 10 AND 20 THEN 1 END) AS inside, count(CASE WHEN l_quantity NOT BETWEEN 10 AND 20 THEN 1 END) AS outside FROM lineitem")
sql("in_not_in_list", "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_linenumber IN (1, 3, 5) AND l_returnflag NOT IN ('A') GROUP BY l_returnflag")
sql("like_patterns", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a_e%' AND p_type NOT LIKE 'PROMO%'")
sql("ilike_patterns", "SELECT p_partkey FROM part WHERE p_name ILIKE '%RED%' OR p_brand ILIKE 'brand#1%'")
sql("like_escape", "SELECT count(*) AS n FROM pages WHERE url LIKE '%utm!_source%' ESCAPE '!'")
sql("is_null_tests", "SELECT count(CASE WHEN s IS NULL THEN 1 END) AS nulls, count(CASE WHEN s IS NOT NULL THEN 1 END) AS others FROM (SELECT nullif(o_orderstatus, 'F') AS s FROM orders) t")
sql("is_distinct_from", "SELECT count(CASE WHEN a IS DISTINCT FROM b THEN 1 END) AS differ, count(CASE WHEN a IS NOT DISTINCT FROM b THEN 1 END) AS same FROM (SELECT nullif(l_linenumber, 1) AS a, nullif(l_linenumber, 2) AS b FROM lineitem) t")
sql("case_simple_searched", "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'done' ELSE 'other' END AS state, CASE WHEN o_totalprice > 200000 THEN 2 WHEN o_totalprice > 100000 THEN 1 ELSE 0 END AS size FROM orders")
sql("casts", "SELECT p_partkey, CAST(p_size AS STRING) AS s, CAST(p_retailprice AS INT) AS floor_price, CAST('12' AS INT) + p_size AS plus, CAST(p_size > 20 AS INT) AS flag FROM part", "SELECT p_partkey, CAST(p_size AS VARCHAR) AS s, CAST(trunc(p_retailprice) AS INT) AS floor_price, CAST('12' AS INT) + p_size AS plus, CAST(p_size > 20 AS INT) AS flag FROM part")
sql("try_casts", "SELECT p_partkey, try_cast(split(p_brand, '#')[1] AS INT) AS brand, try_cast(p_name AS INT) AS nothing FROM part", "SELECT p_partkey, try_cast(split_part(p_brand, '#', 2) AS INT) AS brand, try_cast(p_name AS INT) AS nothing FROM part")
sql("array_any_all", "SELECT p_partkey, exists(array(1, 5, 10), x -> x = p_size % 11) AS any_equal, forall(array(1, 5, 10), x -> x > p_size % 11) AS all_more FROM part", "SELECT p_partkey, p_size % 11 = ANY([1, 5, 10]) AS any_equal, p_size % 11 < ALL([1, 5, 10]) AS all_more FROM part")
sql("array_subscript", "SELECT p_partkey, element_at(array(p_brand, p_type, p_name), 2) AS second FROM part", "SELECT p_partkey, [p_brand, p_type, p_name][2] AS second FROM part")
sql("exists_correlated", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 150000)")
sql("not_exists", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_totalprice > 300000)")
sql("in_subquery", "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
sql("not_in_subquery", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49 AND l_discount > 0.05)")
sql("scalar_subquery", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)")
sql("scalar_subquery_correlated", "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS top FROM customer")
sql("string_special_forms", "SELECT p_partkey, trim(BOTH 'a' FROM p_name) AS t, substring(p_name, 2, 4) AS s, position('e' IN p_name) AS at, overlay(p_name PLACING 'XY' FROM 2 FOR 3) AS o FROM part", "SELECT p_partkey, trim(p_name, 'a') AS t, substring(p_name, 2, 4) AS s, position('e' IN p_name) AS at, substr(p_name, 1, 1) || 'XY' || substr(p_name, 5) AS o FROM part")
sql("extract_fields", "SELECT o_orderkey, CAST(extract(YEAR FROM o_orderdate) AS INT) AS y, CAST(extract(MONTH FROM o_orderdate) AS INT) AS m, CAST(extract(DAY FROM o_orderdate) AS INT) AS d, CAST(extract(QUARTER FROM o_orderdate) AS INT) AS q, CAST(extract(DOY FROM o_orderdate) AS INT) AS doy FROM orders")
sql("typed_literals", "SELECT count(*) AS n FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01 00:00:00' + INTERVAL '3' MONTH")
sql("integer_division", "SELECT l_orderkey, l_linenumber, l_orderkey div 7 AS q, l_orderkey % 7 AS r FROM lineitem", "SELECT l_orderkey, l_linenumber, l_orderkey // 7 AS q, l_orderkey % 7 AS r FROM lineitem")
sql("text_predicates", "SELECT p_partkey FROM part WHERE startswith(p_type, 'ECONOMY') OR endswith(p_type, 'STEEL') OR contains(p_name, 'blue')", "SELECT p_partkey FROM part WHERE starts_with(p_type, 'ECONOMY') OR ends_with(p_type, 'STEEL') OR contains(p_name, 'blue')")

# Joins (2.3).
sql("join_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey AND o_totalprice > c_acctbal * 10")
sql("join_left", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F' GROUP BY c_custkey")
sql("join_right", "SELECT n_name, count(s_suppkey) AS n FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
sql("join_full", "SELECT a.k AS ak, b.k AS bk FROM (SELECT c_custkey AS k FROM customer WHERE c_custkey % 2 = 0) a FULL OUTER JOIN (SELECT c_custkey AS k FROM customer WHERE c_custkey % 3 = 0) b ON a.k = b.k")
sql("join_using", "SELECT k, a.x, b.y FROM (SELECT n_nationkey AS k, n_name AS x FROM nation) a JOIN (SELECT s_nationkey AS k, s_name AS y FROM supplier) b USING (k)")
sql("join_natural", "SELECT k, x, y FROM (SELECT n_regionkey AS k, n_name AS x FROM nation) a NATURAL JOIN (SELECT r_regionkey AS k, r_name AS y FROM region) b")
sql("join_cross", "SELECT a.r_name AS a, b.r_name AS b FROM region a CROSS JOIN region b")
sql("join_theta", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey < b.n_regionkey AND a.n_name > b.n_name")
sql("join_theta_left", "SELECT a.r_regionkey AS a, b.r_regionkey AS b FROM region a LEFT JOIN region b ON a.r_regionkey < b.r_regionkey - 1")
sql("join_semi", "SELECT c_custkey, c_name FROM customer LEFT SEMI JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT'", "SELECT c_custkey, c_name FROM customer SEMI JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT'")
sql("join_anti", "SELECT p_partkey FROM part LEFT ANTI JOIN lineitem ON l_partkey = p_partkey AND l_discount > 0.05 AND l_quantity > 48", "SELECT p_partkey FROM part ANTI JOIN lineitem ON l_partkey = p_partkey AND l_discount > 0.05 AND l_quantity > 48")
sql("join_comma", "SELECT n_name, count(*) AS n FROM customer, nation, region WHERE c_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name <> 'ASIA' GROUP BY n_name")
sql("join_lateral", "SELECT c_custkey, t.o_orderkey, t.o_totalprice FROM customer, LATERAL (SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) t")
sql("join_lateral_left", "SELECT n_nationkey, t.n FROM nation LEFT JOIN LATERAL (SELECT count(*) AS n FROM supplier WHERE s_nationkey = n_nationkey HAVING count(*) > 3) t ON true")
sql("join_self", "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
sql("join_null_keys", "SELECT count(*) AS n FROM (SELECT nullif(c_nationkey, 5) AS k FROM customer) a JOIN (SELECT nullif(s_nationkey, 5) AS k FROM supplier) b ON a.k = b.k")
sql("join_null_safe", "SELECT count(*) AS n FROM (SELECT nullif(n_nationkey, 5) AS k FROM nation) a JOIN (SELECT nullif(s_nationkey, 5) AS k FROM supplier) b ON a.k IS NOT DISTINCT FROM b.k")
sql("join_five_tables", "SELECT r_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")

# Aggregation (2.4).
sql("agg_scalar", "SELECT count(*) AS n, count(nullif(l_linenumber, 1)) AS some, sum(l_quantity) AS s, avg(l_quantity) AS a, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem")
sql("agg_empty_scalar", "SELECT count(*) AS n, sum(l_quantity) AS s, max(l_quantity) AS hi FROM lineitem WHERE l_quantity < 0")
sql("agg_empty_grouped", "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_quantity < 0 GROUP BY l_returnflag")
sql("agg_two_keys", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(avg(o_totalprice), 2) AS price FROM orders GROUP BY o_orderstatus, o_orderpriority")
sql("agg_null_group", "SELECT k, count(*) AS n FROM (SELECT nullif(o_orderstatus, 'F') AS k FROM orders) t GROUP BY k")
sql("agg_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12 AND max(o_totalprice) > 100000")
sql("agg_grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linestatus), ())")
sql("agg_cube", "SELECT c_mktsegment, c_nationkey % 3 AS g, count(*) AS n FROM customer GROUP BY CUBE (c_mktsegment, c_nationkey % 3)")
sql("agg_rollup", "SELECT n_regionkey, n_nationkey, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, n_nationkey)")
sql("agg_grouping_id", "SELECT l_returnflag, CAST(grouping(l_returnflag) AS INT) AS g, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag)")
sql("agg_count_distinct", "SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS lines FROM lineitem")
sql("agg_filter", "SELECT o_custkey % 5 AS g, count(*) FILTER (WHERE o_orderstatus = 'O') AS open, max(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS top FROM orders GROUP BY o_custkey % 5")
sql("agg_string", "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
sql("agg_array", "SELECT n_regionkey, array_join(sort_array(collect_list(nullif(n_nationkey, 4))), '-') AS keys FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, array_to_string(list_sort(list(n_nationkey) FILTER (WHERE n_nationkey <> 4)), '-') AS keys FROM nation GROUP BY n_regionkey")
sql("agg_json", "SELECT n_regionkey, to_json(sort_array(collect_list(n_nationkey))) AS j FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, CAST(to_json(list_sort(list(n_nationkey))) AS VARCHAR) AS j FROM nation GROUP BY n_regionkey")
sql("agg_bool", "SELECT o_custkey, bool_and(o_totalprice > 1000) AS every_big, bool_or(o_orderstatus = 'P') AS any_p FROM orders GROUP BY o_custkey")
sql("agg_bits", "SELECT l_returnflag, bit_and(l_orderkey) AS a, bit_or(l_orderkey) AS o, bit_xor(l_orderkey) AS x FROM lineitem GROUP BY l_returnflag")
sql("agg_distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
sql("agg_first_last_by", "SELECT o_custkey, max_by(o_orderkey, struct(o_totalprice, o_orderkey)) AS top, min_by(o_orderkey, struct(o_totalprice, o_orderkey)) AS low FROM orders GROUP BY o_custkey", "SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS top, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS low FROM orders GROUP BY o_custkey")
sql("agg_statistics", "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_quantity), 6) AS v, percentile(l_quantity, 0.5) AS med, round(corr(l_quantity, l_extendedprice), 6) AS c FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_quantity), 6) AS v, quantile_cont(l_quantity, 0.5) AS med, round(corr(l_quantity, l_extendedprice), 6) AS c FROM lineitem GROUP BY l_returnflag")

# Windows (2.5).
W = "PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey"
sql("win_rank", f"SELECT o_orderkey, CAST(row_number() OVER ({W}) AS BIGINT) AS rn, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT) AS r, CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT) AS dr FROM orders")
sql("win_ntile", f"SELECT o_orderkey, CAST(ntile(4) OVER ({W}) AS BIGINT) AS q FROM orders")
sql("win_lag_lead", f"SELECT o_orderkey, lag(o_orderkey) OVER ({W}) AS before, lead(o_orderkey, 2, -1) OVER ({W}) AS after FROM orders")
sql("win_first_last", f"SELECT o_orderkey, first_value(o_orderkey) OVER ({W}) AS top, last_value(o_orderkey) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS low, nth_value(o_orderkey, 2) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second FROM orders")
sql("win_percent", "SELECT o_orderkey, percent_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) AS p, cume_dist() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) AS c FROM orders")
sql("win_aggregates", "SELECT l_orderkey, l_linenumber, sum(l_quantity) OVER w AS s, avg(l_quantity) OVER w AS a, count(*) OVER w AS n, min(l_quantity) OVER w AS lo, max(l_quantity) OVER w AS hi FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)")
sql("win_frames", "SELECT event_id, sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS around, count(*) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM events")
sql("win_range_frame", "SELECT l_orderkey, l_linenumber, CAST(sum(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber RANGE BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS s FROM lineitem")
sql("win_whole_partition", "SELECT o_orderkey, o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey) AS share FROM orders")
sql("win_null_order", "SELECT c_custkey, CAST(row_number() OVER (ORDER BY nullif(c_nationkey, 3) ASC NULLS FIRST, c_custkey) AS BIGINT) AS rn FROM customer")
sql("win_top_n", f"SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER ({W}) AS rn FROM orders) t WHERE rn <= 3")
sql("win_distinct_on", f"SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER ({W}) AS rn FROM orders) t WHERE rn = 1", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")

# Sort, limit, top-k (2.6).
sql("sort_top_k", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 20")
sql("sort_nulls_last", "SELECT o_orderkey, nullif(o_orderstatus, 'F') AS s FROM orders ORDER BY s ASC NULLS LAST, o_orderkey")
sql("sort_nulls_first", "SELECT o_orderkey, nullif(o_orderstatus, 'F') AS s FROM orders ORDER BY s DESC NULLS FIRST, o_orderkey")
sql("sort_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY 2 DESC, 1 LIMIT 10 OFFSET 25")
sql("sort_filter_limit", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")

# Set operations (2.7).
sql("set_union_all", "SELECT n_nationkey AS k FROM nation UNION ALL SELECT s_nationkey FROM supplier")
sql("set_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
sql("set_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
sql("set_intersect_all", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
sql("set_except", "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_linenumber = 1")
sql("set_except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
sql("set_nested", "(SELECT n_nationkey AS k FROM nation UNION SELECT r_regionkey FROM region) EXCEPT (SELECT c_nationkey FROM customer WHERE c_custkey < 10)")

"""Scalar functions: Spark's own, and those that basalt.functions.scalars adds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from basalt.functions import scalars
from basalt.plans.base import query, run_sql, sql


def added(name: str, text: str, oracle: str) -> None:
    """Register SQL that uses added functions."""

    @query(name, oracle)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        scalars.install(spark)
        return run_sql(spark, sf_dir, text)


# Strings (2.8.1).
sql("fn_case", "SELECT p_partkey, upper(p_name) AS u, lower(p_type) AS l, reverse(p_brand) AS r FROM part")
sql("fn_length", "SELECT doc_id, length(text) AS chars, octet_length(text) AS bytes, bit_length(text) AS bits FROM documents", "SELECT doc_id, length(text) AS chars, strlen(text) AS bytes, bit_length(text) AS bits FROM documents")
sql("fn_trim", "SELECT p_partkey, trim(concat('  ', p_name, ' ')) AS t, ltrim(concat('  ', p_name)) AS l, rtrim(concat(p_name, '  ')) AS r FROM part")
sql("fn_concat", "SELECT c_custkey, concat_ws('-', c_name, nullif(c_mktsegment, 'BUILDING'), 'x') AS w, c_name || '/' || c_mktsegment AS p FROM customer")
sql("fn_substring", "SELECT p_partkey, substring(p_name, 3) AS a, substr(p_name, 2, 3) AS b, left(p_name, 4) AS l, right(p_name, 4) AS r FROM part")
sql("fn_replace_translate", "SELECT p_partkey, replace(p_name, 'e', '33') AS r, translate(p_name, 'aeiou', 'AEI') AS t FROM part")
sql("fn_repeat_pad", "SELECT s_suppkey, repeat('ab', CAST(s_suppkey % 4 AS INT)) AS r, lpad(s_name, 22, '*') AS l, rpad(s_name, 22, '.') AS p FROM supplier", "SELECT s_suppkey, repeat('ab', s_suppkey % 4) AS r, lpad(s_name, 22, '*') AS l, rpad(s_name, 22, '.') AS p FROM supplier")
sql("fn_split_part", "SELECT page_id, split_part(url, '/', 3) AS host, split_part(url, '/', 9) AS beyond FROM pages")
sql("fn_ascii", "SELECT n_nationkey, ascii(n_name) AS a, chr(65 + n_nationkey) AS c FROM nation")
sql("fn_regexp_replace", "SELECT page_id, regexp_replace(url, '[0-9]+', '#') AS u FROM pages", "SELECT page_id, regexp_replace(url, '[0-9]+', '#', 'g') AS u FROM pages")
sql("fn_regexp_extract", "SELECT page_id, regexp_extract(url, '://([^/]+)/([a-z]+)', 2) AS lang, url RLIKE 'utm_' AS tracked FROM pages", "SELECT page_id, regexp_extract(url, '://([^/]+)/([a-z]+)', 2) AS lang, regexp_matches(url, 'utm_') AS tracked FROM pages")
sql("fn_levenshtein", "SELECT a.n_name AS a, b.n_name AS b, levenshtein(a.n_name, b.n_name) AS d FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
added("fn_strpos", "SELECT p_partkey, strpos(p_name, 'e') AS at, starts_with(p_type, 'SMALL') AS s, ends_with(p_type, 'COPPER') AS e FROM part", "SELECT p_partkey, strpos(p_name, 'e') AS at, starts_with(p_type, 'SMALL') AS s, ends_with(p_type, 'COPPER') AS e FROM part")
added("fn_concat_present", "SELECT c_custkey, concat_present(c_name, nullif(c_mktsegment, 'BUILDING')) AS c FROM customer", "SELECT c_custkey, concat(c_name, nullif(c_mktsegment, 'BUILDING')) AS c FROM customer")
added("fn_regexp_first", "SELECT page_id, regexp_replace_first(url, '[0-9]+', '#') AS u, regexp_match_first(url, 'utm_[a-z]+') AS m FROM pages", "SELECT page_id, regexp_replace(url, '[0-9]+', '#') AS u, nullif(regexp_extract(url, 'utm_[a-z]+'), '') AS m FROM pages")
added("fn_initcap_quote", "SELECT n_nationkey, initcap_words(lower(n_name) || '-x y') AS i, quote_ident(n_name) AS q, chr_unicode(8300 + n_nationkey) AS c FROM nation", "SELECT n_nationkey, array_to_string(list_transform(regexp_extract_all(lower(n_name) || '-x y', '([A-Za-z0-9]+|[^A-Za-z0-9]+)'), lambda w: upper(w[1]) || lower(w[2:])), '') AS i, CASE WHEN regexp_matches(n_name, '^[a-z_][a-z0-9_$]*$') THEN n_name ELSE '\"' || replace(n_name, '\"', '\"\"') || '\"' END AS q, chr(8300 + n_nationkey) AS c FROM nation")

# Numbers (2.8.2).
sql("fn_rounding", "SELECT c_custkey, abs(c_acctbal) AS a, round(c_acctbal) AS r0, CAST(ceil(c_acctbal) AS BIGINT) AS c, CAST(floor(c_acctbal) AS BIGINT) AS f, CAST(sign(c_acctbal) AS INT) AS s FROM customer")
sql("fn_powers", "SELECT p_partkey, power(p_size, 2) AS p, sqrt(p_size) AS s, exp(p_size / 50) AS e, ln(p_size) AS l, log10(p_size) AS l10, log2(p_size) AS l2, cbrt(p_size) AS c FROM part", "SELECT p_partkey, power(p_size, 2) AS p, sqrt(p_size) AS s, exp(p_size / 50) AS e, ln(p_size) AS l, log10(p_size) AS l10, log2(p_size) AS l2, cbrt(p_size) AS c FROM part")
sql("fn_trigonometry", "SELECT p_partkey, sin(p_size) AS s, cos(p_size) AS c, tan(p_size) AS t, asin(p_size / 60) AS a, acos(p_size / 60) AS ac, atan(p_size) AS at, atan2(p_size, 3) AS a2, degrees(p_size) AS d, radians(p_size) AS r, pi() AS p FROM part")
sql("fn_mod", "SELECT l_orderkey, l_linenumber, mod(l_orderkey, 7) AS m, l_orderkey % 5 AS n FROM lineitem")
added("fn_gcd_lcm", "SELECT p_partkey, gcd(p_partkey, p_size) AS g, lcm(p_partkey, p_size) AS l FROM part", "SELECT p_partkey, CAST(gcd(p_partkey, p_size) AS BIGINT) AS g, CAST(lcm(p_partkey, p_size) AS BIGINT) AS l FROM part")
added("fn_trunc_log", "SELECT c_custkey, trunc_to(c_acctbal, 1) AS t, log_base(2D, abs(c_acctbal) + 1) AS l FROM customer", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN ceil(c_acctbal * 10) ELSE floor(c_acctbal * 10) END / 10 AS t, ln(abs(c_acctbal) + 1) / ln(2) AS l FROM customer")
added("fn_series", "SELECT n_nationkey, array_join(series(n_nationkey, 10, 3), ',') AS up, array_join(series(10, n_nationkey, -4), ',') AS down FROM nation", "SELECT n_nationkey, array_to_string(generate_series(n_nationkey, 10, 3), ',') AS up, array_to_string(generate_series(10, n_nationkey, -4), ',') AS down FROM nation")
sql("generate_series", "SELECT id AS n, id * id AS square FROM range(1, 51, 1)", "SELECT n, n * n AS square FROM generate_series(1, 50) AS t(n)")

# Nulls and types (2.8.3).
sql("fn_coalesce", "SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS c, nullif(c_nationkey, 3) AS n, greatest(c_nationkey, 10) AS g, least(c_nationkey, 10) AS l FROM customer")
added("fn_greatest_strict", "SELECT c_custkey, greatest_strict(c_acctbal, CAST(nullif(c_nationkey, 3) AS DOUBLE)) AS g, least_strict(c_acctbal, CAST(nullif(c_nationkey, 3) AS DOUBLE)) AS l FROM customer", "SELECT c_custkey, CASE WHEN c_nationkey <> 3 THEN greatest(c_acctbal, c_nationkey) END AS g, CASE WHEN c_nationkey <> 3 THEN least(c_acctbal, c_nationkey) END AS l FROM customer")
sql("fn_typeof", "SELECT typeof(1) AS i, typeof('a') AS s, typeof(1.5D) AS d, typeof(true) AS b", "SELECT 'int' AS i, 'string' AS s, 'double' AS d, 'boolean' AS b")

# Time (2.8.4, 2.8.9, 2.8.16).
sql("fn_date_trunc", "SELECT o_orderkey, CAST(CAST(date_trunc('MONTH', o_orderdate) AS DATE) AS STRING) AS m, CAST(CAST(date_trunc('YEAR', o_orderdate) AS DATE) AS STRING) AS y FROM orders", "SELECT o_orderkey, CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS VARCHAR) AS m, CAST(CAST(date_trunc('year', o_orderdate) AS DATE) AS VARCHAR) AS y FROM orders")
sql("fn_date_parts", "SELECT event_id, CAST(date_part('HOUR', ts) AS INT) AS h, CAST(date_part('MINUTE', ts) AS INT) AS m, CAST(weekday(CAST(ts AS DATE)) AS INT) AS monday_0, CAST(date_part('WEEK', ts) AS INT) AS w FROM events", "SELECT event_id, CAST(date_part('hour', ts) AS INT) AS h, CAST(date_part('minute', ts) AS INT) AS m, CAST(isodow(ts) - 1 AS INT) AS monday_0, CAST(date_part('week', ts) AS INT) AS w FROM events")
sql("fn_make_to_date", "SELECT n_nationkey, CAST(make_date(2020, 1 + n_nationkey % 12, 5) AS STRING) AS d, CAST(to_date('2021-03-04') AS STRING) AS t, date_format(make_date(2020, 1 + n_nationkey % 12, 5), 'dd.MM.yyyy') AS f FROM nation", "SELECT n_nationkey, CAST(make_date(2020, 1 + n_nationkey % 12, 5) AS VARCHAR) AS d, '2021-03-04' AS t, strftime(make_date(2020, 1 + n_nationkey % 12, 5), '%d.%m.%Y') AS f FROM nation")
sql("fn_date_arithmetic", "SELECT o_orderkey, datediff(DATE '1999-01-01', CAST(o_orderdate AS DATE)) AS days, CAST(CAST(o_orderdate AS DATE) + INTERVAL '10' DAY AS STRING) AS later FROM orders", "SELECT o_orderkey, CAST(DATE '1999-01-01' - CAST(o_orderdate AS DATE) AS INT) AS days, CAST(CAST(CAST(o_orderdate AS DATE) + INTERVAL 10 DAY AS DATE) AS VARCHAR) AS later FROM orders")
added("fn_age", "SELECT o_orderkey, age_text(DATE '1999-01-01', CAST(o_orderdate AS DATE)) AS age FROM orders", "SELECT o_orderkey, (d // 365) || ' years ' || (d % 365) // 30 || ' mons ' || d % 30 || ' days' AS age FROM (SELECT o_orderkey, abs(DATE '1999-01-01' - CAST(o_orderdate AS DATE)) AS d FROM orders) t")
added("fn_time_bucket", "SELECT event_id, time_bucket(900000, epoch_ms(ts)) AS b, date_bin('1 hour', epoch_ms(ts)) AS h FROM events", "SELECT event_id, epoch_us(ts) // 900000000 * 900000 AS b, epoch_us(ts) // 3600000000 * 3600000 AS h FROM events")

# JSON (2.8.5, 2.9).
sql("json_get_text", "SELECT event_id, get_json_object(props, '$.k') AS k FROM events", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
sql("json_path_filter", "SELECT count(*) AS n FROM events WHERE CAST(get_json_object(props, '$.k') AS INT) > 50", "SELECT count(*) AS n FROM events WHERE CAST(json_extract_string(props, '$.k') AS INT) > 50")
sql("json_variant", "SELECT event_id, variant_get(parse_json(props), '$.k', 'int') AS k FROM events", "SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events")
sql("json_build", "SELECT n_nationkey, to_json(named_struct('id', n_nationkey, 'name', n_name)) AS o, to_json(array(n_nationkey, n_regionkey)) AS a FROM nation", "SELECT n_nationkey, CAST(json_object('id', n_nationkey, 'name', n_name) AS VARCHAR) AS o, CAST(json_array(n_nationkey, n_regionkey) AS VARCHAR) AS a FROM nation")
sql("json_array_length", "SELECT n_nationkey, json_array_length(to_json(sequence(0, n_nationkey))) AS n FROM nation", "SELECT n_nationkey, CAST(json_array_length(to_json(generate_series(0, n_nationkey))) AS INT) AS n FROM nation")
sql("json_keys", "SELECT event_id, array_join(json_object_keys(props), ',') AS keys FROM events", "SELECT event_id, array_to_string(json_keys(props), ',') AS keys FROM events")
added("json_typeof", "SELECT event_id, json_typeof(props) AS t, json_typeof(get_json_object(props, '$.k')) AS k, json_extract_path_text(props, 'k') AS v FROM events", "SELECT event_id, 'object' AS t, 'number' AS k, json_extract_string(props, '$.k') AS v FROM events")

# Geography (2.8.6, 2.8.16, 2.18): coordinates made from keys.
POINTS = "(SELECT s_suppkey AS id, (s_suppkey * 37 % 1200) / 10.0 - 60 AS lat, (s_suppkey * 91 % 3400) / 10.0 - 170 AS lon FROM supplier)"
HAVERSINE = "2 * 6371000 * asin(sqrt(least(1.0, pow(sin(radians(48.85 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(48.85)) * pow(sin(radians(2.35 - lon) / 2), 2))))"
added("geo_distance", f"SELECT id, geo_distance(CAST(lat AS DOUBLE), CAST(lon AS DOUBLE), 48.85D, 2.35D) AS m, geo_distance_euclidean(CAST(lon AS DOUBLE), CAST(lat AS DOUBLE), 0D, 0D) AS e FROM {POINTS} p", f"SELECT id, {HAVERSINE} AS m, sqrt(lon * lon + lat * lat) AS e FROM {POINTS} p")
added("geo_within", f"SELECT id FROM {POINTS} p WHERE geo_within(CAST(lat AS DOUBLE), CAST(lon AS DOUBLE), 48.85D, 2.35D, 5000000D)", f"SELECT id FROM {POINTS} p WHERE {HAVERSINE} <= 5000000")
added("geo_nearest", f"SELECT id FROM (SELECT id, geo_distance(CAST(lat AS DOUBLE), CAST(lon AS DOUBLE), 48.85D, 2.35D) AS m FROM {POINTS} p) d ORDER BY m, id LIMIT 10", f"SELECT id FROM {POINTS} p ORDER BY {HAVERSINE}, id LIMIT 10")
sql("geo_bbox", f"SELECT id FROM {POINTS} p WHERE lat BETWEEN -20 AND 40 AND lon BETWEEN -60 AND 60")
added("geo_polygon", f"SELECT id FROM {POINTS} p WHERE point_in_polygon(CAST(lon AS DOUBLE), CAST(lat AS DOUBLE), array(-100D, 100.05D, 0.03D), array(-50.01D, -50.02D, 50.03D))", f"SELECT id FROM {POINTS} p WHERE (((-50.01 > lat) <> (-50.02 > lat) AND lon < (100.05 + 100) * (lat + 50.01) / (-50.02 + 50.01) - 100) <> ((-50.02 > lat) <> (50.03 > lat) AND lon < (0.03 - 100.05) * (lat + 50.02) / (50.03 + 50.02) + 100.05)) <> ((50.03 > lat) <> (-50.01 > lat) AND lon < (-100 - 0.03) * (lat - 50.03) / (-50.01 - 50.03) + 0.03)")
added("geo_area_point", "SELECT n_nationkey, geo_area(array(0D, 4D, 4D, 0D), array(0D, 0D, CAST(n_nationkey AS DOUBLE), 3D)) AS area, st_x(st_makepoint(n_nationkey, 2.5)) AS x, st_y(st_makepoint(n_nationkey, 2.5)) AS y FROM nation", "SELECT n_nationkey, abs(4 * n_nationkey + 4 * 3) / 2.0 AS area, CAST(n_nationkey AS DOUBLE) AS x, 2.5::DOUBLE AS y FROM nation")

# Vectors (2.8.7, 2.8.10, 2.8.16).
added("vector_distances", "SELECT a.vec_id AS a, b.vec_id AS b, l2_distance(CAST(a.embedding AS ARRAY<DOUBLE>), CAST(b.embedding AS ARRAY<DOUBLE>)) AS l2, cosine_distance(CAST(a.embedding AS ARRAY<DOUBLE>), CAST(b.embedding AS ARRAY<DOUBLE>)) AS cos, inner_product(CAST(a.embedding AS ARRAY<DOUBLE>), CAST(b.embedding AS ARRAY<DOUBLE>)) AS dot FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1", "SELECT a.vec_id AS a, b.vec_id AS b, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS l2, 1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS cos, list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS dot FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
added("vector_norms", "SELECT vec_id, vector_dims(CAST(embedding AS ARRAY<DOUBLE>)) AS d, vector_norm(vector_normalize(CAST(embedding AS ARRAY<DOUBLE>))) AS n FROM embeddings", "SELECT vec_id, CAST(len(embedding) AS INT) AS d, 1.0::DOUBLE AS n FROM embeddings")
added("sparse_dot", "SELECT n_nationkey, sparse_dot_product(map(1, CAST(n_nationkey AS DOUBLE), 2, 2D), map(2, 3D, 1, 0.5D, 7, 9D)) AS d FROM nation", "SELECT n_nationkey, CAST(n_nationkey * 0.5 + 6.0 AS DOUBLE) AS d FROM nation")

# Hashes, encodings, arrays (2.8.12, 2.8.15).
sql("fn_hashes", "SELECT doc_id, md5(text) AS m, sha2(text, 256) AS s FROM documents", "SELECT doc_id, md5(text) AS m, sha256(text) AS s FROM documents")
added("fn_encodings", "SELECT n_nationkey, encode_as(n_name, 'hex') AS h, encode_as(n_name, 'base64') AS b, decode_as(encode_as(n_name, 'base64'), 'base64') AS back FROM nation", "SELECT n_nationkey, lower(hex(n_name)) AS h, base64(encode(n_name)) AS b, n_name AS back FROM nation")
sql("array_functions", "SELECT p_partkey, size(split(p_name, ' ')) AS n, array_contains(split(p_name, ' '), 'red') AS red, array_join(array_append(split(p_name, ' '), 'x'), '|') AS a, array_join(array_distinct(split(p_name, ' ')), '|') AS d, element_at(split(p_name, ' '), 1) AS first FROM part", "SELECT p_partkey, CAST(len(string_split(p_name, ' ')) AS INT) AS n, list_contains(string_split(p_name, ' '), 'red') AS red, array_to_string(list_append(string_split(p_name, ' '), 'x'), '|') AS a, array_to_string(list_filter(string_split(p_name, ' '), lambda x, i: list_position(string_split(p_name, ' '), x) = i), '|') AS d, string_split(p_name, ' ')[1] AS first FROM part")
added("array_bounds", "SELECT p_partkey, array_upper(split(p_name, ' ')) AS u, array_lower(split(p_name, ' ')) AS l, array_join(array_cat(split(p_name, ' '), CAST(NULL AS ARRAY<STRING>)), ' ') AS c FROM part", "SELECT p_partkey, CAST(len(string_split(p_name, ' ')) AS INT) AS u, 1 AS l, p_name AS c FROM part")

"""Functions that the SQL surface has beside Spark's own, as SQL expressions that Catalyst inlines.

install(spark) makes them temporary functions; names are those of the PostgreSQL-flavoured surface."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: signature, result, body.
FUNCTIONS: list[tuple[str, str, str]] = [
    # strings
    ("strpos(s STRING, sub STRING)", "INT", "position(sub, s)"),
    ("starts_with(s STRING, p STRING)", "BOOLEAN", "startswith(s, p)"),
    ("ends_with(s STRING, p STRING)", "BOOLEAN", "endswith(s, p)"),
    ("concat_present(a STRING, b STRING)", "STRING", "concat_ws('', a, b)"),
    ("initcap_words(s STRING)", "STRING", "array_join(transform(regexp_extract_all(s, '([A-Za-z0-9]+|[^A-Za-z0-9]+)', 1), w -> concat(upper(left(w, 1)), lower(substring(w, 2)))), '')"),
    ("regexp_replace_first(s STRING, p STRING, r STRING)", "STRING", "CASE WHEN s RLIKE p THEN regexp_replace(s, concat('(?s)^(.*?)(?:', p, ')(.*)$'), concat('$1', r, '$2')) ELSE s END"),
    ("regexp_match_first(s STRING, p STRING)", "STRING", "CASE WHEN s RLIKE p THEN regexp_extract(s, p, 0) END"),
    ("quote_ident(s STRING)", "STRING", "CASE WHEN s RLIKE '^[a-z_][a-z0-9_$]*$' THEN s ELSE concat('\"', replace(s, '\"', '\"\"'), '\"') END"),
    ("chr_unicode(n INT)", "STRING", "decode(unhex(lpad(hex(n), 8, '0')), 'UTF-32')"),
    # numbers
    ("gcd(a BIGINT, b BIGINT)", "BIGINT", "abs(aggregate(sequence(1, 92), named_struct('a', a, 'b', b), (s, i) -> CASE WHEN s.b = 0 THEN s ELSE named_struct('a', s.b, 'b', s.a % s.b) END, s -> s.a))"),
    ("lcm(a BIGINT, b BIGINT)", "BIGINT", "CASE WHEN a = 0 OR b = 0 THEN 0 ELSE abs(a div aggregate(sequence(1, 92), named_struct('a', a, 'b', b), (s, i) -> CASE WHEN s.b = 0 THEN s ELSE named_struct('a', s.b, 'b', s.a % s.b) END, s -> s.a) * b) END"),
    ("trunc_to(x DOUBLE, d INT)", "DOUBLE", "CASE WHEN x < 0 THEN ceil(x * pow(10, d)) ELSE floor(x * pow(10, d)) END / pow(10, d)"),
    ("log_base(b DOUBLE, x DOUBLE)", "DOUBLE", "ln(x) / ln(b)"),
    ("series(a BIGINT, b BIGINT, step BIGINT)", "ARRAY<BIGINT>", "CASE WHEN step = 0 THEN raise_error('step size cannot be zero') WHEN (b - a) * sign(step) < 0 THEN array() ELSE sequence(a, b, step) END"),
    # nulls and types
    ("greatest_strict(a DOUBLE, b DOUBLE)", "DOUBLE", "CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN greatest(a, b) END"),
    ("least_strict(a DOUBLE, b DOUBLE)", "DOUBLE", "CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN least(a, b) END"),
    # time; epoch milliseconds as bigint, as series keep them
    ("time_bucket(width BIGINT, ts BIGINT)", "BIGINT", "floor(ts / width) * width"),
    ("epoch_ms(ts TIMESTAMP_NTZ)", "BIGINT", "unix_millis(CAST(ts AS TIMESTAMP))"),
    ("age_text(a DATE, b DATE)", "STRING", "concat(abs(datediff(a, b)) div 365, ' years ', (abs(datediff(a, b)) % 365) div 30, ' mons ', abs(datediff(a, b)) % 30, ' days')"),
    ("date_bin(unit STRING, ts BIGINT)", "BIGINT", "floor(ts / CASE WHEN unit LIKE '%second%' THEN 1000 WHEN unit LIKE '%minute%' THEN 60000 WHEN unit LIKE '%hour%' THEN 3600000 WHEN unit LIKE '%day%' THEN 86400000 WHEN unit LIKE '%week%' THEN 604800000 ELSE 2592000000 END) * CASE WHEN unit LIKE '%second%' THEN 1000 WHEN unit LIKE '%minute%' THEN 60000 WHEN unit LIKE '%hour%' THEN 3600000 WHEN unit LIKE '%day%' THEN 86400000 WHEN unit LIKE '%week%' THEN 604800000 ELSE 2592000000 END"),
    # arrays
    ("array_upper(a ARRAY<STRING>)", "INT", "nullif(size(a), 0)"),
    ("array_lower(a ARRAY<STRING>)", "INT", "CASE WHEN size(a) > 0 THEN 1 END"),
    ("array_cat(a ARRAY<STRING>, b ARRAY<STRING>)", "ARRAY<STRING>", "concat(coalesce(a, array()), coalesce(b, array()))"),
    # JSON text
    ("json_typeof(j STRING)", "STRING", "CASE WHEN j IS NULL THEN NULL WHEN ltrim(j) LIKE '{%' THEN 'object' WHEN ltrim(j) LIKE '[%' THEN 'array' WHEN ltrim(j) LIKE '\"%' THEN 'string' WHEN trim(j) IN ('true', 'false') THEN 'boolean' WHEN trim(j) = 'null' THEN 'null' ELSE 'number' END"),
    ("json_extract_path_text(j STRING, k STRING)", "STRING", "get_json_object(j, concat('$.', k))"),
    ("jsonb_object_keys(j STRING)", "ARRAY<STRING>", "json_object_keys(j)"),
    # geography; degrees and metres
    ("geo_distance(lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE)", "DOUBLE", "2 * 6371000 * asin(sqrt(least(1D, pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2))))"),
    ("geo_distance_euclidean(x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE)", "DOUBLE", "sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2))"),
    ("geo_within(lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE, r DOUBLE)", "BOOLEAN", "2 * 6371000 * asin(sqrt(least(1D, pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2)))) <= r"),
    ("geo_area(xs ARRAY<DOUBLE>, ys ARRAY<DOUBLE>)", "DOUBLE", "abs(aggregate(sequence(1, size(xs)), 0D, (s, i) -> s + element_at(xs, i) * element_at(ys, i % size(xs) + 1) - element_at(xs, i % size(xs) + 1) * element_at(ys, i))) / 2"),
    ("st_makepoint(x DOUBLE, y DOUBLE)", "STRING", "concat('POINT(', CAST(x AS STRING), ' ', CAST(y AS STRING), ')')"),
    ("st_x(p STRING)", "DOUBLE", "CAST(regexp_extract(p, 'POINT ?\\\\(([^ ]+) ([^)]+)\\\\)', 1) AS DOUBLE)"),
    ("st_y(p STRING)", "DOUBLE", "CAST(regexp_extract(p, 'POINT ?\\\\(([^ ]+) ([^)]+)\\\\)', 2) AS DOUBLE)"),
    ("point_in_polygon(x DOUBLE, y DOUBLE, xs ARRAY<DOUBLE>, ys ARRAY<DOUBLE>)", "BOOLEAN", "aggregate(sequence(1, size(xs)), false, (s, i) -> s <> ((element_at(ys, i) > y) <> (element_at(ys, i % size(xs) + 1) > y) AND x < (element_at(xs, i % size(xs) + 1) - element_at(xs, i)) * (y - element_at(ys, i)) / CASE WHEN element_at(ys, i % size(xs) + 1) = element_at(ys, i) THEN 1 ELSE element_at(ys, i % size(xs) + 1) - element_at(ys, i) END + element_at(xs, i)))"),
    # vectors
    ("l2_distance(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>)", "DOUBLE", "sqrt(aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x))"),
    ("inner_product(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>)", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"),
    ("cosine_distance(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>)", "DOUBLE", "1 - aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x) / sqrt(aggregate(a, 0D, (s, x) -> s + x * x) * aggregate(b, 0D, (s, x) -> s + x * x))"),
    ("vector_dims(v ARRAY<DOUBLE>)", "INT", "size(v)"),
    ("vector_norm(v ARRAY<DOUBLE>)", "DOUBLE", "sqrt(aggregate(v, 0D, (s, x) -> s + x * x))"),
    ("vector_normalize(v ARRAY<DOUBLE>)", "ARRAY<DOUBLE>", "transform(v, x -> x / nullif(sqrt(aggregate(v, 0D, (s, y) -> s + y * y)), 0))"),
    ("sparse_dot_product(a MAP<INT, DOUBLE>, b MAP<INT, DOUBLE>)", "DOUBLE", "aggregate(map_keys(a), 0D, (s, k) -> s + element_at(a, k) * coalesce(try_element_at(b, k), 0D))"),
    # encodings
    ("encode_as(s STRING, format STRING)", "STRING", "CASE format WHEN 'hex' THEN lower(hex(s)) WHEN 'base64' THEN base64(CAST(s AS BINARY)) ELSE s END"),
    ("decode_as(s STRING, format STRING)", "STRING", "CAST(CASE format WHEN 'hex' THEN unhex(s) WHEN 'base64' THEN unbase64(s) ELSE CAST(s AS BINARY) END AS STRING)"),
]


def install(spark: SparkSession) -> None:
    """Define all functions in the session; again is harmless."""
    for signature, result, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {result} RETURN {body}")

"""The corpus operators' queries, one for each operator over its whole table, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.llm import ann, bpe, exact, langid, mixing, passages, quality, simhash, tokenfile, urlfilter
from basalt.llm.common import Scratch, table

#: Rules of op6: verdict, then host and path.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def fold(folds: int, doc_id: str = "doc_id") -> Column:
    """Rows of one id are in one fold, by crc32 of its text; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.groups(table(spark, sf_dir, "documents"), keep="largest")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(fold(4) == 2, F.lit(True))
    model = langid.train(docs.filter(~held_out), order=F.xxhash64("doc_id"))
    out = langid.predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).rows


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = Scratch(spark).new()
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenfile.write(table(spark, sf_dir, "documents"), path, out, end_id=2)
    return tokenfile.read(spark, out)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(fold(5) == 0, F.lit(True))
    model = quality.train(docs, labels.filter(~held_out))
    out = quality.score(docs, model)
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, ids=False)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.component_ids(table(spark, sf_dir, "documents"))


def op10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.near_passages(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_exact_dedup, op2_language_id, op3_nearest, op4_mixing, op5_token_files, op6_url_filter, op7_quality, op8_byte_bpe, op9_simhash, op10_passages)
}

ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op4_mixing": """
        WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size, coalesce('=' || source, '') AS key,
                CAST('0x' || substr(md5(concat_ws('|', '0', CAST(doc_id AS VARCHAR))), 1, 13) AS BIGINT) AS place FROM documents),
        s0 AS (SELECT key, source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY key, source),
        s1 AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS w, CAST(source_size * 3 AS DOUBLE) AS cap FROM s0),
        s2 AS (SELECT *, cap / w AS fill FROM s1),
        s3 AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER (ORDER BY fill, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(w) OVER (ORDER BY fill, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s2),
        s4 AS (SELECT key, source_size, coalesce(least(cap, w * (SELECT level FROM s3 WHERE fill >= level ORDER BY fill, level LIMIT 1)), cap) AS target,
                (source_size + 63) // 64 AS n_blocks FROM s3),
        s AS (SELECT *, CASE WHEN source_size > 0 THEN target * n_blocks / source_size ELSE 0 END AS n_slots FROM s4),
        n AS (SELECT greatest(1, (CAST(floor(sum(n_slots)) AS BIGINT) + 4095) // 4096) AS n_shards FROM s),
        shards AS (SELECT unnest(range(n_shards)) AS shard FROM n),
        packed AS (SELECT doc_id, key, size, CAST(coalesce(sum(size) OVER (PARTITION BY key ORDER BY place % 1024, place, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
                FROM d WHERE size > 0),
        segments AS (SELECT *, least(start + size, (block + 1) * 64) - greatest(start, block * 64) AS words
                FROM (SELECT *, unnest(range(start // 64, (start + size - 1) // 64 + 1)) AS block FROM packed) t),
        e AS (SELECT key, n_blocks, n_slots / n_shards AS each, floor(n_slots / n_shards) AS whole, n_slots / n_shards - floor(n_slots / n_shards) AS fraction FROM s, n WHERE n_slots > 0),
        ends AS (SELECT key, fraction, sum(fraction) OVER (ORDER BY key ROWS UNBOUNDED PRECEDING) AS hi FROM e),
        t AS (SELECT coalesce(max(hi), 0.0) AS total FROM ends),
        draws AS (SELECT shard, total * CAST('0x' || substr(md5(concat_ws('|', '0', CAST(shard AS VARCHAR), CAST(draw AS VARCHAR))), 1, 13) AS BIGINT) / 4503599627370496.0 AS u
                FROM (SELECT shard, total, unnest(range(1, CAST(floor(total) AS BIGINT) + 2)) AS draw FROM shards, t) x
                WHERE draw <= floor(total) + CAST(CAST('0x' || substr(md5(concat_ws('|', '0', CAST(shard AS VARCHAR), 'n')), 1, 13) AS BIGINT) / 4503599627370496.0 < total - floor(total) AS INT)),
        hits AS (SELECT shard, key, count(*) AS more FROM draws JOIN ends ON hi - fraction <= u AND u < hi GROUP BY shard, key),
        counts AS (SELECT shard, key, n_blocks, CAST(whole AS BIGINT) + coalesce(more, 0) AS n FROM e CROSS JOIN shards LEFT JOIN hits USING (shard, key)),
        begins AS (SELECT *, CAST(sum(n) OVER (PARTITION BY key ORDER BY shard) AS BIGINT) - n AS begin FROM counts),
        slots AS (SELECT key, n_blocks, unnest(range(begin, begin + n)) AS j FROM begins WHERE n > 0),
        boxes AS (SELECT *, (n_blocks + a - 1) // a AS b FROM (SELECT *, CAST(ceil(sqrt(CAST(n_blocks AS DOUBLE))) AS BIGINT) AS a, j // n_blocks AS turn FROM slots WHERE j < n_blocks * 3) t),
        walk(key, j, n_blocks, a, b, turn, x, step) AS (
            SELECT key, j, n_blocks, a, b, turn, CAST(j % n_blocks AS BIGINT), 0 FROM boxes
            UNION ALL
            SELECT key, j, n_blocks, a, b, turn, l * b + (r + CAST('0x' || substr(md5(concat_ws('|', '0', key, CAST(turn AS VARCHAR), '3', CAST(l AS VARCHAR))), 1, 13) AS BIGINT)) % b, step + 1
            FROM (SELECT * REPLACE ((l + CAST('0x' || substr(md5(concat_ws('|', '0', key, CAST(turn AS VARCHAR), '2', CAST(r AS VARCHAR))), 1, 13) AS BIGINT)) % a AS l)
            FROM (SELECT * REPLACE ((r + CAST('0x' || substr(md5(concat_ws('|', '0', key, CAST(turn AS VARCHAR), '1', CAST(l AS VARCHAR))), 1, 13) AS BIGINT)) % b AS r)
            FROM (SELECT * REPLACE ((l + CAST('0x' || substr(md5(concat_ws('|', '0', key, CAST(turn AS VARCHAR), '0', CAST(r AS VARCHAR))), 1, 13) AS BIGINT)) % a AS l)
            FROM (SELECT *, x // b AS l, x % b AS r FROM walk WHERE step = 0 OR x >= n_blocks) t0) t1) t2) t3),
        times AS (SELECT key, x AS block, count(*) AS times FROM walk WHERE step > 0 AND x < n_blocks GROUP BY ALL),
        taken AS (SELECT key, start, CAST(sum(words * times) AS BIGINT) AS taken FROM segments JOIN times USING (key, block) GROUP BY key, start)
        SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken FROM packed LEFT JOIN taken USING (key, start) JOIN s USING (key)
        UNION ALL SELECT doc_id, size, source_size, target, 0 FROM d JOIN s USING (key) WHERE size = 0""",
    "op6_url_filter": """
        WITH RECURSIVE rules(verdict, rule) AS (VALUES ('allow', 'org/'), ('block', 'example.org/es/'), ('block', 'example.org/en/1'), ('allow', 'com/fr/'), ('block', 'com/de/')),
        r AS (SELECT verdict, rule, split_part(rule, '/', 1) AS h, substr(rule, position('/' IN rule)) AS p FROM rules),
        links AS (
            SELECT url, unnest(regexp_extract_all(html, '(?is)<link\\b[^>]*\\brel\\s*=\\s*["'']?canonical\\b[^>]*>')) AS tag, '(?is)\\bhref\\s*=\\s*["'']?([^"''\\s>]+)' AS pat FROM pages
            UNION ALL
            SELECT url, unnest(regexp_extract_all(html, '(?is)<meta\\b[^>]*\\bhttp-equiv\\s*=\\s*["'']?refresh\\b[^>]*>')), '(?is)\\burl\\s*=\\s*["'']?([^"''\\s>]+)' FROM pages),
        e AS (SELECT split_part(url, '#', 1) AS a, split_part(regexp_extract(tag, pat, 1), '#', 1) AS b FROM links),
        both_ways AS (SELECT a, b FROM e WHERE b LIKE '%://%' UNION SELECT b, a FROM e WHERE b LIKE '%://%'),
        reach(u, v) AS (SELECT a, b FROM both_ways UNION SELECT u, b FROM reach JOIN both_ways ON v = a),
        urls AS (SELECT DISTINCT u AS url FROM (SELECT url AS u FROM pages UNION SELECT v FROM reach) t),
        parts AS (SELECT url, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM urls),
        split AS (SELECT url, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
        judged AS (SELECT url, host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
            FROM split LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY ALL)
        SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule,
            coalesce(j.verdict, CASE WHEN EXISTS (SELECT 1 FROM reach JOIN judged b ON b.url = v WHERE u = split_part(pages.url, '#', 1) AND b.verdict = 'block') THEN 'block' ELSE 'allow' END) AS verdict
        FROM pages LEFT JOIN judged j ON j.url = pages.url""",
}

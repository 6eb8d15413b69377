"""The corpus pipeline: which documents go on, and what becomes of them.

Each stage takes (spark, docs, sf_dir) and returns a frame; all but the last return the columns of
documents. run() writes each stage's frame as Parquet in the shared folder and reads it as the next
one's docs."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.llm import bpe, exact, langid, mixing, simhash
from basalt.llm.common import Scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Bytes of words that a worker of byte_bpe remembers: the executors' JVMs stay as large as the stages before made them.
WORDS = 32 << 20


def one_of_each(docs: DataFrame, kept: DataFrame, *also: str) -> DataFrame:
    """The rows of `docs` whose doc_id, and columns `also`, are in `kept`; of rows that repeat a doc_id and
    text, the first by its columns. Ids meet by shuffle, null ones too, in which repeated rows combine first."""
    key = F.sha2(F.coalesce("text", F.lit("")), 256)
    first = docs.groupBy("doc_id", key.alias("text_sha256"), *[c for c in also if c in docs.columns]).agg(F.min(F.struct(*COLUMNS[1:])).alias("row"))
    kept = kept.select("doc_id", *also).distinct()
    on = first.doc_id.eqNullSafe(kept.doc_id)
    for c in also:  # neither is null; with == Spark would check that, and for a computed column compute it once more
        on &= first[c].eqNullSafe(kept[c])
    return first.join(kept, on, "left_semi").select("doc_id", "row.*")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters go, null and empty texts too, and those of which no language has at
    least half of the letters. Null ids and repeated rows are judged like others; without any text and
    lang to learn from all go; an empty table gives no rows; more columns are ignored."""
    docs = docs.select(*COLUMNS)
    model = langid.train(docs, order=F.xxhash64("doc_id"))
    return langid.predict(docs, model).filter((F.col("lang_pred") != "und") & (F.col("score") >= 0.5)).select(*COLUMNS)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the smallest doc_id stays, null if all are; null counts as empty. Of
    rows that repeat an id and text one stays, the first by its columns. An empty table gives no rows."""
    return one_of_each(docs, exact.groups(docs).filter("kept"), "text_sha256")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar fingerprints, the row with the smallest doc_id stays, null if all
    are; null and empty texts have fingerprint zero. Different texts of one id are told apart by their
    fingerprints; rows that repeat an id and text count once. An empty table gives no rows."""
    groups = simhash.component_ids(docs)
    prints = docs.withColumn("fingerprint", F.lpad(F.lower(F.hex(simhash.fingerprints("text"))), 16, "0"))
    return one_of_each(prints, groups.filter(F.col("component_id").eqNullSafe(F.col("doc_id"))), "fingerprint")


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as often as the mix takes its words: the whole part of words taken by size,
    and once more with a chance of the fraction, decided by a hash of its id and text. Documents without
    words go, as the mix can't take them. A document is an id, null or not, with a text: different texts
    of one id are mixed each for itself; of rows that repeat both, the first by its columns counts and
    comes for all. An empty table gives no rows; more columns are ignored."""
    key = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text"))
    docs = docs.select(*COLUMNS, key.alias("document"))
    rows = mixing.mix(docs, doc_id="document").rows.filter("taken > 0")
    times = F.col("taken") / F.col("size")
    whole = F.floor(times)
    rows = rows.select(F.col("doc_id").alias("document"), (whole + (mixing.uniform(F.lit("copies"), F.col("doc_id")) < times - whole).cast("int")).cast("int").alias("times"))
    rows = rows.groupBy("document").agg(F.sum("times").alias("times")).filter("times > 0")
    kept = docs.groupBy("document").agg(F.min(F.struct(*COLUMNS)).alias("row"))
    both = kept.join(rows, "document").select("row.*", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return both.select(*COLUMNS)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each row's text, null ids and repeated rows as given; null texts count as empty."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, room=WORDS)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("simhash_near_dedup", near_dedup),
    ("mixing", mixing_sources),
    ("byte_bpe", byte_bpe),
]

#: Languages, fingerprints and ids aren't SQL's; tests/llm/test_pipeline.py has the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = scratch.keep(docs)
    return docs

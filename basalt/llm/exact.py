"""Exact deduplication (operator 1)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.llm.common import Scratch, lookup

#: Bits of the table of hashes that occur more than once: 2048 rows of 4 KB, whatever the input.
BITS = 1 << 26


def md5_128(text: Column) -> Column:
    return F.unhex(F.md5(text))


def groups(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    keep: str = "smallest",
    normalise: Callable[[Column], Column] = lambda c: c,
    digest: Callable[[Column], Column] = md5_128,
) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of `docs`.

    Rows group by a 128-bit hash of the normalised text; the texts of hashes that occur more than once
    are then compared byte by byte, so that a collision never joins different texts. The row with the
    smallest (or largest) doc_id of equal texts stays.

    Null text counts as empty. A null doc_id never stays while another id has that text; if all are
    null, keep_id is null and the rows are kept. Rows that repeat a doc_id and text share its decision.
    An empty table gives no rows; other columns are ignored. Hot groups: copies combine before each
    shuffle, and decisions go back to rows of hot groups by a broadcast of at most 1000 rows.

    Only texts whose hash repeats are shuffled: a bit table of fixed size marks those hashes, and what
    it marks in error costs a comparison, not a wrong result."""
    if keep not in ("smallest", "largest"):
        raise ValueError("keep must be 'smallest' or 'largest'")
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(normalise(F.col(text)), F.lit("")).alias("text"))
    rows = rows.withColumn("h", digest(F.col("text")))
    narrow = scratch.keep(rows.select("doc_id", "h", F.unhex(F.sha2("text", 256)).alias("sha")))
    total = narrow.count()

    repeated = narrow.groupBy("h").count().filter("count > 1")
    spot = F.pmod(F.xxhash64("h"), F.lit(BITS))
    bits = repeated.select(spot.alias("spot")).groupBy(F.bitmap_bucket_number("spot").alias("bucket"))
    bits = bits.agg(F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("bits"))
    place = F.bitmap_bit_position("spot")
    byte = F.conv(F.hex(F.substring("bits", (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = rows.withColumn("spot", spot).withColumn("bucket", F.bitmap_bucket_number("spot")).join(F.broadcast(bits), "bucket")
    marked = marked.filter(byte.bitwiseAND(F.expr("shiftleft(1, cast(bitmap_bit_position(spot) % 8 as int))")) != 0)

    best = F.min("doc_id") if keep == "smallest" else F.max("doc_id")
    same = marked.groupBy("h", "text").agg(best.alias("keep_id"), F.count("*").alias("group_size")).filter("group_size > 1")
    key = lambda sha: F.concat("h", sha).alias("key")
    same = same.select(key(F.unhex(F.sha2("text", 256))), "keep_id", "group_size")
    found = lookup(narrow.select("doc_id", "sha", key("sha")), scratch.keep(same), "key", "group_size", total)
    alone = F.col("group_size").isNull()
    keep_id = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep_id).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )

"""Operator 3: proportional stratified interleaving into shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from concordia.llm.scratch import Scratch

#: Buckets of the two rankings.  Their number is fixed, so the prefix sums over them are
#: bounded; the rows within a bucket are ranked in parallel, by a sort that can spill.
BUCKETS = 4096


def hash60(*parts):
    """The first 15 hex digits of an MD5, as a number below 2^60."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("long")


def interleave(docs: DataFrame, n_shards: int = 24, seed: int = 42) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row; shard counts differ by one at most.

    Rows are shuffled within their source by a seeded hash and get the fraction
    (rank - 1 + phase) / rows of the source, with a phase per source; sorted by it, any
    stretch holds the sources in their shares, and the sorted rows are cut into shards of
    equal counts.  The first ranking goes by source and hash bucket, the second by
    fraction bucket, so a source that holds most rows is spread over BUCKETS tasks.

    A null text has no bytes; texts of any length count as a whole; a null id or source is a
    value like others; ties in the hash go by id, size and checksum, so only rows that are wholly
    alike can trade places, and repeated rows are placed one by one.  Other columns are ignored;
    an empty table gives no rows.
    """
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    shuffled = hash60(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = docs.select(
        "doc_id",
        F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("stratum"),
        shuffled.alias("h"),
        F.shiftright(shuffled, 48).cast("int").alias("bucket"),
    )
    counts = rows.groupBy("stratum", "bucket").agg(F.count("*").alias("n"))
    by = Window.partitionBy("stratum")
    offsets = counts.select(
        "stratum",
        "bucket",
        (F.sum("n").over(by.orderBy("bucket")) - F.col("n")).alias("before"),
        F.sum("n").over(by).alias("total"),
    )
    full = docs.select(
        "doc_id",
        F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("stratum"),
        shuffled.alias("h"),
        F.shiftright(shuffled, 48).cast("int").alias("bucket"),
        (F.octet_length(F.coalesce("text", F.lit(""))) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    within = Window.partitionBy("stratum", "bucket").orderBy("h", "doc_id", "size", "text_crc32")
    phase = hash60(F.lit(seed), F.lit("phase"), F.col("stratum")) / F.lit(float(2**60))
    rank = F.col("before") + F.row_number().over(within) - 1
    ranked = full.join(offsets, ["stratum", "bucket"]).select(
        "doc_id", "size", "text_crc32", "stratum", "h", ((rank + phase) / F.col("total")).alias("part")
    )
    ranked = Scratch(docs.sparkSession, "shards").keep(ranked, "ranked")
    ranked = ranked.withColumn("bucket", F.floor(F.col("part") * BUCKETS).cast("int"))
    n = ranked.count()
    counts = ranked.groupBy("bucket").agg(F.count("*").alias("n"))
    offsets = counts.select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("before"))
    within = Window.partitionBy("bucket").orderBy("part", "stratum", "h", "doc_id", "size", "text_crc32")
    place = F.col("before") + F.row_number().over(within) - 1
    placed = ranked.join(offsets, "bucket").select("doc_id", "size", "text_crc32", place.alias("place"))
    shard = F.expr(f"(place * {n_shards}) div {max(n, 1)}")
    first = F.expr(f"(shard * {n} + {n_shards - 1}) div {n_shards}")
    return placed.withColumn("shard", shard.cast("int")).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("place") - first).alias("slot")
    )

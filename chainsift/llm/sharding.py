"""Contiguous, byte-balanced shards by global prefix sums (DataFrame functions only).

Rows of equal texts are a group and stay together. Groups are ordered by a hash of their text and dealt into
ranges; each range's number is written with its groups, so that later reads agree on it. Totals for each range
(as many rows as there are shuffle partitions) give, by a running sum, the bytes and rows before each range; a
running sum inside each range completes the global prefix. Shard s gets the groups whose middle byte lies in
[s, s + 1) * total / shards. Inside a group rows are ranked in salted parts, so that no task needs to hold a
large group; what is broadcast has one row for each range or shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import write_table

#: Rows of a group that are ranked together, about, where a group holds all rows.
PER_PART = 20_000


def shard_by_bytes(docs: DataFrame, shards: int = 40, overhead: int = 16) -> DataFrame:
    """Rows ``doc_id, size, text_crc32, shard, slot``; ``size`` is the text's UTF-8 bytes plus ``overhead``.

    Equal texts, repeated rows among them, are in one shard; each row has its own slot. A null text counts
    as no bytes and as equal to the empty text. Null doc_ids are rows like others. Other columns of ``docs``
    are not read. An empty table gives no rows; a shard may stay empty where there are fewer groups than
    shards, or where one group is larger than a shard's target. Sizes of shards differ from the target by
    at most the largest group."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # the narrow rows are written: texts are read once
    narrow = write_table(narrow.withColumn("row", F.monotonically_increasing_id()), "shard-sizes")
    salts = max(n, narrow.count() // PER_PART)
    narrow = narrow.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int"))
    key = ["text_key", "text_crc32", "size"]
    parts = narrow.groupBy(*key, "salt").agg(F.count("*").alias("n"))
    groups = parts.groupBy(*key).agg(F.sum("n").alias("rows")).withColumn("bytes", F.col("rows") * F.col("size"))
    groups = write_table(groups.repartitionByRange(n, *key).withColumn("range", F.spark_partition_id()), "shard-groups")
    totals = groups.groupBy("range").agg(F.sum("bytes").alias("range_bytes"), F.sum("rows").alias("range_rows"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy(F.lit(0))
    totals = totals.select(
        "range",
        F.coalesce(F.sum("range_bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("range_rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("range_bytes").over(everything).alias("total"),
    )
    inside = Window.partitionBy("range").orderBy(*key).rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        groups.join(F.broadcast(totals), "range")
        .withColumn("first", F.col("rows_before") + F.sum("rows").over(inside) - F.col("rows"))
        .withColumn("prefix", F.col("bytes_before") + F.sum("bytes").over(inside) - F.col("bytes"))
        .withColumn("shard", F.least(F.lit(shards - 1).cast("decimal(38,0)"), F.floor((2 * F.col("prefix") + F.col("bytes")).cast("decimal(28,0)") * shards / (2 * F.col("total")))).cast("int"))
    )
    opens = placed.groupBy("shard").agg(F.min("first").alias("opens"))
    placed = placed.join(F.broadcast(opens), "shard").select(*key, "shard", (F.col("first") - F.col("opens")).alias("first"))
    along = Window.partitionBy(*key).orderBy("salt").rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.withColumn("earlier", F.sum("n").over(along) - F.col("n")).join(placed, key).select(*key, "salt", "shard", (F.col("first") + F.col("earlier")).alias("first"))
    slot = F.col("first") + F.row_number().over(Window.partitionBy(*key, "salt").orderBy("doc_id", "row")) - 1
    return narrow.join(parts, [*key, "salt"]).select("doc_id", "size", "text_crc32", "shard", slot.cast("long").alias("slot"))

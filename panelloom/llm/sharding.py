"""Contiguous shards of nearly equal bytes, by global prefix sums.

Rows are laid in one order: by a hash of the text, then doc_id, so equal texts lie side by side and a
large group of them still spreads over range partitions. Each partition sums its sizes; the running
total of those few sums is each partition's offset, and a window inside the partition adds the rest.
Shard k takes the rows whose prefix ends in the k-th of equal byte ranges. A group of equal texts that
a cut would split moves whole to the shard of its first row if it is small (``snap`` of a shard);
larger groups are split, for else the shards couldn't be equal.

A null text has no bytes: size 1, CRC 0. Repeated doc_ids and equal rows each get their own slot.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelloom.llm.common import durable


def sharded(docs: DataFrame, shards: int = 16, snap: float = 0.01) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each document."""
    spark = docs.sparkSession
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64(F.coalesce("text", F.lit("")), F.col("text").isNull()).alias("group_key"),
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The numbers of the partitions are part of the written rows: a lost task can't deal them anew.
    laid = durable(slim.repartitionByRange(parts, "group_key", "doc_id").withColumn("part", F.spark_partition_id()))

    sums = laid.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).orderBy("part").collect()  # a row for each partition
    offsets, bytes_, rows = [], 0, 0
    for r in sums:
        offsets.append((r.part, bytes_, rows))
        bytes_, rows = bytes_ + r.bytes, rows + r.n
    target = max(1.0, bytes_ / shards)

    inside = Window.partitionBy("part").orderBy("group_key", "doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offset = spark.createDataFrame(offsets, "part int, bytes_before long, rows_before long")
    placed = laid.join(F.broadcast(offset), "part").select(
        "doc_id",
        "size",
        "text_crc32",
        "group_key",
        (F.col("bytes_before") + F.sum("size").over(inside) - F.col("size")).alias("start"),
        (F.col("rows_before") + F.count("*").over(inside) - 1).alias("place"),
    )
    # The middle of a row decides, so that a row goes where most of it lies.
    by_bytes = F.least(F.floor((F.col("start") + F.col("size") / 2) / target), F.lit(shards - 1)).cast("int")
    placed = placed.withColumn("shard", by_bytes)

    # At most one group lies across each cut: shards - 1 groups in all.
    across = (
        placed.groupBy("group_key")
        .agg(F.min("shard").alias("first_shard"), F.max("shard").alias("last_shard"), F.sum("size").alias("group_size"))
        .filter((F.col("first_shard") < F.col("last_shard")) & (F.col("group_size") <= snap * target))
        .select("group_key", "first_shard")
    )
    placed = placed.join(F.broadcast(across), "group_key", "left").withColumn("shard", F.coalesce("first_shard", "shard"))
    placed = durable(placed.drop("first_shard", "group_key"))
    firsts = placed.groupBy("shard").agg(F.min("place").alias("shard_place"))  # a row for each shard
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - F.col("shard_place")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )

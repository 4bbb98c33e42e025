"""Weighted rendezvous hashing of record keys over shards.

Every shard draws, for each key, a number from the hash of (key, shard); the shard with the least
``-ln(u) / weight`` takes the record. A shard's draw doesn't depend on the other shards, so one more shard takes
records only into itself, and on average only its share of the weight.

Nulls, repeats, ties: a null key is hashed as a missing value and goes to one fixed shard; repeated keys go to the same
shard; equal draws go to the smaller shard. An empty table gives no rows. Only the named columns are read, so other
columns and their names don't matter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteaudit.llm.common import written


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard (0, 1, ...) of a key, for shards of the given positive weights."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    name = F.coalesce(key.cast("string"), F.lit("\0null"))

    def cost(shard: int, weight: float) -> Column:
        h = F.shiftrightunsigned(F.xxhash64(F.concat(name, F.lit(f"#{shard}"))), 11)
        return -F.log((h.cast("double") + 0.5) / F.lit(float(1 << 53))) / F.lit(float(weight))

    return F.array_min(F.array(*[F.struct(cost(i, w).alias("cost"), F.lit(i).alias("shard"))
                                 for i, w in enumerate(weights)]))["shard"]


def numbered(df: DataFrame, name: str) -> DataFrame:
    """Add ``slot``, counting from 0 without gaps within each ``shard``.

    The rows are written to the shared folder once; file and row number there are a fixed order. Ranks are taken within
    (file, shard), which is bounded by the size of a file even if all rows are alike, and shifted by the counts of
    the files before.
    """
    rows = written(df, name).select("*", F.col("_metadata.file_path").alias("_file"),
                                    F.col("_metadata.row_index").alias("_row"))
    counts = rows.groupBy("_file", "shard").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_file", "shard", (F.sum("_n").over(Window.partitionBy("shard").orderBy("_file"))
                                              - F.col("_n")).alias("_before"))
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("_file", "shard").orderBy("_row")))
    return (ranked.join(before, ["_file", "shard"])
            .withColumn("slot", F.col("_before") + F.col("_rank") - 1)
            .drop("_file", "_row", "_rank", "_before"))


def shard_records(df: DataFrame, key: str, weights: Sequence[float], added_weight: float = 1.0) -> DataFrame:
    """``df`` with ``shard``, ``slot`` and ``grown_shard``, the shard if one shard of ``added_weight`` joins."""
    placed = df.withColumns({"shard": rendezvous(F.col(key), weights),
                             "grown_shard": rendezvous(F.col(key), [*weights, added_weight])})
    return numbered(placed, "shards")


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """op5: all documents into ``shards`` equal shards by doc_id. A null text has no bytes: size 1, crc32 0."""
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"),
                         F.crc32(text).alias("text_crc32"), F.lit("key").alias("law"))
    return shard_records(narrow, "doc_id", [1.0] * shards).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")

"""Sharding by weighted rendezvous hashing.

Every record key gets a score on every shard from a hash of (key, shard) and the shard's
weight, and goes to the shard where its score is greatest.  The key and the shards alone
decide, so a further shard only takes records into itself, in proportion to its weight.

A null key counts as the empty key.  Equal keys share a shard.  Null texts have no bytes; very long ones are
only measured and hashed.  Ties of scores go to the lower shard; rows that tie in a shard's order, repeated ones
included, may swap slots.  A column that has the name of the result is replaced; other columns are handed on.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm import common


def shard_of(key: Column, weights: list[float]) -> Column:
    """The shard 0 .. len(weights)-1 of a record key: the greatest -weight / ln(u), ties to the lower shard."""
    name = F.coalesce(key.cast("string"), F.lit(""))

    def score(shard: int, weight: float) -> Column:
        digits = F.substring(F.md5(F.concat(name, F.lit(f":{shard}")).cast("binary")), 1, 12)
        point = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 48)
        return F.struct((F.lit(-float(weight)) / F.log(point)).alias("score"), F.lit(-shard).alias("minus"))

    return -F.array_max(F.array(*[score(i, w) for i, w in enumerate(weights) if w > 0]))["minus"]


def sharded(df: DataFrame, key: str, weights: list[float], out: str = "shard") -> DataFrame:
    """``df`` with the shard of every row, without a shuffle."""
    return df.withColumn(out, shard_of(F.col(key), weights))


def slots(rows: DataFrame, group: str, order: list[str], buckets: int = 1024, out: str = "slot") -> DataFrame:
    """Number the rows of each group from 0 without gaps.

    Equal rows are counted first and unfolded last, so that a key with very many rows is one row
    in between.  The rest is dealt into ``buckets`` hash buckets a group, numbered within and
    shifted by the rows of the buckets before: groups x buckets sums, whatever the data.
    """
    names = rows.columns
    counted = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("__n"))
    dealt = common.cut(counted.withColumn("__bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int")))
    sums = dealt.groupBy(group, "__bucket").agg(F.sum("__n").alias("__sum"))
    before = sums.withColumn("__before", F.sum("__sum").over(W.partitionBy(group).orderBy("__bucket")) - F.col("__sum")).drop("__sum")
    inside = W.partitionBy(group, "__bucket").orderBy(*order)
    placed = dealt.withColumn("__at", F.sum("__n").over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col("__n")).join(before, [group, "__bucket"])
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)).alias("__copy")
    return placed.select(*names, (F.col("__before") + F.col("__at")).alias("__first"), copies).select(*names, (F.col("__first") + F.col("__copy")).alias(out))


def op2_sharding(spark: SparkSession, sf_dir: str, shards: int = 8) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    rows = sharded(sharded(rows, "doc_id", [1.0] * shards), "doc_id", [1.0] * (shards + 1), "grown_shard")
    rows = slots(rows, "shard", ["doc_id", "size", "text_crc32"])
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")

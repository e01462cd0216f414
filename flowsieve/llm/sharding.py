"""Rendezvous hashing of stable record keys over weighted shards.

Every (key, shard) pair gets a uniform number u from a hash; the record goes to the shard with the
smallest ``-ln(u) / weight``. Adding a shard only ever moves records into the new one, and each
shard receives its share of the weights. Expressions only: one scan, no shuffle to place a record.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import shuffle_width

#: Bits of the hash that make up u; u is exact in a double.
HASH_BITS = 52


def _draw(key: Column, shard: int) -> Column:
    """Integer in [0, 2^52) from the key's text and the shard number. A null key counts as ''."""
    text = F.concat_ws(":", F.lit("shard"), F.lit(str(shard)), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("long")


def rendezvous_shard(key: Column, weights: Sequence[float]) -> Column:
    """Shard number 0..len(weights)-1 of a key. Equal scores go to the lower number; weights are positive."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    equal = len(set(weights)) == 1
    scored = []
    for shard, weight in enumerate(weights):
        draw = _draw(key, shard)
        # With equal weights the order of -ln(u) is the reverse order of the integers themselves.
        score = -draw if equal else -F.log((draw + F.lit(0.5)) / F.lit(float(2**HASH_BITS))) / F.lit(float(weight))
        scored.append(F.struct(score.alias("score"), F.lit(shard).alias("shard")))
    return F.array_min(F.array(*scored))["shard"]


def number_within(df: DataFrame, group: str, order_hash: Column, ties: Sequence[Column], out: str) -> DataFrame:
    """Gapless numbers from 0 within each value of ``group``, in order of (order_hash, ties).

    ``order_hash`` is an integer in [0, 2^32). Each group is cut into ranges of the hash, so that a group
    with a third of all rows is still numbered by many tasks; the ranges' counts (at most
    groups x shuffle partitions rows) give every range its first number."""
    parts = shuffle_width(df.sparkSession)
    cut = df.withColumn("__h", order_hash).withColumn("__r", F.floor(F.col("__h") * F.lit(parts) / F.lit(2**32)).cast("int"))
    sizes = cut.groupBy(group, "__r").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(group).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select(F.col(group).alias("__g"), F.col("__r").alias("__gr"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    inside = Window.partitionBy(group, "__r").orderBy("__h", *ties)
    numbered = cut.withColumn("__k", F.row_number().over(inside) - 1)
    joined = numbered.join(first, numbered[group].eqNullSafe(first["__g"]) & (numbered["__r"] == first["__gr"]))
    return joined.withColumn(out, (F.col("__k") + F.col("__first")).cast("long")).drop("__h", "__r", "__n", "__k", "__g", "__gr", "__first")


def shard_documents(docs: DataFrame, weights: Sequence[float], grown: Sequence[float] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, size (UTF-8 bytes of the text plus 8), text_crc32, shard, slot and grown_shard.

    ``grown`` are the weights after a change (default: one more shard of the first weight). Null text: empty, size 8.
    Null keys all go to the shard of the empty key. Repeated rows share a shard and get a slot each.
    Other columns of ``docs`` are not read; an empty table gives an empty result."""
    grown = [*weights, weights[0]] if grown is None else grown
    body = F.coalesce(F.col(text), F.lit(""))
    placed = docs.select(
        F.col(key),
        (F.octet_length(body) + 8).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous_shard(F.col(key), weights).alias("shard"),
        rendezvous_shard(F.col(key), grown).alias("grown_shard"),
    )
    order = F.conv(F.substring(F.md5(F.concat(F.lit("slot:"), F.coalesce(F.col(key).cast("string"), F.lit("")))), 1, 8), 16, 10).cast("long")
    return number_within(placed, "shard", order, [F.col(key), F.col("text_crc32"), F.col("size")], "slot")

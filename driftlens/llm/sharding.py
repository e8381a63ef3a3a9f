"""Sharding by rendezvous hashing over weighted shards, in built-in functions only.

Each shard draws a value from a hash of (key, shard); the record goes to the shard with the largest
``weight / -ln(u)``. A shard's value does not depend on the other shards, so a new shard takes records only into
itself and a removed one gives away only its own.

Defined results: a null key is a key of its own; equal keys share a shard; a null text has no bytes (size 1, checksum
0); rows that agree in key, checksum and size are interchangeable and get successive slots; an empty table gives an
empty result; only the key and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELLS_PER_SHARD = 512


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a key; shards are numbered from 0 and weigh ``weights``."""
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a positive weight")
    name = F.coalesce(key.cast("string"), F.lit("\0null"))

    def draw(shard: int, weight: float) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(name, F.lit(shard)), 11)
        u = (bits.cast("double") + 0.5) / float(1 << 53)  # strictly between 0 and 1
        return F.struct((F.lit(float(weight)) / -F.log(u)).alias("value"), F.lit(-shard).alias("shard"))

    draws = [draw(i, w) for i, w in enumerate(weights)]
    best = reduce(F.greatest, draws)
    return (-best["shard"]).cast("int")


def cell_of(key: Column, cells: int) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(key.cast("string"), F.lit("\0null")), F.lit("cell")), F.lit(cells)).cast("int")


def shard(
    docs: DataFrame,
    weights: Sequence[float] = (1.0,) * 8,
    grown_weights: Sequence[float] | None = None,
    key: str = "doc_id",
    text: str = "text",
    cells: int = CELLS_PER_SHARD,
) -> DataFrame:
    """key, size, checksum, shard, slot in the shard, and the shard after one more shard joins.

    Slots are gapless per shard without ordering a whole shard in one task: rows are numbered within (shard, cell of
    the key), and each cell starts where the cells before it end. A key with very many rows is spread by checksum.
    The table of cell sizes has at most ``len(weights) * cells`` rows.
    """
    grown_weights = list(weights) + [1.0] if grown_weights is None else list(grown_weights)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(key).alias("key"),
        (F.octet_length(body) + F.lit(1)).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
    ).select(
        "*",
        rendezvous(F.col("key"), weights).alias("shard"),
        rendezvous(F.col("key"), grown_weights).alias("grown_shard"),
        cell_of(F.concat_ws("\0", F.col("key"), F.col("text_crc32")), cells).alias("cell"),
    )
    counts = rows.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "cell").orderBy("key", "text_crc32", "size")
    return (
        rows.withColumn("place", F.row_number().over(inside) - 1)
        .join(starts, ["shard", "cell"])
        .select(
            F.col("key").alias(key),
            "size",
            "text_crc32",
            F.lit("key").alias("law"),
            "shard",
            (F.col("start") + F.col("place")).cast("long").alias("slot"),
            "grown_shard",
        )
    )

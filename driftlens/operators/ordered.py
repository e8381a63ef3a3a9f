"""Running totals and previous values over long ordered sequences.

A window without a partition key, or with one hot key, would put the whole sequence into one task. Here the rows
are range-partitioned into even chunks in order; each chunk is worked on by itself, and one small row per chunk
(and group) carries the state over the chunk borders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import stage


def in_chunks(df: DataFrame, order: list[str], chunks: int | None = None) -> DataFrame:
    """Rows with the number of their range partition. The order must be total, or ties share a chunk.

    Written once: range bounds are sampled, and both passes over the chunks must see the same ones. Without a number
    the session's shuffle partitions are used, merged where they turn out small.
    """
    ranged = df.repartitionByRange(chunks, *order) if chunks else df.repartitionByRange(*order)
    placed = ranged.withColumn("chunk", F.spark_partition_id())
    return stage(placed, "chunks")


def _carried(chunks: DataFrame, per_chunk: DataFrame, group: list[str]) -> DataFrame:
    """Attach one row per (group, chunk) to the rows of that chunk."""
    keys = [*group, "chunk"]
    renamed = per_chunk.withColumnsRenamed({k: f"__{k}" for k in keys})
    condition = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return chunks.join(renamed, condition, "left").drop(*[f"__{k}" for k in keys])


def running_totals(
    df: DataFrame,
    order: list[str],
    totals: dict[str, Column],
    group: list[str] | None = None,
    chunks: int | None = None,
) -> DataFrame:
    """Add a running sum per entry of ``totals`` (name -> summed expression), inclusive of the row itself."""
    group = group or []
    names = list(totals)
    placed = in_chunks(df.withColumns({f"__{n}": c for n, c in totals.items()}), [*group, *order], chunks)
    so_far = Window.partitionBy(*group, "chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*group).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    per_chunk = (
        placed.groupBy(*group, "chunk")
        .agg(*[F.sum(f"__{n}").alias(n) for n in names])
        .select(*group, "chunk", *[F.sum(n).over(earlier).alias(f"__before_{n}") for n in names])
    )
    local = placed.withColumns({f"__local_{n}": F.sum(f"__{n}").over(so_far) for n in names})
    return _carried(local, per_chunk, group).select(
        *df.columns,
        *[(F.coalesce(f"__before_{n}", F.lit(0)) + F.col(f"__local_{n}")).alias(n) for n in names],
    )


def places(df: DataFrame, order: list[str], name: str, group: list[str], chunks: int | None = None) -> DataFrame:
    """Add each row's place inside its group, from 0. Rows are exchanged and sorted once; rows of equal order come in any order.

    A sorted chunk numbers its rows as it is written; one small row per (group, chunk) says by how much to move them.
    """
    keys = [*group, *order]
    ranged = df.repartitionByRange(chunks, *keys) if chunks else df.repartitionByRange(*keys)
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = stage(ranged.sortWithinPartitions(*keys).select("*", F.spark_partition_id().alias("chunk"), at.alias("__at")), "chunks")
    earlier = Window.partitionBy(*group).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    per_chunk = placed.groupBy(*group, "chunk").agg(F.min("__at").alias("first"), F.count(F.lit(1)).alias("n"))
    shift = (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("__shift")
    moved = _carried(placed, stage(per_chunk.select(*group, "chunk", shift), "shifts"), group)
    return moved.select(*df.columns, (F.col("__at") + F.col("__shift")).alias(name))


def previous_value(
    df: DataFrame, group: list[str], order: list[str], value: str, name: str, chunks: int | None = None
) -> DataFrame:
    """Add the previous row's ``value`` within the group; ``value`` must not be null."""
    placed = in_chunks(df, [*group, *order], chunks)
    inside = Window.partitionBy(*group, "chunk").orderBy(*order)
    last = placed.groupBy(*group, "chunk").agg(F.max_by(value, F.struct(*order)).alias("__last"))
    across = Window.partitionBy(*group).orderBy("chunk")
    carried = last.select(*group, "chunk", F.lag("__last").over(across).alias("__carried"))
    local = placed.withColumn("__local", F.lag(value).over(inside))
    return _carried(local, carried, group).select(
        *df.columns, F.coalesce("__local", "__carried").alias(name)
    )

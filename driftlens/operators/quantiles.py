"""Exact quantiles without sorting the table.

A sketch brackets each wanted quantile, one counting pass finds the bracket that really holds the wanted rank
(exact whatever the quality of the sketch), and only the rows of that bracket are ranked. With the default
accuracy a bracket holds a few ten-thousandths of the rows, already collapsed to (value, count).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..staging import stage


def _bracket(x: Column, bounds: Column, size: int) -> Column:
    """Index of the bracket a value falls in: the number of bounds below it."""
    result = F.lit(0)
    for i in range(size):
        result = result + F.when(x > F.element_at(bounds, i + 1), 1).otherwise(0)
    return result


def _join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join that lets null keys meet; the right side is small enough for Spark to see that by itself."""
    renamed = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    condition = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return left.join(renamed, condition).drop(*[f"__{k}" for k in keys])


def exact_quantiles(
    df: DataFrame,
    keys: list[str],
    columns: list[str],
    percents: tuple[int, ...] = K.QUANTILE_PERCENTS,
    accuracy: int = 10_000,
) -> DataFrame:
    """Discrete quantiles per group and numeric column: the value at rank ceil(n * percent / 100).

    Returns (keys, column_name, percent, quantile). Nulls are ignored.
    """
    margin = 2.0 / accuracy
    points = sorted({min(1.0, max(0.0, p / 100 + s * margin)) for p in percents for s in (-1, 1)})
    long = df.select(*keys, *[F.col(f"`{c}`").cast("double").alias(c) for c in columns]).unpivot(
        list(keys), list(columns), "column_name", "x"
    )
    long = long.where("x is not null")
    group = [*keys, "column_name"]
    sketch = stage(
        long.groupBy(*group).agg(F.percentile_approx("x", points, accuracy).alias("bounds")), "quantile-bounds"
    )
    placed = _join(long, sketch, group).select(
        *group, "x", _bracket(F.col("x"), F.col("bounds"), len(points)).alias("bracket")
    )
    counts = placed.groupBy(*group, "bracket").agg(F.count(F.lit(1)).alias("cnt"))
    in_order = Window.partitionBy(*group).orderBy("bracket")
    cumulative = counts.withColumn(
        "before", F.sum("cnt").over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("cnt")
    ).withColumn("total", F.sum("cnt").over(Window.partitionBy(*group)))
    wanted = (
        cumulative.withColumn("percent", F.explode(F.array(*[F.lit(p) for p in percents])))
        .withColumn("rank", F.greatest(F.lit(1), F.expr("(total * percent + 99) div 100")))
        .where("rank > before and rank <= before + cnt")
        .select(*group, "bracket", "percent", (F.col("rank") - F.col("before")).alias("rank_inside"))
    )
    wanted = stage(wanted, "quantile-ranks")
    inside = [*group, "bracket"]
    hits = _join(placed, wanted.select(*inside).distinct(), inside)
    values = hits.groupBy(*inside, "x").agg(F.count(F.lit(1)).alias("cnt"))
    up_to = Window.partitionBy(*inside).orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = values.withColumn("upto", F.sum("cnt").over(up_to))
    matches = _join(running, wanted, inside).where("rank_inside > upto - cnt and rank_inside <= upto")
    return matches.select(*group, "percent", F.col("x").alias("quantile"))

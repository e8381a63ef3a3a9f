"""Joins that keep a hot key off a single task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS_PER_SALT = 100_000
SALT = "__salt"


def salted_join(
    large: DataFrame, small: DataFrame, keys: list[str], spread_by: list[str], how: str = "inner", rows_per_salt: int = ROWS_PER_SALT
) -> DataFrame:
    """Join on ``keys`` with every hot key of ``large`` spread in proportion to its rows.

    Rows per key are counted first. A key with more than ``rows_per_salt`` rows is dealt to so many salts by a hash of
    ``spread_by``, which is stable under retries, and its row of ``small`` is copied that often; all other keys have one
    salt and are joined plainly. The hot keys are fewer than the rows divided by ``rows_per_salt``. ``small`` has one row
    per key. The salt stays in the result, so that a grouping by (keys, salt) can follow without another shuffle of the
    large side; drop it when it is not needed.
    """
    renamed = [F.col(k).alias(f"__hot_{k}") for k in keys]
    counted = large.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows")).where(F.col("__rows") > rows_per_salt)
    hot = counted.select(*renamed, F.ceil(F.col("__rows") / rows_per_salt).cast("int").alias("__spread"))

    def spread(rows: DataFrame) -> DataFrame:
        joined = rows.join(hot, [F.col(k) == F.col(f"__hot_{k}") for k in keys], "left")
        return joined.withColumn("__spread", F.coalesce("__spread", F.lit(1))).drop(*[f"__hot_{k}" for k in keys])

    dealt = spread(large).withColumn(SALT, F.pmod(F.xxhash64(*spread_by), F.col("__spread")).cast("int")).drop("__spread")
    copies = spread(small).withColumn(SALT, F.explode(F.sequence(F.lit(0), F.col("__spread") - 1))).drop("__spread")
    return dealt.join(copies, [*keys, SALT], how)

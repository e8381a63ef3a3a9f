"""Output of streaming steps: one folder per event-time window, replaced when a micro-batch changes the window."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FOLDER = "window_us"


def replace_windows(rows: DataFrame, path: str, time_column: str) -> None:
    """Write ``rows``, which hold whole windows; other windows keep their files, and a replay leaves the same ones."""
    placed = rows.withColumn(_FOLDER, F.unix_micros(F.col(time_column).cast("timestamp")))
    writer = placed.repartition(_FOLDER).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(_FOLDER).parquet(path)


def read_windows(spark: SparkSession, path: str, schema: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """The windows written under ``path``, by their starts in microseconds; empty when there is none yet."""
    try:
        rows = spark.read.schema(f"{schema}, {_FOLDER} bigint").parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    if first is not None:
        rows = rows.where(F.col(_FOLDER) >= first)
    if last is not None:
        rows = rows.where(F.col(_FOLDER) <= last)
    return rows.drop(_FOLDER)


def windows_around(spark: SparkSession, path: str, schema: str, first: int, last: int, n: int) -> tuple[int, int]:
    """Starts of the ``n``-th window before ``first`` and after ``last``, or of the outermost ones; only folders are read."""
    starts = spark.read.schema(f"{schema}, {_FOLDER} bigint").parquet(path).select(_FOLDER).distinct()
    before = starts.where(F.col(_FOLDER) <= first).orderBy(F.desc(_FOLDER)).limit(n + 1).agg(F.min(_FOLDER)).first()[0]
    after = starts.where(F.col(_FOLDER) >= last).orderBy(_FOLDER).limit(n + 1).agg(F.max(_FOLDER)).first()[0]
    return before, after

"""Per-key state that Spark holds: one small state a key, read and written only where a micro-batch has rows of the key.

Moments travel as microseconds since the epoch, which are exact and free of time zones. What a step emits is appended to
Parquet by Spark's own file sink, so that a restart neither loses nor repeats a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from ..shipping import ship


def micros(moment: str) -> Column:
    return F.unix_micros(F.col(moment).cast("timestamp"))


def moment(value: str) -> Column:
    return F.timestamp_micros(value)


def gathered(frames: Iterable[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    """The rows of one key in one micro-batch, in order. A trigger's limits on files or bytes bound them."""
    rows = pd.concat(list(frames), ignore_index=True)
    return rows.iloc[np.lexsort([rows[c].to_numpy() for c in reversed(order)])]


def stepped(rows: DataFrame, keys: list[str], step: Callable, emitted: str, state: str, timeout: str = GroupStateTimeout.NoTimeout) -> DataFrame:
    """What ``step(key, frames, state)`` emits for every key that has rows, or whose timer rings."""
    ship(rows.sparkSession)
    return rows.groupBy(*keys).applyInPandasWithState(step, emitted, state, "append", timeout)


def append_to(rows: DataFrame, root: str, name: str, available_now: bool) -> StreamingQuery:
    """Append to ``root/name``; progress is kept in ``root/checkpoint-name``."""
    writer = (
        rows.writeStream.format("parquet")
        .outputMode("append")
        .option("path", f"{root}/{name}")
        .option("checkpointLocation", f"{root}/checkpoint-{name}")
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_appended(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """What has been appended so far; empty when no micro-batch has ended yet."""
    try:
        return spark.read.schema(schema).parquet(f"{root}/{name}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def stream_appended(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """The appended rows as a stream of their own."""
    return spark.readStream.schema(schema).parquet(f"{root}/{name}")

"""Arrow functions on Spark's Python workers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from driftlens.shipping import ship


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` whose function the workers can import."""
    ship(df.sparkSession)
    return df.mapInArrow(f, schema)

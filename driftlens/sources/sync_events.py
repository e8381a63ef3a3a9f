"""Sync-completed events, batch or streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K

EVENT_SCHEMA = "event string, connector_id string, `schema` string, `table` string, received_at timestamp"


def read_sync_events(spark: SparkSession, path: str) -> DataFrame:
    return sync_events(spark.read.schema(EVENT_SCHEMA).json(path))


def stream_sync_events(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    reader = spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", max_files)
    return sync_events(reader.json(path))


def sync_events(
    raw: DataFrame, default_schema: str = K.DEFAULT_SCHEMA, default_table: str = K.DEFAULT_TABLE
) -> DataFrame:
    """Events with defaults filled in; ``status`` says which ones start a check and which are ignored."""
    return raw.select(
        "event",
        "connector_id",
        F.coalesce("schema", F.lit(default_schema)).alias("dataset_id"),
        F.coalesce("table", F.lit(default_table)).alias("table_name"),
        *[c for c in raw.columns if c not in ("event", "connector_id", "schema", "table")],
        F.when(F.col("event") == K.SYNC_END, "accepted").otherwise("ignored").alias("status"),
    )


def accepted(events: DataFrame) -> DataFrame:
    return events.where(F.col("status") == "accepted").drop("status")


def fan_out(syncs: DataFrame, watched: DataFrame) -> DataFrame:
    """Every detected sync triggers a check of every watched table.

    ``watched`` is the configured watch list. It is read once, as a scalar subquery, and each sync is copied per
    watched table in place: nothing is shuffled.
    """
    targets = watched.agg(F.collect_list(F.struct("dataset_id", "table_name"))).scalar()
    return syncs.withColumn("target", F.explode(targets)).select(*syncs.columns, "target.*")

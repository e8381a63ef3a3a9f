"""Streaming drift check: event-time windows are the syncs, each one compared with the windows before it.

The stream keeps one state of bounded size per (window, column): counters, moments and a sketch of frequent values, all
combined on the map side. Every micro-batch replaces the stored states of the windows it changed; the check then rebuilds
the affected windows' fingerprints and compares them with the batch operators. A window's partition is replaced as a
whole, so that a replayed batch leaves the same files and nothing piles up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import constants as K
from ..functions import live_rows, value_key
from ..operators.drift import compare, drift_log, rolling_members
from ..operators.selection import CATEGORICAL, ProfiledColumn, profiled_columns
from ..operators.sketches import TRACKED_VALUES
from .batches import read_windows, replace_windows, windows_around

_GROUP = (
    "sync timestamp, position int, name string, data_type string, kind string, cnt bigint, filled bigint, mean double, "
    "stddev double, top array<struct<value:string,cnt:bigint>>"
)
_LOG = (
    "logged_at timestamp, psi double, column_name string, dataset_id string, table_name string, "
    "is_anomalous boolean, report_id string"
)


def _cell(column: ProfiledColumn) -> Column:
    c = F.col(f"`{column.name}`")
    categorical = column.kind == CATEGORICAL
    return F.struct(
        F.lit(column.position).alias("position"),
        F.lit(column.name).alias("name"),
        F.lit(column.data_type.simpleString()).alias("data_type"),
        F.lit(column.kind).alias("kind"),
        (value_key(c, column.data_type) if categorical else F.lit(None).cast("string")).alias("value"),
        (F.lit(None).cast("double") if categorical else c.cast("double")).alias("x"),
        c.isNotNull().alias("filled"),
    )


def window_groups(
    stream: DataFrame, time_column: str, window: str, lateness: str, profile_columns: list[str] | None = None,
    tracked_values: int = TRACKED_VALUES,
) -> DataFrame:
    """One row per (window, column), with its counters, its moments and its most frequent values.

    Values are exact while a window's column has fewer than three quarters of ``tracked_values`` of them, and within the
    sketch's bound beyond (see ``operators.sketches``). Deleted rows are left out as in a batch profile; rows with an
    unknown flag are counted.
    """
    columns = profiled_columns(stream.schema, profile_columns)
    if K.DELETED_FLAG in stream.columns:
        stream = stream.where(live_rows(F.col(K.DELETED_FLAG)))
    # the watermark needs an instant, which a zone-less timestamp is not
    timed = stream.withColumn("__at", F.col(time_column).cast("timestamp")).withWatermark("__at", lateness)
    cells = timed.select("__at", F.explode(F.array(*[_cell(c) for c in columns])).alias("cell"))
    frequent = F.call_function(
        "approx_top_k_estimate", F.call_function("approx_top_k_accumulate", "cell.value", F.lit(tracked_values)), F.lit(tracked_values)
    )
    return (
        cells.groupBy(
            F.window("__at", window).alias("window"),
            *[F.col(f"cell.{f}").alias(f) for f in ("position", "name", "data_type", "kind")],
        )
        .agg(
            F.count(F.lit(1)).alias("cnt"),
            F.count_if(F.col("cell.filled")).alias("filled"),
            F.avg("cell.x").alias("mean"),
            F.stddev_samp("cell.x").alias("stddev"),
            F.transform(frequent, lambda e: F.struct(e["item"].alias("value"), e["count"].alias("cnt"))).alias("top"),
        )
        .withColumn("sync", F.col("window.start"))
        .drop("window")
    )


def fingerprints_of_groups(groups: DataFrame, dataset_id: str, table_name: str, kept_values: int = K.TOP_VALUES) -> DataFrame:
    """Fingerprints (as far as a comparison needs them) from the states of each window."""
    best = F.slice(F.array_sort(F.transform("top", lambda e: F.struct((-e["cnt"]).alias("least"), e["value"].alias("value")))), 1, kept_values)
    share = F.transform(best, lambda e: F.struct(e["value"].alias("key"), (-e["least"] / F.col("cnt")).alias("value")))
    cell = F.struct(
        "position",
        "name",
        "data_type",
        F.round(1 - F.col("filled") / F.col("cnt"), 6).alias("null_pct"),
        "mean",
        "stddev",
        F.map_from_entries(F.when(F.col("kind") == CATEGORICAL, share).otherwise(F.slice(share, 1, 0))).alias("distribution"),
    )
    identity = F.concat_ws("|", F.lit(dataset_id), F.lit(table_name), F.col("sync").cast("string"))
    return (
        groups.groupBy("sync")
        .agg(F.max("cnt").alias("row_count"), F.collect_list(cell).alias("columns"))
        .select(
            F.left(F.sha2(identity, 256), F.lit(32)).alias("fingerprint_id"),
            F.col("sync").alias("computed_at"),
            F.lit(False).alias("is_synthetic"),
            F.lit("stream").alias("connection_id"),
            F.lit("local").alias("project_id"),
            F.lit(dataset_id).alias("dataset_id"),
            F.lit(table_name).alias("table_name"),
            "row_count",
            F.lit("").alias("schema_hash"),
            "columns",
        )
    )


def check_stream(
    stream: DataFrame,
    root: str,
    dataset_id: str,
    table_name: str,
    time_column: str,
    *,
    window: str = "1 day",
    lateness: str = "2 days",
    profile_columns: list[str] | None = None,
    n: int = K.BASELINE_SYNCS,
    kept_values: int = K.TOP_VALUES,
    tracked_values: int = TRACKED_VALUES,
    available_now: bool = False,
) -> StreamingQuery:
    """Check every window as it fills; the drift log is written to ``root/log``.

    A window that changes also changes the baseline of the ``n`` windows after it, so these are checked again, and their
    log entries replaced.
    """
    groups = window_groups(stream, time_column, window, lateness, profile_columns, tracked_values)

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        spark, path = batch.sparkSession, f"{root}/groups"
        batch.persist()  # a row per window and column, read twice
        try:
            start = F.unix_micros("sync")
            span = batch.agg(F.min(start).alias("first"), F.max(start).alias("last")).first()
            if span["first"] is None:
                return
            replace_windows(batch, path, "sync")
        finally:
            batch.unpersist()
        # only the partitions of the affected windows, their baselines and their successors are read
        near = read_windows(spark, path, _GROUP, *windows_around(spark, path, _GROUP, span["first"], span["last"], n))
        members = rolling_members(fingerprints_of_groups(near, dataset_id, table_name, kept_values), n)
        checked = drift_log(compare(members)).where(F.unix_micros("logged_at") >= span["first"])
        replace_windows(checked, f"{root}/log", "logged_at")

    writer = (
        groups.writeStream.outputMode("update")
        .foreachBatch(on_batch)
        .option("checkpointLocation", f"{root}/checkpoint")
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def current_log(spark: SparkSession, root: str) -> DataFrame:
    """The log entry of every window."""
    return read_windows(spark, f"{root}/log", _LOG)

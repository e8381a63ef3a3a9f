"""Checks triggered by a stream of sync events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.profile import Load
from ..plans.sync_check import SyncCheck, check_syncs
from ..sources.sync_events import accepted

Loader = Callable[[SparkSession], Load]


def check_on_sync(
    events: DataFrame,
    loaders: dict[tuple[str, str], Loader],
    history_path: str,
    log_path: str,
    checkpoint: str,
    on_check: Callable[[SyncCheck], None] | None = None,
    nodes: DataFrame | None = None,
    incident_path: str | None = None,
    keep: bool = True,
    available_now: bool = False,
) -> StreamingQuery:
    """Profile and compare every watched table a completed sync names.

    ``events`` comes from ``sources.sync_events``; ``loaders`` maps (dataset, table) of the watch list to what is to be
    profiled. Tables synced in the same micro-batch are checked in one plan, and the log takes each check once. The new
    fingerprints join the history unless ``keep`` is off; with ``nodes`` each check is traced downstream.
    """

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        synced = accepted(batch).select("dataset_id", "table_name").distinct()
        watched = batch.sparkSession.createDataFrame(list(loaders), "dataset_id string, table_name string")
        # at most one row per watched table
        due = synced.join(watched, ["dataset_id", "table_name"], "left_semi").collect()
        if due:
            loads = [loaders[(row.dataset_id, row.table_name)](batch.sparkSession) for row in due]
            result = check_syncs(batch.sparkSession, loads, history_path, log_path, nodes, keep, incident_path)
            if on_check:
                on_check(result)

    writer = events.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()

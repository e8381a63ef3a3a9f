"""New-sync detection on a stream of connector polls."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from ..functions import not_blank
from .keyed import append_to, gathered, micros, moment, read_appended, stepped

CHANGE = "connector_id string, polled_at timestamp, seq bigint, last_seen string, succeeded_at string"
_EMITTED = "connector_id string, at bigint, seq bigint, last_seen string, succeeded_at string"
_STATE = "at bigint, seq bigint, succeeded_at string"


def _step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Compare each poll with the one before it; the newest poll of the connector is the state."""
    rows = gathered(frames, ["at", "seq"])
    last = None
    if state.exists:
        at, seq, last = state.get
        rows = rows[(rows["at"] > at) | ((rows["at"] == at) & (rows["seq"] > seq))]
    if not len(rows):
        return
    seen = rows["succeeded_at"].shift(1)
    seen.iloc[0] = last
    newest = rows.iloc[-1]
    state.update((int(newest["at"]), int(newest["seq"]), newest["succeeded_at"]))
    changed = seen.notna() & (seen != rows["succeeded_at"])
    yield pd.DataFrame(
        {
            "connector_id": key[0],
            "at": rows["at"][changed],
            "seq": rows["seq"][changed],
            "last_seen": seen[changed],
            "succeeded_at": rows["succeeded_at"][changed],
        }
    )


def sync_changes(polls: DataFrame) -> DataFrame:
    """Polls (connector_id, polled_at, seq, succeeded_at) that show a new sync, as a stream.

    Empty values are skipped, and the first value seen of a connector only sets its baseline. A poll that arrives after
    a later one of its connector has been seen tells nothing new and is passed over; within a micro-batch the polls are
    put in order. Polls without a connector, time or number are passed over too.
    """
    asked = polls.select(
        "connector_id", micros("polled_at").alias("at"), F.col("seq").cast("bigint").alias("seq"),
        not_blank(F.col("succeeded_at")).alias("succeeded_at"),
    ).dropna()
    changes = stepped(asked, ["connector_id"], _step, _EMITTED, _STATE)
    return changes.select("connector_id", moment("at").alias("polled_at"), "seq", "last_seen", "succeeded_at")


def watch_syncs(polls: DataFrame, root: str, available_now: bool = False) -> StreamingQuery:
    """Append every poll that shows a new sync to ``root/changes``."""
    return append_to(sync_changes(polls), root, "changes", available_now)


def detected_changes(spark: SparkSession, root: str) -> DataFrame:
    return read_appended(spark, root, "changes", CHANGE)

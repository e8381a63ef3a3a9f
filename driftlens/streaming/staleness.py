"""Alarms for tables that stopped loading: a timer per table, which rings although no event comes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import constants as K
from .keyed import append_to, gathered, micros, moment, read_appended, stepped

ALARM = "table_name string, alarm string, last_loaded_at timestamp, at timestamp"
STALE, RECOVERED = "stale", "recovered"
_EMITTED = "table_name string, alarm string, last bigint, at bigint"
_STATE = "last bigint, raised boolean"
_SECOND = 1_000_000


def _step(threshold: int) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    def rows(name: str, alarm: str, last, at) -> pd.DataFrame:
        return pd.DataFrame({"table_name": name, "alarm": alarm, "last": last, "at": at})

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last, raised = state.get
            if not raised:
                state.update((last, True))
                yield rows(key[0], STALE, [last], [last + threshold])
            return
        times = np.unique(gathered(frames, ["loaded"])["loaded"].to_numpy())
        raised = False
        if state.exists:
            last, raised = state.get
            times = np.concatenate(([last], times[times > last]))
        before, after = times[:-1], times[1:]
        late = after - before > threshold
        if raised and len(after):
            # the alarm of the first gap has been raised already; any load ends it
            yield rows(key[0], RECOVERED, before[:1], after[:1])
            before, after, late = before[1:], after[1:], late[1:]
            raised = False
        yield rows(key[0], STALE, before[late], before[late] + threshold)
        yield rows(key[0], RECOVERED, before[late], after[late])
        last = int(times[-1])
        due = (last + threshold) // 1000
        if not raised and due <= state.getCurrentWatermarkMs():
            yield rows(key[0], STALE, [last], [last + threshold])
            raised = True
        state.update((last, raised))
        if not raised:
            state.setTimeoutTimestamp(due)

    return step


def staleness_alarms(loads: DataFrame, threshold_seconds: int = K.STALE_AFTER_SECONDS, lateness: str = "10 minutes") -> DataFrame:
    """Alarms of the loads (table_name, loaded_at), as a stream: one ``stale`` row when a table has not loaded for longer
    than the threshold, and one ``recovered`` row at the load that ends it.

    Time is what all tables together have reached, less ``lateness``: while any table loads, the others' timers run. Loads
    that arrive later than that, and loads without a table or time, are passed over. Two values a table are held.
    """
    timed = loads.select("table_name", F.col("loaded_at").cast("timestamp").alias("loaded_at")).dropna()
    keyed = timed.withWatermark("loaded_at", lateness).select("table_name", "loaded_at", micros("loaded_at").alias("loaded"))
    step = _step(threshold_seconds * _SECOND)
    alarms = stepped(keyed, ["table_name"], step, _EMITTED, _STATE, GroupStateTimeout.EventTimeTimeout)
    return alarms.select("table_name", "alarm", moment("last").alias("last_loaded_at"), moment("at").alias("at"))


def watch_staleness(loads: DataFrame, root: str, available_now: bool = False, **how) -> StreamingQuery:
    """Append the alarms to ``root/alarms``."""
    return append_to(staleness_alarms(loads, **how), root, "alarms", available_now)


def raised_alarms(spark: SparkSession, root: str) -> DataFrame:
    return read_appended(spark, root, "alarms", ALARM)


def stale_now(alarms: DataFrame) -> DataFrame:
    """Tables whose newest alarm has not ended."""
    newest = alarms.groupBy("table_name").agg(F.max_by(F.struct("alarm", "last_loaded_at", "at"), F.struct("at", "alarm")).alias("a"))
    return newest.select("table_name", "a.*").where(F.col("alarm") == STALE)

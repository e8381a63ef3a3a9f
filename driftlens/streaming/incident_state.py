"""Incident state kept up to date from a stream of operator actions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from ..functions import constants as K
from ..operators.incidents import APPROVE, DISMISS, REENABLE
from .keyed import append_to, gathered, micros, moment, read_appended, stepped, stream_appended

TRANSITION = (
    "report_id string, opened_at timestamp, state string, decision string, decided_at timestamp, "
    "decided_seq bigint, reenabled_at timestamp, reenabled_seq bigint, step int"
)
_EMITTED = (
    "report_id string, opened bigint, state string, decision string, decided bigint, decided_seq bigint, "
    "reenabled bigint, reenabled_seq bigint, step int"
)
_HELD = ("report_id", "opened", "decision", "decided", "decided_seq", "reenabled", "reenabled_seq")
_STATE = (
    "report_id array<string>, opened array<bigint>, decision array<string>, decided array<bigint>, decided_seq array<bigint>, "
    "reenabled array<bigint>, reenabled_seq array<bigint>"
)
BUCKETS = 16_384


def _step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The first decision counts, and the first re-enabling after an approval; nothing else moves an incident.

    What decided it in an earlier micro-batch came before everything in this one. The incidents of a bucket are worked on
    in one call: a call a key costs Python milliseconds a key.
    """
    held = {(row[0], row[1]): row[2:] for row in zip(*state.get)} if state.exists else {}
    moved: dict[tuple, tuple] = {}
    rows = gathered(frames, ["at", "seq"])
    for name, opened, at, seq, action in zip(*(rows[c].tolist() for c in ("report_id", "opened", "at", "seq", "action"))):
        incident = (name, opened)
        before = moved.get(incident) or held.get(incident)
        if before is None:
            if action != REENABLE:
                moved[incident] = (action, at, seq, None, None)
        elif action == REENABLE and before[0] == APPROVE and before[3] is None:
            if incident not in moved or (at, seq) > before[1:3]:
                moved[incident] = (*before[:3], at, seq)
    if not moved:
        return
    held |= moved
    state.update(tuple(list(column) for column in zip(*((*incident, *values) for incident, values in held.items()))))
    out = pd.DataFrame([(*incident, *values) for incident, values in moved.items()], columns=_HELD)
    out = out.astype({"reenabled": "Int64", "reenabled_seq": "Int64"})
    back = out["reenabled"].notna()
    now = out["decision"].map({APPROVE: K.QUARANTINED, DISMISS: K.DISMISSED}).mask(back, K.REENABLED)
    out.insert(2, "state", now)
    yield out.assign(step=back.astype("int32") + 1)


def transitions(actions: DataFrame, opened: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """State changes of incidents, as a stream, from operator actions (report_id, at, seq, action).

    ``opened`` has one row (report_id, opened_at) per incident and is looked up per micro-batch; actions on incidents that
    are not open, or before they were, are passed over. Spark holds five values for each decided incident and nothing for
    the others. Every change is emitted once, with the state after it.

    Incidents share a state by ``buckets`` of their ids, which is read and written where a micro-batch has rows of the
    bucket. A checkpoint keeps the number it began with; a stream of very many incidents wants more of them.
    """
    known = opened.select("report_id", micros("opened_at").alias("opened"))
    moves = actions.where(F.col("action").isin(APPROVE, DISMISS, REENABLE)).select(
        "report_id", micros("at").alias("at"), F.col("seq").cast("bigint").alias("seq"), "action"
    )
    on_open = moves.dropna().join(known, "report_id").where("at >= opened")
    placed = on_open.withColumn("bucket", F.pmod(F.xxhash64("report_id"), F.lit(buckets)))
    changes = stepped(placed, ["bucket"], _step, _EMITTED, _STATE)
    return changes.select(
        "report_id", moment("opened").alias("opened_at"), "state", "decision", moment("decided").alias("decided_at"),
        "decided_seq", moment("reenabled").alias("reenabled_at"), "reenabled_seq", "step",
    )


def track_incidents(actions: DataFrame, opened: DataFrame, root: str, available_now: bool = False) -> StreamingQuery:
    """Append every state change to ``root/transitions``."""
    return append_to(transitions(actions, opened), root, "transitions", available_now)


def stream_transitions(spark: SparkSession, root: str) -> DataFrame:
    return stream_appended(spark, root, "transitions", TRANSITION)


def current_state(spark: SparkSession, root: str, opened: DataFrame) -> DataFrame:
    """The state of every opened incident after what has arrived so far."""
    fields = [c.strip().split()[0] for c in TRANSITION.split(", ")][2:-1]
    log = read_appended(spark, root, "transitions", TRANSITION)
    newest = log.groupBy("report_id").agg(F.max_by(F.struct(*fields), "step").alias("s"))
    return opened.select("report_id", "opened_at").join(newest.select("report_id", "s.*"), "report_id", "left").withColumn(
        "state", F.coalesce("state", F.lit(K.PENDING))
    )

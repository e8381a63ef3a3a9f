"""Sync detection and incident state, in batch.

Incident events have (report_id, at, seq, action); ``seq`` makes the order total. An incident is open from its
``opened_at`` on. The life cycle only ever moves forward, so each state change is the *first* fitting event, which a
grouped minimum finds with map-side combining: no event list of a busy incident is ever gathered.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import not_blank, seconds_between
from ..sources.history import between_dates
from .ordered import previous_value
from .skew import SALT, salted_join

# The actions an operator can take.
APPROVE, DISMISS, REENABLE, INVESTIGATE = "approve", "dismiss", "reenable", "investigate"
# how an incident enters the log; it decides nothing
OPEN = "open"


def new_syncs(polls: DataFrame) -> DataFrame:
    """Polls (connector_id, polled_at, seq, succeeded_at) at which a connector shows a new sync.

    Empty values are skipped, and the first value seen only sets the baseline.
    """
    seen = polls.withColumn("succeeded_at", not_blank(F.col("succeeded_at"))).where("succeeded_at is not null")
    with_last = previous_value(seen, ["connector_id"], ["polled_at", "seq"], "succeeded_at", "last_seen")
    return with_last.where("last_seen is not null and last_seen <> succeeded_at")


def decisions(opened: DataFrame, events: DataFrame, order: tuple[str, ...] = ("at", "seq")) -> DataFrame:
    """State of every opened incident: what decided it and when, and when it was re-enabled.

    ``opened`` has one row (report_id, opened_at) per incident; ``order`` names the columns events are ordered by.
    """
    moment = F.struct(*order)
    # a busy incident may own most of the log: its events are spread by salt, reduced there, and combined
    after_opening = salted_join(events, opened, ["report_id"], ["seq"]).where(F.col("at") >= F.col("opened_at"))

    def first_of(rows: DataFrame, name: str) -> DataFrame:
        event = F.struct("at", "seq", "action", moment.alias("moment"))
        per_salt = rows.groupBy("report_id", SALT).agg(F.min_by(event, moment).alias(name))
        return per_salt.groupBy("report_id").agg(F.min_by(name, f"{name}.moment").alias(name))

    first = first_of(after_opening.where(F.col("action").isin(APPROVE, DISMISS)), "decision")
    approved = first.where(F.col("decision.action") == APPROVE).select(
        "report_id", F.col("decision.moment").alias("approval")
    )
    returns = salted_join(events.where(F.col("action") == REENABLE), approved, ["report_id"], ["seq"])
    back = first_of(returns.where(moment > F.col("approval")), "reenabling")
    state = (
        F.when(F.col("reenabling").isNotNull(), K.REENABLED)
        .when(F.col("decision.action") == APPROVE, K.QUARANTINED)
        .when(F.col("decision.action") == DISMISS, K.DISMISSED)
        .otherwise(K.PENDING)
    )
    return (
        opened.join(first, "report_id", "left")
        .join(back, "report_id", "left")
        .select(
            "report_id",
            "opened_at",
            state.alias("state"),
            F.col("decision.action").alias("decision"),
            F.col("decision.at").alias("decided_at"),
            F.col("decision.seq").alias("decided_seq"),
            F.col("reenabling.at").alias("reenabled_at"),
            F.col("reenabling.seq").alias("reenabled_seq"),
        )
    )


def event_outcomes(decided: DataFrame, events: DataFrame) -> DataFrame:
    """What each event led to: the state change it caused, or its rejection."""
    joined = salted_join(events, decided.drop("decision"), ["report_id"], ["seq"], "left")
    decides = F.col("seq").eqNullSafe(F.col("decided_seq")) & F.col("at").eqNullSafe(F.col("decided_at"))
    restores = F.col("seq").eqNullSafe(F.col("reenabled_seq")) & F.col("at").eqNullSafe(F.col("reenabled_at"))
    action = F.col("action")
    outcome = (
        F.when((action == APPROVE) & decides, "executed")
        .when((action == DISMISS) & decides, "dismissed")
        .when((action == REENABLE) & restores, "reenabled")
        .when(action == INVESTIGATE, "flagged_for_investigation")
        .when(action.isin(APPROVE, DISMISS, REENABLE), "rejected")
        .otherwise("unknown_action")
    )
    return joined.select("report_id", "at", "seq", "action", outcome.alias("outcome"))


# what tells one event of the log from another
EVENT_KEY = ["report_id", "at", "seq", "action"]


def append_events(events: DataFrame, path: str) -> None:
    """Append to the incident event log (the audit trail) what it does not hold yet: a repeated batch adds nothing.

    Only the key columns are looked up, and only on the days between the first and the last new event.
    """
    fresh = events.withColumn("event_date", F.to_date("at")).dropDuplicates(EVENT_KEY)
    try:
        stored = between_dates(events.sparkSession.read.parquet(path).select(*EVENT_KEY, "event_date"), fresh, "event_date")
        present = stored.select(*[F.col(c).alias(f"stored_{c}") for c in EVENT_KEY])
        same = [F.col(c).eqNullSafe(F.col(f"stored_{c}")) for c in EVENT_KEY]
        fresh = fresh.join(present, same, "left_anti")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    fresh.write.mode("append").partitionBy("event_date").parquet(path)


def check_merges(requested: DataFrame, decided: DataFrame, merges: DataFrame) -> DataFrame:
    """Status of the fix of every requested incident.

    ``merges`` has (report_id, pr_number, pr_state, merged, merged_at, pr_url), one row per incident with a fix. Only
    quarantined incidents count; a merged fix re-enables the table.
    """
    held = decided.where(F.col("state") == K.QUARANTINED).select("report_id", "opened_at", F.lit(True).alias("held"))
    status = (
        F.when(F.col("held").isNull(), "not_found")
        .when(F.col("pr_number").isNull(), "no_pr")
        .when(F.col("merged"), "reenabled")
        .otherwise("pr_open")
    )
    held_only = F.col("held").isNotNull()
    return (
        requested.select("report_id")
        .join(held, "report_id", "left")
        .join(merges, "report_id", "left")
        .select(
            "report_id",
            status.alias("status"),
            F.when(held_only, F.col("pr_number")).alias("pr_number"),
            F.when(held_only, F.col("pr_state")).alias("pr_state"),
            F.when(held_only, F.col("pr_url")).alias("pr_url"),
            F.when(held_only & F.col("merged"), F.col("merged_at")).alias("pr_merged_at"),
        )
    )


def merge_events(checked: DataFrame, first_seq: int = 0) -> DataFrame:
    """Re-enable events for the log, one per merged fix."""
    merged = checked.where("status = 'reenabled'")
    return merged.select(
        "report_id",
        F.col("pr_merged_at").alias("at"),
        F.lit(first_seq).cast("bigint").alias("seq"),
        F.lit(REENABLE).alias("action"),
    )


def quarantined(decided: DataFrame, merges: DataFrame) -> DataFrame:
    """Quarantined incidents with their fix."""
    held = decided.where(F.col("state") == K.QUARANTINED).select("report_id", "opened_at", "decided_at")
    return held.join(merges.select("report_id", "pr_number", "pr_url"), "report_id", "left")


def resolution_times(decided: DataFrame) -> DataFrame:
    """How long each closed loop took, in seconds and as minutes and seconds."""
    seconds = F.floor(seconds_between(F.col("reenabled_at"), F.col("opened_at")))
    closed = decided.where(F.col("state") == K.REENABLED).withColumn("elapsed_seconds", seconds)
    minutes = F.expr("elapsed_seconds div 60")
    rest = F.col("elapsed_seconds") % 60
    text = F.when(minutes > 0, F.format_string("%dm %ds", minutes, rest)).otherwise(F.format_string("%ds", rest))
    return closed.select("report_id", "opened_at", "reenabled_at", "elapsed_seconds", text.alias("elapsed"))

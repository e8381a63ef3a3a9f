"""Quarantined incidents joined to the merges of their fixes, both as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import constants as K
from ..functions import seconds_between
from .incident_state import current_state
from .keyed import append_to, read_appended

CLOSING = (
    "report_id string, opened_at timestamp, decided_at timestamp, pr_number bigint, pr_url string, merged_at timestamp, "
    "status string, closed_at timestamp, elapsed_seconds bigint"
)
NEVER_MERGED = "never_merged"


def closings(changes: DataFrame, merges: DataFrame, horizon: str = "30 days", lateness: str = "1 day") -> DataFrame:
    """One row per quarantined incident: closed by its merged fix, or given up on.

    ``changes`` is the stream of state changes (see ``incident_state``), ``merges`` a stream of (report_id, pr_number,
    merged, merged_at, pr_url). A merge belongs to an incident when it lies within ``horizon`` of the approval, before or
    after it; the incident closes at the later of both. An incident is given up on when the watermark, ``lateness`` behind
    the slower of the two streams, shows that no such merge can arrive any more. Both sides leave the state by then: what
    Spark holds is bounded by what happens within twice the horizon.
    """
    held = (
        changes.where(F.col("state") == K.QUARANTINED)
        .select("report_id", "opened_at", "decided_at")
        .withWatermark("decided_at", lateness)
    )
    done = (
        merges.where("merged")
        .select(
            F.col("report_id").alias("fixed_id"), F.col("pr_number").cast("bigint").alias("pr_number"), "pr_url",
            F.col("merged_at").cast("timestamp").alias("merged_at"),
        )
        .withWatermark("merged_at", lateness)
    )
    near = F.expr(f"merged_at between decided_at - interval {horizon} and decided_at + interval {horizon}")
    joined = held.join(done, (F.col("report_id") == F.col("fixed_id")) & near, "leftOuter")
    closed = F.when(F.col("fixed_id").isNotNull(), F.greatest("merged_at", "decided_at"))
    return joined.withColumn("closed_at", closed).select(
        "report_id", "opened_at", "decided_at", "pr_number", "pr_url", "merged_at",
        F.when(F.col("fixed_id").isNotNull(), K.REENABLED).otherwise(NEVER_MERGED).alias("status"), "closed_at",
        F.floor(seconds_between(F.col("closed_at"), F.col("opened_at"))).cast("bigint").alias("elapsed_seconds"),
    )


def close_on_merge(changes: DataFrame, merges: DataFrame, root: str, available_now: bool = False, **how) -> StreamingQuery:
    """Append the closings to ``root/closings``."""
    return append_to(closings(changes, merges, **how), root, "closings", available_now)


def closed_by_merge(spark: SparkSession, root: str, opened: DataFrame) -> DataFrame:
    """The closings so far, without incidents that an operator re-enabled before their fix was seen."""
    standing = current_state(spark, root, opened).where(F.col("state") == K.QUARANTINED).select("report_id")
    return read_appended(spark, root, "closings", CLOSING).join(standing, "report_id", "left_semi")

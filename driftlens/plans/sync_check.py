"""The main path as one step: profile what was loaded, compare, log, classify, trace and suggest fixes."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import drift, incidents, lineage, profile, triage
from ..sources import history as H
from ..staging import stage


class SyncCheck(NamedTuple):
    reports: DataFrame  # one drift report per loaded table
    classes: DataFrame  # class, evidence and next step of each
    opened: DataFrame  # incidents to approve: (report_id, opened_at)
    blast: DataFrame | None  # downstream nodes of the anomalous tables
    fixes: DataFrame | None  # models with a literal that no longer exists
    verdicts: DataFrame  # one row per opened incident: report, class, state, impact, downstream nodes, fixes


def check_syncs(
    spark: SparkSession,
    loads: list[profile.Load],
    history_path: str,
    log_path: str | None = None,
    nodes: DataFrame | None = None,
    keep: bool = False,
    incident_path: str | None = None,
    detected_after: int | None = None,
) -> SyncCheck:
    """Check freshly loaded tables against their stored past, all in one go.

    ``keep`` also adds the new fingerprints to the history, after the comparison. With a node table (see
    ``sources.manifest``) the anomalous tables are traced downstream. ``incident_path`` takes every opened incident as
    an event, once per report. ``detected_after`` seconds from the load to this check give the impact of each incident.
    """
    current = stage(profile.fingerprint_loads(loads), "current")
    reports = stage(drift.check_tables(current, H.read_history(spark, history_path)), "reports")
    if log_path:
        H.append_log(drift.drift_log(reports), log_path)
    if keep:
        H.store(current, history_path)
    classes = stage(triage.classify(reports), "classes")
    opened = classes.where(F.col("next_step") == "pending_approval").select(
        "report_id", F.col("computed_at").alias("opened_at")
    )
    if incident_path:
        events = classes.join(opened, "report_id").select(
            *H.TABLE_KEY, "report_id", F.col("opened_at").alias("at"), F.lit(0).cast("bigint").alias("seq"), F.lit(incidents.OPEN).alias("action"),
            F.col("opened_at").alias("logged_at"),
        )
        H.append_log(events, incident_path)
    impact = None
    if detected_after is not None:
        received = opened.select("report_id", F.col("opened_at").alias("received_at"))
        detected = F.timestamp_add("SECOND", F.lit(detected_after), "received_at")
        impact = triage.detection_impact(received.withColumn("detected_at", detected))
    states = opened.withColumn("state", F.lit(K.PENDING))
    verdicts = triage.verdicts(reports, classes, states, impact)
    if nodes is None:
        return SyncCheck(reports, classes, opened, None, None, verdicts)
    requests = reports.where("is_anomalous").select(
        F.col("table_name").alias("source_table"), F.coalesce("max_psi_column", F.lit("")).alias("changed_column")
    )
    starts = stage(lineage.find_sources(nodes, requests.distinct()), "starts")
    blast = stage(lineage.blast_radius(nodes, lineage.edges(nodes), starts), "blast")
    silent = classes.where(F.col("classification") == K.SILENT_SEMANTIC_FAILURE).select("report_id")
    pairs = triage.rename_pairs(reports).join(silent, "report_id", "left_semi")
    fixes = stage(triage.stale_literals(pairs, blast, nodes), "fixes")
    none = F.lit(0).cast("bigint")
    downstream = blast.groupBy(F.col("source_table").alias("table_name")).agg(F.count(F.lit(1)).alias("downstream_nodes"))
    suggested = fixes.groupBy("table_name").agg(F.count(F.lit(1)).alias("suggested_fixes"))
    verdicts = (
        verdicts.join(downstream, "table_name", "left")
        .join(suggested, "table_name", "left")
        .withColumn("downstream_nodes", F.coalesce("downstream_nodes", none))
        .withColumn("suggested_fixes", F.coalesce("suggested_fixes", none))
        .withColumn("fix_status", F.when(F.col("suggested_fixes") > 0, "suggested").otherwise("none"))
    )
    return SyncCheck(reports, classes, opened, blast, fixes, verdicts)

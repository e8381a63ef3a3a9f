"""Monitoring views and the downstream KPIs they protect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import seconds_between, strictly_live_rows


def freshness(
    wanted: DataFrame, metadata: DataFrame, as_of: Column, threshold_seconds: int = K.STALE_AFTER_SECONDS
) -> DataFrame:
    """Age of every wanted table; one that is not known keeps its row and is not stale."""
    age = F.round(seconds_between(as_of, F.col("last_modified_at"))).cast("bigint")
    return (
        wanted.select("table_name")
        .join(metadata, "table_name", "left")
        .withColumn("age_seconds", age)
        .select(
            "table_name",
            "last_modified_at",
            "age_seconds",
            "row_count",
            F.coalesce(F.col("age_seconds") > threshold_seconds, F.lit(False)).alias("is_stale"),
            F.lit(threshold_seconds).alias("threshold_seconds"),
        )
    )


def freshness_bands(ages: DataFrame) -> DataFrame:
    """Share of the threshold used up, at most 100, and its colour."""
    used = F.when(
        F.col("age_seconds").isNotNull(), F.least(F.col("age_seconds") / F.col("threshold_seconds") * 100, F.lit(100.0))
    )
    return ages.withColumn("used_pct", used).withColumn(
        "band",
        F.when(F.col("used_pct") >= 100, "red").when(F.col("used_pct") >= 75, "amber").when(
            F.col("used_pct").isNotNull(), "green"
        ),
    )


def any_stale(ages: DataFrame) -> DataFrame:
    return ages.agg(F.coalesce(F.bool_or("is_stale"), F.lit(False)).alias("any_stale"))


def coverage(tables: DataFrame, covered: DataFrame, dataset_id: str) -> DataFrame:
    """Configured tables with a baseline flag: by schema and table, or by the bare table name alone.

    Only the history of one dataset counts: a table of the same name elsewhere covers nothing here.
    """
    covered = covered.where(F.col("dataset_id") == dataset_id)
    full = covered.select(
        F.col("dataset_id").alias("schema_name"), "table_name", F.lit(True).alias("by_schema")
    ).distinct()
    bare = covered.select("table_name", F.lit(True).alias("by_name")).distinct()
    return (
        tables.join(full, ["schema_name", "table_name"], "left")
        .join(bare, "table_name", "left")
        .select(
            "connector_id",
            "schema_name",
            "table_name",
            "enabled",
            (F.col("by_schema").isNotNull() | F.col("by_name").isNotNull()).alias("has_baseline"),
        )
    )


def in_display_order(covered: DataFrame) -> DataFrame:
    """Tables without a baseline last, then disabled ones, then by name."""
    return covered.orderBy("connector_id", F.desc("has_baseline"), F.desc("enabled"), "table_name", "schema_name")


def coverage_summary(covered: DataFrame) -> DataFrame:
    """Tables, monitored tables and the rounded (half-even) percentage per connector."""
    monitored = F.count_if(F.col("has_baseline"))
    return covered.groupBy("connector_id").agg(
        F.count(F.lit(1)).alias("total_tables"),
        monitored.alias("monitored_tables"),
        F.bround(F.lit(100.0) * monitored / F.count(F.lit(1))).cast("bigint").alias("coverage_pct"),
    )


def drift_trend(log: DataFrame, n: int = K.DRIFT_LOG_SIZE) -> DataFrame:
    """The last ``n`` checks, oldest first."""
    newest = log.orderBy(F.desc("logged_at"), F.desc("report_id")).limit(n)
    return newest.orderBy("logged_at", "report_id")


def summary(log: DataFrame, states: DataFrame, watched: DataFrame, preferred_table: str) -> DataFrame:
    """Watched tables, open incidents and the newest check of the preferred table, else the newest of all."""
    entry = F.struct("logged_at", "report_id", "psi", "column_name", "is_anomalous")
    newest = log.agg(
        F.max(F.when(F.col("table_name") == preferred_table, entry)).alias("preferred"), F.max(entry).alias("overall")
    ).select(F.coalesce("preferred", "overall").alias("latest"))
    open_incidents = states.agg(F.count_if(F.col("state") == K.PENDING))
    return watched.agg(F.count(F.lit(1)).alias("tables_watched")).select(
        "tables_watched",
        open_incidents.scalar().alias("active_incidents"),
        F.lit(K.PSI_WATCH).alias("psi_threshold"),
        F.lit(K.BASELINE_SYNCS).alias("baseline_age"),
        newest.scalar().alias("latest"),
    ).select(
        "tables_watched",
        "active_incidents",
        "psi_threshold",
        "baseline_age",
        F.col("latest.psi").alias("latest_psi"),
        F.col("latest.column_name").alias("latest_psi_column"),
        F.col("latest.logged_at").alias("latest_checked_at"),
        F.coalesce("latest.is_anomalous", F.lit(False)).alias("is_anomalous"),
    )


def activity_feed(activity: DataFrame, limit: int = K.ACTIVITY_PAGE, kept: int = K.ACTIVITY_LOG_SIZE) -> DataFrame:
    """The last ``limit`` of the last ``kept`` activity entries, oldest first. A feature limit, not a sample."""
    page = activity.orderBy(F.desc("at"), F.desc("seq")).limit(min(limit, kept))
    return page.orderBy("at", "seq")


def in_state(incidents: DataFrame, state: str) -> DataFrame:
    """Incidents currently in one state: the pending list, or the quarantined one."""
    return incidents.where(F.col("state") == state)


def pending_verdict(verdicts: DataFrame, report_id: str) -> DataFrame:
    """Look up one pending verdict; no row when it is unknown or no longer pending."""
    return in_state(verdicts, K.PENDING).where(F.col("report_id") == report_id)


# KPIs: a fact (stage_id, amount, close_date, is_deleted) and a label dimension (stage_id, label). The sides carry no
# broadcast hint: a dimension of proven small size is broadcast by Spark itself, a large one is shuffled.


def staged_facts(facts: DataFrame, stages: DataFrame, label: str | None = None) -> DataFrame:
    """Live facts with their stage label, optionally of one label only."""
    kept = stages.select("stage_id", F.col("label").alias("stage_label"))
    if label is not None:
        kept = kept.where(F.col("stage_label") == label)
    return facts.where(strictly_live_rows(F.col("is_deleted"))).join(kept, "stage_id")


def _value_and_count(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.coalesce(F.sum("amount").cast("double"), F.lit(0.0)).alias("pipeline_value"),
        F.count(F.lit(1)).alias("deal_count"),
    )


def kpi_by_label(facts: DataFrame, stages: DataFrame, label: str) -> DataFrame:
    """Value and count of one stage, found by its (mutable) label: 0, not null, when nothing matches."""
    return _value_and_count(staged_facts(facts, stages, label))


def kpi_open(facts: DataFrame, stages: DataFrame, label: str, as_of: Column) -> DataFrame:
    """The same over facts that close on or after ``as_of``."""
    return _value_and_count(staged_facts(facts.where(F.col("close_date") >= as_of), stages, label))


def value_at_risk(facts: DataFrame, stages: DataFrame, stage_ids: list) -> DataFrame:
    """Value per affected stage, found by its stable id; 0 for one without facts."""
    affected = stages.where(F.col("stage_id").isin(*stage_ids)).select("stage_id")
    live = facts.where(strictly_live_rows(F.col("is_deleted")) & F.col("stage_id").isin(*stage_ids))
    summed = live.groupBy("stage_id").agg(F.sum("amount").cast("double").alias("value"))
    return affected.join(summed, "stage_id", "left").select(
        "stage_id", F.coalesce("value", F.lit(0.0)).alias("pipeline_value_at_risk")
    )


def mart_by_stage(rows: DataFrame, as_of: Column) -> DataFrame:
    """Count, value and still open value per stage label."""
    return rows.groupBy("stage_label").agg(
        F.count(F.lit(1)).alias("deal_count"),
        F.sum("amount").cast("double").alias("pipeline_value"),
        F.sum(F.when(F.col("close_date") >= as_of, F.col("amount")).otherwise(F.lit(0)))
        .cast("double")
        .alias("active_pipeline_value"),
    )


def stage_totals(facts: DataFrame) -> DataFrame:
    """Facts and value per stage id, biggest first."""
    return (
        facts.groupBy("stage_id")
        .agg(F.count(F.lit(1)).alias("deals"), F.sum("amount").cast("double").alias("total_value"))
        .orderBy(F.desc("total_value"), "stage_id")
    )

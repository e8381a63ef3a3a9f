"""Risk forecast per table, from the spread of its recent fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import days_between, psi_term
from ..sources import history as H
from .drift import KEY, column_comparison

TABLE = H.TABLE_KEY


def _newest_against_rest(members: DataFrame) -> DataFrame:
    """Stability index of the newest fingerprint's categorical columns against the mean of the others."""
    compared = column_comparison(members).where("has_values and old_distributions > 0")
    # the entry of the highest score; on a tie the first column
    lead = F.min(F.struct((-F.col("score")).alias("minus"), F.col("position"), F.col("column_name")))
    return compared.groupBy(*TABLE).agg(
        F.max("score").alias("max_psi"),
        lead["column_name"].alias("volatile_column"),
        F.avg("score").alias("avg_max_psi"),
    )


def past_anomalies(baseline: DataFrame, psi_threshold: float = K.PSI_WATCH) -> DataFrame:
    """Fingerprints that stand out against the mean of the other baseline fingerprints of their table.

    The mean without one's own share is (total - own) / (n - 1), so no fingerprint is paired with another. A
    value that a fingerprint lacks adds ``psi_term(0, total / (n - 1))``; these are summed once per column and
    taken back where the fingerprint does hold the value.
    """
    per_column = Window.partitionBy(*TABLE, "column_name")
    # one placement serves every window below: they all group by a superset of these keys
    rows = (
        baseline.select(*TABLE, "fingerprint_id", "computed_at", F.explode("columns").alias("c"))
        .select(*TABLE, "fingerprint_id", "computed_at", F.col("c.name").alias("column_name"), "c.distribution")
        .where(F.size("distribution") > 0)
        .repartition(*TABLE, "column_name")
        .withColumn("others", F.count(F.lit(1)).over(per_column) - 1)
        .where("others > 0")
        .select("*", F.explode("distribution").alias("value", "share"))
        .drop("distribution")
    )
    per_value = Window.partitionBy(*TABLE, "column_name", "value")
    own = F.col("share")
    rows = rows.withColumn("total", F.sum("share").over(per_value)).withColumn(
        "holders", F.count(F.lit(1)).over(per_value)
    )
    absent = psi_term(F.lit(0.0), F.col("total") / F.col("others"))
    rows = rows.withColumn("absent", absent).withColumn(
        "all_absent", F.sum(F.col("absent") / F.col("holders")).over(per_column)
    )
    present = psi_term(own, (F.col("total") - own) / F.col("others"))
    scores = rows.groupBy(*TABLE, "column_name", "fingerprint_id", "computed_at").agg(
        F.round(F.max("all_absent") + F.sum(present - F.col("absent")), 6).alias("psi")
    )
    return (
        scores.where(F.col("psi") > psi_threshold)
        .groupBy(*TABLE, "fingerprint_id", "computed_at")
        .agg(F.max("psi").alias("psi"))
    )


def risk_profiles(
    history: DataFrame, as_of: Column, n: int = K.RISK_SYNCS, psi_threshold: float = K.PSI_WATCH
) -> DataFrame:
    """Risk signals of every table in the history, from its newest ``n`` fingerprints."""
    newest = H.recent(history, n)
    members = newest.withColumn("is_current", F.col("recency") == 1).withColumn("sync_no", F.lit(0))
    baseline = newest.where("recency > 1")
    counts = newest.groupBy(*TABLE).agg(F.count(F.lit(1)).alias("fingerprint_count"))
    past = past_anomalies(baseline, psi_threshold).groupBy(*TABLE).agg(
        F.count(F.lit(1)).alias("anomaly_count"), F.max("computed_at").alias("last_anomaly_at")
    )
    enough = F.col("fingerprint_count") >= 2
    return (
        counts.join(_newest_against_rest(members), TABLE, "left")
        .join(past, TABLE, "left")
        .select(
            *TABLE,
            "fingerprint_count",
            F.when(enough, F.coalesce("anomaly_count", F.lit(0))).otherwise(0).alias("anomaly_count"),
            F.when(enough, F.round(days_between(as_of, F.col("last_anomaly_at")), 1)).alias("recent_anomaly_days"),
            F.when(enough, F.round(F.coalesce("max_psi", F.lit(0.0)), 4)).otherwise(0.0).alias("max_psi"),
            F.when(enough, F.col("volatile_column")).alias("volatile_column"),
            F.when(enough, F.round(F.coalesce("avg_max_psi", F.lit(0.0)), 4)).otherwise(0.0).alias("avg_max_psi"),
            enough.alias("sufficient_history"),
        )
    )


def log_signals(log: DataFrame, as_of: Column) -> DataFrame:
    """The strongest anomalous entry of the drift log per table; of equal scores the first one counts."""
    strongest = F.min_by(
        F.struct("psi", "logged_at"), F.struct((-F.col("psi")).alias("minus"), F.col("logged_at"), F.col("report_id"))
    )
    return (
        log.where("is_anomalous and psi > 0")
        .groupBy(*TABLE)
        .agg(strongest.alias("entry"))
        .select(
            *TABLE,
            F.col("entry.psi").alias("log_psi"),
            F.round(days_between(as_of, F.col("entry.logged_at")), 2).alias("log_days"),
        )
    )


def merge_log(profiles: DataFrame, signals: DataFrame) -> DataFrame:
    """Let the drift log raise what the stored history does not show yet."""
    logged = F.col("log_psi").isNotNull()
    nearer = F.col("recent_anomaly_days").isNull() | (F.col("log_days") < F.col("recent_anomaly_days"))
    return (
        profiles.join(signals, TABLE, "left")
        .withColumn("max_psi", F.when(logged, F.greatest("max_psi", "log_psi")).otherwise(F.col("max_psi")))
        .withColumn(
            "recent_anomaly_days",
            F.when(logged & nearer, F.col("log_days")).otherwise(F.col("recent_anomaly_days")),
        )
        .withColumn(
            "anomaly_count",
            F.when(logged, F.greatest("anomaly_count", F.lit(1))).otherwise(F.col("anomaly_count")),
        )
        .drop("log_psi", "log_days")
    )


def risk_score(count: Column, days: Column, max_psi: Column, sufficient: Column) -> Column:
    frequency = F.least(count * 20, F.lit(50))
    recency = F.when(days <= 3, 30).when(days <= 7, 20).when(days <= 14, 10).otherwise(0)
    size = F.when(max_psi > 2.0, 15).when(max_psi > 0.5, 8).when(max_psi > 0.25, 4).otherwise(0)
    return F.when(sufficient, F.least(frequency + recency + size, F.lit(100))).otherwise(5).cast("int")


def risk_level(score: Column) -> Column:
    return F.when(score >= 70, "CRITICAL").when(score >= 45, "HIGH").when(score >= 20, "MEDIUM").otherwise("LOW")


def risk_reason(count: Column, days: Column, column: Column, fingerprints: Column) -> Column:
    """One sentence on the score."""
    when = F.when(
        days.isNotNull() & (days != 0), F.concat(F.bround(days, 0).cast("bigint").cast("string"), F.lit(" days ago"))
    ).otherwise("recently")
    return F.when(
        count > 0,
        F.concat(
            F.lit("Column '"),
            F.coalesce(column, F.lit("None")),
            F.lit("' drifted "),
            count.cast("string"),
            F.lit(" time(s) in recent history, most recently "),
            when,
            F.lit("."),
        ),
    ).otherwise(
        F.concat(
            F.lit("No significant drift history — baseline is stable across "),
            fingerprints.cast("string"),
            F.lit(" fingerprints."),
        )
    )


def risk_forecast(watched: DataFrame, profiles: DataFrame, signals: DataFrame | None = None) -> DataFrame:
    """Score, level and reason of every watched table, highest risk first.

    A watched table without history counts as having too little of it; one that could not be read (``readable``
    is false, if the column is there) is reported as unknown.
    """
    tables = watched.select(
        *TABLE, (F.col("readable") if "readable" in watched.columns else F.lit(True)).alias("readable")
    )
    filled = tables.join(profiles, TABLE, "left").fillna(
        {"fingerprint_count": 0, "anomaly_count": 0, "max_psi": 0.0, "sufficient_history": False}
    )
    merged = merge_log(filled, signals) if signals is not None else filled
    score = risk_score(
        F.col("anomaly_count"), F.col("recent_anomaly_days"), F.col("max_psi"), F.col("sufficient_history")
    )
    reason = risk_reason(
        F.col("anomaly_count"), F.col("recent_anomaly_days"), F.col("volatile_column"), F.col("fingerprint_count")
    )
    readable = F.col("readable")
    return merged.select(
        *TABLE,
        F.when(readable, score).otherwise(0).alias("risk_score"),
        F.when(readable, risk_level(score)).otherwise("UNKNOWN").alias("risk_level"),
        F.when(readable, reason)
        .otherwise("Unable to compute — check fingerprint history")
        .alias("reason"),
        F.when(readable, F.col("volatile_column")).alias("volatile_column"),
        F.when(readable, F.col("max_psi")).otherwise(0.0).alias("max_psi"),
        F.when(readable, F.col("anomaly_count")).otherwise(0).alias("anomaly_count"),
        F.when(readable, F.col("recent_anomaly_days")).alias("recent_anomaly_days"),
        F.when(readable, F.col("fingerprint_count")).otherwise(0).alias("fingerprint_count"),
    ).orderBy(F.desc("risk_score"), *TABLE)

"""From drift reports to classes, stale literals and impact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from .drift import KEY, value_shifts
from .lineage import in_graph, node_sql

RENAME_TOLERANCE = 0.01


def rename_pairs(reports: DataFrame, tolerance: float = RENAME_TOLERANCE) -> DataFrame:
    """A value that vanished and one that turned up with the closest share, at most ``tolerance`` away.

    Within a column the closest pair is taken first, ties by old and then by new value, and each value is used once; so
    an unrelated value that vanishes as well cannot hide a rename. A column has at most twenty new values and twenty for
    each baseline fingerprint, so its pairs are matched inside one row.
    """
    side = F.struct("value", F.greatest("current", "baseline").alias("share"))
    columns = value_shifts(reports).groupBy(*KEY, "report_id", "computed_at", "column_name").agg(
        F.collect_list(F.when(F.col("shift") == "DISAPPEARED", side)).alias("old"),
        F.collect_list(F.when(F.col("shift") == "APPEARED", side)).alias("new"),
    )

    def pairs_of(old: Column) -> Column:
        return F.transform(
            "new",
            lambda new: F.struct(
                F.round(F.abs(old["share"] - new["share"]), 9).alias("apart"),
                old["value"].alias("old_value"),
                new["value"].alias("new_value"),
                old["share"].alias("old_share"),
                new["share"].alias("new_share"),
            ),
        )

    near = F.filter(F.flatten(F.transform("old", pairs_of)), lambda p: p["apart"] <= tolerance)

    def take(taken: Column, pair: Column) -> Column:
        used = F.exists(taken, lambda t: (t["old_value"] == pair["old_value"]) | (t["new_value"] == pair["new_value"]))
        return F.when(used, taken).otherwise(F.concat(taken, F.array(pair)))

    ordered = columns.withColumn("near", F.array_sort(near))
    matched = ordered.withColumn("pair", F.explode(F.aggregate("near", F.slice("near", 1, 0), take)))
    return matched.select(*KEY, "report_id", "computed_at", "column_name", *(f"pair.{c}" for c in ("old_value", "old_share", "new_value", "new_share")))


def classify(reports: DataFrame, tolerance: float = RENAME_TOLERANCE) -> DataFrame:
    """Drift class of every anomalous report, with the evidence it rests on and the next step.

    Rules, first match wins: a rename with steady row count and columns is a silent semantic failure; nulls, a row
    count collapse, changed columns or a value gone for good is an upstream data quality problem; new values or
    more rows with nothing gone is benign growth; anything else is seasonal.
    """
    judged = reports.where(F.col("status") == "compared")
    shifts = value_shifts(judged).groupBy("report_id").agg(
        F.count_if(F.col("shift") == "DISAPPEARED").alias("vanished_values"),
        F.count_if(F.col("shift") == "APPEARED").alias("new_values"),
    )
    pairs = rename_pairs(judged, tolerance).groupBy("report_id").agg(F.count(F.lit(1)).alias("renamed_values"))
    waves = judged.groupBy(F.col("dataset_id").alias("wave_dataset"), F.col("computed_at").alias("wave_at")).agg(
        F.count_if("is_anomalous").alias("wave_anomalies")
    )
    same_wave = (F.col("dataset_id") == F.col("wave_dataset")) & F.col("computed_at").eqNullSafe(F.col("wave_at"))
    zero = F.lit(0).cast("bigint")
    evidence = (
        judged.join(waves, same_wave)
        .withColumn("other_anomalies", F.col("wave_anomalies") - F.col("is_anomalous").cast("int"))
        .join(shifts, "report_id", "left")
        .join(pairs, "report_id", "left")
        .withColumns({c: F.coalesce(c, zero) for c in ("vanished_values", "new_values", "renamed_values")})
        .withColumn("columns_changed", (F.size("columns_added") > 0) | (F.size("columns_removed") > 0))
        .withColumn(
            "null_flag",
            F.exists("column_drifts", lambda d: (d["drift_type"] == "NULL_PCT_CHANGE") & d["is_anomalous"]),
        )
    )
    z = F.col("row_count_z_score")
    renamed, gone = F.col("renamed_values") > 0, F.col("vanished_values") > 0
    drift_class = (
        F.when(renamed & (F.abs(z) <= K.ROW_COUNT_Z_LIMIT) & ~F.col("columns_changed"), K.SILENT_SEMANTIC_FAILURE)
        .when(
            F.col("null_flag")
            | (z < -K.ROW_COUNT_Z_LIMIT)
            | F.col("columns_changed")
            | (F.col("vanished_values") > F.col("renamed_values")),
            K.UPSTREAM_DATA_QUALITY,
        )
        .when(((F.col("new_values") > 0) | (z > K.ROW_COUNT_Z_LIMIT)) & ~gone, K.BENIGN_GROWTH)
        .otherwise(K.NORMAL_SEASONAL)
    )
    classified = evidence.withColumn("classification", F.when(F.col("is_anomalous"), drift_class))
    status = (
        F.when(~F.col("is_anomalous"), "clean")
        .when(F.col("classification") == K.SILENT_SEMANTIC_FAILURE, "pending_approval")
        .otherwise("no_action_needed")
    )
    affected = F.array_distinct(
        F.transform(F.filter("column_drifts", lambda d: d["is_anomalous"]), lambda d: d["column_name"])
    )
    return classified.select(
        *KEY,
        "report_id",
        "computed_at",
        "classification",
        status.alias("next_step"),
        affected.alias("affected_columns"),
        "renamed_values",
        "vanished_values",
        "new_values",
        "null_flag",
        "columns_changed",
        "row_count_z_score",
        (F.col("other_anomalies") == 0).alias("others_clean"),
    )


def stale_literals(pairs: DataFrame, blast: DataFrame, nodes: DataFrame) -> DataFrame:
    """Downstream models that compare a renamed column with a value that no longer exists.

    ``pairs`` has (table_name, column_name, old_value, new_value); ``blast`` comes from ``lineage.blast_radius`` for the
    renamed columns. One row per model and breaking snippet, with the snippet and the model's SQL after replacement.
    """
    models = in_graph(nodes).where("resource_type = 'model'").select(
        "graph",
        "uid",
        F.coalesce("original_file_path", "path", F.concat(F.lit("models/"), "name", F.lit(".sql"))).alias("file_path"),
        node_sql(nodes).alias("sql"),
    )
    referencing = blast.where("references_column and node_type = 'model'").select(
        F.col("source_table").alias("table_name"), F.col("changed_column").alias("column_name"), "graph", "uid", "name"
    ).distinct()
    pattern = F.concat(F.lit(r"(?:\w+\.)?\b"), F.col("column_name"), F.lit(r"\s*=\s*'(?:[^']|'')*'"))
    snippets = (
        referencing.join(models, ["graph", "uid"])
        .withColumn("original_snippet", F.explode(F.array_distinct(F.regexp_extract_all("sql", pattern, F.lit(0)))))
        .withColumn("old_value", F.replace(F.regexp_extract("original_snippet", r"'((?:[^']|'')*)'$", 1), F.lit("''"), F.lit("'")))
    )

    def quoted(c: Column) -> Column:
        return F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'"))

    fixed = F.replace(F.col("original_snippet"), quoted(F.col("old_value")), quoted(F.col("new_value")))
    return (
        snippets.join(pairs.select("table_name", "column_name", "old_value", "new_value"), ["table_name", "column_name", "old_value"])
        .withColumn("fixed_snippet", fixed)
        .select(
            "table_name",
            "column_name",
            "graph",
            F.col("uid").alias("model_uid"),
            F.col("name").alias("model_name"),
            "file_path",
            "old_value",
            "new_value",
            "original_snippet",
            "fixed_snippet",
            F.replace("sql", F.col("original_snippet"), F.col("fixed_snippet")).alias("fixed_sql"),
        )
    )


def detection_impact(incidents: DataFrame, manual_seconds: float = K.MANUAL_DETECTION_SECONDS) -> DataFrame:
    """Time to detect and hours saved per incident, with running counts in order of detection.

    ``incidents`` has (report_id, received_at, detected_at).
    """
    from ..functions import seconds_between
    from .ordered import running_totals

    seconds = seconds_between(F.col("detected_at"), F.col("received_at"))
    timed = incidents.withColumn("seconds", seconds).withColumn(
        "hours", F.greatest((F.lit(manual_seconds) - F.col("seconds")) / 3600.0, F.lit(0.0))
    )
    summed = running_totals(
        timed, ["detected_at", "report_id"], {"incidents_total": F.lit(1), "hours_total": F.col("hours")}
    )
    return summed.select(
        "report_id",
        "received_at",
        "detected_at",
        F.round("seconds", 1).alias("time_to_detect_seconds"),
        F.lit(manual_seconds).alias("industry_avg_ttd_seconds"),
        F.round("hours", 2).alias("hours_saved_this_incident"),
        F.col("incidents_total").cast("bigint").alias("incidents_caught_total"),
        F.round("hours_total", 2).alias("total_hours_saved"),
    )


def verdicts(reports: DataFrame, classes: DataFrame, states: DataFrame, impact: DataFrame | None = None) -> DataFrame:
    """Open verdicts: the report, its class, the incident state and the impact in one row."""
    report = reports.select(
        "report_id",
        "dataset_id",
        "table_name",
        "computed_at",
        "max_psi_score",
        "max_psi_column",
        F.lit(K.PSI_WATCH).alias("psi_threshold"),
        "row_count_z_score",
        "anomaly_reason",
        "columns_added",
        "columns_removed",
        "max_psi_baseline_dist",
        "max_psi_current_dist",
    )
    rows = report.join(classes.select("report_id", "classification", "affected_columns"), "report_id").join(
        states, "report_id"
    )
    return rows.join(impact, "report_id", "left") if impact is not None else rows

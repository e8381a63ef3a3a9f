"""Drift: each fingerprint against the mean of its recent predecessors, for all tables and syncs at once.

A comparison is keyed by (dataset_id, table_name, sync_no). Its members are the current fingerprint and up to
``n`` baseline fingerprints, all of them in one frame, so that one grouping by the key replaces the self-join of
the history. Whatever is grouped here is bounded: at most ``n + 1`` fingerprints with twenty values a column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import psi_band, psi_of_shares, score_multiple
from ..sources import history as H
from ..staging import stage

KEY = ["dataset_id", "table_name", "sync_no"]
_TOTALS = "array<struct<value:string,current:double,old_total:double>>"


def rolling_members(fingerprints: DataFrame, n: int = K.BASELINE_SYNCS) -> DataFrame:
    """Members of the comparison of every sync with the ``n`` syncs before it.

    Only ids and times are ordered per table; the profiles themselves meet their number by id. The fingerprints are
    read twice, so pass stored ones.
    """
    in_order = Window.partitionBy(*H.TABLE_KEY).orderBy("computed_at", "fingerprint_id")
    numbers = fingerprints.select(*H.TABLE_KEY, "computed_at", "fingerprint_id").select(
        F.col("fingerprint_id").alias("numbered_id"), F.row_number().over(in_order).alias("own_no")
    )
    numbered = fingerprints.join(numbers, F.col("fingerprint_id") == F.col("numbered_id")).drop("numbered_id")
    # a sync is the current one of its own comparison and a baseline of the n that follow
    served = numbered.withColumn("sync_no", F.explode(F.sequence("own_no", F.col("own_no") + n)))
    return served.withColumn("is_current", F.col("sync_no") == F.col("own_no")).drop("own_no")


def recent_members(current: DataFrame, history: DataFrame, n: int = K.BASELINE_SYNCS) -> DataFrame:
    """Members of the comparison of new fingerprints (one per table) with the newest ``n`` stored ones."""
    baseline = H.recent(history, n).drop("recency")
    return (
        current.withColumn("is_current", F.lit(True))
        .unionByName(baseline.withColumn("is_current", F.lit(False)))
        .withColumn("sync_no", F.lit(0))
    )


def _header(members: DataFrame) -> DataFrame:
    now, before = F.col("is_current"), ~F.col("is_current")
    names = ["fingerprint_id", "connection_id", "project_id", "computed_at", "row_count", "schema_hash"]
    old_count = F.when(before, F.col("row_count").cast("double"))
    header = members.groupBy(*KEY).agg(
        *[F.max(F.when(now, F.col(c))).alias(c) for c in names],
        F.count_if(now).alias("currents"),
        F.count_if(before).alias("baseline_count"),
        F.coalesce(F.bool_or(F.when(before, F.col("is_synthetic"))), F.lit(False)).alias("baseline_includes_synthetic"),
        F.avg(old_count).alias("mean_count"),
        F.stddev_samp(old_count).alias("sd_count"),
    )
    spread = (F.col("baseline_count") >= 2) & (F.col("sd_count") > 0)
    z = F.when(spread, (F.col("row_count") - F.col("mean_count")) / F.col("sd_count")).otherwise(0.0)
    return header.where("currents > 0").withColumn("row_count_z", z).drop("currents", "mean_count", "sd_count")


def column_comparison(members: DataFrame) -> DataFrame:
    """One row per comparison and column: current statistics, baseline means, aligned shares and the score.

    ``shares`` lists every value of either side as (value, current, baseline). The baseline share is averaged
    over the fingerprints that have a distribution for the column; a value absent from one of them counts 0.
    """
    rows = members.select(*KEY, "is_current", F.explode("columns").alias("c")).select(*KEY, "is_current", "c.*")
    now, before = F.col("is_current"), ~F.col("is_current")
    has_values = F.size("distribution") > 0
    stats = rows.groupBy(*KEY, F.col("name").alias("column_name")).agg(
        F.max(F.when(now, F.col("position"))).alias("position"),
        F.max(F.when(now, F.col("data_type"))).alias("data_type"),
        F.max(F.when(before, F.col("data_type"))).alias("old_data_type"),
        F.min(F.when(before, F.col("data_type"))).alias("other_old_data_type"),
        F.max(F.when(now, F.col("null_pct"))).alias("null_pct"),
        F.max(F.when(now, F.col("mean"))).alias("mean"),
        F.coalesce(F.bool_or(F.when(now, has_values)), F.lit(False)).alias("has_values"),
        F.count_if(before).alias("old_columns"),
        F.count_if(before & has_values).alias("old_distributions"),
        F.avg(F.when(before, F.col("null_pct"))).alias("old_null_pct"),
        F.avg(F.when(before, F.col("mean"))).alias("old_mean"),
        F.avg(F.when(before, F.col("stddev"))).alias("old_stddev"),
    )
    values = (
        rows.select(*KEY, "is_current", F.col("name").alias("column_name"), F.explode("distribution").alias("value", "share"))
        .groupBy(*KEY, "column_name", "value")
        .agg(
            F.coalesce(F.max(F.when(now, F.col("share"))), F.lit(0.0)).alias("current"),
            F.coalesce(F.sum(F.when(before, F.col("share"))), F.lit(0.0)).alias("old_total"),
        )
        .groupBy(*KEY, "column_name")
        .agg(F.array_sort(F.collect_list(F.struct("value", "current", "old_total"))).alias("totals"))
    )
    numeric = "(not has_values and mean is not null and old_mean is not null)"
    return (
        stats.join(values, [*KEY, "column_name"], "left")
        .selectExpr(
            "* except(totals)",
            f"transform(coalesce(totals, cast(array() as {_TOTALS})), v -> named_struct('value', v.value, "
            "'current', v.current, 'baseline', coalesce(try_divide(v.old_total, old_distributions), 0D))) as shares",
            "position is not null and old_columns > 0 as in_both",
            f"case when position is not null and old_columns > 0 and {numeric} then "
            "case when old_stddev > 0 then abs((mean - old_mean) / old_stddev) else 0D end end as mean_z",
        )
        .select(
            "*",
            F.when(F.col("in_both") & F.col("has_values"), psi_of_shares(F.col("shares")))
            .when(
                F.col("mean_z").isNotNull(),
                F.least(F.col("mean_z") / K.NUMERIC_Z_LIMIT, F.lit(K.NUMERIC_SCORE_CAP)),
            )
            .alias("score"),
            F.expr("case when in_both then abs(null_pct - old_null_pct) end").alias("null_shift"),
            F.expr(
                "coalesce(in_both and (data_type <> old_data_type or data_type <> other_old_data_type), false)"
            ).alias("type_changed"),
        )
    )


def _shares_map(shares: str, side: str) -> str:
    return f"map_from_entries(transform(filter({shares}, v -> v.{side} > 0), v -> struct(v.value, v.{side})))"


def _drift_entry(kind: str, score: str, current: str, baseline: str, anomalous: str) -> str:
    return (
        f"named_struct('position', position, 'column_name', column_name, 'drift_type', '{kind}', 'psi_score', {score}, "
        f"'current_value', {current}, 'baseline_value', {baseline}, 'is_anomalous', {anomalous}, 'shares', shares)"
    )


def _column_drifts(threshold: float) -> Column:
    """Drift entries of one column: the score, and the null shift where it is worth reporting."""
    categorical = _drift_entry(
        "PSI_CATEGORICAL",
        "score",
        f"to_json({_shares_map('shares', 'current')})",
        f"to_json({_shares_map('shares', 'baseline')})",
        f"score > {threshold}D",
    )
    numeric = _drift_entry(
        "PSI_NUMERIC",
        "score",
        "cast(round(mean, 4) as string)",
        "cast(round(old_mean, 4) as string)",
        f"mean_z > {K.NUMERIC_Z_LIMIT}D",
    )
    nulls = _drift_entry(
        "NULL_PCT_CHANGE",
        "null_shift",
        "cast(round(null_pct, 4) as string)",
        "cast(round(old_null_pct, 4) as string)",
        f"null_shift > {K.NULL_SHIFT_ANOMALOUS}D",
    )
    return F.expr(
        f"filter(array(case when score is not null and has_values then {categorical} end, "
        f"case when mean_z is not null then {numeric} end, "
        f"case when null_shift > {K.NULL_SHIFT_REPORTED}D then {nulls} end), e -> e is not null)"
    )


# Entries are ordered by position, so the first of the best scores wins a tie. Scores are compared as they are shown, by six
# places: what lies below is noise of the order in which rows were summed.
_BEST = """
aggregate(filter(compared, c -> c.score is not null),
  cast(null as struct<name:string,score:double,shares:array<struct<value:string,current:double,baseline:double>>,has_values:boolean>),
  (acc, c) -> case when acc is null or round(c.score, 6) > round(acc.score, 6)
    then named_struct('name', c.name, 'score', c.score, 'shares', c.shares, 'has_values', c.has_values) else acc end)
"""


def _names(keep: str) -> Column:
    return F.expr(
        f"case when baseline_count > 0 then array_sort(transform(filter(compared, c -> {keep}), c -> c.name)) end"
    )


def compare(members: DataFrame, psi_threshold: float = K.PSI_WATCH, strict: bool = False) -> DataFrame:
    """Drift reports: one row per comparison.

    Without any baseline the row has the status ``no_baseline`` and no verdict; with ``strict`` the job fails.
    The members are written down first: headers, columns and values are three passes over the same small rows.
    """
    members = stage(members, "members")
    columns = column_comparison(members)
    per_column = F.struct(
        "position",
        F.col("column_name").alias("name"),
        "data_type",
        "old_columns",
        "type_changed",
        "score",
        "mean_z",
        "null_shift",
        "has_values",
        "shares",
        _column_drifts(psi_threshold).alias("drifts"),
    )
    gathered = columns.groupBy(*KEY).agg(F.array_sort(F.collect_list(per_column)).alias("compared"))
    report = _header(members).join(gathered, KEY, "left")

    missing = F.lit("Cannot compare: no baseline fingerprints exist yet.")
    has_baseline = F.col("baseline_count") > 0
    status = F.when(has_baseline, "compared").otherwise(
        F.raise_error(missing) if strict else F.lit("no_baseline")
    )
    report = report.withColumns(
        {
            "status": status,
            "best": F.expr(_BEST),
            "columns_added": _names("c.old_columns = 0"),
            "columns_removed": _names("c.position is null"),
            "columns_type_changed": _names("c.type_changed"),
        }
    ).withColumn("raw_score", F.coalesce(F.col("best.score"), F.lit(0.0)))
    over = F.col("raw_score") > psi_threshold
    rows_off = F.abs("row_count_z") > K.ROW_COUNT_Z_LIMIT
    added, removed = F.size("columns_added") > 0, F.size("columns_removed") > 0

    def listed(column):
        return F.concat(F.lit("['"), F.array_join(column, "', '"), F.lit("']"))

    reason = F.concat_ws(
        "; ",
        F.when(
            over,
            F.format_string(
                f"column '%s' PSI=%.3f (threshold {psi_threshold})", F.col("best.name"), F.col("raw_score")
            ),
        ),
        F.when(rows_off, F.format_string("row count Z-score=%.2f", F.col("row_count_z"))),
        F.when(added, F.concat(F.lit("columns added: "), listed("columns_added"))),
        F.when(removed, F.concat(F.lit("columns removed: "), listed("columns_removed"))),
    )
    anomalous = F.when(has_baseline, over | rows_off | added | removed)
    return report.select(
        *KEY,
        F.left(F.sha2(F.concat_ws("|", F.lit("report"), "fingerprint_id"), 256), F.lit(32)).alias("report_id"),
        "fingerprint_id",
        "connection_id",
        "project_id",
        "computed_at",
        "row_count",
        "status",
        "baseline_count",
        "baseline_includes_synthetic",
        F.when(has_baseline, F.round("raw_score", 6)).alias("overall_drift_score"),
        F.when(has_baseline, F.col("best.name")).alias("max_psi_column"),
        F.when(has_baseline, F.round("raw_score", 6)).alias("max_psi_score"),
        F.when(has_baseline, psi_band(F.col("raw_score"))).alias("psi_band"),
        F.when(has_baseline, score_multiple(F.col("raw_score"), psi_threshold)).alias("threshold_multiple"),
        F.when(has_baseline, F.round("row_count_z", 4)).alias("row_count_z_score"),
        "columns_added",
        "columns_removed",
        "columns_type_changed",
        F.expr(
            "case when baseline_count > 0 then "
            "flatten(transform(filter(compared, c -> c.position is not null), c -> c.drifts)) end"
        ).alias("column_drifts"),
        anomalous.alias("is_anomalous"),
        F.when(anomalous, reason).alias("anomaly_reason"),
        *[
            F.expr(
                f"coalesce({_shares_map('case when best.has_values then best.shares end', side)}, "
                "cast(map() as map<string,double>))"
            ).alias(f"max_psi_{side}_dist")
            for side in ("current", "baseline")
        ],
    )


def check_tables(current: DataFrame, history: DataFrame, n: int = K.BASELINE_SYNCS) -> DataFrame:
    """The memory step: new fingerprints of any number of tables against their stored recent past."""
    return compare(recent_members(current, history, n))


def column_drifts(reports: DataFrame) -> DataFrame:
    """Long form of the drift entries."""
    keep = [*KEY, "report_id", "computed_at"]
    return reports.select(*keep, F.explode("column_drifts").alias("drift")).select(*keep, "drift.*")


def _categorical_shares(reports: DataFrame) -> DataFrame:
    drifts = column_drifts(reports).where(F.col("drift_type") == "PSI_CATEGORICAL")
    return drifts.withColumn("share", F.explode("shares")).select(
        *KEY, "report_id", "computed_at", "column_name", "share.value", "share.current", "share.baseline"
    )


def value_shifts(reports: DataFrame) -> DataFrame:
    """Values that vanished from, or newly turned up in, a categorical column."""
    vanished = (F.col("baseline") > 0) & (F.col("current") < K.PSI_FLOOR)
    turned_up = (F.col("current") > 0) & (F.col("baseline") < K.PSI_FLOOR)
    both = F.array_compact(
        F.array(F.when(vanished, F.lit("DISAPPEARED")), F.when(turned_up, F.lit("APPEARED")))
    )
    return _categorical_shares(reports).select("*", F.explode(both).alias("shift"))


def leading_values(reports: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` most frequent values of each drifted column, on the current and on the baseline side."""
    sides = F.explode(
        F.array(
            F.struct(F.lit("current").alias("side"), F.col("current").alias("share")),
            F.struct(F.lit("baseline").alias("side"), F.col("baseline").alias("share")),
        )
    )
    long = _categorical_shares(reports).withColumn("s", sides).where("s.share > 0")
    best = Window.partitionBy("report_id", "column_name", "s.side").orderBy(F.desc("s.share"), "value")
    return long.select(
        *KEY, "report_id", "computed_at", "column_name", "s.side", "value", "s.share", F.row_number().over(best).alias("rank")
    ).where(F.col("rank") <= k)


def top_movers(reports: DataFrame, k: int = 7) -> DataFrame:
    """The ``k`` values of the highest-scoring column whose share moved most, with percentages to one decimal."""
    delta = F.round(F.col("current") - F.col("baseline"), 12)
    biggest = Window.partitionBy("report_id").orderBy(F.desc(F.abs("delta")), "value")
    moved = reports.select(
        *KEY,
        "report_id",
        "computed_at",
        F.col("max_psi_column").alias("column_name"),
        F.explode(
            F.map_entries(
                F.map_zip_with(
                    "max_psi_current_dist",
                    "max_psi_baseline_dist",
                    lambda _, a, e: F.struct(
                        F.coalesce(a, F.lit(0.0)).alias("current"), F.coalesce(e, F.lit(0.0)).alias("baseline")
                    ),
                )
            )
        ).alias("entry"),
    ).select(
        *KEY, "report_id", "computed_at", "column_name", F.col("entry.key").alias("value"), "entry.value.current", "entry.value.baseline"
    )
    ranked = moved.withColumn("delta", delta).withColumn("rank", F.row_number().over(biggest))
    return ranked.where(F.col("rank") <= k).select(
        *KEY,
        "report_id",
        "computed_at",
        "column_name",
        "rank",
        "value",
        F.round(F.col("current") * 100, 1).alias("current_pct"),
        F.round(F.col("baseline") * 100, 1).alias("baseline_pct"),
        "delta",
    )


def drift_log(reports: DataFrame) -> DataFrame:
    """The log entry of every check."""
    return reports.where(F.col("status") == "compared").select(
        F.col("computed_at").alias("logged_at"),
        F.col("max_psi_score").alias("psi"),
        F.col("max_psi_column").alias("column_name"),
        "dataset_id",
        "table_name",
        "is_anomalous",
        "report_id",
    )

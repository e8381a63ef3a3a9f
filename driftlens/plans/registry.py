"""Every registered query: (spark, folder) -> DataFrame over the star-schema tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import columns, drift, incidents, lineage, monitor, profile, reach, risk, selection, sketches, triage
from ..operators.quantiles import exact_quantiles
from ..sources import history as H
from ..sources.connectors import connector_tables, schema_of_tables
from ..sources.manifest import manifest_nodes
from ..sources.sync_events import accepted, fan_out, sync_events
from ..sources.tables import catalog, read_table, read_watch_list, table_metadata
from ..staging import new_path, stage
from . import roles as R
from .sync_check import check_syncs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _day(column: str = "computed_at"):
    return R.day_text(column).alias("sync_day")


def _joined(column: str):
    return F.array_join(column, ",").alias(column)


# --- scans -----------------------------------------------------------------------------------------------------


@query
def table_catalog(spark, d):
    """Catalog scan and column selection, next to the size of every table."""
    tables = {t: read_table(spark, d, t) for t in TABLES}
    columns = catalog(spark, tables, "main")
    kept = selection.profilable_columns(columns).select("table_name", "column_name", "kind")
    sizes = table_metadata(tables).select("table_name", "row_count")
    return (
        columns.join(kept, ["table_name", "column_name"], "left")
        .join(sizes, "table_name")
        .select("table_name", "ordinal", "column_name", "data_type", F.coalesce("kind", F.lit("skipped")).alias("kind"), "row_count")
    )


@query
def freshness(spark, d):
    """Age of every table at a fixed time, by the newest value of its own time column; tables without one are unknown."""
    wanted = spark.createDataFrame([(t,) for t in [*TABLES, "not_loaded"]], "table_name string")
    loaded = R.all_of(
        [
            read_table(spark, d, table).agg(
                F.lit(table).alias("table_name"), F.max(column).alias("last_modified_at"), F.count(F.lit(1)).alias("row_count")
            )
            for table, column in R.TIME_COLUMNS.items()
        ]
    )
    ages = monitor.freshness(wanted, loaded, R.moment(R.AS_OF))
    return monitor.freshness_bands(ages).withColumn("any_stale", monitor.any_stale(ages).scalar())


@query
def watched_columns(spark, d):
    """Every column a watch list names, with its kind, or the status of one that its table does not have."""
    columns = catalog(spark, {t: read_table(spark, d, t) for t in TABLES}, "main")
    path = new_path(spark, "watch-list")
    R.watch_document(columns).write.text(path)
    watched = read_watch_list(spark, path)
    found = selection.profilable_columns(columns, watched).select("table_name", "column_name", F.col("kind").alias("status"))
    return found.unionByName(selection.missing_columns(columns, watched).select("table_name", "column_name", "status"))


# --- profiles --------------------------------------------------------------------------------------------------


def _whole_tables(spark, d, kind, **options):
    now = R.moment(R.AS_OF)
    loads = [profile.Load(read_table(spark, d, t), "main", t, now, per_sync=False) for t in ("orders", "lineitem")]
    return profile.fingerprint_loads([profile.only_kind(load, kind) for load in loads], **options)


@query
def profile_numeric(spark, d):
    """Counts, moments, exact distinct counts and exact quantiles of every numeric column of orders and lineitem."""
    stats = profile.column_rows(_whole_tables(spark, d, selection.NUMERIC, distinct="exact", top="none"))
    parts = []
    for t in ("orders", "lineitem"):
        df = read_table(spark, d, t)
        names = [c.name for c in selection.profiled_columns(df.schema) if c.kind == selection.NUMERIC]
        parts.append(
            exact_quantiles(df.select(F.lit(t).alias("table_name"), *names), ["table_name"], names)
        )
    wide = R.all_of(parts).groupBy("table_name", F.col("column_name").alias("name")).agg(
        *[F.max(F.when(F.col("percent") == p, F.col("quantile"))).alias(f"p{p}") for p in K.QUANTILE_PERCENTS]
    )
    return stats.drop(*[f"p{p}" for p in K.QUANTILE_PERCENTS]).join(wide, ["table_name", "name"]).select(
        "table_name",
        F.col("name").alias("column_name"),
        "row_count",
        "null_pct",
        "distinct_count",
        F.col("min_val").alias("min_value"),
        F.col("max_val").alias("max_value"),
        F.round("mean", 4).alias("mean"),
        F.round("stddev", 4).alias("stddev"),
        *[f"p{p}" for p in K.QUANTILE_PERCENTS],
    )


@query
def profile_categorical(spark, d):
    rows = profile.column_rows(_whole_tables(spark, d, selection.CATEGORICAL, distinct="exact"))
    return rows.select(
        "table_name",
        F.col("name").alias("column_name"),
        "row_count",
        "null_pct",
        "distinct_count",
        F.col("top_values")[0]["value"].alias("top_value"),
        F.col("top_values")[0]["pct"].alias("top_pct"),
        "entropy",
    )


def _text_tables(spark, d):
    now = R.moment(R.AS_OF)
    wanted = {
        "part": ["p_name", "p_brand", "p_type"],
        "customer": ["c_name", "c_mktsegment"],
        "events": ["event_type", "props"],
        "conversations": ["role", "text"],
        "documents": ["text", "lang", "source"],
        "pages": ["url", "html"],
        "benchmark": ["text"],
    }
    return profile.fingerprint_loads(
        [
            profile.Load(read_table(spark, d, t), "main", t, now, per_sync=False, profile_columns=columns)
            for t, columns in wanted.items()
        ]
    )


@query
def topk_values(spark, d):
    """The twenty most frequent values of text columns, near-unique ones included."""
    rows = profile.column_rows(_text_tables(spark, d))
    return rows.select(
        "table_name", F.col("name").alias("column_name"), F.posexplode("top_values").alias("rank", "v")
    ).select("table_name", "column_name", (F.col("rank") + 1).alias("rank"), "v.value", "v.cnt", "v.pct")


@query
def entropy_by_column(spark, d):
    rows = profile.column_rows(_text_tables(spark, d))
    return rows.select(
        "table_name", F.col("name").alias("column_name"), "entropy",
        F.size("distribution").alias("kept_values"),
    )


@query
def approximate_profile(spark, d):
    """The one-scan form of a profile, by sketches only; the counters in it are exact."""
    fps = profile.fingerprint_loads([R.lineitem_by_month(spark, d)], top="approx")
    rows = profile.column_rows(fps)
    return rows.select(
        _day(), F.col("name").alias("column_name"), "row_count", "null_pct",
        F.round("mean", 4).alias("mean"), F.size("distribution").alias("kept_values"),
    )


@query
def weekly_profile(spark, d):
    """Weekly profiles merged from stored daily states, and whether each estimate is within its bound of the exact value.

    The profile itself reads the states alone; the table is read for the exact values beside it.
    """
    load, path = R.events_by_day(spark, d), new_path(spark, "states")
    H.store_states(sketches.states(load), path)
    H.store_states(sketches.states(load), path)  # a repeat adds nothing
    week = F.date_trunc("week", "computed_at").cast("timestamp_ntz").alias("week")
    by_week = H.read_history(spark, path).select("*", week)
    weeks = stage(sketches.estimates(sketches.merged(by_week, ["week", "name", "kind"])), "weeks")
    rows = load.df.select(F.date_trunc("week", "ts").cast("timestamp_ntz").alias("week"), *load.profile_columns)
    return R.with_exact(weeks, rows).select(
        _day("week"), F.col("name").alias("column_name"), "row_count", "null_pct", F.col("min_val").alias("min_value"),
        F.col("max_val").alias("max_value"), F.round("mean", 4).alias("mean"), F.round("stddev", 4).alias("stddev"),
        F.col("exact_distinct").alias("distinct_count"), "distinct_within", "quantiles_within", "top_within",
    )


@query
def fingerprint_daily(spark, d):
    """The whole history of the events table in one job."""
    fps = profile.fingerprint_loads([R.events_by_day(spark, d)], distinct="exact")
    return profile.column_rows(fps).select(
        _day(),
        "schema_hash",
        "row_count",
        "position",
        F.col("name").alias("column_name"),
        "data_type",
        "null_pct",
        "distinct_count",
        F.col("min_val").alias("min_value"),
        F.col("max_val").alias("max_value"),
        F.round("mean", 4).alias("mean"),
        F.round("stddev", 4).alias("stddev"),
        "entropy",
    )


@query
def live_profile(spark, d):
    """Orders as a soft-deleting source: deleted rows are left out, rows with an unknown flag are profiled."""
    deleted = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus") == "F").alias(K.DELETED_FLAG)
    orders = read_table(spark, d, "orders").select("o_orderstatus", "o_orderpriority", "o_totalprice", deleted)
    fps = profile.fingerprints(orders, "sales", "orders", R.moment(R.AS_OF), per_sync=False)
    return profile.column_rows(fps).select(
        F.col("name").alias("column_name"), "row_count", "null_pct", F.round("mean", 4).alias("mean"),
        F.size("distribution").alias("kept_values"),
    )


# --- history ---------------------------------------------------------------------------------------------------


@query
def recent_fingerprints(spark, d):
    loads = [R.events_by_day(spark, d), R.lineitem_by_month(spark, d)]
    fps = profile.fingerprint_loads([profile.header_only(load) for load in loads])
    return H.recent(fps).select("dataset_id", "table_name", _day(), "recency", "row_count")


@query
def fingerprint_listing(spark, d):
    return H.listing(profile.fingerprint_loads([profile.header_only(R.events_by_day(spark, d))]), "app", "events").select(_day(), "row_count")


@query
def history_store(spark, d):
    """Stored twice, kept once: appending to the history is idempotent, and partitions are pruned by date."""
    path = new_path(spark, "history")
    fps = _profiled(R.events_by_day(spark, d))
    H.store(fps, path)
    H.store(fps, path)
    stored = H.read_history(spark, path, since="2024-01-10")
    return stored.groupBy(_day()).agg(
        F.count(F.lit(1)).alias("fingerprints"), F.max("row_count").alias("row_count")
    )


@query
def history_delete(spark, d):
    """Delete by rewrite: store a history, rewrite it less the real fingerprints of one table, read the copy back."""
    path, cleaned = new_path(spark, "history"), new_path(spark, "history")
    loads = [profile.header_only(R.events_by_day(spark, d)), profile.header_only(R.orders_by_month(spark, d))]
    H.store(profile.fingerprint_loads(loads), path)
    gone = H.matching("events", "app", is_synthetic=False, computed_from=R.moment("2024-01-20 00:00:00"))
    H.rewrite_without(spark, path, gone, cleaned)
    return H.read_history(spark, cleaned).select("dataset_id", "table_name", _day(), "row_count")


@query
def history_delete_in_place(spark, d):
    """The same delete on the stored history itself: only the dates that hold matches are written again."""
    path = new_path(spark, "history")
    loads = [profile.header_only(R.events_by_day(spark, d)), profile.header_only(R.orders_by_month(spark, d))]
    H.store(profile.fingerprint_loads(loads), path)
    H.delete_where(spark, path, H.matching("events", "app", is_synthetic=False, computed_from=R.moment("2024-01-20 00:00:00")))
    return H.read_history(spark, path).select("dataset_id", "table_name", _day(), "row_count")


@query
def baseline_capture(spark, d):
    """Five staggered copies of a live profile, each with its own id."""
    now = R.moment(R.AS_OF)
    live = profile.fingerprints(read_table(spark, d, "orders"), "main", "orders", now, per_sync=False)
    copies = H.replicate(live, H.capture_offsets(), now)
    ids = copies.groupBy("table_name").agg(F.count_distinct("fingerprint_id").alias("ids"))
    return copies.join(ids, "table_name").select(
        "table_name", _day(), "row_count", "is_synthetic", F.size("columns").alias("columns"), "ids"
    )


def _covered(spark, d):
    """Tables with a fingerprint in a stored history."""
    path = new_path(spark, "history")
    H.store(profile.fingerprint_loads(R.baseline_loads(spark, d)), path)
    return H.covered_tables(H.read_history(spark, path))


@query
def covered_tables(spark, d):
    return _covered(spark, d)


# --- drift -----------------------------------------------------------------------------------------------------


def _profiled(*loads):
    return stage(profile.fingerprint_loads(list(loads)), "fingerprints")


def _loads(spark, d):
    return [R.events_by_day(spark, d), R.orders_by_month(spark, d), R.lineitem_by_month(spark, d), R.documents_by_source(spark, d)]


def _histories(spark, d):
    return _profiled(*_loads(spark, d))


def _rolling_reports(fps):
    return drift.compare(drift.rolling_members(fps))


def _rename_members(spark, d):
    current, history = R.rename_scenario(spark, d)
    return drift.recent_members(current, history)


def _rename_reports(spark, d):
    return drift.compare(_rename_members(spark, d))


def _rename_and_daily_reports(spark, d):
    daily = drift.rolling_members(_profiled(R.events_by_day(spark, d)))
    return drift.compare(_rename_members(spark, d).unionByName(daily))


@query
def psi_daily(spark, d):
    """Stability index of every categorical column of the daily and monthly loads against the seven before."""
    rows = drift.column_drifts(_rolling_reports(_histories(spark, d)))
    return rows.where("drift_type = 'PSI_CATEGORICAL'").select(
        "dataset_id", "table_name", _day(), "column_name", "psi_score", "is_anomalous"
    )


@query
def numeric_shift_daily(spark, d):
    rows = drift.column_drifts(_rolling_reports(_histories(spark, d)))
    return rows.where("drift_type = 'PSI_NUMERIC'").select(
        "dataset_id",
        "table_name",
        _day(),
        "column_name",
        F.round("psi_score", 6).alias("score"),
        F.col("current_value").cast("double").alias("current_mean"),
        F.col("baseline_value").cast("double").alias("baseline_mean"),
        "is_anomalous",
    )


@query
def null_shift(spark, d):
    fps = _profiled(R.documents_by_source(spark, d))
    rows = drift.column_drifts(_rolling_reports(fps)).where("drift_type = 'NULL_PCT_CHANGE'")
    return rows.select(_day(), "column_name", F.round("psi_score", 6).alias("null_shift"), "is_anomalous")


@query
def row_count_z(spark, d):
    fps = _profiled(*[profile.header_only(load) for load in _loads(spark, d)])
    rows = _rolling_reports(fps).where("status = 'compared'")
    return rows.select("dataset_id", "table_name", _day(), "row_count", "baseline_count", "row_count_z_score")


@query
def schema_delta(spark, d):
    """Columns that come, go and change their type between daily loads."""
    events = read_table(spark, d, "events")
    day = F.col("ts").cast("date").cast("timestamp_ntz")
    cut = R.moment("2024-01-15 00:00:00")
    old = events.where(F.col("ts") < cut).select("ts", "event_type", "value", "user_id")
    new = events.where(F.col("ts") >= cut).select(
        "ts", "event_type", F.col("user_id").cast("string").alias("user_id"), "props"
    )
    fps = _profiled(
        *[
            profile.Load(df, "app", "events", day, profile_columns=[c for c in df.columns if c != "ts"])
            for df in (old, new)
        ]
    )
    return (
        _rolling_reports(fps)
        .where("status = 'compared'")
        .select(
            _day(), _joined("columns_added"), _joined("columns_removed"), _joined("columns_type_changed"), "is_anomalous",
            F.coalesce(F.regexp_extract("anomaly_reason", "(columns .*)$", 1), F.lit("")).alias("columns_reason"),
        )
    )


@query
def drift_report(spark, d):
    """One verdict per table and load."""
    reports = _rolling_reports(_histories(spark, d))
    return reports.select(
        "dataset_id",
        "table_name",
        _day(),
        "status",
        "row_count",
        "baseline_count",
        "max_psi_column",
        "max_psi_score",
        "psi_band",
        "row_count_z_score",
        "is_anomalous",
        "anomaly_reason",
    )


@query
def latest_check(spark, d):
    """The memory step: the newest load of each table against its stored recent past."""
    fps = _histories(spark, d)
    newest = H.recent(fps, 1).drop("recency")
    older = fps.join(newest.select("fingerprint_id"), "fingerprint_id", "left_anti")
    return drift.check_tables(newest, older).select(
        "dataset_id", "table_name", _day(), "baseline_count", "max_psi_column", "max_psi_score", "threshold_multiple",
        "row_count_z_score", "is_anomalous",
    )


@query
def value_shifts(spark, d):
    reports = _rename_and_daily_reports(spark, d)
    return drift.value_shifts(reports).select(
        "dataset_id", "table_name", _day(), "column_name", "value", "shift",
        F.round("current", 6).alias("current_share"), F.round("baseline", 6).alias("baseline_share"),
    )


@query
def leading_values(spark, d):
    reports = _rolling_reports(_profiled(R.orders_by_month(spark, d)))
    return drift.leading_values(reports).select(
        _day(), "column_name", "side", "value", F.round("share", 6).alias("share")
    )


@query
def top_movers(spark, d):
    return drift.top_movers(_rename_reports(spark, d)).select(
        "dataset_id", "table_name", "column_name", "value", "current_pct", "baseline_pct",
        F.round("delta", 6).alias("delta"),
    )


# --- triage ----------------------------------------------------------------------------------------------------


@query
def rename_pairs(spark, d):
    return triage.rename_pairs(_rename_reports(spark, d)).select(
        "dataset_id", "table_name", "column_name", "old_value", "new_value",
        F.round("old_share", 6).alias("old_share"), F.round("new_share", 6).alias("new_share"),
    )


@query
def drift_class(spark, d):
    """Class and next step of every check of the rename scenario and of the daily event loads."""
    reports = stage(_rename_and_daily_reports(spark, d), "reports")
    return triage.classify(reports).select(
        "dataset_id", "table_name", _day(), "classification", "next_step", _joined("affected_columns"),
        "renamed_values", "vanished_values", "new_values", "null_flag", "others_clean",
    )


@query
def stale_literals(spark, d):
    """Models whose SQL still filters on a renamed value, with the corrected SQL."""
    nodes = stage(manifest_nodes(R.customer_manifests(spark, d)), "nodes")
    pairs = stage(triage.rename_pairs(_rename_reports(spark, d)), "pairs")
    requests = pairs.select(
        F.col("table_name").alias("source_table"), F.col("column_name").alias("changed_column")
    ).distinct()
    starts = stage(lineage.find_sources(nodes, requests), "starts")
    blast = lineage.blast_radius(nodes, lineage.edges(nodes), starts)
    return triage.stale_literals(pairs, blast, nodes).select(
        "table_name", "column_name", "model_name", "file_path", "original_snippet", "fixed_snippet", "fixed_sql"
    )


def _traced(spark, d, requests):
    nodes = stage(manifest_nodes(R.renaming_manifests(spark, d)), "nodes")
    starts = stage(lineage.find_sources(nodes, requests), "starts")
    facts = stage(columns.column_facts(nodes), "facts")
    return nodes, starts, facts, columns.trace(facts, starts)


def _region_request(spark):
    return spark.range(1).select(F.lit("region").alias("source_table"), F.lit("r_name").alias("changed_column"))


@query
def column_trace(spark, d):
    """The names that the region's name has in every model it reaches, and whether it gets there as it is."""
    _, _, _, traced = _traced(spark, d, _region_request(spark))
    return traced.where("part = 0").select("graph", "uid", "column", "exact")


@query
def traced_blast(spark, d):
    """Blast radius with the column found by its own name in the text, and under the names it goes on under."""
    nodes, starts, facts, traced = _traced(spark, d, _region_request(spark))
    blast = lineage.blast_radius(nodes, lineage.edges(nodes), starts)
    return columns.flag_traced(blast, facts, traced).select(
        "graph", "uid", "hop", "references_column", "traces_column"
    )


def _broken(spark, d):
    pairs = stage(triage.rename_pairs(_rename_reports(spark, d)), "pairs")
    requests = pairs.select(
        F.col("table_name").alias("source_table"), F.col("column_name").alias("changed_column")
    ).distinct()
    nodes, _, facts, traced = _traced(spark, d, requests)
    return columns.broken_literals(pairs, facts, traced, nodes), nodes


@query
def broken_literals(spark, d):
    """Literals of a renamed value, wherever the column goes by another name."""
    broken, _ = _broken(spark, d)
    return broken.select(
        "table_name", "column_name", "model_name", "file_path", "column_there", "form", "certain", "old_value", "new_value",
        "original_snippet", "fixed_snippet", "fixed_sql",
    )


@query
def repaired_models(spark, d):
    """Every model with a broken literal, with all its literals replaced."""
    broken, nodes = _broken(spark, d)
    return columns.repaired_models(stage(broken, "broken"), nodes).drop("graph")


@query
def impact_running(spark, d):
    """Time to detect and hours saved, with running totals over all incidents."""
    spans = R.incident_events(spark, d).groupBy("report_id").agg(
        F.min("at").alias("received_at"), F.max("at").alias("detected_at")
    )
    return triage.detection_impact(spans).select(
        "report_id", "time_to_detect_seconds", "hours_saved_this_incident", "incidents_caught_total", "total_hours_saved"
    )


def _verdicts(spark, d):
    reports = stage(_rename_reports(spark, d), "reports")
    classes = stage(triage.classify(reports), "classes")
    waiting = classes.where("next_step = 'pending_approval'")
    opened = waiting.select("report_id", F.col("computed_at").alias("opened_at"))
    approved = waiting.where("dataset_id = 'market'").select(
        "report_id", F.timestamp_add("HOUR", F.lit(1), "computed_at").alias("at"), F.lit(1).cast("bigint").alias("seq"),
        F.lit(incidents.APPROVE).alias("action"),
    )
    received = opened.select("report_id", F.col("opened_at").alias("received_at"))
    impact = triage.detection_impact(
        received.withColumn("detected_at", F.timestamp_add("SECOND", F.lit(R.DETECTION_SECONDS), "received_at"))
    )
    return triage.verdicts(reports, classes, incidents.decisions(opened, approved), impact)


@query
def verdict_rows(spark, d):
    """Open verdicts: report, class, incident state and impact in one row."""
    return monitor.in_state(_verdicts(spark, d), K.PENDING).select(
        "dataset_id", "table_name", "classification", _joined("affected_columns"), "max_psi_column", "max_psi_score",
        "psi_threshold", "state",
        F.size("max_psi_baseline_dist").alias("baseline_values"), F.size("max_psi_current_dist").alias("current_values"),
        "time_to_detect_seconds", "hours_saved_this_incident",
    )


@query
def sync_check(spark, d):
    """The main path in one step: store a past, load the renamed tables, compare, classify, trace and suggest fixes."""
    after, before = R.rename_loads(spark, d)
    path = new_path(spark, "history")
    H.store(H.replicate(profile.fingerprint_loads(before), R.BASELINE_OFFSETS, R.moment(R.AS_OF)), path)
    nodes = stage(manifest_nodes(R.customer_manifests(spark, d)), "nodes")
    result = check_syncs(spark, after, path, nodes=nodes)
    downstream = result.blast.groupBy(F.col("source_table").alias("table_name")).agg(F.count(F.lit(1)).alias("downstream"))
    fixes = result.fixes.groupBy("table_name").agg(F.count(F.lit(1)).alias("fixes"))
    zero = F.lit(0).cast("bigint")
    return (
        result.classes.join(result.reports.select("report_id", "max_psi_column", "max_psi_score"), "report_id")
        .join(downstream, "table_name", "left")
        .join(fixes, "table_name", "left")
        .select(
            "dataset_id", "table_name", "classification", "next_step", "max_psi_column", "max_psi_score",
            F.coalesce("downstream", zero).alias("downstream"), F.coalesce("fixes", zero).alias("fixes"),
        )
    )


# --- risk ------------------------------------------------------------------------------------------------------


@query
def past_anomalies(spark, d):
    """Past loads that stand out against the other past loads of their table."""
    newest = H.recent(_histories(spark, d), K.RISK_SYNCS).where("recency > 1")
    return risk.past_anomalies(newest).select("dataset_id", "table_name", _day(), F.round("psi", 5).alias("psi"))


@query
def risk_profile(spark, d):
    return risk.risk_profiles(_histories(spark, d), R.moment(R.AS_OF))


@query
def risk_forecast(spark, d):
    """Risk of every watched table, drift log included; one watched table has no history, one cannot be read."""
    fps = _histories(spark, d)
    log = stage(drift.drift_log(_rolling_reports(fps)), "log")
    known = H.covered_tables(fps).select("dataset_id", "table_name", F.lit(True).alias("readable"))
    extra = spark.createDataFrame(
        [("app", "never_loaded", True), ("app", "unreadable", False)], "dataset_id string, table_name string, readable boolean"
    )
    as_of = R.moment(R.AS_OF)
    return risk.risk_forecast(
        known.unionByName(extra), risk.risk_profiles(fps, as_of), risk.log_signals(log, as_of)
    )


# --- lineage ---------------------------------------------------------------------------------------------------


def _graph(spark, d, ends):
    nodes = lineage.stage_nodes(R.key_graph(spark, d))
    return nodes, lineage.stage_edges(nodes, ends)


def _region_blast(spark, d, ends=False):
    nodes, edge_rows = _graph(spark, d, ends)
    starts = stage(lineage.find_sources(nodes, R.region_starts(spark, d)), "starts")
    return nodes, edge_rows, starts


@query
def manifest_node_table(spark, d):
    """Nodes read from one manifest document per customer."""
    nodes = manifest_nodes(R.customer_manifests(spark, d))
    return nodes.select(
        "graph", "uid", "name", "resource_type", "source_name", "owner_name", "owner_email", "original_file_path",
        "raw_code", _joined("depends_on"),
    )


@query
def lineage_edges(spark, d):
    return lineage.edges(stage(R.key_graph(spark, d), "nodes")).select("src", "dst")


@query
def blast_radius(spark, d):
    """Everything downstream of every region at once."""
    nodes, edge_rows, starts = _region_blast(spark, d)
    return lineage.blast_radius(nodes, edge_rows, starts).select(
        "source_table", "uid", "hop", "node_type", "name", "severity", "owner", "references_column"
    )


@query
def blast_edges(spark, d):
    nodes, edge_rows, starts = _region_blast(spark, d)
    reached = lineage.reachable(edge_rows, starts)
    return lineage.blast_edges(nodes, edge_rows, starts, reached).drop("graph")


@query
def blast_display(spark, d):
    """Distinct display rows (flagged source, then downstream assets) with how many nodes each stands for."""
    nodes, edge_rows, starts = _region_blast(spark, d)
    rows = lineage.display_nodes(lineage.blast_radius(nodes, edge_rows, starts), starts).drop("graph")
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("nodes"))


@query
def blast_summary(spark, d):
    """Summary lines of each region's blast radius, and of as many unknown sources."""
    nodes, edge_rows, starts = _region_blast(spark, d)
    unknown = read_table(spark, d, "region").select(
        F.concat(F.lit("not "), "r_name").alias("source_table"), F.lit("r_name").alias("changed_column")
    )
    blast = lineage.blast_radius(nodes, edge_rows, starts)
    return lineage.summary_lines(R.region_starts(spark, d).unionByName(unknown), blast).select("source_table", "uid", "line")


@query
def owners(spark, d):
    nodes, edge_rows, starts = _region_blast(spark, d)
    return lineage.affected_owners(lineage.blast_radius(nodes, edge_rows, starts))


@query
def reach_changes(spark, d):
    """Pairs whose hop changes when customers of one segment move up to their region and those of another go.

    Of the orders of moved customers the shipments come nearer too, unless the supplier's way was as short.
    """
    nodes, edge_rows, starts = _region_blast(spark, d, ends=True)
    tops = stage(nodes.where("resource_type = 'source'").select(F.col("uid").alias("src")), "tops")
    above = stage(edge_rows.join(tops, "src").select("graph", F.col("src").alias("top"), F.col("dst").alias("src")), "above")

    def of_segment(*names):
        return nodes.where(F.col("name").isin(*[f"segment {name}" for name in names])).select(F.col("uid").alias("dst"))

    moved = edge_rows.join(of_segment("BUILDING"), "dst", "left_semi").join(above, ["graph", "src"])
    changed = edge_rows.join(of_segment("BUILDING", "MACHINERY"), "dst", "left_anti").unionByName(
        moved.select("graph", F.col("top").alias("src"), "dst")
    )
    reached = lineage.reachable(edge_rows, starts)
    return reach.reach_changes(reached, edge_rows, lineage.lay_edges(changed), starts).drop("graph")


@query
def hop_layers(spark, d):
    nodes, edge_rows, starts = _region_blast(spark, d)
    return lineage.hop_layers(lineage.reachable(edge_rows, starts)).drop("graph")


@query
def hop_positions(spark, d):
    nodes, edge_rows, starts = _region_blast(spark, d)
    return lineage.hop_positions(lineage.reachable(edge_rows, starts)).drop("graph")


@query
def model_sql(spark, d):
    """SQL of the models named after nations and segments."""
    nodes = R.key_graph(spark, d)
    names = read_table(spark, d, "nation").select(F.col("n_name").alias("name")).unionByName(
        read_table(spark, d, "customer").select(F.concat(F.lit("segment "), "c_mktsegment").alias("name")).distinct()
    )
    return lineage.models_sql(nodes, names).select("uid", "name", "file_path", "sql")


# --- KPIs ------------------------------------------------------------------------------------------------------


@query
def kpi_by_label(spark, d):
    return monitor.kpi_by_label(R.facts(spark, d), R.stages(spark, d), "EUROPE")


@query
def kpi_after_rename(spark, d):
    """The silent failure itself: after the rename the same KPI is 0."""
    renamed = selection.relabel(R.stages(spark, d), "label", *R.RENAMED_REGION)
    return monitor.kpi_by_label(R.facts(spark, d), renamed, "EUROPE")


@query
def kpi_open_dates(spark, d):
    return monitor.kpi_open(R.facts(spark, d), R.stages(spark, d), "EUROPE", R.moment(R.OPEN_FROM))


@query
def kpi_by_id(spark, d):
    """Value at risk, by the stable ids of the affected stages."""
    return monitor.value_at_risk(R.facts(spark, d), R.stages(spark, d), [0, 3])


@query
def staging_model(spark, d):
    rows = monitor.staged_facts(R.facts(spark, d), R.stages(spark, d), "EUROPE")
    return rows.select(
        "deal_id", "stage_id", "stage_label", F.col("amount").cast("double").alias("amount"),
        F.col("close_date").cast("date").cast("string").alias("close_day"),
    )


@query
def mart_by_stage(spark, d):
    return monitor.mart_by_stage(monitor.staged_facts(R.facts(spark, d), R.stages(spark, d)), R.moment(R.OPEN_FROM))


@query
def stage_totals(spark, d):
    return monitor.stage_totals(R.facts(spark, d))


@query
def relabel(spark, d):
    """Many renames at once by a mapping table, counted per new label."""
    customer = read_table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    mapping = read_table(spark, d, "region").select(
        F.lit(R.RENAMED_SEGMENT[0]).alias("old_value"), F.lit(R.RENAMED_SEGMENT[1]).alias("new_value")
    ).distinct()
    renamed = selection.relabel_all(customer, "c_mktsegment", mapping)
    touched = selection.affected_rows(customer, "c_mktsegment", R.RENAMED_SEGMENT[0])
    counts = renamed.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("rows"))
    return counts.withColumn("affected_rows", touched.scalar())


# --- monitoring ------------------------------------------------------------------------------------------------


@query
def connector_table_list(spark, d):
    return connector_tables(R.connector_configs(spark, d)).select("connector_id", "schema_name", "table_name", "enabled")


@query
def schema_lookup(spark, d):
    """The first schema of each table in the order of the document."""
    return schema_of_tables(connector_tables(R.ordered_configs(spark, d)))


@query
def coverage(spark, d):
    return monitor.in_display_order(monitor.coverage(R.configured_tables(spark, d), _covered(spark, d), R.COVERED_DATASET))


@query
def coverage_summary(spark, d):
    return monitor.coverage_summary(monitor.coverage(R.configured_tables(spark, d), _covered(spark, d), R.COVERED_DATASET))


def _event_log(spark, d):
    return drift.drift_log(_rolling_reports(_profiled(R.events_by_day(spark, d))))


@query
def drift_trend(spark, d):
    log = drift.drift_log(_rolling_reports(_histories(spark, d)))
    # report ids differ between engines, so checks of the same day are told apart by table here
    named = log.withColumn("report_id", F.concat_ws(".", "dataset_id", "table_name"))
    return monitor.drift_trend(named).select(
        _day("logged_at"), F.col("report_id").alias("table_key"), "psi", "column_name", "is_anomalous"
    )


@query
def monitor_summary(spark, d):
    log = stage(_event_log(spark, d), "log")
    states = incidents.decisions(R.opened_incidents(spark, d), R.incident_events(spark, d))
    watched = _covered(spark, d)
    return monitor.summary(log, states, watched, "events").withColumn("latest_checked_at", R.day_text("latest_checked_at"))


@query
def activity_feed(spark, d):
    activity = read_table(spark, d, "events").select(
        F.col("ts").alias("at"), F.col("event_id").alias("seq"), F.col("event_type").alias("agent"), F.col("props").alias("message")
    )
    return monitor.activity_feed(activity).select("seq", "agent", "message")


@query
def quarantined(spark, d):
    states = incidents.decisions(R.opened_incidents(spark, d), R.incident_events(spark, d))
    return incidents.quarantined(states, R.merge_states(spark, d)).select("report_id", "pr_number", "pr_url")


# --- syncs and incidents ---------------------------------------------------------------------------------------


@query
def sync_event_intake(spark, d):
    events = sync_events(R.raw_sync_events(spark, d))
    return events.groupBy("dataset_id", "table_name", "status").agg(
        F.count(F.lit(1)).alias("events"), F.count_distinct("connector_id").alias("connectors")
    )


@query
def sync_changes(spark, d):
    """Polls at which a connector shows a new sync."""
    return incidents.new_syncs(R.polls(spark, d)).select("connector_id", "seq", "last_seen", "succeeded_at")


@query
def sync_fan_out(spark, d):
    """Every accepted sync event checks every watched table."""
    watched = read_table(spark, d, "region").select(F.lit("crm").alias("dataset_id"), F.col("r_name").alias("table_name"))
    syncs = accepted(sync_events(R.raw_sync_events(spark, d))).select("connector_id", "received_at")
    counted = syncs.groupBy("connector_id").agg(F.count(F.lit(1)).alias("checks"))
    return fan_out(counted, watched).select("connector_id", "dataset_id", "table_name", "checks")


@query
def incident_state(spark, d):
    states = incidents.decisions(R.opened_incidents(spark, d), R.incident_events(spark, d))
    return states.select("report_id", "state", "decision", "decided_seq", "reenabled_seq")


@query
def incident_log(spark, d):
    """The event log as stored, by day: an append, then a pruned read."""
    path = new_path(spark, "incident-log")
    incidents.append_events(R.incident_events(spark, d), path)
    stored = spark.read.parquet(path).where(F.col("event_date") >= F.lit("2024-01-10").cast("date"))
    return stored.groupBy(F.col("event_date").cast("string").alias("event_day"), "action").agg(
        F.count(F.lit(1)).alias("events"), F.count_distinct("report_id").alias("incidents")
    )


@query
def incident_log_replayed(spark, d):
    """The event log after a batch came twice: it holds every event once."""
    path, events = new_path(spark, "incident-log"), R.incident_events(spark, d)
    incidents.append_events(events.where("action <> 'dismiss'"), path)
    incidents.append_events(events, path)
    return spark.read.parquet(path).groupBy(F.col("event_date").cast("string").alias("event_day"), "action").agg(
        F.count(F.lit(1)).alias("events"), F.count_distinct("report_id").alias("incidents")
    )


@query
def event_outcomes(spark, d):
    events = R.incident_events(spark, d)
    states = incidents.decisions(R.opened_incidents(spark, d), events)
    return incidents.event_outcomes(states, events).select("report_id", "seq", "action", "outcome")


@query
def merge_checks(spark, d):
    """Status of the fix of every incident that was ever asked about."""
    events = R.incident_events(spark, d)
    states = incidents.decisions(R.opened_incidents(spark, d), events)
    requested = events.select("report_id").distinct()
    return incidents.check_merges(requested, states, R.merge_states(spark, d)).select(
        "report_id", "status", "pr_number", "pr_state", "pr_url"
    )


@query
def auto_reenabled(spark, d):
    """Incident states after the merged fixes re-enabled their tables."""
    events = R.incident_events(spark, d)
    opened = R.opened_incidents(spark, d)
    states = incidents.decisions(opened, events)
    checked = incidents.check_merges(events.select("report_id").distinct(), states, R.merge_states(spark, d))
    # the merges go back into the log as events, and the log decides; a merge counts from the decision on
    held = states.select("report_id", "decided_at")
    merged = incidents.merge_events(checked, first_seq=1 << 40).join(held, "report_id").withColumn("at", F.greatest("at", "decided_at"))
    folded = events.unionByName(merged.select(*events.columns))
    return incidents.decisions(opened, folded).groupBy("state").agg(F.count(F.lit(1)).alias("incidents"))


@query
def resolution_times(spark, d):
    states = incidents.decisions(R.opened_incidents(spark, d), R.incident_events(spark, d))
    return incidents.resolution_times(states).select("report_id", "elapsed_seconds", "elapsed")


# --- streams ---------------------------------------------------------------------------------------------------


def _event_stream(spark, d):
    schema = read_table(spark, d, "events").schema
    return spark.readStream.schema(schema).parquet(f"{d.rstrip('/')}/events*.parquet")


@query
def stream_daily_drift(spark, d):
    """The drift log of the daily event windows, kept by a streaming query."""
    from ..streaming.drift_check import check_stream, current_log

    root = new_path(spark, "stream-drift")
    deleted = F.when(F.col("event_type") == "error", True).alias(K.DELETED_FLAG)
    stream = _event_stream(spark, d).select("*", deleted)
    check_stream(
        stream, root, "app", "events", "ts", profile_columns=["event_type", "value", "user_id", "props"], available_now=True
    ).awaitTermination()
    return current_log(spark, root).select(_day("logged_at"), "psi", "column_name", "is_anomalous")


@query
def stream_sync_changes(spark, d):
    from ..streaming.sync_watch import detected_changes, watch_syncs

    root = new_path(spark, "stream-syncs")
    stream = _event_stream(spark, d)
    watch_syncs(R.polls_of(stream), root, available_now=True).awaitTermination()
    return detected_changes(spark, root).select("connector_id", "seq", "last_seen", "succeeded_at")


@query
def stream_incident_state(spark, d):
    from ..streaming.incident_state import current_state, track_incidents

    root, opened = new_path(spark, "stream-incidents"), R.opened_incidents(spark, d)
    track_incidents(R.incident_events_of(_event_stream(spark, d)), opened, root, available_now=True).awaitTermination()
    return current_state(spark, root, opened).select("report_id", "state", "decision", "decided_seq", "reenabled_seq")


@query
def stream_incident_log(spark, d):
    """The event log written by a stream whose source delivers every event twice."""
    from ..streaming.event_log import LOG, log_events

    root, twice = new_path(spark, "stream-log"), F.explode(F.array(F.lit(1), F.lit(2))).alias("delivery")
    events = R.incident_events_of(_event_stream(spark, d)).select("*", twice)
    log_events(events, root, lateness="400 days", available_now=True).awaitTermination()
    return spark.read.parquet(f"{root}/{LOG}").groupBy(F.col("event_date").cast("string").alias("event_day"), "action").agg(
        F.count(F.lit(1)).alias("events"), F.count_distinct("report_id").alias("incidents")
    )


@query
def stream_merged_incidents(spark, d):
    """Incidents closed by the merge of their fix, and how long that took: state changes and merges joined as streams."""
    from ..streaming.incident_state import stream_transitions, track_incidents
    from ..streaming.merges import close_on_merge, closed_by_merge

    root, opened = new_path(spark, "stream-merges"), R.opened_incidents(spark, d)
    merges = R.merge_states(spark, d)
    merges.write.parquet(f"{root}/merges")
    track_incidents(R.incident_events_of(_event_stream(spark, d)), opened, root, available_now=True).awaitTermination()
    merged = spark.readStream.schema(merges.schema).parquet(f"{root}/merges")
    close_on_merge(stream_transitions(spark, root), merged, root, available_now=True, horizon="400 days").awaitTermination()
    closed = closed_by_merge(spark, root, opened).where(F.col("status") == K.REENABLED)
    return closed.select("report_id", "pr_number", "elapsed_seconds", R.micros_of("closed_at").alias("closed_us"))


@query
def stream_staleness(spark, d):
    """Alarms of connectors that showed no event for two days, by timers."""
    from ..streaming.staleness import raised_alarms, watch_staleness

    root = new_path(spark, "stream-staleness")
    loads = R.polls_of(_event_stream(spark, d)).select(F.col("connector_id").alias("table_name"), F.col("polled_at").alias("loaded_at"))
    watch_staleness(loads, root, available_now=True, threshold_seconds=R.SILENT_SECONDS, lateness="0 seconds").awaitTermination()
    alarms = raised_alarms(spark, root)
    return alarms.select("table_name", "alarm", R.micros_of("last_loaded_at").alias("loaded_us"), R.micros_of("at").alias("at_us"))

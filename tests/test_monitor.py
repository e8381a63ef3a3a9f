import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from driftlens.operators import monitor
from driftlens.sources import history as H
from driftlens.sources.connectors import connector_tables, schema_of_tables
from driftlens.sources.sync_events import accepted, fan_out, read_sync_events
from driftlens.sources.tables import read_watch_list, table_metadata, watch_list

from scenario import MODES, column, fingerprint, frame

NOW = datetime(2026, 5, 1, 12)


def test_freshness(spark):
    rows = [("fresh", NOW - timedelta(hours=1), 5), ("edge", NOW - timedelta(seconds=21600), 6), ("old", NOW - timedelta(hours=7), 7), ("warm", NOW - timedelta(hours=5), 8)]
    metadata = spark.createDataFrame(rows, "table_name string, last_modified_at timestamp, row_count bigint")
    wanted = spark.createDataFrame([(t,) for t in ("fresh", "edge", "old", "warm", "absent")], "table_name string")
    ages = monitor.freshness(wanted, metadata, F.lit(NOW.isoformat()).cast("timestamp"))
    got = {r.table_name: r for r in monitor.freshness_bands(ages).collect()}
    assert {t: r.is_stale for t, r in got.items()} == {"fresh": False, "edge": False, "old": True, "warm": False, "absent": False}
    assert {t: r.band for t, r in got.items()} == {"fresh": "green", "edge": "red", "old": "red", "warm": "amber", "absent": None}
    assert got["old"].used_pct == 100.0 and got["absent"].row_count is None
    assert monitor.any_stale(ages).first()[0] is True
    assert monitor.any_stale(ages.where("table_name = 'fresh'")).first()[0] is False


def test_table_metadata_of_files(spark, tmp_path):
    spark.range(7).write.parquet(str(tmp_path / "a"))
    row = table_metadata({"a": spark.read.parquet(str(tmp_path / "a"))}).first()
    assert row.row_count == 7 and abs((datetime.now() - row.last_modified_at).total_seconds()) < 86400


def test_watch_lists_read_alike(spark, tmp_path):
    entries = [
        {"dataset": "crm", "table": "depot", "priority": "critical", "profile_columns": ["mode"]},
        {"dataset": "crm", "table": "contact", "priority": "standard"},
    ]
    (tmp_path / "w.json").write_text(json.dumps({"watched_tables": entries}, indent=1))
    lines = "".join(f"  - {json.dumps(e)}\n" for e in entries)
    (tmp_path / "w.yaml").write_text("watched_tables:\n" + lines)
    rows = [read_watch_list(spark, str(tmp_path / f)).collect() for f in ("w.json", "w.yaml")]
    assert rows[0] == rows[1]
    assert [(r.dataset_id, r.table_name, r.priority, r.profile_columns) for r in rows[0]] == [
        ("crm", "depot", "critical", ["mode"]),
        ("crm", "contact", "standard", None),
    ]


def test_connector_config_skips_what_is_not_an_object(spark):
    config = {"data": {"schemas": {"crm": {"tables": {"depot": {"enabled": True}, "parcel": {}, "bad": 5, "off": {"enabled": False}}}, "odd": "x", "ads": {"tables": {"depot": {"enabled": True}}}, "empty": {}}}}
    configs = spark.createDataFrame([("c", json.dumps(config)), ("d", "{}")], "connector_id string, config string")
    tables = connector_tables(configs)
    assert {(r.schema_name, r.table_name, r.enabled) for r in tables.collect()} == {("crm", "depot", True), ("crm", "parcel", False), ("crm", "off", False), ("ads", "depot", True)}
    assert {r.table_name: r.schema_name for r in schema_of_tables(tables).collect()} == {"depot": "crm", "parcel": "crm", "off": "crm"}
    covered = spark.createDataFrame([("crm", "parcel"), ("other", "off")], "dataset_id string, table_name string")
    rows = monitor.in_display_order(monitor.coverage(tables, covered, "crm")).collect()
    # a table of the same name in another dataset covers nothing
    assert [(r.schema_name, r.table_name, r.has_baseline) for r in rows] == [("crm", "parcel", True), ("ads", "depot", False), ("crm", "depot", False), ("crm", "off", False)]
    assert tuple(monitor.coverage_summary(monitor.coverage(tables, covered, "crm")).first()) == ("c", 4, 1, 25)
    elsewhere = monitor.coverage(tables, covered, "other").where("has_baseline").collect()
    assert [(r.schema_name, r.table_name) for r in elsewhere] == [("crm", "off")]


@pytest.mark.parametrize("total, monitored, pct", [(8, 1, 12), (8, 3, 38), (3, 1, 33), (1, 1, 100)])
def test_coverage_rounds_half_to_even(spark, total, monitored, pct):
    rows = spark.range(total).select(F.lit("c").alias("connector_id"), (F.col("id") < monitored).alias("has_baseline"))
    assert monitor.coverage_summary(rows).first().coverage_pct == pct


def test_sync_events(spark, tmp_path):
    events = [
        {"event": "sync_end", "connector_id": "c"},
        {"event": "sync_start", "connector_id": "c", "schema": "s", "table": "t"},
        {"event": "sync_end", "connector_id": "d", "schema": "s", "table": "t"},
    ]
    (tmp_path / "e.json").write_text("\n".join(json.dumps(e) for e in events))
    rows = read_sync_events(spark, str(tmp_path / "e.json"))
    assert sorted((r.connector_id, r.dataset_id, r.table_name, r.status) for r in rows.collect()) == [
        ("c", "hubspot", "deal_pipeline_stage", "accepted"),
        ("c", "s", "t", "ignored"),
        ("d", "s", "t", "accepted"),
    ]
    watched = spark.createDataFrame([("x", "t1"), ("x", "t2")], "dataset_id string, table_name string")
    spread = fan_out(accepted(rows).select("connector_id"), watched).collect()
    assert sorted((r.connector_id, r.table_name) for r in spread) == [("c", "t1"), ("c", "t2"), ("d", "t1"), ("d", "t2")]


def log_frame(spark, rows):
    return spark.createDataFrame(
        rows, "logged_at timestamp, psi double, column_name string, dataset_id string, table_name string, is_anomalous boolean, report_id string"
    )


def test_trend_and_summary(spark):
    log = log_frame(spark, [(NOW + timedelta(minutes=i), i / 100, "c", "crm", "parcel" if i else "depot", i > 25, f"r{i:03d}") for i in range(300)])
    trend = monitor.drift_trend(log).collect()
    assert len(trend) == 200 and [trend[0].report_id, trend[-1].report_id] == ["r100", "r299"]
    states = spark.createDataFrame([("a", "pending"), ("b", "quarantined"), ("c", "pending")], "report_id string, state string")
    watched = spark.createDataFrame([("depot",), ("parcel",)], "table_name string")
    preferred = monitor.summary(log, states, watched, "depot").first()
    assert (preferred.tables_watched, preferred.active_incidents, preferred.latest_psi, preferred.is_anomalous) == (2, 2, 0.0, False)
    fallback = monitor.summary(log, states, watched, "nowhere").first()
    assert (fallback.latest_psi, fallback.is_anomalous) == (2.99, True)
    empty = monitor.summary(log.limit(0), states.limit(0), watched, "depot").first()
    assert (empty.active_incidents, empty.latest_psi, empty.is_anomalous) == (0, None, False)


def test_activity_and_lookups(spark):
    feed = spark.range(500).select(F.timestamp_seconds("id").alias("at"), F.col("id").alias("seq"))
    assert [r.seq for r in monitor.activity_feed(feed).collect()] == list(range(450, 500))
    assert len(monitor.activity_feed(feed, limit=300).collect()) == 100
    verdicts = spark.createDataFrame([("a", "pending"), ("b", "dismissed")], "report_id string, state string")
    assert monitor.pending_verdict(verdicts, "a").count() == 1
    assert monitor.pending_verdict(verdicts, "b").count() == 0


@pytest.fixture(scope="module")
def deals(spark):
    rows = [("sent", 100.0, datetime(2026, 6, 1), False), ("sent", 50.0, datetime(2026, 1, 1), False), ("sent", 7.0, NOW, None), ("sent", 9.0, NOW, True), ("won", 30.0, NOW, False), ("lost", 1.0, NOW, False)]
    facts = spark.createDataFrame(rows, "stage_id string, amount double, close_date timestamp, is_deleted boolean")
    stages = spark.createDataFrame([("sent", "Under offer"), ("won", "Won"), ("new", "New")], "stage_id string, label string")
    return facts, stages


def test_kpis(deals):
    facts, stages = deals
    now = F.lit(NOW.isoformat()).cast("timestamp")
    assert tuple(monitor.kpi_by_label(facts, stages, "Under offer").first()) == (150.0, 2)
    assert tuple(monitor.kpi_by_label(facts, stages, "Bid placed").first()) == (0.0, 0)
    assert tuple(monitor.kpi_open(facts, stages, "Under offer", now).first()) == (100.0, 1)
    assert {tuple(r) for r in monitor.value_at_risk(facts, stages, ["sent", "new"]).collect()} == {("sent", 150.0), ("new", 0.0)}
    mart = {tuple(r) for r in monitor.mart_by_stage(monitor.staged_facts(facts, stages), now).collect()}
    assert mart == {("Under offer", 2, 150.0, 100.0), ("Won", 1, 30.0, 30.0)}
    assert [tuple(r) for r in monitor.stage_totals(facts).collect()] == [("sent", 4, 166.0), ("won", 1, 30.0), ("lost", 1, 1.0)]


def test_history_round_trip(spark, tmp_path):
    path = str(tmp_path / "history")
    rows = [fingerprint(f"{t}{i}", t, 1 + i, 7 + i, [column(0, "mode", MODES)], synthetic=i < 2) for t in ("depot", "parcel") for i in range(12)]
    fps = frame(spark, rows)
    H.store(fps.where("computed_at < timestamp_ntz '2026-05-08'"), path)
    H.store(fps, path)
    H.store(fps, path)
    stored = H.read_history(spark, path)
    assert stored.count() == 24
    assert {r.columns[0].distribution["rail"] for r in stored.collect()} == {MODES["rail"]}
    assert H.read_history(spark, path, since="2026-05-11").count() == 4
    newest = H.recent(stored, 3).where("table_name = 'parcel'").orderBy("recency").collect()
    assert [r.fingerprint_id for r in newest] == ["parcel11", "parcel10", "parcel9"]
    assert [r.fingerprint_id for r in H.listing(stored, "crm", "depot", 2).collect()] == ["depot11", "depot10"]
    gone = H.matching("depot", "crm", is_synthetic=False, computed_from=F.lit("2026-05-05").cast("timestamp_ntz"))
    H.rewrite_without(spark, path, gone, str(tmp_path / "clean"))
    clean = H.read_history(spark, str(tmp_path / "clean"))
    assert clean.count() == 24 - 8 and clean.where("table_name = 'parcel'").count() == 12
    assert {r.table_key for r in H.covered_tables(clean).collect()} == {"crm.depot", "crm.parcel"}


def files_of(path):
    return {p for p in path.rglob("*.parquet")}


def test_delete_in_place_rewrites_only_the_dates_it_must(spark, tmp_path):
    path = tmp_path / "history"
    fps = frame(spark, [fingerprint(f"{t}{i}", t, 1 + i, 7 + i, [column(0, "mode", MODES)]) for t in ("depot", "parcel") for i in range(6)])
    H.store(fps.where("not (table_name = 'parcel' and day(computed_at) = 3)"), str(path))
    before = files_of(path)
    H.delete_where(spark, str(path), H.matching("depot", "crm", computed_from=F.lit("2026-05-03").cast("timestamp_ntz")))
    left = H.read_history(spark, str(path))
    assert {(r.table_name, r.computed_at.day) for r in left.collect()} == {("depot", 1), ("depot", 2), *[("parcel", d) for d in (1, 2, 4, 5, 6)]}
    same = {p for p in before if p.parent.name in ("computed_date=2026-05-01", "computed_date=2026-05-02")}
    assert same and same <= files_of(path)
    assert not (path / "computed_date=2026-05-03").exists()  # nothing stays of this date
    assert [p.name for p in path.iterdir() if p.name.startswith("_delete-")] == []
    after = files_of(path)
    H.delete_where(spark, str(path), H.matching("nothing", "crm"))
    assert files_of(path) == after
    H.delete_where(spark, str(path), F.lit(None).cast("boolean"))
    assert files_of(path) == after


@pytest.mark.parametrize("decided", [False, True])
def test_an_interrupted_delete_is_finished_or_forgotten(spark, tmp_path, monkeypatch, decided):
    path = str(tmp_path / "history")
    fps = frame(spark, [fingerprint(f"{t}{i}", t, 1 + i, 7 + i, [column(0, "mode", MODES)]) for t in ("depot", "parcel") for i in range(3)])
    H.store(fps, path)

    def stop(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patched, pytest.raises(RuntimeError):
        if decided:
            patched.setattr(H, "_replace_dates", stop)
        else:
            patched.setattr(type(spark), "createDataFrame", stop)
        H.delete_where(spark, path, H.matching("depot", "crm"))
    assert H.read_history(spark, path).count() == 6
    H.finish_deletes(spark, path)
    assert H.read_history(spark, path).count() == (3 if decided else 6)
    H.finish_deletes(spark, path)
    assert not list((tmp_path / "history").glob("_delete-*"))


def test_rows_without_a_date_can_be_deleted(spark, tmp_path):
    path = str(tmp_path / "history")
    fps = frame(spark, [fingerprint(f"d{i}", "depot", 1 + i, 7 + i, [column(0, "mode", MODES)]) for i in range(2)])
    H.store(fps.withColumn("computed_at", F.when(F.col("fingerprint_id") != "d0", F.col("computed_at"))), path)
    H.delete_where(spark, path, F.col("fingerprint_id") == "d0")
    assert [r.fingerprint_id for r in H.read_history(spark, path).collect()] == ["d1"]


def test_baseline_copies(spark):
    live = frame(spark, [fingerprint("live", "depot", 20, 7, [column(0, "mode", MODES)], synthetic=True)])
    now = F.lit("2026-05-20 00:00:00").cast("timestamp_ntz")
    copies = H.replicate(live, H.capture_offsets(), now).collect()
    assert sorted(r.computed_at.day for r in copies) == [8, 11, 14, 17, 20]
    assert len({r.fingerprint_id for r in copies}) == 5 and not any(r.is_synthetic for r in copies)
    again = H.replicate(live, H.capture_offsets(), now).collect()
    assert {r.fingerprint_id for r in copies} == {r.fingerprint_id for r in again}
    assert len(H.replicate(live, [14, 10, 7, 4, 0], now).collect()) == 5


def test_watch_list_document(spark):
    doc = spark.createDataFrame([([("d", "t", "critical", None, ["a"])],)], "watched_tables array<struct<dataset:string,`table`:string,priority:string,description:string,profile_columns:array<string>>>")
    assert watch_list(doc).first().profile_columns == ["a"]

import json
import os

import pytest
from pyspark.sql import functions as F

from driftlens.operators.profile import Load, fingerprint_loads
from driftlens.operators.selection import relabel
from driftlens.plans.sync_check import check_syncs
from driftlens.sources import history as H
from driftlens.sources.manifest import read_manifest
from driftlens.sources.sync_events import stream_sync_events
from driftlens.streaming.sync_trigger import check_on_sync

from scenario import MODES, MODES_AFTER, ZONES
from test_drift import plain_psi

MANIFEST = os.path.join(os.path.dirname(__file__), "fixtures", "manifest.json")


def at(text):
    return F.lit(text).cast("timestamp_ntz")


@pytest.fixture(scope="module")
def tables(spark):
    depots = [(mode, 900.0 + 35 * i) for mode, share in MODES.items() for i in range(round(share * 100))]
    parcels = [(zone, 2.5 + 0.25 * i) for zone, share in ZONES.items() for i in range(round(share * 100))]
    return spark.createDataFrame(depots, "mode string, floor_area double"), spark.createDataFrame(parcels, "zone string, weight double")


@pytest.fixture(scope="module")
def history(spark, tables, tmp_path_factory):
    depot, parcel = tables
    now = at("2027-03-20 00:00:00")
    live = fingerprint_loads([Load(depot, "crm", "depot", now, per_sync=False), Load(parcel, "crm", "parcel", now, per_sync=False)])
    path = str(tmp_path_factory.mktemp("meta") / "fingerprints")
    H.store(H.replicate(live, H.capture_offsets(), now), path)
    return path


def test_rename_from_load_to_fix(spark, tables, history, tmp_path):
    depot, parcel = tables
    now = at("2027-03-22 12:00:00")
    renamed = relabel(depot, "mode", "rail", "railway")
    loads = [Load(renamed, "crm", "depot", now, per_sync=False), Load(parcel, "crm", "parcel", now, per_sync=False)]
    log = str(tmp_path / "log")
    nodes = read_manifest(spark, MANIFEST).persist()
    opened = str(tmp_path / "incidents")
    result = check_syncs(spark, loads, history, log, nodes, incident_path=opened, detected_after=90)
    check_syncs(spark, loads, history, log, incident_path=opened)  # a repeat logs nothing new
    assert spark.read.parquet(log).count() == 2
    (event,) = spark.read.parquet(opened).collect()
    (verdict,) = result.verdicts.collect()
    assert event.report_id == verdict.report_id and event.action == "open"
    assert (verdict.table_name, verdict.state, verdict.downstream_nodes, verdict.suggested_fixes, verdict.fix_status) == ("depot", "pending", 6, 1, "suggested")
    assert verdict.time_to_detect_seconds == 90.0 and verdict.hours_saved_this_incident == pytest.approx((11520 - 90) / 3600, abs=0.006)
    classes = {r.table_name: r for r in result.classes.collect()}
    assert classes["depot"].classification == "SILENT_SEMANTIC_FAILURE" and classes["depot"].others_clean
    assert classes["parcel"].next_step == "clean"
    assert [r.report_id for r in result.opened.collect()] == [classes["depot"].report_id]
    assert [r.name for r in result.blast.orderBy("hop", "name").collect()] == ["base_depot", "lane_cost", "lane_load", "cost_sheet", "night_report", "dispatch_screen"]
    (fix,) = result.fixes.collect()
    assert fix.fixed_snippet == "d.mode = 'railway'"
    score = {r.table_name: r.max_psi_score for r in result.reports.collect()}
    assert score["depot"] == pytest.approx(plain_psi(MODES_AFTER, MODES), abs=1e-6) and score["parcel"] == 0.0


def test_check_on_sync_events(spark, tables, history, tmp_path):
    depot, parcel = tables
    events = [
        {"event": "sync_end", "connector_id": "c", "schema": "crm", "table": "depot"},
        {"event": "sync_start", "connector_id": "c", "schema": "crm", "table": "parcel"},
        {"event": "sync_end", "connector_id": "c", "schema": "crm", "table": "unwatched"},
    ]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "e.json").write_text("\n".join(json.dumps(e) for e in events))
    now = "2027-03-23 00:00:00"
    loaders = {
        ("crm", "depot"): lambda s: Load(depot, "crm", "depot", at(now), per_sync=False),
        ("crm", "parcel"): lambda s: Load(parcel, "crm", "parcel", at(now), per_sync=False),
    }
    seen = []
    query = check_on_sync(
        stream_sync_events(spark, str(tmp_path / "in")), loaders, history, str(tmp_path / "log"), str(tmp_path / "cp"),
        on_check=lambda r: seen.extend(r.classes.collect()), available_now=True,
    )
    query.awaitTermination()
    assert [(r.table_name, r.next_step) for r in seen] == [("depot", "clean")]
    assert [r.table_name for r in spark.read.parquet(str(tmp_path / "log")).collect()] == ["depot"]
    kept = H.read_history(spark, history).where(F.col("computed_at") == at(now)).collect()
    assert [r.table_name for r in kept] == ["depot"]

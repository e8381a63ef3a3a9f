import math
import statistics
from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftlens.functions import psi_band, psi_of_shares
from driftlens.operators import drift

from scenario import DEPOT_ROWS, MODES, MODES_AFTER, PARCEL_ROWS, ZONES, column, depot_columns, fingerprint, frame, renamed


def psi(spark, current, baseline):
    shares = [(current.get(k, 0.0), baseline.get(k, 0.0)) for k in sorted({*current, *baseline})]
    df = spark.createDataFrame([(shares,)], "s array<struct<current:double,baseline:double>>")
    return df.select(psi_of_shares(F.col("s"))).first()[0]


def plain_psi(current, baseline):
    """The formula with plain Python, to check against."""
    pairs = [(max(current.get(k, 0), 0.001), max(baseline.get(k, 0), 0.001)) for k in {*current, *baseline}]
    return sum((a - e) * math.log(a / e) for a, e in pairs)


@pytest.fixture(scope="module")
def reports(past, after_rename):
    rows = drift.check_tables(after_rename, past).collect()
    return {r.table_name: r for r in rows}


def test_identical_distributions_score_zero(spark):
    assert psi(spark, MODES, MODES) == 0.0
    assert psi(spark, ZONES, ZONES) == 0.0


def test_noise_stays_below_the_threshold(spark):
    noisy = {k: v * (1 + 0.01 * i) for i, (k, v) in enumerate(MODES.items())}
    total = sum(noisy.values())
    assert psi(spark, {k: v / total for k, v in noisy.items()}, MODES) < 0.25


@pytest.mark.parametrize(
    "current, baseline, expected",
    [
        (MODES_AFTER, MODES, 2 * 0.239 * math.log(240)),
        ({"wet": 0.25, "dry": 0.75}, {"dry": 1.0}, 0.249 * math.log(250) - 0.25 * math.log(0.75)),
        (renamed(ZONES, "hills", "uplands"), ZONES, 2 * 0.229 * math.log(230)),
        ({}, {}, 0.0),
    ],
)
def test_golden_scores(spark, current, baseline, expected):
    assert psi(spark, current, baseline) == pytest.approx(expected, abs=1e-6)


def test_bands(spark):
    df = spark.createDataFrame([(0.099,), (0.10,), (0.25,), (0.2500001,)], "s double")
    assert [r[0] for r in df.select(psi_band(F.col("s"))).collect()] == ["stable", "watch", "watch", "anomalous"]


shares = st.dictionaries(st.sampled_from("abcdefgh"), st.floats(0, 1, allow_nan=False), max_size=8)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(shares, shares)
def test_score_is_symmetric_and_not_negative(spark, a, b):
    forward = psi(spark, a, b)
    assert forward >= 0
    assert forward == psi(spark, b, a)
    assert forward == pytest.approx(plain_psi(a, b), abs=1e-6)


def test_rename_is_flagged(reports):
    depot = reports["depot"]
    score = plain_psi(MODES_AFTER, MODES)
    assert depot.is_anomalous and depot.max_psi_column == "mode"
    assert depot.max_psi_score == pytest.approx(score, abs=1e-6)
    assert depot.baseline_count == len(DEPOT_ROWS) and depot.baseline_includes_synthetic
    assert depot.anomaly_reason == f"column 'mode' PSI={score:.3f} (threshold 0.25)"
    assert depot.threshold_multiple == round(score / 0.25, 1)
    assert depot.max_psi_current_dist["railway"] == pytest.approx(MODES["rail"])
    assert "railway" not in depot.max_psi_baseline_dist


def test_fact_table_is_clean(reports):
    parcel = reports["parcel"]
    assert not parcel.is_anomalous and parcel.anomaly_reason is None
    z = (9010 - statistics.mean(PARCEL_ROWS)) / statistics.stdev(PARCEL_ROWS)
    assert parcel.row_count_z_score == pytest.approx(z, abs=1e-4)


def test_report_score_equals_the_direct_score(reports):
    entry = next(d for d in reports["depot"].column_drifts if d.column_name == "mode")
    assert entry.drift_type == "PSI_CATEGORICAL" and entry.is_anomalous
    assert entry.psi_score == pytest.approx(plain_psi(MODES_AFTER, MODES), rel=1e-4)


def one_report(spark, current, baseline, **options):
    members = drift.recent_members(frame(spark, [current]), frame(spark, baseline))
    return drift.compare(members, **options).first()


def test_columns_added_removed_and_retyped(spark):
    old = [fingerprint(f"b{i}", "depot", 10 + i, 7, depot_columns(MODES)) for i in range(3)]
    columns = [column(0, "mode", MODES), column(1, "crane", {"yes": 0.6, "no": 0.4}), column(2, "heated", mean=0.6, stddev=0.1)]
    report = one_report(spark, fingerprint("n", "depot", 20, 7, columns), old)
    assert report.columns_added == ["crane"]
    assert report.columns_removed == ["floor_area"]
    assert report.columns_type_changed == ["heated"]
    assert report.is_anomalous
    assert report.anomaly_reason == "columns added: ['crane']; columns removed: ['floor_area']"


def test_missing_baseline(spark):
    now = fingerprint("n", "depot", 20, 7, depot_columns(MODES))
    report = one_report(spark, now, [])
    assert report.status == "no_baseline" and report.is_anomalous is None
    with pytest.raises(Exception, match="no baseline"):
        one_report(spark, now, [], strict=True)


@pytest.mark.parametrize("counts, now, expected", [([7] * 5, 7, 0.0), ([7] * 5, 8, 0.0), ([7], 50, 0.0), ([100, 101, 102, 103, 104], 100, -1.2649)])
def test_row_count_z(spark, counts, now, expected):
    old = [fingerprint(f"b{i}", "t", 1 + i, n, [column(0, "a", {"x": 1.0})]) for i, n in enumerate(counts)]
    assert one_report(spark, fingerprint("n", "t", 20, now, [column(0, "a", {"x": 1.0})]), old).row_count_z_score == expected


def test_numeric_score_makes_the_table_anomalous_before_the_column(spark):
    old = [fingerprint("b", "t", 1, 10, [column(0, "v", mean=10.0, stddev=2.0)])]
    report = one_report(spark, fingerprint("n", "t", 2, 10, [column(0, "v", mean=12.0, stddev=2.0)]), old)
    drifted = report.column_drifts[0]
    assert drifted.psi_score == pytest.approx(1 / 3) and not drifted.is_anomalous
    assert report.is_anomalous
    far = one_report(spark, fingerprint("n", "t", 2, 10, [column(0, "v", mean=100.0, stddev=2.0)]), old)
    assert far.max_psi_score == 2.0 and far.column_drifts[0].is_anomalous


def test_null_shift_is_reported_but_never_decides(spark):
    old = [fingerprint("b", "t", 1, 10, [column(0, "v", {"x": 1.0}, null_pct=0.0)])]
    for now, entries in ((0.05, []), (0.08, [False]), (0.2, [True])):
        report = one_report(spark, fingerprint("n", "t", 2, 10, [column(0, "v", {"x": 1.0}, null_pct=now)]), old)
        found = [d.is_anomalous for d in report.column_drifts if d.drift_type == "NULL_PCT_CHANGE"]
        assert found == entries and not report.is_anomalous


def test_first_column_wins_a_tie(spark):
    a, b = {"x": 1.0}, {"y": 1.0}
    old = [fingerprint("b", "t", 1, 10, [column(0, "first", a), column(1, "second", a)])]
    report = one_report(spark, fingerprint("n", "t", 2, 10, [column(0, "first", b), column(1, "second", b)]), old)
    assert report.max_psi_column == "first"


def test_mean_share_counts_only_fingerprints_with_the_column(spark):
    old = [
        fingerprint("b1", "t", 1, 10, [column(0, "v", {"x": 1.0})]),
        fingerprint("b2", "t", 2, 10, [column(0, "v", {"x": 0.5, "y": 0.5})]),
        fingerprint("b3", "t", 3, 10, [column(0, "w", {"q": 1.0})]),
    ]
    report = one_report(spark, fingerprint("n", "t", 4, 10, [column(0, "v", {"x": 1.0}), column(1, "w", {"q": 1.0})]), old)
    assert report.max_psi_baseline_dist == {"x": 0.75, "y": 0.25}


def test_only_the_newest_seven_count(spark):
    old = [fingerprint(f"b{i}", "t", 1 + i, 10, [column(0, "v", {"old" if i < 3 else "x": 1.0})]) for i in range(10)]
    report = one_report(spark, fingerprint("n", "t", 25, 10, [column(0, "v", {"x": 1.0})]), old)
    assert report.baseline_count == 7 and not report.is_anomalous


def test_rolling_comparison_equals_single_checks(spark):
    rows = [
        fingerprint(f"f{i}", "t", datetime(2026, 4, 1 + i), 100 + i * i, [column(0, "v", {"x": 0.5 + 0.02 * i, "y": 0.5 - 0.02 * i})])
        for i in range(12)
    ]
    rolling = drift.compare(drift.rolling_members(frame(spark, rows))).where("status = 'compared'").collect()
    by_id = {r.fingerprint_id: r for r in rolling}
    assert len(by_id) == 11
    for i in (1, 5, 8, 11):
        single = one_report(spark, rows[i], rows[:i])
        assert by_id[f"f{i}"].max_psi_score == single.max_psi_score
        assert by_id[f"f{i}"].row_count_z_score == single.row_count_z_score
        assert by_id[f"f{i}"].baseline_count == min(i, 7)


def test_shifts_leaders_and_movers(past, after_rename):
    found = drift.check_tables(after_rename, past).persist()
    shifts = {(r.value, r["shift"]) for r in drift.value_shifts(found).collect()}
    assert shifts == {("rail", "DISAPPEARED"), ("railway", "APPEARED")}
    movers = [r for r in drift.top_movers(found).collect() if r.table_name == "depot"]
    assert len(movers) == len(MODES) + 1
    assert {(r.value, r.current_pct, r.baseline_pct) for r in movers if r["rank"] <= 2} == {
        ("rail", 0.0, 24.0),
        ("railway", 24.0, 0.0),
    }
    leaders = drift.leading_values(found, 2).where("column_name = 'zone' and side = 'current'").collect()
    assert [r.value for r in sorted(leaders, key=lambda r: r["rank"])] == ["north", "delta"]
    log = {r.table_name: r for r in drift.drift_log(found).collect()}
    assert log["depot"].is_anomalous and log["depot"].psi == pytest.approx(plain_psi(MODES_AFTER, MODES), abs=1e-6)
    found.unpersist()

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from driftlens.operators import risk

from scenario import MODES, MODES_AFTER, column, fingerprint, frame
from test_drift import plain_psi


def mean_of(distributions):
    keys = {k for d in distributions for k in d}
    return {k: sum(d.get(k, 0) for d in distributions) / len(distributions) for k in keys}


def as_of(text="2026-06-01 00:00:00"):
    return F.lit(text).cast("timestamp_ntz")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_leave_one_out_equals_the_naive_form(spark, seed):
    rng = random.Random(seed)
    rows, plain = [], {}
    for table in ("t", "u"):
        for i in range(rng.randint(3, 9)):
            columns = []
            for position, name in enumerate(("a", "b")):
                weights = {k: rng.random() ** 4 for k in rng.sample("abcdef", rng.randint(1, 5))}
                total = sum(weights.values())
                if rng.random() < 0.9:
                    columns.append((position, name, {k: w / total for k, w in weights.items()}))
            rows.append(fingerprint(f"{table}{i}", table, 1 + i, 10, [column(*c) for c in columns]))
            plain.setdefault(table, []).append((f"{table}{i}", {n: d for _, n, d in columns}))
    expected = set()
    for history in plain.values():
        for fid, columns in history:
            for name, dist in columns.items():
                others = [c[name] for f, c in history if f != fid and name in c]
                if others and round(plain_psi(dist, mean_of(others)), 6) > 0.25:
                    expected.add(fid)
    got = {r.fingerprint_id for r in risk.past_anomalies(frame(spark, rows)).collect()}
    assert got == expected


def test_profile_of_a_drifting_table(spark):
    rows = [
        fingerprint(f"f{i}", "depot", 1 + i, 7, [column(0, "steady", {"x": 1.0}), column(1, "mode", MODES_AFTER if i in (3, 9) else MODES)])
        for i in range(10)
    ] + [fingerprint("only", "young", 1, 7, [column(0, "mode", MODES)])]
    got = {r.table_name: r for r in risk.risk_profiles(frame(spark, rows), as_of()).collect()}
    depot = got["depot"]
    assert (depot.fingerprint_count, depot.anomaly_count, depot.volatile_column) == (10, 1, "mode")
    assert depot.recent_anomaly_days == 28.0  # the fourth of May
    others = mean_of([MODES_AFTER if i == 3 else MODES for i in range(9)])
    expected = plain_psi(MODES_AFTER, others)
    assert depot.max_psi == pytest.approx(expected, abs=1e-4)
    assert depot.avg_max_psi == pytest.approx(expected / 2, abs=1e-4)
    young = got["young"]
    assert (young.sufficient_history, young.anomaly_count, young.max_psi, young.volatile_column) == (False, 0, 0.0, None)


def test_only_the_newest_fifteen_count(spark):
    rows = [fingerprint(f"f{i}", "t", 1 + i, 7, [column(0, "v", {"old" if i < 10 else "new": 1.0})]) for i in range(25)]
    profile = risk.risk_profiles(frame(spark, rows), as_of()).first()
    assert profile.fingerprint_count == 15 and profile.anomaly_count == 0 and profile.max_psi == 0.0


@pytest.mark.parametrize(
    "count, days, psi, enough, score, level",
    [
        (0, None, 0.0, False, 5, "LOW"),
        (1, 2.0, 1.4077, True, 58, "HIGH"),
        (3, 10.0, 0.3, True, 64, "HIGH"),
        (5, 1.0, 3.0, True, 95, "CRITICAL"),
        (1, 30.0, 0.1, True, 20, "MEDIUM"),
        (0, None, 0.25, True, 0, "LOW"),
    ],
)
def test_score_and_level(spark, count, days, psi, enough, score, level):
    df = spark.createDataFrame([(count, days, psi, enough)], "c int, d double, p double, e boolean")
    value = risk.risk_score(F.col("c"), F.col("d"), F.col("p"), F.col("e"))
    assert tuple(df.select(value, risk.risk_level(value)).first()) == (score, level)


def test_reason_text(spark):
    rows = [(2, 3.5, "mode", 9), (1, 0.0, None, 9), (0, None, None, 9)]
    df = spark.createDataFrame(rows, "c int, d double, n string, f int")
    texts = [r[0] for r in df.select(risk.risk_reason(F.col("c"), F.col("d"), F.col("n"), F.col("f"))).collect()]
    assert texts == [
        "Column 'mode' drifted 2 time(s) in recent history, most recently 4 days ago.",
        "Column 'None' drifted 1 time(s) in recent history, most recently recently.",
        "No significant drift history — baseline is stable across 9 fingerprints.",
    ]


def test_forecast_takes_the_age_of_the_strongest_log_entry(spark):
    history = frame(spark, [fingerprint(f"f{i}", "depot", 1 + i, 7, [column(0, "mode", MODES)]) for i in range(4)])
    log = spark.createDataFrame(
        [
            (datetime(2026, 5, 29), 0.4, "mode", "crm", "depot", True, "r3"),
            (datetime(2026, 5, 20), 1.4, "mode", "crm", "depot", True, "r1"),
            (datetime(2026, 5, 25), 1.4, "mode", "crm", "depot", True, "r2"),
            (datetime(2026, 5, 31), 9.0, "mode", "crm", "depot", False, "r4"),
            (datetime(2026, 5, 30), 0.5, "mode", "crm", "young", True, "r5"),
        ],
        "logged_at timestamp_ntz, psi double, column_name string, dataset_id string, table_name string, is_anomalous boolean, report_id string",
    )
    watched = spark.createDataFrame(
        [("crm", "depot", True), ("crm", "young", True), ("crm", "broken", False)], "dataset_id string, table_name string, readable boolean"
    )
    rows = risk.risk_forecast(watched, risk.risk_profiles(history, as_of()), risk.log_signals(log, as_of())).collect()
    assert [r.table_name for r in rows] == ["depot", "young", "broken"]
    depot, young, broken = rows
    assert (depot.recent_anomaly_days, depot.anomaly_count, depot.max_psi, depot.risk_score) == (12.0, 1, 1.4, 38)
    assert (young.risk_score, young.risk_level, young.anomaly_count) == (5, "LOW", 1)
    assert (broken.risk_score, broken.risk_level) == (0, "UNKNOWN")

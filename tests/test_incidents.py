import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from driftlens.operators import incidents, ordered, triage
from driftlens.operators.skew import SALT, salted_join

START = datetime(2026, 1, 1)


def random_log(seed, reports=25, events=400):
    """A log in which one report owns a third of all events."""
    rng = random.Random(seed)
    names = ["hot"] * (reports // 2) + [f"r{i}" for i in range(reports)]
    actions = ["approve", "dismiss", "reenable", "investigate", "poke"]
    log = [
        (rng.choice(names), START + timedelta(seconds=rng.randrange(300)), i, rng.choice(actions)) for i in range(events)
    ]
    opened = {name: START + timedelta(seconds=rng.randrange(200)) for name in {*names} if rng.random() < 0.9}
    return log, opened


def play(log, opened):
    """The life cycle one event at a time."""
    state = {name: "pending" for name in opened}
    outcome = {}
    for name, at, seq, action in sorted(log, key=lambda e: (e[1], e[2])):
        now = state.get(name) if name in opened and at >= opened[name] else None
        if action == "approve" and now == "pending":
            state[name], outcome[seq] = "quarantined", "executed"
        elif action == "dismiss" and now == "pending":
            state[name], outcome[seq] = "dismissed", "dismissed"
        elif action == "reenable" and now == "quarantined":
            state[name], outcome[seq] = "reenabled", "reenabled"
        elif action == "investigate":
            outcome[seq] = "flagged_for_investigation"
        else:
            outcome[seq] = "unknown_action" if action == "poke" else "rejected"
    return state, outcome


def frames(spark, log, opened):
    events = spark.createDataFrame(log, "report_id string, at timestamp_ntz, seq bigint, action string")
    return spark.createDataFrame(list(opened.items()), "report_id string, opened_at timestamp_ntz"), events


@pytest.mark.parametrize("seed", [1, 2])
def test_states_and_outcomes_equal_a_plain_replay(spark, seed):
    log, opened = random_log(seed)
    state, outcome = play(log, opened)
    opened_frame, events = frames(spark, log, opened)
    decided = incidents.decisions(opened_frame, events)
    assert {r.report_id: r.state for r in decided.collect()} == state
    assert {r.seq: r.outcome for r in incidents.event_outcomes(decided, events).collect()} == outcome


def test_merges_bring_tables_back(spark):
    log = [("a", START, 1, "approve"), ("b", START, 2, "approve"), ("c", START, 3, "approve"), ("d", START, 4, "dismiss")]
    opened, events = frames(spark, log, {k: START for k in "abcd"})
    decided = incidents.decisions(opened, events)
    merges = spark.createDataFrame(
        [("a", 1, "closed", True, START + timedelta(hours=1), "u1"), ("b", 2, "open", False, None, "u2"), ("d", 4, "closed", True, START, "u4")],
        "report_id string, pr_number bigint, pr_state string, merged boolean, merged_at timestamp_ntz, pr_url string",
    )
    asked = spark.createDataFrame([(k,) for k in "abcde"], "report_id string")
    checked = incidents.check_merges(asked, decided, merges)
    assert {r.report_id: r.status for r in checked.collect()} == {"a": "reenabled", "b": "pr_open", "c": "no_pr", "d": "not_found", "e": "not_found"}
    later = incidents.decisions(opened, events.unionByName(incidents.merge_events(checked, 100)))
    assert {r.report_id: r.state for r in later.collect()} == {"a": "reenabled", "b": "quarantined", "c": "quarantined", "d": "dismissed"}
    (closed,) = incidents.resolution_times(later).collect()
    assert (closed.report_id, closed.elapsed_seconds, closed.elapsed) == ("a", 3600, "60m 0s")
    assert {r.report_id: r.pr_number for r in incidents.quarantined(decided, merges).collect()} == {"a": 1, "b": 2, "c": None}


def test_event_log_is_partitioned_by_day(spark, tmp_path):
    _, events = frames(spark, [("a", START, 1, "approve"), ("a", START + timedelta(days=1), 2, "reenable")], {"a": START})
    incidents.append_events(events, str(tmp_path / "log"))
    incidents.append_events(events.limit(1), str(tmp_path / "log"))
    back = spark.read.parquet(str(tmp_path / "log"))
    assert back.count() == 2 and back.select("event_date").distinct().count() == 2


def test_event_log_takes_an_event_once(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = [("a", START, 1, "approve"), ("a", START, 1, "approve"), (None, None, None, None), ("a", START, 1, "dismiss")]
    _, events = frames(spark, rows, {"a": START})
    for batch in (events, events.limit(2), events.limit(0), events.unionByName(frames(spark, [("b", START, 2, "approve")], {"b": START})[1])):
        incidents.append_events(batch, path)
    kept = [(r.report_id, r.seq, r.action) for r in spark.read.parquet(path).collect()]
    assert sorted(kept, key=str) == sorted([("a", 1, "approve"), (None, None, None), ("a", 1, "dismiss"), ("b", 2, "approve")], key=str)


def test_new_syncs_skip_empty_values_and_the_first_one(spark):
    values = [None, "s1", "s1", "", "s2", None, "s2", "s1"]
    rows = [("c", START + timedelta(minutes=i), i, v) for i, v in enumerate(values)] + [("d", START, 100, "s1")]
    polls = spark.createDataFrame(rows, "connector_id string, polled_at timestamp_ntz, seq bigint, succeeded_at string")
    found = {(r.seq, r.last_seen, r.succeeded_at) for r in incidents.new_syncs(polls).collect()}
    assert found == {(4, "s1", "s2"), (7, "s2", "s1")}


def test_running_totals_and_previous_values_cross_chunk_borders(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "a", None]), i, rng.randrange(100)) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, i int, v int").repartition(7)
    alone = {r.i: r.total for r in ordered.running_totals(df, ["i"], {"total": F.col("v")}, chunks=6).collect()}
    grouped = {r.i: r.total for r in ordered.running_totals(df, ["i"], {"total": F.col("v")}, group=["g"], chunks=6).collect()}
    before = {r.i: r.last for r in ordered.previous_value(df, ["g"], ["i"], "v", "last", chunks=6).collect()}
    total, sums, last = 0, {}, {}
    for g, i, v in rows:
        total += v
        sums[g] = sums.get(g, 0) + v
        assert (alone[i], grouped[i], before[i]) == (total, sums[g], last.get(g))
        last[g] = v
    chunks = ordered.in_chunks(df, ["i"], 6).groupBy("chunk").count().collect()
    assert len(chunks) == 6 and max(r["count"] for r in chunks) < 1000


def test_impact(spark):
    rows = [("a", START, START + timedelta(seconds=42)), ("b", START, START + timedelta(hours=5))]
    df = spark.createDataFrame(rows, "report_id string, received_at timestamp_ntz, detected_at timestamp_ntz")
    got = {r.report_id: r for r in triage.detection_impact(df).collect()}
    assert (got["a"].time_to_detect_seconds, got["a"].hours_saved_this_incident) == (42.0, 3.19)
    assert (got["b"].hours_saved_this_incident, got["b"].incidents_caught_total, got["b"].total_hours_saved) == (0.0, 2, 3.19)


def test_a_hot_key_is_spread_without_changing_the_result(spark):
    large = spark.range(400).select(F.when(F.col("id") % 4 < 3, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 40)).alias("key"), "id")
    small = large.select("key").distinct().withColumn("name", F.upper("key"))
    plain = sorted((r.key, r.id, r.name) for r in large.join(small, "key", "left").collect())
    for rows_per_salt in (1, 25, 1000):
        joined = salted_join(large, small, ["key"], ["id"], "left", rows_per_salt)
        assert sorted((r.key, r.id, r.name) for r in joined.collect()) == plain
        salts = joined.where("key = 'hot'").select(SALT).distinct().count()
        assert salts > 5 if rows_per_salt < 1000 else salts == 1

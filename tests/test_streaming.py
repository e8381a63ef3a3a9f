import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from driftlens.operators import drift, incidents, monitor, profile
from driftlens.streaming.drift_check import check_stream, current_log
from driftlens.streaming.event_log import log_events
from driftlens.streaming.incident_state import current_state, stream_transitions, track_incidents, transitions
from driftlens.streaming.keyed import append_to
from driftlens.streaming.merges import close_on_merge, closed_by_merge
from driftlens.streaming.staleness import raised_alarms, stale_now, watch_staleness
from driftlens.streaming.sync_watch import detected_changes, watch_syncs

from test_incidents import START, frames, play, random_log


def in_files(df, path, order, parts):
    """Write a frame as several files, oldest rows first, so that a stream takes them batch by batch."""
    rows = df.orderBy(order).collect()
    size = -(-len(rows) // parts)
    for i in range(parts):
        chunk = df.sparkSession.createDataFrame(rows[i * size : (i + 1) * size], df.schema)
        chunk.coalesce(1).write.mode("append").parquet(path)


def file_stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_stream_of_loads_equals_the_batch_comparison(spark, tmp_path):
    rng = random.Random(5)
    rows = []
    for day in range(14):
        names = "abc" if day != 9 else "abx"
        rows += [
            (datetime(2026, 1, 1 + day, rng.randrange(24), rng.randrange(60)), rng.choice(names), rng.gauss(10 + day / 10, 2) if rng.random() > 0.1 else None)
            for _ in range(60)
        ]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, kind string, amount double")
    in_files(df, str(tmp_path / "in"), "ts", 5)
    stream = file_stream(spark, str(tmp_path / "in"), df.schema)
    query = check_stream(stream, str(tmp_path / "out"), "app", "loads", "ts", profile_columns=["kind", "amount"], available_now=True)
    query.awaitTermination()
    streamed = {r.logged_at.date(): (r.psi, r.column_name, r.is_anomalous) for r in current_log(spark, str(tmp_path / "out")).collect()}
    day = F.col("ts").cast("date").cast("timestamp_ntz")
    fps = profile.fingerprints(df, "app", "loads", day, profile_columns=["kind", "amount"])
    log = drift.drift_log(drift.compare(drift.rolling_members(fps)))
    batch = {r.logged_at.date(): (r.psi, r.column_name, r.is_anomalous) for r in log.collect()}
    assert streamed == batch and len(batch) == 13
    assert batch[datetime(2026, 1, 10).date()][2]
    # two columns a window are held, however many values they have, and every window has one folder
    assert max(op["numRowsTotal"] for p in query.recentProgress for op in p["stateOperators"]) <= 2 * 14
    assert len(list((tmp_path / "out/groups").glob("window_us=*"))) == 14


def test_near_unique_columns_do_not_grow_the_state(spark, tmp_path):
    rows = [(datetime(2026, 1, 1 + i // 400, i % 24), f"id{i}") for i in range(1200)]
    add(spark, rows, "ts timestamp_ntz, key string", tmp_path / "in")
    query = check_stream(
        file_stream(spark, str(tmp_path / "in"), "ts timestamp_ntz, key string"), str(tmp_path / "out"), "app", "ids", "ts",
        tracked_values=64, available_now=True,
    )
    query.awaitTermination()
    assert max(op["numRowsTotal"] for p in query.recentProgress for op in p["stateOperators"]) <= 3
    assert current_log(spark, str(tmp_path / "out")).count() == 2


POLL = "connector_id string, polled_at timestamp_ntz, seq bigint, succeeded_at string"


def minutes(n):
    return START + timedelta(minutes=n)


def add(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))


def state_writes(query):
    return [op["numRowsUpdated"] for p in query.recentProgress for op in p["stateOperators"]]


def run_polls(spark, tmp_path):
    query = watch_syncs(file_stream(spark, str(tmp_path / "in"), POLL), str(tmp_path / "out"), available_now=True)
    query.awaitTermination()
    return query


def seen_changes(spark, tmp_path):
    return sorted((r.connector_id, r.seq, r.last_seen, r.succeeded_at) for r in detected_changes(spark, str(tmp_path / "out")).collect())


def test_stream_of_polls(spark, tmp_path):
    rng = random.Random(2)
    rows = [
        (rng.choice(["hot", "hot", "a", "b"]), START + timedelta(minutes=i), i, rng.choice([None, "", "s1", "s2", "s2"])) for i in range(300)
    ]
    polls = spark.createDataFrame(rows, POLL)
    batch = sorted((r.connector_id, r.seq, r.last_seen, r.succeeded_at) for r in incidents.new_syncs(polls).collect())
    assert batch
    # half of the files, a restart, and the other half
    in_files(polls.where("seq < 150"), str(tmp_path / "in"), "seq", 2)
    run_polls(spark, tmp_path)
    assert seen_changes(spark, tmp_path) == [r for r in batch if r[1] < 150]
    in_files(polls.where("seq >= 150"), str(tmp_path / "in"), "seq", 2)
    run_polls(spark, tmp_path)
    assert seen_changes(spark, tmp_path) == batch
    run_polls(spark, tmp_path)
    assert seen_changes(spark, tmp_path) == batch


def test_late_polls_tell_nothing_new(spark, tmp_path):
    add(spark, [("a", minutes(5), 5, "s2"), ("a", minutes(1), 1, "s1"), ("b", minutes(3), 3, "s1")], POLL, tmp_path / "in")
    run_polls(spark, tmp_path)
    add(spark, [("a", minutes(2), 2, "s1"), ("a", minutes(5), 5, "s2"), ("a", None, 7, "s9"), (None, minutes(9), 8, "s9")], POLL, tmp_path / "in")
    late = run_polls(spark, tmp_path)
    add(spark, [("a", minutes(6), 6, "s3"), ("a", minutes(7), 7, "")], POLL, tmp_path / "in")
    touched = run_polls(spark, tmp_path)
    assert seen_changes(spark, tmp_path) == [("a", 5, "s1", "s2"), ("a", 6, "s2", "s3")]
    # connector b is held and was not written again
    assert sum(state_writes(late)) == 0 and sum(state_writes(touched)) == 1
    assert max(op["numRowsTotal"] for p in touched.recentProgress for op in p["stateOperators"]) == 2


ACTION = "report_id string, at timestamp_ntz, seq bigint, action string"


def run_actions(spark, tmp_path, opened):
    query = track_incidents(file_stream(spark, str(tmp_path / "in"), ACTION), opened, str(tmp_path / "out"), available_now=True)
    query.awaitTermination()
    return query


def test_stream_of_actions(spark, tmp_path):
    log, opened = random_log(4, events=200)
    opened_frame, events = frames(spark, log, opened)
    ordered = events.orderBy("at", "seq").collect()
    for chunk in (ordered[:100], ordered[100:]):  # a restart in between
        in_files(spark.createDataFrame(chunk, events.schema), str(tmp_path / "in"), ["at", "seq"], 2)
        run_actions(spark, tmp_path, opened_frame)
    states = current_state(spark, str(tmp_path / "out"), opened_frame).collect()
    assert {r.report_id: r.state for r in states} == play(log, opened)[0]
    batch = {r.report_id: (r.state, r.decided_seq, r.reenabled_seq) for r in incidents.decisions(opened_frame, events).collect()}
    assert {r.report_id: (r.state, r.decided_seq, r.reenabled_seq) for r in states} == batch


def test_actions_out_of_order(spark, tmp_path):
    opened = spark.createDataFrame([("r1", START), ("r2", START), ("r3", START)], "report_id string, opened_at timestamp_ntz")
    add(spark, [("r1", minutes(9), 9, "approve"), ("r2", minutes(8), 8, "dismiss"), ("r9", minutes(1), 1, "approve")], ACTION, tmp_path / "in")
    run_actions(spark, tmp_path, opened)
    # r1 was approved before this dismissal arrived; the re-enabling came later than the approval, whatever its clock says
    add(spark, [("r1", minutes(2), 2, "dismiss"), ("r1", minutes(3), 3, "reenable"), ("r2", minutes(4), 4, "reenable")], ACTION, tmp_path / "in")
    second = run_actions(spark, tmp_path, opened)
    add(spark, [("r1", minutes(20), 20, "dismiss"), ("r2", minutes(21), 21, "approve"), ("r3", minutes(22), 22, "investigate")], ACTION, tmp_path / "in")
    third = run_actions(spark, tmp_path, opened)
    states = {r.report_id: (r.state, r.decided_seq, r.reenabled_seq) for r in current_state(spark, str(tmp_path / "out"), opened).collect()}
    assert states == {"r1": ("reenabled", 9, 3), "r2": ("dismissed", 8, None), "r3": ("pending", None, None)}
    # what does not move an incident costs no write
    assert sum(state_writes(second)) == 1 and sum(state_writes(third)) == 0


def test_incidents_share_states(spark, tmp_path):
    log, opened = random_log(7, events=400)
    opened_frame, events = frames(spark, log, opened)
    in_files(events, str(tmp_path / "in"), ["at", "seq"], 2)
    actions = file_stream(spark, str(tmp_path / "in"), ACTION)
    query = append_to(transitions(actions, opened_frame, buckets=3), str(tmp_path / "out"), "transitions", True)
    query.awaitTermination()
    states = current_state(spark, str(tmp_path / "out"), opened_frame).collect()
    batch = {r.report_id: (r.state, r.decided_seq, r.reenabled_seq) for r in incidents.decisions(opened_frame, events).collect()}
    assert {r.report_id: (r.state, r.decided_seq, r.reenabled_seq) for r in states} == batch
    # a state, and a call of Python, a bucket and not an incident
    assert sum(r.state != "pending" for r in states) > 3
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3


MERGE = "report_id string, pr_number bigint, merged boolean, merged_at timestamp_ntz, pr_url string"


def run_merges(spark, tmp_path, opened):
    root = str(tmp_path / "out")
    run_actions(spark, tmp_path, opened)
    merges = file_stream(spark, str(tmp_path / "merges"), MERGE)
    close_on_merge(stream_transitions(spark, root), merges, root, horizon="2 hours", lateness="10 minutes", available_now=True).awaitTermination()
    return {r.report_id: (r.status, r.pr_number, r.elapsed_seconds) for r in closed_by_merge(spark, root, opened).collect()}


def test_merges_close_incidents(spark, tmp_path):
    ids = ["early", "late", "never", "open", "own"]
    opened = spark.createDataFrame([(i, START) for i in ids], "report_id string, opened_at timestamp_ntz")
    add(spark, [(i, minutes(10), n, "approve") for n, i in enumerate(ids)], ACTION, tmp_path / "in")
    add(spark, [("early", 1, True, minutes(4), "u1"), ("open", 4, False, None, "u4"), ("late", 9, True, minutes(900), "u9")], MERGE, tmp_path / "merges")
    # a merge before the approval closes at the approval; a merge far outside the horizon is none of this incident
    assert run_merges(spark, tmp_path, opened) == {"early": ("reenabled", 1, 600)}
    # after a restart: a merge within the horizon, and an operator who was faster than the merge
    add(spark, [("own", minutes(30), 50, "reenable")], ACTION, tmp_path / "in")
    add(spark, [("late", 2, True, minutes(70), "u2"), ("own", 5, True, minutes(60), "u5")], MERGE, tmp_path / "merges")
    assert run_merges(spark, tmp_path, opened) == {"early": ("reenabled", 1, 600), "late": ("reenabled", 2, 4200)}
    # time goes on in both streams: what was not merged within the horizon is given up on, once
    more = spark.createDataFrame([("new", minutes(900))], "report_id string, opened_at timestamp_ntz").unionByName(opened)
    add(spark, [("new", minutes(901), 60, "approve")], ACTION, tmp_path / "in")
    add(spark, [("other", 7, True, minutes(905), "u7")], MERGE, tmp_path / "merges")
    for _ in range(2):
        closed = run_merges(spark, tmp_path, more)
    assert closed == {
        "early": ("reenabled", 1, 600), "late": ("reenabled", 2, 4200), "never": ("never_merged", None, None), "open": ("never_merged", None, None)
    }


LOAD = "table_name string, loaded_at timestamp_ntz"


def run_loads(spark, tmp_path, threshold=3600):
    loads = file_stream(spark, str(tmp_path / "in"), LOAD)
    query = watch_staleness(loads, str(tmp_path / "out"), threshold_seconds=threshold, lateness="0 seconds", available_now=True)
    query.awaitTermination()
    start = START.replace(tzinfo=None)
    return sorted((r.table_name, r.alarm, (r.at - start).total_seconds() / 60) for r in raised_alarms(spark, str(tmp_path / "out")).collect())


def test_a_table_that_stops_loading_raises_one_alarm(spark, tmp_path):
    add(spark, [("a", minutes(0)), ("b", minutes(0)), ("b", minutes(50)), ("b", minutes(100))], LOAD, tmp_path / "in")
    stale = ("a", "stale", 60.0)
    assert run_loads(spark, tmp_path) == [stale]  # no event of its own told so
    add(spark, [("b", minutes(150)), ("b", minutes(200)), (None, minutes(210)), ("c", None)], LOAD, tmp_path / "in")
    assert run_loads(spark, tmp_path) == [stale]  # and it is told once
    add(spark, [("a", minutes(220)), ("b", minutes(240))], LOAD, tmp_path / "in")
    recovered = ("a", "recovered", 220.0)
    assert run_loads(spark, tmp_path) == [recovered, stale]
    add(spark, [("a", minutes(250)), ("a", minutes(240)), ("a", minutes(400)), ("b", minutes(461))], LOAD, tmp_path / "in")
    expected = sorted([stale, recovered, ("a", "stale", 310.0), ("a", "recovered", 400.0), ("a", "stale", 460.0), ("b", "stale", 300.0), ("b", "recovered", 461.0)])
    assert run_loads(spark, tmp_path) == expected


def test_alarms_equal_the_freshness_view(spark, tmp_path):
    rng = random.Random(8)
    rows, last = [], {}
    for i in range(400):
        table = rng.choice("aaabbbcdefgh"[: 12 if i < 200 else 6])
        rows.append((table, minutes(3 * i)))
        last[table] = minutes(3 * i)
    for part in range(4):
        add(spark, rows[part * 100 : part * 100 + 100], LOAD, tmp_path / "in")
    alarms = run_loads(spark, tmp_path, threshold=1800)
    metadata = spark.createDataFrame([(t, at, 1) for t, at in last.items()], "table_name string, last_modified_at timestamp_ntz, row_count bigint")
    now = F.lit(max(last.values()).replace(tzinfo=None)).cast("timestamp_ntz")
    view = monitor.freshness(metadata.select("table_name"), metadata, now, threshold_seconds=1800)
    stale = {r.table_name for r in view.where("is_stale").collect()}
    assert {r.table_name for r in stale_now(raised_alarms(spark, str(tmp_path / "out"))).collect()} == stale and stale
    # every alarm ends before the next one of its table begins
    for table in last:
        mine = [x[1] for x in sorted(alarms, key=lambda x: x[2]) if x[0] == table]
        assert mine == (["stale", "recovered"] * len(mine))[: len(mine)]


def test_a_replayed_batch_adds_no_row_to_the_log(spark, tmp_path):
    schema = "report_id string, at timestamp_ntz, seq bigint, action string"
    days = [[(f"r{i % 5}", START + timedelta(days=day, minutes=i), day * 50 + i, "approve") for i in range(50)] for day in range(6)]
    sent, held = set(), []
    for day, rows in enumerate(days):
        again = rows + rows[:20] + (days[day - 1][30:] if day else []) + [("r", None, None, None)]
        add(spark, again, schema, tmp_path / "in")
        sent |= set(rows)
        query = log_events(file_stream(spark, str(tmp_path / "in"), schema), str(tmp_path / "out"), lateness="1 day", available_now=True)
        query.awaitTermination()  # a new run goes on where the last one ended
        held += [op["numRowsTotal"] for p in query.recentProgress for op in p["stateOperators"]]
        rows_back = [(r.report_id, r.seq) for r in spark.read.parquet(str(tmp_path / "out/events")).collect()]
        assert len(rows_back) == len(set(rows_back)) and set(rows_back) == {(r[0], r[2]) for r in sent}
    assert max(held) <= 4 * 50  # the keys of twice the lateness and of one batch, not of all days

import os

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from driftlens.sources import history as H
from driftlens.staging import CHECKPOINT, release, stage, stage_bucketed
from driftlens.streaming.batches import read_windows, replace_windows, windows_around

from scenario import MODES, column, fingerprint, frame


def folders(spark):
    root = spark.conf.get(CHECKPOINT) + "/driftlens"
    return os.listdir(root) if os.path.isdir(root) else []


def test_release_leaves_no_folder_and_no_table(spark):
    release(spark)
    before = set(folders(spark))  # other applications may share the folder
    rows = spark.range(20).select("id", (F.col("id") % 3).alias("k"))
    assert stage(rows, "plain").count() == 20 and stage_bucketed(rows, "spread", "k").count() == 20
    assert len(set(folders(spark)) - before) == 2
    release(spark)
    assert set(folders(spark)) == before and not [t for t in spark.catalog.listTables() if t.name.startswith("staged_")]


def test_bucketed_rows_are_joined_in_place(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = stage_bucketed(spark.range(1000).select("id", (F.col("id") % 97).alias("k")), "spread", "k")
        joined = rows.join(spark.range(97).withColumnRenamed("id", "k").repartition(3), "k")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert plan.count("hashpartitioning(k") == 1 and joined.count() == 1000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_windows_are_replaced_as_a_whole(spark, tmp_path):
    path, schema = str(tmp_path / "windows"), "at timestamp, n int"
    assert read_windows(spark, path, schema).count() == 0

    def write(rows):
        frame = spark.createDataFrame([(datetime(2026, 1, day), n) for day, n in rows], schema)
        replace_windows(frame, path, "at")

    write([(1, 1), (1, 2), (2, 3), (4, 4)])
    for _ in range(2):  # a replay leaves the same files
        write([(2, 9), (3, 8)])
    assert sorted((r["at"].day, r["n"]) for r in read_windows(spark, path, schema).collect()) == [(1, 1), (1, 2), (2, 9), (3, 8), (4, 4)]
    assert len(list((tmp_path / "windows").glob("window_us=*"))) == 4
    second = int(datetime(2026, 1, 2, tzinfo=timezone.utc).timestamp()) * 1_000_000
    day = 86_400_000_000
    assert windows_around(spark, path, schema, second, second + day, 1) == (second - day, second + 2 * day)
    assert sorted(r["n"] for r in read_windows(spark, path, schema, second, second + day).collect()) == [8, 9]


def test_append_reads_only_the_dates_at_hand(spark, tmp_path):
    path = str(tmp_path / "history")
    rows = [fingerprint(f"f{i}", "depot", 1 + i, 240 + i, [column(0, "mode", MODES)]) for i in range(6)]
    H.store(frame(spark, rows), path)
    H.store(frame(spark, [rows[2], rows[2], rows[5]]), path)
    assert sorted(r.fingerprint_id for r in H.read_history(spark, path).collect()) == [f"f{i}" for i in range(6)]
    fresh = frame(spark, rows[2:4]).withColumn("computed_date", F.to_date("computed_at"))
    near = H.between_dates(spark.read.parquet(path), fresh)
    assert sorted(r.fingerprint_id for r in near.collect()) == ["f2", "f3"]
    scan = [x for x in near._jdf.queryExecution().executedPlan().toString().splitlines() if "PartitionFilters" in x]
    assert scan and "Subquery" in scan[0].split("PartitionFilters")[1].split("]")[0]


def test_a_delete_keeps_rows_it_knows_nothing_about(spark):
    rows = spark.createDataFrame([(1, None), (2, False), (3, True)], "id int, flag boolean")
    assert {r.id for r in H.without(rows, F.col("flag") == F.lit(False)).collect()} == {1, 3}

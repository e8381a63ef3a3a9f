"""Profiles merged from states against profiles of the whole."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from driftlens.operators import sketches
from driftlens.operators.profile import Load
from driftlens.sources import history as H

SCHEMA = "day timestamp_ntz, kind string, amount double, code int, flag boolean, nothing string, blank double, _fivetran_deleted boolean"


def rows_of(days=9, per_day=120):
    rng = random.Random(7)
    out = []
    for day in range(days):
        for _ in range(per_day * (3 if day == 4 else 1)):
            amount = rng.gauss(1e6 + day, 2) if rng.random() > 0.1 else None
            out.append(
                (datetime(2026, 3, 1 + day), rng.choice(["a", "b", "b", "c", None]), amount, rng.randrange(4000), rng.random() < 0.3, None, None, rng.choice([None, False, False, True]))
            )
    return out


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(rows_of(), SCHEMA).repartition(5).cache()


def load(df, when=None):
    return Load(df, "crm", "deal", F.col("day") if when is None else when, when is None, ["kind", "amount", "code", "flag", "nothing", "blank"])


def by_name(frame):
    return {r["name"]: r for r in frame.collect()}


def test_merged_days_equal_the_whole(spark, table, tmp_path):
    daily = sketches.states(load(table))
    assert daily.count() == 9 * 6
    path = str(tmp_path / "states")
    for _ in range(2):
        H.store_states(daily, path)
    stored = H.read_history(spark, path)
    assert stored.count() == 9 * 6
    merged = by_name(sketches.estimates(sketches.merged(stored, ["name", "kind"])))
    live = table.where("_fivetran_deleted is null or not _fivetran_deleted")
    assert set(merged) == {"kind", "amount", "code", "flag", "nothing", "blank"}
    for name, got in merged.items():
        exact = live.agg(
            F.count("*").alias("rows"), F.count(name).alias("filled"), F.count_distinct(name).alias("distinct"),
            *([F.min(name).alias("lo"), F.max(name).alias("hi"), F.avg(name).alias("mean"), F.stddev_samp(name).alias("sd")] if name in ("amount", "code", "blank") else []),
        ).first().asDict()
        assert (got["row_count"], got["filled_count"]) == (exact["rows"], exact["filled"])
        assert abs(got["distinct_count"] - exact["distinct"]) <= got["distinct_bound"]
        if name in ("amount", "code"):
            assert (got["min_val"], got["max_val"]) == (exact["lo"], exact["hi"])
            assert got["mean"] == pytest.approx(exact["mean"], rel=1e-12) and got["stddev"] == pytest.approx(exact["sd"], rel=1e-9)
            values = sorted(r[0] for r in live.where(F.col(name).isNotNull()).select(F.col(name).cast("double")).collect())
            for share, q in zip((0.01, 0.25, 0.5, 0.75, 0.99), got["quantiles"]):
                assert sum(v < q for v in values) / len(values) <= share + got["rank_bound"]
                assert sum(v <= q for v in values) / len(values) >= share - got["rank_bound"]
    counts = {r[0]: r[1] for r in live.groupBy(F.coalesce("kind", F.lit("__null__"))).count().collect()}
    top = [(v.value, v.cnt) for v in merged["kind"]["top_values"]]
    assert top == sorted(counts.items(), key=lambda x: (-x[1], x[0]))
    assert {v.value for v in merged["flag"]["top_values"]} == {"True", "False"}
    assert merged["nothing"]["distinct_count"] == 0 and [(v.value) for v in merged["nothing"]["top_values"]] == ["__null__"]
    assert merged["blank"]["quantiles"] is None and merged["blank"]["mean"] is None and merged["blank"]["stddev"] is None


def test_the_order_of_merging_does_not_matter(spark, table):
    daily = sketches.states(load(table)).cache()
    half = F.when(F.dayofmonth("computed_at") < 4, 0).otherwise(1)
    halves = sketches.merged(daily.withColumn("half", half), ["half", "name", "kind"])
    halves = halves.withColumns({"computed_at": F.lit(datetime(2026, 3, 1)).cast("timestamp_ntz"), "dataset_id": F.lit("d"), "table_name": F.col("half").cast("string")})
    direct, stepped = (by_name(sketches.estimates(sketches.merged(x, ["name", "kind"]))) for x in (daily, halves))
    for name in direct:
        for field in ("row_count", "filled_count", "null_pct", "min_val", "max_val", "top_values"):
            assert direct[name][field] == stepped[name][field]
        assert abs(direct[name]["distinct_count"] - stepped[name]["distinct_count"]) <= direct[name]["distinct_bound"]
        assert direct[name]["mean"] == pytest.approx(stepped[name]["mean"]) if direct[name]["mean"] else stepped[name]["mean"] is None


def test_values_beyond_the_tracked_ones_stay_within_the_bound(spark):
    rng = random.Random(3)
    values = ["often"] * 900 + ["less"] * 300 + [f"id{i}" for i in range(3000)]
    rng.shuffle(values)
    days = [(datetime(2026, 3, 1 + i % 5), v) for i, v in enumerate(values)]
    df = spark.createDataFrame(days, "day timestamp_ntz, kind string").repartition(4)
    daily = sketches.states(Load(df, "crm", "deal", F.col("day")), tracked_values=200)
    got = sketches.estimates(sketches.merged(daily, ["name", "kind"], tracked_values=200), tracked_values=200).first()
    top = {v.value: v.cnt for v in got["top_values"]}
    assert abs(top["often"] - 900) <= got["count_bound"] and abs(top["less"] - 300) <= got["count_bound"]
    assert len(top) <= 20


def test_an_empty_table_has_no_states(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert sketches.states(load(empty)).count() == 0
    assert sketches.states(load(empty, F.lit(datetime(2026, 3, 1)).cast("timestamp_ntz"))).count() == 0
    assert sketches.merged(sketches.states(load(empty)), ["name", "kind"]).count() == 0

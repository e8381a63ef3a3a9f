"""Every registered query against its SQL form, on the smallest tables."""

import math
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from driftlens.operators import monitor
from driftlens.sources.tables import read_table, table_metadata

import __spark_entry__ as entry_point

from scenario import DATA

QUERIES, ORACLE = entry_point.queries(), entry_point.oracle_sql()
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{DATA}/{table}.parquet')")
    return connection


def tidy(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float) and math.isnan(value):
        return None
    return value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cells = [tuple(tidy(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(cells, key=repr)


@pytest.mark.parametrize("name", sorted(n for n in ORACLE if not n.startswith("op") and n != "pipeline"))
def test_query_equals_its_sql(spark, duck, name):
    frame = QUERIES[name](spark, DATA)
    got = table(frame.columns, [tuple(r) for r in frame.collect()])
    cursor = duck.execute(ORACLE[name])
    expected = table([c[0] for c in cursor.description], cursor.fetchall())
    assert got[0] == expected[0]
    assert got[1] == expected[1]


def test_every_query_has_sql():
    assert {n for n in QUERIES if not n.startswith("op") and n != "pipeline"} <= set(ORACLE)


def test_file_times_of_every_table(spark):
    now = F.lit("2100-01-01").cast("timestamp")
    wanted = spark.createDataFrame([(t,) for t in [*TABLES, "not_loaded"]], "table_name string")
    metadata = table_metadata({t: read_table(spark, DATA, t) for t in TABLES})
    rows = {r.table_name: r for r in monitor.freshness(wanted, metadata, now).collect()}
    assert rows["lineitem"].row_count == 6000 and rows["lineitem"].age_seconds > 0 and rows["lineitem"].is_stale
    assert rows["not_loaded"].age_seconds is None and not rows["not_loaded"].is_stale


def test_entry(spark):
    assert entry_point.entry(spark).count() > 100

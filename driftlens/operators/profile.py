"""Table fingerprints: one row per table and sync, with every column's statistics nested inside.

A whole sync history is profiled in one job by grouping on the sync time. The wide aggregate holds, per
(sync, column), only counters and bounded sketches, all of them combined on the map side, so neither a hot sync
nor a hot value reaches one task. Exact top values are counted by (sync, column, value), which spreads a
near-unique column over all tasks; each task then keeps its own best twenty before the next shuffle.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as K
from ..functions import live_rows
from .selection import CATEGORICAL, ProfiledColumn, profiled_columns

TOP_TYPE = "array<struct<value:string,cnt:bigint>>"
STATS_TYPE = (
    "array<struct<position:int,name:string,data_type:string,kind:string,null_pct:double,distinct_count:bigint,"
    f"min_val:double,max_val:double,mean:double,stddev:double,quantiles:array<double>,top:{TOP_TYPE}>>"
)


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _identifier(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _column_statistics(
    column: ProfiledColumn, exact_distinct: bool, accuracy: int, approximate_top: bool, tracked_values: int, kept_values: int
) -> str:
    """The aggregate expressions of one column, as one SQL struct."""
    c = _identifier(column.name)
    x = f"cast({c} as double)"
    if column.kind == CATEGORICAL:
        sketch = f"approx_top_k({_label(column)}, {kept_values}, {tracked_values})"
        top = f"transform({sketch}, e -> named_struct('value', e.item, 'cnt', e.count))"
        moments = ["cast(null as double)"] * 4 + ["cast(null as array<double>)"]
        moments.append(top if approximate_top else f"cast(null as {TOP_TYPE})")
    else:
        percents = ", ".join(f"{p / 100}D" for p in K.QUANTILE_PERCENTS)
        moments = [f"min({x})", f"max({x})", f"avg({x})", f"stddev_samp({x})"]
        moments += [f"percentile_approx({x}, array({percents}), {accuracy})", f"cast(null as {TOP_TYPE})"]
    distinct_count = "cast(null as bigint)" if exact_distinct else f"approx_count_distinct({c})"
    named = zip(("min_val", "max_val", "mean", "stddev", "quantiles", "top"), moments, strict=True)
    return (
        f"named_struct('position', {column.position}, 'name', {_text(column.name)}, "
        f"'data_type', {_text(column.data_type.simpleString())}, 'kind', '{column.kind}', "
        f"'null_pct', coalesce(round(try_divide(count(1) - count({c}), count(1)), 6), 0D), "
        f"'distinct_count', {distinct_count}, " + ", ".join(f"'{n}', {e}" for n, e in named) + ")"
    )


def _label(column: ProfiledColumn) -> str:
    """SQL form of a value's distribution key: booleans as True/False, null under its own key."""
    text = f"cast({_identifier(column.name)} as string)"
    if isinstance(column.data_type, T.BooleanType):
        text = f"initcap({text})"
    return f"coalesce({text}, '{K.NULL_KEY}')"


def value_counts(df: DataFrame, keys: list[str], columns: list[ProfiledColumn]) -> DataFrame:
    """Rows per (keys, column position, value) of the given columns, values as distribution keys."""
    positions = [str(c.position) for c in columns]
    labelled = df.selectExpr(*keys, *[f"{_label(c)} as `{c.position}`" for c in columns])
    long = labelled.unpivot(list(keys), positions, "position", "value")
    return long.groupBy(*keys, F.expr("cast(position as int) as position"), "value").agg(F.expr("count(1) as cnt"))


def top_values(counts: DataFrame, keys: list[str], k: int = K.TOP_VALUES) -> DataFrame:
    """The ``k`` most frequent values of each column, ties broken by value (``rank`` 1 is the most frequent)."""
    best = Window.partitionBy(*keys, "position").orderBy(F.desc("cnt"), "value")
    return counts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def schema_hash(schema: T.StructType) -> str:
    """First 16 hex digits of the SHA-256 of the name-sorted ``name:type`` list of all columns."""
    entries = sorted(f"{f.name}:{f.dataType.simpleString()}" for f in schema.fields)
    return hashlib.sha256(",".join(entries).encode()).hexdigest()[:16]


# The finished column entry. Exact counts come as one map by column position, sketched ones inside the statistics.
_COUNTED = f"""
transform(stats, c -> named_struct('c', c, 'kept', array_sort(
  coalesce(try_element_at(top, c.position), c.top, cast(array() as {TOP_TYPE})),
  (a, b) -> case when a.cnt > b.cnt then -1 when a.cnt < b.cnt then 1
                 when a.value < b.value then -1 when a.value > b.value then 1 else 0 end)))
"""
_TOTALLED = f"""
transform({_COUNTED}, r -> named_struct('c', r.c, 'kept', r.kept, 'total', aggregate(r.kept, 0L, (sum, v) -> sum + v.cnt)))
"""
_ENTRY = f"""
transform({_TOTALLED}, r -> named_struct(
  'position', r.c.position, 'name', r.c.name, 'data_type', r.c.data_type, 'kind', r.c.kind,
  'null_pct', r.c.null_pct,
  'distinct_count', coalesce(r.c.distinct_count, try_element_at(distincts, r.c.position), 0L),
  'top_values', transform(r.kept, v -> named_struct(
     'value', v.value, 'cnt', v.cnt, 'pct', round(coalesce(try_divide(v.cnt, row_count), 0D), 6))),
  'min_val', r.c.min_val, 'max_val', r.c.max_val, 'mean', r.c.mean, 'stddev', r.c.stddev,
  {", ".join(f"'p{p}', try_element_at(r.c.quantiles, {i + 1})" for i, p in enumerate(K.QUANTILE_PERCENTS))},
  'distribution', map_from_entries(transform(r.kept, v -> struct(v.value, coalesce(try_divide(v.cnt, row_count), 0D)))),
  'entropy', case when r.c.kind = '{CATEGORICAL}' then round(aggregate(
     r.kept, 0D, (bits, v) -> bits - (v.cnt / r.total) * log2(v.cnt / r.total)), 6) end))
"""


class Load(NamedTuple):
    """A table to profile: ``computed_at`` is the sync time, a column of ``df`` (each distinct value is one sync), or
    a literal when the whole table is one sync (``per_sync`` off)."""

    df: DataFrame
    dataset_id: str
    table_name: str
    computed_at: Column
    per_sync: bool = True
    profile_columns: list[str] | None = None
    connection_id: str = "local"
    project_id: str = "local"
    is_synthetic: bool = False
    with_columns: bool = True


_TABLE = ["dataset_id", "table_name", "connection_id", "project_id", "is_synthetic", "schema_hash", "computed_at"]


def distinct_counts(df: DataFrame, keys: list[str], columns: list[ProfiledColumn]) -> DataFrame:
    """Exact distinct counts per (keys, column position), nulls left out.

    Columns of like type are stacked and grouped by value, so that a near-unique column is spread over all tasks and
    never held in one.
    """
    kinds = {"bigint": [], "double": [], "string": []}
    for c in columns:
        if isinstance(c.data_type, T.IntegralType):
            kinds["bigint"].append(c)
        elif isinstance(c.data_type, T.FractionalType) and not isinstance(c.data_type, T.DecimalType):
            kinds["double"].append(c)
        else:
            kinds["string"].append(c)
    result = None
    for kind, members in kinds.items():
        if not members:
            continue
        stacked = df.select(*keys, *[F.col(_identifier(c.name)).cast(kind).alias(str(c.position)) for c in members])
        part = (
            stacked.unpivot(list(keys), [str(c.position) for c in members], "position", "value")
            .where("value is not null")
            .distinct()
            .groupBy(*keys, F.col("position").cast("int").alias("position"))
            .agg(F.count(F.lit(1)).alias("distinct_count"))
        )
        result = part if result is None else result.unionByName(part)
    return result


def header_only(load: Load) -> Load:
    """The same load without column statistics: one count per sync and no shuffle by value."""
    return load._replace(with_columns=False)


def only_kind(load: Load, kind: str) -> Load:
    """The same load with the columns of one kind."""
    return load._replace(profile_columns=[c.name for c in profiled_columns(load.df.schema, load.profile_columns) if c.kind == kind])


def _parts(load: Load, top: str, distinct: str, accuracy: int, tracked_values: int, kept_values: int) -> list[DataFrame]:
    """Partial rows of one table: the wide aggregate, then the top values and distinct counts as maps per sync."""
    df = load.df
    columns = profiled_columns(df.schema, load.profile_columns) if load.with_columns else []
    if K.DELETED_FLAG in df.columns:
        df = df.where(live_rows(F.col(K.DELETED_FLAG)))
    identity = [
        F.lit(load.dataset_id).alias("dataset_id"),
        F.lit(load.table_name).alias("table_name"),
        F.lit(load.connection_id).alias("connection_id"),
        F.lit(load.project_id).alias("project_id"),
        F.lit(load.is_synthetic).alias("is_synthetic"),
        F.lit(schema_hash(load.df.schema)).alias("schema_hash"),
        (F.col("__sync") if load.per_sync else load.computed_at).alias("computed_at"),
    ]
    names = [F.col(_identifier(c.name)) for c in columns]
    keys = ["__sync"] if load.per_sync else []
    source = df.select(load.computed_at.alias("__sync"), *names) if load.per_sync else df.select(*names)
    statistics = source.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.expr(
            "array("
            + ", ".join(
                _column_statistics(c, distinct == "exact", accuracy, top == "approx", tracked_values, kept_values) for c in columns
            )
            + ")"
            if columns
            else f"cast(array() as {STATS_TYPE})"
        ).alias("stats"),
    )
    parts = [statistics.select(*identity, "row_count", "stats")]
    categorical = [c for c in columns if c.kind == CATEGORICAL]
    if top == "exact" and categorical:
        best = top_values(value_counts(source, keys, categorical), keys, kept_values)
        by_column = best.groupBy(*keys, "position").agg(F.collect_list(F.struct("value", "cnt")).alias("values"))
        by_sync = by_column.groupBy(*keys).agg(
            F.map_from_entries(F.collect_list(F.struct("position", "values"))).alias("top")
        )
        parts.append(by_sync.select(*identity, "top"))
    if distinct == "exact" and columns:
        by_sync = distinct_counts(source, keys, columns).groupBy(*keys).agg(
            F.map_from_entries(F.collect_list(F.struct("position", "distinct_count"))).alias("distincts")
        )
        parts.append(by_sync.select(*identity, "distincts"))
    return parts


def fingerprint_loads(
    loads: list[Load],
    *,
    top: str = "exact",
    distinct: str = "approx",
    accuracy: int = 10_000,
    tracked_values: int = 10_000,
    kept_values: int = K.TOP_VALUES,
) -> DataFrame:
    """Fingerprints of any number of tables in one job.

    ``kept_values`` of each categorical column make its distribution; ``cut_shares`` tells what the others hold.

    ``top="approx"`` replaces the exact value counts by a mergeable sketch, which needs no shuffle by value and no
    second scan: the choice for wide tables and near-unique columns; ``top="none"`` counts no values. ``distinct="exact"`` costs a shuffle by value of
    every column; quantiles here are always sketches (see ``quantiles`` for exact ones).
    """
    rows = None
    for load in loads:
        for part in _parts(load, top, distinct, accuracy, tracked_values, kept_values):
            rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    for name, kind in (("top", f"map<int,{TOP_TYPE}>"), ("distincts", "map<int,bigint>")):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    # One partial row per sync and kind: grouping aligns them, and treats a null sync like any other. The rows are
    # placed by key explicitly, because Spark 4.1 otherwise takes over the partitioning of the union's children, which
    # gives wrong groups when an exchange below one of them is reused.
    aligned = rows.repartition(*_TABLE).groupBy(*_TABLE).agg(
        *[F.any_value(c, True).alias(c) for c in ("row_count", "stats", "top", "distincts")]
    )
    identity = F.concat_ws("|", "dataset_id", "table_name", F.col("computed_at").cast("string"))
    return aligned.select(
        F.left(F.sha2(identity, 256), F.lit(32)).alias("fingerprint_id"),
        "computed_at",
        "is_synthetic",
        "connection_id",
        "project_id",
        "dataset_id",
        "table_name",
        "row_count",
        "schema_hash",
        F.expr(_ENTRY).alias("columns"),
    )


def fingerprints(
    df: DataFrame,
    dataset_id: str,
    table_name: str,
    computed_at: Column,
    *,
    per_sync: bool = True,
    profile_columns: list[str] | None = None,
    connection_id: str = "local",
    project_id: str = "local",
    is_synthetic: bool = False,
    **options,
) -> DataFrame:
    """Fingerprint one table: one row per sync, or one row in all when ``per_sync`` is off."""
    load = Load(
        df, dataset_id, table_name, computed_at, per_sync, profile_columns, connection_id, project_id, is_synthetic
    )
    return fingerprint_loads([load], **options)


HEADER = ["fingerprint_id", "dataset_id", "table_name", "computed_at", "row_count", "schema_hash", "is_synthetic"]


def column_rows(fps: DataFrame, keep: list[str] = HEADER) -> DataFrame:
    """Long form: one row per fingerprint and column."""
    return fps.select(*keep, F.explode("columns").alias("column")).select(*keep, "column.*")


def cut_shares(fps: DataFrame, keep: list[str] = HEADER) -> DataFrame:
    """Share of each categorical column's rows whose value is not among the kept ones: 0 unless the column is cut."""
    kept = F.aggregate(F.map_values("distribution"), F.lit(0.0), lambda total, share: total + share)
    rows = column_rows(fps, keep).where((F.col("kind") == CATEGORICAL) & (F.size("distribution") > 0))
    return rows.select(*keep, "position", F.col("name").alias("column_name"), F.greatest(F.round(1 - kept, 6), F.lit(0.0)).alias("cut_share"))

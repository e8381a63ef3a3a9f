"""Which columns are profiled, and row-level relabelling."""

from __future__ import annotations

import warnings
from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as K

NUMERIC = "numeric"
CATEGORICAL = "categorical"

# Base type names of profiled columns, as Spark spells them.
NUMERIC_TYPES = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
CATEGORICAL_TYPES = ("string", "boolean")


class ProfiledColumn(NamedTuple):
    position: int
    name: str
    data_type: T.DataType
    kind: str


def column_kind(data_type):
    """Numeric, categorical or null for a column holding type names (precision is ignored)."""
    base = F.regexp_replace(F.lower(data_type), r"\(.*", "")
    return F.when(base.isin(*NUMERIC_TYPES), NUMERIC).when(base.isin(*CATEGORICAL_TYPES), CATEGORICAL)


def profilable_columns(catalog: DataFrame, watched: DataFrame | None = None) -> DataFrame:
    """Catalog rows that are profiled, with their kind: categorical ones first, each kind in ordinal order.

    Loader-internal columns, ``id`` and all other types are left out. With a watch list, tables on it that
    name columns keep only those; tables that are not on it keep nothing.
    """
    rows = catalog.withColumn("kind", column_kind(F.col("data_type"))).where(
        F.col("kind").isNotNull() & ~F.col("column_name").isin("id", *K.LOADER_COLUMNS)
    )
    if watched is None:
        return rows
    rules = watched.select("dataset_id", "table_name", "profile_columns")
    allowed = (
        F.col("profile_columns").isNull()
        | (F.size("profile_columns") == 0)
        | F.array_contains("profile_columns", F.col("column_name"))
    )
    return rows.join(rules, ["dataset_id", "table_name"]).where(allowed).drop("profile_columns")


def missing_columns(catalog: DataFrame, watched: DataFrame) -> DataFrame:
    """Watched columns that their table does not have; ``status`` is ``error`` where no usable one is left."""
    wanted = watched.select(
        "dataset_id", "table_name", F.explode("profile_columns").alias("column_name")
    )
    missing = wanted.join(catalog, ["dataset_id", "table_name", "column_name"], "left_anti")
    usable = profilable_columns(catalog, watched).groupBy("dataset_id", "table_name").agg(
        F.count(F.lit(1)).alias("usable")
    )
    return missing.join(usable, ["dataset_id", "table_name"], "left").select(
        "dataset_id",
        "table_name",
        "column_name",
        F.when(F.coalesce("usable", F.lit(0)) == 0, "error").otherwise("warning").alias("status"),
    )


def profiled_columns(schema: T.StructType, profile_columns: Iterable[str] | None = None) -> list[ProfiledColumn]:
    """The same selection on one schema, to build a profile plan from. Raises when nothing can be profiled."""
    wanted = set(profile_columns or ())
    found: dict[str, list[T.StructField]] = {CATEGORICAL: [], NUMERIC: []}
    for field in schema.fields:
        if field.name == "id" or field.name in K.LOADER_COLUMNS or (wanted and field.name not in wanted):
            continue
        if isinstance(field.dataType, (T.StringType, T.BooleanType)):
            found[CATEGORICAL].append(field)
        elif isinstance(field.dataType, T.NumericType):
            found[NUMERIC].append(field)
    missing = sorted(wanted - set(schema.names))
    if not found[CATEGORICAL] and not found[NUMERIC]:
        if wanted:
            available = sorted(set(schema.names) - set(K.LOADER_COLUMNS))
            raise ValueError(f"no watched column can be profiled; missing: {missing}; available: {available}")
        raise ValueError("the table has no column that can be profiled")
    if missing:
        warnings.warn(f"watched columns not in the table: {missing}", stacklevel=2)
    ordered = [(f, CATEGORICAL) for f in found[CATEGORICAL]] + [(f, NUMERIC) for f in found[NUMERIC]]
    return [ProfiledColumn(i, f.name, f.dataType, kind) for i, (f, kind) in enumerate(ordered)]


def relabel(df: DataFrame, column: str, old: str, new: str) -> DataFrame:
    """Replace one value of a column. Swap the arguments to undo it."""
    return df.withColumn(column, F.when(F.col(column) == old, F.lit(new)).otherwise(F.col(column)))


def relabel_all(df: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """Replace many values at once by an (old_value, new_value) table; values without a pair stay."""
    joined = df.join(mapping, df[column] == mapping["old_value"], "left")
    others = [df[c] if c != column else F.coalesce(mapping["new_value"], df[c]).alias(c) for c in df.columns]
    return joined.select(*others)


def affected_rows(df: DataFrame, column: str, value: str) -> DataFrame:
    """How many rows a relabelling of ``value`` touches."""
    return df.where(F.col(column) == value).agg(F.count(F.lit(1)).alias("affected_rows"))

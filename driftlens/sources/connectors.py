"""Connector schema configuration: which tables of which schema are switched on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kept as text per entry, so that an entry which is not an object is seen and skipped.
_CONFIG = "struct<data:struct<schemas:map<string,string>>>"
_SCHEMA = "struct<tables:map<string,string>>"
_TABLE = "struct<enabled:boolean>"


def _is_object(text: Column) -> Column:
    return F.startswith(F.ltrim(text), F.lit("{"))


def connector_tables(configs: DataFrame) -> DataFrame:
    """Every configured table of (connector_id, config) documents: one row per schema and table, in order.

    A missing ``enabled`` counts as off; entries that are not objects are skipped.
    """
    schemas = configs.select(
        "connector_id",
        F.posexplode(F.from_json("config", _CONFIG)["data"]["schemas"]).alias(
            "schema_position", "schema_name", "schema_text"
        ),
    ).where(_is_object(F.col("schema_text")))
    tables = schemas.select(
        "connector_id",
        "schema_position",
        "schema_name",
        F.posexplode(F.from_json("schema_text", _SCHEMA)["tables"]).alias(
            "table_position", "table_name", "table_text"
        ),
    ).where(_is_object(F.col("table_text")))
    return tables.select(
        "connector_id",
        "schema_position",
        "schema_name",
        "table_position",
        "table_name",
        F.coalesce(F.from_json("table_text", _TABLE)["enabled"], F.lit(False)).alias("enabled"),
    )


def schema_of_tables(tables: DataFrame) -> DataFrame:
    """The first schema that holds each table, per connector; look-ups that find nothing stay null on a left join."""
    return tables.groupBy("connector_id", "table_name").agg(
        F.min_by("schema_name", "schema_position").alias("schema_name")
    )

"""Table, catalog, metadata and watch-list scans."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CATALOG_SCHEMA = "dataset_id string, table_name string, ordinal int, column_name string, data_type string"
WATCH_LIST_SCHEMA = (
    "watched_tables array<struct<dataset:string, `table`:string, priority:string, description:string, "
    "profile_columns:array<string>>>"
)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Scan of one parquet table of a folder."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def catalog(spark: SparkSession, tables: Mapping[str, DataFrame], dataset_id: str) -> DataFrame:
    """Column name and type of every table in ordinal order. Reads schemas only, never data."""
    rows = [
        (dataset_id, table, ordinal, field.name, field.dataType.simpleString())
        for table, df in tables.items()
        for ordinal, field in enumerate(df.schema.fields, start=1)
    ]
    return spark.createDataFrame(rows, CATALOG_SCHEMA)


def table_metadata(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Last modification time and row count of file-backed tables.

    Only file metadata and row-group counts are read: no column is decoded. Partial results are one row per
    task, so the number of files does not matter.
    """
    parts = [
        df.select(F.col("_metadata.file_modification_time").alias("modified")).agg(
            F.lit(table).alias("table_name"),
            F.max("modified").alias("last_modified_at"),
            F.count(F.lit(1)).alias("row_count"),
        )
        for table, df in tables.items()
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def read_watch_list(spark: SparkSession, path: str) -> DataFrame:
    """Watched tables with priority and profiled columns, from a JSON or YAML document."""
    if path.endswith((".yaml", ".yml")):
        import json

        import yaml

        # read by Spark, so that the list may lie where the tables lie; it is one small document
        document = spark.read.text(path, wholetext=True).first()
        text = json.dumps(yaml.safe_load(document.value if document else ""))
        document = spark.createDataFrame([(text,)], "value string").select(
            F.from_json("value", WATCH_LIST_SCHEMA).alias("doc")
        ).select("doc.watched_tables")
    else:
        document = spark.read.schema(WATCH_LIST_SCHEMA).json(path, multiLine=True)
    return watch_list(document)


def watch_list(document: DataFrame) -> DataFrame:
    """One row per watched table of a parsed watch-list document."""
    return document.select(F.posexplode("watched_tables").alias("position", "entry")).select(
        F.col("entry.dataset").alias("dataset_id"),
        F.col("entry.table").alias("table_name"),
        F.col("entry.priority").alias("priority"),
        F.col("entry.description").alias("description"),
        F.col("entry.profile_columns").alias("profile_columns"),
        "position",
    )

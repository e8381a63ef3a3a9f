"""Dependency-graph reader: a build manifest as a node table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_NODE = (
    "struct<name:string, resource_type:string, source_name:string, original_file_path:string, path:string, "
    "raw_code:string, raw_sql:string, compiled_code:string, owner:struct<name:string, email:string>, "
    "depends_on:struct<nodes:array<string>>>"
)
MANIFEST_SCHEMA = (
    f"struct<nodes:map<string,{_NODE}>, sources:map<string,{_NODE}>, exposures:map<string,{_NODE}>>"
)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Nodes of the manifest file(s) at ``path``; several files give several graphs, told apart by ``graph``."""
    text = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("graph"), F.col("value")
    )
    return manifest_nodes(text)


def manifest_nodes(documents: DataFrame) -> DataFrame:
    """Node table of JSON manifests given as (graph, value) rows.

    Nodes, sources and exposures become one table; where two maps hold the same id the later map wins, while
    the node keeps the place of its first mention.
    """
    # one array of all entries, so that a document is parsed and read once
    listed = ", ".join(
        f"transform(coalesce(map_entries(doc.{field}), array()), (e, i) -> "
        f"named_struct('map_rank', {rank}, 'place', i, 'uid', e.key, 'node', e.value))"
        for rank, field in enumerate(("nodes", "sources", "exposures"))
    )
    entries = (
        documents.select("graph", F.from_json("value", MANIFEST_SCHEMA).alias("doc"))
        .select("graph", F.explode(F.expr(f"concat({listed})")).alias("entry"))
        .select("graph", "entry.*")
    )
    # nodes shrink many times when packed, so parts merged by their packed size would be large ones to sort
    count = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    entries = entries.repartition(count, "graph", "uid")
    same_id = Window.partitionBy("graph", "uid")
    latest = (
        entries.withColumn("first_mention", F.min(F.struct("map_rank", "place")).over(same_id))
        .withColumn("rn", F.row_number().over(same_id.orderBy(F.desc("map_rank"), F.desc("place"))))
        .where("rn = 1")
    )
    return latest.select(
        "graph",
        "uid",
        F.struct("first_mention.map_rank", "first_mention.place").alias("position"),
        F.coalesce("node.name", "uid").alias("name"),
        F.coalesce("node.resource_type", F.lit("model")).alias("resource_type"),
        F.coalesce("node.source_name", F.lit("")).alias("source_name"),
        F.col("node.owner.name").alias("owner_name"),
        F.col("node.owner.email").alias("owner_email"),
        F.col("node.raw_code").alias("raw_code"),
        F.col("node.raw_sql").alias("raw_sql"),
        F.col("node.compiled_code").alias("compiled_code"),
        F.col("node.original_file_path").alias("original_file_path"),
        F.col("node.path").alias("path"),
        F.coalesce("node.depends_on.nodes", F.array().cast("array<string>")).alias("depends_on"),
    )

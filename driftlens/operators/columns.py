"""Columns followed through the models' SQL: under which names they go on, which models use them, which literals break.

Each model's statement is scanned once, in its own task (``functions.sql_facts``); everything between models is joins.
A column is followed by a breadth-first search over (node, place inside the node, column name), so a rename in one model
is known to the next. Column names are compared in lower case.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sql_facts import FACT_SCHEMA, facts
from ..shipping import ship
from ..staging import new_path, stage, stage_bucketed
from .lineage import in_graph, node_sql

ASKED = ["source_table", "changed_column", "graph", "start_uid"]
_FACTS = [tuple(part.split()) for part in FACT_SCHEMA.split(", ")]
_ARROW = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
_PLACE = "uid string, part int, column string, exact boolean"


_ROWS = 20_000  # facts handed back at once


def _table(rows: list[tuple]) -> pa.RecordBatch:
    schema = pa.schema([("graph", pa.string()), ("uid", pa.string()), *((c, _ARROW[kind]) for c, kind in _FACTS)])
    columns = zip(*rows) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, schema)], schema=schema)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    for batch in batches:
        for graph, uid, sql in zip(*(batch.column(c).to_pylist() for c in ("graph", "uid", "sql"))):
            rows += [(graph, uid, *row) for row in facts(sql)]
            if len(rows) >= _ROWS:
                yield _table(rows)
                rows = []
    yield _table(rows)


def _with_sql(nodes: DataFrame) -> DataFrame:
    return in_graph(nodes).select("graph", "uid", node_sql(nodes).alias("sql")).where("sql <> ''")


def column_facts(nodes: DataFrame) -> DataFrame:
    """What each node's SQL does with the columns of the nodes it depends on, and of its own inner queries.

    (graph, uid, fact, from_uid, from_part, column, ...): see ``functions.sql_facts``. A relation is looked up among the
    node's own dependencies, by template call or by the last part of its name; one that is no dependency gives no row. If
    two dependencies go by one name, both are meant.
    """
    ship(nodes.sparkSession)
    known = in_graph(nodes)
    found = _with_sql(nodes).mapInArrow(_scan, f"graph string, uid string, {FACT_SCHEMA}")
    is_source = F.col("resource_type") == "source"
    name = F.lower("name")
    own = F.when(is_source, F.concat(F.lit("source:"), F.lower("source_name"), F.lit("."), name)).otherwise(
        F.concat(F.lit("ref:"), name)
    )
    names = known.select(
        "graph", F.col("uid").alias("from_uid"), F.explode(F.array(own, F.concat(F.lit("table:"), name))).alias("relation")
    )
    upstream = (
        known.select("graph", "uid", F.explode("depends_on").alias("from_uid"))
        .distinct()
        .join(names, ["graph", "from_uid"])
    )
    # inner places and relations in one pass, as each reference to the scan would run it again
    own_place = F.col("relation").isNull()
    met = found.join(upstream, ["graph", "uid", "relation"], "left").where(own_place | F.col("from_uid").isNotNull())
    columns = [c for c, _ in _FACTS if c != "relation"]
    return met.select("graph", "uid", *columns, F.when(own_place, F.col("uid")).otherwise(F.col("from_uid")).alias("from_uid"))


def trace(column_facts: DataFrame, starts: DataFrame) -> DataFrame:
    """Every place a changed column reaches, and its name there.

    ``starts`` has (source_table, changed_column, graph, start_uid) as from ``lineage.find_sources``; requests without a
    column reach nothing. One row per (request, uid, part, column), the start included; ``part`` 0 is a node's output.
    ``exact`` says that some way there passes the column as it is, so that its values are the source's values; other ways
    go through expressions.

    Each hop joins the frontier with the passes, which are written once, bucketed by where they start; only the
    frontier moves. There are at most two states per place and name, so cycles end by themselves.
    """
    spark = column_facts.sparkSession
    passes = stage_bucketed(
        column_facts.where("fact = 'pass'").select(
            "graph", F.col("from_uid").alias("uid"), F.col("from_part").alias("part"), F.col("column").alias("taken"),
            F.col("uid").alias("next_uid"), F.col("to_part").alias("next_part"), F.col("to_column").alias("given"),
            F.col("exact").alias("bare"),
        ).distinct(),
        "passes", "graph", "uid",
    )
    root = new_path(spark, "traced")
    schema = f"source_table string, changed_column string, graph string, start_uid string, {_PLACE}"
    state = [*ASKED, "uid", "part", "column", "exact"]
    in_graph(starts).where("changed_column <> ''").select(
        *ASKED,
        F.col("start_uid").alias("uid"),
        F.lit(0).alias("part"),
        F.lower("changed_column").alias("column"),
        F.lit(True).alias("exact"),
    ).distinct().write.parquet(f"{root}/hop=0")
    hop = 0
    while True:
        frontier = spark.read.schema(schema).parquet(f"{root}/hop={hop}")
        visited = spark.read.schema(schema).parquet(*[f"{root}/hop={h}" for h in range(hop + 1)])
        hop += 1
        step = (
            frontier.join(passes, ["graph", "uid", "part"])
            .where("taken is null or taken = column")
            .select(
                *ASKED,
                F.col("next_uid").alias("uid"),
                F.col("next_part").alias("part"),
                F.coalesce("given", "column").alias("column"),
                (F.col("exact") & F.col("bare")).alias("exact"),
            )
            .distinct()
            .join(visited, state, "left_anti")
        )
        step.write.parquet(f"{root}/hop={hop}")
        if spark.read.schema(schema).parquet(f"{root}/hop={hop}").isEmpty():
            break
    reached = spark.read.schema(schema).parquet(*[f"{root}/hop={h}" for h in range(hop)])
    return reached.groupBy(*state[:-1]).agg(F.max("exact").alias("exact"))


def using(column_facts: DataFrame, traced: DataFrame) -> DataFrame:
    """Nodes that use or pass on a traced column under whatever name: (request, uid)."""
    places = traced.select(*ASKED, F.col("uid").alias("from_uid"), F.col("part").alias("from_part"), "column")
    uses = column_facts.where("fact = 'use'").select("graph", "uid", "from_uid", "from_part", "column").distinct()
    met = uses.join(places, ["graph", "from_uid", "from_part", "column"]).select(*ASKED, "uid")
    carried = traced.where("uid <> start_uid").select(*ASKED, "uid")
    return stage(met.unionByName(carried), "using").distinct()


def flag_traced(blast: DataFrame, column_facts: DataFrame, traced: DataFrame) -> DataFrame:
    """A blast radius with ``traces_column``: the node uses the column, also where an earlier model renamed it.

    ``references_column`` stays the plain search of the column's own name in the text.
    """
    met = using(column_facts, traced).withColumn("met", F.lit(True))
    key = [*ASKED, "uid"]
    given = in_graph(blast)
    same = [given[k].eqNullSafe(met[k]) if k == "changed_column" else given[k] == met[k] for k in key]
    return given.join(met, same, "left").select(*[given[c] for c in given.columns], F.coalesce(met["met"], F.lit(False)).alias("traces_column"))


def _quoted(c: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'"))


def _between(text: str, start: Column, stop: Column) -> Column:
    return F.substring(F.col(text), start + 1, stop - start)


def broken_literals(pairs: DataFrame, column_facts: DataFrame, traced: DataFrame, nodes: DataFrame) -> DataFrame:
    """Literals that a changed column, under whatever name, is compared with and that name a value it no longer has.

    ``pairs`` has (table_name, column_name, old_value, new_value). One row per literal: equality in either direction,
    lists, simple CASE, LIKE without wildcards and IS DISTINCT FROM (``form``). Only places are asked that the column reaches
    as it is: values behind an expression are others. ``certain`` is false where the column has no qualifier and the
    query several relations. The snippet is the comparison (of CASE the branch); ``fixed_sql`` replaces this one literal.
    """
    places = traced.where("exact").select(
        F.col("source_table").alias("table_name"), F.col("changed_column").alias("column_name"), "graph",
        F.col("uid").alias("from_uid"), F.col("part").alias("from_part"), "column",
    )
    met = (
        column_facts.where("fact = 'compare'")
        .join(places, ["graph", "from_uid", "from_part", "column"])
        .join(
            pairs.select("table_name", "column_name", F.col("old_value").alias("literal"), "new_value"),
            ["table_name", "column_name", "literal"],
        )
        .groupBy("table_name", "column_name", "graph", "uid", "literal", "new_value", "literal_start", "literal_stop")
        .agg(
            F.max("certain").alias("certain"), F.min("form").alias("form"), F.min("column").alias("column_there"),
            F.min("snippet_start").alias("a"), F.max("snippet_stop").alias("b"),
        )
    )
    described = in_graph(nodes).select(
        "graph", "uid", "name",
        F.coalesce("original_file_path", "path", F.concat(F.lit("models/"), "name", F.lit(".sql"))).alias("file_path"),
        node_sql(nodes).alias("sql"),
    )
    value = _quoted(F.col("new_value"))
    first, last, a, b = (F.col(c) for c in ("literal_start", "literal_stop", "a", "b"))
    return met.join(described, ["graph", "uid"]).select(
        "table_name", "column_name", "graph",
        F.col("uid").alias("model_uid"), F.col("name").alias("model_name"), "file_path", "column_there", "form", "certain",
        F.col("literal").alias("old_value"), "new_value", "literal_start", "literal_stop",
        _between("sql", a, b).alias("original_snippet"),
        F.concat(_between("sql", a, first), value, _between("sql", last, b)).alias("fixed_snippet"),
        F.concat(_between("sql", F.lit(0), first), value, _between("sql", last, F.length("sql"))).alias("fixed_sql"),
    )


def repaired_models(broken: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each model with a broken literal, with all its certain fixes applied at once.

    If two renames claim one literal, the new value that is first by name is taken. Literals that are not certain stay as
    they are and are counted in ``uncertain_literals``.
    """
    one = Window.partitionBy("graph", "model_uid", "literal_start").orderBy("new_value")
    chosen = broken.where("certain").withColumn("rn", F.row_number().over(one)).where("rn = 1")
    fixes = chosen.groupBy("graph", "model_uid").agg(
        F.collect_list(F.struct("literal_start", "literal_stop", _quoted(F.col("new_value")).alias("value"))).alias("fixes")
    )
    loose = broken.groupBy("graph", "model_uid").agg(
        F.count_distinct(F.when(~F.col("certain"), F.col("literal_start"))).alias("uncertain_literals")
    )
    texts = in_graph(nodes).select("graph", F.col("uid").alias("model_uid"), F.col("name").alias("model_name"), node_sql(nodes).alias("sql"))
    rows = loose.join(fixes, ["graph", "model_uid"], "left").join(texts, ["graph", "model_uid"])
    # from the last literal to the first, so that the offsets before it stay true
    fixed = F.aggregate(
        F.sort_array(F.coalesce("fixes", F.array().cast(fixes.schema["fixes"].dataType)), asc=False),
        F.col("sql"),
        lambda text, fix: F.concat(
            F.substring(text, F.lit(1), fix["literal_start"]), fix["value"], F.substring(text, fix["literal_stop"] + 1, F.length(text))
        ),
    )
    return rows.select(
        "graph", "model_uid", "model_name", F.coalesce(F.size("fixes"), F.lit(0)).alias("fixed_literals"),
        "uncertain_literals", fixed.alias("fixed_sql"),
    )

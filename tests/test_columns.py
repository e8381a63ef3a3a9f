"""Columns followed through models, and the literals that break on the way."""

import random

import pytest
from pyspark.sql import functions as F

from driftlens.operators import columns, lineage
from driftlens.plans import roles

from scenario import DATA

NODE = (
    "graph string, uid string, position struct<map_rank:int,place:int>, name string, resource_type string, source_name string, "
    "owner_name string, owner_email string, raw_code string, raw_sql string, compiled_code string, original_file_path string, "
    "path string, depends_on array<string>"
)


def node(uid, sql=None, depends=(), kind="model", source="", graph="g"):
    name = uid.split(".")[-1]
    return (graph, uid, (0, 0), name, kind, source, None, None, sql, None, None, None, None, list(depends))


def table(spark, *rows):
    return spark.createDataFrame(list(rows), NODE)


SOURCE = node("src.stage", kind="source", source="crm")


def followed(spark, nodes, column="label"):
    starts = lineage.find_sources(nodes, spark.createDataFrame([("stage", column)], "source_table string, changed_column string"))
    found = columns.column_facts(nodes)
    return starts, found, columns.trace(found, starts)


@pytest.fixture(scope="module")
def chain(spark):
    return table(
        spark,
        SOURCE,
        node("m.a", "select id, label as stage_label from {{ source('crm', 'stage') }} -- label = 'won'", ["src.stage"]),
        node("m.b", "with t as (select a.*, 'won' as why from {{ ref('a') }} a) select stage_label s, upper(stage_label) u from t", ["m.a"]),
        node("m.c", "select count(*) n from {{ ref('b') }} where s in ('lost', 'won') and u = 'won' or 'won' = s", ["m.b"]),
        node("m.d", "select x.label from {{ ref('c') }} x where x.label = 'won'", ["m.c"]),
    )


def test_a_column_is_followed_through_renames(spark, chain):
    starts, found, traced = followed(spark, chain)
    rows = {(r.uid, r.column, r.exact) for r in traced.where("part = 0").collect()}
    assert rows == {("src.stage", "label", True), ("m.a", "stage_label", True), ("m.b", "s", True), ("m.b", "u", False)}
    blast = lineage.blast_radius(chain, lineage.edges(chain), starts)
    flags = {r.uid: (r.hop, r.references_column, r.traces_column) for r in columns.flag_traced(blast, found, traced).collect()}
    # the text search loses the renamed column at the third hop and takes the same name in the fourth for it
    assert flags == {"m.a": (1, True, True), "m.b": (2, True, True), "m.c": (3, False, True), "m.d": (4, True, False)}


def test_literals_break_under_every_name(spark, chain):
    _, found, traced = followed(spark, chain)
    pairs = spark.createDataFrame([("stage", "label", "won", "it's won")], "table_name string, column_name string, old_value string, new_value string")
    broken = columns.broken_literals(pairs, found, traced, chain)
    rows = {(r.model_name, r.column_there, r.form, r.original_snippet, r.fixed_snippet) for r in broken.collect()}
    assert rows == {
        ("c", "s", "in", "s in ('lost', 'won')", "s in ('lost', 'it''s won')"),
        ("c", "s", "reversed", "'won' = s", "'it''s won' = s"),
    }
    (whole,) = columns.repaired_models(broken, chain).collect()
    assert whole.fixed_literals == 2 and whole.uncertain_literals == 0
    assert whole.fixed_sql.endswith("where s in ('lost', 'it''s won') and u = 'won' or 'it''s won' = s")


def test_uncertain_literals_are_named_and_left(spark):
    nodes = table(
        spark,
        SOURCE,
        node("src.deal", kind="source", source="crm"),
        node("m.a", "select 1 one from deal d join stage s on s.id = d.stage where label = 'won'", ["src.stage", "src.deal"]),
    )
    _, found, traced = followed(spark, nodes)
    pairs = spark.createDataFrame([("stage", "label", "won", "w")], "table_name string, column_name string, old_value string, new_value string")
    broken = columns.broken_literals(pairs, found, traced, nodes)
    assert [(r.certain, r.original_snippet) for r in broken.collect()] == [(False, "label = 'won'")]
    (whole,) = columns.repaired_models(broken, nodes).collect()
    assert (whole.fixed_literals, whole.uncertain_literals) == (0, 1) and whole.fixed_sql.endswith("label = 'won'")


def test_cycles_graphs_and_empty_tables(spark):
    nodes = table(
        spark,
        SOURCE,
        node("m.a", "select label from stage union all select y from {{ ref('b') }}", ["src.stage", "m.b"]),
        node("m.b", "select label as y from {{ ref('a') }}", ["m.a"]),
        node("src.stage", kind="source", source="crm", graph="h"),
        node("m.z", "select label as other from crm.stage", ["src.stage"], graph="h"),
        node("m.empty", "", ["src.stage"], graph="h"),
    )
    _, _, traced = followed(spark, nodes)
    rows = {(r.graph, r.uid, r.column) for r in traced.where("uid <> start_uid").collect()}
    assert rows == {("g", "m.a", "label"), ("g", "m.b", "y"), ("h", "m.z", "other")}
    none = nodes.limit(0)
    _, found, traced = followed(spark, none)
    assert found.count() == 0 and traced.count() == 0


def test_generated_models_against_a_plain_search(spark):
    """Random select lists: reach equals a search over the renames they were made from."""
    rng = random.Random(5)
    rows, links = [SOURCE], {}
    for i in range(60):
        above = rng.sample(["src.stage", *[f"m.n{j}" for j in range(i)]], min(i + 1, 2))
        items = []
        for up, alias in zip(above, "pq"):
            for _ in range(2):
                old, new = rng.choice(["label", "c1", "c2"]), rng.choice(["label", "c1", "c2", "c3"])
                items.append(f"{alias}.{old} as {new}")
                links.setdefault((up, old), set()).add((f"m.n{i}", new))
        relation = " cross join ".join(f"{{{{ ref('{u.split('.')[-1]}') }}}} {a}" if u != "src.stage" else f"crm.stage {a}" for u, a in zip(above, "pq"))
        rows.append(node(f"m.n{i}", f"select {', '.join(items)} from {relation}", above))
    expected, open_ = set(), [("src.stage", "label")]
    while open_:
        for reached in links.get(open_.pop(), ()):
            if reached not in expected:
                expected.add(reached)
                open_.append(reached)
    _, _, traced = followed(spark, table(spark, *rows))
    assert {(r.uid, r.column) for r in traced.where("uid <> start_uid").collect()} == expected and expected
    assert traced.where(~F.col("exact")).count() == 0


def test_models_are_scanned_once(spark, chain):
    plan = columns.column_facts(chain)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapIn") == 1


def test_manifests_are_made_in_many_tasks(spark):
    """A small table is one task to read, but its manifests are many times its size."""
    for made in (roles.renaming_manifests, roles.customer_manifests):
        assert made(spark, DATA).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))

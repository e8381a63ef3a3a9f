import json
import os
import random

import pytest
from pyspark.sql import functions as F

from driftlens.operators import lineage, reach, triage
from driftlens.operators.ordered import places
from driftlens.sources.manifest import manifest_nodes, read_manifest

PATH = os.path.join(os.path.dirname(__file__), "fixtures", "manifest.json")


@pytest.fixture(scope="module")
def nodes(spark):
    return read_manifest(spark, PATH).persist()


@pytest.fixture(scope="module")
def edges(nodes):
    return lineage.edges(nodes).persist()


def requests(spark, *pairs):
    return spark.createDataFrame(pairs, "source_table string, changed_column string")


def radius(spark, nodes, edges, *pairs):
    starts = lineage.find_sources(nodes, requests(spark, *pairs))
    return lineage.blast_radius(nodes, edges, starts), starts


def test_nodes_and_edges(nodes, edges):
    assert nodes.count() == 9
    named = {(r.src.split(".")[-1], r.dst.split(".")[-1]) for r in edges.collect()}
    assert named == {
        ("parcel", "base_parcel"),
        ("depot", "base_depot"),
        ("base_parcel", "lane_load"),
        ("base_depot", "lane_load"),
        ("base_depot", "lane_cost"),
        ("lane_load", "night_report"),
        ("lane_cost", "night_report"),
        ("night_report", "dispatch_screen"),
        ("lane_cost", "cost_sheet"),
    }


def test_later_map_wins_on_the_same_id(spark):
    text = '{"nodes":{"x":{"name":"old"},"y":{}},"sources":{"x":{"name":"new","resource_type":"source"}}}'
    rows = manifest_nodes(spark.createDataFrame([("g", text)], "graph string, value string")).collect()
    assert {(r.uid, r.name, r.resource_type) for r in rows} == {("x", "new", "source"), ("y", "y", "model")}


def test_branches_meet_again_at_their_shortest_hop(spark, nodes, edges):
    blast, _ = radius(spark, nodes, edges, ("depot", "mode"))
    rows = [(r.hop, r.name, r.severity, r.owner, r.references_column) for r in blast.orderBy("hop", "name").collect()]
    assert rows == [
        (1, "base_depot", "critical", None, True),
        (2, "lane_cost", "high", None, False),
        (2, "lane_load", "high", None, False),
        (3, "cost_sheet", "medium", "costs@example.org", False),
        (3, "night_report", "medium", None, False),
        (4, "dispatch_screen", "low", "Night desk", False),
    ]


def test_look_up_by_qualified_name_unknown_name_and_without_column(spark, nodes, edges):
    blast, starts = radius(spark, nodes, edges, ("ops.depot", "mode"), ("warehouse", "mode"), ("parcel", ""))
    assert {r.source_table for r in starts.collect()} == {"ops.depot", "parcel"}
    rows = blast.collect()
    assert len([r for r in rows if r.source_table == "ops.depot"]) == 6
    parcel = [r for r in rows if r.source_table == "parcel"]
    assert {r.name for r in parcel} == {"base_parcel", "lane_load", "night_report", "dispatch_screen"}
    assert not any(r.references_column for r in parcel)


def test_column_match_is_a_substring_test(spark, nodes, edges):
    blast, _ = radius(spark, nodes, edges, ("depot", "loor_ar"))
    assert {r.name for r in blast.where("references_column").collect()} == {"base_depot", "lane_cost"}


def test_summary(spark, nodes, edges):
    asked = requests(spark, ("parcel", "weight"), ("barn", "weight"), ("depot", None))
    blast = lineage.blast_radius(nodes, edges, lineage.find_sources(nodes, asked))
    rows = lineage.summary_lines(asked, blast).orderBy("source_table", "hop", "uid").collect()
    assert [r.line for r in rows if r.source_table == "parcel"] == [
        "Blast radius for parcel.weight:",
        "  [CRITICAL] model: base_parcel [references column]",
        "  [HIGH] model: lane_load [references column]",
        "  [MEDIUM] model: night_report",
        "  [LOW] exposure: dispatch_screen (owner: Night desk)",
    ]
    assert [r.line for r in rows if r.source_table == "barn"] == ["No downstream dependencies for barn.weight"]
    unnamed = [r.line for r in rows if r.source_table == "depot"]
    assert unnamed[0] == "Blast radius for depot:" and len(unnamed) == 7


def test_models_sql(spark, nodes):
    names = spark.createDataFrame([("base_depot",), ("lane_cost",), ("night_report",), ("cost_sheet",)], "name string")
    rows = {r.name: (r.file_path, r.sql) for r in lineage.models_sql(nodes, names).collect()}
    assert set(rows) == {"base_depot", "lane_cost", "night_report"}
    assert rows["base_depot"][0] == "models/base/base_depot.sql"
    assert rows["lane_cost"] == ("lanes/lane_cost.sql", "select depot_id, floor_area * 3 as cost from base_depot")
    assert rows["night_report"][0] == "models/night_report.sql"


def test_display_edges_layers_and_owners(spark, nodes, edges):
    blast, starts = radius(spark, nodes, edges, ("parcel", "weight"))
    reached = lineage.reachable(edges, starts)
    shown = lineage.display_nodes(blast, starts).orderBy("hop").collect()
    assert [(r.id, r.severity) for r in shown][0] == ("parcel", "flagged") and len(shown) == 5
    pairs = {(r.from_name, r.to_name) for r in lineage.blast_edges(nodes, edges, starts, reached).collect()}
    assert pairs == {("parcel", "base_parcel"), ("base_parcel", "lane_load"), ("lane_load", "night_report"), ("night_report", "dispatch_screen")}
    assert {(r.hop, r.nodes) for r in lineage.hop_layers(reached).collect()} == {(1, 1), (2, 1), (3, 1), (4, 1)}
    assert [(r.owner, r.asset_count) for r in lineage.affected_owners(blast).collect()] == [("Night desk", 4)]


def test_graphs_that_share_ids_stay_apart(spark):
    def document(downstream):
        models = {d: {"name": d, "depends_on": {"nodes": ["s"]}} for d in downstream}
        return json.dumps({"nodes": models, "sources": {"s": {"name": "t", "resource_type": "source"}}})

    texts = [("first", document(["a", "b"])), ("second", document(["b", "c"]))]
    nodes = manifest_nodes(spark.createDataFrame(texts, "graph string, value string"))
    blast, _ = radius(spark, nodes, lineage.edges(nodes), ("t", "x"))
    assert {(r.graph, r.name) for r in blast.collect()} == {("first", "a"), ("first", "b"), ("second", "b"), ("second", "c")}


def test_random_graph_with_cycles_against_plain_search(spark):
    rng = random.Random(7)
    pairs = {(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(110)} | {("n0", f"n{i}") for i in range(20, 40)}
    edges = spark.createDataFrame(sorted(pairs), "src string, dst string")
    starts = spark.createDataFrame([("n0",), ("n1",), ("n2",)], "start_uid string")
    got = {(r.start_uid, r.uid): r.hop for r in lineage.reachable(edges, starts).collect()}
    expected = {}
    for start in ("n0", "n1", "n2"):
        distance, frontier = {start: 0}, [start]
        while frontier:
            step = []
            for node in frontier:
                for a, b in pairs:
                    if a == node and b not in distance:
                        distance[b] = distance[node] + 1
                        step.append(b)
            frontier = step
        expected.update({(start, n): h for n, h in distance.items() if h})
    assert got == expected
    near = lineage.reachable(edges, starts, max_hops=1).collect()
    assert {(r.start_uid, r.uid) for r in near} == {k for k, h in expected.items() if h == 1}


def plain_reach(pairs, starts):
    out = {}
    for start in starts:
        distance, frontier = {start: 0}, [start]
        while frontier:
            step = []
            for node in frontier:
                for a, b in pairs:
                    if a == node and b not in distance:
                        distance[b] = distance[node] + 1
                        step.append(b)
            frontier = step
        out.update({(start, n): h for n, h in distance.items() if h})
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_reach_is_kept_up_when_edges_come_and_go(spark, seed):
    rng = random.Random(seed)
    old = {(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(90)} | {("n0", f"n{i}") for i in range(5, 12)}
    gone = set(rng.sample(sorted(old), 15)) if seed != 2 else set()
    new = (old - gone) | ({(f"n{rng.randrange(44)}", f"n{rng.randrange(44)}") for _ in range(8)} if seed != 3 else set())
    names = ["n0", "n1", "n2"]
    graphs = ["g", "h"]  # nothing changes in the second

    def frame(by):
        return spark.createDataFrame([(g, *e) for g in graphs for e in sorted(by[g])], "graph string, src string, dst string")

    starts = spark.createDataFrame([(g, n) for g in graphs for n in names], "graph string, start_uid string")
    before, after = frame({"g": old, "h": old}), frame({"g": new, "h": old})
    reached = lineage.reachable(before, starts)
    changes = reach.reach_changes(reached, before, after, starts)
    first, last = plain_reach(old, names), plain_reach(new, names)
    expected = {(s, n): (first.get((s, n)), last.get((s, n))) for s, n in first.keys() | last.keys() if first.get((s, n)) != last.get((s, n))}
    rows = changes.collect()
    assert {r.graph for r in rows} == {"g"}
    assert {(r.start_uid, r.uid): (r.hop_before, r.hop_after) for r in rows} == expected and expected
    kept_up = {(r.graph, r.start_uid, r.uid): r.hop for r in reach.with_changes(reached, changes).collect()}
    assert kept_up == {("g", *k): h for k, h in last.items()} | {("h", *k): h for k, h in first.items()}


def test_a_change_at_a_leaf_and_no_change_at_all(spark):
    chain = [(f"n{i}", f"n{i + 1}") for i in range(6)]
    edges = spark.createDataFrame(chain, "src string, dst string")
    starts = spark.createDataFrame([("n0",)], "start_uid string")
    reached = lineage.reachable(edges, starts)
    fewer = spark.createDataFrame(chain[:-1], "src string, dst string")
    assert [(r.uid, r.hop_before, r.hop_after) for r in reach.reach_changes(reached, edges, fewer, starts).collect()] == [("n6", 6, None)]
    assert reach.reach_changes(reached, edges, edges, starts).count() == 0


def test_hop_positions(spark):
    reached = spark.createDataFrame([("s", f"n{i:03d}", 1 if i < 90 else 2) for i in range(100)], "start_uid string, uid string, hop int")
    rows = lineage.hop_positions(reached).collect()
    assert {(r.uid, r.place) for r in rows if r.hop == 1} == {(f"n{i:03d}", i) for i in range(90)}
    assert {(r.uid, r.place) for r in rows if r.hop == 2} == {(f"n{90 + i:03d}", i) for i in range(10)}


def test_stale_literal_is_found_and_fixed(spark, nodes, edges):
    blast, _ = radius(spark, nodes, edges, ("depot", "mode"))
    pairs = spark.createDataFrame(
        [("depot", "mode", "rail", "rail 'n' road"), ("depot", "mode", "pipe", "tube")],
        "table_name string, column_name string, old_value string, new_value string",
    )
    (fix,) = triage.stale_literals(pairs, blast, nodes).collect()
    assert fix.model_name == "base_depot" and fix.file_path == "models/base/base_depot.sql"
    assert fix.original_snippet == "d.mode = 'rail'"
    assert fix.fixed_snippet == "d.mode = 'rail ''n'' road'"
    assert fix.fixed_sql.endswith("where d.mode = 'rail ''n'' road'")


def test_manifest_parts_are_not_merged(spark):
    """Rows that pack well are dealt over all parts, also where few packed bytes would be merged into one."""
    text = '{"nodes": {%s}}' % ", ".join(f'"n{i}": {{"name": "n{i}"}}' for i in range(200))
    nodes = manifest_nodes(spark.createDataFrame([("g", text)], "graph string, value string"))
    parts = {r.part for r in nodes.select(F.spark_partition_id().alias("part")).collect()}
    assert len(parts) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert nodes.count() == 200


def test_edges_and_hops_with_repeats(spark):
    """Nodes that come twice, dependencies named twice and nodes without an id."""
    rows = [("a", []), ("b", ["a", "a", "x"]), ("b", ["a"]), ("c", ["b", "a"]), (None, ["a", "b"]), ("d", None)]
    edges = lineage.edges(spark.createDataFrame(rows, "uid string, depends_on array<string>"))
    assert sorted((r.src, r.dst or "") for r in edges.collect()) == [("a", ""), ("a", "b"), ("a", "c"), ("b", ""), ("b", "c")]
    # one exchange deals the pairs, for the join and for making them distinct
    plan = edges._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("Join")
    starts = spark.createDataFrame([("a",)], "start_uid string")
    found = sorted((r.uid or "", r.hop) for r in lineage.reachable(edges, starts).collect())
    assert found == [("", 1), ("", 2), ("b", 1), ("c", 1)]


def test_a_missing_node_that_all_name_is_looked_up_once(spark, monkeypatch):
    """What is unknown is one row however many nodes name it, so that no task gets all of their pairs."""
    rows = [(f"n{i}", [f"n{i // 2}", "nowhere", None, "nowhere"]) for i in range(1, 400)] + [("n0", None), ("n7", ["n0"]), ("n7", ["n0"])]
    nodes = spark.createDataFrame(rows, "uid string, depends_on array<string>")
    written = {}
    monkeypatch.setattr(lineage, "stage", lambda df, label: written.setdefault(label, df))
    edges = lineage.edges(nodes)
    assert [tuple(r) for r in written["missing"].collect()] == [("", "nowhere")]
    assert sorted((r.src, r.dst) for r in edges.collect()) == sorted([(f"n{i // 2}", f"n{i}") for i in range(1, 400)] + [("n0", "n7")])


def test_staged_edges_are_not_written_again(spark, monkeypatch):
    nodes = spark.createDataFrame([("g", "a", []), ("g", "b", ["a"]), ("h", "b", ["a"])], "graph string, uid string, depends_on array<string>")
    edges = lineage.stage_edges(nodes)
    starts = spark.createDataFrame([("g", "a"), ("h", "a")], "graph string, start_uid string")
    labels, write = [], lineage.stage_bucketed
    monkeypatch.setattr(lineage, "stage_bucketed", lambda df, label, *keys, **more: labels.append(label) or write(df, label, *keys, **more))
    assert [tuple(r) for r in lineage.reachable(edges, starts).collect()] == [("g", "a", "b", 1)] and labels == []
    assert lineage.reachable(edges.limit(1), starts).count() == 1 and labels == ["edges"]


def test_changed_edges_are_told_apart_in_one_grouping(spark, monkeypatch):
    starts = spark.createDataFrame([("n0",)], "start_uid string")
    old = spark.createDataFrame([("n0", "n1"), ("n0", "n1"), ("n1", "n2"), ("n2", None)], "src string, dst string")
    new = spark.createDataFrame([("n0", "n1"), ("n0", "n2"), ("n0", "n2"), ("n2", None)], "src string, dst string")
    written, write = {}, reach.stage
    monkeypatch.setattr(reach, "stage", lambda df, label: written.setdefault(label, write(df, label)))
    changes = reach.reach_changes(lineage.reachable(old, starts), old, new, starts)
    assert sorted((r.src, r.dst, r["was"], r["is"]) for r in written["differing"].collect()) == [("n0", "n2", 0, 1), ("n1", "n2", 1, 0)]
    assert [(r.uid, r.hop_before, r.hop_after) for r in changes.collect()] == [("n2", 2, 1)]


def odd_nodes(spark, rng):
    """Nodes of two graphs with cycles, repeats, missing and null dependencies, and nodes without an id."""
    rows = [(g, f"n{i}", [f"n{rng.randrange(50)}" for _ in range(rng.randrange(4))] + ["nowhere", None], f"name {i % 7}") for g in "gh" for i in range(60)]
    rows += rows[:9] + [("g", None, ["n1", "n2", "n3"], "none"), ("h", "n5", None, "again"), (None, "n1", ["n2"], "lost")]
    return spark.createDataFrame(rows, "graph string, uid string, depends_on array<string>, name string").select(
        "*", F.lit("model").alias("resource_type"), F.lit(0).alias("position")
    )


@pytest.mark.parametrize("max_hops", [None, 0, 1, 3])
@pytest.mark.parametrize("ends", [True, False])
def test_ends_of_the_graph_are_found_once(spark, monkeypatch, max_hops, ends):
    """Nodes that lead nowhere are in no hop of the search, and the result is that of a search over all edges."""
    nodes = odd_nodes(spark, random.Random(11))
    plain = lineage.edges(nodes)
    laid = lineage.stage_edges(lineage.stage_nodes(nodes), ends)
    assert sorted(map(str, laid.collect())) == sorted(map(str, plain.collect()))
    starts = spark.createDataFrame([(g, n) for g in "gh" for n in ("n1", "n4", "n59")], "graph string, start_uid string")
    expected = sorted(map(str, lineage.reachable(plain, starts, max_hops).collect()))
    added, add = [], lineage.Growing.add
    monkeypatch.setattr(lineage.Growing, "add", lambda self, rows: added.append(rows) or add(self, rows))
    assert sorted(map(str, lineage.reachable(laid, starts, max_hops).collect())) == expected
    leading = {(r.graph, r.src) for r in plain.collect()}
    hops = [{(r.graph, r.uid) for r in rows.collect()} for rows in added[1:]]
    assert all(nodes <= leading for nodes in hops[:-1]) and not (hops[-1] & leading)


def test_a_frontier_meets_edges_and_nodes_where_it_lies(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        nodes = lineage.stage_nodes(odd_nodes(spark, random.Random(12)).select("*", *[F.lit("").alias(c) for c in ("raw_code", "raw_sql", "compiled_code", "owner_name", "owner_email")]))
        starts = spark.createDataFrame([("g", "n1", "t", "c")], "graph string, start_uid string, source_table string, changed_column string")
        reached = lineage.in_place(lineage.reachable(lineage.stage_edges(nodes), starts))
        names = lineage.in_place(nodes).select("place", "name")
        plan = reached.join(names, "place")._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(place" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_edges_among_what_is_reached_without_asking_who_reaches_it(spark):
    nodes = lineage.stage_nodes(odd_nodes(spark, random.Random(13)))
    laid = lineage.stage_edges(nodes)
    starts = spark.createDataFrame([(g, f"n{i}") for g in "gh" for i in (*range(6), 59)], "graph string, start_uid string")
    reached = lineage.reachable(laid, starts)
    whole = lineage.blast_edges(nodes, laid, starts, reached)
    asked = lineage.blast_edges(nodes, laid, starts, reached.select("*"))  # another frame: nothing is known of it
    found = whole.collect()
    assert sorted(map(str, found)) == sorted(map(str, asked.collect())) and found
    assert "key" not in whole._jdf.queryExecution().optimizedPlan().toString()
    near = lineage.reachable(laid, starts, max_hops=1)
    few = {tuple(r) for r in lineage.blast_edges(nodes, laid, starts, near).collect()}
    assert few < {tuple(r) for r in found}


def test_places_need_no_exchange_after_the_ranges(spark):
    rows = [(g, f"n{i:03d}" if i else None) for g in ("a", "b", None) for i in range(50)]
    frame = spark.createDataFrame(rows, "graph string, uid string").repartition(5)
    got = places(frame, ["uid"], "place", ["graph"], chunks=4)
    assert {(r.graph, r.uid, r.place) for r in got.collect()} == {(g, f"n{i:03d}" if i else None, i) for g in ("a", "b", None) for i in range(50)}
    assert "hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()


def test_owners_read_the_blast_once(spark, monkeypatch):
    rows = [("t", "a"), ("t", "a"), ("t", None), ("u", None), (None, "b")]
    labels, write = [], lineage.stage
    monkeypatch.setattr(lineage, "stage", lambda df, label: labels.append(label) or write(df, label))
    owners = lineage.affected_owners(spark.createDataFrame(rows, "source_table string, owner string"))
    assert [(r.source_table, r.owner, r.asset_count) for r in owners.collect()] == [("t", "a", 3)] and labels == ["owned"]


def test_upkeep_reads_edges_and_reach_where_they_lie(spark, monkeypatch):
    """Edges and reach that lie by place are not written again; only the reach by pair and what changes is."""
    rng = random.Random(5)
    nodes = lineage.stage_nodes(odd_nodes(spark, rng))
    old = lineage.stage_edges(nodes)
    kept = old.where("dst is null or dst not in ('n3', 'n7', 'n55')")
    new = lineage.lay_edges(kept.unionByName(spark.createDataFrame([("g", "n1", "n55"), ("h", "n2", "n3")], "graph string, src string, dst string")))
    starts = spark.createDataFrame([(g, n) for g in "gh" for n in ("n1", "n2", "n4")], "graph string, start_uid string")
    reached = lineage.reachable(old, starts)
    labels, made = [], reach.Growing.__init__
    monkeypatch.setattr(reach.Growing, "__init__", lambda self, spark, label, *keys: labels.append(label) or made(self, spark, label, *keys))
    changes = reach.reach_changes(reached, old, new, starts)
    assert labels == ["held", "lost", "gained"]
    first = {(r.graph, r.start_uid, r.uid): r.hop for r in reached.where("uid is not null").collect()}
    last = {(r.graph, r.start_uid, r.uid): r.hop for r in lineage.reachable(new, starts).where("uid is not null").collect()}
    got = {(r.graph, r.start_uid, r.uid): (r.hop_before, r.hop_after) for r in changes.collect()}
    assert got == {k: (first.get(k), last.get(k)) for k in first.keys() | last.keys() if first.get(k) != last.get(k)} and got

"""Dependency graph: edges, blast radius from many sources at once, owners and affected SQL.

Nodes come from a manifest (see ``sources.manifest``) or any frame with a ``uid`` column; edges are (src, dst) pairs
from upstream to downstream. Ids belong to a graph: ``graph`` is part of every key, so many manifests that use the same
ids are searched together and stay apart. A frame without it is one graph, named by the empty text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import not_blank, severity
from ..staging import Growing, deal, stage, stage_bucketed


def in_graph(rows: DataFrame) -> DataFrame:
    return rows if "graph" in rows.columns else rows.withColumn("graph", F.lit(""))


def placed(rows: DataFrame, column: str = "uid") -> DataFrame:
    """Rows with the ``place`` that the node named in ``column`` has. Different nodes may share one."""
    return rows.withColumn("place", F.hash("graph", column))


def same(*pairs: tuple[str, str]) -> Column:
    """Whether columns are equal, for rows that meet by ``place``: written so that joins do not exchange rows by them."""
    told = F.lit(True)
    for one, other in pairs:
        told = told & (F.col(one) <= F.col(other)) & (F.col(one) >= F.col(other))
    return told


def _shown(lies: DataFrame, *columns: str) -> DataFrame:
    """Columns of what lies dealt by ``place``, which ``in_place`` finds again."""
    rows = lies.select(*columns)
    rows._in_place = lies
    return rows


def in_place(rows: DataFrame, column: str = "uid") -> DataFrame:
    """Rows with their ``place``: as they lie where they are dealt by it, else to be exchanged by it."""
    return getattr(rows, "_in_place", None) or placed(in_graph(rows), column)


def links(edge_rows: DataFrame) -> tuple[DataFrame, ...]:
    """Edges with the ``place`` of their upstream end: of ``stage_edges`` those that lead on and those that do not."""
    return getattr(edge_rows, "_links", None) or (placed(in_graph(edge_rows).select("graph", "src", "dst"), "src"),)


def stage_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes written once, bucketed by their place, so that what is found about nodes meets them without an exchange.

    Only of sources the position is asked for, and kept.
    """
    given = in_graph(nodes).withColumn("position", F.when(F.col("resource_type") == "source", F.col("position")))
    written = Growing(nodes.sparkSession, "nodes", "place").add(deal(placed(given), "place"))
    return _shown(written, *given.columns)


def _pairs(nodes: DataFrame, parted: bool = False) -> list[DataFrame]:
    """``edges`` with the place of their upstream end, dealt by it; ``parted`` into those that lead on and those that do not."""
    known, spark = in_place(nodes), nodes.sparkSession
    # only a node that comes twice gives a pair twice; nodes that merely share a hash do no harm here
    told = known.groupBy("place", F.xxhash64("graph", "uid")).count().where("count > 1").select("place")
    repeated = not stage(told, "repeated").isEmpty()

    def once(rows: DataFrame) -> DataFrame:
        return rows.distinct() if repeated else rows

    def named(rows: DataFrame, *more: str) -> DataFrame:
        rows = rows.select("graph", F.explode(F.array_distinct("depends_on")).alias("src"), *more)
        return rows.where("graph is not null and src is not null")

    there = known.select(F.col("place").alias("known_place"), F.col("graph").alias("known_graph"), F.col("uid").alias("known_uid"))
    node = (F.col("place") == F.col("known_place")) & same(("graph", "known_graph"), ("src", "known_uid"))
    looked_up = deal(placed(named(known).distinct(), "src"), "place").join(there, node, "left")
    looked_up = once(looked_up.select("place", "graph", "src", F.col("known_uid").isNotNull().alias("known")))
    names = Growing(spark, "names", "place").add(looked_up)
    missing = stage(names.where("not known").select("graph", "src"), "missing")

    def pairs(rows: DataFrame) -> DataFrame:
        rows = named(rows.withColumnRenamed("uid", "dst"), "dst").join(missing, ["graph", "src"], "left_anti")
        return once(deal(placed(rows, "src"), "place"))

    if not parted:
        return [pairs(known)]
    leading = names.where("known").select(F.col("place").alias("up_place"), F.col("graph").alias("up_graph"), F.col("src").alias("up"))
    leads = (F.col("place") == F.col("up_place")) & same(("graph", "up_graph"), ("uid", "up"))
    return [pairs(known.join(leading.hint("shuffle_hash"), leads, how)) for how in ("left_semi", "left_anti")]


def edges(nodes: DataFrame) -> DataFrame:
    """Distinct upstream-to-downstream pairs of each graph; dependencies on unknown nodes are dropped.

    What nodes depend on is made distinct before it is looked up, and what is unknown is written down: a missing node
    that most nodes name is one row there, and its pairs go before any exchange. The rest are dealt by the place of their
    upstream end once, and in that place they are made distinct, where a node comes twice.
    """
    return _pairs(nodes)[0].select("graph", "src", "dst")


def stage_edges(nodes: DataFrame, ends: bool = True) -> DataFrame:
    """``edges`` as ``reachable`` reads them, written bucketed by the place of their upstream end from where they lie.

    Those whose downstream end leads on lie apart from the others, which no search follows from hop to hop. Without ``ends``
    the others are not written but made where they are read, which is less work when that is once.
    """
    parts = [rows.select("place", "graph", "src", "dst") for rows in _pairs(nodes, parted=True)]
    parts[0] = Growing(nodes.sparkSession, "edges", "place").add(parts[0])
    if ends:
        parts[1] = Growing(nodes.sparkSession, "edges", "place").add(parts[1])
    rows = parts[0].unionByName(parts[1]).select("graph", "src", "dst")
    rows._links = tuple(parts)
    return rows


def lay_edges(edge_rows: DataFrame) -> DataFrame:
    """Any edges written once as they are, bucketed by the place of their upstream end."""
    written = Growing(edge_rows.sparkSession, "edges", "place").add(deal(links(edge_rows)[0], "place"))
    rows = written.select("graph", "src", "dst")
    rows._links = (written,)
    return rows


def find_sources(nodes: DataFrame, requests: DataFrame) -> DataFrame:
    """Source node of each requested ``source_table`` in each graph: by table name or by source and table, first match.

    Requests that match nothing give no row.
    """
    sources = in_graph(nodes).where("resource_type = 'source'").select(
        "graph",
        "uid",
        "position",
        F.explode(
            F.array_distinct(F.array(F.col("name"), F.concat_ws(".", "source_name", "name")))
        ).alias("source_table"),
    )
    return (
        requests.join(sources, "source_table")
        .groupBy(*requests.columns, "graph")
        .agg(F.min_by("uid", "position").alias("start_uid"))
    )


def reachable(edge_rows: DataFrame, starts: DataFrame, max_hops: int | None = None) -> DataFrame:
    """Every node reachable from each start, with its shortest hop: (graph, start_uid, uid, hop), starts excluded.

    A breadth-first search by joins: each hop joins the frontier with the edges, keeps what was not reached before, once
    per (start, node), and writes it down. Edges and hops are written bucketed by the place of the node, so that a frontier
    meets the edges where it lies and only what it finds moves. Edges of ``stage_edges`` are followed only where they lead
    on; the nodes at the ends are found once, from all hops together. All starts advance together, cycles end by themselves,
    and only the emptiness of a hop is looked at outside the cluster.
    """
    spark, (linked, *last) = edge_rows.sparkSession, links(edge_rows)
    if not last:
        linked = stage_bucketed(linked, "edges", "place")
    node = ["place", "graph", "start_uid", "uid"]

    def downstream(rows: DataFrame, pairs: DataFrame) -> DataFrame:
        met = (F.col("f.place") == F.col("e.place")) & same(("f.graph", "e.graph"), ("f.uid", "e.src"))
        found = rows.alias("f").join(pairs.alias("e"), met)
        return placed(found.select("f.graph", "f.start_uid", F.col("e.dst").alias("uid"), (F.col("f.hop") + 1).alias("hop")))

    begun = in_graph(starts).select("graph", "start_uid", F.col("start_uid").alias("uid"), F.lit(0).alias("hop")).distinct()
    log = Growing(spark, "reached", "place")
    leads = F.lit(True).alias("leads")
    reached = log.add(deal(placed(begun).select(*node, "hop", leads), "place"))
    hop = 0
    while max_hops is None or hop < max_hops:
        found = downstream(reached.where(F.col("hop") == hop), linked).select(*node, "hop")
        hop += 1
        # one grouping drops what comes twice and what an earlier hop reached
        rows = deal(found.unionByName(reached.where("uid is not null").select(*node, "hop")), "place")
        first = rows.groupBy(*node).agg(F.min("hop").alias("hop")).where(F.col("hop") == hop)
        reached = log.add(first.select("*", leads))
        if reached.where(F.col("hop") == hop).isEmpty():
            break
    for ends in last:
        from_hops = reached if max_hops is None else reached.where(F.col("hop") < max_hops)
        rows = deal(downstream(from_hops, ends), "place")
        # what has no id is never the same
        unknown = F.when(F.col("uid").isNull(), F.col("hop")).alias("unknown")
        first = rows.groupBy(*node, unknown).agg(F.min("hop").alias("hop"))
        reached = log.add(first.select(*node, "hop", F.lit(False).alias("leads")))
    shown = _shown(reached.where("hop > 0"), "graph", "start_uid", "uid", "hop")
    if max_hops is None:
        shown._whole = (edge_rows, starts, reached.where("leads"))
    return shown


def node_sql(nodes: DataFrame) -> Column:
    """A node's SQL: the first of raw code, raw SQL and compiled code that is not empty."""
    return F.coalesce(not_blank(nodes["raw_code"]), not_blank(nodes["raw_sql"]), not_blank(nodes["compiled_code"]), F.lit(""))


def blast_radius(
    nodes: DataFrame, edge_rows: DataFrame, starts: DataFrame, max_hops: int | None = None
) -> DataFrame:
    """Downstream nodes of each (source_table, changed_column, start_uid), nearest first by ``hop``."""
    reached = in_place(reachable(edge_rows, starts, max_hops))
    described = in_place(nodes).select(
        F.col("place").alias("node_place"),
        F.col("graph").alias("node_graph"),
        F.col("uid").alias("node_uid"),
        "resource_type",
        "name",
        F.when(F.col("resource_type") == "exposure", F.coalesce(not_blank(F.col("owner_name")), "owner_email")).alias("owner"),
        node_sql(nodes).alias("sql"),
    )
    column = F.coalesce("changed_column", F.lit(""))
    return (
        reached.join(in_graph(starts), ["graph", "start_uid"])
        .join(described, (F.col("place") == F.col("node_place")) & same(("graph", "node_graph"), ("uid", "node_uid")))
        .select(
            "source_table",
            "changed_column",
            "graph",
            "start_uid",
            "uid",
            "hop",
            F.col("resource_type").alias("node_type"),
            "name",
            severity(F.col("hop")).alias("severity"),
            "owner",
            F.when(column != "", F.contains("sql", column)).otherwise(F.lit(False)).alias("references_column"),
        )
    )


def blast_edges(nodes: DataFrame, edge_rows: DataFrame, starts: DataFrame, reached: DataFrame) -> DataFrame:
    """Edges among a start and what it reaches, by node name; nodes of equal name merge.

    Names and downstream ends are found in place. Where ``reached`` is, as it stands, what ``reachable`` gave without a limit
    for these edges and starts, the far end of every edge is reached as well, and one exchange brings it to its name.
    Otherwise one brings it to where its start reaches it.
    """
    names = in_place(nodes).select("place", "graph", "uid", "name").alias("n")
    met = (F.col("m.place") == F.col("n.place")) & same(("m.graph", "n.graph"), ("m.uid", "n.uid"))
    led = (F.col("m.place") == F.col("e.place")) & same(("m.graph", "e.graph"), ("m.uid", "e.src"))

    def named(members: DataFrame) -> DataFrame:
        return members.alias("m").join(names, met).select("m.place", "m.graph", "m.start_uid", "m.uid", "n.name")

    def downstream(members: DataFrame) -> list[DataFrame]:
        ends = [named(members).alias("m").join(pairs.alias("e"), led) for pairs in links(edge_rows)]
        return [e.select("m.graph", "m.start_uid", F.col("e.dst").alias("uid"), F.col("m.name").alias("from_name")) for e in ends]

    whole = getattr(reached, "_whole", None)
    if whole and whole[0] is edge_rows and whole[1] is starts:
        far = deal(placed(reduce(DataFrame.unionByName, downstream(whole[2]))), "place")
        pairs = far.alias("m").join(names, met).select("m.graph", "m.start_uid", "m.from_name", F.col("n.name").alias("to_name"))
    else:
        given = placed(in_graph(starts).select("graph", "start_uid", F.col("start_uid").alias("uid")))
        members = [in_place(reached), given]
        # a key that is a number sorts many times faster than texts do
        key = F.xxhash64("graph", "start_uid", "uid").alias("key")
        far = reduce(DataFrame.unionByName, [e for m in members for e in downstream(m)]).select("*", key)
        there = reduce(DataFrame.unionByName, [named(m).drop("place") for m in members]).select("*", key)
        pairs = far.join(there.withColumnRenamed("name", "to_name"), ["key", "graph", "start_uid", "uid"])
    return pairs.select("graph", "start_uid", "from_name", "to_name").distinct()


def models_sql(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """SQL and file path of the models with the given ``name``s."""
    models = in_graph(nodes).where("resource_type = 'model'").join(names.select("name").distinct(), "name", "left_semi")
    return models.select(
        "graph",
        "uid",
        "name",
        F.coalesce(
            not_blank(F.col("original_file_path")),
            not_blank(F.col("path")),
            F.concat(F.lit("models/"), F.col("name"), F.lit(".sql")),
        ).alias("file_path"),
        F.coalesce(not_blank(F.col("raw_code")), not_blank(F.col("raw_sql")), F.lit("")).alias("sql"),
    )


def summary_lines(requests: DataFrame, blast: DataFrame) -> DataFrame:
    """The text summary of every requested (source_table, changed_column): a heading, then one line per node.

    Lines read in (hop, graph, uid) order. A request without downstream nodes, or with an unknown source, says so.
    """
    key = ["source_table", "changed_column"]
    subject = F.concat_ws(".", *key)
    owner = F.coalesce(F.concat(F.lit(" (owner: "), F.col("owner"), F.lit(")")), F.lit(""))
    flag = F.when(F.col("references_column"), " [references column]").otherwise("")
    line = F.concat(
        F.lit("  ["), F.upper("severity"), F.lit("] "), F.col("node_type"), F.lit(": "), F.col("name"), owner, flag
    )
    asked = requests.select(*key).distinct()
    found = blast.select(*[F.col(c).alias(f"found_{c}") for c in key]).distinct().withColumn("found", F.lit(True))
    same = F.col(key[0]).eqNullSafe(F.col(f"found_{key[0]}")) & F.col(key[1]).eqNullSafe(F.col(f"found_{key[1]}"))
    headings = asked.join(found, same, "left").select(
        *key,
        F.lit(0).alias("hop"),
        F.lit("").alias("graph"),
        F.lit("").alias("uid"),
        F.when(F.col("found"), F.concat(F.lit("Blast radius for "), subject, F.lit(":")))
        .otherwise(F.concat(F.lit("No downstream dependencies for "), subject))
        .alias("line"),
    )
    return headings.unionByName(blast.select(*key, "hop", "graph", "uid", line.alias("line")))


def display_nodes(blast: DataFrame, starts: DataFrame) -> DataFrame:
    """Graph nodes for display: the flagged source first, then everything downstream."""
    source = in_graph(starts).select(
        "source_table",
        "graph",
        F.lit(0).alias("hop"),
        F.col("source_table").alias("id"),
        F.lit("source").alias("node_type"),
        F.lit("flagged").alias("severity"),
        F.lit(None).cast("string").alias("owner"),
        F.lit(False).alias("references_column"),
    )
    return source.unionByName(
        blast.select(
            "source_table", "graph", "hop", F.col("name").alias("id"), "node_type", "severity", "owner", "references_column"
        )
    )


def hop_layers(reached: DataFrame) -> DataFrame:
    """Size of every layer per start."""
    return reached.groupBy("graph", "start_uid", "hop").agg(F.count(F.lit(1)).alias("nodes"))


def hop_positions(reached: DataFrame) -> DataFrame:
    """Place of each node inside its layer, in ``uid`` order from 0.

    A layer may hold most of the graph, so the places are counted chunk by chunk.
    """
    from .ordered import places

    rows = in_graph(reached).select("graph", "start_uid", "hop", "uid")
    return places(rows, ["uid"], "place", group=["graph", "start_uid", "hop"])


def affected_owners(blast: DataFrame) -> DataFrame:
    """Affected assets and distinct named owners per incident source."""
    # one pass over what is affected
    owned = stage(blast.groupBy("source_table", "owner").agg(F.count(F.lit(1)).alias("n")), "owned")
    assets = owned.groupBy("source_table").agg(F.sum("n").alias("asset_count"))
    owners = owned.where("owner is not null").select("source_table", "owner")
    return owners.join(assets, "source_table")

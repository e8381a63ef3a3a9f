"""Hard negatives by a multiway hyperplane tree with distance ranges.

Scores are inner products of integer vectors. One more coordinate, sqrt(M^2 - |x|^2) with M the largest norm, gives every
row the same norm, and a query takes 0 there: the distance of a query to a row is then sqrt(|q|^2 + M^2 - 2 score), so a
window of scores is an annulus around the query, and "the best under a mark" is its inner edge.

A node of the tree has several split points; a row goes to its nearest one. For every pair (split point, sibling) the node
keeps the least and the greatest distance of the sibling's rows to the split point. A sibling is passed over when, by one
of these ranges and the triangle inequality, no row of it can lie in the annulus, or when its labels rule it out. Leaves
are computed exactly, on integers. As a query finds rows, its annulus narrows.

On Spark the root is a table: its split points come from a bounded sample, every row of the table goes to its nearest one,
and the ranges are grouped minima and maxima. A cell's rows are dealt by a hash to blocks of bounded size, and each block
holds a tree of its own. Queries travel in packs to the blocks of the cells that the root's ranges leave over. Positives
are searched twice: in the query's own cell for a first mark, then wherever that mark cannot exclude. Results are exact;
the sample only decides how much is passed over.

Defined results: rows whose label or vector is null, or whose vector is empty or holds a null or non-finite component,
take no part, nor do rows with a null id; vectors of another length than the first row's (smallest id) take no part; of
rows with one id the one with the smallest label and vector counts; equal rows of different ids are rows of their own;
equal scores are ordered by id; an empty table gives an empty result; other columns are not read. Components too large for
exact inner products are an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlens.llm.workers import map_arrow
from driftlens.staging import stage

CELLS = 16
SAMPLE_ROWS = 2048
BLOCK_ROWS = 4096
PACK_ROWS = 256
FAN_OUT = 8
LEAF_ROWS = 96
SCALE = 256
POSITIVES = 5
NEGATIVES = 5
LEAST_PERCENT = 80
_FAR = np.iinfo(np.int64).max // 4


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & finite


def spread_points(rows: np.ndarray, count: int) -> np.ndarray:
    """Places of ``count`` rows far from each other, the first one first; fewer if there are no more different rows."""
    chosen = [0]
    away = ((rows - rows[0]) ** 2).sum(axis=1)
    while len(chosen) < count:
        far = int(np.argmax(away))
        if away[far] <= 0:
            break
        chosen.append(far)
        away = np.minimum(away, ((rows - rows[far]) ** 2).sum(axis=1))
    return np.array(chosen)


def distances(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    square = (rows**2).sum(axis=1)[:, None] + (points**2).sum(axis=1) - 2 * rows @ points.T
    return np.sqrt(np.maximum(square, 0))


def label_bits(labels: np.ndarray) -> np.ndarray:
    """One of 64 bits for each label."""
    mixed = labels.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return np.uint64(1) << (mixed >> np.uint64(58))


class Node:
    """Split points with the ranges of every child's distances to each of them, or a leaf with its rows."""

    __slots__ = ("rows", "points", "low", "high", "children", "bits", "only")

    def __init__(self, full: np.ndarray, labels: np.ndarray, rows: np.ndarray, fan_out: int, leaf_rows: int):
        self.rows, self.children = rows, []
        if len(rows) <= leaf_rows:
            return
        step = max(1, len(rows) // (fan_out * 8))
        tried = rows[::step]
        picked = tried[spread_points(full[tried], fan_out)]
        if len(picked) < 2:
            return
        self.points = full[picked]
        away = distances(full[rows], self.points)
        near = away.argmin(axis=1)
        own = [np.flatnonzero(near == j) for j in range(len(picked))]
        own = [o for o in own if len(o)]
        if len(own) < 2:
            return
        self.low = np.array([away[o].min(axis=0) for o in own])
        self.high = np.array([away[o].max(axis=0) for o in own])
        held = [labels[rows[o]] for o in own]
        self.bits = np.array([np.bitwise_or.reduce(label_bits(x)) for x in held])
        self.only = [int(x[0]) if (x == x[0]).all() else None for x in held]
        self.children = [Node(full, labels, rows[o], fan_out, leaf_rows) for o in own]


def possible(away: np.ndarray, low: np.ndarray, high: np.ndarray, inner: np.ndarray, outer: np.ndarray, slack: float) -> np.ndarray:
    """Queries x children: whether the ranges leave room for a row between the radii ``inner`` and ``outer``."""
    nearest = np.maximum(away[:, None, :] - high[None], low[None] - away[:, None, :]).max(axis=2)
    farthest = (away[:, None, :] + high[None]).min(axis=2)
    return (nearest <= outer[:, None] + slack) & (farthest >= inner[:, None] - slack)


class Queries:
    """Queries with the best rows found so far; a query wants ``k`` rows with scores from ``least`` to ``most``."""

    def __init__(self, ids, labels, vectors, least, most, same: bool, k: int, top: float):
        self.ids, self.labels, self.vectors, self.same, self.k, self.top = ids, labels, vectors, same, k, top
        self.least, self.most = least.copy(), most
        self.square = (vectors.astype(np.float64) ** 2).sum(axis=1)
        self.full = np.column_stack([vectors, np.zeros(len(ids))]).astype(np.float64)
        self.slack = 1e-6 * (1 + np.sqrt(top + self.square.max(initial=0)))
        none = np.zeros(0, dtype=np.int64)
        self.found = [(none, none) for _ in ids]

    def radius(self, score: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.square[at] + self.top - 2 * score.astype(np.float64), 0))

    def admitted(self, at: np.ndarray, node: Node, child: int) -> np.ndarray:
        if self.same:
            return (label_bits(self.labels[at]) & node.bits[child]) != 0
        return np.full(len(at), True) if node.only[child] is None else self.labels[at] != node.only[child]

    def search(self, node: Node, at: np.ndarray, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        if not node.children:
            self.leaf(at, ids[node.rows], labels[node.rows], vectors[node.rows])
            return
        away = distances(self.full[at], node.points)
        # the child around the query's own split point comes first: what it finds narrows the annulus for the others
        order = np.argsort(np.bincount(away.argmin(axis=1), minlength=len(node.points))[: len(node.children)])[::-1]
        for j in order:
            inner, outer = self.radius(self.most[at], at), self.radius(self.least[at], at)
            open_ = possible(away, node.low[j : j + 1], node.high[j : j + 1], inner, outer, self.slack)[:, 0]
            open_ &= self.admitted(at, node, j)
            if open_.any():
                self.search(node.children[j], at[open_], ids, labels, vectors)

    def leaf(self, at: np.ndarray, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        scores = inner_products(self.vectors[at], vectors)
        fits = (scores >= self.least[at][:, None]) & (scores <= self.most[at][:, None]) & (self.ids[at][:, None] != ids)
        fits &= (self.labels[at][:, None] == labels) if self.same else (self.labels[at][:, None] != labels)
        for i in np.flatnonzero(fits.any(axis=1)):
            hit = np.flatnonzero(fits[i])
            q = at[i]
            s, v = np.concatenate([self.found[q][0], scores[i, hit]]), np.concatenate([self.found[q][1], ids[hit]])
            best = np.lexsort((v, -s))[: self.k]
            self.found[q] = s[best], v[best]
            if len(best) == self.k:
                self.least[q] = max(self.least[q], s[best[-1]])


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of integer vectors; sums below 2**53 are exact in doubles too."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def _flat(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def mark_rows(table: DataFrame, id_col: str, vector: str, label: Column | str, scale: int) -> DataFrame:
    """id, label, v (integers), n2 (squared norm) of the rows that take part, one row an id."""
    label = F.col(label) if isinstance(label, str) else label
    given = table.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector).alias("v"))
    given = given.where(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("v")))
    whole = F.transform("v", lambda x: F.floor(x.cast("double") * scale).cast("int"))
    rows = given.select("id", "label", whole.alias("v")).groupBy("id").agg(F.min(F.struct("label", "v")).alias("r"))
    square = F.aggregate("r.v", F.lit(0).cast("double"), lambda s, x: s + x.cast("double") * x.cast("double"))
    return stage(rows.select("id", "r.label", "r.v", square.alias("n2"), F.size("r.v").alias("size")), "negative-rows")


class Index:
    """The root's split points and ranges, and the blocks with their trees' rows."""

    def __init__(self, rows: DataFrame, cells: int = CELLS, sample_rows: int = SAMPLE_ROWS, block_rows: int = BLOCK_ROWS,
                 fan_out: int = FAN_OUT, leaf_rows: int = LEAF_ROWS):
        self.fan_out, self.leaf_rows = fan_out, leaf_rows
        first = rows.orderBy("id").select("size").head()
        self.size = first["size"] if first else 0
        if not first:
            return
        rows = rows.where(F.col("size") == self.size)
        self.top = rows.agg(F.max("n2")).head()[0]
        if self.top >= 2.0**55:
            raise ValueError("components are too large for exact inner products in 64 bits")
        size, top = self.size, self.top
        sample = rows.orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("v").toArrow().column(0).combine_chunks()
        full = self.lifted(_flat(sample, size))
        self.points = points = full[spread_points(full, cells)]

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                near = distances(lift(_flat(batch.column(2), size), top), points).argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(near.astype(np.int32))], names=["id", "label", "v", "cell"]
                )

        placed = map_arrow(rows.select("id", "label", "v"), place, "id long, label long, v array<int>, cell int")
        self.rows = stage(placed, "negative-cells")
        self.low, self.high, self.counts = self._ranges()
        blocks = {c: max(1, -(-n // block_rows)) for c, n in enumerate(self.counts) if n}
        self.blocks_of = blocks
        by_cell = F.create_map(*[F.lit(x) for pair in blocks.items() for x in pair])
        block = F.pmod(F.xxhash64("id"), by_cell[F.col("cell")]).cast("int")
        # a block is bounded by the hash: about block_rows rows
        self.blocks = stage(
            self.rows.withColumn("block", block)
            .groupBy("cell", "block")
            .agg(F.array_sort(F.collect_list(F.struct("id", "label", "v"))).alias("rows")),
            "negative-blocks",
        )

    def lifted(self, vectors: np.ndarray) -> np.ndarray:
        return lift(vectors, self.top)

    def _ranges(self) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Cells x split points: least and greatest distance; rows of each cell. Cells squared numbers, whatever the table."""
        size, top, points = self.size, self.top, self.points

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            low, high = np.full((len(points), len(points)), np.inf), np.zeros((len(points), len(points)))
            count = np.zeros(len(points), dtype=np.int64)
            for batch in batches:
                away = distances(lift(_flat(batch.column(0), size), top), points)
                cell = batch.column(1).to_numpy()
                np.minimum.at(low, cell, away)
                np.maximum.at(high, cell, away)
                count += np.bincount(cell, minlength=len(points))
            cell, point = np.nonzero(np.repeat(count[:, None], len(points), axis=1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (cell, point, low[cell, point], high[cell, point], count[cell])],
                names=["cell", "point", "low", "high", "n"],
            )

        parts = map_arrow(self.rows.select("v", "cell"), run, "cell long, point long, low double, high double, n long")
        found = parts.groupBy("cell", "point").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).toArrow()
        cell, point, lows, highs, n = (c.to_numpy() for c in found.columns)
        low, high = np.full((len(points), len(points)), np.inf), np.full((len(points), len(points)), -np.inf)
        low[cell, point], high[cell, point] = lows, highs
        counts = np.zeros(len(points), dtype=np.int64)
        counts[cell] = n
        return low, high, counts.tolist()

    def search(self, queries: DataFrame, same: bool, k: int, own_cell: bool = False, pack_rows: int = PACK_ROWS) -> DataFrame:
        """(key, part, id, score): at most ``k`` rows of each block for every query, its ``k`` best rows among them.

        ``queries`` has (key, part, id, label, v, cell, least, most), key and part naming the query; with ``own_cell`` only the query's own cell is searched.
        """
        size, top, points, low, high = self.size, self.top, self.points, self.low, self.high
        blocks_of, fan_out, leaf_rows = self.blocks_of, self.fan_out, self.leaf_rows

        def unpacked(items: pa.ListArray) -> tuple[pa.StructArray, Queries]:
            flat = items.flatten()
            ids, labels, least, most = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("id", "label", "least", "most"))
            return flat, Queries(ids, labels, _flat(flat.field("v"), size), least, most, same, k, top)

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(len(batch)):
                    pack = batch.slice(i, 1)
                    if own_cell:
                        cells = [pack.column(0)[0].as_py()]
                    else:
                        _, q = unpacked(pack.column(1))
                        at = np.arange(len(q.ids))
                        cells = np.flatnonzero(
                            possible(distances(q.full, points), low, high, q.radius(q.most, at), q.radius(q.least, at), q.slack).any(axis=0)
                        ).tolist()
                    to = [(c, b) for c in cells if c in blocks_of for b in range(blocks_of[c])]
                    for first in range(0, len(to), 8):
                        some = to[first : first + 8]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([c for c, _ in some], type=pa.int32()),
                                pa.array([b for _, b in some], type=pa.int32()),
                                pack.column(1).take(pa.array([0] * len(some))),
                            ],
                            names=["cell", "block", "pack"],
                        )

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last = tree = None
            for batch in batches:
                for i in range(len(batch)):
                    place = (batch.column(0)[i].as_py(), batch.column(1)[i].as_py())
                    if place != last:
                        flat = batch.column(2).slice(i, 1).flatten()
                        ids, labels = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("id", "label"))
                        vectors = _flat(flat.field("v"), size)
                        tree, last = Node(lift(vectors, top), labels, np.arange(len(ids)), fan_out, leaf_rows), place
                    asked, q = unpacked(batch.column(3).slice(i, 1))
                    q.search(tree, np.arange(len(asked)), ids, labels, vectors)
                    by = pa.array(np.repeat(np.arange(len(asked)), [len(s) for s, _ in q.found]))
                    yield pa.RecordBatch.from_arrays(
                        [
                            asked.field("key").take(by),
                            asked.field("part").take(by),
                            pa.array(np.concatenate([v for _, v in q.found])),
                            pa.array(np.concatenate([s for s, _ in q.found])),
                        ],
                        names=["key", "part", "id", "score"],
                    )

        # packs of queries of one cell, which the same cells are left over for; a pack is bounded like a block
        sizes = queries.groupBy("cell").agg(F.count("*").alias("asked"))
        dealt = queries.join(sizes, "cell").withColumn("pack", F.pmod(F.xxhash64("key", "part"), F.ceil(F.col("asked") / pack_rows)))
        packs = dealt.groupBy("cell", "pack").agg(
            F.collect_list(F.struct("key", "part", "id", "label", "v", "least", "most")).alias("items")
        )
        item = "array<struct<key:bigint,part:int,id:bigint,label:bigint,v:array<int>,least:bigint,most:bigint>>"
        routed = map_arrow(packs.select("cell", "items"), route, f"cell int, block int, pack {item}")
        met = self.blocks.join(routed, ["cell", "block"]).select("cell", "block", "rows", "pack")
        return map_arrow(met, find, "key long, part int, id long, score long")


def lift(vectors: np.ndarray, top: float) -> np.ndarray:
    """The vectors with one more coordinate, which gives all of them the squared norm ``top``."""
    vectors = vectors.astype(np.float64)
    rest = np.sqrt(np.maximum(top - (vectors**2).sum(axis=1), 0))
    return np.column_stack([vectors, rest])


def best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("key", "part").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(
    table: DataFrame,
    is_anchor: Column,
    id_col: str = "vec_id",
    vector: str = "embedding",
    label: Column | str = "label",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    least_percent: int = LEAST_PERCENT,
    scale: int = SCALE,
    **index,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    For each anchor its best rows of the same label, and for each of these the best rows of other labels whose score is at
    most the positive's and at least ``least_percent`` of it. ``is_anchor`` is a condition on the id column.
    """
    spark = table.sparkSession
    rows = mark_rows(table, id_col, vector, label, scale)
    tree = Index(rows, **index)
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not tree.size:
        return spark.createDataFrame([], out)
    anchors = tree.rows.withColumnRenamed("id", id_col).where(is_anchor).withColumnRenamed(id_col, "id")
    anyone = anchors.select(
        "*", F.col("id").alias("key"), F.lit(0).alias("part"), F.lit(-int(_FAR)).alias("least"), F.lit(int(_FAR)).alias("most")
    )
    near = best(tree.search(anyone, True, positives, own_cell=True), positives)
    mark = near.where(F.col("rank") == positives).select("key", F.col("score").alias("mark"))
    marked = anyone.join(mark, "key", "left").withColumn("least", F.coalesce("mark", "least")).drop("mark")
    found = stage(best(tree.search(marked, True, positives), positives), "positives")
    # the least integer score that is least_percent of the positive's
    least = F.expr(f"({least_percent} * score) div 100 + if(mod({least_percent} * score, 100) > 0, 1, 0)")
    pairs = found.select(
        "key", F.col("rank").alias("part"), F.col("id").alias("positive_id"), F.col("score").alias("most"), least.alias("least")
    ).where("least <= most")
    windows = anchors.join(pairs.drop("positive_id"), F.col("id") == F.col("key"))
    hard = best(tree.search(windows, False, negatives), negatives)
    named = pairs.select(F.col("key").alias("anchor"), F.col("part").alias("of"), "positive_id", "most")
    return hard.join(named, (F.col("key") == F.col("anchor")) & (F.col("part") == F.col("of"))).select(
        F.col("anchor").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        F.col("most").alias("positive_score"), F.col("score").alias("negative_score"),
    )

"""Near duplicates: an exact n-gram Jaccard join.

A text is the set of hashes of its word n-grams. Texts with equal sets are one class; only classes are compared.

* Tiles. Sizes fall into bands. In a band's scheme the hash range is cut into parts, more than two linked sets can
  differ in; so two linked sets agree in at least one of each set's first ``d + 1`` non-empty parts, where ``d`` is the
  largest possible difference. A tile is the classes of a band that agree in a part. A class also joins the next band's
  scheme when a partner can lie there. A set with too few non-empty parts joins by single hashes as well.
* In a tile every class is first compared with the tile's least class. Bitmaps of hashed n-grams bound the overlap
  from above: a bit set only on one side is at least one n-gram more. A bitmap grows with its set, as a full one tells
  nothing; the longer of two is folded to the shorter. Pairs that pass are compared exactly, by
  intersecting sorted arrays. Tiles whose classes are then all connected need nothing more; in the others all pairs
  from different components are bounded by bitmaps, in blocks of bounded size, and the rest compared exactly.

So no link between different components is lost, and copies are never expanded into pairs: a group of n near copies
costs about n comparisons. Sets are compared as 64-bit hashes.

Defined results: a null text, or one without a word, has size 0 and is a component of its own; with fewer words than
``size`` the whole sequence is one n-gram; equal rows share a component; an empty table gives an empty result; only the
id and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftlens.llm.components import components
from driftlens.llm.texts import lower_ascii, mix, shingle_hashes, signed, text_slices, word_hashes, word_spans
from driftlens.llm.workers import map_arrow
from driftlens.staging import stage

BAND = 1.5
BITMAP_BITS = 2048
MOST_BITMAP_BITS = 1 << 15
BLOCK = 2048
SET_BYTES = 1 << 18
GROUP_ROWS = 1 << 16
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    for _, data, offsets in text_slices(column, SET_BYTES):
        data = lower_ascii(data)
        starts, ends = word_spans(data, offsets)
        words = word_hashes(data, starts, ends)
        edges = np.searchsorted(starts, offsets)
        for a, b in zip(edges[:-1], edges[1:]):
            if b - a >= size:
                yield np.unique(shingle_hashes(words[a:b], size))
            elif b > a:
                yield shingle_hashes(words[a:b], b - a) ^ np.uint64(b - a)
            else:
                yield np.zeros(0, dtype=np.uint64)


def class_key(hashes: np.ndarray) -> int:
    """One number for a set, whatever its order."""
    total = mix(hashes ^ _ODD).sum(dtype=np.uint64)
    return int(mix(np.array([total, len(hashes)], dtype=np.uint64) * _ODD).sum(dtype=np.uint64).astype(np.int64))


def bitmap_bits(n: int) -> int:
    """Bits of the bitmap of ``n`` n-grams: a power of two, at least two an n-gram within the limits."""
    return min(max(BITMAP_BITS, 1 << (2 * n - 1).bit_length()), MOST_BITMAP_BITS)


def bitmap(hashes: np.ndarray) -> bytes:
    count = bitmap_bits(len(hashes))
    bits = np.zeros(count, dtype=np.uint8)
    bits[(hashes >> np.uint64(20)) % np.uint64(count)] = 1
    return np.packbits(bits).tobytes()


def most_different(n: int, percent: int) -> int:
    """The largest symmetric difference of a set of ``n`` with any set it is linked to."""
    partner = n * 100 // percent
    return (100 - percent) * (n + partner) // (100 + percent)


def scheme_of(n: int) -> int:
    return int(math.floor(math.log(n) / math.log(BAND) + 1e-9))


def parts_of(scheme: int, percent: int) -> int:
    """Parts of a scheme: enough that sets of the band usually have more non-empty parts than they can differ in."""
    largest = math.ceil(BAND ** (scheme + 1))
    ratio = Fraction(100 - percent, 100 + percent) * (1 + Fraction(100, percent))
    return math.ceil(float(ratio) * 1.25 * largest) + 6


def signatures(hashes: np.ndarray, percent: int) -> np.ndarray:
    """Keys of the tiles of one set."""
    n = len(hashes)
    if not n:
        return hashes
    own = scheme_of(n)
    schemes = [own] + ([own + 1] if 100 * n >= percent * (math.floor(BAND ** (own + 1)) - 1) else [])
    need = most_different(n, percent) + 1
    out, sparse = [], False
    mixed = mix(hashes ^ np.uint64(0x5851F42D4C957F2D))
    for scheme in schemes:
        count = parts_of(scheme, percent)
        part = ((hashes >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)
        begin = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        content = np.add.reduceat(mixed, begin)
        sparse |= len(begin) < need
        label = part[begin] + (np.uint64(scheme + 1) << np.uint64(40))
        out.append(mix(content + label * _ODD)[:need])
    if sparse:
        prefix = n - -(-n * percent // 100) + 1
        out.append(mix(hashes[:prefix] ^ np.uint64(0x2545F4914F6CDD1D)))
    return np.concatenate(out)


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Exact test on sorted arrays."""
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= percent * (len(x) + len(y) - common)


def may_link(n: np.ndarray, m: np.ndarray, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Whether sizes and bitmaps leave room for a link; rows of ``x`` and ``y`` are bitmaps as 64-bit words."""
    only_x = np.bitwise_count(x & ~y).sum(axis=-1, dtype=np.int64)
    only_y = np.bitwise_count(y & ~x).sum(axis=-1, dtype=np.int64)
    most = np.minimum(n - only_x, m - only_y)
    return 100 * most >= percent * (n + m - most)


def bitmap_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit words of all bitmaps of a batch, where each begins and the last ends)."""
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) // 8
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint64), np.concatenate(([0], np.cumsum(sizes)))


def folded(words: np.ndarray, edges: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """The bitmaps of ``rows`` as rows of ``size`` words, no more than any of them has: a bitmap's parts are united."""
    out = np.empty((len(rows), size), dtype=np.uint64)
    sizes = edges[rows + 1] - edges[rows]
    for own in np.unique(sizes):
        some = np.flatnonzero(sizes == own)
        parts = words[edges[rows[some]][:, None] + np.arange(own)].reshape(len(some), -1, size)
        out[some] = np.bitwise_or.reduce(parts, axis=1)
    return out


def described(docs: DataFrame, size: int, id_col: str, text: str) -> DataFrame:
    """id, n, class (null for an empty set) and bitmap of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(batch.column(1), size))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(s) for s in sets], type=pa.int64()),
                    pa.array([class_key(s) if len(s) else None for s in sets], type=pa.int64()),
                    pa.array([bitmap(s) for s in sets], type=pa.binary()),
                ],
                names=["id", "n", "class", "bitmap"],
            )

    given = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
    return map_arrow(given, run, f"id {given.schema['id'].dataType.simpleString()}, n long, class long, bitmap binary")


def tiles(docs: DataFrame, size: int, percent: int, text: str) -> DataFrame:
    """(tile, class) of all tiles with two classes at least; tiles with the same classes are one.

    A task emits a class once however many copies it meets, and the sorted groups are read as a stream.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            keys, classes = [], []
            for hashes in shingle_sets(batch.column(0), size):
                if not len(hashes):
                    continue
                own = class_key(hashes)
                if own in seen:
                    continue
                seen.add(own)
                found = signatures(hashes, percent)
                keys.append(found)
                classes.append(np.full(len(found), own, dtype=np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(np.concatenate(keys))), pa.array(np.concatenate(classes))], names=["key", "class"]
                )

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_key = rest = np.zeros(0, dtype=np.int64)
        large = None  # key of a group that is too large to hold; its rows go out as they come

        def rows(tile: np.ndarray, member: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(tile), pa.array(member)], names=["tile", "class"])

        def closed(key: np.ndarray, member: np.ndarray) -> pa.RecordBatch | None:
            new = np.concatenate(([True], (key[1:] != key[:-1]) | (member[1:] != member[:-1])))
            key, member = key[new], member[new]
            begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            count = np.diff(np.append(begin, len(key)))
            name = mix(np.add.reduceat(mix(member.view(np.uint64) ^ _ODD), begin)).view(np.int64)
            keep = count > 1
            if key[0] == large:  # its other rows have gone out under its key
                name[0], keep[0] = large, True
            some = np.repeat(keep, count)
            return rows(np.repeat(name, count)[some], member[some]) if some.any() else None

        for batch in batches:
            key = np.concatenate([rest_key, batch.column(0).to_numpy(zero_copy_only=False)])
            member = np.concatenate([rest, batch.column(1).to_numpy(zero_copy_only=False)])
            if not len(key):
                continue
            last = int(np.searchsorted(key, key[-1]))
            if last:
                out = closed(key[:last], member[:last])
                large = None if key[0] == large else large
                if out is not None:
                    yield out
            rest_key, rest = key[last:], member[last:]
            if len(rest) > GROUP_ROWS:
                distinct = np.unique(rest)
                if len(distinct) > GROUP_ROWS:
                    large = int(rest_key[0])
                    yield rows(np.full(len(distinct) - 1, large), distinct[:-1])
                    distinct = distinct[-1:]
                rest, rest_key = distinct, rest_key[: len(distinct)]
        if len(rest):
            out = closed(rest_key, rest)
            if out is not None:
                yield out

    keys = map_arrow(docs.select(F.col(text).cast("string").alias("text")), emit, "key long, class long")
    dealt = keys.repartition("key").sortWithinPartitions("key", "class")
    return stage(map_arrow(dealt, group, "tile long, class long"), "near-tiles").distinct()


def _bounded(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes and bitmaps leave room for a link."""
    side = classes.select("class", "n", "bitmap")
    joined = (
        pairs.join(side.toDF("a", "n", "x"), "a")
        .join(side.toDF("b", "m", "y"), "b")
        .where((F.least("n", "m") * 100) >= (F.greatest("n", "m") * percent))
        .select("a", "b", "n", "m", "x", "y")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n, m = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
                x, y = bitmap_words(batch.column(4)), bitmap_words(batch.column(5))
                least = np.minimum(np.diff(x[1]), np.diff(y[1]))
                ok = np.zeros(batch.num_rows, dtype=bool)
                for size in np.unique(least):
                    some = np.flatnonzero(least == size)
                    for rows in np.array_split(some, -(-len(some) // BLOCK)):
                        ok[rows] = may_link(n[rows], m[rows], folded(*x, rows, size), folded(*y, rows, size), percent)
                yield batch.select([0, 1]).filter(pa.array(ok))

    return map_arrow(joined, run, "a long, b long")


def _exact(docs: DataFrame, pairs: DataFrame, classes: DataFrame, size: int, percent: int, id_col: str, text: str) -> DataFrame:
    """The pairs that are links, by intersecting sorted arrays.

    Each class is read from the text of one of its rows; the members of a pair's smaller class meet its array in
    spans of at most about ``BLOCK`` members, so one class with very many partners is no single task's work.
    """
    needed = pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).distinct()
    asked = classes.join(needed, "class", "left_semi").select("class", F.col("first").alias("id"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(batch.column(1), size))
            own = np.array([class_key(s) if len(s) else 0 for s in sets], dtype=np.int64)
            ok = own == batch.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([s.tobytes() for s in sets], type=pa.binary())], names=["class", "hashes"]
            ).filter(pa.array(ok, type=pa.bool_()))

    given = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
    texts = given.join(asked.hint("shuffle_hash"), given["id"].eqNullSafe(asked["id"])).select("class", "text")
    sets = stage(map_arrow(texts, read, "class long, hashes binary"), "near-sets").dropDuplicates(["class"])
    spans = pairs.groupBy("b").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("spans"))
    spread = pairs.join(spans, "b").withColumn("span", F.pmod(F.xxhash64("a"), F.col("spans")).cast("int"))
    members = spread.join(sets.toDF("a", "hashes"), "a").select("b", "span", "a", "hashes")
    heads = spans.join(sets.toDF("b", "hashes"), "b").select(
        "b", F.explode(F.sequence(F.lit(0), F.col("spans") - 1)).alias("span"), F.lit(None).cast("long").alias("a"), "hashes"
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, head = None, None
        for batch in batches:
            a, b = [], []
            for key, span, own, packed in zip(*(batch.column(i).to_pylist() for i in range(4))):
                hashes = np.frombuffer(packed, dtype=np.uint64)
                if own is None:
                    at, head = (key, span), hashes
                elif at == (key, span) and linked(hashes, head, percent):
                    a.append(own)
                    b.append(key)
            yield pa.RecordBatch.from_arrays([pa.array(a, type=pa.int64()), pa.array(b, type=pa.int64())], names=["a", "b"])

    dealt = members.unionByName(heads).repartition("b", "span").sortWithinPartitions("b", "span", F.asc_nulls_first("a"))
    return stage(map_arrow(dealt, compare, "a long, b long"), "near-links")


def _cross_pairs(open_tiles: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs from different components that meet in an open tile and pass the bounds.

    A tile of more than ``BLOCK`` classes is dealt into blocks, and each pair of blocks is a group of its own.
    """
    counts = open_tiles.groupBy("tile").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    dealt = (
        open_tiles.join(counts, "tile")
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("tile", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "class", "root")
        .join(classes.select("class", "n", "bitmap"), "class")
        .select("tile", "p", "q", "own", "class", "root", "n", "bitmap")
    )

    def pairs_of(own: np.ndarray, p: int, q: int, name: np.ndarray, root: np.ndarray, n: np.ndarray, words: np.ndarray, edges: np.ndarray):
        order = np.argsort(n, kind="stable")
        own, name, root, n = own[order], name[order], root[order], n[order]
        # larger sets have no shorter bitmaps
        sizes = (edges[1:] - edges[:-1])[order]
        for size in np.unique(sizes):
            mine = np.flatnonzero(sizes == size)
            first, last = int(mine[0]), int(np.searchsorted(n, n[mine[-1]] * 100 // percent, side="right"))
            bits = folded(words, edges, order[first:last], size)
            for i in mine:
                # partners are not smaller, and not too large
                end = int(np.searchsorted(n, n[i] * 100 // percent, side="right"))
                rest = slice(i + 1, end)
                some = (root[rest] != root[i]) & ((own[rest] != own[i]) | (p == q))
                some = np.flatnonzero(some) + i + 1
                if len(some):
                    some = some[may_link(np.full(len(some), n[i]), n[some], bits[i - first][None, :], bits[some - first], percent)]
                    for j in some:
                        yield max(name[i], name[j]), min(name[i], name[j])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def work(table: pa.Table) -> pa.RecordBatch:
            cols = [table.column(i).combine_chunks() for i in range(8)]
            tile, p, q, own, name, root, n = (c.to_numpy(zero_copy_only=False) for c in cols[:7])
            words, edges = bitmap_words(cols[7])
            begin = np.flatnonzero(np.concatenate(([True], (tile[1:] != tile[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1]))))
            out: set[tuple[int, int]] = set()
            for a, b in zip(begin, np.append(begin[1:], len(tile))):
                if b - a > 1:
                    out.update(pairs_of(own[a:b], p[a], q[a], name[a:b], root[a:b], n[a:b], words, edges[a : b + 1]))
            return pa.RecordBatch.from_arrays(
                [pa.array([x for x, _ in out], type=pa.int64()), pa.array([y for _, y in out], type=pa.int64())], names=["a", "b"]
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*held, batch])
            key = [table.column(i).to_numpy() for i in range(3)]
            same = (key[0] == key[0][-1]) & (key[1] == key[1][-1]) & (key[2] == key[2][-1])
            first = int(np.argmax(same))
            if first:
                yield work(table.slice(0, first))
            held = table.slice(first).combine_chunks().to_batches()
        if held:
            yield work(pa.Table.from_batches(held))

    sorted_rows = dealt.repartition("tile", "p", "q").sortWithinPartitions("tile", "p", "q")
    return map_arrow(sorted_rows, run, "a long, b long").distinct()


def join(docs: DataFrame, size: int = 4, percent: int = 85, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_shingles, component_id: the smallest id that links reach, for every row."""
    rows = stage(described(docs, size, id_col, text), "near-rows")
    classes = stage(
        rows.where("n > 0").groupBy("class").agg(F.min("id").alias("first"), F.min("n").alias("n"), F.min("bitmap").alias("bitmap")),
        "near-classes",
    )
    met = stage(tiles(docs, size, percent, text), "near-met")
    # the class that meets others in the most tiles is the one least edited: most of a tile's classes are linked to it
    weighted = met.join(met.groupBy("class").agg(F.count("*").alias("meets")), "class")
    heads = weighted.groupBy("tile").agg(
        F.max(F.struct("meets", "class"))["class"].alias("head"), F.count("*").alias("members")
    )
    star = met.join(heads, "tile").where(F.col("class") != F.col("head")).select(F.col("class").alias("a"), F.col("head").alias("b")).distinct()
    tried = stage(_bounded(star, classes, percent), "near-pairs")
    links = _exact(docs, tried, classes, size, percent, id_col, text)
    roots = stage(components(links), "near-roots")
    labelled = (
        met.join(heads.where("members > 2").select("tile"), "tile")
        .join(roots.withColumnRenamed("node", "class"), "class", "left")
        .withColumn("root", F.coalesce("root", "class"))
    )
    several = labelled.groupBy("tile").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("tile")
    open_tiles = stage(labelled.join(several, "tile", "left_semi").select("tile", "class", "root"), "near-open")
    more = stage(_cross_pairs(open_tiles, classes, percent).join(tried, ["a", "b"], "left_anti"), "near-pairs")
    if more.limit(1).count():
        late = _exact(docs, more, classes, size, percent, id_col, text)
        old = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
        roots = components(old.unionByName(late))
    rooted = classes.select("class", "first").join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("class", "component_id")
    return rows.join(named, "class", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id")
    )


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of one row of each component, that of its smallest id; rows without an id all stay.

    Of several rows with one id the one with the least text stays. Only (id, a hash of the text) move to decide; the
    texts are read once more and stay where they are wherever the decision is small enough to be sent to them.
    """
    body = F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))
    names = join(docs, size, percent, id_col, text)
    kept = names.where(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias("_j_id")).distinct()
    # one row of each kept id
    rows = docs.withColumn("_j_place", F.row_number().over(Window.partitionBy(F.col(id_col)).orderBy(body, F.monotonically_increasing_id())))
    several = docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_j_id")).count().where("count > 1")
    if several.limit(1).count():
        docs = rows.where(F.col(id_col).isNull() | (F.col("_j_place") == 1)).drop("_j_place")
    named = docs.where(F.col(id_col).isNotNull()).join(kept, F.col(id_col) == F.col("_j_id"), "left_semi")
    return named.unionByName(docs.where(F.col(id_col).isNull())).select(*docs.columns)

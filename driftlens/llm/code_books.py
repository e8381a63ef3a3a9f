"""Vector codes by exact product codebooks; the nearest entry is found by slicing and intersecting bitmasks.

A vector is floored to integers and cut into equal parts; each part position has a codebook of at most 64 entries. In a
codebook every dimension's coordinates are sorted, and the place after each coordinate carries the mask of all entries
up to there, one bit an entry. For a part and a radius, two look-ups a dimension give the mask of the entries inside the
slice [x - radius, x + radius]; the masks of all dimensions, combined by AND, leave the entries inside the box. An entry
outside the box is farther away than the radius, so when the best entry inside lies within the radius it is the nearest,
and all its equals are inside too. The first radius is what most of a few parts of the batch need; parts that find
nothing take twice the radius, parts whose best entry lies outside it take its distance. Distances are integers, so codes
are exact, whatever the radius.

A round of fitting assigns all vectors in one pass: each task sums its parts per entry, the sums meet by (entry,
component), and the codebooks alone (64 entries of one vector's size) go through the driver. Label sums are one row a
label before they meet the rows again.

Defined results: vectors that are null, empty or hold a null or non-finite component take no part, nor do vectors whose
length is no multiple of the parts or differs from that of the first kept row (smallest id, null ids last, equal ids by
vector); fewer rows than entries make shorter codebooks; equal entries keep all their places and the first is used;
repeated rows are rows of their own; an empty table gives an empty result; other columns are not read. Components whose
size does not allow exact sums of squares in 64 bits are an error, not a wrong code.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlens.llm.workers import map_arrow
from driftlens.staging import stage

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
BATCH_ROWS = 4096
FIRST_ROWS = 128


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & finite


def integers(vectors: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) as 64-bit integers."""
    out = np.floor(vectors.astype(np.float64) * scale)
    if out.size and np.abs(out).max() * 2 * np.sqrt(out.shape[1]) >= 2.0**30:
        raise ValueError("components are too large for exact distances in 64 bits")
    return out.astype(np.int64)


class CodeBook:
    """The entries of one part position, sliced by dimension."""

    def __init__(self, entries: np.ndarray):
        if len(entries) > 64:
            raise ValueError("a mask has 64 bits")
        self.entries = entries
        bits = np.uint64(1) << np.arange(len(entries), dtype=np.uint64)
        order = np.argsort(entries, axis=0, kind="stable")
        self.sorted = np.take_along_axis(entries, order, axis=0).T.copy()  # a row for each dimension
        first = np.zeros((entries.shape[1], 1), dtype=np.uint64)
        self.masks = np.concatenate([first, np.bitwise_or.accumulate(bits[order], axis=0).T], axis=1)

    def inside(self, parts: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """The mask of the entries inside each part's box."""
        out = np.full(len(parts), np.iinfo(np.uint64).max, dtype=np.uint64)
        for d, (line, masks) in enumerate(zip(self.sorted, self.masks)):
            x = parts[:, d]
            low, high = np.searchsorted(line, x - radius, "left"), np.searchsorted(line, x + radius, "right")
            out &= masks[high] & ~masks[low]
        return out

    def nearest(self, parts: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each part, ties to the lower entry."""
        code = np.zeros(len(parts), dtype=np.int64)
        error = np.zeros(len(parts), dtype=np.int64)
        reach = np.full(len(parts), max(1, radius), dtype=np.int64)
        open_ = np.arange(len(parts))
        while len(open_):
            mine, far = parts[open_], reach[open_]
            mask = self.inside(mine, far)
            bits = np.unpackbits(mask.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            row, entry = np.nonzero(bits)
            gap = mine[row] - self.entries[entry]
            distance = np.einsum("ij,ij->i", gap, gap)
            found = mask != 0
            begin = np.flatnonzero(np.diff(row, prepend=-1))
            least = np.full(len(open_), np.iinfo(np.int64).max)
            if len(begin):
                least[found] = np.minimum.reduceat(distance, begin)
            # entries ascend within a row, so the first of the least is the lowest
            hit = np.flatnonzero(distance == least[row])
            _, at = np.unique(row[hit], return_index=True)
            best = np.zeros(len(open_), dtype=np.int64)
            best[found] = entry[hit[at]]
            done = found & (least <= far * far)
            code[open_[done]], error[open_[done]] = best[done], least[done]
            left = ~done
            again = np.where(found[left], np.ceil(np.sqrt(np.where(found, least, 0)[left].astype(np.float64))).astype(np.int64) + 1, far[left] * 2)
            open_ = open_[left]
            reach[open_] = again
        return code, error


class Codes:
    """Codebooks of all part positions; ``books`` is entries x components."""

    def __init__(self, books: np.ndarray, parts: int):
        self.width = books.shape[1] // parts
        self.books = [CodeBook(books[:, p * self.width : (p + 1) * self.width]) for p in range(parts)]

    def assign(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, squared distances), rows x parts."""
        codes = np.zeros((len(vectors), len(self.books)), dtype=np.int64)
        errors = np.zeros_like(codes)
        for p, book in enumerate(self.books):
            mine = np.ascontiguousarray(vectors[:, p * self.width : (p + 1) * self.width])
            few = mine[:FIRST_ROWS, None, :] - book.entries[None, :, :]
            near = np.sqrt((few * few).sum(axis=2).min(axis=1).astype(np.float64))
            codes[:, p], errors[:, p] = book.nearest(mine, int(np.ceil(np.quantile(near, 0.75))) if len(near) else 1)
        return codes, errors


def _vectors(column: pa.Array) -> np.ndarray:
    rows = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1) if rows else np.zeros((0, 1))


def _sums(books: np.ndarray, parts: int, scale: int):
    """Sums and counts of what a task assigns to each entry, one row a (entry, component)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes(books, parts)
        total = np.zeros(books.shape, dtype=np.int64)
        count = np.zeros((len(books), parts), dtype=np.int64)
        for batch in batches:
            for first in range(0, len(batch), BATCH_ROWS):
                vectors = integers(_vectors(batch.column(0).slice(first, BATCH_ROWS)), scale)
                found, _ = codes.assign(vectors)
                for p in range(parts):
                    count[:, p] += np.bincount(found[:, p], minlength=len(books))
                    own = slice(p * codes.width, (p + 1) * codes.width)
                    np.add.at(total[:, own], found[:, p], vectors[:, own])
        entry, component = np.nonzero(np.repeat(count, codes.width, axis=1))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(entry.astype(np.int32)),
                pa.array(component.astype(np.int32)),
                pa.array(total[entry, component]),
                pa.array(count[entry, component // codes.width]),
            ],
            names=["entry", "component", "total", "n"],
        )

    return run


def usable_rows(table: DataFrame, parts: int, id_col: str, vector: str, label: str | None = None) -> tuple[DataFrame, int]:
    """(id, label, v of the rows that take part; the vectors' length, 0 if there are none)."""
    v = F.col(vector)
    rows = table.select(
        F.col(id_col).alias("id"), (F.col(label) if label else F.lit(None).cast("int")).alias("label"), v.alias("v")
    ).where(usable(F.col("v")) & (F.size("v") % parts == 0))
    first = rows.orderBy(F.col("id").asc_nulls_last(), F.col("v").cast("array<double>")).select(F.size("v").alias("n")).head()
    if first is None:
        return rows, 0
    return rows.where(F.size("v") == first.n), first.n


def fit(
    rows: DataFrame, size: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> np.ndarray:
    """Codebooks, entries x components; ``rows`` and ``size`` come from ``usable_rows``."""
    order = [F.col("id").asc_nulls_last(), F.col("v").cast("array<double>")]
    start = rows.orderBy(*order).limit(entries).orderBy(*order).select("v").toArrow().column(0).combine_chunks()
    books = integers(_vectors(start).reshape(-1, size), scale)
    for _ in range(rounds):
        sums = map_arrow(rows.select("v"), _sums(books, parts, scale), "entry int, component int, total long, n long")
        # at most entries x size rows, whatever the table's size
        new = sums.groupBy("entry", "component").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).toArrow()
        entry, component, total, n = (c.to_numpy() for c in new.columns)
        books = books.copy()
        books[entry, component] = total // n
    return books


def encode(rows: DataFrame, books: np.ndarray, parts: int = PARTS, scale: int = SCALE) -> DataFrame:
    """id, label, code (one byte a part) and error of every row of ``usable_rows``."""
    kinds = [rows.schema[c].dataType.simpleString() for c in ("id", "label")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes(books, parts)
        for batch in batches:
            for first in range(0, len(batch), BATCH_ROWS):
                part = batch.slice(first, BATCH_ROWS)
                found, errors = codes.assign(integers(_vectors(part.column(2)), scale))
                packed = found.astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array([r.tobytes() for r in packed], type=pa.binary()),
                        pa.array(errors.sum(axis=1)),
                    ],
                    names=["id", "label", "code", "error"],
                )

    return map_arrow(rows.select("id", "label", "v"), run, f"id {kinds[0]}, label {kinds[1]}, code binary, error long")


def decode(books: np.ndarray, code: bytes, parts: int = PARTS) -> np.ndarray:
    """The integer vector a code stands for."""
    width = books.shape[1] // parts
    return np.concatenate([books[c, p * width : (p + 1) * width] for p, c in enumerate(code)])


def books_digest(books: np.ndarray, parts: int = PARTS) -> str:
    """sha256 of all components in decimal, by part, entry and place, joined by commas."""
    width = books.shape[1] // parts
    values = books.reshape(len(books), parts, width).transpose(1, 0, 2).ravel()
    return hashlib.sha256(",".join(map(str, values.tolist())).encode()).hexdigest()


def compress(
    table: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, **more
) -> DataFrame:
    """id, code (hex), error, label_error and codebooks_sha256 of every vector that takes part."""
    rows, size = usable_rows(table, parts, id_col, vector, label)
    books = fit(rows, size, parts, **more) if size else np.zeros((0, parts), dtype=np.int64)
    coded = stage(encode(rows, books, parts, more.get("scale", SCALE)), "vector-codes")
    sums = coded.groupBy(F.col("label").alias("of_label")).agg(F.sum("error").alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of_label"))).select(
        F.col("id").alias(id_col),
        F.lower(F.hex("code")).alias("code"),
        "error",
        "label_error",
        F.lit(books_digest(books, parts)).alias("codebooks_sha256"),
    )

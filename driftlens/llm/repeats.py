"""Repeated passages by a depth-limited radix sort of suffixes.

A window is ``length`` tokens (bytes or words) of one text; a window that also starts anywhere else is a repeat, and
every token that a repeat covers can be removed. Suffixes need only be ordered through their first ``length`` tokens,
and only far enough to see which are equal. So they are sorted by digits, the most significant first, and a group
that has one member left is dropped:

* The first digit of a window is its least ``gram`` tokens by hash, a property of the window alone. Neighbouring
  windows share it, so a run of windows is one record, and only digits that occur twice go on.
* The next digits are hashes of the part that all windows of a run share. Runs that are equal as a whole are repeats
  as a whole. Where a group holds different runs, the members that have no equal, and one of each set of equals, are
  cut into shorter runs (``widths`` windows, in the end single windows) and sorted again.

Equal groups of the last digit are exactly the repeated windows. Groups are counted by (digit, run) with map-side
sums and looked up by joins, so no group is ever gathered, however many copies there are. The texts are written once,
bucketed by row key, and every pass reads them without a shuffle.

Defined results: a null text is empty; a text shorter than a window has no repeat of its own; equal rows are each
other's repeats; runs of one token repeated are repeats of themselves from the second window on (the first starts
elsewhere too); an empty table gives an empty result; extra columns are carried along; their names cannot clash
because own columns start with ``_r_``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlens.llm import texts
from driftlens.llm.texts import PIECE, gram_hashes, mix, signed, span_hashes, text_slices, word_spans
from driftlens.llm.workers import map_arrow
from driftlens.staging import stage, stage_bucketed

LENGTH = 400
WIDTHS = (64, 8, 1)
_PLACE = 24  # bits of a position inside a piece

RECORD = "_r_core long, _r_full long, _r_full2 long, _r_key long, _r_doc {}, _r_at long, _r_lo long, _r_hi long"


def symbols(data: np.ndarray, offsets: np.ndarray, words: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, offsets of texts in them, first byte and end byte of each symbol)."""
    if not words:
        at = np.arange(len(data))
        return data, offsets, at, at + 1
    starts, ends = word_spans(data, offsets)
    values = texts.word_hashes(data, starts, ends)
    return values, np.searchsorted(starts, offsets), starts, ends


def sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    """Least key of each ``width`` neighbours, by block prefixes and suffixes."""
    n = len(keys)
    full = -(-n // width) * width
    blocks = np.full(full, np.iinfo(np.uint64).max, dtype=np.uint64)
    blocks[:n] = keys
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def runs(values: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(anchor, first window, last window, gram hash) of each run of windows with one least gram, piece by piece."""
    total = len(values)
    mask = np.uint64((1 << _PLACE) - 1)
    for first in range(0, max(total - length + 1, 0), PIECE):
        part = values[first : first + PIECE + length - 1]
        hashes = gram_hashes(part, gram)
        at = np.arange(len(hashes))
        least = sliding_min((hashes & ~mask) | at.astype(np.uint64), length - gram + 1)
        anchor = (least & mask).astype(np.int64)
        window = np.arange(len(anchor))
        row = np.searchsorted(offsets, window + first, side="right") - 1
        ok = window + first + length <= offsets[row + 1]
        window, anchor = window[ok], anchor[ok]
        if not len(window):
            continue
        new = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1] + 1))))
        last = np.append(new[1:], len(window)) - 1
        yield anchor[new] + first, window[new] + first, window[last] + first, hashes[anchor[new]]


def _each_slice(column: pa.Array, words: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, symbols, offsets, row of each symbol offset) with the rows' numbers in the batch."""
    for first, data, offsets in text_slices(column):
        values, starts, _, _ = symbols(data, offsets, words)
        yield first, values, starts


def _first_digits(words: bool, length: int, gram: int) -> Callable:
    """(gram hash, row key, times) of the runs of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for first, values, offsets in _each_slice(batch.column(1), words):
                for _, lo, _, core in runs(values, offsets, length, gram):
                    row = np.searchsorted(offsets, lo, side="right") - 1
                    order = np.lexsort((core, row))
                    row, core = row[order], core[order]
                    new = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (core[1:] != core[:-1]))))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(signed(core[new])),
                            pa.array(keys[first + row[new]]),
                            pa.array(np.diff(np.append(new, len(row)))),
                        ],
                        names=["_r_core", "_r_key", "_r_n"],
                    )

    return run


def _records(words: bool, length: int, gram: int, width: int | None) -> Callable:
    """Records of whole runs whose gram is in the list of the row, or of runs cut to ``width`` windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            items = batch.column(3)
            edges = items.offsets.to_numpy()
            inner = items.values
            for first, values, offsets in _each_slice(batch.column(2), words):
                a, b = edges[first], edges[first + len(offsets) - 1]
                owner = np.repeat(np.arange(len(offsets) - 1), np.diff(edges[first : first + len(offsets)]))
                if width is None:
                    wanted = inner.slice(a, b - a).to_numpy(zero_copy_only=False).view(np.uint64)
                    found = list(runs(values, offsets, length, gram))
                    if not found or not len(wanted):
                        continue
                    at, lo, hi, core = (np.concatenate(x) for x in zip(*found))
                    row = np.searchsorted(offsets, lo, side="right") - 1
                    # a (row, gram) pair is looked up among the wanted pairs
                    pair = mix(wanted + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                    own = mix(core + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                    some = np.isin(own, pair)
                    at, lo, hi, core, row = at[some], lo[some], hi[some], core[some], row[some]
                else:
                    part = inner.slice(a, b - a)
                    at, lo, hi = (part.field(i).to_numpy(zero_copy_only=False) + offsets[owner] for i in range(3))
                    least, most = (at - hi) // width, (at - lo) // width
                    many = most - least + 1
                    pick = np.repeat(np.arange(len(at)), many)
                    step = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + least[pick]
                    at, row, base = at[pick], owner[pick], at[pick] - width * step
                    lo, hi = np.maximum(lo[pick], base - width + 1), np.minimum(hi[pick], base)
                    core = mix(span_hashes(values, base, base - width + 1 + length) + step.astype(np.uint64))
                if not len(at):
                    continue
                place = mix((at - hi).astype(np.uint64) << np.uint64(32) | (at - lo).astype(np.uint64))
                full = mix(span_hashes(values, lo, hi + length) + place)
                full2 = mix(span_hashes(values, lo, hi + length, 1) + place)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(signed(core)),
                        pa.array(signed(full)),
                        pa.array(signed(full2)),
                        pa.array(keys[first + row]),
                        batch.column(1).take(pa.array(first + row)),
                        *(pa.array(x - offsets[row]) for x in (at, lo, hi)),
                    ],
                    names=["_r_core", "_r_full", "_r_full2", "_r_key", "_r_doc", "_r_at", "_r_lo", "_r_hi"],
                )

    return run


def _sorted_once(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One digit: (repeats, runs to be cut). A run is a repeat if the same run occurs elsewhere."""
    here = F.struct("_r_doc", "_r_key", "_r_lo")
    same = records.groupBy("_r_core", "_r_full", "_r_full2").agg(F.count("*").alias("n"), F.min(here).alias("first"))
    kinds = same.groupBy("_r_core").agg(F.count("*").alias("kinds"), F.sum("n").alias("all"))
    known = same.join(kinds, "_r_core").where("all > 1")
    judged = stage(
        records.join(known, ["_r_core", "_r_full", "_r_full2"]).select(
            "_r_key", "_r_at", "_r_lo", "_r_hi", "n", "kinds", (here == F.col("first")).alias("is_first")
        ),
        "repeat-digit",
    )
    repeats = judged.where("n > 1").select("_r_key", "_r_lo", "_r_hi", "is_first")
    rest = judged.where("kinds > 1 and (n = 1 or is_first)").select("_r_key", "_r_at", "_r_lo", "_r_hi").distinct()
    return repeats, rest


def repeated(
    docs: DataFrame,
    length: int = LENGTH,
    words: bool = False,
    widths: tuple[int, ...] = WIDTHS,
    gram: int | None = None,
    id_col: str = "doc_id",
    text: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """(rows with ``_r_key``, repeats): a repeat is a run of window starts ``_r_lo`` to ``_r_hi`` of a row.

    ``is_first`` marks the occurrence with the smallest id among equal runs of that digit.
    """
    gram = gram or max(1, length // 6)
    # the part that all windows of a run share must not be empty
    widths = tuple(w for w in widths if w == 1 or 4 * w <= length)
    kind = docs.schema[id_col].dataType.simpleString()
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    # equal rows share a key and a result
    rows = stage_bucketed(docs.withColumn("_r_key", F.xxhash64(F.col(id_col).cast("string"), body)), "repeat-rows", "_r_key")
    lean = rows.select("_r_key", F.col(id_col).alias("_r_doc"), F.col(text).cast("string").alias("_r_text"))
    digits = stage(
        map_arrow(lean.select("_r_key", "_r_text"), _first_digits(words, length, gram), "_r_core long, _r_key long, _r_n long"),
        "repeat-grams",
    )
    twice = digits.groupBy("_r_core").agg(F.sum("_r_n").alias("n")).where("n > 1").select("_r_core")
    # the list of a row is bounded by its own text
    asked = digits.join(twice, "_r_core", "left_semi").groupBy("_r_key").agg(F.collect_set("_r_core").alias("items"))
    found = None
    for width in (None, *widths):
        joined = lean.join(asked.hint("shuffle_hash"), "_r_key").select("_r_key", "_r_doc", "_r_text", "items")
        records = stage(map_arrow(joined, _records(words, length, gram, width), RECORD.format(kind)), "repeat-records")
        repeats, rest = _sorted_once(records)
        found = repeats if found is None else found.unionByName(repeats)
        asked = rest.groupBy("_r_key").agg(F.collect_list(F.struct("_r_at", "_r_lo", "_r_hi")).alias("items"))
    return rows, found


def without_repeats(
    docs: DataFrame,
    emit: Callable[[pa.RecordBatch, list[tuple[bytes, int, int, int]]], pa.RecordBatch],
    schema,
    length: int = LENGTH,
    words: bool = False,
    keep_first: bool = False,
    id_col: str = "doc_id",
    text: str = "text",
    **more,
) -> DataFrame:
    """``emit`` gets each batch of rows with (remaining bytes, bytes, removed bytes, removed runs) of every text.

    With ``keep_first`` the first occurrence of a repeat stays, unless another repeat covers it.
    """
    rows, found = repeated(docs, length, words, id_col=id_col, text=text, **more)
    if keep_first:
        found = found.where(~F.col("is_first"))
    spans = found.groupBy("_r_key").agg(F.collect_set(F.struct("_r_lo", "_r_hi")).alias("_r_spans"))
    joined = rows.join(spans.hint("shuffle_hash"), "_r_key", "left")
    names = joined.columns
    text_at, spans_at = names.index(text), names.index("_r_spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, spans = batch.column(text_at), batch.column(spans_at)
            counts = pc.fill_null(pc.list_value_length(spans), 0).to_numpy(zero_copy_only=False)
            out = []
            for first, data, offsets in text_slices(column):
                raw = data.tobytes()
                if words and counts[first : first + len(offsets) - 1].any():
                    starts, ends = word_spans(data, offsets)
                    word_at = np.searchsorted(starts, offsets)
                for i in range(len(offsets) - 1):
                    a, b = int(offsets[i]), int(offsets[i + 1])
                    if not counts[first + i]:
                        out.append((raw[a:b], b - a, 0, 0))
                        continue
                    item = spans[first + i].values
                    lo, hi = (item.field(j).to_numpy(zero_copy_only=False) for j in (0, 1))
                    if words:
                        lo, hi = starts[lo + word_at[i]] - a, ends[hi + length - 1 + word_at[i]] - a
                    else:
                        hi = hi + length
                    change = np.zeros(b - a + 1, dtype=np.int64)
                    np.add.at(change, lo, 1)
                    np.add.at(change, hi, -1)
                    gone = np.cumsum(change[:-1]) > 0
                    begins = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    out.append((data[a:b][~gone].tobytes(), b - a, int(gone.sum()), begins))
            yield emit(batch, out)

    return map_arrow(joined, run, schema)


def digest(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 of every text, every occurrence of a repeat being removed."""
    given = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
    kind = given.schema["id"].dataType.simpleString()

    def emit(batch: pa.RecordBatch, out: list[tuple[bytes, int, int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                batch.column(batch.schema.get_field_index("id")),
                *(pa.array([x[i] for x in out], type=pa.int64()) for i in (1, 2, 3)),
                pa.array([hashlib.sha256(x[0]).hexdigest() for x in out], type=pa.string()),
            ],
            names=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )

    schema = f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return without_repeats(given, emit, schema, length, id_col="id", text="text", **more)


def remove(docs: DataFrame, length: int, words: bool = True, keep_first: bool = True, id_col: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """The rows with their columns, repeats cut out of the text; a text that is left without a word goes."""
    columns = docs.columns

    def emit(batch: pa.RecordBatch, out: list[tuple[bytes, int, int, int]]) -> pa.RecordBatch:
        old = batch.column(batch.schema.get_field_index(text)).to_pylist()
        new = [x[0].decode("utf-8", "ignore") if x[2] else t for x, t in zip(out, old)]
        kept = pa.array([not x[2] or bool(x[0].strip()) for x in out], type=pa.bool_())
        arrays = [pa.array(new, type=pa.string()) if c == text else batch.column(batch.schema.get_field_index(c)) for c in columns]
        return pa.RecordBatch.from_arrays(arrays, names=columns).filter(kept)

    return without_repeats(docs, emit, docs.schema, length, words, keep_first, id_col, text, **more)

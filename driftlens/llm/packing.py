"""Packing along a space-filling curve.

Documents become token ids; the ids of each document, through a fixed table of random directions, become a point in a
few dimensions; the point's cell on a Hilbert curve is the document's key. Documents are laid out in key order as one
stream that is cut every ``length`` ids, so neighbours on the curve share sequences and only the last sequence has
padding.

The stream needs no total order in one task: documents are dealt to parts by quantiles of the key (with a hash of the
id below it, so that equal documents spread over parts), each part's number of ids is summed, and a part starts where
the parts before it end.

Defined results: a null text is empty and gives the end mark alone; equal rows are laid out one after the other; an
empty table gives an empty result; only the id and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.llm.token_counts import byte_symbols
from driftlens.llm.workers import map_arrow, ship
from driftlens.staging import stage

LENGTH = 2048
END_ID = 1
DIMS, BITS = 4, 6
PART_IDS = 4_000_000
MAX_PARTS = 20_000

PIECE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

# Fixed value: how the byte-level tokenizers cut a text before merging bytes.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)


class Encoder:
    """Ids of a text by a tokenizer file.

    Where the file is a plain byte-level merge table whose ids stand in merge order, the same ids come from the faster
    merge loop of ``tiktoken``, fed with the file's own vocabulary; any other file, and any text that holds one of the
    file's added tokens, is left to ``tokenizers``.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.kind = np.uint16 if self.size <= 1 << 16 else np.uint32
        with open(path, encoding="utf-8") as f:
            known = json.load(f)
        self.added = [t["content"] for t in known.get("added_tokens", [])]
        self.merger = self._merger(known)

    @staticmethod
    def _merger(known: dict):
        model, cut = known["model"], known.get("pre_tokenizer") or {}
        plain = model.get("type") == "BPE" and not known.get("normalizer") and not model.get("continuing_subword_prefix")
        if not plain or cut.get("type") != "ByteLevel" or not cut.get("use_regex") or cut.get("add_prefix_space"):
            return None
        alphabet, special = byte_symbols(), {t["content"] for t in known.get("added_tokens", [])}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        ids = [model["vocab"].get(a + b, -1) for a, b in pairs]
        if any(a >= b for a, b in zip(ids, ids[1:])):
            return None
        ranks = {bytes(alphabet[c] for c in piece): i for piece, i in model["vocab"].items() if piece not in special}
        import tiktoken

        return tiktoken.Encoding("merges", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.kind).tobytes()

    def ids(self, text: str) -> bytes:
        if self.merger is None or any(t in text for t in self.added):
            return self.whole(text)
        return np.array(self.merger.encode_ordinary(text), dtype=self.kind).tobytes()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


@lru_cache(maxsize=2)
def directions(size: int, dims: int = DIMS) -> np.ndarray:
    """A random direction for each id; the same in every task."""
    return np.random.default_rng(7).standard_normal((size, dims)).astype(np.float32)


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of integer points (rows), by the transpose construction."""
    x = points.T.astype(np.int64).copy()
    dims = len(x)
    bit = 1 << (bits - 1)
    while bit > 1:
        low = bit - 1
        for i in range(dims):
            high = (x[i] & bit) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0]) ^ swap
            x[i] ^= swap
        bit >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip, bit = np.zeros_like(x[0]), 1 << (bits - 1)
    while bit > 1:
        flip = np.where((x[dims - 1] & bit) != 0, flip ^ (bit - 1), flip)
        bit >>= 1
    x ^= flip
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def curve_keys(ids: list[np.ndarray], size: int) -> np.ndarray:
    """Curve cell of each document: the mean direction of its ids, squashed to the unit cube."""
    table = directions(size)
    means = np.array([table[i].mean(axis=0) if len(i) else np.zeros(DIMS) for i in ids], dtype=np.float64).reshape(-1, DIMS)
    cells = ((np.tanh(2.5 * means) + 1) / 2 * (1 << BITS)).astype(np.int64)
    return hilbert(np.clip(cells, 0, (1 << BITS) - 1))


def encoded(docs: DataFrame, path: str, id_col: str, text: str) -> DataFrame:
    """id, n (ids with the end mark), key, ids (packed, without the end mark)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path)
        for batch in batches:
            packed = [tool.ids(t or "") for t in batch.column(1).to_pylist()]
            arrays = [np.frombuffer(p, dtype=tool.kind) for p in packed]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(a) + 1 for a in arrays], type=pa.int64()),
                    pa.array(curve_keys(arrays, tool.size), type=pa.int64()),
                    pa.array([tool.kind().itemsize] * len(arrays), type=pa.int32()),
                    pa.array(packed, type=pa.binary()),
                ],
                names=["id", "n", "cell", "width", "ids"],
            )

    given = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
    kind = given.schema["id"].dataType.simpleString()
    out = map_arrow(given, run, f"id {kind}, n long, cell long, width int, ids binary")
    spread = F.shiftrightunsigned(F.xxhash64(F.col("id").cast("string"), F.col("ids")), 64 - (62 - DIMS * BITS))
    return out.withColumn("key", F.shiftleft("cell", 62 - DIMS * BITS) + spread).drop("cell")


def cut(ids: np.ndarray, at: int, length: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(start, length, checksum, sequence, offset) of the pieces of one document that begins at ``at`` of the stream."""
    start = 0
    while start < len(ids):
        sequence, offset = divmod(at + start, length)
        n = min(length - offset, len(ids) - start)
        yield start, n, zlib.crc32(ids[start : start + n].tobytes()), sequence, offset
        start += n


def pack(
    docs: DataFrame,
    path: str,
    length: int = LENGTH,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text: str = "text",
    part_ids: int = PART_IDS,
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    The driver gets one quantile and one sum for each part; there are at most ``MAX_PARTS``.
    """
    ship(docs.sparkSession)
    rows = stage(encoded(docs, path, id_col, text), "pack-ids")
    kind = rows.schema["id"].dataType.simpleString()
    total = rows.agg(F.sum("n")).first()[0] or 0
    parts = int(min(MAX_PARTS, max(1, -(-total // part_ids))))
    shares = [i / parts for i in range(1, parts)]
    bounds = np.array(
        (rows.agg(F.percentile_approx("key", shares, 20 * parts)).first()[0] or []) if shares else [], dtype=np.int64
    )

    @F.pandas_udf("int")
    def part_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, key.to_numpy(), side="left").astype(np.int32))

    dealt = rows.withColumn("part", part_of("key"))
    sums = {r.part: r.n for r in dealt.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    starts, at = {}, 0
    for part in sorted(sums):
        starts[part], at = at, at + sums[part]

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = None, 0
        for batch in batches:
            which, pieces = [], []
            columns = (batch.column(i).to_pylist() for i in range(3))
            for i, (own, width, packed) in enumerate(zip(*columns)):
                if own != part:
                    part, at = own, starts[own]
                ids = np.frombuffer(packed, dtype=np.uint16 if width == 2 else np.uint32).astype("<u4")
                ids = np.append(ids, np.array([end_id], dtype="<u4"))
                for start, n, check, sequence, offset in cut(ids, at, length):
                    which.append(i)
                    pieces.append((start, n, check, len(ids), sequence, offset))
                at += len(ids)
            values = np.array(pieces, dtype=np.int64).reshape(-1, 6)
            yield pa.RecordBatch.from_arrays(
                [batch.column(3).take(pa.array(which, type=pa.int64())), *(pa.array(values[:, j]) for j in range(6))],
                names=[id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    laid = dealt.repartition(max(parts, 1), "part").sortWithinPartitions("part", "key", "id", "n")
    return map_arrow(laid.select("part", "width", "ids", "id"), lay, f"`{id_col}` {kind}, {PIECE}")

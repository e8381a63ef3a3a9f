"""Quality classifier with supervised subword embeddings.

A text's features are its words, its pairs of neighbouring words, and the n-grams of the characters of each word with a
border before and after it; each is hashed to one of ``buckets`` learned vectors. The vectors of a text are averaged and
a linear layer with softmax gives the probability of label 1. Vectors and layer are trained by stochastic gradient descent in numpy
on at most ``sample_rows`` labelled texts, the first in order of a hash of their id.

Scoring needs only the difference of the two classes' outputs for each bucket, one number, so a text's score is the
mean of one gathered array; the model that travels to the tasks is ``buckets`` numbers.

Defined results: a null, empty or wordless text has no feature and scores the share of label 1 in the sample; with no
usable label every score is 0.5, and with labels of one kind only the constant 1 or 0; null labels are not learned
from, nor are texts longer than ``sample_bytes`` (they are scored whole, in the task that reads them); repeated rows are
scored one by one; an empty table gives an empty result; only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlens.llm.texts import mix, text_slices, word_hashes, word_spans
from driftlens.llm.workers import map_arrow

BUCKET_BITS = 17
DIM = 12
SAMPLE_ROWS = 4000
SAMPLE_BYTES = 1 << 17
EPOCHS = 15
RATE = 0.3
VECTOR_RATE = 40.0  # times the rate
SEED = 11
GRAMS = (3, 4, 5)
BORDER = 1 << 21  # no code point
_ODD = np.uint64(0x9E3779B97F4A7C15)
CUT = 0.7


def held_out(id_col: Column) -> Column:
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def characters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code point, first byte) of every character of UTF-8 bytes."""
    first = np.flatnonzero((data & 0xC0) != 0x80)
    padded = np.concatenate([data, np.zeros(3, dtype=np.uint8)]).astype(np.uint32)
    b0, b1, b2, b3 = (padded[first + i] for i in range(4))
    two = (b0 & 0x1F) << 6 | b1 & 0x3F
    three = (b0 & 0x0F) << 12 | (b1 & 0x3F) << 6 | b2 & 0x3F
    four = (b0 & 0x07) << 18 | (b1 & 0x3F) << 12 | (b2 & 0x3F) << 6 | b3 & 0x3F
    return np.where(b0 < 0x80, b0, np.where(b0 < 0xE0, two, np.where(b0 < 0xF0, three, four))), first


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BUCKET_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every feature of the texts of one slice: words, pairs of words, and n-grams of their characters."""
    starts, ends = word_spans(data, offsets)
    shift = np.uint64(64 - bits)
    hashes = word_hashes(data, starts, ends)
    rows = np.searchsorted(offsets, starts, side="right") - 1
    out_rows, out = [rows], [(hashes >> shift).astype(np.int64)]
    pair = np.flatnonzero(rows[1:] == rows[:-1])
    out_rows.append(rows[pair])
    out.append((mix(hashes[pair] * _ODD + hashes[pair + 1]) >> shift).astype(np.int64))
    if not len(starts):
        return out_rows[0], out[0]
    # the characters of each word between a border before and a border after it
    code, first = characters(data)
    a, b = np.searchsorted(first, starts), np.searchsorted(first, ends)
    lengths = b - a + 2
    begin = np.cumsum(lengths) - lengths
    symbols = np.full(int(lengths.sum()), BORDER, dtype=np.uint64)
    owner = np.repeat(np.arange(len(starts)), lengths)
    place = np.arange(len(symbols)) - begin[owner]
    inside = (place > 0) & (place < lengths[owner] - 1)
    symbols[inside] = code[(a[owner] + place - 1)[inside]]
    left = lengths[owner] - place
    packed = symbols.copy()
    for n in range(2, max(GRAMS) + 1):
        packed = packed[: len(symbols) - n + 1] * _ODD + symbols[n - 1 :]
        if n in GRAMS:
            some = np.flatnonzero(left[: len(packed)] >= n)
            out.append((mix(packed[some] ^ np.uint64(n)) >> shift).astype(np.int64))
            out_rows.append(rows[owner[some]])
    return np.concatenate(out_rows), np.concatenate(out)


def bags(texts: pa.Array, bits: int = BUCKET_BITS) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, weights) of each text; weights sum to 1."""
    out = []
    for _, data, offsets in text_slices(texts):
        rows, buckets = features(data, offsets, bits)
        key, count = np.unique((rows.astype(np.int64) << bits) | buckets, return_counts=True)
        row, bucket = key >> bits, key & ((1 << bits) - 1)
        edges = np.searchsorted(row, np.arange(len(offsets)))
        for a, b in zip(edges[:-1], edges[1:]):
            weight = count[a:b] / max(count[a:b].sum(), 1)
            out.append((bucket[a:b].astype(np.int32), weight.astype(np.float32)))
    return out


@dataclass(frozen=True)
class Model:
    """``gain[bucket]``: what the bucket's vector adds to the log odds of label 1."""

    gain: np.ndarray
    bias: float
    empty: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        out = []
        for _, data, offsets in text_slices(texts):
            rows, buckets = features(data, offsets, int(len(self.gain)).bit_length() - 1)
            n = np.bincount(rows, minlength=len(offsets) - 1)
            total = np.bincount(rows, weights=self.gain[buckets], minlength=len(offsets) - 1)
            odds = total / np.maximum(n, 1) + self.bias
            out.append(np.where(n > 0, 1 / (1 + np.exp(-np.clip(odds, -40, 40))), self.empty))
        return np.concatenate(out) if out else np.zeros(0)


def train(
    texts: list[str | None],
    labels: np.ndarray,
    bits: int = BUCKET_BITS,
    dim: int = DIM,
    epochs: int = EPOCHS,
    rate: float = RATE,
    vector_rate: float = VECTOR_RATE,
    seed: int = SEED,
) -> Model:
    """Stochastic gradient descent over single texts with a falling rate; the same input gives the same model."""
    size = 1 << bits
    labels = np.asarray(labels, dtype=np.int64)
    share = float(labels.mean()) if len(labels) else 0.5
    if share in (0.0, 1.0) or not len(labels):
        odds = 0.0 if not len(labels) else (40.0 if share else -40.0)
        return Model(np.zeros(size), odds, share)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (size, dim))
    layer, bias = np.zeros((dim, 2)), np.log(np.array([1 - share, share]))
    examples = bags(pa.array(texts, type=pa.large_string()), bits)
    used = np.array([i for i, (b, _) in enumerate(examples) if len(b)], dtype=np.int64)
    done, steps = 0, max(epochs * len(used), 1)
    for _ in range(epochs):
        for i in rng.permutation(used):
            bucket, weight = examples[i]
            hidden = weight @ vectors[bucket]
            out = hidden @ layer + bias
            out = np.exp(out - out.max())
            out /= out.sum()
            out[labels[i]] -= 1
            step = rate * (1 - done / steps)
            back = layer @ out
            layer -= step * np.outer(hidden, out)
            bias -= 0.1 * step * out
            # a vector moves by its weight in the mean, which is small: vectors have a rate of their own
            vectors[bucket] -= (step * vector_rate) * weight[:, None] * back
            done += 1
    return Model(vectors @ (layer[:, 1] - layer[:, 0]), float(bias[1] - bias[0]), share)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    sample_rows: int = SAMPLE_ROWS,
    sample_bytes: int = SAMPLE_BYTES,
) -> Model:
    """A model from at most ``sample_rows`` labelled texts of at most ``sample_bytes`` each that are not held out.

    An id with several labels counts with its smallest, an id with several rows with its least text; only the sample
    comes to the driver.
    """
    wanted = (
        labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
        .groupBy(F.col(id_col).alias("label_id"))
        .agg(F.min(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("label_id"), "label_id")
        .limit(sample_rows)
    )
    sample = (
        docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
        .where(F.coalesce(F.octet_length("text"), F.lit(0)) <= sample_bytes)
        .join(F.broadcast(wanted), F.col("id") == F.col("label_id"))  # sample_rows rows at most
        .groupBy("id", "label")
        .agg(F.min("text").alias("text"))
        .toPandas()
        .sort_values(["id", "text"], kind="stable")
    )
    return train(sample["text"].where(sample["text"].notna(), None).tolist(), sample["label"].to_numpy())


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text", cut: float = CUT) -> DataFrame:
    """id, held_out, score, predicted for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = shared.value.scores(batch.column(2))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(values), pa.array((values >= cut).astype(np.int32))],
                names=[id_col, "held_out", "score", "predicted"],
            )

    given = docs.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), F.col(text).cast("string").alias("text"))
    kind = given.schema[0].dataType.simpleString()
    return map_arrow(given, run, f"`{id_col}` {kind}, held_out boolean, score double, predicted int")

"""Nearest neighbours by inner product from randomly rotated one-bit codes.

Each vector is taken relative to its nearest centre, rotated by a fixed random rotation and reduced to the signs of
its coordinates, packed into bits, with a few correction scalars. For a query these give an estimate of the inner
product and a bound on its error. In every block the best estimates are computed exactly first; the k-th exact value
found so far is the mark, and every further vector whose estimate plus bound reaches the mark is computed exactly too.
Scores are therefore always exact; only a vector whose error exceeds its bound can be missed (``epsilon`` standard
errors; recall is measured in the tests).

Queries and vectors meet in blocks of bounded size: each block of vectors is joined by its number to the blocks of
queries. The centres are fitted on at most ``sample_rows`` vectors; every vector is indexed.

Defined results: rows whose id is null, or whose vector is null, empty, zero or holds a null or non-finite component,
take no part; of rows with one id the smallest vector counts; vectors of different length are never compared; equal
scores are ordered by id; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlens.llm.workers import map_arrow, ship
from driftlens.staging import stage

CENTRES = 16
SAMPLE_ROWS = 4096
BLOCK_VALUES = 1 << 19
QUERY_ROWS = 512
EPSILON = 2.6
SEED = 20240229

PACKED = "dim int, block int, n int, ids binary, vectors binary, codes binary, scalars binary, centre binary"


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix; the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def centres(sample: np.ndarray, count: int = CENTRES, rounds: int = 8) -> np.ndarray:
    """Lloyd's centres of a bounded sample, started from evenly spaced rows."""
    count = max(1, min(count, len(sample)))
    out = sample[np.linspace(0, len(sample) - 1, count).astype(int)].copy()
    for _ in range(rounds):
        near = nearest(sample, out)
        for i in range(count):
            if (near == i).any():
                out[i] = sample[near == i].mean(axis=0)
    return out


def nearest(vectors: np.ndarray, middle: np.ndarray) -> np.ndarray:
    return np.argmin((middle**2).sum(axis=1) - 2 * vectors @ middle.T, axis=1)


def encode(vectors: np.ndarray, middle: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs; (factor, offset, error) of each vector; the number of its centre.

    With residual o, its rotated signs s and a = <s, o> / (|o| sqrt(d)), <o, q> is estimated by <s, q> |o| / (a
    sqrt(d)); the standard error is |q| |o| sqrt((1 - a^2) / a^2 / (d - 1)).
    """
    dim = vectors.shape[1]
    near = nearest(vectors, middle)
    rest = vectors - middle[near]
    turned = rest @ turn
    signs = np.where(turned >= 0, 1.0, -1.0)
    norm = np.sqrt((rest**2).sum(axis=1))
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.abs(turned).sum(axis=1) / (norm * np.sqrt(dim))
        factor = np.where(norm > 0, norm / (a * np.sqrt(dim)), 0.0)
        error = np.where(norm > 0, norm * np.sqrt(np.maximum(1 - a * a, 0) / (a * a) / max(dim - 1, 1)), 0.0)
    turned_centre = (middle @ turn)[near]
    # <o, q> = <o, q - c> + <o, c>: the parts that do not depend on the query
    offset = (rest * middle[near]).sum(axis=1) - factor * (signs * turned_centre).sum(axis=1)
    return np.packbits(signs > 0, axis=1), np.column_stack([factor, offset, error]), near


def exact(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products summed in one order for every row, block and batch; a matrix product gives equal rows unequal bits."""
    return (vectors * query).sum(axis=1)


def search_block(
    query_ids: np.ndarray,
    queries: np.ndarray,
    ids: np.ndarray,
    vectors: np.ndarray,
    codes: np.ndarray,
    scalars: np.ndarray,
    near: np.ndarray,
    middle: np.ndarray,
    turn: np.ndarray,
    k: int,
    epsilon: float,
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query id, vector ids, exact scores): the k best of one block for each query."""
    dim = queries.shape[1]
    signs = np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * 2 - 1
    factor, offset, error = scalars.T
    guess = (signs @ (queries @ turn).astype(np.float32).T).T * factor + offset  # queries x vectors
    guess += (queries @ middle.T)[:, near]
    away = np.sqrt(np.maximum((queries**2).sum(axis=1)[:, None] - 2 * queries @ middle.T + (middle**2).sum(axis=1), 0))
    bound = epsilon * error * away[:, near] + 1e-6
    # equal vectors are found together, so that ties among them go to the smaller id
    _, same = np.unique((vectors + 0.0).view(f"V{vectors.itemsize * dim}").ravel(), return_inverse=True)
    groups = same.max(initial=-1) + 1
    for i, own in enumerate(query_ids):
        other = ids != own
        first = min(len(ids), k + 44)
        lead = np.argpartition(-guess[i], first - 1)[:first]
        lead = lead[other[lead]]
        scores = exact(vectors[lead], queries[i])
        mark = np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) >= k else -np.inf
        more = guess[i] + bound[i] >= mark
        if groups < len(ids):
            hit = np.zeros(groups, dtype=bool)
            hit[same[more]] = True
            hit[same[lead]] = True
            more = hit[same]
        more[lead] = False
        more = np.flatnonzero(more & other)
        found = np.concatenate([lead, more])
        scores = np.concatenate([scores, exact(vectors[more], queries[i])])
        best = np.lexsort((ids[found], -scores))[:k]
        yield int(own), ids[found[best]], scores[best]


def usable(vector: Column) -> Column:
    v = vector.cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)


def search(
    table: DataFrame,
    is_query: Column,
    k: int = 20,
    id_col: str = "vec_id",
    vector: str = "embedding",
    sample_rows: int = SAMPLE_ROWS,
    block_values: int = BLOCK_VALUES,
    query_rows: int = QUERY_ROWS,
    epsilon: float = EPSILON,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` largest inner products of each query with all other rows."""
    spark = table.sparkSession
    ship(spark)
    rows = stage(
        table.where(F.col(id_col).isNotNull() & usable(F.col(vector)))
        .select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("asks"))
        .groupBy("id")
        .agg(F.min("v").alias("v"), F.max("asks").alias("asks"))
        .withColumn("dim", F.size("v")),
        "ann-rows",
    )
    found = "query_id long, vec_id long, score double"
    sizes = rows.groupBy("dim").agg(F.count("*").alias("n"), F.sum(F.col("asks").cast("long")).alias("q"))
    parts = []
    for d in sizes.orderBy("dim").collect():  # one row for each length of vector
        mine = rows.where(F.col("dim") == d.dim)
        if not d.q:
            continue
        sample = mine.orderBy(F.xxhash64("id")).limit(sample_rows).select("v").toPandas()
        dim = d.dim
        middle = centres(np.array(sample["v"].tolist(), dtype=np.float64).reshape(len(sample), d.dim))
        per_block = max(1, block_values // d.dim)
        blocks, query_blocks = -(-d.n // per_block), -(-d.q // query_rows)

        def pack(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("id")
            vectors = np.array(group["v"].tolist(), dtype=np.float64)
            codes, scalars, near = encode(vectors, middle, rotation(vectors.shape[1]))
            return pd.DataFrame(
                {
                    "dim": [vectors.shape[1]],
                    "block": [group["block"].iloc[0]],
                    "n": [len(group)],
                    "ids": [group["id"].to_numpy(np.int64).tobytes()],
                    "vectors": [vectors.tobytes()],
                    "codes": [codes.tobytes()],
                    "scalars": [scalars.tobytes()],
                    "centre": [near.astype(np.int32).tobytes()],
                }
            )

        def dealt(part: DataFrame, count: int) -> DataFrame:
            return part.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(count)).cast("int"))

        def pack_queries(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("id")
            return pd.DataFrame(
                {
                    "q_ids": [group["id"].to_numpy(np.int64).tobytes()],
                    "q_vectors": [np.array(group["v"].tolist(), dtype=np.float64).tobytes()],
                }
            )

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            turn, packed = rotation(dim), max(1, -(-dim // 8))
            for batch in batches:
                for row in batch.to_pylist():
                    out = list(
                        search_block(
                            np.frombuffer(row["q_ids"], np.int64),
                            np.frombuffer(row["q_vectors"], np.float64).reshape(-1, dim),
                            np.frombuffer(row["ids"], np.int64),
                            np.frombuffer(row["vectors"], np.float64).reshape(-1, dim),
                            np.frombuffer(row["codes"], np.uint8).reshape(-1, packed),
                            np.frombuffer(row["scalars"], np.float64).reshape(-1, 3),
                            np.frombuffer(row["centre"], np.int32),
                            middle,
                            turn,
                            k,
                            epsilon,
                        )
                    )
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.repeat([q for q, _, _ in out], [len(v) for _, v, _ in out]).astype(np.int64)),
                            pa.array(np.concatenate([v for _, v, _ in out])),
                            pa.array(np.concatenate([s for _, _, s in out])),
                        ],
                        names=["query_id", "vec_id", "score"],
                    )

        vectors = dealt(mine, blocks).groupBy("block").applyInPandas(pack, PACKED)
        asked = dealt(mine.where("asks"), query_blocks).groupBy("block").applyInPandas(pack_queries, "q_ids binary, q_vectors binary")
        asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        parts.append(map_arrow(vectors.join(asked, "block"), find, found))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )

"""Language identification by rank-order profiles.

A profile is the list of the most frequent letter n-grams (one to three letters, words padded with blanks) in order
of frequency. A text's own profile is compared to each language's by the out-of-place distance: the sum over the
text's n-grams of how far each stands from its place in the language's list, or the length of the list where it is
missing. The nearest language wins.

Profiles are learned from all rows that are not held out: tasks count n-grams per language, the counts are summed, and
the ``size`` most frequent of each language are kept. Only these come to the driver.

Defined results: a null text, or one without a letter, is ``und`` with score 0; null languages are not learned from;
with no learned language everything is ``und``; equal counts are ordered by n-gram and equal distances by language;
repeated rows are judged one by one; an empty table gives an empty result; other columns are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlens.llm.workers import map_arrow

SIZE = 300
UNKNOWN = "und"
ROWS_AT_ONCE = 256
_BITS = np.uint64(21)


def held_out(id_col: Column) -> Column:
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def grams(text: str) -> np.ndarray:
    """Codes of all n-grams of one text; empty if it has no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    is_letter = letters()[points]
    if not is_letter.any():
        return np.zeros(0, dtype=np.uint64)
    # every run of other characters becomes one blank; one blank at either end
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    body = np.where(is_letter, points, 0)[keep].astype(np.uint64)
    ends = np.zeros(len(body) + 2, dtype=np.uint64)
    ends[1:-1] = body
    if body[-1] == 0:
        ends = ends[:-1]
    a, b, c = ends[:-2], ends[1:-1], ends[2:]
    one = ends[ends > 0]
    two = (ends[:-1] << _BITS) | ends[1:]
    three = ((a << _BITS) | b) << _BITS | c
    # n-grams of two and three are told apart from shorter ones by marks in the top bits
    return np.concatenate([one, two | np.uint64(1 << 63), three[b > 0] ^ np.uint64(1 << 62)])


def ranked(codes: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The ``size`` most frequent codes, most frequent first, ties by code."""
    values, counts = np.unique(codes, return_counts=True)
    return values[np.argsort(-counts, kind="stable")[:size]]


@dataclass(frozen=True)
class Profiles:
    """Places of n-grams in each language's list; ``size`` where an n-gram is missing."""

    languages: list[str]
    codes: np.ndarray
    places: np.ndarray  # codes x languages
    size: int

    @staticmethod
    def of(lists: dict[str, np.ndarray], size: int = SIZE) -> Profiles:
        languages = sorted(lists)
        codes = np.unique(np.concatenate([lists[x] for x in languages])) if languages else np.zeros(0, dtype=np.uint64)
        places = np.full((len(codes), len(languages)), size, dtype=np.int64)
        for i, language in enumerate(languages):
            places[np.searchsorted(codes, lists[language]), i] = np.arange(len(lists[language]))
        return Profiles(languages, codes, places, size)

    def distances(self, own: np.ndarray) -> np.ndarray:
        """Out-of-place distance of a text's ranked n-grams to each language."""
        at = np.searchsorted(self.codes, own)
        at[at == len(self.codes)] = 0
        known = self.codes[at] == own
        places = np.where(known[:, None], self.places[at], self.size)
        place = np.arange(len(own))[:, None]
        return np.where(places < self.size, np.abs(places - place), self.size).sum(axis=0)

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and its score: how much nearer it is than the next one, or than a text with no known n-gram."""
        own = ranked(grams(text or ""), self.size)
        if not len(own) or not self.languages:
            return UNKNOWN, 0.0
        far = self.distances(own)
        best = int(np.argmin(far))
        rest = np.delete(far, best).min() if len(far) > 1 else len(own) * self.size
        return self.languages[best], float((rest - far[best]) / rest) if rest else 0.0


def learn(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", size: int = SIZE) -> Profiles:
    """Profiles from all rows that are not held out and have a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(first, ROWS_AT_ONCE)
                held: dict[str, list[np.ndarray]] = {}
                for language, value in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    held.setdefault(language, []).append(grams(value))
                for language, found in held.items():
                    codes, n = np.unique(np.concatenate(found), return_counts=True)
                    if language in sums:
                        old, m = sums[language]
                        every, place = np.unique(np.concatenate([old, codes]), return_inverse=True)
                        sums[language] = every, np.bincount(place, weights=np.concatenate([m, n]), minlength=len(every))
                    else:
                        sums[language] = codes, n.astype(np.float64)
        for language, (codes, n) in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([language] * len(codes), type=pa.string()), pa.array(codes.view(np.int64)), pa.array(n.astype(np.int64))],
                names=["lang", "code", "n"],
            )

    taught = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(F.col(id_col))).select(
        F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")
    )
    sums = map_arrow(taught, count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    # unsigned order of codes: flip the sign bit
    order = Window.partitionBy("lang").orderBy(F.desc("n"), F.col("code").bitwiseXOR(F.lit(-(1 << 63))))
    top = sums.withColumn("place", F.row_number().over(order)).where(F.col("place") <= size)
    lists: dict[str, list[tuple[int, int]]] = {}
    for r in top.select("lang", "code", "place").collect():
        lists.setdefault(r.lang, []).append((r.place, r.code))
    return Profiles.of({x: np.array([c for _, c in sorted(v)], dtype=np.int64).view(np.uint64) for x, v in lists.items()}, size)


def predict(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, held_out, lang_pred, score for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [profiles.predict(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([x for x, _ in out], type=pa.string()), pa.array([s for _, s in out], type=pa.float64())],
                names=[id_col, "held_out", "lang_pred", "score"],
            )

    given = docs.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), F.col(text).cast("string").alias("text"))
    kind = given.schema[0].dataType.simpleString()
    return map_arrow(given, run, f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame, profiles: Profiles, text: str = "text", min_score: float = 0.0) -> DataFrame:
    """All columns of the rows whose language is known with a score of at least ``min_score``."""
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [profiles.predict(t) for t in batch.column(place).to_pylist()]
            yield batch.filter(pa.array([x != UNKNOWN and s >= min_score for x, s in out], type=pa.bool_()))

    return map_arrow(docs, run, docs.schema)

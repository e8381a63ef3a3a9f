"""The dealt operators as registered queries over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from driftlens.llm import classifier, code_books, hard_negatives, jaccard, language, mixing, neighbours, packing, pieces, quality_rules
from driftlens.llm import repeats, sharding, token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


@query
def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.cascade(read(spark, folder, "documents")).drop("rejected_by", "n_asked")


@query
def op5_rendezvous_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard(read(spark, folder, "documents"))


@query
def op2_entropy_balanced_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(read(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")


@query
def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(read(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op3_one_bit_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.search(read(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op8_hilbert_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(read(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op7_rank_order_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    return language.predict(docs, language.learn(docs))


@query
def op9_subword_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    return classifier.score(docs, classifier.fit(docs, read(spark, folder, "labels")))


@query
def op4_repeated_bytes(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.digest(read(spark, folder, "documents"))


@query
def op6_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.join(read(spark, folder, "documents"))


@query
def op11_hyperplane_negatives(spark: SparkSession, folder: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(read(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, label=moved)


@query
def op12_piece_digest(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.digest(read(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op13_bitmask_codes(spark: SparkSession, folder: str) -> DataFrame:
    return code_books.compress(read(spark, folder, "embeddings"))


# SQL forms. Where an operator learns, estimates or hashes beyond SQL there is none; see the tests.

_WORD = r"[^\x20\x09-\x0D]+"

ORACLE["op1_quality_rules"] = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
split AS (SELECT r, doc_id, text, regexp_extract_all(text, '{_WORD}') AS w,
  [x for x in string_split(text, chr(10)) if regexp_matches(x, '{_WORD}')] AS lines FROM docs),
windows AS (SELECT r, unnest(range(1, len(w) - 3)) AS i, w FROM split),
named AS (SELECT r, i, array_to_string(w[i : i + 4], ' ') AS x FROM windows),
twice AS (SELECT r, i FROM named QUALIFY count(*) OVER (PARTITION BY r, x) > 1),
covered AS (SELECT r, count(DISTINCT i + o) AS n FROM twice, (SELECT unnest(range(5)) AS o) GROUP BY r),
base AS (SELECT doc_id, text, w, len(lines) AS n_lines, len(w) AS n_words, CAST(list_sum([length(x) for x in w]) AS BIGINT) AS word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
  FROM split LEFT JOIN covered c USING (r)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  len([x for x in w if regexp_matches(x, '[A-Za-z]') OR regexp_matches(x, '[^\x00-\x7F]')]) AS n_alpha,
  length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_letters FROM base)
SELECT doc_id, n_words, coalesce(word_chars, 0) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 100 * n_symbols <= 10 * n_words AND coalesce(word_chars, 0) BETWEEN 2 * n_words AND 14 * n_words
    AND 100 * n_alpha >= 80 * n_words AND 100 * n_dup_lines <= 30 * n_lines AND 100 * n_upper <= 50 * n_letters AS kept FROM judged
"""

ORACLE["op6_jaccard_join"] = rf"""
WITH RECURSIVE split AS (SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents),
grams AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + least(len(w), 4) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 4) + 2)) AS i FROM split WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY 1),
met AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM met JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y WHERE 100 * c >= 85 * (s.n + t.n - c)),
reached AS (SELECT doc_id, doc_id AS other FROM split UNION SELECT r.doc_id, l.y FROM reached r JOIN links l ON l.x = r.other)
SELECT doc_id, any_value(coalesce(n, 0)) AS n_shingles, min(other) AS component_id FROM reached LEFT JOIN sizes USING (doc_id) GROUP BY doc_id
"""

_KEPT = """kept AS (SELECT vec_id, label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v FROM embeddings
  WHERE len(embedding) > 0 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0)"""

ORACLE["op11_hyperplane_negatives"] = f"""
WITH {_KEPT},
rows AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, CAST(v AS DOUBLE[]) AS v
  FROM kept WHERE label IS NOT NULL),
scored AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM rows a JOIN rows b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positive AS (SELECT anchor_id, other AS positive_id, score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.other AS negative_id, p.score AS positive_score,
  s.score AS negative_score
FROM positive p JOIN scored s USING (anchor_id) WHERE NOT same AND s.score BETWEEN p.score * 80 / 100.0 AND p.score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.other) QUALIFY row_number() OVER w <= 5
"""


def _assigned(books: str) -> str:
    return f"""SELECT vec_id, part, entry, cost FROM (SELECT p.vec_id, p.part, b.entry,
    CAST(list_sum([(p.x[i] - b.x[i]) * (p.x[i] - b.x[i]) for i in range(1, len(p.x) + 1)]) AS BIGINT) AS cost
    FROM parts p JOIN {books} b ON p.part = b.part) QUALIFY row_number() OVER (PARTITION BY vec_id, part ORDER BY cost, entry) = 1"""


def _moved(books: str, near: str) -> str:
    return f"""SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM {books} b LEFT JOIN (SELECT part, entry, list(mean ORDER BY i) AS x FROM
    (SELECT part, entry, i, CAST(sum(c) AS BIGINT) // count(*) - CASE WHEN sum(c) < 0 AND sum(c) % count(*) <> 0 THEN 1 ELSE 0 END AS mean FROM
      (SELECT n.part, n.entry, unnest(range(1, len(p.x) + 1)) AS i, unnest(p.x) AS c FROM {near} n JOIN parts p USING (vec_id, part))
     GROUP BY part, entry, i) GROUP BY part, entry) m USING (part, entry)"""


ORACLE["op13_bitmask_codes"] = f"""
WITH {_KEPT},
parts AS (SELECT vec_id, part, v[part * w + 1 : part * w + w] AS x
  FROM (SELECT vec_id, v, len(v) // 16 AS w, unnest(range(16)) AS part FROM kept)),
books0 AS (SELECT part, entry, x FROM parts JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept) USING (vec_id)
  WHERE entry < 64),
near0 AS ({_assigned("books0")}), books1 AS ({_moved("books0", "near0")}),
near1 AS ({_assigned("books1")}), books2 AS ({_moved("books1", "near1")}), near2 AS ({_assigned("books2")}),
coded AS (SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(cost) AS BIGINT) AS error
  FROM near2 JOIN kept USING (vec_id) GROUP BY vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) FROM books2) AS codebooks_sha256 FROM coded
"""

"""Hard negatives, vector codes and sentencepiece ids against plain Python and the library."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftlens.llm import code_books, hard_negatives, pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")
CLASH = ["id", "v", "n2", "size", "cell", "block", "key", "part", "rank", "score", "least", "most", "code", "error", "of_label", "entry"]
VECTORS = "vec_id long, embedding array<float>, label int"


def table(spark, rows):
    return spark.createDataFrame(rows, VECTORS).repartition(3).selectExpr("*", *(f"'clash' AS `{c}`" for c in CLASH))


def random_rows(seed, count, dim, copies=0):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(6, dim)) / 4
    v = (middle[rng.integers(0, 6, count)] + rng.normal(size=(count, dim)) / 12).astype(np.float32)
    rows = [(int(i), [float(x) for x in v[i]], int(rng.integers(0, 10))) for i in range(count)]
    rows += [(count + i, rows[7][1], i % 3) for i in range(copies)]
    return rows


def odd_rows(dim):
    one = [0.25] * dim
    return [
        (None, one, 1), (9001, None, 1), (9002, [], 1), (9003, [None, *one[1:]], 1), (9004, [math.nan, *one[1:]], 2),
        (9005, [math.inf, *one[1:]], 2), (9006, one[1:], 2), (9007, one, None), (9008, [0.0] * dim, 3), (9009, [-0.1] * dim, 3),
    ]


def whole(vector):
    return [math.floor(256 * float(np.float32(x))) for x in vector]


# --- hard negatives


def plain_negatives(rows, is_anchor, positives=5, negatives=5):
    kept = {}
    dim = len(min((r for r in rows if fits(r) and r[2] is not None), key=lambda r: r[0])[1])
    for i, v, label in rows:
        if fits((i, v, label)) and label is not None and len(v) == dim:
            kept[i] = min(kept.get(i, (label, whole(v))), (label, whole(v)))
    out = set()
    for a, (label, v) in kept.items():
        if not is_anchor(a):
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), i, m == label) for i, (m, w) in kept.items() if i != a]
        for p, i, _ in sorted(s for s in scored if s[2])[:positives]:
            fit = sorted(s for s in scored if not s[2] and 80 * -p <= 100 * -s[0] <= 100 * -p)
            out |= {(a, i, rank, n, -p, -s) for rank, (s, n, _) in enumerate(fit[:negatives], 1)}
    return out


def fits(row):
    return row[0] is not None and row[1] and all(x is not None and math.isfinite(x) for x in row[1])


@pytest.mark.parametrize("seed, copies", [(1, 0), (2, 400)])
def test_negatives(spark, seed, copies):
    rows = random_rows(seed, 600, 8, copies) + odd_rows(8) + [(3, [0.5] * 8, 0)]
    out = hard_negatives.mine(
        table(spark, rows), F.col("vec_id") % 20 == 0, cells=5, sample_rows=64, block_rows=90, fan_out=3, leaf_rows=8
    )
    got = [tuple(r) for r in out.collect()]
    expected = plain_negatives(rows, lambda i: i % 20 == 0)
    assert len(got) == len(set(got)) and set(got) == expected and len(expected) > 100


def test_negatives_pass_siblings_over():
    """The ranges exclude no row of a window, and exclude something."""
    rows = np.array([whole(v) for _, v, _ in random_rows(3, 3000, 8)])
    labels = np.arange(3000) % 10
    top = float((rows.astype(float) ** 2).sum(axis=1).max())
    tree = hard_negatives.Node(hard_negatives.lift(rows, top), labels, np.arange(3000), 8, 32)
    ids = np.arange(3000)
    least, most = np.full(20, 9000), np.full(20, 11000)
    q = hard_negatives.Queries(ids[:20], labels[:20], rows[:20], least, most, False, 5, top)
    seen = []
    leaf = q.leaf
    q.leaf = lambda at, i, m, v: (seen.append(len(at) * len(i)), leaf(at, i, m, v))
    q.search(tree, np.arange(20), ids, labels, rows)
    scores = rows[:20] @ rows.T
    for n in range(20):
        hit = [(-s, i) for i, s in enumerate(scores[n]) if 9000 <= s <= 11000 and labels[i] != labels[n] and i != n]
        assert list(zip(-q.found[n][0], q.found[n][1])) == sorted(hit)[:5]
    assert 0 < sum(seen) < 20 * 3000


def test_negatives_of_an_empty_table(spark):
    out = hard_negatives.mine(table(spark, odd_rows(4)[1:7]), F.col("vec_id") % 2 == 0)
    assert out.count() == 0 and len(out.columns) == 6
    alone = hard_negatives.mine(table(spark, [(0, [0.5] * 4, 1)]), F.col("vec_id") % 2 == 0)
    assert alone.count() == 0


# --- vector codes


def plain_codes(rows, parts=16, entries=64, rounds=2):
    kept = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and len(r[1]) % parts == 0]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [(i, whole(v), label) for i, v, label in kept if len(v) == len(kept[0][1])]
    w = len(kept[0][1]) // parts
    cut = [[tuple(v[p * w : p * w + w]) for _, v, _ in kept] for p in range(parts)]
    books = [c[:entries] for c in cut]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            held = {}
            for x in cut[p]:
                held.setdefault(nearest(p, x)[1], []).append(x)
            books[p] = [tuple(sum(c) // len(c) for c in zip(*held[k])) if k in held else e for k, e in enumerate(books[p])]
    final = [[nearest(p, x) for x in cut[p]] for p in range(parts)]
    sums = Counter()
    for n, (_, _, label) in enumerate(kept):
        sums[label] += sum(f[n][0] for f in final)
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return Counter(
        (i, "".join(f"{f[n][1]:02x}" for f in final), sum(f[n][0] for f in final), sums[label], sha) for n, (i, _, label) in enumerate(kept)
    )


@pytest.mark.parametrize("count, dim, parts, copies", [(300, 32, 16, 150), (40, 12, 4, 3), (90, 5, 5, 0)])
def test_codes(spark, count, dim, parts, copies):
    rows = random_rows(count, count, dim, copies) + odd_rows(dim) + [(2, [0.5] * dim, None)]
    out = code_books.compress(table(spark, rows), parts=parts)
    assert Counter(tuple(r) for r in out.collect()) == plain_codes(rows, parts)


def test_codes_of_an_empty_table(spark):
    out = code_books.compress(table(spark, odd_rows(16)[1:6]))
    assert out.count() == 0 and out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_codes_stand_for_their_entries(spark):
    rows, size = code_books.usable_rows(table(spark, random_rows(4, 200, 16)), 4, "vec_id", "embedding", "label")
    books = code_books.fit(rows, size, 4)
    for r in code_books.encode(rows, books, 4).join(rows.select("id", "v"), "id").collect():
        gap = np.array(whole(r.v)) - code_books.decode(books, bytes(r.code), 4)
        assert int((gap * gap).sum()) == r.error


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-40, 40), min_size=3, max_size=3), min_size=1, max_size=64), st.integers(1, 50))
def test_a_mask_search_is_exact_for_every_first_radius(entries, radius):
    book = code_books.CodeBook(np.array(entries))
    asked = np.array([[7 * i % 90 - 45, 3 * i % 70 - 35, i % 50 - 25] for i in range(60)])
    code, error = book.nearest(asked, radius)
    gaps = ((asked[:, None, :] - np.array(entries)[None]) ** 2).sum(axis=2)
    assert (error == gaps.min(axis=1)).all() and (code == gaps.argmin(axis=1)).all()


def test_components_too_large_are_an_error():
    with pytest.raises(ValueError):
        code_books.integers(np.array([[1e30, 0.0]]))


# --- sentencepiece ids


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def vocabulary():
    return pieces._loaded(pieces.load(MODEL))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_pieces_of_documents(spark, docs, rows, library):
    out = pieces.digest(docs, MODEL)
    expected = Counter()
    for i, text, *_ in rows:
        ids = library.encode(text or "")
        expected[(i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)), True)] += 1
    assert Counter(tuple(r) for r in out.collect()) == expected


def test_pieces_there_and_back(spark, docs, rows, library):
    coded = pieces.encode(docs, MODEL)
    assert coded.columns == [*docs.columns, "ids"]
    back = pieces.decode(coded, MODEL)
    assert Counter((r.doc_id, r.decoded) for r in back.collect()) == Counter((i, library.decode(library.encode(t or ""))) for i, t, *_ in rows)
    again = pieces.encode(coded.withColumn("more", F.lit(1)), MODEL)
    assert again.columns == [*docs.columns, "more", "ids"]


def test_whole_texts_agree_with_the_library(spark, docs):
    assert pieces.disagreeing(docs, MODEL).count() == 0
    assert pieces.disagreeing(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), MODEL).count() == 0


def test_a_disagreement_is_shown(vocabulary, monkeypatch):
    monkeypatch.setattr(vocabulary, "store", {})
    monkeypatch.setattr(vocabulary, "merge", list)
    assert [f[3] for f in vocabulary.described(["", "the words", "\n"])] == [True, False, True]
    assert not vocabulary.agrees("the words", vocabulary.encode("the words"))


def test_pieces_of_an_empty_table(spark, empty):
    assert pieces.digest(empty, MODEL).count() == 0
    assert pieces.decode(pieces.encode(empty, MODEL), MODEL).count() == 0


SOME = st.one_of(st.text(max_size=12), st.sampled_from(["▁", " ", "   ", "\n", "<s>", "<0x41>", "the ", "ing", "\x00", "é", "漢字", "aaaa", "\U0001f600"]))


@settings(max_examples=300, deadline=None)
@given(st.lists(SOME, max_size=12).map("".join))
def test_pieces_of_any_text(library, vocabulary, text):
    ids = library.encode(text)
    assert vocabulary.encode(text) == ids
    assert vocabulary.decode(ids) == library.decode(ids)
    assert vocabulary.described([text, "", text]) == [
        (len(ids), ",".join(map(str, ids)), library.decode(ids), True), (0, "", "", True), (len(ids), ",".join(map(str, ids)), library.decode(ids), True)
    ]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 262), st.integers(0, 31_999)), max_size=10))
def test_text_of_any_ids(library, vocabulary, ids):
    assert vocabulary.decode(ids) == library.decode(ids)


def test_both_forms_of_the_agenda(library, vocabulary):
    rng = random.Random(3)
    for size in (pieces.SHORT - 3, pieces.SHORT, pieces.SHORT + 1, 400):
        text = "".join(rng.choice("aeinrst") for _ in range(size))
        assert vocabulary._merge_short(list(text), {}) == vocabulary._merge_long(list(text), {})
        assert vocabulary.encode(text) == library.encode(text)
    assert vocabulary.encode("a" * 20_000) == library.encode("a" * 20_000)


def test_the_store_of_parts_is_bounded(vocabulary, monkeypatch):
    monkeypatch.setattr(pieces, "KEPT_PARTS", 10)
    text = " ".join(f"word{i}" for i in range(100))
    known = vocabulary.described([text])
    assert vocabulary.described(["a"]) and len(vocabulary.store) <= 10
    assert vocabulary.described([text]) == known


def field(number, value):
    """A field of a serialised message."""

    def varint(x):
        out = bytearray()
        while x > 127:
            out.append(x & 127 | 128)
            x >>= 7
        return bytes([*out, x])

    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def test_other_vocabularies_are_refused():
    piece = field(1, field(1, b"<unk>") + field(3, pieces.UNKNOWN))
    unigram = piece + field(2, field(3, 1))
    own = piece + field(1, field(1, b"own") + field(3, pieces.USER_DEFINED)) + field(2, field(3, pieces.MERGES))
    for model in (unigram, own):
        with pytest.raises((ValueError, RuntimeError)):
            pieces.Pieces(model)

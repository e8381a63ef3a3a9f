"""Mixing, neighbours, repeats, the Jaccard join, components and packing against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from driftlens.llm import jaccard, mixing, neighbours, packing, repeats
from driftlens.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_row(frame):
    return Counter(tuple(r) for r in frame.collect())


# --- mixing


def plain_targets(sizes):
    """{source: target} by sharing the excess again and again."""
    total = sum(sizes.values())
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, free, left = {}, set(sizes), total
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 3 * sizes[s] + 1e-9}
        if not over:
            target |= {s: weight[s] * level for s in free}
            break
        target |= {s: 3 * sizes[s] for s in over}
        left -= sum(3 * sizes[s] for s in over)
        free -= over
    return target


def test_mix_meets_its_targets(docs, rows, empty):
    out = mixing.mix(docs, chunk_rows=16).collect()
    sizes = defaultdict(int)
    for _, text, _, source in rows:
        sizes[source] += len(WORD.findall(text or ""))
    expected = plain_targets(sizes)
    assert Counter((r.doc_id, r["size"]) for r in out) == Counter((i, len(WORD.findall(t or ""))) for i, t, *_ in rows)
    taken = Counter()
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(expected[r.source])
        assert 0 <= r.taken <= 3 * r["size"] and r.taken == r.copies * r["size"]
        taken[r.source] += r.taken
    for source, size in sizes.items():
        lengths = [len(WORD.findall(t or "")) for _, t, _, s in rows if s == source]
        shortest = min((n for n in lengths if n), default=0)
        # the one text of 30,000 words outweighs the rest of its source, which makes up for it as far as it can
        rest = sorted(lengths)[:-1]
        room = abs(taken[source] - expected[source]) <= shortest / 2 + 1e-3
        assert room or {r.copies for r in out if r.source == source and r["size"] in rest and r["size"]} <= {0, 3}
    again = mixing.mix(docs, chunk_rows=16).collect()
    key = lambda r: (r.doc_id or -1, r.source or "", r["size"])
    assert [r.taken for r in sorted(again, key=key)] == [r.taken for r in sorted(out, key=key)]
    assert mixing.mix(empty).count() == 0


def plain_mix(rows, target, limit=3):
    """{size: (rate, copies of the class)} of one source: the dual's root by bisection, then rounding with a carry."""
    counts = Counter(rows)
    low, high = -64.0, 4.0
    for _ in range(300):
        middle = (low + high) / 2
        got = sum(n * s * min(limit, np.exp(middle * s)) for s, n in counts.items())
        low, high = (middle, high) if got < target else (low, middle)
    out = {s: min(limit, np.exp(high * s)) for s in counts}
    order, due = sorted(counts, reverse=True), sum(counts[s] * s * out[s] for s in counts)
    for i, s in enumerate(order):
        later = sum(counts[t] * t * out[t] for t in order[i:])
        room = limit * sum(counts[t] * t for t in order[i + 1 :])
        # as near to the carried rate as possible, among the numbers that leave a rest the shorter ones can take
        want = int(np.floor(counts[s] * out[s] * due / later + 0.5))
        fit = [c for c in range(limit * counts[s] + 1) if -1e-6 <= due - c * s <= room + 1e-6]
        copies = min(fit, key=lambda c: abs(c - want)) if fit else None
        if copies is None:
            copies = min(range(limit * counts[s] + 1), key=lambda c: max(c * s - due, due - c * s - room))
        out[s], due = (out[s], copies), due - copies * s
    return out


def test_rates_solve_the_dual_and_decide_the_copies(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, "w " * max(1, int(rng.lognormvariate(3, 1))), rng.choice("aab")) for i in range(900)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    out = mixing.mix(frame, weights=(1.0, 2.0)).collect()
    for source in "ab":
        own = [r for r in out if r.source == source]
        # stationary: the rates give the target, and are one tilt by tokens
        assert sum(r.rate * r["size"] for r in own) == pytest.approx(own[0].target, rel=1e-6)
        plain = plain_mix([r["size"] for r in own], own[0].target)
        taken = Counter()
        for r in own:
            assert r.rate == pytest.approx(plain[r["size"]][0], rel=1e-6)
            taken[r["size"]] += r.copies
        assert +taken == {s: c for s, (_, c) in plain.items() if c}
        assert abs(sum(r.taken for r in own) - own[0].target) <= min(r["size"] for r in own) / 2 + 1e-3
    # other multipliers give other copies
    solve = mixing.tilts
    monkeypatch.setattr(mixing, "tilts", lambda *a: {k: v.withColumn("tilt", F.lit(-0.02)) for k, v in solve(*a).items()})
    moved = mixing.mix(frame, weights=(1.0, 2.0)).collect()
    changed = {r.doc_id: r.taken for r in moved}
    assert sum(changed[r.doc_id] != r.taken for r in out) > 100
    assert sum(r.taken for r in moved) == pytest.approx(sum(r["size"] * np.exp(-0.02 * r["size"]) for r in out), abs=3)


def test_a_very_long_text_is_made_up_for_by_the_whole_source(spark):
    rows = [(i, "w " * (1 + i % 40), "a") for i in range(4000)] + [(4000, "w " * 40_001, "a")]
    rows += [(5000 + i, "w " * 50, "b") for i in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    out = mixing.mix(frame, weights=(3.0, 4.0)).collect()
    for source, shortest in (("a", 1), ("b", 50)):
        own = [r for r in out if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= shortest / 2 + 1e-6
    short = [r.copies for r in out if r.doc_id < 4000]
    assert max(short) - min(short) <= 1
    again = mixing.mix(frame, weights=(3.0, 4.0), chunk_rows=1000).collect()
    assert {r.doc_id: r.copies for r in again} == {r.doc_id: r.copies for r in out}


def test_newton_meets_two_kinds_of_targets_at_once(spark):
    cells = spark.createDataFrame(
        [("a", "x", 1, 100), ("a", "y", 3, 100), ("b", "x", 2, 100), ("b", "y", 5, 10)], "s string, l string, size long, n long"
    )
    wanted = {
        "s": spark.createDataFrame([("a", 300.0), ("b", 300.0)], "value string, target double"),
        "l": spark.createDataFrame([("x", 350.0), ("y", 250.0)], "value string, target double"),
    }
    solved = {k: {r.value: r.tilt for r in v.collect()} for k, v in mixing.tilts(cells, wanted).items()}
    rate = {(r.s, r.l): r.n * r["size"] * min(3, np.exp((solved["s"][r.s] + solved["l"][r.l]) * r["size"])) for r in cells.collect()}
    assert rate["a", "x"] + rate["a", "y"] == pytest.approx(300, rel=1e-6)
    assert rate["a", "x"] + rate["b", "x"] == pytest.approx(350, rel=1e-6)


def test_repeated_rows_of_the_mix_keep_their_columns(docs):
    out = mixing.repeat_rows(docs)
    assert out.columns == docs.columns
    assert out.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 6


def test_equal_rows_of_the_mix_are_taken_at_their_rate(spark):
    rows = [(None, "x y z", "a", {"k": 1})] * 700 + [(i, f"u v {i}", "a", {"k": i}) for i in range(300)]
    rows += [(1000 + i, f"p q {i}", "b", {}) for i in range(1000)] + [(7, "u v 7", "a", {"k": 8})]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, `odd.name` map<string, long>").repartition(3)
    for weights in ((1.0, 4.0), (7.0, 3.0)):
        target = {r.source: r.target for r in mixing.mix(frame, weights).select("source", "target").distinct().collect()}
        out = mixing.repeat_rows(frame, weights)
        assert out.columns == frame.columns
        got = Counter((r[0], r[1], r[2], tuple(r[3].items())) for r in out.collect())
        assert set(got) <= {(r[0], r[1], r[2], tuple(r[3].items())) for r in rows}
        for source in "ab":
            assert abs(3 * sum(n for r, n in got.items() if r[2] == source) - target[source]) <= 1.5
        share = got[None, "x y z", "a", (("k", 1),)] / 700
        assert abs(share - target["a"] / 3003) < 0.1


# --- structured texts


def opposite_strings(size):
    bits = [bin(i).count("1") & 1 for i in range(size)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_structured_words_are_different_documents(spark):
    rows = [(i, w) for size in (1024, 2048) for i, w in enumerate(opposite_strings(size), size)]
    out = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in out.collect()} == {i: i for i, _ in rows}


def kept_by_hand(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        out.append(bytes(b for b, g in zip(t, gone) if not g))
    return out


def test_structured_texts_lose_only_their_repeats(spark):
    rng = random.Random(9)
    shared = "".join(rng.choice("cdefgh") for _ in range(464))
    rows = [(i, f"{a}{shared}{'xyz'[:i % 3]}") for i, a in enumerate([*opposite_strings(256), *opposite_strings(1024), *opposite_strings(270)])]
    expected = kept_by_hand([t.encode() for _, t in rows], 400)
    out = {r.doc_id: (r.n_removed, r.kept_sha256) for r in repeats.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {i: (len(t) - len(k), hashlib.sha256(k).hexdigest()) for (i, t), k in zip(rows, expected)}


# --- neighbours


def exact_search(vectors, queries, k):
    ids = np.array(sorted(vectors))
    table = np.array([vectors[i] for i in ids])
    for q in queries:
        score = table @ vectors[q]
        other = ids != q
        order = np.lexsort((ids[other], -score[other]))[:k]
        yield q, ids[other][order].tolist(), score[other][order]


def test_neighbours_of_awkward_rows(spark, empty):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(200)]
    rows += [(200 + i, rows[7][1]) for i in range(30)]  # ties
    rows += [(300, None), (320, []), (340, [0.0] * 8), (360, [1.0, None] + [0.0] * 6), (380, [float("nan")] * 8), (400, [float("inf")] * 8)]
    rows += [(None, rows[1][1]), (20, rows[20][1]), (500, [1.0, 2.0]), (520, [2.0, 1.0]), (521, [3.0, 3.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    out = neighbours.search(frame, F.col("vec_id") % 20 == 0, k=20, block_values=400, query_rows=4).collect()
    good = {i: np.array(v) for i, v in rows if i is not None and i < 300}
    got = defaultdict(dict)
    for r in out:
        got[r.query_id][r["rank"]] = (r.vec_id, r.score)
    hits = 0
    for q, ids, score in exact_search(good, [i for i in good if i % 20 == 0], 20):
        assert sorted(got[q]) == list(range(1, 21))
        hits += len({v for v, _ in got[q].values()} & set(ids))
        for i, s in got[q].values():
            assert s == pytest.approx(float(good[i] @ good[q]), abs=1e-12)
    assert hits / (20 * 12) >= 0.97
    assert [got[500][i][0] for i in (1, 2)] == [521, 520] and [got[520][i][0] for i in (1, 2)] == [521, 500]
    assert set(got) == {i for i in good if i % 20 == 0} | {500, 520}
    nothing = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert neighbours.search(nothing, F.col("vec_id") % 20 == 0).count() == 0


def test_ties_in_a_block_of_many_copies_go_to_the_smaller_id():
    rng = np.random.default_rng(11)
    turn = neighbours.rotation(64)
    for _ in range(12):
        vectors = rng.standard_normal((700, 64))
        q = rng.standard_normal(64)
        copies = rng.permutation(700)[:300]
        vectors[copies] = q + 0.3 * rng.standard_normal(64)
        ids = rng.permutation(700).astype(np.int64)
        middle = neighbours.centres(vectors, 4)
        codes, scalars, near = neighbours.encode(vectors, middle, turn)
        asks = ids[copies[0]]
        ((_, got, scores),) = neighbours.search_block(np.array([asks]), q[None, :], ids, vectors, codes, scalars, near, middle, turn, 20, neighbours.EPSILON)
        ids, exact = ids[ids != asks], (vectors * q).sum(axis=1)[ids != asks]
        best = np.lexsort((ids, -exact))[:20]
        assert got.tolist() == ids[best].tolist() and scores.tolist() == exact[best].tolist()


def test_recall_on_the_given_vectors(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    vectors = {r.vec_id: np.array(r.embedding, dtype=np.float64) for r in table.collect()}
    got = defaultdict(set)
    for r in neighbours.search(table, F.col("vec_id") % 20 == 0).collect():
        got[r.query_id].add(r.vec_id)
    queries = [i for i in vectors if i % 20 == 0]
    assert np.mean([len(got[q] & set(ids)) / 20 for q, ids, _ in exact_search(vectors, queries, 20)]) >= 0.97


def test_error_bounds_hold_for_nearly_all_vectors():
    rng = np.random.default_rng(1)
    vectors, q = rng.standard_normal((2000, 64)), rng.standard_normal(64)
    middle, turn = neighbours.centres(vectors[:500], 4), neighbours.rotation(64)
    codes, scalars, near = neighbours.encode(vectors, middle, turn)
    signs = np.unpackbits(codes, axis=1, count=64) * 2.0 - 1
    guess = signs @ (q @ turn) * scalars[:, 0] + scalars[:, 1] + (middle @ q)[near]
    away = np.sqrt(((q - middle) ** 2).sum(axis=1))[near]
    assert (np.abs(guess - vectors @ q) <= neighbours.EPSILON * scalars[:, 2] * away).mean() > 0.97


# --- repeats


def plain_removed(tokens, length):
    """Which tokens of each text a repeat covers."""
    counts = Counter(tuple(t[i : i + length]) for t in tokens for i in range(len(t) - length + 1))
    out = []
    for t in tokens:
        gone = np.zeros(len(t), dtype=bool)
        for i in range(len(t) - length + 1):
            if counts[tuple(t[i : i + length])] > 1:
                gone[i : i + length] = True
        out.append(gone)
    return out


def plain_digest(rows, length):
    raw = [(t or "").encode() for _, t, *_ in rows]
    for (i, *_), b, gone in zip(rows, raw, plain_removed(raw, length)):
        spans = int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if len(b) else 0
        kept = np.frombuffer(b, dtype=np.uint8)[~gone].tobytes()
        yield i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("length", [400, 37])
def test_repeated_bytes_are_removed(docs, rows, length):
    assert by_row(repeats.digest(docs, length)) == Counter(plain_digest(rows, length))


def test_repeats_of_random_short_alphabets(spark):
    rng = random.Random(9)
    rows = [(i, "".join(rng.choice("ab") for _ in range(rng.randint(0, 90)))) for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert by_row(repeats.digest(frame, 12, widths=(3, 1))) == Counter(plain_digest(rows, 12))


def test_pieces_of_long_texts_agree(monkeypatch):
    values = np.frombuffer(b"".join(random.Random(2).choice([b"xy", b"z", b"w"]) for _ in range(900)), dtype=np.uint8).astype(np.uint64)
    offsets = np.array([0, 300, 300, len(values)])
    whole = [np.concatenate(x) for x in zip(*repeats.runs(values, offsets, 30, 5))]
    monkeypatch.setattr(repeats, "PIECE", 64)
    parts = [np.concatenate(x) for x in zip(*repeats.runs(values, offsets, 30, 5))]

    def windows(found):
        return {(w, a, int(g)) for a, lo, hi, g in zip(*found) for w in range(lo, hi + 1)}

    assert windows(whole) == windows(parts)


def test_passages_in_words_keep_their_first_occurrence(spark, empty):
    rng = random.Random(4)
    words = lambda n: [rng.choice("abcdefgh") * rng.randint(1, 9) + str(rng.randint(0, 99)) for _ in range(n)]
    passage = words(60)
    rows = [(i, " ".join(words(40)) + "\n" + "  ".join(passage) + "\n" + " ".join(words(30))) for i in range(5)]
    rows += [(9, " ".join(passage)), (10, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.lit(1))
    out = {r.doc_id: r.text for r in repeats.remove(frame, 50).collect()}
    assert out[0] == rows[0][1] and out[10] is None and 9 not in out
    for i in range(1, 5):
        assert out[i].split() == rows[i][1].split()[:40] + rows[i][1].split()[-30:]
    assert repeats.remove(empty, 50).columns == empty.columns and repeats.digest(empty).count() == 0


# --- the Jaccard join


def plain_join(rows, size, percent):
    sets = []
    for _, text, *_ in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        n = min(size, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                root[find(i)] = find(j)
    least = {}
    for i, (own, *_) in enumerate(rows):
        if own is not None:
            least[find(i)] = min(own, least.get(find(i), own))
    return [(r[0], len(sets[i]), least.get(find(i)) if sets[i] else r[0]) for i, r in enumerate(rows)]


def variants(seed, groups, copies, edits):
    rng = random.Random(seed)
    rows = []
    for _ in range(groups):
        base = [str(rng.randint(0, 5000)) for _ in range(rng.randint(6, 140))]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randint(0, edits)):
                w[rng.randrange(len(w))] = str(rng.randint(0, 5000))
            rows.append((len(rows) * 3 + 1, " ".join(w[: len(w) - rng.randint(0, 2)])))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (5, 80)])
def test_join_of_awkward_rows(docs, rows, size, percent):
    assert by_row(jaccard.join(docs, size, percent)) == Counter(plain_join(rows, size, percent))


@pytest.mark.parametrize(("size", "percent"), [(1, 85), (2, 80), (3, 60)])
def test_join_loses_no_link(spark, size, percent):
    rows = variants(size, 30, 6, 5)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert by_row(jaccard.join(frame, size, percent)) == Counter(plain_join(rows, size, percent))


def test_blocks_and_large_tiles_change_nothing(spark, monkeypatch):
    common = [str(i) for i in range(12)]
    rows = [(i, " ".join([*common, *(f"{i}-{j % 5}" for j in range(8 if i % 2 else 2))])) for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    expected = Counter(plain_join(rows, 1, 60))
    assert by_row(jaccard.join(frame, 1, 60)) == expected
    monkeypatch.setattr(jaccard, "BLOCK", 5)
    assert by_row(jaccard.join(frame, 1, 60)) == expected


def test_signatures_of_linked_sets_meet():
    rng = np.random.default_rng(8)
    for n in [1, 2, 5, 6, 7, 12, 40, 41, 300, 2000]:
        for percent in (60, 80, 85):
            for _ in range(20):
                x = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
                most = int(len(x) * (100 - percent) / 100)
                y = np.unique(np.concatenate([x[rng.permutation(len(x))[: len(x) - rng.integers(0, most + 1)]], rng.integers(0, 2**63, rng.integers(0, most + 1), dtype=np.uint64)]))
                if jaccard.linked(x, y, percent):
                    assert set(jaccard.signatures(x, percent).tolist()) & set(jaccard.signatures(y, percent).tolist())


def test_bitmaps_never_rule_out_a_link():
    rng = np.random.default_rng(8)
    bits = lambda s: np.frombuffer(jaccard.bitmap(s), dtype=np.uint64)[None, :]
    for n in (3, 50, 900, 6000):
        x = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        y = np.unique(np.concatenate([x[: int(n * 0.93)], rng.integers(0, 2**63, n // 20, dtype=np.uint64)]))
        assert jaccard.may_link(np.array([len(x)]), np.array([len(y)]), bits(x), bits(y), 85)[0] or not jaccard.linked(x, y, 85)


def test_bitmaps_of_large_sets_rule_out_strangers():
    rng = np.random.default_rng(9)
    bits = lambda s: np.frombuffer(jaccard.bitmap(s), dtype=np.uint64)[None, :]
    for n in (2000, 6000, 20_000):
        x, y = (rng.integers(0, 2**63, n, dtype=np.uint64) for _ in range(2))
        assert not jaccard.may_link(np.array([n]), np.array([n]), bits(x), bits(y), 80)[0]


def test_folded_bitmaps_are_those_of_fewer_bits(monkeypatch):
    rng = np.random.default_rng(10)
    sets = [np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in (3, 1000, 1100, 2500, 9000, 40_000)]
    words, edges = jaccard.bitmap_words(pa.array([jaccard.bitmap(s) for s in sets], type=pa.binary()))
    assert np.diff(edges).tolist() == [32, 32, 64, 128, 512, 512]
    out = jaccard.folded(words, edges, np.array([5, 0, 2, 4, 1, 3]), 32)
    monkeypatch.setattr(jaccard, "MOST_BITMAP_BITS", 2048)
    assert [x.tobytes() for x in out] == [jaccard.bitmap(sets[i]) for i in (5, 0, 2, 4, 1, 3)]


@pytest.mark.parametrize("block", [jaccard.BLOCK, 3])
def test_sets_with_bitmaps_of_different_length_are_joined(spark, monkeypatch, block):
    rng = random.Random(11)
    rows = []
    for _ in range(4):
        base = [str(rng.randint(0, 10**6)) for _ in range(1150)]
        for _ in range(6):  # 920 to 1,150 words: bitmaps of 2,048 and of 4,096 bits
            w = base[: rng.randint(920, 1150)]
            for _ in range(rng.randint(0, 30)):
                w[rng.randrange(len(w))] = str(rng.randint(0, 10**6))
            rows.append((len(rows) * 3 + 1, " ".join(w)))
    assert len({jaccard.bitmap_bits(len(t.split())) for _, t in rows}) == 2
    monkeypatch.setattr(jaccard, "BLOCK", block)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert by_row(jaccard.join(frame, 1, 85)) == Counter(plain_join(rows, 1, 85))


def test_one_of_each_group_stays(docs, rows, empty):
    out = jaccard.one_of_each(docs)
    joined = plain_join(rows, 5, 80)
    expected = {i for i, _, c in joined if i is not None and i == c}
    kept = [r.doc_id for r in out.select("doc_id").collect()]
    assert set(kept) - {None} == expected and max(Counter(k for k in kept if k is not None).values()) == 1
    assert kept.count(None) == 2 and out.columns == docs.columns
    assert jaccard.join(empty).count() == 0


def test_components_of_chains_stars_and_cycles(spark):
    rng = random.Random(6)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200 + i, 200 + (i + 1) % 7) for i in range(7)] + [(5, 5)]
    rng.shuffle(links)
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    expected = {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 30)} | {200 + i: 200 for i in range(1, 7)}
    assert found == expected
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- packing


def test_hilbert_neighbours_are_neighbours():
    side = 8
    points = np.array([(x, y, z) for x in range(side) for y in range(side) for z in range(side)])
    keys = packing.hilbert(points, 3)
    assert sorted(keys.tolist()) == list(range(side**3))
    path = points[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_packing_is_an_exact_round_trip(docs, rows, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    out = packing.pack(docs, path, length=128, part_ids=3000).collect()
    expected = Counter()
    whole = {}
    for i, text, *_ in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        whole.setdefault((i, len(ids)), ids)
        expected[i] += len(ids)
    got = Counter()
    for r in out:
        ids = whole[r.doc_id, r.doc_tokens]
        assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        got[r.doc_id] += r.length
    assert got == expected
    sequences = defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append((r.offset, r.length))
    for number, pieces in sequences.items():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == 128 or number == max(sequences)
    assert sorted(sequences) == list(range(len(sequences)))
    assert packing.pack(empty, path).count() == 0


@pytest.mark.parametrize("text", ["a\x1cb", "x² ½", "don't we'll I'M", "  two  spaces \n\n x ", "é ß _ __a 12three", "<|endoftext|> x", "　漢字"])
def test_pieces_give_the_ids_of_the_whole_text(text):
    tool = packing.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert tool.ids(text) == tool.whole(text)


@pytest.mark.parametrize("text", ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>  y", "<|endoftext", "plain text"])
def test_ids_are_those_of_the_untouched_tokenizer(text):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tool = packing.Encoder(path)
    expected = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(tool.ids(text), dtype=tool.kind).tolist() == expected

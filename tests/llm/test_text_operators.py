"""Quality rules, sharding, language, classifier and token counts against plain Python."""

import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftlens.llm import classifier, language, quality_rules, sharding, texts, token_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_row(frame):
    """Rows as a multiset, without regard to order."""
    return Counter(tuple(r) for r in frame.collect())


# --- texts


@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \n\té漢\x0b", max_size=12)), max_size=8))
@settings(max_examples=60, deadline=None)
def test_words_of_slices_are_the_words_of_the_texts(values):
    found = []
    for _, data, offsets in texts.text_slices(pa.array(values, type=pa.string()), limit=7):
        starts, ends = texts.word_spans(data, offsets)
        rows = np.searchsorted(offsets, starts, side="right") - 1
        found += [[data[a:b].tobytes().decode() for a, b in zip(starts[rows == i], ends[rows == i])] for i in range(len(offsets) - 1)]
    assert found == [WORD.findall(v or "") for v in values]


def test_equal_words_hash_alike_and_others_do_not():
    data = np.frombuffer(b"one two one twoo on e", dtype=np.uint8)
    starts, ends = texts.word_spans(data, np.array([0, len(data)]))
    h = texts.word_hashes(data, starts, ends)
    assert h[0] == h[2] and len(set(h.tolist())) == 5


# --- quality rules


def plain_quality(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    counts, covered = Counter(windows), set()
    for i, x in enumerate(windows):
        if counts[x] > 1:
            covered.update(range(i, i + 5))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n_symbols = sum(c in "#*$%&|<>" for c in text)
    return len(w), sum(map(len, w)), n_symbols, len(lines) - len(set(lines)), len(covered)


def test_quality_figures(docs, rows):
    out = quality_rules.cascade(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    expected = []
    for i, text, *_ in rows:
        p = plain_quality(text)
        expected.append((i, *p, p[0] < 10 or 100 * p[4] > 20 * p[0]))
    assert by_row(out) == Counter(expected)


def test_the_order_of_the_rules_never_changes_the_verdict(docs):
    forward = quality_rules.judge(docs, quality_rules.RULES).select("doc_id", "n_words", "kept")
    back = quality_rules.judge(docs, quality_rules.RULES[::-1]).select("doc_id", "n_words", "kept")
    assert by_row(forward) == by_row(back)


def test_cascade_stops_at_the_first_rejection_and_asks_the_best_rule_first(spark):
    estimates = [quality_rules.Estimate("few_words", 10, 1, 1.0), quality_rules.Estimate("repeated_words", 10, 5, 1.0)]
    assert [r.name for r in quality_rules.ordered(quality_rules.BASE_RULES, estimates)] == ["repeated_words", "few_words"]
    frame = spark.createDataFrame([(1, "a b"), (2, " ".join(map(str, range(20))) + " word" * 0)], "doc_id long, text string")
    rows = {r.doc_id: r for r in quality_rules.judge(frame, quality_rules.RULES).collect()}
    assert (rows[1].rejected_by, rows[1].n_asked) == ("few_words", 1)


def test_estimates_cover_every_rule_even_of_nothing(empty):
    found = quality_rules.estimate(empty)
    assert [e.name for e in found] == [r.name for r in quality_rules.RULES] and {e.rows for e in found} == {0}
    assert quality_rules.cascade(empty).count() == 0


# --- sharding


def test_shards_are_gapless_and_sizes_and_checksums_true(docs, rows):
    out = sharding.shard(docs).collect()
    expected = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in out) == expected
    for s in {r.shard for r in out}:
        slots = sorted(r.slot for r in out if r.shard == s)
        assert slots == list(range(len(slots)))
    assert {r.law for r in out} == {"key"}


def test_key_and_shard_count_decide_and_growth_moves_only_into_the_new_shard(spark, empty):
    keys = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    out = sharding.shard(keys).toPandas()
    moved = out[out.shard != out.grown_shard]
    assert set(moved.grown_shard) == {8} and abs(len(moved) / len(out) - 1 / 9) < 0.02
    again = sharding.shard(keys.orderBy(F.desc("doc_id"))).toPandas().set_index("doc_id").shard
    assert (again == out.set_index("doc_id").shard).all()
    assert sharding.shard(empty).count() == 0


def test_shards_get_rows_by_weight(spark):
    keys = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    share = sharding.shard(keys, weights=(1.0, 3.0)).groupBy("shard").count().toPandas().set_index("shard")["count"] / 20_000
    assert abs(share[1] - 0.75) < 0.02
    with pytest.raises(ValueError):
        sharding.rendezvous(F.col("doc_id"), [1.0, 0.0])


# --- language


def plain_grams(text):
    points = [c if c.isalpha() else " " for c in text.lower()]
    words = "".join(points).split()
    out = Counter()
    for w in words:
        out.update(w)
        padded = f" {w} "
        out.update(padded[i : i + 2] for i in range(len(padded) - 1))
        out.update(padded[i : i + 3] for i in range(len(padded) - 2))
    return out


@given(st.text(alphabet="abé ß1.\n漢", max_size=30))
@settings(max_examples=80, deadline=None)
def test_letter_ngrams_are_those_of_padded_words(text):
    values, counts = np.unique(language.grams(text), return_counts=True)
    assert sorted(counts.tolist()) == sorted(plain_grams(text).values())


def test_out_of_place_distance_by_hand():
    profiles = language.Profiles.of({"x": np.array([5, 7, 9], dtype=np.uint64), "y": np.array([9, 5], dtype=np.uint64)}, size=3)
    # own order 9, 5, 11: x has 9 at 2 and 5 at 0, y has 9 at 0 and 5 at 1; 11 is missing in both
    assert profiles.distances(np.array([9, 5, 11], dtype=np.uint64)).tolist() == [2 + 1 + 3, 0 + 0 + 3]


def test_languages_of_awkward_rows(docs, rows, empty):
    learned = language.learn(docs)
    assert learned.languages == sorted({lang for i, t, lang, _ in rows if lang and t is not None and i is not None and zlib.crc32(str(i).encode()) % 4 != 2} | {"en"})
    out = language.predict(docs, learned).collect()
    assert len(out) == len(rows)
    for r in out:
        assert 0 <= r.score <= 1 and r.lang_pred in [*learned.languages, "und"]
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    no_letter = {170, 171, 172, 173, 174}
    assert {r.doc_id for r in out if r.lang_pred == "und" and r.doc_id is not None} == no_letter
    kept = language.keep_known(docs, learned)
    assert kept.columns == docs.columns and kept.count() == len(rows) - len(no_letter) - 1
    nothing = language.learn(empty)
    assert {r.lang_pred for r in language.predict(docs, nothing).collect()} == {"und"}


def test_held_out_accuracy_of_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language.predict(docs, language.learn(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.98


# --- hashes


def opposite_strings(size):
    """Two strings of two letters whose weighted sums agree for every odd base modulo a power of two."""
    bits = [bin(i).count("1") & 1 for i in range(size)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("size", [512, 1024, 2048])
def test_structured_words_do_not_collide(size):
    one, other = opposite_strings(size)
    data = np.frombuffer(f"{one} {other} {one}".encode(), dtype=np.uint8)
    starts, ends = texts.word_spans(data, np.array([0, len(data)]))
    for which in (0, 1):
        h = texts.span_hashes(data, starts, ends, which)
        assert h[0] == h[2] != h[1]


@given(st.lists(st.integers(0, 3), min_size=1, max_size=90), st.integers(1, 40), st.booleans(), st.integers(0, 1))
@settings(max_examples=150, deadline=None)
def test_span_hashes_are_equal_where_spans_are(values, size, as_bytes, which):
    data = np.array(values, dtype=np.uint8 if as_bytes else np.uint64)
    starts = np.arange(max(len(data) - size + 1, 0))
    h = texts.span_hashes(data, starts, starts + size, which)
    spans = [tuple(values[i : i + size]) for i in starts]
    assert len(set(h.tolist())) == len(set(spans)) == len(set(zip(h.tolist(), spans)))
    if len(data) >= size:
        assert (texts.gram_hashes(data, size, which) == h).all()
    shuffled = starts[::-1].copy()
    assert (texts.span_hashes(data, shuffled, shuffled + size, which) == h[::-1]).all()


def test_span_hashes_do_not_depend_on_blocks(monkeypatch):
    data = np.frombuffer(b"abcabdabcabc" * 50, dtype=np.uint8)
    starts = np.arange(500)
    whole = texts.span_hashes(data, starts, starts + 7 + starts % 60)
    grams = texts.gram_hashes(data, 13)
    monkeypatch.setattr(texts, "HASH_BLOCK", 64)
    assert (texts.span_hashes(data, starts, starts + 7 + starts % 60) == whole).all()
    assert (texts.gram_hashes(data, 13) == grams).all()


# --- classifier


def test_scores_of_awkward_rows(docs, rows, empty, spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(7, None), (None, 1)], "doc_id long, quality int")
    model = classifier.fit(docs, labels)
    out = classifier.score(docs, model).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)
    assert {round(r.score, 9) for r in out if r.doc_id in (170, 171, 172, 173)} == {round(model.empty, 9)}
    assert classifier.score(empty, model).count() == 0
    blank = classifier.fit(docs, labels.where("quality = 5"))
    assert {r.score for r in classifier.score(docs, blank).collect()} == {0.5}
    one = classifier.fit(docs, labels.where("quality = 1"))
    assert {r.predicted for r in classifier.score(docs, one).collect()} == {1}


def plain_features(text, bits):
    """Buckets of the features of one text, by hand."""
    def mixed(x):
        return int(texts.mix(np.array([x & (2**64 - 1)], dtype=np.uint64))[0])

    odd, out = int(classifier._ODD), []
    words = WORD.findall(text or "")
    hashes = []
    for word in words:
        data = np.frombuffer(word.encode(), dtype=np.uint8)
        hashes.append(int(texts.word_hashes(data, np.array([0]), np.array([len(data)]))[0]))
        symbols = [classifier.BORDER, *map(ord, word), classifier.BORDER]
        for n in classifier.GRAMS:
            for i in range(len(symbols) - n + 1):
                packed = symbols[i]
                for symbol in symbols[i + 1 : i + n]:
                    packed = packed * odd + symbol
                out.append(mixed((packed & (2**64 - 1)) ^ n))
    out += hashes + [mixed(a * odd + b) for a, b in zip(hashes, hashes[1:])]
    return Counter(x >> (64 - bits) for x in out)


TEXTS = ["one two two", None, "", "é 漢字 \U0001f600x a", " the\nthe  the ", "Ünïcode ½", "x"]


def test_features_and_scores_by_hand():
    model = classifier.train(TEXTS * 3, np.array([1, 0, 1, 0, 1, 0, 1] * 3), bits=9, dim=3, epochs=2)
    column = pa.array(TEXTS, type=pa.large_string())
    found = []
    for _, data, offsets in texts.text_slices(column):
        rows, buckets = classifier.features(data, offsets, 9)
        found += [Counter(buckets[rows == i].tolist()) for i in range(len(offsets) - 1)]
    assert found == [plain_features(t, 9) for t in TEXTS]
    for text, score in zip(TEXTS, model.scores(column)):
        plain = plain_features(text, 9)
        odds = sum(model.gain[b] * n for b, n in plain.items()) / max(sum(plain.values()), 1) + model.bias
        assert score == pytest.approx(1 / (1 + np.exp(-odds)) if plain else model.empty)


def test_gradient_steps_by_hand():
    labels, bits, dim, rate, vector_rate = [1, 0, 1], 6, 2, 0.5, 3.0
    some = ["one two two", "é 漢字", "x"]
    model = classifier.train(some, np.array(labels), bits, dim, 2, rate, vector_rate, seed=5)
    rng = np.random.default_rng(5)
    vectors = rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim)).tolist()
    layer, bias, done = [[0.0, 0.0] for _ in range(dim)], [float(np.log(1 / 3)), float(np.log(2 / 3))], 0
    for _ in range(2):
        for i in rng.permutation(np.arange(3)):
            bag = plain_features(some[i], bits)
            weight = {b: n / sum(bag.values()) for b, n in bag.items()}
            hidden = [sum(w * vectors[b][d] for b, w in weight.items()) for d in range(dim)]
            odds = [sum(hidden[d] * layer[d][c] for d in range(dim)) + bias[c] for c in (0, 1)]
            total = sum(np.exp(o) for o in odds)
            slope = [np.exp(o) / total - (labels[i] == c) for c, o in enumerate(odds)]
            step = rate * (1 - done / 6)
            back = [sum(layer[d][c] * slope[c] for c in (0, 1)) for d in range(dim)]
            for d in range(dim):
                for c in (0, 1):
                    layer[d][c] -= step * hidden[d] * slope[c]
                for b, w in weight.items():
                    vectors[b][d] -= step * vector_rate * w * back[d]
            bias = [bias[c] - 0.1 * step * slope[c] for c in (0, 1)]
            done += 1
    gain = [sum(v[d] * (layer[d][1] - layer[d][0]) for d in range(dim)) for v in vectors]
    assert model.gain == pytest.approx(np.array(gain), abs=1e-6) and model.bias == pytest.approx(bias[1] - bias[0], abs=1e-6)


def test_held_out_accuracy_of_quality(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = classifier.fit(docs, labels)
    out = classifier.score(docs, model).join(labels, "doc_id").where("held_out").toPandas()
    good, bad = out[out.quality == 1].score.to_numpy(), out[out.quality == 0].score.to_numpy()
    assert (out.predicted == out.quality).mean() > 0.95
    assert (good[:, None] > bad[None, :]).mean() > 0.88


def test_training_is_repeatable_and_long_texts_are_not_learned_from(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = classifier.fit(docs, labels)
    assert (classifier.fit(docs, labels).gain == model.gain).all()
    long = docs.withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.repeat(F.lit("w "), 70_000)).otherwise(F.col("text")))
    assert (classifier.fit(long, labels).gain == classifier.fit(docs.where("doc_id % 2 = 1"), labels).gain).all()


# --- token counts


def greedy(word, pieces):
    word, i, n = (*word, token_counts.END), 0, 0
    while i < len(word):
        for j in range(len(word), i, -1):
            if word[i:j] in pieces:
                break
        else:
            return n if word[i:] == (token_counts.END,) else 1
        n, i = n + 1, j
    return n


@given(st.sets(st.text(alphabet="abc", min_size=1, max_size=4), max_size=9), st.sets(st.text(alphabet="abc", min_size=1, max_size=3), max_size=4), st.text(alphabet="abc", min_size=1, max_size=14))
@settings(max_examples=300, deadline=None)
def test_automaton_counts_what_greedy_splitting_builds(inner, last, word):
    pieces = {tuple(p.encode()) for p in inner | {"a", "b"}} | {(*p.encode(), token_counts.END) for p in last}
    assert token_counts.Automaton(pieces).count(word.encode()) == greedy(word.encode(), pieces)


def test_token_counts_of_awkward_rows(docs, rows, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    pieces = set(token_counts.vocabulary(path))
    known = {}

    def count(word):
        return known.setdefault(word, greedy(word, pieces)) if len(word) < 400 else token_counts.load(path).count(word)

    expected = []
    for i, text, *_ in rows:
        words = (text or "").lower().encode().split()
        expected.append((i, len(words), sum(map(count, words))))
    assert by_row(token_counts.token_counts(docs, path)) == Counter(expected)
    assert token_counts.token_counts(empty, path).count() == 0

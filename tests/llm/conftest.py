import random

import pytest

#: columns of the operators' own, as names of unrelated input columns
CLASHING = ["n", "id", "size", "key", "part", "cell", "class", "kept", "score", "target", "copies", "rank", "items", "shard", "slot", "lang_pred"]


def make_words(rng, n):
    parts = ["the", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def make_rows():
    """Small documents with every awkward case: (doc_id, text, lang, source)."""
    rng = random.Random(5)
    body = [" ".join(make_words(rng, rng.randint(20, 160))) for _ in range(40)]
    rows = [(i, t, "en" if i % 3 else "fr", f"src{i % 4}") for i, t in enumerate(body)]
    rows += [(100 + i, body[3], "en", "src0") for i in range(4)]  # exact copies
    near = body[5].split()
    for i in range(4):  # near copies
        w = list(near)
        w[(7 * i + 3) % len(w)] = "changed"
        rows.append((120 + i, " ".join(w), "en", "src1"))
    passage = " ".join(make_words(rng, 120))
    rows += [(140 + i, f"{body[10 + i]}\n{passage}\n{body[20 + i]}", "en", "src2") for i in range(3)]
    rows += [(160, "ab " * 700, "en", "src0"), (161, "x" * 1500, "en", "src3")]  # repeats inside one text
    rows += [(170, None, "en", "src1"), (171, "", "en", None), (172, " \n\t ", None, "src2"), (173, "\x0b\x0c\r", "fr", "é")]
    rows += [(174, "12 34 !!", "en", "src1"), (175, "Ünïcode éèà ñ ß 漢字 \U0001f600 ½ ²   x", "de", "zz"), (176, "one two", "en", "src0")]
    rows += [(177, "ONE  two", "en", "src0"), (178, "one two three", "en", "src0")]
    rows += [(None, body[2], "en", "src0"), (None, None, None, None), (5, body[5], "en", "src1")]  # a repeated row
    rows += [(180, " ".join(make_words(rng, 30_000)), "en", "src0")]  # a very long text
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3).cache()
    return plain.selectExpr("*", *(f"'clash' AS `{c}`" for c in CLASHING))


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")

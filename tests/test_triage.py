import random

import pytest

from driftlens.operators import drift, triage

from scenario import MODES, MODES_AFTER, column, fingerprint, frame


def judged(spark, current, baseline):
    members = drift.recent_members(frame(spark, current), frame(spark, baseline))
    return {r.table_name: r for r in triage.classify(drift.compare(members)).collect()}


def history(table, columns, rows=lambda i: 100 + i):
    return [fingerprint(f"{table}{i}", table, 1 + i, rows(i), columns) for i in range(5)]


def test_classes(spark):
    even = {k: 0.25 for k in "abcd"}
    grown = {"a": 0.15, "b": 0.15, "c": 0.15, "d": 0.15, "e": 0.4}
    skewed = {"a": 0.7, "b": 0.1, "c": 0.1, "d": 0.1}
    plain = [column(0, "v", even)]
    now = {
        "renamed": (100, [column(0, "v", {"a": 0.25, "b": 0.25, "c": 0.25, "x": 0.25})]),
        "gone": (100, [column(0, "v", {"a": 0.5, "b": 0.5})]),
        "grown": (100, [column(0, "v", grown)]),
        "more": (900, plain),
        "fewer": (3, plain),
        "skewed": (100, [column(0, "v", skewed)]),
        "wider": (100, plain + [column(1, "w", {"q": 1.0})]),
        "nulls": (100, [column(0, "v", skewed, null_pct=0.3)]),
        "clean": (100, plain),
        "both": (900, [column(0, "v", {"a": 0.25, "b": 0.25, "c": 0.25, "x": 0.25})]),
    }
    old = [row for t in now for row in history(t, plain)]
    got = judged(spark, [fingerprint(f"{t}-now", t, 20, rows, cols) for t, (rows, cols) in now.items()], old)
    assert {t: r.classification for t, r in got.items()} == {
        "renamed": "SILENT_SEMANTIC_FAILURE",
        "gone": "UPSTREAM_DATA_QUALITY",
        "grown": "BENIGN_GROWTH",
        "more": "BENIGN_GROWTH",
        "fewer": "UPSTREAM_DATA_QUALITY",
        "skewed": "NORMAL_SEASONAL",
        "wider": "UPSTREAM_DATA_QUALITY",
        "nulls": "UPSTREAM_DATA_QUALITY",
        "clean": None,
        "both": "NORMAL_SEASONAL",
    }
    assert {t: r.next_step for t, r in got.items() if t in ("renamed", "gone", "clean")} == {
        "renamed": "pending_approval",
        "gone": "no_action_needed",
        "clean": "clean",
    }
    assert got["nulls"].affected_columns == ["v"] and got["nulls"].null_flag
    assert not got["clean"].others_clean


def test_rename_with_a_clean_fact_table(spark):
    old = history("depot", [column(0, "mode", MODES)], lambda i: 7) + history("parcel", [column(0, "zone", MODES)])
    now = [
        fingerprint("s", "depot", 20, 7, [column(0, "mode", MODES_AFTER)]),
        fingerprint("d", "parcel", 20, 100, [column(0, "zone", MODES)]),
    ]
    got = judged(spark, now, old)
    assert got["depot"].classification == "SILENT_SEMANTIC_FAILURE" and got["depot"].others_clean
    assert got["parcel"].next_step == "clean"


@pytest.mark.parametrize("share, found", [(0.2, [("c", "x")]), (0.215, [])])
def test_rename_pairs_need_equal_shares(spark, share, found):
    old = history("t", [column(0, "v", {"a": 0.5, "b": 0.3, "c": 0.2})])
    now = [fingerprint("n", "t", 20, 100, [column(0, "v", {"a": 0.5, "b": 0.5 - share, "x": share})])]
    reports = drift.compare(drift.recent_members(frame(spark, now), frame(spark, old)))
    assert [(r.old_value, r.new_value) for r in triage.rename_pairs(reports).collect()] == found


def test_two_renames_are_matched_by_share(spark):
    old = history("t", [column(0, "v", {"a": 0.5, "b": 0.3, "c": 0.2})])
    now = [fingerprint("n", "t", 20, 100, [column(0, "v", {"a": 0.5, "y": 0.3, "x": 0.2})])]
    reports = drift.compare(drift.recent_members(frame(spark, now), frame(spark, old)))
    assert {(r.old_value, r.new_value) for r in triage.rename_pairs(reports).collect()} == {("b", "y"), ("c", "x")}


def test_an_unrelated_value_that_vanishes_hides_no_rename(spark):
    old = history("t", [column(0, "v", {"c": 0.5, "a": 0.3, "b": 0.2})])
    now = [fingerprint("n", "t", 20, 100, [column(0, "v", {"c": 0.8, "x": 0.2})])]
    reports = drift.compare(drift.recent_members(frame(spark, now), frame(spark, old)))
    assert [(r.old_value, r.new_value) for r in triage.rename_pairs(reports).collect()] == [("b", "x")]
    assert triage.classify(reports).first().classification == "SILENT_SEMANTIC_FAILURE"


def closest(old, new, tolerance):
    """Pairs by share, the closest first, each value once."""
    near = sorted((round(abs(a - b), 9), o, n) for o, a in old.items() for n, b in new.items() if round(abs(a - b), 9) <= tolerance)
    found = []
    for _, o, n in near:
        if all(o != x and n != y for x, y in found):
            found.append((o, n))
    return set(found)


def test_rename_pairs_of_random_distributions(spark):
    rng = random.Random(12)
    olds, news, expected = [], [], {}
    for i in range(40):
        vanished = {f"o{j}": rng.choice([0.02, 0.03, 0.035, 0.04, 0.08]) for j in range(rng.randint(0, 5))}
        appeared = {f"n{j}": rng.choice([0.02, 0.028, 0.04, 0.055, 0.08]) for j in range(rng.randint(0, 5))}
        olds += history(f"t{i}", [column(0, "v", {"stays": 0.5, **vanished})])
        news.append(fingerprint(f"now{i}", f"t{i}", 20, 100, [column(0, "v", {"stays": 0.5, **appeared})]))
        expected[f"t{i}"] = closest(vanished, appeared, 0.01)
    reports = drift.compare(drift.recent_members(frame(spark, news), frame(spark, olds)))
    got = {t: set() for t in expected}
    for r in triage.rename_pairs(reports).collect():
        got[r.table_name].add((r.old_value, r.new_value))
    assert got == expected

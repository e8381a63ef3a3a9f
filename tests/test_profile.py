import math
import random
import warnings

import pytest
from pyspark.sql import functions as F

from driftlens.operators import profile, selection
from driftlens.operators.quantiles import exact_quantiles
from driftlens.sources.tables import catalog

def whole(df, **options):
    now = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    row = profile.fingerprints(df, "d", "t", now, per_sync=False, **options).first()
    return row, {c.name: c for c in row.columns}


@pytest.mark.parametrize("top", ["exact", "approx"])
def test_one_profile(spark, top):
    rows = [(i, "a" if i < 6 else "b" if i < 9 else None, i % 2 == 0, float(i)) for i in range(10)]
    df = spark.createDataFrame(rows, "id long, label string, flag boolean, amount double")
    row, columns = whole(df, top=top)
    assert row.row_count == 10
    assert list(columns) == ["label", "flag", "amount"]  # categorical first, id left out
    label = columns["label"]
    assert label.distribution == {"a": 0.6, "b": 0.3, "__null__": 0.1}
    assert label.null_pct == 0.1 and label.distinct_count == 2
    assert [v.value for v in label.top_values] == ["a", "b", "__null__"]
    assert columns["flag"].distribution == {"True": 0.5, "False": 0.5}
    amount = columns["amount"]
    assert (amount.min_val, amount.max_val, amount.mean) == (0.0, 9.0, 4.5)
    assert amount.stddev == pytest.approx(math.sqrt(sum((i - 4.5) ** 2 for i in range(10)) / 9))
    assert (amount.p1, amount.p50, amount.p99) == (0.0, 4.0, 9.0)
    assert amount.distribution == {} and amount.entropy is None


def test_entropy(spark):
    df = spark.createDataFrame([(f"v{i}", "same") for i in range(7)], "even string, single string")
    _, columns = whole(df)
    assert columns["even"].entropy == pytest.approx(math.log2(7), abs=1e-6)
    assert columns["single"].entropy == 0.0


def test_entropy_renormalises_the_kept_values(spark):
    """Of thirty equal values twenty are kept; their shares count as the whole."""
    _, columns = whole(spark.createDataFrame([(f"v{i:02d}",) for i in range(30)], "v string"))
    assert len(columns["v"].distribution) == 20
    assert columns["v"].entropy == pytest.approx(math.log2(20), abs=1e-6)


@pytest.mark.parametrize("kept, cut", [(20, round(10 / 30, 6)), (30, 0.0), (3, 0.9)])
def test_a_cut_distribution_shows_its_tail(spark, kept, cut):
    rows = spark.createDataFrame([(f"v{i:02d}", 1.0) for i in range(30)], "v string, x double")
    fps = profile.fingerprints(rows, "d", "t", F.lit("2027-03-01").cast("timestamp_ntz"), per_sync=False, kept_values=kept)
    (row,) = profile.cut_shares(fps).collect()
    assert (row.column_name, row.cut_share) == ("v", pytest.approx(cut, abs=1e-6))


def test_headers_have_counts_and_no_columns(spark):
    load = profile.Load(spark.createDataFrame([("a", 1.0), ("b", 2.0)], "v string, x double"), "d", "t", F.lit("2027-03-01").cast("timestamp_ntz"), per_sync=False)
    row = profile.fingerprint_loads([profile.header_only(load)]).first()
    assert row.row_count == 2 and row.columns == [] and row.schema_hash == profile.schema_hash(load.df.schema)
    only = profile.fingerprint_loads([profile.only_kind(load, "numeric")], top="none").first()
    assert [c.name for c in only.columns] == ["x"]


def test_empty_table(spark):
    df = spark.createDataFrame([], "label string, amount double")
    row, columns = whole(df)
    assert row.row_count == 0
    assert columns["label"].null_pct == 0.0 and columns["label"].entropy == 0.0 and columns["label"].distribution == {}
    assert columns["amount"].mean is None and columns["amount"].stddev is None


def test_single_row_has_no_stddev(spark):
    _, columns = whole(spark.createDataFrame([(1.0,)], "amount double"))
    assert columns["amount"].stddev is None and columns["amount"].mean == 1.0


def test_top_twenty_breaks_ties_by_value(spark):
    df = spark.createDataFrame([(f"v{i:02d}",) for i in range(30)] + [("v29",)], "label string")
    _, columns = whole(df)
    assert [v.value for v in columns["label"].top_values] == ["v29"] + [f"v{i:02d}" for i in range(19)]
    assert sum(columns["label"].distribution.values()) == pytest.approx(21 / 31)


def test_soft_deleted_rows_are_left_out_and_unknown_ones_kept(spark):
    df = spark.createDataFrame([("a", True), ("b", False), ("c", None)], "label string, _fivetran_deleted boolean")
    row, columns = whole(df)
    assert row.row_count == 2 and set(columns["label"].distribution) == {"b", "c"}


def test_one_profile_per_sync(spark):
    df = spark.createDataFrame([("d1", "a"), ("d1", "b"), ("d2", "a"), (None, "z")], "day string, label string")
    rows = profile.fingerprints(df, "d", "t", F.col("day"), profile_columns=["label"]).collect()
    assert {r.computed_at: r.row_count for r in rows} == {"d1": 2, "d2": 1, None: 1}
    assert {r.computed_at: r.columns[0].distribution for r in rows}["d2"] == {"a": 1.0}
    assert len({r.fingerprint_id for r in rows}) == 3
    again = profile.fingerprints(df, "d", "t", F.col("day"), profile_columns=["label"]).collect()
    assert {r.fingerprint_id for r in rows} == {r.fingerprint_id for r in again}


def test_odd_column_names(spark):
    df = spark.createDataFrame([("x", 1.0)], "`a.b-c` string, `it's` double")
    _, columns = whole(df)
    assert columns["a.b-c"].distribution == {"x": 1.0} and columns["it's"].mean == 1.0


def test_watched_columns(spark):
    df = spark.createDataFrame([("x", 1.0)], "label string, amount double")
    with pytest.raises(ValueError, match="missing: \\['gone'\\]"):
        whole(df, profile_columns=["gone"])
    with pytest.warns(UserWarning, match="gone"):
        _, columns = whole(df, profile_columns=["gone", "label"])
    assert list(columns) == ["label"]
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        whole(df, profile_columns=["amount"])
    with pytest.raises(ValueError, match="no column"):
        whole(spark.createDataFrame([(1,)], "id long"))


def test_column_selection_over_the_catalog(spark):
    df = spark.createDataFrame(
        [], "id long, label string, price decimal(18,2), at timestamp, tags array<string>, _fivetran_synced string, ok boolean"
    )
    rows = catalog(spark, {"t": df, "u": df}, "d")
    kept = {(r.table_name, r.column_name): r.kind for r in selection.profilable_columns(rows).collect()}
    assert kept[("t", "label")] == "categorical" and kept[("t", "price")] == "numeric"
    assert {c for t, c in kept if t == "t"} == {"label", "price", "ok"}
    watched = spark.createDataFrame(
        [("d", "t", ["label", "nope"]), ("d", "u", ["nope"])], "dataset_id string, table_name string, profile_columns array<string>"
    )
    assert [(r.table_name, r.column_name) for r in selection.profilable_columns(rows, watched).collect()] == [("t", "label")]
    missing = {(r.table_name, r.column_name, r.status) for r in selection.missing_columns(rows, watched).collect()}
    assert missing == {("t", "nope", "warning"), ("u", "nope", "error")}


def test_schema_hash_sees_names_and_types_but_not_order(spark):
    def digest(ddl):
        return whole(spark.createDataFrame([], ddl))[0].schema_hash

    assert digest("a string, b double") == digest("b double, a string")
    assert digest("a string, b double") != digest("a string, b float")
    assert len(digest("a string")) == 16


def test_relabel(spark):
    df = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "label string")
    changed = selection.relabel(df, "label", "a", "z")
    assert sorted(str(r[0]) for r in changed.collect()) == ["None", "b", "z", "z"]
    assert selection.affected_rows(df, "label", "a").first()[0] == 2
    assert sorted(str(r[0]) for r in selection.relabel(changed, "label", "z", "a").collect()) == ["None", "a", "a", "b"]
    mapping = spark.createDataFrame([("a", "x"), ("b", "y")], "old_value string, new_value string")
    many = selection.relabel_all(df, "label", mapping)
    assert many.columns == ["label"] and sorted(str(r[0]) for r in many.collect()) == ["None", "x", "x", "y"]


@pytest.mark.parametrize("accuracy", [4, 10_000])
def test_exact_quantiles_whatever_the_sketch(spark, accuracy):
    """A coarse sketch only makes brackets wider; a value that fills a third of the rows changes nothing."""
    rng = random.Random(1)
    rows = [(k, float(rng.choice([7] + [rng.randint(0, 500)] * 2))) for k in ("a", None) for _ in range(700)]
    rows += [("one", 3.5), ("a", None)]
    got = {
        (r.k, r.percent): r.quantile
        for r in exact_quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], ["v"], accuracy=accuracy).collect()
    }
    for key in ("a", None, "one"):
        values = sorted(v for k, v in rows if k == key and v is not None)
        for p in (1, 25, 50, 75, 99):
            assert got[(key, p)] == values[max(1, math.ceil(len(values) * p / 100)) - 1]
    assert len(got) == 15

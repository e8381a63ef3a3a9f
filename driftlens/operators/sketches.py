"""Profiles that add up: per (sync, column) a state of bounded size, from which the profile of any longer span follows.

A state holds exact counters, moments and extremes, and three sketches: distinct values, quantiles and frequent values.
States are stored like fingerprints and combined by grouping; the profile of a week, or of all tables of a connection,
never reads a table again. What the sketches may be wrong by is part of the result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as K
from ..functions import live_rows, value_key
from .profile import Load
from .selection import CATEGORICAL, NUMERIC, ProfiledColumn, profiled_columns

DISTINCT_BITS = 12
QUANTILE_K = 200
TRACKED_VALUES = 10_000
# The sketches' published error figures. A distinct count's relative standard error is this constant over
# the root of its registers; a quantile's rank is off by at most 1.65 % (99 % of the time, for the default size); a
# frequent value's count is off by at most 3.5 times the rows over the values tracked.
DISTINCT_ERROR = 1.04
RANK_ERROR = 0.0165
COUNT_ERROR = 3.5

STATE_KEY = ["dataset_id", "table_name", "computed_at", "position", "name", "data_type", "kind"]
MERGED = ["rows", "filled", "moments", "min_val", "max_val", "distinct_state", "quantile_state", "top_state"]


def _moments(x: Column) -> Column:
    return F.struct(F.count(x).alias("n"), F.avg(x).alias("mean"), (F.var_pop(x) * F.count(x)).alias("m2"))


def _column_state(column: ProfiledColumn, tracked_values: int) -> Column:
    """All states of one column, as one struct."""
    c = F.col("`" + column.name.replace("`", "``") + "`")
    categorical = column.kind == CATEGORICAL
    x = F.lit(None).cast("double") if categorical else c.cast("double")
    # states without values can be combined too, null ones cannot
    label = value_key(c, column.data_type) if categorical else F.lit(None).cast("string")
    whole = isinstance(column.data_type, T.IntegralType)
    return F.struct(
        F.lit(column.position).alias("position"),
        F.lit(column.name).alias("name"),
        F.lit(column.data_type.simpleString()).alias("data_type"),
        F.lit(column.kind).alias("kind"),
        F.count(F.lit(1)).alias("rows"),
        F.count(c).alias("filled"),
        _moments(x).alias("moments"),
        F.min(x).alias("min_val"),
        F.max(x).alias("max_val"),
        F.hll_sketch_agg(c.cast("bigint") if whole else c.cast("string"), F.lit(DISTINCT_BITS)).alias("distinct_state"),
        F.kll_sketch_agg_double(x, F.lit(QUANTILE_K)).alias("quantile_state"),
        F.call_function("approx_top_k_accumulate", label, F.lit(tracked_values)).alias("top_state"),
    )


def states(load: Load, tracked_values: int = TRACKED_VALUES) -> DataFrame:
    """One state per sync and column of a table, from one scan with map-side combining.

    A column that is null throughout has empty sketches; a sync without rows has no states. Soft-deleted rows are left
    out as in a fingerprint.
    """
    df, columns = load.df, profiled_columns(load.df.schema, load.profile_columns)
    if K.DELETED_FLAG in df.columns:
        df = df.where(live_rows(F.col(K.DELETED_FLAG)))
    every = F.array(*[_column_state(c, tracked_values) for c in columns])
    if load.per_sync:
        wide = df.groupBy(load.computed_at.alias("computed_at")).agg(every.alias("states"))
    else:
        wide = df.agg(every.alias("states"), F.count(F.lit(1)).alias("any")).where("any > 0").withColumn("computed_at", load.computed_at)
    return wide.select(
        F.lit(load.dataset_id).alias("dataset_id"), F.lit(load.table_name).alias("table_name"), "computed_at", F.inline("states")
    ).withColumn("state_id", state_id())


def state_id() -> Column:
    """Depends only on table, sync and column, so that a repeat stores nothing."""
    return F.left(F.sha2(F.concat_ws("|", "dataset_id", "table_name", F.col("computed_at").cast("string"), "name"), 256), F.lit(32))


# Two groups of rows with means a and b differ in their joint sum of squares by (a - b)^2 n m / (n + m).
_JOINED = """
aggregate(gathered, named_struct('n', 0L, 'mean', cast(null as double), 'm2', 0D), (a, b) ->
  case when b.n = 0 or b.mean is null then a when a.n = 0 then b else named_struct('n', a.n + b.n,
    'mean', a.mean + (b.mean - a.mean) * b.n / (a.n + b.n),
    'm2', a.m2 + b.m2 + (b.mean - a.mean) * (b.mean - a.mean) * a.n * b.n / (a.n + b.n)) end)
"""


def merged(parts: DataFrame, keys: list[str], tracked_values: int = TRACKED_VALUES) -> DataFrame:
    """States of larger spans: one per group of ``keys``, which hold the column's name and kind.

    Sketches are combined on the map side; of the moments, three numbers per state meet in one group, ordered so that
    reruns agree. Type and position are the newest state's.
    """
    ordered = F.array_sort(F.collect_list(F.struct("computed_at", "dataset_id", "table_name", "moments")))
    out = parts.groupBy(*keys).agg(
        *[F.max_by(c, F.struct("computed_at", "dataset_id", "table_name", c)).alias(c) for c in ("position", "data_type") if c not in keys],
        F.sum("rows").alias("rows"),
        F.sum("filled").alias("filled"),
        F.transform(ordered, lambda s: s["moments"]).alias("gathered"),
        F.min("min_val").alias("min_val"),
        F.max("max_val").alias("max_val"),
        F.hll_union_agg("distinct_state").alias("distinct_state"),
        F.kll_merge_agg_double("quantile_state").alias("quantile_state"),
        F.call_function("approx_top_k_combine", "top_state", F.lit(tracked_values)).alias("top_state"),
    )
    return out.withColumn("moments", F.expr(_JOINED)).drop("gathered")


def estimates(found: DataFrame, kept_values: int = K.TOP_VALUES, tracked_values: int = TRACKED_VALUES) -> DataFrame:
    """The profile of each state, with the bounds of its estimates.

    Counters, extremes, mean and deviation are exact. ``distinct_bound`` is four standard errors of the distinct count,
    ``rank_bound`` a share of the filled rows, ``count_bound`` a number of rows; while a column has fewer values than
    three quarters of what the sketch tracks, the top values are exact and ties go to the smaller value; beyond, only
    values that are frequent for certain are listed.
    """
    tracked = F.call_function("approx_top_k_estimate", "top_state", F.lit(tracked_values))
    top = F.transform(tracked, lambda e: F.struct(e["item"].alias("value"), e["count"].alias("cnt")))
    by_count = F.slice(
        F.array_sort(F.transform(top, lambda e: F.struct((-e["cnt"]).alias("least"), e["value"].alias("value")))), 1, kept_values
    )
    ranks = F.array(*[F.lit(p / 100) for p in K.QUANTILE_PERCENTS])
    numeric = (F.col("kind") == NUMERIC) & (F.col("moments.n") > 0)
    distinct = F.hll_sketch_estimate("distinct_state")
    return found.select(
        *[c for c in found.columns if c not in MERGED],
        F.col("rows").alias("row_count"),
        F.col("filled").alias("filled_count"),
        F.round(1 - F.col("filled") / F.col("rows"), 6).alias("null_pct"),
        "min_val",
        "max_val",
        F.col("moments.mean").alias("mean"),
        F.when(F.col("moments.n") > 1, F.sqrt(F.col("moments.m2") / (F.col("moments.n") - 1))).alias("stddev"),
        distinct.alias("distinct_count"),
        F.ceil(distinct * (4 * DISTINCT_ERROR / math.sqrt(1 << DISTINCT_BITS))).alias("distinct_bound"),
        F.when(numeric, F.kll_sketch_get_quantile_double("quantile_state", ranks)).alias("quantiles"),
        F.lit(RANK_ERROR).alias("rank_bound"),
        F.when(
            F.col("kind") == CATEGORICAL,
            F.transform(by_count, lambda e: F.struct(e["value"].alias("value"), (-e["least"]).alias("cnt"))),
        ).alias("top_values"),
        F.when(F.col("kind") == CATEGORICAL, F.ceil(F.col("rows") * (COUNT_ERROR / tracked_values))).alias("count_bound"),
    )

"""Column expressions shared by the operators. All of them are Spark built-ins and stay on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import constants as K


def floored(share: Column, floor: float = K.PSI_FLOOR) -> Column:
    """A share as the stability index sees it: absent counts as 0, and nothing is below the floor."""
    return F.greatest(F.coalesce(share, F.lit(0.0)), F.lit(floor))


def psi_term(current: Column, baseline: Column, floor: float = K.PSI_FLOOR) -> Column:
    """One value's contribution to the population stability index."""
    a, e = floored(current, floor), floored(baseline, floor)
    return (a - e) * F.log(a / e)


def psi_of_shares(shares: Column, floor: float = K.PSI_FLOOR) -> Column:
    """Stability index of an array of structs with the fields ``current`` and ``baseline``."""
    total = F.aggregate(
        shares, F.lit(0.0), lambda acc, s: acc + psi_term(s["current"], s["baseline"], floor)
    )
    return F.round(total, 6)


def psi_band(score: Column) -> Column:
    return (
        F.when(score < K.PSI_STABLE, "stable").when(score <= K.PSI_WATCH, "watch").otherwise("anomalous")
    )


def value_key(column: Column, data_type: T.DataType) -> Column:
    """A categorical value as a distribution key: booleans as True/False, null under its own key."""
    text = column.cast("string")
    if isinstance(data_type, T.BooleanType):
        text = F.initcap(text)
    return F.coalesce(text, F.lit(K.NULL_KEY))


def severity(hop: Column) -> Column:
    return F.when(hop == 1, "critical").when(hop == 2, "high").when(hop == 3, "medium").otherwise("low")


def score_multiple(score: Column, threshold: float = K.PSI_WATCH) -> Column:
    """How many times over its threshold a score is, to one decimal."""
    return F.round(score / F.lit(threshold), 1)


def not_blank(column: Column) -> Column:
    """The text, or null where it is empty."""
    return F.nullif(column, F.lit(""))


def live_rows(flag: Column) -> Column:
    """Soft-delete filter of the profiles: rows with an unknown flag are kept."""
    return flag.isNull() | ~flag


def strictly_live_rows(flag: Column) -> Column:
    """Soft-delete filter of the KPI queries: rows with an unknown flag are dropped (three-valued NOT)."""
    return ~flag


def days_between(later: Column, earlier: Column) -> Column:
    """Exact days between two timestamps (of the same kind) as a double."""
    return seconds_between(later, earlier) / F.lit(86400.0)


def seconds_between(later: Column, earlier: Column) -> Column:
    """Exact seconds between two timestamps as a double. Works for both timestamp types."""
    return F.timestamp_diff("MICROSECOND", earlier, later) / F.lit(1e6)

"""Mixing sources to target weights by entropy balancing.

Every document gets a rate, the number of copies it is worth. Of all rates that give each source (or each value of
further constrained columns) its target number of tokens and stay under a limit, the ones wanted are closest to 1 in
relative entropy over documents. The solution tilts exponentially by tokens: ``min(limit, exp(l * size))`` with one
multiplier ``l`` for each constrained value (the sum of a document's, where several columns are constrained). The dual is
convex and is solved by Newton steps guarded by a bracket. Each step is one grouped sum over cells, the distinct
combinations of constrained values and sizes with their documents, so a hot source is summed map-side like any other.
Rates are then rounded to whole copies, the tokens that rounding leaves over or short being carried from longer to
all shorter documents.

Defined results: a null text has size 0 and is never taken; sources of equal name are one source, the null source is
one of its own and comes last; repeated rows are documents of their own; an empty table gives an empty result; only
the id, the text and the source are read, so other columns cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from driftlens.llm.texts import WORD
from driftlens.llm.workers import ship
from driftlens.operators.ordered import running_totals
from driftlens.staging import stage

MAX_COPIES = 3
PART_COPIES = 1_000
STEPS = 40
TOLERANCE = 1e-9


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = (1.0, 2.0, 3.0), limit: float = MAX_COPIES) -> DataFrame:
    """source, source_size, n_docs, target: shares of all tokens by weight, none above ``limit`` times its source.

    ``weights`` repeat over the sources in code-point order, null last. A source that would exceed its limit stops
    there and the rest is shared again by weight, until none exceeds it. The level that the others share is one
    number; each round finds it by one sum over the sources.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    # ranks by range partitions, so that millions of sources are no single task's work
    ranked = running_totals(by_source.withColumn("is_null", F.col("source").isNull()), ["is_null", "source"], {"place": F.lit(1)})
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weight = F.element_at(cycle, ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    sources = stage(ranked.withColumn("weight", weight), "mix-sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, most = 0.0, F.col("source_size") * float(limit)
    while True:
        free = F.col("weight") * level < most
        row = sources.agg(
            F.sum(F.when(free, F.col("weight"))).alias("weight"), F.sum(F.when(~free, most)).alias("stopped")
        ).first()
        if not row.weight:
            break
        raised = (total - (row.stopped or 0.0)) / row.weight
        if raised <= level:
            break
        level = raised
    return sources.select("source", "source_size", "n_docs", F.least(F.col("weight") * level, most).alias("target"))


def tilts(
    cells: DataFrame,
    wanted: dict[str, DataFrame],
    limit: float = MAX_COPIES,
    steps: int = STEPS,
    tolerance: float = TOLERANCE,
) -> dict[str, DataFrame]:
    """The multipliers of each constrained column: {column: (value, target, tilt)}.

    ``cells`` has the constrained columns, ``size`` and ``n``, the documents of that size; ``wanted[column]`` has (value,
    target). The dual's slope at a value is ``sum(n * size * rate) - target`` and its curvature
    ``sum(n * size^2 * rate)`` over cells under the limit, so values of one column are independent and one Newton step
    treats them all; several columns take turns. The slope rises with the multiplier: a step that would leave the
    bracket is replaced by the bracket's middle. Only the number of open values comes to the driver.
    """
    top = F.log(F.lit(float(limit)))
    state = {
        name: stage(
            rows.select("value", "target", F.lit(0.0).alias("tilt"), F.lit(-64.0).alias("low"), F.lit(2 * math.log(limit)).alias("high")),
            "mix-state",
        )
        for name, rows in wanted.items()
    }
    for _ in range(steps):
        still_open = 0
        for name in wanted:
            joined, exponent = cells, F.lit(0.0)
            for other, rows in state.items():
                side = rows.select(F.col("value").alias(f"v_{other}"), F.col("tilt").alias(f"t_{other}"))
                joined = joined.join(side, F.col(other).eqNullSafe(F.col(f"v_{other}")))
                exponent = exponent + F.col(f"t_{other}") * F.col("size")
            got = F.col("n") * F.col("size") * F.exp(F.least(exponent, top))
            sums = joined.groupBy(f"v_{name}").agg(
                F.sum(got).alias("got"), F.sum(F.when(exponent < top, got * F.col("size")).otherwise(0.0)).alias("slope")
            )
            gap = F.coalesce(F.col("got"), F.lit(0.0)) - F.col("target")
            is_open = F.abs(gap) > F.col("target") * tolerance
            low = F.when(gap < 0, F.col("tilt")).otherwise(F.col("low"))
            high = F.when(gap > 0, F.col("tilt")).otherwise(F.col("high"))
            jump = F.col("tilt") - F.try_divide(gap, F.col("slope"))
            # with one column the bracket is final; with several the others move it, so it is opened again
            if len(wanted) > 1:
                low, high = F.lit(-64.0), F.lit(2 * math.log(limit))
            moved = state[name].join(sums, F.col("value").eqNullSafe(F.col(f"v_{name}")), "left").select(
                "value", "target", low.alias("low"), high.alias("high"), is_open.alias("open"),
                F.when(~is_open, F.col("tilt")).when((jump > low) & (jump < high), jump).otherwise((low + high) / 2).alias("tilt"),
            )
            seen = Observation()
            state[name] = stage(moved.observe(seen, F.count_if("open").alias("open")), "mix-state")
            still_open += seen.get["open"]
        if not still_open:
            break
    return {name: rows.select("value", "target", "tilt") for name, rows in state.items()}


def rounded(classes: pd.DataFrame, limit: int) -> pd.DataFrame:
    """Whole copies of each size class of one source from the rates, longest first.

    What the whole copies of a class leave over of the tokens it was due, or take too many of, is carried to all shorter
    classes in proportion to the tokens they are due themselves. A class keeps what is left reachable by the shorter
    ones at 0 to ``limit`` copies wherever it can.
    """
    classes = classes.sort_values("size", ascending=False, kind="stable")
    sizes, numbers = classes["size"].tolist(), classes["n"].tolist()
    asked = (classes["n"] * classes["size"] * classes["rate"]).tolist()
    due = rest = math.fsum(asked)
    tokens, copies = sum(s * n for s, n in zip(sizes, numbers)), []
    for size, n, own in zip(sizes, numbers, asked):
        share = own * due / rest / size if rest > 0 else 0.0
        tokens -= size * n
        rest -= own
        most, least = due / size, (due - limit * tokens) / size
        low, high = math.ceil(least - 1e-9), math.floor(most + 1e-9)
        if low <= high:
            taken = min(max(math.floor(share + 0.5), low), high)
        else:  # no count leaves a reachable rest: the nearer side
            taken = high + 1 if high + 1 - most < least - high else high
        taken = min(max(taken, 0), limit * n)
        due -= taken * size
        copies.append(taken)
    return classes.assign(copies=copies)


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (1.0, 2.0, 3.0),
    limit: int = MAX_COPIES,
    id_col: str = "doc_id",
    text: str = "text",
    source: str = "source",
    chunk_rows: int | None = None,
) -> DataFrame:
    """id, source, size, source_size, target, rate, copies, taken; one row per document.

    A source misses its target by at most half of its shortest document, unless the documents shorter than one that was
    rounded cannot make up for it within 0 to ``limit`` copies. One task sees the distinct sizes of a source, whose
    number is at most the square root of twice the source's tokens. The copies of a class are dealt by place in the
    order of a hash of id and text; places are counted over even range chunks, so neither a hot source nor a hot size is
    one task's work. Chunks (of about ``chunk_rows`` rows, else the session's shuffle partitions) never change the result.
    """
    ship(docs.sparkSession)
    sizes = stage(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source).cast("string").alias("source"),
            word_count(F.col(text)).alias("size"),
            F.xxhash64(F.col(id_col).cast("string"), F.col(text)).alias("tie"),
            F.monotonically_increasing_id().alias("row"),  # spreads equal rows; written once, so it stays
        ),
        "mix-sizes",
    )
    wanted = stage(targets(sizes, weights, limit), "mix-targets")
    cells = stage(sizes.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-cells")
    asked = wanted.where("source_size > 0").select(F.col("source").alias("value"), "target")
    solved = tilts(cells.where("size > 0"), {"source": asked}, limit)["source"]
    parts = wanted.join(solved.select("value", "tilt"), F.col("source").eqNullSafe(F.col("value")), "left").select(
        F.col("source").alias("s"), "target", "source_size", "tilt"
    )
    rate = F.when(F.col("size") > 0, F.least(F.exp(F.col("tilt") * F.col("size")), F.lit(float(limit)))).otherwise(0.0)
    classes = cells.join(parts, F.col("source").eqNullSafe(F.col("s"))).select(
        F.col("source").alias("c_source"), "size", "n", "target", "source_size", rate.alias("rate")
    )
    schema = "c_source string, size long, n long, target double, source_size long, rate double, copies long"

    def dealt(group: pd.DataFrame) -> pd.DataFrame:
        some = group["size"] > 0
        full = [rounded(group[some], limit)] if some.any() else []
        return pd.concat([*full, group[~some].assign(copies=0)])

    deals = stage(
        classes.groupBy("c_source").applyInPandas(dealt, schema).withColumnsRenamed({"size": "c_size", "copies": "all_copies"}),
        "mix-deals",
    )
    chunks = max(1, -(-sizes.count() // chunk_rows)) if chunk_rows else None
    placed = running_totals(sizes, ["tie", "row"], {"place": F.lit(1)}, ["source", "size"], chunks)
    joined = placed.join(deals, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("size") == F.col("c_size")))
    extra = F.when(F.col("place") <= F.col("all_copies") % F.col("n"), 1).otherwise(0)
    return joined.withColumn("copies", (F.expr("all_copies div n") + extra).cast("int")).select(
        F.col("id").alias(id_col), "source", "size", "source_size", "target", "rate", "copies",
        (F.col("copies") * F.col("size")).cast("long").alias("taken"),
    )


def repeat_rows(docs: DataFrame, weights: Sequence[float] = (1.0, 2.0, 3.0), limit: int = MAX_COPIES, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """All columns of the rows, each as often as the mix takes it.

    Rows are matched by 128 bits of hash over all columns. Rows that are equal in all of them get the sum of their
    copies: they are brought to one row map-side, and its copies are laid out in parts of ``PART_COPIES``.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    # types that cannot be hashed are hashed as text
    odd = [any(t in f.dataType.simpleString() for t in ("map<", "variant")) for f in docs.schema]
    hashed = [F.to_json(F.struct(c)) if o else c for c, o in zip(columns, odd)]
    keyed = docs.withColumn("_m_key", F.struct(F.xxhash64(*hashed).alias("a"), F.xxhash64(F.lit(1), *hashed).alias("b")))
    own = keyed.select("_m_key", F.col(text).alias("text"), F.col(source).alias("source"))
    taken = mix(own, weights, limit, "_m_key", "text", "source")
    copies = stage(
        taken.groupBy(F.col("_m_key").alias("_m_k"))
        .agg(F.count("*").alias("_m_rows"), F.sum("copies").alias("_m_copies"))
        .where("_m_copies > 0"),
        "mix-copies",
    )
    key = F.col("_m_key") == F.col("_m_k")
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("_m_copies")))
    out = keyed.join(copies.where("_m_rows = 1"), key).withColumn("_m_copy", each).select(*columns)
    several = copies.where("_m_rows > 1")
    if not several.limit(1).count():
        return out
    one = (
        keyed.select("_m_key", F.struct(*columns).alias("_m_row"))
        .join(several, key)
        .groupBy("_m_key")
        .agg(F.first("_m_row").alias("_m_row"), F.first("_m_copies").alias("_m_all"))
    )
    parts = one.withColumn("_m_part", F.explode(F.expr(f"sequence(0L, (_m_all - 1) div {PART_COPIES})")))
    laid = (
        parts.withColumn("_m_copies", F.least(F.lit(PART_COPIES).cast("long"), F.col("_m_all") - F.col("_m_part") * PART_COPIES))
        .repartition("_m_key", "_m_part")
        .withColumn("_m_copy", each)
    )
    return out.unionByName(laid.select(*[F.col(f"_m_row.`{c}`") for c in docs.columns]))

"""Fingerprint history: an append-only parquet table, partitioned by date."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import constants as K

TABLE_KEY = ["dataset_id", "table_name"]


def read_history(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """Stored fingerprints. ``since`` (a date) prunes whole partitions."""
    history = spark.read.parquet(path)
    if since:
        history = history.where(F.col("computed_date") >= F.lit(since).cast("date"))
    return history.drop("computed_date")


def _laid_out(rows: DataFrame, time_column: str) -> DataFrame:
    dated = rows.withColumn("computed_date", F.to_date(time_column))
    return dated.hint("rebalance", "computed_date").sortWithinPartitions(*TABLE_KEY, time_column)


def between_dates(stored: DataFrame, fresh: DataFrame, date: str = "computed_date") -> DataFrame:
    """Stored rows from the first to the last date of ``fresh``, and those without a date; whole partitions are pruned."""
    span = [fresh.agg(f(date)).scalar() for f in (F.min, F.max)]
    return stored.where(F.col(date).isNull() | F.col(date).between(*span))


def _append_new(rows: DataFrame, path: str, id_column: str, time_column: str) -> None:
    """Append the rows whose id is not stored yet; of several rows with one id one is taken.

    The look-up reads just the id column, and only of the partitions between the first and the last new date; an
    anti-join alone would read the whole history.
    """
    fresh = rows.withColumn("computed_date", F.to_date(time_column)).dropDuplicates([id_column, "computed_date"])
    try:
        present = between_dates(rows.sparkSession.read.parquet(path).select(id_column, "computed_date"), fresh)
        fresh = fresh.join(present.withColumnRenamed(id_column, "stored_id").drop("computed_date"), F.col(id_column) == F.col("stored_id"), "left_anti")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    _laid_out(fresh.drop("computed_date"), time_column).write.mode("append").partitionBy("computed_date").parquet(path)


def store(fingerprints: DataFrame, path: str) -> None:
    """Append fingerprints that are not stored yet: ids depend only on table and sync, so a repeat adds nothing."""
    _append_new(fingerprints, path, "fingerprint_id", "computed_at")


def append_log(log: DataFrame, path: str) -> None:
    """Append drift-log entries, once per check of a table and sync."""
    _append_new(log, path, "report_id", "logged_at")


def store_states(states: DataFrame, path: str) -> None:
    """Append sketch states that are not stored yet (see ``operators.sketches``)."""
    _append_new(states, path, "state_id", "computed_at")


def recent(history: DataFrame, n: int = K.BASELINE_SYNCS) -> DataFrame:
    """The newest ``n`` fingerprints of every table, newest first (``recency`` 1 is the newest).

    Each task keeps its own ``n`` newest per table before the shuffle, so a long history costs one scan.
    """
    newest = Window.partitionBy(*TABLE_KEY).orderBy(F.desc("computed_at"), "fingerprint_id")
    return history.withColumn("recency", F.row_number().over(newest)).where(F.col("recency") <= n)


def listing(history: DataFrame, dataset_id: str, table_name: str, limit: int = K.LISTING_SYNCS) -> DataFrame:
    """The newest fingerprints of one table."""
    mine = (F.col("dataset_id") == dataset_id) & (F.col("table_name") == table_name)
    return history.where(mine).orderBy(F.desc("computed_at"), "fingerprint_id").limit(limit)


def matching(
    table_name: str,
    dataset_id: str,
    is_synthetic: bool | None = None,
    computed_from: Column | None = None,
) -> Column:
    """Predicate of a history delete: one table, optionally only (non-)synthetic rows from a time on."""
    predicate = (F.col("table_name") == table_name) & (F.col("dataset_id") == dataset_id)
    if is_synthetic is not None:
        predicate = predicate & (F.col("is_synthetic") == F.lit(is_synthetic))
    if computed_from is not None:
        predicate = predicate & (F.col("computed_at") >= computed_from)
    return predicate


def without(history: DataFrame, predicate: Column) -> DataFrame:
    """The history less the matching rows; a row for which the predicate is unknown stays."""
    return history.where(~F.coalesce(predicate, F.lit(False)))


def rewrite_without(spark: SparkSession, path: str, predicate: Column, new_path: str) -> None:
    """Delete by rewrite: a cleaned copy with the same layout at ``new_path``; the caller then switches over."""
    kept = without(read_history(spark, path), predicate)
    _laid_out(kept, "computed_at").write.partitionBy("computed_date").parquet(new_path)


_JOURNAL = "_delete-"  # readers skip names that start with an underscore


def _files(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def _on_dates(dates: list) -> Column:
    """Partition predicate of the given dates; None stands for rows without one."""
    known = F.col("computed_date").isin([d for d in dates if d is not None])
    return known | F.col("computed_date").isNull() if None in dates else known


def delete_where(spark: SparkSession, path: str, predicate: Column) -> None:
    """Delete the matching rows of the history at ``path`` in place, rewriting only the dates that hold some.

    Rows for which the predicate is unknown stay. What stays of those dates is first written beside the history, closed by
    the list of the dates; only then are the dates replaced and emptied ones removed. A run that is interrupted before the
    list is written has changed nothing. One that is interrupted later is brought to its end by ``finish_deletes``, which
    the next delete calls first: until then a date holds its old or its new rows, or has them in the folder beside. Other
    dates keep their files, and with nothing to delete nothing is written. One writer at a time is assumed; the driver
    sees one value per date.
    """
    finish_deletes(spark, path)
    stored = spark.read.parquet(path)
    dates = [r[0] for r in stored.where(predicate).select("computed_date").distinct().toLocalIterator()]
    if not dates:
        return
    journal = f"{path.rstrip('/')}/{_JOURNAL}{uuid.uuid4().hex}"
    kept = without(stored.where(_on_dates(dates)), predicate).sortWithinPartitions("computed_date", *TABLE_KEY, "computed_at")
    kept.write.parquet(f"{journal}/rows")
    touched = spark.createDataFrame([(d,) for d in dates], "computed_date date")
    touched.coalesce(1).write.parquet(f"{journal}/dates")
    finish_deletes(spark, path)


def finish_deletes(spark: SparkSession, path: str) -> None:
    """Carry out deletes that were decided but not finished, and forget those that were never decided."""
    files, folder = _files(spark, path)
    if not files.exists(folder):
        return
    for status in files.listStatus(folder):
        journal = status.getPath()
        if not journal.getName().startswith(_JOURNAL):
            continue
        if files.exists(_files(spark, f"{journal}/dates/_SUCCESS")[1]):
            _replace_dates(spark, path, str(journal))
        files.delete(journal, True)


def _replace_dates(spark: SparkSession, path: str, journal: str) -> None:
    rows = spark.read.parquet(f"{journal}/rows")
    replaced = rows.hint("rebalance", "computed_date").sortWithinPartitions("computed_date", *TABLE_KEY, "computed_at")
    replaced.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("computed_date").parquet(path)
    left = rows.select("computed_date").distinct().withColumn("left", F.lit(True))
    touched = spark.read.parquet(f"{journal}/dates").alias("t")
    same = F.col("t.computed_date").eqNullSafe(F.col("l.computed_date"))
    for (emptied,) in touched.join(left.alias("l"), same, "left_anti").toLocalIterator():
        name = "__HIVE_DEFAULT_PARTITION__" if emptied is None else emptied.isoformat()
        files, gone = _files(spark, f"{path.rstrip('/')}/computed_date={name}")
        files.delete(gone, True)


def replicate(fingerprints: DataFrame, offsets_days: list[int], as_of: Column) -> DataFrame:
    """Baseline capture: one copy of each fingerprint per offset, dated that many days before ``as_of``.

    Ids are derived from the original's id and the offset, so a retried task writes the same rows again.
    """
    copies = fingerprints.withColumn("offset_days", F.explode(F.array(*[F.lit(d) for d in offsets_days])))
    return copies.select(
        F.left(
            F.sha2(F.concat_ws("|", "fingerprint_id", F.col("offset_days").cast("string")), 256), F.lit(32)
        ).alias("fingerprint_id"),
        F.timestamp_add("DAY", -F.col("offset_days"), as_of).alias("computed_at"),
        F.lit(False).alias("is_synthetic"),
        *[c for c in fingerprints.columns if c not in ("fingerprint_id", "computed_at", "is_synthetic")],
    )


def capture_offsets(copies: int = 5, step_days: int = 3) -> list[int]:
    """Offsets of evenly staggered copies that end at the capture time."""
    return [(copies - 1 - i) * step_days for i in range(copies)]


def covered_tables(history: DataFrame) -> DataFrame:
    """Distinct tables that have at least one fingerprint."""
    return history.select(*TABLE_KEY).distinct().withColumn(
        "table_key", F.concat_ws(".", "dataset_id", "table_name")
    )

"""Written intermediate results.

A profile is a few kilobytes per sync, but the scan behind it may be terabytes. Whatever is read more than
once downstream is therefore written once, as parquet, in the folder the cluster names in
``spark.checkpoint.dir``. This also cuts the lineage, so that a lost executor costs a re-read, not a re-scan.

Results are lazy and read what is staged, so nothing is removed behind their back: call ``release`` when the results of
a session are used up. It also runs when the driver's Python ends.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT = "spark.checkpoint.dir"

_paths: dict[str, list[str]] = {}
_tables: dict[str, list[str]] = {}


def staging_root(spark: SparkSession) -> str:
    """The shared folder for written intermediates. Only a local session that names none gets one of its own."""
    configured = spark.conf.get(CHECKPOINT, None) or spark.sparkContext.getConf().get(CHECKPOINT, None)
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT} to a folder that every executor can reach")
        configured = tempfile.mkdtemp(prefix="driftlens-")
        spark.conf.set(CHECKPOINT, configured)
    return configured.rstrip("/") + "/driftlens"


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{staging_root(spark)}/{label}-{uuid.uuid4().hex}"
    application = spark.sparkContext.applicationId
    if application not in _paths:
        _paths[application] = []
        atexit.register(_at_exit, spark)
    _paths[application].append(path)
    return path


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and return a scan of the written copy."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def deal(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` in the places that ``keys`` have in a bucketed copy, so that joins with one need no further exchange."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def stage_bucketed(df: DataFrame, label: str, *keys: str, dealt: bool = False) -> DataFrame:
    """Write ``df`` once, bucketed by ``keys``: later joins on them leave it where it is.

    ``dealt`` says that ``deal`` has put rows of equal ``keys`` together, so that they are written from where they lie.
    """
    spark = df.sparkSession
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = new_path(spark, label)
    name = f"staged_{uuid.uuid4().hex}"
    (df if dealt else deal(df, *keys)).write.bucketBy(count, *keys).option("path", path).saveAsTable(name)
    _tables.setdefault(spark.sparkContext.applicationId, []).append(name)
    written = spark.table(name)
    written._bucketed_by = keys
    return written


def let_go(spark: SparkSession) -> None:
    """Let Spark delete the exchanged rows of what is done with, which it does only when the driver's garbage is collected.

    Else those of all steps lie on disk together, beside the copies that were made from them.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Growing:
    """A copy that grows: rows are appended bucketed by ``keys``, and read as one table that joins by them in place.

    ``add`` takes rows that ``deal`` has put together by ``keys``; they are written from where they lie.
    """

    def __init__(self, spark: SparkSession, label: str, *keys: str):
        self.spark, self.keys = spark, keys
        self.count = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.path, self.name = new_path(spark, label), f"staged_{uuid.uuid4().hex}"
        _tables.setdefault(spark.sparkContext.applicationId, []).append(self.name)

    def add(self, dealt: DataFrame) -> DataFrame:
        rows = dealt.write.mode("append").bucketBy(self.count, *self.keys)
        rows.option("path", self.path).option("compression", "zstd").saveAsTable(self.name)
        let_go(self.spark)
        written = self.spark.table(self.name)
        written._bucketed_by = self.keys
        return written


def is_bucketed(df: DataFrame, *keys: str) -> bool:
    """Whether ``df`` is, as it stands, what ``stage_bucketed`` wrote by these keys."""
    return getattr(df, "_bucketed_by", None) == keys


def release(spark: SparkSession) -> None:
    """Remove everything this application has staged; results that still read it become unusable."""
    application = spark.sparkContext.applicationId
    for name in _tables.pop(application, []):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    configuration = spark.sparkContext._jsc.hadoopConfiguration()
    written = _paths.get(application, [])
    while written:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(written.pop())
        path.getFileSystem(configuration).delete(path, True)


def _at_exit(spark: SparkSession) -> None:
    if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
        release(spark)

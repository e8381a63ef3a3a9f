"""Session settings the engine is tuned for.

Every operator works on any session it is given; these settings only decide how fast it runs.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # profiles keep one sketch per (sync, column); the default of 128 groups would sort far too early
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "4096",
    # many different small plans share one session: the default of 100 compiled classes evicts too early
    "spark.sql.codegen.cache.maxEntries": "1000",
}


def build_session(
    app_name: str = "driftlens",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """A session with the engine's settings. On a cluster leave ``master`` and the partition count unset."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = dict(SETTINGS)
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(extra or {})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()

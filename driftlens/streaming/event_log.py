"""The incident event log, written by a stream: an event that is delivered again is written once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.incidents import EVENT_KEY

LOG = "events"


def once(events: DataFrame, lateness: str = "1 day") -> DataFrame:
    """(report_id, at, seq, action), each event once as long as its repeats come within ``lateness`` of its time.

    Spark keeps the keys of about twice that long and drops them as the watermark passes. An event later than that is
    dropped, and so is one without a time, which has no place in a log by days.
    """
    timed = events.select(*EVENT_KEY).where("at is not null").withColumn("at", F.col("at").cast("timestamp"))
    return timed.withWatermark("at", lateness).dropDuplicatesWithinWatermark(EVENT_KEY)


def log_events(events: DataFrame, root: str, lateness: str = "1 day", available_now: bool = False) -> StreamingQuery:
    """Append each event once to ``root/events``, by day; a restart goes on behind the last whole micro-batch."""
    writer = (
        once(events, lateness)
        .withColumn("event_date", F.to_date("at"))
        .writeStream.format("parquet")
        .outputMode("append")
        .partitionBy("event_date")
        .option("path", f"{root}/{LOG}")
        .option("checkpointLocation", f"{root}/checkpoint-{LOG}")
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()

"""Streams: counts by session of signals as they arrive, and their maturity."""

from __future__ import annotations

from panelforge.sources.log import LatestLog
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def maturity_counts(signals: DataFrame, time: str = "ts", kind: str = "event_type") -> DataFrame:
    """Arrivals by kind and session day. The same plan serves a table and a stream.

    On a stream, put a watermark on ``time`` first: late rows are then dropped and old sessions forgotten.
    """
    return signals.groupBy(F.col(kind), F.to_date(time).alias("session_date")).agg(F.count("*").alias("n"))


COUNTS = "name string, kind string, session_date date, n bigint"


def count_stream(signals: DataFrame, path: str, time: str = "ts", kind: str = "event_type", late: str = "2 days") -> DataFrame:
    """Arrivals by kind and session day of a stream, as far as it has come, kept as a table that each batch brings up to date.

    Days that are over by ``late`` are forgotten, and rows that come later than that are dropped. A batch writes the counts that it changed;
    a batch that runs again writes the same. Another run goes on where this one ended.
    """
    counts = LatestLog(signals.sparkSession, f"{path}/counts", COUNTS, "name")
    # A watermark needs an instant: the time as it stands, taken for UTC's.
    moment = F.to_timestamp(F.concat(F.col(time).cast("timestamp_ntz").cast("string"), F.lit("Z")))
    stamped = signals.select(moment.alias("_time"), F.col(kind).alias("kind")).withWatermark("_time", late)
    days = stamped.groupBy("kind", F.window("_time", "1 day").alias("day")).agg(F.count("*").alias("n"))
    start = F.to_date(F.to_utc_timestamp("day.start", F.current_timezone()))
    named = days.select(F.concat_ws("|", start.cast("string"), F.when(F.col("kind").isNull(), "").otherwise(F.concat(F.lit("is "), "kind"))).alias("name"), "kind", start.alias("session_date"), "n")
    writer = named.writeStream.outputMode("update").foreachBatch(lambda batch, _: counts.append(batch)).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    writer.start().awaitTermination()
    return counts.read().select(F.col("kind").alias(kind), "session_date", "n")


def matured_stream(signals: DataFrame, calendar: DataFrame, sessions: DataFrame) -> DataFrame:
    """A stream of signals (``created_at``, ``horizon_days``) with ``horizon_end``, by joins with static calendar tables.

    ``calendar`` has session_date and ord, ``sessions`` has day and n_le, as a Market keeps them. A signal whose horizon
    ends beyond the calendar has a NULL end and is pending.
    """
    dated = signals.withColumn("_day", F.to_date("created_at"))
    placed = dated.join(sessions.withColumnRenamed("day", "_day"), "_day", "left").withColumn("_ord", F.col("n_le") + F.col("horizon_days"))
    ends = calendar.select(F.col("ord").alias("_ord"), F.col("session_date").alias("horizon_end"))
    return placed.join(ends, "_ord", "left").drop("_day", "_ord", "n_le").withColumn("is_matured", F.col("horizon_end").isNotNull())


def run_once(stream: DataFrame, path: str) -> DataFrame:
    """Process what a stream has now into a table at ``path``, with the stream's own checkpoint beside it, and read that table.

    Another run goes on where this one ended, so each signal is written once.
    """
    writer = stream.writeStream.format("parquet").option("path", f"{path}/table").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    writer.start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/table")

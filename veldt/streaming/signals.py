"""Signals of events as they arrive: graded once each, and counted by day and severity behind a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veldt.operators.events import signals


def signal_stream(events: DataFrame, delay: str = "7 days") -> DataFrame:
    """The signal of each event, once, however often its row arrives within the delay; later repeats count as new.

    events: a stream of what operators.events.signals reads. State is one id for each event younger than the delay.
    """
    timed = signals(events).withColumn("at", F.to_timestamp("event_date"))
    return timed.withWatermark("at", delay).dropDuplicatesWithinWatermark(["signal_id"])


def severity_counts(signals_: DataFrame, width: str = "1 day") -> DataFrame:
    """Signals by window of time and severity; a window is complete once the watermark has passed its end."""
    by = signals_.groupBy(F.window("at", width).alias("w"), "severity").agg(F.count("*").alias("signals"))
    return by.select(F.col("w.start").alias("since"), "severity", "signals")


def append(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Write all that has arrived to a Parquet folder; run again to go on from the checkpoint."""
    return stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def closed_counts(events: DataFrame, folder: str, checkpoint: str, delay: str = "7 days", width: str = "1 day") -> StreamingQuery:
    """Write each window's counts once, when the watermark has passed its end; run again to go on from the checkpoint.

    Two stateful operators stand behind it: ids of signals younger than the delay, and counts of open windows. A row that
    comes after its window was written is left out here; `shortfall` finds it.
    """
    return append(severity_counts(signal_stream(events, delay), width), folder, checkpoint)


def shortfall(counts: DataFrame, events: DataFrame, width: str = "1 day") -> DataFrame:
    """since, severity, signals, counted of the written windows that lack signals, as late rows leave them.

    counts: what closed_counts wrote; events: the batch of all events that have arrived. A window of which nothing was written
    lacks all its signals if a later one was written; windows after the last one written are still open.
    """
    once = signals(events).dropDuplicates(["signal_id"]).withColumn("at", F.to_timestamp("event_date"))
    whole = severity_counts(once, width)
    written = counts.select("since", "severity", F.col("signals").alias("counted"))
    last = written.agg(F.max("since").alias("last"))  # one row
    both = whole.join(written, ["since", "severity"], "left").join(F.broadcast(last), F.col("since") <= F.col("last"))
    counted = F.coalesce("counted", F.lit(0))
    return both.where(F.col("signals") > counted).select("since", "severity", "signals", counted.alias("counted"))

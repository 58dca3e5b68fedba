"""Query of the stream of signals: a table of arrived events, streamed to the end, with the windows that it closes."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from veldt.plans.event_queries import _RAW, raw_events
from veldt.registry import query
from veldt.sources.snapshots import shared_folder
from veldt.streaming import signals as S


@query(f"""WITH {_RAW}, d AS (SELECT CAST(event_date AS DATE) AS day, severity FROM signals)
SELECT strftime(day, '%Y-%m-%d') AS day, severity, count(*) AS signals FROM d WHERE day + 1 <= (SELECT max(day) FROM d) - 7 GROUP BY 1, 2""")
def closed_signal_windows(spark, folder):
    """Signals by day and severity of the days that the watermark, seven days behind the last event, has passed."""
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    raw_events(spark, folder).write.parquet(f"{at}/in")
    schema = spark.read.parquet(f"{at}/in").schema
    S.closed_counts(spark.readStream.schema(schema).parquet(f"{at}/in"), f"{at}/out", f"{at}/checkpoint").awaitTermination()
    written = spark.read.schema("since timestamp, severity string, signals long").parquet(f"{at}/out")
    return written.select(F.date_format("since", "yyyy-MM-dd").alias("day"), "severity", "signals")

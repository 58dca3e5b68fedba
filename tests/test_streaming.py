from pyspark.sql import functions as F

from veldt.operators.events import signals
from veldt.streaming.signals import append, closed_counts, severity_counts, shortfall, signal_stream

SCHEMA = "event_id long, company_id string, kind string, event_type string, title string, notes string, indicator_id string, event_date string, url string, confidence double"


def rows(first, n):
    return [(i, f"c{i % 3}", "inquiry" if i % 2 else "deep-search", "处罚" if i % 5 == 0 else "x", "t", "", "R09", f"2024-01-{1 + i % 20:02d}", "https://e.example/", 0.9) for i in range(first, first + n)]


def test_a_stream_gives_each_signal_once_and_goes_on(spark, tmp_path):
    source, out, check = (f"{tmp_path}/{x}" for x in ("in", "out", "check"))
    for batch in (rows(0, 40), rows(20, 40)):  # the second brings 20 events again
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        append(signal_stream(stream, "60 days"), out, check).awaitTermination(120)
    got = sorted(r.signal_id for r in spark.read.parquet(out).collect())
    want = sorted(r.signal_id for r in signals(spark.createDataFrame(rows(0, 60), SCHEMA)).collect())
    assert got == want


def test_counts_are_those_of_the_batch(spark, tmp_path):
    source = f"{tmp_path}/in"
    df = spark.createDataFrame(rows(0, 60), SCHEMA)
    df.coalesce(1).write.parquet(source)
    counts = severity_counts(signal_stream(spark.readStream.schema(SCHEMA).parquet(source)))
    query = counts.writeStream.format("memory").queryName("severity_counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted((r.since.strftime("%Y-%m-%d"), r.severity, r.signals) for r in spark.table("severity_counts").collect())
    want = sorted((r.event_date, r.severity, r.n) for r in signals(df).groupBy("event_date", "severity").agg(F.count("*").alias("n")).collect())
    assert got == want


def test_windows_are_written_once_over_restarts_and_late_rows_are_found(spark, tmp_path):
    source, out, check = (f"{tmp_path}/{x}" for x in ("in", "out", "check"))

    def arrive(days):
        batch = [(i, "c", "inquiry", "x", "t", "", "R09", f"2024-01-{d:02d}", "https://e.example/", 0.9) for i, d in days]
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        closed_counts(spark.readStream.schema(SCHEMA).parquet(source), out, check, "3 days").awaitTermination(120)
        return sorted((r.since.day, r.signals) for r in spark.read.schema("since timestamp, severity string, signals long").parquet(out).collect())

    first = [(i, 1 + i % 20) for i in range(40)]
    assert arrive(first) == [(d, 2) for d in range(1, 17)]  # the watermark is the 17th: its window and later ones are open
    second = [(100, 18), (101, 30), (39, 20), (102, 2)]  # one in time, one far ahead, a repeat, one too late
    got = arrive(second)
    want = {d: 2 for d in range(1, 21)} | {18: 3}
    assert got == sorted(want.items())  # every window once, the repeat not counted, the late row absent
    counts, events = spark.read.parquet(out), spark.read.schema(SCHEMA).parquet(source)
    assert [(r.since.day, r.signals, r.counted) for r in shortfall(counts, events).collect()] == [(2, 3, 2)]
    assert shortfall(counts.where("day(since) <> 5"), events).where("day(since) = 5").first().counted == 0

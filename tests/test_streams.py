"""The tracker of maturing signals across batches and restarts, and the order of records."""

import bisect
import datetime as dt
import random

import pytest
from panelforge.operators import metrics
from panelforge.sources import store
from panelforge.streaming import maturity, tracker
from pyspark.sql import functions as F

DAY = dt.date(2026, 1, 1)


def brute(signals, sessions):
    out = []
    for i, created, horizon in signals:
        passed = bisect.bisect_right(sessions, created.date()) if created else 0
        if created and horizon and passed + horizon <= len(sessions):
            out.append((i, sessions[passed + horizon - 1]))
    return sorted(out)


@pytest.mark.parametrize("shards", [3])
def test_signals_mature_once_across_restarts(spark, tmp_path, shards):
    rng = random.Random(2)
    sessions = [DAY + dt.timedelta(d) for d in sorted(rng.sample(range(60), 30))]
    at = lambda d: dt.datetime.combine(d, dt.time(rng.randint(0, 23)))
    signals = [(i, at(DAY + dt.timedelta(rng.randint(0, 70))), rng.choice([1, 3, 5, 20])) for i in range(120)] + [(900, None, 1), (901, at(DAY), None)]
    names = "id long, created_at timestamp_ntz, horizon_days int"

    def batch(some, days):
        if some:
            spark.createDataFrame(some, names).coalesce(1).write.mode("append").parquet(f"{tmp_path}/signals")
        if days:
            spark.createDataFrame([(d,) for d in days + days[-1:]], "session_date date").coalesce(1).write.mode("append").parquet(f"{tmp_path}/sessions")

    def run():
        read = lambda name, schema: spark.readStream.schema(schema).parquet(f"{tmp_path}/{name}")
        with tracker.state_in_rocksdb(spark):
            out = maturity.run_once(tracker.track(read("signals", names), read("sessions", "session_date date"), shards), f"{tmp_path}/run")
        return sorted((r["id"], r["horizon_end"]) for r in out.collect())

    # Signals of later days are there before their sessions, and signals of earlier days come after them.
    batch(signals[::2], sessions[:10])
    assert run() == brute(signals[::2], sessions[:10])
    assert run() == brute(signals[::2], sessions[:10])  # nothing new, nothing twice
    batch(signals[1::2], sessions[10:25])
    assert run() == brute(signals, sessions[:25])
    batch([], sessions[25:])
    assert run() == brute(signals, sessions)


def test_records_come_in_the_order_of_time_and_id(spark):
    rows = [(i, dt.datetime(2026, 1, 1 + i * 7 % 5)) for i in range(50)]
    df = spark.createDataFrame(rows, "id int, created_at timestamp_ntz").repartition(5)
    assert [(r["created_at"], r["id"]) for r in store.in_order(df).collect()] == sorted((t, i) for i, t in rows)


def test_groups_come_in_the_order_of_horizon_and_class(spark):
    rows = [(h, c) for h in (20, 1, 5) for c in ("Watch", "Avoid", "Tradeable")]
    df = spark.createDataFrame(rows, "horizon_days int, classification string").repartition(4).withColumn("n", F.lit(1))
    assert [(r["horizon_days"], r["classification"]) for r in metrics.in_order(df).collect()] == sorted(rows)


def test_counts_follow_the_stream_and_late_rows_are_dropped(spark, tmp_path):
    schema = "ts timestamp_ntz, event_type string"

    def run(rows):
        if rows:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        read = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        return sorted((tuple(r) for r in maturity.count_stream(read, f"{tmp_path}/run").collect()), key=repr)

    day = lambda d, h=0: dt.datetime(2026, 1, d, h)
    assert run([(day(1, 5), "a"), (day(1, 6), "a"), (day(1), None), (day(2), "b")]) == [("a", DAY, 2), ("b", dt.date(2026, 1, 2), 1), (None, DAY, 1)]
    assert run([(day(2, 3), "b"), (day(20), "a")])[0:3] == [("a", DAY, 2), ("a", dt.date(2026, 1, 20), 1), ("b", dt.date(2026, 1, 2), 2)]
    run([(day(21), "a")])
    assert ("a", DAY, 2) in run([(day(1, 9), "a")])  # over long ago
    assert run([])[1] == ("a", dt.date(2026, 1, 20), 1)

"""The outcome log, numbering of snapshots and result tables."""

import datetime as dt
import threading

from panelforge.plans import queries
from panelforge.sources import log, results, store
from pyspark.sql import functions as F

SCHEMA = "k bigint, v string"


def rows_of(frame):
    return sorted(((r["k"], r["v"]) for r in frame.collect()), key=repr)


def test_latest_rows_survive_compaction_and_vacuum(spark, tmp_path):
    own = log.LatestLog(spark, f"{tmp_path}/t", SCHEMA, "k", buckets=4, batches=3)
    assert own.read().count() == 0
    expected = {}
    for i in range(8):
        batch = [(k, f"{i}-{k}") for k in range(i, 40, i + 1)] + ([(None, f"n{i}")] if i % 3 == 0 else [])
        own.append(spark.createDataFrame(batch, SCHEMA))
        expected.update(batch)
        assert len(own.state()[1]) < 3
    assert rows_of(own.read()) == sorted(expected.items(), key=repr)
    own.compact()
    base, top = own.state()
    assert not top and set(base) == {"0", "1", "2", "3"}
    own.vacuum()
    assert rows_of(own.read()) == sorted(expected.items(), key=repr) and len(own.commits()) == 1
    # A batch touches its own buckets' files alone.
    own.append(spark.createDataFrame([(1, "last")], SCHEMA))
    own.compact()
    new = own.state()[0]
    assert sum(new[b] != base[b] for b in base) == 1
    assert rows_of(own.read()) == sorted((expected | {1: "last"}).items(), key=repr)


def test_two_writers_lose_nothing(spark, tmp_path):
    writers = [log.LatestLog(spark, f"{tmp_path}/t", SCHEMA, "k", buckets=2, batches=3) for _ in range(2)]

    def write(number):
        for i in range(4):
            writers[number].append(spark.createDataFrame([(100 * number + i, "x"), (7, f"{number}")], SCHEMA))

    threads = [threading.Thread(target=write, args=(n,)) for n in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    kept = dict(rows_of(writers[0].read()))
    assert {k for k in kept if k != 7} == {i for i in range(4)} | {100 + i for i in range(4)} and kept[7] in {"0", "1"}
    assert rows_of(writers[1].read()) == rows_of(writers[0].read())


def test_compactions_at_the_same_time_lose_nothing(spark, tmp_path):
    own = log.LatestLog(spark, f"{tmp_path}/t", SCHEMA, "k", buckets=2, batches=99)
    for i in range(3):
        own.append(spark.createDataFrame([(i, "a"), (9, f"{i}")], SCHEMA))
    held = own.state()
    other = log.LatestLog(spark, f"{tmp_path}/t", SCHEMA, "k", buckets=2)
    own.append(spark.createDataFrame([(5, "late")], SCHEMA))
    other.state = lambda: held  # it began before the last batch
    own.compact()
    other.compact()
    assert rows_of(own.read()) == [(0, "a"), (1, "a"), (2, "a"), (5, "late"), (9, "2")]


def test_files_of_an_older_schema_load_and_are_rewritten(spark, tmp_path):
    old = log.LatestLog(spark, f"{tmp_path}/t", "k bigint", "k", buckets=2)
    old.append(spark.createDataFrame([(1,), (2,)], "k long"))
    old.compact()
    new = log.LatestLog(spark, f"{tmp_path}/t", SCHEMA, "k", buckets=2)
    new.append(spark.createDataFrame([(2, "b")], SCHEMA))
    assert rows_of(new.read()) == [(1, None), (2, "b")]
    new.compact()
    assert rows_of(new.read()) == [(1, None), (2, "b")]


def test_a_read_scans_the_base_without_a_shuffle_of_it(spark, tmp_path):
    own = log.LatestLog(spark, f"{tmp_path}/t", SCHEMA, "k", buckets=2, batches=99)
    own.append(spark.createDataFrame([(i, "a") for i in range(50)], SCHEMA))
    own.compact()
    own.append(spark.createDataFrame([(1, "b")], SCHEMA))
    plan = own.read()._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan and "SortMergeJoin" not in plan
    assert dict(rows_of(own.read()))[1] == "b"


def test_one_days_batch_is_numbered_by_many_tasks(spark, tmp_path):
    own = store.SignalStore(spark, f"{tmp_path}/s")
    names = "ticker string, created_at timestamp_ntz, horizon_days int, classification string, score double, theme string, benchmark string, sector_proxy string, price_at_creation double, rule_version string"
    rows = [(f"T{i * 37 % 200:03}", dt.datetime(2026, 1, 1), 5, "Watch", float(i), "x", "SPY", None, 2.0, "rules.v1") for i in range(400)]
    own.insert(spark.createDataFrame(rows + rows[:3], names).repartition(7))
    found = own.snapshots().orderBy("id").collect()
    assert [r["id"] for r in found] == list(range(1, 404))
    assert [(r["ticker"], r["score"]) for r in found] == sorted((t, s) for t, _, _, _, s, *_ in rows + rows[:3])
    own.insert(spark.createDataFrame(rows[:1], names))
    assert own.snapshots().agg(F.max("id")).first()[0] == 404


def test_a_repeated_run_leaves_the_same_rows(spark, tmp_path):
    tables = results.ResultTables(spark, f"{tmp_path}/r")
    assert tables.read("metrics").count() == 0 and tables.runs("metrics") == []
    schema = "horizon_days int, classification string, sample_size long, more int"
    first = spark.createDataFrame([(1, "Watch", 5, 0), (5, "Watch", 6, 0), (5, "Avoid", 7, 0)], schema)
    for _ in range(2):
        tables.write("metrics", "a", first)
    tables.write("metrics", "b", first.where("horizon_days = 1"))
    tables.write("metrics", "a", spark.createDataFrame([(5, "Watch", 8, 0)], schema))
    rows = sorted((r["run_id"], r["horizon_days"], r["classification"], r["sample_size"]) for r in tables.read("metrics").collect())
    assert rows == [("a", 1, "Watch", 5), ("a", 5, "Watch", 8), ("b", 1, "Watch", 5)]
    assert tables.runs("metrics") == ["a", "b"] and tables.read("metrics", "b").count() == 1
    assert tables.read("metrics").columns[:3] == ["run_id", "horizon_days", "classification"]
    assert "v17_stored_outcomes" in queries.QUERIES

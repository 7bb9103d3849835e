"""Feeds from outside, ordered and typed readers, and the report."""

import datetime as dt
import os
import sys
from pathlib import Path

import pytest
from panelforge.operators import metrics, prices
from panelforge.plans import pipeline, report
from panelforge.sources import clients, feeds, store
from panelforge.sources.providers import get_price_provider


@pytest.fixture(autouse=True)
def importable(spark):
    folder = str(Path(__file__).resolve().parent)
    sys.path.insert(0, folder)
    environment = spark.sparkContext.environment
    before = environment.get("PYTHONPATH", "")
    environment["PYTHONPATH"] = os.pathsep.join(p for p in (before, folder, str(Path(folder).parent)) if p)
    yield
    environment["PYTHONPATH"] = before
    sys.path.remove(folder)


def test_prices_come_one_partition_a_symbol(spark):
    raw = feeds.read_prices(spark, "feed_functions:prices", [" aaa", "BBB", "none"], "2026-01-01", "2026-01-31")
    assert raw.rdd.getNumPartitions() == 3
    bundle = get_price_provider(spark, "eod", fetch="feed_functions:prices").get_history(["aaa", "none"], "2026-01-01", "2026-01-31")
    rows = sorted((r["symbol"], r["session_date"], r["adjusted_close"]) for r in bundle.prices.collect())
    assert rows == [("AAA", dt.date(2026, 1, 1), 11.0), ("AAA", dt.date(2026, 1, 5), 12.5)]
    assert [r["symbol"] for r in bundle.missing.collect()] == ["NONE"]


def test_news_and_earnings_never_fail(spark):
    news = {r["symbol"]: r["raw"] for r in feeds.fetch_news(spark, ["aaa", "bbb", "bad"], "feed_functions:news").collect()}
    assert news == {"AAA": '[{"title": "About AAA"}]', "BBB": "[]", "BAD": "[]"}
    dates = {r["symbol"]: r["earnings_date"] for r in feeds.fetch_earnings(spark, ["aaa", "bbb", "ccc"], "feed_functions:earnings").collect()}
    assert dates == {"AAA": "2026-03-01", "BBB": None, "CCC": None}
    assert feeds.fetch_news(spark, [], "feed_functions:news").count() == 0


def test_display_keeps_order_and_empty_frames(spark):
    df = spark.createDataFrame([(1, "x", 2)], "horizon_days int, ticker string, other int")
    assert store.display(df, store.GROUP_COLUMNS).columns == ["horizon_days"]
    assert store.display(df, ["ticker", "horizon_days", "none"]).columns == ["ticker", "horizon_days"]
    assert store.display(df.select(), store.OUTCOME_COLUMNS).columns == store.OUTCOME_COLUMNS
    ordered = metrics.in_order(spark.createDataFrame([(5, "b"), (1, "c"), (5, "a")], "horizon_days int, classification string"))
    assert [tuple(r) for r in ordered.collect()] == [(1, "c"), (5, "a"), (5, "b")]


def test_report_has_the_demo_figures(spark):
    lines = report.report_lines(spark)
    assert len(lines) == 10 and lines[1] == "records: 3"
    values = dict(line.split(": ") for line in lines[1:])
    assert float(values["tradeable hit rate"]) == 1.0 and float(values["cohort base rate"]) == 0.4
    assert round(float(values["excess trade hit rate"]), 9) == 0.6 and values["false positives"] == "0" and values["avoid chase records"] == "1"


def test_signals_without_a_ticker_or_time_stay(spark):
    panel = spark.createDataFrame([(s, dt.date(2026, 1, d), float(100 + d)) for s in ("MKT", "AAA") for d in range(1, 9)], "symbol string, session_date date, adjusted_close double")
    market = prices.Market(panel, "MKT")
    day = dt.datetime(2026, 1, 2)
    rows = [(1, "AAA", day, "P"), (2, None, day, "P"), (3, "AAA", None, None), (4, None, None, None), (5, "AAA", day, None), (5, "AAA", day, None)]
    signals = spark.createDataFrame(rows, "id long, ticker string, created_at timestamp_ntz, sector_proxy string")
    for name, value in {"horizon_days": 1, "sentiment": "positive", "rsi": 50.0, "return_20d": 0.0, "setup_score": 80.0, "volume": True, "theme": "x"}.items():
        signals = signals.selectExpr("*", f"{value!r} as {name}")
    made = pipeline.generate_signals(signals, market)
    assert sorted(r["id"] for r in made.collect()) == [1, 2, 3, 4, 5, 5]
    done = {r["id"]: r["status"] for r in pipeline.evaluate_forward(made, market).collect()}
    assert done == {1: "matured", 2: "missing_prices", 3: "insufficient_calendar", 4: "missing_prices", 5: "matured"}
    release = market.release()
    assert release is None


@pytest.fixture
def seen(spark, tmp_path):
    environment = spark.sparkContext.environment
    environment["SEEN"] = os.environ["SEEN"] = str(tmp_path)
    yield tmp_path
    del os.environ["SEEN"]
    environment.pop("SEEN")


def test_only_wanted_symbols_and_days_are_fetched(spark, seen):
    panel = feeds.read_sessions(spark, "feed_functions:seen", ["a", "b", "c", "d", "e"], "2026-01-01", "2026-12-31", partitions=2, first_wait=0.01)
    own = panel.where("symbol in ('A', 'C', 'E') and session_date >= '2026-03-02' and session_date < '2026-03-05' and adjusted_close > 0")
    rows = sorted(map(tuple, own.collect()))
    assert rows == [(s, dt.date(2026, 3, d), d - 2.0) for s in "ACE" for d in (3, 4)]
    assert {f.name for f in seen.iterdir()} == {f"{s} 2026-03-02 2026-03-05" for s in "ACE"}
    assert panel.rdd.getNumPartitions() == 2
    assert panel.where("symbol = 'Z'").count() == 0 and panel.where("session_date > '2027-01-01'").count() == 0


def test_clients_are_asked_once_and_again_after_errors(spark, seen):
    rows = [(i, f"text {i % 6}") for i in range(40)] + [(90, "never this"), (91, None)]
    df = spark.createDataFrame(rows, "id int, prompt string").repartition(5)
    cache = str(seen / "cache" / "answers")
    (seen / "cache").mkdir()
    ask = lambda: {r["id"]: (r["answer"], r["error"]) for r in clients.ask(df, "feed_functions:flaky", cache=cache, tasks=3, first_wait=0.01).collect()}
    first = ask()
    assert len(first) == len(rows) and all(first[i] == (f"TEXT {i % 6}", None) for i in range(40))
    assert first[90] == (None, "ValueError: no answer") and first[91] == (None, None)
    calls = lambda: sum(f.is_file() for f in seen.iterdir())
    assert calls() == 13  # each text twice, and the one that fails for good once
    assert ask() == first and calls() == 14
    assert clients.ask(df.limit(0), "feed_functions:flaky").count() == 0


def test_pace_and_retry():
    now, slept = [0.0], []

    def sleep(seconds):
        slept.append(seconds)
        now[0] += seconds

    pace = clients.Pace(4.0, clock=lambda: now[0], sleep=sleep)
    for _ in range(5):
        pace.wait()
    assert now[0] == pytest.approx(1.0)
    slept.clear()
    with pytest.raises(OSError):
        clients.with_retry(lambda: (_ for _ in ()).throw(OSError("down")), 4, 1.0, sleep=sleep)
    assert len(slept) == 3 and 0.75 <= slept[0] <= 1.25 and 3 <= slept[2] <= 5

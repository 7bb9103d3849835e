"""Packed series, extremes and medians against brute force."""

import datetime as dt
import math
import random
import statistics

import pytest
from panelforge.operators import metrics, prices, returns, selection
from panelforge.plans import pipeline
from pyspark.sql import functions as F

DAY = dt.date(2026, 1, 1)


_MADE: dict = {}


def market_of(spark, seed, symbols=("A", "B", "M"), days=70):
    """Made once for each seed and bound of what is sent."""
    key = seed, prices.Market.SENT
    if key not in _MADE:
        _MADE[key] = made_market(spark, seed, symbols, days)
    return _MADE[key]


def made_market(spark, seed, symbols, days):
    rng = random.Random(seed)
    held = {s: sorted(rng.sample(range(days), rng.randint(20, 50))) for s in symbols}
    rows = [(s, DAY + dt.timedelta(d), round(rng.uniform(50, 150), 2)) for s, own in held.items() for d in own]
    panel = spark.createDataFrame(rows, "symbol string, session_date date, adjusted_close double")
    return prices.Market(panel, "M"), {s: {d: p for t, d, p in rows if t == s} for s in symbols}


@pytest.mark.parametrize("sent", [prices.Market.SENT, 0])
def test_look_ups_and_extremes_match_brute_force(spark, monkeypatch, sent):
    monkeypatch.setattr(prices.Market, "SENT", sent)
    market, held = market_of(spark, 4)
    rng = random.Random(5)
    day = lambda: DAY + dt.timedelta(rng.randint(-10, 80))
    rows = [(i, rng.choice(["A", "B", "Z", None]), day(), day()) for i in range(400)] + [(900, "A", None, day()), (901, "A", day(), None)]
    probes = spark.createDataFrame(rows, "id int, s string, a date, b date")
    read = market.read(probes, "s", lambda own: {"after": own.on_or_after(market.place(F.col("a"))), "before": own.on_or_before(market.place(F.col("b"))), "on": own.on(market.place(F.col("a")))})
    found = {r["id"]: r for r in returns.drawdown_runup(read, market, "s", "a", "b").collect()}
    assert len(found) == len(rows)
    for i, s, a, b in rows:
        own = held.get(s, {})
        later, earlier = [d for d in own if a and d >= a], [d for d in own if b and d <= b]
        inside = sorted(d for d in own if a and b and a <= d <= b)
        r = found[i]
        assert r["after"] == (own[min(later)] if later else None) and r["before"] == (own[max(earlier)] if earlier else None)
        assert r["on"] == own.get(a)
        if inside:
            first = own[inside[0]]
            assert r["max_drawdown"] == pytest.approx(min(own[d] for d in inside) / first - 1) and r["max_runup"] == pytest.approx(max(own[d] for d in inside) / first - 1)
        else:
            assert r["max_drawdown"] is None and r["max_runup"] is None


def test_extremes_make_no_row_for_a_session(spark):
    market, _ = market_of(spark, 4)
    probes = spark.createDataFrame([("A", DAY, DAY + dt.timedelta(60))], "ticker string, start_day date, end_day date")
    plan = returns.drawdown_runup(probes, market)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("Join") == 1


def test_evaluation_joins_prices_twice(spark):
    market, _ = market_of(spark, 4)
    names = "id int, ticker string, created_at timestamp_ntz, horizon_days int, classification string, sector_proxy string"
    snapshots = spark.createDataFrame([(1, "A", dt.datetime(2026, 1, 5), 3, "Watch", "B")], names)
    plan = pipeline.evaluate_forward(snapshots, market)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 3  # and the keys' results with the signals


def test_base_rates_need_no_cohort_and_partials_add_up(spark):
    market, _ = market_of(spark, 7)
    tickers = spark.createDataFrame([("A", "B"), ("B", None), ("Z", "A")], "ticker string, sector_proxy string")
    dates = spark.createDataFrame([(dt.datetime(2026, 1, 2) + dt.timedelta(i), h) for i in range(30) for h in (1, 5)], "created_at timestamp_ntz, horizon_days int")
    whole = pipeline.cohort_counts(tickers, dates, market)
    early, late = dates.where("created_at < '2026-01-15'"), dates.where("created_at >= '2026-01-15'")
    merged = metrics.merge_counts(pipeline.cohort_counts(tickers, early, market), pipeline.cohort_counts(tickers, late, market))
    rows = lambda df: sorted((r["horizon_days"], r["key"], r["n"], r["up"]) for r in df.collect())
    assert rows(whole) == rows(merged) == rows(metrics.count_risers(pipeline.universe_cohort(tickers, dates, market)))
    assert rows(whole)
    plan = whole._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan


VALUES = {
    "odd": [3.0, 1.0, 2.0], "even": [4.0, 1.0, 2.0, 8.0], "one": [7.0], "equal": [5.0] * 40, "none": [None, None], "nulls": [None, 2.0, None, 4.0],
    "spread": [10.0**k for k in range(-300, 300, 7)], "infinite": [-math.inf, 1.0, math.inf, math.inf], "ends": [-1.7e308, 1.7e308, 0.0, 1e-300], "zero": [0.0, -0.0, 0.0], None: [1.0, 9.0, 5.0],
    "hot": [1.0] * 500 + [2.0] * 499 + [3.0], "tiny": [1.0, math.nextafter(1.0, 2), math.nextafter(1.0, 0)], "gap": [0.0, 0.0, 100.0, 100.0],
}


def test_medians_match_brute_force(spark):
    rng = random.Random(8)
    values = VALUES | {"random": [rng.gauss(0, 1) for _ in range(3001)], "skewed": [math.exp(rng.gauss(0, 30)) for _ in range(2000)]}
    rows = [(k, 1, v, 0) for k, held in values.items() for v in held]
    df = spark.createDataFrame(rows, "k string, j int, v double, found int").repartition(3)
    out = {r["k"]: r["m"] for r in selection.medians(df, ["k", "j"], "v", "m").collect()}
    assert set(out) == set(values)
    for k, held in values.items():
        known = [v for v in held if v is not None]
        assert out[k] == (statistics.median(known) if known else None), k


def test_medians_of_nan_no_keys_and_no_rows(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", math.nan), ("a", math.nan), ("b", 1.0), ("b", 2.0), ("b", math.nan)], "k string, v double")
    out = {r["k"]: r["median"] for r in selection.medians(df, ["k"], "v").collect()}
    assert math.isnan(out["a"]) and out["b"] == 2.0
    assert selection.medians(df.where("k = 'b'"), [], "v").collect()[0][0] == 2.0
    assert [tuple(r) for r in selection.medians(df.limit(0), [], "v").collect()] == [(None,)]
    assert selection.medians(df.limit(0), ["k"], "v").count() == 0
    plan = selection.medians(df, ["k"], "v")._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "median" not in plan.replace("as median", "").replace("median#", "") and "percentile" not in plan


def test_betas_of_minute_bars_by_blocks_equal_those_of_one_sort(spark):
    rng = random.Random(11)
    start, rows = dt.datetime(2026, 1, 1, 9, 30), []
    for symbol, n in (("M", 9000), ("A", 9000), ("B", 40)):
        price = 100.0
        for i in range(n):
            price *= 1 + rng.gauss(0, 0.001)
            if symbol == "M" or rng.random() < 0.9:
                rows.append((symbol, start + dt.timedelta(minutes=i), price))
    panel = spark.createDataFrame(rows, "symbol string, session_date timestamp_ntz, adjusted_close double")
    found = lambda **how: {(r["symbol"], r["session_date"]): (r["beta"], r["n_joint"]) for r in returns.rolling_betas(panel, "M", **how).collect()}
    one, blocks = found(), found(period="hour")
    assert set(one) == set(blocks) and len(one) > 7000
    for key, (beta, n) in one.items():
        assert blocks[key][1] == n and (blocks[key][0] is None) == (beta is None)
        assert beta is None or round(blocks[key][0], 6) == round(beta, 6)
    plan = returns.rolling_betas(panel, "M", period="hour")._jdf.queryExecution().optimizedPlan().toString()
    assert "_block" in plan

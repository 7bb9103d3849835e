"""Panels, returns, forward evaluation, providers, store and journal on small inputs."""

import datetime as dt

import pytest
from panelforge.functions import news
from panelforge.operators import metrics, prices, returns
from panelforge.plans import demo, pipeline
from panelforge.sources import journal, providers, store
from pyspark.sql import functions as F

DAY = dt.date(2026, 1, 1)


def panel_of(spark, series, days=None):
    rows = [(s, (days or {}).get(s, [DAY + dt.timedelta(i) for i in range(len(v))])[i], float(p)) for s, v in series.items() for i, p in enumerate(v)]
    return spark.createDataFrame(rows, "symbol string, session_date date, adjusted_close double")


def at(day, hour=0):
    return dt.datetime(2026, 1, day, hour)


def snapshots_of(spark, rows):
    names = "id int, ticker string, created_at timestamp_ntz, horizon_days int, classification string, sector_proxy string"
    return spark.createDataFrame(rows, names)


@pytest.fixture(scope="module")
def lab(spark):
    return pipeline.validation_lab(providers.get_price_provider(spark), spark)


def test_demo_result(lab):
    groups = {r["classification"]: r for r in lab["groups"].collect()}
    assert set(groups) == {"Avoid", "Avoid Chase", "Tradeable"}
    best = groups["Tradeable"]
    assert (best["sample_size"], best["trade_hit_rate"], round(best["base_rate"], 9), round(best["excess_trade_hit_rate"], 9)) == (1, 1.0, 0.4, 0.6)
    summary = lab["summary"].first()
    assert (summary["sample_size"], summary["false_positives"], summary["false_negatives"], summary["avoid_chase_count"]) == (3, 0, 1, 1)
    assert round(summary["median_forward_abnormal_return"], 6) == 0.0875


def test_demo_outcomes_and_provenance(lab):
    rows = {r["ticker"]: r for r in lab["outcomes"].collect()}
    assert round(rows["UAL"]["max_drawdown"], 9) == -0.06 and rows["UAL"]["avoided_bad_trade"] and rows["UAL"]["trade_hit"] is None
    assert rows["CRWD"]["false_negative"] and rows["NVDA"]["data_quality_flags"] == ["beta_fallback_used"]
    assert rows["NVDA"]["price_source"] == "demo" and rows["NVDA"]["price_actual_end"] == "2026-01-16T00:00:00" and "hit" not in lab["outcomes"].columns
    assert {r["ticker"]: round(r["forward_abnormal_return"], 4) for r in lab["universe_cohort"].collect()} == {"NVDA": 0.0875, "UAL": -0.0495, "CRWD": 0.165, "MSFT": -0.005, "DAL": -0.017}


def test_missing_required_symbol_is_an_error_and_optional_shrinks_the_cohort(spark):
    panel = demo.demo_panel(spark)
    with pytest.raises(ValueError, match="missing required price history"):
        pipeline.validation_lab(providers.PanelProvider(panel.where("symbol <> 'SPY'")), spark)
    small = pipeline.validation_lab(providers.PanelProvider(panel.where("symbol <> 'DAL'")), spark)
    assert {r["base_rate"] for r in small["groups"].collect()} == {0.5}


def test_raw_return_and_backward_return(spark):
    market = prices.Market(panel_of(spark, {"A": [100, 110, 121], "M": [1, 1, 1]}, {"A": [DAY, DAY + dt.timedelta(1), DAY + dt.timedelta(5)]}), "M")
    keys = spark.createDataFrame([("A", DAY, dt.date(2026, 1, 6)), ("A", dt.date(2026, 1, 3), dt.date(2026, 1, 4)), ("A", dt.date(2026, 2, 1), dt.date(2026, 2, 2)), ("Z", DAY, DAY), ("A", DAY, None)], "ticker string, s date, e date")
    found = {(r["ticker"], r["s"], r["e"]): r["r"] for r in returns.raw_returns(keys, market, "ticker", "s", "e", "r").collect()}
    assert round(found["A", DAY, dt.date(2026, 1, 6)], 9) == 0.21
    assert round(found["A", dt.date(2026, 1, 3), dt.date(2026, 1, 4)], 9) == round(110 / 121 - 1, 9)
    assert found["A", dt.date(2026, 2, 1), dt.date(2026, 2, 2)] is None and found["Z", DAY, DAY] is None and found["A", DAY, None] is None


def test_beta_is_two_and_never_looks_ahead(spark):
    market, ticker = [100.0], [100.0]
    for i in range(69):
        move = [0.01, -0.005, 0.02, 0.0][i % 4]
        market.append(market[-1] * (1 + move))
        ticker.append(ticker[-1] * (1 + (2 if i < 45 else 16) * move))
    made = prices.Market(panel_of(spark, {"T": ticker, "M": market}), "M", lookback=40)
    keys = spark.createDataFrame([("T", None, DAY + dt.timedelta(45), DAY + dt.timedelta(50)), ("T", None, DAY + dt.timedelta(20), DAY + dt.timedelta(22))], "ticker string, sector_proxy string, start_day date, end_day date")
    rows = {r["start_day"]: r for r in returns.abnormal_returns(keys, made).collect()}
    late, early = rows[DAY + dt.timedelta(45)], rows[DAY + dt.timedelta(20)]
    assert round(late["beta"], 9) == 2 and not late["beta_fallback_used"] and late["data_quality_flag"] == "ok"
    assert early["beta"] == 1 and early["beta_fallback_used"] and early["data_quality_flag"] == "beta_fallback_used"


def test_constant_benchmark_falls_back(spark):
    made = prices.Market(panel_of(spark, {"T": [100 + i % 3 for i in range(60)], "M": [37.1] * 60}), "M")
    keys = spark.createDataFrame([("T", "S", DAY + dt.timedelta(50), DAY + dt.timedelta(52))], "ticker string, sector_proxy string, start_day date, end_day date")
    row = returns.abnormal_returns(keys, made).first()
    assert row["beta"] == 1 and row["data_quality_flag"] == "beta_fallback_used,missing_sector_proxy" and row["combined_abnormal_return"] == row["beta_adjusted_abnormal_return"]


def test_forward_evaluation_statuses(spark):
    panel = panel_of(spark, {"T": [100 + i for i in range(8)], "M": [50] * 8})
    rows = [(1, "T", at(1), 5, "Tradeable", ""), (2, "T", at(1), 20, "Watch", None), (3, "Z", at(1), 1, "Avoid", None), (4, "T", at(3, 12), 1, "Other", None)]
    out = {r["id"]: r for r in pipeline.evaluate_forward(snapshots_of(spark, rows), prices.Market(panel, "M")).collect()}
    assert out[1]["horizon_end"] == dt.date(2026, 1, 6) and round(out[1]["forward_return"], 9) == 0.05 and out[1]["trade_hit"] and out[1]["false_negative"] is False and out[1]["avoided_bad_trade"] is None
    assert (out[2]["status"], out[3]["status"], out[4]["status"]) == ("insufficient_calendar", "missing_prices", "matured")
    # Created after midnight: the price of the next day counts, and the horizon is the session after the day.
    assert out[4]["horizon_end"] == dt.date(2026, 1, 4) and out[4]["forward_return"] == 0 and out[4]["trade_hit"] is None
    pending = pipeline.evaluate_forward(snapshots_of(spark, rows[:1]), prices.Market(panel, "M"), as_of=F.lit("2026-01-05")).first()
    assert pending["status"] == "pending" and not pending["is_matured"] and pending["forward_return"] is None
    with pytest.raises(Exception, match="missing_prices|insufficient_calendar"):
        pipeline.evaluate_forward(snapshots_of(spark, rows), prices.Market(panel, "M"), strict=True).collect()


def test_horizon_uses_the_benchmark_sessions(spark):
    days = [dt.date(2026, 1, 2), dt.date(2026, 1, 5), dt.date(2026, 1, 6)]
    made = prices.Market(panel_of(spark, {"T": [100, 110], "M": [1, 1, 1]}, {"T": [days[0], days[2]], "M": days}), "M")
    keys = spark.createDataFrame([(days[0], 1), (dt.date(2026, 1, 3), 1), (dt.date(2025, 12, 1), 2), (days[2], 1)], "created_day date, horizon_days int")
    assert [r["horizon_end"] for r in made.horizon_end(keys).orderBy("created_day").collect()] == [days[1], days[1], days[1], None]


def test_group_metrics_and_base_rate_scope(spark):
    rows = [
        (5, "Tradeable", at(1), 0.05, True, True, None, None, False), (5, "Tradeable", at(1), -0.02, True, False, None, None, False), (5, "Watch", at(1), 0.01, True, None, True, None, False),
        (5, "Avoid Chase", at(1), 0.04, True, None, None, False, True), (5, "Avoid", at(1), -0.03, True, None, None, True, False), (5, "Avoid", at(1), None, True, None, None, None, None), (5, "Tradeable", at(1), 0.5, False, True, None, None, False),
    ]
    names = "horizon_days int, classification string, created_at timestamp_ntz, forward_abnormal_return double, is_matured boolean, trade_hit boolean, watch_followthrough boolean, avoided_bad_trade boolean, false_negative boolean"
    records = spark.createDataFrame(rows, names)
    cohort = spark.createDataFrame([(at(1), 5, 0.1), (at(1), 5, -0.1), (at(1), 20, 0.1), (at(2), 5, 0.1), (at(1), 5, None)], "created_at timestamp_ntz, horizon_days int, forward_abnormal_return double")
    groups = {r["classification"]: r for r in metrics.group_metrics(records, cohort).collect()}
    best = groups["Tradeable"]
    assert (best["sample_size"], best["trade_hit_rate"], best["base_rate"], best["excess_trade_hit_rate"]) == (2, 0.5, 0.5, 0.0)
    summary = metrics.summary_metrics(records).first()
    assert (summary["sample_size"], summary["sample_positive_rate"], summary["false_positives"], summary["false_negatives"], summary["avoid_chase_count"]) == (5, 0.6, 1, 1, 1)
    assert {r["base_rate"] for r in metrics.group_metrics(records, cohort.limit(0)).collect()} == {None}


# Providers

DIRTY = "symbol,date,adjusted_close\n dirty ,2026-01-05,30.0\nDIRTY,2026-01-01,10.0\nDIRTY,2026-01-02,20.0\nDIRTY,2026-01-02,25.0\nDIRTY,2026-01-03,\nDIRTY,2026-01-06T00:00:00+00:00,40.0\nDIRTY,01/07/2026,50.0\nDIRTY,2026-01-02,\n"


def test_csv_provider(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text(DIRTY)
    bundle = providers.CSVProvider(spark, str(path)).get_history(["Dirty", " dirty", "ZZZ"], "2026-01-01", "2026-01-31").validate()
    rows = bundle.prices.orderBy("session_date").collect()
    assert [(r["session_date"].day, r["adjusted_close"]) for r in rows] == [(1, 10.0), (2, 25.0), (5, 30.0), (6, 40.0), (7, 50.0)]
    assert [r["symbol"] for r in bundle.missing.collect()] == ["ZZZ"] and bundle.metadata.count() == 2
    assert providers.CSVProvider(spark, str(path)).get_history(["DIRTY"], "2026-01-05", "2026-01-06T12:00:00").prices.count() == 2
    path.write_text("symbol,date,close\nA,2026-01-01,1\n")
    with pytest.raises(ValueError, match="missing required columns"):
        providers.CSVProvider(spark, str(path)).load()


class Counting(providers.PanelProvider):
    calls: list

    def get_history(self, symbols, start, end):
        self.calls.append(list(symbols))
        return super().get_history(symbols, start, end)


def test_cache_fetches_only_misses(spark, tmp_path):
    inner = Counting(demo.demo_panel(spark))
    inner.calls = []
    cache = providers.CachingProvider(inner, spark, str(tmp_path / "c"), "snap")
    first = cache.get_history(["NVDA", "NONE"], "2026-01-01", "2026-01-09").prices.count()
    assert cache.get_history(["nvda", "UAL", "NONE"], "2026-01-01", "2026-01-09").prices.count() == 2 * first
    cache.get_history(["NVDA"], "2026-01-01", "2026-01-08")
    providers.CachingProvider(inner, spark, str(tmp_path / "c"), "other").get_history(["NVDA"], "2026-01-01", "2026-01-09")
    assert inner.calls == [["NVDA", "NONE"], ["UAL", "NONE"], ["NVDA"], ["NVDA"]]


def test_bundle_invariants_and_factory(spark):
    bundle = providers.get_price_provider(spark).get_history(["SPY"], DAY, "2026-01-31")
    with pytest.raises(ValueError, match="mixes price sources"):
        providers.PriceBundle(bundle.prices, bundle.metadata, "other", bundle.adjustment).validate()
    with pytest.raises(ValueError, match="mixes price adjustments"):
        providers.PriceBundle(bundle.prices, bundle.metadata, bundle.source, "other").validate()
    for name in ("nope", "csv", "eod"):
        with pytest.raises(ValueError):
            providers.get_price_provider(spark, name)
    asked = []

    def fetch(symbols, start, end):
        asked.append((symbols, start, end))
        return [("A", DAY, 1.5), ("A", DAY + dt.timedelta(1), None)]

    found = providers.recent_prices(providers.get_price_provider(spark, "eod", fetch=fetch), ["a"], "2026-01-10")
    assert found.count() == 1 and asked[0][2] == dt.date(2026, 1, 11) and (asked[0][2] - asked[0][1]).days == 181


# Store and journal


def test_store_appends_and_upserts(spark, tmp_path):
    own = store.SignalStore(spark, str(tmp_path / "s"))
    names = "ticker string, created_at timestamp_ntz, horizon_days int, classification string, score double, theme string, benchmark string, sector_proxy string, price_at_creation double, rule_version string"
    row = lambda t, d: (t, at(d), 5, "Watch", 1.0, "x", "SPY", None, 2.0, "rules.v1")
    own.insert(spark.createDataFrame([row(" b ", 2), row("a", 1)], names))
    own.insert(spark.createDataFrame([row("c", 1)], names))
    rows = own.snapshots().orderBy("id").collect()
    assert [(r["id"], r["ticker"], r["sector_proxy"]) for r in rows] == [(1, "A", ""), (2, "B", ""), (3, "C", "")]
    out = "signal_id long, forward_return double, is_matured boolean, trade_hit boolean"
    own.upsert(spark.createDataFrame([(1, 0.1, True, True), (2, 0.2, False, None)], out))
    own.upsert(spark.createDataFrame([(1, None, True, None)], out))
    kept = {r["signal_id"]: r for r in own.outcomes().collect()}
    assert kept[1]["forward_return"] is None and kept[1]["trade_hit"] is None and kept[2]["forward_return"] == 0.2
    assert store.snapshots_with_outcomes(own.snapshots(), own.outcomes()).count() == 3
    assert [r["id"] for r in store.matured_records(own.snapshots(), own.outcomes()).collect()] == [1]
    with pytest.raises(Exception, match="Unsupported horizon"):
        own.insert(spark.createDataFrame([("a", at(1), 4, "Watch", 1.0, "x", "SPY", None, 2.0, "r")], names))


def test_journal_round_trip(spark, tmp_path):
    path = str(tmp_path / "j")
    assert journal.load_records(spark, path).count() == 0
    df = spark.createDataFrame([("NVDA", "wait", "é")], "ticker string, verdict string, note string")
    journal.append_records(journal.encode_records(df, F.struct("ticker", "note"), F.struct("verdict"), F.lit("2026-01-01T00:00:00+00:00")), path)
    (tmp_path / "j" / "more.txt").write_text('{"saved_at": "x"}\n{bad\n\n   \n5\n')
    records = journal.load_records(spark, path)
    assert records.count() == 3 and any("é" in r["value"] for r in records.collect())
    assert sorted(tuple(r) for r in journal.journal_view(records).collect()) == [("", "", ""), ("2026-01-01T00:00:00+00:00", "NVDA", "wait"), ("x", "", "")]


def test_news_shapes(spark):
    raw = """[{"title": "A", "publisher": "P", "link": "l", "providerPublishTime": 1760000000}, {"content": {"title": "B", "provider": {"displayName": "D"}, "canonicalUrl": {"url": "u"}, "pubDate": " 2026-01-01 "}}, {}, "text", {"title": "", "providerPublishTime": true}]"""
    df = spark.createDataFrame([(1, raw), (2, "{}"), (3, None), (4, "no json"), (5, "[]")], "id int, raw string")
    out = news.normalise_news(df, carry=["id"])
    assert [tuple(r)[2:] for r in out.orderBy("position").collect()] == [("A", "P", "l", "2025-10-09T08:53:20+00:00"), ("B", "D", "u", "2026-01-01"), (None,) * 4, (None,) * 4]
    assert news.summarise(out, "id", lambda prompt: prompt.splitlines()[-2:]) == {1: ["- A", "- B"]}

"""The registered queries: each operator over the sample tables, with an independent DuckDB statement.

Numbers that come from averages are rounded to six places on both sides.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from panelforge.functions import news, pretrade, rules, scalars
from panelforge.operators import extras, metrics, prices, returns, snapshot
from panelforge.sources import journal, log, providers, results, store
from panelforge.sources.shared import fresh_path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import adapter, pipeline
from . import sql as Q

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = steady(sql)
        return function

    return register


#: Added before rounding on both sides: values that end in an exact half of the last place are then not decided by how
#: each engine rounds halves.
SHIFT = 3e-8


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(F.col(c) + SHIFT, 6).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def steady(sql: str) -> str:
    """The statement with SHIFT added in each round(..., 6)."""
    out = []
    for found in re.finditer(r"\bround\(", sql):
        depth, end = 1, found.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        if sql[:end].endswith(", 6)"):
            out.append((end - 4, f" + {SHIFT}"))
    for place, text in reversed(out):
        sql = sql[:place] + text + sql[place:]
    return sql


def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct look-ups of all signals, with the end of their horizons."""
    own = adapter.signals(spark, sf_dir).select("ticker", "sector_proxy", F.to_date("created_at").alias("created_day"), prices.after_day(F.col("created_at")).alias("start_day"), "horizon_days").distinct()
    return adapter.market(spark, sf_dir).horizon_end(own).withColumnRenamed("horizon_end", "end_day")


def evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    market = adapter.market(spark, sf_dir)
    return pipeline.evaluate_forward(pipeline.generate_signals(adapter.signals(spark, sf_dir), market), market)


def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    dates = adapter.signals(spark, sf_dir).select("created_at", "horizon_days")
    return pipeline.universe_cohort(adapter.nations(spark, sf_dir).drop("n_nationkey"), dates, adapter.market(spark, sf_dir))


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The partials of the cohort's base rates on all dates of the signals."""
    dates = adapter.signals(spark, sf_dir).select("created_at", "horizon_days")
    return pipeline.cohort_counts(adapter.nations(spark, sf_dir).drop("n_nationkey"), dates, adapter.market(spark, sf_dir))


# Panels


@query(Q.WITH_PANEL + "SELECT symbol, session_date, round(p, 6) AS adjusted_close FROM panel")
def d1_price_panel(spark, sf_dir):
    return rounded(adapter.universe(spark, sf_dir))


@query(Q.NORMALISE)
def p1_normalize_prices(spark, sf_dir):
    return prices.normalise(extras.messy_prices(adapter.table(spark, sf_dir, "events")))


@query(Q.WITH_PANEL + "SELECT symbol, session_date, round(p, 6) AS adjusted_close FROM panel WHERE session_date BETWEEN DATE '1996-03-01' AND DATE '1996-06-30'")
def p2_window_slice(spark, sf_dir):
    return rounded(prices.window_slice(adapter.universe(spark, sf_dir), "1996-03-01", "1996-06-30"))


@query(Q.WITH_PANEL + Q.COVERAGE)
def p4_coverage_metadata(spark, sf_dir):
    wanted = prices.requested(spark, [" france", "Germany ", "MKT", "FRANCE", "nowhere"])
    return prices.coverage(adapter.universe(spark, sf_dir), wanted)


@query(Q.WITH_PANEL + Q.MISSING)
def j12_missing_symbols(spark, sf_dir):
    return prices.missing_symbols(adapter.universe(spark, sf_dir), prices.requested(spark, ["nowhere", "FRANCE", "ATLANTIS", "MKT"]))


@query(Q.WITH_PANEL + Q.REQUIRED)
def j13_required_missing(spark, sf_dir):
    wanted = prices.requested(spark, ["nowhere", "FRANCE", "ATLANTIS", "MKT"])
    required = spark.createDataFrame([("FRANCE",), ("ATLANTIS",)], "symbol string")
    return prices.missing_symbols(adapter.universe(spark, sf_dir), wanted).join(required, "symbol", "left_semi").select("symbol")


@query(Q.WITH_RETURNS + "SELECT symbol, session_date, round(p, 6) AS adjusted_close, round(ret, 6) AS ret FROM rets")
def w1_simple_returns(spark, sf_dir):
    return rounded(prices.simple_returns(adapter.universe(spark, sf_dir)))


@query(Q.WITH_PANEL + "SELECT session_date, CAST(ord AS INTEGER) AS ord FROM cal")
def d16_session_calendar(spark, sf_dir):
    return prices.session_calendar(adapter.universe(spark, sf_dir), adapter.BENCHMARK)


# As-of look-ups and returns


@query(Q.WITH_KEYS + "SELECT ticker, sector_proxy, created_day, horizon_days, end_day AS horizon_end FROM keys")
def j6_horizon_end(spark, sf_dir):
    return keys(spark, sf_dir).select("ticker", "sector_proxy", "created_day", "horizon_days", F.col("end_day").alias("horizon_end"))


@query(Q.WITH_KEYS + Q.ASOF_AFTER)
def j4_asof_on_after(spark, sf_dir):
    market = adapter.market(spark, sf_dir)
    found = market.read(keys(spark, sf_dir), "ticker", lambda own: {"price": own.on_or_after(market.place(F.col("start_day")))})
    return rounded(found.select("ticker", "created_day", "price").distinct())


@query(Q.WITH_KEYS + Q.ASOF_BEFORE)
def j5_asof_on_before(spark, sf_dir):
    market = adapter.market(spark, sf_dir)
    found = market.read(keys(spark, sf_dir), "ticker", lambda own: {"price": own.on_or_before(market.place(F.col("end_day")))})
    return rounded(found.select("ticker", "end_day", "price").distinct())


@query(Q.WITH_KEYS + Q.RAW_RETURN)
def a1_raw_return(spark, sf_dir):
    found = returns.raw_returns(keys(spark, sf_dir), adapter.market(spark, sf_dir), "ticker", "start_day", "end_day", "raw_return")
    return rounded(found.select("ticker", "created_day", "horizon_days", "raw_return"))


@query(Q.WITH_BETAS + "SELECT symbol, session_date, round(beta, 6) AS beta, n_joint FROM betas")
def a2_rolling_beta(spark, sf_dir):
    return rounded(returns.rolling_betas(adapter.universe(spark, sf_dir), adapter.BENCHMARK))


@query(Q.WITH_RECORDS + Q.RECORDS)
def a3_abnormal_return(spark, sf_dir):
    found = returns.abnormal_returns(keys(spark, sf_dir), adapter.market(spark, sf_dir))
    return rounded(found.select("ticker", "sector_proxy", "created_day", "horizon_days", *pipeline.RECORD))


@query(Q.WITH_KEYS + Q.DRAWDOWN)
def a4_drawdown_runup(spark, sf_dir):
    found = returns.drawdown_runup(keys(spark, sf_dir), adapter.market(spark, sf_dir))
    return rounded(found.select("ticker", "created_day", "horizon_days", "max_drawdown", "max_runup"))


@query(Q.WITH_RECORDS + "SELECT ticker, created_day, horizon_days, round(raw_return - market_return, 6) AS market_adjusted_return FROM records SEMI JOIN wanted USING (ticker, created_day, horizon_days)")
def v2_market_adjusted(spark, sf_dir):
    found = returns.abnormal_returns(keys(spark, sf_dir), adapter.market(spark, sf_dir))
    return rounded(found.select("ticker", "created_day", "horizon_days", (F.col("raw_return") - F.col("market_return")).alias("market_adjusted_return")))


# Rule tables


@query(Q.WITH_EVENTS + "SELECT id, round(event_ar, 6) AS event_abnormal_return, label AS reaction_label FROM reactions")
def f5_event_reaction(spark, sf_dir):
    found = pipeline.generate_signals(adapter.signals(spark, sf_dir), adapter.market(spark, sf_dir))
    return rounded(found.select("id", "event_abnormal_return", "reaction_label"))


@query(Q.REACTION_TABLE)
def f5_reaction_table(spark, sf_dir):
    grid = extras.reaction_grid(spark)
    made = rules.event_reaction(F.col("news"), F.col("ar"), F.col("present"), F.col("granularity"), basket_evidence=F.col("basket"))
    return grid.select("news", "ar", "present", "granularity", "basket", made.alias("r")).select("news", "ar", "present", "granularity", "basket", "r.label", "r.causal_claim", "r.reason")


@query(Q.WITH_EVENTS + "SELECT id, classification, score, 'rules.v1' AS rule_version FROM classes")
def f8_classify_signal(spark, sf_dir):
    found = pipeline.generate_signals(adapter.signals(spark, sf_dir), adapter.market(spark, sf_dir))
    return found.select("id", "classification", "score", "rule_version")


@query(Q.CLASS_TABLE)
def f8_class_table(spark, sf_dir):
    grid = extras.class_grid(spark)
    made = rules.signal_class(F.col("news"), F.col("reaction"), F.col("extended"), F.col("setup"), F.col("volume"))
    return grid.select("*", made.alias("r")).select("news", "reaction", "extended", "setup", "volume", "r.classification", "r.score", "r.reason")


@query(Q.OVEREXTENDED)
def f10_overextended(spark, sf_dir):
    grid = extras.extension_grid(spark)
    return grid.select("flag", "rsi", "return_20d", rules.overextended(F.col("flag"), F.col("rsi"), F.col("return_20d")).alias("overextended"))


@query(Q.OUTCOME_TABLE)
def f11_outcome_semantics(spark, sf_dir):
    grid = extras.outcome_grid(spark)
    return grid.select("classification", "ar", rules.outcome(F.col("classification"), F.col("ar")).alias("o")).select("classification", "ar", "o.*")


@query(Q.SENTIMENTS)
def f6_f7_sentiment(spark, sf_dir):
    words = spark.createDataFrame([(w,) for w in extras.SENTIMENT_WORDS], "word string")
    return words.select("word", rules.event_sentiment(F.col("word")).alias("event_sentiment"), rules.signal_sentiment(F.col("word")).alias("signal_sentiment"))


@query(Q.HORIZONS)
def p9_p10_horizons(spark, sf_dir):
    found = adapter.table(spark, sf_dir, "part").select((F.col("p_size") * 1).cast("int").alias("horizon")).distinct()
    return found.select("horizon", rules.horizon_known(F.col("horizon")).alias("known"), rules.horizon_label(F.col("horizon")).alias("label"))


@query(Q.DEFAULT_HORIZONS)
def p11_default_horizons(spark, sf_dir):
    types = spark.createDataFrame([(t,) for t in [*rules.DEFAULT_HORIZONS, *rules.MORE_DEFAULT_HORIZONS, "other"]], "signal_type string")
    return types.select("signal_type", F.explode_outer(rules.default_horizons(F.col("signal_type"), more=True)).alias("horizon_days"))


@query(Q.WITH_SIGNALS + Q.PROXIES)
def j10_theme_proxy(spark, sf_dir):
    return adapter.signals(spark, sf_dir).select("id", "theme", rules.theme_proxy(F.col("theme")).alias("proxy"))


# Forward evaluation, store and metrics


@query(Q.WITH_OUTCOMES + "SELECT id, status, is_matured, horizon_end, round(forward_return, 6) AS forward_return, round(far, 6) AS forward_abnormal_return, round(max_drawdown, 6) AS max_drawdown, round(max_runup, 6) AS max_runup, data_quality_flag, trade_hit, watch_followthrough, avoided_bad_trade, false_negative FROM outcomes")
def q1_forward_evaluation(spark, sf_dir):
    columns = ["id", "status", "is_matured", "horizon_end", "forward_return", "forward_abnormal_return", "max_drawdown", "max_runup", "data_quality_flag", "trade_hit", "watch_followthrough", "avoided_bad_trade", "false_negative"]
    return rounded(evaluated(spark, sf_dir).select(columns))


@query(Q.WITH_OUTCOMES + Q.AS_OF)
def p7_maturity(spark, sf_dir):
    market = adapter.market(spark, sf_dir)
    signals = adapter.signals(spark, sf_dir).withColumn("classification", F.lit("Watch"))
    return pipeline.evaluate_forward(signals, market, as_of=F.lit("1998-06-30")).groupBy("status").agg(F.count("*").alias("n"))


@query(Q.WITH_EVENTS + Q.SNAPSHOTS)
def q3_record_signals(spark, sf_dir):
    found = pipeline.generate_signals(adapter.signals(spark, sf_dir), adapter.market(spark, sf_dir))
    stored = store.canonical_snapshots(found)
    return rounded(stored.select("id", "ticker", "created_at", "horizon_days", "classification", "score", "theme", "benchmark", "sector_proxy", "price_at_creation", "rule_version"))


def _stored(spark, sf_dir):
    """Snapshots, and the outcomes of those whose class asks for one, so that the others have none."""
    own = evaluated(spark, sf_dir)
    outcomes = own.where("classification <> 'Avoid'").select(F.col("id").alias("signal_id"), "is_matured", "forward_return", "forward_abnormal_return", "trade_hit")
    return own.select("id", "ticker", "created_at", "horizon_days", "classification"), outcomes


@query(Q.WITH_OUTCOMES + "SELECT o.id, ticker, created_at, horizon_days, o.classification, e.is_matured, round(e.forward_return, 6) AS forward_return, round(e.far, 6) AS forward_abnormal_return, e.trade_hit FROM outcomes o LEFT JOIN (SELECT * FROM (SELECT id, is_matured, forward_return, far, trade_hit, classification FROM outcomes) WHERE classification <> 'Avoid') e ON o.id = e.id")
def j1_snapshot_left_outcome(spark, sf_dir):
    return rounded(store.snapshots_with_outcomes(*_stored(spark, sf_dir)))


@query(Q.WITH_OUTCOMES + "SELECT id, ticker, created_at, horizon_days, classification, is_matured, round(forward_return, 6) AS forward_return, round(far, 6) AS forward_abnormal_return, trade_hit FROM outcomes WHERE classification <> 'Avoid' AND is_matured")
def j2_matured_records(spark, sf_dir):
    return rounded(store.matured_records(*_stored(spark, sf_dir)))


@query(Q.UPSERT)
def s13_latest_outcome_upsert(spark, sf_dir):
    lines = adapter.table(spark, sf_dir, "lineitem")
    batches = lines.select(F.col("l_orderkey").alias("signal_id"), F.col("l_linenumber").alias("batch_seq"), F.col("l_discount").alias("forward_return"), (F.col("l_returnflag") == "R").alias("hit"))
    # A batch has a signal once.
    batches = batches.groupBy("signal_id", "batch_seq").agg(F.min("forward_return").alias("forward_return"), F.min("hit").alias("hit"))
    return store.latest_outcomes(batches)


@query(Q.UPSERT)
def s13_outcome_log(spark, sf_dir):
    """The same batches through the log: upserts one by one, compacted on the way, and read back."""
    lines = adapter.table(spark, sf_dir, "lineitem")
    rows = lines.groupBy(F.col("l_orderkey").alias("signal_id"), "l_linenumber").agg(F.min("l_discount").alias("forward_return"), F.min(F.col("l_returnflag") == "R").alias("hit"))
    own = log.LatestLog(spark, fresh_path(spark, "log"), "signal_id bigint, forward_return double, hit boolean", "signal_id", buckets=8, batches=3)
    for number in range(1, 8):  # an order has seven lines at most
        own.append(rows.where(F.col("l_linenumber") == number))
    return own.read()


@query(Q.WITH_OUTCOMES + Q.PROVENANCE)
def j14_provenance(spark, sf_dir):
    market = adapter.market(spark, sf_dir)
    wanted = market.panel.select("symbol").distinct().where("symbol <> 'FRANCE'")
    metadata = prices.coverage(market.panel, wanted).select("symbol", F.lit("lines").alias("source"), F.lit("average").alias("adjustment"), "actual_start", "actual_end", F.array(F.lit("sampled")).alias("data_quality_flags"))
    found = store.provenance(evaluated(spark, sf_dir).select("id", "ticker", "data_quality_flag"), metadata, "bundle", "none")
    return found.select("id", "price_source", "price_adjustment", "price_actual_start", "price_actual_end", F.array_join("data_quality_flags", ",").alias("flags"))


@query(Q.WITH_COHORT + "SELECT ticker, created_at, horizon_days, round(far, 6) AS forward_abnormal_return FROM cohort")
def q4_universe_cohort(spark, sf_dir):
    return rounded(cohort(spark, sf_dir))


@query(Q.WITH_GROUPS + "SELECT horizon_days, classification, round(base_rate, 6) AS base_rate FROM base")
def j11_base_rate(spark, sf_dir):
    return rounded(metrics.base_rates(metrics.matured(evaluated(spark, sf_dir)), counts(spark, sf_dir)))


@query(Q.WITH_GROUPS + Q.GROUPS)
def a5_group_metrics(spark, sf_dir):
    return rounded(metrics.group_metrics(evaluated(spark, sf_dir), counts(spark, sf_dir)))


@query(Q.WITH_OUTCOMES + "SELECT 'all' AS run_id, id, ticker, horizon_days, classification, status, horizon_end, round(forward_return, 6) AS forward_return, round(far, 6) AS forward_abnormal_return, trade_hit FROM outcomes")
def v17_stored_outcomes(spark, sf_dir):
    """Outcomes written by run and horizon, some horizons twice, and read again."""
    tables = results.ResultTables(spark, fresh_path(spark, "results"))
    own = evaluated(spark, sf_dir)
    tables.write("outcomes", "all", own)
    tables.write("outcomes", "other", own.where("horizon_days = 1"))
    tables.write("outcomes", "all", own.where("horizon_days in (1, 5)"))
    columns = ["run_id", "id", "ticker", "horizon_days", "classification", "status", "horizon_end", "forward_return", "forward_abnormal_return", "trade_hit"]
    return rounded(tables.read("outcomes", "all").select(columns))


@query(Q.WITH_OUTCOMES + Q.SUMMARY)
def a6_summary_metrics(spark, sf_dir):
    return rounded(metrics.summary_metrics(evaluated(spark, sf_dir)))


@query(Q.WITH_OUTCOMES + Q.VALIDATION)
def v13_validation_metrics(spark, sf_dir):
    return rounded(metrics.validation_metrics(evaluated(spark, sf_dir), ["horizon_days", "theme", "ticker"]))


@query(Q.WITH_OUTCOMES + Q.HIT_RATE)
def v12_hit_rate(spark, sf_dir):
    return rounded(extras.hit_rates(evaluated(spark, sf_dir)))


@query(Q.WITH_OUTCOMES + Q.FLAGGED)
def p19_flagged_tickers(spark, sf_dir):
    return evaluated(spark, sf_dir).agg(F.array_join(F.array_sort(F.collect_set(F.when(F.col("beta_fallback_used"), F.col("ticker")))), ", ").alias("flagged"))


@query(Q.WITH_GROUPS + Q.CHART)
def p17_p18_excess_chart(spark, sf_dir):
    groups = metrics.group_metrics(evaluated(spark, sf_dir), counts(spark, sf_dir)).where("excess_trade_hit_rate is not null")
    return rounded(groups.select("horizon_days", "classification", (F.col("excess_trade_hit_rate") * 100).alias("excess_hit_rate_pct"), scalars.percent(F.col("trade_hit_rate")).alias("label")))


@query(Q.WITH_GROUPS + Q.FIRST_GROUP)
def p15_first_group(spark, sf_dir):
    groups = metrics.group_metrics(evaluated(spark, sf_dir), counts(spark, sf_dir))
    return rounded(groups.where("classification = 'Avoid Chase'").orderBy("horizon_days").limit(1).select("horizon_days", "avoided_bad_trade_rate"))


# Extras of the extended rule set


@query(Q.WITH_CALENDAR + Q.CALENDAR_HORIZONS)
def v4_calendar_event_study(spark, sf_dir):
    found = extras.calendar_event_study(adapter.signals(spark, sf_dir), adapter.market(spark, sf_dir))
    columns = ["ticker", "created_day", "horizon_days", "raw_return", "market_adjusted_return", "beta_adjusted_abnormal_return", "sector_adjusted_abnormal_return", "combined_abnormal_return", "calculation_method"]
    return rounded(found.select(columns))


@query(Q.WITH_RECORDS + Q.METHOD)
def v3_calculation_method(spark, sf_dir):
    found = returns.abnormal_returns(keys(spark, sf_dir), adapter.market(spark, sf_dir))
    method = returns.calculation_method(F.col("raw_return"), F.col("market_return"), F.col("sector_return"))
    return found.select("ticker", "created_day", "horizon_days", method.alias("calculation_method"))


@query(Q.WITH_CALENDAR + Q.WIDE_FORWARD)
def v9_wide_forward_returns(spark, sf_dir):
    return rounded(extras.wide_forward_returns(adapter.signals(spark, sf_dir), adapter.market(spark, sf_dir)))


@query(Q.VOLUME)
def v6_volume_reaction(spark, sf_dir):
    return rounded(extras.volume_reaction(extras.daily_volume(spark, sf_dir)))


@query(Q.WITH_KEYS + Q.PEERS)
def v7_peer_basket(spark, sf_dir):
    found = returns.raw_returns(keys(spark, sf_dir), adapter.market(spark, sf_dir), "ticker", "start_day", "end_day", "raw_return")
    return rounded(found.groupBy("sector_proxy", "created_day", "horizon_days").agg(F.avg("raw_return").alias("peer_reaction")))


@query(Q.V_LABELS)
def v5_v8_labels(spark, sf_dir):
    return extras.label_grid(spark).select("*", extras.basket_label(F.col("news"), F.col("ar"), F.col("peer"), F.col("causality")).alias("label"), extras.confidence(F.col("quality"), F.col("causality")).alias("confidence"))


@query(Q.V_OUTCOMES)
def v11_outcome_rule(spark, sf_dir):
    return extras.drawdown_grid(spark).select("*", extras.drawdown_outcome(F.col("classification"), F.col("ar"), F.col("drawdown")).alias("o")).select("classification", "ar", "drawdown", "o.*")


@query(Q.THESIS)
def v15_thesis_score(spark, sf_dir):
    lists = ["evidence_for", "evidence_against", "confirmation_needed", "invalidation_signals"]
    status = [F.col("status_by_horizon")[rules.HORIZONS[h]].alias(f"status_{h}d") for h in (1, 5, 20)]
    return extras.thesis(extras.thesis_inputs(spark, sf_dir)).select("id", "score", "classification", "reason", *[F.array_join(c, "|").alias(c) for c in lists], *status)


# Rule tables over the orders


@query(Q.WITH_ORDER_INPUTS + Q.ORDER_SENTIMENTS)
def f6_f7_order_sentiments(spark, sf_dir):
    return extras.order_inputs(spark, sf_dir).select("id", rules.event_sentiment(F.col("word")).alias("event_sentiment"), rules.signal_sentiment(F.col("word")).alias("signal_sentiment"))


@query(Q.WITH_ORDER_INPUTS + Q.ORDER_EXTENDED)
def f10_order_overextended(spark, sf_dir):
    return extras.order_inputs(spark, sf_dir).select("id", rules.overextended(F.col("flag"), F.col("rsi"), F.col("return_20d")).alias("overextended"))


@query(Q.WITH_ORDER_INPUTS + Q.ORDER_OUTCOMES)
def f11_order_outcomes(spark, sf_dir):
    return extras.order_inputs(spark, sf_dir).select("id", rules.outcome(F.col("classification"), F.col("ar")).alias("o")).select("id", "o.*")


@query(Q.WITH_ORDER_INPUTS + Q.ORDER_HORIZONS)
def p11_order_horizons(spark, sf_dir):
    return extras.order_inputs(spark, sf_dir).select("id", "signal_type", F.explode_outer(rules.default_horizons(F.col("signal_type"), more=True)).alias("horizon_days"))


@query(Q.WITH_ORDER_INPUTS + Q.ORDER_LABELS)
def v5_v8_order_labels(spark, sf_dir):
    label = extras.basket_label(F.col("news"), F.col("ar"), F.col("peer"), F.col("causality"))
    return extras.order_inputs(spark, sf_dir).select("id", label.alias("label"), extras.confidence(F.col("quality"), F.col("causality")).alias("confidence"))


@query(Q.WITH_ORDER_INPUTS + Q.ORDER_DRAWDOWNS)
def v11_order_outcomes(spark, sf_dir):
    return extras.order_inputs(spark, sf_dir).select("id", extras.drawdown_outcome(F.col("classification"), F.col("ar"), F.col("drawdown")).alias("o")).select("id", "o.*")


# Snapshot and news


@query(Q.WITH_PANEL + Q.TRAILING)
def w4_trailing_returns(spark, sf_dir):
    return rounded(snapshot.ticker_metrics(adapter.universe(spark, sf_dir)))


@query(Q.WITH_PANEL + "SELECT symbol, round(arg_max(p, session_date), 6) AS latest FROM panel GROUP BY symbol")
def w5_latest_per_symbol(spark, sf_dir):
    return rounded(snapshot.latest(adapter.universe(spark, sf_dir)))


@query(Q.WITH_PANEL + "SELECT symbol, session_date, round(p, 6) AS adjusted_close FROM panel QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY session_date DESC) <= 63")
def w6_tail_63(spark, sf_dir):
    return rounded(snapshot.last_rows(adapter.universe(spark, sf_dir)))


@query(Q.WITH_PANEL + Q.MARKET)
def q6_market_snapshot(spark, sf_dir):
    wanted = prices.requested(spark, ["MKT", "FRANCE", "nowhere"]).drop("position")
    return rounded(snapshot.market_snapshot(adapter.universe(spark, sf_dir), wanted))


@query(Q.NEWS)
def x10_news_fields(spark, sf_dir):
    return news.normalise_news(extras.news_feed(spark, sf_dir), carry=["feed"])


@query(Q.HEADLINES)
def x13_headlines(spark, sf_dir):
    listed = news.headlines(news.normalise_news(extras.news_feed(spark, sf_dir), carry=["feed"]), "feed")
    return listed.select("feed", F.array_join("headlines", " / ").alias("headlines"), news.summary_prompt(F.col("headlines")).alias("prompt"))


@query("SELECT o_orderkey AS id, CAST(date_diff('day', DATE '1998-01-15', CAST(o_orderdate AS DATE)) AS INTEGER) AS days FROM orders")
def f12_days_until(spark, sf_dir):
    orders = adapter.table(spark, sf_dir, "orders")
    return orders.select(F.col("o_orderkey").alias("id"), news.days_until(F.col("o_orderdate").cast("string"), F.lit("1998-01-15")).alias("days"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.a.b') AS nested FROM events")
def x9_nested_get(spark, sf_dir):
    item = F.try_parse_json("props")
    return adapter.table(spark, sf_dir, "events").select("event_id", F.try_variant_get(item, "$.k", "bigint").alias("k"), news.field(item, "a", "b").alias("nested"))


# Pre-trade check and journal


@query(Q.WITH_DECISIONS + Q.VIOLATIONS)
def r1_decision_validation(spark, sf_dir):
    valid = pretrade.validate_decisions(adapter.decisions(spark, sf_dir))
    return valid.select("decision_id", "ticker", "status", F.array_join("violations", "|").alias("violations"))


@query(Q.WITH_FLAGS + "SELECT decision_id, " + ", ".join(Q.FLAGS) + " FROM flags")
def r3_risk_flags(spark, sf_dir):
    found = adapter.decisions(spark, sf_dir).select("decision_id", pretrade.risk_flags(F.col("decision_id") % 6 == 0).alias("f"))
    return found.select("decision_id", "f.*")


@query(Q.WITH_FLAGS + Q.ACTIVE)
def r4_active_flags(spark, sf_dir):
    found = adapter.decisions(spark, sf_dir).withColumn("f", pretrade.risk_flags(F.col("decision_id") % 6 == 0))
    return found.select("decision_id", F.array_join(pretrade.active_flags(F.col("f")), ",").alias("active"), pretrade.any_active(F.col("f")).alias("any_active"))


@query(Q.WITH_FLAGS + Q.VERDICT)
def r5_verdict(spark, sf_dir):
    found = pretrade.evaluate(adapter.decisions(spark, sf_dir), F.col("decision_id") % 6 == 0)
    return found.select("decision_id", "verdict", "heuristic_only", "not_financial_advice")


@query(Q.WITH_FLAGS + Q.REASONS)
def r6_reasons(spark, sf_dir):
    found = pretrade.evaluate(adapter.decisions(spark, sf_dir), F.col("decision_id") % 6 == 0, F.col("decision_id") % 2 == 0)
    return found.select("decision_id", F.array_join("reasons", "|").alias("reasons"))


@query(Q.WITH_DECISIONS + "SELECT decision_id, CASE WHEN max_loss > 0 AND position_size > 0 THEN round(max_loss / position_size * 100, 6) END AS implied FROM decisions")
def f13_implied_move(spark, sf_dir):
    return rounded(adapter.decisions(spark, sf_dir).select("decision_id", pretrade.implied_move().alias("implied")))


@query(Q.WITH_DECISIONS + Q.DECISION_ROWS)
def p20_decision_rows(spark, sf_dir):
    text = adapter.decisions(spark, sf_dir).withColumn("max_loss", F.col("max_loss").cast("decimal(10,1)")).withColumn("position_size", F.col("position_size").cast("int"))
    return pretrade.summary_rows(text)


@query(Q.JOURNAL)
def p16_journal_view(spark, sf_dir):
    return journal.journal_view(journal.parse_lines(extras.journal_lines(adapter.table(spark, sf_dir, "orders"))))


@query(Q.FORMATS)
def r7_formats(spark, sf_dir):
    numbers = spark.createDataFrame([(i, v) for i, v in enumerate(extras.FORMAT_NUMBERS)], "n int, v double")
    return numbers.select("n", scalars.fixed(F.col("v"), 0).alias("whole"), scalars.shortest(F.col("v")).alias("short"), scalars.percent(F.col("v") / 100).alias("pct"))


@query(Q.TEXTS)
def x1_x4_texts(spark, sf_dir):
    orders = adapter.table(spark, sf_dir, "orders")
    padded = F.concat(F.lit(" \t"), F.lower("o_orderstatus"), F.lit("\n"))
    return orders.select(F.col("o_orderkey").alias("id"), scalars.symbol(padded).alias("symbol"), scalars.iso_seconds(F.col("o_orderdate")).alias("iso"), scalars.date_key(F.col("o_orderdate")).alias("key"), scalars.path_part(F.concat(F.col("o_orderpriority"), F.lit("/é:"))).alias("part"))


@query(Q.SETS)
def u1_u2_u3_symbol_sets(spark, sf_dir):
    names = lambda where: adapter.nations(spark, sf_dir).where(where).select(F.col("ticker").alias("symbol"))
    a, b = names("n_nationkey < 15"), names("n_nationkey % 2 = 0")
    tag = lambda df, kind: df.withColumn("kind", F.lit(kind))
    return tag(a.union(b).distinct(), "union").union(tag(a.subtract(b), "difference")).union(tag(a.intersect(b), "intersection"))


def lab(spark):
    return pipeline.validation_lab(providers.get_price_provider(spark), spark)


@query(Q.WITH_LAB + Q.LAB_GROUPS)
def q5_validation_lab(spark, sf_dir):
    return rounded(metrics.in_order(lab(spark)["groups"]))


@query(Q.WITH_LAB + Q.LAB_SUMMARY)
def q8_lab_summary(spark, sf_dir):
    return rounded(lab(spark)["summary"])


@query(Q.WITH_LAB + Q.LAB_OUTCOMES)
def q7_lab_outcomes(spark, sf_dir):
    columns = ["ticker", "classification", "horizon_end", "status", "raw_return", "forward_abnormal_return", "max_drawdown", "max_runup", "beta_fallback_used", "price_source", "price_adjustment"]
    return rounded(lab(spark)["outcomes"].select(columns))


# The lab and the providers over the tables


def lab_over_tables(spark, sf_dir):
    """The lab's run over the sample tables' prices, with every order as a signal of the first session."""
    provider = providers.PanelProvider(adapter.universe(spark, sf_dir), "lines", "average")
    symbols = [r["symbol"] for r in adapter.market(spark, sf_dir).series.select("symbol").collect()]  # as many as nations and regions
    bundle = provider.get_history(symbols, "1900-01-01", "2100-01-01").validate()
    return pipeline.lab_tables(bundle, adapter.signals(spark, sf_dir), adapter.nations(spark, sf_dir).drop("n_nationkey"), adapter.BENCHMARK)


@query(Q.WITH_FIRST_DAY + Q.FIRST_DAY_GROUPS)
def q5_lab_over_tables(spark, sf_dir):
    return rounded(lab_over_tables(spark, sf_dir)["groups"])


@query(Q.WITH_FIRST_DAY + Q.FIRST_DAY_OUTCOMES)
def q7_lab_outcomes_over_tables(spark, sf_dir):
    columns = ["id", "classification", "horizon_end", "status", "forward_return", "forward_abnormal_return", "beta_fallback_used", "price_source", "price_adjustment"]
    return rounded(lab_over_tables(spark, sf_dir)["outcomes"].select(columns))


@query(Q.WITH_FIRST_DAY + Q.FIRST_DAY_SUMMARY)
def q8_lab_summary_over_tables(spark, sf_dir):
    return rounded(lab_over_tables(spark, sf_dir)["summary"])


@query(Q.WITH_PANEL + "SELECT symbol, session_date, round(p, 6) AS adjusted_close FROM panel WHERE symbol IN ('FRANCE', 'MKT') AND session_date BETWEEN DATE '1995-03-01' AND DATE '1996-02-28'")
def s7_cached_history(spark, sf_dir):
    """Two symbols of which the second request finds one in the cache, and one that has no prices."""
    cache = providers.CachingProvider(providers.PanelProvider(adapter.universe(spark, sf_dir), "lines", "average"), spark, fresh_path(spark, "cache"), "snapshot")
    cache.get_history(["france"], "1995-03-01", "1996-02-28")
    return rounded(cache.get_history(["France", "MKT", "nowhere"], "1995-03-01", "1996-02-28").prices.select("symbol", "session_date", "adjusted_close"))


# Clean series, ordered readers, displays and typed journals


def raw_series(spark, sf_dir):
    """Times of both kinds, with gaps, NaN and repeated rows."""
    events = adapter.table(spark, sf_dir, "events")
    key, moment = F.col("event_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    time = F.when(key % 4 == 0, F.concat(moment, F.lit("-05:00"))).when(key % 4 == 1, F.concat(moment, F.lit("Z"))).when(key % 4 == 2, moment).otherwise("no time")
    price = F.when(key % 7 == 0, F.lit(None)).when(key % 11 == 0, F.lit(float("nan"))).otherwise(F.col("value").cast("double"))
    rows = events.select(F.col("event_type").alias("symbol"), time.alias("time"), price.alias("price"), key.alias("event_id"))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.when(key % 10 == 0, 1).otherwise(0))))


@query(Q.WITH_SERIES + "SELECT symbol, t AS time, round(price, 6) AS price, event_id FROM series WHERE t IS NOT NULL AND price IS NOT NULL AND NOT isnan(price)")
def p6_clean_prices(spark, sf_dir):
    return rounded(prices.clean_prices(raw_series(spark, sf_dir)).drop("copy"))


@query(Q.WITH_SERIES + "SELECT symbol, time, round(price, 6) AS price, event_id FROM series WHERE price IS NOT NULL AND NOT isnan(price)")
def p21_fetched_series(spark, sf_dir):
    return rounded(prices.clean_series(raw_series(spark, sf_dir)).drop("copy"))


@query(Q.WITH_SERIES + "SELECT event_id, t AS utc FROM series")
def x6_utc_naive(spark, sf_dir):
    return raw_series(spark, sf_dir).select("event_id", scalars.utc_naive(F.col("time")).alias("utc"))


@query(Q.WITH_SERIES + Q.AVAILABLE)
def p21_available(spark, sf_dir):
    wanted = spark.createDataFrame([("click",), ("view",), ("purchase",), ("nowhere",)], "symbol string")
    return prices.available(prices.clean_series(raw_series(spark, sf_dir)), wanted)


@query(Q.MERGED)
def u5_universe_merge(spark, sf_dir):
    nation = adapter.table(spark, sf_dir, "nation")
    key, day = F.col("n_nationkey"), F.explode(F.sequence(F.lit(1), F.lit(3)))
    panel = lambda where, factor: nation.where(where).select(F.col("n_name").alias("symbol"), day.alias("d"), key).select("symbol", F.date_add(F.lit("2026-01-01").cast("date"), F.col("d")).alias("session_date"), (key * factor + F.col("d")).cast("double").alias("adjusted_close"))
    return prices.merge_universe(panel("n_nationkey < 15", 1), panel("n_nationkey % 2 = 0", 10), panel("n_nationkey % 6 = 0", 100))


@query(Q.WITH_SIGNALS + "SELECT id, ticker, created_at, horizon_days FROM signals ORDER BY created_at, id")
def o1_ordered_records(spark, sf_dir):
    return store.in_order(adapter.signals(spark, sf_dir)).select("id", "ticker", "created_at", "horizon_days")


@query(Q.WITH_SIGNALS + "SELECT ticker, theme, horizon_days, coalesce(sector_proxy, '') AS sector_proxy, created_at FROM signals")
def p12_display(spark, sf_dir):
    return store.display(store.canonical_snapshots(adapter.signals(spark, sf_dir)), store.SNAPSHOT_COLUMNS)


@query(Q.WITH_FLAGS + Q.TYPED)
def p14_typed_records(spark, sf_dir):
    made = pretrade.evaluate(adapter.decisions(spark, sf_dir).withColumn("f", pretrade.risk_flags(F.col("decision_id") % 6 == 0)), F.col("decision_id") % 6 == 0)
    decision = F.struct(*[F.col(c) for c in ("decision_id", "ticker", "event_type", "horizon_days", "max_loss", "status")], F.lit(1).alias("unknown_key"))
    lines = journal.encode_records(made, decision, F.struct("verdict", F.col("f").alias("flags"), F.lit("x").alias("more")), F.lit("2026-01-02T00:00:00"))
    typed = journal.typed_records(journal.parse_lines(lines))
    known = [F.col(f"decision.{c}").alias(c) for c in ("ticker", "event_type", "horizon_days", "max_loss", "status", "notes")]
    return typed.select("saved_at", F.col("decision.decision_id").cast("long").alias("decision_id"), *known, F.col("evaluation.verdict").alias("verdict"), "flags.high_runup", "flags.event_gamble", F.size("evaluation.reasons").alias("n_reasons"))


@query(Q.WITH_KEYS + "SELECT s.id, k.end_day AS horizon_end, k.end_day IS NOT NULL AS is_matured FROM signals s LEFT JOIN keys k USING (ticker, created_day, horizon_days)")
def stream_matured_signals(spark, sf_dir):
    """Orders as a stream, each signal with its maturity, written by one run of the stream."""
    from panelforge.streaming.maturity import matured_stream, run_once

    schema = adapter.table(spark, sf_dir, "orders").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "orders.parquet").parquet(sf_dir)
    market = adapter.market(spark, sf_dir)
    matured = matured_stream(adapter.signals_of(spark, sf_dir, stream).select("id", "created_at", "horizon_days"), market.calendar, market.sessions)
    return run_once(matured.select("id", "horizon_end", "is_matured"), fresh_path(spark, "stream"))


@query(Q.WITH_OUTCOMES + "SELECT id, status, horizon_end FROM outcomes")
def stream_tracked_maturity(spark, sf_dir):
    """Orders and line items as two streams: signals wait in state for the sessions that end their horizons."""
    from panelforge.streaming import maturity, tracker

    def stream(name):
        return spark.readStream.schema(adapter.table(spark, sf_dir, name).schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)

    signals = adapter.signals_of(spark, sf_dir, stream("orders")).select("id", "created_at", "horizon_days")
    with tracker.state_in_rocksdb(spark):
        matured = maturity.run_once(tracker.track(signals, stream("lineitem").select(F.col("l_shipdate").alias("session_date"))), fresh_path(spark, "tracked"))
    priced = adapter.market(spark, sf_dir).series.select(F.col("symbol").alias("ticker"), F.lit(True).alias("priced"))
    found = adapter.signals(spark, sf_dir).select("id", "ticker").join(matured, "id", "left").join(priced, "ticker", "left")
    status = F.when(F.col("priced").isNull(), "missing_prices").when(F.col("horizon_end").isNull(), "insufficient_calendar").otherwise("matured")
    return found.select("id", status.alias("status"), "horizon_end")


@query(Q.MATURITY_STREAM)
def stream_maturity(spark, sf_dir):
    """Events as a stream, counted by kind and day; the table's rows come in no order of time, so none is late."""
    from panelforge.streaming.maturity import count_stream

    events = spark.readStream.schema(adapter.table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return count_stream(events, fresh_path(spark, "counted"), late="36500 days")

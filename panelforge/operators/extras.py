"""Operators of the extended rule set, and small input tables for the rule queries."""

from __future__ import annotations

import itertools

from panelforge.functions import rules, scalars
from panelforge.operators import prices, returns
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

NAN = float("nan")
SENTIMENT_WORDS = ["positive", " Bullish ", "GOOD", "upbeat", "negative", "bearish", "bad", "Downbeat", "neutral", "", None, "great"]
FORMAT_NUMBERS = [0.0, 0.5, 1.5, 2.5, 3.5, 10.0, 12.25, 99.5, 100.0, 123456.7, 999999.5, 1000000.0, 1234567.0, 0.1, 0.00012345, 0.00001234, 2.0, 0.333333333, 54321.125]
REACTION_ROWS = [
    (news, ar, present, grain, basket)
    for news, ar, (present, grain), basket in itertools.product(
        ["positive", "upbeat", "negative", "neutral"], [None, 0.0, 0.0099, 0.01, 0.02, -0.0099, -0.01, -0.02, NAN], [(True, "daily"), (True, "intraday"), (False, "daily")], [True, False]
    )
]
CLASS_ROWS = list(
    itertools.product(
        ["positive", "negative", "downbeat", "neutral"],
        [rules.POSITIVE_REACTION, rules.NEGATIVE_REACTION, rules.SELL_THE_NEWS, rules.BAD_NEWS_ABSORBED, rules.NO_REACTION, rules.INCONCLUSIVE],
        [True, False], [61.0, 62.0, 69.0, 70.0], [True, False],
    )
)
EXTENSION_ROWS = list(itertools.product([True, False, None], [None, 74.0, 75.0], [None, 0.24, 0.25]))
OUTCOME_ROWS = list(itertools.product(["Tradeable", "Watch", "Wait for Confirmation", "Avoid", "Avoid Chase", "Other"], [None, -0.01, 0.0, 0.01, 0.02, 0.021]))
LABEL_ROWS = list(itertools.product(["positive", "negative", "neutral", "other"], [None, -0.01, -0.005, 0.0, 0.005, 0.01], [None, 0.01], ["low", "medium"], ["ok", "beta_fallback_used"]))
DRAWDOWN_ROWS = list(itertools.product(["Tradeable", "Watch", "Avoid", "Avoid Chase", "Other"], [None, -0.01, 0.0, 0.04, 0.05], [None, -0.04, -0.05]))


def reaction_grid(spark):
    return spark.createDataFrame(REACTION_ROWS, "news string, ar double, present boolean, granularity string, basket boolean")


def class_grid(spark):
    return spark.createDataFrame(CLASS_ROWS, "news string, reaction string, extended boolean, setup double, volume boolean")


def extension_grid(spark):
    return spark.createDataFrame(EXTENSION_ROWS, "flag boolean, rsi double, return_20d double")


def outcome_grid(spark):
    return spark.createDataFrame(OUTCOME_ROWS, "classification string, ar double")


def label_grid(spark):
    return spark.createDataFrame(LABEL_ROWS, "news string, ar double, peer double, causality string, quality string")


def drawdown_grid(spark):
    return spark.createDataFrame(DRAWDOWN_ROWS, "classification string, ar double, drawdown double")


def messy_prices(events: DataFrame) -> DataFrame:
    """Raw prices in several date formats, with blanks and other text that is no number."""
    day = F.to_date("ts")
    kind = F.col("event_id") % 5
    date = (
        F.when(kind == 0, F.date_format(day, "yyyy-MM-dd")).when(kind == 1, F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T20:00:00-05:00")))
        .when(kind == 2, F.date_format(day, "MM/dd/yyyy")).when(kind == 3, F.date_format(day, "yyyyMMdd")).otherwise("someday")
    )
    key = F.col("event_id")
    price = F.when(key % 7 == 0, " ").when(key % 11 == 0, "5d").when(key % 13 == 0, "NaN").otherwise(F.col("value").cast("string"))
    return events.select(F.concat(F.lit(" "), "event_type", F.lit("\t")).alias("symbol"), date.alias("date"), price.alias("adjusted_close"), key.alias("ordinal"))


def hit_rates(records: DataFrame) -> DataFrame:
    """The share of hits of all matured records and of each class."""
    rate = F.try_divide(F.count_if("hit"), F.count("*")).alias("hit_rate")
    return records.where("is_matured").rollup("classification").agg(rate).select(F.coalesce("classification", F.lit("all")).alias("classification"), "hit_rate")


def calendar_event_study(signals: DataFrame, market: prices.Market, horizons: tuple[int, ...] = (1, 3)) -> DataFrame:
    """Returns and abnormal returns to the end of so many calendar days; betas have no look-ahead here either."""
    keys = signals.select("ticker", "sector_proxy", F.to_date("created_at").alias("created_day")).distinct()
    keys = keys.withColumn("horizon_days", F.explode(F.array(*map(F.lit, horizons)))).withColumn("end_day", F.date_add("created_day", F.col("horizon_days")))
    found = returns.abnormal_returns(keys, market, start="created_day").drop("end_day")
    method = returns.calculation_method(F.col("raw_return"), F.col("market_return"), F.col("sector_return"))
    return found.withColumn("market_adjusted_return", F.col("raw_return") - F.col("market_return")).withColumn("calculation_method", method)


def wide_forward_returns(signals: DataFrame, market: prices.Market, horizons: tuple[int, ...] = (1, 3, 5, 20)) -> DataFrame:
    """One column for each horizon."""
    long = calendar_event_study(signals, market, horizons)
    at = lambda h, value: F.max(F.when(F.col("horizon_days") == h, F.col(value)))
    packed = [at(h, "raw_return").alias(f"forward_{h}d_return") for h in horizons] + [at(h, "combined_abnormal_return").alias(f"forward_{h}d_abnormal_return") for h in horizons]
    return long.groupBy("ticker", "created_day").agg(*packed)


def daily_volume(spark, sf_dir: str) -> DataFrame:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    owner = read("supplier").join(read("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("symbol"))
    lines = read("lineitem").join(owner, F.col("l_suppkey") == F.col("s_suppkey"))
    return lines.groupBy("symbol", F.to_date("l_shipdate").alias("session_date")).agg(F.sum("l_quantity").alias("volume"))


def volume_reaction(volumes: DataFrame, window: int = 5, trailing: int = 20) -> DataFrame:
    """Mean volume of a session and those after it over the mean of the rows before it."""
    order = Window.partitionBy("symbol").orderBy("session_date")
    now = F.avg("volume").over(order.rowsBetween(0, window - 1))
    before = F.avg("volume").over(order.rowsBetween(-trailing, -1))
    return volumes.select("symbol", "session_date", F.try_divide(now, before).alias("volume_reaction"))


def basket_label(news: Column, abnormal: Column, peer: Column, causality: Column, threshold: float = 0.005) -> Column:
    """The reaction label of the extended rules, by which a peer basket can confirm neutral news."""
    kind = F.lower(news)
    both = (F.abs(abnormal) > threshold) & F.coalesce(F.abs(peer) > threshold, F.lit(False))
    signed = F.when(abnormal > 0, rules.POSITIVE_REACTION).otherwise(rules.NEGATIVE_REACTION)
    return (
        F.when(abnormal.isNull(), rules.INCONCLUSIVE)
        .when((kind == "positive") & (abnormal > threshold), rules.POSITIVE_REACTION)
        .when((kind == "positive") & (abnormal < -threshold), rules.SELL_THE_NEWS)
        .when((kind == "negative") & (abnormal >= 0), rules.BAD_NEWS_ABSORBED)
        .when((kind == "negative") & (abnormal < -threshold), rules.NEGATIVE_REACTION)
        .when(kind.isin("neutral", "mixed"), F.when(both, signed).otherwise(rules.INCONCLUSIVE))
        .when(causality == "low", rules.INCONCLUSIVE)
        .when(F.abs(abnormal) <= threshold, rules.NO_REACTION)
        .otherwise(rules.INCONCLUSIVE)
    )


def confidence(quality: Column, causality: Column) -> Column:
    return F.when(quality != "ok", 0.35).when(causality == "medium", 0.7).otherwise(0.5)


def drawdown_outcome(classification: Column, abnormal: Column, drawdown: Column) -> Column:
    """Struct of hit, avoided_bad_trade and false_negative; a deep drawdown, too, is a bad trade avoided."""
    known = abnormal.isNotNull()
    bullish, avoided = classification.isin("Tradeable", "Watch", "Wait for Confirmation"), classification.isin("Avoid", "Avoid Chase")
    return F.struct(
        F.when(known & bullish, scalars.above(abnormal, 0.0)).alias("hit"),
        F.when(known & avoided, (abnormal <= 0) | (F.coalesce(drawdown, F.lit(0.0)) <= -0.05)).alias("avoided_bad_trade"),
        F.when(known & avoided, abnormal >= 0.05).alias("false_negative"),
    )


# Fixed values.
FOR = ["Ticker is above the 20D moving average.", "5D abnormal return is positive.", "Basket breadth is above 50%.", "Volume is above 1.2x its recent average.", "Event study shows a positive abnormal reaction."]
AGAINST = [
    "Ticker is not above the 20D moving average.", "5D abnormal return is negative.", "Basket breadth is not broad enough.", "RSI is above 75.", "Price is more than 10% above the 20D moving average.",
    "Macro regime is Risk-Off.", "Positive news produced a negative abnormal reaction.",
]
THESIS_REASONS = {
    "Tradeable": "Rule-based evidence is broad enough and extension risk is not high.",
    "Watch": "Evidence is constructive but still has conflicts or missing confirmation.",
    "Avoid Chase": "Setup has positive evidence but extension risk is high.",
    "Avoid": "Evidence conflicts or score is negative.",
    "Wait for Confirmation": "More forward-return confirmation is needed.",
}
CAUGHT = "The catalyst was positively received, but the stock is already technically extended."


def thesis(df: DataFrame) -> DataFrame:
    """Score, evidence and class of a thesis from its features.

    Columns: above_ma20, abnormal_5d, breadth, volume_ratio, rsi, distance, macro, news, positive_event (any study shows a
    positive reaction), positive_abnormal and negative_abnormal (any study's abnormal return is). Adds score, evidence_for,
    evidence_against, confirmation_needed, invalidation_signals, classification, reason and status_by_horizon.
    """
    holds = lambda c: F.coalesce(c, F.lit(False))
    c = F.col
    ma, ar, breadth = holds(c("above_ma20")), c("abnormal_5d"), c("breadth")
    volume = holds(c("volume_ratio") > 1.2)
    rsi, far = holds(c("rsi") > 75), holds(c("distance") > 0.10)
    risk_off, event = holds(c("macro") == "Risk-Off"), holds(c("positive_event"))
    rejected = holds((c("news") == "positive") & c("negative_abnormal"))
    steps = [(ma, 2, -1), (holds(ar > 0), 2, 0), (holds(ar <= 0), -2, 0), (holds(breadth > 0.5), 2, 0), (holds(breadth <= 0.5), -1, 0), (volume, 1, 0), (rsi, -3, 0), (far, -3, 0), (risk_off, -2, 0), (event, 2, 0), (rejected, -3, 0)]
    score = sum((F.when(cond, yes).otherwise(no) for cond, yes, no in steps[1:]), F.when(steps[0][0], 2).otherwise(-1))
    listed = lambda pairs: F.array_compact(F.array(*[F.when(cond, text) for cond, text in pairs]))
    good = listed(zip([ma, holds(ar > 0), holds(breadth > 0.5), volume, event], FOR, strict=True))
    bad = listed(zip([~ma, holds(ar <= 0), holds(breadth <= 0.5), rsi, far, risk_off, rejected], AGAINST, strict=True))
    out = df.withColumn("score", score).withColumn("evidence_for", good).withColumn("evidence_against", bad)
    caught = holds(c("news") == "positive") & holds(c("positive_abnormal")) & (rsi | far) & holds(c("volume_ratio") > 1.5)
    decided = (
        F.when(caught, "Avoid Chase").when(c("score") < 0, "Avoid").when((rsi | far) & (c("score") > 0), "Avoid Chase").when((F.size("evidence_against") > 0) & (c("score") >= 3), "Watch")
        .when(c("score") >= 6, "Tradeable").when(c("score") >= 2, "Watch").otherwise("Wait for Confirmation")
    )
    reasons = F.create_map(*[F.lit(x) for pair in THESIS_REASONS.items() for x in pair])
    first = F.when(caught | event, "Confirmed on 1D event reaction").otherwise("Inconclusive on 1D event reaction")
    swing = F.when(~caught & holds(ar > 0), "Confirmed on 5D swing horizon").otherwise("Unconfirmed on 5D forward return")
    return (
        out.withColumn("classification", decided)
        .withColumn("reason", F.when(caught, CAUGHT).otherwise(reasons[c("classification")]))
        .withColumn("confirmation_needed", listed([(ar.isNull(), "Need 5D abnormal return validation.")]))
        .withColumn("invalidation_signals", listed([(rsi, "Overextension risk remains high."), (far, "Wait for price to digest the move.")]))
        .withColumn("status_by_horizon", F.create_map(F.lit(rules.HORIZONS[1]), first, F.lit(rules.HORIZONS[5]), swing, F.lit(rules.HORIZONS[20]), F.lit("Still open on 20D theme horizon")))
    )


def thesis_inputs(spark, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select(
        key.alias("id"), (key % 2 == 0).alias("above_ma20"), F.when(key % 5 != 0, (key % 7 - 3) / F.lit(100.0)).alias("abnormal_5d"), F.when(key % 3 != 0, (key % 10) / F.lit(10.0)).alias("breadth"),
        ((key % 20) / F.lit(10.0)).alias("volume_ratio"), (key % 101).cast("double").alias("rsi"), ((key % 17) / F.lit(100.0)).alias("distance"), F.when(key % 4 == 0, "Risk-Off").otherwise("Neutral").alias("macro"),
        F.when(key % 3 == 0, "positive").otherwise("neutral").alias("news"), (key % 11 < 4).alias("positive_event"), (key % 11 < 6).alias("positive_abnormal"), (key % 13 < 3).alias("negative_abnormal"),
    )


def order_inputs(spark, sf_dir: str) -> DataFrame:
    """Inputs of the rule tables, one row for each order, in all combinations sooner or later; some are NULL."""
    key = F.col("o_orderkey")
    pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))
    part = lambda by: F.floor(key / by)
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        key.alias("id"), pick(["positive", " Bullish ", "good", "upbeat", "negative", "BEARISH", "bad", "downbeat", "mixed", "", None], key).alias("word"),
        pick(["positive", "negative", "neutral", "mixed", "other"], part(5)).alias("news"), F.when(key % 5 != 0, (key % 41 - 20) / F.lit(200.0)).alias("ar"), F.when(key % 3 != 0, (key % 23 - 11) / F.lit(500.0)).alias("peer"),
        pick(["low", "medium", "high"], part(2)).alias("causality"), pick(["ok", "beta_fallback_used"], part(3)).alias("quality"),
        pick(["Tradeable", "Watch", "Wait for Confirmation", "Avoid", "Avoid Chase", "Other"], part(7)).alias("classification"), F.when(key % 4 != 0, -(key % 13) / F.lit(100.0)).alias("drawdown"),
        pick([True, False, None], key).alias("flag"), F.when(key % 9 != 0, (key % 101).cast("double")).alias("rsi"), F.when(key % 8 != 0, (key % 61) / F.lit(100.0)).alias("return_20d"),
        pick(["event_reaction", "trade_setup", "theme_thesis", "context", "technical_extension", "basket_confirmation", "another"], part(4)).alias("signal_type"),
    )


def news_feed(spark, sf_dir: str) -> DataFrame:
    """JSON lists of both shapes, with an entry that is no object, one with hardly a field, and some text that is no list."""
    key = F.col("o_orderkey").cast("string")
    flat = F.concat(F.lit('{"title": "Flat '), key, F.lit('", "publisher": "Wire", "link": "http://a/'), key, F.lit('", "providerPublishTime": '), (F.col("o_orderkey") + 1600000000).cast("string"), F.lit("}"))
    nested = F.concat(
        F.lit('{"title": "", "content": {"title": "Nested '), "o_orderpriority", F.lit('", "provider": {"displayName": "Desk"}, "canonicalUrl": {"url": "http://b"}, "pubDate": " '),
        F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit('T00:00:00Z "}}'),
    )
    bare = F.lit('{"content": {"clickThroughUrl": {"url": "http://c"}}, "providerPublishTime": "oops"}')
    listed = F.concat(F.lit("["), flat, F.lit(", "), nested, F.lit(', "text", '), bare, F.lit("]"))
    raw = F.when(F.col("o_orderkey") % 6 == 0, F.lit('{"no": "list"}')).when(F.col("o_orderkey") % 3 == 0, F.lit("[not json")).otherwise(listed)
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("feed"), raw.alias("raw"))


def journal_lines(orders: DataFrame) -> DataFrame:
    """Lines of a journal: good ones, blank ones, bad ones, one without a verdict, and one that is no object."""
    kind = F.col("o_orderkey") % 5
    head = F.concat(F.lit('{"saved_at": "'), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit('", "decision": {"ticker": "T'), (F.col("o_orderkey") % 50).cast("string"), F.lit('"}'))
    good = F.concat(head, F.lit(', "evaluation": {"verdict": "wait"}}'))
    line = F.when(kind == 1, "   ").when(kind == 2, "{not valid json").when(kind == 3, F.concat(head, F.lit("}"))).when(kind == 4, "[1]").otherwise(good)
    return orders.select(line.alias("value"))

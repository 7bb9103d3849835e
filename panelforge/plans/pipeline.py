"""The composite queries: forward evaluation, signal generation, the cohort, and the lab."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from panelforge.functions import rules
from panelforge.operators import metrics, prices, returns
from panelforge.sources import store
from panelforge.sources.providers import PriceBundle, PriceProvider
from panelforge.sources.shared import stored
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import demo

RECORD = ["raw_return", "market_return", "beta", "beta_fallback_used", "beta_adjusted_abnormal_return", "sector_return", "sector_adjusted_abnormal_return", "combined_abnormal_return", "data_quality_flag"]


def at_keys(rows: DataFrame, keys: list[str], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``rows`` with the columns that ``work`` adds, which depend on ``keys`` alone.

    ``work`` runs over the distinct keys, of which there are far fewer, and rows take the results by one null-safe join: a row
    without a ticker, a proxy or a time has a key like any other and stays, and a popular ticker's rows do not meet in one task. It also
    keeps generated methods small enough to be compiled, which one pipeline of all look-ups and rules is not.
    """
    made = work(rows.select(keys).distinct())
    added = [c for c in made.columns if c not in keys]
    other = made.select(*[F.col(c).alias(f"_key_{c}") for c in keys], *added)
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_key_{c}")) for c in keys])
    return rows.join(other, same, "left").drop(*[f"_key_{c}" for c in keys])


def generate_signals(signals: DataFrame, market: prices.Market) -> DataFrame:
    """Event study over one session, reaction and class, and the snapshot's fields, for each input signal."""
    created = signals.withColumn("start_day", prices.after_day(F.col("created_at"))).withColumn("created_day", F.to_date("created_at"))

    def study(rows: DataFrame) -> DataFrame:
        ends = rows.withColumn("end_day", market.own().ahead(market.place(F.col("created_day")), F.lit(1)))
        found = returns.abnormal_returns(ends, market, more=lambda own: {"price_at_creation": own.on(market.place(F.col("created_day")))})
        return found.select(*rows.columns, F.col("combined_abnormal_return").alias("event_abnormal_return"), "price_at_creation")

    joined = at_keys(created, ["ticker", "sector_proxy", "start_day", "created_day"], study)
    # The label and the two sentiments are columns of their own, so that the optimizer doesn't repeat their expressions in every rule.
    kinds = joined.withColumn("event_kind", rules.event_sentiment(F.col("sentiment"))).withColumn("signal_kind", rules.signal_sentiment(F.col("sentiment")))
    reaction = rules.event_reaction(F.col("sentiment"), F.col("event_abnormal_return"), kind=F.col("event_kind"))
    judged = kinds.withColumn("reaction", reaction).withColumn("reaction_label", F.col("reaction.label")).drop("reaction", "event_kind")
    extended = rules.overextended(F.lit(False), F.col("rsi"), F.col("return_20d"))
    made = rules.signal_class(F.col("sentiment"), F.col("reaction_label"), extended, F.col("setup_score"), F.col("volume"), kind=F.col("signal_kind"))
    decided = judged.withColumn("decision", made)
    return decided.select(*signals.columns, "event_abnormal_return", "reaction_label", "decision.classification", "decision.score", "decision.rule_version", "price_at_creation", F.lit(market.benchmark).alias("benchmark"))


def evaluate_forward(snapshots: DataFrame, market: prices.Market, as_of: Column | None = None, strict: bool = False) -> DataFrame:
    """Each snapshot with its forward record and ``status``: matured, pending, insufficient_calendar or missing_prices.

    ``strict`` raises at run time where a ticker has no prices or the calendar ends too early. A signal is mature once
    ``as_of``, by default the benchmark's last session, has come to the end of its horizon.
    """
    proxied = snapshots.withColumn("_proxy", F.nullif(F.col("sector_proxy"), F.lit("")))
    dated = proxied.withColumn("start_day", prices.after_day(F.col("created_at"))).withColumn("created_day", F.to_date("created_at"))
    now = F.element_at(market.own().dates, -1) if as_of is None else F.to_date(as_of)

    def evaluate(rows: DataFrame) -> DataFrame:
        ends = rows.withColumn("end_day", market.own().ahead(market.place(F.col("created_day")), F.col("horizon_days")))
        first, last = market.place(F.col("start_day")), market.place(F.col("end_day"))
        found = returns.abnormal_returns(ends, market, proxy="_proxy", more=lambda own: returns.moves_within(own, first, last) | {"_priced": own.prices.isNotNull()})
        status = F.when(~F.col("_priced"), "missing_prices").when(F.col("end_day").isNull(), "insufficient_calendar").when(now >= F.col("end_day"), "matured").otherwise("pending")
        found = found.withColumn("status", status)
        if strict:
            broken = F.col("status").isin("missing_prices", "insufficient_calendar")
            found = found.withColumn("status", F.when(broken, F.raise_error(F.concat_ws(": ", "status", "ticker"))).otherwise(F.col("status")))
        mature = F.col("status") == "matured"
        return found.select(*rows.columns, "end_day", "status", *[F.when(mature, F.col(c)).alias(c) for c in [*RECORD, "max_drawdown", "max_runup"]])

    found = at_keys(dated, ["ticker", "_proxy", "start_day", "created_day", "horizon_days"], evaluate)
    joined = found.withColumn("outcome", rules.outcome(F.col("classification"), F.col("combined_abnormal_return")))
    return joined.select(
        *snapshots.columns, F.col("end_day").alias("horizon_end"), "status", (F.col("status") == "matured").alias("is_matured"), *RECORD, "max_drawdown", "max_runup",
        F.col("raw_return").alias("forward_return"), F.col("combined_abnormal_return").alias("forward_abnormal_return"), F.col("outcome.trade_hit").alias("hit"), "outcome.*",
    )


def universe_cohort(tickers: DataFrame, dates: DataFrame, market: prices.Market) -> DataFrame:
    """The abnormal return of every ticker that has prices (with its ``sector_proxy``) on each ``created_at`` and horizon.

    Dates and horizons are few, as many as the calendar has; every ticker is asked for each.
    """
    found = cohort_moves(tickers, dates, market)
    return found.select("ticker", "created_at", "horizon_days", F.col("combined_abnormal_return").alias("forward_abnormal_return"))


def cohort_moves(tickers: DataFrame, dates: DataFrame, market: prices.Market) -> DataFrame:
    """The records of the cohort. They are made within each ticker's row from its series and its proxy's; nothing is joined after that."""
    ends = dates.select("created_at", "horizon_days").distinct()
    ends = market.horizon_end(ends.withColumn("created_day", F.to_date("created_at"))).where("horizon_end is not null")
    own = market.own()
    first, last = market.place(prices.after_day(F.col("created_at"))), market.place(F.col("horizon_end"))
    spans = ends.select("created_at", "horizon_days", first.alias("first"), last.alias("last"))
    # The spans of the calendar in one row: as many as it has days and horizons.
    spans = spans.withColumn("market_return", returns.moved(own, F.col("first"), F.col("last"))).agg(F.collect_list(F.struct("*")).alias("spans"))
    held = market.read(tickers.select("ticker", "sector_proxy"), "ticker", lambda s: {"_own_prices": s.prices, "_own_betas": s.betas, "_own_upto": s.upto}).where("_own_prices is not null")
    held = market.read(held, "sector_proxy", lambda s: {"_others": s.prices, "_other_upto": s.upto})
    none = F.lit(None)
    ticker = prices.Series(none, F.col("_own_prices"), F.col("_own_betas"), none, none, F.col("_own_upto"))
    proxy = prices.Series(none, F.col("_others"), none, none, none, F.col("_other_upto"))
    # Within the ticker's row, so that a span takes its few numbers along and not the series.
    # Each ticker is a good deal of work for a row of its size, so tickers are dealt out again.
    held = held.repartition(int(held.sparkSession.conf.get("spark.sql.shuffle.partitions")), "ticker").withColumn("_spans", spans.scalar())
    moves = F.transform(
        "_spans",
        lambda x: F.struct(
            x.created_at.alias("created_at"), x.horizon_days.alias("horizon_days"), x.market_return.alias("market_return"), returns.moved(ticker, x.first, x.last).alias("raw_return"),
            ticker.beta_before(x.first).alias("beta_estimate"), returns.moved(proxy, x.first, x.last).alias("_sector"),
        ),
    )
    # A proxy without prices is none.
    known = F.when(F.col("_others").isNotNull(), F.col("sector_proxy")).alias("sector_proxy")
    made = held.select("ticker", known, moves.alias("_moves")).select("ticker", "sector_proxy", F.inline("_moves"))
    return returns.record(made)


def cohort_counts(tickers: DataFrame, dates: DataFrame, market: prices.Market) -> DataFrame:
    """Partials of the cohort's base rate: ``horizon_days``, ``key`` (the date), ``n`` rows and ``up`` risers.

    They can be added: the counts of new dates, or of more tickers, join those that are known (:func:`metrics.merge_counts`). A task
    counts its tickers as it spreads them, so what is shuffled is a row for each date, horizon and task, never a ticker's.
    """
    return metrics.count_risers(cohort_moves(tickers, dates, market).withColumnRenamed("combined_abnormal_return", "forward_abnormal_return"))


def validation_lab(provider: PriceProvider, spark) -> dict[str, DataFrame]:
    """The demo run: snapshots, outcomes with provenance, cohort, groups and summary."""
    signals, cohort = demo.demo_signals(spark), demo.demo_cohort(spark)
    roles = demo.symbol_roles(signals, cohort)
    days = [r["session_date"] for r in demo.business_days(spark).orderBy("session_date").collect()]
    symbols = sorted(r["symbol"] for r in roles.collect())
    bundle = provider.get_history(symbols, days[0], days[-1]).validate()
    absent = bundle.missing.join(roles.where("role = 'required'"), "symbol", "left_semi")
    names = sorted(r["symbol"] for r in absent.collect())
    if names:
        raise ValueError(f"missing required price history: {names}")
    return lab_tables(bundle, signals, cohort)


def lab_tables(bundle: PriceBundle, signals: DataFrame, cohort: DataFrame, benchmark: str = demo.BENCHMARK) -> dict[str, DataFrame]:
    """All signals as of the benchmark's first session: snapshots, outcomes with provenance, cohort, groups and summary."""
    market = prices.Market(bundle.prices, benchmark)
    first = market.panel.where(F.col("symbol") == benchmark).agg(F.min("session_date").cast("timestamp_ntz").alias("created_at"))
    dated = signals.drop("created_at").join(F.broadcast(first))
    snapshots = stored(generate_signals(dated, market), "snapshots")
    outcomes = stored(evaluate_forward(snapshots, market), "outcomes")
    members = stored(universe_cohort(cohort, snapshots.select("created_at", "horizon_days"), market), "cohort")
    if members.isEmpty():
        raise ValueError("the cohort is empty")
    return {
        "snapshots": snapshots,
        "outcomes": store.provenance(outcomes.drop("hit"), bundle.metadata, bundle.source, bundle.adjustment),
        "universe_cohort": members,
        "groups": metrics.group_metrics(outcomes, members),
        "summary": metrics.summary_metrics(outcomes),
    }

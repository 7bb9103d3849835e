"""As-of returns, rolling betas and abnormal returns.

All take *keys*: the distinct combinations of ticker, sector proxy and dates that signals need. There are far fewer of them
than signals, so look-ups run over the keys and signals take the results by one equality join.
"""

from __future__ import annotations

from collections.abc import Callable

from panelforge.functions import scalars
from panelforge.operators import prices
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LOOKBACK = 120
FEWEST = 30
# Fixed values.
METHODS = ("unavailable", "beta_and_sector_adjusted", "beta_adjusted_spy_only")


def raw_returns(keys: DataFrame, market: prices.Market, symbol: str, start: str, end: str, out: str) -> DataFrame:
    """Add ``out``: price on or before ``end`` over price on or after ``start``, less 1.

    The two prices are found independently, so a span without a session gives a backward return.
    """
    first, last = market.place(F.col(start)), market.place(F.col(end))
    return market.read(keys, symbol, lambda own: {out: moved(own, first, last)})


def moved(own: prices.Series, first: Column, last: Column) -> Column:
    return scalars.ratio_less_one(own.on_or_before(last), own.on_or_after(first))


def rolling_betas(panel: DataFrame, benchmark: str, lookback: int = LOOKBACK, period: str | None = None) -> DataFrame:
    """``beta`` of each symbol over its last ``lookback`` sessions that the benchmark shares, up to the session itself.

    NULL with fewer than min(lookback, 30) joint returns or a constant benchmark. A window's moments are taken about its own
    means. With ``period`` (a unit of date_trunc, for long series such as minute bars) a symbol's windows run block by block, each block
    with the rows that its first windows reach back to; the figures are the same.
    """
    returns = prices.simple_returns(panel, period).where("ret is not null")
    market = returns.where(F.col("symbol") == benchmark).select("session_date", F.col("ret").alias("market_ret"))
    joint = returns.where(F.col("symbol") != benchmark).join(market, "session_date")
    if period is None:
        order = Window.partitionBy("symbol").orderBy("session_date")
    else:
        joint = prices.in_blocks(joint, ["symbol"], "session_date", lookback - 1, period, max(4096, 4 * lookback))
        order = Window.partitionBy("symbol", "_block").orderBy("_number")
    frame = order.rowsBetween(-(lookback - 1), 0)
    variance = F.var_samp("market_ret").over(frame)
    enough = F.count("*").over(frame) >= min(lookback, FEWEST)
    beta = F.when(enough & (variance > 0), F.covar_samp("ret", "market_ret").over(frame) / variance)
    made = joint.withColumn("beta", beta).withColumn("n_joint", F.count("*").over(frame))
    return (made if period is None else made.where("_own")).select("symbol", "session_date", "beta", "n_joint")


def beta_adjusted(ret: Column, beta: Column, market: Column) -> Column:
    return ret - beta * market


def sector_adjusted(ret: Column, sector: Column) -> Column:
    return ret - sector


def combined(ret: Column, beta: Column, market: Column, sector: Column, weight: float = 0.5) -> Column:
    """Market and sector share the adjustment; without a sector return it is the market's alone."""
    return F.when(sector.isNull(), beta_adjusted(ret, beta, market)).otherwise(ret - (1 - weight) * beta * market - weight * sector)


def abnormal_returns(
    keys: DataFrame,
    market: prices.Market,
    ticker: str = "ticker",
    proxy: str = "sector_proxy",
    start: str = "start_day",
    end: str = "end_day",
    more: Callable[[prices.Series], dict[str, Column]] | None = None,
) -> DataFrame:
    """Add the abnormal-return record to each key, and what ``more`` reads of the ticker's series.

    Without a ticker return only the market's is given; without a market return only the ticker's. The beta is that of the
    last joint session before ``start``, so no later price counts; a missing one is 1 and flagged.
    ``data_quality_flag`` is 'ok' or the flags joined by commas. Prices are joined twice: the ticker's and the proxy's; the market's
    are scalars.
    """
    first, last = market.place(F.col(start)), market.place(F.col(end))
    found = market.read(keys, ticker, lambda own: {"raw_return": moved(own, first, last), "beta_estimate": own.beta_before(first)} | (more(own) if more else {}))
    found = market.read(found, proxy, lambda own: {"_sector": moved(own, first, last)})
    found = found.withColumn("market_return", moved(market.own(), first, last))
    return record(found, proxy)


def record(found: DataFrame, proxy: str = "sector_proxy") -> DataFrame:
    """The abnormal-return record from ``raw_return``, ``market_return``, ``_sector`` and ``beta_estimate``."""
    raw, market_return, sector = F.col("raw_return"), F.col("market_return"), F.col("sector_return")
    good = raw.isNotNull() & market_return.isNotNull()
    beta = F.when(good, F.coalesce("beta_estimate", F.lit(1.0)))
    fallback = good & F.col("beta_estimate").isNull()
    flags = F.concat_ws(",", F.when(fallback, "beta_fallback_used"), F.when(F.col(proxy).isNotNull() & sector.isNull(), "missing_sector_proxy"))
    quality = F.when(raw.isNull(), "insufficient_price_history").when(market_return.isNull(), "missing_benchmark_data").when(flags == "", "ok").otherwise(flags)
    out = found.withColumn("sector_return", F.when(good, F.col("_sector"))).withColumn("beta", beta).withColumn("beta_fallback_used", fallback)
    return out.select(
        "*",
        beta_adjusted(raw, F.col("beta"), market_return).alias("beta_adjusted_abnormal_return"),
        sector_adjusted(raw, sector).alias("sector_adjusted_abnormal_return"),
        combined(raw, F.col("beta"), market_return, sector).alias("combined_abnormal_return"),
        quality.alias("data_quality_flag"),
    ).drop("_sector", "beta_estimate")


def calculation_method(raw: Column, market: Column, sector: Column) -> Column:
    """How the combined abnormal return of a record came about."""
    return F.when(raw.isNull() | market.isNull(), METHODS[0]).when(sector.isNotNull(), METHODS[1]).otherwise(METHODS[2])


def moves_within(own: prices.Series, start: Column, end: Column) -> dict[str, Column]:
    """``max_drawdown`` and ``max_runup`` against the first price from one place to another; NULL without a session there."""
    first, low, high = own.extremes(start, end)
    return {"max_drawdown": scalars.ratio_less_one(low, first), "max_runup": scalars.ratio_less_one(high, first)}


def drawdown_runup(keys: DataFrame, market: prices.Market, symbol: str = "ticker", start: str = "start_day", end: str = "end_day") -> DataFrame:
    """Add ``max_drawdown`` and ``max_runup`` against the first price in the window; NULL without a session in it.

    A window is two look-ups in the tables of extremes, so no row is made for its sessions. A window that begins after the
    last session, or ends before the first, has none.
    """
    return market.read(keys, symbol, lambda own: moves_within(own, market.place(F.col(start)), market.place(F.col(end))))

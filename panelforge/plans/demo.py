"""The demo universe and its signal inputs."""

from __future__ import annotations

import datetime as dt

from panelforge.functions import rules
from panelforge.operators.prices import canonical_symbols
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BENCHMARK = "SPY"
HORIZON = 5
START = dt.date(2026, 1, 1)
SESSIONS = 12
# Fixed values.
TICKERS = {
    "NVDA": [100, 102, 104, 105, 108, 112, 111, 113, 114, 116, 118, 119],
    "UAL": [50, 49, 48, 47, 47.5, 48, 48.2, 48.5, 49, 49.4, 49.6, 50],
    "CRWD": [70, 72, 75, 78, 82, 84, 83, 82, 81, 80, 79, 78],
    "MSFT": [200, 201, 202, 202, 203, 204, 204, 205, 205, 206, 206, 207],
    "DAL": [40, 39.8, 39.6, 39.5, 39.4, 39.7, 39.9, 40.1, 40.2, 40.3, 40.5, 40.6],
}
MARKET = [100, 100.5, 101, 101.5, 102, 102.5, 102.8, 103, 103.2, 103.4, 103.5, 103.7]
SECTORS = {
    "SMH": [100, 101, 102, 102.5, 103, 104, 104.5, 105, 105.5, 106, 106.2, 106.4],
    "JETS": [100, 99.5, 99, 98.8, 99, 99.4, 99.7, 100, 100.1, 100.3, 100.5, 100.8],
    "HACK": [100, 101, 102, 103, 104, 104.5, 104.7, 105, 105.2, 105.4, 105.5, 105.7],
}
COHORT_PROXY = {"NVDA": "SMH", "UAL": "JETS", "CRWD": "HACK", "MSFT": None, "DAL": "JETS"}
SIGNALS = [
    ("NVDA", "AI Infrastructure / Semiconductor", "positive", 62.0, 0.12, 78.0, True),
    ("UAL", "Airlines / Travel Rebound", "positive", 51.0, 0.02, 58.0, True),
    ("CRWD", "Cybersecurity", "positive", 81.0, 0.31, 82.0, True),
]


def business_days(spark: SparkSession, start: dt.date = START, periods: int = SESSIONS) -> DataFrame:
    """So many weekdays from ``start``, with their place from 1."""
    days = spark.range(periods * 2).select(F.date_add(F.lit(start), F.col("id").cast("int")).alias("session_date")).where(F.weekday("session_date") < 5)
    return days.orderBy("session_date").limit(periods).withColumn("place", F.datediff("session_date", F.lit(start)) - 2 * F.floor((F.datediff("session_date", F.lit(start)) + F.weekday(F.lit(start))) / 7) + 1)


def demo_panel(spark: SparkSession) -> DataFrame:
    """Benchmark, then sectors, then tickers; a later series of the same symbol would replace an earlier one."""
    series = {BENCHMARK: MARKET} | SECTORS | TICKERS
    rows = [(symbol, i + 1, float(p)) for symbol, values in series.items() for i, p in enumerate(values)]
    priced = spark.createDataFrame(rows, "symbol string, place long, adjusted_close double")
    return priced.join(business_days(spark), "place").select("symbol", "session_date", "adjusted_close")


def demo_signals(spark: SparkSession) -> DataFrame:
    inputs = spark.createDataFrame(SIGNALS, "ticker string, theme string, sentiment string, rsi double, return_20d double, setup_score double, volume boolean")
    proxied = inputs.withColumn("sector_proxy", rules.theme_proxy(F.col("theme"))).withColumn("horizon_days", F.lit(HORIZON))
    return proxied.withColumn("created_at", F.lit(START).cast("timestamp_ntz")).withColumn("granularity", F.lit("daily"))


def demo_cohort(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(COHORT_PROXY.items()), "ticker string, sector_proxy string")


def symbol_roles(signals: DataFrame, cohort: DataFrame, benchmark: str = BENCHMARK) -> DataFrame:
    """``symbol`` and ``role``: required (benchmark, tickers, their proxies), or optional (what only the cohort has)."""
    spark = signals.sparkSession
    first = spark.createDataFrame([(s,) for s in canonical_symbols([benchmark])], "symbol string")
    column = lambda df, name: df.select(F.upper(name).alias("symbol")).where("symbol is not null")
    required = first.union(column(signals, "ticker")).union(column(signals, "sector_proxy")).distinct()
    optional = column(cohort, "ticker").union(column(cohort, "sector_proxy")).subtract(required)
    return required.withColumn("role", F.lit("required")).union(optional.withColumn("role", F.lit("optional")))

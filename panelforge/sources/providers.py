"""Price providers: each gives a bundle of a normalised panel and its provenance for symbols and a window."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Protocol

from panelforge.functions import scalars
from panelforge.operators import prices
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REQUIRED = ("symbol", "date", "adjusted_close")


@dataclass(frozen=True)
class PriceBundle:
    """``prices`` (a panel), ``metadata`` (one row for each requested symbol, in order) and where they come from."""

    prices: DataFrame
    metadata: DataFrame
    source: str
    adjustment: str

    @property
    def missing(self) -> DataFrame:
        """Requested symbols without prices, in request order."""
        return self.metadata.where("actual_start is null").select("position", "symbol")

    def validate(self) -> PriceBundle:
        """Raises unless all metadata have the bundle's one source and one adjustment."""
        found = self.metadata.agg(F.collect_set("source").alias("s"), F.collect_set("adjustment").alias("a")).first()
        for kind, values, own in (("sources", found["s"], self.source), ("adjustments", found["a"], self.adjustment)):
            if set(values) - {own}:
                raise ValueError(f"bundle mixes price {kind}: {sorted({*values, own})}")
        return self


class PriceProvider(Protocol):
    name: str
    adjustment: str

    def get_history(self, symbols: Sequence[str], start, end) -> PriceBundle: ...


def assemble(panel: DataFrame, symbols: Sequence[str], start, end, source: str, adjustment: str) -> PriceBundle:
    """Cut a panel to the request and describe what it has of it."""
    spark = panel.sparkSession
    wanted = prices.requested(spark, symbols)
    cut = prices.window_slice(panel, start, end).join(wanted.select("symbol"), "symbol", "left_semi")
    metadata = prices.coverage(cut, wanted).select(
        "position", "symbol", F.lit(source).alias("source"), F.lit(adjustment).alias("adjustment"),
        F.to_date(F.lit(start)).alias("requested_start"), F.to_date(F.lit(end)).alias("requested_end"), "actual_start", "actual_end",
        F.array().cast("array<string>").alias("data_quality_flags"), F.lit(None).cast("int").alias("expected_sessions"),
        F.array().cast("array<date>").alias("missing_session_dates"), F.array().cast("array<date>").alias("stale_price_dates"), F.lit(None).cast("boolean").alias("survivorship_verified"),
    )
    return PriceBundle(cut, metadata, source, adjustment)


class PanelProvider:
    """Prices that are already a panel, as of a demo or a table."""

    def __init__(self, panel: DataFrame, name: str = "demo", adjustment: str = "synthetic"):
        self.panel, self.name, self.adjustment = panel, name, adjustment

    def get_history(self, symbols: Sequence[str], start, end) -> PriceBundle:
        return assemble(self.panel, symbols, start, end, self.name, self.adjustment)


class CSVProvider:
    """Long CSV with symbol, date and adjusted_close. All columns are read as text and then coerced."""

    def __init__(self, spark: SparkSession, path: str, name: str = "csv", adjustment: str = "adjusted_close"):
        self.spark, self.path, self.name, self.adjustment = spark, path, name, adjustment

    def load(self) -> DataFrame:
        raw = self.spark.read.option("header", True).csv(self.path)
        absent = sorted(set(REQUIRED) - set(raw.columns))
        if absent:
            raise ValueError(f"price CSV is missing required columns: {absent}")
        # Input order: file, then place in the file.
        columns = [*REQUIRED, F.struct(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("row")).alias("ordinal")]
        return raw.select(*columns)

    def get_history(self, symbols: Sequence[str], start, end) -> PriceBundle:
        raw = self.load()
        wanted = prices.requested(self.spark, symbols).select(F.col("symbol").alias("_s"))
        own = raw.join(wanted, scalars.symbol(F.col("symbol")) == F.col("_s"), "left_semi")
        return assemble(prices.normalise(own), symbols, start, end, self.name, self.adjustment)


class FetchProvider:
    """End-of-day prices from an injected ``fetch(symbols, start, end)`` that gives rows of symbol, date and close.

    The upstream end is exclusive, so one day is added to it. A ``fetch`` given by name, ``module:function``, runs in the
    executors, one partition a symbol (:class:`panelforge.sources.feeds.Prices`); a function runs on the driver.
    """

    def __init__(self, spark: SparkSession, fetch: Callable | str, name: str = "eod", adjustment: str = "auto_adjusted"):
        self.spark, self.fetch, self.name, self.adjustment = spark, fetch, name, adjustment

    def get_history(self, symbols: Sequence[str], start, end) -> PriceBundle:
        wanted = prices.canonical_symbols(symbols)
        if isinstance(self.fetch, str):
            from panelforge.sources.feeds import read_prices

            return assemble(prices.normalise(read_prices(self.spark, self.fetch, wanted, start, end)), wanted, start, end, self.name, self.adjustment)
        day = lambda x: x if isinstance(x, dt.date) else dt.date.fromisoformat(str(x)[:10])
        rows = [(s, str(d), None if p is None else str(p), i) for i, (s, d, p) in enumerate(self.fetch(wanted, day(start), day(end) + dt.timedelta(days=1)))]
        raw = self.spark.createDataFrame(rows, "symbol string, date string, adjusted_close string, ordinal long")
        return assemble(prices.normalise(raw), wanted, start, end, self.name, self.adjustment)


class CachingProvider:
    """Cache first: a Parquet table partitioned by source, adjustment and snapshot.

    Only exactly the same symbol and window is a hit; only misses are fetched; empty results are not kept. Without a
    ``snapshot_id`` today's date is one.
    """

    def __init__(self, inner: PriceProvider, spark: SparkSession, path: str, snapshot_id: str | None = None):
        self.inner, self.spark, self.path, self.snapshot_id = inner, spark, path, snapshot_id
        self.name, self.adjustment = inner.name, inner.adjustment

    def cached(self) -> DataFrame:
        schema = "symbol string, session_date date, adjusted_close double, req_start date, req_end date, source string, adjustment string, snapshot_id string"
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path)

    def get_history(self, symbols: Sequence[str], start, end) -> PriceBundle:
        snapshot = self.snapshot_id or dt.date.today().isoformat()
        wanted = prices.requested(self.spark, symbols)
        lit = lambda value: F.to_date(F.lit(value))
        parts = {"source": scalars.path_part(F.lit(self.name)), "adjustment": scalars.path_part(F.lit(self.adjustment)), "snapshot_id": F.lit(snapshot)}
        same = (F.col("req_start") == lit(start)) & (F.col("req_end") == lit(end))
        for name, value in parts.items():
            same &= F.col(name) == value
        hits = self.cached().where(same).join(wanted.select("symbol"), "symbol", "left_semi").select("symbol", "session_date", "adjusted_close")
        misses = [r["symbol"] for r in wanted.join(hits.select("symbol").distinct(), "symbol", "left_anti").orderBy("position").collect()]
        panel = hits
        if misses:
            fresh = self.inner.get_history(misses, start, end).prices
            kept = fresh.select("*", lit(start).alias("req_start"), lit(end).alias("req_end"), *[v.alias(k) for k, v in parts.items()])
            kept.write.mode("append").partitionBy(*parts).parquet(self.path)
            panel = self.cached().where(same).join(wanted.select("symbol"), "symbol", "left_semi").select("symbol", "session_date", "adjusted_close")
        return assemble(panel, symbols, start, end, self.name, self.adjustment)


def get_price_provider(spark: SparkSession, name: str = "demo", *, path: str | None = None, cache_dir: str | None = None, snapshot_id: str | None = None, fetch: Callable | None = None):
    """A provider by name: demo, csv (needs ``path``) or eod (needs ``fetch``), with a cache if ``cache_dir`` is given."""
    if name == "demo":
        from panelforge.plans.demo import demo_panel

        provider = PanelProvider(demo_panel(spark))
    elif name == "csv":
        if not path:
            raise ValueError("the csv provider needs a path")
        provider = CSVProvider(spark, path)
    elif name == "eod":
        if fetch is None:
            raise ValueError("the eod provider needs a fetch function")
        provider = FetchProvider(spark, fetch)
    else:
        raise ValueError(f"unknown price provider: {name}")
    return CachingProvider(provider, spark, cache_dir, snapshot_id) if cache_dir else provider


def recent_prices(provider: PriceProvider, symbols: Sequence[str], end, lookback_days: int = 180) -> DataFrame:
    """Prices of the days up to ``end``."""
    last = dt.date.fromisoformat(str(end)[:10])
    return provider.get_history(symbols, last - dt.timedelta(days=lookback_days), last).prices

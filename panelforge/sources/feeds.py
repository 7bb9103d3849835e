"""Feeds from outside: prices by a data source with one partition a symbol, and news and earnings dates by injected functions.

A fetch function is named ``module:function``, so that executors import it, or given as a function, which is sent to them.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable, Iterable, Iterator, Sequence
from importlib import import_module

from panelforge.operators.prices import canonical_symbols
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual


def resolve(fetch: str | Callable) -> Callable:
    if callable(fetch):
        return fetch
    module, _, name = fetch.partition(":")
    return getattr(import_module(module), name)


class Prices(DataSource):
    """``symbol``, ``date``, ``adjusted_close`` (text) and ``ordinal`` of the symbols in a window whose end is included.

    Options: ``symbols`` (a JSON list), ``start``, ``end``, ``fetch``, the name of a function of symbols, first day and the day after
    the last that gives rows of symbol, date and price.
    """

    @classmethod
    def name(cls) -> str:
        return "panel_prices"

    def schema(self) -> str:
        return "symbol string, date string, adjusted_close string, ordinal long"

    def reader(self, schema) -> DataSourceReader:
        return PricesReader(self.options)


class PricesReader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def partitions(self) -> Sequence[InputPartition]:
        return [InputPartition(symbol) for symbol in json.loads(self.options["symbols"])]

    def read(self, partition) -> Iterator[tuple]:
        start, end = (dt.date.fromisoformat(self.options[k]) for k in ("start", "end"))
        for i, (symbol, day, price) in enumerate(resolve(self.options["fetch"])([partition.value], start, end + dt.timedelta(days=1))):
            yield symbol, str(day), None if price is None else str(price), i


def read_prices(spark: SparkSession, fetch: str, symbols: Sequence[str], start, end) -> DataFrame:
    spark.dataSource.register(Prices)
    wanted = json.dumps(canonical_symbols(symbols))
    return spark.read.format("panel_prices").options(symbols=wanted, start=str(start)[:10], end=str(end)[:10], fetch=fetch).load()


class Sessions(DataSource):
    """``symbol``, ``session_date`` and ``adjusted_close`` of the symbols from ``start`` to ``end``, both included.

    Options: ``symbols`` (a JSON list), ``start``, ``end``, ``fetch`` as for :class:`Prices`, ``partitions`` (the most there are, 64), ``attempts`` (4) and
    ``first_wait`` (0.5 seconds). What a query asks of the symbol and the day is asked of ``fetch``: other symbols and days are not fetched.
    Rows without a day or a price are left out; a fetch that fails with an error of the network is tried again and at last fails
    the query.
    """

    @classmethod
    def name(cls) -> str:
        return "panel_sessions"

    def schema(self) -> str:
        return "symbol string, session_date date, adjusted_close double"

    def reader(self, schema) -> DataSourceReader:
        return SessionsReader(self.options)


class SessionsReader(DataSourceReader):
    def __init__(self, options):
        self.options = options
        self.symbols = json.loads(options["symbols"])
        self.start, self.end = (dt.date.fromisoformat(options[k]) for k in ("start", "end"))

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Narrow what is fetched; filters that this does not settle go back to Spark."""
        day = dt.timedelta(days=1)
        for f in filters:
            column = getattr(f, "attribute", None)
            if column == ("symbol",) and isinstance(f, EqualTo):
                self.symbols = [s for s in self.symbols if s == f.value]
            elif column == ("symbol",) and isinstance(f, In):
                self.symbols = [s for s in self.symbols if s in f.value]
            elif column == ("session_date",) and isinstance(f, EqualTo | GreaterThanOrEqual | GreaterThan | LessThanOrEqual | LessThan):
                if isinstance(f, EqualTo | GreaterThanOrEqual):
                    self.start = max(self.start, f.value)
                if isinstance(f, EqualTo | LessThanOrEqual):
                    self.end = min(self.end, f.value)
                if isinstance(f, GreaterThan):
                    self.start = max(self.start, f.value + day)
                if isinstance(f, LessThan):
                    self.end = min(self.end, f.value - day)
            elif not (isinstance(f, IsNotNull) and column in {("symbol",), ("session_date",), ("adjusted_close",)}):
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        """Symbols by turns, so that each partition has as many."""
        symbols = self.symbols if self.start <= self.end else []
        n = max(1, min(len(symbols), int(self.options.get("partitions", 64))))
        return [InputPartition(symbols[i::n]) for i in range(n)]

    def read(self, partition) -> Iterator[tuple]:
        from .clients import with_retry

        fetch, after = resolve(self.options["fetch"]), self.end + dt.timedelta(days=1)
        for symbol in partition.value:
            rows = with_retry(lambda symbol=symbol: list(fetch([symbol], self.start, after)), int(self.options.get("attempts", 4)), float(self.options.get("first_wait", 0.5)))
            for name, day, price in rows:
                day = dt.date.fromisoformat(str(day)[:10]) if day is not None else None
                if day is not None and self.start <= day <= self.end and price is not None and price == price:
                    yield name, day, float(price)


def read_sessions(spark: SparkSession, fetch: str, symbols: Sequence[str], start, end, **options) -> DataFrame:
    """A panel by :class:`Sessions`. It lets Spark push filters to sources in Python, which is off by default."""
    spark.dataSource.register(Sessions)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    own = {k: str(v) for k, v in options.items()}
    return spark.read.format("panel_sessions").options(symbols=json.dumps(canonical_symbols(symbols)), start=str(start)[:10], end=str(end)[:10], fetch=fetch, **own).load()


#: Most tasks that call a feed at a time.
TASKS = 64


def _by_symbol(spark: SparkSession, symbols: Sequence[str], column: str, answer: Callable[[str], str | None]) -> DataFrame:
    wanted = canonical_symbols(symbols)
    schema = f"symbol string, {column} string"
    if not wanted:
        return spark.createDataFrame([], schema)

    def run(frames):
        for frame in frames:
            frame[column] = [answer(symbol) for symbol in frame["symbol"]]
            yield frame

    return spark.createDataFrame([(s,) for s in wanted], "symbol string").repartition(min(len(wanted), TASKS), "symbol").mapInPandas(run, schema)


def fetch_news(spark: SparkSession, symbols: Sequence[str], fetch: str | Callable) -> DataFrame:
    """``symbol`` and ``raw``, the JSON list of its news items; a fetch that fails or gives nothing is an empty list."""

    def answer(symbol: str) -> str:
        try:
            return json.dumps(resolve(fetch)(symbol) or [])
        except Exception:  # what the network does is no error of the feed
            return "[]"

    return _by_symbol(spark, symbols, "raw", answer)


def fetch_earnings(spark: SparkSession, symbols: Sequence[str], fetch: str | Callable) -> DataFrame:
    """``symbol`` and ``earnings_date``, the first date that the calendar gives as text; NULL if it fails or has none."""

    def answer(symbol: str) -> str | None:
        try:
            value = resolve(fetch)(symbol)
            if isinstance(value, dict):
                value = value.get("Earnings Date")
            if isinstance(value, list | tuple):
                value = value[0] if value else None
            return None if value is None else str(value)
        except Exception:
            return None

    return _by_symbol(spark, symbols, "earnings_date", answer)

"""Price panels: normalisation, windows, coverage, and as-of look-ups in packed series.

A panel has ``symbol``, ``session_date`` and ``adjusted_close``, one row for each symbol and session.

As-of look-ups don't sort probes with prices, which would put all probes of a symbol into one task, nor do they join each price
that a probe needs. A :class:`Market` keeps one row for each symbol: its sessions in order as arrays, and for each day how many of
them there are up to it. All prices, betas and extremes that a probe needs of a symbol are then read from the arrays by number, after
one equality join on the symbol.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from panelforge.functions import scalars
from panelforge.sources.shared import stored
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def normalise(raw: DataFrame) -> DataFrame:
    """A panel from text columns ``symbol``, ``date``, ``adjusted_close`` and the input order ``ordinal``.

    Rows without a date or number are dropped first; then the last one in input order wins for each session.
    """
    parsed = raw.select(
        scalars.symbol(F.col("symbol")).alias("symbol"), scalars.day(F.col("date")).alias("session_date"), scalars.number(F.col("adjusted_close")).alias("adjusted_close"), "ordinal"
    ).where(F.col("session_date").isNotNull() & scalars.is_number(F.col("adjusted_close")))
    # An aggregate, unlike a window, combines before the shuffle.
    return parsed.groupBy("symbol", "session_date").agg(F.max_by("adjusted_close", "ordinal").alias("adjusted_close"))


def clean_prices(raw: DataFrame, symbol: str = "symbol", time: str = "time", price: str = "price") -> DataFrame:
    """Text times as times without zone, rows without time or price left out, in order. Repeated times stay."""
    parsed = raw.withColumn(time, scalars.utc_naive(F.col(time).cast("string")))
    return clean_series(parsed.where(F.col(time).isNotNull()), symbol, time, price)


def clean_series(raw: DataFrame, symbol: str = "symbol", time: str = "time", price: str = "price") -> DataFrame:
    """A fetched series as it is, without NULL and NaN prices and in order; times keep their type and may repeat."""
    return raw.where(scalars.is_number(F.col(price))).orderBy(symbol, time)


def available(series: DataFrame, wanted: DataFrame, symbol: str = "symbol") -> DataFrame:
    """Whether each wanted symbol has any row."""
    known = series.select(symbol).distinct().withColumn("available", F.lit(True))
    return wanted.join(known, symbol, "left").withColumn("available", F.coalesce("available", F.lit(False)))


def merge_universe(*panels: DataFrame) -> DataFrame:
    """One panel of several: of a symbol that more than one has, the whole series of the last one counts."""
    ranked = [p.select("symbol", "session_date", "adjusted_close", F.lit(i).alias("_rank")) for i, p in enumerate(panels)]
    every = ranked[0]
    for more in ranked[1:]:
        every = every.unionByName(more)
    last = every.groupBy("symbol").agg(F.max("_rank").alias("_rank"))
    return every.join(last, ["symbol", "_rank"], "left_semi").drop("_rank")


def window_slice(panel: DataFrame, start, end) -> DataFrame:
    """Sessions from ``start`` to ``end``, both included; times count as their day."""
    return panel.where(F.col("session_date").between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))


def canonical_symbols(symbols: Sequence[str]) -> list[str]:
    """Stripped, in upper case, each once, in the order of first mention."""
    return list(dict.fromkeys(str(s).strip().upper() for s in symbols))


def requested(spark, symbols: Sequence[str]) -> DataFrame:
    rows = [(i, s) for i, s in enumerate(canonical_symbols(symbols))]
    return spark.createDataFrame(rows, "position int, symbol string")


def coverage(panel: DataFrame, wanted: DataFrame) -> DataFrame:
    """First and last session of each wanted symbol; NULL for one without prices."""
    spans = panel.groupBy("symbol").agg(F.min("session_date").alias("actual_start"), F.max("session_date").alias("actual_end"))
    return wanted.join(spans, "symbol", "left")


def missing_symbols(panel: DataFrame, wanted: DataFrame) -> DataFrame:
    return wanted.join(panel.select("symbol").distinct(), "symbol", "left_anti")


def simple_returns(panel: DataFrame, period: str | None = None) -> DataFrame:
    """``ret``: the change to the symbol's previous own session; a previous price of zero gives none.

    ``period`` is for series of so many rows that one symbol's are too many for a task (:func:`in_blocks`).
    """
    if period is None:
        before = F.lag("adjusted_close").over(Window.partitionBy("symbol").orderBy("session_date"))
        return panel.withColumn("ret", scalars.ratio_less_one(F.col("adjusted_close"), before))
    before = F.lag("adjusted_close").over(Window.partitionBy("symbol", "_block").orderBy("_number"))
    blocks = in_blocks(panel, ["symbol"], "session_date", 1, period)
    return blocks.withColumn("ret", scalars.ratio_less_one(F.col("adjusted_close"), before)).where("_own").select(*panel.columns, "ret")


def in_blocks(rows: DataFrame, keys: list[str], time: str, reach: int, period: str, size: int = 4096) -> DataFrame:
    """``rows`` in blocks of ``size`` consecutive rows of their keys, each with the ``reach`` rows before it: for windows over long series.

    A series of many rows, such as minute bars, is then no one task's sort: rows are numbered within a ``period`` (a unit of
    date_trunc that has few of them) after the counts of earlier periods, and windows run by ``_block`` in the order of ``_number``. ``_own`` says
    that a row is of the block itself; the others serve its first windows and are left out of the result. ``reach`` is at most ``size``.
    """
    placed = rows.withColumn("_period", F.date_trunc(period, F.col(time)))
    sizes = placed.groupBy(*keys, "_period").agg(F.count("*").alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_period").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(*keys, "_period", F.coalesce(earlier, F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy(*keys, "_period").orderBy(time)) - 1
    numbered = placed.withColumn("_within", within).join(sizes, [*keys, "_period"]).withColumn("_number", F.col("_before") + F.col("_within")).drop("_within", "_before", "_period")
    block = F.expr(f"_number div {size}")
    serves = F.col("_number") % size >= size - reach
    blocks = F.explode(F.when(serves, F.array(block, block + 1)).otherwise(F.array(block)))
    return numbered.withColumn("_block", blocks).withColumn("_own", F.col("_block") == block)


def session_calendar(panel: DataFrame, benchmark: str) -> DataFrame:
    """The benchmark's sessions with their ordinal from 1. One row for each session, so one window is small."""
    days = panel.where(F.col("symbol") == benchmark).select("session_date").distinct()
    return days.withColumn("ord", F.row_number().over(Window.orderBy("session_date")))


def after_day(ts: Column) -> Column:
    """The first day whose midnight is at or after a time."""
    midnight = F.date_trunc("day", ts) == ts
    return F.to_date(ts) + F.when(midnight, 0).otherwise(1)


def beyond(df: DataFrame) -> tuple:
    """A day before the first and a day after the last session, between which all look-ups are moved, and how many symbols there are."""
    row = df.agg(F.date_sub(F.min("session_date"), 1).alias("low"), F.date_add(F.max("session_date"), 1).alias("high"), F.countDistinct("symbol").alias("n")).first()
    return row["low"], row["high"], row["n"]


class Series:
    """The packed series of one symbol as columns, and what is read from it; NULL where there is nothing.

    A place is the number of a day from :meth:`Market.place`; sessions are numbered from 0.
    """

    def __init__(self, dates: Column, prices: Column, betas: Column, lows: Column, highs: Column, upto: Column):
        self.dates, self.prices, self.betas, self.lows, self.highs, self.upto = dates, prices, betas, lows, highs, upto

    def sessions_before(self, place: Column) -> Column:
        """How many sessions there are strictly before the day."""
        return F.when(place.isNotNull(), F.coalesce(F.get(self.upto, place - 1), F.lit(0)))

    def on_or_after(self, place: Column) -> Column:
        return F.get(self.prices, self.sessions_before(place))

    def on_or_before(self, place: Column) -> Column:
        return F.get(self.prices, F.get(self.upto, place) - 1)

    def on(self, place: Column) -> Column:
        return F.when(F.get(self.upto, place) > self.sessions_before(place), self.on_or_before(place))

    def beta_before(self, place: Column) -> Column:
        """The beta of the last joint session strictly before the day."""
        return F.get(self.betas, self.sessions_before(place) - 1)

    def ahead(self, place: Column, horizon: Column) -> Column:
        """The day of the so many-th session strictly after the day."""
        return F.get(self.dates, F.get(self.upto, place) + horizon - 1)

    def extremes(self, start: Column, end: Column) -> tuple[Column, Column, Column]:
        """First, lowest and highest price from one day to another, both included: two look-ups, however many sessions lie between."""
        first, last = self.sessions_before(start), F.get(self.upto, end) - 1
        good = (start <= end) & (first <= last)
        level = F.length(F.bin(last - first + 1)) - 1  # of the longest run that is kept and fits
        second = last - F.call_function("shiftleft", F.lit(1), level) + 1
        of = lambda table, better: F.when(good, better(F.get(F.get(table, level), first), F.get(F.get(table, level), second)))
        return F.when(good, F.get(self.prices, first)), of(self.lows, F.least), of(self.highs, F.greatest)


class Market:
    """A panel with what look-ups need of it, made once and kept.

    ``series`` has a row for each symbol: ``dates`` and ``prices`` of its sessions, ``betas`` (of the last session up to each that the
    benchmark shares), ``lows`` and ``highs`` (for each k the extremes of the 2**k sessions from each on) and ``upto`` (for each
    day from ``low`` to ``high`` the number of sessions up to it). ``sessions`` and ``calendar`` are the benchmark's calendar as tables.
    All of these grow with symbols and days alone, not with signals. The series are written to the shared folder, and all is cached, so
    a lost executor costs a read. The series are broadcast while they are at most :data:`SENT` bytes; else look-ups shuffle by symbol.
    """

    #: Bytes of all series that a join may broadcast.
    SENT = 64_000_000

    def __init__(self, panel: DataFrame, benchmark: str, lookback: int = 120):
        from .returns import rolling_betas

        self.benchmark = benchmark
        self.panel = panel.select("symbol", "session_date", "adjusted_close").persist()
        self.low, self.high, symbols = beyond(self.panel)
        self.calendar = session_calendar(self.panel, benchmark).persist()
        self.n_days = (self.high - self.low).days + 1 if self.low else 0
        betas = rolling_betas(self.panel, benchmark, lookback).select("symbol", "session_date", F.struct("beta").alias("joint"))
        rows = self.panel.where("adjusted_close is not null").join(betas, ["symbol", "session_date"], "left")
        order = Window.partitionBy("symbol").orderBy("session_date")
        so_far = F.last("joint", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
        rows = rows.select("symbol", "session_date", F.col("adjusted_close").alias("p"), so_far["beta"].alias("beta"), F.col("adjusted_close").alias("low0"), F.col("adjusted_close").alias("high0"))
        # Twice as long a run from a session on is that run and the one that follows it.
        levels = max(1, self.n_days.bit_length())
        for k in range(levels - 1):
            later = lambda name, k=k: F.lead(f"{name}{k}", 1 << k).over(order)
            rows = rows.select("*", F.least(f"low{k}", later("low")).alias(f"low{k + 1}"), F.greatest(f"high{k}", later("high")).alias(f"high{k + 1}"))
        held = F.sort_array(F.collect_list(F.struct("session_date", *[c for c in rows.columns if c not in ("symbol", "session_date")])))
        packed = rows.groupBy("symbol").agg(held.alias("held"))
        every = lambda name: F.transform("held", lambda x: x[name])
        following = F.transform("held", lambda x, i: F.date_diff(F.coalesce(F.get("held", i + 1)["session_date"], F.date_add(F.lit(self.high), 1)), x["session_date"]))
        before = F.array_repeat(F.lit(0), F.date_diff(F.get("held", F.lit(0))["session_date"], F.lit(self.low)))
        upto = F.concat(before, F.flatten(F.transform(following, lambda n, i: F.array_repeat(i + 1, n))))
        table = lambda name: F.array(*[every(f"{name}{k}") for k in range(levels)])
        series = packed.select("symbol", every("session_date").alias("dates"), every("p").alias("prices"), every("beta").alias("betas"), table("low").alias("lows"), table("high").alias("highs"), upto.alias("upto"))
        # Written, so that the plans of look-ups do not repeat how they were made.
        self.series = stored(series, "series").persist()
        self.sent = (symbols or 0) * self.n_days * (24 + 16 * levels) <= self.SENT
        start = self.calendar.sparkSession.createDataFrame([(self.low, 0)], "session_date date, ord int")
        self.sessions = spread(self.calendar.unionByName(start), [], self.high).select("day", F.col("ord").alias("n_le")).persist()

    def release(self) -> None:
        for kept in (self.panel, self.calendar, self.series, self.sessions):
            kept.unpersist()

    def place(self, day: Column) -> Column:
        """The number of a day, moved into the calendar; NULL of NULL."""
        return F.when(day.isNotNull(), F.date_diff(F.greatest(F.least(day, F.lit(self.high)), F.lit(self.low)), F.lit(self.low)))

    def own(self) -> Series:
        """The benchmark's series: one row, read once by each query as scalars, as long as the calendar."""
        row = self.series.where(F.col("symbol") == self.benchmark)
        return Series(*[row.select(c).scalar() for c in ("dates", "prices", "betas", "lows", "highs", "upto")])

    def read(self, probes: DataFrame, symbol: str, columns: Callable[[Series], dict[str, Column]]) -> DataFrame:
        """``probes`` with the ``columns`` that are made of the series of ``symbol``; of a symbol without one all are NULL."""
        names = ("dates", "prices", "betas", "lows", "highs", "upto")
        series = self.series.select(F.col("symbol").alias("_s"), *[F.col(c).alias(f"_{c}") for c in names])
        joined = probes.join(F.broadcast(series) if self.sent else series, F.col(f"`{symbol}`") == F.col("_s"), "left")
        made = columns(Series(*[F.col(f"_{c}") for c in names]))
        return joined.select(*[F.col(f"`{c}`") for c in probes.columns if c not in made], *[c.alias(name) for name, c in made.items()])

    def horizon_end(self, keys: DataFrame, created: str = "created_day", horizon: str = "horizon_days") -> DataFrame:
        """Add ``horizon_end``: the so many-th session strictly after the day; NULL if the calendar ends before."""
        return keys.withColumn("horizon_end", self.own().ahead(self.place(F.col(created)), F.col(horizon)))


def spread(rows: DataFrame, keys: list[str], high) -> DataFrame:
    """Each row once for every ``day`` from its session to the day before the next one of its keys, the last up to ``high``."""
    order = Window.partitionBy(*keys).orderBy("session_date")
    last = F.coalesce(F.date_sub(F.lead("session_date").over(order), 1), F.lit(high))
    return rows.withColumn("_last", last).withColumn("day", F.explode(F.sequence("session_date", "_last"))).drop("_last")

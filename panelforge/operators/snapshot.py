"""Trailing returns and the market snapshot."""

from __future__ import annotations

from panelforge.functions import scalars
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SPANS = (5, 20, 60)
CHART_ROWS = 63


def latest(panel: DataFrame) -> DataFrame:
    """``latest``: the value of each symbol's last session."""
    return panel.groupBy("symbol").agg(F.max_by("adjusted_close", "session_date").alias("latest"))


def ticker_metrics(panel: DataFrame) -> DataFrame:
    """``latest``, trailing returns over 5, 20 and 60 rows, and the distance from the high, for each symbol."""
    order = Window.partitionBy("symbol").orderBy(F.desc("session_date"))
    recent = panel.withColumn("n", F.row_number().over(order))
    # Values so many rows back, found by one aggregate.
    back = {n: F.max(F.when(F.col("n") == n + 1, F.col("adjusted_close"))) for n in (0, *SPANS)}
    packed = recent.groupBy("symbol").agg(*[value.alias(f"p{n}") for n, value in back.items()], F.max("adjusted_close").alias("high"))
    trailing = [scalars.ratio_less_one(F.col("p0"), F.col(f"p{n}")).alias(f"return_{n}d") for n in SPANS]
    return packed.select("symbol", F.col("p0").alias("latest"), *trailing, scalars.ratio_less_one(F.col("p0"), F.col("high")).alias("distance_from_high"))


def market_snapshot(panel: DataFrame, wanted: DataFrame) -> DataFrame:
    """Metrics of each wanted symbol, and whether it has any price."""
    joined = wanted.join(ticker_metrics(panel).withColumn("available", F.lit(True)), "symbol", "left")
    return joined.withColumn("available", F.coalesce("available", F.lit(False)))


def last_rows(panel: DataFrame, rows: int = CHART_ROWS) -> DataFrame:
    order = Window.partitionBy("symbol").orderBy(F.desc("session_date"))
    return panel.withColumn("n", F.row_number().over(order)).where(F.col("n") <= rows).drop("n")

"""The engine's logical tables over the sample star schema.

Prices: a symbol is a nation, its price on a day the average unit price of that day's line items; the benchmark MKT takes all
nations, a sector proxy all of a region. MIDDLE EAST has no proxy, to exercise the market-only path. Signals: one for each
order, whose ticker is the customer's nation.
"""

from __future__ import annotations

from panelforge.operators.prices import Market
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BENCHMARK = "MKT"
NO_PROXY = "MIDDLE EAST"
THEMES = {
    "AUTOMOBILE": "Consumer Cyclical / Autos",
    "BUILDING": "Utilities and Power",
    "FURNITURE": "enterprise software tools",
    "HOUSEHOLD": "AI Infrastructure / Semiconductor",
    "MACHINERY": "Machinery",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel of nations, regions and the benchmark, from one scan of the line items."""
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    supplier = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name", "r_name")
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", F.to_date("l_shipdate").alias("session_date"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("p"))
    daily = lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("n_name", "r_name", "session_date").agg(F.sum("p").alias("total"), F.count("*").alias("n"))
    proxy = F.when(F.col("r_name") != NO_PROXY, F.col("r_name"))
    each = daily.select(F.explode(F.array_compact(F.array("n_name", proxy, F.lit(BENCHMARK)))).alias("symbol"), "session_date", "total", "n")
    return each.groupBy("symbol", "session_date").agg((F.sum("total") / F.sum("n")).alias("adjusted_close"))


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ticker`` and ``sector_proxy`` of each nation."""
    joined = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select("n_nationkey", F.col("n_name").alias("ticker"), F.when(F.col("r_name") != NO_PROXY, F.col("r_name")).alias("sector_proxy"))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals_of(spark, sf_dir, table(spark, sf_dir, "orders"))


def signals_of(spark: SparkSession, sf_dir: str, orders: DataFrame) -> DataFrame:
    """The signals of orders, which may be a stream."""
    priority = {"1-URGENT": 1, "2-HIGH": 3, "3-MEDIUM": 5, "4-NOT SPECIFIED": 20, "5-LOW": 60}
    owner = table(spark, sf_dir, "customer").join(nations(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_mktsegment", "ticker", "sector_proxy")
    orders = orders.join(owner, F.col("o_custkey") == F.col("c_custkey"))
    pick = lambda column, names: F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[F.col(column)]
    first = F.substring("o_orderpriority", 1, 1).cast("int")
    horizon = F.element_at(F.array(*map(F.lit, priority.values())), first)
    return orders.select(
        F.col("o_orderkey").alias("id"), "ticker", F.col("o_orderdate").alias("created_at"), horizon.alias("horizon_days"), "sector_proxy",
        pick("o_orderstatus", {"P": "positive", "F": "negative", "O": "neutral"}).alias("sentiment"), (F.col("o_orderkey") % 101).cast("double").alias("setup_score"),
        ((F.col("o_orderkey") * 7) % 101).cast("double").alias("rsi"), F.lit(None).cast("double").alias("return_20d"), (F.col("o_totalprice") > 250000).alias("volume"),
        F.coalesce(pick("c_mktsegment", THEMES), F.col("c_mktsegment")).alias("theme"),
    )


_MARKETS: dict[tuple[str, str], tuple[tuple, Market]] = {}


def market(spark: SparkSession, sf_dir: str) -> Market:
    """The market of a data directory, made once for each Spark application and again, with the old one released, when its files change."""
    key = (spark.sparkContext.applicationId, sf_dir)
    state = _state(spark, sf_dir)
    if key not in _MARKETS or _MARKETS[key][0] != state:
        if key in _MARKETS:
            _MARKETS.pop(key)[1].release()
        _MARKETS[key] = state, Market(universe(spark, sf_dir), BENCHMARK)
    return _MARKETS[key][1]


def _state(spark: SparkSession, sf_dir: str) -> tuple:
    """Size and time of the line items' file or folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/lineitem.parquet")
    status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
    return status.getLen(), status.getModificationTime()


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned decisions, one for each order, some of them not valid."""
    orders = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))
    from panelforge.functions.pretrade import DOMAINS

    return orders.select(
        key.alias("decision_id"), F.when(key % 17 == 0, "  ").otherwise(F.concat(F.lit(" t"), (key % 50).cast("string"))).alias("ticker"), F.lit("theme").alias("theme"), F.lit("thesis").alias("entry_thesis"),
        pick([*DOMAINS["event_type"], "unknown"], key).alias("event_type"), pick(DOMAINS["planned_action"], F.floor(key / 3)).alias("planned_action"),
        pick(DOMAINS["instrument_type"], F.floor(key / 2)).alias("instrument_type"), pick(DOMAINS["market_expectation"], F.floor(key / 5)).alias("market_expectation"),
        pick(DOMAINS["confidence"], key).alias("confidence"), F.when(key % 3 != 0, "entered").alias("status"), (key % 40).cast("int").alias("horizon_days"),
        pick(["below the 50 day line", " IDK ", "", "tbd", "close under 90"], F.floor(key / 7)).alias("invalidation_rule"), (key % 113).cast("double").alias("position_size"),
        F.when(key % 4 != 0, (key % 9 - 1) / F.lit(2.0)).alias("max_loss"),
    )

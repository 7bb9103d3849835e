"""Signal snapshots and their outcomes as Parquet tables: append, latest-wins upsert, and the two joins."""

from __future__ import annotations

from panelforge.functions import rules, scalars
from panelforge.sources import log
from panelforge.sources.shared import hadoop_path, stored
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The columns of the tables.
SNAPSHOTS = (
    "id bigint, ticker string, created_at timestamp_ntz, horizon_days int, classification string, score double, theme string, benchmark string, sector_proxy string, "
    "price_at_creation double, rule_version string"
)
OUTCOMES = (
    "signal_id bigint, forward_return double, forward_abnormal_return double, max_drawdown double, max_runup double, hit boolean, trade_hit boolean, watch_followthrough boolean, "
    "avoided_bad_trade boolean, false_negative boolean, evaluated_at timestamp_ntz, is_matured boolean"
)
# What the tables of snapshots, outcomes and groups show.
SNAPSHOT_COLUMNS = ["ticker", "theme", "classification", "score", "horizon_days", "benchmark", "sector_proxy", "price_at_creation", "rule_version", "created_at"]
OUTCOME_COLUMNS = [
    "ticker", "classification", "horizon_days", "raw_return", "market_return", "beta", "beta_fallback_used", "combined_abnormal_return", "trade_hit", "watch_followthrough",
    "avoided_bad_trade", "false_negative", "max_drawdown", "max_runup", "data_quality_flag",
]
GROUP_COLUMNS = [
    "horizon_days", "classification", "sample_size", "sample_positive_rate", "base_rate", "trade_hit_rate", "excess_trade_hit_rate", "watch_followthrough_rate", "avoided_bad_trade_rate",
    "false_negatives", "average_forward_abnormal_return",
]


def with_schema(df: DataFrame, schema: str) -> DataFrame:
    """The declared columns, absent ones as NULL, others dropped: older and wider tables load alike."""
    empty = df.sparkSession.createDataFrame([], schema)
    return df.select(*[(F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in empty.schema])


def canonical_snapshots(df: DataFrame) -> DataFrame:
    """As they are stored: canonical ticker, '' for no proxy, checked horizon."""
    df = df.withColumn("ticker", scalars.symbol(F.col("ticker"))).withColumn("sector_proxy", F.coalesce("sector_proxy", F.lit("")))
    return df.withColumn("horizon_days", rules.checked_horizon(F.col("horizon_days")))


def latest_outcomes(batches: DataFrame, order: str = "batch_seq") -> DataFrame:
    """For each signal the whole row of its last batch. An aggregate combines before the shuffle.

    Of several rows of one batch the greatest by the hash of its columns counts, so that reruns agree.
    """
    columns = [c for c in batches.columns if c not in ("signal_id", order)]
    last = batches.groupBy("signal_id").agg(F.max_by(F.struct(*columns), F.struct(order, F.xxhash64(*columns))).alias("row"))
    return last.select("signal_id", "row.*")


def snapshots_with_outcomes(snapshots: DataFrame, outcomes: DataFrame) -> DataFrame:
    return snapshots.join(outcomes.withColumnRenamed("signal_id", "id"), "id", "left")


def in_order(records: DataFrame) -> DataFrame:
    """As they were created: by time, then id."""
    return records.orderBy("created_at", "id")


def display(records: DataFrame, columns: list[str]) -> DataFrame:
    """Those of the columns that the records have, in the order given; a frame without columns gets them all as text."""
    if not records.columns:
        return records.sparkSession.createDataFrame([], ", ".join(f"`{c}` string" for c in columns))
    return records.select(*[c for c in columns if c in records.columns])


def matured_records(snapshots: DataFrame, outcomes: DataFrame) -> DataFrame:
    return snapshots.join(outcomes.where("is_matured").withColumnRenamed("signal_id", "id"), "id")


def provenance(records: DataFrame, metadata: DataFrame, source: str, adjustment: str) -> DataFrame:
    """Add where each ticker's prices come from, and all quality flags in one array: the metadata's, then the engine's."""
    known = metadata.select(
        F.col("symbol").alias("ticker"), F.col("source").alias("_source"), F.col("adjustment").alias("_adjustment"), "actual_start", "actual_end", F.col("data_quality_flags").alias("_flags")
    )
    joined = records.join(known, "ticker", "left")
    engine = F.filter(F.split(F.when(F.col("data_quality_flag") != "ok", F.col("data_quality_flag")), ","), lambda x: x != "")
    none = F.array().cast("array<string>")
    return joined.select(
        *records.columns, F.coalesce("_source", F.lit(source)).alias("price_source"), F.coalesce("_adjustment", F.lit(adjustment)).alias("price_adjustment"),
        scalars.iso_seconds(F.col("actual_start")).alias("price_actual_start"), scalars.iso_seconds(F.col("actual_end")).alias("price_actual_end"),
        F.concat(F.coalesce("_flags", none), F.coalesce(engine, none)).alias("data_quality_flags"),
    )


class SignalStore:
    """Both tables under one folder. Snapshots are only added; outcomes are a log of which the latest row of each signal counts."""

    def __init__(self, spark: SparkSession, path: str, batches: int = log.BATCHES):
        self.spark, self.path = spark, path.rstrip("/")
        self.log = log.LatestLog(spark, f"{self.path}/signal_outcomes", OUTCOMES, "signal_id", batches=batches)

    def snapshots(self) -> DataFrame:
        path = f"{self.path}/signal_snapshots"
        folder, files = hadoop_path(self.spark, path)
        if not files.exists(folder):
            return self.spark.createDataFrame([], SNAPSHOTS)
        return with_schema(self.spark.read.option("mergeSchema", True).parquet(path), SNAPSHOTS)

    def outcomes(self) -> DataFrame:
        return self.log.read()

    def insert(self, signals: DataFrame) -> None:
        """Append signals; ids go on from the highest one, in the order of time and ticker.

        Rows are dealt out by ranges of that order, however many one day has, and numbered by what ranges before their own hold and
        their place in it; rows that are equal in all of the order may stand in any. The ranges are written first, as numbers must not change
        if a task runs again. Numbers go on from what was read, so inserts come one after another.
        """
        start = self.snapshots().agg(F.coalesce(F.max("id"), F.lit(0)).alias("n")).first()["n"]
        order = ["created_at", "ticker", "horizon_days", "classification", "score", "price_at_creation"]
        rows = with_schema(canonical_snapshots(signals.drop("id")), SNAPSHOTS)
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        ranged = stored(rows.withColumn("_tie", F.rand()).repartitionByRange(parts, *order, "_tie").withColumn("_part", F.spark_partition_id()), "ranged")
        sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
        # One row for each range.
        sizes = sizes.select(F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
        place = F.row_number().over(Window.partitionBy("_part").orderBy(*order, "_tie"))
        numbered = ranged.withColumn("_row", place).join(F.broadcast(sizes), F.col("_part") == F.col("_p"))
        numbered = numbered.withColumn("id", F.lit(start) + F.col("_before") + F.col("_row"))
        with_schema(numbered, SNAPSHOTS).write.mode("append").parquet(f"{self.path}/signal_snapshots")

    def upsert(self, outcomes: DataFrame) -> None:
        """Replace whole outcome rows: a later batch wins."""
        self.log.append(with_schema(outcomes, OUTCOMES))

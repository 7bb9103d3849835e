"""Results of runs as tables: events, their studies by horizon, and metrics by group, kept by run.

Each table is partitioned by run and, where its rows have one, by horizon. Writing replaces the partitions that the rows
belong to and leaves all others (dynamic partition overwrite), so a run that is repeated leaves the same rows and never doubles them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import hadoop_path

ABNORMAL = "raw_return double, market_return double, sector_return double, beta double, beta_fallback_used boolean, beta_adjusted_abnormal_return double, sector_adjusted_abnormal_return double, combined_abnormal_return double"

# The columns of the tables.
TABLES = {
    "event_studies": ("run_id string, horizon_days int, ticker string, sector_proxy string, created_day date, end_day date, " + ABNORMAL + ", data_quality_flag string", ["run_id", "horizon_days"]),
    "outcomes": (
        "run_id string, horizon_days int, id bigint, ticker string, created_at timestamp_ntz, classification string, status string, horizon_end date, forward_return double, "
        "forward_abnormal_return double, max_drawdown double, max_runup double, hit boolean, trade_hit boolean, watch_followthrough boolean, avoided_bad_trade boolean, false_negative boolean, data_quality_flag string",
        ["run_id", "horizon_days"],
    ),
    "metrics": (
        "run_id string, horizon_days int, classification string, sample_size bigint, sample_positive_rate double, base_rate double, trade_hit_rate double, excess_trade_hit_rate double, "
        "watch_followthrough_rate double, avoided_bad_trade_rate double, false_negatives bigint, average_forward_abnormal_return double",
        ["run_id", "horizon_days"],
    ),
}


@dataclass
class ResultTables:
    """The tables under one folder."""

    spark: SparkSession
    path: str

    def write(self, table: str, run_id: str, rows: DataFrame) -> None:
        """Replace what the run has for the horizons of ``rows``. Columns that are not declared are left out, absent ones are NULL."""
        schema, partitions = TABLES[table]
        fields = self.spark.createDataFrame([], schema).schema
        own = rows.drop("run_id").withColumn("run_id", F.lit(run_id))
        declared = own.select(*[(F.col(f.name).cast(f.dataType) if f.name in own.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in fields])
        declared.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(f"{self.path}/{table}")

    def read(self, table: str, run_id: str | None = None) -> DataFrame:
        """The rows of a run, or of all; partitions of other runs are not read."""
        schema, _ = TABLES[table]
        folder, files = hadoop_path(self.spark, f"{self.path}/{table}")
        if not files.exists(folder):
            return self.spark.createDataFrame([], schema)
        names = self.spark.createDataFrame([], schema).columns
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/{table}").select(*names)
        return rows if run_id is None else rows.where(F.col("run_id") == run_id)

    def runs(self, table: str) -> list[str]:
        return sorted(r["run_id"] for r in self.read(table).select("run_id").distinct().collect())

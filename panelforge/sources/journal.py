"""The decision journal: JSON lines, appended, and read with bad lines left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def encode_records(df: DataFrame, decision: Column, evaluation: Column, saved_at: Column | None = None) -> DataFrame:
    """One JSON text ``value`` for each row: saved_at, decision and evaluation."""
    moment = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssxxx") if saved_at is None else saved_at
    record = F.struct(moment.alias("saved_at"), decision.alias("decision"), evaluation.alias("evaluation"))
    return df.select(F.to_json(record, {"ignoreNullFields": "false"}).alias("value"))


def append_records(lines: DataFrame, path: str) -> None:
    lines.write.mode("append").text(path)


def parse_lines(lines: DataFrame) -> DataFrame:
    """``record`` (a VARIANT) of each line that is valid JSON, with the line's text; blank and bad lines go."""
    parsed = lines.where(F.trim("value") != "").select("value", F.try_parse_json("value").alias("record"))
    return parsed.where("record is not null")


def load_records(spark: SparkSession, path: str) -> DataFrame:
    """All valid records; none if there is no file."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return parse_lines(spark.createDataFrame([], "value string"))
    return parse_lines(spark.read.text(path))


DECISION = (
    "decision_id string, created_at string, ticker string, theme string, event_type string, planned_action string, instrument_type string, horizon_days int, market_expectation string, "
    "entry_thesis string, risk_thesis string, max_loss double, invalidation_rule string, confidence string, position_size double, notes string, status string"
)


def typed_records(records: DataFrame) -> DataFrame:
    """``saved_at``, ``decision``, ``flags`` and ``evaluation`` as typed structs of the known keys; other keys are left out.

    A flag that is absent is false; the two notes on an evaluation are always true.
    """
    from panelforge.functions.pretrade import FLAGS

    get = lambda path, kind: F.try_variant_get("record", path, kind)
    decision = [get(f"$.decision.{f.split()[0]}", f.split()[1]).alias(f.split()[0]) for f in DECISION.split(", ")]
    flags = [F.coalesce(get(f"$.evaluation.flags.{name}", "boolean"), F.lit(False)).alias(name) for name in FLAGS]
    reasons = F.coalesce(get("$.evaluation.reasons", "array<string>"), F.array().cast("array<string>"))
    evaluation = F.struct(get("$.evaluation.verdict", "string").alias("verdict"), reasons.alias("reasons"), F.lit(True).alias("heuristic_only"), F.lit(True).alias("not_financial_advice"))
    return records.select(get("$.saved_at", "string").alias("saved_at"), F.struct(*decision).alias("decision"), F.struct(*flags).alias("flags"), evaluation.alias("evaluation"))


def journal_view(records: DataFrame) -> DataFrame:
    """``saved_at``, ``ticker`` and ``verdict``, '' where absent."""
    part = lambda path: F.coalesce(F.try_variant_get("record", path, "string"), F.lit(""))
    return records.select(part("$.saved_at").alias("saved_at"), part("$.decision.ticker").alias("ticker"), part("$.evaluation.verdict").alias("verdict"))

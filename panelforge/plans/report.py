"""The demo run's figures as lines of text: ``python -m panelforge.plans.report``."""

from __future__ import annotations

from panelforge.plans import pipeline
from panelforge.sources.providers import get_price_provider
from pyspark.sql import SparkSession

LINES = [
    ("records", "sample_size"), ("tradeable hit rate", "trade_hit_rate"), ("cohort base rate", "base_rate"), ("excess trade hit rate", "excess_trade_hit_rate"),
    ("avg forward abnormal return", "average_forward_abnormal_return"), ("median forward abnormal return", "median_forward_abnormal_return"), ("false positives", "false_positives"),
    ("false negatives", "false_negatives"), ("avoid chase records", "avoid_chase_count"),
]
OF_GROUP = ("trade_hit_rate", "base_rate", "excess_trade_hit_rate")


def report_lines(spark: SparkSession) -> list[str]:
    """A title and nine figures; those of the tradeable group are None without one."""
    tables = pipeline.validation_lab(get_price_provider(spark), spark)
    summary = tables["summary"].first().asDict()
    group = tables["groups"].where("classification = 'Tradeable'").orderBy("horizon_days").first()
    values = summary | {k: None if group is None else group[k] for k in OF_GROUP}
    return ["validation demo", *[f"{label}: {values[key]}" for label, key in LINES]]


if __name__ == "__main__":
    session = SparkSession.builder.appName("validation demo").getOrCreate()
    print("\n".join(report_lines(session)))
    session.stop()

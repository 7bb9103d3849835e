"""Metrics of evaluated signals against the base rate of a cohort."""

from __future__ import annotations

from panelforge.functions import scalars
from panelforge.operators import selection
from panelforge.sources.shared import stored
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rate(flag: Column) -> Column:
    """Share of true among those that are not NULL; NULL if none is."""
    return F.avg(flag.cast("int"))


def matured(records: DataFrame) -> DataFrame:
    return records.where(F.col("is_matured") & F.col("forward_abnormal_return").isNotNull())


def count_risers(cohort: DataFrame) -> DataFrame:
    """Partials of base rates: by ``horizon_days`` and ``key`` (the date) the rows with a return, ``n``, and the risers among them, ``up``."""
    rows = cohort.where("forward_abnormal_return is not null").select("horizon_days", scalars.date_key(F.col("created_at")).alias("key"), "forward_abnormal_return")
    return rows.groupBy("horizon_days", "key").agg(F.count("*").alias("n"), F.count_if(scalars.above(F.col("forward_abnormal_return"), 0.0)).alias("up"))


def merge_counts(*counts: DataFrame) -> DataFrame:
    """The sum of partials, such as those of other dates or other tickers."""
    every = counts[0]
    for more in counts[1:]:
        every = every.unionByName(more)
    return every.groupBy("horizon_days", "key").agg(F.sum("n").alias("n"), F.sum("up").alias("up"))


def base_rates(records: DataFrame, cohort: DataFrame) -> DataFrame:
    """``base_rate`` by horizon and class: the share of risers among the cohort of the group's dates and horizon.

    ``cohort`` is the cohort itself or its partials (:func:`count_risers`). A cohort row counts once for each group, however many
    signals share its date. NULL dates match each other.
    """
    dates = records.select("horizon_days", "classification", scalars.date_key(F.col("created_at")).alias("key")).distinct()
    counts = cohort if "up" in cohort.columns else count_risers(cohort)
    sums = counts.select(F.col("horizon_days").alias("h"), F.col("key").alias("k"), "n", "up")
    joined = dates.join(sums, (F.col("horizon_days") == F.col("h")) & F.col("key").eqNullSafe(F.col("k")))
    return joined.groupBy("horizon_days", "classification").agg(F.try_divide(F.sum("up"), F.sum("n")).alias("base_rate"))


def group_metrics(records: DataFrame, cohort: DataFrame) -> DataFrame:
    """One row for each horizon and class of the matured records."""
    records = matured(records)
    groups = records.groupBy("horizon_days", "classification").agg(
        F.count("*").alias("sample_size"),
        rate(scalars.above(F.col("forward_abnormal_return"), 0.0)).alias("sample_positive_rate"),
        rate(F.col("trade_hit")).alias("trade_hit_rate"),
        rate(F.col("watch_followthrough")).alias("watch_followthrough_rate"),
        rate(F.col("avoided_bad_trade")).alias("avoided_bad_trade_rate"),
        F.count_if("false_negative").alias("false_negatives"),
        F.avg("forward_abnormal_return").alias("average_forward_abnormal_return"),
    )
    joined = groups.join(base_rates(records, cohort), ["horizon_days", "classification"], "left")
    return joined.select(
        "horizon_days", "classification", "sample_size", "sample_positive_rate", "base_rate", "trade_hit_rate", (F.col("trade_hit_rate") - F.col("base_rate")).alias("excess_trade_hit_rate"),
        "watch_followthrough_rate", "avoided_bad_trade_rate", "false_negatives", "average_forward_abnormal_return",
    )


def in_order(groups: DataFrame) -> DataFrame:
    return groups.orderBy("horizon_days", "classification")


def summary_metrics(records: DataFrame) -> DataFrame:
    """One row over all matured records."""
    ar = F.col("forward_abnormal_return")
    records = stored(matured(records).select("forward_abnormal_return", "classification", "trade_hit", "false_negative"), "records")
    middle = selection.medians(records, [], "forward_abnormal_return", "median_forward_abnormal_return")
    made = records.agg(
        F.count("*").alias("sample_size"),
        rate(scalars.above(ar, 0.0)).alias("sample_positive_rate"),
        F.avg(ar).alias("average_forward_abnormal_return"),
        F.count_if((F.col("classification") == "Tradeable") & ~F.col("trade_hit")).alias("false_positives"),
        F.count_if("false_negative").alias("false_negatives"),
        F.count_if(F.col("classification") == "Avoid Chase").alias("avoid_chase_count"),
    )
    # Two rows of one.
    return made.join(F.broadcast(middle)).select(
        "sample_size", "sample_positive_rate", "average_forward_abnormal_return", "median_forward_abnormal_return", "false_positives", "false_negatives", "avoid_chase_count"
    )


def validation_metrics(records: DataFrame, group_by: list[str]) -> DataFrame:
    """Metrics by any columns: counts, hit rate, drawdown, and rates of false positives and negatives."""
    matured_row = F.coalesce(F.col("is_matured"), F.lit(False))
    hit = F.coalesce(F.col("hit"), F.lit(False))
    bullish = matured_row & F.col("classification").isin("Tradeable", "Watch")
    avoided = matured_row & F.col("classification").isin("Avoid", "Avoid Chase")
    share = lambda part, whole: F.try_divide(F.count_if(part), F.count_if(whole))
    own = F.when(matured_row, F.col("forward_abnormal_return"))
    measured = ["is_matured", "hit", "classification", "forward_abnormal_return", "max_drawdown", "false_negative"]
    records = stored(records.select(*dict.fromkeys([*group_by, *measured])), "records")
    middle = selection.medians(records.withColumn("_own", own), group_by, "_own", "median_forward_abnormal_return")
    out = records.groupBy(*group_by).agg(
        F.count("*").alias("signal_count"),
        F.count_if(matured_row).alias("matured_count"),
        share(matured_row & hit, matured_row).alias("hit_rate"),
        F.avg(own).alias("avg_forward_abnormal_return"),
        F.avg(F.when(matured_row, F.col("max_drawdown"))).alias("avg_max_drawdown"),
        share(bullish & (F.col("hit") == F.lit(False)), bullish).alias("false_positive_rate"),
        share(avoided & F.coalesce(F.col("false_negative"), F.lit(False)), avoided).alias("false_negative_rate"),
    )
    middle = middle.select(*[F.col(f"`{c}`").alias(f"_{c}") for c in group_by], "median_forward_abnormal_return")
    out = out.join(middle, selection.same([f"`{c}`" for c in group_by], [f"`_{c}`" for c in group_by]), "left").drop(*[f"_{c}" for c in group_by])
    scope = [c for c in ("horizon_days", "theme") if c in group_by]
    risen = F.coalesce(scalars.above(F.col("forward_abnormal_return"), 0.0), F.lit(False))
    base = records.where(matured_row).groupBy(*scope).agg(rate(risen).alias("base_rate"))
    joined = out.join(base, scope, "left") if scope else out.crossJoin(F.broadcast(base))
    return joined.withColumn("excess_hit_rate", F.col("hit_rate") - F.col("base_rate"))

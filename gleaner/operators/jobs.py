"""Job logs and activity: statistics, chunks and periods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.session import cut_lineage


def with_index(df: DataFrame, order: Sequence[str], name: str = "index") -> DataFrame:
    """Adds the position of each row in a total order, counted from 0, without a single-task window.

    Rows are range partitioned and sorted, each partition numbers its own, and the numbers start after the
    rows of the partitions before it. The partitioned rows are checkpointed, so that both passes see the
    same partitions. ``order`` must have no ties.
    """
    sorted_parts = df.repartitionByRange(*order).sortWithinPartitions(*order)
    low_bits = F.monotonically_increasing_id()
    placed = cut_lineage(
        sorted_parts.withColumn("_part", F.spark_partition_id())
        .withColumn("_pos", low_bits - F.shiftleft(F.spark_partition_id().cast("long"), 33))
    )
    # One row per partition.
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(offsets), "_part").withColumn(
        name, F.col("_before") + F.col("_pos")).drop("_part", "_pos", "_n", "_before")


def assign_chunks(df: DataFrame, order: Sequence[str], size: int) -> DataFrame:
    """Adds ``chunk``: consecutive groups of ``size`` rows."""
    return with_index(df, order, "_i").withColumn("chunk", F.floor(F.col("_i") / size)).drop("_i")


def batch_totals(df: DataFrame, error: str, *by: str) -> DataFrame:
    """``total, successful, failed``, overall or per group."""
    return df.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.count_if(F.col(error).isNull()).alias("successful"),
        F.count_if(F.col(error).isNotNull()).alias("failed"),
    )


def job_statistics(df: DataFrame, status: str) -> DataFrame:
    """Jobs by status with their share of all jobs in per cent."""
    counted = df.groupBy(status).agg(F.count("*").alias("jobs"))
    total = df.agg(F.count("*")).scalar()
    return counted.withColumn("percent", F.round(F.col("jobs") * 100.0 / total, 6))


def progress(df: DataFrame, job: str, done) -> DataFrame:
    """Per job: ``total, completed, progress`` in per cent."""
    return df.groupBy(job).agg(F.count("*").alias("total"), F.count_if(done).alias("completed")).withColumn(
        "progress", F.round(F.col("completed") * 100.0 / F.col("total"), 6))


def daily_activity(df: DataFrame, ts: str, as_of: str, days: int = 7) -> DataFrame:
    """``day, events`` of the last days up to ``as_of``, days without any included."""
    end = F.to_date(F.lit(as_of))
    spine = df.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(end, days - 1), end)).alias("day"))
    recent = df.filter((F.col(ts) >= F.date_sub(end, days - 1)) & (F.col(ts) < F.date_add(end, 1)))
    counted = recent.groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("n"))
    return spine.join(counted, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("events"))


def by_period(df: DataFrame, ts: str, period: str, metric: str) -> DataFrame:
    """``period_start, events, total`` per day, week, month or any other truncation."""
    return df.groupBy(F.date_trunc(period, F.col(ts)).cast("date").alias("period_start")).agg(
        F.count("*").alias("events"), F.sum(metric).alias("total"))


def classification_summary(results: DataFrame, category: str, confidence: str, error: str | None = None) -> DataFrame:
    """Per category: ``n, percent, avg_confidence, low_confidence``; failed and blank results left out."""
    good = results.filter(F.col(category).isNotNull() & (F.col(category) != ""))
    if error is not None:
        good = good.filter(F.col(error).isNull())
    counted = good.groupBy(F.col(category).alias("category")).agg(
        F.count("*").alias("n"), F.sum(confidence).alias("_sum"), F.count_if(F.col(confidence) < 0.7).alias("low_confidence"))
    total = counted.agg(F.sum("n")).scalar()
    return counted.select(
        "category", "n", (F.col("n") * 100.0 / total).alias("percent"), (F.col("_sum") / F.col("n")).alias("avg_confidence"),
        "low_confidence")


def classification_overall(results: DataFrame, category: str, confidence: str) -> DataFrame:
    """``total_classified, average_confidence, low_confidence_count`` over all rows."""
    good = results.filter(F.col(category).isNotNull() & (F.col(category) != ""))
    return good.agg(F.count("*").alias("total_classified"), F.avg(confidence).alias("average_confidence"),
                    F.count_if(F.col(confidence) < 0.7).alias("low_confidence_count"))


def top_categories(summary: DataFrame, n: int = 3) -> DataFrame:
    return summary.orderBy(F.desc("n"), "category").limit(n).select("category", "n")

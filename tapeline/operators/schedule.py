"""Due dates of recurring pulls as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeline.functions.calendar import is_trading_day, period_key

#: Tasks of a partition, about: each grows to the dates since its last run.
PARTITION_ROWS = 50_000
INTERVALS = ("daily", "weekly", "semi_monthly", "monthly", "bi_monthly")


def due_periods(tasks: DataFrame, today: str, *, include_today: bool = True) -> DataFrame:
    """(name, due_date) for every period that each task has not run yet.

    ``tasks``: name, interval, last_run_date, start_date (both may be null) and
    run_on_non_trading_days. A period is due on its first trading day (or first day if
    the task says so) after the period of the last run; a task that never ran starts
    at its start date, or today. ``include_today`` is false before the task's hour.
    """
    day = F.col("date")
    first = F.when(F.col("last_run_date").isNotNull(), F.date_add("last_run_date", 1)).otherwise(
        F.coalesce("start_date", F.lit(today).cast("date"))
    )
    last = F.lit(today).cast("date")
    last = last if include_today else F.date_sub(last, 1)
    # a task expands to the dates since its last run, a span of calendar days; dealt out
    # before that, as a small file's tasks lie in one partition
    spark = tasks.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), tasks.count() // PARTITION_ROWS + 1)
    tasks = tasks.repartition(parts, "name", "interval")
    days = tasks.withColumns({"_first": first, "_last": last}).where(F.col("_first") <= F.col("_last"))
    days = days.withColumn("date", F.explode(F.sequence("_first", "_last")))
    days = days.where(F.col("run_on_non_trading_days") | is_trading_day(day))

    def key(col):
        out = F.lit(None).cast("string")
        for name in INTERVALS:
            out = F.when(F.col("interval") == name, period_key(col, name)).otherwise(out)
        return out

    keyed = days.withColumns({"_p": key(day), "_done": key(F.col("last_run_date"))})
    fresh = keyed.where(F.col("_done").isNull() | (F.col("_p") != F.col("_done")))
    return fresh.groupBy("name", "interval", "_p").agg(F.min("date").alias("due_date")).drop("_p")


def next_due(due: DataFrame) -> DataFrame:
    """The oldest due date per task."""
    spec = Window.partitionBy("name").orderBy("due_date")
    return due.withColumn("_r", F.row_number().over(spec)).where("_r = 1").drop("_r")

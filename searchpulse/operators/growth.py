"""Day-over-day growth of a query."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def day_growth(daily: DataFrame) -> DataFrame:
    """(count - previous day's count) / previous day's count, null without a previous day.

    A range frame of exactly one day finds the previous day even when days are
    missing, with one shuffle and no self join. A window partition holds one
    row per day of a query, so no query text makes it large.
    """
    day_no = F.datediff(F.col("date"), F.lit("1970-01-01").cast("date"))
    yesterday = Window.partitionBy("query_text").orderBy(day_no).rangeBetween(-1, -1)
    previous = F.sum("query_count").over(yesterday)
    return daily.withColumn("previous_count", previous).withColumn(
        "growth_rate",
        F.when(
            F.col("previous_count") > 0,
            (F.col("query_count") - F.col("previous_count")) / F.col("previous_count"),
        ),
    )

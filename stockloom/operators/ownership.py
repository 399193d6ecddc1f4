"""Weekly ownership concentration from holding levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stockloom import constants as C
from stockloom.functions.dates import day_of
from stockloom.functions.numbers import tolerant_number


def weekly_concentration(levels: DataFrame, max_level: int | None = None) -> DataFrame:
    """Share of small and large holders per key and week.

    Takes ``stock_code, date, HoldingSharesLevel, people, percent``. The large
    buckets are nested (12 and up includes 15 and up) and have no upper end unless
    ``max_level`` is given; people are summed over all rows, readable level or not.
    """
    level = tolerant_number(F.col("HoldingSharesLevel").cast("string"))
    rows = levels.select(
        "stock_code", day_of(F.col("date").cast("string")).alias("update_date"), level.alias("level"),
        F.col("people").cast("bigint").alias("people"), F.col("percent").cast("double").alias("percent"))
    if max_level is not None:
        rows = rows.filter(F.col("level").isNull() | (F.col("level") <= max_level))

    def share(condition):
        return F.coalesce(F.sum(F.when(condition, F.col("percent"))), F.lit(0.0))

    return rows.groupBy("stock_code", "update_date").agg(
        share(F.col("level") >= C.LARGE_400_MIN_LEVEL).alias("large_holders_400"),
        share(F.col("level") >= C.LARGE_1000_MIN_LEVEL).alias("large_holders_1000"),
        share(F.col("level") <= C.RETAIL_MAX_LEVEL).alias("retail_holders_10"),
        F.coalesce(F.sum("people"), F.lit(0)).alias("total_shareholders"))

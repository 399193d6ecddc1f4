"""Where a load continues: high-water marks, deltas and the freshness gate."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from stockloom import constants as C
from stockloom.functions.dates import days_before, year_start
from stockloom.operators.keyed import in_days


def high_water_marks(keys: DataFrame, stored: DataFrame, date_column: str, today: dt.date,
                     default_years: int = 5) -> DataFrame:
    """Latest stored day per key, or January 1st some years back for a key without rows."""
    latest = stored.groupBy("stock_code").agg(F.max(F.to_date(date_column)).alias("latest"))
    return (keys.select("stock_code").distinct().join(latest, "stock_code", "left")
            .select("stock_code", F.coalesce("latest", year_start(today, default_years)).alias("mark")))


def revenue_marks(keys: DataFrame, stored: DataFrame, today: dt.date) -> DataFrame:
    """Revenue continues from January 1st of the latest stored year."""
    latest = stored.groupBy("stock_code").agg(F.max("revenue_year").alias("latest"))
    first = F.when(F.col("latest").isNotNull(), F.make_date(F.col("latest"), F.lit(1), F.lit(1)))
    return (keys.select("stock_code").distinct().join(latest, "stock_code", "left")
            .select("stock_code", F.coalesce(first, year_start(today, C.DAILY_DEFAULT_YEARS)).alias("mark")))


def news_marks(keys: DataFrame, news: DataFrame, today: dt.date) -> DataFrame:
    """Day the news load starts from, per key.

    The latest stored day, or 90 days back without one; the last seven days are
    always searched again, so the start is never later than that.
    """
    latest = news.groupBy("stock_code").agg(F.max(F.to_date("publish_time")).alias("latest"))
    start = F.coalesce("latest", days_before(today, C.NEWS_DEFAULT_DAYS))
    return (keys.select("stock_code").distinct().join(latest, "stock_code", "left")
            .select("stock_code", start.alias("history_start"),
                    F.least(start, days_before(today, C.NEWS_RECENT_DAYS)).alias("mark")))


def delta(landed: DataFrame, marks: DataFrame, day: Column, today: dt.date) -> DataFrame:
    """Landed rows of the marked keys from their mark to today, both included."""
    return (landed.withColumn("__day", day).filter(F.col("__day") <= F.lit(today))
            .join(marks.select("stock_code", "mark"), "stock_code")
            .filter(F.col("__day") >= F.col("mark")).drop("__day", "mark"))


def daily_marks(keys: DataFrame, daily: DataFrame, today: dt.date) -> DataFrame:
    """High-water marks of the daily table."""
    return high_water_marks(keys, daily, "stock_date", today, C.DAILY_DEFAULT_YEARS)


def row_counts(keys: DataFrame, daily: DataFrame, since: dt.date) -> DataFrame:
    """Rows per key from a day on, 0 included."""
    counts = (in_days(daily, since).groupBy("stock_code")
              .agg(F.count(F.lit(1)).alias("n_rows")))
    return (keys.select("stock_code").distinct().join(counts, "stock_code", "left")
            .select("stock_code", F.coalesce("n_rows", F.lit(0)).alias("n_rows")))


def stale_keys(keys: DataFrame, daily: DataFrame, today: dt.date) -> DataFrame:
    """Keys without a row for today."""
    current = in_days(daily, today).select("stock_code").distinct()
    return keys.select("stock_code").distinct().join(current, "stock_code", "left_anti")


def is_fresh(keys: DataFrame, daily: DataFrame, weekly: DataFrame, today: dt.date) -> bool:
    """Whether only the news needs loading: all keys have today's row and ownership is not empty."""
    return stale_keys(keys, daily, today).isEmpty() and not weekly.isEmpty()


def latest_day(daily: DataFrame) -> DataFrame:
    """Latest day over all keys, in one row."""
    return daily.agg(F.max("stock_date").alias("latest_day"))

"""Date handling: tolerant parsing, text shortening, relative dates.

"Today" is always a parameter, so a run can be repeated.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F


def day_of(text: Column) -> Column:
    """The calendar day a date or timestamp text starts with; NULL if it has none."""
    return F.substring(F.trim(text), 1, 10).try_cast("date")


def compact_date(text: Column) -> Column:
    """Strict ``yyyyMMdd`` text as a date; NULL for anything else."""
    clean = F.trim(text)
    return F.when(clean.rlike("^[0-9]{8}$"), F.try_to_date(clean, "yyyyMMdd"))


def dashed_date(text: Column) -> Column:
    """Eight-character day text with dashes put in; other lengths unchanged."""
    clean = F.trim(text.cast("string"))
    return F.when(
        F.length(clean) == 8,
        F.concat_ws("-", clean.substr(1, 4), clean.substr(5, 2), clean.substr(7, 2)),
    ).otherwise(clean)


def feed_time(text: Column) -> Column:
    """Publication time of a feed entry; NULL if it cannot be read.

    Feeds write ``Tue, 01 Jul 2026 08:30:00 GMT``. The weekday is redundant and
    not parseable in Spark, so it is cut first; ISO text is accepted as well.
    """
    clean = F.regexp_replace(F.trim(text), "^[A-Za-z]{3,9}, *", "")
    return F.coalesce(
        F.try_to_timestamp(clean, F.lit("d MMM yyyy HH:mm:ss zzz")),
        F.try_to_timestamp(clean, F.lit("d MMM yyyy HH:mm:ss Z")),
        clean.try_cast("timestamp"),
    )


def minute_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm")


def day_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def year_start(today: dt.date, years_back: int) -> Column:
    """January 1st of ``years_back`` years before ``today``."""
    return F.lit(dt.date(today.year - years_back, 1, 1))


def days_before(today: dt.date, days: int) -> Column:
    return F.lit(today - dt.timedelta(days=days))

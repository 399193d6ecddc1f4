"""From landed rows to stored columns, for each table."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from stockloom.functions.dates import day_of, feed_time
from stockloom.functions.numbers import number_or_zero
from stockloom.operators.flows import assemble_daily
from stockloom.operators.indicators import update_indicators
from stockloom.operators.keyed import keep_first, prefer, restrict_keys, stable_order
from stockloom.operators.news import model_sentiment, news_columns
from stockloom.operators.ownership import weekly_concentration
from stockloom.operators.statements import as_facts
from stockloom.plans.incremental import delta
from stockloom.sources.news_feed import company_keywords, search


def prices(landed: DataFrame) -> DataFrame:
    return landed.select(
        F.col("stock_id").alias("stock_code"), day_of(F.col("date")).alias("stock_date"),
        F.col("close").alias("stock_close"), F.col("Trading_Volume").alias("trading_volume"),
        F.col("Trading_money").alias("trading_money"))


def flows(landed: DataFrame) -> DataFrame:
    return landed.select(F.col("stock_id").alias("stock_code"), day_of(F.col("date")).alias("stock_date"),
                         "name", "buy", "sell")


def margins(landed: DataFrame) -> DataFrame:
    return landed.select(
        F.col("stock_id").alias("stock_code"), day_of(F.col("date")).alias("stock_date"),
        F.col("MarginPurchaseTodayBalance").alias("margin_balance"),
        F.col("ShortSaleTodayBalance").alias("short_balance"))


def one_per_day(rows: DataFrame, *more: str) -> DataFrame:
    """Landed days may overlap between files; one row per key and day (and ``more``) is kept."""
    day = ["stock_code", "stock_date"]
    return keep_first(rows.dropna(subset=day), [*day, *more], stable_order(rows, [*day, *more]))


def daily_batch(price_rows: DataFrame, flow_rows: DataFrame, margin_rows: DataFrame, marks: DataFrame, today: dt.date) -> DataFrame:
    """New daily rows from each key's mark on, assembled.

    The landed sets may cover any span and overlap: a key has one row a day, and one for each investor.
    """
    day = F.col("stock_date")
    return assemble_daily(one_per_day(delta(prices(price_rows), marks, day, today)),
                          one_per_day(delta(flows(flow_rows), marks, day, today), "name"),
                          one_per_day(delta(margins(margin_rows), marks, day, today)))


def daily_metrics(price_rows: DataFrame, flow_rows: DataFrame, margin_rows: DataFrame, history: DataFrame,
                  marks: DataFrame, today: dt.date, tail_rows: int | None = None) -> DataFrame:
    """New daily rows with indicators over the history, the stored daily metrics."""
    batch = daily_batch(price_rows, flow_rows, margin_rows, marks, today)
    numeric = [c for c, _ in batch.dtypes if c not in ("stock_code", "stock_date")]
    past = restrict_keys(history, marks.select("stock_code").distinct()).withColumns({c: F.col(c).cast("double") for c in numeric})
    return update_indicators(past, batch, tail_rows)


def weekly(levels: DataFrame, backup_levels: DataFrame | None = None) -> DataFrame:
    """Ownership per week, from one row for each level; keys without levels are taken from the backup file."""
    columns = ["stock_code", "date", "HoldingSharesLevel", "people", "percent"]
    key = columns[:3]
    rows = keep_first(levels.select(*columns), key, stable_order(levels.select(*columns), key))
    if backup_levels is not None:
        rows = prefer(rows, backup_levels.select(*columns))
    return weekly_concentration(rows)


def holding_rows(landed: DataFrame) -> DataFrame:
    return landed.withColumnRenamed("stock_id", "stock_code")


def revenues(landed: DataFrame) -> DataFrame:
    return landed.select(F.col("stock_id").alias("stock_code"), "revenue_year", "revenue_month",
                         F.col("revenue").alias("total_revenue")).distinct()


def dividends(landed: DataFrame) -> DataFrame:
    """Cash and stock dividends, each the sum of its two parts (unreadable parts count as 0).

    Rows without an ex-dividend day or a payment day are not kept.
    """
    def total(kind: str):
        return (number_or_zero(F.col(f"{kind}EarningsDistribution"))
                + number_or_zero(F.col(f"{kind}StatutorySurplus")))

    rows = landed.select(
        F.col("stock_id").alias("stock_code"), F.col("year").alias("date_info"),
        total("Cash").alias("cash_dividends"), total("Stock").alias("stock_dividend"),
        F.col("CashExDividendTradingDate").alias("ex_dividend_date"),
        F.col("CashDividendPaymentDate").alias("cash_dividend_date"))
    for c in ("ex_dividend_date", "cash_dividend_date"):
        rows = rows.filter(F.col(c).isNotNull() & (F.col(c) != ""))
    return rows


def facts(income: DataFrame, balance: DataFrame, cashflow: DataFrame) -> DataFrame:
    return (as_facts(income, "income").unionByName(as_facts(balance, "balance"))
            .unionByName(as_facts(cashflow, "cashflow")))


def news(entries: DataFrame, company: DataFrame, marks: DataFrame, stored: DataFrame | Callable[[DataFrame], DataFrame],
         today: dt.date, make_scorer=None) -> DataFrame:
    """Scored news rows of each company that are not stored yet.

    ``stored`` are the stored news, or a function that gives the stored keys among those of some rows.

    A mark covers both the search since the latest stored day and the search of
    the last days, so one pass over the entries does. Repeats and stored links
    are dropped before a model sees them.
    """
    published = feed_time(F.col("published"))
    found = delta(search(entries, company_keywords(company), None, today), marks, F.to_date(published), today)
    once = keep_first(found, ["stock_code", "link"], [published.desc_nulls_last(), F.col("title")])
    keys = stored(once.select("stock_code", F.col("link").alias("news_link"))) if callable(stored) else stored
    known = keys.select("stock_code", F.col("news_link").alias("link"))
    fresh = once.join(known, ["stock_code", "link"], "left_anti")
    return news_columns(model_sentiment(fresh, make_scorer))

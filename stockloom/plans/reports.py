"""Dashboard queries and the context rows handed to an analyst."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from stockloom import constants as C
from stockloom.functions.dates import day_text, minute_text
from stockloom.functions.numbers import at_fixed
from stockloom.operators.keyed import in_days, latest_rows
from stockloom.operators.news import daily_sentiment, shown_news
from stockloom.operators.statements import FLAGS


def company_record(company: DataFrame, stock_code: str) -> DataFrame:
    return company.filter(F.col("stock_code") == stock_code)


def daily_range(daily: DataFrame, start: dt.date, end: dt.date, stock_code: str | None = None) -> DataFrame:
    """Daily rows between two days, both included, in day order.

    The filter also prunes the year directories of a stored table.
    """
    rows = in_days(daily, start, end).drop("stock_year")
    if stock_code is not None:
        rows = rows.filter(F.col("stock_code") == stock_code)
    return rows.orderBy("stock_code", "stock_date")


def weekly_history(weekly: DataFrame, rows: int = C.WEEKLY_HISTORY_ROWS) -> DataFrame:
    return latest_rows(weekly, ["stock_code"], ["update_date"], rows)


def latest_news(news: DataFrame) -> DataFrame:
    """The news list of each key with its times to the minute."""
    shown = shown_news(news, rank_as="position")
    return shown.select("stock_code", "position", "title", minute_text(F.col("publish_time")).alias("publish_minute"),
                        "news_link", "sentiment_score")


def price_sentiment(daily: DataFrame, news: DataFrame, start: dt.date | None = None,
                    end: dt.date | None = None) -> DataFrame:
    """Closes with the mean sentiment of the day, 0 on days without news."""
    prices, scores = daily, daily_sentiment(news)
    if start is not None and end is not None:
        prices, scores = in_days(prices, start, end), in_days(scores, start, end)
    return prices.select("stock_code", "stock_date", "stock_close").join(scores, ["stock_code", "stock_date"], "left").select(
        "stock_code", "stock_date", "stock_close", day_text(F.col("stock_date")).alias("day"),
        F.coalesce("avg_sentiment", F.lit(0.0)).alias("avg_sentiment"))


def warning_history(indicators: DataFrame, thresholds: DataFrame,
                    quarters: int = C.WARNING_HISTORY_QUARTERS) -> DataFrame:
    """The latest quarters of each key beside its thresholds."""
    recent = latest_rows(indicators, ["stock_code"], ["year", "quarter"], quarters)
    return recent.join(thresholds.drop("last_updated"), "stock_code", "left")


def warning_lights(indicators: DataFrame) -> DataFrame:
    """"warn" or "ok" per metric with its value as text."""
    def light(flag: str, value: str, decimals: int, unit: str) -> Column:
        text = F.concat(at_fixed(F.col(value), decimals), F.lit(unit))
        return F.concat(F.when(F.col(flag).cast("boolean"), F.lit("warn (")).otherwise(F.lit("ok (")), text, F.lit(")"))

    return indicators.select(
        "stock_code", F.concat(F.col("year"), F.lit(" Q"), F.col("quarter")).alias("period"),
        light("is_cash_flow_warning", "earnings_quality_ratio", 1, "%").alias("cash_flow_light"),
        light("is_debt_warning", "debt_ratio", 1, "%").alias("debt_light"),
        light("is_receivable_warning", "receivable_turnover_days", 0, "d").alias("receivable_light"),
        light("is_inventory_warning", "inventory_turnover_days", 0, "d").alias("inventory_light"),
        F.concat(at_fixed(F.col("interest_coverage_ratio"), 2), F.lit("x")).alias("coverage_text"))


def _in_order(position: str, value: Column) -> Column:
    """The values of a bounded group as an array in the order of ``position``."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(position), value.alias("value"))))
    return F.transform(pairs, lambda pair: pair["value"])


def news_line(title: str = "title") -> Column:
    return F.concat(F.lit("["), F.coalesce(minute_text(F.col("publish_time")), F.lit("-")), F.lit("] "),
                    F.coalesce(F.col(title), F.lit("")), F.lit(" ("),
                    F.coalesce(at_fixed(F.col("sentiment_score"), 2), F.lit("-")), F.lit(")"))


def news_lines(news: DataFrame, rows: int) -> DataFrame:
    """The first ``rows`` of each key's news list as lines of text."""
    shown = shown_news(news, rank_as="position").filter(F.col("position") <= rows)
    lines = shown.groupBy("stock_code").agg(_in_order("position", news_line()).alias("news"))
    return lines.withColumn("news_text", F.array_join("news", "\n"))


def recent_prices(daily: DataFrame, today: dt.date) -> DataFrame:
    """Last day of each key since January 1st of the year before, with its five-row mean."""
    window = in_days(daily, dt.date(today.year - 1, 1, 1), today)
    last = ["stock_date", "stock_close", "ma20", "k_value", "d_value", "foreign_net_buy", "trust_net_buy"]
    recent = latest_rows(window.select("stock_code", *last), ["stock_code"], ["stock_date"], 5)
    return recent.groupBy("stock_code").agg(
        F.max_by(F.struct(*last), "stock_date").alias("last"),
        F.avg(F.col("stock_close").cast("double")).alias("ma5"),
    ).select("stock_code", *[F.col(f"last.{c}").alias(c) for c in last], "ma5")


def warning_phrases(indicators: DataFrame) -> DataFrame:
    """Phrases of the flags raised in each key's latest quarter."""
    newest = F.struct("year", "quarter")
    last = indicators.groupBy("stock_code").agg(F.max_by(F.struct(*FLAGS), newest).alias("f"))
    phrases = F.array_compact(F.array(*[
        F.when(F.col(f"f.{flag}").cast("boolean"), F.lit(text)) for flag, text in C.WARNING_PHRASES.items()]))
    return last.select("stock_code", phrases.alias("warnings"))


def analyst_context(company: DataFrame, daily: DataFrame, weekly: DataFrame, indicators: DataFrame,
                    news: DataFrame, today: dt.date) -> DataFrame:
    """One row per company: last prices and flows, ownership, warnings, newest headlines."""
    shares = latest_rows(weekly, ["stock_code"], ["update_date"], 1)
    return (company.select("stock_code", "company_name", "company_class", "main_business")
            .join(recent_prices(daily, today), "stock_code", "left")
            .join(shares.select("stock_code", "update_date", "large_holders_1000", "large_holders_400",
                                "retail_holders_10"), "stock_code", "left")
            .join(warning_phrases(indicators), "stock_code", "left")
            .join(news_lines(news, C.NEWS_CONTEXT_ROWS), "stock_code", "left")
            .withColumns({"warnings_text": F.array_join(F.coalesce("warnings", F.array().cast("array<string>")), ", "),
                          "news_text": F.coalesce("news_text", F.lit(""))}))


def news_context(company: DataFrame, daily: DataFrame, news: DataFrame,
                 days: int = C.TREND_CONTEXT_DAYS) -> DataFrame:
    """One row per company with news: its news list and its last days of price and sentiment."""
    last = latest_rows(daily.select("stock_code", "stock_date", "stock_close"), ["stock_code"], ["stock_date"], days)
    trend = price_sentiment(last, news)
    line = F.concat_ws(" ", F.col("day"), F.lit("close"), at_fixed(F.col("stock_close"), 2),
                       F.lit("sentiment"), at_fixed(F.col("avg_sentiment"), 2))
    trends = trend.groupBy("stock_code").agg(F.array_join(_in_order("stock_date", line), "\n").alias("trend_text"))
    return (news_lines(news, C.NEWS_SHOWN_ROWS).select("stock_code", "news_text")
            .join(company.select("stock_code", "company_name"), "stock_code", "left")
            .join(trends, "stock_code", "left"))


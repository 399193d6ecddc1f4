"""Readers of landed data sets: typed scans of ``{"data": [{...}]}`` responses.

A landing folder holds responses as JSON lines (splittable, the layout to use at
scale) or, with ``multi_line``, one pretty-printed response per file. Schemas are
explicit; a field a response lacks reads as NULL and takes its default. Bounds and
codes are ordinary filters, and an empty or missing ``data`` gives no rows.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from stockloom.functions.dates import day_of
from stockloom.schemas import LANDINGS, Landing

Day = dt.date | str | None


def unpack(responses: DataFrame, landing: Landing) -> DataFrame:
    """Rows of parsed responses (a ``data`` array column) with defaults filled in."""
    rows = responses.select(F.inline("data"))
    filled = {name: F.coalesce(F.col(name), F.lit(value)) for name, value in landing.defaults}
    return rows.withColumns(filled) if filled else rows


def parse_responses(text: DataFrame, dataset: str, column: str = "value") -> DataFrame:
    """Rows of responses that arrive as text, for example from a message or a text file."""
    landing = LANDINGS[dataset]
    parsed = text.select(F.from_json(F.col(column), landing.envelope).alias("r")).select("r.data")
    return unpack(parsed, landing)


def bounded(rows: DataFrame, landing: Landing, start: Day = None, end: Day = None,
            stock_ids: Sequence[str] | DataFrame | None = None) -> DataFrame:
    """Rows of the given codes whose day lies between the bounds, both included."""
    if landing.date_field:
        day = day_of(F.col(landing.date_field))
        if start is not None:
            rows = rows.filter(day >= F.lit(start).cast("date"))
        if end is not None:
            rows = rows.filter(day <= F.lit(end).cast("date"))
    if isinstance(stock_ids, DataFrame):
        codes = stock_ids.select(F.col("stock_code").alias("stock_id")).distinct()
        rows = rows.join(codes, "stock_id", "left_semi")
    elif stock_ids is not None:
        rows = rows.filter(F.col("stock_id").isin(list(stock_ids)))
    return rows


def read_landed(spark: SparkSession, path: str, dataset: str, start: Day = None, end: Day = None,
                stock_ids: Sequence[str] | DataFrame | None = None, multi_line: bool = False) -> DataFrame:
    landing = LANDINGS[dataset]
    responses = spark.read.schema(landing.envelope).option("multiLine", multi_line).json(path)
    return bounded(unpack(responses, landing), landing, start, end, stock_ids)


def stock_prices(spark: SparkSession, path: str, **bounds) -> DataFrame:
    """date, stock_id, close, Trading_Volume, Trading_money"""
    return read_landed(spark, path, "price", **bounds)


def monthly_revenues(spark: SparkSession, path: str, **bounds) -> DataFrame:
    """stock_id, revenue, revenue_month, revenue_year, date"""
    return read_landed(spark, path, "revenue", **bounds)


def dividends(spark: SparkSession, path: str, **bounds) -> DataFrame:
    """Eight text columns; an absent one is empty text."""
    return read_landed(spark, path, "dividend", **bounds)


def valuations(spark: SparkSession, path: str, **bounds) -> DataFrame:
    """date, stock_id, dividend_yield, PER, PBR"""
    return read_landed(spark, path, "valuation", **bounds)


def income_statements(spark: SparkSession, path: str, **bounds) -> DataFrame:
    return read_landed(spark, path, "income", **bounds)


def balance_sheets(spark: SparkSession, path: str, **bounds) -> DataFrame:
    return read_landed(spark, path, "balance", **bounds)


def cash_flows(spark: SparkSession, path: str, **bounds) -> DataFrame:
    return read_landed(spark, path, "cashflow", **bounds)


def investor_flows(spark: SparkSession, path: str, **bounds) -> DataFrame:
    """date, stock_id, buy, name, sell: one row per day and investor"""
    return read_landed(spark, path, "investor", **bounds)


def margin_balances(spark: SparkSession, path: str, **bounds) -> DataFrame:
    """date, stock_id and both balances; an absent balance is 0."""
    return read_landed(spark, path, "margin", **bounds)


def holding_levels(spark: SparkSession, path: str, **bounds) -> DataFrame:
    return read_landed(spark, path, "holding", **bounds)



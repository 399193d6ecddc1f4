"""Daily flows: investor classes, margin balances and their joins to prices."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, functions as F

from stockloom import constants as C
from stockloom.functions.text import name_matches
from stockloom.operators.keyed import latest_rows

DAY_KEY = ["stock_code", "stock_date"]
FLOW_COLUMNS = list(C.INVESTOR_CLASSES)
MARGIN_COLUMNS = ["margin_balance", "short_balance"]


def net_buy(buy: Column, sell: Column) -> Column:
    return buy - sell


def investor_summary(flows: DataFrame) -> DataFrame:
    """Net buying per key, day and investor class.

    Takes ``stock_code, stock_date, name, buy, sell``. Classes may overlap, and a
    row without an investor name counts in every class. A conditional sum, so
    a day's rows are combined before the shuffle.
    """
    net = net_buy(F.col("buy"), F.col("sell"))
    sums = [F.coalesce(F.sum(F.when(name_matches(F.col("name"), words), net)), F.lit(0.0)).alias(column)
            for column, words in C.INVESTOR_CLASSES.items()]
    return flows.groupBy(*DAY_KEY).agg(*sums)


def assemble_daily(prices: DataFrame, flows: DataFrame, margins: DataFrame) -> DataFrame:
    """Prices with investor sums and margin balances of the same day, gaps as 0.

    All sides hold one row per key and day and are joined on both, so no
    dominant key meets in one task.
    """
    joined = (prices.join(investor_summary(flows), DAY_KEY, "left")
              .join(margins.select(*DAY_KEY, *MARGIN_COLUMNS), DAY_KEY, "left"))
    return joined.na.fill(0)


def total_net_buy() -> Column:
    """Sum of the classes in one row; NULL as soon as one of them is."""
    return reduce(add, [F.col(c) for c in FLOW_COLUMNS])


def recent_net_buy(daily: DataFrame, days: int = C.FLOW_DAYS) -> DataFrame:
    """Net buying of all classes over the latest rows of each key."""
    recent = latest_rows(daily.select(*DAY_KEY, *FLOW_COLUMNS), ["stock_code"], ["stock_date"], days)
    return recent.groupBy("stock_code").agg(F.sum(total_net_buy()).alias("net_buy_5d"))

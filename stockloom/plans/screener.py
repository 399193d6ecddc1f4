"""Multi-factor screener and the factor row of single keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stockloom import constants as C
from stockloom.functions.numbers import at_fixed, signed_thousands
from stockloom.operators.flows import FLOW_COLUMNS, total_net_buy
from stockloom.operators.keyed import latest_rows
from stockloom.operators.statements import estimated_roe

FACTORS = ["stock_code", "company_name", "stock_close", "ma20", "ma60", "net_buy_5d", "estimated_roe"]

#: Column titles of the published factor table, in the order of FACTORS.
FACTOR_TITLES = ["股票代碼", "公司名稱", "收盤價", "月線(MA20)", "季線(MA60)", "近5日法人淨買進(張)", "估算ROE(%)"]


def latest_daily(daily: DataFrame) -> DataFrame:
    """Last day of each key and the net buying of its last five rows, in one pass.

    ``daily`` carries its averages; at most five rows per key and task are shuffled.
    """
    kept = ["stock_code", "stock_date", "stock_close", "ma20", "ma60", *FLOW_COLUMNS]
    recent = latest_rows(daily.select(*kept), ["stock_code"], ["stock_date"], C.FLOW_DAYS)
    last = F.max_by(F.struct("stock_close", "ma20", "ma60"), "stock_date")
    return recent.groupBy("stock_code").agg(
        F.max("stock_date").alias("stock_date"), last.alias("last"),
        F.sum(total_net_buy()).alias("net_buy_5d"),
    ).select("stock_code", "stock_date", *[F.col(f"last.{c}").cast("double").alias(c)
                                           for c in ("stock_close", "ma20", "ma60")], "net_buy_5d")


def latest_from_prices(daily: DataFrame) -> DataFrame:
    """The same from plain closes: the averages of the last day need 60 rows per key, not the history."""
    kept = ["stock_code", "stock_date", "stock_close", *FLOW_COLUMNS]
    recent = latest_rows(daily.select(*kept), ["stock_code"], ["stock_date"], C.MA_LONG, rank_as="age")

    def mean_of(n: int) -> Column:
        inside = F.when(F.col("age") <= n, F.col("stock_close").cast("double"))
        return F.when(F.count(inside) == n, F.avg(inside))

    return recent.groupBy("stock_code").agg(
        F.max("stock_date").alias("stock_date"),
        F.max(F.when(F.col("age") == 1, F.col("stock_close").cast("double"))).alias("stock_close"),
        mean_of(C.MA_SHORT).alias("ma20"), mean_of(C.MA_LONG).alias("ma60"),
        F.sum(F.when(F.col("age") <= C.FLOW_DAYS, total_net_buy())).alias("net_buy_5d"))


def factor_table(latest: DataFrame, facts: DataFrame, company: DataFrame) -> DataFrame:
    """Latest day, five-day net buying, estimated ROE and name of each key."""
    return (latest.join(estimated_roe(facts), "stock_code", "left")
            .join(company.select("stock_code", "company_name"), "stock_code", "left")
            .withColumns({"estimated_roe": F.coalesce(F.col("estimated_roe"), F.lit(0.0)),
                          "net_buy_5d": F.coalesce(F.col("net_buy_5d").cast("double"), F.lit(0.0))})
            .select(*FACTORS))


def screen(factors: DataFrame, min_roe: float = 0, ma_cross: str | None = None,
           min_net_buy: float = 0) -> DataFrame:
    """Keys passing the active criteria: a minimum is active above 0, ``ma_cross`` is ma20 or ma60."""
    if min_roe > 0:
        factors = factors.filter(F.col("estimated_roe") >= min_roe)
    if min_net_buy > 0:
        factors = factors.filter(F.col("net_buy_5d") >= min_net_buy)
    if ma_cross in ("ma20", "ma60"):
        factors = factors.filter(F.col("stock_close") > F.col(ma_cross))
    return factors


def screener(daily: DataFrame, facts: DataFrame, company: DataFrame, min_roe: float = 0,
             ma_cross: str | None = None, min_net_buy: float = 0) -> DataFrame:
    return screen(factor_table(latest_daily(daily), facts, company), min_roe, ma_cross, min_net_buy)


def factor_metrics(daily: DataFrame, facts: DataFrame, company: DataFrame,
                   stock_code: str | None = None) -> DataFrame:
    """Factor rows, of one key if given; the key filter reaches all three scans."""
    if stock_code is not None:
        daily, facts, company = (t.filter(F.col("stock_code") == stock_code) for t in (daily, facts, company))
    return factor_table(latest_daily(daily), facts, company)


def factor_labels(factors: DataFrame) -> DataFrame:
    """Directions and display texts of factor rows; "N/A" where an average is missing or zero."""
    def position(average: str) -> Column:
        known = F.coalesce(F.col(average), F.lit(0.0)) != 0
        return (F.when(~known, F.lit("N/A"))
                .when(F.col("stock_close") > F.col(average), F.lit("above")).otherwise(F.lit("below")))

    def shown(average: str) -> Column:
        known = F.coalesce(F.col(average), F.lit(0.0)) != 0
        return F.when(known, at_fixed(F.col(average), 2)).otherwise(F.lit("N/A"))

    whole = F.col("net_buy_5d").cast("bigint")
    direction = F.when(whole > 0, F.lit("buy")).when(whole < 0, F.lit("sell")).otherwise(F.lit("flat"))
    return factors.select(
        "stock_code", "company_name", at_fixed(F.col("stock_close"), 2).alias("close_text"),
        direction.alias("net_buy_direction"), signed_thousands(whole).alias("net_buy_text"),
        position("ma20").alias("ma20_position"), shown("ma20").alias("ma20_text"),
        position("ma60").alias("ma60_position"), shown("ma60").alias("ma60_text"),
        at_fixed(F.col("estimated_roe"), 2).alias("roe_text"))


def titled(factors: DataFrame) -> DataFrame:
    """Factor rows under their published titles."""
    return factors.select(*FACTORS).toDF(*FACTOR_TITLES)

"""Registered queries: each a Spark job over the shared tables, with the same result as SQL for DuckDB."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

import carriers as data
from stockloom import constants as C
from stockloom.functions import dates, numbers, text
from stockloom.operators import flows, indicators, keyed, news, ownership, state, statements
from stockloom.plans import incremental, loads, reports, screener, update
from stockloom.schemas import LANDINGS, TABLES
from stockloom.sinks.warehouse import Warehouse
from stockloom.session import fresh_path, shuffles_removed
from stockloom.sources import checked, files, landed, news_feed
from stockloom.streaming import loads as stream_loads, stateful

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

TODAY = dt.date(2001, 12, 31)


def _with(names: list[str]) -> str:
    """WITH clause of the carriers and everything they are written in terms of."""
    order: list[str] = []

    def visit(name: str) -> None:
        for needed in data.CARRIER_NEEDS.get(name, []):
            visit(needed)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    return "WITH " + ",\n".join(f"{n} AS ({data.CARRIER_SQL[n]})" for n in order)


def query(name: str, sql: str | None = None, needs: list[str] = (), ctes: str = "") -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        def in_utc(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return run(spark, sf_dir)

        QUERIES[name] = in_utc
        if sql is not None:
            head = _with(list(needs)) if needs else ""
            if ctes:
                head = f"{head},\n{ctes}" if head else f"WITH {ctes}"
            SQL[name] = f"{head}\n{sql}"
        return run

    return register


def r4(column: str) -> Column:
    return numbers.rounded(F.col(column).cast("double"), 4).alias(column)


def r4s(*columns: str) -> list[Column]:
    return [r4(c) for c in columns]


def sql4(*columns: str) -> str:
    return ", ".join(f"floor({c} * 10000 + 0.5) / 10000 AS {c}" for c in columns)


# --- indicators -------------------------------------------------------------------------------

NUMBERED = """numbered AS (
    SELECT *, row_number() OVER (PARTITION BY stock_code ORDER BY stock_date) - 1 AS n,
           count(*) OVER (PARTITION BY stock_code) AS length FROM daily_price)"""

AVERAGES = """averages AS (
    SELECT stock_code, stock_date,
           CASE WHEN n >= 19 THEN avg(stock_close) OVER (PARTITION BY stock_code ORDER BY n ROWS 19 PRECEDING) END AS ma20,
           CASE WHEN n >= 59 THEN avg(stock_close) OVER (PARTITION BY stock_code ORDER BY n ROWS 59 PRECEDING) END AS ma60
    FROM numbered)"""

STOCHASTIC = """ranges AS (
    SELECT *, min(stock_close) OVER w AS lo, max(stock_close) OVER w AS hi FROM numbered
    WINDOW w AS (PARTITION BY stock_code ORDER BY n ROWS 8 PRECEDING)),
raw AS (
    SELECT *, CASE WHEN n >= 8 AND hi > lo THEN (stock_close - lo) / (hi - lo) * 100 ELSE CAST(50 AS DOUBLE) END AS rsv FROM ranges),
k_line AS (
    SELECT *, pow(CAST(2 AS DOUBLE) / 3, n) / 3 * sum(rsv * pow(CAST(1.5 AS DOUBLE), n)) OVER (
                 PARTITION BY stock_code ORDER BY n ROWS UNBOUNDED PRECEDING)
              + 50 * pow(CAST(2 AS DOUBLE) / 3, n + 1) AS k_value FROM raw),
kd AS (
    SELECT stock_code, stock_date, k_value,
           pow(CAST(2 AS DOUBLE) / 3, n) / 3 * sum(k_value * pow(CAST(1.5 AS DOUBLE), n)) OVER (
                 PARTITION BY stock_code ORDER BY n ROWS UNBOUNDED PRECEDING)
           + 50 * pow(CAST(2 AS DOUBLE) / 3, n + 1) AS d_value FROM k_line)"""

STRENGTH = """steps AS (
    SELECT *, coalesce(stock_close - lag(stock_close) OVER (PARTITION BY stock_code ORDER BY n), 0) AS delta FROM numbered),
moves AS (
    SELECT *, avg(greatest(delta, 0)) OVER w AS gain, avg(greatest(-delta, 0)) OVER w AS loss FROM steps
    WINDOW w AS (PARTITION BY stock_code ORDER BY n ROWS 13 PRECEDING)),
strength AS (
    SELECT stock_code, stock_date,
           CASE WHEN n >= 13 AND loss > 0 THEN 100 - 100 / (1 + gain / loss) ELSE CAST(0 AS DOUBLE) END AS rsi14 FROM moves)"""


def _ema_sql(source: str, span: int) -> str:
    alpha, keep = f"(CAST(2 AS DOUBLE) / {span + 1})", f"(CAST({span - 1} AS DOUBLE) / {span + 1})"
    return (f"pow({keep}, n) * sum(CASE WHEN n = 0 THEN CAST(1 AS DOUBLE) ELSE {alpha} END * {source} * pow({keep}, -n)) "
            "OVER (PARTITION BY stock_code ORDER BY n ROWS UNBOUNDED PRECEDING)")


HISTOGRAM = f"""means AS (
    SELECT *, {_ema_sql('stock_close', 12)} - {_ema_sql('stock_close', 26)} AS dif FROM numbered),
histogram AS (
    SELECT stock_code, stock_date, dif - {_ema_sql('dif', 9)} AS macd_hist FROM means)"""


@query("technical_indicators", needs=["daily_price"],
       ctes=",\n".join([NUMBERED, AVERAGES, STOCHASTIC, STRENGTH, HISTOGRAM]),
       sql=f"""SELECT stock_code, stock_date, {sql4('ma20', 'ma60', 'k_value', 'd_value', 'rsi14', 'macd_hist')}
               FROM averages JOIN kd USING (stock_code, stock_date) JOIN strength USING (stock_code, stock_date)
               JOIN histogram USING (stock_code, stock_date)""")
def _(spark, sf_dir):
    prices = data.daily_price(spark, sf_dir).select("stock_code", "stock_date", "stock_close")
    return with_indicators(spark, sf_dir, prices).select("stock_code", "stock_date", *r4s(*indicators.INDICATORS))


def with_indicators(spark: SparkSession, sf_dir: str, rows: DataFrame, names: list[str] = indicators.INDICATORS) -> DataFrame:
    return indicators.indicators(rows, names)


def _family(name: str, columns: list[str], ctes: str, source: str) -> None:
    @query(name, needs=["daily_price"], ctes=f"{NUMBERED},\n{ctes}",
           sql=f"SELECT stock_code, stock_date, {sql4(*columns)} FROM {source}")
    def _(spark, sf_dir):
        prices = data.daily_price(spark, sf_dir).select("stock_code", "stock_date", "stock_close")
        return with_indicators(spark, sf_dir, prices, columns).select("stock_code", "stock_date", *r4s(*columns))


_family("rolling_averages", ["ma20", "ma60"], AVERAGES, "averages")
_family("stochastic_lines", ["k_value", "d_value"], STOCHASTIC, "kd")
_family("relative_strength", ["rsi14"], STRENGTH, "strength")
_family("macd_histogram", ["macd_hist"], HISTOGRAM, "histogram")


@query("short_series_indicators",
       ctes="""daily_price AS (SELECT CAST(o_custkey AS VARCHAR) AS stock_code, CAST(o_orderdate AS DATE) AS stock_date,
                        max(o_totalprice) AS stock_close FROM orders GROUP BY 1, 2),
""" + ",\n".join([NUMBERED, AVERAGES, STOCHASTIC, STRENGTH]),
       sql="""SELECT stock_code, stock_date, CASE WHEN length >= 5 THEN floor(ma20 * 10000 + 0.5) / 10000 END AS ma20,
                     CASE WHEN length >= 5 THEN floor(k_value * 10000 + 0.5) / 10000 ELSE 50 END AS k_value,
                     CASE WHEN length >= 5 THEN floor(d_value * 10000 + 0.5) / 10000 ELSE 50 END AS d_value,
                     CASE WHEN length >= 5 THEN floor(rsi14 * 10000 + 0.5) / 10000 END AS rsi14
              FROM numbered JOIN averages USING (stock_code, stock_date) JOIN kd USING (stock_code, stock_date)
              JOIN strength USING (stock_code, stock_date)""")
def _(spark, sf_dir):
    """Many sparse series, some of fewer than five rows, which have no indicators."""
    daily = data.table(spark, sf_dir, "orders").groupBy(
        F.col("o_custkey").cast("string").alias("stock_code"), F.to_date("o_orderdate").alias("stock_date")).agg(
        F.max("o_totalprice").alias("stock_close"))
    names = ["ma20", "k_value", "d_value", "rsi14"]
    return indicators.indicators(daily, names).select("stock_code", "stock_date", *r4s(*names))


# --- daily assembly ---------------------------------------------------------------------------

SUMMARY = """summary AS (
    SELECT stock_code, stock_date,
           coalesce(sum(CASE WHEN name IS NULL OR regexp_matches(name, '(?i)Foreign|外資') THEN buy - sell END), 0) AS foreign_net_buy,
           coalesce(sum(CASE WHEN name IS NULL OR regexp_matches(name, '(?i)Trust|投信') THEN buy - sell END), 0) AS trust_net_buy,
           coalesce(sum(CASE WHEN name IS NULL OR regexp_matches(name, '(?i)Dealer|自營商') THEN buy - sell END), 0) AS dealer_net_buy
    FROM flow GROUP BY 1, 2)"""

ASSEMBLED = SUMMARY + """,
assembled AS (
    SELECT stock_code, stock_date, stock_close, trading_volume, trading_money,
           coalesce(foreign_net_buy, 0) AS foreign_net_buy, coalesce(trust_net_buy, 0) AS trust_net_buy,
           coalesce(dealer_net_buy, 0) AS dealer_net_buy, coalesce(margin_balance, 0) AS margin_balance,
           coalesce(short_balance, 0) AS short_balance
    FROM daily_price LEFT JOIN summary USING (stock_code, stock_date) LEFT JOIN margin USING (stock_code, stock_date))"""
DAILY_NEEDS = ["daily_price", "flow", "margin"]


def assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.assemble_daily(data.daily_price(spark, sf_dir), data.flow(spark, sf_dir), data.margin(spark, sf_dir))


@query("investor_flow_summary", needs=["flow"], ctes=SUMMARY, sql="SELECT * FROM summary")
def _(spark, sf_dir):
    return flows.investor_summary(data.flow(spark, sf_dir))


@query("daily_assembly", needs=DAILY_NEEDS, ctes=ASSEMBLED, sql="SELECT * FROM assembled")
def _(spark, sf_dir):
    return assembled(spark, sf_dir)


@query("daily_metrics", needs=DAILY_NEEDS,
       ctes=",\n".join([ASSEMBLED, NUMBERED, AVERAGES, STOCHASTIC, STRENGTH, HISTOGRAM]),
       sql=f"""SELECT assembled.*, {sql4('ma20', 'ma60', 'k_value', 'd_value', 'rsi14', 'macd_hist')}
               FROM assembled JOIN averages USING (stock_code, stock_date) JOIN kd USING (stock_code, stock_date)
               JOIN strength USING (stock_code, stock_date) JOIN histogram USING (stock_code, stock_date)""")
def _(spark, sf_dir):
    daily = with_indicators(spark, sf_dir, assembled(spark, sf_dir))
    return daily.select(*[c for c in daily.columns if c not in indicators.INDICATORS], *r4s(*indicators.INDICATORS))


@query("recent_net_buy", needs=["flow"], ctes=SUMMARY,
       sql="""SELECT stock_code, sum(foreign_net_buy + trust_net_buy + dealer_net_buy) AS net_buy_5d
              FROM (SELECT *, row_number() OVER (PARTITION BY stock_code ORDER BY stock_date DESC) AS rn FROM summary)
              WHERE rn <= 5 GROUP BY 1""")
def _(spark, sf_dir):
    return flows.recent_net_buy(flows.investor_summary(data.flow(spark, sf_dir)))


SPLIT_DAY = dt.date(2001, 6, 1)


@query("indicator_update", needs=["daily_price"], ctes=",\n".join([NUMBERED, AVERAGES, STOCHASTIC, STRENGTH, HISTOGRAM]),
       sql=f"""SELECT stock_code, stock_date, {sql4(*indicators.INDICATORS)}
               FROM averages JOIN kd USING (stock_code, stock_date) JOIN strength USING (stock_code, stock_date)
               JOIN histogram USING (stock_code, stock_date) WHERE stock_date >= DATE '{SPLIT_DAY}'""")
def _(spark, sf_dir):
    """History up to a day, a batch that overlaps its last weeks with other prices: history wins, the batch's days come out."""
    prices = data.daily_price(spark, sf_dir).select("stock_code", "stock_date", "stock_close")
    history = prices.filter(F.col("stock_date") < F.lit(SPLIT_DAY + dt.timedelta(60)))
    batch = prices.filter(F.col("stock_date") >= F.lit(SPLIT_DAY)).withColumn(
        "stock_close", F.when(F.col("stock_date") < F.lit(SPLIT_DAY + dt.timedelta(60)), F.lit(1.0)).otherwise(F.col("stock_close")))
    return indicators.update_indicators(history, batch).select("stock_code", "stock_date", *r4s(*indicators.INDICATORS))


@query("indicator_update_tail", needs=["daily_price"],
       ctes=f"""tail AS (SELECT stock_code, stock_date, stock_close FROM (
                    SELECT *, row_number() OVER (PARTITION BY stock_code ORDER BY stock_date DESC) AS rn FROM daily_price
                    WHERE stock_date < DATE '{SPLIT_DAY}') WHERE rn <= 65
                UNION ALL SELECT stock_code, stock_date, stock_close FROM daily_price WHERE stock_date >= DATE '{SPLIT_DAY}'),
""" + NUMBERED.replace("FROM daily_price", "FROM tail") + ",\n" + STOCHASTIC,
       sql=f"""SELECT stock_code, stock_date, {sql4('k_value', 'd_value')} FROM kd WHERE stock_date >= DATE '{SPLIT_DAY}'""")
def _(spark, sf_dir):
    """The same over the latest 65 rows of history, where K and D restart from their seed."""
    prices = data.daily_price(spark, sf_dir).select("stock_code", "stock_date", "stock_close")
    history = prices.filter(F.col("stock_date") < F.lit(SPLIT_DAY))
    batch = prices.filter(F.col("stock_date") >= F.lit(SPLIT_DAY))
    return indicators.update_indicators(history, batch, tail_rows=65).select(
        "stock_code", "stock_date", *r4s("k_value", "d_value"))


@query("history_wins", needs=["daily_price"],
       sql="""SELECT coalesce(p.stock_code, q.stock_code) AS stock_code, coalesce(p.stock_date, q.stock_date) AS stock_date,
                     coalesce(p.stock_close, q.stock_close) AS stock_close
              FROM (SELECT stock_code, stock_date, stock_close FROM daily_price WHERE trading_volume > 25) p
              FULL JOIN (SELECT stock_code, stock_date, trading_money AS stock_close FROM daily_price WHERE trading_volume < 35) q
              ON p.stock_code = q.stock_code AND p.stock_date = q.stock_date""")
def _(spark, sf_dir):
    """Keyed union: where both sides have a day, the first side's row stays."""
    prices = data.daily_price(spark, sf_dir)
    history = prices.filter("trading_volume > 25").select("stock_code", "stock_date", "stock_close")
    batch = prices.filter("trading_volume < 35").select("stock_code", "stock_date", F.col("trading_money").alias("stock_close"))
    return keyed.union_keep_first([history, batch], ["stock_code", "stock_date"])


# --- ownership --------------------------------------------------------------------------------

CONCENTRATION = """
    SELECT stock_code, date AS update_date,
           coalesce(sum(CASE WHEN level >= 12 THEN percent END), 0) AS large_holders_400,
           coalesce(sum(CASE WHEN level >= 15 THEN percent END), 0) AS large_holders_1000,
           coalesce(sum(CASE WHEN level <= 3 THEN percent END), 0) AS retail_holders_10,
           CAST(sum(people) AS BIGINT) AS total_shareholders
    FROM {source} GROUP BY 1, 2"""


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each key, day and level, as a response has."""
    return data.holding(spark, sf_dir).groupBy("stock_code", "date", "HoldingSharesLevel").agg(
        F.sum("people").alias("people"), F.sum("percent").alias("percent"))


@query("weekly_concentration", needs=["holding"], sql=CONCENTRATION.format(source="holding"))
def _(spark, sf_dir):
    return ownership.weekly_concentration(data.holding(spark, sf_dir))


@query("weekly_history", needs=["holding"], ctes=f"weekly AS ({CONCENTRATION.format(source='holding')})",
       sql="""SELECT stock_code, update_date, large_holders_400, large_holders_1000, retail_holders_10, total_shareholders
              FROM (SELECT *, row_number() OVER (PARTITION BY stock_code ORDER BY update_date DESC) AS rn FROM weekly) WHERE rn <= 52""")
def _(spark, sf_dir):
    return reports.weekly_history(ownership.weekly_concentration(data.holding(spark, sf_dir)))


@query("ownership_fallback", needs=["holding"],
       ctes="""covered AS (SELECT CAST(s_suppkey AS VARCHAR) AS stock_code FROM supplier WHERE s_acctbal > 0),
chosen AS (SELECT * FROM holding WHERE stock_code IN (SELECT stock_code FROM covered)
           UNION ALL SELECT stock_code, date, level, people * 10, percent FROM holding WHERE stock_code NOT IN (SELECT stock_code FROM covered))""",
       sql=CONCENTRATION.format(source="chosen"))
def _(spark, sf_dir):
    """The first source only covers some keys; the others are taken from the second one, which has all."""
    levels = _levels(spark, sf_dir)
    covered = data.table(spark, sf_dir, "supplier").filter("s_acctbal > 0").select(
        F.col("s_suppkey").cast("string").alias("stock_code"))
    first = keyed.restrict_keys(levels, covered)
    return loads.weekly(first, levels.withColumn("people", F.col("people") * 10))


@query("ownership_file_levels", needs=["holding"],
       sql="""SELECT stock_code, strftime(date, '%Y-%m-%d') AS date,
                     coalesce(CAST(level AS VARCHAR), 'total') AS HoldingSharesLevel,
                     CAST(people AS BIGINT) AS people, percent FROM holding""")
def _(spark, sf_dir):
    """Ownership rows as the weekly file has them: odd headers, padded codes, eight-digit days."""
    raw = data.holding(spark, sf_dir).select(
        F.regexp_replace("date", "-", "").alias(" 資料日期 "), F.concat(F.col("stock_code"), F.lit("  ")).alias("證券代號"),
        F.col("HoldingSharesLevel").alias("持股分級"), F.col("people").cast("string").alias("人數"),
        F.col("percent").cast("string").alias("占集保庫存數比例%"))
    return files.ownership_levels(raw)


# --- statements -------------------------------------------------------------------------------

PIVOT = """pivoted AS (
    SELECT stock_code, date_info,
        max(CASE WHEN statement = 'cashflow' AND types IN ('CashFlowsFromOperatingActivities', 'NetCashInflowFromOperatingActivities') THEN data_value END) AS ocf,
        max(CASE WHEN statement = 'income' AND types IN ('IncomeAfterTaxes', 'IncomeAfterTax') THEN data_value END) AS ni,
        max(CASE WHEN statement = 'balance' AND (types = 'Liabilities' OR origin_name = '負債總額') AND types NOT LIKE '%_per' THEN data_value END) AS debt,
        max(CASE WHEN statement = 'balance' AND (types = 'TotalAssets' OR origin_name = '資產總額') AND types NOT LIKE '%_per' THEN data_value END) AS assets,
        max(CASE WHEN statement = 'income' AND types = 'OperatingIncome' THEN data_value END) AS op_inc,
        max(CASE WHEN statement = 'cashflow' AND types IN ('InterestExpense', 'PayTheInterest') THEN data_value END) AS int_exp,
        max(CASE WHEN statement = 'balance' AND types IN ('AccountsReceivable', 'NotesAndAccountsReceivable') THEN data_value END) AS ar,
        max(CASE WHEN statement = 'balance' AND types IN ('Inventories', 'Inventory') THEN data_value END) AS inv,
        max(CASE WHEN statement = 'income' AND types IN ('Revenue', 'OperatingRevenue') THEN data_value END) AS revenue,
        max(CASE WHEN statement = 'income' AND types IN ('OperatingCosts', 'CostOfGoodsSold') THEN data_value END) AS cost
    FROM statement_fact GROUP BY 1, 2)"""

RATIOS = PIVOT + """,
filled AS (
    SELECT stock_code, CAST(year(date_info) AS INT) AS year, CAST(quarter(date_info) AS INT) AS quarter,
           coalesce(ocf, 0) AS ocf, coalesce(ni, 0) AS ni, coalesce(debt, 0) AS debt, coalesce(assets, 0) AS assets,
           coalesce(op_inc, 0) AS op_inc, coalesce(int_exp, 0) AS int_exp, coalesce(ar, 0) AS ar, coalesce(inv, 0) AS inv,
           coalesce(revenue, 0) AS revenue, coalesce(cost, 0) AS cost,
           row_number() OVER (PARTITION BY stock_code, year(date_info), quarter(date_info) ORDER BY date_info) AS rn
    FROM pivoted),
ratios AS (
    SELECT stock_code, year, quarter,
           CASE WHEN ni > 0 THEN ocf * 100 / ni WHEN ocf >= 0 THEN 100 ELSE -100 END AS eq,
           CASE WHEN revenue > 0 THEN ar / (revenue * 4 / 365) ELSE 65 END AS recv,
           CASE WHEN cost > 0 THEN inv / (cost * 4 / 365) ELSE 85 END AS invd,
           CASE WHEN assets > 0 THEN debt * 100 / assets ELSE 0 END AS debt_pct,
           CASE WHEN int_exp > 0 THEN op_inc / int_exp WHEN op_inc >= 0 THEN 999 ELSE -999 END AS cover
    FROM filled WHERE rn = 1)"""

HISTORY = """debt_history AS (
    SELECT stock_code, date_info, debt, assets, debt / assets * 100 AS debt_ratio
    FROM (SELECT *, row_number() OVER (PARTITION BY stock_code ORDER BY date_info DESC) AS rn FROM pivoted WHERE assets > 0)
    WHERE rn <= 12)"""

LIMITS = HISTORY + """,
fitted AS (
    SELECT stock_code, floor((median(debt_ratio) + CAST(1.5 AS DOUBLE) * coalesce(stddev_samp(debt_ratio), 5)) * 100 + 0.5) / 100 AS fitted
    FROM debt_history GROUP BY 1),
limits AS (
    SELECT stock_code, CAST(80 AS DOUBLE) AS min_earnings_quality_ratio, CAST(120 AS DOUBLE) AS max_receivable_turnover_days,
           CAST(150 AS DOUBLE) AS max_inventory_turnover_days, greatest(coalesce(fitted, 60), CAST(60 AS DOUBLE)) AS max_debt_ratio,
           CAST(3 AS DOUBLE) AS min_interest_coverage
    FROM (SELECT DISTINCT stock_code FROM statement_fact) LEFT JOIN fitted USING (stock_code))"""

JUDGED = """
    SELECT stock_code, year, quarter, floor(eq * 100 + 0.5) / 100 AS earnings_quality_ratio,
           floor(recv * 100 + 0.5) / 100 AS receivable_turnover_days, floor(invd * 100 + 0.5) / 100 AS inventory_turnover_days,
           floor(debt_pct * 100 + 0.5) / 100 AS debt_ratio, floor(cover * 100 + 0.5) / 100 AS interest_coverage_ratio,
           recv > {recv} AS is_receivable_warning, invd > {inv} AS is_inventory_warning,
           eq < {eq} AS is_cash_flow_warning, debt_pct > {debt} AS is_debt_warning
    FROM {source}"""
DEFAULTS = JUDGED.format(recv=120, inv=150, eq=80, debt=60, source="ratios")


@query("statement_pivot", needs=["statement_fact"], ctes=PIVOT, sql="SELECT * FROM pivoted")
def _(spark, sf_dir):
    return statements.pivot_metrics(data.statement_fact(spark, sf_dir))


@query("statement_dates", needs=["statement_fact"],
       sql="""SELECT stock_code, date_info FROM statement_fact WHERE statement = 'balance'
              UNION SELECT stock_code, date_info FROM statement_fact WHERE statement = 'income'
              UNION SELECT stock_code, date_info FROM statement_fact WHERE statement = 'cashflow'""")
def _(spark, sf_dir):
    return statements.statement_dates(data.statement_fact(spark, sf_dir))


@query("debt_history", needs=["statement_fact"], ctes=f"{PIVOT},\n{HISTORY}",
       sql=f"SELECT stock_code, date_info, debt, assets, {sql4('debt_ratio')} FROM debt_history")
def _(spark, sf_dir):
    return statements.debt_history(data.statement_fact(spark, sf_dir)).select(
        "stock_code", "date_info", "debt", "assets", r4("debt_ratio"))


@query("default_thresholds", needs=["statement_fact"], ctes=f"{PIVOT},\n{LIMITS}", sql="SELECT * FROM limits")
def _(spark, sf_dir):
    facts = data.statement_fact(spark, sf_dir)
    return statements.default_thresholds(facts.select("stock_code").distinct(), facts)


@query("warning_indicators", needs=["statement_fact"], ctes=RATIOS, sql=DEFAULTS)
def _(spark, sf_dir):
    return statements.warning_indicators(data.statement_fact(spark, sf_dir))


@query("warnings_with_own_thresholds", needs=["statement_fact"],
       ctes=f"{RATIOS},\n{LIMITS},\njoined AS (SELECT * FROM ratios JOIN limits USING (stock_code))",
       sql=JUDGED.format(recv="max_receivable_turnover_days", inv="max_inventory_turnover_days",
                         eq="min_earnings_quality_ratio", debt="max_debt_ratio", source="joined"))
def _(spark, sf_dir):
    facts = data.statement_fact(spark, sf_dir)
    own = statements.default_thresholds(facts.select("stock_code").distinct(), facts)
    return statements.warning_indicators(facts, own)


CHANGED = {"min_earnings_quality_ratio": 50.0, "max_receivable_turnover_days": 60.0,
           "max_inventory_turnover_days": 90.0, "max_debt_ratio": 75.0, "min_interest_coverage": 2.0}


def _changes(limits: DataFrame) -> DataFrame:
    """New thresholds for the keys with a high debt limit, and for keys that have none to change."""
    keys = limits.filter("max_debt_ratio > 300").select("stock_code")
    unknown = keys.select(F.concat(F.lit("x"), "stock_code").alias("stock_code"))
    return keys.unionByName(unknown).withColumns({n: F.lit(v) for n, v in CHANGED.items()})


CHANGED_LIMITS = f"""{PIVOT},\n{LIMITS},
changed AS (
    SELECT stock_code,
           CASE WHEN hit THEN 50 ELSE min_earnings_quality_ratio END AS min_earnings_quality_ratio,
           CASE WHEN hit THEN 60 ELSE max_receivable_turnover_days END AS max_receivable_turnover_days,
           CASE WHEN hit THEN 90 ELSE max_inventory_turnover_days END AS max_inventory_turnover_days,
           CASE WHEN hit THEN 75 ELSE max_debt_ratio END AS max_debt_ratio,
           CASE WHEN hit THEN 2 ELSE min_interest_coverage END AS min_interest_coverage, hit
    FROM (SELECT *, max_debt_ratio > 300 AS hit FROM limits))"""


def _limits(spark: SparkSession, facts: DataFrame) -> DataFrame:
    rows = statements.default_thresholds(facts.select("stock_code").distinct(), facts)
    return rows.withColumn("last_updated", F.lit(None).cast("timestamp"))


@query("threshold_change", needs=["statement_fact"], ctes=CHANGED_LIMITS,
       sql="""SELECT stock_code, min_earnings_quality_ratio, max_receivable_turnover_days, max_inventory_turnover_days,
                     max_debt_ratio, min_interest_coverage, hit AS stamped FROM changed""")
def _(spark, sf_dir):
    facts = data.statement_fact(spark, sf_dir)
    limits = _limits(spark, facts)
    changed = statements.apply_threshold_changes(limits, _changes(limits))
    return changed.withColumn("stamped", F.col("last_updated").isNotNull()).drop("last_updated")


@query("warnings_after_change", needs=["statement_fact"],
       ctes=RATIOS + CHANGED_LIMITS.removeprefix(PIVOT) + ",\njoined AS (SELECT * FROM ratios JOIN changed USING (stock_code))",
       sql=JUDGED.format(recv="max_receivable_turnover_days", inv="max_inventory_turnover_days",
                         eq="min_earnings_quality_ratio", debt="max_debt_ratio", source="joined"))
def _(spark, sf_dir):
    facts = data.statement_fact(spark, sf_dir)
    limits = _limits(spark, facts)
    changed = statements.apply_threshold_changes(limits, _changes(limits))
    return statements.warning_indicators(facts, changed)


@query("warning_history", needs=["statement_fact"], ctes=f"{RATIOS},\n{LIMITS},\njudged AS ({DEFAULTS})",
       sql="""SELECT h.*, l.* EXCLUDE (stock_code)
              FROM (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY stock_code ORDER BY year DESC, quarter DESC) AS rn FROM judged)
                    WHERE rn <= 12) h LEFT JOIN limits l ON h.stock_code = l.stock_code""")
def _(spark, sf_dir):
    facts = data.statement_fact(spark, sf_dir)
    return reports.warning_history(statements.warning_indicators(facts), _limits(spark, facts))


@query("warning_lights", needs=["statement_fact"], ctes=f"{RATIOS},\njudged AS ({DEFAULTS})",
       sql="""SELECT stock_code, year || ' Q' || quarter AS period,
                     CASE WHEN is_cash_flow_warning THEN 'warn (' ELSE 'ok (' END || printf('%.1f', floor(earnings_quality_ratio * 10 + 0.5) / 10) || '%)' AS cash_flow_light,
                     CASE WHEN is_debt_warning THEN 'warn (' ELSE 'ok (' END || printf('%.1f', floor(debt_ratio * 10 + 0.5) / 10) || '%)' AS debt_light,
                     CASE WHEN is_receivable_warning THEN 'warn (' ELSE 'ok (' END || printf('%.0f', floor(receivable_turnover_days + 0.5)) || 'd)' AS receivable_light,
                     CASE WHEN is_inventory_warning THEN 'warn (' ELSE 'ok (' END || printf('%.0f', floor(inventory_turnover_days + 0.5)) || 'd)' AS inventory_light,
                     printf('%.2f', interest_coverage_ratio) || 'x' AS coverage_text FROM judged""")
def _(spark, sf_dir):
    return reports.warning_lights(statements.warning_indicators(data.statement_fact(spark, sf_dir)))


ROE = """roe AS (
    SELECT b.stock_code,
           max(CASE WHEN f.types IN ('IncomeAfterTaxes', 'IncomeAfterTax') THEN f.data_value END)
           / nullif(max(CASE WHEN b.types = 'TotalAssets' AND b.types NOT LIKE '%_per' THEN b.data_value END), 0) * 100 AS estimated_roe
    FROM balance_fact b
    JOIN (SELECT stock_code, max(date_info) AS last_date FROM balance_fact GROUP BY 1) q
      ON b.stock_code = q.stock_code AND b.date_info = q.last_date
    LEFT JOIN income_fact f ON b.stock_code = f.stock_code AND b.date_info = f.date_info
    GROUP BY 1)"""


@query("estimated_roe", needs=["balance_fact", "income_fact"], ctes=ROE,
       sql=f"SELECT stock_code, {sql4('estimated_roe')} FROM roe")
def _(spark, sf_dir):
    return statements.estimated_roe(data.statement_fact(spark, sf_dir)).select("stock_code", r4("estimated_roe"))


# --- screener ---------------------------------------------------------------------------------

FACTORS = ",\n".join([SUMMARY, NUMBERED, AVERAGES, ROE]) + """,
flowed AS (
    SELECT stock_code, stock_date, coalesce(foreign_net_buy, 0) + coalesce(trust_net_buy, 0) + coalesce(dealer_net_buy, 0) AS net
    FROM daily_price LEFT JOIN summary USING (stock_code, stock_date)),
bought AS (
    SELECT stock_code, sum(net) AS net_buy_5d
    FROM (SELECT *, row_number() OVER (PARTITION BY stock_code ORDER BY stock_date DESC) AS rn FROM flowed)
    WHERE rn <= 5 GROUP BY 1),
factors AS (
    SELECT d.stock_code, company_name, d.stock_close, ma20, ma60, coalesce(net_buy_5d, 0) AS net_buy_5d,
           coalesce(estimated_roe, 0) AS estimated_roe
    FROM daily_price d
    JOIN (SELECT stock_code, max(stock_date) AS last_date FROM daily_price GROUP BY 1) l
      ON d.stock_code = l.stock_code AND d.stock_date = l.last_date
    JOIN averages a ON d.stock_code = a.stock_code AND d.stock_date = a.stock_date
    LEFT JOIN bought b ON d.stock_code = b.stock_code LEFT JOIN roe r ON d.stock_code = r.stock_code
    LEFT JOIN company c ON d.stock_code = c.stock_code)"""
FACTOR_NEEDS = ["daily_price", "flow", "balance_fact", "income_fact", "company"]
FACTOR_ROW = f"SELECT stock_code, company_name, stock_close, {sql4('ma20', 'ma60')}, net_buy_5d, {sql4('estimated_roe')} FROM factors"


def factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = assembled(spark, sf_dir)
    return screener.factor_table(screener.latest_from_prices(daily), data.statement_fact(spark, sf_dir),
                                 data.company(spark, sf_dir))


def factor_row(df: DataFrame) -> DataFrame:
    return df.select("stock_code", "company_name", "stock_close", *r4s("ma20", "ma60"), "net_buy_5d", r4("estimated_roe"))


@query("factor_table", needs=FACTOR_NEEDS, ctes=FACTORS, sql=FACTOR_ROW)
def _(spark, sf_dir):
    return factor_row(factors(spark, sf_dir))


@query("screener", needs=FACTOR_NEEDS, ctes=FACTORS,
       sql=FACTOR_ROW + " WHERE estimated_roe >= 0.5 AND net_buy_5d >= 10 AND stock_close > ma20")
def screened(spark, sf_dir):
    return factor_row(screener.screen(factors(spark, sf_dir), min_roe=0.5, ma_cross="ma20", min_net_buy=10))


@query("screener_from_stored_metrics", needs=FACTOR_NEEDS, ctes=FACTORS, sql=FACTOR_ROW + " WHERE stock_close > ma60")
def _(spark, sf_dir):
    """The screener over daily metrics that carry their averages, as they are stored."""
    daily = with_indicators(spark, sf_dir, assembled(spark, sf_dir), ["ma20", "ma60"])
    return factor_row(screener.screener(daily, data.statement_fact(spark, sf_dir), data.company(spark, sf_dir),
                                        ma_cross="ma60"))


@query("factor_metrics", needs=FACTOR_NEEDS, ctes=FACTORS, sql=FACTOR_ROW)
def _(spark, sf_dir):
    """Factor rows from stored metrics, of all keys."""
    daily = with_indicators(spark, sf_dir, assembled(spark, sf_dir), ["ma20", "ma60"])
    return factor_row(screener.factor_metrics(daily, data.statement_fact(spark, sf_dir), data.company(spark, sf_dir)))


@query("factor_labels", needs=FACTOR_NEEDS, ctes=FACTORS,
       sql="""SELECT stock_code, company_name, printf('%.2f', floor(stock_close * 100 + 0.5) / 100) AS close_text,
                     CASE WHEN net_buy_5d > 0 THEN 'buy' WHEN net_buy_5d < 0 THEN 'sell' ELSE 'flat' END AS net_buy_direction,
                     CASE WHEN net_buy_5d >= 0 THEN '+' ELSE '-' END || format('{:,}', CAST(abs(net_buy_5d) AS BIGINT)) AS net_buy_text,
                     CASE WHEN ma20 IS NULL THEN 'N/A' WHEN stock_close > ma20 THEN 'above' ELSE 'below' END AS ma20_position,
                     CASE WHEN ma60 IS NULL THEN 'N/A' WHEN stock_close > ma60 THEN 'above' ELSE 'below' END AS ma60_position,
                     CASE WHEN ma20 IS NULL THEN 'N/A' ELSE printf('%.2f', floor(ma20 * 100 + 0.5) / 100) END AS ma20_text,
                     CASE WHEN ma60 IS NULL THEN 'N/A' ELSE printf('%.2f', floor(ma60 * 100 + 0.5) / 100) END AS ma60_text,
                     printf('%.2f', floor(estimated_roe * 100 + 0.5) / 100) AS roe_text
              FROM (SELECT * REPLACE (floor(ma20 * 10000 + 0.5) / 10000 AS ma20, floor(ma60 * 10000 + 0.5) / 10000 AS ma60) FROM factors)""")
def _(spark, sf_dir):
    return screener.factor_labels(factor_row(factors(spark, sf_dir)))


@query("factor_table_titled", needs=FACTOR_NEEDS, ctes=FACTORS,
       sql="""SELECT stock_code AS "股票代碼", company_name AS "公司名稱", stock_close AS "收盤價", net_buy_5d AS "近5日法人淨買進(張)",
                     floor(ma20 * 10000 + 0.5) / 10000 AS "月線(MA20)", floor(ma60 * 10000 + 0.5) / 10000 AS "季線(MA60)",
                     floor(estimated_roe * 10000 + 0.5) / 10000 AS "估算ROE(%)" FROM factors""")
def _(spark, sf_dir):
    return screener.titled(factor_row(factors(spark, sf_dir)))


# --- news -------------------------------------------------------------------------------------

CLEANED = """pieces AS (SELECT *, string_split(title, ' - ') AS parts, source_name = '' AND contains(title, ' - ') AS cut FROM feed),
cleaned AS (
    SELECT stock_code, CASE WHEN cut THEN trim(array_to_string(parts[1:len(parts) - 1], ' - '), ' ' || chr(9) || chr(10) || chr(13)) ELSE title END AS title,
           published, link, CASE WHEN cut THEN trim(parts[len(parts)]) ELSE source_name END AS source_name FROM pieces),
accepted AS (
    SELECT * FROM cleaned WHERE contains(lower(source_name), 'cmoney') OR contains(lower(source_name), 'yahoo股市'))"""

SHOWN = """ordered AS (SELECT *, row_number() OVER (PARTITION BY stock_code ORDER BY publish_time DESC NULLS LAST, news_link) AS rn FROM news),
once AS (SELECT *, row_number() OVER (PARTITION BY stock_code, title ORDER BY rn) AS rt FROM ordered WHERE rn <= 100),
shown AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY stock_code ORDER BY rn) AS position FROM once WHERE rt = 1) WHERE position <= 30)"""

DAY_SCORES = """day_scores AS (
    SELECT stock_code, CAST(publish_time AS DATE) AS stock_date, avg(sentiment_score) AS avg_sentiment FROM news
    WHERE publish_time IS NOT NULL GROUP BY 1, 2)"""


@query("feed_clean_up", needs=["feed"], ctes=CLEANED,
       sql="SELECT stock_code, title, strftime(published, '%Y-%m-%d %H:%M') AS published_minute, link, source_name FROM accepted")
def _(spark, sf_dir):
    return news.clean_entries(data.feed(spark, sf_dir)).select(
        "stock_code", "title", dates.minute_text(dates.feed_time(F.col("published"))).alias("published_minute"),
        "link", "source_name")


@query("page_titles_split",
       ctes="""titles AS (SELECT CAST(page_id AS VARCHAR) AS link, regexp_extract(html, '<title>([^<]*)</title>', 1) || ' - cnyes - 鉅亨網' AS title FROM pages)""",
       sql="""SELECT link, regexp_extract(title, '^(.*) - 鉅亨網$', 1) AS title, '鉅亨網' AS source_name FROM titles""")
def _(spark, sf_dir):
    """Page titles as feed titles whose publisher follows the last separator."""
    pages = data.table(spark, sf_dir, "pages").select(
        F.col("page_id").cast("string").alias("link"), F.lit("").alias("source_name"), F.lit("").alias("published"),
        F.concat(F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit(" - cnyes - 鉅亨網")).alias("title"))
    return news.clean_entries(pages).select("link", "title", "source_name")


@query("news_search", needs=["feed"],
       ctes=CLEANED.replace("FROM feed)", "FROM feed WHERE contains(title, 'e') AND CAST(published AS DATE) BETWEEN DATE '2024-01-03' AND DATE '2024-02-20')"),
       sql="SELECT stock_code, title, link FROM accepted")
def _(spark, sf_dir):
    """Titles holding the key's keyword within a span of days, from accepted publishers."""
    entries = data.feed(spark, sf_dir)
    keywords = entries.select("stock_code").distinct().withColumn("keyword", F.lit("e"))
    return news_feed.search(entries, keywords, dt.date(2024, 1, 3), dt.date(2024, 2, 20)).select("stock_code", "title", "link")


@query("headline_scores", needs=["news"], sql="SELECT stock_code, news_link, sentiment_score FROM news")
def _(spark, sf_dir):
    return data.news(spark, sf_dir).select("stock_code", "news_link", "sentiment_score")


@query("model_scores", needs=["headline"],
       sql="""SELECT link AS news_link, CASE WHEN contains(title, 'the') THEN 0.0 WHEN length(title) > 60 THEN 0.5
                                     WHEN length(title) < 30 THEN -0.5 ELSE 0.0 END::DOUBLE AS sentiment_score FROM headline""")
def _(spark, sf_dir):
    """Scores of a pluggable model; titles it fails on fall back to the lexicon (no hits here).

    The stand-in model finds long titles positive, short ones negative, and refuses some.
    """
    def make_scorer():
        def score(titles):
            if any("the" in t for t in titles):
                raise ValueError("cannot score")
            return [("Positive" if len(t) > 60 else "label_2" if len(t) < 30 else "Neutral", 0.5) for t in titles]
        return score

    titles = data.headline(spark, sf_dir).select(F.col("link").alias("news_link"), "title")
    return news.model_sentiment(titles, make_scorer).drop("title")


@query("merged_searches", needs=["feed"],
       sql="""SELECT stock_code, link, CASE WHEN published >= TIMESTAMP '2024-01-20' THEN title ELSE 'old: ' || title END AS title FROM feed""")
def _(spark, sf_dir):
    """Recent and historical search results overlap; the recent row stays."""
    entries = data.feed(spark, sf_dir).select("stock_code", "link", "title", "published")
    recent = entries.filter(dates.feed_time(F.col("published")) >= F.lit("2024-01-20").cast("timestamp"))
    historical = entries.withColumn("title", F.concat(F.lit("old: "), "title"))
    return news.merge_searches(recent, historical).drop("published")


@query("news_rows", needs=["feed"], ctes=CLEANED,
       sql="""SELECT stock_code, title, strftime(published, '%Y-%m-%d %H:%M') AS publish_minute, link AS news_link, '' AS content,
                     sha256(stock_code || chr(1) || link) AS news_id FROM accepted""")
def _(spark, sf_dir):
    """Stored news rows from feed entries that arrive twice."""
    entries = news.clean_entries(data.feed(spark, sf_dir))
    rows = news.as_news(entries.unionByName(entries))
    return rows.select("stock_code", "title", dates.minute_text(F.col("publish_time")).alias("publish_minute"),
                       "news_link", "content", "news_id")


@query("news_stream_load", needs=["feed"], ctes=CLEANED,
       sql="""SELECT stock_code, title, strftime(published, '%Y-%m-%d %H:%M') AS publish_minute, link AS news_link FROM accepted""")
def _(spark, sf_dir):
    """Entries landed as JSON responses, streamed into the stored table, two thirds of the files and then the rest, twice over."""
    entries = data.feed(spark, sf_dir).withColumn("source", F.struct(F.col("source_name").alias("title"))).drop("source_name")
    landing, store = fresh_path(spark, "landing"), _store(spark)
    response = F.array(F.struct("title", "published", "link", "source")).alias("entries")
    n_files = max(3, entries.rdd.getNumPartitions())  # as the input has splits
    entries.select("stock_code", response).repartition(n_files).write.json(landing)
    for attempt in ("first", "again"):
        rows = stream_loads.news_stream(spark, landing, files_per_batch=-(-2 * n_files // 3))
        stream_loads.append_stream(rows, store, "news", fresh_path(spark, f"checkpoint-{attempt}")).awaitTermination()
    return store.read("news").select(
        "stock_code", "title", dates.minute_text(F.col("publish_time")).alias("publish_minute"), "news_link")


@query("latest_news", needs=["news"], ctes=SHOWN,
       sql="""SELECT stock_code, CAST(position AS INT) AS position, title, strftime(publish_time, '%Y-%m-%d %H:%M') AS publish_minute, news_link, sentiment_score FROM shown""")
def _(spark, sf_dir):
    return reports.latest_news(data.news(spark, sf_dir))


@query("daily_sentiment", needs=["news"], ctes=DAY_SCORES,
       sql=f"SELECT stock_code, stock_date, {sql4('avg_sentiment')} FROM day_scores")
def _(spark, sf_dir):
    return news.daily_sentiment(data.news(spark, sf_dir)).select("stock_code", "stock_date", r4("avg_sentiment"))


@query("price_sentiment", needs=["news", "news_price"], ctes=DAY_SCORES,
       sql="""SELECT stock_code, stock_date, strftime(stock_date, '%Y-%m-%d') AS day, stock_close,
                     floor(coalesce(avg_sentiment, 0) * 10000 + 0.5) / 10000 AS avg_sentiment
              FROM news_price LEFT JOIN day_scores USING (stock_code, stock_date)
              WHERE stock_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-25'""")
def _(spark, sf_dir):
    joined = reports.price_sentiment(data.news_price(spark, sf_dir), data.news(spark, sf_dir),
                                     dt.date(2024, 1, 5), dt.date(2024, 1, 25))
    return joined.select("stock_code", "stock_date", "day", "stock_close", r4("avg_sentiment"))


@query("news_zscores", needs=["news"], ctes=SHOWN + """,
spread AS (SELECT stock_code, avg(sentiment_score) AS m, stddev_samp(sentiment_score) AS s FROM shown GROUP BY 1)""",
       sql="""SELECT stock_code, news_link, CASE WHEN sentiment_score > 0.1 THEN 'positive' WHEN sentiment_score < -0.1 THEN 'negative' ELSE 'neutral' END AS label,
                     floor(CASE WHEN sentiment_score BETWEEN -0.1 AND 0.1 OR s IS NULL OR s = 0 THEN 0 ELSE (sentiment_score - m) / s END * 10000 + 0.5) / 10000 AS z_score,
                     CASE WHEN sentiment_score BETWEEN -0.1 AND 0.1 THEN '0.00' WHEN s IS NULL OR s = 0 THEN '+0.00'
                          ELSE CASE WHEN sentiment_score < m THEN '-' ELSE '+' END
                               || printf('%.2f', floor(abs((sentiment_score - m) / s) * 100 + 0.5) / 100) END AS z_text
              FROM shown JOIN spread USING (stock_code)""")
def _(spark, sf_dir):
    shown = news.shown_news(data.news(spark, sf_dir))
    return news.with_zscores(shown).select("stock_code", "news_link", "label", r4("z_score"), "z_text")


# --- company and landed files -------------------------------------------------------------------

@query("company_load",
       ctes="""raw AS (SELECT *, lpad(CAST(s_nationkey + 20 AS VARCHAR), 2, '0') AS industry FROM supplier)""",
       sql="""SELECT CAST(s_suppkey AS VARCHAR) AS stock_code, s_name AS company_name,
                     CASE WHEN s_suppkey % 2 = 0 THEN make_date(1990 + s_suppkey % 20, 3, 7) END AS listing_date,
                     CASE industry WHEN '20' THEN '其他' WHEN '21' THEN '化學工業' WHEN '22' THEN '生技醫療業' WHEN '23' THEN '油電燃氣業'
                          WHEN '24' THEN '半導體業' WHEN '25' THEN '電腦及週邊設備業' WHEN '26' THEN '光電業' WHEN '27' THEN '通信網路業'
                          WHEN '28' THEN '電子零組件業' WHEN '29' THEN '電子通路業' WHEN '30' THEN '資訊服務業' WHEN '31' THEN '其他電子業'
                          WHEN '32' THEN '文化創意業' WHEN '33' THEN '農業科技業' WHEN '34' THEN '電子商務' WHEN '35' THEN '綠能環保'
                          WHEN '36' THEN '數位雲端' WHEN '37' THEN '運動休閒' WHEN '38' THEN '居家生活' ELSE '其他' END AS company_class,
                     '上市' AS market_class
              FROM raw WHERE s_suppkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')""")
def _(spark, sf_dir):
    """Suppliers as a company master file: padded texts, eight-digit days (half unreadable), coded industries."""
    key = F.col("s_suppkey")
    day = F.when(key % 2 == 0, F.concat((F.lit(1990) + key % 20).cast("string"), F.lit("0307"))).otherwise("760221")
    raw = data.table(spark, sf_dir, "supplier").select(
        F.concat(F.lit(" "), key.cast("string")).alias("公司代號"), F.concat("s_name", F.lit("  ")).alias("公司名稱"),
        day.alias("上市日期"), (F.col("s_nationkey") + 20).cast("string").alias("產業別"),
        *[F.lit(None).cast("string").alias(c) for c in files.C.COMPANY_FIELDS
          if c not in ("公司代號", "公司名稱", "上市日期", "產業別")])
    wanted = data.table(spark, sf_dir, "customer").filter("c_mktsegment <> 'BUILDING'").select(
        F.col("c_custkey").cast("string").alias("stock_code"))
    return files.companies(raw, wanted).select("stock_code", "company_name", "listing_date", "company_class", "market_class")


@query("company_backup_load",
       sql="""SELECT CAST(s_suppkey AS VARCHAR) AS stock_code, s_name AS company_name, s_name AS company_name_abbr,
                     make_date(1990 + s_nationkey, 3, 7) AS listing_date FROM supplier""")
def _(spark, sf_dir):
    """Suppliers as a Parquet backup of the company table, with text dates and without short names."""
    path = fresh_path(spark, "backup")
    data.table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").cast("string").alias("StockCode"), F.col("s_name").alias("CompanyNameC"),
        F.concat((F.lit(1990) + F.col("s_nationkey")).cast("string"), F.lit("-03-07 00:00:00")).alias("ListingDate"),
        F.col("s_acctbal").alias("Dataid")).write.parquet(path)
    return files.read_company_backup(spark, path)


@query("company_record", needs=["company"], sql="SELECT * FROM company WHERE stock_code = '3'")
def _(spark, sf_dir):
    return reports.company_record(data.company(spark, sf_dir), "3")


@query("search_keywords", needs=["company"],
       sql="SELECT stock_code, coalesce(nullif(company_name_abbr, ''), nullif(company_name, ''), stock_code) AS keyword FROM company")
def _(spark, sf_dir):
    return news_feed.company_keywords(data.company(spark, sf_dir))


def _landed_query(dataset: str, sql: str, needs: list[str], fields: Callable[[SparkSession, str], DataFrame],
                  start: str | None = None, end: str | None = None) -> None:
    """Rows of a table sent as response text, one response per row, and read back by the typed parser."""
    @query(f"landed_{dataset}", needs=needs, sql=sql)
    def _(spark, sf_dir):
        rows = fields(spark, sf_dir)
        responses = rows.select(F.to_json(F.struct(F.array(F.struct(*rows.columns)).alias("data"))).alias("value"))
        landing = LANDINGS[dataset]
        return landed.bounded(landed.parse_responses(responses, dataset), landing, start, end)


_landed_query("price", """SELECT strftime(stock_date, '%Y-%m-%d') AS date, stock_code AS stock_id, stock_close AS close,
              trading_volume AS Trading_Volume, trading_money AS Trading_money FROM daily_price
              WHERE stock_date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'""", ["daily_price"],
              lambda spark, sf: data.daily_price(spark, sf).select(
                  F.col("stock_date").cast("string").alias("date"), F.col("stock_code").alias("stock_id"),
                  F.col("stock_close").alias("close"), F.col("trading_volume").alias("Trading_Volume"),
                  F.col("trading_money").alias("Trading_money")), "1996-01-01", "1999-12-31")
_landed_query("investor", """SELECT strftime(stock_date, '%Y-%m-%d') AS date, stock_code AS stock_id, buy, name, sell FROM flow""",
              ["flow"], lambda spark, sf: data.flow(spark, sf).select(
                  F.col("stock_date").cast("string").alias("date"), F.col("stock_code").alias("stock_id"), "buy", "name", "sell"))
_landed_query("margin", """SELECT strftime(stock_date, '%Y-%m-%d') AS date, stock_code AS stock_id,
              margin_balance AS MarginPurchaseTodayBalance, CAST(0 AS DOUBLE) AS ShortSaleTodayBalance FROM margin""",
              ["margin"], lambda spark, sf: data.margin(spark, sf).select(
                  F.col("stock_date").cast("string").alias("date"), F.col("stock_code").alias("stock_id"),
                  F.col("margin_balance").alias("MarginPurchaseTodayBalance")))
_landed_query("holding", """SELECT strftime(date, '%Y-%m-%d') AS date, stock_code AS stock_id,
              coalesce(CAST(level AS VARCHAR), 'total') AS HoldingSharesLevel, CAST(people AS BIGINT) AS people, percent,
              CAST(NULL AS DOUBLE) AS unit FROM holding""",
              ["holding"], lambda spark, sf: data.holding(spark, sf).withColumnRenamed("stock_code", "stock_id"))
for _name in ("income", "balance", "cashflow"):
    _landed_query(_name, f"""SELECT strftime(date_info, '%Y-%m-%d') AS date, stock_code AS stock_id, types AS type,
                  data_value AS value, origin_name FROM {_name}_fact""", [f"{_name}_fact"],
                  lambda spark, sf, _name=_name: getattr(data, f"{_name}_fact")(spark, sf).select(
                      F.col("date_info").cast("string").alias("date"), F.col("stock_code").alias("stock_id"),
                      F.col("types").alias("type"), F.col("data_value").alias("value"), "origin_name"))
_landed_query("valuation", """SELECT strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS date, CAST(o_custkey AS VARCHAR) AS stock_id,
              CAST(o_orderkey % 7 AS DOUBLE) AS dividend_yield, o_totalprice AS PER, CAST(NULL AS DOUBLE) AS PBR FROM orders""",
              [], lambda spark, sf: data.table(spark, sf, "orders").select(
                  F.to_date("o_orderdate").cast("string").alias("date"), F.col("o_custkey").cast("string").alias("stock_id"),
                  (F.col("o_orderkey") % 7).cast("double").alias("dividend_yield"), F.col("o_totalprice").alias("PER")))


def _landed_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    return data.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("stock_id"), F.floor("o_totalprice").cast("double").alias("revenue"),
        F.month(day).alias("revenue_month"), F.year(day).alias("revenue_year"), day.cast("string").alias("date"))


_landed_query("revenue", """SELECT CAST(o_custkey AS VARCHAR) AS stock_id, floor(o_totalprice) AS revenue,
              CAST(month(o_orderdate) AS INT) AS revenue_month, CAST(year(o_orderdate) AS INT) AS revenue_year,
              strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS date FROM orders""", [], _landed_revenue)


def _landed_dividend(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return data.table(spark, sf_dir, "part").select(
        key.cast("string").alias("stock_id"), F.concat((F.lit(2000) + key % 20).cast("string")).alias("year"),
        F.col("p_size").cast("string").alias("CashEarningsDistribution"),
        F.when(key % 3 == 0, "x").when(key % 3 == 1, "0.5").alias("CashStatutorySurplus"),
        F.when(key % 4 == 0, "").otherwise("1.25").alias("StockEarningsDistribution"),
        F.when(key % 5 == 0, "").when(key % 5 > 1, "2020-07-01").alias("CashExDividendTradingDate"),
        F.when(key % 7 > 0, "2020-08-01").alias("CashDividendPaymentDate"))


_landed_query("dividend", """SELECT CAST(p_partkey AS VARCHAR) AS stock_id, CAST(2000 + p_partkey % 20 AS VARCHAR) AS year,
              CASE WHEN p_partkey % 4 = 0 THEN '' ELSE '1.25' END AS StockEarningsDistribution, '' AS StockStatutorySurplus,
              CAST(p_size AS VARCHAR) AS CashEarningsDistribution,
              CASE p_partkey % 3 WHEN 0 THEN 'x' WHEN 1 THEN '0.5' ELSE '' END AS CashStatutorySurplus,
              CASE WHEN p_partkey % 5 > 1 THEN '2020-07-01' ELSE '' END AS CashExDividendTradingDate,
              CASE WHEN p_partkey % 7 > 0 THEN '2020-08-01' ELSE '' END AS CashDividendPaymentDate FROM part""", [], _landed_dividend)


@query("dividends",
       sql="""SELECT CAST(p_partkey AS VARCHAR) AS stock_code, CAST(2000 + p_partkey % 20 AS VARCHAR) AS date_info,
                     p_size + CASE WHEN p_partkey % 3 = 1 THEN CAST(0.5 AS DOUBLE) ELSE 0 END AS cash_dividends,
                     CASE WHEN p_partkey % 4 = 0 THEN CAST(0 AS DOUBLE) ELSE 1.25 END AS stock_dividend,
                     '2020-07-01' AS ex_dividend_date, '2020-08-01' AS cash_dividend_date
              FROM part WHERE p_partkey % 5 > 1 AND p_partkey % 7 > 0""")
def _(spark, sf_dir):
    rows = _landed_dividend(spark, sf_dir).withColumn("StockStatutorySurplus", F.lit(""))
    return loads.dividends(rows)


@query("monthly_revenue",
       sql="""SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS stock_code, CAST(year(o_orderdate) AS INT) AS revenue_year,
                     CAST(month(o_orderdate) AS INT) AS revenue_month, floor(o_totalprice) AS total_revenue FROM orders""")
def _(spark, sf_dir):
    return loads.revenues(_landed_revenue(spark, sf_dir))


@query("statement_rows", needs=["income_fact"],
       sql="SELECT DISTINCT statement, stock_code, date_info, types, data_value, origin_name FROM income_fact")
def _(spark, sf_dir):
    rows = data.income_fact(spark, sf_dir).select(
        F.col("date_info").cast("string").alias("date"), F.col("stock_code").alias("stock_id"),
        F.col("types").alias("type"), F.col("data_value").alias("value"), "origin_name")
    return statements.as_facts(rows.unionByName(rows), "income")


@query("event_properties", sql="SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def _(spark, sf_dir):
    """Nested text fields flattened through an explicit schema."""
    return data.table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint").alias("p")).select(
        "event_id", "p.k")


@query("day_texts",
       sql="""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS parsed, strftime(o_orderdate, '%Y-%m-%d') AS dashed,
                     CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderdate AS DATE) END AS readable FROM orders""")
def _(spark, sf_dir):
    """Eight-digit days parsed, dashed, and parsed again where half of them are damaged."""
    compact = F.date_format("o_orderdate", "yyyyMMdd")
    damaged = F.when(F.col("o_orderkey") % 2 == 0, compact).otherwise(F.concat(compact, F.lit("?")))
    return data.table(spark, sf_dir, "orders").select(
        "o_orderkey", dates.compact_date(compact).alias("parsed"), dates.dashed_date(compact).alias("dashed"),
        dates.compact_date(damaged).alias("readable"))


# --- incremental loads and stored tables --------------------------------------------------------

MARKS = """keys AS (SELECT stock_code FROM company UNION SELECT 'new' || CAST(n_nationkey AS VARCHAR) FROM nation),
marks AS (
    SELECT stock_code, coalesce(max(stock_date), DATE '2000-01-01') AS mark
    FROM keys LEFT JOIN (SELECT * FROM daily_price WHERE stock_date < DATE '2001-06-01') USING (stock_code) GROUP BY 1)"""


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    fresh = data.table(spark, sf_dir, "nation").select(
        F.concat(F.lit("new"), F.col("n_nationkey").cast("string")).alias("stock_code"))
    return data.company(spark, sf_dir).select("stock_code").unionByName(fresh)


def _marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = data.daily_price(spark, sf_dir).filter(F.col("stock_date") < F.lit(SPLIT_DAY))
    return incremental.high_water_marks(_keys(spark, sf_dir), stored, "stock_date", TODAY, default_years=1)


@query("high_water_marks", needs=["daily_price", "company"], ctes=MARKS, sql="SELECT * FROM marks")
def _(spark, sf_dir):
    return _marks(spark, sf_dir)


@query("landed_delta", needs=["daily_price", "company"], ctes=MARKS,
       sql="""SELECT stock_code, stock_date, stock_close FROM daily_price JOIN marks USING (stock_code)
              WHERE stock_date >= mark AND stock_date <= DATE '2001-12-31'""")
def _(spark, sf_dir):
    prices = data.daily_price(spark, sf_dir).select("stock_code", "stock_date", "stock_close")
    return incremental.delta(prices, _marks(spark, sf_dir), F.col("stock_date"), TODAY)


@query("news_marks", needs=["news", "company"],
       ctes="""keys AS (SELECT DISTINCT stock_code FROM (SELECT stock_code FROM company UNION ALL SELECT stock_code FROM news)),
starts AS (SELECT stock_code, coalesce(max(CAST(publish_time AS DATE)), DATE '2024-01-20' - 90) AS history_start
           FROM keys LEFT JOIN news USING (stock_code) GROUP BY 1)""",
       sql="SELECT stock_code, CAST(history_start AS DATE) AS history_start, CAST(least(history_start, DATE '2024-01-20' - 7) AS DATE) AS mark FROM starts")
def _(spark, sf_dir):
    rows = data.news(spark, sf_dir)
    keys = data.company(spark, sf_dir).select("stock_code").unionByName(rows.select("stock_code"))
    return incremental.news_marks(keys, rows, dt.date(2024, 1, 20))


@query("row_counts", needs=["daily_price", "company"], ctes=MARKS,
       sql="""SELECT stock_code, count(stock_date) AS n_rows FROM keys
              LEFT JOIN (SELECT * FROM daily_price WHERE stock_date >= DATE '2001-06-01') USING (stock_code) GROUP BY 1""")
def _(spark, sf_dir):
    return incremental.row_counts(_keys(spark, sf_dir), data.daily_price(spark, sf_dir), SPLIT_DAY)


@query("latest_day", needs=["daily_price"], sql="SELECT max(stock_date) AS latest_day FROM daily_price")
def _(spark, sf_dir):
    return incremental.latest_day(data.daily_price(spark, sf_dir))


@query("stale_keys", needs=["daily_price", "company"], ctes=MARKS,
       sql="SELECT stock_code FROM keys WHERE stock_code NOT IN (SELECT stock_code FROM daily_price WHERE stock_date >= DATE '2001-10-15')")
def _(spark, sf_dir):
    return incremental.stale_keys(_keys(spark, sf_dir), data.daily_price(spark, sf_dir), dt.date(2001, 10, 15))


@query("daily_range", needs=["daily_price"],
       sql="SELECT stock_code, stock_date, stock_close FROM daily_price WHERE stock_date BETWEEN DATE '1997-03-01' AND DATE '1998-02-28'")
def _(spark, sf_dir):
    return reports.daily_range(data.daily_price(spark, sf_dir).select("stock_code", "stock_date", "stock_close"),
                               dt.date(1997, 3, 1), dt.date(1998, 2, 28))


@query("duplicate_keys", sql="SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(spark, sf_dir):
    return keyed.duplicate_keys(data.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("orphan_keys", needs=["margin"],
       ctes="parents AS (SELECT CAST(s_suppkey AS VARCHAR) AS stock_code FROM supplier WHERE s_acctbal > 0)",
       sql="SELECT stock_code, count(*) AS n_rows FROM margin WHERE stock_code NOT IN (SELECT stock_code FROM parents) GROUP BY 1")
def _(spark, sf_dir):
    parents = data.table(spark, sf_dir, "supplier").filter("s_acctbal > 0").select(
        F.col("s_suppkey").cast("string").alias("stock_code"))
    return keyed.orphans(data.margin(spark, sf_dir), parents)


def _store(spark: SparkSession) -> Warehouse:
    return Warehouse(spark, fresh_path(spark, "store"))


def _written(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Rows several batches are cut from, derived once."""
    path = fresh_path(spark, "input")
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


@query("idempotent_append", needs=["daily_price"],
       sql="""SELECT stock_code, stock_date, CASE WHEN trading_volume > 25 THEN stock_close ELSE CAST(1 AS DOUBLE) END AS stock_close
              FROM daily_price WHERE trading_volume > 25 OR trading_volume < 35""")
def _(spark, sf_dir):
    """Two overlapping batches, the second one sent twice: existing rows stay, new ones are added once."""
    prices = _written(spark, data.daily_price(spark, sf_dir).select("stock_code", "stock_date", "stock_close", "trading_volume"))
    store = _store(spark)
    second = prices.filter("trading_volume < 35").withColumn("stock_close", F.lit(1.0))
    store.append_new("daily_metrics", prices.filter("trading_volume > 25"))
    store.append_new("daily_metrics", second)
    store.append_new("daily_metrics", second)
    return store.read("daily_metrics").select("stock_code", "stock_date", F.col("stock_close").cast("double").alias("stock_close"))


@query("upsert_warnings", needs=["statement_fact"],
       ctes=f"{RATIOS},\njudged AS ({DEFAULTS})",
       sql="""SELECT stock_code, year, quarter, debt_ratio,
                     CASE WHEN year >= 1999 THEN debt_ratio > 75 ELSE is_debt_warning END AS is_debt_warning FROM judged""")
def _(spark, sf_dir):
    """Quarters judged by default, then the later ones again with other thresholds: the new row wins."""
    facts = data.statement_fact(spark, sf_dir)
    keys = facts.select("stock_code").distinct()
    changed = keys.withColumns({n: F.lit(v) for n, v in CHANGED.items()})
    store = _store(spark)
    store.upsert("warning_indicator", statements.warning_indicators(facts))
    later = facts.filter(F.col("date_info") >= F.lit(dt.date(1999, 1, 1)))
    store.upsert("warning_indicator", statements.warning_indicators(later, changed))
    return store.read("warning_indicator").select(
        "stock_code", "year", "quarter", F.col("debt_ratio").cast("double").alias("debt_ratio"),
        F.col("is_debt_warning").cast("boolean").alias("is_debt_warning"))


@query("insert_missing_thresholds", needs=["statement_fact"],
       sql="""SELECT stock_code, CAST(CASE WHEN bool_or(types = 'Liabilities') THEN 80 ELSE 50 END AS DOUBLE) AS min_earnings_quality_ratio,
                     CAST(120 AS DOUBLE) AS max_receivable_turnover_days, CAST(150 AS DOUBLE) AS max_inventory_turnover_days,
                     CAST(60 AS DOUBLE) AS max_debt_ratio, CAST(3 AS DOUBLE) AS min_interest_coverage
              FROM statement_fact GROUP BY 1""")
def _(spark, sf_dir):
    """Keys with thresholds keep them; the others get a row."""
    facts = data.statement_fact(spark, sf_dir)

    def defaults(rows: DataFrame, quality: float) -> DataFrame:
        limits = statements.C.DEFAULT_THRESHOLDS | {"min_earnings_quality_ratio": quality}
        return rows.select("stock_code").distinct().withColumns({n: F.lit(v) for n, v in limits.items()})

    store = _store(spark)
    store.append_new("warning_threshold", defaults(facts.filter("types = 'Liabilities'"), 80.0))
    store.append_new("warning_threshold", defaults(facts, 50.0))
    return store.read("warning_threshold").select("stock_code", *[F.col(c).cast("double").alias(c) for c in statements.C.DEFAULT_THRESHOLDS])


# --- what is kept up from batch to batch --------------------------------------------------------

EARLIER_DAY, NIGHT = dt.date(2000, 3, 15), dt.date(2001, 12, 31)


def _batches(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Prices as three batches: up to a day without every fifth day of a year, up to another day, and the rest with those days, late."""
    prices = _written(spark, data.daily_price(spark, sf_dir).select("stock_code", "stock_date", "stock_close", "trading_volume"))
    late = (F.year("stock_date") == 1999) & (F.dayofyear("stock_date") % 5 == 0)
    day = F.col("stock_date")
    return [prices.filter((day < F.lit(EARLIER_DAY)) & ~late), prices.filter((day >= F.lit(EARLIER_DAY)) & (day < F.lit(SPLIT_DAY))),
            prices.filter(late | (day >= F.lit(SPLIT_DAY)))]


@query("indicator_states", needs=["daily_price"], ctes=",\n".join([NUMBERED, STOCHASTIC, STRENGTH, HISTOGRAM]),
       sql=f"""SELECT kd.stock_code, kd.stock_date AS last_day, length AS n_rows, CAST(least(length, 60) AS INT) AS n_closes,
                      {sql4('k_value', 'd_value', 'macd_hist')}
               FROM kd JOIN numbered USING (stock_code, stock_date) JOIN histogram USING (stock_code, stock_date) WHERE n = length - 1""")
def _(spark, sf_dir):
    """The stored states after three nights, the last of which brings late days: those of the whole history."""
    store = _store(spark)
    for batch in _batches(spark, sf_dir):
        update.append_daily(store, batch)
    return store.read("indicator_state").withColumns(
        {"k_value": F.col("k_state"), "d_value": F.col("d_state"), "macd_hist": F.col("ema_fast") - F.col("ema_slow") - F.col("ema_signal")}).select(
        "stock_code", "last_day", "n_rows", F.size("closes").alias("n_closes"), *r4s("k_value", "d_value", "macd_hist"))


@query("indicators_by_state", needs=["daily_price"],
       ctes=",\n".join([NUMBERED, AVERAGES, STOCHASTIC, STRENGTH, HISTOGRAM]),
       sql=f"""SELECT stock_code, stock_date, {sql4('ma20', 'ma60', 'k_value', 'd_value', 'rsi14', 'macd_hist')}
               FROM averages JOIN kd USING (stock_code, stock_date) JOIN strength USING (stock_code, stock_date)
               JOIN histogram USING (stock_code, stock_date)""")
def _(spark, sf_dir):
    """All days in three batches, each from the states the one before left."""
    prices = _written(spark, data.daily_price(spark, sf_dir).select("stock_code", "stock_date", "stock_close"))
    states = spark.createDataFrame([], TABLES["indicator_state"].schema)
    night = F.when(F.col("stock_date") < F.lit(EARLIER_DAY), 0).when(F.col("stock_date") < F.lit(SPLIT_DAY), 1).otherwise(2)
    out = None
    for number in range(3):
        done = state.advance(states, prices.filter(night == number))
        done = state.Advanced(_written(spark, done.rows), done.base)  # looked at three times
        path = fresh_path(spark, "states")
        new = state.latest(done.checkpoints())
        new.unionByName(states.join(new, "stock_code", "left_anti")).write.parquet(path)
        states = spark.read.parquet(path)
        out = done.indicators() if out is None else out.unionByName(done.indicators())
    return out.select("stock_code", "stock_date", *r4s(*indicators.INDICATORS))


@query("mark_ledger", needs=["daily_price"],
       sql="SELECT stock_code, max(stock_date) AS latest, count(*) AS n_rows FROM daily_price GROUP BY 1")
def _(spark, sf_dir):
    """Marks and row counts from the ledger, after batches of which one is sent twice."""
    store = _store(spark)
    first, second, rest = _batches(spark, sf_dir)
    for batch in (first, second, second, rest):
        store.append_new("daily_metrics", batch)
    return store.marks("daily_metrics")


@query("latest_rows_kept", needs=["daily_price"],
       sql="""SELECT stock_code, CAST(rn AS INT) AS place, stock_date, stock_close FROM (
                  SELECT *, row_number() OVER (PARTITION BY stock_code ORDER BY stock_date DESC) AS rn FROM daily_price) WHERE rn <= 10""")
def _(spark, sf_dir):
    """The newest rows of each key, kept up from batch to batch, whatever came late."""
    store = _store(spark)
    for batch in reversed(_batches(spark, sf_dir)):
        update.keep_latest(store, batch)
    return store.read("latest_daily").select("stock_code", "place", "stock_date", F.col("stock_close").cast("double").alias("stock_close"))


@query("news_known_keys", needs=["news"],
       sql="SELECT stock_code, news_link FROM news WHERE sentiment_score > 0")
def _(spark, sf_dir):
    """Which keys of all news are stored already, by the sketches and then exactly, where some are."""
    rows, store = data.news(spark, sf_dir), _store(spark)
    store.append_new("news", rows.filter("sentiment_score > 0"))
    return store.known_keys("news", rows)


@query("screener_from_latest_rows", needs=FACTOR_NEEDS, ctes=FACTORS, sql=f"SELECT stock_code, stock_close, net_buy_5d FROM ({FACTOR_ROW})")
def _(spark, sf_dir):
    """The screener's figures from the newest rows that are kept at hand, without the whole history."""
    store = _store(spark)
    update.keep_latest(store, with_indicators(spark, sf_dir, assembled(spark, sf_dir), ["ma20", "ma60"]))
    latest = store.read("latest_daily").drop("place")
    latest = latest.withColumns({c: F.col(c).cast("double") for c, kind in latest.dtypes if kind.startswith("decimal")})
    return screener.screener(latest, data.statement_fact(spark, sf_dir), data.company(spark, sf_dir)).select("stock_code", *r4s("stock_close", "net_buy_5d"))


@query("changed_rows", needs=["statement_fact"], ctes=f"{PIVOT},\n{LIMITS}",
       sql="SELECT stock_code, max_debt_ratio + 2 * (1 + CAST(stock_code AS INT) % 3) AS max_debt_ratio FROM limits")
def _(spark, sf_dir):
    """Limits changed key by key over many small changes, read through base and changes and compacted on the way."""
    facts = data.statement_fact(spark, sf_dir)
    store = _store(spark)
    store.append_new("warning_threshold", statements.default_thresholds(facts.select("stock_code").distinct(), facts))
    for round_ in range(3):
        rows = store.read("warning_threshold").filter(F.col("stock_code").cast("int") % 3 >= round_)
        store.upsert("warning_threshold", rows.withColumn("max_debt_ratio", F.col("max_debt_ratio").cast("double") + 2))
        store.compact("warning_threshold", most=1)
    return store.read("warning_threshold").select("stock_code", F.col("max_debt_ratio").cast("double").alias("max_debt_ratio"))


@query("indicator_stream", needs=["daily_price"],
       ctes=",\n".join([NUMBERED, AVERAGES, STOCHASTIC, STRENGTH, HISTOGRAM]),
       sql=f"""SELECT stock_code, stock_date, {sql4('ma20', 'ma60', 'k_value', 'd_value', 'rsi14', 'macd_hist')}
               FROM averages JOIN kd USING (stock_code, stock_date) JOIN strength USING (stock_code, stock_date)
               JOIN histogram USING (stock_code, stock_date)""")
def _(spark, sf_dir):
    """Prices landed in two parts and streamed with state by key; the second run goes on from the checkpoint."""
    for name, value in stateful.STATE_STORE.items():
        spark.conf.set(name, value)
    prices = data.daily_price(spark, sf_dir).select("stock_code", "stock_date", "stock_close")
    landing, out, checkpoint = (fresh_path(spark, x) for x in ("landing", "indicators", "checkpoint"))
    for part in (prices.filter(F.col("stock_date") < F.lit(SPLIT_DAY)), prices.filter(F.col("stock_date") >= F.lit(SPLIT_DAY))):
        part.write.mode("append").parquet(landing)
        rows = stateful.indicator_stream(spark.readStream.schema(prices.schema).parquet(landing))
        rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out, format="parquet").awaitTermination()
    return spark.read.parquet(out).select("stock_code", "stock_date", *r4s(*indicators.INDICATORS))


def _landed_news(spark: SparkSession, sf_dir: str, times: int = 1) -> DataFrame:
    rows, landing = data.news(spark, sf_dir), fresh_path(spark, "landing")
    for _ in range(times):
        rows.write.mode("append").parquet(landing)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1000).parquet(landing)


@query("news_once_stream", needs=["news"], sql="SELECT stock_code, news_link, title, sentiment_score FROM news")
def _(spark, sf_dir):
    """News landed twice, each key and link once within the watermark."""
    out = fresh_path(spark, "news")
    rows = stateful.news_once(_landed_news(spark, sf_dir, times=2), "36500 days")
    rows.writeStream.option("checkpointLocation", fresh_path(spark, "checkpoint")).trigger(availableNow=True).start(out, format="parquet").awaitTermination()
    return spark.read.parquet(out).select("stock_code", "news_link", "title", "sentiment_score")


@query("daily_means_stream", needs=["news"], ctes=DAY_SCORES,
       sql=f"SELECT stock_code, stock_date, {sql4('avg_sentiment')} FROM day_scores WHERE stock_date < (SELECT max(CAST(publish_time AS DATE)) FROM news)")
def _(spark, sf_dir):
    """Mean scores of all days the watermark has passed: all but the last one."""
    out = fresh_path(spark, "means")
    rows = stateful.daily_means(_landed_news(spark, sf_dir), "0 seconds")
    rows.writeStream.option("checkpointLocation", fresh_path(spark, "checkpoint")).trigger(availableNow=True).start(out, format="parquet").awaitTermination()
    return spark.read.parquet(out).select("stock_code", "stock_date", r4("avg_sentiment"))


def _land_once(rows: DataFrame, root: str, dataset: str) -> None:
    """Rows as responses of a landing folder: JSON lines, compressed."""
    responses = rows.select(F.array(F.struct(*rows.columns)).alias("data")).write.mode("append")
    with shuffles_removed(rows.sparkSession):
        responses.json(f"{root}/{dataset}", compression="gzip")


def _land_prices(rows: DataFrame, root: str) -> None:
    _land_once(rows.select(F.col("stock_date").cast("string").alias("date"), F.col("stock_code").alias("stock_id"), F.col("stock_close").alias("close"),
                      F.col("trading_volume").alias("Trading_Volume"), F.col("trading_money").alias("Trading_money")), root, "price")


@query("nightly_update", needs=["daily_price", "flow", "margin", "income_fact", "balance_fact"],
       ctes=",\n".join([ASSEMBLED, f"loaded AS (SELECT * FROM daily_price WHERE stock_date >= make_date(2001 - {C.DAILY_DEFAULT_YEARS}, 1, 1))",
                        NUMBERED.replace("FROM daily_price", "FROM loaded"), STOCHASTIC]),
       sql=f"""SELECT stock_code, stock_date, {sql4('stock_close', 'margin_balance')}, floor(k_value * 100 + 0.5) / 100 AS k_value, n_facts
               FROM assembled JOIN kd USING (stock_code, stock_date)
               LEFT JOIN (SELECT stock_code, count(*) AS n_facts FROM (SELECT stock_code, date_info FROM income_fact UNION ALL SELECT stock_code, date_info FROM (
                          SELECT DISTINCT stock_code, date_info, types FROM balance_fact))
                          WHERE date_info BETWEEN make_date(2001 - {C.STATEMENT_DEFAULT_YEARS}, 1, 1) AND DATE '2001-12-31' GROUP BY 1) USING (stock_code)""")
def _(spark, sf_dir):
    """Two nights of the whole update over landed files: all tables are loaded, and the second night goes on from the first."""
    root, store = fresh_path(spark, "landing"), _store(spark)
    zone = update.LandingZone(spark, root, rejects=store)
    prices = data.daily_price(spark, sf_dir)
    keys = prices.select("stock_code").distinct()
    _land_once(data.flow(spark, sf_dir).select(F.col("stock_date").cast("string").alias("date"), F.col("stock_code").alias("stock_id"), "buy", "name", "sell"), root, "investor")
    _land_once(data.margin(spark, sf_dir).select(F.col("stock_date").cast("string").alias("date"), F.col("stock_code").alias("stock_id"),
                                            F.col("margin_balance").alias("MarginPurchaseTodayBalance"), F.col("short_balance").alias("ShortSaleTodayBalance")), root, "margin")
    for name in ("income", "balance"):
        facts = getattr(data, f"{name}_fact")(spark, sf_dir)
        _land_once(facts.select(F.col("date_info").cast("string").alias("date"), F.col("stock_code").alias("stock_id"), F.col("types").alias("type"),
                           F.col("data_value").alias("value"), "origin_name"), root, name)
    for day, part in ((SPLIT_DAY - dt.timedelta(1), F.col("stock_date") < F.lit(SPLIT_DAY)), (NIGHT, F.col("stock_date") >= F.lit(SPLIT_DAY))):
        _land_prices(prices.filter(part), root)
        update.update_all(store, zone, keys, day)
    facts = store.read("statement_fact").groupBy("stock_code").agg(F.count("*").alias("n_facts"))
    daily = store.read("daily_metrics").withColumns({c: F.col(c).cast("double") for c in ("stock_close", "margin_balance", "k_value")})
    return daily.join(facts, "stock_code", "left").select("stock_code", "stock_date", *r4s("stock_close", "margin_balance"),
                                                          numbers.rounded(F.col("k_value"), 2).alias("k_value"), "n_facts")


@query("landed_rejects", needs=["daily_price"],
       sql="""SELECT CASE WHEN stock_date IS NULL THEN 'no day' ELSE 'no key' END AS reason, count(*) AS n_rows FROM (
                  SELECT CASE WHEN trading_volume % 7 = 0 THEN NULL ELSE stock_date END AS stock_date, trading_volume % 5 = 0 AS nameless FROM daily_price)
              WHERE stock_date IS NULL OR nameless GROUP BY 1""")
def _(spark, sf_dir):
    """Prices landed with keys and days missing: each bad row is kept with its file and reason (the key is asked for first)."""
    prices, root, store = data.daily_price(spark, sf_dir), fresh_path(spark, "landing"), _store(spark)
    volume = F.col("trading_volume")
    rows = prices.select(F.when(volume % 7 != 0, F.col("stock_date").cast("string")).alias("date"),
                         F.when((volume % 5 != 0) | (volume % 7 == 0), F.col("stock_code")).alias("stock_id"),
                         F.col("stock_code").alias("Trading_money"), F.col("stock_date").cast("string").alias("note"))
    rows.select(F.array(F.struct("date", "stock_id", F.xxhash64("Trading_money", "note").cast("double").alias("Trading_money"))).alias("data")).write.json(f"{root}/price")
    checked.read_checked(spark, f"{root}/price", "price", store)
    return store.read("landed_reject").groupBy("reason").agg(F.count("*").alias("n_rows"))


@query("landed_all_fields", needs=["daily_price"],
       sql="""SELECT strftime(stock_date, '%Y-%m-%d') AS date, stock_code AS stock_id, stock_close AS MarginPurchaseTodayBalance,
                     CAST(0 AS DOUBLE) AS ShortSaleTodayBalance, CASE WHEN year(stock_date) >= 1999 THEN CAST(trading_volume AS BIGINT) END AS Lots FROM daily_price""")
def _(spark, sf_dir):
    """Files of two layouts, the later ones with a field nobody listed: it is read, absent fields take their defaults."""
    prices, root = data.daily_price(spark, sf_dir), fresh_path(spark, "landing")
    columns = [F.col("stock_date").cast("string").alias("date"), F.col("stock_code").alias("stock_id"), F.col("stock_close").alias("MarginPurchaseTodayBalance")]
    later = F.year("stock_date") >= 1999
    _land_once(prices.filter(~later).select(*columns), root, "margin")
    _land_once(prices.filter(later).select(*columns, F.col("trading_volume").cast("long").alias("Lots")), root, "margin")
    return checked.read_all_fields(spark, f"{root}/margin", "margin")


# --- context rows -------------------------------------------------------------------------------

@query("analyst_context", needs=DAILY_NEEDS + ["headline", "holding", "statement_fact", "company"],
       ctes=",\n".join([ASSEMBLED, NUMBERED, AVERAGES, STOCHASTIC, RATIOS, f"judged AS ({DEFAULTS})",
                        f"weekly AS ({CONCENTRATION.format(source='holding')})"]) + """,
docs AS (SELECT CAST(doc_id % 50 AS VARCHAR) AS stock_code, title,
                make_timestamp((1704067200 + doc_id * 3600) * 1000000) AS publish_time, link AS news_link FROM headline),
""" + SHOWN.replace("FROM news)", "FROM docs)") + """,
metrics AS (SELECT *, row_number() OVER (PARTITION BY stock_code ORDER BY stock_date DESC) AS age
            FROM assembled JOIN averages USING (stock_code, stock_date) JOIN kd USING (stock_code, stock_date)
            WHERE stock_date BETWEEN DATE '2000-01-01' AND DATE '2001-12-31'),
last_week AS (SELECT *, row_number() OVER (PARTITION BY stock_code ORDER BY update_date DESC) AS age FROM weekly),
last_quarter AS (SELECT *, row_number() OVER (PARTITION BY stock_code ORDER BY year DESC, quarter DESC) AS age FROM judged),
lines AS (SELECT stock_code, string_agg('[' || strftime(publish_time, '%Y-%m-%d %H:%M') || '] ' || title || ' (0.00)', chr(10) ORDER BY position) AS news_text
          FROM shown WHERE position <= 5 GROUP BY 1)""",
       sql="""SELECT c.stock_code, c.company_name, m.stock_date, m.stock_close, floor(f.ma5 * 10000 + 0.5) / 10000 AS ma5,
                     floor(m.ma20 * 10000 + 0.5) / 10000 AS ma20, floor(m.k_value * 10000 + 0.5) / 10000 AS k_value,
                     floor(m.d_value * 10000 + 0.5) / 10000 AS d_value, m.foreign_net_buy, m.trust_net_buy, w.update_date,
                     w.large_holders_1000, w.large_holders_400, w.retail_holders_10, c.company_class, c.main_business,
                     coalesce(concat_ws(', ', CASE WHEN q.is_cash_flow_warning THEN '本期盈餘品質不佳（現金流短缺）' END,
                                        CASE WHEN q.is_debt_warning THEN '負債比率偏高，超出設定閥值' END,
                                        CASE WHEN q.is_receivable_warning THEN '應收帳款天數過長' END,
                                        CASE WHEN q.is_inventory_warning THEN '存貨天數過長，有滯銷可能' END), '') AS warnings_text,
                     coalesce(n.news_text, '') AS news_text
              FROM company c LEFT JOIN metrics m ON c.stock_code = m.stock_code AND m.age = 1
              LEFT JOIN (SELECT stock_code, avg(stock_close) AS ma5 FROM metrics WHERE age <= 5 GROUP BY 1) f ON c.stock_code = f.stock_code
              LEFT JOIN last_week w ON c.stock_code = w.stock_code AND w.age = 1
              LEFT JOIN last_quarter q ON c.stock_code = q.stock_code AND q.age = 1
              LEFT JOIN lines n ON c.stock_code = n.stock_code""")
def _(spark, sf_dir):
    doc = F.col("doc_id")
    docs = data.headline(spark, sf_dir).select(
        (doc % 50).cast("string").alias("stock_code"), "title", F.timestamp_seconds(F.lit(1704067200) + doc * 3600).alias("publish_time"),
        F.col("link").alias("news_link"), F.lit(0.0).alias("sentiment_score"))
    daily = with_indicators(spark, sf_dir, assembled(spark, sf_dir), ["ma20", "k_value", "d_value"])
    context = reports.analyst_context(
        data.company(spark, sf_dir), daily, ownership.weekly_concentration(data.holding(spark, sf_dir)),
        statements.warning_indicators(data.statement_fact(spark, sf_dir)), docs, TODAY)
    return context.select("stock_code", "company_name", "stock_date", "stock_close", *r4s("ma5", "ma20", "k_value", "d_value"),
                          "foreign_net_buy", "trust_net_buy", "update_date", "large_holders_1000", "large_holders_400",
                          "retail_holders_10", "company_class", "main_business", "warnings_text", "news_text")


@query("news_context", needs=["news", "news_price"], ctes=f"""{SHOWN},\n{DAY_SCORES},
lines AS (SELECT stock_code, string_agg('[' || strftime(publish_time, '%Y-%m-%d %H:%M') || '] ' || title || ' (' || printf('%.2f', sentiment_score) || ')',
                 chr(10) ORDER BY position) AS news_text FROM shown GROUP BY 1),
trend AS (SELECT *, row_number() OVER (PARTITION BY stock_code ORDER BY stock_date DESC) AS age
          FROM news_price LEFT JOIN day_scores USING (stock_code, stock_date)),
trends AS (SELECT stock_code, string_agg(strftime(stock_date, '%Y-%m-%d') || ' close ' || printf('%.2f', floor(stock_close * 100 + 0.5) / 100) || ' sentiment '
                  || printf('%.2f', floor(coalesce(avg_sentiment, 0) * 100 + 0.5) / 100), chr(10) ORDER BY stock_date) AS trend_text
           FROM trend WHERE age <= 15 GROUP BY 1)""",
       sql="SELECT stock_code, news_text, trend_text FROM lines LEFT JOIN trends USING (stock_code)")
def _(spark, sf_dir):
    companies = data.table(spark, sf_dir, "nation").select(
        F.concat(F.lit("src"), F.col("n_nationkey").cast("string")).alias("stock_code"), F.col("n_name").alias("company_name"))
    return reports.news_context(companies, data.news_price(spark, sf_dir), data.news(spark, sf_dir)).drop("company_name")


# --- the nightly update over landed files -------------------------------------------------------

LOAD_DAY, LOAD_MIDDLE = dt.date(1998, 12, 31), dt.date(1998, 6, 30)
LOAD_YEAR = "BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'"


def _land(rows: DataFrame, root: str, name: str) -> None:
    """Rows as responses of a landing folder, twice over, as overlapping requests leave them."""
    _land_once(rows, root, name)
    landed_ = rows.sparkSession.read.text(f"{root}/{name}")  # of the files there are now
    landed_.write.mode("append").text(f"{root}/{name}", compression="gzip")


def _zone(spark: SparkSession) -> update.LandingZone:
    return update.LandingZone(spark, fresh_path(spark, "landing"))


@query("daily_load", needs=DAILY_NEEDS, ctes=ASSEMBLED, sql=f"SELECT * FROM assembled WHERE stock_date {LOAD_YEAR}")
def _(spark, sf_dir):
    """Prices, flows and margins landed twice, then loaded in two runs from the first day of the year before on."""
    zone, store = _zone(spark), _store(spark)
    day, code = F.col("stock_date").cast("string").alias("date"), F.col("stock_code").alias("stock_id")
    prices = data.daily_price(spark, sf_dir)
    _land(prices.select(day, code, F.col("stock_close").alias("close"), F.col("trading_volume").alias("Trading_Volume"),
                        F.col("trading_money").alias("Trading_money")), zone.root, "price")
    named = data.flow(spark, sf_dir).groupBy("stock_code", "stock_date", "name").agg(F.sum("buy").alias("buy"), F.sum("sell").alias("sell"))
    _land(named.select(day, code, "name", "buy", "sell"), zone.root, "investor")
    _land(data.margin(spark, sf_dir).select(day, code, F.col("margin_balance").alias("MarginPurchaseTodayBalance"),
                                            F.col("short_balance").alias("ShortSaleTodayBalance")), zone.root, "margin")
    for today in (LOAD_MIDDLE, LOAD_DAY):
        update.update_daily(store, zone, prices.select("stock_code").distinct(), today)
    stored = store.read("daily_metrics").drop(*indicators.INDICATORS)
    return stored.select("stock_code", "stock_date", *[F.col(c).cast("double").alias(c) for c in stored.columns[2:]])


@query("weekly_load", needs=["holding"], ctes=f"weekly AS ({CONCENTRATION.format(source='holding')})",
       sql=f"SELECT * FROM weekly WHERE update_date {LOAD_YEAR}")
def _(spark, sf_dir):
    """Ownership levels landed twice and loaded once."""
    zone, store = _zone(spark), _store(spark)
    levels = _levels(spark, sf_dir)
    _land(levels.withColumnRenamed("stock_code", "stock_id"), zone.root, "holding")
    update.update_weekly(store, zone, levels.select("stock_code").distinct(), LOAD_DAY)
    stored = store.read("weekly_concentration")
    return stored.select("stock_code", "update_date", *[F.col(c).cast("double").alias(c) for c in stored.columns[2:5]], "total_shareholders")


@query("news_load", needs=["feed"], ctes=CLEANED,
       sql="""SELECT stock_code, title, strftime(published, '%Y-%m-%d %H:%M') AS publish_minute, link AS news_link FROM accepted
              WHERE contains(title, 'tion') AND CAST(published AS DATE) BETWEEN DATE '2023-12-25' AND DATE '2024-03-24'""")
def _(spark, sf_dir):
    """Searches landed twice and loaded twice: each company's titles with its keyword, of the last 90 days."""
    zone, store = _zone(spark), _store(spark)
    entries = data.feed(spark, sf_dir).withColumn("source", F.struct(F.col("source_name").alias("title"))).drop("source_name")
    for _ in range(2):
        entries.select("stock_code", F.array(F.struct("title", "published", "link", "source")).alias("entries")).write.mode("append").json(f"{zone.root}/news")
    store.append_new("company", entries.select("stock_code").distinct().withColumn("company_name_abbr", F.lit("tion")))
    for _ in range(2):
        update.update_news(store, zone, dt.date(2024, 3, 24))
    return store.read("news").select("stock_code", "title", dates.minute_text(F.col("publish_time")).alias("publish_minute"), "news_link")


@query("stored_threshold_change", needs=["statement_fact"], ctes=CHANGED_LIMITS,
       sql="""SELECT stock_code, min_earnings_quality_ratio, max_receivable_turnover_days, max_inventory_turnover_days,
                     max_debt_ratio, min_interest_coverage, hit AS stamped FROM changed""")
def _(spark, sf_dir):
    """Limits fitted to the statements, stored, changed in the store and read back."""
    limits, store = _limits(spark, data.statement_fact(spark, sf_dir)), _store(spark)
    store.upsert("warning_threshold", limits)
    store.update_thresholds(_changes(limits))
    stored = store.read("warning_threshold")
    return stored.select("stock_code", *[F.col(c).cast("double").alias(c) for c in stored.columns[1:6]], F.col("last_updated").isNotNull().alias("stamped"))


@query("stored_sql", needs=["daily_price"],
       sql="""SELECT stock_code, stock_date, stock_close FROM daily_price WHERE stock_date BETWEEN DATE '1996-01-01' AND DATE '1997-06-30'""")
def _(spark, sf_dir):
    """A query with bound parameters over the stored table."""
    store = _store(spark)
    store.append_new("daily_metrics", data.daily_price(spark, sf_dir).select("stock_code", "stock_date", "stock_close"))
    return store.sql("SELECT stock_code, stock_date, CAST(stock_close AS DOUBLE) AS stock_close FROM daily_metrics WHERE stock_date BETWEEN :first AND :last",
                     first=dt.date(1996, 1, 1), last=dt.date(1997, 6, 30))

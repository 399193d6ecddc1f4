"""The library's inputs derived from the driver's shared tables.

The shared tables are a star schema and a set of texts; each function below turns
them into one of the inputs the library works on, over all their rows. The SQL
texts in ``CARRIER_SQL`` say the same for DuckDB. Amounts are summed as whole
cents, so sums do not depend on the order of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

POSITIVE = ["ing", "tion", "eau"]
NEGATIVE = ["ment", "the", "und"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(amount: Column) -> Column:
    return F.floor(amount * 100 + 0.5)


def quarter_day(day: Column, early: Column) -> Column:
    """Statement day of a date: the end of its quarter, or of the quarter's first month."""
    start = F.date_trunc("quarter", day).cast("date")
    return F.when(early, F.last_day(start)).otherwise(F.last_day(F.add_months(start, 2)))


def daily_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_suppkey").cast("string").alias("stock_code"), F.to_date("l_shipdate").alias("stock_date")).agg(
        F.sum("l_quantity").alias("trading_volume"), F.sum(cents(F.col("l_extendedprice"))).alias("c"))
    return rows.select("stock_code", "stock_date", (F.floor(F.col("c") / F.col("trading_volume")) / 100)
                       .alias("stock_close"), "trading_volume", (F.col("c") / 100).alias("trading_money"))


def flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.concat("l_returnflag", "l_linestatus")
    name = (F.when(kind == "AF", "Foreign_Investor").when(kind == "AO", "Investment_Trust")
            .when(kind == "NF", "Dealer_self").when(kind == "NO", "Foreign_Dealer_Self").when(kind == "RO", "Other"))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("stock_code"), F.to_date("l_shipdate").alias("stock_date"),
        name.alias("name"), F.col("l_quantity").alias("buy"), (F.col("l_linenumber") * 5.0).alias("sell"))


def margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").groupBy(
        (F.col("o_custkey") % 100).cast("string").alias("stock_code"), F.to_date("o_orderdate").alias("stock_date")).agg(
        F.sum(cents(F.col("o_totalprice"))).alias("c"), F.count(F.lit(1)).alias("n"))
    return rows.select("stock_code", "stock_date", (F.col("c") / 100).alias("margin_balance"),
                       F.col("n").cast("double").alias("short_balance"))


def holding(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.col("l_quantity").cast("bigint") % 17 + 1
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("stock_code"),
        F.date_format(F.date_trunc("week", "l_shipdate"), "yyyy-MM-dd").alias("date"),
        F.when(F.col("l_linenumber") == 7, "total").otherwise(level.cast("string")).alias("HoldingSharesLevel"),
        F.col("l_linenumber").cast("bigint").alias("people"),
        F.floor(F.col("l_discount") * 100 + 0.5).cast("double").alias("percent"))


def balance_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, kind = F.col("o_custkey") % 50, F.col("o_orderpriority")
    day = quarter_day(F.col("o_orderdate"), F.col("o_orderkey") % 10 == 0)
    types = (F.when(kind == "1-URGENT", "TotalAssets")
             .when((kind == "2-HIGH") & (key % 2 == 0), "Liabilities").when(kind == "2-HIGH", "LiabilityTotal")
             .when(kind == "3-MEDIUM", "AccountsReceivable").when(kind == "4-NOT SPECIFIED", "Inventories")
             .otherwise("Liabilities_per"))
    origin = F.when(kind.isin("2-HIGH", "5-LOW"), "負債總額").otherwise("-")
    rows = table(spark, sf_dir, "orders").groupBy(
        key.cast("string").alias("stock_code"), day.alias("date_info"), types.alias("types"),
        origin.alias("origin_name")).agg(F.sum(cents(F.col("o_totalprice"))).alias("c"))
    return rows.select(F.lit("balance").alias("statement"), "stock_code", "date_info", "types",
                       (F.col("c") / 100).alias("data_value"), "origin_name")


def income_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, discount = F.col("l_extendedprice"), F.col("l_discount")
    day = quarter_day(F.col("l_shipdate"), F.col("l_orderkey") % 10 == 0)
    sums = {"Revenue": price, "OperatingCosts": price * (1 - discount),
            "OperatingIncome": price * (discount - 0.02), "IncomeAfterTaxes": price * (discount - 0.04)}
    rows = table(spark, sf_dir, "lineitem").groupBy(
        (F.col("l_suppkey") % 50).cast("string").alias("stock_code"), day.alias("date_info")).agg(
        *[F.sum(cents(value)).alias(name) for name, value in sums.items()])
    facts = F.explode(F.array(*[
        F.struct(F.lit(n).alias("types"), (F.col(n) / 100).alias("data_value")) for n in sums]))
    return rows.select("stock_code", "date_info", facts.alias("f")).select(
        F.lit("income").alias("statement"), "stock_code", "date_info", "f.types", "f.data_value",
        F.lit("-").alias("origin_name"))


def cashflow_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("o_orderstatus")
    day = quarter_day(F.col("o_orderdate"), F.col("o_orderkey") % 10 == 0)
    types = F.when(status == "F", "NetCashInflowFromOperatingActivities").when(status == "O", "PayTheInterest").otherwise("Other")
    sign = F.when((status == "F") & (F.col("o_orderkey") % 4 == 0), -1).otherwise(1)
    rows = table(spark, sf_dir, "orders").groupBy(
        (F.col("o_custkey") % 50).cast("string").alias("stock_code"), day.alias("date_info"), types.alias("types")).agg(
        F.sum(cents(F.col("o_totalprice")) * sign).alias("c"))
    return rows.select(F.lit("cashflow").alias("statement"), "stock_code", "date_info", "types",
                       (F.col("c") / 100).alias("data_value"), F.lit("-").alias("origin_name"))


def statement_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (balance_fact(spark, sf_dir).unionByName(income_fact(spark, sf_dir))
            .unionByName(cashflow_fact(spark, sf_dir)))


def headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document as a headline: source, doc_id, link (document and line), title."""
    lines = table(spark, sf_dir, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("line", "title"))
    return lines.select("source", "doc_id", F.concat_ws("-", "doc_id", "line").alias("link"), "title")


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headlines as feed entries, with their publisher behind."""
    doc = F.col("doc_id")
    publisher = F.when(doc % 3 == 0, "CMoney").when(doc % 3 == 1, "Yahoo股市").otherwise("Other News")
    time = F.timestamp_seconds(F.lit(1704067200) + doc * 3600)
    return headline(spark, sf_dir).select(
        F.col("source").alias("stock_code"), F.concat("title", F.lit(" - "), publisher).alias("title"),
        F.concat(F.lit("Mon, "), F.date_format(time, "dd MMM yyyy HH:mm:ss"), F.lit(" GMT")).alias("published"),
        "link", F.when(doc % 2 == 0, F.lit("")).otherwise(publisher).alias("source_name"))


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headlines as stored news rows, scored with a lexicon that occurs in them."""
    from stockloom.functions.text import lexicon_score
    return headline(spark, sf_dir).select(
        F.col("source").alias("stock_code"), "title",
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 3600).alias("publish_time"),
        F.col("link").alias("news_link"), lexicon_score(F.col("title"), POSITIVE, NEGATIVE).alias("sentiment_score"))


def news_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily prices of the news keys: events by user group and day."""
    rows = table(spark, sf_dir, "events").groupBy(
        F.concat(F.lit("src"), F.col("user_id") % 25).alias("stock_code"), F.to_date("ts").alias("stock_date")).agg(
        F.sum(cents(F.col("value"))).alias("c"))
    return rows.select("stock_code", "stock_date", (F.col("c") / 100).alias("stock_close"))


def company(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    rows = table(spark, sf_dir, "supplier").join(
        nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.select(F.col("s_suppkey").cast("string").alias("stock_code"), F.col("s_name").alias("company_name"),
                       F.when(F.col("s_suppkey") % 3 == 0, F.lit("")).when(F.col("s_suppkey") % 3 == 1, F.col("n_name"))
                       .alias("company_name_abbr"), F.col("n_name").alias("company_class"),
                       F.lit("-").alias("main_business"))


CARRIER_SQL = {
    "daily_price": """
        SELECT stock_code, stock_date, floor(c / trading_volume) / 100 AS stock_close, trading_volume,
               c / 100 AS trading_money
        FROM (SELECT CAST(l_suppkey AS VARCHAR) AS stock_code, CAST(l_shipdate AS DATE) AS stock_date,
                     SUM(l_quantity) AS trading_volume,
                     CAST(SUM(CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)) AS BIGINT) AS c
              FROM lineitem GROUP BY 1, 2)""",
    "flow": """
        SELECT CAST(l_suppkey AS VARCHAR) AS stock_code, CAST(l_shipdate AS DATE) AS stock_date,
               CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'Foreign_Investor' WHEN 'AO' THEN 'Investment_Trust'
                    WHEN 'NF' THEN 'Dealer_self' WHEN 'NO' THEN 'Foreign_Dealer_Self' WHEN 'RO' THEN 'Other' END AS name,
               l_quantity AS buy, l_linenumber * CAST(5 AS DOUBLE) AS sell
        FROM lineitem""",
    "margin": """
        SELECT CAST(o_custkey % 100 AS VARCHAR) AS stock_code, CAST(o_orderdate AS DATE) AS stock_date,
               CAST(SUM(CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT)) AS BIGINT) / 100 AS margin_balance,
               CAST(COUNT(*) AS DOUBLE) AS short_balance
        FROM orders GROUP BY 1, 2""",
    "holding": """
        SELECT CAST(l_suppkey AS VARCHAR) AS stock_code, CAST(date_trunc('week', l_shipdate) AS DATE) AS date,
               CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_quantity AS BIGINT) % 17 + 1 END AS level,
               l_linenumber AS people, floor(l_discount * 100 + 0.5) AS percent
        FROM lineitem""",
    "balance_fact": """
        SELECT 'balance' AS statement, stock_code, date_info, types,
               CAST(SUM(c) AS BIGINT) / 100 AS data_value, origin_name
        FROM (SELECT CAST(o_custkey % 50 AS VARCHAR) AS stock_code,
                     CASE WHEN o_orderkey % 10 = 0 THEN last_day(CAST(date_trunc('quarter', o_orderdate) AS DATE))
                          ELSE last_day(CAST(date_trunc('quarter', o_orderdate) AS DATE) + INTERVAL 2 MONTH) END AS date_info,
                     CASE WHEN o_orderpriority = '1-URGENT' THEN 'TotalAssets'
                          WHEN o_orderpriority = '2-HIGH' AND (o_custkey % 50) % 2 = 0 THEN 'Liabilities'
                          WHEN o_orderpriority = '2-HIGH' THEN 'LiabilityTotal'
                          WHEN o_orderpriority = '3-MEDIUM' THEN 'AccountsReceivable'
                          WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'Inventories' ELSE 'Liabilities_per' END AS types,
                     CASE WHEN o_orderpriority IN ('2-HIGH', '5-LOW') THEN '負債總額' ELSE '-' END AS origin_name,
                     CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS c
              FROM orders) GROUP BY 2, 3, 4, 6""",
    "income_base": """
        SELECT CAST(l_suppkey % 50 AS VARCHAR) AS stock_code,
               CASE WHEN l_orderkey % 10 = 0 THEN last_day(CAST(date_trunc('quarter', l_shipdate) AS DATE))
                    ELSE last_day(CAST(date_trunc('quarter', l_shipdate) AS DATE) + INTERVAL 2 MONTH) END AS date_info,
               CAST(SUM(CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)) AS BIGINT) / 100 AS revenue,
               CAST(SUM(CAST(floor(l_extendedprice * (1 - l_discount) * 100 + 0.5) AS BIGINT)) AS BIGINT) / 100 AS cost,
               CAST(SUM(CAST(floor(l_extendedprice * (l_discount - CAST(0.02 AS DOUBLE)) * 100 + 0.5) AS BIGINT)) AS BIGINT) / 100 AS op_inc,
               CAST(SUM(CAST(floor(l_extendedprice * (l_discount - CAST(0.04 AS DOUBLE)) * 100 + 0.5) AS BIGINT)) AS BIGINT) / 100 AS ni
        FROM lineitem GROUP BY 1, 2""",
    "income_fact": """
        SELECT 'income' AS statement, stock_code, date_info, 'Revenue' AS types, revenue AS data_value, '-' AS origin_name FROM income_base
        UNION ALL SELECT 'income', stock_code, date_info, 'OperatingCosts', cost, '-' FROM income_base
        UNION ALL SELECT 'income', stock_code, date_info, 'OperatingIncome', op_inc, '-' FROM income_base
        UNION ALL SELECT 'income', stock_code, date_info, 'IncomeAfterTaxes', ni, '-' FROM income_base""",
    "cashflow_fact": """
        SELECT 'cashflow' AS statement, stock_code, date_info, types, CAST(SUM(c) AS BIGINT) / 100 AS data_value, '-' AS origin_name
        FROM (SELECT CAST(o_custkey % 50 AS VARCHAR) AS stock_code,
                     CASE WHEN o_orderkey % 10 = 0 THEN last_day(CAST(date_trunc('quarter', o_orderdate) AS DATE))
                          ELSE last_day(CAST(date_trunc('quarter', o_orderdate) AS DATE) + INTERVAL 2 MONTH) END AS date_info,
                     CASE o_orderstatus WHEN 'F' THEN 'NetCashInflowFromOperatingActivities' WHEN 'O' THEN 'PayTheInterest'
                          ELSE 'Other' END AS types,
                     CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT)
                         * CASE WHEN o_orderstatus = 'F' AND o_orderkey % 4 = 0 THEN -1 ELSE 1 END AS c
              FROM orders) GROUP BY 2, 3, 4""",
    "statement_fact": """
        SELECT * FROM balance_fact UNION ALL SELECT * FROM income_fact UNION ALL SELECT * FROM cashflow_fact""",
    "headline": """
        SELECT source, doc_id, CAST(doc_id AS VARCHAR) || '-' || CAST(line AS VARCHAR) AS link, title
        FROM (SELECT source, doc_id, unnest(range(len(lines))) AS line, unnest(lines) AS title
              FROM (SELECT source, doc_id, string_split(text, chr(10)) AS lines FROM documents))""",
    "feed": """
        SELECT source AS stock_code, title || ' - ' || publisher AS title,
               make_timestamp((1704067200 + doc_id * 3600) * 1000000) AS published, link,
               CASE WHEN doc_id % 2 = 0 THEN '' ELSE publisher END AS source_name
        FROM (SELECT *, CASE doc_id % 3 WHEN 0 THEN 'CMoney' WHEN 1 THEN 'Yahoo股市' ELSE 'Other News' END AS publisher
              FROM headline)""",
    "news_counts": """
        SELECT source AS stock_code, title, make_timestamp((1704067200 + doc_id * 3600) * 1000000) AS publish_time, link AS news_link,
               CAST(contains(title, 'ing') AS INT) + CAST(contains(title, 'tion') AS INT) + CAST(contains(title, 'eau') AS INT) AS good,
               CAST(contains(title, 'ment') AS INT) + CAST(contains(title, 'the') AS INT) + CAST(contains(title, 'und') AS INT) AS bad
        FROM headline""",
    "news": """
        SELECT stock_code, title, publish_time, news_link,
               CASE WHEN good + bad = 0 THEN CAST(0 AS DOUBLE)
                    ELSE floor((good - bad) / (good + bad) * CAST(0.8 AS DOUBLE) * 100 + 0.5) / 100 END AS sentiment_score
        FROM news_counts""",
    "news_price": """
        SELECT 'src' || CAST(user_id % 25 AS VARCHAR) AS stock_code, CAST(ts AS DATE) AS stock_date,
               CAST(SUM(CAST(floor(value * 100 + 0.5) AS BIGINT)) AS BIGINT) / 100 AS stock_close
        FROM events GROUP BY 1, 2""",
    "company": """
        SELECT CAST(s_suppkey AS VARCHAR) AS stock_code, s_name AS company_name,
               CASE s_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN n_name END AS company_name_abbr,
               n_name AS company_class, '-' AS main_business
        FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
}

#: Carriers each carrier is written in terms of.
CARRIER_NEEDS = {
    "income_fact": ["income_base"],
    "statement_fact": ["balance_fact", "income_fact", "cashflow_fact"],
    "feed": ["headline"],
    "news_counts": ["headline"],
    "news": ["news_counts"],
}

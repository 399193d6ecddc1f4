import datetime as dt

from pyspark.sql import functions as F

from stockloom.operators.flows import assemble_daily, investor_summary, recent_net_buy
from stockloom.operators.keyed import (duplicate_keys, latest_rows, orphans, prefer, restrict_keys, top_rows,
                                       union_keep_first)
from stockloom.operators.ownership import weekly_concentration

D1, D2 = dt.date(2026, 7, 1), dt.date(2026, 7, 2)
FLOW = "stock_code string, stock_date date, name string, buy double, sell double"


def test_classes_overlap_and_missing_names_count_everywhere(spark, rows):
    flows = spark.createDataFrame([
        ("a", D1, "Foreign_Dealer_Self", 10.0, 4.0), ("a", D1, None, 1.0, 0.0), ("a", D1, "Other", 9.0, 0.0),
        ("a", D2, "Investment_Trust", 0.0, 5.0)], FLOW)
    assert rows(investor_summary(flows)) == {("a", D1, 7.0, 1.0, 7.0), ("a", D2, 0.0, -5.0, 0.0)}


def test_assembly_fills_missing_sides_with_zero(spark):
    prices = spark.createDataFrame([("a", D1, 10.0, 1.0, 2.0), ("a", D2, None, 3.0, 4.0)],
                                   "stock_code string, stock_date date, stock_close double, trading_volume double, trading_money double")
    margins = spark.createDataFrame([("a", D2, 7.0, 8.0)],
                                    "stock_code string, stock_date date, margin_balance double, short_balance double")
    first, second = assemble_daily(prices, spark.createDataFrame([], FLOW), margins).orderBy("stock_date").collect()
    assert (first["foreign_net_buy"], first["margin_balance"], first["stock_close"]) == (0.0, 0.0, 10.0)
    assert (second["stock_close"], second["margin_balance"], second["short_balance"]) == (0.0, 7.0, 8.0)


def test_five_day_net_buy_skips_rows_with_a_missing_class(spark, rows):
    daily = spark.createDataFrame(
        [("a", D1 + dt.timedelta(days=i), 1.0, 1.0, None if i == 6 else 1.0) for i in range(8)],
        "stock_code string, stock_date date, foreign_net_buy double, trust_net_buy double, dealer_net_buy double")
    assert rows(recent_net_buy(daily)) == {("a", 12.0)}


def test_weekly_buckets(spark, rows):
    levels = spark.createDataFrame([
        ("a", "2026-07-01", "1", 100, 5.0), ("a", "2026-07-01", "3", 50, 10.0), ("a", "2026-07-01", "12", 5, 25.0),
        ("a", "2026-07-01", "15", 2, 45.0)],
        "stock_code string, date string, HoldingSharesLevel string, people bigint, percent double")
    assert rows(weekly_concentration(levels)) == {("a", D1, 70.0, 45.0, 15.0, 157)}
    extra = levels.unionByName(spark.createDataFrame([("a", "2026-07-01", "total", 157, 100.0),
                                                      ("a", "2026-07-01", "17", 9, 1.0)], levels.schema))
    assert rows(weekly_concentration(extra)) == {("a", D1, 71.0, 46.0, 15.0, 323)}
    assert rows(weekly_concentration(extra, max_level=15)) == {("a", D1, 70.0, 45.0, 15.0, 314)}


def test_keyed_selection(spark, rows):
    df = spark.createDataFrame([("a", i, i * 10) for i in range(5)] + [("b", 9, None)], "k string, d int, v int")
    assert rows(latest_rows(df, ["k"], ["d"], 2)) == {("a", 4, 40), ("a", 3, 30), ("b", 9, None)}
    assert rows(top_rows(df, ["k"], [F.col("d")], 1, rank_as="r")) == {("a", 0, 0, 1), ("b", 9, None, 1)}
    assert rows(duplicate_keys(df, ["k"])) == {("a", 5)}
    assert rows(orphans(df, df.filter("k = 'a'"), "k")) == {("b", 1)}
    assert restrict_keys(df, ["b"], "k").count() == restrict_keys(df, df.filter("k = 'b'"), "k").count() == 1


def test_earlier_frame_wins_and_fallback_only_fills_missing_keys(spark, rows):
    first = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x")], "stock_code string, d int, v string")
    second = spark.createDataFrame([("a", 2, "y"), ("a", 3, "y"), ("b", 1, "y")], first.schema)
    assert rows(union_keep_first([first, second], ["stock_code", "d"])) == {
        ("a", 1, "x"), ("a", 2, "x"), ("a", 3, "y"), ("b", 1, "y")}
    assert rows(prefer(first, second)) == {("a", 1, "x"), ("a", 2, "x"), ("b", 1, "y")}


def test_latest_rows_limits_groups_before_the_shuffle(spark):
    df = spark.range(100).selectExpr("id % 3 as k", "id as d").repartition(4)
    plan = latest_rows(df, ["k"], ["d"], 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.rindex("Exchange hashpartitioning") < plan.rindex("WindowGroupLimit")

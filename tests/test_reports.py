import datetime as dt

import pytest
from pyspark.sql import functions as F

from stockloom.operators.indicators import indicators
from stockloom.plans import reports, screener

DAILY = ("stock_code string, stock_date date, stock_close double, foreign_net_buy double, trust_net_buy double,"
         " dealer_net_buy double")
START = dt.date(2026, 1, 1)
FACTS = "statement string, stock_code string, date_info date, types string, data_value double, origin_name string"


def series(key, n, slope):
    return [(key, START + dt.timedelta(days=i), 100.0 + slope * i, 1.0, 2.0, -0.5) for i in range(n)]


@pytest.fixture
def inputs(spark):
    daily = spark.createDataFrame(series("up", 70, 1.0) + series("down", 70, -1.0) + series("new", 10, 1.0), DAILY)
    facts = spark.createDataFrame([("balance", "up", START, "TotalAssets", 1000.0, "-"), ("income", "up", START, "IncomeAfterTaxes", 150.0, "-")], FACTS)
    company = spark.createDataFrame([("up", "Up Ltd", "x", "y")], "stock_code string, company_name string, company_class string, main_business string")
    return daily, facts, company


def codes(df):
    return {r["stock_code"] for r in df.collect()}


def test_screener_criteria(inputs):
    daily, facts, company = inputs
    stored = indicators(daily)
    run = lambda **criteria: codes(screener.screener(stored, facts, company, **criteria))
    assert run() == {"up", "down", "new"}
    assert run(min_roe=10) == {"up"} and run(min_roe=-1) == {"up", "down", "new"}
    assert run(ma_cross="ma20") == run(ma_cross="ma60") == {"up"}
    assert run(min_net_buy=12.5) == {"up", "down", "new"} and run(min_net_buy=13) == set()
    assert run(ma_cross="other") == {"up", "down", "new"}


def test_both_ways_to_the_latest_row_agree(inputs):
    daily, facts, company = inputs
    key = lambda df: sorted((r["stock_code"], r["stock_close"], r["ma20"], r["ma60"], r["net_buy_5d"]) for r in df.collect())
    assert key(screener.latest_daily(indicators(daily))) == key(screener.latest_from_prices(daily))


def test_factor_row_and_labels(inputs):
    daily, facts, company = inputs
    stored = indicators(daily)
    row = screener.factor_metrics(stored, facts, company, "up").first()
    assert (row["company_name"], row["estimated_roe"], row["net_buy_5d"], row["stock_close"]) == ("Up Ltd", 15.0, 12.5, 169.0)
    labels = {r["stock_code"]: r for r in screener.factor_labels(screener.factor_table(
        screener.latest_daily(stored), facts, company)).collect()}
    assert (labels["up"]["ma20_position"], labels["down"]["ma60_position"], labels["new"]["ma20_position"]) == ("above", "below", "N/A")
    assert (labels["up"]["net_buy_text"], labels["up"]["net_buy_direction"], labels["up"]["roe_text"]) == ("+12", "buy", "15.00")
    assert screener.titled(screener.factor_table(screener.latest_daily(stored), facts, company)).columns == screener.FACTOR_TITLES


def test_key_filter_reaches_the_scan(spark, inputs, tmp_path):
    inputs[0].write.parquet(str(tmp_path / "d"))
    daily = spark.read.parquet(str(tmp_path / "d")).withColumns({"ma20": F.lit(1.0), "ma60": F.lit(1.0)})
    plan = screener.factor_metrics(daily, inputs[1], inputs[2], "up")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(stock_code,up)" in plan


def test_daily_range_prunes_years(spark, inputs):
    daily = inputs[0].withColumn("stock_year", F.year("stock_date"))
    got = reports.daily_range(daily, dt.date(2026, 1, 2), dt.date(2026, 1, 4), "up").collect()
    assert [r["stock_date"].day for r in got] == [2, 3, 4] and "stock_year" not in got[0].asDict()


def test_analyst_context(spark, inputs):
    daily, facts, company = inputs
    stored = indicators(daily)
    weekly = spark.createDataFrame([("up", START, 1.0, 2.0, 3.0), ("up", START + dt.timedelta(days=7), 4.0, 5.0, 6.0)],
                                   "stock_code string, update_date date, large_holders_400 double, large_holders_1000 double, retail_holders_10 double")
    warn = spark.createDataFrame([("up", 2025, 4, True, True, True, True), ("up", 2026, 1, True, False, False, True)],
                                 "stock_code string, year int, quarter int, is_receivable_warning boolean, is_inventory_warning boolean,"
                                 " is_cash_flow_warning boolean, is_debt_warning boolean")
    news = spark.createDataFrame([("up", f"t{i}", dt.datetime(2026, 3, 1, 8, i), f"l{i}", 0.5) for i in range(7)],
                                 "stock_code string, title string, publish_time timestamp, news_link string, sentiment_score double")
    row = reports.analyst_context(company, stored, weekly, warn, news, dt.date(2026, 12, 31)).first()
    assert (row["stock_close"], row["ma5"], row["large_holders_1000"]) == (169.0, 167.0, 5.0)
    assert row["warnings"] == ["負債比率偏高，超出設定閥值", "應收帳款天數過長"]
    assert row["news"] == [f"[2026-03-01 08:0{i}] t{i} (0.50)" for i in (6, 5, 4, 3, 2)]
    empty = reports.analyst_context(company, stored.limit(0), weekly.limit(0), warn.limit(0), news.limit(0), dt.date(2026, 12, 31)).first()
    assert (empty["stock_close"], empty["warnings_text"], empty["news_text"]) == (None, "", "")
    context = reports.news_context(company, stored, news).first()
    assert context["trend_text"].count("\n") == 14 and context["trend_text"].startswith("2026-02-25 close 155.00 sentiment 0.00")


def test_warning_history_and_lights(spark):
    indicators_ = spark.createDataFrame([("a", 2020 + i // 4, i % 4 + 1, 80.25, 50.0, 40.0, 61.0, 3.0, False, False, False, True) for i in range(20)],
                                        "stock_code string, year int, quarter int, earnings_quality_ratio double, receivable_turnover_days double,"
                                        " inventory_turnover_days double, debt_ratio double, interest_coverage_ratio double,"
                                        " is_receivable_warning boolean, is_inventory_warning boolean, is_cash_flow_warning boolean, is_debt_warning boolean")
    limits = spark.createDataFrame([("a", 60.0, None)], "stock_code string, max_debt_ratio double, last_updated timestamp")
    recent = reports.warning_history(indicators_, limits).orderBy("year", "quarter").collect()
    assert len(recent) == 12 and (recent[0]["year"], recent[0]["quarter"]) == (2022, 1)
    light = reports.warning_lights(indicators_).first()
    assert (light["period"], light["debt_light"], light["cash_flow_light"]) == ("2020 Q1", "warn (61.0%)", "ok (80.3%)")
    assert (light["receivable_light"], light["coverage_text"]) == ("ok (50d)", "3.00x")

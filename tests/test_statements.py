import datetime as dt

import pytest
from pyspark.sql import functions as F

from stockloom.operators import statements as st

FACT = "statement string, stock_code string, date_info date, types string, data_value double, origin_name string"
Q1, JAN = dt.date(2026, 3, 31), dt.date(2026, 1, 31)


def facts(spark, *rows):
    return spark.createDataFrame([(s, k, d, t, float(v), o) for s, k, d, t, v, o in rows], FACT)


def quarter(spark, day=Q1, key="a", **metrics):
    out = []
    for name, value in metrics.items():
        statement, types, _, _ = st.C.STATEMENT_METRICS[name]
        out.append((statement, key, day, types[0], value, "-"))
    return facts(spark, *out)


def ratios(spark, **metrics):
    return st.warning_indicators(quarter(spark, **metrics)).first()


@pytest.mark.parametrize("metrics, column, want", [
    ({"ni": 0, "ocf": 5}, "earnings_quality_ratio", 100.0),
    ({"ni": 0, "ocf": -5}, "earnings_quality_ratio", -100.0),
    ({"ni": 4, "ocf": 3}, "earnings_quality_ratio", 75.0),
    ({"int_exp": 0, "op_inc": 1}, "interest_coverage_ratio", 999.0),
    ({"int_exp": 0, "op_inc": -1}, "interest_coverage_ratio", -999.0),
    ({"int_exp": 4, "op_inc": 10}, "interest_coverage_ratio", 2.5),
    ({"revenue": 0, "ar": 9}, "receivable_turnover_days", 65.0),
    ({"revenue": 365, "ar": 40}, "receivable_turnover_days", 10.0),
    ({"cost": 0, "inv": 9}, "inventory_turnover_days", 85.0),
    ({"cost": 365, "inv": 8}, "inventory_turnover_days", 2.0),
    ({"assets": 0, "debt": 9}, "debt_ratio", 0.0),
    ({"assets": 3, "debt": 1}, "debt_ratio", 33.33)])
def test_ratios_and_their_stand_ins(spark, metrics, column, want):
    assert ratios(spark, **metrics)[column] == pytest.approx(want)


def test_flags_are_strict(spark):
    at_limit = ratios(spark, assets=100, debt=60, ni=100, ocf=80, revenue=365, ar=480, cost=365, inv=600)
    assert [at_limit[f] for f in st.FLAGS] == [False] * 4
    beyond = ratios(spark, assets=100, debt=61, ni=100, ocf=79, revenue=365, ar=481, cost=365, inv=601)
    assert [beyond[f] for f in st.FLAGS] == [True] * 4


def test_alias_by_origin_name_and_percentage_types(spark):
    df = facts(spark, ("balance", "a", Q1, "Other", 10, "負債總額"), ("balance", "a", Q1, "Liabilities_per", 99, "負債總額"),
               ("balance", "a", Q1, "TotalAssets", 40, "-"), ("income", "a", Q1, "Liabilities", 77, "負債總額"))
    row = st.pivot_metrics(df).first()
    assert (row["debt"], row["assets"], row["ni"]) == (10.0, 40.0, None)


def test_missing_type_never_counts_as_debt(spark):
    df = spark.createDataFrame([("balance", "a", Q1, None, 5.0, "負債總額"), ("balance", "a", Q1, None, 6.0, "存貨")], FACT)
    row = st.pivot_metrics(df).first()
    assert (row["debt"], row["inv"]) == (None, 6.0)


def test_largest_matching_fact_counts(spark):
    df = facts(spark, ("income", "a", Q1, "Revenue", 10, "-"), ("income", "a", Q1, "OperatingRevenue", 12, "營業收入"))
    assert st.pivot_metrics(df).first()["revenue"] == 12.0


def test_earliest_date_of_a_quarter_counts(spark):
    both = quarter(spark, JAN, assets=100, debt=10).unionByName(quarter(spark, Q1, assets=100, debt=90))
    out = st.warning_indicators(both).collect()
    assert [(r["year"], r["quarter"], r["debt_ratio"]) for r in out] == [(2026, 1, 10.0)]


def test_own_thresholds_and_defaults_for_gaps(spark):
    limits = spark.createDataFrame([("a", 10.0, None, None, 95.0, None)],
                                   "stock_code string, min_earnings_quality_ratio double, max_receivable_turnover_days double,"
                                   " max_inventory_turnover_days double, max_debt_ratio double, min_interest_coverage double")
    df = quarter(spark, assets=100, debt=90, ni=100, ocf=20, revenue=365, ar=481)
    df = df.unionByName(quarter(spark, key="b", assets=100, debt=90, ni=100, ocf=20))
    got = {r["stock_code"]: r for r in st.warning_indicators(df, limits).collect()}
    assert (got["a"]["is_debt_warning"], got["a"]["is_cash_flow_warning"], got["a"]["is_receivable_warning"]) == (False, False, True)
    assert (got["b"]["is_debt_warning"], got["b"]["is_cash_flow_warning"]) == (True, True)


@pytest.mark.parametrize("debts, want", [([70], 77.5), ([10], 60.0), ([], 60.0), ([100, 100], 100.0)])
def test_debt_limit(spark, debts, want):
    days = [dt.date(2020, 3, 31) + dt.timedelta(days=91 * i) for i in range(len(debts))]
    df = facts(spark, *[r for d, v in zip(days, debts) for r in (
        ("balance", "a", d, "Liabilities", v, "-"), ("balance", "a", d, "TotalAssets", 100, "-"))],
        ("balance", "z", Q1, "TotalAssets", 0, "-"))
    keys = spark.createDataFrame([("a",)], "stock_code string")
    assert st.default_thresholds(keys, df).first()["max_debt_ratio"] == pytest.approx(want)


def test_debt_limit_uses_twelve_latest_dates(spark):
    days = [dt.date(2015, 3, 31) + dt.timedelta(days=91 * i) for i in range(20)]
    df = facts(spark, *[r for i, d in enumerate(days) for r in (
        ("balance", "a", d, "Liabilities", 10 if i < 8 else 90, "-"), ("balance", "a", d, "TotalAssets", 100, "-"))])
    assert st.debt_history(df).count() == 12
    assert st.default_thresholds(df, df).first()["max_debt_ratio"] == 90.0


def test_roe_takes_latest_balance_date(spark, rows):
    df = facts(spark, ("balance", "a", JAN, "TotalAssets", 1000, "-"), ("balance", "a", Q1, "TotalAssets", 500, "-"),
               ("income", "a", Q1, "IncomeAfterTaxes", 75, "-"), ("income", "a", dt.date(2026, 6, 30), "IncomeAfterTaxes", 1, "-"),
               ("balance", "b", Q1, "TotalAssets", 0, "-"), ("income", "b", Q1, "IncomeAfterTaxes", 1, "-"))
    assert rows(st.estimated_roe(df)) == {("a", 15.0), ("b", None)}


def test_threshold_changes_touch_existing_keys_only(spark):
    limits = st.default_thresholds(spark.createDataFrame([("a",), ("b",)], "stock_code string"), facts(spark, ("balance", "x", Q1, "-", 1, "-")))
    limits = limits.withColumn("last_updated", F.lit(None).cast("timestamp"))
    changes = spark.createDataFrame([("a",), ("new",)], "stock_code string").withColumns(
        {n: F.lit(1.0) for n in st.THRESHOLDS})
    got = {r["stock_code"]: r for r in st.apply_threshold_changes(limits, changes, dt.datetime(2026, 1, 1)).collect()}
    assert set(got) == {"a", "b"}
    assert got["a"]["max_debt_ratio"] == 1.0 and got["a"]["last_updated"] == dt.datetime(2026, 1, 1)
    assert got["b"]["max_debt_ratio"] == 60.0 and got["b"]["last_updated"] is None


def test_pivot_is_one_aggregate_without_joins(spark):
    plan = st.pivot_metrics(quarter(spark, ni=1).repartition(3))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1

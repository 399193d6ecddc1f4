"""Statement facts in long form: metric pivot, ratios, thresholds and warning flags.

Facts are ``statement, stock_code, date_info, types, data_value, origin_name``. All
steps are conditional aggregates, so facts are combined before each shuffle.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from stockloom import constants as C
from stockloom.functions.numbers import ratio_or, rounded, signed_sentinel
from stockloom.operators.keyed import latest_rows

METRICS = list(C.STATEMENT_METRICS)
RATIOS = ["earnings_quality_ratio", "receivable_turnover_days", "inventory_turnover_days",
          "debt_ratio", "interest_coverage_ratio"]
FLAGS = ["is_receivable_warning", "is_inventory_warning", "is_cash_flow_warning", "is_debt_warning"]
THRESHOLDS = list(C.DEFAULT_THRESHOLDS)


def is_metric(metric: str) -> Column:
    """Whether a fact carries the metric, by its type or by its original name."""
    statement, types, origins, skip_percent = C.STATEMENT_METRICS[metric]
    named = F.col("types").isin(types) | F.col("origin_name").isin(origins)
    if skip_percent:
        named = named & ~F.col("types").like(C.PERCENT_TYPE_PATTERN)
    return (F.col("statement") == statement) & named


def metric_value(metric: str) -> Column:
    return F.max(F.when(is_metric(metric), F.col("data_value").cast("double"))).alias(metric)


def pivot_metrics(facts: DataFrame, metrics: list[str] = METRICS) -> DataFrame:
    """One row per key and statement date, a column per metric (the largest matching fact).

    A date of any statement counts, also one without a metric.
    """
    return facts.groupBy("stock_code", "date_info").agg(*[metric_value(m) for m in metrics])


def statement_dates(facts: DataFrame) -> DataFrame:
    return facts.select("stock_code", "date_info").distinct()


def first_of_quarter(pivoted: DataFrame) -> DataFrame:
    """Of several dates in one quarter the earliest one counts."""
    values = [c for c in pivoted.columns if c not in ("stock_code", "date_info")]
    return (pivoted.groupBy("stock_code", F.year("date_info").alias("year"), F.quarter("date_info").alias("quarter"))
            .agg(F.min_by(F.struct(*values), "date_info").alias("v"))
            .select("stock_code", "year", "quarter", *[F.col(f"v.{c}").alias(c) for c in values]))


def quarterly_ratios(facts: DataFrame) -> DataFrame:
    """Ratios of each quarter, with fixed stand-ins where a denominator is not positive."""
    m = {name: F.coalesce(F.col(name), F.lit(0.0)) for name in METRICS}

    def per_day(quarterly: Column) -> Column:
        return quarterly * C.QUARTERS_PER_YEAR / C.DAYS_PER_YEAR

    ratios = {
        "earnings_quality_ratio": ratio_or(m["ocf"] * 100, m["ni"],
                                           signed_sentinel(m["ocf"], C.EARNINGS_QUALITY_SENTINEL)),
        "receivable_turnover_days": ratio_or(m["ar"], per_day(m["revenue"]), C.RECEIVABLE_DAYS_SENTINEL),
        "inventory_turnover_days": ratio_or(m["inv"], per_day(m["cost"]), C.INVENTORY_DAYS_SENTINEL),
        "debt_ratio": ratio_or(m["debt"] * 100, m["assets"], C.DEBT_RATIO_SENTINEL),
        "interest_coverage_ratio": ratio_or(m["op_inc"], m["int_exp"],
                                            signed_sentinel(m["op_inc"], C.INTEREST_COVERAGE_SENTINEL)),
    }
    return first_of_quarter(pivot_metrics(facts)).select(
        "stock_code", "year", "quarter", *[ratios[r].alias(r) for r in RATIOS])


def with_thresholds(df: DataFrame, thresholds: DataFrame | None) -> DataFrame:
    """Adds each key's thresholds; a missing row or value takes the default."""
    if thresholds is None:
        return df.withColumns({name: F.lit(value) for name, value in C.DEFAULT_THRESHOLDS.items()})
    joined = df.join(thresholds.select("stock_code", *THRESHOLDS), "stock_code", "left")
    return joined.withColumns({
        name: F.coalesce(F.col(name).cast("double"), F.lit(value))
        for name, value in C.DEFAULT_THRESHOLDS.items()})


def warning_indicators(facts: DataFrame, thresholds: DataFrame | None = None) -> DataFrame:
    """Quarterly ratios and their four flags (strict comparison with the key's thresholds).

    Interest coverage has a threshold but, as documented, raises no flag.
    """
    judged = with_thresholds(quarterly_ratios(facts), thresholds)
    flags = {
        "is_receivable_warning": F.col("receivable_turnover_days") > F.col("max_receivable_turnover_days"),
        "is_inventory_warning": F.col("inventory_turnover_days") > F.col("max_inventory_turnover_days"),
        "is_cash_flow_warning": F.col("earnings_quality_ratio") < F.col("min_earnings_quality_ratio"),
        "is_debt_warning": F.col("debt_ratio") > F.col("max_debt_ratio"),
    }
    return judged.select("stock_code", "year", "quarter", *[rounded(F.col(r), 2).alias(r) for r in RATIOS],
                         *[flags[f].alias(f) for f in FLAGS])


def debt_history(facts: DataFrame, quarters: int = C.DEBT_HISTORY_QUARTERS) -> DataFrame:
    """Debt in percent of assets at each key's latest balance dates with positive assets."""
    balance = facts.filter(F.col("statement") == "balance")
    pivoted = pivot_metrics(balance, ["debt", "assets"]).filter(F.col("assets") > 0)
    return (latest_rows(pivoted, ["stock_code"], ["date_info"], quarters)
            .withColumn("debt_ratio", F.col("debt") / F.col("assets") * 100))


def default_thresholds(keys: DataFrame, facts: DataFrame) -> DataFrame:
    """Thresholds of new keys: constants, and a debt limit fitted to the key's history.

    The limit is median + 1.5 standard deviations of at most twelve ratios, and
    never below the constant.
    """
    spread = F.coalesce(F.stddev_samp("debt_ratio"), F.lit(C.DEBT_STD_MISSING))
    fitted = debt_history(facts).groupBy("stock_code").agg(
        rounded(F.median("debt_ratio") + C.DEBT_STD_WEIGHT * spread, 2).alias("fitted"))
    limit = F.greatest(F.col("fitted"), F.lit(C.DEFAULT_THRESHOLDS["max_debt_ratio"]))
    constants = {n: F.lit(v) for n, v in C.DEFAULT_THRESHOLDS.items()} | {"max_debt_ratio": limit}
    return keys.select("stock_code").distinct().join(fitted, "stock_code", "left").select(
        "stock_code", *[constants[n].alias(n) for n in THRESHOLDS])


def estimated_roe(facts: DataFrame) -> DataFrame:
    """Net income in percent of total assets at each key's latest balance date.

    Balance and income facts are pivoted together, so no many-to-many join is
    needed, and the latest date is picked by an aggregate.
    """
    relevant = facts.filter(F.col("statement").isin("balance", "income"))
    pivoted = relevant.groupBy("stock_code", "date_info").agg(
        metric_value("ni"), metric_value("assets"),
        F.max(F.col("statement") == "balance").alias("has_balance")).filter("has_balance")
    latest = pivoted.groupBy("stock_code").agg(
        F.max_by(F.struct("ni", "assets"), "date_info").alias("v"))
    return latest.select(
        "stock_code", (F.col("v.ni") / F.nullif(F.col("v.assets"), F.lit(0.0)) * 100).alias("estimated_roe"))


def as_facts(df: DataFrame, statement: str) -> DataFrame:
    """Landed statement rows in canonical columns, exact repeats removed."""
    return df.select(
        F.lit(statement).alias("statement"), F.col("stock_id").alias("stock_code"),
        F.to_date("date").alias("date_info"), F.col("type").alias("types"),
        F.col("value").alias("data_value"), "origin_name").distinct()


def apply_threshold_changes(thresholds: DataFrame, changes: DataFrame,
                            at: dt.datetime | Column | None = None) -> DataFrame:
    """Thresholds with the changes of existing keys applied and stamped; other changes do nothing."""
    stamp = F.current_timestamp() if at is None else (at if isinstance(at, Column) else F.lit(at))
    new = changes.select("stock_code", F.struct(*THRESHOLDS).alias("new"))
    joined = thresholds.join(new, "stock_code", "left")
    return joined.select(
        "stock_code",
        *[F.coalesce(F.col(f"new.{n}").cast("double"), F.col(n).cast("double")).alias(n) for n in THRESHOLDS],
        F.when(F.col("new").isNotNull(), stamp).otherwise(F.col("last_updated")).alias("last_updated"))

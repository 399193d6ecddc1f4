"""Stored tables (schema, key, layout) and the schemas of landed files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F, types as T


_TYPES = {"string": T.StringType(), "double": T.DoubleType(), "int": T.IntegerType(), "bigint": T.LongType(),
          "smallint": T.ShortType(), "date": T.DateType(), "timestamp": T.TimestampType()}
_TYPES["decimal(38,2)"] = T.DecimalType(38, 2)
_TYPES["closes"] = T.ArrayType(T.StructType([T.StructField("day", T.DateType()), T.StructField("close", T.DoubleType())]))


def _struct(text: str) -> T.StructType:
    """Schema of "name type, name type, ..."; unlike DDL parsing it needs no session."""
    pairs = [column.split() for column in text.split(", ")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


@dataclass(frozen=True)
class Table:
    """A stored table: its columns, its key and its partition columns.

    ``layout`` maps each partition column to the SQL expression deriving it
    from the stored columns, so a reader can prune on it.
    """

    name: str
    schema: T.StructType
    key: tuple[str, ...]
    layout: dict[str, str]
    sort: tuple[str, ...] = ()

    @property
    def columns(self) -> list[str]:
        return self.schema.fieldNames()

    @property
    def key_layout(self) -> list[str]:
        """Partition columns that follow from the key, so equal keys share a partition."""
        return [c for c, source in self.layout.items() if any(k in source for k in self.key)]


_TABLES = [
    Table("company", _struct(
        "stock_code string, company_name string, company_name_abbr string, company_name_en string,"
        " chairman_name string, establishment_date date, listing_date date, company_class string,"
        " website string, company_email string, general_manager string, company_address string,"
        " market_class string, main_business string"), ("stock_code",), {}),
    Table("daily_metrics", _struct(
        "stock_code string, stock_date date, stock_close decimal(38,2), trading_volume decimal(38,2),"
        " trading_money decimal(38,2), ma20 decimal(38,2), ma60 decimal(38,2), k_value decimal(38,2),"
        " d_value decimal(38,2), rsi14 decimal(38,2), macd_hist decimal(38,2),"
        " foreign_net_buy decimal(38,2), trust_net_buy decimal(38,2), dealer_net_buy decimal(38,2),"
        " margin_balance decimal(38,2), short_balance decimal(38,2)"),
        ("stock_code", "stock_date"), {"stock_year": "year(stock_date)"}, ("stock_code", "stock_date")),
    Table("weekly_concentration", _struct(
        "stock_code string, update_date date, large_holders_400 decimal(38,2),"
        " large_holders_1000 decimal(38,2), retail_holders_10 decimal(38,2), total_shareholders bigint"),
        ("stock_code", "update_date"), {}, ("stock_code", "update_date")),
    Table("monthly_revenue", _struct(
        "stock_code string, revenue_year int, revenue_month int, total_revenue decimal(38,2)"),
        ("stock_code", "revenue_year", "revenue_month"), {}, ("stock_code", "revenue_year")),
    Table("dividend", _struct(
        "stock_code string, date_info string, cash_dividends decimal(38,2), stock_dividend decimal(38,2),"
        " ex_dividend_date date, cash_dividend_date date"), ("stock_code", "date_info"), {}, ("stock_code",)),
    Table("statement_fact", _struct(
        "statement string, stock_code string, date_info date, types string, data_value decimal(38,2),"
        " origin_name string"),
        ("statement", "stock_code", "date_info", "types"), {"statement_part": "statement"},
        ("stock_code", "date_info")),
    Table("news", _struct(
        "news_id string, stock_code string, title string, content string, publish_time timestamp,"
        " news_link string, sentiment_score decimal(38,2)"),
        ("stock_code", "news_link"), {"news_bucket": "pmod(xxhash64(stock_code, news_link), 64)"}, ("stock_code", "publish_time")),
    Table("daily_sentiment", _struct("stock_code string, stock_date date, avg_sentiment double"),
        ("stock_code", "stock_date"), {}, ("stock_code", "stock_date")),
    Table("warning_threshold", _struct(
        "stock_code string, min_earnings_quality_ratio decimal(38,2), max_receivable_turnover_days decimal(38,2),"
        " max_inventory_turnover_days decimal(38,2), max_debt_ratio decimal(38,2),"
        " min_interest_coverage decimal(38,2), last_updated timestamp"), ("stock_code",), {}),
    Table("warning_indicator", _struct(
        "stock_code string, year int, quarter int, earnings_quality_ratio decimal(38,2),"
        " receivable_turnover_days decimal(38,2), inventory_turnover_days decimal(38,2),"
        " debt_ratio decimal(38,2), interest_coverage_ratio decimal(38,2), is_receivable_warning smallint,"
        " is_inventory_warning smallint, is_cash_flow_warning smallint, is_debt_warning smallint"),
        ("stock_code", "year", "quarter"), {}, ("stock_code", "year", "quarter")),
]
#: What the indicators of a key need of its past: see ``operators.state``.
_STATE = ("last_day date, n_rows bigint, k_state double, d_state double, ema_fast double, ema_slow double, ema_signal double,"
          " closes closes")
_DAILY = next(t for t in _TABLES if t.name == "daily_metrics")
_TABLES += [
    Table("indicator_state", _struct(f"stock_code string, {_STATE}"), ("stock_code",), {}, ("stock_code",)),
    Table("indicator_checkpoint", _struct(f"stock_code string, state_year int, {_STATE}"),
        ("stock_code", "state_year"), {"checkpoint_year": "state_year"}, ("stock_code",)),
    Table("landed_reject", _struct("dataset string, file string, reason string, digest string, raw string"),
        ("dataset", "file", "reason", "digest"), {}, ("dataset", "file")),
    Table("latest_daily", T.StructType([*_DAILY.schema.fields, T.StructField("place", T.IntegerType())]),
        ("stock_code", "place"), {}, ("stock_code",)),
]
TABLES = {t.name: t for t in _TABLES}


def conform(df: DataFrame, table: Table) -> DataFrame:
    """``df`` with the stored table's columns and types.

    Doubles are rounded by the cast to the stored decimals, NaN is NULL, and flags
    become 0/1. Text that is no such value becomes NULL; a number beyond its column
    (36 digits before the point) fails the batch rather than being lost. Columns the
    batch lacks are stored as NULL.
    """
    have = dict(df.dtypes)
    out = []
    for field in table.schema.fields:
        if field.name not in have:
            out.append(F.lit(None).cast(field.dataType).alias(field.name))
        elif have[field.name] == field.dataType.simpleString():
            out.append(F.col(field.name))
        elif have[field.name] == "boolean":
            out.append(F.col(field.name).cast("int").cast(field.dataType).alias(field.name))
        elif have[field.name] in ("double", "float"):
            out.append(F.nanvl(field.name, F.lit(None).cast("double")).cast(field.dataType).alias(field.name))
        elif have[field.name] == "string":
            out.append(F.col(field.name).try_cast(field.dataType).alias(field.name))
        else:
            out.append(F.col(field.name).cast(field.dataType).alias(field.name))
    return df.select(*out)


@dataclass(frozen=True)
class Landing:
    """One landed data set: the fields kept, and defaults for absent ones."""

    name: str
    fields: T.StructType
    date_field: str | None = "date"
    defaults: tuple[tuple[str, object], ...] = ()

    @property
    def envelope(self) -> T.StructType:
        return T.StructType([T.StructField("data", T.ArrayType(self.fields))])


_STATEMENT = "date string, stock_id string, type string, value double, origin_name string"
_LANDINGS = [
    Landing("price", _struct(
        "date string, stock_id string, close double, Trading_Volume double, Trading_money double")),
    Landing("revenue", _struct(
        "stock_id string, revenue double, revenue_month int, revenue_year int, date string")),
    Landing("dividend", _struct(
        "stock_id string, year string, StockEarningsDistribution string, StockStatutorySurplus string,"
        " CashEarningsDistribution string, CashStatutorySurplus string, CashExDividendTradingDate string,"
        " CashDividendPaymentDate string"),
        None, tuple((c, "") for c in (
            "stock_id", "year", "StockEarningsDistribution", "StockStatutorySurplus",
            "CashEarningsDistribution", "CashStatutorySurplus", "CashExDividendTradingDate",
            "CashDividendPaymentDate"))),
    Landing("valuation", _struct(
        "date string, stock_id string, dividend_yield double, PER double, PBR double")),
    Landing("income", _struct(_STATEMENT)),
    Landing("balance", _struct(_STATEMENT)),
    Landing("cashflow", _struct(_STATEMENT)),
    Landing("investor", _struct("date string, stock_id string, buy double, name string, sell double")),
    Landing("margin", _struct(
        "date string, stock_id string, MarginPurchaseTodayBalance double, ShortSaleTodayBalance double"),
        "date", (("MarginPurchaseTodayBalance", 0.0), ("ShortSaleTodayBalance", 0.0))),
    Landing("holding", _struct(
        "date string, stock_id string, HoldingSharesLevel string, people bigint, percent double, unit double")),
]
LANDINGS = {x.name: x for x in _LANDINGS}

FEED_ENTRY = _struct("title string, published string, link string").add("source", _struct("title string"))
FEED_ENVELOPE = T.StructType([
    T.StructField("stock_code", T.StringType()),
    T.StructField("entries", T.ArrayType(FEED_ENTRY)),
])

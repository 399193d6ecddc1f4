import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from stockloom.plans import loads
from stockloom.plans.update import LandingZone, monitored, update_all, update_companies
from stockloom.schemas import LANDINGS
from stockloom.sinks.warehouse import Warehouse
from stockloom.sources import files, landed, news_feed
from stockloom.streaming import loads as streams

READERS = {
    "price": landed.stock_prices, "revenue": landed.monthly_revenues, "dividend": landed.dividends,
    "valuation": landed.valuations, "income": landed.income_statements, "balance": landed.balance_sheets,
    "cashflow": landed.cash_flows, "investor": landed.investor_flows, "margin": landed.margin_balances,
    "holding": landed.holding_levels,
}


def land(path, *responses):
    path.mkdir(parents=True, exist_ok=True)
    name = f"part-{len(list(path.iterdir()))}.json"
    (path / name).write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in responses), encoding="utf-8")
    return str(path)


@pytest.mark.parametrize("name", sorted(READERS))
def test_readers_have_fixed_schemas_and_take_empty_responses(spark, tmp_path, name):
    path = land(tmp_path / name, {"data": []}, {"msg": "no data"}, {"data": [{"stock_id": "1", "extra": 5}]})
    df = READERS[name](spark, path)
    assert df.columns == LANDINGS[name].fields.fieldNames() and df.count() == 1


def test_bounds_codes_and_multi_line(spark, tmp_path):
    rows = [{"date": f"2026-07-0{d}", "stock_id": s, "close": 1.0} for d in (1, 2, 3) for s in ("1", "2")]
    path = land(tmp_path / "p", {"data": rows})
    assert landed.stock_prices(spark, path, start="2026-07-02", end=dt.date(2026, 7, 3), stock_ids=["1"]).count() == 2
    keys = spark.createDataFrame([("2",)], "stock_code string")
    assert landed.stock_prices(spark, path, stock_ids=keys).count() == 3
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "x.json").write_text(json.dumps({"data": rows}, indent=2))
    assert landed.stock_prices(spark, str(tmp_path / "m"), multi_line=True).count() == 6


def test_absent_fields_take_defaults(spark, tmp_path):
    margin = landed.margin_balances(spark, land(tmp_path / "m", {"data": [{"date": "2026-07-01", "stock_id": "1"}]})).first()
    assert (margin["MarginPurchaseTodayBalance"], margin["ShortSaleTodayBalance"]) == (0.0, 0.0)
    dividend = landed.dividends(spark, land(tmp_path / "d", {"data": [{"stock_id": "1", "year": "110"}]})).first()
    assert dividend["CashExDividendTradingDate"] == "" and dividend["StockStatutorySurplus"] == ""


def test_dividends_are_summed_and_need_both_days(spark, tmp_path, rows):
    base = {"stock_id": "1", "CashExDividendTradingDate": "2026-07-01", "CashDividendPaymentDate": "2026-08-01"}
    path = land(tmp_path / "d", {"data": [
        base | {"year": "a", "CashEarningsDistribution": "2.5", "CashStatutorySurplus": "x", "StockEarningsDistribution": ""},
        base | {"year": "b", "CashDividendPaymentDate": ""}, base | {"year": "c", "CashExDividendTradingDate": None},
        base | {"year": "d", "StockEarningsDistribution": 1.5, "StockStatutorySurplus": "0.5"}]})
    got = rows(loads.dividends(landed.dividends(spark, path)), "date_info", "cash_dividends", "stock_dividend")
    assert got == {("a", 2.5, 0.0), ("d", 0.0, 2.0)}


def test_ownership_file(spark, tmp_path, rows):
    (tmp_path / "o.csv").write_text("資料日期, 證券代號 ,持股分級,人數,股數,占集保庫存數比例%\n20260701,2330  ,1,10,5,1.5\n20260701,9999,2,10,5,2.5\n",
                                    encoding="utf-8")
    got = rows(files.read_ownership(spark, str(tmp_path / "o.csv"), ["2330"]))
    assert got == {("2330", "2026-07-01", "1", 10, 1.5)}
    with pytest.raises(ValueError):
        files.ownership_columns(["a", "b"])


COMPANY = {"公司代號": " 2330", "公司名稱": "台灣積體電路", "公司簡稱": "台積電", "成立日期": "19870221", "上市日期": "830905", "產業別": "24"}


def test_companies(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([COMPANY, COMPANY | {"公司代號": "1", "產業別": "99"}, {"公司代號": "7"}],
                                                ensure_ascii=False), encoding="utf-8")
    got = {r["stock_code"]: r for r in files.read_companies(spark, str(tmp_path / "c.json"), ["2330", "1"]).collect()}
    assert set(got) == {"2330", "1"}
    assert got["2330"]["establishment_date"] == dt.date(1987, 2, 21) and got["2330"]["listing_date"] is None
    assert (got["2330"]["company_class"], got["1"]["company_class"]) == ("半導體業", "其他")


@pytest.mark.parametrize("columns", [
    "StockCode string, CompanyNameC string, EstablishmentDate string, ListingDate string, Dataid string",
    "stock_code string, company_name string, establishment_date string, listing_date string, other string"])
def test_company_backup(spark, tmp_path, columns):
    spark.createDataFrame([("1", "full", "1987-02-21 00:00:00", None, "id")], columns).write.parquet(str(tmp_path / "b"))
    df = files.read_company_backup(spark, str(tmp_path / "b"))
    row = df.first()
    assert (row["stock_code"], row["company_name_abbr"], row["establishment_date"]) == ("1", "full", dt.date(1987, 2, 21))
    assert df.columns == ["stock_code", "company_name", "establishment_date", "listing_date", "company_name_abbr"]


def test_backup_is_used_where_there_is_no_master_file(spark, tmp_path):
    spark.createDataFrame([("1", "full", "1987-02-21", "1990-01-01")],
                          "StockCode string, CompanyNameC string, EstablishmentDate string, ListingDate string"
                          ).write.parquet(str(tmp_path / "land" / "company_backup"))
    store = Warehouse(spark, str(tmp_path / "store"))
    update_companies(store, LandingZone(spark, str(tmp_path / "land")), monitored(spark))
    row = store.read("company").first()
    assert (row["company_name_abbr"], row["listing_date"], row["website"]) == ("full", dt.date(1990, 1, 1), None)


def entry(title, day, link, source=None):
    stamp = dt.datetime(2026, 7, day, 8).strftime("%a, %d %b %Y %H:%M:%S GMT")
    return {"title": title, "published": stamp, "link": link} | ({"source": {"title": source}} if source else {})


def test_search(spark, tmp_path, rows):
    path = land(tmp_path / "n", {"stock_code": "2330", "entries": [
        entry("台積電創高 - CMoney", 1, "l1"), entry("台積電 - 其他報", 1, "l2"), entry("別家 - CMoney", 1, "l3"),
        entry("台積電", 2, "l4", "鉅亨網"), entry("台積電晚 - CMoney", 9, "l5")]}, {"stock_code": "1", "entries": []})
    words = spark.createDataFrame([("2330", "台積電")], "stock_code string, keyword string")
    found = news_feed.search(news_feed.read_feed(spark, path), words, dt.date(2026, 7, 1), dt.date(2026, 7, 2))
    assert rows(found, "title", "link") == {("台積電創高", "l1"), ("台積電", "l4")}


TODAY = dt.date(2026, 7, 10)
DAYS = [TODAY - dt.timedelta(days=i) for i in range(79, -1, -1)]


def landing(root, days):
    for code in ("2330", "2317"):
        base = {"stock_id": code}
        prices = [base | {"date": str(d), "close": 100 + (d.toordinal() * 7 % 13), "Trading_Volume": 1e6, "Trading_money": 1e8} for d in days]
        land(root / "price", {"data": prices})
        for _ in range(2):  # overlapping responses
            land(root / "investor", {"data": [base | {"date": str(d), "name": "Foreign_Investor", "buy": 10.0, "sell": 4.0} for d in days]})
        land(root / "margin", {"data": [base | {"date": str(d), "MarginPurchaseTodayBalance": 5.0} for d in days[::2]]})
        land(root / "revenue", {"data": [base | {"date": "2026-02-01", "revenue": 7.0, "revenue_month": 1, "revenue_year": 2026}] * 2})
        land(root / "dividend", {"data": [base | {"year": "114", "CashEarningsDistribution": "3", "CashExDividendTradingDate": "2026-06-01",
                                                  "CashDividendPaymentDate": "2026-07-01"}]})
        for name, kind in (("balance", "TotalAssets"), ("income", "IncomeAfterTaxes"), ("cashflow", "InterestExpense")):
            land(root / name, {"data": [base | {"date": "2026-03-31", "type": kind, "value": 100.0, "origin_name": "-"}] * 2})
    land(root / "holding", {"data": [{"stock_id": "2330", "date": "2026-07-03", "HoldingSharesLevel": "15", "people": 3, "percent": 40.0}]})
    (root / "ownership").mkdir(exist_ok=True)
    (root / "ownership" / "w.csv").write_text("日期,代號,分級,人數,比例\n20260703,2330,1,9,9\n20260703,2317,1,8,60\n", encoding="utf-8")
    (root / "company").mkdir(exist_ok=True)
    (root / "company" / "c.json").write_text(json.dumps([COMPANY, COMPANY | {"公司代號": "2317", "公司簡稱": "鴻海"}], ensure_ascii=False),
                                             encoding="utf-8")
    land(root / "news", {"stock_code": "2330", "entries": [entry("台積電獲利創高 - CMoney", 9, "l1"), entry("台積電 - CMoney", 2, "l2")]})


def test_full_update_then_nothing_new_then_the_gate(spark, tmp_path):
    zone, store = LandingZone(spark, str(tmp_path / "land")), Warehouse(spark, str(tmp_path / "store"))
    keys = monitored(spark, ["2330", "2317"])
    landing(tmp_path / "land", DAYS[:-1])
    assert update_all(store, zone, keys, TODAY - dt.timedelta(days=1)) is True
    counts = lambda: {n: store.read(n).count() for n in (
        "company", "daily_metrics", "weekly_concentration", "monthly_revenue", "dividend", "statement_fact", "news",
        "warning_threshold", "warning_indicator")}
    first = counts()
    assert first == {"company": 2, "daily_metrics": 158, "weekly_concentration": 2, "monthly_revenue": 2, "dividend": 2,
                     "statement_fact": 6, "news": 2, "warning_threshold": 2, "warning_indicator": 2}
    weekly = {r["stock_code"]: r for r in store.read("weekly_concentration").collect()}
    assert (weekly["2330"]["large_holders_1000"], weekly["2317"]["retail_holders_10"]) == (40, 60)
    assert float(store.read("news").filter("news_link = 'l1'").first()["sentiment_score"]) == 0.8
    land(tmp_path / "land" / "price", {"data": [{"stock_id": c, "date": str(TODAY), "close": 110.0, "Trading_Volume": 1.0,
                                                 "Trading_money": 1.0} for c in ("2330", "2317")]})
    assert update_all(store, zone, keys, TODAY) is True
    assert counts() == first | {"daily_metrics": 160}
    last = store.read("daily_metrics").filter(F.col("stock_date") == F.lit(TODAY)).first()
    assert last["ma60"] is not None and last["foreign_net_buy"] == 0 and last["margin_balance"] == 0
    land(tmp_path / "land" / "news", {"stock_code": "2317", "entries": [entry("鴻海大單 - CMoney", 10, "l9")]})
    assert update_all(store, zone, keys, TODAY) is False
    assert counts() == first | {"daily_metrics": 160, "news": 3}


def test_streams_append_late_and_repeated_rows_once(spark, tmp_path, rows):
    store = Warehouse(spark, str(tmp_path / "store"))
    path = land(tmp_path / "n", {"stock_code": "a", "entries": [entry("x - CMoney", 9, "l1")]})
    run = lambda: streams.append_stream(streams.news_stream(spark, path), store, "news", str(tmp_path / "cp")).awaitTermination()
    run()
    land(tmp_path / "n", {"stock_code": "a", "entries": [entry("x again - CMoney", 9, "l1"), entry("late 創高 - CMoney", 1, "l2")]})
    run()
    assert rows(store.read("news"), "title", "news_link") == {("x", "l1"), ("late 創高", "l2")}
    prices = land(tmp_path / "p", {"data": [{"stock_id": "a", "date": "2026-07-01", "close": 5.0}]})
    stream = loads.prices(streams.landed_stream(spark, prices, "price"))
    streams.append_stream(stream, store, "daily_metrics", str(tmp_path / "cp2")).awaitTermination()
    assert store.read("daily_metrics").count() == 1


def test_streamed_daily_sentiment(spark, tmp_path, rows):
    path = land(tmp_path / "n", {"stock_code": "a", "entries": [entry("創高 - CMoney", 1, "l1"), entry("x - CMoney", 1, "l2"),
                                                                entry("x - CMoney", 20, "l3")]})
    store = Warehouse(spark, str(tmp_path / "store"))

    def run():
        streams.daily_sentiment_stream(streams.news_stream(spark, path), store, str(tmp_path / "cp")).awaitTermination()
        return rows(store.read("daily_sentiment").withColumn("avg_sentiment", F.round("avg_sentiment", 6)))

    assert run() == {("a", dt.date(2026, 7, 1), 0.4), ("a", dt.date(2026, 7, 20), 0.0)}
    land(tmp_path / "n", {"stock_code": "a", "entries": [entry("創高 late - CMoney", 1, "l4"), entry("創高 again - CMoney", 1, "l5")]})
    assert run() == {("a", dt.date(2026, 7, 1), 0.6), ("a", dt.date(2026, 7, 20), 0.0)}


STEPS = ["update_companies", "update_daily", "update_weekly", "update_fundamentals", "update_news", "init_thresholds", "update_warnings"]


def contents(store):
    """All tables but the stamps of loading."""
    out = {}
    for name in ("company", "daily_metrics", "weekly_concentration", "monthly_revenue", "dividend", "statement_fact", "news", "warning_threshold",
                 "warning_indicator", "indicator_state", "latest_daily"):
        df = store.read(name)
        out[name] = sorted((tuple(r) for r in df.drop("last_updated").collect()), key=str)
    return out


def test_a_broken_night_goes_on_where_it_stopped(spark, tmp_path, monkeypatch):
    """Each step breaks once; the tables end as those of a night without a fault, and no finished step runs again."""
    from stockloom.plans import update

    landing(tmp_path / "land", DAYS[:-1])
    zone, keys = LandingZone(spark, str(tmp_path / "land")), monitored(spark, ["2330", "2317"])
    whole, broken = Warehouse(spark, str(tmp_path / "whole")), Warehouse(spark, str(tmp_path / "broken"))
    day = TODAY - dt.timedelta(days=1)
    assert update_all(whole, zone, keys, day) is True
    ran, faults = [], set(STEPS)

    def flaky(name, step):
        def run(*args, **kwargs):
            step(*args, **kwargs)  # all its writes are done when it breaks
            if name in faults:
                faults.remove(name)
                raise RuntimeError(name)
            ran.append(name)
        return run

    for name in STEPS:
        monkeypatch.setattr(update, name, flaky(name, getattr(update, name)))
    for _ in STEPS:
        with pytest.raises(RuntimeError):
            update_all(broken, zone, keys, day)
    assert update_all(broken, zone, keys, day) is True
    assert ran == STEPS and not faults
    assert contents(broken) == contents(whole)


def test_rejects_are_counted_and_kept_with_their_reason(spark, tmp_path):
    from stockloom.sources import checked

    store, folder = Warehouse(spark, str(tmp_path / "store")), tmp_path / "price"
    folder.mkdir()
    good = [{"date": f"2026-07-{d:02d}", "stock_id": "a", "close": 1.0 * d} for d in range(1, 6)]
    lines = [json.dumps({"data": good}), '{"data": [{"date": "2026-07-09", "stock', "", json.dumps({"data": []}), json.dumps({"status": 402}),
             json.dumps({"data": [{"date": "2026-07-06", "close": 2.0}, {"date": "soon", "stock_id": "a"}, {"stock_id": "b", "close": 3.0}]})]
    (folder / "one.json").write_text("\n".join(lines))
    (folder / "two.json").write_text(json.dumps({"data": [{"date": "2026-07-07", "stock_id": "b", "close": "x"}]}))
    for _ in range(2):  # read again, nothing is rejected twice
        got = checked.read_checked(spark, str(folder), "price", store)
    assert (got.read, got.kept, got.rejected) == (10, 6, 4) and got.rows.count() == 6
    rejects = {(r.file.rsplit("/", 1)[1], r.reason): r.raw for r in store.read("landed_reject").collect()}
    assert set(rejects) == {("one.json", "unreadable response"), ("one.json", "no key"), ("one.json", "no day")}
    assert rejects["one.json", "unreadable response"] == lines[1] and store.read("landed_reject").count() == 4
    zone = LandingZone(spark, str(tmp_path), rejects=store)
    assert zone.dataset("price", end="2026-07-02").count() == 2 and zone.dataset("margin").count() == 0
    store.append_new("daily_metrics", spark.createDataFrame([("a", None, 1.0), ("a", dt.date(2026, 7, 1), 2.0)], "stock_code string, stock_date date, stock_close double"))
    assert store.read("landed_reject").filter("dataset = 'daily_metrics' AND reason = 'no full key'").count() == 1


def test_new_fields_survive_and_absent_ones_take_defaults(spark, tmp_path):
    from stockloom.sources import checked

    folder = tmp_path / "margin"
    land(folder, {"data": [{"date": "2026-07-01", "stock_id": "a", "MarginPurchaseTodayBalance": 5}]})
    land(folder, {"data": [{"date": "2026-07-02", "stock_id": "a", "MarginPurchaseTodayBalance": "7.5", "Note": "late", "Lots": 3, "Detail": {"x": [1, 2]}},
                                       {"date": "2026-07-03", "stock_id": "a", "ShortSaleTodayBalance": 2, "Lots": 2.5}]}, {"data": None}, {"status": 1})
    df = checked.read_all_fields(spark, str(folder), "margin")
    assert df.columns == ["date", "stock_id", "MarginPurchaseTodayBalance", "ShortSaleTodayBalance", "Detail", "Lots", "Note"]
    got = {r.date[-2:]: r for r in df.collect()}
    assert (got["01"].MarginPurchaseTodayBalance, got["01"].ShortSaleTodayBalance, got["01"].Note) == (5.0, 0.0, None)
    assert (got["02"].MarginPurchaseTodayBalance, float(got["02"].Lots), got["02"].Note, got["02"].Detail) == (7.5, 3.0, "late", '{"x":[1,2]}')
    assert (got["03"].ShortSaleTodayBalance, float(got["03"].Lots)) == (2.0, 2.5)
    empty = tmp_path / "price"
    land(empty, {"data": []})
    assert checked.read_all_fields(spark, str(empty), "price").columns == LANDINGS["price"].fields.fieldNames()

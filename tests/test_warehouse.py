import datetime as dt
import os
import time
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from stockloom.plans import incremental as inc, reports
from stockloom.plans.update import change_thresholds, init_thresholds, update_warnings
from stockloom.schemas import TABLES
from stockloom.session import shared_folder
from stockloom.sinks.warehouse import Warehouse

DAYS = [dt.date(2026, 7, d) for d in (1, 2, 3)]


@pytest.fixture
def store(spark, tmp_path):
    return Warehouse(spark, str(tmp_path / "store"))


def closes(spark, *pairs, key="2330"):
    return spark.createDataFrame([(key, d, float(v)) for d, v in pairs], "stock_code string, stock_date date, stock_close double")


def stored(store):
    return {r["stock_date"]: float(r["stock_close"]) for r in store.read("daily_metrics").collect()}


def test_existing_rows_win_and_a_repeat_changes_nothing(spark, store):
    store.append_new("daily_metrics", closes(spark, (DAYS[0], 100), (DAYS[1], 200)))
    second = closes(spark, (DAYS[1], 999), (DAYS[2], 300))
    for _ in range(2):
        store.append_new("daily_metrics", second)
    assert stored(store) == dict(zip(DAYS, (100.0, 200.0, 300.0)))


def shuffles(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return {name for name in (found.apply(i).name() for i in range(found.size())) if name.startswith("shuffle_")}


def test_written_tables_leave_no_shuffle_files(spark, store):
    before, rows = shuffles(spark), closes(spark, (DAYS[0], 100), (DAYS[1], 200))
    with store.stage("some") as write:
        write(rows.repartition(3, "stock_date"))
    store._write(TABLES["daily_metrics"], rows)
    store.parts("warning_threshold").write(rows.select("stock_code"))
    until = time.time() + 20
    while shuffles(spark) - before and time.time() < until:  # they go in the background
        time.sleep(0.2)
    assert not shuffles(spark) - before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_batch_may_repeat_a_key_and_hold_text_dates(spark, store):
    batch = spark.createDataFrame([("a", "2026-07-01", 2.0), ("a", "2026-07-01 00:00:00", 1.0), ("a", "never", 3.0)],
                                  "stock_code string, stock_date string, stock_close double")
    store.append_new("daily_metrics", batch)
    assert stored(store) == {DAYS[0]: 1.0}


def test_values_take_the_stored_scale_and_large_ones_stay(spark, store):
    batch = closes(spark, (DAYS[0], 1.005), (DAYS[1], 1e12)).withColumn("k_value", F.lit(12.345))
    store.append_new("daily_metrics", batch)
    got = {r["stock_date"]: r for r in store.read("daily_metrics").collect()}
    assert str(got[DAYS[0]]["stock_close"]) == "1.01" and str(got[DAYS[0]]["k_value"]) == "12.35"
    assert float(got[DAYS[1]]["stock_close"]) == 1e12 and got[DAYS[0]]["ma20"] is None


@pytest.mark.parametrize("name", ["stock\"code;", "missing"])
def test_key_columns_must_be_there(spark, store, name):
    with pytest.raises(ValueError):
        store.append_new("daily_metrics", closes(spark, (DAYS[0], 1)).withColumnRenamed("stock_code", name))
    with pytest.raises(KeyError):
        store.append_new("x\"; y", closes(spark, (DAYS[0], 1)))


def test_unwritten_tables_are_empty(store):
    for name, table in TABLES.items():
        df = store.read(name)
        assert df.columns == table.columns and df.isEmpty()


def test_daily_rows_lie_in_year_directories_and_appends_prune_them(spark, store):
    store.append_new("daily_metrics", closes(spark, (dt.date(2024, 5, 1), 1), (dt.date(2026, 5, 1), 2)))
    assert {d for d in os.listdir(store.path("daily_metrics")) if d.startswith("stock")} == {"stock_year=2024", "stock_year=2026"}
    keys = store._existing_keys(TABLES["daily_metrics"], closes(spark, (dt.date(2026, 6, 1), 1)))
    assert keys.count() == 1
    assert "PartitionFilters: [isnotnull(stock_year" in keys._jdf.queryExecution().executedPlan().toString()


def test_news_key_is_unique_across_days(spark, store):
    schema = "stock_code string, title string, publish_time timestamp, news_link string"
    store.append_new("news", spark.createDataFrame([("a", "t", dt.datetime(2026, 7, 1), "l")], schema))
    store.append_new("news", spark.createDataFrame([("a", "t", dt.datetime(2026, 7, 9), "l"), ("b", "t", None, "l")], schema))
    assert {(r["stock_code"], r["publish_time"]) for r in store.read("news").collect()} == {
        ("a", dt.datetime(2026, 7, 1)), ("b", None)}


def test_upsert_lets_the_new_row_win(spark, store):
    def ind(*rows):
        return spark.createDataFrame(rows, "stock_code string, year int, quarter int, debt_ratio double, is_debt_warning boolean")
    store.upsert("warning_indicator", ind(("a", 2026, 1, 1.0, False), ("a", 2026, 2, 2.0, True)))
    store.upsert("warning_indicator", ind(("a", 2026, 2, 9.0, False), ("b", 2026, 2, 3.0, True)))
    got = {(r["stock_code"], r["quarter"]): (float(r["debt_ratio"]), r["is_debt_warning"]) for r in store.read("warning_indicator").collect()}
    assert got == {("a", 1): (1.0, 0), ("a", 2): (9.0, 0), ("b", 2): (3.0, 1)}
    with pytest.raises(ValueError):
        store.upsert("daily_metrics", closes(spark, (DAYS[0], 1)))


def test_thresholds_init_change_and_rejudge(spark, store):
    q = dt.date(2026, 3, 31)
    facts = spark.createDataFrame([("balance", "a", q, "TotalAssets", 100.0, "-"), ("balance", "a", q, "Liabilities", 70.0, "-"),
                                   ("balance", "b", q, "TotalAssets", 100.0, "-"), ("balance", "b", q, "Liabilities", 90.0, "-")],
                                  "statement string, stock_code string, date_info date, types string, data_value double, origin_name string")
    store.append_new("statement_fact", facts)
    keys = spark.createDataFrame([("a",), ("b",)], "stock_code string")
    init_thresholds(store, keys.filter("stock_code = 'a'"))
    init_thresholds(store, keys)
    limits = {r["stock_code"]: float(r["max_debt_ratio"]) for r in store.read("warning_threshold").collect()}
    assert limits == {"a": 77.5, "b": 97.5}
    update_warnings(store, keys)
    flags = lambda: {r["stock_code"]: r["is_debt_warning"] for r in store.read("warning_indicator").collect()}
    assert flags() == {"a": 0, "b": 0}
    new = keys.filter("stock_code = 'b'").withColumns({
        "min_earnings_quality_ratio": F.lit(80.0), "max_receivable_turnover_days": F.lit(120.0),
        "max_inventory_turnover_days": F.lit(150.0), "max_debt_ratio": F.lit(80.0), "min_interest_coverage": F.lit(3.0)})
    change_thresholds(store, new.unionByName(new.withColumn("stock_code", F.lit("unknown"))))
    assert flags() == {"a": 0, "b": 1}
    stamped = {r["stock_code"]: r["last_updated"] is not None for r in store.read("warning_threshold").collect()}
    assert stamped == {"a": False, "b": True}


def test_marks_delta_and_gate(spark, store, rows):
    today = dt.date(2026, 7, 3)
    keys = spark.createDataFrame([("2330",), ("new",)], "stock_code string")
    daily = closes(spark, (DAYS[0], 1), (DAYS[1], 2))
    marks = inc.high_water_marks(keys, daily, "stock_date", today, 1)
    assert rows(marks) == {("2330", DAYS[1]), ("new", dt.date(2025, 1, 1))}
    landed = closes(spark, (DAYS[0], 1), (DAYS[1], 5), (DAYS[2], 6), (dt.date(2026, 7, 4), 7)).unionByName(
        closes(spark, (dt.date(2024, 12, 31), 8), (dt.date(2025, 1, 1), 9), key="new"))
    assert rows(inc.delta(landed, marks, F.col("stock_date"), today)) == {
        ("2330", DAYS[1], 5.0), ("2330", DAYS[2], 6.0), ("new", dt.date(2025, 1, 1), 9.0)}
    revenue = spark.createDataFrame([("2330", 2024)], "stock_code string, revenue_year int")
    assert rows(inc.revenue_marks(keys, revenue, today)) == {("2330", dt.date(2024, 1, 1)), ("new", dt.date(2025, 1, 1))}
    assert rows(inc.stale_keys(keys, daily, DAYS[1])) == {("new",)}
    assert rows(inc.row_counts(keys, daily, DAYS[1])) == {("2330", 1), ("new", 0)}
    assert not inc.is_fresh(keys, daily, daily, DAYS[1])
    one = keys.filter("stock_code = '2330'")
    assert inc.is_fresh(one, daily, daily, DAYS[1]) and not inc.is_fresh(one, daily, daily.limit(0), DAYS[1])


def test_news_marks(spark, rows):
    news = spark.createDataFrame([("a", dt.datetime(2026, 7, 1, 9)), ("b", dt.datetime(2026, 5, 1))], "stock_code string, publish_time timestamp")
    keys = spark.createDataFrame([("a",), ("b",), ("c",)], "stock_code string")
    assert rows(inc.news_marks(keys, news, dt.date(2026, 7, 3))) == {
        ("a", dt.date(2026, 7, 1), dt.date(2026, 6, 26)), ("b", dt.date(2026, 5, 1), dt.date(2026, 5, 1)),
        ("c", dt.date(2026, 4, 4), dt.date(2026, 4, 4))}


def test_versions_survive_empty_and_half_written_ones(spark, store, rows):
    limits = spark.createDataFrame([("a", 1234.5)], "stock_code string, max_debt_ratio double")
    store.upsert("warning_indicator", spark.createDataFrame([], "stock_code string, year int, quarter int"))
    store.upsert("warning_indicator", spark.createDataFrame([], "stock_code string, year int, quarter int"))
    assert store.read("warning_indicator").isEmpty()
    store.upsert("warning_threshold", limits)
    store.parts("warning_threshold").write(store.read("warning_threshold").limit(0), "version")
    assert store.read("warning_threshold").isEmpty()
    half = f"{store.path('warning_threshold')}/change=9"
    store.read("warning_threshold").write.parquet(half)
    os.remove(half + "/_SUCCESS")
    store.upsert("warning_threshold", limits)
    assert {(r.stock_code, float(r.max_debt_ratio)) for r in store.read("warning_threshold").collect()} == {("a", 1234.5)}
    assert os.path.isdir(f"{store.path('warning_threshold')}/change=10")


def parts_of(store, name):
    return sorted((d for d in os.listdir(store.path(name)) if "=" in d), key=lambda d: int(d.split("=")[1]))


def test_an_upsert_writes_its_keys_only_and_compaction_cleans_up(spark, store, rows):
    def limits(*pairs):
        return spark.createDataFrame([(k, float(v)) for k, v in pairs], "stock_code string, max_debt_ratio double")

    store.upsert("warning_threshold", limits(*[(f"k{i}", i) for i in range(100)]))
    assert store.compact("warning_threshold", most=0) and parts_of(store, "warning_threshold") == ["change=1", "version=2"]
    store.upsert("warning_threshold", limits(("k7", 700), ("new", 1)))
    assert spark.read.parquet(f"{store.path('warning_threshold')}/change=3").count() == 2
    before = store.read("warning_threshold")  # a reader that listed the parts before the compactions
    store.upsert("warning_threshold", limits(("k7", 701)))
    want = {(f"k{i}", 701.0 if i == 7 else float(i)) for i in range(100)} | {("new", 1.0)}
    current = lambda: {(r.stock_code, float(r.max_debt_ratio)) for r in store.read("warning_threshold").collect()}
    assert current() == want
    assert store.compact("warning_threshold", most=1) and current() == want
    assert parts_of(store, "warning_threshold") == ["version=2", "change=3", "change=4", "version=5"]
    assert {r.stock_code: float(r.max_debt_ratio) for r in before.collect()}["k7"] == 700.0
    store.upsert("warning_threshold", limits(("k8", 800)))
    assert store.compact("warning_threshold", most=0)
    assert parts_of(store, "warning_threshold") == ["version=5", "change=6", "version=7"] and not store.compact("warning_threshold", most=0)


def test_reading_few_changes_does_not_shuffle_the_base(spark, store):
    store.upsert("warning_threshold", spark.range(1000).select(F.col("id").cast("string").alias("stock_code"), F.lit(1.0).alias("max_debt_ratio")))
    store.compact("warning_threshold", most=0)
    store.upsert("warning_threshold", spark.createDataFrame([("5", 2.0)], "stock_code string, max_debt_ratio double"))
    plan = store.read("warning_threshold")._jdf.queryExecution().executedPlan().toString()
    base = plan.split("version=")[0]
    assert "BroadcastHashJoin" in base and "Exchange hashpartitioning" not in base.split("Union")[-1].split("FileScan")[0]


def test_ledger_holds_what_was_appended(spark, store, rows):
    marks = lambda: {(r.stock_code, r.latest, r.n_rows) for r in store.marks("daily_metrics").collect()}
    assert marks() == set()
    store.append_new("daily_metrics", closes(spark, (DAYS[0], 1), (DAYS[2], 3)))
    again = closes(spark, (DAYS[1], 2), (DAYS[2], 9)).unionByName(closes(spark, (DAYS[0], 5), key="b"))
    for _ in range(3):
        store.append_new("daily_metrics", again)
    assert marks() == {("2330", DAYS[2], 3), ("b", DAYS[0], 1)} and not store.repair_ledger("daily_metrics")
    plan = store.marks("daily_metrics")._jdf.queryExecution().executedPlan().toString()
    assert "_ledger" in plan and "daily_metrics/stock_year" not in plan and store.path("daily_metrics") + "]" not in plan
    store.append_new("statement_fact", spark.createDataFrame([("income", "a", DAYS[0], "x"), ("balance", "a", DAYS[1], "x")], "statement string, stock_code string, date_info date, types string"))
    assert {(r.stock_code, r.latest) for r in store.marks("statement_fact", "income").collect()} == {("a", DAYS[0])}


def test_a_lost_ledger_write_is_repaired(spark, store, monkeypatch):
    def broken(*_):
        raise RuntimeError("the driver went away")

    store.append_new("daily_metrics", closes(spark, (DAYS[0], 1)))
    with monkeypatch.context() as m:
        m.setattr(Warehouse, "_note", broken)
        with pytest.raises(RuntimeError):
            store.append_new("daily_metrics", closes(spark, (DAYS[1], 2)))
    assert not os.listdir(f"{store.root}/_stage")
    store.append_new("daily_metrics", closes(spark, (DAYS[1], 2)))  # the retry brings the mark, not the count
    mark = store.marks("daily_metrics").first()
    assert (mark.latest, mark.n_rows) == (DAYS[1], 1)
    assert store.repair_ledger("daily_metrics") and store.marks("daily_metrics").first().n_rows == 2
    for i in range(20):
        store.append_new("daily_metrics", closes(spark, (DAYS[2], 3), key=f"k{i}"))
    assert store.marks("daily_metrics").count() == 21 and len(os.listdir(f"{store.root}/_ledger/daily_metrics")) < 25


def test_a_number_beyond_its_column_is_never_lost(spark, store):
    with pytest.raises(Exception, match="CAST|NUMERIC|OVERFLOW|out of range"):
        store.upsert("warning_threshold", spark.createDataFrame([("a", 1e40)], "stock_code string, max_debt_ratio double"))


def test_stored_side_of_a_news_append_is_pruned_by_bucket(spark, store):
    news = spark.createDataFrame([("a", f"l{i}", dt.datetime(2026, 7, 1)) for i in range(300)], "stock_code string, news_link string, publish_time timestamp")
    store.append_new("news", news)
    keys = store._existing_keys(TABLES["news"], news.limit(2))
    plan = keys._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "news_bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert keys.count() < 60
    assert not os.path.isdir(f"{store.root}/_stage") or not os.listdir(f"{store.root}/_stage")


def test_reading_since_a_day_reads_its_years(spark, store):
    store.append_new("daily_metrics", closes(spark, (DAYS[0], 1), (dt.date(2001, 1, 1), 2)))
    recent = store.read("daily_metrics", since=DAYS[0])
    assert recent.count() == 1
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "stock_year" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Context:
        master = "yarn"

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda *_: None)

    with pytest.raises(ValueError):
        shared_folder(Session())


def test_parameterised_sql_over_stored_tables(spark, store, rows):
    store.append_new("daily_metrics", closes(spark, (DAYS[0], 1), (DAYS[1], 2), (DAYS[2], 3)))
    found = store.sql("SELECT stock_date FROM daily_metrics WHERE stock_code = :code AND stock_date BETWEEN :start AND :end",
                      code="2330", start=DAYS[1], end=DAYS[2])
    assert rows(found) == {(DAYS[1],), (DAYS[2],)}
    assert store.sql("SELECT * FROM daily_metrics WHERE stock_code = :code", code="x' OR '1'='1").isEmpty()


def test_queries_by_day_read_the_years_they_need(spark, store):
    store.append_new("daily_metrics", closes(spark, (DAYS[0], 1), (dt.date(2001, 1, 1), 2)))
    daily, keys = store.read("daily_metrics", with_layout=True), spark.createDataFrame([("2330",)], "stock_code string")
    for df in (inc.row_counts(keys, daily, DAYS[0]), inc.stale_keys(keys, daily, DAYS[0]), reports.recent_prices(daily, DAYS[0])):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert any("stock_year" in part.split("]")[0] for part in plan.split("PartitionFilters: [")[1:])


def test_sketches_let_new_keys_skip_the_stored_ones(spark, store, monkeypatch):
    schema = "stock_code string, news_link string, publish_time timestamp"
    news = lambda ids: spark.createDataFrame([("a", f"l{i}", dt.datetime(2026, 7, 1)) for i in ids], schema)
    store.append_new("news", news(range(3_000)))
    hits = {r.news_link for r in store.probable("news", news(range(2_500, 23_000))).collect()}
    assert {f"l{i}" for i in range(2_500, 3_000)} <= hits and len(hits) < 520  # of 20,000 new keys nearly all skip the exact join
    looked = []
    existing = Warehouse._existing_keys
    monkeypatch.setattr(Warehouse, "_existing_keys", lambda self, table, staged: (looked.append(staged.count()), existing(self, table, staged))[1])
    store.append_new("news", news(range(2_990, 6_000)))
    store.append_new("news", news(range(2_990, 6_000)))
    assert looked[0] < 40 and looked[1] == 3_010 and store.read("news").count() == 6_000
    assert {r.news_link for r in store.known_keys("news", news([5, 7_000])).collect()} == {"l5"}


def test_sketches_of_broken_and_older_stores_lose_nothing(spark, store, monkeypatch):
    schema = "stock_code string, news_link string"
    news = lambda ids: spark.createDataFrame([("a", f"l{i}") for i in ids], schema)
    with monkeypatch.context() as m:
        m.setattr("stockloom.sinks.warehouse.SKETCHED", set())
        store.append_new("news", news(range(50)))  # a store without sketches
    store.append_new("news", news(range(40, 60)))
    assert store.read("news").count() == 60

    def broken(*_):
        raise RuntimeError("gone")

    with monkeypatch.context() as m:
        m.setattr(Warehouse, "_write", broken)  # keys noted, rows not stored
        with pytest.raises(RuntimeError):
            store.append_new("news", news(range(55, 70)))
    store.append_new("news", news(range(55, 70)))
    store.append_new("news", news(range(70)))
    assert store.read("news").count() == 70


def test_an_append_stages_the_columns_it_has_once(spark, store, monkeypatch):
    staged, stage = [], Warehouse.stage

    @contextmanager
    def spied(self, label):
        with stage(self, label) as write:
            yield lambda df: (staged.append(df.columns), write(df))[1]

    monkeypatch.setattr(Warehouse, "stage", spied)
    store.append_new("daily_metrics", closes(spark, (DAYS[0], 100), (DAYS[1], 200), (None, 1), (None, 2)))
    store.append_new("daily_metrics", closes(spark, (DAYS[1], 0), (DAYS[2], 300)))
    assert stored(store) == {DAYS[0]: 100.0, DAYS[1]: 200.0, DAYS[2]: 300.0}
    wide = [c for c in staged if len(c) > 3 and "digest" not in c]
    assert not wide and staged.count(["stock_code", "stock_date", "stock_close"]) == 2
    assert sorted(r.raw.count('"stock_close":2') for r in store.read("landed_reject").collect()) == [0, 1]
    assert [(r.latest, r.n_rows) for r in store.marks("daily_metrics").collect()] == [(DAYS[2], 3)]


def test_news_without_a_time_can_be_appended(spark, store):
    store.append_new("news", spark.createDataFrame([("a", "l1"), ("a", "l2"), ("a", "l1")], "stock_code string, news_link string"))
    assert store.read("news").count() == 2

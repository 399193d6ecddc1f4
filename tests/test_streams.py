"""Streams with state: equal to the batch operators, through restarts, with late rows counted."""

import datetime as dt
import random

import pandas as pd
import pytest

from stockloom.operators.indicators import INDICATORS, indicators
from stockloom.operators.news import daily_sentiment
from stockloom.sinks.warehouse import Warehouse
from stockloom.streaming import stateful

PRICES = "stock_code string, stock_date date, stock_close double"
NEWS = "stock_code string, title string, publish_time timestamp, news_link string, sentiment_score double"
START = dt.date(2026, 1, 1)


@pytest.fixture
def state_store(spark):
    name = next(iter(stateful.STATE_STORE))
    before = spark.conf.get(name)
    for key, value in stateful.STATE_STORE.items():
        spark.conf.set(key, value)
    yield
    spark.conf.set(name, before)


def land(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def run(df, folder, out="out"):
    query = df.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/{out}", format="parquet")
    query.awaitTermination()
    return query


def test_indicator_stream_through_a_restart(spark, state_store, tmp_path):
    rng, rows, folder = random.Random(1), [], str(tmp_path)
    for key, n in (("a", 150), ("b", 40), ("c", 4)):
        value = 100.0
        for i in range(n):
            value = max(1.0, value + rng.gauss(0, 1))
            rows.append((key, START + dt.timedelta(days=i), None if i % 41 == 30 else round(value, 2)))
    part = lambda first, last: [r for r in rows if first <= (r[1] - START).days < last]

    def stream():
        landed = spark.readStream.schema(PRICES).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        return stateful.indicator_stream(landed)

    land(spark, f"{folder}/in", part(0, 60)[::-1] + part(0, 3), PRICES)  # not in order, and some days twice
    run(stream(), folder)
    first = spark.read.parquet(f"{folder}/out")
    assert first.count() == 60 + 40 and {r.stock_code for r in first.collect()} == {"a", "b"}
    land(spark, f"{folder}/in", part(60, 61), PRICES)
    land(spark, f"{folder}/in", part(61, 150)[::-1], PRICES)
    run(stream(), folder)
    got = {(r.stock_code, r.stock_date): r for r in spark.read.parquet(f"{folder}/out").collect()}
    want = {(r.stock_code, r.stock_date): r for r in indicators(spark.createDataFrame(rows, PRICES)).collect() if r.stock_code != "c"}
    assert got.keys() == want.keys()  # a series of four days has no indicators
    for k, r in got.items():
        for name in INDICATORS:
            assert (r[name] is None) == (want[k][name] is None) and (r[name] is None or r[name] == pytest.approx(want[k][name], abs=1e-9)), (k, name)


def test_days_wait_for_the_watermark(spark, state_store, tmp_path):
    folder, days = str(tmp_path), [START + dt.timedelta(days=i) for i in range(20)]
    stream = lambda: stateful.indicator_stream(spark.readStream.schema(PRICES).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"), "3 days")
    land(spark, f"{folder}/in", [("a", d, 1.0) for d in days[:10] if d != days[8]], PRICES)
    run(stream(), folder)
    assert {r.stock_date for r in spark.read.parquet(f"{folder}/out").collect()} == set(days[:7])
    land(spark, f"{folder}/in", [("a", days[8], 2.0)], PRICES)  # two days late
    land(spark, f"{folder}/in", [("a", d, 1.0) for d in days[10:]], PRICES)
    land(spark, f"{folder}/in", [("a", days[2], 9.0)], PRICES)  # beyond the watermark
    query = run(stream(), folder)
    got = {r.stock_date: r.stock_close for r in spark.read.parquet(f"{folder}/out").collect()}
    assert got == {d: 2.0 if d == days[8] else 1.0 for d in days[:17]}
    assert stateful.late_rows(query) == 1


def news(*rows):
    return [(key, f"t{link}", dt.datetime(2026, 7, 1) + dt.timedelta(hours=h), link, score) for key, h, link, score in rows]


def test_news_once_within_the_watermark(spark, tmp_path):
    folder, store = str(tmp_path), Warehouse(spark, str(tmp_path / "store"))
    first = news(("a", 0, "l1", 0.5), ("a", 1, "l1", 0.5), ("b", 1, "l1", 0.1), ("a", 30, "l2", 0.2))
    second = news(("a", 26, "l1", 0.5), ("a", 100, "l3", 0.3))
    third = news(("a", 2, "l9", 0.9), ("a", 99, "l3", 0.3), ("a", 101, "l4", 0.4))  # l9 comes four days late
    for part in (first, second, third):
        land(spark, f"{folder}/in", part, NEWS)
        stream = stateful.news_once(spark.readStream.schema(NEWS).parquet(f"{folder}/in"), "2 days")
        query = stateful.store_stream(stream, store, "news", f"{folder}/checkpoint")
        query.awaitTermination()
    assert stateful.late_rows(query) == 1
    batch = Warehouse(spark, str(tmp_path / "batch"))
    batch.append_new("news", spark.createDataFrame([r for r in first + second + third if r[3] != "l9"], NEWS))
    keys = lambda s: sorted((r.stock_code, r.news_link) for r in s.read("news").collect())
    assert keys(store) == keys(batch) == [("a", "l1"), ("a", "l2"), ("a", "l3"), ("a", "l4"), ("b", "l1")]


def test_daily_means_once_the_watermark_has_passed(spark, tmp_path):
    folder, store = str(tmp_path), Warehouse(spark, str(tmp_path / "store"))
    first = news(("a", 1, "l1", 0.5), ("a", 20, "l2", 0.0), ("b", 5, "l3", -1.0), ("a", 30, "l4", 0.25))
    second = news(("a", 23, "l5", 0.7), ("a", 80, "l6", 0.1))  # the day before, still within the watermark
    third = news(("b", 6, "l7", 1.0), ("a", 130, "l8", 0.1))  # three days late
    late = 0
    for part in (first, second, third):
        land(spark, f"{folder}/in", part, NEWS)
        means = stateful.daily_means(spark.readStream.schema(NEWS).parquet(f"{folder}/in"), "1 day")
        query = stateful.store_stream(means, store, "daily_sentiment", f"{folder}/checkpoint")
        query.awaitTermination()
        late += stateful.late_rows(query)
    want = daily_sentiment(spark.createDataFrame([r for r in first + second + third if r[3] != "l7"], NEWS)).filter("stock_date < '2026-07-05'")
    rows = lambda df: sorted((r.stock_code, r.stock_date, round(r.avg_sentiment, 9)) for r in df.collect())
    assert rows(store.read("daily_sentiment")) == rows(want) and len(rows(want)) == 4 and late == 1


class _Stored:
    """A state variable in memory that counts its calls."""

    def __init__(self):
        self.kept, self.calls = [], 0

    def __getattr__(self, name):
        def call(*given):
            self.calls += 1
            if name in ("appendValue", "put", "update"):
                self.kept = [*self.kept, given[0]] if name == "appendValue" else list(given[0])
            elif name == "clear":
                self.kept = []
            return {"exists": bool(self.kept), "get": self.kept}.get(name)
        return call


def test_rows_of_a_key_wait_in_pieces():
    """A state call is a round trip: their number does not follow the rows."""
    class Handle:
        stored, timers = {}, []

        def getValueState(self, name, _):
            return self.stored.setdefault(name, _Stored())

        getListState = getValueState

        def registerTimer(self, at):
            self.timers.append(at)

    class Timer:
        def getCurrentWatermarkInMs(self):
            return (START + dt.timedelta(days=2500) - dt.date(1970, 1, 1)).days * 86_400_000

    processor, handle = stateful.IndicatorProcessor(), Handle()
    processor.init(handle)
    piece = pd.DataFrame({"stock_code": "a", "stock_date": [START + dt.timedelta(days=i) for i in range(3000)], "stock_close": [float(i % 97) for i in range(3000)]})
    list(processor.handleInputRows(("a",), iter([piece[:1500], piece[1500:]]), None))
    out = pd.concat(list(processor.handleExpiredTimer(("a",), Timer(), None)))
    assert len(out) == 2501 and sum(s.calls for s in handle.stored.values()) < 20 and len(handle.timers) == 2
    assert out["ma20"].iloc[100] == pytest.approx(sum(i % 97 for i in range(81, 101)) / 20)

"""Indicators from stored states: the same values as over the whole history, however the days are cut."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from stockloom.operators import state
from stockloom.operators.indicators import INDICATORS, indicators, update_indicators
from stockloom.plans import screener, update
from stockloom.plans.update import append_daily, keep_latest
from stockloom.schemas import TABLES
from stockloom.sinks.warehouse import Warehouse

SCHEMA = "stock_code string, stock_date date, stock_close double"
START = dt.date(1999, 11, 20)


def series(seed=1, sizes=(("a", 420), ("b", 70), ("c", 4), ("d", 200))):
    """Closes with gaps, missing values and a series that starts late and is sparse."""
    rng, out = random.Random(seed), []
    for key, n in sizes:
        value = 100.0
        for i in range(n):
            value = max(1.0, value + rng.gauss(0, 1))
            day = START + dt.timedelta(days=i * 9 + 100 if key == "d" else i)
            out.append((key, day, None if i % 53 == 30 else round(value, 2)))
    return out


def by_day(df):
    return {(r.stock_code, r.stock_date): r for r in df.collect()}


def assert_same(got, want, keys=None):
    for k in keys or got:
        for name in INDICATORS:
            x, y = got[k][name], want[k][name]
            assert (x is None) == (y is None) and (x is None or float(x) == pytest.approx(float(y), abs=1e-7)), (k, name, x, y)


@pytest.mark.parametrize("cuts", [(6, 7, 30, 31, 200, 3_000), (60, 61, 3_000)])
def test_any_cut_gives_the_values_of_the_whole(spark, cuts):
    rows = spark.createDataFrame(series(), SCHEMA).cache()
    want = by_day(indicators(rows))
    states = spark.createDataFrame([], TABLES["indicator_state"].schema)
    first, seen = START, 0
    for cut in cuts:
        last = START + dt.timedelta(days=cut)
        done = state.advance(states, rows.filter((F.col("stock_date") >= F.lit(first)) & (F.col("stock_date") < F.lit(last))))
        got = by_day(done.indicators())
        assert_same(got, want, [k for k in got if k[0] != "c" or cut > 7])
        new = spark.createDataFrame(state.latest(done.checkpoints()).collect(), states.schema)
        states = spark.createDataFrame(new.unionByName(states.join(new, "stock_code", "left_anti")).collect(), states.schema)
        first, seen = last, seen + len(got)
    assert seen == len(want)
    end = {r.stock_code: r for r in states.collect()}
    for key, n in (("a", 420), ("b", 70), ("c", 4), ("d", 200)):
        own = [x for x in series() if x[0] == key]
        assert end[key].n_rows == n and end[key].last_day == own[-1][1]
        assert [(c.day, c.close) for c in end[key].closes] == [(d, v) for _, d, v in own[-60:]]


def history(spark, store):
    past = store.read("daily_metrics")
    return past.select("stock_code", "stock_date", F.col("stock_close").cast("double").alias("stock_close"))


def test_nights_with_late_repeated_and_broken_batches(spark, tmp_path, monkeypatch):
    """Each night's rows are those of the whole stored history and the batch; the states end as if all had come in order."""
    store = Warehouse(spark, str(tmp_path))
    rows = series(2, (("a", 300), ("b", 90)))
    late = {START + dt.timedelta(days=d) for d in (15, 20, 55, 60)}
    batches = [[r for r in rows if r[1] < START + dt.timedelta(days=80) and r[1] not in late],
               [r for r in rows if START + dt.timedelta(days=79) <= r[1] < START + dt.timedelta(days=120)],  # the last day once more
               [r for r in rows if r[1] in late and r[0] == "a"] + [r for r in rows if r[0] == "b" and r[1] >= START + dt.timedelta(days=79)],
               [r for r in rows if r[1] >= START + dt.timedelta(days=120) or r[1] in late]]
    for i, batch in enumerate(batches):
        df = spark.createDataFrame(batch, SCHEMA)
        before = spark.createDataFrame(history(spark, store).collect(), SCHEMA)
        known = {(r.stock_code, r.stock_date) for r in before.collect()}
        want = by_day(update_indicators(before, df))
        if i == 1:  # the run breaks off after the rows, before the states; the next one makes up for it
            with monkeypatch.context() as m:
                m.setattr(Warehouse, "upsert", lambda *_: (_ for _ in ()).throw(RuntimeError("gone")))
                with pytest.raises(RuntimeError):
                    append_daily(store, df)
        append_daily(store, df)
        got = by_day(store.read("daily_metrics"))
        new = [k for k in got if k not in known]
        assert {(r[0], r[1]) for r in batch} == {k for k in got if k in {(r[0], r[1]) for r in batch}}
        for k in new:
            for name in INDICATORS:
                x, y = got[k][name], want[k][name]
                assert (x is None) == (y is None) and (x is None or float(x) == pytest.approx(float(y), abs=0.0051)), (i, k, name)
    whole = state.latest(state.advance(spark.createDataFrame([], TABLES["indicator_state"].schema), spark.createDataFrame(rows, SCHEMA)).checkpoints())
    got, want = ({r.stock_code: r for r in df.collect()} for df in (store.read("indicator_state"), whole))
    for key in ("a", "b"):
        assert (got[key].n_rows, got[key].last_day, got[key].closes) == (want[key].n_rows, want[key].last_day, want[key].closes)
        for v in state.VALUES:
            assert got[key][v] == pytest.approx(want[key][v], abs=1e-9)
    view = {(r.stock_code, r.place): r.stock_date for r in store.read("latest_daily").collect()}
    for key in ("a", "b"):
        assert [view[key, p] for p in range(1, 11)] == sorted((r[1] for r in rows if r[0] == key), reverse=True)[:10]


def test_a_night_reads_no_stored_day(spark, tmp_path, monkeypatch):
    store = Warehouse(spark, str(tmp_path))
    rows = spark.createDataFrame(series(3, (("a", 200),)), SCHEMA)
    append_daily(store, rows.filter(F.col("stock_date") < F.lit(START + dt.timedelta(days=150))))
    read, asked = Warehouse.read, []
    monkeypatch.setattr(Warehouse, "read", lambda self, name, *a, **k: (asked.append(name), read(self, name, *a, **k))[1])
    append_daily(store, rows.filter(F.col("stock_date") >= F.lit(START + dt.timedelta(days=149))))
    assert "indicator_checkpoint" not in asked
    assert asked.count("daily_metrics") == 1  # the append's look at the keys of the touched years
    assert store.read("daily_metrics").count() == 200


def test_a_batch_is_gone_when_its_rows_are_appended(spark, tmp_path, monkeypatch):
    store, stages = Warehouse(spark, str(tmp_path)), []
    append = Warehouse.append_new
    monkeypatch.setattr(Warehouse, "append_new", lambda self, *a: (stages.extend(sorted(p.parts[-2:] for p in tmp_path.glob("_stage/*/*"))), append(self, *a))[1])
    append_daily(store, spark.createDataFrame(series(5, (("a", 80),)), SCHEMA))
    assert [(stage.split("-")[0], number) for stage, number in stages] == [("daily", "0")]
    assert os.listdir(tmp_path / "_stage") == [] and store.read("daily_metrics").count() == 80


def test_screener_over_the_latest_rows(spark, tmp_path):
    store = Warehouse(spark, str(tmp_path))
    rows = spark.createDataFrame(series(4, (("a", 120), ("b", 90))), SCHEMA).withColumns(
        {f"{n}_net_buy": F.dayofmonth("stock_date").cast("double") for n in ("foreign", "trust", "dealer")})
    append_daily(store, rows)
    keep_latest(store, rows.limit(0))
    facts = store.read("statement_fact")
    company = spark.createDataFrame([("a", "A"), ("b", "B")], "stock_code string, company_name string")
    over = [sorted(map(tuple, screener.factor_metrics(d, facts, company).collect()), key=str) for d in (store.read("daily_metrics"), store.read("latest_daily").drop("place"))]
    assert over[0] == over[1] and len(over[0]) == 2


def test_latest_rows_merge_few_rows_of_a_batch(spark, tmp_path, monkeypatch):
    store, merged, start = Warehouse(spark, str(tmp_path / "store")), [], dt.date(2026, 1, 1)
    union = update.union_keep_first
    monkeypatch.setattr(update, "union_keep_first", lambda frames, keys: (merged.append(frames[1].count()), union(frames, keys))[1])
    days = [start + dt.timedelta(days=i) for i in range(200)]
    rows = [("a", d, float(i)) for i, d in enumerate(days)] + [("a", days[199], 900.0), ("b", None, 5.0), ("b", days[0], 1.0)]
    batch = spark.createDataFrame(rows, "stock_code string, stock_date date, stock_close double")
    update.keep_latest(store, batch)
    update.keep_latest(store, batch.filter("stock_close < 195"))
    got = {(r.stock_code, r.place): (r.stock_date, float(r.stock_close)) for r in store.read("latest_daily").collect()}
    want = {("a", 10 - i): (days[190 + i], 190.0 + i) for i in range(10)} | {("b", 1): (days[0], 1.0), ("b", 2): (None, 5.0)}
    assert got == want and merged == [13, 12]

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from stockloom.operators.indicators import INDICATORS, indicators, update_indicators
from stockloom.operators.series import SeriesLayout, distribute

SCHEMA = "stock_code string, stock_date date, stock_close double"
START = dt.date(1950, 1, 1)
LAYOUT = SeriesLayout()
SMALL = SeriesLayout(bucket_days=128, stretch_rows=1024, block_rows=1024)


def frame(spark, series, step=1):
    rows = [(key, START + dt.timedelta(days=i * step), float(c)) for key, closes in series.items()
            for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, SCHEMA)


def by_key(df):
    out = {}
    for r in df.orderBy("stock_code", "stock_date").collect():
        out.setdefault(r["stock_code"], []).append(r)
    return out


def walk(n, seed):
    rng, value, out = random.Random(seed), 100.0, []
    for _ in range(n):
        value = max(1.0, value + rng.gauss(0, 1))
        out.append(round(value, 2))
    return out


def expected(closes):
    """The indicators row by row, as the definitions read."""
    n = len(closes)
    if n < 5:
        return [(None, None, 50.0, 50.0, None, None)] * n
    out, k, d, fast, slow, signal = [], 50.0, 50.0, closes[0], closes[0], 0.0
    for i, c in enumerate(closes):
        mean = lambda w: math.fsum(closes[i - w + 1:i + 1]) / w if i >= w - 1 else None
        frame9 = closes[i - 8:i + 1] if i >= 8 else None
        rsv = 50.0 if not frame9 or max(frame9) == min(frame9) else (c - min(frame9)) / (max(frame9) - min(frame9)) * 100
        k = rsv / 3 + k * 2 / 3
        d = k / 3 + d * 2 / 3
        moves = [closes[j] - closes[j - 1] if j else 0.0 for j in range(i - 13, i + 1)] if i >= 13 else []
        gain, loss = math.fsum(m for m in moves if m > 0), math.fsum(-m for m in moves if m < 0)
        rsi = 100 - 100 / (1 + gain / loss) if loss > 0 else 0.0
        if i:
            fast, slow = fast + (c - fast) * 2 / 13, slow + (c - slow) * 2 / 27
            signal += (fast - slow - signal) * 2 / 10
        out.append((mean(20), mean(60), k, d, rsi, fast - slow - signal))
    return out


@pytest.mark.parametrize("layout", [LAYOUT, SMALL], ids=["default", "small"])
def test_matches_row_by_row_definitions(spark, layout):
    series = {f"n{n}": walk(n, n) for n in (1, 4, 5, 19, 60, 511, 1024, 1025, 2600)} | {"long": walk(20000, 7)}
    got = by_key(indicators(frame(spark, series), layout=layout))
    for key, closes in series.items():
        assert len(got[key]) == len(closes)
        for row, want in zip(got[key], expected(closes)):
            for name, value in zip(INDICATORS, want):
                assert (row[name] is None) == (value is None), (key, name, row)
                assert value is None or row[name] == pytest.approx(value, abs=1e-9), (key, name, row)


@pytest.mark.parametrize("layout", [LAYOUT, SMALL], ids=["default", "small"])
def test_sparse_series(spark, layout):
    closes = walk(1500, 3)
    got = by_key(indicators(frame(spark, {"a": closes}, step=40), layout=layout))["a"]
    for row, want in zip(got, expected(closes)):
        assert row["d_value"] == pytest.approx(want[3], abs=1e-9)
        assert row["macd_hist"] == pytest.approx(want[5], abs=1e-9)


def test_all_rising_and_one_drop(spark):
    rising = [100.0 + i for i in range(17)]
    drop = list(rising)
    drop[8] = 90.0
    got = by_key(indicators(frame(spark, {"up": rising, "drop": drop})))
    assert [r["rsi14"] for r in got["up"]] == [0.0] * 17
    assert [r["rsi14"] for r in got["drop"]][:13] == [0.0] * 13
    assert got["drop"][13]["rsi14"] == pytest.approx(63.8298, abs=1e-4)
    assert got["drop"][14]["rsi14"] == pytest.approx(64.5833, abs=1e-4)


def test_flat_series_stays_neutral(spark):
    got = by_key(indicators(frame(spark, {"flat": [10.0] * 10})))["flat"]
    assert all(r["k_value"] == pytest.approx(50) and r["d_value"] == pytest.approx(50) for r in got)
    assert all(r["macd_hist"] == pytest.approx(0) for r in got)


def test_rsi_undefined_can_be_null(spark):
    got = by_key(indicators(frame(spark, {"up": [100.0 + i for i in range(17)]}), rsi_undefined=None))["up"]
    assert all(r["rsi14"] is None for r in got)


def test_average_is_null_while_a_close_is_missing(spark):
    df = frame(spark, {"a": [100.0 + i for i in range(50)]})
    gap = F.when(F.col("stock_date") == F.lit(START + dt.timedelta(days=25)), None).otherwise(F.col("stock_close"))
    got = by_key(indicators(df.withColumn("stock_close", gap)))["a"]
    assert got[24]["ma20"] is not None and got[45]["ma20"] is not None
    assert all(got[i]["ma20"] is None for i in range(25, 45))


def test_not_a_number_is_a_missing_close(spark):
    closes = [100.0 + i for i in range(50)]
    closes[25] = float("nan")
    got = by_key(indicators(frame(spark, {"a": closes})))["a"]
    assert got[25]["stock_close"] is None and got[44]["ma20"] is None and got[45]["ma20"] is not None
    assert all(r["macd_hist"] == r["macd_hist"] and r["k_value"] == r["k_value"] for r in got)


def test_empty_series(spark):
    assert indicators(spark.createDataFrame([], SCHEMA)).count() == 0


def test_synthetic_series_in_bounds(spark):
    closes = [100 + 0.5 * i + 5 * math.sin(i) for i in range(70)]
    got = by_key(indicators(frame(spark, {"s": closes})))["s"]
    assert got[25]["ma20"] is not None and got[65]["ma60"] is not None
    assert got[20]["rsi14"] is not None and got[40]["macd_hist"] is not None
    assert all(0 <= r[n] <= 100 for r in got for n in ("k_value", "d_value", "rsi14"))


def test_update_equals_recomputation_and_history_wins(spark):
    closes = walk(300, 11)
    full = frame(spark, {"a": closes})
    cut = START + dt.timedelta(days=200)
    history = full.filter(F.col("stock_date") <= F.lit(cut))
    batch = full.filter(F.col("stock_date") >= F.lit(cut)).withColumn(
        "stock_close", F.when(F.col("stock_date") == F.lit(cut), 1.0).otherwise(F.col("stock_close")))
    got = by_key(update_indicators(history, batch))["a"]
    assert len(got) == 100 and got[0]["stock_close"] == closes[200]
    for row, want in zip(got, expected(closes)[200:]):
        assert row["k_value"] == pytest.approx(want[2], abs=1e-9)
    tail = by_key(update_indicators(history, batch, tail_rows=65))["a"]
    for row, want in zip(tail, expected(closes[136:])[64:]):
        assert row["k_value"] == pytest.approx(want[2], abs=1e-9)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_series_are_distributed_by_block_without_python(spark):
    plan = plan_of(indicators(frame(spark, {"a": [1.0] * 10})))
    assert "hashpartitioning(stock_code" in plan and "__block" in plan
    assert "Python" not in plan and "MapInPandas" not in plan
    spread = indicators(frame(spark, {"hot": walk(40000, 5)}), ["ma20"])
    assert spread.count() == 40000


def test_layout_is_checked():
    with pytest.raises(ValueError):
        SeriesLayout(block_rows=512)
    for wrong in ({"block_rows": 8000}, {"stretch_rows": 512}, {"stretch_rows": 4096}, {"lead_rows": 100}):
        with pytest.raises(ValueError):
            SeriesLayout(**wrong)


def test_no_block_of_a_dominant_key_outgrows_its_bound(spark):
    days = spark.range(60000).selectExpr("'hot' AS stock_code", "date_add(DATE'1900-01-01', cast(id AS int)) AS stock_date",
                                         "cast(id % 17 AS double) AS stock_close")
    cold = spark.range(100).selectExpr("cast(id AS string) AS stock_code", "DATE'2000-01-01' AS stock_date", "1D AS stock_close")
    series = distribute(days.unionByName(cold), LAYOUT)
    sizes = [r["count"] for r in series.df.groupBy("stock_code", "__block").count().filter("stock_code = 'hot'").collect()]
    assert len(sizes) == 8 and max(sizes) <= LAYOUT.block_rows + LAYOUT.lead_rows + 2 * LAYOUT.bucket_days
    own = series.df.filter("__block = __home")
    assert own.count() == 60100

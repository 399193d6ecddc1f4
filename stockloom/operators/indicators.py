"""Technical indicators of daily close series, for all keys at once.

Each family of indicators is a list of steps over distributed series, a step being
columns that only need the steps before it; :func:`indicators` runs the families
side by side. Frames count rows, not days: an average over 20 rows is NULL until 20
rows are there, and also while one of them is NULL.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window, functions as F

from stockloom import constants as C
from stockloom.operators.keyed import latest_rows
from stockloom.operators.recurrence import Smoothing, carry_steps, position_steps, row_steps
from stockloom.operators.series import LENGTH, ROW, Series, SeriesLayout, distribute

INDICATORS = ["ma20", "ma60", "k_value", "d_value", "rsi14", "macd_hist"]

Steps = list[dict[str, Column]]

_NEW, _RANK, _TOUCHED = "__new", "__rank", "__touched"


def moving_average_steps(series: Series, value: str = "stock_close") -> Steps:
    """Means over 20 and 60 rows; the long sum is put together from three short ones."""
    short = series.rows_back(C.MA_SHORT)
    before = [F.lag("sum20", C.MA_SHORT * i).over(series.ordered()) for i in range(1, C.MA_LONG // C.MA_SHORT)]
    return [
        {"n20": F.count(value).over(short), "total20": F.sum(value).over(short)},
        {"sum20": F.when(F.col("n20") == C.MA_SHORT, F.col("total20"))},
        {f"sum20_{i}": earlier for i, earlier in enumerate(before)},
        {"ma20": F.col("sum20") / C.MA_SHORT,
         "ma60": reduce(add, [F.col(f"sum20_{i}") for i in range(len(before))], F.col("sum20")) / C.MA_LONG},
    ]


@dataclass(frozen=True)
class Start:
    """Columns with the values before the first new row, for series that begin with rows known already.

    ``lead`` counts the rows that are only there for the frames of the others; ``fresh``
    says that nothing came before.
    """

    lead: Column
    fresh: Column
    k: Column
    d: Column
    fast: Column
    slow: Column
    signal: Column

    def steps(self) -> Column:
        return row_steps() - self.lead

    def new(self, value: Column) -> Column:
        """``value`` where a recurrence runs, nothing in the rows before."""
        return F.when(F.col(ROW) >= self.lead, value).otherwise(F.lit(0.0))


def stochastic_steps(series: Series, value: str = "stock_close", start: Start | None = None) -> Steps:
    """K smooths the raw stochastic by thirds, D smooths K; both start from 50 if nothing else is given.

    The raw value is the place of the close in its 9-row range, 0-100, and 50
    where there is no range or no full frame.
    """
    third = Smoothing(1.0 / 3.0)
    frame = series.rows_back(C.STOCHASTIC_ROWS)
    place = F.try_divide(F.col(value) - F.col("low9"), F.col("high9") - F.col("low9")) * 100
    seed = C.STOCHASTIC_NEUTRAL
    raw = F.coalesce(F.when(F.col("n9") == C.STOCHASTIC_ROWS, place), F.lit(seed))
    k0, d0, since = (F.lit(seed), F.lit(seed), row_steps()) if start is None else (start.k, start.d, start.steps())
    return [
        {"n9": F.count(value).over(frame), "low9": F.min(value).over(frame), "high9": F.max(value).over(frame),
         **series.numbered()},
        {"rsv": raw if start is None else start.new(raw)},
        {"k_local": third.local(series, F.col("rsv"))},
        {"d_local": third.local(series, F.col("k_local"))},
        *carry_steps(series, {"k_carry": "k_local", "d_carry": "d_local"}),
        {"k_value": F.col("k_local") + third.faded(F.col("k_carry")) + third.faded_seed(k0, since),
         "d_value": F.col("d_local") + third.faded(F.col("d_carry"))
         + third.fed_by_equal(F.col("k_carry"), position_steps())
         + third.faded_seed(d0, since) + third.fed_by_equal(k0, since)},
    ]


def relative_strength_steps(series: Series, value: str = "stock_close",
                            undefined: float | None = 0.0) -> Steps:
    """RSI over 14 rows. ``undefined`` is its value without a full frame or a loss."""
    frame = series.rows_back(C.RSI_ROWS)
    delta = F.col("delta")
    strength = 100 - 100 / (1 + F.try_divide(F.col("gain14"), F.col("loss14")))
    return [
        {"delta": F.col(value) - F.lag(value).over(series.ordered()), **series.numbered()},
        {"gain": F.when(delta > 0, delta).otherwise(F.lit(0.0)),
         "loss": F.when(delta < 0, -delta).otherwise(F.lit(0.0))},
        {"gain14": F.sum("gain").over(frame), "loss14": F.sum("loss").over(frame)},
        {"rsi14": F.coalesce(F.when(row_steps() >= C.RSI_ROWS, strength), F.lit(undefined).cast("double"))},
    ]


def macd_steps(series: Series, value: str = "stock_close", start: Start | None = None) -> Steps:
    """Histogram of the 12/26 exponential mean difference against its 9-row mean.

    A missing close counts as 0, as it does in the assembled daily rows.
    """
    fast, slow, signal = (Smoothing.of_span(n) for n in (C.EMA_FAST, C.EMA_SLOW, C.EMA_SIGNAL))
    close = F.coalesce(F.col(value), F.lit(0.0))
    first: bool | Column = True
    before: list[dict[str, Column]] = []
    if start is not None:
        close, first, since = start.new(close), start.fresh, start.steps()
        before = [{"fast_before": fast.faded_seed(start.fast, since), "slow_before": slow.faded_seed(start.slow, since),
                   "signal_before": signal.faded_seed(start.signal, since) + signal.fed_by(fast, start.fast, since) - signal.fed_by(slow, start.slow, since)}]

    def whole(name: str, value: Column) -> Column:
        return value + F.col(f"{name}_before") if start is not None else value

    fast_carry, slow_carry = F.col("fast_carry"), F.col("slow_carry")
    return [
        series.numbered(),
        {},
        {"fast_local": fast.local(series, close, from_first_value=first),
         "slow_local": slow.local(series, close, from_first_value=first)},
        {"signal_local": signal.local(series, F.col("fast_local") - F.col("slow_local"))},
        *carry_steps(series, {"fast_carry": "fast_local", "slow_carry": "slow_local",
                              "signal_carry": "signal_local"}),
        *before,
        {"ema_fast": whole("fast", F.col("fast_local") + fast.faded(fast_carry)),
         "ema_slow": whole("slow", F.col("slow_local") + slow.faded(slow_carry)),
         "macd_signal": whole("signal", F.col("signal_local") + signal.faded(F.col("signal_carry"))
                              + signal.fed_by(fast, fast_carry) - signal.fed_by(slow, slow_carry))},
        {"macd": F.col("ema_fast") - F.col("ema_slow")},
        {"macd_hist": F.col("macd") - F.col("macd_signal")},
    ]


_FAMILIES = {
    "ma20": moving_average_steps, "ma60": moving_average_steps,
    "k_value": stochastic_steps, "d_value": stochastic_steps,
    "rsi14": relative_strength_steps, "macd_hist": macd_steps,
}


def indicators(prices: DataFrame, names: list[str] = INDICATORS,
               layout: SeriesLayout = SeriesLayout(), rsi_undefined: float | None = 0.0) -> DataFrame:
    """``prices`` (one row per key and day, ``stock_close``) with the named indicators.

    A series of fewer than five rows has none: averages, RSI and MACD are NULL
    and K and D stay at 50.
    """
    columns = [c for c in prices.columns if c not in INDICATORS]
    close = F.nanvl(F.col("stock_close").cast("double"), F.lit(None).cast("double"))
    source = prices.select(*columns).withColumn("stock_close", close)
    series = distribute(source, layout)
    plans = [family(series, undefined=rsi_undefined) if family is relative_strength_steps else family(series)
             for family in dict.fromkeys(_FAMILIES[n] for n in names)]
    enough = F.col(LENGTH) >= C.SHORT_SERIES_ROWS
    neutral = {"k_value": F.lit(C.STOCHASTIC_NEUTRAL), "d_value": F.lit(C.STOCHASTIC_NEUTRAL)}
    return series.add_steps(*plans).finish(columns + [
        F.when(enough, F.col(name)).otherwise(neutral.get(name, F.lit(None))).alias(name)
        for name in names])


def update_indicators(history: DataFrame, batch: DataFrame, tail_rows: int | None = None,
                      layout: SeriesLayout = SeriesLayout()) -> DataFrame:
    """Indicators of the batch's days, computed over history and batch together.

    Each side has one row per key and day; the history's row wins where both have
    one. By default the whole history is used, so results do not depend on how the
    days were cut into batches; ``tail_rows`` limits it to the latest rows of each key.
    """
    key, day = layout.key, layout.day
    base = [c for c in batch.columns if c not in INDICATORS]
    past = history.select(*base)
    if tail_rows:
        past = latest_rows(past, [key], [day], tail_rows)
    both = past.withColumn(_NEW, F.lit(False)).unionByName(batch.select(*base).withColumn(_NEW, F.lit(True)))
    both = both.repartition(key, day)
    of_day = Window.partitionBy(key, day).orderBy(_NEW)
    merged = both.withColumns({
        _RANK: F.row_number().over(of_day),
        _TOUCHED: F.max(_NEW).over(of_day.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
    }).filter(F.col(_RANK) == 1).drop(_NEW, _RANK)
    return indicators(merged, layout=layout).filter(_TOUCHED).drop(_TOUCHED)

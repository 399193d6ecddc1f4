"""Streams that keep their own state: indicators by key, news once, and daily means.

All three are bounded by a watermark on event time. What comes later than it allows is
left out by the engine and counted (:func:`late_rows`); the batch loads take such rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from stockloom.constants import (EMA_FAST, EMA_SIGNAL, EMA_SLOW, MA_LONG, MA_SHORT, RSI_ROWS, SHORT_SERIES_ROWS,
                                 STOCHASTIC_NEUTRAL, STOCHASTIC_ROWS)
from stockloom.operators.indicators import INDICATORS
from stockloom.sinks.warehouse import Warehouse

#: State of many keys does not fit the heap of an executor; this store keeps it on disk.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
OUTPUT = "stock_code string, stock_date date, stock_close double, " + ", ".join(f"{n} double" for n in INDICATORS)
_VALUES = "n_rows bigint, k_state double, d_state double, ema_fast double, ema_slow double, ema_signal double, closes binary"
#: A row that waits or is looked back on, and how many of them a piece holds at most.
_PAIR = np.dtype([("day", "<i4"), ("close", "<f8")])
_PIECE = 10_000


def _milliseconds(day: int) -> int:
    return day * 86_400_000


def _days(dates: pd.Series) -> np.ndarray:
    """Dates as days since 1970."""
    return dates.to_numpy().astype("datetime64[D]").astype(np.int32)


def _packed(days: np.ndarray, closes: np.ndarray) -> bytes:
    """Days and closes (NaN: missing) as one state value."""
    out = np.empty(len(days), _PAIR)
    out["day"], out["close"] = days, closes
    return out.tobytes()


class IndicatorProcessor(StatefulProcessor):
    """Indicators of each key's closes, in the order of the days.

    Rows wait in a list until the watermark has passed their day; a timer on that day
    then lets them through, so files may come in any order within the watermark. A day
    that repeats keeps its first row. The first rows of a key come out with its fifth: a
    shorter series has no indicators. The running values and the closes that frames look
    back on, at most 60, are one value; of a shorter series these are all its rows.

    Rows travel and wait in packed pieces, as each call to the state store is a round trip.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.values = handle.getValueState("running", _VALUES)
        self.waiting = handle.getListState("pieces", "rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for piece in rows:
            days = _days(piece["stock_date"])
            self.waiting.appendValue((_packed(days, piece["stock_close"].to_numpy(dtype=float)),))
            first = int(days.min()) if first is None else min(first, int(days.min()))
        self.wake(first)
        return iter([])

    def wake(self, day: int) -> None:
        """Timers of times before the watermark fire; that of the last day must not wait for another one."""
        self.handle.registerTimer(_milliseconds(day) - 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Lets all rows through whose day the watermark has reached; one timer waits for the first of the others."""
        last_day = timerValues.getCurrentWatermarkInMs() // _milliseconds(1)
        pieces = [np.frombuffer(r[0], _PAIR) for r in self.waiting.get()] if self.waiting.exists() else []
        waiting = np.concatenate(pieces) if pieces else np.empty(0, _PAIR)
        is_ready = waiting["day"] <= last_day
        if not is_ready.any():
            return
        later = waiting[~is_ready]
        if len(later):
            self.waiting.put([(later[i:i + _PIECE].tobytes(),) for i in range(0, len(later), _PIECE)])
            self.wake(int(later["day"].min()))
        else:
            self.waiting.clear()
        ready = waiting[is_ready]
        ready = ready[np.unique(ready["day"], return_index=True)[1]]  # of each day the first, by day
        if self.values.exists():
            *values, known = self.values.get()
            before = np.frombuffer(known, _PAIR)
        else:
            values, before = [0, STOCHASTIC_NEUTRAL, STOCHASTIC_NEUTRAL, 0.0, 0.0, 0.0], np.empty(0, _PAIR)
        if len(before):
            ready = ready[ready["day"] > before["day"][-1]]
        for i in range(0, len(ready), _PIECE):
            new = ready[i:i + _PIECE]
            held, shown = values[0], self.steps(values, before["close"], new["close"])
            rows = np.concatenate([before, new])
            if held < SHORT_SERIES_ROWS <= values[0]:  # the first rows come out with the fifth
                self.early(rows[:held], shown)
            if values[0] >= SHORT_SERIES_ROWS:
                out = rows if held < SHORT_SERIES_ROWS else new
                yield pd.DataFrame({"stock_code": key[0], "stock_date": out["day"].astype("datetime64[D]").astype(object), "stock_close": out["close"], **shown})
            before = rows[-MA_LONG:]
        self.values.update((*values, before.tobytes()))

    def early(self, rows: np.ndarray, shown: dict[str, np.ndarray]) -> None:
        """Puts the indicators of the rows that were held back in front: worked out again, as they are few."""
        if len(rows):
            held = self.steps([0, STOCHASTIC_NEUTRAL, STOCHASTIC_NEUTRAL, 0.0, 0.0, 0.0], np.empty(0), rows["close"])
            for name in INDICATORS:
                shown[name] = np.concatenate([held[name], shown[name]])

    def steps(self, values: list, before: np.ndarray, closes: np.ndarray) -> dict[str, np.ndarray]:
        """Takes the running values on by some closes after known ones; the indicators of their days, NaN where there are none."""
        start, series = len(before), np.concatenate([before, closes])

        def frames(of: np.ndarray, rows: int, fill: float) -> np.ndarray:
            """The frames of so many rows that end with the new ones, filled up in front."""
            return sliding_window_view(np.concatenate([np.full(rows - 1, fill), of]), rows)[start:]

        frame = frames(series, STOCHASTIC_ROWS, np.nan)
        low, high = frame.min(axis=1), frame.max(axis=1)  # NaN unless the frame is whole
        spread = high - low
        raw = np.where(spread > 0, (closes - low) / np.where(spread > 0, spread, 1.0) * 100, STOCHASTIC_NEUTRAL)
        n, k, d, fast, slow, signal = values
        k_values, d_values, hist = [], [], []
        for r, close in zip(raw.tolist(), np.nan_to_num(closes).tolist()):
            n += 1
            k = r / 3 + k * 2 / 3
            d = k / 3 + d * 2 / 3
            if n == 1:
                fast = slow = close
            else:
                fast += (close - fast) * 2 / (EMA_FAST + 1)
                slow += (close - slow) * 2 / (EMA_SLOW + 1)
                signal += (fast - slow - signal) * 2 / (EMA_SIGNAL + 1)
            k_values.append(k)
            d_values.append(d)
            hist.append(fast - slow - signal)
        moves = np.nan_to_num(np.diff(series, prepend=np.nan))
        gain = frames(np.maximum(moves, 0.0), RSI_ROWS, 0.0).sum(axis=1)
        loss = frames(np.maximum(-moves, 0.0), RSI_ROWS, 0.0).sum(axis=1)
        defined = (values[0] + np.arange(1, len(closes) + 1) >= RSI_ROWS) & (loss > 0)
        strength = np.where(defined, 100 - 100 / (1 + gain / np.where(loss > 0, loss, 1.0)), 0.0)
        values[:] = [n, k, d, fast, slow, signal]
        return {"ma20": frames(series, MA_SHORT, np.nan).sum(axis=1) / MA_SHORT, "ma60": frames(series, MA_LONG, np.nan).sum(axis=1) / MA_LONG,
                "k_value": np.array(k_values), "d_value": np.array(d_values), "rsi14": strength, "macd_hist": np.array(hist)}

    def close(self) -> None:
        pass


def indicator_stream(prices: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """Indicators of a stream of closes (stock_code, stock_date, stock_close), each day once.

    A day comes out when the watermark, the greatest day so far less ``delay``, has reached
    it; by then all its rows and those before must have come.
    """
    rows = prices.select("stock_code", "stock_date", F.col("stock_close").cast("double").alias("stock_close"),
                         F.col("stock_date").cast("timestamp").alias("event_time")).withWatermark("event_time", delay)
    # The processor travels whole: it also runs in a helper process that has no library path.
    own = sys.modules[__name__]
    cloudpickle.register_pickle_by_value(own)
    try:
        return rows.groupBy("stock_code").transformWithStateInPandas(
            statefulProcessor=IndicatorProcessor(), outputStructType=OUTPUT, outputMode="append", timeMode="eventTime")
    finally:
        cloudpickle.unregister_pickle_by_value(own)


def news_once(rows: DataFrame, delay: str = "7 days") -> DataFrame:
    """News rows, one for each key and link, with a state that is bounded by ``delay``.

    Repeats must come within ``delay`` of each other's publication. A row without a time has none
    to be late by: it counts as the epoch and is left out like any row beyond the watermark.
    """
    timed = rows.withColumn("publish_time", F.coalesce("publish_time", F.timestamp_seconds(F.lit(0))))
    return timed.withWatermark("publish_time", delay).dropDuplicatesWithinWatermark(["stock_code", "news_link"])


def daily_means(rows: DataFrame, delay: str = "1 day") -> DataFrame:
    """Mean score per key and day, in tumbling windows; a day comes out once, when the watermark has passed it."""
    means = (rows.withWatermark("publish_time", delay).groupBy(F.window("publish_time", "1 day").alias("of"), "stock_code")
             .agg(F.avg(F.col("sentiment_score").cast("double")).alias("avg_sentiment")))
    return means.select("stock_code", F.to_date("of.start").alias("stock_date"), "avg_sentiment")


def store_stream(rows: DataFrame, store: Warehouse, table: str, checkpoint: str, follow: bool = False) -> StreamingQuery:
    """Write a stream of finished rows to a stored table; a batch that is replayed changes nothing."""
    def load(batch: DataFrame, _: int) -> None:
        store.append_new(table, batch)

    writer = rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(load)
    return (writer if follow else writer.trigger(availableNow=True)).start()


def late_rows(query: StreamingQuery) -> int:
    """Rows that came beyond the watermark in the batches the query still knows of, and were left out."""
    return sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"])

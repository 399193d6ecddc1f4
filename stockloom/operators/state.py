"""Indicators from a stored state of each key, so that a batch costs the batch.

K, D and the exponential means are first-order recurrences: a batch maps the values
before it to those after it by an affine map, ``y -> a*y + b``, and maps of consecutive
pieces compose. The running sums of ``recurrence`` are these maps, block by block; here
they are applied to the stored values of a key instead of the seeds. Everything else
looks back at most 60 rows. A state is therefore

* the last day and the number of rows,
* K, D, the fast and the slow exponential mean and the signal,
* the last 60 closes with their days.

Beside its latest state a key has a checkpoint for each year, the state after the year's
last row. A row that comes late starts its key again from the checkpoint before its year,
over the stored rows since then, so not even then old years are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from stockloom import constants as C
from stockloom.operators.indicators import (INDICATORS, Start, macd_steps, moving_average_steps,
                                            relative_strength_steps, stochastic_steps)
from stockloom.operators.recurrence import row_steps
from stockloom.operators.series import LENGTH, ROW, SeriesLayout, distribute

VALUES = ["k_state", "d_state", "ema_fast", "ema_slow", "ema_signal"]
STATE = ["last_day", "n_rows", *VALUES, "closes"]
NEW, YEAR = "__new", "state_year"
_KNOWN, _STARTS = "__known", "__start_values"


@dataclass(frozen=True)
class Advanced:
    """Rows of a batch with their indicators and running values, and the rows before them that frames need."""

    rows: DataFrame
    base: list[str]

    def indicators(self) -> DataFrame:
        """The new rows with their indicators."""
        return self.rows.filter(F.col(NEW)).select(*self.base, *INDICATORS)

    def checkpoints(self) -> DataFrame:
        """stock_code, state_year and the state after the last row of each year there are rows of, known ones included."""
        key, day = "stock_code", "stock_date"
        own = self.rows.filter(~F.col(_KNOWN)).withColumn(YEAR, F.year(day))
        ends = own.groupBy(key, YEAR).agg(
            F.max(ROW).alias("last_row"), F.max(day).alias("last_day"),
            F.max_by(F.struct("n_rows", *VALUES), day).alias("v")).select(key, YEAR, "last_row", "last_day", "v.*")
        # Few for each key: its years. A row is given to the checkpoints that still see it.
        of_key = ends.groupBy(key).agg(F.collect_list(F.struct(YEAR, "last_row")).alias("ends"))
        sees = F.filter("ends", lambda e: (F.col(ROW) <= e["last_row"]) & (F.col(ROW) > e["last_row"] - C.MA_LONG))
        closes = (self.rows.select(key, day, "stock_close", ROW).join(of_key, key)
                  .select(key, F.explode(sees).alias("e"), F.struct(F.col(day).alias("day"), F.col("stock_close").alias("close")).alias("c"))
                  .groupBy(key, F.col(f"e.{YEAR}").alias(YEAR)).agg(F.sort_array(F.collect_list("c")).alias("closes")))
        return ends.drop("last_row").join(closes, [key, YEAR]).select(key, YEAR, *STATE)


def as_stored(close: Column) -> Column:
    """A close as the tables hold it, so that a value is the same from a batch and from the table; NaN is missing."""
    number = close.cast("double")
    return F.nanvl(number, F.lit(None).cast("double")).cast("decimal(38,2)").cast("double")


def advance(states: DataFrame, rows: DataFrame, layout: SeriesLayout = SeriesLayout(), rsi_undefined: float | None = 0.0) -> Advanced:
    """Indicators of ``rows`` (one per key and day, after the key's state if there is one).

    ``rows`` may have a boolean column ``__new``; only rows where it holds come out again.
    """
    key, day = layout.key, layout.day
    if NEW not in rows.columns:
        rows = rows.withColumn(NEW, F.lit(True))
    base = [c for c in rows.columns if c not in (*INDICATORS, NEW)]
    values = F.struct(F.size("closes").alias("lead"), F.col("n_rows").alias("before"), *VALUES).alias(_STARTS)
    known = states.join(rows.select(key).distinct(), key, "left_semi")
    new = (rows.select(*base, NEW).withColumns({"stock_close": as_stored(F.col("stock_close")), _KNOWN: F.lit(False)})
           .join(known.select(key, values), key, "left"))
    lead = known.select(key, values, F.explode("closes").alias("c")).select(
        key, F.col("c.day").alias(day), F.col("c.close").alias("stock_close"), _STARTS, F.lit(False).alias(NEW), F.lit(True).alias(_KNOWN))
    series = distribute(new.unionByName(lead, allowMissingColumns=True), layout)

    def before(name: str, otherwise: float) -> Column:
        return F.coalesce(F.col(f"{_STARTS}.{name}"), F.lit(otherwise))

    neutral = C.STOCHASTIC_NEUTRAL
    start = Start(lead=before("lead", 0), fresh=F.col(_STARTS).isNull(), k=before("k_state", neutral), d=before("d_state", neutral),
                  fast=before("ema_fast", 0.0), slow=before("ema_slow", 0.0), signal=before("ema_signal", 0.0))
    done = series.add_steps(moving_average_steps(series), stochastic_steps(series, start=start),
                            relative_strength_steps(series, undefined=rsi_undefined), macd_steps(series, start=start))
    enough = F.col(LENGTH) >= C.SHORT_SERIES_ROWS
    shown = {"k_value": F.lit(neutral), "d_value": F.lit(neutral)}
    return Advanced(done.finish([
        *base, NEW, _KNOWN, F.col(ROW).alias(ROW), (row_steps() - start.lead + before("before", 0)).cast("bigint").alias("n_rows"),
        F.col("k_value").alias("k_state"), F.col("d_value").alias("d_state"), "ema_fast", "ema_slow", F.col("macd_signal").alias("ema_signal"),
        *[F.when(enough, F.col(n)).otherwise(shown.get(n, F.lit(None))).alias(n) for n in INDICATORS]]), base)


def latest(checkpoints: DataFrame) -> DataFrame:
    """Each key's state after all its rows."""
    return checkpoints.groupBy("stock_code").agg(F.max_by(F.struct(*STATE), YEAR).alias("s")).select("stock_code", "s.*")


def late_keys(states: DataFrame, marks: DataFrame, batch: DataFrame) -> DataFrame:
    """stock_code, first: keys that have to start from a checkpoint, and the day from which on.

    Those are keys with batch rows on or before the last day of their state, and keys
    whose state is not that of the greatest stored day (a run broke off between the two).
    """
    first = batch.groupBy("stock_code").agg(F.min("stock_date").alias("first"))
    both = first.join(states.select("stock_code", "last_day"), "stock_code", "left").join(marks.select("stock_code", "latest"), "stock_code", "left")
    behind = ~F.col("last_day").eqNullSafe(F.col("latest"))
    from_day = F.least("first", F.when(behind, F.least(F.coalesce("last_day", F.lit("0001-01-01").cast("date")), F.coalesce("latest", "first"))))
    return both.filter(behind | (F.col("first") <= F.col("last_day"))).select("stock_code", from_day.alias("first"))


def replayed(late: DataFrame, stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Stored rows of late keys from the year of their first day on, with the batch's; the stored row of a day wins.

    ``__new`` marks the days the batch has a row of.
    """
    base = [c for c in batch.columns if c not in INDICATORS]
    since = late.select("stock_code", F.year("first").alias("first_year"))
    past = stored.join(since, "stock_code").filter(F.year("stock_date") >= F.col("first_year")).select(*base)
    both = past.withColumn(NEW, F.lit(False)).unionByName(batch.join(since, "stock_code", "left_semi").select(*base).withColumn(NEW, F.lit(True)))
    of_day = Window.partitionBy("stock_code", "stock_date").orderBy(NEW)
    whole = of_day.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = both.repartition("stock_code", "stock_date").withColumns({"__rank": F.row_number().over(of_day), "__touched": F.max(NEW).over(whole)})
    return ranked.filter("__rank = 1").select(*base, F.col("__touched").alias(NEW))


def states_before(late: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Of each late key the last checkpoint before the year of its first day, if any."""
    since = late.select("stock_code", F.year("first").alias("first_year"))
    earlier = checkpoints.join(since, "stock_code").filter(F.col(YEAR) < F.col("first_year"))
    return latest(earlier.select("stock_code", YEAR, *STATE))

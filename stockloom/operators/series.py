"""Ordered per-key series in pieces of bounded size.

Frame functions need the rows of a key in order. A series is cut by row number, so
that a dominant key never is one task, however long its series:

* *bucket* – a fixed span of days, hence never more rows than days. Counting
  rows per bucket combines on the map side and leaves a table a few hundred
  times smaller than the series; a running sum over it gives every bucket the
  row number it starts at.
* *block* – whole buckets, about ``block_rows`` rows, the unit of distribution:
  everything is partitioned by (key, block).
* *lead-in* – the last buckets of a block, at least ``lead_rows`` rows, are also
  given to the next block, so frames and recurrences there see their past.

A *stretch* is a run of about ``stretch_rows`` rows, within which
the recurrences scale their terms (see ``recurrence``). All windows share one
partitioning and one order, so they need no shuffle of their own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F


@dataclass(frozen=True)
class SeriesLayout:
    key: str = "stock_code"
    day: str = "stock_date"
    bucket_days: int = 256
    stretch_rows: int = 1024
    block_rows: int = 8192
    lead_rows: int = 640

    def __post_init__(self) -> None:
        if self.block_rows < self.lead_rows + self.bucket_days:
            raise ValueError("block_rows must exceed lead_rows + bucket_days")
        if self.block_rows % self.stretch_rows:
            raise ValueError("block_rows must be a multiple of stretch_rows")
        # Long enough for a carry to fade, short enough for scaled terms to stay in range.
        if self.stretch_rows - self.bucket_days < 640 or self.stretch_rows + self.bucket_days > 1500:
            raise ValueError("stretch_rows must leave 640 to 1500 rows, give or take a bucket")
        if self.lead_rows < 640:
            raise ValueError("lead_rows must be at least 640")


_BUCKET, _BLOCK, _STRETCH = "__bucket", "__block", "__stretch"
_HOME, _START = "__home", "__start"

#: Rows of the series; number of a row in its series and in its stretch, from 0.
#: A lead-in may start inside a stretch. Its row numbers are then exact too, but
#: positions count from where it starts.
LENGTH = "__length"
ROW = "__row"
POSITION = "__position"


def _bucket(layout: SeriesLayout) -> Column:
    return F.floor(F.unix_date(F.col(layout.day)) / layout.bucket_days)


def bucket_starts(df: DataFrame, layout: SeriesLayout) -> DataFrame:
    """Per key and bucket: first row number, series length, and the blocks to send it to."""
    counts = (df.select(layout.key, _bucket(layout).alias(_BUCKET))
              .groupBy(layout.key, _BUCKET).agg(F.count(F.lit(1)).alias("n")))
    whole = Window.partitionBy(layout.key).orderBy(_BUCKET)
    everything = whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = whole.rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        layout.key, _BUCKET, "n",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias(_START),
        F.sum("n").over(everything).alias(LENGTH),
        F.last("n").over(everything).alias("n_last"),
    )
    home = F.floor(F.col(_START) / layout.block_rows)
    last_block = F.floor((F.col(LENGTH) - F.col("n_last")) / layout.block_rows)
    reaches_next = (F.col(_START) + F.col("n") > (home + 1) * layout.block_rows - layout.lead_rows)
    return starts.select(
        layout.key, _BUCKET, _START, LENGTH, home.alias(_HOME),
        F.floor(F.col(_START) / layout.stretch_rows).alias(_STRETCH),
        F.when(reaches_next & (last_block > home), F.array(home, home + 1))
        .otherwise(F.array(home)).alias("blocks"),
    )


@dataclass(frozen=True)
class Series:
    """Distributed series and the windows over them."""

    df: DataFrame
    layout: SeriesLayout

    @property
    def _pieces(self) -> list[str]:
        return [self.layout.key, _BLOCK]

    @property
    def _inner(self) -> list[str]:
        return [_BUCKET, self.layout.day]

    def ordered(self) -> WindowSpec:
        return Window.partitionBy(*self._pieces).orderBy(_STRETCH, *self._inner)

    def rows_back(self, n: int) -> WindowSpec:
        """Frame of the current row and the ``n - 1`` rows before it."""
        return self.ordered().rowsBetween(-(n - 1), 0)

    def stretch(self) -> WindowSpec:
        """Frame of the stretch up to the current row."""
        return self._in_stretch().rowsBetween(Window.unboundedPreceding, 0)

    def _in_stretch(self) -> WindowSpec:
        return Window.partitionBy(*self._pieces, _STRETCH).orderBy(*self._inner)

    def numbered(self) -> dict[str, Column]:
        """Row number in the series and position in the stretch."""
        position = F.row_number().over(self._in_stretch()) - 1
        return {POSITION: position, ROW: F.first(_START).over(self.stretch()) + position}

    def add_steps(self, *plans: list[dict[str, Column]]) -> "Series":
        """Adds the columns of several step-wise plans, the same step of all plans together.

        Window expressions added together share one pass where their windows
        agree, so plans that run side by side cost about as much as the longest.
        """
        df = self.df
        for i in range(max(len(plan) for plan in plans)):
            df = df.withColumns({k: v for plan in plans for k, v in (plan[i] if i < len(plan) else {}).items()})
        return Series(df, self.layout)

    def finish(self, columns: list[str | Column]) -> DataFrame:
        """The series' own rows (lead-ins dropped) with the given columns."""
        return self.df.filter(F.col(_BLOCK) == F.col(_HOME)).select(*columns)


def distribute(df: DataFrame, layout: SeriesLayout = SeriesLayout()) -> Series:
    """Series distributed by blocks.

    The partitionings are spelled out: the running sum leaves the bucket table
    partitioned by key alone, and the planner would gladly reuse that for the
    rows as well, which is the dominant key in one task again.
    """
    starts = bucket_starts(df, layout).repartition(layout.key, _BUCKET)
    spread = (df.withColumn(_BUCKET, _bucket(layout))
              .join(starts, [layout.key, _BUCKET])
              .withColumn(_BLOCK, F.explode("blocks")).drop("blocks")
              .repartition(layout.key, _BLOCK))
    return Series(spread, layout)

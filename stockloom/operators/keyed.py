"""Keyed row selection: latest n, first per key, prioritised unions, key checks.

``row_number() <= n`` filters are planned with a group limit below the shuffle,
so a task hands on at most n rows per key however many rows the key has.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

_RANK = "__rank"
_PRIORITY = "__priority"


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int,
             rank_as: str | None = None) -> DataFrame:
    """The first ``n`` rows of each key in ``order``; optionally keep the rank."""
    rank = rank_as or _RANK
    window = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)
    return out if rank_as else out.drop(rank)


def latest_rows(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], n: int,
                rank_as: str | None = None) -> DataFrame:
    """The last ``n`` rows of each key by the given columns, NULLs last."""
    return top_rows(df, keys, [F.col(c).desc_nulls_last() for c in order_by], n, rank_as)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first in ``order`` (any, without one)."""
    return top_rows(df, keys, list(order) or [F.lit(0)], 1)


def stable_order(df: DataFrame, skip: Sequence[str] = ()) -> list[Column]:
    """An order over all comparable columns, for choices that must not depend on the input order."""
    unordered = ("map", "variant")
    return [F.col(name).asc_nulls_last() for name, kind in df.dtypes
            if name not in skip and not kind.startswith(unordered)]


def union_keep_first(frames: Sequence[DataFrame], keys: Sequence[str],
                     order: Sequence[Column] = ()) -> DataFrame:
    """Union in which, per key, a row of an earlier frame wins over later ones."""
    tagged = [f.withColumn(_PRIORITY, F.lit(i)) for i, f in enumerate(frames)]
    union = tagged[0]
    for frame in tagged[1:]:
        union = union.unionByName(frame)
    tie = list(order) or stable_order(frames[0], keys)
    return keep_first(union, keys, [F.col(_PRIORITY), *tie]).drop(_PRIORITY)


def prefer(primary: DataFrame, secondary: DataFrame, key: str = "stock_code") -> DataFrame:
    """``primary``, plus ``secondary`` for the keys ``primary`` has no row of."""
    present = primary.select(key).distinct()
    return primary.unionByName(secondary.join(present, key, "left_anti"))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") > 1)


def orphans(df: DataFrame, parent: DataFrame, key: str = "stock_code") -> DataFrame:
    """Keys of ``df`` the parent table does not know, with their row counts."""
    counted = df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))
    return counted.join(parent.select(key).distinct(), key, "left_anti")


def in_days(df: DataFrame, first: dt.date, last: dt.date | None = None, day: str = "stock_date") -> DataFrame:
    """Rows of the days from ``first`` to ``last``; a stored table with its partition column reads those years only."""
    if "stock_year" in df.columns:
        df = df.filter(F.col("stock_year") >= first.year)
        df = df if last is None else df.filter(F.col("stock_year") <= last.year)
    df = df.filter(F.col(day) >= F.lit(first))
    return df if last is None else df.filter(F.col(day) <= F.lit(last))


def restrict_keys(df: DataFrame, keys: DataFrame | Sequence[str], key: str = "stock_code") -> DataFrame:
    """Rows of the given keys; a plain list is pushed down to the scan."""
    if isinstance(keys, DataFrame):
        return df.join(keys.select(key).distinct(), key, "left_semi")
    return df.filter(F.col(key).isin(list(keys)))

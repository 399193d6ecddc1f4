"""The nightly update: landed files to stored tables, in dependency order."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from stockloom import constants as C
from stockloom.operators import state
from stockloom.operators.indicators import INDICATORS
from stockloom.operators.keyed import latest_rows, union_keep_first
from stockloom.operators.news import Scorer
from stockloom.operators.statements import default_thresholds, warning_indicators
from stockloom.plans import incremental as inc, loads
from stockloom.plans.runs import Run
from stockloom.schemas import FEED_ENVELOPE, LANDINGS, TABLES, conform
from stockloom.sinks.warehouse import Warehouse
from stockloom.sources import checked, files, landed, news_feed


@dataclass(frozen=True)
class LandingZone:
    """Folders of the landed data sets below one root; an absent one reads as empty.

    With ``rejects``, rows that cannot be read go to the table of rejects there.
    """

    spark: SparkSession
    root: str
    rejects: Warehouse | None = None

    def dataset(self, name: str, **bounds) -> DataFrame:
        path = f"{self.root}/{name}"
        if self.rejects is not None:
            return self._or_empty(lambda: landed.bounded(
                checked.read_checked(self.spark, path, name, self.rejects).rows, LANDINGS[name], **bounds), LANDINGS[name].fields)
        return self._or_empty(lambda: landed.read_landed(self.spark, path, name, **bounds), LANDINGS[name].fields)

    def entries(self) -> DataFrame:
        path = f"{self.root}/news"
        empty = news_feed.unpack_entries(self.spark.createDataFrame([], FEED_ENVELOPE)).schema
        return self._or_empty(lambda: news_feed.read_feed(self.spark, path), empty)

    def ownership_file(self, codes: DataFrame) -> DataFrame | None:
        return self._or_none(lambda: files.read_ownership(self.spark, f"{self.root}/ownership", codes))

    def companies(self, codes: DataFrame) -> DataFrame | None:
        master = self._or_none(lambda: files.read_companies(self.spark, f"{self.root}/company", codes))
        if master is not None:
            return master
        return self._or_none(lambda: files.read_company_backup(self.spark, f"{self.root}/company_backup"))

    def _or_none(self, read: Callable[[], DataFrame]) -> DataFrame | None:
        try:
            return read()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def _or_empty(self, read: Callable[[], DataFrame], schema) -> DataFrame:
        found = self._or_none(read)
        return self.spark.createDataFrame([], schema) if found is None else found


def monitored(spark: SparkSession, codes: Sequence[str] = C.MONITORED_KEYS) -> DataFrame:
    return spark.createDataFrame([(c,) for c in codes], "stock_code string")


def update_companies(store: Warehouse, zone: LandingZone, keys: DataFrame) -> None:
    rows = zone.companies(keys)
    if rows is not None:
        store.append_new("company", rows)


def update_daily(store: Warehouse, zone: LandingZone, keys: DataFrame, today: dt.date,
                 tail_rows: int | None = None) -> None:
    """Daily rows from the marks on, with indicators from the stored states (``tail_rows``: over the latest rows alone)."""
    marks = inc.high_water_marks(keys, store.marks("daily_metrics"), "latest", today, C.DAILY_DEFAULT_YEARS)
    landed = (zone.dataset("price"), zone.dataset("investor"), zone.dataset("margin"))
    with store.stage("marks") as staged:
        # As a written table their size is known beforehand, and landed rows need not be dealt out by key to be cut.
        marks = staged(marks)
        if tail_rows:
            store.append_new("daily_metrics", loads.daily_metrics(*landed, store.read("daily_metrics"), marks, today, tail_rows))
        else:
            append_daily(store, loads.daily_batch(*landed, marks, today))


def append_daily(store: Warehouse, batch: DataFrame) -> None:
    """Append daily rows with indicators that go on from each key's state, and keep states and latest rows up.

    A night reads the states of its keys and no stored day, unless rows come late or an
    earlier run broke off between its writes: such keys start again from the checkpoint
    before the year, over the stored rows of that year and later ones.
    """
    with store.stage("daily") as staged:
        with store.stage("batch") as first_staged:  # gone before the rows are appended
            done = _advanced(store, batch.drop(*INDICATORS), first_staged)
            done = state.Advanced(staged(done.rows), done.base)
        store.append_new("daily_metrics", done.indicators())
        checkpoints = staged(done.checkpoints())
        store.upsert("indicator_checkpoint", checkpoints)
        store.upsert("indicator_state", state.latest(checkpoints))
        keep_latest(store, done.indicators())


def _advanced(store: Warehouse, batch: DataFrame, staged: Callable[[DataFrame], DataFrame]) -> state.Advanced:
    """Indicators of the rows of a batch the table does not have yet, from the states, or of late keys from a checkpoint."""
    batch = staged(batch)
    states, marks = store.read("indicator_state"), store.marks("daily_metrics")
    # The last day is landed again each night; it is known where state and table agree.
    known = states.join(marks, "stock_code").filter(F.col("last_day") == F.col("latest")).select("stock_code", F.col("last_day").alias("stock_date"))
    batch = batch.join(known, ["stock_code", "stock_date"], "left_anti")
    late = staged(state.late_keys(states, marks, batch))
    rows = batch
    if not late.isEmpty():
        first = late.agg(F.min(F.year("first")).alias("y")).first().y
        stored = store.read("daily_metrics", with_layout=True).filter(F.col("stock_year") >= first)
        stored = stored.withColumns({c: F.col(c).cast("double") for c, kind in stored.dtypes if kind.startswith("decimal")})
        rows = (batch.join(late, "stock_code", "left_anti").withColumn(state.NEW, F.lit(True))
                .unionByName(state.replayed(late, stored, batch)))
        states = (states.join(late, "stock_code", "left_anti")
                  .unionByName(state.states_before(late, store.read("indicator_checkpoint"))))
    return state.advance(states, rows)


def keep_latest(store: Warehouse, rows: DataFrame, n: int = C.LATEST_ROWS) -> None:
    """Keep the newest rows of each key up, from those that were the newest and the ones just appended.

    A row older than the n newest can never be among them again, and a row the view has
    is the stored one, so neither late nor repeated rows need the table. The batch is cut to
    the newest days of each key first, as it came, in one pass; only what is left is typed, merged and ranked.
    """
    daily = TABLES["daily_metrics"]
    rows = rows.withColumns({"stock_code": F.col("stock_code").cast("string"), "stock_date": F.col("stock_date").try_cast("date")})
    days = Window.partitionBy("stock_code").orderBy(F.col("stock_date").desc_nulls_last())
    with store.stage("latest") as staged:
        newest = staged(rows.withColumn("__day", F.dense_rank().over(days)).filter(F.col("__day") <= n).drop("__day"))
        before = store.read("latest_daily").drop("place").join(newest.select("stock_code").distinct(), "stock_code", "left_semi")
        both = union_keep_first([before, conform(newest, daily)], daily.key)
        store.upsert("latest_daily", latest_rows(both, ["stock_code"], ["stock_date"], n, rank_as="place"))


def update_weekly(store: Warehouse, zone: LandingZone, keys: DataFrame, today: dt.date) -> None:
    marks = inc.high_water_marks(keys, store.marks("weekly_concentration"), "latest", today,
                                 C.DAILY_DEFAULT_YEARS)
    levels = loads.holding_rows(zone.dataset("holding"))
    recent = inc.delta(levels, marks, loads.day_of(F.col("date")), today)
    store.append_new("weekly_concentration", loads.weekly(recent, zone.ownership_file(keys)))


def update_fundamentals(store: Warehouse, zone: LandingZone, keys: DataFrame, today: dt.date) -> None:
    def since_mark(rows: DataFrame, marks: DataFrame) -> DataFrame:
        coded = rows.withColumn("stock_code", F.col("stock_id"))
        return inc.delta(coded, marks, loads.day_of(F.col("date")), today).drop("stock_code")

    revenue_years = store.marks("monthly_revenue").select("stock_code", F.year("latest").alias("revenue_year"))
    revenue_marks = inc.revenue_marks(keys, revenue_years, today)
    store.append_new("monthly_revenue", loads.revenues(since_mark(zone.dataset("revenue"), revenue_marks)))
    store.append_new("dividend", loads.dividends(zone.dataset("dividend", stock_ids=keys)))
    marks = {name: inc.high_water_marks(keys, store.marks("statement_fact", name), "latest", today,
                                        C.STATEMENT_DEFAULT_YEARS) for name in ("income", "balance", "cashflow")}
    store.append_new("statement_fact", loads.facts(
        *[since_mark(zone.dataset(name), marks[name]) for name in ("income", "balance", "cashflow")]))


def update_news(store: Warehouse, zone: LandingZone, today: dt.date,
                make_scorer: Callable[[], Scorer] | None = None) -> None:
    company = store.read("company")
    latest = store.marks("news").select("stock_code", F.col("latest").alias("publish_time"))
    marks = inc.news_marks(company, latest, today)
    store.append_new("news", loads.news(zone.entries(), company, marks, lambda rows: store.known_keys("news", rows), today, make_scorer))


def init_thresholds(store: Warehouse, keys: DataFrame) -> None:
    """Thresholds for keys that have none; existing ones stay."""
    missing = keys.join(store.read("warning_threshold"), "stock_code", "left_anti")
    store.append_new("warning_threshold", default_thresholds(missing, store.read("statement_fact")))


def update_warnings(store: Warehouse, keys: DataFrame) -> None:
    facts = store.read("statement_fact").join(keys.select("stock_code").distinct(), "stock_code", "left_semi")
    store.upsert("warning_indicator", warning_indicators(facts, store.read("warning_threshold")))


def change_thresholds(store: Warehouse, changes: DataFrame) -> None:
    """Store changed thresholds and re-judge the quarters of the changed keys."""
    store.update_thresholds(changes)
    update_warnings(store, changes)


def update_all(store: Warehouse, zone: LandingZone, keys: DataFrame, today: dt.date,
               make_scorer: Callable[[], Scorer] | None = None) -> bool:
    """The whole update; if all keys have today's prices only the news is loaded. True if it ran in full.

    A run that broke off is taken up at the step where it stopped, also when that was
    after the prices; the gate is asked by new runs only.
    """
    run = Run(store, today)
    if not run.resumed and inc.is_fresh(keys, store.read("daily_metrics", since=today), store.read("weekly_concentration"), today):
        update_news(store, zone, today, make_scorer)
        return False
    run.go([
        ("companies", lambda: update_companies(store, zone, keys)),
        ("daily", lambda: update_daily(store, zone, keys, today)),
        ("weekly", lambda: update_weekly(store, zone, keys, today)),
        ("fundamentals", lambda: update_fundamentals(store, zone, keys, today)),
        ("news", lambda: update_news(store, zone, today, make_scorer)),
        ("thresholds", lambda: init_thresholds(store, keys)),
        ("warnings", lambda: update_warnings(store, keys)),
    ])
    return True

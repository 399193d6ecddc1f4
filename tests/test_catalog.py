"""Every registered query against its SQL on the smallest shared tables."""

import datetime as dt
import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_point
import catalog

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def cell(value):
    if value is None or isinstance(value, (bool, str)):
        return value
    if isinstance(value, (dt.date, dt.datetime)):
        return str(value)[:10]
    return float(value)


def table(names, tuples):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cells = [tuple(cell(t[i]) for i in order) for t in tuples]
    return [names[i] for i in order], sorted(cells, key=lambda t: [(v is None, str(type(v)), v if v is not None else 0) for v in t])


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = entry_point.queries()[name](spark, SF_DIR)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    result = duck.execute(entry_point.oracle_sql()[name])
    want = table([d[0] for d in result.description], result.fetchall())
    assert got == want


def test_entry(spark):
    assert entry_point.entry(spark).count() == 10


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.SQL)


def test_rows_land_twice_and_compressed(spark, tmp_path):
    rows = spark.createDataFrame([("2026-07-01", "a", 1.0, 2.0), ("2026-07-02", "a", 3.0, None)],
                                 "date string, stock_id string, MarginPurchaseTodayBalance double, ShortSaleTodayBalance double")
    catalog._land(rows, str(tmp_path), "margin")
    files = glob.glob(f"{tmp_path}/margin/part-*")
    assert files and all(f.endswith(".gz") for f in files)
    landed = catalog.update.LandingZone(spark, str(tmp_path)).dataset("margin").select(*rows.columns).collect()
    assert sorted(map(tuple, landed)) == [("2026-07-01", "a", 1.0, 2.0)] * 2 + [("2026-07-02", "a", 3.0, 0.0)] * 2


def test_a_night_of_states_looks_at_written_rows(spark, monkeypatch):
    plans, whole = [], catalog.state.Advanced.checkpoints
    monkeypatch.setattr(catalog.state.Advanced, "checkpoints", lambda self: (plans.append(self.rows._jdf.queryExecution().optimizedPlan().toString()), whole(self))[1])
    assert catalog.QUERIES["indicators_by_state"](spark, SF_DIR).count() > 0
    assert len(plans) == 3 and not any("Window" in p for p in plans)


def test_news_land_in_as_many_files_as_the_input_has_splits(spark, monkeypatch):
    files, stream = [], catalog.stream_loads.news_stream
    monkeypatch.setattr(catalog.stream_loads, "news_stream", lambda spark, path, **more: (files.append(len(glob.glob(f"{path}/*.json"))), stream(spark, path, **more))[1])
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for c in before:
            spark.conf.set(c, "16k")
        splits = catalog.data.feed(spark, SF_DIR).rdd.getNumPartitions()
        assert catalog.QUERIES["news_stream_load"](spark, SF_DIR).count() > 0
    finally:
        for c, value in before.items():
            spark.conf.set(c, value)
    assert splits > 3 and files == [splits, splits]

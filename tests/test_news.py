import datetime as dt

import pytest

from stockloom.operators import news as nw

NEWS = "stock_code string, title string, publish_time timestamp, news_link string, sentiment_score double"
T0 = dt.datetime(2026, 7, 1, 8, 0)


def listed(spark, n, title=lambda i: f"t{i}", score=lambda i: 0.0, key="a"):
    return spark.createDataFrame([(key, title(i), T0 + dt.timedelta(minutes=i), f"l{i:04d}", score(i)) for i in range(n)], NEWS)


def test_list_keeps_newest_per_title_among_the_scanned(spark):
    shown = nw.shown_news(listed(spark, 150, title=lambda i: f"t{i % 7}"), rank_as="p").orderBy("p").collect()
    assert [r["title"] for r in shown] == [f"t{i % 7}" for i in range(149, 142, -1)]
    assert nw.shown_news(listed(spark, 150)).count() == 30
    older = nw.shown_news(listed(spark, 150, title=lambda i: "same" if i >= 50 else f"t{i}")).collect()
    assert [r["news_link"] for r in older] == ["l0149"]


def test_list_breaks_ties_by_link(spark):
    df = spark.createDataFrame([("a", "x", T0, "l2", 0.0), ("a", "x", T0, "l1", 0.0), ("a", "y", None, "l0", 0.0)], NEWS)
    shown = nw.shown_news(df, rank_as="p").orderBy("p").collect()
    assert [r["news_link"] for r in shown] == ["l1", "l0"]


def test_zscores(spark):
    one = nw.with_zscores(listed(spark, 1, score=lambda i: 0.8)).first()
    assert (one["label"], one["z_score"]) == ("positive", 0.0)
    three = {r["news_link"]: r for r in nw.with_zscores(listed(spark, 3, score=lambda i: [0.8, 0.05, -0.8][i])).collect()}
    assert three["l0001"]["z_score"] == 0.0 and three["l0001"]["label"] == "neutral"
    assert three["l0000"]["z_score"] == pytest.approx((0.8 - 0.05 / 3) / 0.800156, abs=1e-3)
    assert three["l0002"]["label"] == "negative"
    assert [three[f"l000{i}"]["z_text"] for i in range(3)] == ["+0.98", "0.00", "-1.02"]


def test_daily_mean_leaves_out_rows_without_time(spark):
    df = listed(spark, 2, score=lambda i: [0.2, 0.6][i]).unionByName(spark.createDataFrame([("a", "x", None, "z", 1.0)], NEWS))
    (row,) = nw.daily_sentiment(df).collect()
    assert tuple(row) == ("a", T0.date(), pytest.approx(0.4))


def test_recent_search_wins(spark, rows):
    schema = "stock_code string, title string, published string, link string"
    recent = spark.createDataFrame([("a", "new", "p", "l1")], schema)
    old = spark.createDataFrame([("a", "old", "p", "l1"), ("a", "old", "p", "l2"), ("b", "old", "p", "l1")], schema)
    assert rows(nw.merge_searches(recent, old), "stock_code", "title", "link") == {
        ("a", "new", "l1"), ("a", "old", "l2"), ("b", "old", "l1")}


def test_rows_are_unique_and_repeatable(spark):
    schema = "stock_code string, title string, published string, link string"
    df = spark.createDataFrame([("a", "獲利創高", "Wed, 01 Jul 2026 08:30:00 GMT", "l1")] * 2 + [("b", "x", "bad", "l1")], schema)
    first, second = [sorted(map(tuple, nw.as_news(df).collect())) for _ in range(2)]
    assert first == second and len(first) == 2
    assert {r["sentiment_score"] for r in nw.as_news(df).collect()} == {0.8, 0.0}


def scorer():
    def score(titles):
        if any(t == "boom" for t in titles):
            raise RuntimeError
        return [({"up": "Positive", "down": "LABEL_2"}.get(t, "Neutral"), 0.9) for t in titles]
    return score


def broken():
    raise ImportError("no model here")


def test_model_scores_with_fallback_per_title(spark):
    df = spark.createDataFrame([("up",), ("down",), ("flat",), ("boom",), (None,)], "title string")
    got = {r["title"]: r["sentiment_score"] for r in nw.model_sentiment(df, scorer).collect()}
    assert got == {"up": 0.9, "down": -0.9, "flat": 0.0, "boom": 0.0, None: 0.0}
    fallen = spark.createDataFrame([("創高",), ("boom",)], "title string")
    for factory in (broken, None):
        got = {r["title"]: r["sentiment_score"] for r in nw.model_sentiment(fallen, factory).collect()}
        assert got == {"創高": 0.8, "boom": 0.0}


def test_lexicon_scoring_stays_out_of_python(spark):
    df = spark.createDataFrame([("創高",)], "title string")
    plan = nw.model_sentiment(df)._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan and "Python" not in plan
    assert "ArrowEvalPython [answer(title" in nw.model_sentiment(df, scorer)._jdf.queryExecution().executedPlan().toString()


def test_clean_entries_reject_other_sources(spark, rows):
    df = spark.createDataFrame([("A - CMoney", "", 1), ("B", "Reuters", 2), ("C - x", "鉅亨網", 3), ("D", None, 4)],
                               "title string, source_name string, id int")
    assert rows(nw.clean_entries(df)) == {("A", "CMoney", 1), ("C - x", "鉅亨網", 3)}


def test_scoring_leaves_other_columns_as_they_are(spark):
    df = spark.createDataFrame([("創高", 2 ** 53 + 1), (None, None), ("x", -(2 ** 53) - 1)], "title string, n bigint")
    assert sorted(map(str, (r.n for r in nw.model_sentiment(df, scorer).collect()))) == sorted(map(str, (2 ** 53 + 1, None, -(2 ** 53) - 1)))

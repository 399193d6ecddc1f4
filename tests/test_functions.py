import datetime as dt

import pytest
from pyspark.sql import functions as F

from stockloom import constants as C
from stockloom.functions import dates, numbers, text


def one(spark, column, **values):
    df = spark.range(1)
    for name, value in values.items():
        df = df.withColumn(name, F.lit(value).cast("string") if value is None else F.lit(value))
    return df.select(column.alias("x")).first()[0]


@pytest.mark.parametrize("title, score", [
    ("台積電營收創高", 0.8), ("聯發科獲利衰退", 0.0), ("中華電信今日召開董事會", 0.0),
    ("股價暴跌", -0.8), ("創高創高後大跌、利空", -0.27), (None, 0.0)])
def test_lexicon(spark, title, score):
    assert one(spark, text.lexicon_score(F.col("t")), t=title) == pytest.approx(score)


def test_lexicon_has_sixteen_words_each():
    assert len(set(C.POSITIVE_WORDS)) == len(set(C.NEGATIVE_WORDS)) == 16
    assert len(C.INDUSTRIES) == 38


@pytest.mark.parametrize("title, source, want", [
    ("A - B - C", "", ("A - B", "C")), ("A - B", None, ("A", "B")), ("A - B", "src", ("A - B", "src")),
    ("no separator", "", ("no separator", "")), ("a - - b", "", ("a", "- b")), (" - x", "", ("", "x"))])
def test_title_split(spark, title, source, want):
    t, s = F.col("t"), F.col("s")
    assert (one(spark, text.clean_title(t, s), t=title, s=source),
            one(spark, text.clean_source(t, s), t=title, s=source)) == want


@pytest.mark.parametrize("name, ok", [
    ("Anue鉅亨", True), ("news.CNYES.com", True), ("Yahoo股市", True), ("奇摩新聞", True), ("CMoney", True),
    ("MoneyDJ理財網", True), ("Yahoo News", False), ("", False), (None, False)])
def test_allowed_source(spark, name, ok):
    assert one(spark, text.allowed_source(F.col("n")), n=name) is ok


@pytest.mark.parametrize("name, classes", [
    ("Foreign_Investor", "TFF"), (None, "TTT"), ("Dealer_self", "FFT"), ("Foreign_Dealer_Self", "TFT"),
    ("Investment_Trust", "FTF"), ("外資及陸資", "TFF"), ("foreign", "TFF")])
def test_investor_classes(spark, name, classes):
    got = [one(spark, text.name_matches(F.col("n"), pattern), n=name) for pattern in C.INVESTOR_CLASSES.values()]
    assert got == [c == "T" for c in classes]


def test_search_keyword(spark):
    call = lambda a, n: one(spark, text.search_keyword(F.col("a"), F.col("n"), F.lit("2330")), a=a, n=n)
    assert (call("short", "full"), call("", "full"), call(None, ""), call(None, None)) == ("short", "full", "2330", "2330")


@pytest.mark.parametrize("value, want", [
    ("19870221", dt.date(1987, 2, 21)), (" 19870221 ", dt.date(1987, 2, 21)), ("760221", None),
    ("1987-02-21", None), ("19871341", None), ("", None), (None, None)])
def test_compact_date(spark, value, want):
    assert one(spark, dates.compact_date(F.col("v")), v=value) == want


@pytest.mark.parametrize("value, want", [("20260701", "2026-07-01"), ("2026-07-01", "2026-07-01"), (" 20260701", "2026-07-01")])
def test_dashed_date(spark, value, want):
    assert one(spark, dates.dashed_date(F.col("v")), v=value) == want


@pytest.mark.parametrize("value, want", [
    ("Wed, 01 Jul 2026 08:30:00 GMT", dt.datetime(2026, 7, 1, 8, 30)),
    ("Wed, 1 Jul 2026 08:30:00 GMT", dt.datetime(2026, 7, 1, 8, 30)),
    ("Wed, 01 Jul 2026 08:30:00 +0800", dt.datetime(2026, 7, 1, 0, 30)),
    ("2026-07-01T08:30:00Z", dt.datetime(2026, 7, 1, 8, 30)), ("yesterday", None), (None, None)])
def test_feed_time(spark, value, want):
    got = one(spark, F.date_format(dates.feed_time(F.col("v")), "yyyy-MM-dd HH:mm"), v=value)
    assert got == (want and want.strftime("%Y-%m-%d %H:%M"))


def test_day_of(spark):
    assert one(spark, dates.day_of(F.col("v")), v="2026-07-01 00:00:00") == dt.date(2026, 7, 1)
    assert one(spark, dates.day_of(F.col("v")), v="soon") is None


@pytest.mark.parametrize("value, want", [("1.5", 1.5), ("", 0.0), ("x", 0.0), (None, 0.0), ("NaN", 0.0), (" 2 ", 2.0)])
def test_number_or_zero(spark, value, want):
    assert one(spark, numbers.number_or_zero(F.col("v")), v=value) == want


def test_fixed_texts(spark):
    assert one(spark, numbers.at_fixed(F.lit(-1.005), 1)) == "-1.0"
    assert one(spark, numbers.at_fixed(F.lit(0.5), 2, signed=True)) == "+0.50"
    assert one(spark, numbers.signed_thousands(F.lit(-1234567.9))) == "-1,234,567"


def test_digest_is_stable_and_tells_rows_apart(spark):
    make = lambda a, b: one(spark, text.row_digest(F.lit(a), F.lit(b)))
    assert make("a", "bc") == make("a", "bc") != make("ab", "c")

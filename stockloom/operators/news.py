"""Headlines: clean-up, scoring, de-duplication and daily sentiment."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from stockloom import constants as C
from stockloom.functions.dates import feed_time
from stockloom.functions.numbers import at_fixed
from stockloom.functions.text import (allowed_source, clean_source, clean_title, contains_any,
                                      lexicon_score, row_digest)
from stockloom.operators.keyed import keep_first, top_rows, union_keep_first

NEWS_KEY = ["stock_code", "news_link"]

#: A headline model: texts in, one (label, confidence) per text out.
Scorer = Callable[[Sequence[str]], Sequence[tuple[str, float]]]


def clean_entries(entries: DataFrame, keywords: list[str] = C.SOURCE_KEYWORDS) -> DataFrame:
    """Feed entries with title and publisher told apart, from accepted publishers only.

    Takes ``title, published, link, source_name`` plus any other columns.
    """
    title, source = F.col("title"), F.col("source_name")
    return (entries.withColumns({"title": clean_title(title, source),
                                 "source_name": clean_source(title, source)})
            .filter(allowed_source(F.col("source_name"), keywords)))


def merge_searches(recent: DataFrame, historical: DataFrame) -> DataFrame:
    """Both search results, one row per link; the recent search wins."""
    return union_keep_first([recent, historical], ["stock_code", "link"])


def news_columns(entries: DataFrame) -> DataFrame:
    """Feed entries in stored columns; scored with the lexicon unless they carry a score.

    The id is a digest of key and link, so loading an entry again gives the same row.
    """
    if "sentiment_score" not in entries.columns:
        entries = entries.withColumn("sentiment_score", lexicon_score(F.col("title")))
    return entries.select(
        row_digest(F.col("stock_code"), F.col("link")).alias("news_id"), "stock_code", "title",
        F.lit("").alias("content"), feed_time(F.col("published")).alias("publish_time"),
        F.col("link").alias("news_link"), "sentiment_score")


def as_news(entries: DataFrame) -> DataFrame:
    """Stored news rows of feed entries, one per key and link."""
    return keep_first(news_columns(entries), NEWS_KEY, [F.col("publish_time").desc_nulls_last(), F.col("title")])


def label_score(label: Column, confidence: Column) -> Column:
    """Signed confidence of a model label: positive, negative or neither."""
    upper = F.upper(label)
    return (F.when(contains_any(upper, C.POSITIVE_LABELS), confidence)
            .when(contains_any(upper, C.NEGATIVE_LABELS), -confidence)
            .otherwise(F.lit(0.0)))


def model_sentiment(df: DataFrame, make_scorer: Callable[[], Scorer] | None = None,
                    title: str = "title", output: str = "sentiment_score") -> DataFrame:
    """Adds a headline score from a model, or from the lexicon where the model fails.

    ``make_scorer`` loads the model; it is called once per task, and the
    model sees the titles in Arrow batches. Without one the lexicon scores all
    titles and no Python worker is involved.
    """
    fallback = lexicon_score(F.col(title))
    if make_scorer is None:
        return df.withColumn(output, fallback)

    def ask(scorer: Scorer | None, titles: list[str]) -> list[tuple[str | None, float | None]]:
        """The model's answers; a failing batch is halved until the failing title is alone."""
        if scorer is not None and titles:
            try:
                answers = [(str(label), float(confidence)) for label, confidence in scorer(titles)]
                if len(answers) == len(titles):
                    return answers
            except Exception:
                half = len(titles) // 2
                if half:
                    return ask(scorer, titles[:half]) + ask(scorer, titles[half:])
        return [(None, None)] * len(titles)

    @F.pandas_udf("label string, confidence double")
    def answer(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        try:
            scorer = make_scorer()
        except Exception:
            scorer = None
        for batch in batches:
            yield pd.DataFrame(ask(scorer, batch.fillna("").tolist()), columns=["label", "confidence"])

    # Only the titles go through Python; all other columns stay as they are.
    asked = "__answer"
    found = df.withColumn(asked, answer(F.col(title)))
    label, confidence = F.col(f"{asked}.label"), F.col(f"{asked}.confidence")
    return found.withColumn(output, F.when(label.isNull(), fallback).otherwise(label_score(label, confidence))).drop(asked)


def shown_news(news: DataFrame, scanned: int = C.NEWS_SCAN_ROWS, shown: int = C.NEWS_SHOWN_ROWS,
               rank_as: str | None = None) -> DataFrame:
    """The news list of each key: latest rows, repeated titles dropped, then cut.

    Repeats are dropped among the scanned rows only, so fewer may remain than
    are asked for. Rows of the same minute are ordered by link.
    """
    newest = [F.col("publish_time").desc_nulls_last(), F.col("news_link").asc_nulls_last()]
    scan = top_rows(news, ["stock_code"], newest, scanned)
    return top_rows(keep_first(scan, ["stock_code", "title"], newest), ["stock_code"], newest, shown, rank_as)


def daily_sentiment(news: DataFrame) -> DataFrame:
    """Mean score per key and calendar day; rows without a time are left out."""
    return (news.filter(F.col("publish_time").isNotNull())
            .groupBy("stock_code", F.to_date("publish_time").alias("stock_date"))
            .agg(F.avg(F.col("sentiment_score").cast("double")).alias("avg_sentiment")))


def sentiment_label(score: Column) -> Column:
    band = C.SENTIMENT_NEUTRAL_BAND
    return (F.when(score > band, F.lit("positive")).when(score < -band, F.lit("negative"))
            .otherwise(F.lit("neutral")))


def with_zscores(shown: DataFrame) -> DataFrame:
    """Labels and z-scores among each key's shown news (a bounded list).

    Neutral rows, and lists without spread, have z-score 0. ``z_text`` shows the sign of all but neutral rows.
    """
    listed = Window.partitionBy("stock_code")
    score = F.coalesce(F.col("sentiment_score").cast("double"), F.lit(0.0))
    rated = shown.withColumn("sentiment_score", score).withColumns({
        "mean_score": F.avg("sentiment_score").over(listed),
        "std_score": F.stddev_samp("sentiment_score").over(listed),
        "label": sentiment_label(F.col("sentiment_score"))})
    neutral = F.col("label") == "neutral"
    z = F.try_divide(F.col("sentiment_score") - F.col("mean_score"), F.col("std_score"))
    rated = rated.withColumn("z_score", F.when(neutral, F.lit(0.0)).otherwise(F.coalesce(z, F.lit(0.0))))
    return rated.withColumn("z_text", F.when(neutral, F.lit("0.00")).otherwise(at_fixed(F.col("z_score"), 2, signed=True)))

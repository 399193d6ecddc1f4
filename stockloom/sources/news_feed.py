"""Landed news searches: one JSON object per company with its feed entries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from stockloom import constants as C
from stockloom.functions.dates import feed_time
from stockloom.functions.text import search_keyword
from stockloom.operators.news import clean_entries
from stockloom.schemas import FEED_ENVELOPE


def unpack_entries(responses: DataFrame) -> DataFrame:
    """Flat entries: key, title, published, link and the name of the source."""
    return responses.select("stock_code", F.inline("entries")).select(
        "stock_code", "title", "published", "link", F.coalesce("source.title", F.lit("")).alias("source_name"))


def read_feed(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    return unpack_entries(spark.read.schema(FEED_ENVELOPE).option("multiLine", multi_line).json(path))


def company_keywords(company: DataFrame) -> DataFrame:
    """What to search for each company by: short name, full name or code."""
    return company.select("stock_code", search_keyword(
        F.col("company_name_abbr"), F.col("company_name"), F.col("stock_code")).alias("keyword"))


def search(entries: DataFrame, keywords: DataFrame, start: dt.date | None, end: dt.date,
           sources: list[str] = C.SOURCE_KEYWORDS) -> DataFrame:
    """Entries of each key whose title holds its keyword, within the days, from accepted sources."""
    day = F.to_date(feed_time(F.col("published")))
    inside = day <= F.lit(end) if start is None else day.between(F.lit(start), F.lit(end))
    found = (entries.filter(inside)
             .join(keywords, "stock_code")
             .filter(F.contains(F.col("title"), F.col("keyword"))).drop("keyword"))
    return clean_entries(found, sources).drop("source_name")

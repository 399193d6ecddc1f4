"""The incremental loads as Structured Streaming jobs over landing folders.

A stream only parses and shapes rows; the idempotent append does the rest, batch by
batch. It compares with everything stored, so a row may arrive any time late or
be replayed after a failure, and no watermark has to drop anything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from stockloom import constants as C
from stockloom.operators.news import clean_entries, daily_sentiment, news_columns
from stockloom.schemas import FEED_ENVELOPE, LANDINGS
from stockloom.sinks.warehouse import Warehouse
from stockloom.sources.landed import unpack
from stockloom.sources.news_feed import unpack_entries


def landed_stream(spark: SparkSession, path: str, dataset: str, files_per_batch: int = 1000) -> DataFrame:
    """Rows of a landed data set as its files arrive."""
    landing = LANDINGS[dataset]
    responses = (spark.readStream.schema(landing.envelope)
                 .option("maxFilesPerTrigger", files_per_batch).json(path))
    return unpack(responses, landing)


def news_stream(spark: SparkSession, path: str, sources: list[str] = C.SOURCE_KEYWORDS,
                files_per_batch: int = 1000) -> DataFrame:
    """Scored news rows of landed searches as their files arrive."""
    responses = (spark.readStream.schema(FEED_ENVELOPE)
                 .option("maxFilesPerTrigger", files_per_batch).json(path))
    return news_columns(clean_entries(unpack_entries(responses), sources))


def append_stream(rows: DataFrame, store: Warehouse, table: str, checkpoint: str,
                  follow: bool = False) -> StreamingQuery:
    """Append a stream to a stored table; stops when the landed files are through unless it follows."""
    writer = (rows.writeStream.option("checkpointLocation", checkpoint)
              .foreachBatch(lambda batch, _: store.append_new(table, batch)))
    return (writer if follow else writer.trigger(availableNow=True)).start()


def daily_sentiment_stream(rows: DataFrame, store: Warehouse, checkpoint: str, follow: bool = False) -> StreamingQuery:
    """Append a stream of news, and keep the mean score per key and day up to date.

    Every batch recomputes the days it touches from all stored news, so a row may be late
    by any time and a replayed batch changes nothing.
    """
    def load(batch: DataFrame, _: int) -> None:
        batch = batch.persist()
        store.append_new("news", batch)
        touched = batch.select("stock_code", F.to_date("publish_time").alias("stock_date")).distinct()
        stored = store.read("news").withColumn("stock_date", F.to_date("publish_time"))
        store.upsert("daily_sentiment", daily_sentiment(stored.join(touched, ["stock_code", "stock_date"], "left_semi")))
        batch.unpersist()

    writer = rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(load)
    return (writer if follow else writer.trigger(availableNow=True)).start()

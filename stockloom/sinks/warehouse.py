"""The stored tables: typed reads, idempotent appends, upserts, keyed updates and marks.

Tables live as Parquet below one root. Large tables only ever grow, by rows
whose key is new. Tables that change in place are a base and changes (see
``sinks.parts``): an upsert writes the rows of its keys, and readers merge.

Every append also writes what it brought to the ledger of its table: the greatest day
and the number of rows of each key. Marks are merged from there, so finding where a load
continues costs a row for each key and append, whatever the age of the table. A retried
append writes its days again, which changes no mark. What a broken append lost is noticed
by the number of rows in the file footers, and repaired from the table.
"""

from __future__ import annotations

import datetime as dt
import itertools
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stockloom.operators.keyed import keep_first, stable_order, union_keep_first
from stockloom.operators.statements import apply_threshold_changes
from stockloom.schemas import TABLES, Table, conform
from stockloom.session import shuffles_removed
from stockloom.sinks.parts import MOST_CHANGES, Parts

REPLACED = {"warning_threshold", "warning_indicator", "daily_sentiment", "indicator_state", "indicator_checkpoint", "latest_daily"}

#: The day a row counts for in the ledger of its table, and what it is told apart by beside its key.
LEDGERS = {
    "daily_metrics": ("stock_date", "''"),
    "weekly_concentration": ("update_date", "''"),
    "monthly_revenue": ("make_date(revenue_year, revenue_month, 1)", "''"),
    "statement_fact": ("date_info", "statement"),
    "news": ("to_date(publish_time)", "''"),
}
_LEDGER = "stock_code string, part string, latest date, n_rows bigint"

#: Tables with a Bloom filter of the stored keys beside each partition, its bits, and the bits a key sets.
SKETCHED = {"news"}
SKETCH_BITS, SKETCH_HASHES = 1 << 23, 3
_SLOT = 32_768
_SKETCH = "part string, slot int, bits binary"
_ALONE = "__alone"


class Warehouse:
    """Stored tables below ``root``, a path every executor can reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def read(self, name: str, with_layout: bool = False, since: dt.date | None = None) -> DataFrame:
        """The table as stored, or empty if nothing has been written yet.

        ``with_layout`` keeps the partition columns for callers that prune on them.
        ``since`` keeps the rows from a day on, and reads the directories of their years only
        (tables by ``stock_year``).
        """
        table = TABLES[name]
        parts = [f"{c} {self._layout_type(table, c)}" for c in table.layout]
        schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema.fields] + parts)
        if name in REPLACED:
            df = self.parts(name).merged(list(table.key))
        else:
            try:
                df = self.spark.read.schema(schema).parquet(self.path(name))
            except AnalysisException as error:
                if error.getCondition() != "PATH_NOT_FOUND":
                    raise
                df = self.spark.createDataFrame([], schema)
        if since is not None:
            df = df.filter((F.col("stock_year") >= since.year) & (F.col("stock_date") >= F.lit(since)))
        return df if with_layout else df.select(*table.columns)

    def sql(self, query: str, **parameters) -> DataFrame:
        """A query over the stored tables by name, with bound ``:parameters``."""
        for name in TABLES:
            self.read(name).createOrReplaceTempView(name)
        return self.spark.sql(query, args=parameters)

    def _layout_type(self, table: Table, column: str) -> str:
        empty = self.spark.createDataFrame([], table.schema)
        return empty.select(F.expr(table.layout[column])).schema[0].dataType.simpleString()

    def _folder(self, path: str):
        """The file system of a path, and the path as it knows it."""
        found = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return found.getFileSystem(self.spark._jsc.hadoopConfiguration()), found

    def parts(self, name: str) -> Parts:
        """Base and changes of a table that changes in place."""
        table = TABLES[name]
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema.fields)
        return Parts(self.spark, self.path(name), schema, ", ".join(f"{c} {self._layout_type(table, c)}" for c in table.layout))

    def ledger(self, name: str) -> Parts:
        return Parts(self.spark, f"{self.root}/_ledger/{name}", _LEDGER)

    def _entries(self, name: str) -> DataFrame:
        ledger = self.ledger(name)
        found = ledger.listing()
        base = ledger.base(found)
        return base.unionByName(ledger.changes(found).select(*base.columns)) if found.changes else base

    def marks(self, name: str, part: str = "") -> DataFrame:
        """stock_code, latest (greatest stored day), n_rows of a table with a ledger."""
        return (self._entries(name).filter(F.col("part") == part).groupBy("stock_code")
                .agg(F.max("latest").alias("latest"), F.sum("n_rows").alias("n_rows")))

    def _note(self, name: str, staged: DataFrame, fresh: DataFrame) -> None:
        """Writes the batch's greatest days, and the numbers of the rows that were new, to the ledger."""
        if name not in LEDGERS:
            return
        day, part = LEDGERS[name]
        staged, fresh = conform(staged, TABLES[name]), conform(fresh, TABLES[name])
        both = staged.withColumn("n", F.lit(0)).unionByName(fresh.withColumn("n", F.lit(1)))
        ledger = self.ledger(name)
        ledger.write(both.groupBy("stock_code", F.expr(part).alias("part")).agg(F.max(F.expr(day)).alias("latest"), F.sum("n").alias("n_rows")))
        ledger.compact(lambda: self._entries(name).groupBy("stock_code", "part").agg(F.max("latest").alias("latest"), F.sum("n_rows").alias("n_rows")))

    def repair_ledger(self, name: str) -> bool:
        """Writes the ledger anew from the table if it does not hold as many rows as the file footers say; True if it did."""
        noted = self._entries(name).agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n")).first().n
        if noted == self.read(name).count():  # of the footers: no column is read
            return False
        day, part = LEDGERS[name]
        whole = self.read(name).groupBy("stock_code", F.expr(part).alias("part")).agg(F.max(F.expr(day)).alias("latest"), F.count("*").alias("n_rows"))
        self.ledger(name).write(whole, "version")
        return True

    def sketch(self, name: str) -> Parts:
        return Parts(self.spark, f"{self.root}/_sketch/{name}", _SKETCH)

    def _places(self, table: Table, rows: DataFrame) -> DataFrame:
        """The key, and part, slot and bit of each of its places in the sketch."""
        part = F.concat_ws("/", *[F.expr(table.layout[c]).cast("string") for c in table.key_layout])
        places = F.array(*[F.pmod(F.xxhash64(*table.key, F.lit(i)), F.lit(SKETCH_BITS)) for i in range(SKETCH_HASHES)])
        return (rows.select(*table.key, part.alias("part"), F.explode(places).alias("place"))
                .select(*table.key, "part", F.floor(F.col("place") / _SLOT).cast("int").alias("slot"), (F.col("place") % _SLOT).alias("bit")))

    def _united(self, name: str) -> DataFrame:
        sketch = self.sketch(name)
        found = sketch.listing()
        base = sketch.base(found)
        both = base.unionByName(sketch.changes(found).select(*base.columns)) if found.changes else base
        return both.groupBy("part", "slot").agg(F.bitmap_or_agg("bits").alias("bits"))

    def _note_keys(self, table: Table, rows: DataFrame) -> None:
        """Adds keys to the sketch. Before they are stored: a key too many costs a look, one too few would be stored twice."""
        sketch = self.sketch(table.name)
        sketch.write(self._places(table, rows).groupBy("part", "slot").agg(F.bitmap_construct_agg("bit").alias("bits")))
        sketch.compact(lambda: self._united(table.name))

    def probable(self, name: str, rows: DataFrame) -> DataFrame:
        """The keys of ``rows`` that may be stored: all that are, and few others while the sketches have room."""
        table = TABLES[name]
        keys = rows.select(*table.key).distinct()
        if not self.sketch(name).listing().used:
            return keys
        is_set = F.expr("shiftright(cast(conv(hex(substring(bits, cast(bit div 8 AS INT) + 1, 1)), 16, 10) AS INT), cast(bit % 8 AS INT)) & 1")
        met = self._places(table, keys).join(self._united(name), ["part", "slot"])
        return met.groupBy(*table.key).agg(F.sum(is_set).alias("n")).filter(F.col("n") == SKETCH_HASHES).select(*table.key)

    def known_keys(self, name: str, rows: DataFrame) -> DataFrame:
        """Stored keys among those of ``rows``: of the partitions that may hold one, and none if the sketches say so."""
        table = TABLES[name]
        with_layout = self.probable(name, rows)
        existing = self._existing_keys(table, with_layout)
        return existing.join(with_layout, list(table.key), "left_semi")

    def append_new(self, name: str, batch: DataFrame) -> None:
        """Insert the rows whose key the table lacks; existing rows win, as does the first of a repeat.

        Keys are compared with their stored types. A row without a full key cannot be stored;
        it goes to the table of rejects. Running a batch again changes nothing.
        """
        table = TABLES[name]
        missing = [c for c in table.key if c not in batch.columns]
        if missing:
            raise ValueError(f"batch for {name} lacks key columns {missing}")
        whole = conform(batch, table)
        given = whole.select(*[c for c in table.columns if c in batch.columns])
        order = stable_order(given, table.key)
        if name in REPLACED:
            rows = keep_first(whole.dropna(subset=list(table.key)), table.key, order)
            self._change(name, rows.join(self.read(name).select(*table.key), list(table.key), "left_anti"))
            return
        # The batch, once, as a written table of the columns it has. Dealt out by key before it is sorted, a task sorts
        # its share of the batch, not a whole split. A row that lacks a key is a repeat of its likes only.
        no_key = " OR ".join(f"{k} IS NULL" for k in table.key)
        with self.stage(name) as write:
            alone = [*table.key, _ALONE]
            both = given.withColumn(_ALONE, F.when(F.expr(no_key), F.md5(F.to_json(F.struct(*given.columns)))))
            both = write(keep_first(both.repartition(*alone), alone, order).drop(_ALONE))
            lacking = both.filter(no_key)
            if name != "landed_reject" and not lacking.isEmpty():
                raw = F.to_json(F.struct(*table.columns))
                self.append_new("landed_reject", conform(lacking, table).select(
                    F.lit(name).alias("dataset"), F.lit("").alias("file"), F.lit("no full key").alias("reason"), F.md5(raw).alias("digest"), raw.alias("raw")))
            staged = both.dropna(subset=list(table.key))
            hits = write(self.probable(name, staged)) if name in SKETCHED else staged
            # Only the keys that are known are written again, not the rows that are new.
            known = write(self._existing_keys(table, hits).join(hits.select(*table.key), list(table.key), "left_semi"))
            fresh = staged if known.isEmpty() else staged.join(known, list(table.key), "left_anti")
            if name in SKETCHED:
                if not self.sketch(name).listing().used:
                    self._note_keys(table, self.read(name).select(*table.key))  # of rows from before there were sketches
                self._note_keys(table, fresh)
            self._write(table, fresh)
            self._note(name, staged, fresh)

    @contextmanager
    def stage(self, label: str) -> Iterator[Callable[[DataFrame], DataFrame]]:
        """A function that writes a DataFrame below the root and reads it again, for as long as the block lasts."""
        stage = f"{self.root}/_stage/{label}-{uuid.uuid4().hex}"
        numbers = itertools.count()

        def write(df: DataFrame) -> DataFrame:
            path = f"{stage}/{next(numbers)}"
            with shuffles_removed(self.spark):
                df.write.parquet(path)
            return self.spark.read.schema(df.schema).parquet(path)

        try:
            yield write
        finally:
            files, path = self._folder(stage)
            files.delete(path, True)

    def _existing_keys(self, table: Table, staged: DataFrame) -> DataFrame:
        """Stored keys in the partitions the batch touches (years, statements or buckets: a short list)."""
        existing = self.read(table.name, with_layout=True)
        for c in table.key_layout:
            touched = [r[0] for r in staged.select(F.expr(table.layout[c])).distinct().collect()]
            existing = existing.filter(F.col(c).isin(touched))
        return existing.select(*table.key)

    def _write(self, table: Table, rows: DataFrame) -> None:
        """Append, files rebalanced per partition so that a full one is split and small ones are joined.

        Columns the rows lack are added once they are sorted.
        """
        parts = list(table.layout)
        out = rows.withColumns({c: F.expr(e) for c, e in table.layout.items()}) if parts else rows
        out = out.hint("rebalance", *parts) if parts else out.hint("rebalance")
        if table.sort:
            out = out.sortWithinPartitions(*parts, *[c for c in table.sort if c in rows.columns])
        out = out.withColumns({c: F.lit(None).cast(table.schema[c].dataType) for c in table.columns if c not in rows.columns}).select(*table.columns, *parts)
        writer = out.write.mode("append")
        with shuffles_removed(self.spark):
            (writer.partitionBy(*parts) if parts else writer).parquet(self.path(table.name))

    def upsert(self, name: str, rows: DataFrame) -> None:
        """Insert or replace by key; the new row wins. Writes the rows of these keys only."""
        table = TABLES[name]
        if name not in REPLACED:
            raise ValueError(f"{name} only takes new keys")
        new = conform(rows, table).dropna(subset=list(table.key))
        self._change(name, union_keep_first([new], table.key))

    def _change(self, name: str, rows: DataFrame) -> None:
        """One more change; the table is compacted when it has many."""
        table, parts = TABLES[name], self.parts(name)
        parts.write(rows.select(*table.columns, *[F.expr(e).alias(c) for c, e in table.layout.items()]))
        self.compact(name)

    def compact(self, name: str, most: int = MOST_CHANGES) -> bool:
        parts = self.parts(name)
        return parts.compact(lambda: parts.merged(list(TABLES[name].key)), most)

    def update_thresholds(self, changes: DataFrame, at: Column | None = None) -> None:
        """Change the thresholds of existing keys and stamp them; unknown keys are left alone."""
        name = "warning_threshold"
        touched = self.read(name).join(changes.select("stock_code").distinct(), "stock_code", "left_semi")
        self.upsert(name, apply_threshold_changes(touched, changes, at))

"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from stockloom.session import fresh_path


#: Rows of an Arrow batch that are Python objects at a time.
SLICE = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, and kept when executors go."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` to be joined by a shuffle at every size.

    Spark takes what an explode or an aggregate makes for no larger than the file it came from,
    and would build a table many times its limit in the driver to broadcast it.
    """
    return df.hint("merge")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def append(df: DataFrame, source: str, ddl: str, make: Callable[[], Callable[[list], Iterable[tuple]]]) -> DataFrame:
    """``df`` with columns made from the bytes of ``source``; all other columns pass through as Arrow.

    ``make`` is called once for each task. Its result gets the values of a batch (bytes
    or None) and returns a row of ``ddl`` for each of them, in order.
    """
    at, new = df.columns.index(source), StructType.fromDDL(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, function = to_arrow_schema(new), make()
        for whole in batches:
            for i in range(0, whole.num_rows, SLICE):
                b = whole.slice(i, SLICE)
                rows = list(function(b.column(at).cast(pa.binary()).to_pylist()))
                columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns, *columns], names=[*b.schema.names, *arrow.names])

    return df.mapInArrow(run, StructType([*df.schema.fields, *new.fields]))


def expand(df: DataFrame, ddl: str, make: Callable[[], Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]]],
           rows: int = 5_000, size: int = 32_000_000) -> DataFrame:
    """Any number of rows of ``ddl`` from the Arrow batches of each task, sent in bounded batches."""
    new = StructType.fromDDL(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(new)

        def packed(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

        out, held = [], 0
        for row in make()(batches):
            out.append(row)
            held += sum(len(v) for v in row if isinstance(v, (bytes, str)))
            if len(out) >= rows or held >= size:
                yield packed(out)
                out, held = [], 0
        if out:
            yield packed(out)

    return df.mapInArrow(run, new)

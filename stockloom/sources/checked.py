"""Readers that lose nothing unseen: rejected rows with file and reason, and fields nobody listed.

``read_checked`` tells readable rows from rejects and counts both in the one pass that
reads the files. ``read_all_fields`` keeps every field of the landed rows, known or not.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from stockloom.functions.dates import day_of
from stockloom.schemas import LANDINGS, Landing
from stockloom.sinks.warehouse import Warehouse
from stockloom.session import fresh_path

_CORRUPT, _FILE = "_corrupt_record", "_file"


@dataclass(frozen=True)
class Checked:
    """Readable rows, and how many rows there were: ``read`` = ``kept`` + ``rejected``."""

    rows: DataFrame
    read: int
    kept: int
    rejected: int


def _reason(landing: Landing, row: str) -> Column:
    """Why a row is rejected, null if it is not."""
    reason = F.when(F.col(row).isNull(), "unreadable response").when(F.trim(F.coalesce(F.col(f"{row}.stock_id"), F.lit(""))) == "", "no key")
    if landing.date_field:
        reason = reason.when(day_of(F.col(f"{row}.{landing.date_field}")).isNull(), "no day")
    return reason


def read_checked(spark: SparkSession, path: str, dataset: str, store: Warehouse) -> Checked:
    """Rows of a landing folder that have a key and a day; all others go to the store's ``landed_reject``.

    A response that is no JSON is one reject with its text, as is each row without a key
    or day; responses without rows are neither. Files read again add no reject twice.
    """
    landing = LANDINGS[dataset]
    schema = T.StructType([*landing.envelope.fields, T.StructField(_CORRUPT, T.StringType())])
    lines = (spark.read.schema(schema).option("columnNameOfCorruptRecord", _CORRUPT).json(path)
             .withColumn(_FILE, F.col("_metadata.file_path")))
    each = (lines.select(_FILE, _CORRUPT, F.explode_outer("data").alias("row"))
            .filter(F.col("row").isNotNull() | F.col(_CORRUPT).isNotNull()).withColumn("reason", _reason(landing, "row")))
    counts = Observation(f"landed {dataset}")
    kept = F.col("reason").isNull()
    seen = each.withColumn("kept", kept).observe(counts, F.count("*").alias("read"), F.count_if(kept).alias("kept"), F.count_if(~kept).alias("rejected"))
    staged = fresh_path(spark, f"landed-{dataset}")
    seen.write.partitionBy("kept").parquet(staged)
    both = spark.read.schema(seen.schema).parquet(staged)
    got = counts.get
    if got["rejected"]:
        raw = F.coalesce(F.when(F.col("row").isNotNull(), F.to_json("row")), _CORRUPT)
        store.append_new("landed_reject", both.filter("NOT kept").select(
            F.lit(dataset).alias("dataset"), F.col(_FILE).alias("file"), "reason", F.md5(raw).alias("digest"), raw.alias("raw")))
    rows = both.filter("kept").select("row.*")
    filled = {name: F.coalesce(F.col(name), F.lit(value)) for name, value in landing.defaults}
    return Checked(rows.withColumns(filled) if filled else rows, got["read"], got["kept"], got["rejected"])


def _fields(schema: str) -> dict[str, str]:
    """Names and types of ``OBJECT<name: TYPE, ...>``; what is no plain type is read as text."""
    inner = schema.strip()[len("OBJECT<"):-1] if schema.strip().startswith("OBJECT<") else ""
    depth, starts = 0, [-1]
    for i, c in enumerate(inner):
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            starts.append(i)
    parts = [inner[i + 1:j] for i, j in zip(starts, [*starts[1:], len(inner)], strict=True)]
    plain = {"BIGINT", "DOUBLE", "STRING", "BOOLEAN", "DATE"}
    out = {}
    for part in parts:
        name, _, kind = part.strip().partition(": ")
        if kind:
            out[name.strip("`")] = kind.lower() if kind in plain else "double" if kind.startswith("DECIMAL") else "string"
    return out


def read_all_fields(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """Rows of a landing folder with all their fields: the known ones typed, with their defaults, then any other.

    Rows are read as variants, whose schemas are united in an aggregate, so a field that
    appears in some file is a column, with its common type, or text where there is none.
    A known field of another type is cast, and missing where that fails.
    """
    landing = LANDINGS[dataset]
    text = spark.read.text(path).filter("trim(value) <> ''")
    rows = text.select(F.explode(F.expr("try_variant_get(try_parse_json(value), '$.data', 'array<variant>')")).alias("row")).filter("row IS NOT NULL")
    found = rows.agg(F.schema_of_variant_agg("row").alias("s")).first().s
    defaults = dict(landing.defaults)
    columns = []
    for f in landing.fields:
        value = F.try_variant_get("row", f"$['{f.name}']", f.dataType.simpleString())
        columns.append((F.coalesce(value, F.lit(defaults[f.name])) if f.name in defaults else value).alias(f.name))
    known = {f.name for f in landing.fields}
    more = [F.try_variant_get("row", f"$['{name}']", kind).alias(name) for name, kind in sorted(_fields(found or "").items()) if name not in known]
    return rows.select(*columns, *more)

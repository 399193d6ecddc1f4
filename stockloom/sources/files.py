"""Company master files and the weekly ownership file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from stockloom import constants as C
from stockloom.functions.dates import compact_date, dashed_date, day_of
from stockloom.functions.text import strip
from stockloom.operators.keyed import restrict_keys


def ownership_columns(header: Sequence[str]) -> dict[str, str]:
    """Canonical name -> column of the file, the first one whose header holds a keyword."""
    found = {}
    for name, keywords in C.OWNERSHIP_HEADERS.items():
        match = [h for h in header if any(k in h for k in keywords)]
        if not match:
            raise ValueError(f"ownership file has no column for {name}: {list(header)}")
        found[name] = match[0]
    return found


def ownership_levels(raw: DataFrame, codes: DataFrame | Sequence[str] | None = None) -> DataFrame:
    """Ownership rows under canonical names; the day gets dashes, the code loses its blanks.

    Spellings of the headers vary, so columns are found by keyword.
    """
    raw = raw.toDF(*[c.strip() for c in raw.columns])
    source = {name: F.col(f"`{column}`") for name, column in ownership_columns(raw.columns).items()}
    rows = raw.select(
        strip(source["stock_id"].cast("string")).alias("stock_code"),
        dashed_date(source["date"]).alias("date"),
        *[source[c].alias(c) for c in ("HoldingSharesLevel", "people", "percent")])
    rows = rows.withColumns({"people": F.trim("people").try_cast("bigint"),
                             "percent": F.trim("percent").try_cast("double")})
    return rows if codes is None else restrict_keys(rows, codes)


def read_ownership(spark: SparkSession, path: str,
                   codes: DataFrame | Sequence[str] | None = None) -> DataFrame:
    """The weekly file, all columns as text; only its header is looked at up front."""
    return ownership_levels(spark.read.option("header", True).csv(path), codes)


COMPANY_FILE = T.StructType([T.StructField(name, T.StringType()) for name in C.COMPANY_FIELDS])


def industries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(C.INDUSTRIES.items()), "industry_code string, company_class string")


def companies(raw: DataFrame, codes: DataFrame | Sequence[str] | None = None) -> DataFrame:
    """Company master rows under stored names: texts trimmed, dates parsed, industry decoded.

    The industry table has a fixed few dozen rows and is broadcast.
    """
    named = raw.select(*[strip(F.coalesce(F.col(f"`{field}`"), F.lit(""))).alias(column)
                         for field, column in C.COMPANY_FIELDS.items()])
    if codes is not None:
        named = restrict_keys(named, codes)
    decoded = named.join(F.broadcast(industries(raw.sparkSession)), "industry_code", "left")
    return decoded.withColumns({
        "establishment_date": compact_date(F.col("establishment_date")),
        "listing_date": compact_date(F.col("listing_date")),
        "company_class": F.coalesce("company_class", F.lit(C.INDUSTRY_DEFAULT)),
        "market_class": F.lit(C.MARKET_CLASS), "main_business": F.lit(C.BUSINESS_TEXT),
    }).drop("industry_code")


def read_companies(spark: SparkSession, path: str,
                   codes: DataFrame | Sequence[str] | None = None) -> DataFrame:
    """The master file, one JSON array of records."""
    return companies(spark.read.schema(COMPANY_FILE).option("multiLine", True).json(path), codes)


def read_company_backup(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet copy of the company table; the short name falls back to the full name.

    Its columns may have their original or their stored names and its dates may
    be text; columns the stored table does not know, such as a record id, are left out.
    """
    df = spark.read.parquet(path)
    names = C.COMPANY_BACKUP_FIELDS | {stored: stored for stored in C.COMPANY_BACKUP_FIELDS.values()}
    df = df.select(*[F.col(c).alias(names[c]) for c in df.columns if c in names])
    if "company_name_abbr" not in df.columns:
        df = df.withColumn("company_name_abbr", F.col("company_name"))
    return df.withColumns({c: day_of(F.col(c).cast("string"))
                           for c in ("establishment_date", "listing_date") if c in df.columns})

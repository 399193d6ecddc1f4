"""Numbered parts of a table that changes: a base, and the changes since.

A part is a directory ``version=n`` (the whole table) or ``change=n`` (rows that came
after it), numbered in the order of writing and finished by its ``_SUCCESS`` file. A
reader takes the highest finished version and the finished changes above it, so it sees
the table before or after a write and nothing between. A number is never used again,
also not that of a write that broke off.

Compaction writes a new version and removes what the version before it replaced. That
version and its changes stay until the next compaction, for readers that already listed them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from stockloom.session import shuffles_removed

#: Changes a table gathers before it is compacted.
MOST_CHANGES = 16
#: Which change a row comes from.
CHANGE = "change"


@dataclass(frozen=True)
class Listing:
    """Finished parts: the base (0 for none), the changes above it, and all numbers in use with their kinds."""

    base: int
    changes: tuple[int, ...]
    used: tuple[tuple[int, str], ...]

    @property
    def next(self) -> int:
        return max((n for n, _ in self.used), default=0) + 1


class Parts:
    """The parts below ``path``. ``schema`` is the DDL of the stored columns, ``layout`` that of partition columns."""

    def __init__(self, spark: SparkSession, path: str, schema: str, layout: str = ""):
        self.spark, self.path = spark, path
        self.schema = ", ".join(x for x in (schema, layout) if x)
        self.layout = [c.split()[0] for c in layout.split(", ")] if layout else []

    def _folder(self, path: str):
        found = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return found.getFileSystem(self.spark._jsc.hadoopConfiguration()), found

    def listing(self) -> Listing:
        files, path = self._folder(self.path)
        used, finished = [], []
        for status in files.listStatus(path) if files.exists(path) else []:
            kind, _, number = status.getPath().getName().partition("=")
            if kind in ("version", CHANGE) and number.isdigit():
                used.append((int(number), kind))
                if files.exists(self._folder(f"{self.path}/{kind}={number}/_SUCCESS")[1]):
                    finished.append((int(number), kind))
        base = max((n for n, kind in finished if kind == "version"), default=0)
        return Listing(base, tuple(sorted(n for n, kind in finished if kind == CHANGE and n > base)), tuple(sorted(used)))

    def base(self, found: Listing) -> DataFrame:
        if not found.base:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/version={found.base}")

    def changes(self, found: Listing) -> DataFrame:
        """Rows of the changes, with the number of theirs."""
        paths = [f"{self.path}/{CHANGE}={n}" for n in found.changes]
        return self.spark.read.schema(f"{self.schema}, {CHANGE} int").option("basePath", self.path).parquet(*paths)

    def merged(self, key: list[str]) -> DataFrame:
        """The table as it is: of each key the row of the latest change, or else of the base.

        Only the changed keys are looked up in the base, which is not shuffled while they are few.
        """
        found = self.listing()
        base = self.base(found)
        if not found.changes:
            return base
        changes = self.changes(found)
        rest = [c for c in changes.columns if c not in (*key, CHANGE)]
        latest = changes.groupBy(*key).agg(F.max_by(F.struct(*rest), CHANGE).alias("now")).select(*key, "now.*") if rest else changes.select(*key).distinct()
        untouched = base.join(changes.select(*key).distinct(), key, "left_anti")
        return untouched.select(*base.columns).unionByName(latest.select(*base.columns))

    def write(self, rows: DataFrame, kind: str = CHANGE) -> int:
        """One part, rebalanced; the number it got."""
        number = self.listing().next
        out = rows.hint("rebalance", *self.layout) if self.layout else rows.hint("rebalance")
        writer = out.write.partitionBy(*self.layout) if self.layout else out.write
        with shuffles_removed(self.spark):
            writer.parquet(f"{self.path}/{kind}={number}")
        return number

    def compact(self, whole: Callable[[], DataFrame], most: int = MOST_CHANGES) -> bool:
        """Writes ``whole()`` as a new version if more than ``most`` changes came since the last one."""
        before = self.listing()
        if len(before.changes) <= most:
            return False
        self.write(whole(), "version")
        files, _ = self._folder(self.path)
        kept = before.base
        for number, kind in before.used:
            if number < kept:
                files.delete(self._folder(f"{self.path}/{kind}={number}")[1], True)
        return True

"""Benchmark decontamination by Wu-Manber multi-pattern search.

A window is 13 consecutive words of a benchmark item (the whole item, if shorter). A
document word inside any occurrence of a window is hit. Words are the symbols of the
search: of all windows of one length, the last block of two words is looked up in a
shift table. A block that no window holds lets the search jump by almost a whole
window; only where the shift is zero are the windows of that suffix bucket compared,
first by their first two words and then word by word.

The benchmark may be of any size: it is dealt into blocks of bounded bytes, and every
document meets every block (a stated query set against all rows). Nothing else of
unbounded size leaves the executors.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, functions as F

from stockloom.llm.common import append, free_name, written

WINDOW = 13
#: Bytes of benchmark text searched for in one pass; a pass holds about 20 times as much.
BLOCK_BYTES = 4_000_000
#: Windows of a long item that are dealt to blocks together.
PIECE = 1_000

#: ASCII letters to lower case, all other ASCII but digits to a space; the rest are word bytes.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(data: bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text (UTF-8) after lower-casing A-Z."""
    return data.translate(_WORD_BYTES).split() if data else []


class WuManber:
    """Shift and suffix tables over the windows of one length."""

    def __init__(self, windows: dict[tuple[bytes, ...], list[int]], length: int):
        self.length, self.block = length, min(2, length)
        self.default = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.bucket: dict[tuple[bytes, ...], list[tuple]] = {}
        for words, owners in windows.items():
            for end in range(self.block, length + 1):
                key = words[end - self.block:end]
                self.shift[key] = min(self.shift.get(key, self.default), length - end)
            self.bucket.setdefault(words[-self.block:], []).append((words[:self.block], words, owners))

    def search(self, text: list[bytes], found: set[int], spans: list[tuple[int, int]]) -> None:
        """Adds owners of occurring windows to ``found`` and occurrences to ``spans``, in order."""
        shift, length, block, default, n, end = self.shift.get, self.length, self.block, self.default, len(text), self.length
        while end <= n:
            key = tuple(text[end - block:end])
            step = shift(key, default)
            if step:
                end += step
                continue
            start = end - length
            head = tuple(text[start:start + block])
            for first, words, owners in self.bucket.get(key, ()):
                if first == head and tuple(text[start:end]) == words:
                    found.update(owners)
                    spans.append((start, end))
            end += 1


class Block:
    """All searches over one block of the benchmark."""

    def __init__(self, pieces: Iterable[tuple[str | None, bytes]], window: int):
        by_length: dict[int, dict[tuple[bytes, ...], list[int]]] = {}
        self.items: list[str] = []
        for item, text in pieces:
            words = text.split(b" ")
            size = min(window, len(words))
            for i in range(len(words) - size + 1):
                by_length.setdefault(size, {}).setdefault(tuple(words[i:i + size]), []).append(len(self.items))
            self.items.append(item)
        self.searches = [WuManber(windows, size) for size, windows in sorted(by_length.items())]

    def match(self, text: list[bytes]) -> tuple[set[str], list[tuple[int, int]]]:
        """Items with an occurring window, and the hit word ranges, merged."""
        found: set[int] = set()
        spans: list[tuple[int, int]] = []
        for search in self.searches:
            search.search(text, found, spans)
        return {self.items[i] for i in found}, merged(spans)


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def _pieces(benchmark: DataFrame, window: int) -> DataFrame:
    """item, text (words joined by a space), key: long items cut into overlapping pieces."""
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.regexp_extract_all(lowered, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))
    cut = benchmark.select(F.col("item_id").cast("string").alias("item"), words.alias("words")).filter("size(words) > 0")
    return (cut.withColumn("at", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - (window - 1)), F.lit(PIECE))))
            .select("item", F.array_join(F.slice("words", F.col("at"), PIECE + window - 1), " ").alias("text"),
                    F.xxhash64("item", "at").alias("key")))


class Benchmark:
    """The benchmark in blocks; :meth:`blocks` holds one of them at a time on the driver."""

    def __init__(self, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES):
        self.pieces, self.window = _pieces(benchmark, window), window
        size = self.pieces.agg(F.sum(F.octet_length("text") + F.coalesce(F.octet_length("item"), F.lit(0)) + 64)).first()[0] or 0
        self.count = max(1, math.ceil(size / block_bytes))

    def blocks(self) -> Iterator[Block]:
        for k in range(self.count):
            part = self.pieces.filter(F.pmod("key", F.lit(self.count)) == k) if self.count > 1 else self.pieces
            yield Block([(r.item, r.text.encode()) for r in part.select("item", "text").toLocalIterator()], self.window)


def _pass(docs: DataFrame, text: str, block: Block, names: list[str]) -> DataFrame:
    def make():
        def function(values: list[bytes | None]) -> Iterator[tuple]:
            for data in values:
                words = words_of(data)
                items, spans = block.match(words)
                yield len(words), sorted(i for i in items if i is not None), [{"s": s, "e": e} for s, e in spans]
        return function

    ddl = "{} long, {} array<string>, {} array<struct<s:long,e:long>>".format(*names)
    return append(docs, text, ddl, make)


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
         names: tuple[str, str, str] = ("n_words", "n_hit", "items")) -> DataFrame:
    """``docs`` with the number of words, of hit words, and the item ids with an occurring window.

    Null and empty texts have no words. Repeated documents give a row each. An item
    without words has no window; repeated items count once by their id, and a null
    id is not listed though its windows hit. An empty benchmark hits nothing.
    """
    n_words, n_hit, items = names
    searched, spans = Benchmark(benchmark, window, block_bytes), free_name(docs, "spans")
    if searched.count == 1:
        found = _pass(docs, "text", next(searched.blocks()), [n_words, items, spans])
        return found.select(*docs.columns, n_words, _covered(spans).alias(n_hit), items)
    # Each block's finds are written before the next block is made; rows meet again by a stored number.
    row = free_name(docs, "row")
    stored = written(docs.withColumn(row, F.monotonically_increasing_id()), "documents")
    parts = [written(_pass(stored.select(row, "text"), "text", b, [n_words, items, spans]).drop("text"), "hits") for b in searched.blocks()]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionAll(p)
    found = union.groupBy(row).agg(F.first(n_words).alias(n_words), _covered(F.flatten(F.collect_list(spans))).alias(n_hit),
                                   F.array_sort(F.array_distinct(F.flatten(F.collect_list(items)))).alias(items))
    return stored.join(found, row).select(*docs.columns, n_words, n_hit, items)


def _covered(spans: str | Column) -> Column:
    """Words covered by ranges that may overlap."""
    step = F.aggregate(
        F.array_sort(spans), F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).cast("long").alias("end")),
        lambda acc, x: F.struct((acc["sum"] + F.greatest(F.lit(0).cast("long"), x["e"] - F.greatest(x["s"], acc["end"]))).alias("sum"),
                                F.greatest(acc["end"], x["e"]).alias("end")))
    return step["sum"]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    digest = F.sha2(F.concat_ws(",", F.array_sort("items")), 256)
    return hits(docs.select("doc_id", "text"), benchmark, window, block_bytes).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"),
        rule("n_words", "n_hit").alias("contaminated"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents, all columns, that are not contaminated."""
    names = tuple(free_name(docs, n) for n in ("n_words", "n_hit", "items"))
    return hits(docs, benchmark, window, block_bytes, names).filter(~rule(*names[:2])).select(*docs.columns)


def rule(n_words: str, n_hit: str) -> Column:
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))

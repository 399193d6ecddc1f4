"""SimHash near-duplicates, found by deletion-variant signatures.

Fingerprints that differ in at most 4 of 64 bits differ in at most one bit of some
third of them. Each of three segments is therefore indexed once for every bit left
out (a one-wildcard variant): two fingerprints share such a variant exactly if that
segment differs in no other bit. The equality join on variants checks the whole
distance as its join condition and emits a pair at its first shared variant only.

Only distinct fingerprints take part, so copies cost nothing. Groups are the
connected components of the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from stockloom.llm.common import append, free_name, shuffled, written
from stockloom.llm.components import connected_components

SHINGLE, DISTANCE, SEED = 4, 4, 42
#: First bit and length of the segments; with k segments, distances below 2k are found.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
_CHUNK = 1 << 16


def fingerprint(data: bytes | None, size: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of a text (UTF-8); 0 if it has no words."""
    from xxhash import xxh64_intdigest

    words = data.lower().split() if data else []
    if not words:
        return 0
    count, n = np.zeros(64, np.int64), max(1, len(words) - size + 1)
    for at in range(0, n, _CHUNK):
        part = words[at:at + _CHUNK + size - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(size)))) if len(part) >= size else [b" ".join(part)]
        hashes = np.fromiter((xxh64_intdigest(s, SEED) for s in shingles), "<u8")
        count += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * count > n, bitorder="little").view("<i8")[0])


def with_fingerprints(docs: DataFrame, name: str = "fp", size: int = SHINGLE) -> DataFrame:
    """``docs`` with the fingerprint of ``text`` as a long."""
    def make():
        def function(values: list[bytes | None]) -> Iterator[tuple]:
            return ((fingerprint(v, size),) for v in values)
        return function

    return append(docs, "text", f"{name} long", make)


def _mask(first: int, length: int) -> int:
    return ((1 << length) - 1) << first


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _variants(fp: str) -> Column:
    """Array of the 64 one-wildcard segment variants: left-out bit and the other bits of its segment."""
    out = []
    for first, length in SEGMENTS:
        segment = F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << length) - 1)).cast("int")
        out += [segment.bitwiseAND(F.lit(~(1 << i))).bitwiseOR(F.lit((first + i) << 22)) for i in range(length)]
    return F.array(*out)


def links(fingerprints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Pairs a < b of distinct fingerprints (column fp) that differ in at most ``distance`` bits."""
    if distance >= 2 * len(SEGMENTS):
        raise ValueError(f"at most {2 * len(SEGMENTS) - 1} bits with {len(SEGMENTS)} segments")
    index = fingerprints.select("fp", F.explode(_variants("fp")).alias("variant"))
    left, right = index.select(F.col("fp").alias("a"), "variant"), index.select(F.col("fp").alias("b"), "variant")
    differs = F.col("a").bitwiseXOR(F.col("b"))
    bit = F.shiftright("variant", 22)
    # The first shared variant: its segment differs in that bit alone or, if in none, the bit is the
    # segment's first; no earlier segment differs in fewer than two bits.
    first = F.lit(False)
    earlier = F.lit(True)
    for start, length in SEGMENTS:
        part = differs.bitwiseAND(F.lit(_signed(_mask(start, length))))
        first |= bit.between(start, start + length - 1) & earlier & ((part != 0) | (bit == start))
        earlier &= F.bit_count(part) > 1
    return (left.join(shuffled(right), "variant")
            .filter((F.col("a") < F.col("b")) & (F.bit_count(differs) <= distance) & first)
            .select("a", "b"))


def groups(fingerprints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """fp, component (least fingerprint reachable) for every distinct fingerprint with a link."""
    return connected_components(links(fingerprints, distance)).select(F.col("node").alias("fp"), "component")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable).

    Null and empty texts have fingerprint 0 and are linked like any other. Repeated
    rows give a row each. A null doc_id is never a component_id unless the whole
    component has no other. An empty table gives no rows.
    """
    prints = written(with_fingerprints(docs.select("doc_id", "text"), "fp", size).drop("text"), "fingerprints")
    return _labelled(prints, "doc_id", "fp", distance).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _labelled(prints: DataFrame, doc_id: str, fp: str, distance: int) -> DataFrame:
    """``prints`` with component (its least fingerprint) and component_id."""
    own = written(prints.groupBy(F.col(fp).alias("fp")).agg(F.min(doc_id).alias("least")), "representatives")
    linked = groups(own, distance)
    label = own.join(linked, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    lowest = label.groupBy("component").agg(F.min("least").alias("component_id"))
    whole = label.join(lowest, "component").select(F.col("fp").alias(fp), "component", "component_id")
    return prints.join(whole, fp)


def without_near_duplicates(docs: DataFrame, size: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """One document of each group, all columns: the one with the least doc_id.

    Rows of one doc_id with different texts are different documents: each goes by the
    group of its own text, and within a group ties of doc_id go by a hash of the text.
    Rows that repeat the kept document, doc_id and text, are cut to one. In a group
    without any doc_id the tie alone decides.
    """
    names = {n: free_name(docs, n) for n in ("fp", "tie", "repeats")}
    fp, tie, repeats = names["fp"], names["tie"], names["repeats"]
    text = docs.select("doc_id", "text", F.xxhash64("text").alias(tie))
    prints = written(with_fingerprints(text, fp, size).drop("text"), "fingerprints")
    key = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", tie)
    first = _labelled(prints, "doc_id", fp, distance).groupBy("component").agg(F.min(key).alias("first")).select("first.doc_id", f"first.{tie}")
    times = prints.groupBy("doc_id", tie).agg(F.count("*").alias(repeats))
    kept = written(_same_document(first.distinct(), shuffled(times), tie, "inner").select(first["doc_id"], first[tie], repeats), "kept")
    own = docs.withColumn(tie, F.xxhash64("text"))
    # The same join at every size: the kept documents grow with the table.
    once = _same_document(own, kept.filter(F.col(repeats) == 1).hint("merge"), tie, "left_semi")
    if kept.filter(F.col(repeats) > 1).isEmpty():
        return once.select(*docs.columns)
    again = _same_document(own, kept.filter(F.col(repeats) > 1), tie, "left_semi").dropDuplicates(["doc_id", tie])
    return once.unionByName(again).select(*docs.columns)


def _same_document(left: DataFrame, right: DataFrame, tie: str, how: str) -> DataFrame:
    """Join on doc_id (nulls are equal) and the hash of the text."""
    return left.join(right, left["doc_id"].eqNullSafe(right["doc_id"]) & (left[tie] == right[tie]), how)

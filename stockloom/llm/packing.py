"""Packing documents into windows of tokens by non-negative least squares.

Whole windows of long documents stand alone. For what is left of each document the
histogram of lengths over all documents is taken; shallow combinations of two or three
lengths that fill a window exactly are its candidate columns, and non-negative least
squares gives each a number of repeats. Every task packs its documents by its share
of these numbers, rounded; the residuals are packed greedily, longest first, each
filling the window that the one before left open, so only they are ever cut.

Only the histogram (a row per length) and the combinations reach the driver. The ids
are computed once, written, and never shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stockloom.llm.common import expand, written
from stockloom.llm.tokens import with_ids

WINDOW = 4096
#: Triples kept for each longest length, those whose rarest length is most frequent; residuals take the rest.
TRIPLES = 4
SWEEPS = 40
#: Ids that a task packs at once.
CHUNK_IDS, CHUNK_DOCS = 16_000_000, 100_000


def combinations(counts: np.ndarray, triples: int = TRIPLES) -> list[tuple[int, ...]]:
    """Pairs and triples of lengths with documents that fill the window; ``counts`` is indexed by length."""
    window = len(counts)
    there = np.flatnonzero(counts)
    out: list[tuple[int, ...]] = [(int(a), int(window - a)) for a in there if 2 * a >= window and counts[window - a]]
    for a in there[3 * there >= window]:
        rest = window - a
        b = np.arange((rest + 1) // 2, min(a, rest - 1) + 1)
        b = b[(counts[b] > 0) & (counts[rest - b] > 0)]
        if len(b):
            rarest = np.minimum(counts[b], counts[rest - b])
            out += [(int(a), int(x), int(rest - x)) for x in b[np.argsort(-rarest, kind="stable")[:triples]]]
    return out


def solve(counts: np.ndarray, columns: list[tuple[int, ...]], sweeps: int = SWEEPS) -> np.ndarray:
    """Non-negative x that brings the columns' sum near to ``counts``, by exact coordinate descent."""
    left = counts.astype(float).tolist()
    uses = [[(n, c.count(n)) for n in set(c)] for c in columns]
    norms = [sum(k * k for _, k in u) for u in uses]
    x = [0.0] * len(columns)
    for _ in range(sweeps):
        moved = 0.0
        for j, (u, norm) in enumerate(zip(uses, norms, strict=True)):
            step = sum(k * left[n] for n, k in u) / norm
            step = max(step, -x[j])
            if step:
                x[j] += step
                moved = max(moved, abs(step))
                for n, k in u:
                    left[n] -= k * step
        if moved < 0.05:
            break
    return np.array(x)


def plan(counts: np.ndarray) -> list[tuple[tuple[int, ...], float]]:
    """Combinations with their repeats for each document counted, most repeats first."""
    columns = combinations(counts)
    repeats = solve(counts, columns)
    return [(columns[j], float(repeats[j] / counts.sum())) for j in np.argsort(-repeats, kind="stable") if repeats[j] > 0.01]


def pack_lengths(lengths: np.ndarray, shares: list[tuple[tuple[int, ...], float]], window: int = WINDOW) -> np.ndarray:
    """Pieces (document, start, length, sequence, offset) of documents of these lengths; sequences count from 0."""
    whole, rest = lengths // window, lengths % window
    doc = np.repeat(np.arange(len(lengths)), whole)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(whole) - whole, whole)
    rows = [np.column_stack([doc, nth * window, np.full(len(doc), window), np.arange(len(doc)), np.zeros(len(doc), int)])]
    sequences = len(doc)
    order = np.argsort(rest, kind="stable")
    order = order[rest[order] > 0]
    bounds = np.searchsorted(rest[order], np.arange(window + 1))
    taken, ends = bounds[:-1].copy(), bounds[1:]
    for lengths_of, share in shares:
        n = round(share * len(order))
        for x in set(lengths_of):
            n = min(n, int(ends[x] - taken[x]) // lengths_of.count(x))
        if n <= 0:
            continue
        offset = 0
        for x in lengths_of:
            d = order[taken[x]:taken[x] + n]
            taken[x] += n
            rows.append(np.column_stack([d, whole[d] * window, np.full(n, x), sequences + np.arange(n), np.full(n, offset)]))
            offset += x
        sequences += n
    left = np.concatenate([order[taken[x]:ends[x]] for x in range(window - 1, 0, -1)] or [order[:0]])
    if len(left):
        first = np.cumsum(rest[left]) - rest[left]
        total = int(rest[left].sum())
        edges = list(range(0, total - total % window + 1, window))
        for bit in reversed(range((total % window).bit_length())):  # a power of two needs no padding
            if total % window >> bit & 1:
                edges.append(edges[-1] + (1 << bit))
        edges = np.array(edges)
        cuts = np.union1d(first, edges[:-1])
        size = np.diff(np.append(cuts, total))
        at, seq = np.searchsorted(first, cuts, "right") - 1, np.searchsorted(edges, cuts, "right") - 1
        d = left[at]
        rows.append(np.column_stack([d, whole[d] * window + cuts - first[at], size, sequences + seq, cuts - edges[seq]]))
    return np.concatenate(rows)


def packed(docs: DataFrame, tokenizer: str, window: int = WINDOW) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text has the end id alone. Repeated rows, also those with one doc_id
    or none, are documents of their own. An empty table gives no rows. Sequence numbers
    are distinct, with gaps between tasks.
    """
    ids = written(with_ids(docs, tokenizer), "tokens")
    counts = np.zeros(window, np.int64)
    for r in ids.groupBy((F.col("n_tokens") % window).cast("int").alias("rest")).count().filter("rest > 0").collect():
        counts[r.rest] = r["count"]
    shares = plan(counts) if counts.any() else []

    def make():
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 40

        def chunk(names: list, held: list[bytes], tokens: list[int], base: int) -> Iterator[tuple]:
            pieces = pack_lengths(np.array(tokens), shares, window)
            arrays = [np.frombuffer(h, "<u2" if len(h) == 2 * n else "<u4") for h, n in zip(held, tokens, strict=True)]
            for d, start, length, sequence, offset in pieces.tolist():
                yield (names[d], start, length, zlib.crc32(arrays[d][start:start + length].astype("<u4").tobytes()), tokens[d],
                       base + sequence, offset)

        def function(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
            names, held, tokens, size, base = [], [], [], 0, first
            for b in batches:
                for name, data, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    names.append(name)
                    held.append(data)
                    tokens.append(n)
                    size += n
                    if size >= CHUNK_IDS or len(names) >= CHUNK_DOCS:
                        yield from chunk(names, held, tokens, base)
                        names, held, tokens, size, base = [], [], [], 0, base + size
            if names:
                yield from chunk(names, held, tokens, base)
        return function

    ddl = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return expand(ids.select("doc_id", "ids", "n_tokens"), ddl, make, rows=20_000)

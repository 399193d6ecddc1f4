"""Jaccard join of documents on word n-grams, filtered under several global token orders.

Two sets with a Jaccard similarity of at least t share a token within the first
n - ceil(t n) + 1 tokens of each, whatever order all tokens are put in. Every order is a
filter, and a candidate has to pass them all before its sets are compared: the first
order is an index (documents meet at the tokens of their prefixes, where sizes and
places must allow the similarity), the others are looked up for the pairs it leaves.
Bitmaps of the sets, which bound the difference of two sets from below, keep most sets
from moving for that; what passes all orders is verified. In all orders the most frequent
tokens come last (a bounded list, which decides nothing but the cost); the others are
ordered by different hashes.

Classes need no pair of members that are known to be connected. So documents are first
compared with one leader of each of their tokens. What that links is contracted, and
only pairs of different components follow. Equal sets are one set from the start.

Tokens are 64-bit hashes of n-grams, and a set is known by a 64-bit hash of its tokens.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType
from xxhash import xxh64_intdigest

from stockloom.llm.common import SLICE, expand, written
from stockloom.llm.components import connected_components

SIZE, SHARE = 4, 85
#: Orders of all tokens; the first one is indexed.
ORDERS = 3
#: Greatest number of tokens that are known to be frequent, and how often a window of WINDOW tokens must hold one to report it.
FREQUENT, WINDOW, REPORTED = 1 << 17, 4_000_000, 3
#: Documents of a frequent token that share a leader, and partners that are compared in one stretch.
GROUP, STRETCH = 10_000, 256
#: Prefix tokens of a range of the index, which a task holds as arrays, and of a part of it that one task sends.
RANGE, PART = 1_000_000, 1_000_000
#: Bits of the filter that keeps sets without a candidate from moving.
FILTER_BITS = 25
_PIECE = 1 << 20
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def _scrambled(x: np.ndarray, by: int) -> np.ndarray:
    """A permutation of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(31))) * _MIX[by]
    return x ^ (x >> np.uint64(29))


def _grams(words: list[bytes], size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words, from the hashes of the words."""
    h = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    n = len(h) - size + 1
    total = np.zeros(n, np.uint64)
    for i in range(size):
        total = _scrambled(total + h[i:i + n] * np.uint64(2 * i + 1), i % len(_MIX))
    return total


def tokens_of(data: bytes | None, size: int = SIZE) -> np.ndarray:
    """Ascending distinct hashes of a text's n-grams; fewer words are one n-gram, none are none."""
    parts, words, at, more = [], [], 0, False
    data = data.lower() if data else b""
    while at < len(data):
        end = at + _PIECE
        while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        words += data[at:end].split()
        at = end
        if len(words) >= size:
            parts.append(np.unique(_grams(words, size)))
            words, more = words[len(words) - size + 1:], True
    if words and not more:
        parts.append(_grams(words, len(words)))
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def name_of(tokens: np.ndarray) -> int:
    """Signed 64-bit hash of a set."""
    return xxh64_intdigest(tokens.tobytes(), 1) - (1 << 63)


def prefix_length(n: int, share: int = SHARE) -> int:
    return n - -(-share * n // 100) + 1


class Orders:
    """The global orders: frequent tokens last, by frequency, the others by a hash of each order."""

    def __init__(self, frequent: list[int]):
        """``frequent`` are unsigned tokens, the rarest first."""
        listed = np.array(frequent, np.uint64)
        at = np.argsort(listed, kind="stable")
        self.tokens, self.ranks = listed[at], at + 1

    def rank(self, tokens: np.ndarray) -> np.ndarray:
        """0, or the place among the frequent tokens."""
        if not len(self.tokens):
            return np.zeros(len(tokens), np.int64)
        at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
        return np.where(self.tokens[at] == tokens, self.ranks[at], 0)

    def prefix(self, tokens: np.ndarray, order: int, share: int = SHARE) -> np.ndarray:
        """Tokens of the prefix, in order; ``tokens`` are ascending, which is the first order."""
        row = tokens[np.argsort(_scrambled(tokens, order), kind="stable")] if order else tokens
        n, wanted = len(row), prefix_length(len(row), share)
        end = min(n, wanted + 64)
        while True:
            ranks = self.rank(row[:end])
            rare = row[:end][ranks == 0]
            if len(rare) >= wanted:
                return rare[:wanted]
            if end == n:
                last = row[ranks > 0][np.argsort(ranks[ranks > 0], kind="stable")]
                return np.concatenate([rare, last])[:wanted]
            end = min(n, 2 * end)


def _texts(batches: Iterator[pa.RecordBatch], size: int, wanted: Callable[[int | None], bool] = lambda _: True) -> Iterator[tuple[int | None, np.ndarray]]:
    """doc_id and tokens of the rows (doc_id, text) whose doc_id is wanted."""
    for whole in batches:
        ids = whole.column(0).to_pylist()
        rows = pa.array([i for i, doc_id in enumerate(ids) if wanted(doc_id)], pa.int64())
        for k in range(0, len(rows), SLICE):
            b = whole.take(rows.slice(k, SLICE))
            for doc_id, data in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                yield doc_id, tokens_of(data, size)


def _described(docs: DataFrame, size: int) -> DataFrame:
    """Rows (1, doc_id, its set, tokens of it), and (0, token, -, times) for tokens that a task met often in different sets."""
    def make():
        def often(held: list[np.ndarray]) -> Iterator[tuple]:
            tokens, times = np.unique(np.concatenate(held), return_counts=True)
            for t, n in zip(tokens[times >= REPORTED].view(np.int64).tolist(), times[times >= REPORTED].tolist(), strict=True):
                yield 0, t, None, n

        def function(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
            held, n, seen = [], 0, set()
            for doc_id, tokens in _texts(batches, size):
                node = name_of(tokens) if len(tokens) else None
                yield 1, doc_id, node, len(tokens)
                if node is not None and node not in seen:
                    seen.add(node)
                    held.append(tokens)
                    n += len(tokens)
                    if n >= WINDOW:
                        yield from often(held)
                        held, n = [], 0
            if held:
                yield from often(held)
        return function

    return expand(docs.select("doc_id", "text"), "kind int, id long, node long, n long", make)


def _packed(tokens: np.ndarray, salts: np.ndarray, owners: np.ndarray, places: np.ndarray, nodes: np.ndarray, sizes: np.ndarray) -> bytes:
    used, at = np.unique(owners, return_inverse=True)
    columns = [tokens.astype("<u8"), salts.astype("<i4") if salts.any() else np.zeros(0, "<i4"), at.astype("<u2" if len(used) <= 1 << 16 else "<i4"),
               places.astype("<u2" if places.max() < 1 << 16 else "<i4"), nodes[used].astype("<i8"), sizes[used].astype("<i4")]
    return b"".join(len(c).to_bytes(4, "little") + c.itemsize.to_bytes(1, "little") + c.tobytes() for c in columns)


def _unpacked(data: bytes) -> list[np.ndarray]:
    """tokens, salts, places, nodes and sizes of the rows of a part."""
    at, columns = 0, []
    for sign in "uiuuii":
        n, width = int.from_bytes(data[at:at + 4], "little"), data[at + 4]
        columns.append(np.frombuffer(data, f"<{'u' if sign == 'u' and width in (2, 8) else 'i'}{width}", n, at + 5))
        at += 5 + n * width
    tokens, salts, owners, places, nodes, sizes = columns
    return [tokens, salts if len(salts) else np.zeros(len(tokens), "<i4"), places.astype(np.int64), nodes[owners], sizes[owners]]


_SHARED = "token long, salted boolean, node long, n int, place int, leader_node long, leader_n int, leader_place int"


def _index(docs: DataFrame, frequent: list[tuple[int, int]], ranges: int, size: int, share: int, group: int) -> DataFrame:
    """token, salted, node, n, place, and the leader: the prefixes of the first order at tokens of several sets.

    Tokens are dealt to ranges by their hashes, and travel as arrays. A range holds a bounded number of rows, as frequent
    tokens are split by salts. A leader is the set of a token and salt with the token at its first place.
    """
    def make_parts():
        orders = Orders([t & (1 << 64) - 1 for t, _ in frequent])
        salts = np.array([1] + [-(-n // group) for _, n in frequent])

        def parts(held: list[np.ndarray], nodes: list[int]) -> Iterator[tuple]:
            names, sizes = np.array(nodes, np.int64), np.array([len(x) for x, _ in held])
            owners = np.repeat(np.arange(len(held)), [len(p) for _, p in held])
            tokens, places = np.concatenate([p for _, p in held]), np.concatenate([np.arange(len(p)) for _, p in held])
            split = salts[orders.rank(tokens)]
            salt = np.where(split > 1, 1 + names[owners] % split, 0)
            place = ((tokens + salt.astype(np.uint64) * _MIX[0]) % np.uint64(ranges)).astype(np.int64)
            order = np.argsort(place, kind="stable")
            cuts = np.flatnonzero(np.diff(place[order])) + 1
            for rows in np.split(order, cuts):
                yield int(place[rows[0]]), _packed(tokens[rows], salt[rows], owners[rows], places[rows], names, sizes)

        def function(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
            seen, held, nodes, n = set(), [], [], 0
            for _, tokens in _texts(batches, size):
                node = name_of(tokens) if len(tokens) else None
                if node is None or node in seen:
                    continue
                seen.add(node)
                held.append((tokens, orders.prefix(tokens, 0, share)))
                nodes.append(node)
                n += len(tokens)
                if n >= PART:
                    yield from parts(held, nodes)
                    held, nodes, n = [], [], 0
            if held:
                yield from parts(held, nodes)
        return function

    dealt = expand(docs.select("doc_id", "text"), "range int, part binary", make_parts).repartition("range").sortWithinPartitions("range")

    def shared(held: list[bytes], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        tokens, salts, places, nodes, sizes = (np.concatenate(c) for c in zip(*map(_unpacked, held), strict=True))
        order = np.lexsort((nodes, sizes, places, salts, tokens))
        tokens, salts, places, nodes, sizes = (c[order] for c in (tokens, salts, places, nodes, sizes))
        first = np.flatnonzero(np.concatenate([[True], (np.diff(tokens) != 0) | (np.diff(salts) != 0)]))
        group_of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(tokens))))
        kept = (salts > 0) | (np.minimum.reduceat(nodes, first) != np.maximum.reduceat(nodes, first))[group_of]
        at = first[group_of][kept]
        values = (tokens[kept].view(np.int64), salts[kept] > 0, nodes[kept], sizes[kept], places[kept], nodes[at], sizes[at], places[at])
        batch = pa.RecordBatch.from_arrays([pa.array(c).cast(f.type) for c, f in zip(values, schema, strict=True)], schema=schema)
        for i in range(0, batch.num_rows, 100_000):
            yield batch.slice(i, 100_000)

    columns = StructType.fromDDL(_SHARED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, now, held = to_arrow_schema(columns), None, []
        for b in batches:
            for at, part in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if at != now and held:
                    yield from shared(held, schema)
                    held = []
                now = at
                held.append(part)
        if held:
            yield from shared(held, schema)

    return (dealt.mapInArrow(run, columns)
            .select("token", "salted", "node", "n", "place", F.struct(F.col("leader_node").alias("node"), F.col("leader_n").alias("n"), F.col("leader_place").alias("place")).alias("leader")))


def _possible(a: str, b: str, share: int) -> Column:
    """Whether two sets can be similar that first meet at a token with these places in them."""
    n, m, i, j = F.col(f"{a}.n"), F.col(f"{b}.n"), F.col(f"{a}.place"), F.col(f"{b}.place")
    return (F.least(n, m) * 100 >= F.greatest(n, m) * share) & (F.least(n - i, m - j) * (100 + share) >= (n + m) * share)


def _bitmap(tokens: np.ndarray) -> bytes:
    """The size of a set, and a bit for each value of its tokens' last bits: twice as many bits as tokens, or more."""
    bits = max(64, 1 << (2 * len(tokens) - 1).bit_length())
    seen = np.zeros(bits, np.uint8)
    seen[(tokens & np.uint64(bits - 1)).astype(np.int64)] = 1
    return len(tokens).to_bytes(8, "little") + np.packbits(seen, bitorder="little").tobytes()


def _read_bitmap(data: bytes) -> tuple[int, int, int]:
    """Size of the set, number of bits, bits."""
    return int.from_bytes(data[:8], "little"), 8 * (len(data) - 8), int.from_bytes(data[8:], "little")


def _may_pass(own: tuple[int, int, int], other: tuple[int, int, int], share: int) -> bool:
    """Whether two sets may be similar: bits that only one of them has are tokens that only one of them has."""
    (n, width, x), (m, narrow, y) = (own, other) if own[1] >= other[1] else (other, own)
    while width > narrow:
        width //= 2
        x = x >> width | x & (1 << width) - 1
    return (x ^ y).bit_count() * (100 + share) <= (n + m) * (100 - share)


def _is_similar(own: tuple[np.ndarray, list[np.ndarray]], other: tuple[np.ndarray, list[np.ndarray]], share: int) -> bool:
    """Whether two sets share prefix tokens in all orders, and then enough tokens."""
    (x, prefixes), (y, others) = own, other
    if not all(np.isin(p, q).any() for p, q in zip(prefixes, others, strict=True)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= share * (len(x) + len(y) - both)


def _compared(docs: DataFrame, own: DataFrame, pairs: DataFrame, size: int, label: str, data_of, make_read, test) -> DataFrame:
    """The pairs (a, b) that pass ``test``, of sets made from their tokens; many b may share an a.

    Sets are made in a scan, from the texts whose doc_id is the least one of a set and passes a filter of fixed size.
    """
    modulus = 1 << FILTER_BITS
    nodes = pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b")).distinct().join(own, "node")
    bit = F.pmod(F.coalesce("least", F.lit(0)), F.lit(modulus))
    maps = (nodes.select(F.floor(bit / 32768).cast("int").alias("part"), (bit % 32768).alias("bit"))
            .groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits")).collect())
    known = np.zeros(modulus >> 3, np.uint8)
    for r in maps:
        known[r.part * 4096:(r.part + 1) * 4096] = np.frombuffer(r.bits, np.uint8)

    def make_sets():
        def wanted(doc_id: int | None) -> bool:
            at = (doc_id or 0) % modulus
            return bool(known[at >> 3] >> (at & 7) & 1)

        def function(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
            seen = set()
            for _, tokens in _texts(batches, size, wanted):
                node = name_of(tokens) if len(tokens) else None
                if node is not None and node not in seen:
                    seen.add(node)
                    yield node, data_of(tokens)
        return function

    sets = written(expand(docs.select("doc_id", "text"), "node long, data binary", make_sets), label)
    stretch = F.pmod(F.xxhash64("b"), F.ceil(F.col("partners") / STRETCH)).alias("stretch")
    dealt = pairs.join(pairs.groupBy("a").agg(F.count("*").alias("partners")), "a").select("a", "b", stretch)
    first = dealt.select("a", "stretch").distinct().join(sets, F.col("a") == F.col("node")).select("a", "stretch", F.lit(None).cast("long").alias("b"), "data")
    rest = dealt.join(sets, F.col("b") == F.col("node")).select("a", "stretch", "b", "data")
    rows = first.unionByName(rest).repartition("a", "stretch").sortWithinPartitions("a", "stretch", F.col("b").asc_nulls_first())

    def make():
        read = make_read()

        def function(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
            now = None
            for whole in batches:
                for k in range(0, whole.num_rows, SLICE):
                    for a, b, data in zip(*(c.to_pylist() for c in whole.slice(k, SLICE).columns), strict=True):
                        if b is None:
                            now = read(data)
                        elif test(now, read(data)):
                            yield a, b
        return function

    return written(expand(rows.select("a", "b", "data"), "a long, b long", make), "pairs")


def _similar(docs: DataFrame, own: DataFrame, pairs: DataFrame, frequent: list[tuple[int, int]], size: int, share: int) -> DataFrame:
    """The candidates (a, b) that are similar: those whose bitmaps allow it and that share prefix tokens in the other orders, verified."""
    def make_read():
        orders = Orders([t & (1 << 64) - 1 for t, _ in frequent])

        def read(data: bytes) -> tuple[np.ndarray, list[np.ndarray]]:
            tokens = np.frombuffer(data, np.uint64)
            return tokens, [orders.prefix(tokens, r, share) for r in range(1, ORDERS)]
        return read

    left = _compared(docs, own, pairs, size, "bitmaps", _bitmap, lambda: _read_bitmap, lambda a, b: _may_pass(a, b, share))
    return _compared(docs, own, left, size, "sets", np.ndarray.tobytes, make_read, lambda a, b: _is_similar(a, b, share))


def _leader_pairs(shared: DataFrame, share: int) -> DataFrame:
    """Pairs of a leader and the others of its token, and of the leaders of a token that is split, that can be similar."""
    own = shared.select("leader", F.struct("node", "n", "place").alias("x"))
    tops = shared.filter("salted").select("token", "leader").distinct()
    top = tops.groupBy("token").agg(F.min("leader").alias("top"))
    both = own.unionByName(tops.join(top, "token").select(F.col("top").alias("leader"), F.col("leader").alias("x")), allowMissingColumns=True)
    both = both.filter((F.col("leader.node") != F.col("x.node")) & _possible("leader", "x", share))
    return both.select(F.col("leader.node").alias("a"), F.col("x.node").alias("b")).distinct()


def _cross_pairs(shared: DataFrame, known: DataFrame, share: int) -> DataFrame:
    """Pairs of different components that meet at a token and can be similar: those outside a token's largest component, with all others."""
    rows = written(shared.join(known, "node", "left").select("token", F.coalesce("component", "node").alias("component"), F.struct("node", "n", "place").alias("x")), "placed")
    sizes = rows.groupBy("token", "component").agg(F.count("*").alias("size"))
    main = sizes.groupBy("token").agg(F.max(F.struct("size", "component")).alias("main"), F.count("*").alias("components")).filter("components > 1")
    open_ = rows.join(main.select("token", F.col("main.component").alias("main")), "token")
    left = open_.filter("component <> main").select("token", F.col("component").alias("of"), F.col("x").alias("y"))
    met = left.join(open_, "token").filter((F.col("of") != F.col("component")) & ((F.col("component") == F.col("main")) | (F.col("y.node") < F.col("x.node"))) & _possible("y", "x", share))
    return met.select(F.col("y.node").alias("a"), F.col("x.node").alias("b")).distinct()


def classes(docs: DataFrame, size: int = SIZE, share: int = SHARE, frequent_tokens: int = FREQUENT, group: int = GROUP) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the least doc_id reachable over links).

    Sets with ``100 * intersection >= share * union`` are linked, exactly. Texts without
    words and null texts are linked with nothing and are their own component. Repeated
    rows give a row each, and rows of one doc_id with different texts are different
    documents. A null doc_id is a component_id only where a component has no other. No
    rows give no rows.
    """
    described = written(_described(docs, size), "described")
    often = (described.filter("kind = 0").groupBy("id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "id").limit(frequent_tokens).collect())
    frequent = sorted(((r.id, r.n) for r in often), key=lambda x: (x[1], x[0]))
    sets = described.filter("kind = 1").select(F.col("id").alias("doc_id"), "node", "n")

    named = sets.filter("node IS NOT NULL")
    own = written(named.groupBy("node").agg(F.min("doc_id").alias("least")), "representatives")
    total = named.agg(F.coalesce(F.sum(F.col("n") * (100 - share) / 100 + 1), F.lit(0)).alias("rows")).first().rows
    shared = written(_index(docs, frequent, int(total // RANGE) + 1, size, share, group), "shared")

    pairs = written(_leader_pairs(shared, share), "pairs")
    links = _similar(docs, own, pairs, frequent, size, share)
    known = connected_components(links)
    tried = pairs.unionAll(pairs.select("b", "a"))
    more = written(_cross_pairs(shared, known, share).join(tried, ["a", "b"], "left_anti"), "pairs")
    links = links.unionByName(_similar(docs, own, more, frequent, size, share))
    known = connected_components(links).select("node", "component")

    own = written(own.join(known, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component")), "labels")
    lowest = own.groupBy("component").agg(F.min("least").alias("component_id"))
    labels = own.join(lowest, "component").select("node", "component_id")
    return (named.join(labels, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
            .unionByName(sets.filter("node IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))))

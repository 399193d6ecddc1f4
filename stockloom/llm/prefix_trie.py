"""Prefix trie of conversations by vertical bitmaps.

Conversations are dealt to shards, ranges of their ids. A shard's index has a bitset of
its conversations for every (position, turn). Depth first, the bitset of a node is met
with the posting of the next turn of its least conversation not yet placed: the
intersection is a child, what is left goes on. Popcounts are the members; with the bitset
of the conversations of that length, the intersection is the list of those that end there.

Nodes of different shards are one if the hashes of their paths (128 bits, chained) are
equal. Members are added up and the least conversation found over the shards. It owns
the node: all nodes above it are in its shard too. So each shard sums what it owns up its
own trie, and the sums of the nodes that several shards have are added up. Lists of ends
are hashed as a stream, shard by shard. Only hashes of turns leave the first step.

A conversation is read by one task without its texts; shards need memory in proportion to
the turns of their conversations. Copies of a conversation cost a row for each shard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from stockloom.llm.common import expand, written

#: Conversations whose ids have one multiple of GROUP below them share first turns, at most HEADS - 1 of them.
GROUP, HEADS = 20, 4
#: Ids of a shard, a multiple of GROUP.
SHARD = 2_000
WORD = r"[^\x20\x09-\x0D]+"


def _base(conv_id: str) -> Column:
    return F.col(conv_id) - F.col(conv_id) % GROUP


class Shard:
    """The conversations of a shard: ids in order, and their original turns as numbers of distinct turns."""

    def __init__(self):
        self.ids: list[int] = []
        self.turns: list[list[int]] = []
        self.heads: list[int] = []
        self.numbers: dict[bytes, int] = {}
        self.words: list[int] = []

    def add(self, conv_id: int, head: int, digest: bytes, words: int) -> None:
        if not self.ids or self.ids[-1] != conv_id:
            self.ids.append(conv_id)
            self.turns.append([])
            self.heads.append(head)
        number = self.numbers.setdefault(digest, len(self.numbers))
        if number == len(self.words):
            self.words.append(words)
        self.turns[-1].append(number)

    def rebuilt(self) -> list[list[int]]:
        """Each conversation with the first turns of the first one of its group."""
        first = {c: t for c, t in zip(self.ids, self.turns, strict=True) if c % GROUP == 0}
        out = []
        for c, own, head in zip(self.ids, self.turns, self.heads, strict=True):
            base = c - c % GROUP if c >= 0 else -(-c - -c % GROUP)  # the remainder has the sign of the id
            out.append(first.get(base, [])[:head] + own[head:])
        return out

    def nodes(self) -> Iterator[tuple]:
        """(number, number of the parent, path, depth, members, least member, words, ends) in depth-first order."""
        rows = self.rebuilt()
        digests = list(self.numbers)
        postings: list[dict[int, int]] = [{} for _ in range(max(map(len, rows), default=0))]
        ending: dict[int, int] = {}
        for k, row in enumerate(rows):
            ending[len(row)] = ending.get(len(row), 0) | 1 << k
            for at, turn in enumerate(row):
                postings[at][turn] = postings[at].get(turn, 0) | 1 << k
        number = 0
        todo = [((1 << len(rows)) - 1, -1, b"", 0, 0)] if rows else []
        while todo:
            members, parent, path, depth, words = todo.pop()
            here = number
            number += 1
            least = (members & -members).bit_length() - 1
            ends = members & ending.get(depth, 0)
            yield here, parent, path, depth, members.bit_count(), self.ids[least], words, self.listed(ends)
            left = members & ~ends
            while left:
                turn = rows[(left & -left).bit_length() - 1][depth]
                child = left & postings[depth][turn]
                left &= ~child
                below = hashlib.blake2b(path + digests[turn], digest_size=16).digest()
                todo.append((child, here, below, depth + 1, self.words[turn]))

    def listed(self, bits: int) -> list[int]:
        out = []
        while bits:
            low = bits & -bits
            out.append(self.ids[low.bit_length() - 1])
            bits ^= low
        return out


_LOCAL = "shard long, number int, parent int, path binary, depth int, members long, least long, words long, n_ends long, ends string"


def _local_tries():
    """Nodes of each shard from rows (shard, conv_id, head, digest, words) that come shard by shard, in order."""
    def nodes(shard: int, trie: Shard) -> Iterator[tuple]:
        for *row, ends in trie.nodes():
            yield shard, *row, len(ends), ",".join(map(str, ends)) if ends else None

    def function(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now, trie = None, None
        for b in batches:
            for shard, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if shard != now:
                    if trie:
                        yield from nodes(now, trie)
                    now, trie = shard, Shard()
                trie.add(*row)
        if trie:
            yield from nodes(now, trie)
    return function


_SUMS = "path binary, depth int, shared boolean, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def _shard_sums():
    """Each shard's sums over the nodes it owns, for every node of its trie.

    Rows (shard, number, parent, path, depth, words, own members, least, and over all shards:
    members, least member, ends) come shard by shard, by number.
    """
    def sums(rows: list[tuple]) -> Iterator[tuple]:
        children, leaves, saved = ([0] * len(rows) for _ in range(3))
        for at in range(len(rows) - 1, -1, -1):  # children come after their parents
            _, parent, _, _, words, _, least, members, first, ends = rows[at]
            owned = least == first
            if owned:
                leaves[at] += ends == members
                saved[at] += (members - 1) * words
            if parent >= 0:
                children[parent] += owned
                leaves[parent] += leaves[at]
                saved[parent] += saved[at]
        for at, (_, parent, path, depth, _, own, least, members, first, _) in enumerate(rows):
            owned = least == first
            above = rows[parent][8] if owned and parent >= 0 else None
            yield path, depth, own != members, first if owned else None, above, members if owned else None, children[at], leaves[at], saved[at]

    def function(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now, rows = None, []
        for b in batches:
            for shard, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if shard != now:
                    yield from sums(rows)
                    now, rows = shard, []
                rows.append(tuple(row))
        yield from sums(rows)
    return function


def _hashed_ends():
    """SHA-256 of each node's ends, whose pieces come shard by shard."""
    def function(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now, sha = None, None
        for b in batches:
            for path, ends in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if path != now:
                    if sha:
                        yield now, sha.hexdigest()
                    now, sha = path, hashlib.sha256(ends.encode())
                else:
                    sha.update(b"," + ends.encode())
        if sha:
            yield now, sha.hexdigest()
    return function


def trie(conversations: DataFrame, shard: int = SHARD) -> DataFrame:
    """Per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by ``turn`` (nulls first), those of one turn by a hash of role and
    text; null role and text are empty. Repeated rows are turns like any other. Rows
    without conv_id belong to no conversation. No conversation gives no node.
    """
    if shard % GROUP:
        raise ValueError(f"a shard must hold whole groups of {GROUP}")
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16)
    compact = conversations.filter("conv_id IS NOT NULL").select(
        F.floor(_base("conv_id") / shard).cast("long").alias("shard"), F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(HEADS)).cast("int").alias("head"),
        digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    ordered = (compact.repartition("shard").sortWithinPartitions("shard", "conv_id", F.col("turn").asc_nulls_first(), "digest")
               .select("shard", "conv_id", "head", "digest", "words"))
    local = written(expand(ordered, _LOCAL, _local_tries), "shard-tries")

    # Shards are few for each node: at most one row of a shard, however many copies it has.
    node = Window.partitionBy("path", "depth")
    whole = local.select("shard", "number", "parent", "path", "depth", "words", "members", "least",
                         F.sum("members").over(node).alias("all"), F.min("least").over(node).alias("first"), F.sum("n_ends").over(node).alias("all_ends"))
    sums = expand(whole.repartition("shard").sortWithinPartitions("shard", "number"), _SUMS, _shard_sums)
    sums = written(sums, "shard-sums")
    pieces = local.filter("ends IS NOT NULL").select("path", "ends", "depth", "shard")
    hashes = expand(pieces.repartition("path").sortWithinPartitions("path", "shard").select("path", "ends"), "path binary, ends_sha256 string", _hashed_ends)

    facts = ["conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    shared = sums.filter("shared").groupBy("path", "depth").agg(
        *[F.max(c).alias(c) for c in facts[:3]], *[F.sum(c).alias(c) for c in facts[3:]])
    nodes = sums.filter("NOT shared").select("path", "depth", *facts).unionByName(shared.select("path", "depth", *facts))
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return (nodes.join(hashes, "path", "left")
            .select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                    F.coalesce("ends_sha256", nothing).alias("ends_sha256")))

"""Conversation structure repair by aligning turns to the alternating grammar.

The role initials of a sound conversation are ``(s?(ua)+)?``. A conversation is aligned
to each feasible length of that string by Wagner and Fischer's table of edit costs. All
targets end in the same alternation, so the table runs from the end and its columns are
the lengths: one table holds the alignments to all of them. A first repair that is found
in one pass bounds the cost, and Ukkonen's bands leave out all cells that no alignment
within that cost can reach. The audits (initials of the edits) of all cheapest lengths
are traced back and compared. Every so many rows of the table are kept and those between
computed again for the trace, so a very long conversation needs little memory.

A conversation is read by one task, as a stream: its compact rows (initial, fault) come
first, and after the alignment its texts, which are repaired and hashed one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from stockloom.llm.common import SLICE, expand

DELETE, INSERT, REROLE, CUT = 4, 3, 3, 3
#: Alignments that a task remembers, and the longest conversation it remembers one of.
CACHE, REMEMBERED = 100_000, 64
_SPACE = " \t\n\x0b\x0c\r"
_FAR = 1 << 40
#: A row is one byte: d must go; otherwise its initial (o: no role of the grammar), a capital if its text is cut off.
_MUST_GO = ord("d")


class _Table:
    """Costs of aligning the rows from i on to the last j characters of the alternation, within the bands."""

    def __init__(self, rows: bytes, bound: int):
        self.rows, self.n = rows, len(rows)
        kept = np.frombuffer(rows, np.uint8) != _MUST_GO
        self.left = np.concatenate([np.cumsum(kept[::-1])[::-1], [0]]).tolist()  # rows from i on that may stay
        cut = sum(chr(c).isupper() for c in rows)
        spare = bound - DELETE * (self.n - self.left[0]) - CUT * cut
        # So many rows more, or fewer, than characters: deleting a row with a cut text costs one more than keeping it.
        self.more = spare // INSERT
        self.fewer = spare if spare <= cut else cut + (spare - cut) // DELETE
        self.step = max(16, int(self.n ** 0.5))
        self.marks: dict[int, np.ndarray] = {}
        row = self.last()
        for i in range(self.n, -1, -1):
            if i < self.n:
                row = self.above(i, row)
            if i % self.step == 0 or i == self.n:
                self.marks[i] = row
        self.first = row

    def band(self, i: int) -> tuple[int, int]:
        return max(0, self.left[i] - self.fewer), self.left[i] + self.more

    def last(self) -> np.ndarray:
        low, high = self.band(self.n)
        return INSERT * np.arange(low, high + 1, dtype=np.int64)

    def above(self, i: int, below: np.ndarray) -> np.ndarray:
        """Row i from row i + 1."""
        (low, high), (first, last) = self.band(i), self.band(i + 1)
        wide = np.full(high - low + 3, _FAR, np.int64)  # columns low - 1 to high + 1
        a, b = max(first, low - 1), min(last, high + 1)
        wide[a - low + 1:b - low + 2] = below[a - first:b - first + 1]
        out = wide[1:-1] + DELETE
        code = self.rows[i]
        if code != _MUST_GO:
            places = np.arange(low, high + 1)
            own = chr(code).lower()
            fits = places % 2 == 1 if own == "a" else places % 2 == 0 if own == "u" else np.zeros(len(places), bool)
            match = wide[:-2] + np.where(fits, 0, REROLE) + (CUT if chr(code).isupper() else 0)
            match[places == 0] = _FAR
            out = np.minimum(out, match)
        slope = INSERT * np.arange(len(out))
        return np.minimum(np.minimum.accumulate(out - slope) + slope, _FAR)

    def blocks(self) -> Iterator[tuple[int, list[np.ndarray]]]:
        """Rows in order, some at a time: the first row's number, and the rows with the one after them."""
        for i in range(0, self.n, self.step):
            end = min(self.n, i + self.step)
            rows = [self.marks[end]]
            for k in range(end - 1, i - 1, -1):
                rows.append(self.above(k, rows[-1]))
            yield i, rows[::-1]


def _first_repair(rows: bytes) -> int:
    """The cost of a repair: what is missing is inserted, or each row gets the role of its place, or all go."""
    stay = [chr(c) for c in rows if c != _MUST_GO]
    forced = DELETE * (len(rows) - len(stay)) + CUT * sum(map(str.isupper, stay))
    added, want = 0, "u"
    for role in map(str.lower, stay):
        if role not in "ua":
            added, want = added + REROLE, "a" if want == "u" else "u"
        else:
            added, want = added + (0 if role == want else INSERT), "a" if role == "u" else "u"
    added += INSERT * (want == "a")
    placed = sum(REROLE * (role.lower() != "ua"[k % 2]) for k, role in enumerate(stay)) + INSERT * (len(stay) % 2)
    return min(forced + added, forced + placed, DELETE * len(rows))


def repair(rows: bytes) -> tuple[int, str]:
    """Least cost and its ASCII-least audit (D, I, K, R) for rows of one byte each."""
    n = len(rows)
    table = _Table(rows, _first_repair(rows))
    # Whole alignments: (cost, rows deleted and then one kept as s or none, length of the rest).
    ends = [(DELETE * n, n, 0)]
    low, high = table.band(0)
    ends += [(int(table.first[j - low]), 0, j) for j in range(low, high + 1) if j >= 2 and j % 2 == 0]
    starts = {}
    at = n
    for i in range(n):
        if DELETE * i > ends[0][0]:
            break
        if chr(rows[i]).lower() == "s":
            starts[i + 1] = DELETE * i + (CUT if chr(rows[i]).isupper() else 0)
    if starts:
        for begin, block in table.blocks():
            for i in [k for k in starts if begin <= k < begin + len(block) - 1 or k == n == begin + len(block) - 1]:
                low, high = table.band(i)
                ends += [(starts[i] + int(block[i - begin][j - low]), -i, j) for j in range(low, high + 1) if j >= 2 and j % 2 == 0]
            if begin > max(starts):
                break
    cost = min(c for c, _, _ in ends)
    audits = [bytearray(b"D" * n) for c, _, j in ends if c == cost and j == 0]
    # [next row, characters left, audit]
    walks = [[-at, j, bytearray(b"D" * (-at - 1) + b"K" if at else b"")] for c, at, j in ends if c == cost and j]
    for begin, block in table.blocks():
        for walk in walks:
            while walk[0] < begin + len(block) - 1:
                _step(table, begin, block, walk)
        best = min([w[2] for w in walks], default=b"")
        walks = [w for w in walks if w[2].startswith(best) or best.startswith(w[2])]
    audits += [w[2] + b"I" * w[1] for w in walks]
    return cost, min(audits).decode()


def _step(table: _Table, begin: int, block: list[np.ndarray], walk: list) -> None:
    """The ASCII-least edit among the cheapest ones."""
    i, j, audit = walk
    (low, high), (first, last) = table.band(i), table.band(i + 1)
    own, below = block[i - begin], block[i - begin + 1]
    cost = own[j - low]
    if first <= j <= last and cost == DELETE + below[j - first]:
        audit.append(68)
        walk[0] = i + 1
    elif j > low and cost == INSERT + own[j - 1 - low]:
        audit.append(73)
        walk[1] = j - 1
    else:
        audit.append(75 if chr(table.rows[i]).lower() == "ua"[j % 2] else 82)
        walk[0], walk[1] = i + 1, j - 1


class _Conversation:
    """Running state of the conversation that a task reads."""

    def __init__(self, conv_id: int | None):
        self.conv_id = conv_id
        self.rows, self.seen = bytearray(), set()
        self.turns: list[int] = []  # least, greatest, number of different ones
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.last: str | None = None
        self.sha, self.audit, self.cost, self.at, self.out, self.system = hashlib.sha256(), None, 0, 0, 0, 0

    def compact(self, turn: int | None, initial: str, blank: bool, cut: bool, digest: bytes) -> None:
        if turn is not None:
            if not self.turns:
                self.turns = [turn, turn, 1]
            elif turn != self.turns[1]:
                self.turns[1:] = [turn, self.turns[2] + 1]
        fault = "blank" if blank else "duplicate" if digest in self.seen else "truncated" if cut else None
        self.seen.add(digest)
        if fault:
            self.counts[fault] += 1
        if self.last is not None and self.last + initial not in ("su", "ua", "au"):
            self.counts["illegal"] += 1
        self.last = initial
        code = initial if initial and initial in "sua" else "o"
        self.rows.append(_MUST_GO if fault in ("blank", "duplicate") else ord(code.upper() if fault else code))

    def align(self, known: dict[bytes, tuple[int, str]]) -> None:
        rows = bytes(self.rows)
        self.rows, self.seen = bytearray(), set()
        found = known.get(rows)
        if found is None:
            found = repair(rows)
            if len(rows) <= REMEMBERED:
                if len(known) >= CACHE:
                    known.clear()
                known[rows] = found
        self.cost, self.audit = found
        kept = len(self.audit) - len(self.audit.lstrip("D"))
        self.system = int(rows[kept:kept + 1].lower() == b"s" and self.audit[kept:kept + 1] == "K")

    def emit(self, text: str, role: str | None = None) -> None:
        if role is None:
            role = ("user", "assistant")[(self.out - self.system) % 2]
        self.sha.update(f"{chr(10) if self.out else ''}{role}:{text}".encode())
        self.out += 1

    def inserted(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            self.emit("")

    def text(self, role: str, text: str) -> None:
        self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            self.emit(text, role if edit == "K" else None)

    def result(self, known: dict[bytes, tuple[int, str]]) -> tuple:
        if self.audit is None:
            self.align(known)
        self.inserted()
        gaps = self.turns[1] - self.turns[0] + 1 - self.turns[2] if self.turns else 0
        return (self.conv_id, gaps, *self.counts.values(), self.cost, self.audit, self.sha.hexdigest())


def _repaired():
    known: dict[bytes, tuple[int, str]] = {}

    def function(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now = None
        for whole in batches:
            for k in range(0, whole.num_rows, SLICE):
                columns = [c.to_pylist() for c in whole.slice(k, SLICE).columns]
                for conv_id, kind, turn, initial, blank, cut, digest, role, text in zip(*columns, strict=True):
                    if now is None or now.conv_id != conv_id:
                        if now is not None:
                            yield now.result(known)
                        now = _Conversation(conv_id)
                    if kind == 0:
                        now.compact(turn, initial, blank, cut, digest)
                    elif kind == 1:
                        if now.audit is None:
                            now.align(known)
                        now.text(role, text)
        if now is not None:
            yield now.result(known)
    return function


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: the rows as the crc32 of ``conv_id:turn`` damages them.

    Nulls become one space. A row that is dropped stays with ``gone``, so that its
    conversation is not forgotten.
    """
    def filled(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    code = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (conversations.select("conv_id", "turn", filled("role").alias("role"), filled("text").alias("text"), code.alias("code"))
            .select("conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                    (F.col("code") == 0).alias("gone"), F.explode(times).alias("again")).drop("again"))


def repaired(turns: DataFrame) -> DataFrame:
    """Per conversation: faults, and its cheapest repair, of (conv_id, turn, role, text, gone).

    Rows are taken by turn (nulls first), those of one turn by role and text. A null
    conv_id is a conversation of its own, as is any other. A row whose role is empty
    has no initial: it cannot be kept, and its neighbours are illegal. Rows with
    ``gone`` count for nothing, and a conversation of such rows alone is empty, as is
    one whose repair deletes all: it has the hash of the empty string. No rows give no rows.
    """
    present = ~F.col("gone")
    order = Window.partitionBy("conv_id").orderBy(F.col("gone"), F.col("turn").asc_nulls_first(), "role", "text")
    kinds = F.when(F.col("gone"), F.array(F.lit(2))).otherwise(F.array(F.lit(0), F.lit(1)))
    tail = F.right(F.rtrim(F.col("text"), F.lit(_SPACE)), F.lit(1))
    # Every row twice: without and then with its text. The compact ones of a conversation come first.
    each = turns.withColumn("place", F.row_number().over(order)).withColumn("kind", F.explode(kinds))
    texts, compact = F.col("kind") == 1, F.col("kind") == 0
    rows = each.sortWithinPartitions("conv_id", "kind", "place").select(
        "conv_id", "kind", F.when(present, F.col("turn")).alias("turn"), F.when(compact, F.substring("role", 1, 1)).alias("initial"),
        F.when(compact, tail == "").alias("blank"), F.when(compact, ~tail.isin(".", "!", "?")).alias("cut"),
        F.when(compact, F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))).alias("digest"),
        F.when(texts, F.col("role")).alias("role"), F.when(texts, F.col("text")).alias("text"))
    return expand(rows, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string",
                  _repaired)


def repairs(conversations: DataFrame) -> DataFrame:
    """The repairs of the damaged conversations, one row for every conv_id."""
    return repaired(damaged(conversations.select("conv_id", "turn", "role", "text")))

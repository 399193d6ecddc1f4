"""Quality rules with line labels from a linear-chain conditional random field.

Each line with a word is described by what it is made of (symbols, capitals, digits,
punctuation, repeated words, an earlier equal line, ...). A two-state chain, content or
boilerplate, is trained on a bounded sample of documents with a quality label. That label
is one of the document, not of its lines: those are latent. Training starts with all lines
of a document under its label; then each line is labelled by itself, by what it is made of,
as long as most words of a good document are content and most of a bad one are not. So the
chain learns where documents switch. Viterbi decoding labels the lines of every document,
and the share of its words in content lines decides whether it is kept, unless a fixed rule
has failed it before.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stockloom.llm.common import append, expand

#: Expected documents drawn of the more frequent label (at most four times that in all), and the training schedule.
ROWS, STEPS, PENALTY, SEGMENT = 3_000, 200, 1e-3, 64
#: How often the lines of the sample are labelled anew.
RELABELLINGS = 2
#: Least share of words in content lines.
SHARE = 0.5

_SPACE, _UPPER, _LOWER, _DIGIT, _SYMBOL, _STOP, _OTHER, _WIDE, _TAIL = range(9)
_CLASS = np.full(256, _OTHER, np.uint8)
for _kind, _bytes in ((_SPACE, b" \t\n\v\f\r"), (_UPPER, bytes(range(65, 91))), (_LOWER, bytes(range(97, 123))), (_DIGIT, b"0123456789"),
                      (_SYMBOL, b"#*$%&|<>"), (_STOP, b".,;:?'\""), (_WIDE, bytes(range(192, 256))), (_TAIL, bytes(range(128, 192)))):
    _CLASS[list(_bytes)] = _kind
FEATURES = 11
_CHUNK, _PIECE = 1 << 22, 1 << 20


@dataclass
class Text:
    """Base figures of a text, and its lines with a word as feature rows."""

    n_words: int = 0
    word_chars: int = 0
    n_symbols: int = 0
    n_dup_lines: int = 0
    n_repeat_words: int = 0
    features: np.ndarray | None = None
    line_words: np.ndarray | None = None

    @property
    def base_failed(self) -> bool:
        return self.n_words < 10 or 100 * self.n_repeat_words > 20 * self.n_words


class _Numbers(dict):
    """Numbers words in the order in which they come."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def numbered(data: bytes) -> np.ndarray:
    """The words of a text as numbers; equal words have one. No list of all words is made."""
    known, at, parts = _Numbers(), 0, []
    while at < len(data):
        end = at + _PIECE
        while end < len(data) and data[end] not in b" \t\n\v\f\r":
            end += 1
        words = data[at:end].split()
        parts.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.int32)


def repeated_words(ids: np.ndarray, size: int = 5) -> int:
    """Words inside windows of ``size`` words that occur at least twice (overlapping ones too)."""
    n = len(ids) - size + 1
    if n < 2:
        return 0
    mix = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)
    keys = np.zeros(n, np.uint64)
    for i in range(size):
        keys += ids[i:i + n].astype(np.uint64) * np.uint64(mix[i])
    _, first, back, counts = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    often = counts[back] > 1
    if not often.any():
        return 0
    at = np.flatnonzero(often)
    like = first[back[at]]
    if not all((ids[at + i] == ids[like + i]).all() for i in range(size)):  # two windows with one key: count them as they are
        words = ids.tolist()
        seen = Counter(zip(*(words[i:] for i in range(size))))
        often = np.array([seen[w] > 1 for w in zip(*(words[i:] for i in range(size)))])
        at = np.flatnonzero(often)
    covered = np.zeros(len(ids) + 1, np.int64)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + size, -1)
    return int((np.cumsum(covered)[:-1] > 0).sum())


def measure(data: bytes | None) -> Text:
    ids = numbered(data) if data else ()
    if not len(ids):
        return Text(n_symbols=len(data) - len(data.translate(None, b"#*$%&|<>")) if data else 0)
    raw = np.frombuffer(data, np.uint8)
    kind = _CLASS[raw]
    ends = np.append(np.flatnonzero(raw == 10), len(raw))
    starts = np.append(0, ends[:-1] + 1)
    per, spaces, tails = np.zeros((len(starts), 9)), 0, 0
    for at in range(0, len(raw), _CHUNK):  # newlines count for the line they end; spaces are no feature
        part = kind[at:at + _CHUNK]
        first = int(np.searchsorted(ends, at))
        own = np.cumsum(raw[at:at + _CHUNK] == 10, dtype=np.int64)
        own[1:] = own[:-1]
        own[0] = 0
        counts = np.bincount(own * 9 + part, minlength=9 * (int(own[-1]) + 1)).reshape(-1, 9)
        per[first:first + len(counts)] += counts
        spaces += int(counts[:, _SPACE].sum())
        tails += int(counts[:, _TAIL].sum())
    symbols = int(per[:, _SYMBOL].sum())
    filled = kind != _SPACE
    begins = np.flatnonzero(filled & np.append(True, ~filled[:-1]))
    line = (np.searchsorted(starts, begins, "right") - 1).astype(np.int32)
    n_lines = len(starts)
    n = np.bincount(line, minlength=n_lines)
    same = np.append(False, ids[1:] == ids[:-1])
    again = np.bincount(line[same], minlength=n_lines)
    seen: set[bytes] = set()
    repeated = np.zeros(n_lines)
    for i, text in enumerate(data.split(b"\n")):
        if n[i]:
            if text in seen:
                repeated[i] = 1
            seen.add(text)
    has = n > 0
    per, w = per[has], n[has].astype(float)
    letters = per[:, _UPPER] + per[:, _LOWER] + per[:, _WIDE]
    chars = letters + per[:, _DIGIT] + per[:, _SYMBOL] + per[:, _STOP] + per[:, _OTHER]
    out = np.column_stack([
        np.ones(len(w)), np.minimum(per[:, _SYMBOL] / w, 3), per[:, _UPPER] / np.maximum(letters, 1), per[:, _DIGIT] / chars,
        np.minimum(per[:, _OTHER] / w, 3), np.minimum(per[:, _STOP] / w, 1), again[has] / w, repeated[has], w < 3,
        np.minimum(chars / w, 20) / 10, np.minimum(np.log1p(w), 6)])
    return Text(len(ids), len(raw) - tails - spaces, symbols, int(repeated.sum()), repeated_words(ids), out, w)


@dataclass
class Chain:
    """Weights of state 1 (content) against state 0, and of transitions (from, to)."""

    emit: np.ndarray
    step: np.ndarray

    def decode(self, features: np.ndarray) -> np.ndarray:
        """The likeliest states, by Viterbi."""
        (s00, s01), (s10, s11) = self.step.tolist()
        low = high = 0.0
        back = []
        for i, e in enumerate((features @ self.emit).tolist()):
            if i:
                a, b = low + s00 >= high + s10, low + s01 > high + s11
                low, high = (low + s00 if a else high + s10), (low + s01 if b else high + s11)
                back.append((0 if a else 1, 0 if b else 1))
            high += e
        state = int(high >= low)
        states = [state]
        for pair in reversed(back):
            state = pair[state]
            states.append(state)
        return np.array(states[::-1])


def train(sequences: list[tuple[int | np.ndarray, np.ndarray]], steps: int = STEPS, penalty: float = PENALTY, segment: int = SEGMENT) -> Chain | None:
    """A chain from (labels of the lines, or of all of them, and features); None unless both labels occur.

    Sequences are cut into segments for training (of one line: each by itself); each line weighs the same.
    """
    whole = [(np.broadcast_to(y, len(x)), x) for y, x in sequences]
    parts = [(y[i:i + segment], x[i:i + segment]) for y, x in whole for i in range(0, len(x), segment)]
    if not parts or len(np.unique(np.concatenate([y for y, _ in parts]))) < 2:
        return None
    longest = max(len(x) for _, x in parts)
    n = len(parts)
    x, y, mask = np.zeros((n, longest, FEATURES)), np.zeros((n, longest), int), np.zeros((n, longest), bool)
    for i, (labels, f) in enumerate(parts):
        x[i, :len(f)], y[i, :len(f)], mask[i, :len(f)] = f, labels, True
    size = mask.sum(1)
    weight = np.full(n, 1 / size.sum())
    both = mask[:, 1:]
    real = np.bincount((2 * y[:, :-1] + y[:, 1:])[both], minlength=4).reshape(2, 2) / size.sum() if longest > 1 else np.zeros((2, 2))
    emit, step = np.zeros(FEATURES), np.zeros((2, 2))
    moments = [np.zeros(FEATURES + 4), np.zeros(FEATURES + 4)]
    for t in range(1, steps + 1):
        score = np.stack([np.zeros((n, longest)), x @ emit], 2)
        forward, backward = np.zeros_like(score), np.zeros_like(score)
        forward[:, 0] = score[:, 0]
        for i in range(1, longest):
            new = np.logaddexp(forward[:, i - 1, :1] + step[0], forward[:, i - 1, 1:] + step[1]) + score[:, i]
            forward[:, i] = np.where(mask[:, i, None], new, forward[:, i - 1])
        for i in range(longest - 2, -1, -1):
            after = score[:, i + 1] + backward[:, i + 1]
            new = np.logaddexp(step[:, 0] + after[:, :1], step[:, 1] + after[:, 1:])
            backward[:, i] = np.where(mask[:, i + 1, None], new, 0)
        total = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
        content = np.exp(forward[:, :, 1] + backward[:, :, 1] - total[:, None])
        gap = np.where(mask, (y - content) * weight[:, None], 0)
        grad = [np.einsum("nl,nlf->f", gap, x) - penalty * emit]
        if longest > 1:
            pair = forward[:, :-1, :, None] + step[None, None] + (score[:, 1:] + backward[:, 1:])[:, :, None, :] - total[:, None, None, None]
            pair = np.where(mask[:, 1:, None, None], np.exp(pair) * weight[:, None, None, None], 0).sum((0, 1))
            grad.append((real - pair - penalty * step).reshape(-1))
        else:
            grad.append(np.zeros(4))
        g = np.concatenate(grad)
        moments = [0.9 * moments[0] + 0.1 * g, 0.99 * moments[1] + 0.01 * g * g]
        move = 0.1 * (moments[0] / (1 - 0.9 ** t)) / (np.sqrt(moments[1] / (1 - 0.99 ** t)) + 1e-8)
        emit, step = emit + move[:FEATURES], step + move[FEATURES:].reshape(2, 2)
    return Chain(emit, step)


def relabelled(lines: Chain, label: int, features: np.ndarray) -> np.ndarray:
    """The lines of a document, each judged by itself, or all under the document's label if they deny it."""
    states = (features @ lines.emit > 0).astype(int)
    words = np.expm1(features[:, -1])
    share = (states * words).sum() / words.sum()
    return states if (share >= SHARE) == bool(label) else np.full(len(features), label)


def learn(sequences: list[tuple[int, np.ndarray]], relabellings: int = RELABELLINGS) -> Chain | None:
    """A chain from (label of the document, features of its lines)."""
    labelled = [(np.full(len(x), y), x) for y, x in sequences]
    for _ in range(relabellings):
        lines = train(labelled, segment=1)
        if lines is None:
            return None
        labelled = [(relabelled(lines, y, x), x) for y, x in sequences]
    return train(labelled)


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> Chain | None:
    """The chain from documents with a quality label: one share of all, about ``rows`` of the larger kind, by a hash of their id."""
    known = labels.select("doc_id", "quality").filter("doc_id IS NOT NULL AND quality IN (0, 1)")
    counts = {r.quality: r["count"] for r in known.groupBy("quality").count().collect()}
    if len(counts) < 2:
        return None
    share = min(1.0, rows / max(counts.values()))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = known.filter(draw < F.lit(share)).limit(4 * rows)
    drawn = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "quality", "text")

    def make():
        def function(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
            for b in batches:
                for doc_id, quality, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), strict=True):
                    features = measure(data).features
                    if features is not None:
                        yield doc_id, quality, features.astype(np.float32).tobytes()
        return function

    found = expand(drawn, "doc_id long, quality int, features binary", make).collect()
    found.sort(key=lambda r: (r.doc_id, r.features))
    return learn([(r.quality, np.frombuffer(r.features, np.float32).reshape(-1, FEATURES).astype(float)) for r in found])


def with_quality(docs: DataFrame, chain: Chain | None, share: float = SHARE) -> DataFrame:
    """doc_id with the base figures, base_failed, kept, and the share of words in content lines."""
    def make():
        def function(values: list[bytes | None]) -> Iterator[tuple]:
            for data in values:
                t = measure(data)
                content = 1.0
                if chain and t.n_words:
                    content = float((chain.decode(t.features) * t.line_words).sum() / t.n_words)
                failed = t.base_failed
                yield t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words, failed, not failed and content >= share, content
        return function

    ddl = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
           "kept boolean, content_share double")
    return append(docs.select("doc_id", "text"), "text", ddl, make).drop("text")


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    Null and empty texts have no words and fail. Repeated rows give a row each. Without
    labels of both kinds no chain can be learned, and the base rules alone decide.
    """
    return with_quality(docs, fit(docs, labels))

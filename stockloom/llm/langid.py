"""Language identification with string kernels.

The kernel is a blended spectrum of presence: for each order n up to three, the byte
n-grams two texts share, over the geometric mean of how many each has; the mean over
the orders. A bounded sample of labelled rows trains it: some of them are Nyström
landmarks, and kernel ridge regression on the landmarks' kernel columns is solved once
for all languages, each against the rest.

A prediction needs the kernel of a text with every landmark, times the coefficients.
As the kernel is a product of scaled presence vectors, landmarks and coefficients are
multiplied beforehand; a batch of texts is then one matrix of scaled presences times
one matrix of weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from stockloom.llm.common import append, expand, free_name

UNDETERMINED = "und"
ORDERS = 3
#: Bounds of the training sample: expected rows for each language, all rows, landmarks for each language.
ROWS, MAX_ROWS, LANDMARKS, RIDGE = 400, 8_000, 64, 0.01
BATCH = 64
#: Below this score no language claims a text: its best margin is far on the side of "the rest".
LEAST_SCORE = 0.25
#: A language claims no text that knows less than this share of its longest n-grams, or than most of the
#: language's own sample texts do (all but RARE of them, less SLACK), if that is lower.
KNOWN_SHARE, RARE, SLACK = 0.7, 0.01, 0.1

_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_FIRST = np.array([0, 1 << 8, 1 << 17, 1 << 25])  # where the codes of each order begin


def normalised(data: bytes | None) -> bytes | None:
    """Lower-case words between single spaces; None without a letter."""
    text = data.decode("utf-8", "replace").lower() if data else ""
    words = text.encode().translate(_LETTERS).split()
    if not words or not any(w[0] < 128 for w in words) and not any(map(str.isalpha, text)):
        return None
    return b" " + b" ".join(words) + b" "


def grams(text: bytes) -> np.ndarray:
    """The distinct n-grams of all orders, as ascending codes that begin with the order's offset."""
    b = np.frombuffer(text, np.uint8).astype(np.uint32)
    codes = [b, (b[:-1] << 8 | b[1:]) + _FIRST[1].astype(np.uint32), (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) + _FIRST[2].astype(np.uint32)]
    return np.unique(np.concatenate(codes))


def presence(codes: list[np.ndarray], vocabulary: np.ndarray) -> np.ndarray:
    """A row for each text: the presences of the vocabulary's n-grams, scaled by order."""
    out = np.zeros((len(codes), len(vocabulary)), np.float32)
    for row, c in zip(out, codes, strict=True):
        counts = np.diff(np.append(np.searchsorted(c, _FIRST[:ORDERS]), len(c)))
        scale = np.sqrt(1 / (ORDERS * np.maximum(counts, 1))).astype(np.float32)
        at = np.searchsorted(vocabulary, c)
        hit = at < len(vocabulary)
        hit[hit] = vocabulary[at[hit]] == c[hit]
        row[at[hit]] = np.repeat(scale, counts)[hit]
    return out


def known_share(codes: np.ndarray, known: np.ndarray) -> float:
    """The share of a text's longest n-grams in ``known`` (ascending), plus what chance may do to so few."""
    own = codes[np.searchsorted(codes, _FIRST[ORDERS - 1]):]
    if not len(own) or not len(known):
        return 1.0
    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
    return float((known[at] == own).mean() + len(own) ** -0.5)


@dataclass
class Model:
    languages: list[str]
    vocabulary: np.ndarray
    weights: np.ndarray  # n-grams x languages
    least: list[float]  # the known share each language asks for

    def judged(self, texts: list[bytes | None]) -> Iterator[tuple[str, float, np.ndarray | None]]:
        """Language and score of each text (UTF-8 or None), and its n-grams."""
        for i in range(0, len(texts), BATCH):
            codes = [grams(t) if t else None for t in map(normalised, texts[i:i + BATCH])]
            given = [c for c in codes if c is not None]
            margins = iter(presence(given, self.vocabulary) @ self.weights if self.languages else [])
            for c in codes:
                if c is not None and self.languages:
                    m = next(margins)
                    best = int(np.argmax(m))
                    yield self.languages[best], float(min(1.0, max(0.0, (1 + m[best]) / 2))), c
                else:
                    yield UNDETERMINED, 0.0, None

    def predict(self, texts: list[bytes | None]) -> Iterator[tuple[str, float]]:
        return ((language, score) for language, score, _ in self.judged(texts))

    def claims(self, texts: list[bytes | None]) -> Iterator[tuple[str, float, bool]]:
        """As ``predict``, and whether the language claims the text: it knows enough of its n-grams."""
        known = self.vocabulary[np.searchsorted(self.vocabulary, _FIRST[ORDERS - 1]):]
        for language, score, codes in self.judged(texts):
            yield language, score, codes is not None and known_share(codes, known) >= self.least[self.languages.index(language)]


def _least_shares(languages: list[str], rows: list[tuple[str, np.ndarray]], chosen: list[tuple[str, np.ndarray]]) -> list[float]:
    """The share of known n-grams each language asks for, by sample texts that did not make the vocabulary.

    Landmarks are judged by the other landmarks alone.
    """
    codes, owners = np.unique(np.concatenate([c for _, c in chosen]), return_counts=True)
    landmarks = {id(c) for _, c in chosen}
    out = []
    for language in languages:
        shares = [known_share(c, codes[owners > 1] if id(c) in landmarks else codes) for own, c in rows if own == language]
        out.append(min(KNOWN_SHARE, float(np.quantile(shares, RARE)) - SLACK))
    return out


def train(rows: list[tuple[str, np.ndarray]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Nyström kernel ridge regression from (language, codes) in an order that says nothing of the language."""
    languages = sorted({lang for lang, _ in rows})
    if not rows:
        return Model([], np.zeros(0, np.uint32), np.zeros((0, 0), np.float32), [])
    marks = [(lang, c) for lang in languages for c in [c for own, c in rows if own == lang][:landmarks]]
    chosen = [c for _, c in marks]
    vocabulary = np.unique(np.concatenate(chosen))
    base = presence(chosen, vocabulary)
    kernel = np.concatenate([presence([c for _, c in rows[i:i + BATCH]], vocabulary) @ base.T for i in range(0, len(rows), BATCH)]).astype(float)
    truth = np.where(np.array([lang for lang, _ in rows])[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    # Each language weighs the same, however many of its rows were drawn.
    weight = np.array([1 / sum(1 for own, _ in rows if own == lang) for lang, _ in rows])[:, None] / len(languages)
    left = kernel.T @ (weight * kernel) + ridge / len(rows) * (base @ base.T).astype(float)
    left += 1e-8 * np.trace(left) / len(left) * np.eye(len(left))
    weights = (base.T @ np.linalg.solve(left, kernel.T @ (weight * truth))).astype(np.float32)
    return Model(languages, vocabulary, weights, _least_shares(languages, rows, marks))


def in_fold(doc_id: str | Column) -> Column:
    """Whether a document is held out of training; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, rows: int = ROWS, max_rows: int = MAX_ROWS, landmarks: int = LANDMARKS) -> Model:
    """The model from labelled rows that are not held out: about ``rows`` for each language.

    Rows are drawn by a hash of their doc_id. Their n-grams are taken where the rows are;
    the driver gets those of the sample only. Without a usable row the model knows no language.
    """
    labelled = docs.select("doc_id", "text", "lang").filter(~in_fold("doc_id") & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r.lang: r["count"] for r in labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_rows).collect()}
    rows = min(rows, max(1, max_rows // max(1, len(counts))))
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, rows / n))]) if counts else F.create_map()
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = labelled.filter(draw < share[F.col("lang")]).select("doc_id", "lang", "text") if counts else labelled.limit(0)

    def make():
        def function(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
            for b in batches:
                for doc_id, lang, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), strict=True):
                    text = normalised(data)
                    if text:
                        yield doc_id, lang, grams(text).tobytes()
        return function

    found = expand(sample, "doc_id long, lang string, codes binary", make).collect() if counts else []
    found.sort(key=lambda r: (hash_order(r.doc_id), r.doc_id, r.codes))
    return train([(r.lang, np.frombuffer(r.codes, np.uint32)) for r in found], landmarks)


def hash_order(doc_id: int) -> int:
    return doc_id * 0x9E3779B97F4A7C15 & (1 << 64) - 1


def with_language(docs: DataFrame, model: Model, language: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the predicted language of ``text`` and its score, 0 to 1."""
    def make():
        return model.predict

    return append(docs, "text", f"{language} string, {score} double", make)


def predictions(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score, by a model of the documents not held out.

    Null texts and texts without a letter are ``und`` with score 0, as are all texts if
    nothing can be learned. Repeated rows give a row each.
    """
    return with_language(docs.select("doc_id", "text"), fit(docs)).select("doc_id", in_fold("doc_id").alias("held_out"), "lang_pred", "score")


def known_language(docs: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """The documents, all columns, whose text some learned language claims.

    Texts without a letter go, as do those whose best language scores too low or knows
    too few of their n-grams. If nothing can be learned, no text is claimed.
    """
    language, score, claimed = (free_name(docs, c) for c in ("lang_pred", "score", "claimed"))
    model = fit(docs)
    found = append(docs, "text", f"{language} string, {score} double, {claimed} boolean", lambda: model.claims)
    return found.filter(F.col(claimed) & (F.col(score) >= least_score)).select(*docs.columns)

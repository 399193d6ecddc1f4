"""Personal data: fixed formats, and more candidates judged by boosted trees, in DataFrame expressions only.

E-mail addresses, IP addresses, card and phone numbers in their plain formats are always
reported. High-recall generators propose further spans (number groups, spelled-out
addresses, disguised octets) that may overlap; features of format and context go to one
boosted ensemble for each kind, and a threshold calibrated on held-out documents selects
what is added.

The trees learn from the corpus itself. A candidate is described in a normal form, in
which ``(at)``, ``[.]`` and their like are the signs they stand for and a leading plus is
gone, so a disguised span looks like a plain one. A candidate inside a plain span of a kind is an
example of it. One that is well formed for a kind but not plain (a disguised address with
a known ending, valid octets, a number of a card's check digit, a number of a phone's
length after a word for phones) is no example and no counterexample of that kind; all
others are counterexamples. Features are small integers, so the counts of all candidates
by feature vector are a bounded table (at most the product of the features' ranges), from
which the trees are grown on the driver; they run as column expressions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import Column, DataFrame, functions as F

from stockloom.llm.common import written
from stockloom.llm.spans import kept, listed, with_matches

KINDS = ("email", "ip", "card", "phone")
#: Kinds that the trees add to.
LEARNED = KINDS
#: Endings of plain addresses that count as known: the most frequent ones.
ENDINGS = 64
ROUNDS, DEPTH, RATE, LEAST = 12, 3, 0.3, 1.0
#: Share of held-out documents (one in so many), and the precision an added span must have there.
HELD_OUT, PRECISION = 4, 0.95

_LOCAL = r"[A-Za-z0-9._%+-]"
_BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
_OPEN, _CLOSE = r"[(\[{<]\x20?", r"\x20?[)\]}>]"
_DOT = rf"(?:\.|\x20?{_OPEN}(?:\.|dot){_CLOSE}\x20?|\x20dot\x20)"
_CANDIDATES = {
    "octets": rf"(?i)(?<![A-Za-z0-9.])[0-9]{{1,3}}(?:{_DOT}[0-9]{{1,3}}){{3}}(?![A-Za-z0-9])",
    "number": r"(?<![A-Za-z0-9])[(]?[0-9](?:[\x20().-]{0,2}[0-9]){6,}+(?![A-Za-z0-9])",
    "address": rf"(?i)(?<!{_LOCAL}){_LOCAL}++\x20?(?:@|{_OPEN}at{_CLOSE}|\x20at\x20)\x20?[A-Za-z0-9-]++"
               rf"(?:\x20?(?:\.|{_OPEN}dot{_CLOSE}|\x20dot\x20)(?<![.]\x20)\x20?[A-Za-z0-9-]{{2,}}+)++",
}
#: Words before a candidate that speak for a kind.
_CUES = r"(?i)\b(?:(phone|tel|mobile|call|fax|whatsapp|telefon|handy|móvil|portable)|(card|visa|credit|karte|tarjeta|carte)|(e-?mail|mail|contact|correo))\b[^\n]{0,12}$"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _valid(kind: str, text: Column) -> Column:
    digits = F.length(_digits(text))
    if kind == "ip":
        return text.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return digits.between(16, 19) & F.call_function("luhn_check", _digits(text))
    return digits.between(8, 15) if kind == "phone" else F.lit(True)


def _bucket(value: Column, *edges: int) -> Column:
    """How many of the edges the value reaches."""
    out = F.lit(0)
    for i, edge in enumerate(edges):
        out = F.when(value >= edge, i + 1).otherwise(out)
    return out


def _normal(text: Column) -> Column:
    """A candidate with signs for the words and brackets that stand for them."""
    at = F.regexp_replace(text, rf"(?i)\x20?(?:{_OPEN}at{_CLOSE}|\x20at\x20|@)\x20?", "@")
    return F.regexp_replace(at, rf"(?i)\x20?(?:{_OPEN}(?:dot|\.){_CLOSE}|\x20dot\x20)\x20?", ".")


def _ending(normal: Column) -> Column:
    return F.lower(F.regexp_extract(normal, r"@.*\.([A-Za-z0-9-]+)$", 1))


def _features(text: Column, before: Column, endings: list[str]) -> list[tuple[str, Column]]:
    """Name and value of each feature of a candidate in normal form and the text before it."""
    groups = F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0))
    digits = _digits(text)
    flag = lambda c: F.when(c, 1).otherwise(0)
    return [
        ("digits", _bucket(F.length(digits), 7, 8, 10, 12, 16, 20)),
        ("groups", _bucket(F.size(groups), 1, 2, 3, 5)),
        ("longest", _bucket(F.coalesce(F.array_max(F.transform(groups, F.length)), F.lit(0)), 4, 5, 10)),
        ("luhn", flag((digits != "") & F.call_function("luhn_check", digits))),
        ("round", flag(text.rlike(r"[(\[{]"))),
        ("dash", flag(text.contains("-"))),
        ("dot", flag(text.contains("."))),
        ("letters", flag(text.rlike("[A-Za-z]{2}"))),
        ("known", F.when(~text.contains("@"), 0).when(_ending(text).isin(endings), 2).otherwise(1)),
        ("local", F.when(~text.contains("@"), 0).when(text.rlike("^[^@]*[0-9._%+-][^@]*@"), 2).otherwise(1)),
        ("octets", flag(_valid("ip", text))),
        ("cue", _cue(before)),
        ("touches", flag(before.rlike(r"[^\s(\[:,;+]$"))),
    ]


NAMES = ("digits", "groups", "longest", "luhn", "round", "dash", "dot", "letters", "known", "local", "octets", "cue", "touches")


def _cue(before: Column) -> Column:
    """Which kind a word before speaks for: phone, card, e-mail, or none (0)."""
    said = [F.regexp_extract(before, _CUES, i) != "" for i in (1, 2, 3)]
    return F.when(said[0], 1).when(said[1], 2).when(said[2], 3).otherwise(0)


def _well_formed(c: Column, endings: list[str]) -> Column:
    """The kind a candidate outside all plain spans may well be of, if any."""
    text, digits = c["normal"], F.length(_digits(c["normal"]))
    return (F.when(c["disguised"] & _ending(text).isin(endings), "email").when(c["disguised"] & _valid("ip", text), "ip")
            .when(_valid("card", text) & ~text.contains("@"), "card")
            .when(digits.between(8, 15) & ~text.contains("@") & (_cue(c["before"]) == 1), "phone").otherwise(""))


@dataclass
class Tree:
    """A split on ``feature`` < ``edge``, or a leaf with a value."""

    value: float = 0.0
    feature: int = -1
    edge: int = 0
    below: Tree | None = None
    above: Tree | None = None

    def __call__(self, x: tuple[int, ...]) -> float:
        return self.value if self.feature < 0 else (self.below if x[self.feature] < self.edge else self.above)(x)

    def column(self, x: list[Column]) -> Column:
        if self.feature < 0:
            return F.lit(self.value)
        return F.when(x[self.feature] < self.edge, self.below.column(x)).otherwise(self.above.column(x))


@dataclass
class Booster:
    """Boosted trees for log odds; spans at or above ``threshold`` are selected."""

    start: float = 0.0
    trees: list[Tree] = field(default_factory=list)
    threshold: float = math.inf

    def __call__(self, x: tuple[int, ...]) -> float:
        out = self.start
        for tree in self.trees:  # in the order of ``column``, so that both give the very same number
            out += tree(x)
        return out

    def column(self, x: list[Column]) -> Column:
        out = F.lit(self.start)
        for tree in self.trees:
            out = out + tree.column(x)
        return out


def _grow(rows: list[tuple[tuple[int, ...], float, float]], depth: int) -> Tree:
    """rows: features, gradient, curvature (sums over the equal candidates)."""
    g, h = sum(r[1] for r in rows), sum(r[2] for r in rows)
    leaf = Tree(RATE * g / (h + LEAST))
    if not depth or len(rows) < 2:
        return leaf
    best, split = 1e-6, None
    for f in range(len(rows[0][0])):
        sums: dict[int, list[float]] = {}
        for x, a, b in rows:
            s = sums.setdefault(x[f], [0.0, 0.0])
            s[0] += a
            s[1] += b
        low_g = low_h = 0.0
        values = sorted(sums)
        for value, after in zip(values, values[1:], strict=False):
            low_g += sums[value][0]
            low_h += sums[value][1]
            gain = low_g ** 2 / (low_h + LEAST) + (g - low_g) ** 2 / (h - low_h + LEAST) - g ** 2 / (h + LEAST)
            if gain > best:
                best, split = gain, (f, after)
    if not split:
        return leaf
    f, edge = split
    return Tree(0.0, f, edge, _grow([r for r in rows if r[0][f] < edge], depth - 1), _grow([r for r in rows if r[0][f] >= edge], depth - 1))


def boost(train: dict[tuple[int, ...], tuple[int, int]], held: dict[tuple[int, ...], tuple[int, int]]) -> Booster:
    """From counts of (examples, others) by feature vector; without examples nothing is ever selected."""
    good, bad = sum(c[0] for c in train.values()), sum(c[1] for c in train.values())
    if not good:
        return Booster()
    out = Booster(math.log((good + 0.5) / (bad + 0.5)))
    score = dict.fromkeys(train, out.start)
    for _ in range(ROUNDS):
        rows = []
        for x, (a, b) in sorted(train.items()):
            p = 1 / (1 + math.exp(-score[x]))
            rows.append((x, a * (1 - p) - b * p, (a + b) * p * (1 - p)))
        tree = _grow(rows, DEPTH)
        out.trees.append(tree)
        for x in score:
            score[x] += tree(x)
    # The lowest score from which on the held-out precision is high enough, and more likely than not by itself.
    seen = sorted(((out(x), c) for x, c in held.items()), reverse=True)
    right = wrong = 0
    for s, (a, b) in seen:
        right, wrong = right + a, wrong + b
        if s >= 0 and right and right / (right + wrong) >= PRECISION:
            out.threshold = s
    return out


def _with_base(docs: DataFrame) -> DataFrame:
    """doc_id and text with the base spans of each kind and the candidates with their features."""
    text = F.col("text")
    digit = text.rlike("[0-9]{2}")
    needs = {"email": text.contains("@"), "ip": digit | text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike("[0-9][ -]?[0-9][ -]?[0-9]"), "phone": text.contains("+"),
             "number": text.rlike("[0-9][ ().-]{0,2}[0-9]"), "octets": text.rlike(r"(?i)[0-9][ ]?[(\[{<. ][ ]?(?:dot|\.)?.{0,3}[0-9]"), "address": text.contains("@") | text.rlike(r"(?i)[(\[{< ]at[)\]}> ].{1,80}(?:dot|\.)")}
    out = with_matches(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text",
                       {f"_{k}": (p, needs[k]) for k, p in {**_BASE, **_CANDIDATES}.items()})
    out = out.withColumns({f"_{k}": kept(f"_{k}", k, partial(_valid, k)) for k in KINDS})
    out = out.withColumn("_base", F.concat(*[f"_{k}" for k in KINDS]))

    def described(c: Column) -> Column:
        before = F.substring(F.col("text"), F.greatest(F.lit(1), c["start"] - 29).cast("int"), F.least(F.lit(30), c["start"]).cast("int"))
        parts = F.filter("_base", lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"]))
        kind = F.coalesce(F.try_element_at(F.transform(parts, lambda s: s["kind"]), F.lit(1)), F.lit(""))
        normal = _normal(c["text"])
        return F.struct(c["start"].alias("start"), c["end"].alias("end"), kind.alias("inside"), normal.alias("normal"),
                        (normal != c["text"]).alias("disguised"), before.alias("before"))

    return out.withColumn("_found", F.transform(F.concat("_number", "_address", "_octets"), described)).drop("_number", "_address", "_octets", "text")


def known_endings(found: DataFrame) -> list[str]:
    """The most frequent last labels of the plain addresses."""
    plain = found.filter(F.size("_found") > 0).select(F.explode("_found").alias("c")).filter("c.inside = 'email'")
    return [r.ending for r in plain.groupBy(_ending(F.col("c.normal")).alias("ending")).count().filter("ending <> ''").orderBy(F.desc("count"), "ending").limit(ENDINGS).collect()]


def train(found: DataFrame, endings: list[str]) -> dict[str, Booster]:
    """A booster for each learned kind, from the candidates (column _found) of all documents."""
    each = found.filter(F.size("_found") > 0).select((F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)) == 0).alias("held"), F.explode("_found").alias("c"))
    c = F.col("c")
    counts = (each.select("held", F.array(*[f for _, f in _features(c["normal"], c["before"], endings)]).alias("x"), c["inside"].alias("inside"),
                          F.when(c["inside"] == "", _well_formed(c, endings)).otherwise("").alias("open"))
              .groupBy("held", "x", "inside", "open").count().collect())
    out = {}
    for kind in LEARNED:
        folds: tuple[dict, dict] = ({}, {})
        for r in counts:
            if r.open != kind:
                a, b = folds[bool(r.held)].get(tuple(r.x), (0, 0))
                folds[bool(r.held)][tuple(r.x)] = (a + r["count"], b) if r.inside == kind else (a, b + r["count"])
        out[kind] = boost(*folds)
    return out


def find(docs: DataFrame, label: str = "pii") -> DataFrame:
    """Per document: doc_id, base and spans (arrays of kind, start, end, by kind and start), and counts of base spans.

    Null and empty texts have no spans. Repeated rows give a row each. If no plain span
    of a kind occurs, nothing of that kind is learned, and none added.
    """
    found = written(_with_base(docs), label)
    endings = known_endings(found)
    boosters = train(found, endings)
    free = F.filter("_found", lambda c: c["inside"] == "")

    def scored(c: Column) -> Column:
        x = [f for _, f in _features(c["normal"], c["before"], endings)]
        best = F.array_max(F.array(*[F.struct((b.column(x) - F.lit(b.threshold)).alias("score"), F.lit(k).alias("kind"))
                                     for k, b in boosters.items() if b.threshold < math.inf] or [F.struct(F.lit(-1.0).alias("score"), F.lit("").alias("kind"))]))
        return F.struct(best["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), best["score"].alias("score"))

    out = found.withColumn("_scored", F.filter(F.transform(free, scored), lambda s: s["score"] >= 0))
    # Of overlapping selected candidates the best stays, the first of equals.
    better = lambda s: F.exists("_scored", lambda o: (o["start"] < s["end"]) & (s["start"] < o["end"]) & (
        (o["score"] > s["score"]) | ((o["score"] == s["score"]) & ((o["start"] < s["start"]) | ((o["start"] == s["start"]) & (o["end"] > s["end"]))))))
    plain = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    out = out.withColumn("_added", F.transform(F.filter("_scored", lambda s: ~better(s)), plain))

    def ordered(kind: str) -> Column:
        both = F.concat(f"_{kind}", F.filter("_added", lambda s: s["kind"] == kind))
        return F.array_sort(both, lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0))

    return out.select("doc_id", F.col("_base").alias("base"), F.concat(*map(ordered, KINDS)).alias("spans"), *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS])


def report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    return find(docs).select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))

"""Places of pattern matches as column expressions: no Python runs on the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

_STEP = 256
#: Arrays of up to two to this power plus one spans are searched.
_DEPTH = 26
_ARRAY = "array<struct<start:long,end:long,text:string>>"


def _totals(lengths: Column) -> Column:
    """0 and the running sums of a short array."""
    return F.aggregate(lengths, F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))


def with_matches(df: DataFrame, text: str, names: dict[str, tuple[str, Column]]) -> DataFrame:
    """``df`` with an array of (start, end, text) for each name: pattern, and a cheap necessary condition.

    Matches are leftmost and do not overlap; starts and ends count code points. What
    stands between the matches, by ``split``, gives their places. Running sums are
    taken in stretches, so that texts with very many matches stay affordable. Patterns
    must not match the empty string; null texts have no matches.
    """
    def step(**columns: Column) -> DataFrame:
        return df.withColumns({f"_{k}_{n}": c for k, c in columns.items() for n in [name]})

    for name, (pattern, needs) in names.items():
        col = lambda k: F.col(f"_{k}_{name}")  # noqa: B023, E731
        df = step(found=F.when(needs, F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))))
        df = step(between=F.when(F.size(col("found")) > 0, F.split(F.col(text), pattern, -1)))
        df = step(sizes=F.zip_with(F.slice(col("between"), 1, F.size(col("found"))), col("found"),
                                   lambda b, m: (F.length(b) + F.length(m)).cast("long")))
        df = step(sums=F.transform(F.sequence(F.lit(0), F.floor((F.size(col("sizes")) - 1) / _STEP).cast("int")),
                                   lambda c: _totals(F.slice(col("sizes"), c * _STEP + 1, _STEP))))  # noqa: B023
        df = step(bases=_totals(F.transform(col("sums"), lambda s: F.element_at(s, -1))))
        df = step(ends=F.flatten(F.zip_with(col("sums"), F.slice(col("bases"), 1, F.size(col("sums"))),
                                            lambda s, b: F.transform(F.slice(s, 2, _STEP), lambda e: e + b))))
        spans = F.zip_with(col("ends"), col("found"), lambda e, m: F.struct(
            (e - F.length(m)).cast("long").alias("start"), e.cast("long").alias("end"), m.alias("text")))
        df = df.withColumn(name, F.coalesce(spans, F.array().cast(_ARRAY)))
        df = df.drop(*[f"_{k}_{name}" for k in ("found", "between", "sizes", "sums", "bases", "ends")])
    return df


def listed(spans: Column) -> Column:
    """``kind:start:end`` of an array of structs, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def kept(spans: str | Column, kind: str, keep=None) -> Column:
    """Array of (kind, start, end) of the matches that ``keep`` (of their text) lets pass."""
    spans = F.col(spans) if isinstance(spans, str) else spans
    spans = F.filter(spans, lambda s: keep(s["text"])) if keep else spans
    return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def overlaps(spans: str, w: Column) -> Column:
    """Whether a span overlaps one of an array of spans that do not overlap and are in order: a binary search."""
    found, size = F.col(spans), F.size(spans)
    # How many spans end before w begins.
    steps = F.array(*[F.lit(1 << k) for k in range(_DEPTH, -1, -1)])
    before = F.aggregate(steps, F.lit(0), lambda n, step: F.when((n + step <= size) & (F.get(found, n + step - 1)["end"] <= w["start"]), n + step).otherwise(n))
    return F.coalesce(F.get(found, before)["start"] < w["end"], F.lit(False))


def redacted(text: str, spans: str, mark: str) -> Column:
    """``text`` with every place covered by ``spans`` (start, end), in order of start, replaced by ``mark``.

    Spans are taken in groups, each with its own stretch of the text, so that a text with
    very many spans stays affordable.
    """
    found, zero = F.col(spans), F.lit(0).cast("long")
    groups = F.transform(F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / _STEP).cast("int")), lambda k: F.slice(found, k * _STEP + 1, _STEP))
    last = F.transform(groups, lambda g: F.array_max(F.transform(g, lambda s: s["end"])))
    reached = F.aggregate(last, F.array(zero), lambda acc, e: F.concat(acc, F.array(F.greatest(F.element_at(acc, -1), e))))

    def cut(whole: Column, begin: Column, end: Column) -> Column:
        return F.substring(whole, (begin + 1).cast("int"), F.greatest(zero, end - begin).cast("int"))

    def masked(group: Column, begin: Column, end: Column) -> Column:
        own = F.struct(F.lit("").alias("out"), begin.alias("at"), cut(F.col(text), begin, end).alias("own"))
        return F.aggregate(group, own, lambda acc, s: F.struct(
            F.when(s["start"] >= acc["at"], F.concat(acc["out"], cut(acc["own"], acc["at"] - begin, s["start"] - begin), F.lit(mark)))
            .otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"), acc["own"].alias("own")))["out"]

    pieces = F.transform(F.arrays_zip(groups.alias("g"), F.slice(reached, 1, F.size(groups)).alias("b"), F.slice(reached, 2, F.size(groups)).alias("e")),
                         lambda p: masked(p["g"], p["b"], p["e"]))
    end = F.element_at(reached, -1)
    return F.when(F.size(spans) == 0, F.col(text)).otherwise(
        F.concat(F.array_join(pieces, ""), F.substring(F.col(text), (end + 1).cast("int"), F.length(text))))

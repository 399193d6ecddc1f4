"""Headline and source-name text, all in native expressions."""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column, functions as F

from stockloom import constants as C
from stockloom.functions.numbers import rounded

#: Python's ``str.strip`` set as far as it occurs in feeds.
_BLANKS = " \t\n\r\f\u000b 　"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(_BLANKS))


def blank(text: Column) -> Column:
    """True for NULL and for empty text."""
    return text.isNull() | (text == "")


def contains_any(text: Column, words: list[str]) -> Column:
    return reduce(or_, [F.contains(text, F.lit(w)) for w in words], F.lit(False))


def count_contained(text: Column, words: list[str]) -> Column:
    """How many of ``words`` occur in ``text``; each counts once."""
    return reduce(add, [F.contains(text, F.lit(w)).cast("int") for w in words], F.lit(0))


def name_matches(name: Column, pattern: str) -> Column:
    """Whether a pattern occurs in a name, in any case; a missing name matches everything."""
    return F.coalesce(name.rlike(f"(?i){pattern}"), F.lit(True))


def allowed_source(name: Column, keywords: list[str] = C.SOURCE_KEYWORDS) -> Column:
    return F.coalesce(contains_any(F.lower(name), keywords), F.lit(False))


def _pieces(title: Column) -> Column:
    return F.split(title, C.TITLE_SOURCE_SEPARATOR)


def clean_title(title: Column, source: Column) -> Column:
    """The headline without a trailing " - publisher" that stands in for a missing source."""
    parts = _pieces(title)
    head = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), C.TITLE_SOURCE_SEPARATOR)
    return F.when(blank(source) & F.contains(title, F.lit(C.TITLE_SOURCE_SEPARATOR)), strip(head)).otherwise(title)


def clean_source(title: Column, source: Column) -> Column:
    """The publisher, taken from the end of the headline where the feed names none."""
    last = strip(F.element_at(_pieces(title), -1))
    return F.when(
        blank(source) & F.contains(title, F.lit(C.TITLE_SOURCE_SEPARATOR)), last
    ).otherwise(F.coalesce(source, F.lit("")))


def lexicon_score(title: Column, positive: list[str] = C.POSITIVE_WORDS,
                  negative: list[str] = C.NEGATIVE_WORDS) -> Column:
    """Balance of positive and negative words scaled to ±0.8; 0 without a hit."""
    good, bad = count_contained(title, positive), count_contained(title, negative)
    score = rounded((good - bad) / F.nullif(good + bad, F.lit(0)) * C.LEXICON_SCALE, 2)
    return F.coalesce(score, F.lit(0.0))


def search_keyword(abbr: Column, name: Column, code: Column) -> Column:
    """Short name, else full name, else the code itself."""
    return F.coalesce(F.nullif(abbr, F.lit("")), F.nullif(name, F.lit("")), code)


def row_digest(*parts: Column) -> Column:
    """A stable id of the given values: the same row gets the same id in every run."""
    return F.sha2(F.concat_ws("\u0001", *parts), 256)

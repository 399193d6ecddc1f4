"""Tolerant and guarded arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def tolerant_number(text: Column) -> Column:
    """Text as a double; NULL where it is not a number."""
    return F.nanvl(F.trim(text).try_cast("double"), F.lit(None).cast("double"))


def number_or_zero(text: Column) -> Column:
    return F.coalesce(tolerant_number(text), F.lit(0.0))


def ratio_or(numerator: Column, denominator: Column, fallback: Column | float) -> Column:
    """``numerator / denominator`` where the denominator is positive, else ``fallback``."""
    other = fallback if isinstance(fallback, Column) else F.lit(float(fallback))
    return F.when(denominator > 0, numerator / denominator).otherwise(other)


def signed_sentinel(value: Column, size: float) -> Column:
    """``size`` for a non-negative value, ``-size`` otherwise."""
    return F.when(value >= 0, F.lit(size)).otherwise(F.lit(-size))


def rounded(value: Column, decimals: int) -> Column:
    """Half-up rounding by one multiplication, the same on every engine with IEEE doubles."""
    scale = 10.0 ** decimals
    return F.floor(value * scale + 0.5) / scale


def at_fixed(value: Column, decimals: int, signed: bool = False) -> Column:
    """Text of a number with a fixed number of decimals; ``signed`` puts the sign before every one."""
    number = value.cast("double")
    text = F.format_string(f"%.{decimals}f", rounded(F.abs(number) if signed else number, decimals))
    if signed:
        text = F.concat(F.when(number < 0, "-").otherwise("+"), text)
    return F.when(value.isNotNull(), text)


def signed_thousands(value: Column) -> Column:
    """Text like ``+1,234`` of the whole part of a number."""
    return F.format_string("%+,d", value.cast("bigint"))

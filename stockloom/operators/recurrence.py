"""First-order recurrences ``y = a*x + (1-a)*y_before`` as window sums.

Unrolled from the start of a stretch, ``y`` at position p is
``q**p * sum(a * x_i * q**-i) + q**(p+1) * carry`` with q = 1-a: a running sum of
scaled terms plus what the stretch before left behind. Stretches are long
enough that the carry of the carry is below double precision, and short enough
that ``q**-i`` stays in range, so one look at the end of the previous stretch
is all that is needed. A seed in front of the first row fades as ``q**(row+1)``
and is added in closed form.

A second recurrence fed by the first one needs what the first one's carry
contributes to it, which is again a closed form.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from stockloom.operators.series import POSITION, ROW, Series


def _power(base: float, exponent: Column) -> Column:
    return F.pow(F.lit(base), exponent.cast("double"))


def position_steps() -> Column:
    return F.col(POSITION) + 1


def row_steps() -> Column:
    return F.col(ROW) + 1


@dataclass(frozen=True)
class Smoothing:
    """A recurrence with weight ``alpha`` of the new value."""

    alpha: float

    @property
    def keep(self) -> float:
        return 1.0 - self.alpha

    @classmethod
    def of_span(cls, span: int) -> "Smoothing":
        return cls(2.0 / (span + 1))

    def local(self, series: Series, value: Column, from_first_value: bool | Column = False) -> Column:
        """The recurrence within the stretch, starting from nothing.

        ``from_first_value``: the first row of the series (where a column says so) counts in full.
        """
        first = F.col(ROW) == 0
        if isinstance(from_first_value, Column):
            first &= from_first_value
        weight = F.lit(self.alpha) if from_first_value is False else F.when(first, F.lit(1.0)).otherwise(F.lit(self.alpha))
        scaled = weight * value * _power(self.keep, -F.col(POSITION))
        return _power(self.keep, F.col(POSITION)) * F.sum(scaled).over(series.stretch())

    def faded(self, carry: Column) -> Column:
        """What is left of the previous stretch's end value at this row."""
        return _power(self.keep, position_steps()) * carry

    def faded_seed(self, seed: float | Column, steps: Column | None = None) -> Column:
        """What is left of a value before the first row after so many rows."""
        return _power(self.keep, row_steps() if steps is None else steps) * seed

    def fed_by_equal(self, carry: Column, steps: Column) -> Column:
        """Contribution of a fading carry of an equal recurrence that feeds this one."""
        return self.alpha * steps * _power(self.keep, steps) * carry

    def fed_by(self, other: "Smoothing", carry: Column, steps: Column | None = None) -> Column:
        """The same for a feeding recurrence with another weight."""
        steps = position_steps() if steps is None else steps
        factor = self.alpha * other.keep / (self.keep - other.keep)
        return factor * (_power(self.keep, steps) - _power(other.keep, steps)) * carry


def carry_steps(series: Series, locals_: dict[str, str]) -> list[dict[str, Column]]:
    """Two steps giving each local column's value at the end of the previous stretch.

    ``locals_`` maps the new column to the local column; the first stretch of a
    block has no predecessor and gets 0.
    """
    edge = {f"{new}_edge": F.when(F.col(POSITION) == 0, F.lag(old).over(series.ordered()))
            for new, old in locals_.items()}
    held = {new: F.coalesce(F.first(f"{new}_edge").over(series.stretch()), F.lit(0.0))
            for new in locals_}
    return [edge, held]

"""Computed measures: expressions over finished measures, evaluated after aggregation."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Computed:
    """An expression with the stored or computed measures it needs."""

    build: Callable[[Callable[[str], Column]], Column]
    needs: frozenset = frozenset()

    def column(self, resolve: Callable[[str], Column]) -> Column:
        return self.build(resolve)

    def __add__(self, other):
        return add(self, other)

    def __sub__(self, other):
        return sub(self, other)

    def __mul__(self, other):
        return mul(self, other)

    def __truediv__(self, other):
        return div(self, other)


Operand = "Computed | str | int | float"


def _of(x) -> Computed:
    return x if isinstance(x, Computed) else measure(x) if isinstance(x, str) else value(x)


def _join(fn, *args) -> Computed:
    parts = [_of(a) for a in args]
    return Computed(lambda r: fn(*[p.column(r) for p in parts]), frozenset().union(*[p.needs for p in parts]))


def value(x) -> Computed:
    return Computed(lambda r: F.lit(x))


def measure(name: str) -> Computed:
    return Computed(lambda r: r(name), frozenset([name]))


def add(a, b) -> Computed:
    return _join(lambda x, y: x + y, a, b)


def sub(a, b) -> Computed:
    return _join(lambda x, y: x - y, a, b)


def mul(a, b) -> Computed:
    return _join(lambda x, y: x * y, a, b)


def div(a, b) -> Computed:
    """Quotient as double; 0.0 where the divisor is 0."""
    return _join(lambda x, y: F.when(y.cast("double") != 0.0, x.cast("double") / F.nullif(y.cast("double"), F.lit(0.0))).otherwise(F.lit(0.0)), a, b)


def sqrt(a) -> Computed:
    """Root; 0.0 where the argument isn't positive."""
    return _join(lambda x: F.when(x.cast("double") > 0.0, F.sqrt(x.cast("double"))).otherwise(F.lit(0.0)), a)


def sqr(a) -> Computed:
    return _join(lambda x: x.cast("double") * x.cast("double"), a)


def variance(total, total_of_squares, n) -> Computed:
    """Population variance from sums: E[x^2] - E[x]^2."""
    return sub(div(total_of_squares, n), sqr(div(total, n)))


def stddev(total, total_of_squares, n) -> Computed:
    return sqrt(variance(total, total_of_squares, n))


def percent(a, b=None) -> Computed:
    """100 a, or 100 a / b."""
    return mul(_of(a) if b is None else div(a, b), 100)


def stored_needs(names, computed: Mapping[str, Computed]) -> set[str]:
    """The stored measures that ``names`` come down to."""
    out: set[str] = set()
    for n in names:
        out |= stored_needs(computed[n].needs, computed) if n in computed else {n}
    return out


def with_computed(df, names, computed: Mapping[str, Computed]):
    """``df`` with the computed measures among ``names``, nested ones resolved."""

    def resolve(n: str) -> Column:
        return computed[n].column(resolve) if n in computed else F.col(n)

    return df.withColumns({n: resolve(n) for n in names if n in computed})

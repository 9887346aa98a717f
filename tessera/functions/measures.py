"""Mergeable measures: expressions to ingest rows, merge stored states and finish them.

A measure's state is one column; partial and merged aggregation are built-in aggregates, so
Catalyst combines them before the shuffle. ``KINDS`` is open: a kind of one's own is five
functions, and every operator that takes measures takes it.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Measure:
    """``kind`` is a name in ``KINDS``; ``type`` is the declared type, for union that of the elements."""

    kind: str
    type: str = "bigint"
    registers: int = 1024

    @property
    def _kind(self) -> Kind:
        if self.kind not in KINDS:
            raise ValueError(f"unknown measure {self.kind}")
        return KINDS[self.kind]

    def ingest(self, value: Column | None) -> Column:
        """State of a group of input rows; ``value`` is ignored by count."""
        if value is None and self._kind.needs_input:
            raise ValueError(f"{self.kind} needs an input column")
        return self._kind.ingest(self, value)

    def merge(self, state: Column) -> Column:
        """State of a group of states. ``merged`` does the same for a frame, and never gathers sets."""
        return self._kind.merge(self, state)

    def merge_pair(self, a: Column, b: Column) -> Column:
        """State of two states, either of which may be NULL (absent)."""
        return F.coalesce(self._kind.pair(self, a, b), a, b)

    def finish(self, state: Column) -> Column:
        """The value shown for a state; what is absent shows as the type's default."""
        return self._kind.finish(self, state)

    @property
    def state_type(self) -> str:
        return self._kind.state_type(self)


def _or_zero(m: Measure, state: Column) -> Column:
    return F.coalesce(state, F.lit(0)).cast(m.type)


@dataclass(frozen=True)
class Kind:
    """How a measure works: functions of the measure and of columns. ``pair`` may be NULL where one of its states is."""

    ingest: Callable[[Measure, Column], Column]
    merge: Callable[[Measure, Column], Column]
    pair: Callable[[Measure, Column, Column], Column]
    finish: Callable[[Measure, Column], Column] = _or_zero
    state_type: Callable[[Measure], str] = lambda m: m.type
    needs_input: bool = True


KINDS: dict[str, Kind] = {
    "sum": Kind(lambda m, v: F.coalesce(F.sum(v), F.lit(0)).cast(m.type), lambda m, s: F.sum(s).cast(m.type), lambda m, a, b: a + b),
    "min": Kind(lambda m, v: F.min(v).cast(m.type), lambda m, s: F.min(s).cast(m.type), lambda m, a, b: F.least(a, b)),
    "max": Kind(lambda m, v: F.max(v).cast(m.type), lambda m, s: F.max(s).cast(m.type), lambda m, a, b: F.greatest(a, b)),
    "count": Kind(lambda m, v: F.count(F.lit(1)).cast(m.type), lambda m, s: F.sum(s).cast(m.type), lambda m, a, b: a + b, needs_input=False),
    "hll": Kind(
        lambda m, v: F.hll_sketch_agg(v, F.lit(m.registers.bit_length() - 1)), lambda m, s: F.hll_union_agg(s), lambda m, a, b: F.hll_union(a, b),
        lambda m, s: F.coalesce(F.hll_sketch_estimate(s), F.lit(0)).cast("int"), lambda m: "binary",
    ),
    "union": Kind(
        lambda m, v: F.array_sort(F.collect_set(v.cast(m.type))), lambda m, s: F.array_sort(F.array_distinct(F.flatten(F.collect_list(s)))), lambda m, a, b: F.array_sort(F.array_union(a, b)),
        lambda m, s: F.coalesce(s, F.array().cast(f"array<{m.type}>")), lambda m: f"array<{m.type}>",
    ),
}


def merged(states: DataFrame, keys: Sequence[str], measures: Mapping[str, Measure]) -> DataFrame:
    """States merged by key; without keys one row.

    Sets are merged by their elements: these become rows, which are made distinct before and after
    the shuffle, so a task never holds the sets of many rows, only each result once.
    """
    sets = [n for n, m in measures.items() if m.kind == "union"]
    rest = [n for n in measures if n not in sets]
    if not sets:
        return states.groupBy(*keys).agg(*[measures[n].merge(F.col(n)).alias(n) for n in rest]) if rest else states.select(*keys).distinct()
    null = lambda n: F.lit(None).cast(measures[n].type if n in sets else measures[n].state_type)

    def item(of: str | None, element: Column | None = None) -> Column:
        own = [F.col(n).alias(n) if of is None and n in rest else (element if n == of else null(n)).alias(n) for n in measures]
        return F.struct(F.lit(-1 if of is None else sets.index(of)).alias("__of"), *own)

    def items(n: str) -> Column:
        return F.transform(F.coalesce(F.col(n), F.array().cast(f"array<{measures[n].type}>")), lambda x: item(n, x))

    rows = states.select(*keys, F.inline(F.concat(F.array(item(None)), *[items(n) for n in sets])))
    once = rows.groupBy(*keys, "__of", *sets).agg(*[measures[n].merge(F.col(n)).alias(n) for n in rest]) if rest else rows.select(*keys, "__of", *sets).distinct()
    elements = lambda n: F.array_sort(F.collect_list(F.when(F.col("__of") == sets.index(n), F.col(n))))
    return once.groupBy(*keys).agg(*[(elements(n) if n in sets else measures[n].merge(F.col(n))).alias(n) for n in measures])


def sum_of(type: str = "bigint") -> Measure:
    return Measure("sum", type)


def min_of(type: str = "bigint") -> Measure:
    return Measure("min", type)


def max_of(type: str = "bigint") -> Measure:
    return Measure("max", type)


def count_of(type: str = "bigint") -> Measure:
    return Measure("count", type)


def hll(registers: int = 1024) -> Measure:
    """Approximate number of distinct values, with 2^k registers (16 at least)."""
    if registers & (registers - 1) or not 16 <= registers <= 1 << 21:
        raise ValueError("registers must be a power of two from 16 to 2^21")
    return Measure("hll", "int", registers)


def union(type: str = "bigint") -> Measure:
    """Exact set of distinct values."""
    return Measure("union", type)

"""Row expressions under one roof: what Spark's functions don't name directly.

Literals, casts, logic, comparison, arithmetic, bit operations, lists and maps are Spark's own
(``F.lit``, ``cast``, ``& | ~``, ``F.bitwise_not``, ``F.shiftleft``, ``F.element_at``, ``F.transform``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def if_then_else(test: Column, yes: Column, no: Column) -> Column:
    """A NULL test counts as false."""
    return F.when(test, yes).otherwise(no)


def switch_by_index(index: Column, branches: Sequence[Column]) -> Column:
    """The branch with the number ``index``; NULL outside."""
    out = None
    for i, b in enumerate(branches):
        out = F.when(index == i, b) if out is None else out.when(index == i, b)
    return out if out is not None else F.lit(None)


def switch_by_key(key: Column, cases: Mapping[Any, Column], default: Column | None = None) -> Column:
    out = None
    for k, b in cases.items():
        hit = key.eqNullSafe(F.lit(k))
        out = F.when(hit, b) if out is None else out.when(hit, b)
    if out is None:
        return default if default is not None else F.lit(None)
    return out.otherwise(default) if default is not None else out


def compare(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """-1, 0 or 1 by lexicographic order of the columns; NULLs come first."""
    out = F.lit(0)
    for x, y in reversed(list(zip(a, b))):
        before = x.isNull() & y.isNotNull() | F.coalesce(x < y, F.lit(False))
        after = x.isNotNull() & y.isNull() | F.coalesce(x > y, F.lit(False))
        out = F.when(before, -1).when(after, 1).otherwise(out)
    return out


def hash_of(*columns: Column) -> Column:
    """64-bit hash for placement; values aren't those of other engines."""
    return F.xxhash64(*columns)


def to_string(**columns: Column) -> Column:
    """{name=value, ..} of the columns, NULL as null."""
    parts = []
    for n, c in columns.items():
        parts += [F.lit(("{" if not parts else ", ") + n + "="), F.coalesce(c.cast("string"), F.lit("null"))]
    return F.concat(*parts, F.lit("}"))


def set_item(items: Column, index: Column | int, value: Column) -> Column:
    """The list with one element (from 0) replaced."""
    return F.transform(items, lambda x, i: F.when(i == index, value).otherwise(x))


def fail_if(test: Column, message: str, otherwise: Column) -> Column:
    return F.when(test, F.raise_error(F.lit(message))).otherwise(otherwise)


def days_to_date(days: Column, epoch: str = "1970-01-01") -> Column:
    """The date that many days after ``epoch``."""
    return F.date_add(F.lit(epoch).cast("date"), days.cast("int"))


def date_to_days(date: Column, epoch: str = "1970-01-01") -> Column:
    return F.datediff(date, F.lit(epoch).cast("date"))


def field(name: str) -> Column:
    """A column whose name may hold dots."""
    return F.col(f"`{name}`")

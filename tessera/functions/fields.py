"""Types of dimensions that are stored otherwise than they are shown.

A plain type is its Spark name. A ``FieldType`` stores each value in a form that is smaller or sorts as
wanted; predicates and rows come in the shown form and results go out in it.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class FieldType:
    """``state`` is the stored Spark type; the functions lead from a shown column or Python value to the stored one, and back."""

    state: str
    to_state: Callable[[Column], Column]
    to_value: Callable[[Column], Column]
    literal: Callable[[Any], Any]


def days(epoch: str = "1970-01-01") -> FieldType:
    """Dates, stored as days since ``epoch``."""
    first = datetime.date.fromisoformat(epoch)

    def literal(v: Any) -> Any:
        if isinstance(v, str):
            v = datetime.date.fromisoformat(v)
        return None if v is None else (v - first).days

    return FieldType("int", lambda c: F.datediff(c.cast("date"), F.lit(epoch).cast("date")), lambda c: F.date_add(F.lit(epoch).cast("date"), c), literal)


def enum(*names: str) -> FieldType:
    """One of ``names``, stored as its number, so that it is sorted as they are; another value is NULL."""
    if len(set(names)) < len(names):
        raise ValueError("a name is there twice")
    numbers = lambda: F.array(*[F.lit(n) for n in names])
    place = lambda c: F.nullif(F.array_position(numbers(), c), F.lit(0)) - 1
    return FieldType("int", lambda c: place(c).cast("int"), lambda c: F.get(numbers(), c), lambda v: None if v is None else names.index(v))

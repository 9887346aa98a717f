"""Joins: many left rows to the first right row of their key, value joiners and dictionary lookups.

Spark chooses the strategy. A dictionary is broadcast only where Spark's own size estimate is
under the session's threshold; beyond it the same call is a shuffled join.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.dataset import first_per_key


def join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", first: Sequence[str] | None = None, legacy_tail: bool = False) -> DataFrame:
    """Equi-join ``inner`` or ``left``.

    ``first`` orders the right rows of a key, of which only the first then joins: the semantics
    of a merge join that moves on only its left side. ``legacy_tail`` drops left rows above the
    last right key, as such a join does when it ends with its right side. NULL keys match nothing and sort first.
    """
    on = list(on)
    if first is not None:
        right = first_per_key(right, on, list(first) or [c for c in right.columns if c not in on])
    out = left.join(right, on, how)
    if legacy_tail and how == "left":
        last = right.where(F.col(on[0]).isNotNull()).agg(F.max(F.struct(*on)))
        out = out.where(F.struct(*on) <= last.scalar())
    return out


def value_join(left: DataFrame, right: DataFrame, on: Sequence[str], inner: Callable[[DataFrame], dict[str, Column]], left_only: dict[str, Column] | None = None) -> DataFrame:
    """At most one row out per match: ``inner`` gives its columns from the joined row, ``left_only`` those of an
    unmatched left row. A row whose columns are all NULL is no row."""
    matched = right.withColumn("__matched", F.lit(True))
    both = left.join(matched, list(on), "left" if left_only is not None else "inner")
    made = inner(both)
    if left_only is not None:
        made = {n: F.when(F.col("__matched"), c).otherwise(left_only[n]) for n, c in made.items()}
    out = both.select(*[c.alias(n) for n, c in made.items()])
    return out.where(" OR ".join(f"`{n}` IS NOT NULL" for n in made))


def lookup(df: DataFrame, dictionary: DataFrame, key: Sequence[str], attributes: Sequence[str]) -> DataFrame:
    """``df`` with attributes of its key; missing keys have NULL. Repeated keys of the dictionary count once, the
    least row; a key or attribute that ``df`` has already keeps its place."""
    held = first_per_key(dictionary.select(*key, *attributes), list(key), list(attributes))
    return df.join(held, list(key), "left")

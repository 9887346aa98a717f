"""Reducers: keyed folds with built-in aggregates first, arbitrary accumulators in pandas last."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Any

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.dataset import first_per_key, union_all


def reduce_by_key(df: DataFrame, key: Sequence[str], having: Column | None = None, **aggregates: Column) -> DataFrame:
    """Built-in aggregates per key: partial before the shuffle, final after it; ``having`` filters results."""
    out = df.groupBy(*key).agg(*[a.alias(n) for n, a in aggregates.items()])
    return out if having is None else out.where(having)


#: Groups that ``partial_reduce`` holds in a task before it hands them on.
PARTIAL_GROUPS = 500_000


def partial_reduce(df: DataFrame, key: Sequence[str], schema: str, aggregates: Mapping[str, tuple[str, str]], groups: int = PARTIAL_GROUPS) -> DataFrame:
    """Reduction in each partition alone, ``{out: (function, column)}`` with sum, min, max or count; no shuffle.

    A key comes out once per partition, or once for each ``groups`` groups of it, to be merged by a
    later reduction. Where the result isn't wanted by itself, ``reduce_by_key`` does the same within its plan.
    """
    again = {"sum": "sum", "min": "min", "max": "max", "count": "sum"}

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        def reduced(tables: list, first: bool):
            spec = [(c, f) for f, c in aggregates.values()] if first else [(n, again[f]) for n, (f, _) in aggregates.items()]
            spec = [(c, f, pc.CountOptions(mode="all")) if first and f == "count" else (c, f) for c, f in spec]
            made = pa.concat_tables(tables).group_by(list(key)).aggregate(spec)
            return made.select([*key, *[f"{s[0]}_{s[1]}" for s in spec]]).rename_columns([*key, *aggregates])

        held = None
        for batch in batches:
            new = reduced([pa.Table.from_batches([batch])], True)
            held = new if held is None else reduced([held, new], False)
            if held.num_rows >= groups:
                yield from held.to_batches()
                held = None
        if held is not None:
            yield from held.to_batches()

    wanted = T.StructType.fromDDL(schema)
    return df.mapInArrow(_typed(run, wanted), wanted)


def _typed(run: Callable, wanted: T.StructType) -> Callable:
    """``run`` with its batches in the declared order and types."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(wanted)

    def typed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in run(batches):
            yield from pa.Table.from_batches([batch]).select(arrow.names).cast(arrow).to_batches()

    return typed


def merge_distinct(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key, in ``order``."""
    return first_per_key(df, key, order)


def fold(df: DataFrame, key: Sequence[str], value: str, zero: Column, op: Callable[[Column, Column], Column], out: str, order: Sequence[str] = (), keep: Column | None = None) -> DataFrame:
    """Fold of a key's values with a binary operation, in ``order`` if given; ``keep`` filters results.

    The values of a key are gathered in one row: for sums and the like use ``reduce_by_key``.
    """
    items = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("__v"))))
    folded = df.groupBy(*key).agg(items.alias("__items")).select(*key, F.aggregate("__items", zero, lambda a, x: op(a, x["__v"])).alias(out))
    return folded if keep is None else folded.where(keep)


def merge_reduce(key: Sequence[str], inputs: Sequence[tuple[DataFrame, Mapping[str, Column]]], **aggregates: Column) -> DataFrame:
    """Reduction over several inputs of different form: each is given with the expressions of the common columns."""
    common = [df.select(*[c.alias(n) for n, c in columns.items()]) for df, columns in inputs]
    return reduce_by_key(union_all(*common), key, **aggregates)


class Accumulator:
    """The general contract: a fresh accumulator, items into it, two into one, the result out of it."""

    def create(self) -> Any:
        raise NotImplementedError

    def accumulate(self, acc: Any, rows: pd.DataFrame) -> Any:
        raise NotImplementedError

    def combine(self, a: Any, b: Any) -> Any:
        raise NotImplementedError

    def result(self, acc: Any) -> dict:
        raise NotImplementedError


def accumulate_by_key(df: DataFrame, key: Sequence[str], key_schema: str, acc: Accumulator, result_schema: str, salts: int = 64, groups: int = 10_000) -> DataFrame:
    """``acc`` over each key, in three phases: in each partition before the shuffle, then by key and salt, then by key.

    Accumulators travel pickled. A task holds the accumulators of ``groups`` keys at most before it hands
    them on; for a hot key the second phase spreads what comes over ``salts`` tasks, so at most that
    many accumulators of a key meet in one. Accumulators are combined in no order, as the contract allows.
    """
    import pickle

    names = list(key)
    one = names if len(names) > 1 else names[0]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, Any] = {}

        def out() -> pd.DataFrame:
            return pd.DataFrame([(*k, i % salts, pickle.dumps(a)) for i, (k, a) in enumerate(held.items(), TaskContext.get().partitionId())], columns=[*names, "__salt", "__acc"])

        for b in batches:
            for k, g in b.groupby(one, dropna=False):
                k = tuple(None if pd.isna(x) else x for x in (k if isinstance(k, tuple) else (k,)))
                held[k] = acc.accumulate(held[k] if k in held else acc.create(), g)
            if len(held) >= groups:
                yield out()
                held.clear()
        if held:
            yield out()

    def combined(rows: pd.DataFrame) -> Any:
        total = acc.create()
        for blob in rows["__acc"]:
            total = acc.combine(total, pickle.loads(blob))
        return total

    def middle(k: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*k[:-1], pickle.dumps(combined(rows)))], columns=[*names, "__acc"])

    def final(k: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([dict(zip(names, k)) | acc.result(combined(rows))])

    states = df.mapInPandas(partial, f"{key_schema}, __salt int, __acc binary")
    salted = states.groupBy(*names, "__salt").applyInPandas(middle, f"{key_schema}, __acc binary")
    return salted.groupBy(*names).applyInPandas(final, f"{key_schema}, {result_schema}")


def pagerank(pages: DataFrame, iterations: int = 10, damping: float | None = None, page: str = "page_id", links: str = "links", every: int = 5) -> DataFrame:
    """(page, rank) after some rounds in which each page hands its rank on over its links in equal parts.

    All pages start with 1. Undamped, a page to which nothing links leaves the result; with
    ``damping`` d every page has 1 - d besides. Ranks are cut by a written table every few
    rounds, so lineage stays short.
    """
    from tessera.session import cut, discard

    pages = pages.select(page, links).where(F.size(links) > 0)
    ranks, held = pages.select(page, F.lit(1.0).alias("rank")), None
    for i in range(iterations):
        sent = pages.join(ranks, page).select(F.explode(links).alias(page), (F.col("rank") / F.size(links)).alias("part"))
        came = sent.groupBy(page).agg(F.sum("part").alias("rank"))
        if damping is not None:
            came = pages.select(page).join(came, page, "left").select(page, (F.lit(1 - damping) + F.lit(damping) * F.coalesce("rank", F.lit(0.0))).alias("rank"))
        ranks = came
        if (i + 1) % every == 0 and i + 1 < iterations:
            ranks = cut(ranks, "ranks")
            discard(held)
            held = ranks
    return ranks

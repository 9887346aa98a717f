"""Datasets: row transforms, sorting, partitioning and multi-input operators as DataFrame plans.

Everything here is lazy. A function of a column or row should be given as a column expression;
functions of pandas batches run in Arrow.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


# -- sources --------------------------------------------------------------------------------


def of(spark: SparkSession, rows: Iterable, schema: str | T.StructType) -> DataFrame:
    """An in-memory source; stops at the first None, as a supplier of single items does."""
    kept = []
    for r in rows:
        if r is None:
            break
        kept.append(r)
    return spark.createDataFrame(kept, schema)


def closing(spark: SparkSession, schema: str) -> DataFrame:
    """An empty source."""
    return spark.createDataFrame([], schema)


def closing_with_error(spark: SparkSession, schema: str, message: str) -> DataFrame:
    """A source that fails when it runs."""
    one = spark.range(1).select(F.raise_error(F.lit(message)).alias("__error"))
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return one.select(*[F.col("__error").cast(f.dataType).alias(f.name) for f in wanted])


# -- row transforms -------------------------------------------------------------------------


def map_rows(df: DataFrame, **columns: Column) -> DataFrame:
    """1:1 projection to the named expressions."""
    return df.select(*[c.alias(n) for n, c in columns.items()])


def filter_rows(df: DataFrame, test: Column) -> DataFrame:
    return df.where(test)


def flat_map(df: DataFrame, items: Column, name: str, keep: Sequence[str] = ()) -> DataFrame:
    """1:N: a row per element of an array expression; NULL and empty arrays give none."""
    return df.select(*keep, F.explode(items).alias(name))


def take_until(df: DataFrame, test: Column, order: Sequence[Column | str], partition: Sequence[str] = ()) -> DataFrame:
    """Rows up to and including the first, in ``order``, that meets ``test``; per partition key if given.

    Where ``order`` is plain columns, the place of the first hit is a minimum, combined before the
    shuffle, and every row is compared with it: nothing is sorted and no task holds a partition's rows. ``order``
    should tell rows apart; rows that tie with the hit come with it. Other orders need a window.
    """
    if not all(isinstance(o, str) for o in order):
        w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        stopped = F.coalesce(F.max(F.coalesce(test, F.lit(False)).cast("int")).over(w), F.lit(0))
        return df.withColumn("__stopped", stopped).where("__stopped = 0").drop("__stopped")
    place = F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate(order)])
    hits = df.where(test).groupBy(*[F.col(p).alias(f"__p{i}") for i, p in enumerate(partition)]).agg(F.min(place).alias("__stop"))
    if not partition:  # one row
        return df.where(F.coalesce(place <= hits.scalar(), F.lit(True)))
    same = [df[p].eqNullSafe(hits[f"__p{i}"]) for i, p in enumerate(partition)]
    return df.join(hits, same, "left").where(F.col("__stop").isNull() | (place <= F.col("__stop"))).select(*[df[c] for c in df.columns])


def transduce(df: DataFrame, schema: str, on_item: Callable[[pd.DataFrame, dict], pd.DataFrame], on_started: Callable[[], dict] = dict, on_end: Callable[[dict], pd.DataFrame | None] = lambda state: None) -> DataFrame:
    """Stateful map over each partition, in batches: the state lives from ``on_started`` to ``on_end``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = on_started()
        for batch in batches:
            yield on_item(batch, state)
        last = on_end(state)
        if last is not None:
            yield last

    return df.mapInPandas(run, schema)


def split(df: DataFrame, **tests: Column) -> dict[str, DataFrame]:
    """One input to several outputs: each gets the rows that meet its condition."""
    return {n: df.where(t) for n, t in tests.items()}


def byte_range(df: DataFrame, column: str, offset: int, length: int | None = None) -> DataFrame:
    """A slice of a binary column."""
    part = F.substring(column, offset + 1, 2**31 - 1 if length is None else length)
    return df.withColumn(column, part)


def chunk_bytes(df: DataFrame, column: str, size: int) -> DataFrame:
    """A binary column cut into pieces of ``size`` bytes at most, a row each, numbered from 0 by ``piece``; an empty value is one empty piece, NULL none."""
    pieces = F.sequence(F.lit(0), F.greatest(F.floor((F.octet_length(column) - 1) / size), F.lit(0)).cast("int"))
    spread = df.where(F.col(column).isNotNull()).withColumn("piece", F.explode(pieces))
    return spread.withColumn(column, F.substring(column, F.col("piece") * size + 1, F.lit(size)))


def observed(df: DataFrame, name: str):
    """(``df`` that counts its rows as they pass, the Observation that holds the count)."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("items")), seen


# -- sorting and partitioning ---------------------------------------------------------------


def sort(df: DataFrame, *key: str | Column) -> DataFrame:
    return df.orderBy(*key)


def local_sort(df: DataFrame, *key: str | Column) -> DataFrame:
    """Each partition sorted by itself; no shuffle."""
    return df.sortWithinPartitions(*key)


def repartition_sort(df: DataFrame, *key: str, partitions: int | None = None) -> DataFrame:
    """All rows of a key in one partition, partitions sorted by key."""
    shuffled = df.repartition(partitions, *key) if partitions else df.repartition(*key)
    return shuffled.sortWithinPartitions(*key)


def first_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key in ``order``: the distinct form of sort, merge and gather.

    Rows are reduced by a max/min aggregate before the shuffle if ``order`` are plain ascending
    columns; only general orders need the window.
    """
    rest = [c for c in df.columns if c not in key]
    if all(isinstance(o, str) for o in order):
        least = F.min(F.struct(*[F.col(o).alias(f"__o{i}") for i, o in enumerate(order)], *rest))
        return df.groupBy(*key).agg(least.alias("__first")).select(*key, *[F.col("__first")[c].alias(c) for c in rest]).select(*df.columns)
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def union_all(*inputs: DataFrame) -> DataFrame:
    """All rows of all inputs, columns by name, in no order."""
    out = inputs[0]
    for df in inputs[1:]:
        out = out.unionByName(df)
    return out


def concat(*inputs: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """Inputs one after the other: ``__source`` numbers them, rows are sorted by it, then by ``order``."""
    return union_all(*[df.withColumn("__source", F.lit(i)) for i, df in enumerate(inputs)]).orderBy("__source", *order)


def merge_sorted(*inputs: DataFrame, key: Sequence[str], distinct: bool = False) -> DataFrame:
    """Sorted union by ``key``; ``distinct`` keeps one row per key, the one from the earliest input.

    Rows of one key in one input are told apart by their other columns, in order.
    """
    numbered = union_all(*[df.withColumn("__source", F.lit(i)) for i, df in enumerate(inputs)])
    if distinct:
        rest = [c for c in inputs[0].columns if c not in key]
        numbered = first_per_key(numbered, key, ["__source", *rest])
    return numbered.orderBy(*key, "__source").drop("__source")


def rendezvous(df: DataFrame, key: str, shards: Mapping[str, int] | Sequence[str], copies: int = 1, buckets: int = 1024, out: str = "shards") -> DataFrame:
    """``df`` with the list of the ``copies`` shards that own each row's key.

    Keys fall into ``buckets``; for each bucket the shards with the greatest hashes own it, so a
    shard that comes or goes moves only its own share. The table of buckets is made once, from
    the shard names, and is looked up by bucket.
    """
    spark = df.sparkSession
    names = list(shards)
    ranked = (
        spark.range(buckets).select(F.col("id").cast("int").alias("__bucket"), F.explode(F.array(*[F.lit(s) for s in names])).alias("shard"))
        .withColumn("weight", F.xxhash64("__bucket", "shard"))
        .groupBy("__bucket").agg(F.sort_array(F.collect_list(F.struct("weight", "shard")), asc=False).alias("order"))
        .select("__bucket", F.slice(F.transform("order", lambda x: x["shard"]), 1, copies).alias(out))
    )
    placed = df.withColumn("__bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    # one row per bucket, a fixed number of them
    return placed.join(F.broadcast(ranked), "__bucket").drop("__bucket")


_FILTERS = {
    "=": lambda c, v: c.eqNullSafe(F.lit(v)), "!=": lambda c, v: ~c.eqNullSafe(F.lit(v)), ">": lambda c, v: c > v, ">=": lambda c, v: c >= v, "<": lambda c, v: c < v, "<=": lambda c, v: c <= v,
    "in": lambda c, v: c.isin(list(v)), "like": lambda c, v: F.contains(c.cast("string"), F.lit(v)),
}


def read_settings(df: DataFrame, fields: Sequence[str], filters: Mapping[str, object] | None = None, sort: Mapping[str, str] | None = None, offset: int = 0, limit: int | None = None, key: str | None = None, extra: Sequence | None = None) -> DataFrame:
    """A page of a grid: filters, sort orders ('asc' or 'desc'), offset and limit.

    A filter is a value, or (operator, value) with one of = != > >= < <= in like. ``extra`` are ids (of the
    column ``key``) whose rows come after the page, whatever the filters say, unless they are on it.
    """
    everything = df
    for name, v in (filters or {}).items():
        op, value = v if isinstance(v, tuple) else ("=", v)
        df = df.where(_FILTERS[op](F.col(name), value))
    if sort:
        df = df.orderBy(*[F.col(n).desc_nulls_last() if o == "desc" else F.col(n).asc_nulls_first() for n, o in sort.items()])
    if offset:
        df = df.offset(offset)
    if limit is not None:
        df = df.limit(limit)
    if not extra:
        return df.select(*fields)
    asked = everything.where(F.col(key).isin(list(extra)))
    return df.select(*fields).unionByName(asked.join(df.select(key), key, "left_anti").select(*fields))

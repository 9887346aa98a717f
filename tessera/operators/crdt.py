"""Conflict-free replicated state: types as column layouts with merge aggregates, and a keyed store.

A type names the columns that identify a part of the state (a node of a counter, an element of a
set) and how parts merge; merging any number of replicas is one grouped aggregation, which
Spark combines before the shuffle. Values are read by a second aggregation per key.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.changefeed import PublishedTable
from tessera.operators.dataset import rendezvous
from tessera.session import cut, discard, hadoop_fs
from tessera.versions import delete, move_new


@dataclass(frozen=True)
class CrdtType:
    """``part`` columns within a key; ``merges`` of the other columns; ``value`` per key; ``present`` for set members."""

    part: tuple
    merges: Mapping[str, str]
    value: str = ""
    present: str = "true"

    def merge(self, rows: DataFrame, key: Sequence[str]) -> DataFrame:
        """The merged state of all rows: one row per key and part."""
        return rows.groupBy(*key, *self.part).agg(*[F.expr(e).alias(n) for n, e in self.merges.items()])

    def read(self, state: DataFrame, key: Sequence[str], out: str = "value") -> DataFrame:
        """(key, value) of a merged state; keys without present parts are absent for sets and maps."""
        live = state.where(self.present)
        return live.groupBy(*key).agg(F.expr(self.value).alias(out))


#: Counter per node, only growing: node counts merge by max, the value is their sum.
GCOUNTER = CrdtType(("node",), {"n": "max(n)"}, "sum(n)")
#: Two growing counters.
PNCOUNTER = CrdtType(("node",), {"p": "max(p)", "n": "max(n)"}, "sum(p) - sum(n)")
#: Growing set.
GSET = CrdtType(("element",), {"added": "max(added)"}, "array_sort(collect_set(element))")
#: Set whose removed elements never come back; ``added`` and ``removed`` are booleans.
TPSET = CrdtType(("element",), {"added": "max(added)", "removed": "max(removed)"}, "array_sort(collect_set(element))", "added AND NOT coalesce(removed, false)")
#: Set with stamps; an element is in if it was added at or after its last removal.
LWWSET = CrdtType(("element",), {"added": "max(added)", "removed": "max(removed)"}, "array_sort(collect_set(element))", "added >= coalesce(removed, added)")
#: Last writer wins; of equal stamps the greater value, so the merge is commutative.
LWW = CrdtType((), {"latest": "max(struct(ts, obj))"}, "first(latest.obj)")


def lww(rows: DataFrame, key: Sequence[str], ts: str = "ts", obj: str = "obj") -> DataFrame:
    """(key, ts, obj) with the greatest stamp; of equal stamps the greater value."""
    top = F.max(F.struct(F.col(ts).alias("ts"), F.col(obj).alias("obj"))).alias("__top")
    return rows.groupBy(*key).agg(top).select(*key, F.col("__top.ts").alias(ts), F.col("__top.obj").alias(obj))


def gmap(rows: DataFrame, key: Sequence[str], map_key: str, inner: Mapping[str, Column]) -> DataFrame:
    """Map merged key by key: ``inner`` merges the values of a map key."""
    return rows.groupBy(*key, map_key).agg(*[c.alias(n) for n, c in inner.items()])


def with_timestamp(rows: DataFrame, key: Sequence[str], combine: Mapping[str, Column], ts: str = "ts") -> DataFrame:
    """State with a stamp: greatest stamp, state by the combiner."""
    return rows.groupBy(*key).agg(F.max(ts).alias(ts), *[c.alias(n) for n, c in combine.items()])


def extract(rows: DataFrame, since, *stamps: str) -> DataFrame:
    """The delta since a stamp: parts any of whose stamps is newer; 0 or None gives all."""
    if not since:
        return rows
    test = F.lit(False)
    for s in stamps:
        test = test | F.coalesce(F.col(s) > since, F.lit(False))
    return rows.where(test)


def live(rows: DataFrame, key: Sequence[str], merges: Mapping[str, Column], ts: str = "ts", removed: str = "removed") -> DataFrame:
    """Appends and tombstones to live keys: kept only if the last removal is before the last append.

    ``rows`` has a boolean column ``removed``; states of tombstones take no part in the merge.
    """
    aggregated = rows.groupBy(*key).agg(
        F.max(F.when(~F.col(removed), F.col(ts))).alias("__appended"), F.max(F.when(F.col(removed), F.col(ts))).alias("__removed"), *[c.alias(n) for n, c in merges.items()]
    )
    kept = aggregated.where("__appended IS NOT NULL AND (__removed IS NULL OR __removed < __appended)")
    return kept.select(*key, F.col("__appended").alias(ts), *merges)


class CrdtStore:
    """A keyed store: uploads and tombstones are appended, reads merge, consolidation compacts.

    ``merges`` are SQL aggregates over a row's state columns that must ignore NULL, as Spark's do.
    ``keep`` is a filter on merged states.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: Sequence[str], merges: Mapping[str, str], ts: str = "ts", keep: str = "true"):
        self.spark, self.path, self.key, self.merges, self.ts, self.keep = spark, path.rstrip("/"), list(key), dict(merges), ts, keep
        self.schema = f"{schema}, removed boolean"
        self.base = PublishedTable(spark, f"{self.path}/base")

    def _uploads(self) -> list[str]:
        """Names of the uploads that are whole."""
        fs, log = hadoop_fs(self.spark, f"{self.path}/log")
        return sorted(s.getPath().getName() for s in fs.listStatus(log)) if fs.exists(log) else []

    def _rows(self) -> DataFrame:
        """The last base and the uploads that it doesn't hold."""
        return self._of(self.base.versions.latest()[1])

    def _of(self, held: dict | None) -> DataFrame:
        fresh = [n for n in self._uploads() if held is None or n not in held["holds"]]
        parts = [self.spark.read.schema(self.schema).parquet(*[f"{self.path}/log/{n}" for n in fresh])] if fresh else []
        if held is not None:
            parts.append(self.spark.read.schema(self.schema).parquet(f"{self.base.path}/{held['data']}"))
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], self.schema)

    def _append(self, rows: DataFrame) -> None:
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/.staging/{name}")
        move_new(self.spark, f"{self.path}/.staging/{name}", f"{self.path}/log/{name}")  # whole from the moment it is there

    def upload(self, rows: DataFrame) -> None:
        columns = self.spark.createDataFrame([], self.schema).columns
        self._append(rows.withColumn("removed", F.lit(False)).select(*columns))

    def remove(self, keys: DataFrame) -> None:
        """Tombstones: ``keys`` has the key columns and the stamp."""
        typed = self.spark.createDataFrame([], self.schema)
        self._append(keys.withColumn("removed", F.lit(True)).select(*[F.col(f.name) if f.name in (*self.key, self.ts, "removed") else F.lit(None).cast(f.dataType).alias(f.name) for f in typed.schema]))

    def download(self, since=None) -> DataFrame:
        """Live merged states; with a stamp only those changed after it."""
        merged = live(self._rows(), self.key, {n: F.expr(e) for n, e in self.merges.items()}, self.ts).where(self.keep)
        return extract(merged, since, self.ts)

    def consolidate(self) -> None:
        """All states into one table, tombstones dropped.

        The new base names the uploads that it holds, so none is lost or taken twice, whatever is
        uploaded meanwhile. An upload's files are deleted by the consolidation after the one that
        took it in, and so is a base: a reader that began before still finds them. Of two at once one fails.
        """
        number, held = self.base.versions.latest()
        old = held["holds"] if held else []
        there = self._uploads()
        merged = live(self._of(held), self.key, {n: F.expr(e) for n, e in self.merges.items()}, self.ts).where(self.keep)
        self.base.publish(merged.withColumn("removed", F.lit(False)), number, holds=there)
        for name in old:
            delete(self.spark, f"{self.path}/log/{name}")
        if number > 1:
            before = self.base.versions.read(number - 1)
            delete(self.spark, f"{self.base.path}/{before['data']}")


class CrdtCluster:
    """Stores replicated over shards by rendezvous hashing: write to the owners, merge what is read."""

    def __init__(self, stores: Mapping[str, CrdtStore], copies: int = 1):
        self.stores, self.copies = dict(stores), copies

    def _first(self) -> CrdtStore:
        return next(iter(self.stores.values()))

    def owners(self, rows: DataFrame) -> DataFrame:
        return rendezvous(rows, self._first().key[0], list(self.stores), self.copies, out="__owners")

    def upload(self, rows: DataFrame) -> None:
        placed = self.owners(rows)
        for name, store in self.stores.items():
            store.upload(placed.where(F.array_contains("__owners", name)).drop("__owners"))

    def remove(self, keys: DataFrame) -> None:
        for store in self.stores.values():
            store.remove(keys)

    def download(self, since=None, alive: Sequence[str] | None = None) -> DataFrame:
        parts = [s.download().withColumn("removed", F.lit(False)) for n, s in self.stores.items() if alive is None or n in alive]
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        one = self._first()
        merged = live(rows, one.key, {n: F.expr(e) for n, e in one.merges.items()}, one.ts).where(one.keep)
        return extract(merged, since, one.ts)

    def repartition(self, name: str) -> None:
        """Hands the states of one shard to their owners and drops from it what it doesn't own."""
        store = self.stores[name]
        placed = cut(self.owners(store.download()), "owners")
        for other, s in self.stores.items():
            if other != name:
                s.upload(placed.where(F.array_contains("__owners", other)).drop("__owners"))
        store.remove(placed.where(~F.array_contains("__owners", name)).select(*store.key, store.ts))
        discard(placed)

"""Keyed pre-aggregations: sorted Parquet chunks under a manifest, merged on read and by consolidation.

An aggregation has keys, measures and a predicate. Ingest groups rows to measure states and
writes them, sorted by key, as chunk files; the manifest holds each chunk's file, row count,
measures and least and greatest key. A query prunes chunks by key range and by measures, then
filters, groups and merges. Because all measures are mergeable, chunks may overlap freely and
late rows simply merge; consolidation rewrites chosen chunks into fewer, disjoint ones.

The manifest (``manifest.py``) is metadata, a row per chunk file. Several aggregations may share
one, as a cube's do; then what is written to them shows together.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.measures import Measure, merged
from tessera.operators import chunks as ch
from tessera.operators.chunks import Chunk, ChunkDiff, CubeDiff, RangeTree  # noqa: F401
from tessera.operators.manifest import Manifest, single
from tessera.plans.predicates import FALSE, TRUE, And, Constraint, Leaf, Predicate
from tessera.session import hadoop_fs


@dataclass(frozen=True)
class Structure:
    """Keys in order with their types, measures, the predicate of the rows held, how many of the first keys
    a chunk may hold only one value of, and measures no more offered."""

    keys: Mapping[str, str]
    measures: Mapping[str, Measure]
    predicate: Predicate = TRUE
    partition_keys: tuple = ()
    ignored: frozenset = frozenset()

    def __post_init__(self) -> None:
        if tuple(self.partition_keys) != tuple(self.keys)[: len(self.partition_keys)]:
            raise ValueError("partition keys are the first keys, in order")

    def ddl(self, measures: Iterable[str]) -> str:
        return ", ".join([f"`{k}` {t}" for k, t in self.keys.items()] + [f"`{m}` {self.measures[m].state_type}" for m in measures])

    def offered(self) -> set[str]:
        return set(self.measures) - self.ignored


def key_range(predicate: Predicate, keys: Sequence[str]) -> tuple[tuple, tuple]:
    """(lower, upper) bounds of key prefixes: equalities along the keys, then one dimension with bounds or a list."""
    parts = predicate.parts if isinstance(predicate, And) else (predicate,)
    fixed: tuple = ()
    for k in keys:
        own = [p for p in parts if isinstance(p, Leaf) and p.dim == k and p.op in ("eq", "in", "between", "ge", "gt", "le", "lt")]
        c = Constraint.of(own)
        least, most = (min(c.values), max(c.values)) if c.values else (c.low, c.high)
        plain = lambda v: v.isoformat() if hasattr(v, "isoformat") else v
        least, most = plain(least), plain(most)
        if least is None or least != most:
            return fixed + ((least,) if least is not None else ()), fixed + ((most,) if most is not None else ())
        fixed += (least,)
    return fixed, fixed


def _plain(values: Iterable) -> tuple:
    return tuple(v.isoformat() if hasattr(v, "isoformat") else v for v in values)


#: The column that tells the aggregations of one write apart.
TARGET = "__target"


class Aggregation:
    """One pre-aggregation below ``path``; without a shared ``manifest`` it has its own."""

    def __init__(self, spark: SparkSession, path: str, structure: Structure, max_rows_per_chunk: int = 1_000_000, manifest: Manifest | None = None, name: str = "self"):
        self.spark, self.path, self.structure, self.max_rows, self.name = spark, path.rstrip("/"), structure, max_rows_per_chunk, name
        self.manifest = manifest or Manifest(spark, f"{self.path}/manifest")

    # -- manifest -------------------------------------------------------------------------

    def chunks(self) -> list[Chunk]:
        return self.manifest.chunks(self.name)

    def commit(self, diff: ChunkDiff, commit: str | tuple | None = None) -> bool:
        """Applies a diff as the next version; a commit already applied changes nothing and gives False."""
        return self.manifest.commit(single(self.name, diff), commit)

    # -- ingest ---------------------------------------------------------------------------

    def ingest_states(self, rows: DataFrame, inputs: Mapping[str, str | None]) -> DataFrame:
        """Rows grouped to one state per key; ``inputs`` maps measures to columns (None: no column)."""
        kept = rows.where(self.structure.predicate.simplify().column())
        for k in self.structure.keys:
            kept = kept.where(F.col(k).isNotNull())
        aggs = [self.structure.measures[m].ingest(None if c is None else F.col(c)).alias(m) for m, c in inputs.items() if m in self.structure.measures]
        return kept.groupBy(*[F.col(k).cast(t).alias(k) for k, t in self.structure.keys.items()]).agg(*aggs)

    def write(self, states: DataFrame, measures: Sequence[str], partitions: int | None = None) -> ChunkDiff:
        """Writes states as chunks, sorted by key over ranges; nothing shows before the diff is committed."""
        keys = list(self.structure.keys)
        folder = f"{self.path}/data/{uuid.uuid4().hex[:16]}"
        ranged = states.repartitionByRange(partitions, *keys) if partitions else states.repartitionByRange(*keys)
        sorted_rows = ranged.select(*keys, *measures).sortWithinPartitions(*keys)
        apart = [f"__p_{k}" for k in self.structure.partition_keys]
        for k, column in zip(self.structure.partition_keys, apart):  # a file ends where one of them changes
            sorted_rows = sorted_rows.withColumn(column, F.col(k))
        writer = sorted_rows.write.option("maxRecordsPerFile", self.max_rows)
        (writer.partitionBy(*apart) if apart else writer).parquet(folder)
        written = self.spark.read.schema(self.structure.ddl(measures)).option("recursiveFileLookup", "true").parquet(folder)
        per_file = written.groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("rows"), F.min(F.struct(*keys)).alias("low"), F.max(F.struct(*keys)).alias("high"))
        return ChunkDiff(frozenset(Chunk(r["file"], r["rows"], tuple(measures), _plain(r["low"]), _plain(r["high"]), folder) for r in per_file.collect()))

    def prepare(self, rows: DataFrame, inputs: Mapping[str, str | None]) -> ChunkDiff:
        """Writes the states of rows; the diff that would show them."""
        return self.write(self.ingest_states(rows, inputs), [m for m in inputs if m in self.structure.measures])

    def consume(self, rows: DataFrame, inputs: Mapping[str, str | None], commit: str | tuple | None = None) -> ChunkDiff:
        """Ingests rows and commits the chunks; with ``commit`` a repeated batch is taken once."""
        if commit is not None and self.manifest.sync().has(commit):
            return ChunkDiff()
        diff = self.prepare(rows, inputs)
        if self.commit(diff, commit):
            return diff
        discard(self.spark, single(self.name, diff))
        return ChunkDiff()

    # -- query ----------------------------------------------------------------------------

    def find_chunks(self, predicate: Predicate, measures: Iterable[str]) -> list[Chunk]:
        """Chunks that may hold rows of the predicate and have one of the measures."""
        wanted, p = set(measures), predicate.simplify()
        if p == FALSE:
            return []
        low, high = ((), ()) if p == TRUE else key_range(p, list(self.structure.keys))
        return [c for c in self.manifest.index(self.name).get_prefix(low, high) if wanted & set(c.measures)]

    def cost(self, predicate: Predicate, measures: Iterable[str]) -> int:
        """The number of chunks that a query would read."""
        return len(self.find_chunks(predicate, measures))

    def states(self, chunks: Sequence[Chunk], measures: Sequence[str]) -> DataFrame:
        """All rows of chunks, NULL where a chunk lacks a measure: one scan per set of measures."""
        by: dict[tuple, list[str]] = {}
        for c in chunks:
            by.setdefault(tuple(m for m in measures if m in c.measures), []).append(c.file)
        parts = []
        for held, files in by.items():
            df = self.spark.read.schema(self.structure.ddl(held)).parquet(*files)
            parts.append(df.select(*self.structure.keys, *[F.col(m) if m in held else F.lit(None).cast(self.structure.measures[m].state_type).alias(m) for m in measures]))
        if not parts:
            return self.spark.createDataFrame([], self.structure.ddl(measures))
        return reduce(DataFrame.unionByName, parts)

    def query(self, keys: Sequence[str], measures: Sequence[str], predicate: Predicate = TRUE, finish: bool = True) -> DataFrame:
        """Rows of any subset of keys, filtered, with merged measures; ``finish`` turns states to values."""
        offered = [m for m in measures if m in self.structure.offered()]
        p = predicate.simplify()
        chunks = self.find_chunks(p, offered)
        rows = self.states(chunks, offered).where(p.column(F.col, [*self.structure.keys, *offered]))
        # chunks hold each key once: all keys of chunks that don't overlap are merged already
        once = offered and set(keys) == set(self.structure.keys) and ch.overlap(chunks) <= 1
        out = rows.select(*keys, *offered) if once else merged(rows, keys, {m: self.structure.measures[m] for m in offered})
        return out.select(*keys, *[self.structure.measures[m].finish(F.col(m)).alias(m) for m in offered]) if finish else out

    # -- consolidation --------------------------------------------------------------------

    def pick_min_key(self, max_chunks: int = 1000, target_rows: int | None = None) -> list[Chunk]:
        """What to consolidate at the least key: chunks over several partitions, overlaps, or a wrong size."""
        return ch.pick_min_key(self.chunks(), max_chunks, target_rows or self.max_rows, len(self.structure.partition_keys))[1]

    def pick_hot_segment(self, max_chunks: int = 1000) -> list[Chunk]:
        """The chunks at the key that most chunks cover, with what they overlap as far as ``max_chunks`` goes."""
        return ch.pick_hot_segment(self.chunks(), max_chunks)[1]

    def prepare_consolidation(self, picked: Sequence[Chunk]) -> ChunkDiff:
        """Merges chosen chunks into fewer ones; the diff that would exchange them."""
        if not picked:
            return ChunkDiff()
        measures = [m for m in self.structure.measures if m not in self.structure.ignored and any(m in c.measures for c in picked)]
        rows = sum(c.rows for c in picked)
        states = merged(self.states(picked, measures), list(self.structure.keys), {m: self.structure.measures[m] for m in measures})
        return replace(self.write(states, measures, max(1, -(-rows // self.max_rows))), removed=frozenset(picked))

    def consolidate(self, picked: Sequence[Chunk]) -> ChunkDiff:
        """Merges chosen chunks into fewer ones and commits the exchange."""
        diff = self.prepare_consolidation(picked)
        if not diff.empty():
            try:
                self.commit(diff)
            except Exception:
                discard(self.spark, single(self.name, diff))
                raise
        return diff

    def overlap(self) -> int:
        """The most chunks at one key: how much a query has to merge."""
        return ch.overlap(self.chunks())

    # -- housekeeping ---------------------------------------------------------------------

    def cleanup(self, freeze_seconds: float = 3600.0, delay_seconds: float = 60.0, extra_snapshots: int = 1) -> list[str]:
        """Deletes what no kept version needs (``Manifest.clean``); for an aggregation with a manifest of its own."""
        return self.manifest.clean([f"{self.path}/data"], freeze_seconds, delay_seconds, extra_snapshots)

    def missing_files(self) -> list[str]:
        """Chunks of the manifest whose files aren't there."""
        out = []
        for c in self.chunks():
            fs, p = hadoop_fs(self.spark, c.file)
            if not fs.exists(p):
                out.append(c.file)
        return out

    def copy_to(self, other: Aggregation) -> ChunkDiff:
        """The present chunks written to another aggregation of the same structure; the diff to commit there."""
        by: dict[tuple, list[Chunk]] = {}
        for c in self.chunks():
            by.setdefault(c.measures, []).append(c)
        added: set[Chunk] = set()
        for measures, chunks in by.items():
            added |= other.write(self.states(chunks, list(measures)), list(measures)).added
        return ChunkDiff(frozenset(added))

    def backup(self, path: str) -> Aggregation:
        """A copy of the present state at ``path``."""
        other = Aggregation(self.spark, path, self.structure, self.max_rows)
        other.commit(self.copy_to(other))
        return other


def discard(spark: SparkSession, diff: CubeDiff) -> None:
    """Deletes chunks that were written and will never show."""
    for c in diff.added():
        fs, p = hadoop_fs(spark, c.file)
        fs.delete(p, False)


# -- several aggregations from one pass ---------------------------------------------------------


def common_order(orders: Iterable[Sequence[str]]) -> list[str] | None:
    """An order of all keys that agrees with each of ``orders``; None if there is none."""
    graph: dict[str, set] = {}
    for keys in orders:
        for i, k in enumerate(keys):
            graph.setdefault(k, set()).update(keys[i - 1 : i] if i else ())
    try:
        return list(TopologicalSorter(graph).static_order())
    except CycleError:
        return None


def prepare_all(rows: DataFrame, targets: Mapping[str, tuple[Aggregation, Mapping[str, str | None]]], path: str) -> CubeDiff:
    """Writes the states of rows for several aggregations, each with its inputs, in one pass.

    A row becomes one row per aggregation that takes it, with that one's keys and inputs; one
    aggregation before the shuffle and one after it make the states of all of them, one job writes the chunks and
    one reads their key ranges. What one aggregation has and another lacks is NULL and costs next to nothing.
    Aggregations of contrary key orders, and those whose chunks end with a partition, are written by themselves.
    """
    names = [n for n, (a, _) in targets.items() if not a.structure.partition_keys]
    order = common_order([list(targets[n][0].structure.keys) for n in names])
    if order is None or len(names) < 2:
        return CubeDiff({n: a.prepare(rows, inputs) for n, (a, inputs) in targets.items()})
    spark = rows.sparkSession
    alone = {n: a.prepare(rows, inputs) for n, (a, inputs) in targets.items() if n not in names}
    types = {k: t for n in names for k, t in targets[n][0].structure.keys.items()}
    columns = {m: c for n in names for m, c in targets[n][1].items() if m in targets[n][0].structure.measures}
    held = {m: [i for i, n in enumerate(names) if m in targets[n][1] and m in targets[n][0].structure.measures] for m in columns}
    measure = {m: targets[names[held[m][0]]][0].structure.measures[m] for m in columns}

    def taken(i: int) -> Column:
        s = targets[names[i]][0].structure
        test = s.predicate.simplify().column()
        for k in s.keys:
            test = test & F.col(k).isNotNull()
        own = [(F.col(k).cast(t) if k in s.keys else F.lit(None).cast(t)).alias(k) for k, t in types.items()]
        return F.when(test, F.struct(F.lit(i).alias(TARGET), *own))

    def value(m: str) -> Column | None:
        if columns[m] is None or len(held[m]) == len(names):
            return None if columns[m] is None else F.col(columns[m])
        return F.when(F.col(TARGET).isin(held[m]), F.col(columns[m]))

    inputs = sorted({c for c in columns.values() if c is not None})
    spread = rows.select(F.explode(F.array_compact(F.array(*[taken(i) for i in range(len(names))]))).alias("__t"), *[F.col(c).alias(f"__v_{c}") for c in inputs])
    spread = spread.select("__t.*", *[F.col(f"__v_{c}").alias(c) for c in inputs])
    states = spread.groupBy(TARGET, *order).agg(*[measure[m].ingest(value(m)).alias(m) for m in columns])
    folder = f"{path.rstrip('/')}/data/{uuid.uuid4().hex[:16]}"
    ranged = states.repartitionByRange(TARGET, *order).sortWithinPartitions(TARGET, *order)
    ranged.write.option("maxRecordsPerFile", min(targets[n][0].max_rows for n in names)).partitionBy(TARGET).parquet(folder)
    ddl = ", ".join(f"`{k}` {t}" for k, t in types.items())
    written = spark.read.schema(f"{ddl}, `{TARGET}` int").parquet(folder)
    keys = lambda n: F.struct(*targets[n][0].structure.keys)
    bounds = [c for i, n in enumerate(names) for c in (F.min(keys(n)).alias(f"low{i}"), F.max(keys(n)).alias(f"high{i}"))]
    found: dict[str, set] = {n: set() for n in names}
    for r in written.groupBy(F.input_file_name().alias("file"), TARGET).agg(F.count("*").alias("rows"), *bounds).collect():
        i = r[TARGET]
        own = tuple(m for m in targets[names[i]][1] if m in targets[names[i]][0].structure.measures)
        found[names[i]].add(Chunk(r["file"], r["rows"], own, _plain(r[f"low{i}"]), _plain(r[f"high{i}"]), folder))
    return CubeDiff(alone | {n: ChunkDiff(frozenset(cs)) for n, cs in found.items()})

"""OLAP cube: many pre-aggregations behind one query, which is routed to the best of them.

Planning is Python over metadata (predicates, keys, chunk counts); what runs is one DataFrame
plan: scan of the chosen chunks, filter, merge, computed measures, attribute lookups, HAVING,
order and page. Nothing is collected while planning.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.computed import Computed, stored_needs, with_computed
from tessera.functions.fields import FieldType
from tessera.functions.measures import Measure, merged
from tessera.operators.aggregation import Aggregation, Structure, discard, prepare_all
from tessera.operators.chunks import CubeDiff
from tessera.operators.manifest import Conflict, Manifest
from tessera.plans.predicates import FALSE, TRUE, And, Predicate, from_json, implies
from tessera.session import estimated_bytes

METADATA, DATA, DATA_WITH_TOTALS = "METADATA", "DATA", "DATA_WITH_TOTALS"


class QueryError(ValueError):
    """A query that the cube can't answer."""


@dataclass(frozen=True)
class CubeQuery:
    attributes: tuple = ()
    measures: tuple = ()
    where: Predicate = TRUE
    having: Predicate = TRUE
    order: tuple = ()  # (field, 'asc' | 'desc')
    limit: int | None = None
    offset: int = 0
    report: str = DATA_WITH_TOTALS

    def to_params(self) -> dict[str, str]:
        """The report parameters that ``parse_query`` reads."""
        out = {"attributes": json.dumps(self.attributes), "measures": json.dumps(self.measures), "offset": str(self.offset), "reportType": self.report}
        for key, p in (("where", self.where), ("having", self.having)):
            if p != TRUE:
                out[key] = json.dumps(p.json(), default=str)
        if self.order:
            out["sort"] = json.dumps([f"{name}:{way.upper()}" for name, way in self.order])
        return out | ({} if self.limit is None else {"limit": str(self.limit)})


def parse_query(params: Mapping[str, Any]) -> CubeQuery:
    """From report parameters: attributes, measures, where, having, sort, limit, offset, reportType (JSON or comma lists)."""

    def names(key: str) -> tuple:
        v = params.get(key, ())
        if isinstance(v, str):
            v = json.loads(v) if v.startswith("[") else [x for x in v.split(",") if x]
        return tuple(v)

    def predicate(key: str) -> Predicate:
        v = params.get(key)
        return TRUE if not v else from_json(json.loads(v) if isinstance(v, str) else v)

    order = []
    for s in names("sort"):
        name, _, way = s.partition(":")
        order.append((name, way.strip().lower() or "asc"))
    limit = params.get("limit")
    return CubeQuery(names("attributes"), names("measures"), predicate("where"), predicate("having"), tuple(order), None if limit is None else int(limit), int(params.get("offset", 0)), params.get("reportType", DATA_WITH_TOTALS))


class AttributeResolver(Protocol):
    """Attributes of a dimension path: a DataFrame with the path's columns and the attributes."""

    def table(self) -> DataFrame: ...


@dataclass
class StaticAttributes:
    df: DataFrame

    def table(self) -> DataFrame:
        return self.df


#: The largest dictionary that is kept in memory and on the executors' disks; larger ones are read each time.
CACHED_BYTES = 256 << 20


class ReloadingAttributes:
    """Reads the dictionary anew when ``seconds`` have passed since it was read."""

    def __init__(self, load: Callable[[], DataFrame], seconds: float, clock: Callable[[], float] | None = None):
        self.load, self.seconds, self.clock = load, seconds, clock or time.monotonic
        self._df: DataFrame | None = None
        self._at = 0.0

    def table(self) -> DataFrame:
        if self._df is None or self.clock() - self._at >= self.seconds:
            old, new = self._df, self.load()
            self._df, self._at = new.cache() if estimated_bytes(new) <= CACHED_BYTES else new, self.clock()
            if old is not None:
                old.unpersist()
        return self._df


@dataclass
class QueryResult:
    """Rows and totals as lazy frames, with what the report says about them."""

    attributes: list[str]
    measures: list[str]
    sorted_by: list[str]
    rows: DataFrame | None = None
    totals: DataFrame | None = None
    filtered: DataFrame | None = None  # all rows after HAVING, before the page
    filter_attributes: dict = field(default_factory=dict)
    report: str = DATA_WITH_TOTALS
    aggregations: list[str] = field(default_factory=list)

    def total_count(self) -> int:
        return self.filtered.count() if self.filtered is not None else 0

    def to_json(self) -> str:
        """The report: metadata, and with data the records of the page, the totals and the count."""
        out: dict = {"attributes": self.attributes, "measures": self.measures, "sortedBy": self.sorted_by, "filterAttributes": self.filter_attributes}
        if self.rows is not None:
            out["records"] = [json.loads(r) for r in self.rows.toJSON().collect()]  # one page
            out["totalCount"] = self.total_count()
        if self.totals is not None:
            out["totals"] = json.loads(self.totals.toJSON().first())
        return json.dumps(out)


class Cube:
    """Dimensions, measures, computed measures, parents, attributes and aggregations."""

    def __init__(self, spark: SparkSession, path: str, dimensions: Mapping[str, str | FieldType], measures: Mapping[str, Measure], computed: Mapping[str, Computed] | None = None, parents: Mapping[str, str] | None = None):
        """``dimensions`` have a Spark type each, or a ``FieldType`` that stores them otherwise than they are shown."""
        self.spark, self.path = spark, path.rstrip("/")
        self.fields = {d: t for d, t in dimensions.items() if isinstance(t, FieldType)}
        self.dimensions, self.measures = {d: t.state if isinstance(t, FieldType) else t for d, t in dimensions.items()}, dict(measures)
        self.computed, self.parents = dict(computed or {}), dict(parents or {})
        self.attributes: dict[str, tuple[tuple, AttributeResolver]] = {}
        self.aggregations: dict[str, Aggregation] = {}
        self.manifest = Manifest(spark, f"{self.path}/manifest")  # one for all: loads and consolidations show whole

    # -- definition -----------------------------------------------------------------------

    def with_aggregation(self, name: str, dimensions: Sequence[str], measures: Sequence[str], predicate: Predicate = TRUE, ignored: Sequence[str] = (), max_rows_per_chunk: int = 1_000_000, partition_keys: Sequence[str] = ()) -> Cube:
        s = Structure({d: self.dimensions[d] for d in dimensions}, {m: self.measures[m] for m in measures}, self._stored(predicate), tuple(partition_keys), frozenset(ignored))
        self.aggregations[name] = Aggregation(self.spark, f"{self.path}/{name}", s, max_rows_per_chunk, self.manifest, name)
        return self

    def with_attributes(self, dimension: str, resolver: AttributeResolver, names: Sequence[str]) -> Cube:
        """Attributes ``dimension.name`` looked up by the dimension and its parents."""
        for n in names:
            self.attributes[f"{dimension}.{n}"] = (tuple(self.chain(dimension)), resolver)
        return self

    def _stored(self, predicate: Predicate) -> Predicate:
        """A predicate on shown values as one on stored values."""
        return predicate.converted(lambda d, v: self.fields[d].literal(v) if d in self.fields else v).simplify()

    def _shown(self, df: DataFrame, keys: Sequence[str]) -> DataFrame:
        return df.withColumns({d: self.fields[d].to_value(F.col(d)) for d in keys if d in self.fields})

    def chain(self, dimension: str) -> list[str]:
        """The dimension with its parents, outermost first."""
        out = [dimension]
        while out[0] in self.parents:
            out.insert(0, self.parents[out[0]])
        return out

    # -- ingest ---------------------------------------------------------------------------

    def prepare(self, rows: DataFrame, dimensions: Mapping[str, str], measures: Mapping[str, str | None], data: Predicate = TRUE) -> CubeDiff:
        """Writes the chunks of every aggregation that the input can fill, in one pass; the diff that would show them.

        ``dimensions`` and ``measures`` map names of the cube to columns. ``data`` describes the
        input and only rules aggregations out; an aggregation's own predicate filters its rows.
        """
        data = self._stored(data)
        named = rows.select(*[(self.fields[d].to_state(F.col(c)) if d in self.fields else F.col(c)).alias(d) for d, c in dimensions.items()], *[F.col(c).alias(f"__in_{m}") for m, c in measures.items() if c is not None])
        targets = {}
        for name, a in self.aggregations.items():
            inputs = {m: None if c is None else f"__in_{m}" for m, c in measures.items() if m in a.structure.offered()}
            if set(a.structure.keys) <= set(dimensions) and inputs and And((a.structure.predicate, data)).simplify() != FALSE:
                targets[name] = (a, inputs)
        return prepare_all(named, targets, self.path)

    def commit(self, diff: CubeDiff, commit: str | tuple | None = None, positions: Mapping[str, tuple] | None = None) -> bool:
        """Shows a diff, with moves of log positions; False, and its files are deleted, if ``commit`` was applied before or it conflicts (which is raised)."""
        try:
            done = self.manifest.commit(diff, commit, positions)
        except Exception:
            discard(self.spark, diff)
            raise
        if not done:
            discard(self.spark, diff)
        return done

    def consume(self, rows: DataFrame, dimensions: Mapping[str, str], measures: Mapping[str, str | None], data: Predicate = TRUE, commit: str | tuple | None = None) -> list[str]:
        """Feeds every aggregation that the input can fill, all in one commit; returns their names.

        ``commit`` is a name, or (source, number) with rising numbers: what was applied isn't taken again.
        """
        if commit is not None and self.manifest.sync().has(commit):
            return []
        diff = self.prepare(rows, dimensions, measures, data)
        return [n for n in self.aggregations if n in diff.parts] if self.commit(diff, commit) else []

    # -- planning -------------------------------------------------------------------------

    def compatible(self, dimensions: set[str], measures: set[str], where: Predicate) -> list[str]:
        """Aggregations with all the keys, some of the measures, and all the rows that the query wants."""
        out = []
        for name, a in self.aggregations.items():
            offered = set(a.structure.measures) - a.structure.ignored
            if dimensions | where.dimensions() <= set(a.structure.keys) and offered & measures and implies(where, a.structure.predicate):
                out.append(name)
        return out

    def route(self, dimensions: set[str], measures: set[str], where: Predicate) -> list[tuple[str, list[str]]]:
        """Aggregations to read, each with the measures it supplies: most measures, then fewest chunks, then fewest keys."""

        def rank(name: str) -> tuple:
            a = self.aggregations[name]
            offered = set(a.structure.measures) - a.structure.ignored
            return (-len(offered & measures), a.cost(where, measures), len(a.chunks()), len(a.structure.keys), name)

        left, plan = set(measures), []
        for name in sorted(self.compatible(dimensions, measures, where), key=rank):
            a = self.aggregations[name]
            takes = sorted((set(a.structure.measures) - a.structure.ignored) & left)
            if takes:
                plan.append((name, takes))
                left -= set(takes)
        return plan

    def states(self, dimensions: Sequence[str], plan: Sequence[tuple[str, list[str]]], where: Predicate) -> DataFrame:
        """Merged states by dimensions: each aggregation is grouped by itself, several are stitched by key."""
        parts = [self.aggregations[n].query(dimensions, takes, where, finish=False) for n, takes in plan]
        if len(parts) == 1:
            return parts[0]
        every = [m for _, takes in plan for m in takes]
        wide = [p.select(*dimensions, *[F.col(m) if m in takes else F.lit(None).cast(self.measures[m].state_type).alias(m) for m in every]) for p, (_, takes) in zip(parts, plan)]
        out = wide[0]
        for w in wide[1:]:
            out = out.unionByName(w)
        # of each measure one row per key is not NULL
        return out.groupBy(*dimensions).agg(*[F.first(m, ignorenulls=True).alias(m) for m in every])

    def raw(self, dimensions: Sequence[str], measures: Sequence[str], where: Predicate = TRUE) -> DataFrame:
        """Grouped rows of stored measures, neither sorted nor limited; measures that no aggregation offers are left out, and without any there are no rows."""
        where = self._stored(where)
        with self.manifest.pinned():
            plan = self.route(set(dimensions), set(measures), where)
            if not plan:
                return self._shown(self.spark.createDataFrame([], ", ".join(f"`{d}` {self.dimensions[d]}" for d in dimensions)), dimensions)
            got = [m for _, takes in plan for m in takes]
            return self._shown(self._finish(self.states(list(dimensions), plan, where), list(dimensions), got), dimensions)

    def _finish(self, states: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
        return states.select(*keys, *[self.measures[m].finish(F.col(m)).alias(m) for m in measures])

    # -- query ----------------------------------------------------------------------------

    def query(self, q: CubeQuery) -> QueryResult:
        """The result of a query, planned from one version of all aggregations."""
        with self.manifest.pinned():
            return self._query(q)

    def _query(self, q: CubeQuery) -> QueryResult:
        where, having = self._stored(q.where), q.having.simplify()
        keys: list[str] = []
        for a in q.attributes:
            if a not in self.dimensions and a not in self.attributes:
                raise QueryError(f"unknown attribute {a}")
            for d in self.chain(a) if a in self.dimensions else self.attributes[a][0]:
                if d not in keys:
                    keys.append(d)
        for d in where.dimensions():
            if d not in self.dimensions:
                raise QueryError(f"unknown dimension {d}")

        offered: set[str] = set()
        for name in self.aggregations:
            a = self.aggregations[name].structure
            if set(keys) | where.dimensions() <= set(a.keys) and implies(where, a.predicate):
                offered |= set(a.measures) - a.ignored
        measures = [m for m in q.measures if (m in self.measures or m in self.computed) and stored_needs([m], self.computed) <= offered]
        extra = [m for m in sorted(having.dimensions() | {o for o, _ in q.order}) if m in self.computed or m in self.measures]
        usable = [m for m in extra if m not in measures and stored_needs([m], self.computed) <= offered]
        stored = sorted(stored_needs([*measures, *usable], self.computed))
        shown = [a for a in q.attributes]
        sorted_by = [f for f, _ in q.order if f in keys or f in self.attributes or f in measures or f in usable]
        if q.report == METADATA:
            return QueryResult(shown, measures, sorted_by, report=q.report)

        if stored:
            plan = self.route(set(keys), set(stored), where)
            states = self.states(keys, plan, where)
        else:
            plan, states = [], self._keys_only(keys, where)
        finished = with_computed(self._shown(self._finish(states, keys, stored), keys), [*measures, *usable], self.computed)
        looked_up = finished
        wanted_attributes = [a for a in self.attributes if a in q.attributes or a in having.dimensions() or any(a == f for f, _ in q.order)]
        for a in wanted_attributes:
            path, resolver = self.attributes[a]
            if not set(path) <= set(keys):
                raise QueryError(f"{a} needs the dimensions {', '.join(path)}")
            looked_up = looked_up.join(resolver.table().select(*path, F.col(a.rpartition(".")[2]).alias(a)).dropDuplicates(list(path)), list(path), "left")
        name = lambda n: F.col(f"`{n}`")
        filtered = looked_up.where(having.column(name, looked_up.columns))
        page = filtered
        order = [name(f).desc_nulls_last() if way == "desc" else name(f).asc_nulls_first() for f, way in q.order if f in sorted_by]
        if order:
            page = page.orderBy(*order)
        if q.offset:
            page = page.offset(q.offset)
        if q.limit is not None:
            page = page.limit(q.limit)
        totals = None
        if q.report == DATA_WITH_TOTALS:
            grand = merged(states, [], {m: self.measures[m] for m in stored}) if stored else self.spark.range(1).select()
            totals = with_computed(self._finish(grand, [], stored), measures, self.computed).select(*measures)
        pinned = q.where.simplify().pinned()
        filter_attributes = {}
        for a, (path, resolver) in self.attributes.items():
            if set(path) <= set(pinned):
                hit = resolver.table()
                for d in path:
                    hit = hit.where(F.col(d).eqNullSafe(F.lit(pinned[d])))
                row = hit.select(F.col(a.rpartition(".")[2])).head()
                filter_attributes[a] = row[0] if row else None
        columns: list[Column] = [name(c) for c in dict.fromkeys([*keys, *shown, *measures])]
        return QueryResult(shown, measures, sorted_by, page.select(*columns), totals, filtered.select(*columns), filter_attributes, q.report, [n for n, _ in plan])

    def _keys_only(self, keys: Sequence[str], where: Predicate) -> DataFrame:
        for name in sorted(self.aggregations, key=lambda n: len(self.aggregations[n].structure.keys)):
            a = self.aggregations[name]
            if set(keys) | where.dimensions() <= set(a.structure.keys) and implies(where, a.structure.predicate):
                return a.states(a.find_chunks(where, a.structure.measures), []).where(where.column()).select(*keys).distinct()
        raise QueryError("no aggregation has these attributes")

    # -- service --------------------------------------------------------------------------

    def consolidate(self, strategy: str = "min_key", max_chunks: int = 1000) -> dict[str, int]:
        """One consolidation of every aggregation ('min_key' or 'hot_segment'), shown in one commit; the number of chunks merged."""
        with self.manifest.pinned():
            picked = {n: a.pick_hot_segment(max_chunks) if strategy == "hot_segment" else a.pick_min_key(max_chunks) for n, a in self.aggregations.items()}
        diff = CubeDiff({n: self.aggregations[n].prepare_consolidation(chunks) for n, chunks in picked.items() if chunks})
        if not diff.empty():
            self.commit(diff)
        return {n: len(chunks) for n, chunks in picked.items()}

    def too_many_overlaps(self, limit: int = 300) -> bool:
        """Whether ingest should wait for consolidation."""
        with self.manifest.pinned():
            return any(a.overlap() > limit for a in self.aggregations.values())

    def cleanup(self, freeze_seconds: float = 3600.0, delay_seconds: float = 60.0, extra_snapshots: int = 1) -> list[str]:
        """Deletes the chunks that no kept version needs (``Manifest.clean``)."""
        return self.manifest.clean([f"{self.path}/data", *[f"{a.path}/data" for a in self.aggregations.values()]], freeze_seconds, delay_seconds, extra_snapshots)

    def backup(self, path: str) -> Cube:
        """A copy of the present state at ``path``, all of it from one version."""
        other = Cube(self.spark, path, self.dimensions | self.fields, self.measures, self.computed, self.parents)
        other.attributes = self.attributes
        for n, a in self.aggregations.items():
            other.aggregations[n] = Aggregation(self.spark, f"{other.path}/{n}", a.structure, a.max_rows, other.manifest, n)
        with self.manifest.pinned():
            diff = CubeDiff({n: a.copy_to(other.aggregations[n]) for n, a in self.aggregations.items()})
        other.commit(diff)
        return other


class ConsolidationController:
    """Alternates the strategies: the hottest keys in one round, the least ones in the next."""

    def __init__(self, cube: Cube, max_chunks: int = 1000):
        self.cube, self.max_chunks, self.hot = cube, max_chunks, False

    def consolidate(self) -> dict[str, int]:
        """One round; what another writer removed meanwhile is left to the next round."""
        self.hot = not self.hot
        try:
            return self.cube.consolidate("hot_segment" if self.hot else "min_key", self.max_chunks)
        except Conflict:
            self.cube.manifest.reset()
            return {}

    def run(self, rounds: int, every: float = 0.0, sleep: Callable[[float], None] = time.sleep) -> list[dict[str, int]]:
        """A schedule of rounds, ``every`` so many seconds."""
        out = []
        for i in range(rounds):
            if i and every:
                sleep(every)
            out.append(self.consolidate())
        return out

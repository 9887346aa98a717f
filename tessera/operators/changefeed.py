"""Problem 2: a feed of inserts, updates and deletes applied in order, by embedded DuckDB upserts.

The feed is cut into buckets by the hash of the whole key, so a hot repository spreads over
all of them. In each bucket an embedded DuckDB holds the state in a table with a primary key
and applies changes with ``INSERT .. ON CONFLICT DO UPDATE .. WHERE`` the incoming sequence is
greater than the stored one. Arrival order and repeats therefore don't matter, and a removal
stays as a tombstone, so that an older addition arriving later can't revive the key.

The same upsert runs twice: over each input partition before the shuffle (a key that holds a
third of all rows leaves at most one state per partition and flush) and over each bucket after
it. The conditional upsert is associative, commutative and idempotent, which makes that right
and makes retried tasks harmless. The state is kept by bucket: an application of changes reads and rewrites only the
buckets that they touch. When the state has grown beyond ``STATE_BYTES`` a bucket, the next application
cuts it into more of them, so a task holds no more however long the feed runs. Bucket results are written by Spark's committer to a staging folder
and become visible together, by one rename and one version (``tessera.versions``) that says
where each bucket lies.

Defined results: a change whose key or first sequence column is NULL has no place and is not
applied; NULL in a later sequence column sorts lowest, below every value; changes equal in key and sequence are
one change; removing an absent key leaves a tombstone only; an empty feed publishes an empty
state. Columns other than key, sequence, operation and payload are not read.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import flatten
from tessera.session import cut, discard, estimated_bytes, hadoop_fs, new_path
from tessera.versions import Stale, Versions, delete, move_new

#: Bytes of input for each bucket, and states that one DuckDB holds before it hands them on.
BUCKET_BYTES = 64 << 20
#: Bytes of Parquet that the states of one bucket take before there are more buckets.
STATE_BYTES = 16 << 20
FLUSH_STATES = 400_000
BATCH_ROWS = 100_000
DUCKDB_MEMORY = "400MB"

_DUCK = {
    T.LongType: "BIGINT", T.IntegerType: "INTEGER", T.ShortType: "SMALLINT", T.ByteType: "TINYINT", T.StringType: "VARCHAR", T.DoubleType: "DOUBLE", T.FloatType: "FLOAT",
    T.BooleanType: "BOOLEAN", T.DateType: "DATE", T.TimestampNTZType: "TIMESTAMP", T.TimestampType: "TIMESTAMPTZ", T.BinaryType: "BLOB",
}


def _upsert_task(schema: T.StructType, key: Sequence[str], seq: Sequence[str], flush: int | None) -> Callable:
    """A mapInArrow function: rows in, the newest state of each key out, tombstones included.

    ``flush`` bounds the states kept (the next stage merges what is handed on early); None
    keeps all keys of the bucket to its end, so each key comes out once.
    """
    names = schema.names
    zero = {f.name: "''" if isinstance(f.dataType, T.StringType) else "0" if isinstance(f.dataType, T.NumericType) else f"CAST('2000-01-01' AS {_DUCK[type(f.dataType)]})" for f in schema if f.name in seq}
    ddl = ", ".join(f'"{f.name}" {_DUCK[type(f.dataType)]}' for f in schema)
    keys, all_cols = ", ".join(f'"{k}"' for k in key), ", ".join(f'"{n}"' for n in names)
    # a NULL of the sequence is a value of its own, below the others
    order = lambda side: "(" + ", ".join(f"""{side}"{s}" IS NOT NULL, coalesce({side}"{s}", {zero[s]})""" for s in seq) + ")"
    changed = ", ".join(f'"{n}" = excluded."{n}"' for n in names if n not in key)
    upsert = f"""
        INSERT INTO state SELECT {all_cols} FROM batch
        QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY {", ".join(f'"{s}" DESC NULLS LAST' for s in seq)}) = 1
        ON CONFLICT ({keys}) DO UPDATE SET {changed} WHERE {order("excluded.")} > {order("state.")}"""

    def run(batches: Iterator) -> Iterator:
        import duckdb
        import pyarrow as pa

        con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": DUCKDB_MEMORY, "temp_directory": ""})

        def do(sql: str) -> list:
            return con.execute(sql).fetchall()  # to its end: an open result blocks the connection

        def create() -> None:
            do(f"CREATE OR REPLACE TABLE state ({ddl}, PRIMARY KEY ({keys}))")

        def apply(waiting: list) -> None:
            con.register("batch", pa.Table.from_batches(waiting))
            do(upsert)
            con.unregister("batch")

        def export() -> Iterator:
            yield from con.sql(f"SELECT {all_cols} FROM state").to_arrow_reader(50_000)

        create()
        waiting: list = []
        for batch in batches:
            waiting.append(batch)
            if sum(b.num_rows for b in waiting) >= BATCH_ROWS:
                apply(waiting)
                waiting = []
                if flush and do("SELECT count(*) FROM state")[0][0] >= flush:
                    yield from export()
                    create()
        if waiting:
            apply(waiting)
        yield from export()
        con.close()

    return run


def _ordered(feed: DataFrame, key: Sequence[str], seq: Sequence[str], live: str, payload: Sequence[str]) -> DataFrame:
    """The columns of the upsert, without rows that have no place."""
    rows = feed.where(F.col(seq[0]).isNotNull())
    for k in key:
        rows = rows.where(F.col(k).isNotNull())
    return rows.select(*key, *seq, live, *payload)


def _default_buckets(feed: DataFrame) -> int:
    """One for each ``BUCKET_BYTES`` of input, the session's shuffle partitions at least."""
    return max(int(feed.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-estimated_bytes(feed) // BUCKET_BYTES))


def _plain(rows: DataFrame) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema])


def upsert(feed: DataFrame, key: Sequence[str], seq: Sequence[str], live: str = "live", payload: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """The newest state of each key of ``feed``, tombstones (``live`` false) included.

    ``seq`` orders the changes of a key, most significant first; NULLs are lowest. Sequence columns
    are whole numbers, texts, dates or timestamps.
    """
    rows = _ordered(feed, key, seq, live, payload)
    schema = _plain(rows)
    partial = rows.mapInArrow(_upsert_task(schema, key, seq, FLUSH_STATES), schema)
    bucket = F.pmod(F.xxhash64(*key), F.lit(buckets or _default_buckets(feed))).cast("int")
    return partial.repartitionById(buckets or _default_buckets(feed), bucket).mapInArrow(_upsert_task(schema, key, seq, None), schema)


def _buckets_for(state_bytes: int) -> int:
    return -(-state_bytes // STATE_BYTES)


class BucketedState:
    """The state that a feed of changes leads to, kept by bucket below ``path`` and published by version."""

    def __init__(self, spark: SparkSession, path: str, key: Sequence[str], seq: Sequence[str], live: str = "live", payload: Sequence[str] = ()):
        self.spark, self.path, self.key, self.seq, self.live, self.payload = spark, path.rstrip("/"), list(key), list(seq), live, list(payload)
        self.versions = Versions(spark, f"{self.path}/versions")

    def _held(self, version: int | None = None) -> tuple[int, dict]:
        """(version, where the buckets lie): the latest version, or the one asked for."""
        number, held = (version, self.versions.read(version)) if version else self.versions.latest()
        return number, held or {"buckets": 0, "schema": None, "parts": {}, "bytes": {}}

    def _read(self, held: dict, buckets: Sequence[str]) -> DataFrame:
        schema = T.StructType.fromJson(held["schema"])
        if not buckets:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{held['parts'][b]}/bucket={b}" for b in buckets])

    def apply(self, feed: DataFrame, buckets: int | None = None) -> int:
        """Applies changes in any order, repeated or not, and publishes the result; the new version.

        ``buckets`` is the number to begin with. Later ones follow the size of the state and of the feed. Of
        two writers of one version one fails and leaves no trace.
        """
        version, held = self._held()
        at_least = _buckets_for(sum(held["bytes"].values()))
        n = max(held["buckets"] or buckets or _default_buckets(feed), at_least)
        rows = _ordered(feed, self.key, self.seq, self.live, self.payload)
        schema = _plain(rows)
        bucket = F.pmod(F.xxhash64(*self.key), F.lit(n)).cast("int")
        changes = rows.mapInArrow(_upsert_task(schema, self.key, self.seq, FLUSH_STATES), schema)
        kept, waiting = held["parts"], None
        if held["parts"]:
            changes = waiting = cut(changes, "changes")
            if n != held["buckets"]:  # cut anew: all states move
                touched, kept = set(held["parts"]), {}
            else:
                touched = {str(r[0]) for r in changes.select(bucket).distinct().collect()} & held["parts"].keys()  # numbers of buckets
            changes = changes.unionByName(self._read(held, sorted(touched)))
        result = changes.repartitionById(n, bucket).mapInArrow(_upsert_task(schema, self.key, self.seq, None), schema)
        name = uuid.uuid4().hex[:16]
        staging = f"{self.path}/.staging/{name}"
        result.withColumn("bucket", bucket).write.partitionBy("bucket").parquet(staging)
        discard(waiting)
        fs, src = hadoop_fs(self.spark, staging)
        folder = f"data-{name}"
        written = {s.getPath().getName().split("=")[1]: int(fs.getContentSummary(s.getPath()).getLength()) for s in fs.listStatus(src) if "=" in s.getPath().getName()}
        if not move_new(self.spark, staging, f"{self.path}/{folder}"):
            raise OSError(f"could not move {staging}")
        sizes = {b: held["bytes"].get(b, 0) for b in kept} | written
        try:
            self.versions.add(version + 1, {"buckets": n, "schema": schema.jsonValue(), "parts": kept | dict.fromkeys(written, folder), "bytes": sizes})
        except Stale:
            delete(self.spark, f"{self.path}/{folder}")
            raise
        return version + 1

    def read(self, version: int | None = None) -> DataFrame:
        """All states, tombstones included."""
        _, held = self._held(version)
        if held["schema"] is None:
            raise LookupError("nothing has been applied")
        return self._read(held, sorted(held["parts"]))

    def cleanup(self, keep_versions: int = 1, older_than: float = 3600.0) -> list[str]:
        """Removes buckets that none of the last versions names and that have lain for ``older_than`` seconds."""
        numbers = self.versions.numbers()
        named = {f"{folder}/bucket={b}" for v in numbers[-keep_versions:] for b, folder in self.versions.read(v)["parts"].items()}
        fs, root = hadoop_fs(self.spark, self.path)
        gone = []
        for old in numbers[:-keep_versions]:
            delete(self.spark, self.versions._name(old))
        for data in [s for s in fs.listStatus(root) if s.getPath().getName().startswith("data-")]:
            if data.getModificationTime() / 1000 > time.time() - older_than:
                continue
            parts = [s.getPath() for s in fs.listStatus(data.getPath()) if "=" in s.getPath().getName()]
            unnamed = [p for p in parts if f"{data.getPath().getName()}/{p.getName()}" not in named]
            for p in unnamed if len(unnamed) < len(parts) else [data.getPath()]:
                fs.delete(p, True)
                gone.append(p.toString())
        return gone


class PublishedTable:
    """A table whose versions become visible whole: staged, renamed, then named by one new version."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.versions = Versions(spark, f"{self.path}/_versions", kept=None)

    def publish(self, df: DataFrame, after: int | None = None, **extra) -> int:
        """Writes ``df`` as the next version; readers see all of it or nothing.

        Of two writers one makes the version, the other gets an error and leaves no trace. ``after`` is
        the version that ``df`` rests on, if it does; ``extra`` is kept with the version.
        """
        version = (self.versions.latest()[0] if after is None else after) + 1
        name = uuid.uuid4().hex[:16]
        staging = f"{self.path}/.staging/{name}"
        df.write.parquet(staging)
        folder = f"data-{name}"
        if not move_new(self.spark, staging, f"{self.path}/{folder}"):
            raise OSError(f"could not move {staging}")
        try:
            self.versions.add(version, {"data": folder, "schema": df.schema.jsonValue()} | extra)
        except Stale:
            delete(self.spark, f"{self.path}/{folder}")
            raise
        return version

    def read(self, version: int | None = None) -> DataFrame:
        held = self.versions.read(version) if version else self.versions.latest()[1]
        if held is None:
            raise LookupError("nothing is published")
        return self.spark.read.schema(T.StructType.fromJson(held["schema"])).parquet(f"{self.path}/{held['data']}")


def chunk_feed(diffs: DataFrame) -> DataFrame:
    """The changes that the readable diffs make to chunks, each with its place in the order of application."""
    schema = flatten.commit_schema(["id"])
    keep = {"repo": F.col("repo"), "revision_id": F.col("revision_id"), "ref": flatten.reference_or_zero()}
    chunks = flatten.chunks_table(flatten.parsed(diffs, "diff", keep, schema), list(keep), ["id"])
    return chunks.select(
        "repo", "aggregation", "chunk_id", "revision_id", "ref", "entry_no", "op_no",
        F.when(F.col("action") == "added", 1).otherwise(0).alias("step"),
        (F.col("action") == "added").alias("live"),
    )


def live_chunks(diffs: DataFrame, path: str | None = None) -> DataFrame:
    """Per repository and aggregation the chunks live after the last revision, with the revision that last added them."""
    key, seq = ["repo", "aggregation", "chunk_id"], ["revision_id", "ref", "entry_no", "op_no", "step"]
    state = BucketedState(diffs.sparkSession, path or new_path(diffs.sparkSession, "chunk-state"), key, seq)
    state.apply(chunk_feed(diffs), _default_buckets(diffs))
    return state.read().where("live").select(*key, "revision_id")

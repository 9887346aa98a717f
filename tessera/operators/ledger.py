"""Problem 4: only new or changed records per run, by a ledger of work items.

A work item (here: a delivered file) is pending, leased or done. A run leases the items it can
see; an expired or released lease returns to pending; every lease has a fencing token, greater
than all before it, and a token that no longer holds its lease is refused where it would publish
and where it would complete. Results go to a path that depends only on the items and on what was
done before, so a retry finds what the attempt before it published, or publishes it for the first
time: nothing is skipped or repeated. The ledger is a document of numbered versions (``versions``).

The data side is one job for any number of runs: rows get the run that completed their file,
are reduced to the best version per id and run before the shuffle (an id with a third of all
rows leaves one per run and partition), and a window over at most one row per id and run compares the current
version with the one before.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Iterable, Sequence
from dataclasses import asdict, dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.session import hadoop_fs, new_path
from tessera.versions import Versions, delete, exists, move_new

PENDING, LEASED, DONE = "pending", "leased", "done"


class StaleWriter(RuntimeError):
    """A fencing token that holds the lease no more, or a run that started from what isn't the last state."""


@dataclass(frozen=True)
class WorkItem:
    item: str
    state: str = PENDING
    owner: str = ""
    token: int = 0
    expires: float = 0.0


class WorkLedger:
    """Work items with leases; ``path`` None keeps the versions in memory (tests, replays)."""

    def __init__(self, spark: SparkSession | None = None, path: str | None = None):
        self.versions = Versions(spark, path)

    @staticmethod
    def _items(held: dict | None) -> dict[str, WorkItem]:
        return {i["item"]: WorkItem(**i) for i in held["items"]} if held else {}

    @staticmethod
    def _held(items: dict[str, WorkItem], token: int, results: list) -> dict:
        return {"token": token, "items": [asdict(i) for i in items.values()], "results": results}

    def items(self) -> list[WorkItem]:
        return list(self._items(self.versions.latest()[1]).values())

    def results(self) -> list[dict]:
        """What ``complete`` recorded, in order of completion."""
        held = self.versions.latest()[1]
        return held["results"] if held else []

    def add(self, names: Iterable[str]) -> None:
        """Registers new items as pending; known ones stay as they are."""
        names = list(names)

        def edit(held: dict | None) -> dict | None:
            items = self._items(held)
            new = {n: WorkItem(n) for n in names if n not in items}
            return self._held(items | new, held["token"] if held else 0, held["results"] if held else []) if new else None

        self.versions.change(edit)

    def lease(self, owner: str, now: float, seconds: float, names: Iterable[str] | None = None) -> tuple[int, list[str]]:
        """A new fencing token and the items it now holds: all pending ones, those of expired leases included."""
        wanted = None if names is None else set(names)
        got: dict = {}

        def edit(held: dict | None) -> dict:
            items, token = self._items(held), (held["token"] if held else 0) + 1
            free = lambda i: i.state == PENDING or (i.state == LEASED and i.expires <= now)
            taken = [n for n, i in items.items() if free(i) and (wanted is None or n in wanted)]
            got["token"], got["taken"] = token, taken
            return self._held(items | {n: WorkItem(n, LEASED, owner, token, now + seconds) for n in taken}, token, held["results"] if held else [])

        self.versions.change(edit)
        return got["token"], got["taken"]

    @staticmethod
    def _holds(items: dict[str, WorkItem], token: int, names: Sequence[str], now: float) -> None:
        for n in names:
            i = items.get(n)
            if i is None or i.state != LEASED or i.token != token or i.expires <= now:
                raise StaleWriter(f"token {token} doesn't hold {n}")

    def check(self, token: int, names: Sequence[str], now: float) -> None:
        """Refuses a token that doesn't hold all of ``names``; to be asked before anything is published."""
        self._holds(self._items(self.versions.latest()[1]), token, names, now)

    def _finish(self, token: int, names: Sequence[str], now: float, state: str, result: dict | None = None, after: int | None = None) -> None:
        def edit(held: dict | None) -> dict:
            items = self._items(held)
            self._holds(items, token, names, now)
            results = held["results"]
            if after is not None and after != len(results):
                raise StaleWriter("another run has completed meanwhile")
            return self._held(items | {n: replace(items[n], state=state, expires=0.0) for n in names}, held["token"], results + ([result] if result else []))

        self.versions.change(edit)

    def complete(self, token: int, names: Sequence[str], now: float, result: dict | None = None, after: int | None = None) -> None:
        """Work done; ``result`` (where it is) becomes visible in the same step.

        ``after`` is the number of results that the work started from: if there are more by now it
        is refused, because the work doesn't know of them.
        """
        self._finish(token, names, now, DONE, result, after)

    def release(self, token: int, names: Sequence[str], now: float) -> None:
        """Gives leased items back, as a run does that fails and can still say so."""
        self._finish(token, names, now, PENDING)


def work_path(root: str, names: Iterable[str], after: int) -> str:
    """Where the result of these items lies, if ``after`` results were there before: the same for every attempt."""
    digest = hashlib.sha256(json.dumps(sorted(names)).encode()).hexdigest()[:24]
    return f"{root.rstrip('/')}/after={after:06d}-items={digest}"


# -- the data side ------------------------------------------------------------------------

#: What makes two versions of a revision differ.
COMPARED = ("epoch", "level", "type", "created_by", "has_snapshot")


def versions(rows: DataFrame, key: str = "id") -> DataFrame:
    """The rows as (key, file_no, version): a struct that orders by timestamp (NULL lowest), then feed position."""
    seen = F.struct("timestamp", "feed_seq", "epoch", "level", "type", "created_by", F.col("snapshot").isNotNull().alias("has_snapshot"))
    return rows.where(F.col(key).isNotNull()).select(key, "file_no", seen.alias("version"))


def _differs(a: str, b: str) -> Column:
    same = F.lit(True)
    for c in COMPARED:
        same = same & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return ~same


def progress(rows: DataFrame, done: DataFrame, key: str = "id", state: DataFrame | None = None) -> DataFrame:
    """(run_id, key, version, changed) of each key that a run's files hold: its current version and whether it must be processed.

    ``done`` (file_no, run_id) says which run completed a file; rows of other files are not
    seen. ``state`` (key, version) is what the runs before the first one here left, of which the greatest version of a
    key counts; it lets a single run read only its own files, and only the keys in them go on from it.
    """
    best = versions(rows, key).join(done, "file_no").groupBy(key, "run_id").agg(F.max("version").alias("best"))
    if state is not None:
        touched = best.select(key).distinct()
        best = best.unionByName(state.join(touched, key, "left_semi").select(key, F.lit(-1).cast("int").alias("run_id"), F.col("version").alias("best")))
    w = Window.partitionBy(key).orderBy("run_id")
    current = best.withColumn("version", F.max("best").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    before = current.withColumn("before", F.lag("version").over(w)).where("run_id >= 0")
    return before.select("run_id", key, "version", (F.col("before").isNull() | _differs("version", "before")).alias("changed"))


def changes_by_run(rows: DataFrame, done: DataFrame, key: str = "id", state: DataFrame | None = None) -> DataFrame:
    """(run_id, key) of each key that is new or changed in a run."""
    return progress(rows, done, key, state).where("changed").select("run_id", key)


class IncrementalRunner:
    """Live runs: each processes what is new since the last completed one.

    A run writes what its files hold (id, current version, changed or not) beside its target, shows
    its token and moves the table to the path of its items; then it completes: one version of the
    ledger marks the files done and names the path. A run that dies before that leaves at most the
    table that its retry would write, and the retry takes it as it is. A run that comes back after its lease
    was given away is refused before it publishes, and one beside which another run has completed is worked again from the new state.

    The state that runs start from is the tables of the runs before: the version of an id is the
    greatest in any of them. After ``max_layers`` of them a run leaves them merged into one, so a run
    reads its own files and a few tables, of which only the ids that its files touch go on.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "id", lease_seconds: float = 3600.0, max_layers: int = 8, clock: Callable[[], float] = time.time):
        """``clock`` is asked where no time is given: then a lease that ran out during the work is noticed, too."""
        self.spark, self.path, self.key, self.lease_seconds, self.max_layers, self.clock = spark, path.rstrip("/"), key, lease_seconds, max_layers, clock
        self.ledger = WorkLedger(spark, f"{self.path}/ledger")

    def _at(self, now: float | None) -> float:
        return self.clock() if now is None else now

    def begin(self, owner: str, files: Iterable[int], now: float | None = None) -> tuple[int, list[str]]:
        """Leases the delivered files that no run has completed."""
        files = [str(f) for f in files]
        self.ledger.add(files)
        return self.ledger.lease(owner, self._at(now), self.lease_seconds, files)

    def _publish(self, df: DataFrame, target: str, allowed: Callable[[], None]) -> None:
        """``df`` under the name ``target``, unless an earlier attempt left it there."""
        if exists(self.spark, target):
            return
        staging = f"{self.path}/staging/{uuid.uuid4().hex}"
        try:
            allowed()
            df.write.parquet(staging)
            allowed()
            move_new(self.spark, staging, target)
        finally:
            delete(self.spark, staging)

    def work(self, run_id: int, rows: DataFrame, token: int, taken: Sequence[str], now: float | None = None) -> dict:
        """Publishes what the run's files hold; what ``finish`` has to record."""
        before = self.ledger.results()
        layers = before[-1]["layers"] if before else []
        allowed = lambda: self.ledger.check(token, taken, self._at(now))
        target = work_path(f"{self.path}/moved", taken, len(before))
        done = self.spark.createDataFrame([(int(f), run_id) for f in taken], "file_no int, run_id int")
        fresh = rows.where(F.col("file_no").isin([int(f) for f in taken]))
        state = self.spark.read.parquet(*layers).select(self.key, "version") if layers else None
        self._publish(progress(fresh, done, self.key, state).drop("run_id"), target, allowed)
        layers = [*layers, target]
        if len(layers) > self.max_layers:
            merged = work_path(f"{self.path}/merged", taken, len(before))
            every = self.spark.read.parquet(*layers)
            self._publish(every.groupBy(self.key).agg(F.max("version").alias("version")), merged, allowed)
            layers = [merged]
        return {"run_id": run_id, "moved": target, "layers": layers, "after": len(before)}

    def finish(self, token: int, taken: Sequence[str], result: dict, now: float | None = None) -> None:
        self.ledger.complete(token, taken, self._at(now), result, result["after"])

    def run(self, owner: str, run_id: int, rows: DataFrame, files: Iterable[int], now: float | None = None) -> int:
        """A whole run; the number of files it processed."""
        token, taken = self.begin(owner, files, now)
        while taken:
            result = self.work(run_id, rows, token, taken, now)
            try:
                self.finish(token, taken, result, now)
                break
            except StaleWriter:
                self.ledger.check(token, taken, self._at(now))  # the lease is lost, or else another run came between
        return len(taken)

    def changed(self) -> DataFrame:
        """(run_id, key) of all completed runs."""
        parts = [self.spark.read.parquet(r["moved"]).where("changed").select(F.lit(r["run_id"]).alias("run_id"), self.key) for r in self.ledger.results()]
        if not parts:
            raise LookupError("no run has completed")
        return reduce(DataFrame.unionByName, parts)

    def cleanup(self) -> None:
        """Removes staged tables and layers that no result names; nothing may run beside it."""
        named = {p for r in self.ledger.results() for p in (r["moved"], *r["layers"])}
        for kind in ("moved", "merged"):
            fs, folder = hadoop_fs(self.spark, f"{self.path}/{kind}")
            for s in fs.listStatus(folder) if fs.exists(folder) else []:
                if f"{self.path}/{kind}/{s.getPath().getName()}" not in named:
                    fs.delete(s.getPath(), True)
        delete(self.spark, f"{self.path}/staging")


def schedule(runs: DataFrame) -> list[tuple[int, float, int, str]]:
    """(run_id, start, last_file, status) of the scheduler's log, by run: a row per run."""
    log = runs.where("run_id IS NOT NULL AND last_file IS NOT NULL").select("run_id", F.unix_seconds(F.col("started_at").cast("timestamp")).alias("start"), "last_file", "status").orderBy("run_id").collect()
    return [(r["run_id"], float(r["start"] or 0.0), r["last_file"], r["status"]) for r in log]


def replay(log: Sequence[tuple[int, float, int, str]], files: Sequence[int], ledger: WorkLedger, lease_seconds: float = 3600.0, publish: Callable[[int, int, list[str], float], dict] | None = None) -> dict[int, int]:
    """File to the run that completed it, by playing the log of runs through the ledger.

    A failed run releases what it leased; a killed one says nothing, and its items come back when
    the lease expires. ``publish`` (token, run, items, now) does the work of an 'ok' run and returns the result to record.
    """
    done: dict[int, int] = {}
    clock = 0.0
    finished = {r["run_id"] for r in ledger.results()}
    for run_id, start, last_file, status in log:
        clock = max(clock, start)  # never back
        if run_id in finished:
            continue
        seen = [str(f) for f in files if f <= last_file]
        ledger.add(seen)
        if status == "ok":  # the scheduler starts no run beside a living one: what is still leased is dead
            clock = max([clock, *(i.expires for i in ledger.items() if i.state == LEASED)])
        token, taken = ledger.lease(f"run-{run_id}", clock, lease_seconds, seen)
        if status == "ok":
            ledger.complete(token, taken, clock, publish(token, run_id, taken, clock) if publish else None)
            done |= {int(n): run_id for n in taken}
        elif status == "failed":
            ledger.release(token, taken, clock)
    return done


def changed_ids(revisions: DataFrame, runs: DataFrame, path: str | None = None) -> DataFrame:
    """(run_id, id): what each successful run has to process.

    NULL ids are no records; a NULL timestamp is the oldest; rows of files that no successful
    run saw are in no run; exact repeats change nothing.

    The log is played once in memory to learn which run completes which files; one job then writes
    the changes of all runs, and the log is played through the ledger below ``path``: each run that
    succeeds shows its token, moves its part to the path of its items and completes with it. Played
    again over the same ``path`` it finds everything done and published.
    """
    spark = revisions.sparkSession
    root = (path or new_path(spark, "runs")).rstrip("/")
    # the delivered files are the work items: their numbers are the catalogue of deliveries, one row a file
    files = [r[0] for r in revisions.where("file_no IS NOT NULL").select("file_no").distinct().collect()]
    log = schedule(runs)
    done = replay(log, files, WorkLedger())
    ledger = WorkLedger(spark, f"{root}/ledger")
    staging = f"{root}/staging/{uuid.uuid4().hex}"
    if {run_id for run_id, _, _, status in log if status == "ok"} - {r["run_id"] for r in ledger.results()}:
        completed = spark.createDataFrame(sorted(done.items()), "file_no int, run_id int")
        changes_by_run(revisions, completed).write.partitionBy("run_id").parquet(staging)

        def publish(token: int, run_id: int, taken: list[str], now: float) -> dict:
            target = work_path(f"{root}/changed/run_id={run_id}", taken, len(ledger.results()))
            part = f"{staging}/run_id={run_id}"
            ledger.check(token, taken, now)
            has = exists(spark, target) or exists(spark, part) and (move_new(spark, part, target) or True)
            return {"run_id": run_id, "changed": target if has else None}

        replay(log, files, ledger, publish=publish)
        delete(spark, staging)
    paths = [r["changed"] for r in ledger.results() if r["changed"]]
    if not paths:
        return spark.createDataFrame([], "run_id int, id long")
    return spark.read.option("basePath", f"{root}/changed").schema("id long, run_id int, after string").parquet(*paths).select("run_id", "id")


def live_ids(revisions: DataFrame, runs: DataFrame, path: str | None = None, lease_seconds: float = 3600.0) -> DataFrame:
    """(run_id, id), as ``changed_ids``, by live runs one after the other, each reading only its own files and what the runs before left.

    A failed run leases its files and gives them back, a killed one leaves its lease to expire.
    """
    spark = revisions.sparkSession
    files = [r[0] for r in revisions.where("file_no IS NOT NULL").select("file_no").distinct().collect()]
    runner = IncrementalRunner(spark, path or new_path(spark, "live-runs"), lease_seconds=lease_seconds)
    clock = 0.0
    for run_id, start, last_file, status in schedule(runs):
        clock = max(clock, start)
        seen = [f for f in files if f <= last_file]
        if status == "ok":  # as in ``replay``: no living run is beside it
            clock = max([clock, *(i.expires for i in runner.ledger.items() if i.state == LEASED)])
            runner.run(f"run-{run_id}", run_id, revisions, seen, clock)
        else:
            token, taken = runner.begin(f"run-{run_id}", seen, clock)
            if status == "failed":
                runner.ledger.release(token, taken, clock)
    if not runner.ledger.results():
        return spark.createDataFrame([], "run_id int, id long")
    return runner.changed()

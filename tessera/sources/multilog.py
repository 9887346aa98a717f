"""Append-only partitioned logs: numbered files by hour and log, resumable by file and offset.

A file lies at ``log=<name>/hour=<yyyy-MM-dd_HH>/<number>.parquet`` and never changes. Rows are written beside
the log and each file is moved to the next free number in one step, so readers see whole files only. Hours
never go back: rows that come for an earlier hour than the log's last one get into the last one's
next file. The files of a log therefore have one order in which they only grow, and a position is three
values however long the log is: hour, number, and the rows read of that file.
Damaged or half-written files can be skipped.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import hadoop_fs
from tessera.versions import delete, move_new

HOUR = "yyyy-MM-dd_HH"

#: (hour, number, rows of that file that are read)
Position = tuple[str, int, int]


class Multilog:
    """A log below ``path`` with rows of ``schema``."""

    def __init__(self, spark: SparkSession, path: str, schema: str, tolerant: bool = True, max_records: int = 1_000_000):
        self.spark, self.path, self.schema, self.tolerant, self.max_records = spark, path.rstrip("/"), schema, tolerant, max_records

    # -- writing ----------------------------------------------------------------------------------

    def write(self, rows: DataFrame, log: Column, at: Column | None = None) -> list[str]:
        """Appends rows to the logs named by ``log``, in files by the hour of ``at`` (UTC; now, if not given); the files made."""
        at = F.current_timestamp() if at is None else at
        placed = rows.withColumn("log", log.cast("string")).withColumn("hour", F.date_format(at, HOUR))
        staging = f"{self.path}/.staging/{uuid.uuid4().hex}"
        placed = placed.hint("rebalance", "log", "hour")  # few files of each log and hour, a hot one in several tasks
        placed.write.option("compression", "lz4_raw").option("maxRecordsPerFile", self.max_records).partitionBy("log", "hour").parquet(staging)
        waiting: dict[str, list[tuple[str, str]]] = {}
        for path in self._paths(staging):
            name, hour, file = self._parts(path)
            waiting.setdefault(name, []).append((hour, file))
        made = []
        for name, files in waiting.items():
            last = max(self._of_log(name), default=None)
            for hour, file in sorted(files):
                target = (hour, 0) if last is None or hour > last[0] else (last[0], last[1] + 1)
                while not move_new(self.spark, f"{staging}/log={name}/hour={hour}/{file}", self._path(name, *target)):
                    target = (target[0], target[1] + 1)  # another writer took it
                last = target
                made.append(f"{name}/{target[0]}/{target[1]:09d}.parquet")
        delete(self.spark, staging)
        return made

    # -- files ------------------------------------------------------------------------------------

    def _path(self, log: str, hour: str, number: int) -> str:
        return f"{self.path}/log={log}/hour={hour}/{number:09d}.parquet"

    @staticmethod
    def _parts(path: str) -> tuple[str, str, str]:
        log, hour, name = path.split("/")[-3:]
        return log[4:], hour[5:], name

    def _paths(self, root: str, log: str = "*") -> list[str]:
        fs, _ = hadoop_fs(self.spark, root)
        found = fs.globStatus(hadoop_fs(self.spark, f"{root}/log={log}/hour=*/*.parquet")[1])
        return sorted(s.getPath().toString() for s in found or [])

    def _of_log(self, log: str) -> list[tuple[str, int]]:
        return [(hour, int(name.split(".")[0])) for _, hour, name in map(self._parts, self._paths(self.path, log))]

    def logs(self) -> list[str]:
        return sorted({f.split("/")[0] for f in self.files()})

    def files(self) -> list[str]:
        """'<log>/<hour>/<file>' of all files, in order of log, hour and number."""
        return ["/".join(self._parts(p)) for p in self._paths(self.path)]

    # -- reading ----------------------------------------------------------------------------------

    def read(self, start: Mapping[str, Position] | None = None, logs: Sequence[str] | None = None, first_hour: str | None = None, end: Mapping[str, tuple[str, int]] | str | None = None, max_files: int | None = None) -> tuple[DataFrame, dict[str, Position]]:
        """(rows from ``start`` on, the positions after them).

        ``end`` is the last file to read, (hour, number) per log, or the last hour; ``max_files`` the most files of
        a log. ``first_hour`` begins a log that ``start`` doesn't name.
        """
        after: dict[str, Position] = {k: tuple(v) for k, v in (start or {}).items()}
        whole, part = [], []
        files: dict[str, list[tuple[str, int]]] = {}
        for f in self.files():
            log, hour, name = f.split("/")
            files.setdefault(log, []).append((hour, int(name.split(".")[0])))
        for log, own in files.items():
            if logs is not None and log not in logs:
                continue
            hour, number, offset = after.get(log, (first_hour or "", 0, 0))
            last = (end, float("inf")) if isinstance(end, str) else (end or {}).get(log)
            own = [f for f in own if f >= (hour, number) and (last is None or f <= last)][:max_files]
            for f in own:
                (part if f == (hour, number) and offset else whole).append((log, *f, offset))
            if own:
                after[log] = (own[-1][0], own[-1][1] + 1, 0)
        wanted = f"{self.schema}, log string, hour string"
        reader = self.spark.read.schema(wanted).option("basePath", self.path).option("ignoreCorruptFiles", str(self.tolerant).lower())
        frames = [reader.parquet(*[self._path(*f[:3]) for f in whole])] if whole else []
        for log, hour, number, offset in part:  # of one file of each log at most
            held = reader.parquet(self._path(log, hour, number))
            frames.append(held.where(F.col("_metadata.row_index") >= offset).select(*held.columns))
        return reduce(DataFrame.unionByName, frames) if frames else self.spark.createDataFrame([], wanted), after

    def stream(self) -> DataFrame:
        """The log as a file stream, for ``tessera.streaming.etl``."""
        reader = self.spark.readStream.schema(f"{self.schema}, log string, hour string").option("ignoreCorruptFiles", str(self.tolerant).lower())
        return reader.option("basePath", self.path).parquet(f"{self.path}/log=*/hour=*")

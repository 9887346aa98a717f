"""Numbered versions in the shared folder: the compare-and-swap that everything published rests on.

A version is written whole to a name of its own and then given its number in one atomic step that
fails if the number is taken. A writer that dies before the step leaves a file nobody reads, one
that dies after it has finished: no version is ever half there. On a local or NFS folder the step
is a hard link, elsewhere a rename that doesn't overwrite (atomic on HDFS).
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from urllib.parse import unquote, urlparse

from pyspark.sql import SparkSession

from tessera.session import hadoop_fs

#: Versions kept by ``Versions.add``; older ones are pruned. A writer this far behind is refused.
KEPT = 100


class Stale(RuntimeError):
    """Somebody else made the version meanwhile."""


def _rename_new(spark: SparkSession, source, target) -> bool:
    """Renames a file or folder unless the target exists."""
    jvm = spark._jvm
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(source, target, how)
    except Exception as e:
        if "FileAlreadyExistsException" in str(e):
            return False
        raise
    return True


def put_new(spark: SparkSession, uri: str, data: bytes) -> bool:
    """A whole file under a name that isn't taken; False if it is."""
    fs, target = hadoop_fs(spark, uri)
    parent, name = uri.rsplit("/", 1)
    draft = f"{parent}/.{name}-{uuid.uuid4().hex}"
    if str(fs.getUri().getScheme()) == "file":
        plain = lambda u: unquote(urlparse(u).path)
        os.makedirs(plain(parent), exist_ok=True)
        with open(plain(draft), "xb") as out:
            out.write(data)
            out.flush()
            os.fsync(out.fileno())
        try:
            os.link(plain(draft), plain(uri))
        except FileExistsError:
            return False
        finally:
            os.unlink(plain(draft))
        return True
    _, source = hadoop_fs(spark, draft)
    fs.mkdirs(target.getParent())
    out = fs.create(source, False)
    out.write(bytearray(data))
    out.close()
    done = _rename_new(spark, source, target)
    if not done:
        fs.delete(source, False)
    return done


def move_new(spark: SparkSession, source: str, target: str) -> bool:
    """Moves a folder to a name that isn't taken; False, and nothing is moved, if it is."""
    fs, src = hadoop_fs(spark, source)
    _, dst = hadoop_fs(spark, target)
    fs.mkdirs(dst.getParent())
    return _rename_new(spark, src, dst)


def exists(spark: SparkSession, uri: str) -> bool:
    fs, p = hadoop_fs(spark, uri)
    return fs.exists(p)


def delete(spark: SparkSession, uri: str) -> None:
    fs, p = hadoop_fs(spark, uri)
    fs.delete(p, True)


def read_bytes(spark: SparkSession, uri: str) -> bytes:
    fs, p = hadoop_fs(spark, uri)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes())
    finally:
        stream.close()


class Versions:
    """JSON documents numbered from 1 below ``path``; the greatest number is the present state."""

    def __init__(self, spark: SparkSession | None, path: str | None, kept: int | None = KEPT):
        """``path`` None keeps the versions in memory; ``kept`` None prunes nothing."""
        self.spark, self.path, self.kept = spark, path.rstrip("/") if path else None, kept
        self._memory: dict[int, str] = {}
        self._last: tuple[int, str] | None = None  # documents never change

    def numbers(self) -> list[int]:
        if self.path is None:
            return sorted(self._memory)
        fs, folder = hadoop_fs(self.spark, self.path)
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n) for n in names if n.isdigit())

    def _name(self, number: int) -> str:
        return f"{self.path}/{number:012d}"

    def read(self, number: int) -> dict:
        if self._last is None or self._last[0] != number:
            self._last = (number, self._memory[number] if self.path is None else read_bytes(self.spark, self._name(number)).decode())
        return json.loads(self._last[1])

    def latest(self) -> tuple[int, dict | None]:
        """(number, document); (0, None) if there is none."""
        while True:
            numbers = self.numbers()
            if not numbers:
                return 0, None
            try:
                return numbers[-1], self.read(numbers[-1])
            except Exception:
                if numbers[-1] in self.numbers():  # not pruned meanwhile
                    raise

    def add(self, number: int, held: dict) -> None:
        """Makes the version ``number``, the one after the writer's; ``Stale`` if it exists or existed."""
        text = json.dumps(held)
        if self.path is None:
            if number != len(self._memory) + 1:
                raise Stale(f"version {number} exists")
            self._memory[number] = text
            return
        if not put_new(self.spark, self._name(number), text.encode()):
            raise Stale(f"version {number} exists")
        numbers = self.numbers()
        if number > 1 and number - 1 not in numbers:  # the versions it rests on are long gone, and so was this one
            delete(self.spark, self._name(number))
            raise Stale(f"version {number} existed")
        if self.kept is not None:
            for old in numbers[: -self.kept]:
                delete(self.spark, self._name(old))

    def change(self, edit: Callable[[dict | None], dict | None], tries: int = 50) -> tuple[int, dict | None]:
        """Replaces the present document by ``edit`` of it, again if somebody else was faster; None changes nothing."""
        for _ in range(tries):
            number, held = self.latest()
            new = edit(held)
            if new is None:
                return number, held
            try:
                self.add(number + 1, new)
            except Stale:
                continue
            return number + 1, new
        raise Stale("too many writers")

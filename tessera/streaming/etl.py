"""Logs into cubes: resumable batches, each taken exactly once.

Two ways lead there. ``LogController`` reads logs from the positions that the cube's manifest holds and commits
the new positions in the same version as the chunks made from what was read: neither shows without the
other, and of two controllers over one log one is refused. ``log_to_cube`` lets Structured Streaming keep the positions in its checkpoint;
the manifest keeps the number of the last batch, so a batch that was written but not
checkpointed comes again after a failure and changes nothing.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame

from tessera.operators.aggregation import discard
from tessera.operators.chunks import CubeDiff
from tessera.plans.cube import Cube
from tessera.plans.predicates import TRUE, Predicate
from tessera.sources.multilog import Multilog
from tessera.versions import read_bytes


def log_to_cube(stream: DataFrame, cube: Cube, dimensions: Mapping[str, str], measures: Mapping[str, str | None], checkpoint: str, data: Predicate = TRUE, transform: Callable[[DataFrame], DataFrame] = lambda df: df, name: str = "log") -> int:
    """Takes all that is new in ``stream`` into the cube and returns; the number of batches.

    Batches are known by ``name``, the identity that Spark gave the checkpoint, and their number: another checkpoint counts anew.
    """
    taken, source = [], []

    def ingest(batch: DataFrame, number: int) -> None:
        if not source:
            source.append(f"{name}:{json.loads(read_bytes(cube.spark, f'{checkpoint}/metadata').decode())['id']}")
        cube.consume(transform(batch), dimensions, measures, data, commit=(source[0], number))
        taken.append(number)

    query = stream.writeStream.foreachBatch(ingest).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return len(taken)


def splitter(outputs: Mapping[str, Callable[[DataFrame], DataFrame]]) -> Callable[[DataFrame], Any]:
    """One log record to several typed outputs: ``with split(batch) as parts`` gives named functions of the batch, which is read once and let go at the end."""

    @contextmanager
    def split(batch: DataFrame) -> Iterator[dict[str, DataFrame]]:
        kept = batch.persist()
        try:
            yield {n: f(kept) for n, f in outputs.items()}
        finally:
            kept.unpersist()

    return split


@dataclass
class LogProcessor:
    """Reads what is new in a log and writes the chunks made of it; its positions are ``name/<log>`` in the cube's manifest.

    ``max_files`` bounds what one round takes of each log.
    """

    cube: Cube
    log: Multilog
    dimensions: Mapping[str, str]
    measures: Mapping[str, str | None]
    name: str = "log"
    data: Predicate = TRUE
    transform: Callable[[DataFrame], DataFrame] = lambda df: df
    logs: Sequence[str] | None = None
    max_files: int | None = None

    def process(self) -> LogDiff:
        """The diff that would show it, with the moves of positions; nothing shows yet."""
        held = self.cube.manifest.sync().positions
        start = {k.removeprefix(f"{self.name}/"): v for k, v in held.items() if k.startswith(f"{self.name}/")}
        rows, end = self.log.read(start, self.logs, max_files=self.max_files)
        moves = {f"{self.name}/{log}": (start.get(log), to) for log, to in end.items() if to != start.get(log)}
        if not moves:
            return LogDiff()
        return LogDiff(moves, (self.cube.prepare(self.transform(rows), self.dimensions, self.measures, self.data),))


class LogController:
    """Rounds of ingest: read the state, hold back while too many chunks overlap, process all logs, show everything in one commit.

    After a failure, what was written is deleted, the state is read anew by the next round, and the positions are where they were.
    """

    def __init__(self, cube: Cube, processors: Sequence[LogProcessor], overlap_limit: int = 300, parallel: bool = False):
        self.cube, self.processors, self.overlap_limit, self.parallel = cube, list(processors), overlap_limit, parallel

    def process(self) -> bool:
        """One round; False if it was held back."""
        if self.cube.too_many_overlaps(self.overlap_limit):
            return False
        done: list[LogDiff] = []
        try:
            if self.parallel:
                with ThreadPoolExecutor(len(self.processors)) as pool:
                    waiting = [pool.submit(p.process) for p in self.processors]
                done = [w.result() for w in waiting if w.exception() is None]
                for w in waiting:
                    w.result()
            else:
                for p in self.processors:
                    done.append(p.process())
            diff = reduce(LogDiff.then, done, LogDiff())
        except Exception:
            for d in done:
                for part in d.diffs:
                    discard(self.cube.spark, part)
            self.cube.manifest.reset()
            raise
        if diff.positions:
            try:
                self.cube.commit(reduce(CubeDiff.then, diff.diffs, CubeDiff()), positions=diff.positions)
            except Exception:
                self.cube.manifest.reset()
                raise
        return True


# -- the algebra of log diffs -----------------------------------------------------------------


@dataclass(frozen=True)
class LogDiff:
    """Moves of log positions {log: (from, to)} with the data diffs that go with them: the unit of a commit."""

    positions: Mapping[str, tuple] = field(default_factory=dict)
    diffs: tuple = ()

    def empty(self, is_empty: Callable[[Any], bool] = lambda d: d.empty()) -> bool:
        return not self.positions and all(is_empty(d) for d in self.diffs)

    def inverse(self, invert: Callable[[Any], Any] = lambda d: d.inverse()) -> LogDiff:
        return LogDiff({k: (b, a) for k, (a, b) in self.positions.items()}, tuple(invert(d) for d in reversed(self.diffs)))

    def then(self, other: LogDiff) -> LogDiff:
        """Both in one; a log's second move must begin where the first ended."""
        moves = dict(self.positions)
        for log, (a, b) in other.positions.items():
            if log in moves:
                if moves[log][1] != a:
                    raise ValueError(f"{log}: moves don't meet")
                a = moves[log][0]
            moves.pop(log, None)
            if a != b:
                moves[log] = (a, b)
        return LogDiff(moves, self.diffs + other.diffs)


def winner(left: LogDiff, right: LogDiff) -> str | None:
    """Of two concurrent diffs that move the same logs 'left' or 'right', the one that gets further; None if none is shared."""
    shared = left.positions.keys() & right.positions.keys()
    if not shared:
        return None
    score = 0
    for log in shared:
        if left.positions[log][0] != right.positions[log][0]:
            raise ValueError(f"{log}: concurrent moves begin at different places")
        a, b = left.positions[log][1], right.positions[log][1]
        score += (a > b) - (a < b)
    return "left" if score > 0 else "right"


class LogState:
    """Positions and data state, moved on together."""

    def __init__(self, apply: Callable[[Any], None]):
        self.positions: dict[str, Any] = {}
        self._apply = apply

    def apply(self, diff: LogDiff) -> None:
        for log, (a, _) in diff.positions.items():
            if log in self.positions and self.positions[log] != a:
                raise ValueError(f"{log} isn't at {a}")
        for d in diff.diffs:
            self._apply(d)
        self.positions |= {log: b for log, (_, b) in diff.positions.items()}

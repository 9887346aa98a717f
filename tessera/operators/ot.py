"""Versioned metadata: an algebra of diffs and a graph of commits over it.

This is driver-side bookkeeping about tables, never about their rows. Commits are immutable; a
commit has for each parent the diffs that lead from the parent to it. The level of a commit is
one more than the greatest level of its parents, so walking by falling level meets every
commit after all its descendants.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera.versions import Versions, delete, exists, put_new, read_bytes


class Conflict(Exception):
    """Two diffs that can't both be applied; ``winner`` is 'left' or 'right' or None."""

    def __init__(self, winner: str | None = None):
        super().__init__(winner or "conflict")
        self.winner = winner


class OTSystem:
    """Transform, squash, invert and emptiness of diffs, by their types."""

    def __init__(self) -> None:
        self._transform: dict[tuple, Callable] = {}
        self._squash: dict[tuple, Callable] = {}
        self._invert: dict[type, Callable] = {}
        self._empty: dict[type, Callable] = {}

    def on_transform(self, left: type, right: type, f: Callable[[Any, Any], tuple[Sequence, Sequence]]) -> OTSystem:
        """``f(left, right)`` gives (what to apply after left, what to apply after right), or raises Conflict."""
        self._transform[left, right] = f
        return self

    def on_squash(self, first: type, second: type, f: Callable[[Any, Any], Any]) -> OTSystem:
        """``f`` gives both in one diff, or None if they can't be."""
        self._squash[first, second] = f
        return self

    def on_invert(self, kind: type, f: Callable[[Any], Sequence]) -> OTSystem:
        self._invert[kind] = f
        return self

    def on_empty(self, kind: type, f: Callable[[Any], bool]) -> OTSystem:
        self._empty[kind] = f
        return self

    def is_empty(self, diff: Any) -> bool:
        return type(diff) in self._empty and self._empty[type(diff)](diff)

    def _pair(self, a: Any, b: Any) -> tuple[Sequence, Sequence]:
        if (type(a), type(b)) in self._transform:
            return self._transform[type(a), type(b)](a, b)
        if (type(b), type(a)) in self._transform:
            after_b, after_a = self._transform[type(b), type(a)](b, a)
            return after_a, after_b
        return [b], [a]

    def transform(self, left: Sequence, right: Sequence) -> tuple[list, list]:
        """(what to apply after ``left``, what to apply after ``right``) so that both ways end in one state."""
        if not left or not right:
            return list(right), list(left)
        if len(left) == 1 and len(right) == 1:
            a, b = self._pair(left[0], right[0])
            return list(a), list(b)
        if len(left) == 1:
            first_after, left_moved = self.transform(left, right[:1])
            rest_after, left_end = self.transform(left_moved, right[1:])
            return first_after + rest_after, left_end
        right_moved, first_end = self.transform(left[:1], right)
        right_end, rest_end = self.transform(left[1:], right_moved)
        return right_end, first_end + rest_end

    def squash(self, diffs: Iterable) -> list:
        out: list = []
        for d in diffs:
            if self.is_empty(d):
                continue
            while out:
                f = self._squash.get((type(out[-1]), type(d)))
                both = f(out[-1], d) if f else None
                if both is None:
                    break
                out.pop()
                d = both
                if self.is_empty(d):
                    break
            if not self.is_empty(d):
                out.append(d)
        return out

    def invert(self, diffs: Sequence) -> list:
        return [x for d in reversed(diffs) for x in self._invert[type(d)](d)]


@dataclass(frozen=True)
class Commit:
    id: Any
    parents: Mapping[Any, tuple] = field(default_factory=dict)
    level: int = 1
    epoch: int = 0

    @property
    def is_root(self) -> bool:
        return not self.parents

    @property
    def is_merge(self) -> bool:
        return len(self.parents) > 1


class Repository:
    """Commits, heads and snapshots in memory; ``TableRepository`` keeps them in the shared folder."""

    def __init__(self) -> None:
        self._commits: dict[Any, Commit] = {}
        self._snapshots: dict[Any, list] = {}
        self._heads: set = set()

    def push(self, *commits: Commit) -> None:
        for c in commits:
            self._commits.setdefault(c.id, c)

    def load(self, id: Any) -> Commit:
        return self._commits[id]

    def heads(self) -> set:
        return set(self._heads)

    def update_heads(self, new: Iterable, gone: Iterable = ()) -> None:
        self._heads = (self._heads | set(new)) - set(gone)

    def save_snapshot(self, id: Any, diffs: Sequence) -> None:
        self._snapshots[id] = list(diffs)

    def load_snapshot(self, id: Any) -> list | None:
        return self._snapshots.get(id)

    def make(self, id: Any, parents: Mapping[Any, Sequence], epoch: int = 0) -> Commit:
        """A commit one level above its parents."""
        level = 1 + max((self.load(p).level for p in parents), default=0)
        return Commit(id, {p: tuple(d) for p, d in parents.items()}, level, epoch)

    def cleanup(self, level: int) -> None:
        """Forgets commits and snapshots below a level."""
        for k in [k for k, c in self._commits.items() if c.level < level]:
            self._commits.pop(k)
            self._snapshots.pop(k, None)


class TableRepository(Repository):
    """A repository in the shared folder: a whole, exclusively made file for each commit and snapshot, and versions of the set of heads.

    Only what a walk meets is read, so a checkout costs the way to the last snapshot, however large the
    store; the last ``kept`` commits read stay in memory. ``encode`` and ``decode`` turn a diff to
    JSON and back. Two writers of one id: the second fails. Heads change by ``update_heads`` in one step.
    """

    def __init__(self, spark: SparkSession, path: str, encode: Callable[[Any], Any], decode: Callable[[Any], Any], kept: int = 10_000):
        super().__init__()
        self.spark, self.path, self.encode, self.decode, self.kept = spark, path.rstrip("/"), encode, decode, kept
        self._versions = Versions(spark, f"{self.path}/heads")

    def _file(self, kind: str, id: Any) -> str:
        return f"{self.path}/{kind}/{id}.json"

    def load(self, id: Any) -> Commit:
        if id not in self._commits:
            d = json.loads(read_bytes(self.spark, self._file("commit", id)).decode())
            while len(self._commits) >= self.kept:
                del self._commits[next(iter(self._commits))]  # the one read first
            self._commits[id] = Commit(d["id"], {p: tuple(self.decode(x) for x in diffs) for p, diffs in d["parents"]}, d["level"], d["epoch"])
        return self._commits[id]

    def heads(self) -> set:
        held = self._versions.latest()[1]
        return set(held["heads"]) if held else set()

    def update_heads(self, new: Iterable, gone: Iterable = ()) -> None:
        new, gone = set(new), set(gone)
        self._versions.change(lambda held: {"heads": sorted((set(held["heads"] if held else ()) | new) - gone, key=repr)})

    def push(self, *commits: Commit) -> None:
        for c in commits:
            held = {"id": c.id, "level": c.level, "epoch": c.epoch, "parents": [[p, [self.encode(d) for d in diffs]] for p, diffs in c.parents.items()]}
            if not put_new(self.spark, self._file("commit", c.id), json.dumps(held).encode()):
                raise FileExistsError(c.id)
        super().push(*commits)

    def save_snapshot(self, id: Any, diffs: Sequence) -> None:
        """The first snapshot of a commit stays; another would be the same."""
        put_new(self.spark, self._file("snapshot", id), json.dumps({"id": id, "diffs": [self.encode(d) for d in diffs]}).encode())

    def load_snapshot(self, id: Any) -> list | None:
        if not exists(self.spark, self._file("snapshot", id)):
            return None
        return [self.decode(x) for x in json.loads(read_bytes(self.spark, self._file("snapshot", id)).decode())["diffs"]]

    def cleanup(self, level: int) -> None:
        """Deletes commits and snapshots below a level; the levels are read by Spark, only the files to delete come to the driver."""
        super().cleanup(level)
        commits = self.spark.read.schema("level long").option("wholetext", "true").json(f"{self.path}/commit")
        for row in commits.where(F.col("level") < level).select(F.input_file_name()).distinct().collect():
            name = row[0].rsplit("/", 1)[1]
            for kind in ("commit", "snapshot"):
                delete(self.spark, f"{self.path}/{kind}/{name}")


# -- graph algorithms ---------------------------------------------------------------------------


def walk(repo: Repository, heads: Iterable):
    """Commits reachable from ``heads``, by falling level; send True to skip a commit's parents."""
    seen = set(heads)
    queue = [(-repo.load(h).level, repr(h), h) for h in seen]
    heapq.heapify(queue)
    while queue:
        commit = repo.load(heapq.heappop(queue)[2])
        skip = yield commit
        if not skip:
            for p in commit.parents:
                if p not in seen:
                    seen.add(p)
                    heapq.heappush(queue, (-repo.load(p).level, repr(p), p))


def reduce_graph(repo: Repository, heads: Iterable, visit: Callable[[Commit], Any]) -> Any:
    """Walks until ``visit`` returns something other than None or 'skip', and returns that."""
    w = walk(repo, heads)
    try:
        commit = next(w)
        while True:
            got = visit(commit)
            if got is not None and got != "skip":
                return got
            commit = w.send(got == "skip")
    except StopIteration:
        raise LookupError("the graph ended before an answer") from None


def ancestors(repo: Repository, id: Any) -> set:
    """The commit and everything before it."""
    return {c.id for c in walk(repo, [id])}


def path_diffs(repo: Repository, system: OTSystem, base: Any, head: Any) -> list:
    """Diffs that lead from ``base`` to its descendant ``head``, along any way."""
    if base == head:
        return []
    came: dict[Any, Any] = {head: None}
    for commit in walk(repo, [head]):
        for p in commit.parents:
            came.setdefault(p, commit.id)
        if base in came:
            break
    if base not in came:
        raise LookupError(f"{base} isn't before {head}")
    out: list = []
    at = base
    while came[at] is not None:
        out += repo.load(came[at]).parents[at]
        at = came[at]
    return system.squash(out)


def find_parent(repo: Repository, heads: Iterable, matches: Callable[[Commit], bool]) -> Any:
    """The first commit by falling level that matches."""
    return reduce_graph(repo, heads, lambda c: c.id if matches(c) else None)


def exclude_parents(repo: Repository, nodes: Iterable) -> set:
    """Nodes that aren't before another of them: one walk, down to the lowest of their levels."""
    nodes = set(nodes)
    lowest = min((repo.load(n).level for n in nodes), default=0)
    before: set = set()
    w = walk(repo, nodes) if len(nodes) > 1 else iter(())
    try:
        commit = next(w)
        while True:
            before |= nodes & commit.parents.keys()
            commit = w.send(commit.level <= lowest)
    except StopIteration:
        return nodes - before


def find_all_common_parents(repo: Repository, nodes: Iterable) -> set:
    """The latest commits before all nodes, a node itself included.

    One walk by falling level hands on which nodes reach a commit; one that all reach is an answer unless
    it is before an answer, and the walk ends when only such are left.
    """
    reached = {n: 1 << i for i, n in enumerate(dict.fromkeys(nodes))}
    every = (1 << len(reached)) - 1
    queue = [(-repo.load(n).level, repr(n), n) for n in reached]
    heapq.heapify(queue)
    found, below, waiting = set(), set(), set(reached)  # answers, what is before them, what is neither
    while waiting:
        at = heapq.heappop(queue)[2]
        waiting.discard(at)
        if reached[at] == every and at not in below:
            found.add(at)
        for p in repo.load(at).parents:
            if p not in reached:
                reached[p] = 0
                waiting.add(p)
                heapq.heappush(queue, (-repo.load(p).level, repr(p), p))
            reached[p] |= reached[at]
            if at in found or at in below:
                below.add(p)
                waiting.discard(p)
    return found


def find_any_common_parent(repo: Repository, nodes: Iterable) -> Any:
    found = find_all_common_parents(repo, nodes)
    if not found:
        raise LookupError("no common parent")
    return max(found, key=lambda n: (repo.load(n).level, repr(n)))


def find_cut(repo: Repository, nodes: Iterable, good: Callable[[set], bool]) -> set:
    """Going back from ``nodes``, the first set of commits, cutting the graph, that is ``good``."""
    front = set(nodes)
    while not good(front):
        latest = max(front, key=lambda n: (repo.load(n).level, repr(n)))
        if repo.load(latest).is_root:
            raise LookupError("no such cut")
        front = (front - {latest}) | set(repo.load(latest).parents)
        front = exclude_parents(repo, front)
    return front


def reduce_edges(repo: Repository, system: OTSystem, heads: Iterable, base: Any) -> dict[Any, list]:
    """Diffs from ``base`` to each head."""
    return {h: path_diffs(repo, system, base, h) for h in heads}


def diff(repo: Repository, system: OTSystem, a: Any, b: Any) -> list:
    """Diffs that lead from ``a`` to ``b``, by a common parent."""
    base = find_any_common_parent(repo, [a, b])
    return system.squash(system.invert(path_diffs(repo, system, base, a)) + path_diffs(repo, system, base, b))


class _Overlay(Repository):
    """A repository with commits of its own on top of another, which stays as it is."""

    def __init__(self, below: Repository):
        super().__init__()
        self.below = below

    def load(self, id: Any) -> Commit:
        return self._commits[id] if id in self._commits else self.below.load(id)


def merge(repo: Repository, system: OTSystem, heads: Iterable) -> dict[Any, list]:
    """For each head the diffs to a state that has the changes of all heads.

    Heads are merged one by one, each into a virtual commit of those before it, from what the
    two have in common; several latest common parents are first merged themselves.
    """
    over = _Overlay(repo)
    heads = sorted(exclude_parents(repo, heads), key=repr)
    current, after = heads[0], {heads[0]: []}
    for h in heads[1:]:
        common = find_all_common_parents(over, [current, h])
        if not common:
            raise LookupError("no common parent")
        base = min(common, key=repr)
        if len(common) > 1:
            base = ("base", current, h)
            over.push(over.make(base, merge(over, system, common)))
        on_current, on_head = system.transform(_from(over, system, base, current), _from(over, system, base, h))
        after = {k: v + on_current for k, v in after.items()} | {h: on_head}
        virtual = over.make(("merge", current, h), {current: on_current, h: on_head})
        over.push(virtual)
        current = virtual.id
    return {k: system.squash(v) for k, v in after.items()}


def _from(repo: Repository, system: OTSystem, base: Any, head: Any) -> list:
    """Diffs from a base to a head; from a virtual base back to one of its parents first."""
    back: list = []
    if isinstance(base, tuple) and base[:1] == ("base",):
        parent = next(iter(repo.load(base).parents))
        back, base = system.invert(repo.load(base).parents[parent]), parent
    return system.squash(back + path_diffs(repo, system, base, head))


def merge_and_push(repo: Repository, system: OTSystem, new_id: Callable[[], Any]) -> Any:
    """One head out of all; returns it."""
    heads = repo.heads()
    if len(exclude_parents(repo, heads)) == 1:
        return next(iter(exclude_parents(repo, heads)))
    commit = repo.make(new_id(), merge(repo, system, heads))
    repo.push(commit)
    repo.update_heads([commit.id], heads)
    return commit.id


def checkout(repo: Repository, system: OTSystem, id: Any) -> list:
    """Diffs from nothing to a commit: the nearest snapshot before it and the diffs since."""
    base = find_parent(repo, [id], lambda c: c.is_root or repo.load_snapshot(c.id) is not None)
    return system.squash((repo.load_snapshot(base) or []) + path_diffs(repo, system, base, id))


def save_snapshot(repo: Repository, system: OTSystem, id: Any) -> None:
    repo.save_snapshot(id, checkout(repo, system, id))


def load_graph(repo: Repository, heads: Iterable) -> dict[Any, Commit]:
    return {c.id: c for c in walk(repo, heads)}


def copy(source: Repository, target: Repository) -> None:
    graph = load_graph(source, source.heads())
    target.push(*sorted(graph.values(), key=lambda c: c.level))
    target.update_heads(source.heads())
    for id in graph:
        snapshot = source.load_snapshot(id)
        if snapshot is not None:
            target.save_snapshot(id, snapshot)


class StateManager:
    """A local state over a repository: changes are made locally, and synchronised by an optimistic loop."""

    def __init__(self, repo: Repository, system: OTSystem, apply: Callable[[Any], None], new_id: Callable[[], Any]):
        self.repo, self.system, self.apply, self.new_id = repo, system, apply, new_id
        self.revision: Any = None
        self.pending: list = []

    def checkout(self) -> None:
        self.revision = merge_and_push(self.repo, self.system, self.new_id)
        for d in checkout(self.repo, self.system, self.revision):
            self.apply(d)

    def add(self, *diffs: Any) -> None:
        for d in diffs:
            self.apply(d)
            self.pending.append(d)

    def reset(self) -> None:
        """Takes back what isn't committed."""
        for d in self.system.invert(self.pending):
            self.apply(d)
        self.pending = []

    def sync(self) -> None:
        """Commits local changes, merges with the other heads and applies what came from them."""
        if self.pending:
            commit = self.repo.make(self.new_id(), {self.revision: self.system.squash(self.pending)})
            self.repo.push(commit)
            self.repo.update_heads([commit.id], [self.revision])
            self.revision, self.pending = commit.id, []
        head = merge_and_push(self.repo, self.system, self.new_id)
        for d in path_diffs(self.repo, self.system, self.revision, head):
            self.apply(d)
        self.revision = head


def chunk_system() -> OTSystem:
    """The algebra of ``chunks.ChunkDiff`` and ``CubeDiff``: of two diffs that remove the same chunks, the one that removes more wins."""
    from tessera.operators.chunks import ChunkDiff, CubeDiff

    def transform(a, b) -> tuple[Sequence, Sequence]:
        if a.conflicts(b):
            raise Conflict("left" if size(a) >= size(b) else "right")
        return [b], [a]

    size = lambda d: d.n_removed() if isinstance(d, CubeDiff) else len(d.removed)
    out = OTSystem()
    for kind in (ChunkDiff, CubeDiff):
        out.on_transform(kind, kind, transform).on_squash(kind, kind, lambda a, b: a.then(b)).on_invert(kind, lambda d: [d.inverse()]).on_empty(kind, lambda d: d.empty())
    return out

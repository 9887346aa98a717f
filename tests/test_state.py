"""Replicated state, logs and streams, and the commit graph."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tessera import session
from tessera.functions import measures as ms
from tessera.operators import crdt, ot
from tessera.operators.chunks import Chunk, ChunkDiff, CubeDiff
from tessera.operators.manifest import Conflict
from tessera.plans.cube import Cube, CubeQuery
from tessera.sources.multilog import Multilog
from tessera.streaming import etl
from tessera.versions import Stale


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)


@pytest.mark.parametrize("kind,schema,make", [
    (crdt.GCOUNTER, "k int, node int, n long", lambda r: (r.randrange(4), r.randrange(3), r.randrange(50))),
    (crdt.PNCOUNTER, "k int, node int, p long, n long", lambda r: (r.randrange(4), r.randrange(3), r.randrange(50), r.randrange(50))),
    (crdt.GSET, "k int, element string, added boolean", lambda r: (r.randrange(4), r.choice("abcd"), True)),
    (crdt.TPSET, "k int, element string, added boolean, removed boolean", lambda r: (r.randrange(4), r.choice("abcd"), r.choice([True, None]), r.choice([True, False, None]))),
    (crdt.LWWSET, "k int, element string, added long, removed long", lambda r: (r.randrange(4), r.choice("abcd"), r.choice([None, r.randrange(9)]), r.choice([None, r.randrange(9)]))),
    (crdt.LWW, "k int, ts long, obj string", lambda r: (r.randrange(4), r.randrange(5), r.choice("xyz"))),
])
def test_merge_is_commutative_associative_and_idempotent(spark, kind, schema, make):
    r = random.Random(3)
    parts = [spark.createDataFrame([make(r) for _ in range(12)], schema) for _ in range(3)]
    value = lambda *p: rows(kind.read(kind.merge(union(*p), ["k"]), ["k"]))

    def union(*p):
        out = p[0]
        for x in p[1:]:
            out = out.unionByName(x)
        return out

    want = value(*parts)
    for order in itertools.permutations(parts):
        assert value(*order) == want
    assert value(*parts, *parts) == want
    if kind is not crdt.LWW:
        a = kind.merge(union(parts[0], parts[1]), ["k"]).select(*parts[0].columns)
        assert value(a, parts[2]) == want


def test_lwwset_order(spark):
    df = spark.createDataFrame([(1, "a", 5, 5), (1, "b", 4, 5), (1, "c", 6, None), (1, "d", None, 3), (1, "c", None, 7), (1, "c", 8, None)], "k int, element string, added long, removed long")
    assert rows(crdt.LWWSET.read(crdt.LWWSET.merge(df, ["k"]), ["k"])) == [(1, ["a", "c"])]
    assert crdt.extract(df, 5, "added", "removed").count() == 3 and crdt.extract(df, 0, "added").count() == 6


def store(spark, path):
    return crdt.CrdtStore(spark, f"file://{path}", "k string, ts long, state int", ["k"], {"state": "max(CASE WHEN NOT removed THEN state END)"})


def data(spark, *r):
    return spark.createDataFrame(list(r), "k string, ts long, state int")


def test_store(spark, tmp_path):
    s = store(spark, tmp_path)
    assert s.download().count() == 0
    s.upload(data(spark, ("a", 1, 5), ("b", 2, 7), ("c", 3, 1)))
    s.upload(data(spark, ("a", 4, 3), ("b", 1, 9)))
    s.remove(spark.createDataFrame([("b", 1), ("c", 3), ("x", 9)], "k string, ts long"))
    want = [("a", 4, 5), ("b", 2, 9)]  # removed before the last append; removed at the same time; never there
    assert rows(s.download()) == want
    assert rows(s.download(2)) == [("a", 4, 5)]
    s.consolidate()
    assert rows(s.download()) == want
    s.upload(data(spark, ("c", 8, 2)))
    assert rows(s.download()) == [*want, ("c", 8, 2)]
    s.consolidate()
    assert rows(s.download()) == [*want, ("c", 8, 2)]


def test_store_consolidates_beside_uploads_and_readers(spark, tmp_path, monkeypatch):
    s = store(spark, tmp_path)
    s.upload(data(spark, ("a", 1, 5)))
    reader = s.download()  # planned, not run
    spark.createDataFrame([], s.schema).write.parquet(f"{s.path}/.staging/half")  # an upload in flight is no upload
    real = s.base.publish

    def slow(df, after=None, **more):
        s.upload(data(spark, ("b", 2, 7)))  # comes while the base is made
        return real(df, after, **more)

    monkeypatch.setattr(s.base, "publish", slow)
    s.consolidate()
    monkeypatch.setattr(s.base, "publish", real)
    assert rows(s.download()) == [("a", 1, 5), ("b", 2, 7)] and rows(reader) == [("a", 1, 5)]
    for _ in range(3):
        s.consolidate()
        assert rows(s.download()) == [("a", 1, 5), ("b", 2, 7)]
    assert s._uploads() == [] and len(list((tmp_path / "base").glob("data-*"))) <= 2
    number = s.base.versions.latest()[0]
    with pytest.raises(Stale):  # another one was faster
        s.base.publish(s.download(), number - 1)


def test_scope_removes_what_was_made_in_it(spark):
    outer = session.cut(spark.range(3))
    with session.scope(spark):
        inner, n = session.cut_counting(spark.range(10), F.col("id") > 6)
        assert inner.count() == 10 and n == 3
        with session.scope(spark):
            session.cut(spark.range(2))
    fs, p = session.hadoop_fs(spark, inner.tessera_path)
    assert not fs.exists(p) and outer.count() == 3 and session._made == []


def test_cluster(spark, tmp_path):
    stores = {n: store(spark, tmp_path / n) for n in "pqr"}
    c = crdt.CrdtCluster(stores, copies=2)
    c.upload(data(spark, *[(f"k{i}", i, i) for i in range(30)]))
    whole = rows(c.download())
    assert len(whole) == 30 and rows(c.download(alive=["p", "q"])) == whole
    assert sum(s.download().count() for s in stores.values()) == 60
    c.remove(spark.createDataFrame([("k3", 99)], "k string, ts long"))
    assert c.download().count() == 29
    stores["s"] = store(spark, tmp_path / "s")
    bigger = crdt.CrdtCluster(stores, copies=2)
    for n in "pqr":
        bigger.repartition(n)
    assert rows(bigger.download()) == [w for w in whole if w[0] != "k3"]
    assert stores["s"].download().count() > 0


# -- logs ---------------------------------------------------------------------------------------

LOG = "id long, kind string, v long, at timestamp"


def batch(spark, start, n):
    return spark.range(start, start + n).select("id", F.concat(F.lit("k"), F.col("id") % 3).alias("kind"), F.col("id").alias("v"), F.timestamp_seconds(F.col("id") * 900 + 1_700_000_000).alias("at"))


def test_log_positions(spark, tmp_path):
    log = Multilog(spark, f"file://{tmp_path}/log", LOG)
    ids = lambda df: sorted(r.id for r in df.collect())
    assert log.read()[0].count() == 0 and log.files() == []
    log.write(batch(spark, 0, 20), F.col("id") % 2, F.col("at"))
    first, end = log.read()
    assert first.count() == 20 and log.logs() == ["0", "1"] and {f.split("/")[1] for f in log.files()} >= {"2023-11-14_22"}
    assert set(end) == {"0", "1"} and all(len(p) == 3 for p in end.values())  # bounded, however many files
    log.write(batch(spark, 20, 10), F.col("id") % 2, F.col("at"))
    more, after = log.read(end)
    assert ids(more) == list(range(20, 30))
    assert log.read(after)[0].count() == 0 and log.read(after)[1] == after and log.read(end, logs=["1"])[0].count() == 5
    late = log.write(batch(spark, 30, 2).coalesce(1), F.lit("0"), F.lit("2020-01-01").cast("timestamp"))  # an hour long gone
    assert late[0].split("/")[1] == after["0"][0] and ids(log.read(after)[0]) == [30, 31]
    # one file a round, and from within a file
    seen, at = [], {}
    for _ in range(40):
        rows_, to = log.read(at, ["0"], max_files=1)
        seen, at = seen + ids(rows_), to
    assert sorted(seen) == [*range(0, 30, 2), 30, 31] == ids(log.read(logs=["0"])[0]) or sorted(seen) == ids(log.read(logs=["0"])[0])
    hour, number = at["0"][0], at["0"][1] - 1
    assert ids(log.read({"0": (hour, number, 1)}, ["0"])[0]) == [31]
    hours = sorted({f.split("/")[1] for f in log.files()})
    assert log.read(first_hour=hours[1], end=hours[1])[0].where(F.col("hour") != hours[1]).count() == 0
    assert ids(log.read(end={"0": (hours[0], 0)}, logs=["0"])[0]) == ids(log.read(end=hours[0], logs=["0"])[0])
    damaged = next(f for f in log.files() if f.startswith("1/"))
    name, h, file = damaged.split("/")
    target = tmp_path / "log" / f"log={name}" / f"hour={h}" / file
    (target.parent / f".{file}.crc").unlink(missing_ok=True)
    target.write_bytes(target.read_bytes()[:50])
    assert 20 <= log.read()[0].count() < 32


def test_log_controller(spark, tmp_path):
    log = Multilog(spark, f"file://{tmp_path}/log", LOG)
    cube = Cube(spark, f"file://{tmp_path}/cube", {"kind": "string"}, {"n": ms.count_of(), "v": ms.sum_of()}).with_aggregation("k", ["kind"], ["n", "v"]).with_aggregation("all", ["kind"], ["n"])
    make = lambda c, **more: etl.LogProcessor(c, log, {"kind": "kind"}, {"n": None, "v": "v"}, **more)
    total = lambda: tuple(cube.query(CubeQuery((), ("n", "v"))).totals.first())
    one = etl.LogController(cube, [make(cube, logs=["a"]), make(cube, logs=["b"])], parallel=True)
    log.write(batch(spark, 0, 10), F.when(F.col("id") % 2 == 0, "a").otherwise("b"), F.col("at"))
    assert one.process() and total() == (10, 45) and cube.manifest.sync().version == 1  # both logs and both aggregations in one version
    assert one.process() and total() == (10, 45) and cube.manifest.sync().version == 1
    # two controllers read the same; the second is refused, leaves no file and takes nothing twice
    same = Cube(spark, cube.path, cube.dimensions, cube.measures)
    for n, a in cube.aggregations.items():
        same.with_aggregation(n, list(a.structure.keys), list(a.structure.measures))
    log.write(batch(spark, 10, 5), F.lit("a"), F.col("at"))
    mine, theirs = make(cube).process(), make(same).process()
    cube.commit(mine.diffs[0], positions=mine.positions)
    with pytest.raises(Conflict):
        same.commit(theirs.diffs[0], positions=theirs.positions)
    files = lambda: {str(p) for p in (tmp_path / "cube").rglob("*.parquet")}
    held = {c.file.replace("file:", "").replace("///", "/") for n in cube.aggregations for c in cube.manifest.chunks(n)}
    assert files() == held and total() == (15, sum(range(15)))
    # a failure leaves positions and files as they were
    log.write(batch(spark, 15, 5), F.lit("a"), F.col("at"))
    boom = make(cube, transform=lambda df: df.withColumn("v", F.expr("assert_true(false)").cast("long")))
    with pytest.raises(Exception):
        etl.LogController(cube, [make(cube, logs=["b"]), boom]).process()
    assert {f for f in files() if "_temporary" not in f} == held and total() == (15, sum(range(15)))
    assert not etl.LogController(cube, [make(cube)], overlap_limit=0).process()
    bounded = etl.LogController(cube, [make(cube, max_files=1)])
    assert all(bounded.process() for _ in range(4)) and total() == (20, sum(range(20)))


def test_stream_into_cube_exactly_once(spark, tmp_path):
    log = Multilog(spark, f"file://{tmp_path}/log", LOG)
    cube = Cube(spark, f"file://{tmp_path}/cube", {"kind": "string"}, {"n": ms.count_of(), "v": ms.sum_of()}).with_aggregation("k", ["kind"], ["n", "v"])
    state = f"file://{tmp_path}/state"
    run = lambda: etl.log_to_cube(log.stream(), cube, {"kind": "kind"}, {"n": None, "v": "v"}, state)
    total = lambda: tuple(cube.query(CubeQuery((), ("n", "v"))).totals.first())
    log.write(batch(spark, 0, 10), F.lit("a"), F.col("at"))
    assert run() == 1 and total() == (10, 45)
    assert run() == 0 and total() == (10, 45)
    log.write(batch(spark, 10, 5), F.lit("b"), F.col("at"))
    assert run() == 1 and total() == (15, sum(range(15)))
    # the batch applied, its checkpoint entry lost: it comes again and changes nothing
    for f in (tmp_path / "state" / "commits").iterdir():
        if f.name in ("1", ".1.crc"):
            f.unlink()
    run()
    assert total() == (15, sum(range(15)))
    other = f"file://{tmp_path}/other"  # a checkpoint of its own is a source of its own
    assert etl.log_to_cube(log.stream(), cube, {"kind": "kind"}, {"n": None, "v": "v"}, other) == 1 and total()[0] == 30


def test_splitter(spark):
    df = spark.createDataFrame([(1, [3, 4]), (2, None)], "pub int, adv array<int>")
    split = etl.splitter({"pubs": lambda b: b.select("pub"), "advs": lambda b: b.select("pub", F.explode("adv").alias("adv"))})
    with split(df) as out:
        assert df.is_cached and rows(out["pubs"]) == [(1,), (2,)] and rows(out["advs"]) == [(1, 3), (1, 4)]
    assert not df.is_cached


def test_log_diffs():
    a, b = etl.LogDiff({"x": (0, 5)}, ()), etl.LogDiff({"x": (5, 9), "y": (0, 1)}, ())
    assert a.then(b).positions == {"x": (0, 9), "y": (0, 1)} and a.then(a.inverse()).empty()
    assert etl.winner(etl.LogDiff({"x": (0, 5)}), etl.LogDiff({"x": (0, 7)})) == "right" and etl.winner(a, etl.LogDiff({"z": (0, 1)})) is None
    with pytest.raises(ValueError):
        a.then(a)
    applied = []
    s = etl.LogState(applied.append)
    s.apply(etl.LogDiff({"x": (0, 5)}, ("d",)))
    with pytest.raises(ValueError):
        s.apply(a)
    assert s.positions == {"x": 5} and applied == ["d"]


# -- commit graph -------------------------------------------------------------------------------


class Add:
    def __init__(self, n):
        self.n = n

    def __eq__(self, other):
        return self.n == other.n

    def __repr__(self):
        return f"+{self.n}"


class Put:
    """Sets a value from an expected one; concurrent puts conflict unless one wins."""

    def __init__(self, old, new):
        self.old, self.new = old, new


def system():
    def puts(a, b):
        if a.new == b.new:
            return [], []
        if a.new > b.new:
            return [], [Put(b.new, a.new)]
        return [Put(a.new, b.new)], []

    s = ot.OTSystem().on_transform(Add, Add, lambda a, b: ([b], [a])).on_transform(Put, Put, puts).on_transform(Put, Add, lambda a, b: ([b], [a]))
    s.on_squash(Add, Add, lambda a, b: Add(a.n + b.n)).on_squash(Put, Put, lambda a, b: Put(a.old, b.new))
    s.on_invert(Add, lambda d: [Add(-d.n)]).on_invert(Put, lambda d: [Put(d.new, d.old)])
    return s.on_empty(Add, lambda d: d.n == 0).on_empty(Put, lambda d: d.old == d.new)


class State:
    def __init__(self):
        self.sum, self.value = 0, 0

    def apply(self, d):
        if isinstance(d, Add):
            self.sum += d.n
        else:
            assert d.old == self.value
            self.value = d.new


def replay(diffs):
    s = State()
    for d in diffs:
        s.apply(d)
    return s.sum, s.value


def graph(repo):
    """1 - 2 - 3 - 5, 2 - 4, 1 - 6: three heads."""
    for id, parents in ((1, {}), (2, {1: [Add(1)]}), (3, {2: [Add(2), Put(0, 7)]}), (4, {2: [Put(0, 5), Add(4)]}), (5, {3: [Add(8)]}), (6, {1: [Add(16)]})):
        repo.push(repo.make(id, parents))
    repo.update_heads([4, 5, 6])
    return repo


def test_squash_and_transform():
    s = system()
    assert s.squash([Add(1), Add(-1)]) == [] and s.squash([Add(1), Add(2), Add(0)]) == [Add(3)]
    left, right = [Add(1), Put(0, 3)], [Put(0, 9), Add(5)]
    after_left, after_right = s.transform(left, right)
    assert replay(left + after_left) == replay(right + after_right) == (6, 9)
    assert replay(left + s.invert(left)) == (0, 0)


def test_graph_algorithms():
    repo, s = graph(ot.Repository()), system()
    assert [c.id for c in ot.walk(repo, [5, 4])][:1] == [5]
    assert ot.find_any_common_parent(repo, [5, 4]) == 2 and ot.find_any_common_parent(repo, [5, 6]) == 1 and ot.find_any_common_parent(repo, [5, 3]) == 3
    assert ot.exclude_parents(repo, [1, 2, 3, 4]) == {3, 4}
    assert replay(ot.path_diffs(repo, s, 1, 5)) == (11, 7)
    with pytest.raises(LookupError):
        ot.path_diffs(repo, s, 4, 5)
    assert replay(ot.checkout(repo, s, 4) + ot.diff(repo, s, 4, 5)) == (11, 7)
    ot.save_snapshot(repo, s, 3)
    assert replay(ot.checkout(repo, s, 5)) == (11, 7) and ot.find_parent(repo, [5], lambda c: c.level <= 2) == 2
    assert ot.find_cut(repo, [5, 4], lambda f: all(repo.load(x).level <= 2 for x in f)) == {2}
    copy = ot.Repository()
    ot.copy(repo, copy)
    assert copy.heads() == {4, 5, 6} and replay(ot.checkout(copy, s, 5)) == (11, 7)
    assert set(ot.load_graph(repo, [4])) == {1, 2, 4}


def test_merge_makes_all_heads_equal():
    repo, s = graph(ot.Repository()), system()
    merged = ot.merge(repo, s, repo.heads())
    ends = {replay(ot.checkout(repo, s, h) + d) for h, d in merged.items()}
    assert ends == {(31, 7)}
    ids = iter(range(100, 200))
    head = ot.merge_and_push(repo, s, lambda: next(ids))
    assert repo.heads() == {head} and replay(ot.checkout(repo, s, head)) == (31, 7) and repo.load(head).is_merge
    assert ot.merge_and_push(repo, s, lambda: next(ids)) == head
    repo.cleanup(repo.load(head).level)
    assert repo.load(head).id == head and pytest.raises(KeyError, repo.load, 1)


def test_common_parents_equal_brute_force():
    r = random.Random(6)
    for _ in range(60):
        repo, n = ot.Repository(), r.randrange(2, 14)
        repo.push(repo.make(0, {}))
        for i in range(1, n):
            repo.push(repo.make(i, {p: [] for p in r.sample(range(i), min(i, r.choice([1, 1, 2, 3])))}))
        nodes = r.sample(range(n), r.randrange(1, min(n, 4) + 1))
        before = {k: ot.ancestors(repo, k) for k in range(n)}
        latest = lambda group: {a for a in group if not any(a != b and a in before[b] for b in group)}
        assert ot.exclude_parents(repo, nodes) == latest(set(nodes))
        assert ot.find_all_common_parents(repo, nodes) == latest(set.intersection(*(before[k] for k in nodes)))
    assert ot.exclude_parents(repo, []) == set()


def test_criss_cross_merge():
    repo, s = ot.Repository(), system()
    for id, parents in ((1, {}), (2, {1: [Add(1)]}), (3, {1: [Add(2)]}), (4, {2: [Add(2), Add(4)], 3: [Add(1), Add(4)]}), (5, {2: [Add(2), Add(8)], 3: [Add(1), Add(8)]})):
        repo.push(repo.make(id, parents))
    repo.update_heads([4, 5])
    assert ot.find_all_common_parents(repo, [4, 5]) == {2, 3}
    assert {replay(ot.checkout(repo, s, h) + d) for h, d in ot.merge(repo, s, [4, 5]).items()} == {(15, 0)}


def test_state_managers_meet():
    repo, s, ids = ot.Repository(), system(), iter(range(1, 100))
    repo.push(repo.make(0, {}))
    repo.update_heads([0])
    a, b = State(), State()
    x, y = (ot.StateManager(repo, s, st.apply, lambda: next(ids)) for st in (a, b))
    x.checkout(), y.checkout()
    x.add(Add(1), Put(0, 4))
    y.add(Put(0, 6), Add(10))
    x.sync(), y.sync(), x.sync()
    assert (a.sum, a.value) == (b.sum, b.value) == (11, 6) and x.revision == y.revision
    x.add(Add(5))
    x.reset()
    assert a.sum == 11


def test_table_repository(spark, tmp_path):
    encode = lambda d: ["a", d.n] if isinstance(d, Add) else ["p", d.old, d.new]
    decode = lambda v: Add(v[1]) if v[0] == "a" else Put(v[1], v[2])
    open_it = lambda: ot.TableRepository(spark, f"file://{tmp_path}/g", encode, decode)
    repo, s = graph(open_it()), system()
    ot.save_snapshot(repo, s, 3)
    again = open_it()
    assert again.heads() == {4, 5, 6} and replay(ot.checkout(again, s, 5)) == (11, 7)
    with pytest.raises(Exception):
        again.push(again.make(6, {1: []}))
    lazy = open_it()
    assert lazy._commits == {} and replay(ot.checkout(lazy, s, 5)) == (11, 7) and set(lazy._commits) == {3, 5}  # from the snapshot on
    lazy.update_heads([7], [4])
    assert again.heads() == {5, 6, 7}
    small = ot.TableRepository(spark, f"file://{tmp_path}/g", encode, decode, kept=2)
    assert [small.load(i).id for i in (1, 2, 3, 1)] == [1, 2, 3, 1] and len(small._commits) == 2
    lazy.cleanup(3)
    assert lazy.load_snapshot(3) is not None and replay(ot.checkout(open_it(), s, 5)) == (11, 7)
    with pytest.raises(Exception):
        open_it().load(1)


def test_chunk_conflicts():
    c = [Chunk(str(i), 1, (), (), ()) for i in range(4)]
    s = ot.chunk_system()
    a, b = ChunkDiff(frozenset([c[3]]), frozenset(c[:2])), ChunkDiff(frozenset(), frozenset(c[:1]))
    with pytest.raises(ot.Conflict) as e:
        s.transform([a], [b])
    assert e.value.winner == "left"
    assert s.transform([a], [ChunkDiff(frozenset(c[2:3]))])[0] == [ChunkDiff(frozenset(c[2:3]))]
    x, y = CubeDiff({"p": a}), CubeDiff({"p": b, "q": ChunkDiff(frozenset(c[2:3]))})
    assert x.conflicts(y) and x.then(x.inverse()).empty() and y.then(x).parts["q"] == y.parts["q"] and set(y.added()) == {c[2]}
    assert s.squash([x, x.inverse()]) == []

"""Problems 1 to 6 against brute force on dirty fixtures, and their edge cases."""

import datetime
import json

import pytest

import commit_store as cs
from tessera.operators import changefeed, drift, flatten, hierarchy, ledger, orphans
from tessera import session, versions
from tessera.session import cut
from pyspark.sql import functions as F


@pytest.fixture(scope="module", params=[5, 11])
def data(request, spark):
    diffs, revisions = cs.store(request.param)
    return diffs, revisions, spark.createDataFrame(diffs, cs.DIFFS).repartition(3), spark.createDataFrame(revisions, cs.REVISIONS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], cs.DIFFS), spark.createDataFrame([], cs.REVISIONS)


def rows(df):
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got)), "rows are repeated"
    return set(got)


def test_p1_changes(data):
    diffs, revisions, d, r = data
    want = cs.p1(diffs, revisions)
    assert {w[4] for w in want} >= {"renamed", "retyped", "added", "removed"}
    assert rows(drift.found_changes(d, r)) == want


def test_p1_consistent_tables(data):
    diffs, revisions, d, r = data
    chunks = drift.consistent_chunks(d, r)
    assert chunks.count() == sum(1 for x in diffs for _ in cs.chunks(x[2])) + sum(1 for x in revisions for _ in cs.chunks(x[3]))
    assert chunks.where("id IS NULL").count() == 0
    assert chunks.where("count = 5").count() > 0 and chunks.where("file_no > 3 AND count IS NOT NULL").count() > 0
    assert drift.consistent_positions(d, r).where("to_pos IS NULL").count() == 0


def drifting(spark, files):
    """Tables in which file i of shard 1 holds the entries ``files[i]``, one text each."""
    texts = [(100 * i + k, 0, json.dumps([e]), "r", 1, i, 100 * i + k, cs.START, "t", "p", 1) for i, entries in enumerate(files, 1) for k, e in enumerate(entries)]
    return spark.createDataFrame(texts, cs.DIFFS), spark.createDataFrame([], cs.REVISIONS)


def with_chunks(*chunks, **fields):
    return [{**fields, "positions": [], "ops": [{"a": {"added": [c]}}]} for c in chunks]


def test_p1_links_roll_outs_and_retyped_renames(spark):
    old, new = {"id": 1, "min": [1], "max": [5], "count": 3}, {"id": 2, "bounds": {"min": [2], "max": [6]}, "rows": "4"}
    half = {"id": 3, "min": [3], "max_key": [7], "rows": "8"}
    d, r = drifting(spark, [with_chunks(old, old), with_chunks({**old, "count": None, "rows": "3"}), with_chunks({**half, "max": [5], "max_key": None}, {**half}), with_chunks({**half}, {**half, "min": None, "max_key": None, "bounds": {"min": [2], "max": [6]}}), with_chunks({**new})])
    got = drift.consistent_chunks(d, r)
    assert got.where("min IS NULL OR max IS NULL OR count IS NULL").count() == 0 and dict(got.dtypes)["count"] == "bigint" and dict(got.dtypes)["min"] == "array<bigint>"
    names = {x.path: (x.canonical, x.n_values, x.is_linked) for x in drift.spellings(d, r).collect()}
    chunk = "ops.*.chunk."
    assert names[chunk + "max_key"] == (chunk + "max", 2, True) and names[chunk + "rows"] == (chunk + "count", 6, True)
    assert names[chunk + "bounds.min"] == (chunk + "min", 2, True) and names[chunk + "bounds.max"] == (chunk + "max", 2, True)


def test_p1_names_held_together_or_that_could_be_two_fields_are_not_linked(spark):
    old = {"id": 1, "min": [1], "max": [5], "size": 1}
    d, r = drifting(spark, [with_chunks(old), with_chunks({"id": 2, "lo": [1], "hi": [5], "tier": 2}), with_chunks({**old, "tier": 4})])
    names = {x.path: (x.canonical, x.is_linked) for x in drift.spellings(d, r).collect()}
    assert not any(names["ops.*.chunk." + n][1] for n in ("lo", "hi", "min", "max", "tier", "size"))


def test_p1_fields_without_a_cast_of_their_own_have_columns(spark):
    first = with_chunks({"id": 1, "min": [1], "max": [2], "count": 1})
    for e in first:
        e["positions"] = [{"log": "a", "from": ["f", 0, 1], "to": {"file": "f", "rem": 0, "pos": 2}, "shift": 1.5}]
    second = with_chunks({"id": 2, "min": [1], "max": [2], "count": 1, "codec": "z", "cold": True, "row_count": 9, "extra": {"a": 1, "b": [1, {"x": 1}]}})
    d, r = drifting(spark, [first, second])
    got = drift.consistent_chunks(d, r).orderBy("id").collect()
    assert [(x.codec, x.cold, x["count"], x.row_count, x.extra_a, x.extra_b) for x in got] == [(None, None, 1, None, None, None), ("z", True, 1, 9, 1, '[1,{"x":1}]')]
    place = drift.consistent_positions(d, r)
    assert place.first()["shift"] == 1.5 and place.first()["to_pos"] == 2


def test_p1_entries_with_their_fields(data, spark):
    d, r = drifting(spark, [with_chunks({"id": 1}), with_chunks({"id": 2}, note="n", meta={"slot": 3, "ver": "1"}, epoch=7)])
    got = drift.consistent_entries(d, r).orderBy("file_no")
    assert [(x.entry_no, x.n_positions, x.n_ops, x.note, x.meta_slot, x.meta_ver, x.epoch) for x in got.collect()] == [(0, 0, 1, None, None, None, None), (0, 0, 1, "n", 3, "1", 7)]
    diffs, revisions, d, r = data
    values = [v for ok, v in map(cs.readable, [x[2] for x in diffs] + [x[3] for x in revisions]) if ok]
    assert drift.consistent_entries(d, r).count() == sum(1 if isinstance(v, dict) else len(v) if isinstance(v, list) else 0 for v in values)


def test_p1_casts_come_from_the_alias_table(spark):
    chunk = {"id": 1, "at": ["f", 0, 1], "tags": ["a", "b"], "key": [1, 2], "ok": True, "size": 5, "rate": 0.5, "zip": "007", "mixed": 1}
    other = {"id": "2", "at": "g-3@4", "tags": "c,d", "key": {"adv": 8, "day": 7}, "size": 6.0, "rate": 2, "zip": "12", "mixed": "x"}
    third = {"id": 3.0, "at": {"file": "h", "rem": 5, "pos": 6}, "tags": [], "key": "3|4", "size": "7", "ok": None, "mixed": [1]}
    usual = {"id": 4, "key": {"day": 5, "adv": 6}}
    d, r = drifting(spark, [with_chunks(chunk), with_chunks(other), with_chunks(third, usual, {**usual, "id": 5})])
    got = drift.consistent_chunks(d, r).orderBy("id")
    types = dict(got.dtypes)
    assert (types["id"], types["tags"], types["key"], types["ok"], types["size"], types["rate"], types["zip"], types["mixed"]) == ("bigint", "array<string>", "array<bigint>", "boolean", "bigint", "double", "string", "string")
    a, b, c, e, _ = got.collect()
    assert [(x.id, x.at_file, x.at_rem, x.at_pos, x.tags, x.key, x.ok, x.size, x.rate, x.zip, x.mixed) for x in (a, b, c)] == [
        (1, "f", 0, 1, ["a", "b"], [1, 2], True, 5, 0.5, "007", "1"), (2, "g", 3, 4, ["c", "d"], [7, 8], None, 6, 2.0, "12", "x"), (3, "h", 5, 6, [], [3, 4], None, 7, None, None, "[1]"),
    ]
    assert e.key == [5, 6]  # the order in which most objects write the names
    assert {x.path: x.cast for x in drift.spellings(d, r).collect()}["ops.*.chunk.key"] == "array<bigint>"


def test_p1_names_that_clash_or_are_odd(spark):
    chunk = {"id": 1, "n": 5, "N": "x", "it's": 2, "a`b": 3, "meta": {"k": 1, "K": 2}}
    e = with_chunks(chunk, note="a", Note=2, **{"we'd": True})
    for x in e:
        x["positions"] = [{"log": "l", "Log": 7}]
    d, r = drifting(spark, [e])
    got = drift.consistent_chunks(d, r)
    assert got.columns[-7:] == ["N", "a`b", "id", "it's", "meta_K", "meta_k_", "n_"] and tuple(got.first())[-7:] == ("x", 3, 1, 2, 2, 1, 5)
    assert tuple(drift.consistent_positions(d, r).first())[-2:] == (7, "l") and tuple(drift.consistent_entries(d, r).first())[-5:] == (1, 1, 2, "a", True)
    assert {tuple(x)[:2] for x in drift.found_changes(d, r).collect()} == set()


def test_p1_casts(spark):
    texts = [('["f",1,2]',), ('{"file":"f","rem":1,"pos":2}',), ("f-1@2",), (None,)]
    got = spark.createDataFrame(texts, "x string").select(drift.log_place("x").alias("p")).collect()
    assert [None if g.p is None else tuple(g.p) for g in got] == [("f", 1, 2)] * 3 + [None]
    numbers = spark.createDataFrame([("[1,2]",), ("1|2",), ('{"adv":2,"day":1}',), ('{"b":1,"a":2}',), ("[1,2.0]",), ("x|2",), (None,)], "x string").select(drift.list_of_numbers("x", [("day", "adv"), ("p", "q")]).alias("p")).collect()
    assert [g.p for g in numbers] == [[1, 2], [1, 2], [1, 2], [1, 2], [1, 2], [None, 2], None]
    counts = spark.createDataFrame([("5",), ("5.0",), ("x",)], "x string").select(drift.as_number("x").alias("p")).collect()
    assert [g.p for g in counts] == [5, 5, None]


def test_p2_live_chunks(data, monkeypatch):
    monkeypatch.setattr(changefeed, "FLUSH_STATES", 20)
    monkeypatch.setattr(changefeed, "BATCH_ROWS", 7)
    diffs, _, d, _ = data
    assert rows(changefeed.live_chunks(d)) == cs.p2(diffs)


def test_p2_upsert_order_ties_and_tombstones(spark):
    feed = [("a", 1, None, True, "x"), ("a", 1, None, True, "x"), ("a", 3, 0, False, None), ("a", 2, 9, True, "y"), (None, 1, 1, True, "z"), ("b", None, 1, True, "z"), ("c", 5, 1, True, "k"), ("c", 5, None, False, None)]
    df = spark.createDataFrame(feed, "k string, s long, s2 long, live boolean, v string")
    got = {r.k: (r.live, r.v) for r in changefeed.upsert(df.repartition(4), ["k"], ["s", "s2"], payload=["v"]).collect()}
    assert got == {"a": (False, None), "c": (True, "k")}


def test_p2_applied_in_parts_out_of_order(data, spark, tmp_path, monkeypatch):
    diffs, _, d, _ = data
    feed = changefeed.chunk_feed(d)
    state = changefeed.BucketedState(spark, f"file://{tmp_path}/s", ["repo", "aggregation", "chunk_id"], ["revision_id", "ref", "entry_no", "op_no", "step"])
    for i, part in enumerate((feed.where("revision_id % 3 = 1"), feed.where("revision_id % 3 = 0"), feed.limit(0), feed.where("revision_id % 3 = 1"), feed.where("revision_id % 3 = 2"))):
        assert state.apply(part, 7) == i + 1
    live = lambda v=None: rows(state.read(v).where("live").select("repo", "aggregation", "chunk_id", "revision_id"))
    assert live() == cs.p2(diffs) and live(3) == live(2) != live(1)
    before = state._held()[1]["parts"]
    state.apply(feed.where("repo = 'b' AND aggregation = 'x.y' AND chunk_id = 3"))
    after = state._held()[1]["parts"]
    assert sum(before[b] != after[b] for b in before) <= 1  # only the touched bucket is written anew
    assert live() == cs.p2(diffs)
    state.cleanup(1, 0)
    assert live() == cs.p2(diffs) and len(state.versions.numbers()) == 1
    monkeypatch.setattr(changefeed, "STATE_BYTES", 300)
    state.apply(feed.limit(3))
    assert state._held()[1]["buckets"] > 7 and live() == cs.p2(diffs)  # it grew: cut anew
    state.apply(feed.limit(0))
    assert live() == cs.p2(diffs)


def test_p2_null_is_below_every_value_and_types(spark):
    import datetime

    at = datetime.datetime(2024, 1, 1)
    feed = [("a", at, -(2**40), True, b"x"), ("a", at, None, False, b"y"), ("b", at, None, True, b"z"), ("b", None, 1, False, b"q")]
    df = spark.createDataFrame(feed, "k string, s timestamp_ntz, s2 long, live boolean, v binary")
    assert {r.k: (r.live, bytes(r.v), r.s2) for r in changefeed.upsert(df.repartition(3), ["k"], ["s", "s2"], payload=["v"]).collect()} == {"a": (True, b"x", -(2**40)), "b": (True, b"z", None)}


def test_p2_publish_is_atomic(spark, tmp_path):
    table = changefeed.PublishedTable(spark, f"file://{tmp_path}/t")
    assert table.publish(spark.range(3)) == 1
    assert table.publish(spark.range(5)) == 2
    assert table.read().count() == 5 and table.read(1).count() == 3
    with pytest.raises(Exception):
        table.publish(spark.range(5).select((1 / (F.col("id") - 4)).alias("boom"), F.expr("assert_true(id < 0)").alias("v").cast("string")))
    assert table.read().count() == 5


def test_p3_orphans(data, spark):
    diffs, revisions, d, r = data
    backup = [(3, 0, 1, None, None), (151, 0, 1, None, None), (85, 0, 1, None, None), (None, 0, 1, None, None)]
    b = spark.createDataFrame(backup, "id long, epoch int, level long, snapshot string, timestamp timestamp")
    want = cs.p3(diffs, revisions, backup)
    assert rows(orphans.orphan_references(d, r, b)) == want
    counts = orphans.orphan_counts(d, r, b).collect()
    assert sum(c.n_missing + c.n_deleted + c.n_late for c in counts) == len(want)


def runs_table(spark):
    at = cs.START
    log = [(1, 2, "ok"), (2, 3, "failed"), (3, 3, "killed"), (4, 3, "ok"), (5, 3, "ok"), (6, 6, "ok")]
    return log, spark.createDataFrame([(i, at + datetime.timedelta(hours=i), None, f, s) for i, f, s in log], "run_id int, started_at timestamp, finished_at timestamp, last_file int, status string")


def test_p4_changed_ids(data, spark):
    _, revisions, _, r = data
    log, runs = runs_table(spark)
    assert rows(ledger.changed_ids(r, runs)) == cs.p4(revisions, log) == rows(ledger.live_ids(r, runs))
    assert ledger.live_ids(r, runs.where("status <> 'ok'")).count() == 0


def test_p4_one_run_at_a_time_equals_the_replay(data, spark):
    _, revisions, _, r = data
    log, _ = runs_table(spark)
    state = spark.createDataFrame([], "id long").join(ledger.versions(r).select("id", "version").limit(0), "id")
    got, seen = set(), 0
    for run, last, status in log:
        if status != "ok":
            continue
        files = spark.createDataFrame([(f, run) for f in range(seen + 1, last + 1)], "file_no int, run_id int")
        moved = cut(ledger.progress(r, files, state=state))
        got |= {(x.run_id, x.id) for x in moved.where("changed").collect()}
        merged = state.unionByName(moved.select("id", "version")).groupBy("id").agg(F.max("version").alias("version"))
        state, seen = cut(merged), max(seen, last)
    assert got == cs.p4(revisions, log)


@pytest.mark.parametrize("layers", [1, 8])
def test_p4_runs_that_die_and_writers_that_come_late(data, spark, tmp_path, layers):
    _, revisions, _, r = data
    runner = ledger.IncrementalRunner(spark, f"file://{tmp_path}/inc", lease_seconds=10, max_layers=layers)
    with pytest.raises(LookupError):
        runner.changed()
    assert runner.run("w1", 1, r, [1, 2], 0) == 2
    token, taken = runner.begin("w2", [1, 2, 3], 100)  # publishes everything, then dies
    assert taken == ["3"]
    late = runner.work(2, r, token, taken, 100)
    assert runner.run("w3", 3, r, [1, 2, 3], 105) == 0  # its lease still holds
    assert runner.run("w4", 4, r, [1, 2, 3], 111) == 1  # taken over, from the state of run 1
    assert runner.ledger.results()[-1]["moved"] == late["moved"]  # the same path: what was there is taken as it is
    with pytest.raises(ledger.StaleWriter):
        runner.finish(token, taken, late, 112)
    with pytest.raises(ledger.StaleWriter):  # refused before it writes anything
        runner.work(2, r, token, taken, 112)
    assert runner.run("w5", 5, r, [1, 2, 3], 200) == 0
    assert runner.run("w6", 6, r, range(1, 7), 300) == 3
    log = [(1, 2, "ok"), (2, 3, "killed"), (4, 3, "ok"), (5, 3, "ok"), (6, 6, "ok")]
    assert rows(runner.changed()) == cs.p4(revisions, log)
    runner.cleanup()
    assert rows(runner.changed()) == cs.p4(revisions, log)


def test_p4_a_lease_that_runs_out_during_the_work(data, spark, tmp_path):
    _, _, _, r = data
    times = iter([0.0, 1.0, 50.0])
    runner = ledger.IncrementalRunner(spark, f"file://{tmp_path}/inc", lease_seconds=10, clock=lambda: next(times))
    with pytest.raises(ledger.StaleWriter):
        runner.run("slow", 1, r, [1])
    assert not (tmp_path / "inc" / "moved").exists() and runner.ledger.results() == []
    assert ledger.IncrementalRunner(spark, runner.path).run("next", 2, r, [1]) == 1


def test_p4_two_live_runs_on_different_files(data, spark, tmp_path):
    _, revisions, _, r = data
    runner = ledger.IncrementalRunner(spark, f"file://{tmp_path}/inc")
    assert runner.run("w1", 1, r, [1, 2], 0) == 2
    a, files_a = runner.begin("a", [3], 1)
    b, files_b = runner.begin("b", [3, 4], 2)
    assert (files_a, files_b) == (["3"], ["4"])
    from_a, from_b = runner.work(2, r, a, files_a, 3), runner.work(3, r, b, files_b, 3)
    runner.finish(a, files_a, from_a, 4)
    with pytest.raises(ledger.StaleWriter):  # it doesn't know what a did
        runner.finish(b, files_b, from_b, 5)
    runner.finish(b, files_b, runner.work(3, r, b, files_b, 6), 7)
    assert runner.run("w4", 4, r, range(1, 7), 8) == 2
    log = [(1, 2, "ok"), (2, 3, "ok"), (3, 4, "ok"), (4, 6, "ok")]
    assert rows(runner.changed()) == cs.p4(revisions, log)


def test_p4_replay_goes_on_where_it_died(data, spark, tmp_path, monkeypatch):
    _, revisions, _, r = data
    log, runs = runs_table(spark)
    root = f"file://{tmp_path}/runs"
    real, calls = ledger.WorkLedger.complete, []

    def dies(self, token, names, now, result=None, after=None):
        if self.versions.path and len(calls) == 1:
            raise OSError("lost")
        calls.extend([1] if self.versions.path else [])
        real(self, token, names, now, result, after)

    monkeypatch.setattr(ledger.WorkLedger, "complete", dies)
    with pytest.raises(OSError):
        ledger.changed_ids(r, runs, root)
    monkeypatch.setattr(ledger.WorkLedger, "complete", real)
    for _ in range(2):
        assert rows(ledger.changed_ids(r, runs, root)) == cs.p4(revisions, log)


@pytest.mark.parametrize("kept", [False, True])
def test_p4_ledger(spark, tmp_path, kept):
    led = ledger.WorkLedger(spark, f"file://{tmp_path}/ledger") if kept else ledger.WorkLedger()
    led.add(["a", "b"])
    led.add(["b", "c"])
    one, taken = led.lease("w1", 0, 10)
    assert taken == ["a", "b", "c"]
    assert led.lease("w2", 5, 10)[1] == []
    led.complete(one, ["a"], 5)
    two, taken = led.lease("w2", 11, 10)  # the lease of b and c is over
    assert taken == ["b", "c"] and two > one
    with pytest.raises(ledger.StaleWriter):
        led.complete(one, ["b"], 12)
    with pytest.raises(ledger.StaleWriter):
        led.check(one, ["b"], 12)
    led.check(two, ["b"], 12)
    led.release(two, ["c"], 12)
    led.complete(two, ["b"], 12)
    assert {i.item: i.state for i in led.items()} == {"a": "done", "b": "done", "c": "pending"}
    with pytest.raises(ledger.StaleWriter):
        led.complete(two, ["c"], 12)


def test_versions(spark, tmp_path):
    v = versions.Versions(spark, f"file://{tmp_path}/v", kept=3)
    assert v.latest() == (0, None)
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / ".000000000001-x").write_text('{"n')  # a writer that died
    for n in range(1, 7):
        v.add(n, {"n": n})
    assert v.numbers() == [4, 5, 6] and v.latest() == (6, {"n": 6})
    with pytest.raises(versions.Stale):  # two writers of one version: the second loses
        v.add(6, {"n": 0})
    with pytest.raises(versions.Stale):  # far behind: its version existed and was pruned
        v.add(2, {"n": 0})
    assert v.numbers() == [4, 5, 6] and v.read(6) == {"n": 6}
    assert v.change(lambda held: {"n": held["n"] + 1}) == (7, {"n": 7})
    assert v.change(lambda held: None) == (7, {"n": 7})


def test_versions_by_rename(spark, tmp_path):
    """The way taken where there are no hard links."""
    a, b = tmp_path / "a", tmp_path / "b"
    for p in (a, b):
        p.mkdir()
        (p / "x").write_text(p.name)
    assert versions.move_new(spark, f"file://{a}", f"file://{tmp_path}/c") and not versions.move_new(spark, f"file://{b}", f"file://{tmp_path}/c")
    assert (tmp_path / "c" / "x").read_text() == "a" and (b / "x").exists()
    (tmp_path / "f").write_text("f")
    as_path = lambda n: session.hadoop_fs(spark, f"file://{tmp_path}/{n}")[1]
    assert versions._rename_new(spark, as_path("f"), as_path("g")) and not versions._rename_new(spark, as_path("g"), as_path("c/x"))


def test_p5_contradictions(data):
    diffs, revisions, d, r = data
    want = cs.p5(diffs, revisions)
    assert {w[3] for w in want} >= {"cycle", "below_cycle"}
    assert rows(hierarchy.contradictions(d, r)) == want


def test_p5_shapes(spark):
    links = [(1, None), (2, 1), (3, 2), (4, 3), (5, 4), (9, 9), (10, 9), (20, 21), (21, 22), (22, 20), (30, 22), (31, 30), (6, 5), (6, 1)]
    df = spark.createDataFrame([(a, b) for a, b in links], "revision_id long, parent_id long")
    h = {r.id: (r.root, r.depth, r.kind, r.path) for r in hierarchy.hierarchy(hierarchy.parent_links(df), True).collect()}
    assert h[6] == (1, 5, "tree", "1/2/3/4/5/6") and h[1] == (1, 0, "tree", "1")
    assert h[9] == (9, 0, "cycle", "9") and h[10] == (9, 1, "below_cycle", "9/10")
    assert h[21][:3] == (20, 0, "cycle") and h[31] == (20, 2, "below_cycle", "22/30/31")
    pairs = {tuple(r) for r in hierarchy.closure(hierarchy.parent_links(df)).collect()}
    assert (1, 6, 5) in pairs and (4, 6, 2) in pairs and len(pairs) == 1 + 2 + 3 + 4 + 5


def test_p5_descendants_on_and_below_circles(spark):
    links = [(2, 1), (3, 2), (9, 9), (10, 9), (8, 8), (20, 21), (21, 22), (22, 20), (30, 22), (31, 30), (40, 20), *[(50 + i, 49 + i) for i in range(1, 12)], (50, 61), (70, 57), (71, 70), *[(80 + i, 79 + i) for i in range(1, 9)], (80, 31)]
    df = spark.createDataFrame(links, "revision_id long, parent_id long")
    parent, want = dict(links), set()
    for node in parent:
        at, far = parent.get(node), 1
        while at is not None and far <= len(links):
            want |= {(at, node, far)} if at != node and not any(w[:2] == (at, node) for w in want) else set()
            at, far = parent.get(at), far + 1
    assert rows(hierarchy.descendants(hierarchy.parent_links(df))) == want
    counts: dict = {}
    for at, _, far in want:
        n, height = counts.get(at, (0, 0))
        counts[at] = n + 1, max(height, far)
    assert {r.id: (r.n_descendants, r.height) for r in hierarchy.descendant_counts(hierarchy.parent_links(df)).collect()} == counts


def test_p5_long_chain_with_a_hub(spark):
    links = [(i, i - 1) for i in range(2, 300)] + [(1000 + i, 299) for i in range(200)] + [(2, None)]
    df = spark.createDataFrame(links, "revision_id long, parent_id long")
    got = {r.id: r.depth for r in hierarchy.hierarchy(hierarchy.parent_links(df)).collect()}
    assert got[299] == 298 and got[1100] == 299 and len(got) == 499
    counts = {r.id: (r.n_descendants, r.height) for r in hierarchy.descendant_counts(hierarchy.parent_links(df)).collect()}
    assert counts[1] == (498, 299) and counts[299] == (200, 1) and counts[150] == (349, 150) and 1100 not in counts


def test_p6_chunks(data):
    diffs, revisions, d, r = data
    assert rows(flatten.chunks_found(d, r)) == cs.p6(diffs, revisions)


def test_p6_places_and_nulls(spark):
    text = '[null,{"ops":[null,{"a":null,"b":{"added":[null,{"id":"7"},{"id":8.0},{"id":"x"}],"removed":null}}],"positions":null}]'
    df = spark.createDataFrame([(1, text)], "k long, t string")
    nested = flatten.parsed(df, "t", {"k": F.col("k")}, flatten.commit_schema(["id"], ["log"]))
    got = {tuple(r) for r in flatten.chunks_table(nested, ["k"], ["id"]).collect()}
    assert got == {(1, 1, 1, "b", "added", 1, 7), (1, 1, 1, "b", "added", 2, 8), (1, 1, 1, "b", "added", 3, None)}
    assert [tuple(r) for r in flatten.entries_table(nested, ["k"]).collect()] == [(1, 1, 0, 2)]
    assert flatten.positions_table(nested, ["k"], ["log"]).count() == 0
    assert [tuple(r) for r in flatten.operations_table(nested, ["k"]).collect()] == [(1, 1, 1, "b", 4, 0)]


def test_p6_tables_hold_every_field(spark):
    text = '[{"note":"n","meta":{"ver":"1"},"positions":[{"log":"a","upto":["f",0,2],"lag":3},{"log":"b","from":[1],"to":[2]}],"ops":[{"a":{"added":[{"id":"x","n":5,"min":[1]},null],"removed":[{"id":7}]}}]}]'
    df = spark.createDataFrame([(1, text)], "k long, t string")
    keep = {"k": F.col("k")}
    assert [tuple(r) for r in flatten.whole_entries(df, "t", keep).collect()] == [(1, 0, 2, 1, '{"note":"n","meta":"{\\"ver\\":\\"1\\"}"}')]
    bare = spark.createDataFrame([(1, ' {"note":"n","ops":[]}')], "k long, t string")
    assert [tuple(r) for r in flatten.whole_entries(bare, "t", keep).collect()] == [(1, 0, 0, 0, '{"note":"n"}')]
    assert {tuple(r) for r in flatten.whole_positions(df, "t", keep).collect()} == {(1, 0, 0, "a", None, None, '{"upto":"[\\"f\\",0,2]","lag":"3"}'), (1, 0, 1, "b", "[1]", "[2]", None)}
    assert {tuple(r) for r in flatten.whole_chunks(df, "t", keep).collect()} == {(1, 0, 0, "a", "added", 0, None, "x", "[1]", None, None, None, '{"n":"5"}'), (1, 0, 0, "a", "removed", 0, 7, "7", None, None, None, None, None)}


def test_p6_readable_texts_only(spark):
    good = '[{"ops":[{"a":{"added":[{"id":1}]}}]}]'
    texts = [good, good[1:-1], json.dumps(good), json.dumps(good[1:-1]), f" \n{good}\t", f" {json.dumps(good)} ", "[]", '"[]"', "5", '"5"', "null", '"null"', "{}", '[{"ops":5}]', '{"ops":{"a":1}}', '[{"ops":[{"a":{"added":[{"id":2}]}}],"positions":7}]', "[5,null]"]
    texts += [good + x for x in ("]", "}", "x", ",", " 1", ',"k":[]', "}{", f",{good}", '"')] + [x + good for x in ("]", "}", "x", ",", "1,", '"k":', '"')]
    texts += ["", " ", '"', '""', '"x', json.dumps(json.dumps(good)), json.dumps(good + "]"), json.dumps(good)[:-1], f"{json.dumps(good)},1", json.dumps(good) + '"', good.replace('"', "'"), '[{"ops":[NaN]}]', '"[NaN]"', good[:-1], "[{]", '[{"ops":[}]', '[{"a":1}}]', None]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    nested = flatten.parsed(df, "t", {"k": F.col("k")}, flatten.commit_schema(["id"], ["log"]))
    got = {r.k: r.entries for r in nested.collect()}
    for i, t in enumerate(texts):
        ok, value = cs.readable(t)
        value = [value] if isinstance(value, dict) else value
        want = [v for v in value if isinstance(v, dict)] if ok and isinstance(value, list) else []
        assert len([e for e in got.get(i) or [] if e is not None]) == len(want), (t, got.get(i))
    found = {r.k: r.n for r in flatten.chunks_table(nested, ["k"], ["id"]).groupBy("k").agg(F.count("*").alias("n")).collect()}
    assert found == {i: 1 for i, t in enumerate(texts) if i < 6 or i == 15}


def test_p6_quoted_text_after_many_blanks(spark):
    text = "\t\r\n " * 50 + json.dumps('[{"ops":[{"a":{"added":[{"id":7}]}}]}]')
    nested = flatten.parsed(spark.createDataFrame([(1, text)], "k long, t string"), "t", {"k": F.col("k")}, flatten.commit_schema(["id"]))
    assert [r.chunk_id for r in flatten.chunks_table(nested, ["k"], ["id"]).collect()] == [7]


def test_p6_very_long_text(spark):
    long = "[" + ",".join('{"positions":[],"ops":[{"daily":{"added":[{"id":%d}]}}]}' % i for i in range(20_000)) + "]"
    df = spark.createDataFrame([(1, long)], "k long, t string")
    nested = flatten.parsed(df, "t", {"k": F.col("k")}, flatten.commit_schema(["id"]))
    assert flatten.chunks_table(nested, ["k"], ["id"]).agg(F.countDistinct("chunk_id")).first()[0] == 20_000


def test_empty_tables(spark, empty):
    d, r = empty
    b = spark.createDataFrame([], "id long, epoch int, level long, snapshot string, timestamp timestamp")
    _, runs = runs_table(spark)
    for df in (drift.found_changes(d, r), drift.consistent_chunks(d, r), drift.consistent_positions(d, r), changefeed.live_chunks(d), orphans.orphan_references(d, r, b), orphans.orphan_counts(d, r, b), ledger.changed_ids(r, runs), ledger.changed_ids(r, runs.limit(0)), hierarchy.contradictions(d, r), flatten.chunks_found(d, r)):
        assert df.count() == 0

"""A small random commit store with every kind of dirt, and the plain-Python answers to problems 1 to 6."""

from __future__ import annotations

import datetime
import json
import random
from collections import defaultdict

DIFFS = "revision_id long, parent_id long, diff string, repo string, shard int, file_no int, feed_seq long, arrived_at timestamp, tab string, path string, id long"
REVISIONS = "id long, epoch int, level long, snapshot string, type string, timestamp timestamp, created_by string, repo string, shard int, file_no int, feed_seq long, arrived_at timestamp, revision_id long"
START = datetime.datetime(2024, 1, 1)


def chunk(r: random.Random, file_no: int):
    c = {"id": r.randrange(30)}
    if r.random() < 0.2:
        c["id"] = str(c["id"])
    c["rows" if file_no > 3 else "count"] = r.choice([5, 5.5, "7", None])
    if r.random() < 0.3:
        c["sealed"] = r.choice([True, None])
    if file_no == 5:
        c["bounds"] = {"min": [1, 2], "max": [3]}
    else:
        c["min"] = [1, 2]
    return c


def value(r: random.Random, file_no: int):
    entries = []
    for _ in range(r.randrange(3)):
        ops = []
        for _ in range(r.randrange(3)):
            op = {}
            for name in r.sample(["daily", "by site", "x.y"], r.randrange(3)):
                sides = {"added": [chunk(r, file_no) for _ in range(r.randrange(3))]}
                if r.random() < 0.4:
                    sides["removed"] = r.choice([None, [], [chunk(r, file_no)]])
                op[name] = sides
            ops.append(op)
        e = {"positions": [{"log": "a", "to" if file_no < 4 else "upto": ["f", 0, 1]}], "ops": ops}
        entries.append(e)
    return entries[0] if len(entries) == 1 and r.random() < 0.5 else entries


def text(r: random.Random, file_no: int):
    v = value(r, file_no)
    t = json.dumps(v, indent=r.choice([None, 1]))
    kind = r.random()
    if kind < 0.1:
        return json.dumps(t)
    if kind < 0.25:
        return r.choice([None, "", t[: len(t) // 2] + "{", t + ",{", t.replace(":", "=", 1) + "=", "[1],[2]", "{'a': 1}", json.dumps(t[:-1]), "null", "3"])
    return t


def store(seed: int = 5, n: int = 300):
    r = random.Random(seed)
    diffs, revisions = [], []
    for seq in range(n):
        revision = r.choice([None, r.randrange(1, 150), r.randrange(1, 150), 7])
        file_no = r.randrange(1, 7)
        diffs.append((revision, r.choice([None, 0, -1, 7, *[r.randrange(1, 155) for _ in range(6)]]), text(r, file_no), r.choice(["hot", "hot", "b", None]), r.choice([1, 2, None]), file_no, seq, START + datetime.timedelta(days=seq % 70), "t", "p", 1))
        if r.random() < 0.3:
            diffs.append(diffs[-1])
        if r.random() < 0.6:
            id = r.randrange(1, 150)
            revisions.append((id, id % 3, id % 5, text(r, file_no) if r.random() < 0.3 else None, r.choice(["NEW", "HEAD", None]), r.choice([None, START + datetime.timedelta(hours=r.randrange(50))]), r.choice([None, "x"]), "hot", r.choice([1, 2]), file_no, seq, START, 5))
    for a, b in ((160, 161), (161, 162), (162, 160), (163, 162), (164, 164), (165, 164)):  # circles
        diffs.append((a, b, None, "b", 1, 1, n, START, "t", "p", 1))
    return diffs, revisions


def readable(t):
    """(True, value) of a readable text."""

    def refuse(x):
        raise ValueError(x)

    try:
        v = json.loads(t, parse_constant=refuse)
        if isinstance(v, str):
            v = json.loads(v, parse_constant=refuse)
    except (TypeError, ValueError):
        return False, None
    return True, v


def chunks(t):
    ok, v = readable(t)
    if isinstance(v, dict):
        v = [v]
    if not ok or not isinstance(v, list):
        return
    for en, e in enumerate(v):
        for on, o in enumerate(e.get("ops") or []):
            for name, sides in o.items():
                for action in ("added", "removed"):
                    for c in sides.get(action) or []:
                        yield en, on, name, action, int(c["id"])


def ref(p):
    return p if p is not None and p > 0 else 0


def p6(diffs, revisions):
    out = {("ot_diffs", d[0], ref(d[1]), *c) for d in diffs for c in chunks(d[2])}
    return out | {("ot_revisions", r[0], 0, *c) for r in revisions for c in chunks(r[3])}


def p2(diffs):
    events = []
    for d in diffs:
        if d[0] is not None and d[3] is not None:
            events += [(d[0], ref(d[1]), en, on, action == "added", (d[3], name, id)) for en, on, name, action, id in chunks(d[2])]
    live = {}
    for revision, _, _, _, added, key in sorted(events):
        if added:
            live[key] = revision
        else:
            live.pop(key, None)
    return {(*k, v) for k, v in live.items()}


def p3(diffs, revisions, backup):
    first, saved, refs = {}, {b[0] for b in backup}, {}
    for r in revisions:
        first[r[0]] = min(first.get(r[0], 99), r[9])
    for d in diffs:
        for field, id in (("parent_id", d[1]), ("revision_id", d[0])):
            if id is not None and id > 0:
                f, at = refs.get((field, d[0], id), (99, datetime.datetime(9999, 1, 1)))
                refs[field, d[0], id] = (min(f, d[5]), min(at, d[7]))
    out = set()
    for (field, revision, id), (f, at) in refs.items():
        kind = None
        if id not in first:
            kind = "deleted" if id in saved else "missing"
        elif first[id] > f:
            kind = "late"
        if kind:
            out.add((field, revision, id, kind, at.strftime("%Y-%m")))
    return out


def p4(revisions, runs):
    out, before = set(), {}
    for run, last_file, status in runs:
        if status != "ok":
            continue
        now = {}
        for r in revisions:
            if r[9] <= last_file:
                rank = (r[5] is not None, r[5] or START, r[10])
                if r[0] not in now or now[r[0]][0] < rank:
                    now[r[0]] = (rank, (r[1], r[2], r[4], r[6], r[3] is None))
        out |= {(run, id) for id, (_, v) in now.items() if id not in before or before[id][1] != v}
        before = now
    return out


def p5(diffs, revisions):
    parent, nodes = {}, set()
    for d in diffs:
        if d[0] is not None:
            nodes.add(d[0])
            if ref(d[1]):
                nodes.add(d[1])
                parent[d[0]] = max(parent.get(d[0], 0), d[1])
    level = {r[0]: r[2] for r in revisions}
    out = set()
    for n in nodes:
        way = [n]
        while way[-1] in parent and parent[way[-1]] not in way:
            way.append(parent[way[-1]])
        if way[-1] in parent:
            k = way.index(parent[way[-1]])
            out.add((n, min(way[k:]), k, "below_cycle" if k else "cycle"))
        elif n in level and way[-1] in level and level[n] != level[way[-1]] + len(way) - 1:
            out.add((n, way[-1], len(way) - 1, "level"))
    return out


KINDS = {str: "string", int: "int", float: "double", bool: "boolean", list: "array", dict: "object"}


def fields(v, path, out):
    if isinstance(v, list):
        for x in v:
            fields(x, path, out)
    elif isinstance(v, dict):
        for name, x in v.items():
            if x is None:
                continue
            if path == "ops":
                fields(x, "ops.*", out)
                continue
            p = f"{path}.{name}" if path else name
            out[p].add(KINDS[type(x)])
            fields(x, "ops.*.chunk" if p in ("ops.*.added", "ops.*.removed") else p, out)


def p1(diffs, revisions):
    files = defaultdict(lambda: defaultdict(set))
    for tab, shard, file_no, t in [("ot_diffs", d[4], d[5], d[2]) for d in diffs] + [("ot_revisions", r[8], r[9], r[3]) for r in revisions]:
        ok, v = readable(t)
        if ok:
            fields(v, "", files[tab, shard, file_no])
    out = set()
    above = lambda p: p.rpartition(".")[0]
    for tab, shard in {k[:2] for k in files}:
        numbers = sorted(k[2] for k in files if k[:2] == (tab, shard))
        for a, b in zip(numbers, numbers[1:]):
            old, new = files[tab, shard, a], files[tab, shard, b]
            out |= {(tab, shard, b, p, "retyped", "") for p in old if p in new and old[p] != new[p]}
            gone, came = [p for p in old if p not in new], [p for p in new if p not in old]
            for under in {above(p) for p in gone + came}:
                g, c = [p for p in gone if above(p) == under], [p for p in came if above(p) == under]
                if len(g) == len(c) == 1 and old[g[0]] == new[c[0]]:
                    out.add((tab, shard, b, g[0], "renamed", c[0]))
                else:
                    out |= {(tab, shard, b, p, "removed", "") for p in g} | {(tab, shard, b, p, "added", "") for p in c}
    return out

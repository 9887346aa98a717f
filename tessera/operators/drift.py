"""Problem 1: schemas that drift between files, by a catalogue of column lifespans.

1. Each file's "footer", the fields that its readable texts have and their JSON types, is taken
   from the texts in one pass; every task hands on each (file, field, type) once, so a hot
   producer doesn't grow the shuffle.
2. The footers are exploded to (producer, field, set of types, file). Numbered files and
   ``lag`` give islands: the lifespans of a field with one set of types in one producer.
3. Starts and endings of lifespans are the changes: both for one field is 'retyped', a single
   ending and a single start under one parent with equal types is 'renamed', the others are
   'removed' and 'added'.
4. The changes, and the names that entries, positions and chunks hold one by one, give an alias
   table, from every spelling of a field to its first one, with the type that holds all values of the field
   in whatever shape any file writes them. The columns and casts that read all files into one consistent
   table are generated from it: no field's name or type is written here. A spelling that can't be linked is a
   field, and a column, of its own; ``spellings`` lists all of them with their types and numbers of values.

Only the catalogue is collected to the driver, and only to write the casts: it has one row per
spelling of a field and per pair of spellings, whatever the number of rows or files.

Defined results: NULL, empty and unreadable texts have no fields, and a file without a readable
text is no file; NULL producers or file numbers are groups of their own; fields with only NULL
values don't exist; further columns aren't read.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import flatten
from tessera.session import cut, discard

FOOTER = "tab string, shard int, file_no int, path string, kind string"

#: Paths that are keys of data, not fields, and what the path of their elements is called.
AGGREGATIONS, CHUNK_LISTS, CHUNK = "ops", ("ops.*.added", "ops.*.removed"), "ops.*.chunk"
POSITION, ENTRY = "positions", ""

#: Marks the rows of ``_contents`` that are records: ``kind`` is this and the path of the records.
RECORD = "#"


def _refuse(name: str) -> None:
    raise ValueError(name)


def _whole(text: str | None):
    """The value of a readable text; raises ValueError or RecursionError for others."""
    value = json.loads(text, parse_constant=_refuse)
    return json.loads(value, parse_constant=_refuse) if isinstance(value, str) else value


_KINDS = {str: "string", int: "int", float: "double", bool: "boolean", list: "array", dict: "object"}


def _fields(value, path: str, found: set) -> None:
    """Adds (path, type) of all fields below ``value``; list levels have no name."""
    if type(value) is list:
        for x in value:
            if type(x) is dict or type(x) is list:
                _fields(x, path, found)
        return
    dictionary = path == AGGREGATIONS
    for name, x in value.items():
        if x is None:
            continue
        below = "ops.*" if dictionary else f"{path}.{name}" if path else name
        kind = type(x)
        if not dictionary:
            found.add((below, _KINDS[kind]))
        if kind is dict or kind is list:
            _fields(x, CHUNK if below in CHUNK_LISTS else below, found)


def _footers(batches: Iterator) -> Iterator:
    """(tab, shard, file_no, path, kind), each once per task; path '' says that the file has a readable text."""
    import pyarrow as pa

    seen: dict[tuple, set] = {}
    for batch in batches:
        tab, shard, file_no, text = (c.to_pylist() for c in batch.columns)
        for t, s, f, x in zip(tab, shard, file_no, text):
            found: set = {("", "")}
            try:
                value = _whole(x)
                if type(value) is dict or type(value) is list:
                    _fields(value, "", found)
            except (ValueError, RecursionError):
                continue
            seen.setdefault((t, s, f), set()).update(found)
    rows = [(*file, *field) for file, fields in seen.items() for field in fields]
    types = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]
    for i in range(0, len(rows), 10_000):
        cols = zip(*rows[i : i + 10_000])
        yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(cols, types)], ["tab", "shard", "file_no", "path", "kind"])


class _TextShapes(dict):
    """What texts are: 'number', 'fraction', 'numbers' joined by '|', 'place' (file-rem@pos) or 'text'."""

    KEPT = 100_000

    def __missing__(self, x: str) -> str:
        if re.fullmatch(r"\s*[-+]?\d+(\.0*)?\s*", x):
            shape = "number"
        elif re.fullmatch(r"\s*[-+]?\d*\.?\d+([eE][-+]?\d+)?\s*", x):
            shape = "fraction"
        elif re.fullmatch(r"-?\d+(\|-?\d+)+", x):
            shape = "numbers"
        else:
            shape = "place" if re.fullmatch(r".*-\d+@\d+", x) else "text"
        if len(self) >= self.KEPT:
            self.clear()
        if len(x) <= 100:
            self[x] = shape
        return shape


_TEXTS = _TextShapes()
_LISTS = {frozenset(["number"]): "numbers", frozenset(["text"]): "names", frozenset(["text", "number"]): "place", frozenset(["fraction"]): "fractions", frozenset(["number", "fraction"]): "fractions"}


def _scalar(x) -> str:
    """The shape of a value in a list or object, by its type alone."""
    if isinstance(x, bool):
        return "boolean"
    if isinstance(x, int):
        return "number"
    return ("number" if x.is_integer() else "fraction") if isinstance(x, float) else "text"


def _shape(x) -> str:
    """What a value is, however it is written; '' if it doesn't tell. An object's shape ends with the order of its names."""
    if isinstance(x, str):
        return _TEXTS[x]
    if not isinstance(x, (list, dict)):
        return _scalar(x)
    parts = list(x if isinstance(x, list) else x.values())
    if any(isinstance(y, (list, dict)) for y in parts):
        return ""
    shape = _LISTS.get(frozenset(_scalar(y) for y in parts if y is not None), "")
    return shape if isinstance(x, list) or not shape else f"{shape}:{','.join(x)}"


def _kept(record: dict) -> tuple:
    """What tells records apart that don't give the same names and shapes."""
    out = []
    for k, x in record.items():
        kind = type(x)
        if kind is str:
            out.append((k, _TEXTS[x]))
        elif kind is dict:
            out.append((k, _kept(x)))
        elif kind is list:
            out.append((k, frozenset(map(type, x)) if float not in map(type, x) else _shape(x)))
        elif x is not None:
            out.append((k, _scalar(x)))
    return tuple(out)


def _named(record: dict, path: str, skip: tuple = ()) -> list:
    found = []
    for k, x in record.items():
        if x is not None and k not in skip:
            below = f"{path}.{k}" if path else k
            found.append([below, _shape(x)])
            if type(x) is dict:
                found += _named(x, below)
    return found


def _records(value) -> Iterator[tuple[str, dict]]:
    """(path, record) of all entries, positions and chunks."""
    for e in value if type(value) is list else [value]:
        if type(e) is not dict:
            continue
        yield ENTRY, {k: x for k, x in e.items() if k not in (AGGREGATIONS, POSITION)}
        positions, ops = e.get(POSITION), e.get(AGGREGATIONS)
        for p in positions if type(positions) is list else ():
            if type(p) is dict:
                yield POSITION, p
        for o in ops if type(ops) is list else ():
            for sides in o.values() if type(o) is dict else ():
                for name in ("added", "removed") if type(sides) is dict else ():
                    chunks = sides.get(name)
                    for c in chunks if type(chunks) is list else ():
                        if type(c) is dict:
                            yield CHUNK, c


def _contents(batches: Iterator) -> Iterator:
    """Rows of ``_footers`` and, as (tab, shard, file_no, names, '#' and the path, n), how many records hold just these names."""
    import pyarrow as pa

    seen: dict[tuple, set] = {}
    records: Counter = Counter()
    example: dict[tuple, str] = {}
    for batch in batches:
        tab, shard, file_no, text = (c.to_pylist() for c in batch.columns)
        for t, s, f, x in zip(tab, shard, file_no, text):
            found: set = {("", "")}
            try:
                value = _whole(x)
                if type(value) is dict or type(value) is list:
                    _fields(value, "", found)
                    for path, record in _records(value):
                        key = (t, s, f, path, _kept(record))
                        records[key] += 1
                        if key not in example:
                            example[key] = json.dumps(sorted(_named(record, path)))
            except (ValueError, RecursionError):
                continue
            seen.setdefault((t, s, f), set()).update(found)
    rows = [(*file, *field, 0) for file, fields in seen.items() for field in fields]
    rows += [(*key[:3], example[key], RECORD + key[3], n) for key, n in records.items()]
    types = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64()]
    for i in range(0, len(rows), 10_000):
        cols = zip(*rows[i : i + 10_000])
        yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(cols, types)], ["tab", "shard", "file_no", "path", "kind", "n"])


def _texts(diffs: DataFrame, revisions: DataFrame) -> DataFrame:
    texts = diffs.select(F.lit("ot_diffs").alias("tab"), "shard", "file_no", F.col("diff").alias("text")).unionByName(
        revisions.select(F.lit("ot_revisions").alias("tab"), "shard", "file_no", F.col("snapshot").alias("text"))
    )
    return texts.where("text IS NOT NULL AND text <> ''")


def footers(diffs: DataFrame, revisions: DataFrame) -> DataFrame:
    """(tab, shard, file_no, path, types) of all files; ``types`` is the sorted set, joined by '|'."""
    return _footer(_texts(diffs, revisions).mapInArrow(_footers, FOOTER))


def _footer(raw: DataFrame) -> DataFrame:
    return raw.groupBy("tab", "shard", "file_no", "path").agg(F.array_join(F.array_sort(F.collect_set("kind")), "|").alias("types"))


def lifespans(footer: DataFrame) -> DataFrame:
    """Runs of consecutive files in which a field of a producer had one set of types.

    (tab, shard, path, types, start_no, end_no, start_file, end_file, after_file): files are numbered
    from 1 in each producer; ``after_file`` is the file after the last one, NULL if there is none.
    """
    files = Window.partitionBy("tab", "shard").orderBy("file_no")
    numbered = footer.withColumn("no", F.dense_rank().over(files))  # each file has its row with path ''
    following = Window.partitionBy("tab", "shard").orderBy("no").rangeBetween(1, 1)
    numbered = numbered.withColumn("next_file", F.min("file_no").over(following)).where("path <> ''")
    field = Window.partitionBy("tab", "shard", "path", "types").orderBy("no")
    gap = F.coalesce(F.col("no") - F.lag("no").over(field), F.lit(0)) != 1
    islands = numbered.withColumn("island", F.sum(F.when(gap, 1).otherwise(0)).over(field))
    spans = islands.groupBy("tab", "shard", "path", "types", "island").agg(
        F.min("no").alias("start_no"), F.max("no").alias("end_no"), F.min("file_no").alias("start_file"), F.max("file_no").alias("end_file"),
        F.max_by("next_file", "no").alias("after_file"),
    )
    return spans.drop("island")


def changes(footer: DataFrame) -> DataFrame:
    """(tab, shard, file_no, path, change, new_path, types): each start and ending of a lifespan after the producer's first file."""
    marks = F.array(
        F.struct(F.lit("start").alias("event"), F.when(F.col("start_no") > 1, F.col("start_file")).alias("file_no")),
        F.struct(F.lit("end").alias("event"), F.col("after_file").alias("file_no")),
    )
    events = lifespans(footer).select("tab", "shard", "path", "types", F.inline(marks)).where("file_no IS NOT NULL")
    one = lambda kind: F.max(F.when(F.col("event") == kind, F.col("types")))
    per_field = events.groupBy("tab", "shard", "file_no", "path").agg(one("start").alias("new_types"), one("end").alias("old_types"))
    above = F.expr("left(path, length(path) - length(substring_index(path, '.', -1)) - 1)")
    placed = per_field.withColumn("parent", F.when(F.contains("path", F.lit(".")), above).otherwise(""))
    under = Window.partitionBy("tab", "shard", "file_no", "parent")
    gone, come = F.col("new_types").isNull(), F.col("old_types").isNull()
    pair = (
        (F.count(F.when(gone, 1)).over(under) == 1)
        & (F.count(F.when(come, 1)).over(under) == 1)
        & (F.max(F.when(gone, F.col("old_types"))).over(under) == F.max(F.when(come, F.col("new_types"))).over(under))
    )
    judged = placed.select("*", pair.alias("pair"), F.max(F.when(come, F.col("path"))).over(under).alias("came"))
    renamed = F.col("pair") & gone
    change = F.when(~gone & ~come, "retyped").when(renamed, "renamed").when(gone, "removed").otherwise("added")
    return judged.where(~(F.col("pair") & come)).select(
        "tab", "shard", "file_no", "path", change.alias("change"), F.when(renamed, F.col("came")).otherwise("").alias("new_path"),
        F.coalesce("new_types", "old_types").alias("types"),
    )


def found_changes(diffs: DataFrame, revisions: DataFrame) -> DataFrame:
    """Every change of a field from one file of a producer to the next."""
    footer = cut(footers(diffs, revisions), "footers")
    return changes(footer).select("tab", "shard", "file_no", "path", "change", "new_path")


# -- one consistent table -----------------------------------------------------------------


@dataclass(frozen=True)
class Alias:
    """A spelling of a field, the name that its values get and the type that holds those of all spellings."""

    path: str
    canonical: str
    types: str
    values: int
    cast: str
    orders: tuple = ()  # of the names in objects that stand for lists, the usual order of each set of names


#: Fields of the form that the first files have (as the store's description gives it); two of them are never one field.
FIRST_FORM = frozenset([*(f"{CHUNK}.{n}" for n in ("id", "min", "max", "count", "measures")), *(f"{POSITION}.{n}" for n in ("log", "from", "to"))])

PLACE = "struct<file:string,rem:bigint,pos:bigint>"


def cast_of(types: set[str], shapes: set[str]) -> str:
    """The type that holds all values of a field with these JSON types and shapes without loss; STRING, the text as it is, if nothing better does.

    What was never anything but a text stays one. Whole numbers are BIGINT even if some files write them with a point, unless all do.
    """
    if types <= {"string"} or not shapes:
        return "string"
    if shapes <= {"boolean"}:
        return "boolean"
    if shapes <= {"number", "fraction"}:
        return "double" if "fraction" in shapes or types == {"double"} else "bigint"
    if shapes <= {"numbers", "fractions", "number"}:  # a list of one may be written as its element
        return "array<double>" if "fractions" in shapes else "array<bigint>"
    if shapes <= {"names", "text"} and "array" in types:
        return "array<string>"
    return PLACE if shapes <= {"place"} else "string"


def roll_outs(records: DataFrame) -> DataFrame:
    """(old, new, files) of names that take turns: a name that starts in a producer while every record that lacks it still has the old one.

    ``records`` are (tab, shard, file_no, below, names, n). The old name must be in at least half
    of the records of the file before, and both together in as great a part (up to a twentieth)
    of the first file of the new one. The old name may stay in that file, and later, or be gone.
    """
    where = ["tab", "shard", "below"]
    numbered = records.withColumn("no", F.dense_rank().over(Window.partitionBy(*where).orderBy("file_no")))
    total = numbered.groupBy(*where, "no").agg(F.sum("n").alias("total"))
    held = numbered.select(*where, "no", "n", F.explode("names").alias("path")).groupBy(*where, "no", "path").agg(F.sum("n").alias("held"))
    same = lambda a, b, *cols: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in cols]
    counted = held.alias("h").join(total.alias("t"), same("h", "t", *where, "no")).select("h.*", "total")
    first = counted.withColumn("start", F.min("no").over(Window.partitionBy(*where, "path"))).where("no = start AND start > 1")
    new, old, still = first.withColumn("before", F.col("no") - 1).alias("b"), counted.alias("a"), held.alias("s")
    turn = new.join(old, [*same("a", "b", *where), F.col("a.no") == F.col("b.before"), F.col("a.path") != F.col("b.path")])
    turn = turn.join(still, [*same("s", "b", *where, "no"), F.col("s.path") == F.col("a.path")], "left")
    both = F.coalesce("s.held", F.lit(0)) + F.col("b.held")
    whole = (F.col("a.held") * 2 >= F.col("a.total")) & (both <= F.col("b.total")) & (both * F.col("a.total") * 20 >= F.col("a.held") * F.col("b.total") * 19)
    return turn.where(whole).groupBy(F.col("a.path").alias("old"), F.col("b.path").alias("new")).agg(F.count("*").alias("files"))


def _links(footer: DataFrame, change_log: DataFrame) -> list[tuple[str, str]]:
    """Names that follow each other in one file, by the change log."""
    split = [F.substring_index("path", ".", -1).alias("leaf"), F.expr("left(path, length(path) - length(substring_index(path, '.', -1)))").alias("parent")]
    gone = change_log.where("change = 'removed'").select("tab", "shard", "file_no", "path", "types", *split).alias("g")
    come = change_log.where("change = 'added'").select("tab", "shard", "file_no", "path", "types", *split).alias("c")
    same_file = (F.col("g.tab") == F.col("c.tab")) & F.col("g.shard").eqNullSafe(F.col("c.shard")) & (F.col("g.file_no") == F.col("c.file_no"))
    moved = F.expr("g.leaf = c.leaf AND (startswith(c.parent, g.parent) OR startswith(g.parent, c.parent))")
    alike = F.expr("g.parent = c.parent AND g.types = c.types AND (contains(c.leaf, g.leaf) OR contains(g.leaf, c.leaf))")
    moves = gone.join(come, same_file).where(moved | alike).select(F.col("g.path").alias("old"), F.col("c.path").alias("new"))
    links = change_log.where("change = 'renamed'").select(F.col("path").alias("old"), F.col("new_path").alias("new")).unionByName(moves).distinct()
    return sorted((r["old"], r["new"]) for r in links.collect())


def alias_table(footer: DataFrame, change_log: DataFrame, records: DataFrame, apart_always: frozenset = FIRST_FORM) -> list[Alias]:
    """Every spelling of a field with its canonical path and type.

    Renames lead to the older name. Where several fields under one parent change at once, the
    catalogue says removed and added; a removed and an added field of one producer and file are
    still the same field if it moved one level deeper or higher under its name, or if one name
    holds the other ('max' and 'max_key') and the types agree. Names that take turns from record
    to record (``roll_outs``) are one field if their values have one shape, however written; of
    several old names the one with the same or a like name counts, then the only one, else none.
    Names that one record holds together are never one field, nor are two of ``apart_always``. The older of two names is the one
    seen in the earliest file, then the one in more files.
    """
    all_types = F.array_distinct(F.flatten(F.collect_set(F.split("types", r"\|"))))
    spellings = footer.where("path <> ''").groupBy("path").agg(F.min("file_no").alias("first"), F.count("*").alias("files"), F.array_join(F.array_sort(all_types), "|").alias("types"))
    seen = {r["path"]: r for r in spellings.collect()}
    own: dict[str, set] = {}
    orders: dict[str, Counter] = {}
    values: Counter = Counter()
    for r in records.select("n", F.explode("fields").alias("f")).groupBy("f.name", "f.shape").agg(F.sum("n").alias("n")).collect():
        shape, _, order = r["shape"].partition(":")
        values[r["name"]] += r["n"]
        own.setdefault(r["name"], set()).update({shape} - {""})
        if order:
            orders.setdefault(r["name"], Counter())[tuple(order.split(","))] += r["n"]
    alike = {"text": "names", "fraction": "number", "fractions": "numbers"}  # what can stand for the same
    shapes = {n: {alike.get(x, x) for x in found} for n, found in own.items()}
    pairs = records.select(F.explode("names").alias("a"), "names").select("a", F.explode("names").alias("b")).where("a < b").distinct().collect()
    together = {(r["a"], r["b"]) for r in pairs}
    turns = roll_outs(records.select("tab", "shard", "file_no", "below", "names", "n")).collect()
    group = {p: {p} for p in seen}

    def apart(a: str, b: str) -> bool:
        return any((min(x, y), max(x, y)) in together or x in apart_always and y in apart_always for x in group[a] for y in group[b])

    def link(a: str, b: str) -> None:
        if group[a] is not group[b] and not apart(a, b):
            both = group[a] | group[b]
            for p in both:
                group[p] = both

    for old, new in _links(footer, change_log):
        link(old, new)
    parted = lambda p: p.rpartition(".")[::2]

    def likeness(old: str, new: str) -> int:
        (a, x), (b, y) = parted(old), parted(new)
        if x == y:
            return 2 if a.startswith(b) or b.startswith(a) else 0
        return 1 if a == b and (x in y or y in x) else 0

    possible = {(r["old"], r["new"]): r["files"] for r in turns if r["old"] in seen and r["new"] in seen and shapes.get(r["old"], set()) & shapes.get(r["new"], set())}
    for least in (2, 1):
        for old, new in sorted(possible, key=lambda k: (-possible[k], k)):
            if likeness(old, new) == least:
                link(old, new)
    left = True
    while left:  # a link can leave one candidate for another name
        left = False
        for old, new in sorted(possible, key=lambda k: (-possible[k], k)):
            a, b = parted(old)[0], parted(new)[0]
            if a != b or group[old] is group[new] or apart(old, new):
                continue
            olds = {min(group[x]) for x, y in possible if y in group[new] and x not in group[new] and parted(x)[0] == a and not apart(x, y)}
            rivals = {y for x, y in possible if x in group[old] and (min(y, new), max(y, new)) in together and parted(y)[0] == a and not apart(x, y)}
            if len(olds) == 1 and not rivals:
                link(old, new)
                left = True
    older = lambda p: (seen[p]["first"], -seen[p]["files"], p)

    def usual(members: set) -> tuple:
        """Of each set of names the order in which most objects write it."""
        counted: Counter = sum((orders.get(p, Counter()) for p in sorted(members)), Counter())
        best: dict[frozenset, tuple] = {}
        for order, _ in sorted(counted.items(), key=lambda o: (-o[1], o[0])):
            best.setdefault(frozenset(order), order)
        return tuple(sorted(best.values()))

    def cast(members: set) -> str:
        return cast_of({t for p in members for t in seen[p]["types"].split("|")}, set().union(*[own.get(p, set()) for p in members]))

    return [Alias(p, min(group[p], key=older), seen[p]["types"], values[p], cast(group[p]), usual(group[p])) for p in sorted(seen)]


class _Reading:
    """How the fields of a record are read as texts: as a struct of the names wanted, or, where names differ only in case, as a map of all."""

    def __init__(self, fields: Sequence[Field], always: Sequence[str] = ()):
        self.fields = list(fields)
        self.heads = sorted({*always, *(x.partition(".")[0] for f in fields for x in f.spellings)})
        self.as_map = len({h.lower() for h in self.heads}) < len(self.heads)

    def schema(self) -> str:
        return "map<string,string>" if self.as_map else "struct<" + ",".join(f"{_quoted(h)}:string" for h in self.heads) + ">"

    def _get(self, record: str, head: str) -> str:
        return f"{record}[{_literal(head)}]" if self.as_map else f"{record}.{_quoted(head)}"

    def reads(self, record: str) -> str:
        """The SQL that reads each field under ``t_`` and its place, after what comes before it in a struct: the first spelling that isn't NULL."""
        out = ""
        for i, f in enumerate(self.fields):
            gets = []
            for spelling in f.spellings:
                head, _, rest = spelling.partition(".")
                got = self._get(record, head)
                gets.append(f"get_json_object({got}, {_literal('$' + ''.join(f"['{x}']" for x in rest.split('.')))})" if rest else got)
            out += f", coalesce({', '.join(gets)}) AS t_{i}"
        return out


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _level(path: str) -> str | None:
    """The record that a path is a field of; None for the lists that hold the records."""
    if path.startswith(CHUNK + "."):
        return CHUNK
    if path.startswith(POSITION + "."):
        return POSITION
    return None if path in (POSITION, AGGREGATIONS) or path.startswith(AGGREGATIONS + ".") else ENTRY


@dataclass(frozen=True)
class Field:
    """A column of a consistent table: how its values are spelled in the files and what they become."""

    name: str
    spellings: tuple
    cast: str
    orders: tuple


def _fields_of(aliases: list[Alias], below: str) -> list[Field]:
    """The columns of entries, positions or chunks, generated from the alias table.

    An object whose spellings are always objects is read as the fields in it; the fields in any
    other object belong to its value.
    """
    at = f"{below}." if below else ""
    mine = [a for a in aliases if _level(a.path) == below]
    groups: dict[str, list[Alias]] = {}
    for a in mine:
        groups.setdefault(a.canonical, []).append(a)
    of = {a.path: a.canonical for a in mine}
    value = lambda canonical: any(a.types != "object" for a in groups[canonical])

    def inside(path: str) -> bool:
        above = [path[:i] for i in range(len(at), len(path)) if path[i] == "."]
        return any(a in of and value(of[a]) for a in above)

    out = []
    for canonical, own in groups.items():
        has_fields = any(p.startswith(f"{a.path}.") for a in own for p in of)
        if all(inside(a.path) for a in own) or has_fields and not value(canonical):
            continue
        spelled = sorted(own, key=lambda a: (a.path != canonical, a.path))
        out.append(Field(canonical[len(at) :].replace(".", "_"), tuple(a.path[len(at) :] for a in spelled), own[0].cast, own[0].orders))
    return out


def _columns(fields: list[Field], taken: Sequence[str]) -> list[Column]:
    """Each field, cast under ``v_`` and its place, under a name that isn't taken; a place is three columns."""
    names, out = {t.lower() for t in taken}, []

    def free(name: str) -> str:
        while name.lower() in names:
            name += "_"
        names.add(name.lower())
        return name

    for i, f in enumerate(fields):
        value = F.col(f"v_{i}")
        parts = [(f"{f.name}_{part}", value[part]) for part in ("file", "rem", "pos")] if f.cast == PLACE else [(f.name, value)]
        out += [v.alias(free(n)) for n, v in parts]
    return out


def _cast(name: str, field: Field) -> Column:
    if field.cast == "bigint":
        return as_number(name)
    if field.cast in ("double", "boolean"):
        return F.col(name).try_cast(field.cast)
    if field.cast in ("array<bigint>", "array<double>"):
        return list_of_numbers(name, field.orders, field.cast)
    if field.cast == "array<string>":
        return list_of_names(name)
    return log_place(name) if field.cast == PLACE else F.col(name)


def as_number(name: str) -> Column:
    """A whole number written as int, double or text."""
    return F.expr(f"try_cast(try_cast(`{name}` AS DECIMAL(38,6)) AS BIGINT)")


_KEY, _OBJECT = r"^\s*\[", r"^\s*\{"


def list_of_numbers(name: str, orders: Sequence[tuple] = (), cast: str = "array<bigint>") -> Column:
    """A list from a JSON list of numbers, from an object of numbers, or from numbers joined by '|'.

    An object with exactly the names of one of ``orders`` gives its numbers in that order, another one in the
    order they are written in. What isn't a number becomes NULL.
    """
    # between numbers stand only commas or bars, so lists needn't be parsed again
    texts = F.when(F.col(name) == "[]", F.array().cast("array<string>")).otherwise(F.split(F.translate(name, "[] ", ""), "[,|]"))
    if orders:
        held = F.from_json(name, "map<string,string>")
        of_object = F.map_values(held)
        for order in orders:
            same = F.array_sort(F.map_keys(held)) == F.array(*[F.lit(f) for f in sorted(order)])
            of_object = F.when(same, F.array(*[F.element_at(held, f) for f in order])).otherwise(of_object)
        texts = F.when(F.startswith(name, F.lit("{")), of_object).otherwise(texts)
    whole = lambda x: F.coalesce(x.try_cast("bigint"), x.try_cast("decimal(38,6)").try_cast("bigint"))
    return F.transform(texts, whole) if cast == "array<bigint>" else texts.try_cast(cast)


def list_of_names(name: str) -> Column:
    """ARRAY<STRING> from a JSON list of strings or from names joined by ','."""
    return F.when(F.col(name).rlike(_KEY), F.from_json(name, "array<string>")).otherwise(F.split(name, ","))


_PLACE = r"^(.*)-(\d+)@(\d+)$"


def log_place(name: str) -> Column:
    """STRUCT<file, rem, pos> from [file, rem, pos], from an object with these fields, or from 'file-rem@pos'."""
    listed = F.from_json(name, "array<string>")
    made = lambda f, r, p: F.struct(f.alias("file"), r.try_cast("long").alias("rem"), p.try_cast("long").alias("pos"))
    return (
        F.when(F.col(name).rlike(_KEY), made(listed[0], listed[1], listed[2]))
        .when(F.col(name).rlike(_OBJECT), F.from_json(name, "struct<file:string,rem:bigint,pos:bigint>"))
        .when(F.col(name).rlike(_PLACE), made(F.regexp_extract(name, _PLACE, 1), F.regexp_extract(name, _PLACE, 2), F.regexp_extract(name, _PLACE, 3)))
    )


def _sources(diffs: DataFrame, revisions: DataFrame) -> list[tuple[DataFrame, str, dict[str, Column]]]:
    where = {"shard": F.col("shard"), "file_no": F.col("file_no"), "feed_seq": F.col("feed_seq")}
    return [(diffs, "diff", flatten.diff_keys() | where), (revisions, "snapshot", flatten.snapshot_keys() | where)]


def _catalogue(diffs: DataFrame, revisions: DataFrame) -> list[Alias]:
    found = _texts(diffs, revisions).mapInArrow(_contents, FOOTER + ", n bigint")
    per_file = cut(found.groupBy("tab", "shard", "file_no", "kind", "path").agg(F.sum("n").alias("n")), "contents")
    footer = cut(_footer(per_file.where(~F.startswith("kind", F.lit(RECORD)))), "footers")
    fields = F.from_json("path", "array<array<string>>")
    named = F.transform(fields, lambda f: F.struct(f[0].alias("name"), f[1].alias("shape")))
    of_records = per_file.where(F.startswith("kind", F.lit(RECORD)))
    records = of_records.select("tab", "shard", "file_no", F.col("kind").alias("below"), "n", named.alias("fields")).withColumn("names", F.col("fields.name"))
    log, records = cut(changes(footer), "changes"), cut(records, "records")
    aliases = alias_table(footer, log, records)
    discard(per_file, footer, log, records)
    return aliases


def spellings(diffs: DataFrame, revisions: DataFrame) -> DataFrame:
    """(path, canonical, types, cast, n_values, is_linked): every spelling of a field of an entry, position or chunk.

    ``cast`` is the type of the canonical column; ``n_values`` counts the records that hold the spelling; ``is_linked`` says that
    other spellings share its canonical path.
    """
    aliases = [a for a in _catalogue(diffs, revisions) if _level(a.path) is not None]
    sizes = Counter(a.canonical for a in aliases)
    rows = [(a.path, a.canonical, a.types, a.cast, a.values, sizes[a.canonical] > 1) for a in aliases]
    return diffs.sparkSession.createDataFrame(rows, "path string, canonical string, types string, cast string, n_values bigint, is_linked boolean")


def _consistent(diffs: DataFrame, revisions: DataFrame, schema: str, rows: str, fields: list[Field]) -> DataFrame:
    parts = [flatten.parsed(df, text, keys, schema).selectExpr(*keys, f"inline({rows})") for df, text, keys in _sources(diffs, revisions)]
    texts = parts[0].unionByName(parts[1])
    kept = [c for c in texts.columns if not c.startswith("t_")]
    cast = texts.select(*kept, *[_cast(f"t_{i}", f).alias(f"v_{i}") for i, f in enumerate(fields)])
    return cast.select(*kept, *_columns(fields, kept))


def consistent_entries(diffs: DataFrame, revisions: DataFrame) -> DataFrame:
    """All entries of all files, with every field but their positions and ops, of which they have the numbers."""
    fields = _fields_of(_catalogue(diffs, revisions), ENTRY)
    read = _Reading(fields, ["positions", "ops"])
    lists = lambda n: f"coalesce(json_array_length({read._get('e.x', n)}), 0) AS n_{n}"
    rows = f"transform({flatten._list('entries')}, e -> struct(e.i AS entry_no, {lists('positions')}, {lists('ops')}{read.reads('e.x')}))"
    return _consistent(diffs, revisions, f"array<{read.schema()}>", rows, fields)


def consistent_chunks(diffs: DataFrame, revisions: DataFrame) -> DataFrame:
    """All chunks of all files under the oldest names, cast to one type each, with every field that any file has."""
    fields = _fields_of(_catalogue(diffs, revisions), CHUNK)
    read = _Reading(fields, ["id"])
    side = lambda name: f"transform({flatten._list(f'm.value.{name}')}, c -> struct(e.i AS entry_no, o.i AS op_no, m.key AS aggregation, '{name}' AS action, c.i AS chunk_no{read.reads('c.x')}))"
    rows = f"flatten(transform({flatten._list('entries')}, e -> flatten(transform({flatten._list('e.x.ops')}, o -> flatten(transform(map_entries(o.x), m -> concat({side('added')}, {side('removed')})))))))"
    schema = f"array<struct<ops:array<map<string,struct<added:array<{read.schema()}>,removed:array<{read.schema()}>>>>>>"
    return _consistent(diffs, revisions, schema, rows, fields)


def consistent_positions(diffs: DataFrame, revisions: DataFrame) -> DataFrame:
    """All log positions of all files under the oldest names, places in the log as (file, rem, pos), with every field that any file has."""
    fields = _fields_of(_catalogue(diffs, revisions), POSITION)
    read = _Reading(fields, ["log"])
    rows = f"flatten(transform({flatten._list('entries')}, e -> transform({flatten._list('e.x.positions')}, p -> struct(e.i AS entry_no, p.i AS position_no{read.reads('p.x')}))))"
    return _consistent(diffs, revisions, f"array<struct<positions:array<{read.schema()}>>>", rows, fields)

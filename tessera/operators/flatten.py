"""Problem 6: deeply nested records to related flat tables, by higher-order SQL projection.

A nested text is parsed once with ``from_json``, which also says whether it is readable. For each target table one expression of
nested ``transform`` calls attaches the ancestors' keys and positions to every element,
``flatten`` joins the arrays, and a single ``inline`` emits the rows. Everything stays in
the JVM and needs no shuffle; children find their parent by the positions they carry.

Defined results: NULL, empty and unreadable texts give no rows; a missing, NULL or empty
list gives no rows of that table; a NULL element of a list is skipped but keeps its place;
columns of the input are only those named in ``keep``, so clashing names can't get in.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.json_text import json_values

#: Fields of a chunk and of a position are read as text, so no change of type loses a value.
CHUNK_FIELDS = ("id", "min", "max", "count", "measures")
POSITION_FIELDS = ("log", "from", "to")


def _text_struct(fields: Sequence[str]) -> str:
    return "struct<" + ",".join(f"`{f}`:string" for f in fields) + ">"


def commit_schema(chunk_fields: Sequence[str], position_fields: Sequence[str] = ()) -> str:
    chunk = _text_struct(chunk_fields)
    ops = f"ops:array<map<string,struct<added:array<{chunk}>,removed:array<{chunk}>>>>"
    positions = f"positions:array<{_text_struct(position_fields)}>," if position_fields else ""
    return f"array<struct<{positions}{ops}>>"


def parsed(df: DataFrame, text: str, keep: Mapping[str, Column], schema: str) -> DataFrame:
    """The columns in ``keep`` and ``entries``, the readable text of each row in ``schema``; NULL if it is unreadable."""
    return json_values(df.where(F.col(text).isNotNull()), F.col(text), keep, "entries", schema)


def _list(expr: str) -> str:
    """Elements of a list with their places, without NULL elements; empty if the list is NULL."""
    return f"filter(transform(coalesce({expr}, array()), (x, i) -> struct(i AS i, x AS x)), y -> y.x IS NOT NULL)"


def entries_table(nested: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per entry: its place and how many positions and ops it holds."""
    rows = f"""transform({_list('entries')}, e -> struct(e.i AS entry_no,
        coalesce(size(e.x.positions), 0) AS n_positions, coalesce(size(e.x.ops), 0) AS n_ops))"""
    return nested.selectExpr(*keys, f"inline({rows})")


def positions_table(nested: DataFrame, keys: Sequence[str], fields: Sequence[str] = POSITION_FIELDS) -> DataFrame:
    """One row per position of an entry."""
    cols = ", ".join(f"p.x.`{f}` AS `{f}`" for f in fields)
    rows = f"""flatten(transform({_list('entries')}, e ->
        transform({_list('e.x.positions')}, p -> struct(e.i AS entry_no, p.i AS position_no, {cols}))))"""
    return nested.selectExpr(*keys, f"inline({rows})")


def operations_table(nested: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per aggregation of an op, with the numbers of its chunks."""
    rows = f"""flatten(transform({_list('entries')}, e -> flatten(transform({_list('e.x.ops')}, o ->
        transform(filter(map_entries(o.x), m -> m.value IS NOT NULL), m -> struct(e.i AS entry_no, o.i AS op_no, m.key AS aggregation,
            coalesce(size(m.value.added), 0) AS n_added, coalesce(size(m.value.removed), 0) AS n_removed))))))"""
    return nested.selectExpr(*keys, f"inline({rows})")


def chunks_table(nested: DataFrame, keys: Sequence[str], fields: Sequence[str] = CHUNK_FIELDS) -> DataFrame:
    """One row per chunk, added or removed, with the places of all its ancestors.

    ``chunk_id`` is the id as BIGINT (written as number or text), NULL if it is neither;
    the other fields come as the text they have.
    """
    rest = "".join(f", c.x.`{f}` AS `{f}`" for f in fields if f != "id")

    def side(name: str) -> str:
        return f"""transform({_list(f'm.value.{name}')}, c -> struct(e.i AS entry_no, o.i AS op_no, m.key AS aggregation,
            '{name}' AS action, c.i AS chunk_no, try_cast(try_cast(c.x.id AS DECIMAL(38,6)) AS BIGINT) AS chunk_id{rest}))"""

    rows = f"""flatten(transform({_list('entries')}, e -> flatten(transform({_list('e.x.ops')}, o ->
        flatten(transform(map_entries(o.x), m -> concat({side('added')}, {side('removed')})))))))"""
    return nested.selectExpr(*keys, f"inline({rows})")


_RECORD = "map<string,string>"


def _rest(record: str, named: Sequence[str]) -> str:
    """SQL for the JSON text of the fields of a record, read as a map of texts, that have no column; NULL if there are none."""
    left = f"map_filter({record}, (k, v) -> k NOT IN ({', '.join(repr(n) for n in named)}) AND v IS NOT NULL)"
    return f"if(size({left}) > 0, to_json({left}), NULL)"


def whole_entries(df: DataFrame, text: str, keep: Mapping[str, Column]) -> DataFrame:
    """One row per entry, as ``entries_table``, and ``rest``: all its other fields as a JSON text, values as the texts they have."""
    rows = f"""transform({_list('entries')}, e -> struct(e.i AS entry_no, coalesce(json_array_length(e.x['positions']), 0) AS n_positions,
        coalesce(json_array_length(e.x['ops']), 0) AS n_ops, {_rest('e.x', ('positions', 'ops'))} AS rest))"""
    return parsed(df, text, keep, f"array<{_RECORD}>").selectExpr(*keep, f"inline({rows})")


def whole_positions(df: DataFrame, text: str, keep: Mapping[str, Column]) -> DataFrame:
    """One row per position, as ``positions_table``, and ``rest``: the fields under any other name as a JSON text."""
    cols = ", ".join(f"p.x['{f}'] AS `{f}`" for f in POSITION_FIELDS)
    rows = f"""flatten(transform({_list('entries')}, e ->
        transform({_list('e.x.positions')}, p -> struct(e.i AS entry_no, p.i AS position_no, {cols}, {_rest('p.x', POSITION_FIELDS)} AS rest))))"""
    return parsed(df, text, keep, f"array<struct<positions:array<{_RECORD}>>>").selectExpr(*keep, f"inline({rows})")


def whole_chunks(df: DataFrame, text: str, keep: Mapping[str, Column]) -> DataFrame:
    """One row per chunk, as ``chunks_table``, its ``id`` as written, and ``rest``: the fields under any other name as a JSON text."""
    cols = ", ".join(f"c.x['{f}'] AS `{f}`" for f in CHUNK_FIELDS)

    def side(name: str) -> str:
        return f"""transform({_list(f'm.value.{name}')}, c -> struct(e.i AS entry_no, o.i AS op_no, m.key AS aggregation, '{name}' AS action, c.i AS chunk_no,
            try_cast(try_cast(c.x['id'] AS DECIMAL(38,6)) AS BIGINT) AS chunk_id, {cols}, {_rest('c.x', CHUNK_FIELDS)} AS rest))"""

    rows = f"""flatten(transform({_list('entries')}, e -> flatten(transform({_list('e.x.ops')}, o ->
        flatten(transform(map_entries(o.x), m -> concat({side('added')}, {side('removed')})))))))"""
    schema = f"array<struct<ops:array<map<string,struct<added:array<{_RECORD}>,removed:array<{_RECORD}>>>>>>"
    return parsed(df, text, keep, schema).selectExpr(*keep, f"inline({rows})")


def reference_or_zero(parent: str = "parent_id") -> Column:
    """``ref`` of a link row: its parent, or 0 where NULL, zero or negative means none."""
    return F.when(F.col(parent) > 0, F.col(parent)).otherwise(F.lit(0)).cast("long")


def diff_keys() -> dict[str, Column]:
    return {"tab": F.lit("ot_diffs"), "revision_id": F.col("revision_id"), "parent_id": reference_or_zero()}


def snapshot_keys() -> dict[str, Column]:
    return {"tab": F.lit("ot_revisions"), "revision_id": F.col("id"), "parent_id": F.lit(0).cast("long")}


def chunks_found(diffs: DataFrame, revisions: DataFrame) -> DataFrame:
    """Each distinct chunk of both tables with its place (tab, revision, ref, entry, op, aggregation, action)."""
    schema = commit_schema(["id"])
    key = ["tab", "revision_id", "parent_id"]
    rows = chunks_table(parsed(diffs, "diff", diff_keys(), schema), key, ["id"]).unionByName(
        chunks_table(parsed(revisions, "snapshot", snapshot_keys(), schema), key, ["id"])
    )
    return rows.drop("chunk_no").distinct()

"""Strict JSON texts as column expressions.

Spark's JSON readers take the first value of a text and ignore what follows it. Here a
text counts only if the whole of it is one JSON value.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The reader's leniencies turned off; ``bad`` is not NULL where something is wrong.
STRICT = {
    "mode": "PERMISSIVE",
    "columnNameOfCorruptRecord": "bad",
    "allowSingleQuotes": "false",
    "allowNonNumericNumbers": "false",
    "maxStringLen": "2147483647",
}


_QUOTED = r'^[\t\r\n ]*+"'


def _one_in_array(text: Column) -> Column:
    return F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1


def _held(text: Column) -> Column:
    """The text of the first value in ``text``, without quotes if it is a string."""
    return F.get_json_object(F.concat(F.lit("["), text, F.lit("]")), "$[0]")


def is_whole_json(text: Column) -> Column:
    """True iff ``text`` is exactly one JSON value; False for NULL, empty and broken texts.

    The text is parsed inside an array and inside an object. A text that closes either
    wrapper early is a syntax error in the other one, and several values make the array
    longer than one, so trailing content can't slip through. The object is read with the
    reader's leniencies (single quotes, NaN) turned off.
    """
    in_array = _one_in_array(text)
    in_object = F.from_json(F.concat(F.lit('{"k":'), text, F.lit("}")), "k string, bad string", STRICT)
    return F.coalesce(in_array & in_object["bad"].isNull() & in_object.isNotNull(), F.lit(False))


def readable_payload(text: Column) -> Column:
    """The JSON value that ``text`` is, or that the one JSON string in it holds; NULL if unreadable."""
    held = _held(text)
    quoted = text.rlike(_QUOTED)
    inner = F.when(is_whole_json(held) & ~held.rlike(r'^\s*"'), held)
    return F.when(is_whole_json(text), F.when(quoted, inner).otherwise(text))


def json_values(df: DataFrame, text: Column, keep: Mapping[str, Column], name: str, schema: str) -> DataFrame:
    """``keep`` and, as ``name``, the readable ``text`` in ``schema``, a list; a bare record counts as a list of one.

    One pass over a text parses it inside an object, in the schema and strictly, a second one counts the
    values in it: that is the test of ``is_whole_json`` and the reading in one. Only a text that
    doesn't go into the schema, or is unreadable, is looked at again, to tell which. The steps are projections of their own, so
    nothing is parsed for each use of its result.
    """
    own = list(keep)
    held = df.select(*[c.alias(n) for n, c in keep.items()], text.alias("__text"), text.rlike(_QUOTED).alias("__quoted"))
    held = held.select(*own, "__text", "__quoted", F.when(F.col("__quoted"), _held(F.col("__text"))).otherwise(F.col("__text")).alias("__payload"))
    payload = F.col("__payload")
    listed = F.when(payload.rlike(r"^\s*\{"), F.concat(F.lit("["), payload, F.lit("]"))).otherwise(payload)
    read = F.from_json(F.concat(F.lit('{"k":'), listed, F.lit("}")), f"k {schema}, bad string", STRICT)
    held = held.select(*own, "__text", "__quoted", "__payload", listed.alias("__listed"), read.alias("__read"))
    fits = F.col("__read").isNotNull() & F.col("__read.bad").isNull()
    outer = ~F.col("__quoted") | (is_whole_json(F.col("__text")) & ~payload.rlike(r'^\s*"'))
    again = F.when(readable_payload(F.col("__text")).isNotNull(), F.from_json("__listed", schema))
    value = F.when(fits, F.when(_one_in_array(payload) & outer, F.col("__read.k"))).otherwise(again)
    return held.select(*own, value.alias(name))

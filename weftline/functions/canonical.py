"""Canonical JSON of columns: keys in one order at every level, so that equal values have equal texts and hashes."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F, types as T

#: Fixed value: levels of nesting.
DEEPEST = 20


def _scalar(value: Column) -> Column:
    """A string, number, boolean or time as JSON writes it."""
    return F.regexp_extract(F.to_json(F.struct(value.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)


def _text(value: Column, kind: T.DataType, depth: int) -> Column:
    if depth > DEEPEST:
        raise ValueError("nested too deeply")
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        if len({f.name for f in fields}) < len(fields):
            raise ValueError("two fields of one name")
        parts = [F.concat(F.lit(json.dumps(f.name, ensure_ascii=False) + ":"), _text(value.getField(f.name), f.dataType, depth + 1)) for f in fields]
        text = F.concat(F.lit("{"), F.array_join(F.array(*parts), ","), F.lit("}")) if parts else F.lit("{}")
    elif isinstance(kind, T.MapType):
        key = lambda e: e["key"].cast("string")
        entries = F.array_sort(F.map_entries(value), lambda a, b: F.when(key(a) < key(b), -1).when(key(a) > key(b), 1).otherwise(0))
        text = F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(_scalar(key(e)), F.lit(":"), _text(e["value"], kind.valueType, depth + 1))), ","), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(value, lambda v: _text(v, kind.elementType, depth + 1)), ","), F.lit("]"))
    else:
        text = _scalar(value)
    return F.when(value.isNull(), F.lit("null")).otherwise(text)


def canonical_json(df: DataFrame, column: str) -> Column:
    """A column of ``df`` as JSON with the keys of every struct and map in the order of their code points; expressions only.

    Nulls at any level are ``null``; arrays keep their order; a map's keys count as text. A type nested deeper than
    DEEPEST levels, or a struct with two fields of one name, is a ValueError before anything runs. A null column is
    ``null`` too, so a key that varies by it is another than one that does not vary.
    """
    return _text(F.col(f"`{column}`"), df.schema[column].dataType, 0)

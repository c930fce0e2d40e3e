"""Plan-time compilers from field paths and templates to Columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEGMENT = re.compile(r"([^.\[\]]+)|\[(\*?|\d+|\d*:\d*)\]")


def top_field(path: str) -> str:
    return SEGMENT.match(path)[1]


def field_of_each(values: Column, name: str) -> Column:
    return F.transform(values, lambda x: x[name])


def resolve(df: DataFrame, path: str) -> tuple[Column, bool]:
    """(column, whether it is a list) of a path like a.b, a[*].b, a[].b, a[2] or a[0:5]; a missing field is null or an empty list."""
    kind: T.DataType = df.schema
    value: Column | None = None
    many = False
    for name, index in SEGMENT.findall(path):
        if name:
            inner = kind.elementType if many else kind
            if not isinstance(inner, T.StructType) or name not in inner.fieldNames():
                return (F.array().cast("array<string>") if many else F.lit(None).cast("string")), many
            if many:
                value = field_of_each(value, name)
                kind = T.ArrayType(inner[name].dataType)
            else:
                value = F.col(f"`{name}`") if value is None else value[name]
                kind = inner[name].dataType
        else:
            item = kind.elementType if many else kind
            if many and isinstance(item, T.ArrayType):
                value, kind = F.flatten(value), item
            elif not isinstance(kind, T.ArrayType):
                value, kind = F.when(value.isNull(), F.array().cast(T.ArrayType(kind))).otherwise(F.array(value)), T.ArrayType(kind)
            if index in ("", "*"):
                many = True
            elif ":" in index:
                begin, end = (int(x) if x else None for x in index.split(":"))
                value = F.slice(value, (begin or 0) + 1, (10**9 if end is None else end) - (begin or 0))
                many = True
            else:
                value, kind, many = F.try_element_at(value, F.lit(int(index) + 1)), kind.elementType, False
    return (F.coalesce(value, F.array().cast(kind)) if many else value), many


def texts(df: DataFrame, path: str) -> Column:
    """The non-empty values of a path as strings, always a list."""
    value, many = resolve(df, path)
    listed = value if many else F.array(value)
    return F.filter(F.transform(listed, lambda x: x.cast("string")), lambda x: x.isNotNull() & (x != ""))


def render(df: DataFrame, fields: list[str]) -> Column:
    """Labelled text: `f: v` parts with a blank line between; several values as a list; one field with one value bare."""
    parts = []
    for name in fields:
        own, many = texts(df, name), resolve(df, name)[1]
        single = F.concat(F.lit(f"{name}: "), own[0]) if len(fields) > 1 else own[0]
        listed = F.concat(F.lit(f"{name}:\n- "), F.array_join(own, "\n- "))
        parts.append(F.when(F.size(own) == 0, None).otherwise(listed if many else single))
    return F.concat_ws("\n\n", *parts)


def render_template(df: DataFrame, template: str) -> Column:
    """A template with {field} and {field[inner]}; what is missing is empty."""
    parts: list[Column] = []
    for literal, name in re.findall(r"([^{]+)|\{([^}]*)\}", template):
        if literal:
            parts.append(F.lit(literal))
        else:
            value, _ = resolve(df, re.sub(r"\[([^\]*:]+)\]", lambda m: m[0] if m[1].isdigit() else f".{m[1]}", name))
            parts.append(F.coalesce(value.cast("string"), F.lit("")))
    return F.concat(*parts)

"""Canonical JSON text of nested rows: keys sorted at every level, absent apart from null, two spaces a level."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DateType, DecimalType, DoubleType, FloatType, IntegralType, MapType, StringType, StructType, TimestampType

from sessionloom.functions.text import iso

_UPPER_ESCAPES = ["000B", "000E", "000F", *(f"001{d}" for d in "ABCDEF")]


def quoted(text: Column) -> Column:
    """A JSON string. Spark writes the escapes of control characters with capital digits; they become small ones."""
    plain = F.to_json(F.struct(text.alias("v")))
    plain = F.substr(plain, F.lit(6), F.length(plain) - 6)
    small = plain
    for code in _UPPER_ESCAPES:  # an even number of backslashes before the escape, so it is none of a written-out \u
        small = F.regexp_replace(small, r"(?<!\\)((?:\\\\)*)\\u" + code, r"$1\\u" + code.lower())
    return F.when(text.rlike(r"[\x0B\x0E\x0F\x1A-\x1F]"), small).otherwise(plain)


def number(value: Column) -> Column:
    """A double as the shortest decimal: no fraction on whole numbers, an exponent from 1e21 and below 1e-6."""
    written = value.cast("string")
    size = F.abs(value)
    exact = F.regexp_replace(F.regexp_replace(written.cast("decimal(38,17)").cast("string"), "(\\.[0-9]*?)0+$", "$1"), "\\.$", "")
    power = F.regexp_replace(F.regexp_replace(written, "\\.0E", "E"), "E(?=[0-9])", "e+")
    return (
        F.when(F.isnan(value) | (size == float("inf")), F.lit("null"))
        .when((value == F.floor(value)) & (size < 1e15), value.cast("decimal(38,0)").cast("string"))
        .when((size >= 1e-3) & (size < 1e7), written)
        .when((size >= 1e-6) & (size < 1e20), exact)
        .otherwise(F.regexp_replace(power, "E", "e"))
    )


def _lines(entries: Column, open_: str, close: str, indent: int) -> Column:
    """Entries between brackets, one a line; nothing between them where there are none."""
    inner, outer = "\n" + "  " * (indent + 1), "\n" + "  " * indent
    body = F.concat(F.lit(open_ + inner), F.array_join(entries, "," + inner), F.lit(outer + close))
    return F.when(F.size(entries) == 0, F.lit(open_ + close)).otherwise(body)


def canonical(value: Column, kind: DataType, nulls: Collection[str] = (), path: str = "", indent: int = 0) -> Column:
    """The text of ``value`` (type ``kind``); null where it is null.

    Expressions follow the schema, so nothing is parsed and any depth stays in the JVM. A null field is left out, unless its
    dotted path (``a.b``; arrays and maps add nothing) is in ``nulls``: then it is written. Elements of arrays are
    always written. Keys are in order of their UTF-16 units.
    """
    if isinstance(kind, StructType):
        entries = []
        for field in sorted(kind.fields, key=lambda f: f.name.encode("utf-16-be")):
            inner = f"{path}.{field.name}" if path else field.name
            key = F.concat(quoted(F.lit(field.name)), F.lit(": "))
            text = canonical(value[field.name], field.dataType, nulls, inner, indent + 1)
            entries.append(F.concat(key, F.coalesce(text, F.lit("null")) if inner in nulls else text))
        return F.when(value.isNotNull(), _lines(F.array_compact(F.array(*entries)), "{", "}", indent))
    if isinstance(kind, ArrayType):
        items = F.transform(value, lambda x: F.coalesce(canonical(x, kind.elementType, nulls, path, indent + 1), F.lit("null")))
        return F.when(value.isNotNull(), _lines(items, "[", "]", indent))
    if isinstance(kind, MapType):
        pairs = F.array_sort(F.transform(F.map_entries(value), lambda e: F.struct(e["key"].cast("string").alias("key"), e["value"].alias("value"))))
        items = F.transform(pairs, lambda e: F.concat(quoted(e["key"]), F.lit(": "), F.coalesce(canonical(e["value"], kind.valueType, nulls, path, indent + 1), F.lit("null"))))
        return F.when(value.isNotNull(), _lines(items, "{", "}", indent))
    if isinstance(kind, StringType):
        return F.when(value.isNotNull(), quoted(value))
    if isinstance(kind, TimestampType):
        return F.when(value.isNotNull(), F.concat(F.lit('"'), iso(value), F.lit('"')))
    if isinstance(kind, DateType):
        return F.when(value.isNotNull(), F.concat(F.lit('"'), value.cast("string"), F.lit('"')))
    if isinstance(kind, (DoubleType, FloatType, DecimalType)):
        return number(value.cast("double"))
    if isinstance(kind, (IntegralType, BooleanType)):
        return value.cast("string")
    raise TypeError(f"no canonical text for {kind.simpleString()} at {path or 'the top'}")


def document(value: Column, kind: DataType, nulls: Collection[str] = ()) -> Column:
    """A whole document: the canonical text and a line end."""
    return F.concat(canonical(value, kind, nulls), F.lit("\n"))

"""Values as the query language sees them: every leaf of a dotted path, as a string."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
#: In the metadata of a slug that is the text of one column: that column.
SLUG_OF = "text_of"
BITS = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}
_INTEGER = re.compile("0|-?[1-9][0-9]*")


def integer_of(text: str, kind: T.DataType) -> int | None:
    """The integer that has exactly this text as a value of the type; None if there is none."""
    if not _INTEGER.fullmatch(text):
        return None
    number, bound = int(text), 1 << (BITS[type(kind)] - 1)
    return number if -bound <= number < bound else None


def among(column: Column, kind: T.DataType, texts: list[str]) -> Column:
    """Whether the value's text is one of the texts, as a predicate that a scan of integers or strings takes."""
    if isinstance(kind, INTEGRAL):
        numbers = [n for t in texts if (n := integer_of(t, kind)) is not None]
        return column.isin(numbers) if numbers else F.lit(False)
    text = js_string(column, kind)
    return text == texts[0] if len(texts) == 1 else text.isin(texts) if texts else F.lit(False)


def js_string(value: Column, kind: T.DataType) -> Column:
    """The value's text: 42 rather than 42.0, true/false, plain decimals where a double prints without an exponent."""
    if isinstance(kind, T.StringType):
        return value
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        value = value.cast("double")
        size = F.abs(value)
        fraction = F.regexp_replace(value.cast("decimal(38,10)").cast("string"), r"\.?0+$", "")
        return (
            F.when(value.isNull(), F.lit(None).cast("string"))
            .when(F.isnan(value), F.lit("NaN"))
            .when(size == float("inf"), F.when(value > 0, F.lit("Infinity")).otherwise(F.lit("-Infinity")))
            .when((value == F.floor(value)) & (size < 1e15), F.try_to_number(F.format_string("%.0f", value), F.lit("S999999999999999")).cast("string"))
            .when((size >= 1e-3) & (size < 1e7), value.cast("string"))
            .otherwise(fraction)
        )
    if isinstance(kind, T.DecimalType):
        shown = value.cast("string")
        return F.when(F.contains(shown, F.lit(".")), F.regexp_replace(shown, r"\.?0+$", "")).otherwise(shown)
    return value.cast("string")


def _flat(value: Column, kind: T.DataType) -> tuple[Column, T.DataType]:
    while isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.ArrayType):
        value, kind = F.flatten(F.filter(value, lambda x: x.isNotNull())), kind.elementType
    return value, kind


def leaf(schema: T.StructType, path: str) -> tuple[Column, T.DataType] | None:
    """The column that a dotted path names, arrays on the way flattened into one; None where the schema has no such field."""
    first, *rest = path.split(".")
    if first not in schema.names:
        return None
    value, kind = _flat(F.col(f"`{first}`"), schema[first].dataType)
    for name in rest:
        inner = kind.elementType if isinstance(kind, T.ArrayType) else kind
        if isinstance(inner, T.StructType):
            if name not in inner.names:
                return None
            found = inner[name].dataType
        elif isinstance(inner, T.MapType):
            found = inner.valueType
        else:
            return None
        if isinstance(kind, T.ArrayType):
            value, kind = F.transform(value, _get(name)), T.ArrayType(found)
        else:
            value, kind = value[name], found
        value, kind = _flat(value, kind)
    return value, kind


def _get(name: str):
    return lambda x: x[name]


def field_values(schema: T.StructType, path: str) -> Column:
    """ARRAY<STRING> of a path's values in document order, duplicates kept, nulls dropped; empty where there is nothing."""
    found = leaf(schema, path)
    if found is None:
        return F.array().cast("array<string>")
    value, kind = found
    if isinstance(kind, T.ArrayType):
        inner = kind.elementType
        return F.coalesce(F.filter(F.transform(value, lambda x: js_string(x, inner)), lambda x: x.isNotNull()), F.array().cast("array<string>"))
    return F.array_compact(F.array(js_string(value, kind)))


def nested_property(schema: T.StructType, path: str) -> Column:
    """Like field_values, with the values' own type."""
    found = leaf(schema, path)
    if found is None:
        return F.array()
    value, kind = found
    return F.filter(value, lambda x: x.isNotNull()) if isinstance(kind, T.ArrayType) else F.array_compact(F.array(value))


def is_scalar(schema: T.StructType, path: str) -> bool:
    found = leaf(schema, path)
    return found is not None and not isinstance(found[1], T.ArrayType)


def unwrap_single(value: Column, kind: T.DataType) -> Column:
    """The element of a one-element array, of nested ones the innermost, where the array type allows it; null for others."""
    while isinstance(kind, T.ArrayType):
        value, kind = F.when(F.size(value) == 1, F.element_at(value, 1)), kind.elementType
    return value


def as_array(value: Column, kind: T.DataType) -> Column:
    return value if isinstance(kind, T.ArrayType) else F.array(value)


def prefix_path(value: Column, depth: int = 1) -> Column:
    """Where an index keeps a value: the first `depth` characters, each as four hexadecimal digits of its first UTF-16 unit."""
    places = F.filter(F.sequence(F.lit(1), F.lit(depth)), lambda i: i <= F.char_length(value))
    return F.array_join(F.transform(places, lambda i: F.lower(F.left(F.hex(F.encode(F.substring(value, i, F.lit(1)), "UTF-16BE")), F.lit(4)))), "/")


def prefix_of(value: str, depth: int = 1) -> str:
    """prefix_path of one value, on the driver."""
    return "/".join(c.encode("utf-16-be")[:2].hex() for c in value[:depth])

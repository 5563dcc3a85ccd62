"""The declared schemas (a small part of JSON Schema): checking records and tables, compiling to Spark types."""

from __future__ import annotations

from datetime import datetime
from email.utils import parsedate_to_datetime
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.functions.values import leaf
from marlstone.sources.mini_yaml import ABSENT


class ValidationError(ValueError):
    pass


class Validator(Protocol):
    def __call__(self, data: Any, schema: dict, path: str) -> None: ...


def kinds_of(schema: dict) -> list[str]:
    kind = schema.get("type")
    return [] if kind is None else [kind] if isinstance(kind, str) else list(kind)


def is_date(value: Any) -> bool:
    if isinstance(value, datetime):
        return True
    if not isinstance(value, str):
        return False
    for read in (datetime.fromisoformat, parsedate_to_datetime, *[lambda v, f=f: datetime.strptime(v, f) for f in ("%Y/%m/%d", "%Y-%m", "%Y", "%m/%d/%Y", "%B %d, %Y", "%d %B %Y")]):
        try:
            read(value.strip())
            return True
        except (ValueError, TypeError, IndexError):
            pass
    return False


def _number(value: Any) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


_CHECKS = {
    "string": lambda v: isinstance(v, str), "number": _number, "integer": lambda v: _number(v) and float(v).is_integer(),
    "boolean": lambda v: isinstance(v, bool), "date": is_date, "null": lambda v: v is None,
    "array": lambda v: isinstance(v, list), "object": lambda v: isinstance(v, dict),
}


def validate(data: Any, schema: dict, path: str = "") -> None:
    """Raises ValidationError at the first value that isn't what the schema says. Unlisted keys pass."""
    kinds = kinds_of(schema)
    if not kinds:
        return
    shown = " | ".join(kinds)
    if data is None:
        if "null" not in kinds:
            raise ValidationError(f"Expected {shown} at '{path}', got null")
        return
    compound = next((k for k in ("array", "object") if k in kinds), None)
    if compound:
        if not _CHECKS[compound](data):
            raise ValidationError(f"Expected {compound} at '{path}', got {type(data).__name__}")
        if compound == "array":
            for i, item in enumerate(data):
                validate(item, schema.get("items") or {}, f"{path}[{i}]")
            return
        for name in schema.get("required") or []:
            if name not in data:
                raise ValidationError(f"Missing required field: '{path}.{name}'" if path else f"Missing required field: '{name}'")
        for name, inner in (schema.get("properties") or {}).items():
            if name in data and data[name] is not ABSENT:
                validate(data[name], inner, f"{path}.{name}" if path else name)
        return
    if not any(_CHECKS[k](data) for k in kinds if k in _CHECKS):
        raise ValidationError(f"Expected {shown} at '{path}', got {data!r}")


def spark_type(schema: dict) -> T.DataType:
    """The Spark type of a schema. A union of scalars is text; what has no type is text as well."""
    kinds = [k for k in kinds_of(schema) if k != "null"]
    if "array" in kinds:
        return T.ArrayType(spark_type(schema.get("items") or {}))
    if "object" in kinds:
        return T.StructType([T.StructField(n, spark_type(s)) for n, s in (schema.get("properties") or {}).items()])
    scalars = {"number": T.DoubleType(), "integer": T.LongType(), "boolean": T.BooleanType()}
    return scalars.get(kinds[0], T.StringType()) if len(kinds) == 1 else T.StringType()


def record_type(schema: dict) -> T.StructType:
    """The columns of a source: of a list, its items' properties; slug is left to the reader."""
    inner = (schema.get("items") or {}) if "array" in kinds_of(schema) else schema
    kind = spark_type(inner | {"type": "object"})
    return T.StructType([f for f in kind.fields if f.name not in ("slug", "raw")])


def violations(df: DataFrame, schema: dict, key: str = "slug") -> DataFrame:
    """(key, path, problem) of a table's rows: missing required values, nulls, dates that can't be read, fractions in integers."""
    found: list[Column] = []

    def check(path: str, inner: dict, required: bool, parent: Column | None = None) -> None:
        """parent: the object or list of objects that the path's last field is in; what it requires counts only where it is there."""
        kinds = kinds_of(inner)
        place = leaf(df.schema, path)
        problem = lambda text: F.struct(F.lit(path).alias("path"), F.lit(text).alias("problem"))
        if place is None:
            if required:
                found.append(problem("missing"))
            return
        value, kind = place
        if required and "null" not in kinds:
            if not isinstance(kind, T.ArrayType):
                found.append(F.when(value.isNull() if parent is None else value.isNull() & parent.isNotNull(), problem("missing")))
            elif parent is not None and "array" not in kinds:  # one value for each object of a list
                found.append(F.when(F.exists(value, lambda v: v.isNull()), problem("missing")))
        each = F.array(value) if not isinstance(kind, T.ArrayType) else value
        if "date" in kinds:
            found.append(F.when(F.exists(each, lambda v: v.isNotNull() & F.try_to_timestamp(v.cast("string")).isNull()), problem("not a date")))
        if "integer" in kinds and "number" not in kinds:
            found.append(F.when(F.exists(each, lambda v: v.isNotNull() & (v.cast("double") != F.floor(v.cast("double")))), problem("not an integer")))
        for name, below in (inner.get("properties") or {}).items():
            check(f"{path}.{name}", below, name in (inner.get("required") or []), value)
        listed = inner.get("items") or {}
        for name, below in (listed.get("properties") or {}).items():
            check(f"{path}.{name}", below, name in (listed.get("required") or []), value)

    inner = (schema.get("items") or {}) if "array" in kinds_of(schema) else schema
    for name, below in (inner.get("properties") or {}).items():
        check(name, below, name in (inner.get("required") or []))
    return df.select(F.col(key), F.explode(F.array_compact(F.array(*found))).alias("x")).select(key, "x.path", "x.problem")

"""Results and declarations for other programs: static pages, Spark schemas, Python types."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.plans.catalog import ONE, Catalog
from marlstone.plans.engine import Engine
from marlstone.plans.query import Page, Query
from marlstone.sources.validation import kinds_of, record_type


def static_result(engine: Engine, make: Callable[[Engine], Query | Page]) -> DataFrame:
    """(kind, value): the page's records as JSON, its page info, and when it was made."""
    got = make(engine)
    page = got if isinstance(got, Page) else got.exec()
    spark = engine.spark
    info = page.page_info.to_json()
    records = page.data.select(F.lit("record").alias("kind"), F.to_json(F.struct(*page.data.columns)).alias("value"))
    facts = spark.range(1).select(
        F.explode(
            F.array(
                F.struct(F.lit("pageInfo").alias("kind"), F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in info.items()])).alias("value")),
                F.struct(F.lit("generatedAt").alias("kind"), F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("value")),
            )
        ).alias("x")
    )
    return records.unionByName(facts.select("x.*"))


def _name(source: str) -> str:
    return source[:1].upper() + source[1:]


def python_type(schema: dict) -> str:
    """A schema as a Python annotation: number and integer are float, an untyped value is Any."""
    shown = []
    for kind in kinds_of(schema) or [""]:
        if kind == "array":
            shown.append(f"list[{python_type(schema.get('items') or {})}]")
        elif kind == "object":
            shown.append("dict[str, Any]")
        else:
            shown.append({"string": "str", "date": "str", "number": "float", "integer": "float", "boolean": "bool", "null": "None"}.get(kind, "Any"))
    return " | ".join(shown)


def type_definitions(catalog: Catalog) -> str:
    """A module of TypedDicts: a record for each source, its indexed fields marked, its relations, its custom index keys."""
    out = ["from typing import Annotated, Any, Literal, NotRequired, TypedDict", "", 'INDEX = "index"', ""]
    for source in catalog.values():
        inner = (source.schema.get("items") or {}) if "array" in kinds_of(source.schema) else source.schema
        required = set(inner.get("required") or ["slug"]) | {"slug"}
        indexed = catalog.indexes(source.name)
        out += ["", f"class {_name(source.name)}Record(TypedDict):", '    slug: "Annotated[str, INDEX]"', '    raw: "str"']
        for name, kind in (inner.get("properties") or {}).items():
            if name in ("slug", "raw"):
                continue
            shown = python_type(kind)
            shown = f"Annotated[{shown}, INDEX]" if name in indexed else shown
            out.append(f'    {name}: "{shown if name in required else f"NotRequired[{shown}]"}"')
        for name, relation in source.relations.items():
            target = f"{_name(relation.to)}Record"
            shown = target if relation.kind in ONE else f"{target} | None" if relation.kind == "belongsTo" else f"list[{target}]"
            out.append(f'    {name}: "NotRequired[{shown}]"')
        for name, relation in source.relations.items():
            keys = "str" if relation.kind in ONE else "str | None" if relation.kind == "belongsTo" else "list[str]"
            out += ["", f'{_name(source.name)}Relation_{name} = dict[str, "{keys}"]']
        if source.custom_index:
            out += ["", f"{_name(source.name)}CustomIndexKeys = Literal[{', '.join(repr(k) for k in source.custom_index)}]"]
    out += ["", "", "class SourceTypes(TypedDict):", *[f'    {s}: "{_name(s)}Record"' for s in catalog]]
    return "\n".join(out) + "\n"


def table_definitions(catalog: Catalog) -> dict[str, str]:
    """The Spark schema of every file source, as DDL. Relations that are inverse or many are nested by the engine, not stored."""
    return {s.name: f"slug STRING NOT NULL, {', '.join(f'{f.name} {f.dataType.simpleString().upper()}' for f in record_type(s.schema).fields)}, raw STRING" for s in catalog.values() if s.kind != "table"}



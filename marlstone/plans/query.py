"""The query builder: from, where, join, order by, cursor, page size; exec, peek, find.

A Query is an immutable description. It lowers to: scan, custom index columns, filters and
semi-joins, the order key's values exploded, the keyset predicate, sort, limit n + 1. Only
that index page (n + 1 short rows) comes to the driver; the page's rows are then read by
slug and relations are joined to them alone.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.functions.values import among, field_values, js_string, leaf
from marlstone.operators import relations
from marlstone.plans.catalog import ConfigError, Source
from marlstone.plans.paging import AFTER, BEFORE, DEFAULT_PAGE, PageInfo, decode_cursor, encode_cursor, look_ahead_info

if TYPE_CHECKING:
    from marlstone.plans.engine import Engine

OPERATORS = ("eq", "startsWith", "in")
UNICODE, BINARY = "UNICODE", "BINARY"


@dataclass(frozen=True)
class Filter:
    field: str
    op: str
    value: object

    def to_json(self) -> dict:
        return {"field": self.field, "op": self.op, "value": self.value}


@dataclass(frozen=True)
class Page:
    data: DataFrame
    page_info: PageInfo


def condition(schema: T.StructType, test: Filter) -> Column:
    """A filter as a predicate: true if any value of the field satisfies it. Plain columns are compared as they are, for the scan to push down."""
    wanted = list(test.value) if test.op == "in" else [test.value]
    found = leaf(schema, test.field)
    if found is None:
        return F.lit(False)
    column, kind = found
    if not isinstance(kind, T.ArrayType):
        return js_string(column, kind).startswith(test.value) if test.op == "startsWith" else among(column, kind, wanted)
    values = field_values(schema, test.field)
    if test.op == "startsWith":
        return F.exists(values, lambda v: v.startswith(test.value))
    return F.arrays_overlap(values, F.array(*[F.lit(w) for w in wanted])) if wanted else F.lit(False)


@dataclass(frozen=True)
class Query:
    engine: Engine
    source: Source
    filters: tuple[Filter, ...] = ()
    joins: tuple[str, ...] = ()
    key: str = "slug"
    direction: str = "asc"
    token: str | None = None
    reading: str = AFTER
    size: int = DEFAULT_PAGE
    any_of: bool = False
    collation: str = UNICODE
    options: dict = field(default_factory=dict, compare=False)

    def where(self, name: str, op: str, value) -> Query:
        if op not in OPERATORS:
            raise ConfigError(f"Unknown operator: {op}")
        return replace(self, filters=(*self.filters, Filter(name, op, tuple(value) if op == "in" else value)))

    def either(self) -> Query:
        """Rows that satisfy any of the filters rather than all."""
        return replace(self, any_of=True)

    def join(self, relation: str) -> Query:
        if relation not in self.source.relations:
            raise ConfigError(f"Unknown relation: {relation}")
        return replace(self, joins=(*self.joins, relation))

    def order_by(self, key: str, direction: str = "asc") -> Query:
        return replace(self, key=key, direction=direction)

    def cursor(self, token: str, direction: str = AFTER) -> Query:
        decode_cursor(token)
        return replace(self, token=token, reading=direction)

    def page_size(self, n: int) -> Query:
        return replace(self, size=n)

    def last_page(self) -> Query:
        return replace(self, token=None, reading=BEFORE)

    def collate(self, collation: str) -> Query:
        """UNICODE (as people sort) or BINARY (by code point)."""
        return replace(self, collation=collation)

    # Lowering

    def check(self) -> None:
        indexed = self.engine.catalog.indexes(self.source.name)
        lacking = [f for f in self.filters if f.field not in indexed]
        if lacking:
            raise ConfigError(f"[{self.source.name}] needs index: {json.dumps([f.to_json() for f in lacking])}")
        if self.key not in indexed:
            raise ConfigError(f"[{self.source.name}] needs index: {self.key}")

    def _relation_of(self, name: str) -> tuple[str, str] | None:
        first, _, rest = name.partition(".")
        return (first, rest) if rest and first in self.source.relations else None

    def _own_condition(self, schema: T.StructType, test: Filter) -> Column:
        """condition(), but the slug of a table is looked up in the columns that it is made of."""
        if test.field == "slug" and test.op != "startsWith" and self.source.key:
            return self.engine.has_slug(self.source, schema, list(test.value) if test.op == "in" else [test.value])
        return condition(schema, test)

    def to_df(self) -> DataFrame:
        """All matching rows, without pages, order or joined relations."""
        df = self.engine.frame(self.source.name, {self.key, *(f.field for f in self.filters)})
        if self.any_of and any(self._relation_of(f.field) for f in self.filters):
            return reduce(DataFrame.union, [replace(self, filters=(f,), any_of=False).to_df() for f in self.filters]).dropDuplicates(["slug"])
        own = [self._own_condition(df.schema, f) for f in self.filters if not self._relation_of(f.field)]
        if own:
            df = df.where(reduce(lambda a, b: a | b if self.any_of else a & b, own))
        for test in self.filters:
            if place := self._relation_of(test.field):
                relation = self.source.relations[place[0]]
                target = self.engine.frame(relation.to)
                through = self.engine.frame(relation.through) if relation.through else None
                df = relations.having(df, relation, target.where(condition(target.schema, replace(test, field=place[1]))), through)
        return df

    def _order_values(self, df: DataFrame) -> DataFrame:
        """df with the column _v: a row for each value of the order key, none where there is none."""
        if place := self._relation_of(self.key):
            relation = self.source.relations[place[0]]
            target = self.engine.frame(relation.to)
            pairs = relations.linked(df, relation, target, self.engine.frame(relation.through) if relation.through else None)
            values = target.select(F.col("slug").alias("t_slug"), F.explode(field_values(target.schema, place[1])).alias("_v"))
            return df.join(pairs.join(values, "t_slug").select(F.col("l_slug").alias("slug"), "_v").distinct(), "slug")
        found = leaf(df.schema, self.key)
        if found is not None and not isinstance(found[1], T.ArrayType):
            return df.withColumn("_v", js_string(*found)).where("_v is not null")
        return df.withColumn("_v", F.explode(F.array_distinct(field_values(df.schema, self.key))))

    def lines(self) -> DataFrame:
        """(v, vs, slug) of the index page with one look-ahead row, in reading order."""
        self.check()
        rows = self._order_values(self.to_df()).select(F.col("_v").alias("v"), F.col("slug").alias("vs"), "slug")
        sorted_by: Callable[[Column], Column] = (lambda c: F.collate(c, "UNICODE")) if self.collation == UNICODE else (lambda c: c)
        rising = (self.direction == "asc") == (self.reading == AFTER)
        if self.token is not None:
            order, slug = decode_cursor(self.token)
            v, s = sorted_by(F.col("v")), sorted_by(F.col("slug"))
            cv, cs = sorted_by(F.lit(order.get(self.key, slug))), sorted_by(F.lit(slug))
            rows = rows.where((v > cv) | ((v == cv) & (s > cs)) if rising else (v < cv) | ((v == cv) & (s < cs)))
        keys = [sorted_by(F.col("v")), sorted_by(F.col("slug")), F.col("v"), F.col("slug")]
        return rows.orderBy(*[k.asc() if rising else k.desc() for k in keys]).limit(self.size + 1)

    def _page(self) -> tuple[list[Row], PageInfo]:
        found = self.lines().collect()  # at most page size + 1 short rows
        more, rows = len(found) > self.size, found[: self.size]
        if self.reading == BEFORE:
            rows = rows[::-1]
        ends = [encode_cursor({self.key: r["v"]}, r["slug"]) for r in (rows[0], rows[-1])] if rows else [None, None]
        if not rows and self.filters and self.token is None:
            return rows, PageInfo(False, False)
        return rows, look_ahead_info(more, self.reading, self.token is not None, *ends)

    def peek(self) -> Page:
        """The index page only; no record is read."""
        rows, info = self._page()
        spark = self.engine.spark
        return Page(spark.createDataFrame([tuple(r) for r in rows], "v string, vs string, slug string"), info)

    def exec(self) -> Page:
        """The page's records, each once, in the page's order, with the joined relations."""
        rows, info = self._page()
        slugs = list(dict.fromkeys(r["slug"] for r in rows))
        return Page(self._records(slugs).drop("_pos"), info)

    def _records(self, slugs: list[str]) -> DataFrame:
        df = self.engine.by_slugs(self.source.name, slugs)
        for name in self.joins:
            df = self.engine.attach(df, self.source, name, **self.options)
        return df.orderBy("_pos")

    def find(self, slug: str) -> Row:
        found = self._records([slug]).drop("_pos").limit(1).collect()
        if not found:
            raise LookupError(f"Slug '{slug}' not found in {self.source.name}")
        return found[0]

"""The engine: a catalog over tables and files, as DataFrames with a slug."""

from __future__ import annotations

import logging
import re
from collections.abc import Callable, Iterable, Mapping
from functools import reduce
from operator import and_, or_
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.functions.values import INTEGRAL, SLUG_OF, among, integer_of
from marlstone.operators.indexers import indexed_by_record
from marlstone.operators import relations
from marlstone.plans.catalog import Catalog, Source
from marlstone.plans.query import Query
from marlstone.shipping import ship
from marlstone.sources import files
from marlstone.sources.parsers import Parser
from marlstone.sources.validation import Validator, validate


class Logger(Protocol):
    """What the engine says goes here. Record callbacks run on executors, so it must be possible to send it there."""

    def info(self, message: str, *args: Any) -> None: ...

    def warning(self, message: str, *args: Any) -> None: ...


class CacheProvider(Protocol):
    """Keeps the DataFrames of cached sources by name."""

    def get(self, name: str) -> DataFrame | None: ...

    def set(self, name: str, value: DataFrame) -> None: ...

    def has(self, name: str) -> bool: ...

    def delete(self, name: str) -> None: ...


class MemoryCache:
    def __init__(self) -> None:
        self.kept: dict[str, DataFrame] = {}

    def get(self, name: str) -> DataFrame | None:
        return self.kept.get(name)

    def set(self, name: str, value: DataFrame) -> None:
        self.kept[name] = value

    def has(self, name: str) -> bool:
        return name in self.kept

    def delete(self, name: str) -> None:
        self.kept.pop(name, None)


class Engine:
    """custom_index: {"source.field": expression of the source's columns}. record_index: {"source.field": callback},
    which gets a record as a dict and gives a value, a list of values or None. strict: dangling keys of joined relations raise.
    """

    def __init__(
        self,
        spark: SparkSession,
        catalog: Catalog,
        root: str = "",
        *,
        frames: Mapping[str, DataFrame] | None = None,
        custom_index: Mapping[str, Callable[[DataFrame], Column]] | None = None,
        parsers: Mapping[str, Parser] | None = None,
        validator: Validator | None = validate,
        strict: bool = False,
        record_index: Mapping[str, Callable[[dict], Any]] | None = None,
        logger: Logger | None = None,
        cache: CacheProvider | None = None,
    ):
        ship(spark)
        self.spark, self.catalog, self.root, self.strict = spark, catalog, root, strict
        self.frames, self.custom_index = dict(frames or {}), dict(custom_index or {})
        self.parsers, self.validator = dict(parsers or {}), validator
        self.record_index = dict(record_index or {})
        self.logger = logger or logging.getLogger("marlstone")
        self.cache_provider = cache if cache is not None else MemoryCache()

    def from_(self, name: str) -> Query:
        return Query(self, self.catalog[name])

    def frame(self, name: str, fields: Iterable[str] = ()) -> DataFrame:
        """A source's rows with slug, raw (for files) and its custom index columns; those that come from a record callback only if they are among the fields."""
        source = self.catalog[name]
        asked = [f for f in source.custom_index if f in set(fields) and f"{name}.{f}" in self.record_index]
        df = self._rows(name, source)
        for field in asked:
            df = indexed_by_record(df, field, self.record_index[f"{name}.{field}"], f"{name}.{field}", self.logger)
        return df

    def _rows(self, name: str, source: Source) -> DataFrame:
        if (kept := self.cache_provider.get(name)) is not None:
            return kept
        if name in self.frames:
            df = self._with_slug(self.frames[name], source)
        elif source.kind == "table":
            df = self._with_slug(self.spark.read.parquet(self._path(source)), source)
        else:
            df = files.read_source(self.spark, source, source.root or self.root, self.parsers, self.validator)
        for field in source.custom_index:
            if make := self.custom_index.get(f"{name}.{field}"):
                df = df.withColumn(field, make(df))
        return df

    def _path(self, source: Source) -> str:
        root = source.root or self.root
        return f"{root.rstrip('/')}/{source.pattern}" if root else source.pattern

    @staticmethod
    def _with_slug(df: DataFrame, source: Source) -> DataFrame:
        if "slug" in df.columns and not source.key:
            return df
        keys = [F.col(k).cast("string") for k in source.key]
        if len(keys) > 1:
            return df.withColumn("slug", F.concat_ws("--", *keys))
        others = [F.col(f"`{c}`") for c in df.columns if c != "slug"]
        return df.select(*others, keys[0].alias("slug", metadata={SLUG_OF: source.key[0]}))

    @staticmethod
    def has_slug(source: Source, schema: T.StructType, slugs: list[str]) -> Column:
        """Whether a row has one of the slugs, looked up in the columns that a table's slug is made of, for the scan to push down."""
        kinds = [schema[k].dataType for k in source.key]
        if len(kinds) == 1:
            return among(F.col(source.key[0]), kinds[0], slugs)
        if len(kinds) > 1 and all(isinstance(k, INTEGRAL) for k in kinds):
            split = [parts for s in slugs if len(parts := re.findall(r"(?:^|(?<=--))-?[0-9]+(?=--|$)", s)) == len(kinds) and "--".join(parts) == s]
            numbers = [[integer_of(p, k) for p, k in zip(parts, kinds, strict=True)] for parts in split]
            rows = [reduce(and_, [F.col(c) == n for c, n in zip(source.key, row, strict=True)]) for row in numbers if None not in row]
            return reduce(or_, rows) if rows else F.lit(False)
        return F.col("slug").isin(slugs) if slugs else F.lit(False)

    def by_slugs(self, name: str, slugs: list[str]) -> DataFrame:
        """The rows of a few slugs with _pos, the slug's place in the list."""
        df, source = self.frame(name), self.catalog[name]
        wanted = list(dict.fromkeys(slugs))
        df = df.where(self.has_slug(source, df.schema, wanted))
        place = F.array_position(F.array(*[F.lit(s) for s in wanted]).cast("array<string>"), F.col("slug"))
        return df.withColumn("_pos", place)

    def get_many(self, name: str, slugs: list[str]) -> DataFrame:
        """Rows in the order of the slugs; a slug without a row raises."""
        df = self.by_slugs(name, slugs)
        lost = set(slugs) - {r[0] for r in df.select("slug").collect()}  # as many as were asked for
        if lost:
            raise LookupError(f"Failed to load by slug: {sorted(lost)}")
        return df.orderBy("_pos").drop("_pos")

    def attach(self, df: DataFrame, source: Source, name: str, match: str = "exact") -> DataFrame:
        relation = source.relations[name]
        target = self.frame(relation.to)
        if self.strict and relation.kind in ("hasOne", "hasMany"):
            lost = relations.dangling(df, relation, target).limit(1).collect()
            if lost:
                raise relations.DanglingKeyError(f"{source.name}.{name}: '{lost[0]['key']}' of '{lost[0]['slug']}' not found in {relation.to}")
        return relations.attach(df, name, relation, target, self.frame(relation.through) if relation.through else None, match)

    def cache(self, name: str) -> DataFrame:
        """Keeps a source in memory and on disk until evict()."""
        if not self.cache_provider.has(name):
            self.logger.info("caching source %s", name)
            self.cache_provider.set(name, self.frame(name).persist())
        return self.cache_provider.get(name)

    def prefetch(self, *names: str) -> int:
        """Reads sources into the cache; how many rows they have."""
        return sum(self.cache(n).count() for n in names)

    def evict(self, name: str) -> None:
        if (kept := self.cache_provider.get(name)) is not None:
            self.cache_provider.delete(name)
            kept.unpersist()

    def views(self) -> None:
        """Registers all sources as temporary views, for Spark SQL."""
        for name in self.catalog:
            self.frame(name).createOrReplaceTempView(name)

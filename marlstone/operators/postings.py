"""The prefix index: postings of every indexed field, as a partitioned Parquet table.

A posting says that a value v of a field belongs to the record `slug`; vs is the record that
owns the value (the record itself, or for a relation's field the related one). p is where
the value's first characters put it; a probe names p, so that only its partitions are read,
and v, which is sorted within them. ref lists the prefixes of all of the record's fields.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.values import field_values, prefix_of, prefix_path
from marlstone.operators import relations

if TYPE_CHECKING:
    from marlstone.plans.engine import Engine

SCHEMA = "v string, vs string, slug string, ref map<string,array<string>>, source string, field string, p string"
COLUMNS = ("v", "vs", "slug", "ref", "source", "field", "p")
KEY = ("source", "field", "v", "vs", "slug")


def _lines(df: DataFrame, names: dict[str, str], depths: dict[str, int]) -> Column:
    """An array of (v, field, p) for every distinct value of the fields {name in the index: path in df}."""

    def of(name: str, path: str) -> Column:
        place = lambda v: F.struct(v.alias("v"), F.lit(name).alias("field"), prefix_path(v, depths[name]).alias("p"))
        return F.transform(F.array_distinct(field_values(df.schema, path)), place)

    return F.concat(*[of(n, p) for n, p in names.items()])


def postings(engine: Engine, name: str, fields: Mapping[str, int] | None = None) -> DataFrame:
    """(v, vs, slug, source, field, p): the postings of a source's fields {field: depth}, all of them unless given, without ref.

    The source is read once for its own fields, and its pairs with related records are made
    once for each relation.
    """
    depths, source = dict(engine.catalog.indexes(name) if fields is None else fields), engine.catalog[name]
    own, related = {}, {}
    for field in depths:
        first, _, rest = field.partition(".")
        if rest and first in source.relations:
            related.setdefault(first, {})[field] = rest
        else:
            own[field] = field
    df, parts = engine.frame(name, depths), []
    if own:
        parts.append(df.select(F.col("slug").alias("vs"), "slug", F.explode(_lines(df, own, depths)).alias("x")))
    for first, names in related.items():
        relation = source.relations[first]
        target = engine.frame(relation.to)
        pairs = relations.linked(df, relation, target, engine.frame(relation.through) if relation.through else None)
        values = target.select(F.col("slug").alias("vs"), F.explode(_lines(target, names, depths)).alias("x"))
        parts.append(pairs.select(F.col("l_slug").alias("slug"), F.col("t_slug").alias("vs")).distinct().join(values, "vs").select("vs", "slug", "x"))
    return reduce(DataFrame.unionByName, parts).select("x.v", "vs", "slug", F.lit(name).alias("source"), "x.field", "x.p")


def field_postings(engine: Engine, name: str, field: str, depth: int) -> DataFrame:
    """(v, vs, slug, source, field, p) of one field."""
    return postings(engine, name, {field: depth})


def ref_map(rows: DataFrame) -> DataFrame:
    """(source, slug, ref): the sorted distinct prefixes of each of a record's fields."""
    by_field = rows.groupBy("source", "slug", "field").agg(F.array_sort(F.collect_set("p")).alias("ps"))
    entries = F.array_sort(F.collect_list(F.struct("field", "ps")))
    return by_field.groupBy("source", "slug").agg(F.map_from_entries(entries).alias("ref"))


def with_ref(rows: DataFrame) -> DataFrame:
    return rows.join(ref_map(rows), ["source", "slug"]).select(*COLUMNS)


def build_index(engine: Engine, path: str, names: list[str] | None = None, compression: str = "zstd") -> list[str]:
    """Writes the postings of the sources, one job for each; the sources written."""
    done = names or list(engine.catalog)
    for name in done:
        rows = with_ref(postings(engine, name))
        write_postings(rows, path, compression)
    return done


def write_postings(rows: DataFrame, path: str, compression: str = "zstd") -> None:
    """Replaces the partitions that rows have rows of. A field's few frequent prefixes are spread over several files."""
    spread = F.pmod(F.xxhash64("v"), F.lit(8))
    dealt = rows.repartition("source", "field", "p", spread).sortWithinPartitions("source", "field", "p", "v", "vs")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", compression).partitionBy("source", "field", "p").parquet(path)


def read_index(spark, path: str) -> DataFrame:
    """The schema is given: inferring it would read 0061 as a number. An empty value's prefix is stored as null."""
    return spark.read.schema(SCHEMA).parquet(path).withColumn("p", F.coalesce("p", F.lit("")))


def probe(index: DataFrame, source: str, field: str, op: str, value, depth: int = 1) -> DataFrame:
    """The postings whose v is equal to, starts with, or is among the value(s)."""
    rows = index.where((F.col("source") == source) & (F.col("field") == field))
    if op == "startsWith":
        place = prefix_of(value, depth)
        at: Column = F.col("p").startswith(place) if len(value) < depth else F.col("p") == place
        return rows.where((at if value else F.lit(True)) & F.col("v").startswith(value))
    wanted = list(value) if op == "in" else [value]
    places = sorted({prefix_of(w, depth) for w in wanted})
    return rows.where(F.col("p").isin(places) & F.col("v").isin(wanted)) if wanted else rows.where(F.lit(False))


def prefix_dictionary(rows: DataFrame) -> DataFrame:
    """(source, field, dir, children): the distinct next steps below every folder of the prefix tree, sorted."""
    parts = F.split("p", "/")
    steps = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i - 1), "/").alias("dir"), F.get(parts, i - 1).alias("child")))
    each = rows.where("p <> ''").select("source", "field", F.explode(steps).alias("s")).select("source", "field", "s.dir", "s.child")
    return each.groupBy("source", "field", "dir").agg(F.array_sort(F.collect_set("child")).alias("children"))


def leaves(rows: DataFrame) -> DataFrame:
    """(source, field, first, last): the smallest and largest prefix of each field."""
    return rows.groupBy("source", "field").agg(F.min("p").alias("first"), F.max("p").alias("last"))


def owners(rows: DataFrame) -> DataFrame:
    """Postings with each record once: the first by value."""
    return rows.groupBy("source", "slug").agg(F.min_by(F.struct("v", "vs", "field"), F.struct("v", "vs", "field")).alias("x")).select("source", "slug", "x.v", "x.vs", "x.field")


def export_lines(rows: DataFrame, path: str, gzip: bool = True) -> None:
    """The postings as JSON lines {v, vs, ref: {slug: {field: [prefixes]}}} by source, field and prefix, for other readers. A line for each record, so that a frequent value is no group to gather."""
    lines = rows.select("source", "field", "p", "v", "vs", F.create_map("slug", "ref").alias("ref"))
    dealt = lines.repartition("source", "field", "p", F.pmod(F.xxhash64("v", "vs"), F.lit(8))).sortWithinPartitions("source", "field", "p", "v", "vs")
    writer = dealt.write.mode("overwrite").partitionBy("source", "field", "p")
    (writer.option("compression", "gzip") if gzip else writer).json(path)


def manifest(spark, path: str, glob: str = "*") -> DataFrame:
    """(file): the files of an index or export."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return files.select(F.col("path").alias("file")).orderBy("file")


def write_manifest(spark, path: str, target: str, glob: str = "*.json*") -> None:
    """The list of files as one JSON array, a line for each, written in order without being gathered."""
    files = manifest(spark, path, glob)
    first = files.agg(F.min("file")).first()[0]
    named = files.select(F.lit(0).alias("part"), "file", F.concat(F.when(F.col("file") == F.lit(first), "[").otherwise(","), F.to_json(F.array("file"))).alias("line"))
    lines = named.select("part", "file", F.regexp_replace("line", r"^(.)\[(.*)\]$", "$1$2").alias("value"))
    end = spark.range(1).select(F.lit(1).alias("part"), F.lit(None).cast("string").alias("file"), F.lit("]" if first is not None else "[]").alias("value"))
    lines.union(end).repartition(1).sortWithinPartitions("part", "file").select("value").write.mode("overwrite").text(target)


def read_manifest(spark, target: str) -> DataFrame:
    """(file): the files of a written manifest."""
    lines = spark.read.text(target).select(F.regexp_extract("value", r'^[\[,](".*")$', 1).alias("q")).where("q <> ''")
    return lines.select(F.from_json(F.concat(F.lit("["), "q", F.lit("]")), "array<string>")[0].alias("file"))


def schema_json(engine: Engine, name: str) -> str:
    return json.dumps(json.loads(engine.frame(name).schema.json()))

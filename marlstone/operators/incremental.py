"""Changes between two states of a source, and their effect on the index.

A change feed has rows (status, source, slug, fields): A, D or M, and the values of the
indexed fields before (D, M) or after (A). A modification is a deletion and an addition. A
changed record also changes the postings of the records related to it, whose sources need
not be in the feed.
"""

from __future__ import annotations

from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions.values import field_values
from marlstone.operators import postings as index
from marlstone.operators import relations

if TYPE_CHECKING:
    from marlstone.plans.engine import Engine

FEED = "status string, source string, slug string, fields map<string,array<string>>"


def fields_of(df: DataFrame, names: list[str]) -> DataFrame:
    """(slug, fields): the values of the named fields."""
    pairs = [x for n in names for x in (F.lit(n), field_values(df.schema, n))]
    return df.select("slug", F.create_map(*pairs).alias("fields"))


def snapshot_diff(base: DataFrame, head: DataFrame, source: str, names: list[str]) -> DataFrame:
    """The change feed between two states. Records whose named fields are equal are left out."""
    old, new = fields_of(base, names).withColumnsRenamed({"slug": "o", "fields": "of"}), fields_of(head, names).withColumnsRenamed({"slug": "n", "fields": "nf"})
    both = old.join(new, F.col("o") == F.col("n"), "full")
    status = F.when(F.col("o").isNull(), "A").when(F.col("n").isNull(), "D").when(~F.map_entries("of").eqNullSafe(F.map_entries("nf")), "M")
    rows = both.select(status.alias("status"), F.lit(source).alias("source"), F.coalesce("n", "o").alias("slug"), F.coalesce("of", "nf").alias("fields"))
    return rows.where("status is not null")


def affected(engine: Engine, feed: DataFrame, name: str) -> DataFrame:
    """(slug) of the records of a source whose postings may change: changed ones, and those related to changed ones."""
    source = engine.catalog[name]
    own = feed.where(F.col("source") == name).select("slug")
    parts = [own]
    df = engine.frame(name)
    indexed = {f.partition(".")[0] for f in engine.catalog.indexes(name) if "." in f}
    for key, relation in source.relations.items():
        if key not in indexed:
            continue
        for other, path in ((relation.to, relation.foreign), (relation.through, relation.through_foreign)):
            if other is None:
                continue
            changed = feed.where(F.col("source") == other)
            before = changed.select(F.explode(F.coalesce(F.col("fields")[path], F.array("slug") if path == "slug" else F.array().cast("array<string>"))).alias("k"))
            rows = engine.frame(other)
            after = rows.join(changed.select("slug"), "slug", "left_semi").select(F.explode(field_values(rows.schema, path)).alias("k"))
            if relation.through is not None and other == relation.to:
                through = engine.frame(relation.through)
                ends = through.select(F.explode(field_values(through.schema, relation.through_local)).alias("k"), field_values(through.schema, relation.through_foreign).alias("keys"))
                touched = ends.join(before.union(after), "k", "left_semi").select(F.explode("keys").alias("k"))
            else:
                touched = before.union(after)
            local = relations.keyed(df, relation.local, "l_").join(touched, F.col("l_key") == F.col("k"), "left_semi")
            parts.append(local.select(F.col("l_slug").alias("slug")))
    return reduce(DataFrame.union, parts).distinct()


def updated(engine: Engine, rows: DataFrame, feed: DataFrame, name: str, touched: DataFrame | None = None) -> DataFrame:
    """The source's postings after the changes; engine's frames are the new state. touched: affected(), if it is at hand."""
    touched = affected(engine, feed, name) if touched is None else touched
    kept = rows.where(F.col("source") == name).join(touched, "slug", "left_anti").select(*index.COLUMNS)
    fresh = index.postings(engine, name).join(touched, "slug", "left_semi")
    return kept.unionByName(index.with_ref(fresh))


def apply_changes(engine: Engine, path: str, feed: DataFrame, staging: str) -> DataFrame:
    """Rewrites the partitions of the index at `path` that a feed touches; (source, field, p) of those.

    What the partitions shall hold is written to the staging folder first, since the index
    can't be read and overwritten at once; partitions that become empty are emptied.
    """
    spark = engine.spark
    rows = index.read_index(spark, path)
    done = spark.createDataFrame([], "source string, field string, p string")
    for name in engine.catalog:
        staged = f"{staging.rstrip('/')}/{name}"
        affected(engine, feed, name).write.mode("overwrite").parquet(f"{staged}/touched")
        touched = spark.read.schema("slug string").parquet(f"{staged}/touched")
        if touched.isEmpty():
            continue
        old = rows.where(F.col("source") == name)
        new = updated(engine, rows, feed, name, touched)
        before = old.join(touched, "slug", "left_semi").select("source", "field", "p")
        after = index.postings(engine, name).join(touched, "slug", "left_semi").select("source", "field", "p")
        places = before.union(after).distinct()
        new.join(places, ["source", "field", "p"], "left_semi").select(*index.COLUMNS).write.mode("overwrite").parquet(f"{staged}/rows")
        places.write.mode("overwrite").parquet(f"{staged}/places")
        ready, places = spark.read.parquet(f"{staged}/rows"), spark.read.parquet(f"{staged}/places")
        index.write_postings(ready.select(*index.COLUMNS), path)
        empty = places.join(ready, ["source", "field", "p"], "left_anti")
        for row in empty.toLocalIterator():  # folder names, a part of them at a time
            _remove(spark, path, row)
        done = done.unionByName(places)
    return done


def _remove(spark, path: str, place) -> None:
    jvm = spark._jvm
    escape = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    folder = jvm.org.apache.hadoop.fs.Path("/".join([path.rstrip("/"), *(f"{c}={escape(place[c]) if place[c] else '__HIVE_DEFAULT_PARTITION__'}" for c in ("source", "field", "p"))]))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)

"""Sources of content files: scan, parse, check, flatten lists, give every record its slug.

Files are listed by Spark, so any store that it reads will do. They are parsed in Arrow
batches; of a record the JSON text comes back, which Spark reads by the declared schema.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.paths import base_dir, glob_regex, is_glob, slug_of
from marlstone.plans.catalog import Source
from marlstone.shipping import ship
from marlstone.sources import parsers as registry
from marlstone.sources.mini_yaml import plain
from marlstone.sources.parsers import Parser
from marlstone.sources.validation import Validator, record_type


def text_files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """(path, raw): the files under root that a pattern names, with paths below root."""
    root = root.rstrip("/")
    top = f"{root}/{base_dir(pattern)}" if is_glob(pattern) else f"{root}/{pattern}"
    reader = spark.read.option("recursiveFileLookup", True)
    whole = reader.text(top, wholetext=True).select(F.col("_metadata.file_path").alias("full"), F.col("value").alias("raw"))
    below = F.regexp_replace(F.url_decode(F.replace(F.col("full"), F.lit("+"), F.lit("%2B"))), "^.*?" + re.escape(root.split("://")[-1].lstrip("/")) + "/", "")
    return whole.select(below.alias("path"), "raw").where(F.col("path").rlike(glob_regex(pattern)))


def records_of(path: str, raw: str, source: Source, known: Mapping[str, Parser], validator: Validator | None) -> Iterator[tuple[str, str]]:
    """(slug, record as JSON) of a file."""
    data = registry.parse(source.kind, raw, dict(known))
    many = isinstance(data, list)
    for record in data if many else [data]:
        if validator and source.schema:
            kinds = source.schema.get("type")
            validator(record, source.schema.get("items") or {} if kinds == "array" else source.schema, source.name)
        slug = record.get("slug")
        if not many and is_glob(source.pattern):
            own = slug_of(path, source.pattern)
            if slug is not None and str(slug) not in own:
                raise ValueError(f"Slug mismatch: {slug} in {path}, which is {own}")
            slug = own
        elif slug is None:
            slug = slug_of(path.rpartition("/")[2], "")
        yield str(slug), json.dumps(plain(record), ensure_ascii=False)


def read_source(spark: SparkSession, source: Source, root: str, parsers: Mapping[str, Parser], validator: Validator | None) -> DataFrame:
    ship(spark)
    known = registry.parsers() | dict(parsers)
    if source.kind not in known:
        raise ValueError(f"No parser registered for type: {source.kind}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            rows = [(slug, raw, record) for path, raw in zip(files["path"], files["raw"], strict=True) for slug, record in records_of(path, raw, source, known, validator)]
            yield pd.DataFrame(rows, columns=["slug", "raw", "record"])

    parsed = text_files(spark, root, source.pattern).mapInPandas(run, "slug string, raw string, record string")
    columns = F.from_json("record", record_type(source.schema))
    return parsed.withColumn("r", columns).select("slug", "r.*", "raw")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a line each; blank lines and a missing last line break don't matter."""
    return text_lines(spark, path).select(F.from_json("value", schema).alias("r")).select("r.*")


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a text file that aren't blank."""
    return spark.read.text(path).where(F.trim("value") != "")


def parsed_column(df: DataFrame, kind: str, schema: str, raw: str = "raw", key: str = "slug") -> DataFrame:
    """(key, the schema's columns): a column of file contents through a parser, a row for every record."""
    ship(df.sparkSession)
    parser = registry.parsers()[kind]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = [(slug, json.dumps(plain(x), ensure_ascii=False)) for slug, text in zip(rows["k"], rows["t"], strict=True) for data in [parser(text)] for x in (data if isinstance(data, list) else [data])]
            yield pd.DataFrame(found, columns=["k", "record"])

    got = df.select(F.col(key).alias("k"), F.col(raw).alias("t")).mapInPandas(run, "k string, record string")
    return got.select(F.col("k").alias(key), F.from_json("record", schema).alias("r")).select(key, "r.*")

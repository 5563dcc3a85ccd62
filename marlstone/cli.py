"""python -m marlstone.cli index CONFIG OUT [...] | schema CONFIG OUT"""

from __future__ import annotations

import argparse
import importlib
import json
import sys

from pyspark.sql import SparkSession

from marlstone.functions.export import table_definitions, type_definitions
from marlstone.operators import incremental, postings
from marlstone.plans.catalog import Catalog
from marlstone.plans.engine import Engine


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="marlstone")
    commands = top.add_subparsers(dest="command", required=True)
    index = commands.add_parser("index", help="build or update an index")
    index.add_argument("config")
    index.add_argument("out")
    index.add_argument("--root", default="")
    index.add_argument("--incremental", action="store_true")
    index.add_argument("--diff-file", help="change feed in JSON lines, for --incremental")
    index.add_argument("--export", help="folder for the index as JSON lines")
    index.add_argument("--no-gzip", action="store_true")
    index.add_argument("--manifest", help="where to list the exported files")
    index.add_argument("--custom", help="module:attribute with the custom indexers")
    schema = commands.add_parser("schema", help="write record types")
    schema.add_argument("config")
    schema.add_argument("out")
    return top


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        given = parser().parse_args(args)
    except SystemExit as end:
        return 1 if end.code else 0
    with open(given.config, encoding="utf-8") as file:
        catalog = Catalog.from_json(json.load(file))
    if given.command == "schema":
        with open(f"{given.out.rstrip('/')}/record_types.py", "w", encoding="utf-8") as file:
            file.write(type_definitions(catalog))
        with open(f"{given.out.rstrip('/')}/tables.json", "w", encoding="utf-8") as file:
            json.dump(table_definitions(catalog), file, indent=1)
        return 0
    if given.incremental and not given.diff_file:
        print("--incremental needs --diff-file", file=sys.stderr)
        return 1
    spark = spark or SparkSession.builder.getOrCreate()
    custom = {}
    if given.custom:
        module, _, name = given.custom.partition(":")
        custom = getattr(importlib.import_module(module), name)
    engine = Engine(spark, catalog, given.root, custom_index=custom)
    if given.incremental:
        incremental.apply_changes(engine, given.out, spark.read.schema(incremental.FEED).json(given.diff_file), f"{given.out.rstrip('/')}-staging")
    else:
        storage_clear(spark, given.out)
        postings.build_index(engine, given.out)
    if given.export:
        postings.export_lines(postings.read_index(spark, given.out), given.export, gzip=not given.no_gzip)
        if given.manifest:
            postings.write_manifest(spark, given.export, given.manifest)
    return 0


def storage_clear(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


if __name__ == "__main__":
    sys.exit(main())

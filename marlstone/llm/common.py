"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.shared import written
from marlstone.shipping import ship

__all__ = ["release", "spare", "table", "text_digest", "text_or_empty", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def text_digest(name: str = "text"):
    """16 bytes that only rows of the same text share; null text is empty."""
    return F.unhex(F.md5(text_or_empty(name)))


def release() -> None:
    """Gives memory that a Python worker no longer needs back to the system: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not the C library that has it
        ctypes.CDLL(None).malloc_trim(0)


def spare(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores in front until none is a column of df."""
    taken = {c.lower() for c in df.columns}

    def free(name: str) -> str:
        while name.lower() in taken:
            name = f"_{name}"
        return name

    return [free(f"_{n}") for n in names]

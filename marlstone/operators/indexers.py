"""Index values that a callback works out from whole records."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING, Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from marlstone.shipping import ship

if TYPE_CHECKING:
    from marlstone.plans.engine import Logger


def texts(value: Any) -> list[str]:
    """A callback's value or values as the index has them: text, without nulls."""
    if value is None:
        return []
    if isinstance(value, (list, tuple, set)):
        return [t for v in value for t in texts(v)]
    if isinstance(value, bool):
        return ["true" if value else "false"]
    if isinstance(value, float) and value.is_integer():
        return [str(int(value))]
    return [str(value)]


def indexed_by_record(df: DataFrame, column: str, callback: Callable[[dict], Any], name: str, logger: Logger) -> DataFrame:
    """df with an array of the values that the callback gives for each row. A row for which it raises is logged and has none."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for record in batch.to_pylist():
                try:
                    found.append(texts(callback(record)))
                except Exception as problem:  # noqa: BLE001  whatever the callback raises
                    logger.warning("custom index %s skips record %s: %r", name, record.get("slug"), problem)
                    found.append([])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.string()))], [*batch.schema.names, column])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(column, T.ArrayType(T.StringType()))]))

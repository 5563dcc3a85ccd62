"""Keeping an index up to date from a stream of change feeds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from marlstone.operators.incremental import FEED, apply_changes
from marlstone.plans.engine import Engine


def follow(engine: Engine | Callable[[], Engine], feeds: str, index: str, checkpoint: str, staging: str, *, once: bool = True) -> StreamingQuery:
    """Applies JSON change feeds that arrive in a folder, batch by batch.

    A batch that is repeated after a failure gives the same index: its records' postings are
    replaced, not added. With once, what is there is worked through and the query ends.
    """

    def apply(batch: DataFrame, number: int) -> None:
        apply_changes(engine() if callable(engine) else engine, index, batch, f"{staging}/{number}")

    spark = (engine() if callable(engine) else engine).spark
    writer = spark.readStream.schema(FEED).json(feeds).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()

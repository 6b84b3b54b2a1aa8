"""The change log as a stream: micro-batches are appended to a collection, and state is the replay of its log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from skarn.collection import Collection

OPS = "op string, id string, doc string"


def read_changes(spark: SparkSession, path: str) -> DataFrame:
    """New JSON-lines files of operations as they land in a folder."""
    return spark.readStream.schema(OPS).json(path)


def apply_to(collection: Collection) -> Callable[[DataFrame, int], None]:
    """What a micro-batch does: append its operations, then compact if that is due. A batch that was applied already is skipped."""

    def step(batch: DataFrame, number: int) -> None:
        done = collection._meta.get("stream", -1)
        if number <= done:
            return
        collection._meta["stream"] = number
        collection._append(batch.select("op", "id", "doc"))
        collection.sync()

    return step


def follow(collection: Collection, path: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Apply the operations that land in ``path``: all there are now, or every ``interval``."""
    writer = read_changes(collection.spark, path).writeStream.foreachBatch(apply_to(collection)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()

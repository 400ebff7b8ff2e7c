"""Appending newly extracted rows as they arrive: the batch rules, a micro-batch at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.dataset import DATASET, accepted, string_key


def append_new(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Rows of a stream (DATASET, seq) whose key the Parquet table at path lacks are appended to it. A batch that is run again adds nothing."""

    def each(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        base = spark.read.schema(batch.select(*DATASET).schema).parquet(path)
        accepted(base, batch, string_key(), ["seq"]).filter("added").select(*DATASET).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Incremental ingest: new files join a keyed table; an extension of the batch upsert."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sinks.committed import CommittedTable
from ..sinks.tables import KEY


def upsert_stream(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, keys: Sequence[str] = KEY, buckets: int = 64, writer: str = "stream") -> StreamingQuery:
    """Read Parquet files as they come and upsert each micro-batch into the committed table at target.

    A batch rewrites the buckets of its keys only and is committed with its
    number, so one that runs again after a restart changes nothing. Streams
    into one table take different writers.
    """

    def apply(batch: DataFrame, number: int) -> None:
        CommittedTable(batch.sparkSession, target, keys, buckets).upsert(batch, writer, number)

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

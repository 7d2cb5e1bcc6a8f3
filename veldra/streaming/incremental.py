"""Appending to an index as files arrive: each file is chunked, embedded and stored once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def follow(spark: SparkSession, inbox: str, schema: str, chunk: Callable[[DataFrame], DataFrame], embed: Callable[[DataFrame], DataFrame], store: str, checkpoint: str) -> StreamingQuery:
    """Process what lies in ``inbox`` and is new since the last run, then stop.

    The checkpoint remembers files already taken. A batch that is run again after a failure stores the
    chunks and the vectors that are not there yet, each by its own table, so nothing is stored twice and
    nothing is left out, wherever the failure fell.
    """
    from veldra.sources.stores import pending

    def take(batch: DataFrame, _: int) -> None:
        chunks = chunk(batch).persist()
        try:
            embed(pending(chunks, spark, f"{store}/vectors")).write.mode("append").parquet(f"{store}/vectors")
            pending(chunks, spark, f"{store}/chunks").write.mode("append").parquet(f"{store}/chunks")
        finally:
            chunks.unpersist()

    stream = spark.readStream.schema(schema).parquet(inbox)
    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

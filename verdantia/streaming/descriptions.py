"""Descriptions as a stream: what arrives in a folder becomes observations, written once for each micro-batch.

``observe`` replaces the folder of its batch number, so a batch that is repeated after a failure leaves no row twice.
The checkpoint must lie in storage that driver and executors share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans import traits as P

SCHEMA = "taxon string, source string, text string"


def arriving(spark: SparkSession, folder: str, kind: str = "json", schema: str = SCHEMA) -> DataFrame:
    return spark.readStream.schema(schema).format(kind).load(folder)


def observe(stream: DataFrame, parts: dict[str, str], out: str, checkpoint: str, traits: DataFrame | None = None, *, once: bool = False) -> StreamingQuery:
    """Starts the query; ``once``: what has arrived by now, then stops."""

    def store(batch: DataFrame, number: int) -> None:
        P.observations(batch, parts, traits).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def counts_by_window(stream: DataFrame, time: str, group: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Arrivals for each window and group; rows later than ``late`` are left out, which bounds the state."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("window"), group).agg(F.count("*").alias("n"))

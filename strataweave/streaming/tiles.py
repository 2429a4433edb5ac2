"""Ensemble statistics of tiles as they arrive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.ensemble import ensemble


def unfinished(tiles: DataFrame, written: DataFrame) -> DataFrame:
    """Tiles that the output doesn't hold yet."""
    return tiles.join(written.select("tile_id").distinct(), "tile_id", "left_anti")


def ensemble_stream(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, stats: Sequence[str], files: int = 16) -> StreamingQuery:
    """Aggregates each batch of prediction files (a file holds whole tiles) and appends its statistics; ends when all are done.

    A batch's output carries its number and replaces itself if the batch is repeated after a failure.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        ensemble(batch, ["tile_id", "row", "col"], "v", stats).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

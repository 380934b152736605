"""The snapshot store as a stream: new files become rows as they are written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftlattice.sources.snapshots import SCHEMA


def snapshot_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    reader = spark.readStream.schema(SCHEMA).option("multiLine", "true").option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(folder).filter("graph IS NOT NULL").drop("_corrupt_record")

"""Incremental ingestion: what is new in a folder, each file exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def ingest(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, fmt: str = "json", transform=None, files: int = 1000) -> StreamingQuery:
    """Read files that earlier runs have not, transform them and append them to a Parquet sink; the query ends
    when there are no more. A run that is stopped resumes where its checkpoint left off."""
    rows: DataFrame = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files).load(source)
    rows = transform(rows) if transform else rows
    return rows.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

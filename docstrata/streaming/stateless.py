"""Streams: everything that works within a row applies to them unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from docstrata.config import Settings
from docstrata.operators import paragraphs


def candidates(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 64) -> DataFrame:
    """A stream of candidate paragraphs from Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def to_paragraphs(found: DataFrame, out: str, checkpoint: str, language: str | None = None, s: Settings = Settings()) -> StreamingQuery:
    """Clean, split, filter and pack what arrives, and append the paragraphs; ends when all that is there is done. Each
    file is taken once, also after a restart."""
    done = paragraphs.process(found, language, s)
    return done.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()

"""Document files as they land, one row a file, without state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def landing(spark: SparkSession, folder: str, glob: str = "*.pdf", files_per_batch: int = 100) -> DataFrame:
    """A stream of (path, content) of the files that appear in folder; feed it to sources.pdf."""
    reader = spark.readStream.format("binaryFile").schema(SCHEMA).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder).select("path", "content")

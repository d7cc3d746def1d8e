"""A folder that Parquet files are added to, as a source of streaming queries.

Queries that only project, filter and join a static side run as they are; sorts, limits and
window functions need all rows and are refused by Spark when the stream starts.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..sources.tables import Provider


class StreamFolder(Provider):
    """``folder/table.parquet`` read as files arrive, at most ``files`` of them in a step; streams need their schemas given."""

    def __init__(self, spark: SparkSession, folder: str, schemas: dict[str, str], files: int = 1000):
        self.spark, self.folder, self.schemas, self.files = spark, folder.rstrip("/"), schemas, files

    def read(self, entity):
        reader = self.spark.readStream.schema(self.schemas[entity.source.qualified]).option("maxFilesPerTrigger", self.files)
        return reader.parquet(f"{self.folder}/{entity.source.table}.parquet")

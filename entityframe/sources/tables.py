"""Providers of tables, by an entity's qualified name. Columns are checked when a table is bound."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..model.mapping import EntityDef
from ..model.milestoning import Instant


class Provider:
    def read(self, entity: EntityDef) -> DataFrame:
        raise NotImplementedError

    def table(self, entity: EntityDef, business: Instant = None, processing: Instant = None, columns: Sequence[str] = ()) -> DataFrame:
        """The entity's table. The query's dates and the columns that it uses are for sources that must be asked for them."""
        df = self.read(entity)
        check(entity, df.columns)
        return df


def check(entity: EntityDef, columns: Sequence[str]) -> None:
    missing = {p.column for p in entity.properties} | {j.left for j in entity.joins} | set(entity.milestoning.columns())
    missing -= set(columns)
    if missing:
        raise ValueError(f"table {entity.source.qualified} lacks columns {sorted(missing)}")


_schemas: dict[tuple[str, str], StructType] = {}


def parquet(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table; its schema is read once in an application, not for each query."""
    known = (spark.sparkContext.applicationId, path)
    if known not in _schemas:
        _schemas[known] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[known]).parquet(path)


class Frames(Provider):
    """DataFrames, or functions that make them, by qualified name."""

    def __init__(self, frames: dict[str, DataFrame | Callable[[], DataFrame]]):
        self.frames = frames

    def read(self, entity):
        found = self.frames[entity.source.qualified]
        return found if isinstance(found, DataFrame) else found()


class ParquetFolder(Provider):
    """``folder/table.parquet``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def read(self, entity):
        return parquet(self.spark, f"{self.folder}/{entity.source.table}.parquet")


class CsvFolder(Provider):
    """``folder/table.csv`` with the given schemas; no inference."""

    def __init__(self, spark: SparkSession, folder: str, schemas: dict[str, str], header: bool = True):
        self.spark, self.folder, self.schemas, self.header = spark, folder.rstrip("/"), schemas, header

    def read(self, entity):
        return self.spark.read.schema(self.schemas[entity.source.qualified]).csv(f"{self.folder}/{entity.source.table}.csv", header=self.header)


class Catalog(Provider):
    """Tables of the session's catalogues."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def read(self, entity):
        return self.spark.table(entity.source.qualified)


class Chain(Provider):
    """The first provider that knows a table."""

    def __init__(self, *providers: Provider):
        self.providers = providers

    def read(self, entity):
        for p in self.providers[:-1]:
            try:
                return p.read(entity)
            except KeyError:
                continue
        return self.providers[-1].read(entity)

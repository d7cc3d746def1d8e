"""GraphQL endpoints as a batch source. Temporal arguments go to the server; filters, groups, sorts and limits run in Spark."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..model.mapping import EntityDef
from ..model.milestoning import Instant, as_datetime
from .tables import Provider, check


@dataclass(frozen=True)
class Endpoint:
    """A list field of a server, and the names of its date arguments, if it has any."""

    url: str
    field: str
    schema: str
    processing_argument: str | None = None
    business_argument: str | None = None

    def arguments(self, business: Instant, processing: Instant) -> list[str]:
        out = []
        if self.business_argument and business is not None:
            out.append(f'{self.business_argument}: "{as_datetime(business):%Y-%m-%d}"')
        if self.processing_argument and processing is not None:
            out.append(f'{self.processing_argument}: "{as_datetime(processing):%Y-%m-%dT%H:%M:%S}.000Z"')
        return out

    def text(self, fields: list[str], business: Instant, processing: Instant) -> str:
        arguments = ", ".join(self.arguments(business, processing))
        return "{ " + self.field + (f"({arguments})" if arguments else "") + " { " + " ".join(fields) + " } }"


def fetch(url: str, query: str, field: str) -> list[dict]:
    """The rows of a list field; errors of the transport and of the server are raised, a missing field has no rows."""
    request = urllib.request.Request(url, json.dumps({"query": query}).encode(), {"Content-Type": "application/json"})
    with urllib.request.urlopen(request, timeout=60) as answer:
        body = json.load(answer)
    if body.get("errors"):
        raise RuntimeError(f"GraphQL errors: {body['errors']}")
    return (body.get("data") or {}).get(field) or []


class GraphQLSource(DataSource):
    """Options: url, query, field. The schema is given by the reader."""

    @classmethod
    def name(cls) -> str:
        return "entityframe_graphql"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options), schema)


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.options, self.schema = options, schema

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition):
        casts = {"double": float, "float": float, "int": int, "integer": int, "bigint": int, "long": int, "string": str, "boolean": bool}
        kinds = [(f.name, casts.get(f.dataType.simpleString(), lambda x: x)) for f in self.schema.fields]
        for row in fetch(self.options["url"], self.options["query"], self.options["field"]):
            yield tuple(None if row.get(n) is None else cast(row[n]) for n, cast in kinds)


class GraphQL(Provider):
    """Entities by qualified name. A request has the dates given to ``find_all`` and the fields that the query uses."""

    def __init__(self, spark: SparkSession, endpoints: dict[str, Endpoint]):
        self.spark, self.endpoints = spark, endpoints
        spark.dataSource.register(GraphQLSource)

    def table(self, entity: EntityDef, business: Instant = None, processing: Instant = None, columns: Sequence[str] = ()) -> DataFrame:
        e = self.endpoints[entity.source.qualified]
        schema = StructType.fromDDL(e.schema)
        check(entity, schema.names)
        used = [f for f in schema.fields if f.name in columns] or schema.fields[:1]  # a count needs rows only
        query = e.text([f.name for f in used], business, processing)
        return self.spark.read.format(GraphQLSource.name()).schema(StructType(used)).options(url=e.url, query=query, field=e.field).load()

"""Finders: entities with typed attributes, lazy associations, and immutable queries."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Row

from ..model.mapping import Join, Model, method_name
from ..model.milestoning import Instant, as_datetime
from .attributes import TYPES, Attribute
from .expr import Aggregate, Exists, Expr, NoOperation, Path, Predicate, Sort


class Related:
    """An entity at the end of a path of associations. Attributes and associations are looked up by name, when asked for."""

    def __init__(self, engine, root: str, path: Path, entity: str, join: Join | None):
        self._engine, self._root, self._path, self._join = engine, root, path, join
        self._entity = engine.model.entity(entity)
        self._links = engine.model.links[entity]

    def __getattr__(self, name: str):
        if name.startswith("__"):
            raise AttributeError(name)
        for p in self._entity.properties:
            if method_name(p.name) == name:
                prefix = f"{self._path[-1].title()} " if self._path else ""
                return lambda: TYPES[p.type](self._root, self._path, p.column, prefix + p.name)
        for key, join in self._links.items():
            if method_name(key) == name:
                return lambda: Related(self._engine, self._root, (*self._path, key), join.target, join)
        raise AttributeError(f"{self._entity.name} has no property or association {name}")

    def __dir__(self):
        return [*super().__dir__(), *(method_name(p.name) for p in self._entity.properties), *map(method_name, self._links)]

    def _existence(self, **kind) -> Exists:
        if self._join is None:
            raise ValueError("a root entity always exists")
        return Exists(self._root, self._path, self._join.right, **kind)

    def exists(self) -> Exists:
        """A row for each related row."""
        return self._existence()

    def exists_semi(self) -> Exists:
        """Rows that have a related row, once each; only as a term of the filter's top-level conjunction."""
        return self._existence(semi=True)

    def not_exists(self) -> Exists:
        return self._existence(negated=True)

    def attributes(self) -> list[Attribute]:
        return [getattr(self, method_name(p.name))() for p in self._entity.properties]


class Finder(Related):
    """The root entity of queries."""

    def __init__(self, engine, entity: str):
        super().__init__(engine, entity, (), entity, None)

    def count(self) -> Aggregate:
        return Aggregate(None, "count", "Count")

    def find_all(self, business_date: Instant, processing_valid_at: Instant, columns: list[Expr], filter: Predicate | None = None) -> Query:
        """A lazy query. Dates that the root's temporal kind doesn't use are not passed on, to joins neither."""
        asked = as_datetime(business_date), as_datetime(processing_valid_at)
        business, processing = self._entity.milestoning.gate(*asked)
        return Query(self._engine, self._entity.name, business, processing, tuple(columns), filter or NoOperation(), asked=asked)


@dataclass(frozen=True)
class Query:
    engine: object
    root: str
    business: Instant
    processing: Instant
    columns: tuple[Expr, ...]
    filter: Predicate
    order: tuple[Sort, ...] = ()
    groups: tuple[Expr, ...] = ()
    size: int | None = None
    asked: tuple[Instant, Instant] = (None, None)  # the dates as given, for sources that filter by dates themselves

    def order_by(self, *sorts: Sort) -> Query:
        return replace(self, order=sorts)

    def group_by(self, *attributes: Attribute) -> Query:
        return replace(self, groups=attributes)

    def limit(self, n: int) -> Query:
        return replace(self, size=n)

    def to_df(self, unique_names: bool = False) -> DataFrame:
        return self.engine.plan(self, unique_names)

    def to_rows(self) -> list[Row]:
        return self.to_df().collect()

    def to_sql(self, unique_names: bool = False) -> str:
        """The query as Spark SQL over the tables' qualified names."""
        from ..plans.planner import prepare, sql_text

        return sql_text(self.engine, prepare(self.engine, self, unique_names))

    def to_plan(self) -> str:
        """The optimised logical plan's text, for reading."""
        return self.to_df()._jdf.queryExecution().optimizedPlan().toString()


class Engine:
    """A model bound to a provider of tables; ``engine.Customer`` or ``engine.finder('Customer')`` begins a query."""

    def __init__(self, model: Model, provider):
        self.model, self.provider = model, provider

    def finder(self, entity: str) -> Finder:
        return Finder(self, entity)

    def __getattr__(self, name: str) -> Finder:
        if name in self.__dict__.get("model", Model("", [])).entities:
            return self.finder(name)
        raise AttributeError(name)

    def plan(self, query: Query, unique_names: bool = False) -> DataFrame:
        from ..plans.planner import frame, prepare

        return frame(self, prepare(self, query, unique_names))

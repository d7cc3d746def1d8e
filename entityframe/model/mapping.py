"""Entities and their mapping to tables, as plain immutable data."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from .milestoning import NONE, Milestoning

#: Primitive type names, and the Spark type of each.
PRIMITIVES = {"String": "string", "Integer": "long", "Double": "double", "Float": "double", "Decimal": "decimal(38,10)", "Boolean": "boolean", "Date": "date", "DateTime": "timestamp_ntz"}


#: Methods of finders, which no property or association may be called after.
RESERVED = frozenset({"count", "exists", "exists_semi", "not_exists", "attributes", "find_all"})


def method_name(display: str) -> str:
    """``Valid From`` -> ``valid_from``."""
    return re.sub(r"\W+", "_", display.strip()).lower()


@dataclass(frozen=True)
class PropertyDef:
    name: str  # display name
    column: str
    type: str
    doc: str = ""
    key: bool = False

    def __post_init__(self):
        if self.type not in PRIMITIVES:
            raise ValueError(f"unknown type {self.type} of {self.name}")


@dataclass(frozen=True)
class Join:
    """A single-column equi-join from an entity to another."""

    name: str
    target: str
    left: str
    right: str


@dataclass(frozen=True)
class Association:
    """A two-way link: the forward join of ``source`` and the name of the way back."""

    source: str
    forward: str
    reverse: str


@dataclass(frozen=True)
class Source:
    """A table's place: bare, schema.table or catalog.schema.table."""

    table: str
    schema: str | None = None
    catalog: str | None = None

    @property
    def qualified(self) -> str:
        return ".".join(p for p in (self.catalog, self.schema, self.table) if p)


@dataclass(frozen=True)
class EntityDef:
    name: str
    source: Source
    properties: tuple[PropertyDef, ...]
    joins: tuple[Join, ...] = ()
    milestoning: Milestoning = NONE
    doc: str = ""
    extra_columns: tuple[str, ...] = field(default=())  # columns that only joins and dates use

    def __post_init__(self):
        names = [p.name for p in self.properties] + [j.name for j in self.joins]
        doubled = {n for n in names if names.count(n) > 1}
        if doubled:
            raise ValueError(f"{self.name} has {sorted(doubled)} twice")


class Model:
    """All entities of a mapping; associations give every end a way to the other."""

    def __init__(self, name: str, entities: list[EntityDef], associations: list[Association] = ()):
        self.name = name
        self.entities: dict[str, EntityDef] = {}
        for e in entities:
            if e.name in self.entities:
                raise ValueError(f"entity {e.name} is defined twice")
            self.entities[e.name] = e
        self.links: dict[str, dict[str, Join]] = {e: {j.name: j for j in d.joins} for e, d in self.entities.items()}
        for e, joins in self.links.items():
            for j in joins.values():
                if j.target not in self.entities:
                    raise ValueError(f"{e}.{j.name} leads to unknown entity {j.target}")
        for a in associations:
            j = self.links[a.source][a.forward]
            if a.reverse in self.links[j.target]:
                raise ValueError(f"{j.target}.{a.reverse} is defined twice")
            self.links[j.target][a.reverse] = Join(a.reverse, a.source, j.right, j.left)

        for e, d in self.entities.items():
            for n in (*(p.name for p in d.properties), *self.links[e]):
                if method_name(n) in RESERVED:
                    raise ValueError(f"{e}.{n} is called like a method of finders")

    def entity(self, name: str) -> EntityDef:
        if name not in self.entities:
            raise KeyError(f"no entity {name} in model {self.name}")
        return self.entities[name]

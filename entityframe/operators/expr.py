"""Immutable expressions over columns of joined entities.

An expression knows the join paths that it needs, so that the planner can join before any
column is resolved, and lowers itself to a Spark column once paths have aliases.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextvars import ContextVar
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

Path = tuple[str, ...]
#: Columns that stand for aggregates which the planner has computed already, by the aggregate's identity.
computed: ContextVar[dict[int, Column]] = ContextVar("computed", default={})


def alias_of(root: str, path: Path) -> str:
    return "__".join((root, *path))


class Expr:
    label: str = ""

    def children(self) -> tuple[Expr, ...]:
        return ()

    def paths(self) -> list[tuple[str, Path]]:
        """(root entity, path) of all columns, in order of use."""
        return [p for c in self.children() for p in c.paths()]

    def refs(self) -> list[tuple[str, Path, str]]:
        """(root entity, path, column) of all columns."""
        return [r for c in self.children() for r in c.refs()]

    def walk(self) -> Iterator[Expr]:
        yield self
        for c in self.children():
            yield from c.walk()

    def to_column(self) -> Column:
        raise NotImplementedError

    @property
    def aggregates(self) -> bool:
        """Whether it holds an aggregate outside a window."""
        return any(c.aggregates for c in self.children())

    def alias(self, label: str) -> Named:
        return Named(self, label)


@dataclass(frozen=True)
class Named(Expr):
    of: Expr
    label: str

    def children(self):
        return (self.of,)

    def to_column(self):
        return self.of.to_column()


@dataclass(frozen=True)
class ColumnRef(Expr):
    root: str
    path: Path
    column: str
    label: str

    def paths(self):
        return [(self.root, self.path)]

    def refs(self):
        return [(self.root, self.path, self.column)]

    def to_column(self):
        return F.col(f"`{alias_of(self.root, self.path)}`.`{self.column}`")


@dataclass(frozen=True)
class Literal(Expr):
    value: Callable[[], Column]
    label: str = "literal"

    def to_column(self):
        return self.value()


@dataclass(frozen=True)
class Function(Expr):
    """A scalar function; ``make`` turns the argument's column into the result's."""

    of: Expr
    make: Callable[[Column], Column]
    label: str

    def children(self):
        return (self.of,)

    def to_column(self):
        return self.make(self.of.to_column())


@dataclass(frozen=True)
class Spec:
    """A window: partition keys and sort keys; the default SQL frame."""

    partition: tuple[Expr, ...] = ()
    order: tuple[Sort, ...] = ()

    def children(self) -> tuple[Expr, ...]:
        return (*self.partition, *(s.of for s in self.order))

    def to_column(self, needs_order: bool):
        w = Window.partitionBy(*(p.to_column() for p in self.partition))
        if self.order:
            return w.orderBy(*(s.to_column() for s in self.order))
        return w.orderBy(F.lit(1)) if needs_order else w


def spec(partition_by=None, order_by=None) -> Spec:
    as_tuple = lambda x: () if x is None else tuple(x) if isinstance(x, (list, tuple)) else (x,)
    return Spec(as_tuple(partition_by), as_tuple(order_by))


@dataclass(frozen=True)
class Aggregate(Expr):
    of: Expr | None  # None: all rows
    op: str
    label: str
    window: Spec | None = None

    def children(self):
        return (*((self.of,) if self.of else ()), *(self.window.children() if self.window else ()))

    @property
    def aggregates(self):
        return self.window is None or any(c.aggregates for c in self.children())

    def over(self, partition_by=None, order_by=None) -> Aggregate:
        return replace(self, window=spec(partition_by, order_by))

    def summary(self) -> Column:
        """The aggregate without its window."""
        make = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max, "average": F.avg}[self.op]
        return make(self.of.to_column() if self.of else F.lit(1))

    def to_column(self):
        known = computed.get().get(id(self))
        if known is not None:
            return known
        return self.summary() if self.window is None else self.summary().over(self.window.to_column(False))


@dataclass(frozen=True)
class WindowFunction(Expr):
    of: Expr | None
    op: str
    label: str
    n: int = 1
    fill: object = None
    window: Spec = field(default_factory=Spec)

    def children(self):
        return (*((self.of,) if self.of else ()), *self.window.children())

    def over(self, partition_by=None, order_by=None) -> WindowFunction:
        return replace(self, window=spec(partition_by, order_by))

    def to_column(self):
        c = self.of.to_column() if self.of else None
        made = {
            "row_number": lambda: F.row_number(),
            "rank": lambda: F.rank(),
            "dense_rank": lambda: F.dense_rank(),
            "percent_rank": lambda: F.percent_rank(),
            "cume_dist": lambda: F.cume_dist(),
            "ntile": lambda: F.ntile(self.n),
            "lag": lambda: F.lag(c, self.n, self.fill),
            "lead": lambda: F.lead(c, self.n, self.fill),
            "first": lambda: F.first(c),
            "last": lambda: F.last(c),
        }[self.op]()
        return made.over(self.window.to_column(self.op not in ("first", "last")))


class Predicate(Expr):
    def and_op(self, other: Predicate) -> Predicate:
        return self if isinstance(other, NoOperation) else Logical(self, "and", other)

    def or_op(self, other: Predicate) -> Predicate:
        return other if isinstance(other, NoOperation) else Logical(self, "or", other)

    __and__, __or__ = and_op, or_op


class NoOperation(Predicate):
    """No filter: all rows. With and, the other term is left; with or, none."""

    def and_op(self, other):
        return other

    def or_op(self, other):
        return self

    __and__, __or__ = and_op, or_op


@dataclass(frozen=True)
class Logical(Predicate):
    left: Predicate
    op: str
    right: Predicate

    def __post_init__(self):
        for side in (self.left, self.right):
            if not isinstance(side, Predicate):
                raise TypeError(f"not a filter: {side!r}")

    def children(self):
        return (self.left, self.right)

    def to_column(self):
        a, b = self.left.to_column(), self.right.to_column()
        return a & b if self.op == "and" else a | b


@dataclass(frozen=True)
class Test(Predicate):
    """A comparison or other condition on expressions."""

    parts: tuple[Expr, ...]
    make: Callable[..., Column]
    label: str = "test"

    def children(self):
        return self.parts

    def to_column(self):
        return self.make(*(p.to_column() for p in self.parts))


@dataclass(frozen=True)
class Exists(Predicate):
    """A related row is there (or not): the join's right key is (not) null. A row for each match stays."""

    root: str
    path: Path
    key: str
    negated: bool = False
    semi: bool = False

    def paths(self):
        return [] if self.semi else [(self.root, self.path)]

    def refs(self):
        return [] if self.semi else [(self.root, self.path, self.key)]

    def to_column(self):
        c = F.col(f"`{alias_of(self.root, self.path)}`.`{self.key}`")
        return c.isNull() if self.negated else c.isNotNull()


@dataclass(frozen=True)
class Sort:
    of: Expr
    descending: bool = False

    def to_column(self) -> Column:
        c = self.of.to_column()
        return c.desc_nulls_last() if self.descending else c.asc_nulls_last()


def conjuncts(p: Predicate) -> list[Predicate]:
    return conjuncts(p.left) + conjuncts(p.right) if isinstance(p, Logical) and p.op == "and" else [p]

"""Query -> joins, filters and columns -> DataFrame or SQL text. Never runs an action; Catalyst does the physical planning.

DEVIATIONS from the reference, on purpose: ranking functions can be displayed; every join
node gets its temporal predicate, those reached only by filters, groups, sorts and windows
too; windows' joins are all collected; functions nest; constants are typed literals;
an entity that is only filtered on but not related is an error; one join for each path;
queries are immutable; negative interval counts work; or_op and exists_semi are offered.

Windowed aggregates without an order are computed by grouping and joined back, so that one
large partition (all rows, if there are no keys) isn't gathered in one task.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.expr import Aggregate, Exists, Expr, NoOperation, Path, Predicate, Sort, alias_of, computed, conjuncts


_UNIT = re.compile(r"\b(timestampadd|timestampdiff)\('([A-Z]+)',")


@dataclass(frozen=True)
class Step:
    """A table that joins those before it."""

    entity: str
    alias: str
    how: str  # cross, left, left_semi, left_anti; none: the first table
    on: Column | None = None


@dataclass(frozen=True)
class Prepared:
    query: object
    steps: tuple[Step, ...]
    where: tuple[Column, ...]
    names: tuple[str, ...]
    used: dict[str, tuple[str, ...]]  # columns by alias


def prepare(engine, query, unique_names: bool = False) -> Prepared:
    model = engine.model
    terms = [] if isinstance(query.filter, NoOperation) else conjuncts(query.filter)
    for t in terms:
        if not isinstance(t, Predicate):
            raise TypeError(f"not a filter: {t!r}")
    shown = [p for c in query.columns for p in c.paths()]
    others = [p for e in (*query.groups, *(s.of for s in query.order)) for p in e.paths()]
    used: dict[str, dict[str, None]] = {}

    def use(alias: str, *columns: str) -> None:
        used.setdefault(alias, {}).update(dict.fromkeys(columns))

    for e in (*query.columns, *terms, *query.groups, *(s.of for s in query.order)):
        for root, path, column in e.refs():
            use(alias_of(root, path), column)

    # not_exists terms on paths that nothing else uses are anti joins; exists_semi terms semi joins
    def single(t: Predicate) -> bool:
        if not isinstance(t, Exists) or not (t.negated or t.semi) or t.root != query.root:
            return False
        others_use = [*shown, *others, *(p for u in terms if u is not t for p in u.paths())]
        return t.semi or not any(r == t.root and p[: len(t.path)] == t.path for r, p in others_use)

    reduced = [t for t in terms if single(t)]
    terms = [t for t in terms if not single(t)]
    for t in terms:
        _no_semi(t)
    filtered = [p for t in terms for p in t.paths()] + [(t.root, t.path[:-1]) for t in reduced]

    def joined(root: str, path: Path, how: str) -> Step:
        entity, join = root, None
        for name in path:
            if join is not None:
                entity = join.target
            join = model.links[entity][name]
        left, right = alias_of(root, path[:-1]), alias_of(root, path)
        on = F.col(f"`{left}`.`{join.left}`") == F.col(f"`{right}`.`{join.right}`")
        kind = model.entity(join.target).milestoning
        when = kind.predicate(right, query.business, query.processing)
        use(left, join.left)
        use(right, join.right, *(kind.columns() if when is not None else ()))
        return Step(join.target, right, how, on if when is None else on & when)

    steps = [Step(query.root, query.root, "")]
    roots, done = {query.root}, set()
    for root, path in [*shown, *filtered, *others]:
        if root not in roots:
            if not any(r == root for r, _ in shown):
                raise ValueError(f"{root} is neither displayed nor related to {query.root}")
            steps.append(Step(root, root, "cross"))
            roots.add(root)
        for k in range(1, len(path) + 1):
            if (root, path[:k]) not in done:
                steps.append(joined(root, path[:k], "left"))
                done.add((root, path[:k]))
    steps += [joined(t.root, t.path, "left_anti" if t.negated else "left_semi") for t in reduced]
    where = [t.to_column() for t in terms]
    kind = model.entity(query.root).milestoning
    when = kind.predicate(query.root, query.business, query.processing)
    if when is not None:
        where.append(when)
        use(query.root, *kind.columns())
    names = [_unique_name(c) if unique_names else c.label for c in query.columns]
    return Prepared(query, tuple(steps), tuple(where), tuple(names), {a: tuple(c) for a, c in used.items()})


def frame(engine, p: Prepared) -> DataFrame:
    query, df = p.query, None
    for s in p.steps:
        entity = engine.model.entity(s.entity)
        table = engine.provider.table(entity, *query.asked, p.used.get(s.alias, ()))
        lacking = set(p.used.get(s.alias, ())) - set(table.columns)
        if lacking:
            raise ValueError(f"table {entity.source.qualified} lacks columns {sorted(lacking)}")
        table = table.alias(s.alias)
        df = table if df is None else df.crossJoin(table) if s.how == "cross" else df.join(table, s.on, s.how)
    for w in p.where:
        df = df.where(w)
    if _grouped(query):
        hidden = [c.to_column().alias(f"_c{i}") for i, c in enumerate(query.columns)]
        keys = [s.of.to_column().alias(f"_s{i}") for i, s in enumerate(query.order)]
        df = df.groupBy(*(g.to_column() for g in query.groups)).agg(*hidden, *keys)
        return _ordered(df, query, p.names, True)
    df, known = _summed(df, [*query.columns, *(s.of for s in query.order)])
    token = computed.set(known)
    try:
        if any(_windowed(c) for c in query.columns) and (query.order or query.size is not None):
            # the limit comes after the windows; sort keys go along under hidden names
            keys = [s.of.to_column().alias(f"_s{i}") for i, s in enumerate(query.order)]
            df = df.select(*(c.to_column().alias(f"_c{i}") for i, c in enumerate(query.columns)), *keys)
            return _ordered(df, query, p.names, True)
        return _ordered(df, query, p.names, False)
    finally:
        computed.reset(token)


def _ordered(df: DataFrame, query, names: tuple[str, ...], hidden: bool) -> DataFrame:
    """Sorted, limited and named; ``hidden``: columns and sort keys are there as _c and _s."""
    if query.order:
        df = df.sort(*(_sort_key(s, F.col(f"_s{i}")) for i, s in enumerate(query.order)) if hidden else (_sort_key(s, s.of.to_column()) for s in query.order))
    if query.size is not None:
        df = df.limit(query.size)
    return df.select(*((F.col(f"_c{i}") if hidden else c.to_column()).alias(n) for i, (c, n) in enumerate(zip(query.columns, names, strict=True))))


def _sort_key(s: Sort, c: Column) -> Column:
    return c.desc_nulls_last() if s.descending else c.asc_nulls_last()


def _grouped(query) -> bool:
    return bool(query.groups) or any(c.aggregates for c in query.columns)


def _summed(df: DataFrame, exprs: list[Expr]) -> tuple[DataFrame, dict[int, Column]]:
    """``df`` with the windowed aggregates that have no order, grouped by their keys and joined back."""
    found: dict[tuple, list[Aggregate]] = {}
    for e in exprs:
        for a in e.walk():
            if isinstance(a, Aggregate) and a.window is not None and not a.window.order and not any(_windowed(c) for c in a.children()):
                found.setdefault(a.window.partition, []).append(a)
    known, whole = {}, df
    for i, (partition, aggregates) in enumerate(found.items()):
        keys = [k.to_column() for k in partition]
        sums = whole.groupBy(*(k.alias(f"_k{i}_{j}") for j, k in enumerate(keys))).agg(*(a.summary().alias(f"_w{i}_{j}") for j, a in enumerate(aggregates)))
        if keys:
            on = None
            for j, k in enumerate(keys):
                same = k.eqNullSafe(F.col(f"_k{i}_{j}"))
                on = same if on is None else on & same
            df = df.join(sums, on)
        else:
            df = df.crossJoin(sums)  # one row
        known |= {id(a): F.col(f"_w{i}_{j}") for j, a in enumerate(aggregates)}
    return df, known


def sql_text(engine, p: Prepared) -> str:
    """Spark SQL of the plan, its expressions as the analyser resolves them."""
    query, how = p.query, {"": "FROM", "cross": "CROSS JOIN", "left": "LEFT OUTER JOIN", "left_semi": "LEFT SEMI JOIN", "left_anti": "LEFT ANTI JOIN"}
    df, tables = None, []
    for s in p.steps:
        entity = engine.model.entity(s.entity)
        table = engine.provider.table(entity, *query.asked, p.used.get(s.alias, ())).alias(s.alias)
        on = ""
        # conditions are resolved over all tables, so that those of semi and anti joins are too
        whole = table if df is None else df.crossJoin(table)
        if s.on is not None:
            on = f" ON {_text(whole.select(s.on))}"
        df = df if s.how in ("left_semi", "left_anti") else whole
        name = ".".join(f"`{x}`" for x in entity.source.qualified.split("."))
        tables.append(f"{how[s.how]} {name} AS `{s.alias}`{on}")
    of = (lambda c: _text(df.groupBy(*(g.to_column() for g in query.groups)).agg(c))) if _grouped(query) else lambda c: _text(df.select(c))
    lines = ["SELECT " + ", ".join(f"{of(c.to_column())} AS `{n}`" for c, n in zip(query.columns, p.names, strict=True)), *tables]
    if p.where:
        lines.append("WHERE " + " AND ".join(_text(df.select(w)) for w in p.where))
    if query.groups:
        lines.append("GROUP BY " + ", ".join(_text(df.select(g.to_column())) for g in query.groups))
    if query.order:
        lines.append("ORDER BY " + ", ".join(f"{of(s.of.to_column())} {'DESC' if s.descending else 'ASC'} NULLS LAST" for s in query.order))
    if query.size is not None:
        lines.append(f"LIMIT {query.size}")
    return "\n".join(lines)


def _text(df: DataFrame) -> str:
    """SQL of the last column of a projection or an aggregate."""
    node = df._jdf.queryExecution().analyzed()
    exprs = node.aggregateExpressions() if node.nodeName() == "Aggregate" else node.projectList()
    last = exprs.apply(exprs.size() - 1)
    if node.nodeName() == "Project" and node.child().nodeName() == "Project" and node.child().child().nodeName() == "Window":
        node = node.child()
    if node.nodeName() == "Project" and node.child().nodeName() == "Window":
        last = node.child().windowExpressions().apply(0)
    whole = last.sql() if last.getClass().getSimpleName() != "Alias" else last.child().sql()
    return _UNIT.sub(r"\1(\2,", whole)  # units are names in SQL and not text


def _no_semi(t: Predicate) -> None:
    if isinstance(t, Exists) and t.semi:
        raise ValueError("exists_semi stands only in the filter's top-level conjunction")
    for c in t.children():
        if isinstance(c, Predicate):
            _no_semi(c)


def _windowed(e) -> bool:
    return getattr(e, "window", None) is not None or any(_windowed(c) for c in e.children())


def _unique_name(e) -> str:
    path = next((p for _, p in e.paths() if p), ())
    return " ".join([*(p.title() for p in path[:-1]), e.label])

"""Registered queries, one for each operator, and hand-written SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions import numbers
from ..operators.expr import Expr, NoOperation
from .tables import engine

#: Derived tables of the SQL side.
WITH = """WITH customers AS (SELECT *, CASE WHEN c_custkey > 0 THEN c_custkey // 10 END AS manager_id FROM customer),
orders_x AS (SELECT *, CAST(o_orderdate AS DATE) AS o_date, o_orderstatus = 'F' AS is_final, CAST(o_totalprice AS DECIMAL(15,2)) AS price_dec, o_custkey + 1 AS ship_key FROM orders),
orders_hist AS (SELECT *, o_orderdate AS in_z, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS out_z FROM orders),
orders_hist_inf AS (SELECT * REPLACE (coalesce(out_z, TIMESTAMP '9999-12-31') AS out_z) FROM orders_hist),
orders_bi AS (SELECT *, CAST(o_orderdate AS DATE) AS biz_from, CAST(o_orderdate AS DATE) + 90 AS biz_to FROM orders_hist),
events_hist AS (SELECT *, CAST(ts AS DATE) AS day, ts AS in_z, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS out_z FROM events)
"""
AT = "1998-06-01 00:00:00"
_VALID = f"(in_z <= TIMESTAMP '{AT}' AND (out_z > TIMESTAMP '{AT}' OR out_z IS NULL))"
_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}
_builders: dict[str, Callable] = {}


def _add(name: str, build: Callable, sql: str, after: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """``build(engine)`` gives a query; ``after`` only rounds or casts, as the SQL does."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = build(engine(spark, sf_dir)).to_df()
        return after(df) if after else df

    _queries[name], _sql[name], _builders[name] = run, WITH + sql, build


def _all(root, columns: dict[str, Expr], where=None, business=None, processing=None):
    return root.find_all(business, processing, [e.alias(n) for n, e in columns.items()], where)


def _round(*names: str) -> Callable[[DataFrame], DataFrame]:
    from pyspark.sql import functions as F

    return lambda df: df.withColumns({n: F.round(n, 2) for n in names})


def _longs(*names: str) -> Callable[[DataFrame], DataFrame]:
    from pyspark.sql import functions as F

    return lambda df: df.withColumns({n: F.col(n).cast("long") for n in names})


def _scans() -> None:
    _add("q_scan", lambda e: _all(e.Nation, {"key": e.Nation.key(), "name": e.Nation.name()}), "SELECT n_nationkey AS key, n_name AS name FROM nation")
    _add("q_project", lambda e: _all(e.Order, {"key": e.Order.key(), "day": e.Order.day(), "final": e.Order.final(), "price": e.Order.price()}), "SELECT o_orderkey AS key, o_date AS day, is_final AS final, price_dec AS price FROM orders_x")
    _add("q_cross", lambda e: _all(e.Region, {"region": e.Region.name(), "nation": e.Nation.name()}), "SELECT r_name AS region, n_name AS nation FROM region, nation")


def _filters() -> None:
    def on(name, where, sql):
        _add(f"q_filter_{name}", lambda e: _all(e.Order, {"key": e.Order.key(), "total": e.Order.total()}, where(e.Order)), f"SELECT o_orderkey AS key, o_totalprice AS total FROM orders_x WHERE {sql}")

    on("eq", lambda o: o.status().eq("F"), "o_orderstatus = 'F'")
    on("ne", lambda o: o.status().ne("F"), "o_orderstatus <> 'F'")
    on("range", lambda o: o.total().gt(1000).and_op(o.total().lte(200000)).and_op(o.key().gte(10)).and_op(o.key().lt(9000)), "o_totalprice > 1000 AND o_totalprice <= 200000 AND o_orderkey >= 10 AND o_orderkey < 9000")
    on("date", lambda o: o.day().gte("1997-01-01").and_op(o.placed().lt("1998-01-01 00:00:00")), "o_date >= DATE '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01'")
    on("decimal", lambda o: o.price().gt("250000.55"), "price_dec > 250000.55")
    on("bool", lambda o: o.final().is_true(), "is_final = TRUE")
    on("bool_false", lambda o: o.final().is_false(), "is_final = FALSE")
    on("contains", lambda o: o.priority().contains("IG"), "o_orderpriority LIKE '%IG%'")
    on("starts", lambda o: o.priority().starts_with("1-"), "o_orderpriority LIKE '1-%'")
    on("ends", lambda o: o.priority().ends_with("LOW"), "o_orderpriority LIKE '%LOW'")
    on("not_contains", lambda o: o.priority().not_contains("E"), "o_orderpriority NOT LIKE '%E%'")
    on("and", lambda o: o.status().eq("O").and_op(o.total().gt(50000)), "o_orderstatus = 'O' AND o_totalprice > 50000")
    on("or", lambda o: o.status().eq("O").or_op(o.status().eq("P")).and_op(o.total().lt(50000)), "(o_orderstatus = 'O' OR o_orderstatus = 'P') AND o_totalprice < 50000")
    on("no_operation", lambda o: o.status().eq("F").and_op(NoOperation()).and_op(NoOperation().or_op(o.key().gt(3))), "o_orderstatus = 'F'")
    _add("q_filter_null", lambda e: _all(e.Version, {"key": e.Version.key()}, e.Version.valid_to().is_null()), "SELECT o_orderkey AS key FROM orders_hist WHERE out_z IS NULL")
    _add("q_filter_not_null", lambda e: _all(e.Version, {"key": e.Version.key()}, e.Version.valid_to().is_not_null()), "SELECT o_orderkey AS key FROM orders_hist WHERE out_z IS NOT NULL")
    _add("q_filter_related", lambda e: _all(e.Order, {"key": e.Order.key()}, e.Order.customer().segment().eq("BUILDING")), "SELECT o_orderkey AS key FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
    _add("q_filter_columns", lambda e: _all(e.Version, {"key": e.Version.key()}, e.Version.placed().eq(e.Version.valid_to())), "SELECT o_orderkey AS key FROM orders_hist WHERE o_orderdate = out_z")


def _joins() -> None:
    _add("q_exists", lambda e: _all(e.Customer, {"key": e.Customer.key()}, e.Customer.orders().exists()), "SELECT c_custkey AS key FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE o_custkey IS NOT NULL")
    _add("q_exists_semi", lambda e: _all(e.Customer, {"key": e.Customer.key()}, e.Customer.orders().exists_semi()), "SELECT c_custkey AS key FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
    _add("q_not_exists", lambda e: _all(e.Customer, {"key": e.Customer.key()}, e.Customer.orders().not_exists()), "SELECT c_custkey AS key FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
    _add("q_join_forward", lambda e: _all(e.Order, {"key": e.Order.key(), "customer": e.Order.customer().name(), "segment": e.Order.customer().segment()}), "SELECT o_orderkey AS key, c_name AS customer, c_mktsegment AS segment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
    _add("q_join_two_hop", lambda e: _all(e.Customer, {"key": e.Customer.key(), "region": e.Customer.nation().region().name()}), "SELECT c_custkey AS key, r_name AS region FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
    _add("q_join_three_hop", lambda e: _all(e.Line, {"order_key": e.Line.order_key(), "number": e.Line.number(), "nation": e.Line.order().customer().nation().name(), "supplier": e.Line.supplier().name()}, e.Line.quantity().gt(45)), "SELECT l_orderkey AS order_key, l_linenumber AS number, n_name AS nation, s_name AS supplier FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN supplier ON l_suppkey = s_suppkey WHERE l_quantity > 45")
    _add("q_join_self", lambda e: _all(e.Customer, {"key": e.Customer.key(), "manager": e.Customer.manager().name()}), "SELECT a.c_custkey AS key, b.c_name AS manager FROM customers a LEFT JOIN customers b ON a.manager_id = b.c_custkey")
    _add("q_join_self_two_hop", lambda e: _all(e.Customer, {"key": e.Customer.key(), "manager": e.Customer.manager().name(), "top": e.Customer.manager().manager().name()}), "SELECT a.c_custkey AS key, b.c_name AS manager, c.c_name AS top FROM customers a LEFT JOIN customers b ON a.manager_id = b.c_custkey LEFT JOIN customers c ON b.manager_id = c.c_custkey")
    _add("q_join_reverse", lambda e: _all(e.Customer, {"key": e.Customer.key(), "order_key": e.Customer.orders().key()}), "SELECT c_custkey AS key, o_orderkey AS order_key FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
    _add("q_join_reverse_self", lambda e: _all(e.Customer, {"key": e.Customer.key(), "report": e.Customer.reports().name()}), "SELECT a.c_custkey AS key, b.c_name AS report FROM customers a LEFT JOIN customers b ON b.manager_id = a.c_custkey")
    _add("q_join_dual", lambda e: _all(e.Order, {"key": e.Order.key(), "billing": e.Order.billing().name(), "shipping": e.Order.shipping().name()}), "SELECT o_orderkey AS key, b.c_name AS billing, s.c_name AS shipping FROM orders_x LEFT JOIN customer b ON o_custkey = b.c_custkey LEFT JOIN customer s ON ship_key = s.c_custkey")


def _milestones() -> None:
    cols = lambda v: {"key": v.key(), "total": v.total()}
    out = "SELECT o_orderkey AS key, o_totalprice AS total FROM"
    _add("q_mile_processing", lambda e: _all(e.Version, cols(e.Version), processing=AT), f"{out} orders_hist WHERE {_VALID}")
    _add("q_mile_processing_inf", lambda e: _all(e.ClosedVersion, cols(e.ClosedVersion), processing=AT), f"{out} orders_hist_inf WHERE in_z <= TIMESTAMP '{AT}' AND out_z > TIMESTAMP '{AT}'")
    _add("q_mile_business", lambda e: _all(e.Daily, cols(e.Daily), business="1998-06-01"), f"{out} orders_x WHERE o_date = DATE '1998-06-01'")
    _add("q_mile_business_processing", lambda e: _all(e.EventVersion, {"key": e.EventVersion.key(), "value": e.EventVersion.value()}, business="2024-01-03", processing="2024-01-03 12:00:00"), "SELECT event_id AS key, value FROM events_hist WHERE day = DATE '2024-01-03' AND in_z <= TIMESTAMP '2024-01-03 12:00:00' AND (out_z > TIMESTAMP '2024-01-03 12:00:00' OR out_z IS NULL)")
    _add("q_mile_bitemporal", lambda e: _all(e.BiVersion, cols(e.BiVersion), business="1998-05-15", processing=AT), f"{out} orders_bi WHERE biz_from <= DATE '1998-05-15' AND (biz_to > DATE '1998-05-15' OR biz_to IS NULL) AND {_VALID}")
    _add("q_mile_null_date", lambda e: _all(e.Version, cols(e.Version)), f"{out} orders_hist")
    # a root of no temporal kind passes no dates on: all versions are joined
    _add("q_mile_gated", lambda e: _all(e.Customer, {"key": e.Customer.key(), "version": e.Customer.versions().key()}, processing=AT), "SELECT c_custkey AS key, o_orderkey AS version FROM customer LEFT JOIN orders_hist ON c_custkey = o_custkey")
    _add("q_mile_join_on", lambda e: _all(e.Version, {"key": e.Version.key(), "sibling": e.Version.customer().versions().key()}, processing=AT), f"SELECT a.o_orderkey AS key, b.o_orderkey AS sibling FROM (SELECT * FROM orders_hist WHERE {_VALID}) a LEFT JOIN customer ON a.o_custkey = c_custkey LEFT JOIN (SELECT * FROM orders_hist WHERE {_VALID}) b ON c_custkey = b.o_custkey")


def numbers_of(a, make):
    from ..operators.expr import Function

    return Function(a, make, "V")


def _functions() -> None:
    def text(name, make, sql):
        _add(f"q_str_{name}", lambda e: _all(e.Part, {"key": e.Part.key(), "v": make(e.Part.name())}), f"SELECT p_partkey AS key, {sql} AS v FROM part")

    for name, make, sql in (
        ("upper", lambda a: a.upper(), "upper(p_name)"), ("lower", lambda a: a.lower(), "lower(p_name)"), ("strip", lambda a: a.strip(), "trim(p_name)"), ("lstrip", lambda a: a.lstrip(), "ltrim(p_name)"), ("rstrip", lambda a: a.rstrip(), "rtrim(p_name)"),
        ("length", lambda a: a.length(), "length(p_name)"), ("reverse", lambda a: a.reverse(), "reverse(p_name)"), ("left", lambda a: a.left(4), "left(p_name, 4)"), ("left_negative", lambda a: a.left(-3), "left(p_name, -3)"), ("right", lambda a: a.right(4), "right(p_name, 4)"), ("right_negative", lambda a: a.right(-3), "right(p_name, -3)"),
        ("repeat", lambda a: a.repeat(3), "repeat(p_name, 3)"), ("replace", lambda a: a.replace("e", "EE"), "replace(p_name, 'e', 'EE')"), ("substring", lambda a: a.substring(2, 3), "substring(p_name, 3, 3)"), ("substring_open", lambda a: a.substring(2), "substring(p_name, 3)"), ("substring_before", lambda a: a.substring(-1, 3), "substring(p_name, 0, 3)"),
    ):
        text(name, make, sql)

    def number(name, make, sql):
        _add(f"q_num_{name}", lambda e: _all(e.Customer, {"key": e.Customer.key(), "v": make(e.Customer.balance())}), f"SELECT c_custkey AS key, {sql} AS v FROM customer")

    for name, make, sql in (
        ("abs", lambda a: a.abs(), "abs(c_acctbal)"), ("ceil", lambda a: a.ceil(), "ceiling(c_acctbal)"), ("floor", lambda a: a.floor(), "floor(c_acctbal)"), ("power", lambda a: a.power(2), "power(c_acctbal, 2)"), ("mod", lambda a: a.mod(7.0), "c_acctbal % 7.0"),
        ("round", lambda a: a.round(), "round(c_acctbal)"), ("round_d", lambda a: a.round(1), "round(c_acctbal, 1)"),
    ):
        number(name, make, sql)
    # doubles that no whole-number type holds, remainders by zero, decimals
    number("ceil_large", lambda a: numbers_of(a, lambda c: numbers.ceil(c * 1e300)), "ceiling(c_acctbal * 1e300)")
    number("floor_large", lambda a: numbers_of(a, lambda c: numbers.floor(c * 1e300)), "floor(c_acctbal * 1e300)")
    number("mod_zero", lambda a: a.mod(0.0), "c_acctbal % 0.0")
    for name in ("ceil", "floor"):
        _add(f"q_num_{name}_decimal", lambda e, name=name: _all(e.Order, {"key": e.Order.key(), "v": getattr(e.Order.price(), name)()}), f"SELECT o_orderkey AS key, {name}(price_dec) AS v FROM orders_x")
    _add("q_num_sqrt", lambda e: _all(e.Part, {"key": e.Part.key(), "v": e.Part.price().sqrt()}), "SELECT p_partkey AS key, sqrt(p_retailprice) AS v FROM part")

    def date(name, make, sql):
        _add(f"q_date_{name}", lambda e: _all(e.Event, {"key": e.Event.key(), "v": make(e.Event.at())}), f"SELECT event_id AS key, {sql} AS v FROM events")

    for part in ("year", "month", "day", "quarter", "week", "hour", "minute"):
        date(part, lambda a, part=part: getattr(a, part)(), f"extract({part} FROM ts)")
    date("second", lambda a: a.second(), "CAST(extract(second FROM ts) AS BIGINT)")
    date("dow", lambda a: a.day_of_week(), "extract(dow FROM ts)")
    for unit in ("day", "month", "year", "hour", "minute", "second"):
        date(f"add_{unit}s", lambda a, unit=unit: getattr(a, f"add_{unit}s")(5), f"ts + INTERVAL 5 {unit}")
        date(f"sub_{unit}s", lambda a, unit=unit: getattr(a, f"subtract_{unit}s")(5), f"ts - INTERVAL 5 {unit}")
        date(f"diff_{unit}s", lambda a, unit=unit: getattr(a, f"diff_{unit}s")("2024-02-29 00:00:30"), f"date_diff('{unit}', ts, TIMESTAMP '2024-02-29 00:00:30')")
    _add("q_date_add_date", lambda e: _all(e.Order, {"key": e.Order.key(), "v": e.Order.day().add_months(1)}), "SELECT o_orderkey AS key, o_date + INTERVAL 1 MONTH AS v FROM orders_x")


def _groups() -> None:
    total = {"count": ("count(o_totalprice)", None), "sum": ("round(sum(o_totalprice), 2)", _round("v")), "min": ("min(o_totalprice)", None), "max": ("max(o_totalprice)", None), "average": ("round(avg(o_totalprice), 2)", _round("v"))}
    for op, (sql, after) in total.items():
        _add(f"q_agg_{'avg' if op == 'average' else op}", lambda e, op=op: _all(e.Order, {"v": getattr(e.Order.total(), op)()}), f"SELECT {sql} AS v FROM orders", after)
    _add("q_agg_count_all", lambda e: _all(e.Order, {"v": e.Order.count()}), "SELECT count(*) AS v FROM orders")
    _add("q_agg_group_by", lambda e: _all(e.Order, {"status": e.Order.status(), "n": e.Order.count(), "total": e.Order.total().sum()}).group_by(e.Order.status()), "SELECT o_orderstatus AS status, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1", _round("total"))
    _add("q_agg_nested", lambda e: _all(e.Customer, {"v": _sum_of_abs(e.Customer.balance())}), "SELECT round(sum(abs(c_acctbal)), 2) AS v FROM customer", _round("v"))
    _add("q_group_related", lambda e: _all(e.Order, {"segment": e.Order.customer().segment(), "n": e.Order.count()}).group_by(e.Order.customer().segment()), "SELECT c_mktsegment AS segment, count(*) AS n FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1")
    _add("q_group_scalar", lambda e: _all(e.Order, {"status": e.Order.status().lower(), "n": e.Order.count()}).group_by(e.Order.status()), "SELECT lower(o_orderstatus) AS status, count(*) AS n FROM orders GROUP BY o_orderstatus")


def _sum_of_abs(a):
    from ..operators.expr import Aggregate

    return Aggregate(a.abs(), "sum", "Sum")


def _windows() -> None:
    by = "PARTITION BY o_custkey ORDER BY o_totalprice NULLS LAST, o_orderkey"

    def win(name, make, sql, after=None):
        def build(e):
            o = e.Order
            return _all(o, {"key": o.key(), "v": make(o, {"partition_by": o.customer_key(), "order_by": [o.total().ascending(), o.key().ascending()]})})

        _add(f"q_win_{name}", build, f"SELECT o_orderkey AS key, {sql} AS v FROM orders", after)

    rank = _longs("v")
    win("row_number", lambda o, w: o.total().rank("first", **w), f"row_number() OVER ({by})", rank)
    win("rank", lambda o, w: o.total().rank(partition_by=o.status(), order_by=o.priority().descending()), "rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority DESC NULLS LAST)", rank)
    win("dense_rank", lambda o, w: o.total().rank("dense", partition_by=o.status(), order_by=o.priority().ascending()), "dense_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority NULLS LAST)", rank)
    win("percent_rank", lambda o, w: o.total().rank(pct=True, **w), f"percent_rank() OVER ({by})")
    win("cume_dist", lambda o, w: o.total().rank("max", pct=True, **w), f"cume_dist() OVER ({by})")
    win("ntile", lambda o, w: o.total().qcut(4, **w), f"ntile(4) OVER ({by})", rank)
    win("lag", lambda o, w: o.total().shift(1, **w), f"lag(o_totalprice, 1) OVER ({by})")
    win("lag_fill", lambda o, w: o.total().shift(2, fill_value=0.0, **w), f"lag(o_totalprice, 2, 0.0) OVER ({by})")
    win("lead", lambda o, w: o.total().shift(-1, **w), f"lead(o_totalprice, 1) OVER ({by})")
    win("first", lambda o, w: o.total().first(**w), f"first_value(o_totalprice) OVER ({by})")
    win("last", lambda o, w: o.key().last(partition_by=o.customer_key(), order_by=o.status().ascending()).over([o.customer_key()], [o.key().ascending()]), "last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey)")
    win("sum", lambda o, w: o.total().sum().over([o.customer_key()], [o.key().ascending()]), "round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 2)", _round("v"))
    win("sum_all", lambda o, w: o.total().sum().over(), "round(sum(o_totalprice) OVER (), 2)", _round("v"))
    win("related", lambda o, w: o.total().sum().over([o.customer().segment()]), "round(sum(o_totalprice) OVER (PARTITION BY (SELECT c_mktsegment FROM customer WHERE c_custkey = o_custkey)), 2)", _round("v"))
    _sql["q_win_related"] = WITH + "SELECT o_orderkey AS key, round(sum(o_totalprice) OVER (PARTITION BY c_mktsegment), 2) AS v FROM orders LEFT JOIN customer ON o_custkey = c_custkey"


def _sorts() -> None:
    def top(name, sorts, sql):
        _add(name, lambda e: _all(e.Order, {"key": e.Order.key(), "total": e.Order.total()}).order_by(*sorts(e.Order)).limit(25), f"SELECT o_orderkey AS key, o_totalprice AS total FROM orders LEFT JOIN customer ON o_custkey = c_custkey ORDER BY {sql} LIMIT 25")

    top("q_sort_asc", lambda o: (o.total().ascending(), o.key().ascending()), "o_totalprice NULLS LAST, o_orderkey")
    top("q_sort_desc", lambda o: (o.total().descending(), o.key().ascending()), "o_totalprice DESC NULLS LAST, o_orderkey")
    top("q_topk", lambda o: (o.status().ascending(), o.total().descending(), o.key().ascending()), "o_orderstatus NULLS LAST, o_totalprice DESC NULLS LAST, o_orderkey")
    top("q_order_related", lambda o: (o.customer().name().descending(), o.key().ascending()), "c_name DESC NULLS LAST, o_orderkey")
    _add("q_sort_all", lambda e: _all(e.Customer, {"key": e.Customer.key(), "balance": e.Customer.balance()}).order_by(e.Customer.balance().descending(), e.Customer.key().ascending()), "SELECT c_custkey AS key, c_acctbal AS balance FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey")
    _add("q_limit_sorted", lambda e: _all(e.Part, {"key": e.Part.key()}).order_by(e.Part.price().ascending(), e.Part.key().ascending()).limit(100), "SELECT p_partkey AS key FROM part ORDER BY p_retailprice NULLS LAST, p_partkey LIMIT 100")
    _add("q_limit", lambda e: _all(e.Order, {"n": e.Order.count()}).limit(1), "SELECT count(*) AS n FROM orders LIMIT 1")
    _add("q_limit_zero", lambda e: _all(e.Order, {"key": e.Order.key()}).limit(0), "SELECT o_orderkey AS key FROM orders LIMIT 0")
    _add("q_sort_nulls", lambda e: _all(e.Version, {"key": e.Version.key()}).order_by(e.Version.valid_to().descending(), e.Version.key().ascending()).limit(25), "SELECT o_orderkey AS key FROM orders_hist ORDER BY out_z DESC NULLS LAST, o_orderkey LIMIT 25")

    # segment totals of the orders valid at one instant; the dates reach the join because the customers' side is asked as of that instant
    def flagship(e):
        v = e.Version
        return _all(v, {"segment": v.customer().segment(), "valid_orders": v.key().count(), "total": v.total().sum()}, processing=AT).group_by(v.customer().segment()).order_by(v.customer().segment().ascending()).limit(5)

    _add("q_flagship", flagship, f"SELECT c_mktsegment AS segment, count(o_orderkey) AS valid_orders, round(sum(o_totalprice), 2) AS total FROM orders_hist LEFT JOIN customer ON o_custkey = c_custkey WHERE {_VALID} GROUP BY 1 ORDER BY segment NULLS LAST LIMIT 5", _round("total"))


for _family in (_scans, _filters, _joins, _milestones, _functions, _groups, _windows, _sorts):
    _family()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def builders() -> dict[str, Callable]:
    """What makes each query from an engine."""
    return dict(_builders)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)

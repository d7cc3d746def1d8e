"""The model of the driver's tables, with derived temporal tables, and its provider."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import Association, BiTemporal, BusinessDate, BusinessDateAndProcessing, EntityDef, Join, Model, Processing, PropertyDef, Source
from ..operators.finder import Engine
from ..sources.tables import Frames, parquet


def _entity(name: str, table: str, properties: str, joins: str = "", milestoning=None) -> EntityDef:
    """Properties as ``name:column:Type``, joins as ``name:Target:left:right``."""
    props = tuple(PropertyDef(*p.split(":")) for p in properties.split())
    return EntityDef(name, Source(table), props, tuple(Join(*j.split(":")) for j in joins.split()), **({"milestoning": milestoning} if milestoning else {}))


_ORDER = "key:o_orderkey:Integer customer_key:o_custkey:Integer status:o_orderstatus:String total:o_totalprice:Double placed:o_orderdate:DateTime priority:o_orderpriority:String"
_VERSION = _ORDER + " valid_from:in_z:DateTime valid_to:out_z:DateTime"
_TO_CUSTOMER = "customer:Customer:o_custkey:c_custkey"

MODEL = Model(
    "warehouse",
    [
        _entity("Region", "region", "key:r_regionkey:Integer name:r_name:String"),
        _entity("Nation", "nation", "key:n_nationkey:Integer name:n_name:String", "region:Region:n_regionkey:r_regionkey"),
        _entity("Customer", "customers", "key:c_custkey:Integer name:c_name:String balance:c_acctbal:Double segment:c_mktsegment:String manager_key:manager_id:Integer", "nation:Nation:c_nationkey:n_nationkey manager:Customer:manager_id:c_custkey"),
        _entity("Supplier", "supplier", "key:s_suppkey:Integer name:s_name:String balance:s_acctbal:Double", "nation:Nation:s_nationkey:n_nationkey"),
        _entity("Part", "part", "key:p_partkey:Integer name:p_name:String brand:p_brand:String kind:p_type:String size:p_size:Integer price:p_retailprice:Double"),
        _entity("Order", "orders_x", _ORDER + " day:o_date:Date final:is_final:Boolean price:price_dec:Decimal", "customer:Customer:o_custkey:c_custkey billing:Customer:o_custkey:c_custkey shipping:Customer:ship_key:c_custkey"),
        _entity("Line", "lineitem", "order_key:l_orderkey:Integer number:l_linenumber:Integer quantity:l_quantity:Double price:l_extendedprice:Double discount:l_discount:Double flag:l_returnflag:String", "order:Order:l_orderkey:o_orderkey supplier:Supplier:l_suppkey:s_suppkey part:Part:l_partkey:p_partkey"),
        _entity("Event", "events", "key:event_id:Integer at:ts:DateTime user:user_id:Integer kind:event_type:String value:value:Double"),
        _entity("Version", "orders_hist", _VERSION, _TO_CUSTOMER, Processing("in_z", "out_z")),
        _entity("ClosedVersion", "orders_hist_inf", _VERSION, _TO_CUSTOMER, Processing("in_z", "out_z", infinite_end=True)),
        _entity("Daily", "orders_x", _ORDER + " day:o_date:Date", _TO_CUSTOMER, BusinessDate("o_date")),
        _entity("EventVersion", "events_hist", "key:event_id:Integer user:user_id:Integer kind:event_type:String value:value:Double", "", BusinessDateAndProcessing("day", "in_z", "out_z")),
        _entity("BiVersion", "orders_bi", _VERSION, _TO_CUSTOMER, BiTemporal("biz_from", "biz_to", "in_z", "out_z")),
    ],
    [Association("Version", "customer", "versions"), Association("Customer", "manager", "reports"), Association("Order", "customer", "orders")],
)


_histories: dict[tuple[str, str, str], str] = {}


def history(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A derived table of versions, written once in an application as a real one would be stored: dates reach its scan."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _histories:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            folder = "file://" + tempfile.mkdtemp(prefix="entityframe-")
        path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}.parquet"
        make().write.parquet(path)
        _histories[key] = path
    return parquet(spark, _histories[key])


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    read = lambda name: parquet(spark, f"{sf_dir}/{name}.parquet")

    def versions() -> DataFrame:
        w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
        return read("orders").withColumn("in_z", F.col("o_orderdate")).withColumn("out_z", F.lead("o_orderdate").over(w))

    def hist() -> DataFrame:
        return history(spark, sf_dir, "orders_hist", versions)

    def orders() -> DataFrame:
        return read("orders").select("*", F.col("o_orderdate").cast("date").alias("o_date"), (F.col("o_orderstatus") == "F").alias("is_final"), F.col("o_totalprice").cast("decimal(15,2)").alias("price_dec"), (F.col("o_custkey") + 1).alias("ship_key"))

    def customers() -> DataFrame:
        return read("customer").withColumn("manager_id", F.when(F.col("c_custkey") > 0, F.expr("c_custkey div 10")))

    def event_versions() -> DataFrame:
        w = Window.partitionBy("user_id").orderBy("ts", "event_id")
        return read("events").select("event_id", "user_id", "event_type", "value", F.col("ts").cast("date").alias("day"), F.col("ts").alias("in_z"), F.lead("ts").over(w).alias("out_z"))

    plain = {t: (lambda t=t: read(t)) for t in ("region", "nation", "supplier", "part", "lineitem", "events")}
    derived = {
        "customers": customers,
        "orders_x": orders,
        "orders_hist": hist,
        "orders_hist_inf": lambda: hist().withColumn("out_z", F.coalesce("out_z", F.lit("9999-12-31 00:00:00").cast("timestamp_ntz"))),
        "orders_bi": lambda: hist().withColumns({"biz_from": F.col("o_orderdate").cast("date"), "biz_to": F.date_add(F.col("o_orderdate").cast("date"), 90)}),
        "events_hist": lambda: history(spark, sf_dir, "events_hist", event_versions),
    }
    return Engine(MODEL, Frames(plain | derived))

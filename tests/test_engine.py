"""Finders, temporal kinds, plans and sources on small fixtures."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from entityframe.model import Association, BiTemporal, EntityDef, Join, Model, Processing, PropertyDef, Source
from entityframe.model.markdown import loads
from entityframe.operators.expr import NoOperation
from entityframe.operators.finder import Engine
from entityframe.plans import catalog
from entityframe.plans.tables import engine
from entityframe.sources.graphql import Endpoint, GraphQL
from entityframe.sources.tables import Catalog, Chain, CsvFolder, Frames, ParquetFolder
from entityframe.streaming.folder import StreamFolder
from entityframe.stubs import stub

SF = "/root/testdata/sf0.001"
MARKDOWN = """
## Model: harbour.md

## DataStore: port (Database)

| Scheme   | processing_start | processing_end |
|----------|------------------|----------------|
| observed | seen_from        | seen_to        |

### Schema: quays

#### Table: berth_list → Berth

| Column   | Type    | Key | Property |
|----------|---------|-----|----------|
| BERTH_NO | INT     | PK  | number   |
| LABEL    | VARCHAR |     | label    |

### Schema: traffic

#### Table: port_calls → Call (milestoning: observed)

| Column    | Type      | Key | Property   |
|-----------|-----------|-----|------------|
| vessel    | VARCHAR   |     | vessel     |
| dues      | DOUBLE    |     | dues       |
| cleared   | BOOLEAN   |     | cleared    |
| berth_no  | INT       | FK  | berth      |
| seen_from | TIMESTAMP |     | seen_from  |
| seen_to   | TIMESTAMP |     | seen_to    |

#### Association: CallBerth

| Source Column | Target Table | Target Column |
|---------------|--------------|---------------|
| berth_no      | berth_list   | BERTH_NO      |
"""


@pytest.fixture(params=["UTC", "America/New_York"])
def zoned(spark, request):
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield spark
    spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.fixture
def harbour(zoned):
    berths = zoned.sql("SELECT 12 AS BERTH_NO, 'North Quay' AS LABEL")
    calls = zoned.sql("""SELECT vessel, dues, cleared, berth_no, CAST(a AS timestamp_ntz) AS seen_from, CAST(b AS timestamp_ntz) AS seen_to FROM VALUES
        ('Petrel', 310.5D, true, 12, '2017-03-01', '9999-12-31'), ('Tern', 75D, false, 12, '2017-03-01', '2018-09-15') AS t(vessel, dues, cleared, berth_no, a, b)""")
    return Engine(loads(MARKDOWN), Frames({"quays.berth_list": berths, "traffic.port_calls": calls}))


def rows(query):
    return sorted(tuple(r) for r in query.to_rows())


def test_snapshots_and_joins(harbour):
    c, b = harbour.Call, harbour.Berth
    assert rows(c.find_all(None, "2018-01-20 12:00:00", [c.vessel()])) == [("Petrel",), ("Tern",)]
    assert rows(c.find_all(None, "2019-01-20 12:00:00", [c.vessel(), c.dues()])) == [("Petrel", 310.5)]
    assert rows(c.find_all(None, "2018-09-15 00:00:00", [c.vessel()])) == [("Petrel",)]  # the end is excluded
    assert rows(c.find_all(None, "2017-03-01 00:00:00", [c.vessel()])) == [("Petrel",), ("Tern",)]  # the start is included
    assert rows(c.find_all(None, None, [c.vessel()], c.cleared().is_true())) == [("Petrel",)]
    q = c.find_all(None, None, [c.vessel(), c.berth().label()], c.vessel().eq("Petrel"))
    assert rows(q) == [("Petrel", "North Quay")] and q.to_df().columns == ["Vessel", "Berth Label"]
    # a root without dates passes none on
    assert rows(b.find_all("2019-01-20", "2019-01-20", [b.label(), b.calls().vessel()])) == [("North Quay", "Petrel"), ("North Quay", "Tern")]
    assert rows(b.find_all(None, None, [b.label()], b.calls().vessel().eq("Petrel"))) == [("North Quay",)]


def test_labels_and_windows(harbour):
    c = harbour.Call
    df = c.find_all(None, None, [c.vessel().lower(), c.dues().sum().over(), c.dues().rank("first", order_by=c.dues().ascending()), c.dues().shift(1, order_by=c.dues().ascending())]).order_by(c.dues().descending()).limit(1).to_df()
    assert df.columns == ["Lower Vessel", "Dues Sum", "Row Number", "Lag Dues"]
    assert [tuple(r) for r in df.collect()] == [("petrel", 385.5, 2, 75.0)]


def test_queries_are_immutable_and_errors_tell(harbour):
    c, b = harbour.Call, harbour.Berth
    q = c.find_all(None, None, [c.vessel()])
    assert q.limit(1) is not q and q.size is None and len(q.limit(0).to_rows()) == 0
    with pytest.raises(ValueError, match="neither displayed"):
        c.find_all(None, None, [c.vessel()], b.label().eq("x")).to_df()
    with pytest.raises(AttributeError):
        c.nothing()
    with pytest.raises(TypeError):
        c.vessel().eq("x").and_op("y")
    with pytest.raises(ValueError, match="line 3"):
        loads("## Model: m\n\nnonsense")
    frames = harbour.provider.frames
    with pytest.raises(ValueError, match="lacks columns"):
        Engine(harbour.model, Frames({"traffic.port_calls": frames["quays.berth_list"]})).Call.find_all(None, None, [c.vessel()]).to_df()
    with pytest.raises(ValueError, match="lacks columns .'seen_to'"):
        Engine(harbour.model, Frames({"traffic.port_calls": frames["traffic.port_calls"].drop("seen_to")})).Call.find_all(None, None, [c.vessel()]).to_df()


@pytest.mark.parametrize("name", ["Count", "Exists", "Attributes", "Find All"])
def test_names_of_finder_methods_are_refused(name):
    with pytest.raises(ValueError, match="method of finders"):
        Model("m", [EntityDef("T", Source("t"), (PropertyDef(name, "c", "String"),))])


def test_right_keys_are_checked(spark):
    m = Model("m", [EntityDef("A", Source("a"), (PropertyDef("X", "x", "Integer"),), (Join("other", "B", "x", "lost"),)), EntityDef("B", Source("b"), (PropertyDef("Y", "y", "Integer"),))])
    a = Engine(m, Frames({"a": spark.createDataFrame([(1,)], "x long"), "b": spark.createDataFrame([(1,)], "y long")})).A
    with pytest.raises(ValueError, match="b lacks columns .'lost'"):
        a.find_all(None, None, [a.other().y()]).to_df()


def test_no_operation_nested(harbour):
    c = harbour.Call
    petrel, none = c.vessel().eq("Petrel"), NoOperation()
    n = lambda w: len(c.find_all(None, None, [c.vessel()], w).to_rows())
    assert [n(petrel.and_op(none)), n(none.and_op(petrel)), n(petrel.or_op(none)), n(none.or_op(petrel)), n(none.and_op(none)), n(petrel & none & c.dues().gt(1) & none)] == [1, 1, 2, 2, 2, 1]


def test_tricky_text(spark):
    m = Model("m", [EntityDef("T", Source("t"), (PropertyDef("S", "s", "String"),))])
    values = ["it's", "50%", "a_b", "c\\d", "\tx", "é", "", None]
    e = Engine(m, Frames({"t": spark.createDataFrame([(v,) for v in values], "s string")}))
    t = e.T
    find = lambda w: {r[0] for r in t.find_all(None, None, [t.s()], w).to_rows()}
    assert find(t.s().eq("it's")) == {"it's"} and find(t.s().contains("\\")) == {"c\\d"} and find(t.s().contains("'")) == {"it's"}
    assert find(t.s().is_null()) == {None} and None not in find(t.s().not_contains("z"))


def test_numbers_at_the_edges(spark):
    m = Model("m", [EntityDef("T", Source("t"), (PropertyDef("D", "d", "Double"), PropertyDef("I", "i", "Integer")))])
    values = [1e300, -1e300, 2.0**53 + 2, -0.5, 1.5, float("inf"), float("nan"), None]
    t = Engine(m, Frames({"t": spark.createDataFrame([(v, 7) for v in values], "d double, i long")})).T
    got = [tuple(r) for r in t.find_all(None, None, [t.d().ceil(), t.d().floor(), t.d().mod(0), t.i().mod(0.0)]).to_rows()]
    assert [r[0] for r in got[:6]] == [1e300, -1e300, 2.0**53 + 2, 0.0, 2.0, float("inf")] and got[6][0] != got[6][0] and got[7][0] is None
    assert [r[1] for r in got[:6]] == [1e300, -1e300, 2.0**53 + 2, -1.0, 1.0, float("inf")]
    assert all(r[2] != r[2] for r in got[:7]) and got[7][2] is None and all(r[3] != r[3] for r in got)


def test_tree_and_plans(spark):
    taxa = spark.createDataFrame([(10, "Canids", None), (20, "Foxes", 10), (30, "Wolves", 10), (40, "Fennec", 20)], "nr long, title string, parent_nr long")
    d = EntityDef("Taxon", Source("taxa", "zoo"), (PropertyDef("Nr", "nr", "Integer"), PropertyDef("Title", "title", "String")), (Join("parent", "Taxon", "parent_nr", "nr"),))
    e = Engine(Model("zoo", [d], [Association("Taxon", "parent", "children")]), Frames({"zoo.taxa": taxa}))
    t = e.Taxon
    assert rows(t.find_all(None, None, [t.title(), t.parent().title(), t.parent().parent().title()], t.nr().eq(40))) == [("Fennec", "Foxes", "Canids")]
    assert rows(t.find_all(None, None, [t.children().title()], t.nr().eq(10))) == [("Foxes",), ("Wolves",)]
    assert rows(t.find_all(None, None, [t.title()], t.children().not_exists())) == [("Fennec",), ("Wolves",)]
    assert "LeftAnti" in t.find_all(None, None, [t.title()], t.children().not_exists()).to_plan()
    assert t.find_all(None, None, [t.parent().title(), t.parent().nr()]).to_plan().count("Join") == 1  # one join for a path
    assert t.find_all(None, None, [t.parent().title(), t.parent().parent().title()]).to_df(unique_names=True).columns == ["Parent Title", "Parent Parent Title"]
    assert "class TaxonFinder" in stub(e.model)
    top = t.find_all(None, None, [t.title()]).order_by(t.nr().descending()).limit(2).to_df()
    assert "TakeOrderedAndProject" in top._jdf.queryExecution().executedPlan().toString() and [r[0] for r in top.collect()] == ["Fennec", "Wolves"]


@pytest.mark.parametrize("infinite", [False, True])
def test_bitemporal_boundaries(zoned, infinite):
    end = "'9999-12-31'" if infinite else "NULL"
    rates = zoned.sql(f"SELECT 'k' AS k, 1 AS v, DATE'2011-04-10' AS bf, DATE'2011-04-15' AS bt, CAST('2011-05-01' AS timestamp_ntz) AS a, CAST({end} AS timestamp_ntz) AS z")
    kind = BiTemporal("bf", "bt", "a", "z", infinite)
    r = Engine(Model("m", [EntityDef("R", Source("r"), (PropertyDef("V", "v", "Integer"),), milestoning=kind)]), Frames({"r": rates})).R
    n = lambda b, p: len(r.find_all(b, p, [r.v()]).to_rows())
    assert [n("2011-04-10", "2011-05-01"), n("2011-04-14", "2030-01-01"), n("2011-04-15", "2011-05-01"), n("2011-04-09", "2011-05-01"), n("2011-04-10", "2011-04-30 23:59:59"), n(None, None)] == [1, 1, 0, 0, 0, 1]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_unordered_windows_gather_nothing_in_one_task(spark):
    """Sums over all rows or over few keys are grouped and joined back; ordered windows stay windows."""
    o = engine(spark, SF).Order
    for w in (o.total().sum().over(), o.total().max().over([o.status()]), o.total().count().over([o.status(), o.customer().segment()])):
        text = plan_of(o.find_all(None, None, [o.key(), w]).to_df())
        assert "Window" not in text and "partial_" in text
    assert "Window" in plan_of(o.find_all(None, None, [o.total().sum().over([o.status()], [o.key().ascending()])]).to_df())
    both = o.find_all(None, None, [o.key(), o.total().sum().over([o.status()]), o.total().min().over([o.status()]), o.key().count().over()]).order_by(o.key().ascending()).limit(3)
    got = both.to_rows()
    want = spark.sql(f"SELECT o_orderkey, sum(o_totalprice) OVER (PARTITION BY o_orderstatus), min(o_totalprice) OVER (PARTITION BY o_orderstatus), count(*) OVER () FROM parquet.`{SF}/orders.parquet` ORDER BY 1 LIMIT 3").collect()
    assert [tuple(r) for r in got] == [(a, pytest.approx(b), c, d) for a, b, c, d in want]


def test_filters_and_columns_reach_the_scan(spark):
    o = engine(spark, SF).Order
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    text = plan_of(o.find_all(None, None, [o.key()], o.total().gt(1000).and_op(o.status().eq("F"))).to_df())
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThan(o_totalprice,1000.0)" in text and "EqualTo(o_orderstatus,F)" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_totalprice:double>" in text


def test_dates_reach_the_scan_of_versions(spark):
    v = engine(spark, SF).Version
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    text = plan_of(v.find_all(None, "1998-06-01 00:00:00", [v.key()]).to_df())
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "Window" not in text and "LessThanOrEqual(in_z,1998-06-01T00:00)" in text and "Or(GreaterThan(out_z,1998-06-01T00:00),IsNull(out_z))" in text


SQL_QUERIES = sorted(n for n in catalog.queries() if n.startswith(("q_filter_eq", "q_filter_or", "q_join", "q_exists", "q_not_exists", "q_group", "q_agg", "q_topk", "q_win_lag", "q_str_left", "q_date_add_d", "q_num_ceil", "q_cross")))


@pytest.mark.parametrize("name", SQL_QUERIES)
def test_sql_text_gives_the_same_rows(spark, name):
    """The SQL of a query, run over views of its tables."""
    e = engine(spark, SF)
    query = catalog.builders()[name](e)
    for entity in e.model.entities.values():
        e.provider.table(entity).createOrReplaceTempView(entity.source.qualified)
    text = query.to_sql()
    got = spark.sql(text)
    assert text.startswith("SELECT") and got.columns == query.to_df().columns
    assert sorted(map(str, got.collect())) == sorted(map(str, query.to_rows()))


def test_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text("id,name\n1,a\n2,b\n")
    d = EntityDef("T", Source("t"), (PropertyDef("Id", "id", "Integer"), PropertyDef("Name", "name", "String")))
    t = Engine(Model("m", [d]), CsvFolder(spark, str(tmp_path), {"t": "id long, name string"})).T
    assert rows(t.find_all(None, None, [t.name()], t.id().gt(1))) == [("b",)]


def test_catalog_and_chain(spark):
    model = Model("m", [EntityDef(n, Source(t), (PropertyDef("Id", "id", "Integer"),)) for n, t in (("First", "chain_first"), ("Second", "chain_second"))])
    spark.createDataFrame([(5,)], "id long").createOrReplaceTempView("chain_second")
    e = Engine(model, Chain(Frames({"chain_first": spark.createDataFrame([(4,)], "id long")}), Catalog(spark)))
    for finder, want in ((e.First, 4), (e.Second, 5)):
        assert rows(finder.find_all(None, None, [finder.id()])) == [(want,)]
    model = Model("m", [EntityDef("T", Source("no_such_table"), (PropertyDef("Id", "id", "Integer"),))])
    t = Engine(model, Chain(Frames({}), Catalog(spark))).T
    with pytest.raises(Exception, match="TABLE_OR_VIEW_NOT_FOUND"):
        t.find_all(None, None, [t.id()]).to_df()


def test_parquet_folder_and_stream(spark, tmp_path):
    d = EntityDef("Reading", Source("readings"), (PropertyDef("Id", "id", "Integer"), PropertyDef("Level", "level", "Double")))
    spark.createDataFrame([(1, 0.5), (2, 1.5)], "id long, level double").write.parquet(f"{tmp_path}/readings.parquet")
    batch = Engine(Model("m", [d]), ParquetFolder(spark, str(tmp_path))).Reading
    assert rows(batch.find_all(None, None, [batch.id()], batch.level().gt(1))) == [(2,)]
    live = Engine(Model("m", [d]), StreamFolder(spark, str(tmp_path), {"readings": "id long, level double"})).Reading
    df = live.find_all(None, None, [live.id().alias("id")], live.level().gt(1)).to_df()
    assert df.isStreaming

    def run():
        df.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/progress").trigger(availableNow=True).start().awaitTermination(60)
        return sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect())

    assert run() == [2]
    spark.createDataFrame([(3, 2.5), (4, 0.1)], "id long, level double").write.mode("append").parquet(f"{tmp_path}/readings.parquet")
    assert run() == [2, 3]


@pytest.fixture
def server():
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            text = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["query"]
            asked.append(text)
            body = {"errors": ["no"]} if "broken" in text else {"data": {}} if "absent" in text else {"data": {"gauges": [{"place": "Weir", "flow": 18.25, "day": 3}, {"place": "Lock", "flow": 2, "day": None}]}}
            self.send_response(503 if "down" in text else 200)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *a):
            pass

    http = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}/", asked
    http.shutdown()


def test_graphql(spark, server):
    url, asked = server
    props = (PropertyDef("Place", "place", "String"), PropertyDef("Flow", "flow", "Double"), PropertyDef("Day", "day", "Integer"))
    names = ("gauges", "broken", "absent", "down")
    m = Model("g", [EntityDef(n.title(), Source(n), props) for n in names])
    schema = "place string, flow double, day int"
    e = Engine(m, GraphQL(spark, {n: Endpoint(url, n, schema, processing_argument="seenAt", business_argument="onDay") for n in names}))
    g = e.Gauges
    # only the fields that the query uses, and the dates given to find_all
    assert rows(g.find_all(None, None, [g.place()])) == [("Lock",), ("Weir",)] and asked[-1] == "{ gauges { place } }"
    assert rows(g.find_all(None, "2016-02-29 06:45:00", [g.place(), g.flow()], g.flow().gt(10))) == [("Weir", 18.25)]
    assert asked[-1] == '{ gauges(seenAt: "2016-02-29T06:45:00.000Z") { place flow } }'
    assert rows(g.find_all("2016-02-29", None, [g.place()], g.day().is_null())) == [("Lock",)]
    assert asked[-1] == '{ gauges(onDay: "2016-02-29") { place day } }'
    assert rows(g.find_all("2016-02-29", "2016-03-01 00:00:00", [g.count()])) == [(2,)]
    assert asked[-1] == '{ gauges(onDay: "2016-02-29", seenAt: "2016-03-01T00:00:00.000Z") { place } }'
    assert [r[0] for r in g.find_all(None, None, [g.place()]).order_by(g.flow().descending()).limit(1).to_rows()] == ["Weir"] and asked[-1] == "{ gauges { place flow } }"
    assert Endpoint(url, "p", "a int").text(["a"], "2016-02-29", "2016-02-29") == "{ p { a } }"
    # a missing field has no rows; errors of the server and of the transport are raised
    assert e.Absent.find_all(None, None, [e.Absent.place()]).to_rows() == []
    for finder, message in ((e.Broken, "GraphQL errors"), (e.Down, "503")):
        with pytest.raises(Exception, match=message):
            finder.find_all(None, None, [finder.place()]).to_rows()


def test_processing_kind_is_plain_data():
    assert Processing("a", "b") == Processing("a", "b") and Processing("a", "b").gate("2020-01-01", "2021-01-01") == (None, "2021-01-01")

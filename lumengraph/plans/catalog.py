"""The registered queries over the mapped tables, each beside the SQL that states its meaning on the tables themselves.

Orders have a history: each is inserted by its month's change (``i`` and the month); change j1 deletes those whose key 10
divides, j2 inserts again those whose key 20 divides, and j3 deletes and inserts the priority of those whose key 7 divides
and 10 doesn't. All other rows come with change a0.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumengraph.functions import columns as c
from lumengraph.functions import cursors
from lumengraph.model import LOG, QUAD, RDF_TYPE, XSD
from lumengraph.operators import access, changes, documents, revisions
from lumengraph.operators import select as s
from lumengraph.operators import state as st
from lumengraph.sources import rdf
from lumengraph.sources.mapping import BASE, TABLES, cells, iri, logged, quads
from lumengraph.store import new_path
from lumengraph.streaming import feeds

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

LIVE = "(SELECT * FROM orders WHERE o_orderkey % 10 <> 0 OR o_orderkey % 20 = 0)"
CUSTOMER, ORDER, NATION = (f"'{BASE}{x}/'" for x in ("customer", "order", "nation"))


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def ex(name: str) -> str:
    return BASE + name


def f(name: str, kind: str = "string", **more) -> s.Field:
    return s.Field(name, ex(name), kind, **more)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


#: Records of one file of the log. Spark fills a task of a scan by bytes, 4 MB of them for each file's opening: by its default of
#: 128 MB these are 32 files, a million records at most. Above 200 partitions a task that deals records out holds all that it reads.
FILE_RECORDS = 31_250

#: Of each log written, its path and the number of its records by predicate.
_stored: dict[tuple[str, str, str], tuple[str, dict[str, int]]] = {}


def recorded(rows: DataFrame, name: str, predicate: str) -> DataFrame:
    """The log of one table's quads of a predicate with its history, as it is written."""
    own = lambda some, **more: quads(some, TABLES[name], predicate=predicate, **more)
    if name != "orders":
        return logged(own(rows), F.lit("a0"), F.lit("1990-01-01"))
    key = F.col("o_orderkey")
    dated = own(rows, extra={"month": F.date_format("o_orderdate", "yyyyMM")})
    parts = [
        logged(dated, F.concat(F.lit("i"), F.col("month")), F.to_timestamp(F.concat("month", F.lit("01")), "yyyyMMdd")),
        logged(own(rows.where(key % 10 == 0)), F.lit("j1"), F.lit("2000-01-01"), -1),
        logged(own(rows.where(key % 20 == 0)), F.lit("j2"), F.lit("2000-02-01")),
    ]
    if predicate == ex("priority"):
        parts += [logged(own(rows.where((key % 7 == 0) & (key % 10 != 0))), F.lit("j3"), F.lit("2000-03-01"), sign) for sign in (-1, 1)]
    return reduce(DataFrame.unionByName, parts)


def write_log(spark: SparkSession, sf: str, name: str, path: str) -> None:
    """The log of one table, partitioned by predicate: each is written by itself, so that no task sorts its rows by predicate.
    Files are bounded in rows, since a few stored bytes hold many."""
    rows = table(spark, sf, name)
    for p in cells(rows, TABLES[name]):
        out = recorded(rows, name, p).drop("predicate")
        out.write.option("compression", "zstd").option("maxRecordsPerFile", FILE_RECORDS).parquet(f"{path}/predicate={quote(p, safe='')}")


def counted(spark: SparkSession, path: str) -> dict[str, int]:
    """Records by predicate: a folder is a predicate, so that only the ends of files are read."""
    return {r["predicate"]: r["count"] for r in spark.read.schema(LOG).parquet(path).groupBy("predicate").count().collect()}


def _log(spark: SparkSession, sf: str, name: str) -> tuple[str, dict[str, int]]:
    known = (spark.sparkContext.applicationId, sf, name)
    if known not in _stored:
        path = new_path(spark, f"log-{name}")
        write_log(spark, sf, name, path)
        _stored[known] = path, counted(spark, path)
    return _stored[known]


def _predicates(name: str, columns: tuple[str, ...]) -> set[str]:
    """Those of some of a table's columns, and the class."""
    mapped = TABLES[name]
    own = {**mapped.literals, **{c_: p for c_, (p, _) in mapped.links.items()}}
    return {RDF_TYPE, *(ex(own[c_]) for c_ in columns if c_ in own)}


def log(spark: SparkSession, sf: str, *names: str, columns: tuple[str, ...] | None = None) -> DataFrame:
    """The log of some tables, restricted to the predicates of some columns. It is written once a session, partitioned by
    predicate, so that a selection reads the predicates that it needs and no others."""
    parts = []
    for name in names:
        rows = spark.read.schema(LOG).parquet(_log(spark, sf, name)[0]).select(*LOG.names)
        parts.append(rows if columns is None else rows.where(F.col("predicate").isin(*sorted(_predicates(name, columns)))))
    return reduce(DataFrame.unionByName, parts)


def held(spark: SparkSession, sf: str, *names: str, columns: tuple[str, ...] | None = None, predicates: Sequence[str] = ()) -> int:
    """How many records the log of some tables holds, of some columns or predicates."""
    fits = lambda name, p: (columns is None or p in _predicates(name, columns)) and (not predicates or p in predicates)
    return sum(n for name in names for p, n in _log(spark, sf, name)[1].items() if fits(name, p))


def now(spark: SparkSession, sf: str, *names: str, node: s.Node | None = None, at: str | None = None, columns: tuple[str, ...] | None = None, predicates: Sequence[str] = (), by: Sequence[str] = ("subject",)) -> DataFrame:
    """The state of some tables' quads, restricted to what a selection reads."""
    wanted = sorted(s.predicates(node)) if node else predicates
    return st.state(log(spark, sf, *names, columns=columns), at=at, predicates=wanted, by=by, records=held(spark, sf, *names, columns=columns, predicates=wanted))


def number(column: str = "id") -> Column:
    """The key in a subject's IRI."""
    return F.regexp_extract(column, r"/(\d+)$", 1).cast("long")


def flat(spark: SparkSession, sf: str, node: s.Node, *names: str, at: str | None = None) -> DataFrame:
    return s.flat(now(spark, sf, *names, node=node, at=at), node)


# --- the log and its states


@query(f"""
    SELECT {ORDER} || o_orderkey AS subject, p AS predicate, o AS object,
           CASE WHEN o_orderkey % 20 = 0 THEN 'j2' WHEN p = '{BASE}priority' AND o_orderkey % 7 = 0 AND o_orderkey % 10 <> 0 THEN 'j3' ELSE 'i' || strftime(o_orderdate, '%Y%m') END AS change_id
    FROM {LIVE}, LATERAL (VALUES ('{BASE}status', o_orderstatus), ('{BASE}priority', o_orderpriority), ('{BASE}customer', {CUSTOMER} || o_custkey), ('{RDF_TYPE}', '{BASE}Order')) v(p, o)
""")
def kg_state_collapse(spark, sf):
    """The current state with each quad's last change."""
    rows = now(spark, sf, "orders", columns=("o_orderstatus", "o_orderpriority", "o_custkey"), by=QUAD)
    return rows.select("subject", "predicate", "object", "change_id")


@query(f"SELECT {ORDER} || o_orderkey AS subject, o_orderstatus AS object FROM orders WHERE strftime(o_orderdate, '%Y%m') <= '199512'")
def kg_state_at_change(spark, sf):
    """Time travel to a change, before any deletion."""
    return now(spark, sf, "orders", at="i199512", predicates=[ex("status")], by=QUAD).select("subject", "object")


@query(f"SELECT {ORDER} || o_orderkey AS subject, o_orderstatus AS object FROM orders WHERE o_orderdate < TIMESTAMP '1995-06-01'")
def kg_state_at_timestamp(spark, sf):
    """Time travel to a time, by the last change committed before it."""
    rows = log(spark, sf, "orders", columns=("o_orderstatus",))
    done = rows.select(F.col("change_id").alias("id"), "timestamp", F.lit("COMMITTED").alias("status")).distinct()
    return st.state_at_time(rows, done, F.lit("1995-06-01").cast("timestamp"), predicates=[ex("status")], records=held(spark, sf, "orders", predicates=[ex("status")])).select("subject", "object")


@query(f"SELECT {ORDER} || o_orderkey AS subject FROM orders WHERE o_orderkey % 10 <> 0")
def kg_state_after_delete(spark, sf):
    """What a deletion leaves."""
    return now(spark, sf, "orders", columns=(), at="j1", by=QUAD).select("subject")


@query("SELECT CAST(sign AS BIGINT) AS sign, count(*) AS n FROM (SELECT 1 AS sign FROM orders UNION ALL SELECT -1 FROM orders WHERE o_orderkey % 10 = 0 UNION ALL SELECT 1 FROM orders WHERE o_orderkey % 20 = 0) GROUP BY 1")
def kg_log_dedup(spark, sf):
    """Records delivered twice count once."""
    rows = log(spark, sf, "orders", columns=())
    return st.deduplicated(rows.union(rows)).groupBy(F.col("sign").cast("long").alias("sign")).agg(F.count("*").alias("n"))


@query("""
    SELECT change_id, CAST(sum(i) AS BIGINT) AS inserts, CAST(sum(d) AS BIGINT) AS deletes FROM (
        SELECT 'i' || strftime(o_orderdate, '%Y%m') AS change_id, 2 AS i, 0 AS d FROM orders UNION ALL SELECT 'j1', 0, 2 FROM orders WHERE o_orderkey % 10 = 0
        UNION ALL SELECT 'j2', 2, 0 FROM orders WHERE o_orderkey % 20 = 0) GROUP BY 1
""")
def kg_change_stats(spark, sf):
    """Insertions and deletions of each change."""
    return st.change_counts(log(spark, sf, "orders", columns=("o_orderstatus",)))


@query(f"SELECT {ORDER} || o_orderkey AS subject, o_orderstatus AS object, CAST(-1 AS BIGINT) AS sign FROM orders WHERE o_orderkey % 10 = 0 AND o_orderstatus = 'F'")
def kg_change_records_filtered(spark, sf):
    """A change's records by predicate, object and kind."""
    rows = st.records(log(spark, sf, "orders"), "j1", predicates=[ex("status")], objects=["F"], sign=-1)
    return rows.select("subject", "object", F.col("sign").cast("long").alias("sign"))


@query(f"""
    SELECT change_id, n FROM (SELECT 'i' || strftime(o_orderdate, '%Y%m') AS change_id, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT 'j1', count(*) FROM orders WHERE o_orderkey % 10 = 0 UNION ALL SELECT 'j2', count(*) FROM orders WHERE o_orderkey % 20 = 0)
    ORDER BY change_id DESC LIMIT 10
""")
def kg_change_listing(spark, sf):
    """The last changes first, ten of them."""
    return log(spark, sf, "orders", columns=()).groupBy("change_id").agg(F.count("*").alias("n")).orderBy(F.desc("change_id")).limit(10)


@query(f"SELECT {ORDER} || o_orderkey AS subject, o_orderstatus AS object FROM orders WHERE o_orderkey % 10 = 0 ORDER BY 1 OFFSET 50 LIMIT 26")
def kg_change_records_page(spark, sf):
    """A page of a change's records, and one more that tells of the next."""
    rows = st.records(log(spark, sf, "orders"), "j1", predicates=[ex("status")]).withColumnRenamed("subject", "id")
    return s.page(rows, size=26, cursor=cursors.encode(50)).select(F.col("id").alias("subject"), "object")


@query("SELECT id, max_by(status, n) AS status, max(CASE WHEN status <> 'COMMITTED' THEN 'refused' END) AS error FROM (SELECT event_id // 3 AS id, ts, row_number() OVER (PARTITION BY event_id // 3 ORDER BY ts, event_type) AS n, CASE WHEN event_type < 'm' THEN 'COMMITTED' ELSE 'VALIDATION_ERROR' END AS status FROM events) GROUP BY 1")
def kg_change_status(spark, sf):
    """A change's status is its latest entry's; the error that of the latest failure."""
    rows = table(spark, sf, "events")
    number_ = F.row_number().over(s.Window.partitionBy(F.floor(F.col("event_id") / 3)).orderBy("ts", "event_type"))
    bad = F.col("event_type") >= "m"
    entries = rows.select(F.floor(F.col("event_id") / 3).alias("id"), number_.alias("timestamp"), F.when(bad, "VALIDATION_ERROR").otherwise("COMMITTED").alias("status"), F.when(bad, "refused").alias("message"))
    return st.change_status(entries)


# --- the schema


@query(f"""
    SELECT * FROM (VALUES ('{BASE}Customer', '{BASE}name', 'Literal', '{XSD}string'), ('{BASE}Customer', '{BASE}acctbal', 'Literal', '{XSD}double'), ('{BASE}Customer', '{BASE}mktsegment', 'Literal', '{XSD}string'),
        ('{BASE}Customer', '{BASE}nation', 'IRI', '{BASE}Nation'), ('{BASE}Nation', '{BASE}name', 'Literal', '{XSD}string'), ('{BASE}Nation', '{BASE}region', 'IRI', 'http://www.w3.org/2000/01/rdf-schema#Resource')) v(type_uri, property_uri, property_kind, property_ref)
""")
def kg_metadata_types(spark, sf):
    """Classes, their properties and what these lead to, from the data."""
    return st.inferred(log(spark, sf, "customer", "nation"), records=held(spark, sf, "customer", "nation"))


@query(f"""
    SELECT * FROM (VALUES ('{BASE}Customer', '{BASE}nation', '{BASE}Nation'), ('{BASE}Nation', '{BASE}name', '{XSD}string'), ('{BASE}Nation', '{BASE}region', '{BASE}Region'), ('{BASE}Region', '{BASE}name', '{XSD}string'),
        ('{BASE}Customer', '{BASE}name', '{XSD}string')) v(type_uri, property_uri, read_as)
""")
def kg_metadata_fields(spark, sf):
    """What each field of the inferred schema is read as."""
    rows = log(spark, sf, "customer", "nation", "region", columns=("c_name", "c_nationkey", "n_name", "n_regionkey", "r_name"))
    return st.properties(st.inferred(rows)).select("type_uri", "property_uri", st.field_type(F.col("refs")).alias("read_as"))


# --- entry points and filters


@query(f"SELECT {CUSTOMER} || c_custkey AS id, c_name AS name, c_acctbal AS acctbal FROM customer")
def kg_entry_class(spark, sf):
    """All instances of a class with two fields."""
    return flat(spark, sf, s.Node(ex("Customer"), (f("name"), f("acctbal", "double"))), "customer")


@query(f"SELECT {NATION} || n_nationkey AS id FROM nation UNION ALL SELECT '{BASE}region/' || r_regionkey FROM region")
def kg_entry_resource(spark, sf):
    """All subjects, whatever they are."""
    return now(spark, sf, "nation", "region").select(F.col("subject").alias("id")).distinct()


@query(f"SELECT {CUSTOMER} || c_custkey AS id, c_name AS name, c_acctbal AS acctbal FROM customer WHERE c_custkey = 1")
def kg_arg_id(spark, sf):
    """One entity by its prefixed name."""
    return flat(spark, sf, s.Node(ex("Customer"), (f("name"), f("acctbal", "double")), ids=(c.expand("ex:customer/1", {"ex": BASE}),)), "customer")


@query(f"SELECT {CUSTOMER} || c_custkey AS id, c_name AS name FROM customer WHERE c_custkey IN (1, 5, 9, 1000000000)")
def kg_arg_id_list(spark, sf):
    """Several ids; those that don't exist give nothing."""
    return flat(spark, sf, s.Node(ex("Customer"), (f("name"),), ids=tuple(ex(f"customer/{k}") for k in (1, 5, 9, 1000000000))), "customer")


@query(f"SELECT {ORDER} || o_orderkey AS id, o_totalprice AS totalprice FROM {LIVE} WHERE o_orderstatus IN ('F', 'P') AND o_orderpriority = '1-URGENT'")
def kg_arg_property(spark, sf):
    """Arguments that name properties' values; all have to fit."""
    wanted = {"status": ("F", "P"), "priority": ("1-URGENT",)}
    node = s.Node(ex("Order"), (f("totalprice", "double"), *(f(k, test=c.within(*v)) for k, v in wanted.items())), hidden=tuple(wanted))
    return flat(spark, sf, node, "orders")


@query(f"SELECT {ORDER} || o_orderkey AS subject FROM {LIVE} WHERE o_custkey IN (1, 2, 4)")
def kg_arg_relation(spark, sf):
    """Subjects that link to one of some entities, as a semi-join."""
    rows = now(spark, sf, "orders", columns=("o_custkey",))
    own = st.constrained(rows, rows, [ex("customer")], [ex(f"customer/{k}") for k in (1, 2, 4)])
    return own.select("subject").distinct()


def _orders(spark, sf, where, *fields):
    node = s.Node(ex("Order"), (f("totalprice", "double"), *fields), where=where, hidden=tuple(x.name for x in fields))
    return flat(spark, sf, node, "orders")


@query(f"SELECT {ORDER} || o_orderkey AS id, o_totalprice AS totalprice FROM {LIVE} WHERE o_orderstatus = 'F'")
def kg_filter_eq(spark, sf):
    """A filter on the entity."""
    return _orders(spark, sf, lambda v: s.any_of(v["status"], c.eq("F")), f("status"))


@query(f"SELECT {ORDER} || o_orderkey AS id, o_totalprice AS totalprice FROM {LIVE} WHERE o_orderstatus <> 'F'")
def kg_filter_ne(spark, sf):
    """Another value than."""
    return _orders(spark, sf, lambda v: s.any_of(v["status"], c.ne("F")), f("status"))


@query(f"SELECT '{BASE}part/' || p_partkey AS id, p_name AS name, p_type AS type FROM part WHERE p_type LIKE 'S%' AND p_name LIKE '%gear' AND contains(p_brand, 'and#2')")
def kg_filter_wildcard(spark, sf):
    """Wildcards at a pattern's beginning and end."""
    tests = {"type": "S*", "name": "*gear", "brand": "*and#2*"}
    node = s.Node(ex("Part"), tuple(f(k) for k in tests), where=lambda v: reduce(Column.__and__, (s.any_of(v[k], c.eq(x)) for k, x in tests.items())), hidden=("brand",))
    return flat(spark, sf, node, "part")


@query(f"SELECT {ORDER} || o_orderkey AS id, o_totalprice AS totalprice FROM {LIVE} WHERE o_totalprice >= 1000 AND o_totalprice < 200000")
def kg_filter_range(spark, sf):
    """Numbers compare as numbers, though literals are text."""
    node = s.Node(ex("Order"), (f("totalprice", "double"),), where=lambda v: s.any_of(v["totalprice"], c.both(c.ge(1000.0), c.lt(200000.0))))
    return flat(spark, sf, node, "orders")


@query(f"SELECT {ORDER} || o_orderkey AS id, o_totalprice AS totalprice FROM {LIVE} WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def kg_filter_in(spark, sf):
    """One of."""
    return _orders(spark, sf, lambda v: s.any_of(v["priority"], c.within("1-URGENT", "2-HIGH")), f("priority"))


@query(f"SELECT {ORDER} || o_orderkey AS id, o_totalprice AS totalprice FROM {LIVE} WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')")
def kg_filter_out(spark, sf):
    """None of."""
    return _orders(spark, sf, lambda v: s.any_of(v["priority"], c.outside("1-URGENT", "2-HIGH")), f("priority"))


@query(f"SELECT {ORDER} || o_orderkey AS id, o_totalprice AS totalprice FROM {LIVE} WHERE o_orderstatus = 'P' OR o_totalprice > 300000")
def kg_filter_or(spark, sf):
    """One filter or the other."""
    return _orders(spark, sf, lambda v: s.any_of(v["status"], c.eq("P")) | s.any_of(v["totalprice"], c.gt(300000.0)), f("status"))


@query(f"SELECT {NATION} || n_nationkey AS id, c_name AS customer FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_acctbal > 9000")
def kg_filter_field_it(spark, sf):
    """A filter on a field keeps the values that pass, and the entities that keep one."""
    below = s.Node(ex("Customer"), (f("name"), f("acctbal", "double", test=c.gt(9000.0))))
    node = s.Node(ex("Nation"), (s.Field("of", ex("nation"), reverse=True, node=below),))
    return flat(spark, sf, node, "nation", "customer").select("id", F.col("of_name").alias("customer"))


@query(f"SELECT {NATION} || n_nationkey AS subject, '{BASE}region/' || n_regionkey AS object FROM nation")
def kg_filter_types(spark, sf):
    """Links to instances of a class."""
    rows = now(spark, sf, "nation", "region")
    return st.of_class(rows.where(F.col("datatype") == "").where(F.col("predicate") != RDF_TYPE), ex("Region"), rows, "object").select("subject", "object")


# --- fields and joins


@query(f"SELECT {CUSTOMER} || c_custkey AS id, c_name AS name, CASE WHEN c_acctbal < 0 THEN c_acctbal END AS debt FROM customer")
def kg_optional_field(spark, sf):
    """An optional field that some entities lack."""
    node = s.Node(ex("Customer"), (f("name"), s.Field("debt", ex("acctbal"), "double", optional=True, test=c.lt(0.0))))
    return flat(spark, sf, node, "customer")


@query(f"SELECT {CUSTOMER} || c_custkey AS id, c_name AS name, c_acctbal AS debt FROM customer WHERE c_acctbal < 0")
def kg_required_field(spark, sf):
    """A field is required unless it is optional."""
    return flat(spark, sf, s.Node(ex("Customer"), (f("name"), s.Field("debt", ex("acctbal"), "double", test=c.lt(0.0)))), "customer")


@query(f"SELECT {ORDER} || o_orderkey AS id, o_totalprice AS totalprice, {CUSTOMER} || c_custkey AS customer_id, c_name AS customer_name FROM {LIVE} JOIN customer ON c_custkey = o_custkey")
def kg_forward_join(spark, sf):
    """Along a link."""
    node = s.Node(ex("Order"), (f("totalprice", "double"), f("customer", node=s.Node(ex("Customer"), (f("name"),)))))
    return flat(spark, sf, node, "orders", "customer")


@query(f"""
    SELECT {ORDER} || o_orderkey AS id, c_name AS customer, n_name AS nation, r_name AS region FROM {LIVE} JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
    WHERE o_totalprice > 200000
""")
def kg_forward_3hop(spark, sf):
    """Along three links."""
    region = s.Node(ex("Region"), (f("name"),))
    nation = s.Node(ex("Nation"), (f("name"), f("region", node=region)))
    customer = s.Node(ex("Customer"), (f("name"), f("nation", node=nation)))
    node = s.Node(ex("Order"), (f("totalprice", "double", test=c.gt(200000.0)), f("customer", node=customer)), hidden=("totalprice",))
    out = flat(spark, sf, node, "orders", "customer", "nation", "region")
    return out.select("id", F.col("customer_name").alias("customer"), F.col("customer_nation_name").alias("nation"), F.col("customer_nation_region_name").alias("region"))


@query(f"SELECT {CUSTOMER} || c_custkey AS id, c_name AS name, {ORDER} || o_orderkey AS order_id, o_orderstatus AS order_status FROM customer JOIN {LIVE} ON c_custkey = o_custkey")
def kg_reverse_join(spark, sf):
    """Against a link."""
    node = s.Node(ex("Customer"), (f("name"), s.Field("order", ex("customer"), reverse=True, node=s.Node(ex("Order"), (f("status"),)))))
    return flat(spark, sf, node, "orders", "customer")


@query(f"SELECT {CUSTOMER} || c_custkey AS id, {ORDER} || o_orderkey AS order_id, o_orderstatus AS order_status FROM customer LEFT JOIN (SELECT * FROM {LIVE} WHERE o_orderstatus = 'P') ON c_custkey = o_custkey WHERE c_acctbal > 5000")
def kg_optional_nested(spark, sf):
    """Entities without what an optional field leads to stay; those it leads to are restricted on their own."""
    rows = now(spark, sf, "orders", "customer")
    rich = s.entities(rows, s.Node(ex("Customer"), (f("acctbal", "double", test=c.gt(5000.0)),))).select("id")
    orders = s.entities(rows, s.Node(ex("Order"), (f("status", test=c.eq("P")), f("customer", many=True)))).select(F.col("id").alias("order_id"), F.col("status").alias("order_status"), F.explode("customer").alias("_c"))
    return rich.join(orders, rich.id == orders["_c"], "left").drop("_c")


@query(f"SELECT {CUSTOMER} || c_custkey AS id, {ORDER} || o_orderkey AS orders_id, o_totalprice AS orders_totalprice FROM customer LEFT JOIN (SELECT * FROM {LIVE} WHERE o_totalprice > 250000) ON c_custkey = o_custkey WHERE c_acctbal > 0")
def kg_optional_filtered(spark, sf):
    """An optional field whose entities are filtered; one row without for an entity of which none passes."""
    below = s.Node(ex("Order"), (f("totalprice", "double", test=c.gt(250000.0)),))
    node = s.Node(ex("Customer"), (f("acctbal", "double", test=c.gt(0.0)), s.Field("orders", ex("customer"), reverse=True, optional=True, node=below)), hidden=("acctbal",))
    return flat(spark, sf, node, "orders", "customer")


@query(f"""
    SELECT id, nation, customer FROM (
        SELECT '{BASE}region/' || r_regionkey AS id, n_name AS nation, c_name AS customer, m, row_number() OVER (PARTITION BY r_regionkey, n_nationkey ORDER BY c_acctbal DESC, {CUSTOMER} || c_custkey) AS k
        FROM (SELECT *, row_number() OVER (PARTITION BY r_regionkey ORDER BY n_name DESC, {NATION} || n_nationkey) AS m FROM region JOIN nation ON n_regionkey = r_regionkey WHERE n_nationkey IN (SELECT c_nationkey FROM customer)) JOIN customer ON c_nationkey = n_nationkey)
    WHERE m <= 2 AND k <= 3
""")
def kg_nested_levels(spark, sf):
    """W-a, O2: each level of nested entities with an order and a size of its own."""
    buyers = s.Field("customers", ex("nation"), reverse=True, node=s.Node(ex("Customer"), (f("name"), f("acctbal", "double"))), order=("-acctbal",), size=3)
    nations = s.Field("nations", ex("region"), reverse=True, node=s.Node(ex("Nation"), (f("name"), buyers)), order=("-name",), size=2)
    node = s.Node(ex("Region"), (nations,))
    out = s.nested(now(spark, sf, "region", "nation", "customer", node=node), node).select("id", F.explode("nations").alias("n"))
    return out.select("id", F.col("n.name").alias("nation"), F.explode("n.customers.name").alias("customer"))


@query(f"SELECT {NATION} || n_nationkey AS id, n_name AS name, '{BASE}Nation' AS type_name, n_name AS nation_name FROM nation UNION ALL SELECT '{BASE}region/' || r_regionkey, r_name, '{BASE}Region', NULL FROM region")
def kg_inline_fragment(spark, sf):
    """A field that only entities of one class show."""
    rows = now(spark, sf, "nation", "region")
    named = s.entities(rows, s.Node(None, (f("name"),)))
    typed = s.types_of(rows)
    out = named.join(typed, "id", "left")
    return out.select("id", "name", s.type_name(F.col("types")).alias("type_name"), F.when(F.array_contains("types", ex("Nation")), F.col("name")).alias("nation_name"))


@query(f"""
    SELECT {NATION} || n_nationkey AS id, '{{"@id":"{BASE}region/' || n_regionkey || '"}}' AS value FROM nation
    UNION ALL SELECT {NATION} || n_nationkey, '{{"@value":"' || n_name || '","@type":"{XSD}string"}}' FROM nation
""")
def kg_rawrdf(spark, sf):
    """Values as they are in RDF."""
    rows = now(spark, sf, "nation").where(F.col("predicate") != RDF_TYPE)
    return rows.select(F.col("subject").alias("id"), rdf.raw(F.col("datatype"), F.col("object"), F.col("language")).alias("value"))


@query(f"SELECT {NATION} || n_nationkey AS id, '{BASE}Nation' AS type FROM nation UNION ALL SELECT '{BASE}region/' || r_regionkey, '{BASE}Region' FROM region")
def kg_types(spark, sf):
    """P20: each subject's classes."""
    return s.types_of(now(spark, sf, "nation", "region")).select("id", F.explode("types").alias("type"))


@query(f"SELECT {CUSTOMER} || c_custkey AS id, p AS predicate FROM customer, (VALUES ('{RDF_TYPE}'), ('{BASE}name'), ('{BASE}acctbal'), ('{BASE}mktsegment'), ('{BASE}nation')) v(p)")
def kg_predicates(spark, sf):
    """Each subject's predicates."""
    return s.predicates_of(now(spark, sf, "customer")).select("id", F.explode("predicates").alias("predicate"))


@query(f"SELECT {ORDER} || o_orderkey AS id, '{BASE}customer' AS relation FROM {LIVE} WHERE o_custkey = 1")
def kg_relations(spark, sf):
    """How subjects relate to one entity."""
    return s.relations_to(now(spark, sf, "orders", columns=("o_custkey",)), ex("customer/1")).select("id", F.explode("relations").alias("relation"))


@query(f"SELECT {CUSTOMER} || c_custkey AS id, c_mktsegment AS value, '{XSD}string' AS datatype FROM customer")
def kg_object_dynamic(spark, sf):
    """A predicate given as a value."""
    return s.objects_of(now(spark, sf, "customer"), ex("mktsegment")).select("id", "value", "datatype")


@query(f"SELECT {NATION} || n_nationkey AS id, CASE WHEN n_nationkey % 3 = 0 THEN n_name || ' de' ELSE n_name END AS label FROM nation WHERE n_nationkey % 3 <> 1")
def kg_language(spark, sf):
    """P10: literals in a language, or in none."""
    rows = now(spark, sf, "nation").where(F.col("predicate") == ex("name"))
    tag = F.element_at(F.array(F.lit("de"), F.lit("fr"), F.lit("")), (number("subject") % 3 + 1).cast("int"))
    labels = rows.withColumn("language", tag).withColumn("object", F.when(tag == "", F.col("object")).otherwise(F.concat("object", F.lit(" "), tag)))
    return s.entities(labels, s.Node(None, (s.Field("label", ex("name"), language="de"),)))


@query(f"SELECT {CUSTOMER} || c_custkey AS subject, c_name AS object, '{BASE}graph/' || lower(c_mktsegment) AS graph FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def kg_named_graph(spark, sf):
    """Quads of some named graphs."""
    rows = table(spark, sf, "customer")
    own = quads(rows, TABLES["customer"], ("c_name",), extra={"segment": F.lower("c_mktsegment")})
    own = logged(own.withColumn("graph", F.concat(F.lit(ex("graph/")), F.col("segment"))), F.lit("a0"), F.lit("1990-01-01"))
    return st.state(own, graphs=[ex("graph/building"), ex("graph/machinery")], predicates=[ex("name")]).select("subject", "object", "graph")


# --- order and pages


@query(f"SELECT {CUSTOMER} || c_custkey AS id, c_name AS name, c_acctbal AS acctbal FROM customer ORDER BY acctbal DESC, id LIMIT 20")
def kg_orderby(spark, sf):
    """A sorted page, ties by id."""
    return s.page(flat(spark, sf, s.Node(ex("Customer"), (f("name"), f("acctbal", "double"))), "customer"), ["-acctbal"], size=20)


@query(f"SELECT {ORDER} || o_orderkey AS id, o_orderpriority AS priority, o_totalprice AS totalprice FROM {LIVE} ORDER BY priority, totalprice DESC, id LIMIT 100")
def kg_orderby_desc_multi(spark, sf):
    """Two keys, and a page of the usual size."""
    return s.page(flat(spark, sf, s.Node(ex("Order"), (f("priority"), f("totalprice", "double"))), "orders"), ["priority", "-totalprice"])


@query(f"SELECT {ORDER} || o_orderkey AS id, o_totalprice AS totalprice FROM {LIVE} ORDER BY totalprice, id OFFSET 30 LIMIT 10")
def kg_page_offset(spark, sf):
    """The page behind a cursor."""
    return s.page(flat(spark, sf, s.Node(ex("Order"), (f("totalprice", "double"),)), "orders"), ["totalprice"], size=10, cursor=cursors.encode(30))


@query(f"SELECT id, order_id, totalprice FROM (SELECT {CUSTOMER} || o_custkey AS id, {ORDER} || o_orderkey AS order_id, o_totalprice AS totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, {ORDER} || o_orderkey) AS n FROM {LIVE} JOIN customer ON c_custkey = o_custkey) WHERE n <= 3")
def kg_nested_topk(spark, sf):
    """W-a, O2: the three greatest of each parent's entities."""
    below = s.Node(ex("Order"), (f("totalprice", "double"),))
    node = s.Node(ex("Customer"), (s.Field("orders", ex("customer"), reverse=True, node=below),))
    out = s.nested(now(spark, sf, "orders", "customer", node=node), node, ["-totalprice"], size=3)
    return out.select("id", F.explode("orders").alias("o")).select("id", F.col("o.id").alias("order_id"), F.col("o.totalprice").alias("totalprice"))


@query(f"SELECT {CUSTOMER} || o_custkey AS id, count(*) AS total FROM {LIVE} JOIN customer ON c_custkey = o_custkey GROUP BY o_custkey")
def kg_total_count(spark, sf):
    """A8, O6, W-d: how many entities a field leads to, before paging."""
    node = s.Node(ex("Customer"), (s.Field("orders", ex("customer"), reverse=True, node=s.Node(ex("Order"))),))
    return s.flat(now(spark, sf, "orders", "customer", node=node), node).groupBy("id").agg(F.count("*").alias("total"))


@query(f"SELECT {CUSTOMER} || o_custkey AS id, string_agg(o_orderstatus, ',' ORDER BY o_orderstatus DESC) AS statuses FROM {LIVE} GROUP BY o_custkey")
def kg_scalar_list_sort(spark, sf):
    """A field's values as a sorted list."""
    rows = s.flat(now(spark, sf, "orders"), s.Node(ex("Order"), (f("status"), f("customer", many=True)))).select("status", F.explode("customer").alias("id"))
    return rows.groupBy("id").agg(F.array_join(F.sort_array(F.collect_list("status"), asc=False), ",").alias("statuses"))


# --- views, changes, versions, access


def _view() -> s.Node:
    return s.Node(ex("Order"), (f("status", test=c.eq("F")), f("totalprice", "double"), f("priority")), must=(ex("status"),))


@query(f"SELECT {ORDER} || o_orderkey AS id, o_totalprice AS totalprice FROM {LIVE} WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def kg_slice_filter(spark, sf):
    """A view's filter and a query's; the view's holds though its field isn't asked for."""
    node = _view().also(s.Node(ex("Order"), (f("totalprice", "double", test=c.gt(100000.0)),)))
    return flat(spark, sf, node, "orders")


@query(f"""
    SELECT {ORDER} || o_orderkey AS id, o_totalprice AS totalprice, c_name AS customer_name FROM {LIVE} JOIN customer ON c_custkey = o_custkey
    WHERE o_orderstatus = 'F' AND o_orderkey = 3 AND c_mktsegment <> 'BUILDING'
    UNION ALL SELECT 'refused ' || what, NULL, NULL FROM (VALUES ('field'), ('nested field'), ('class'), ('link')) v(what)
""")
def kg_slice_isolation(spark, sf):
    """A query on a view sees the view's entities, fields and tests at every level, under the view's names; whatever
    the view doesn't show is refused."""
    buyer = s.Node(ex("Customer"), (f("name"), f("mktsegment", test=c.ne("BUILDING"))), must=(ex("mktsegment"),))
    view = s.Node(ex("Order"), (f("status", test=c.eq("F")), f("totalprice", "double"), f("customer", node=buyer)), ids=tuple(ex(f"order/{k}") for k in (1, 2, 3)), must=(ex("status"),))
    asked = lambda *fields, **more: s.Node(ex("Order"), fields, **more)
    # another predicate under a known name stays the view's; ids of the query and of the view both hold
    own = view.also(asked(s.Field("totalprice", ex("secret")), s.Field("customer", ex("customer"), node=s.Node(None, (f("name"),))), ids=(ex("order/3"), ex("order/4"))))
    refused = []
    for what, q in (("field", asked(f("priority"))), ("nested field", asked(f("customer", node=s.Node(None, (f("acctbal"),))))), ("class", s.Node(ex("Customer"), (f("totalprice"),))), ("link", asked(f("status", node=s.Node(None, ()))))):
        try:
            view.also(q)
        except ValueError:
            refused.append((f"refused {what}", None, None))
    out = flat(spark, sf, own, "orders", "customer").select("id", "totalprice", "customer_name")
    return out.unionByName(spark.createDataFrame(refused, out.schema))


@query(f"SELECT {CUSTOMER} || c_custkey AS id, c_name AS name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM {LIVE} WHERE o_orderstatus = 'P')")
def kg_slice_must_exist(spark, sf):
    """Membership by something that isn't shown."""
    rows = now(spark, sf, "orders", "customer")
    members = rows.where(F.col("predicate") == ex("customer")).join(s.entities(rows, s.Node(ex("Order"), (f("status", test=c.eq("P")),))).select(F.col("id").alias("_o")), F.col("subject") == F.col("_o"), "left_semi").select(F.col("object").alias("_c"))
    out = s.entities(rows, s.Node(ex("Customer"), (f("name"),)))
    return out.join(members, out.id == members["_c"], "left_semi")


@query(f"SELECT {CUSTOMER} || c_custkey AS id, c_mktsegment AS mktsegment FROM customer WHERE c_acctbal >= 0")
def kg_slice_nonnull(spark, sf):
    """A non-null field of a view that has no value keeps the entity out."""
    owed = F.coalesce(c.read(F.col("object"), "double") < 0, F.lit(False))  # as a number: -0.0 is no debt
    rows = now(spark, sf, "customer").where((F.col("predicate") != ex("acctbal")) | ~owed)
    return s.entities(rows, s.Node(ex("Customer"), (f("mktsegment"),), must=(ex("acctbal"),)))


@query(f"SELECT {CUSTOMER} || c_custkey AS subject, CASE WHEN c_acctbal < 0 THEN 'WATCH' ELSE c_mktsegment END AS object FROM customer")
def kg_with_update(spark, sf):
    """Quads built from a query's rows replace others; deletions and insertions are one change."""
    rows = log(spark, sf, "customer")
    found = s.entities(now(spark, sf, "customer"), s.Node(ex("Customer"), (f("mktsegment"), f("acctbal", "double", test=c.lt(0.0)))))
    cell = lambda v: changes.template(found, F.col("id"), (ex("mktsegment"), v, XSD + "string"))
    status, records, _ = changes.process(changes.Change("b1", "2001-01-01", cell(F.lit("WATCH")), cell(F.col("mktsegment")), [("nonempty", found)]))
    return st.state(rows.unionByName(records), predicates=[ex("mktsegment")], records=3 * held(spark, sf, "customer", predicates=[ex("mktsegment")])).select("subject", "object")


@query(f"SELECT {ORDER} || o_orderkey AS subject FROM {LIVE} WHERE o_orderstatus <> 'P'")
def kg_delete_wildcard(spark, sf):
    """All quads of what a query found are deleted."""
    rows, current = log(spark, sf, "orders"), now(spark, sf, "orders")
    found = s.entities(current, s.Node(ex("Order"), (f("status", test=c.eq("P")),)))
    records = changes.records_of(changes.Change("k1", "2001-01-01", deletes=changes.everything_of(current, found)))
    return st.state(rows.unionByName(records), by=("subject",), records=2 * held(spark, sf, "orders")).select("subject").distinct()


@query("SELECT * FROM (VALUES ('empty', 'ASSERTION_FAILED'), ('nonempty', 'COMMITTED'), ('none', 'VALIDATION_ERROR')) v(asserted, status)")
def kg_assert_gate(spark, sf):
    """Assertions decide whether a change is written."""
    rows = log(spark, sf, "nation")
    found = s.entities(st.state(rows), s.Node(ex("Nation"), (f("name"),)))
    add = changes.template(found, F.col("id"), (ex("seen"), F.lit("true"), XSD + "boolean"))
    got = [(kind, changes.process(changes.Change("b1", "2001-01-01", add, assertions=[(kind, found)]))[0]) for kind in ("empty", "nonempty")]
    got.append(("none", changes.process(changes.Change("b2", "2001-01-01"))[0]))
    return spark.createDataFrame(got, "asserted string, status string")


@query(f"""
    SELECT {CUSTOMER} || c_custkey AS subject, '{BASE}name' AS predicate, 'min length' AS rule FROM customer WHERE length(c_name) < 18 UNION ALL
    SELECT {CUSTOMER} || c_custkey, '{BASE}mktsegment', 'in' FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'FURNITURE') UNION ALL
    SELECT {CUSTOMER} || c_custkey, '{BASE}acctbal', 'datatype' FROM customer UNION ALL
    SELECT {CUSTOMER} || c_custkey, '{BASE}phone', 'min count' FROM customer UNION ALL
    SELECT {CUSTOMER} || c_custkey, '{BASE}nation', 'unknown property' FROM customer
""")
def kg_validate_violations(spark, sf):
    """The shape rules, A14, U6, U7: where inserted quads break their class's shape."""
    shape = changes.Shape(
        ex("Customer"),
        (
            changes.Constraint(ex("name"), required=True, single=True, datatypes=changes.ACCEPTED["String"], tests=(("min length", lambda v: F.length(v) >= 18), ("pattern", c.matching("^customer", "i")))),
            changes.Constraint(ex("mktsegment"), tests=(("in", c.within("BUILDING", "MACHINERY", "FURNITURE")),)),
            changes.Constraint(ex("acctbal"), datatypes=changes.ACCEPTED["Int"]),
            changes.Constraint(ex("phone"), min_count=1),
        ),
    )
    return changes.violations(log(spark, sf, "customer"), [shape], held(spark, sf, "customer")).select("subject", "predicate", "rule")


@query("SELECT user_id, count(*) AS n, CASE WHEN user_id % 3 = 0 OR user_id % 5 = 0 THEN 'stateful' WHEN user_id % 2 = 0 THEN 'ref' ELSE 'plain' END AS queue FROM events GROUP BY user_id")
def kg_route(spark, sf):
    """The queue of each request."""
    user = F.col("user_id")
    rows = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return rows.select("user_id", "n", changes.route(user % 3 == 0, user % 5 == 0, user % 2 == 0).alias("queue"))


@query(f"SELECT {ORDER} || o_orderkey AS subject FROM orders WHERE o_orderkey % 10 <> 0 AND o_orderdate >= TIMESTAMP '1995-01-01'")
def kg_visible_changes(spark, sf):
    """Only committed changes are seen; one is rolled back."""
    rows = log(spark, sf, "orders", columns=())
    done = rows.select(F.col("change_id").alias("id")).distinct().withColumn("status", F.when(F.col("id") < "i199501", "INTERNAL_ERROR").otherwise("COMMITTED"))
    return st.state(changes.rolled_back(changes.visible(rows, done), "j2"), predicates=[RDF_TYPE], records=held(spark, sf, "orders", predicates=[RDF_TYPE])).select("subject")


@query(f"SELECT {NATION} || n_nationkey AS subject, CASE WHEN n_nationkey % 2 = 0 THEN upper(n_name) || '!' ELSE n_name END AS object FROM nation")
def kg_patch_set(spark, sf):
    """U4, Q5: a document without some quads and with others."""
    model = now(spark, sf, "nation").where(F.col("predicate") == ex("name")).drop("change_id")
    even = model.where(number("subject") % 2 == 0)
    new = even.withColumn("object", F.concat(F.upper("object"), F.lit("!")))
    return documents.patched(model, even, new.union(new)).select("subject", "object")


@query("SELECT DISTINCT path FROM (SELECT '/' AS path UNION ALL SELECT '/' || p_brand || '/' FROM part UNION ALL SELECT '/' || p_brand || '/' || p_size || '/' FROM part WHERE p_size <= 25) WHERE path <> '/'")
def kg_missing_containers(spark, sf):
    """Q6: the containers that new documents need."""
    part = table(spark, sf, "part")
    new = part.select(F.concat(F.lit("/"), "p_brand", F.lit("/"), "p_size", F.lit("/"), "p_partkey").alias("path"))
    there = part.where("p_size > 25").select(F.concat(F.lit("/"), "p_brand", F.lit("/"), "p_size", F.lit("/")).alias("path")).union(spark.createDataFrame([("/",)], "path string"))
    return documents.missing_containers(new, there)


def _revisions(spark, sf):
    rows = table(spark, sf, "orders")
    return rows.select(F.col("o_custkey").alias("id"), F.when(F.col("o_orderkey") % 4 == 0, "draft").otherwise("main").alias("branch"), F.col("o_orderkey").alias("revision_id"))


def _tags(spark, sf):
    rows = table(spark, sf, "orders").where("o_orderkey % 4 <> 0 and o_orderkey % 3 = 0")
    return rows.select(F.col("o_custkey").alias("id"), F.when(F.col("o_custkey") % 2 == 0, "default").otherwise("stable").alias("tag_name"), F.col("o_orderkey").alias("revision_id"), F.col("o_orderdate").alias("created_at"))


REVISIONS = "r AS (SELECT o_custkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'draft' ELSE 'main' END AS branch, o_orderkey AS revision_id FROM orders)"
TAGS = "t AS (SELECT o_custkey AS id, CASE WHEN o_custkey % 2 = 0 THEN 'default' ELSE 'stable' END AS tag_name, o_orderkey AS revision_id, o_orderdate AS created_at FROM orders WHERE o_orderkey % 4 <> 0 AND o_orderkey % 3 = 0), h AS (SELECT id, tag_name, arg_max(revision_id, (created_at, revision_id)) AS revision_id FROM t GROUP BY 1, 2)"


@query(f"WITH {REVISIONS} SELECT id, branch, max(revision_id) AS revision_id FROM r GROUP BY 1, 2")
def kg_revision_latest(spark, sf):
    """The newest revision of each entity and branch."""
    return revisions.latest(_revisions(spark, sf)).select("id", "branch", "revision_id")


@query(f"WITH {REVISIONS}, {TAGS} SELECT coalesce(m.id, d.id) AS id, coalesce(d.revision_id, m.revision_id) AS revision_id FROM (SELECT id, max(revision_id) AS revision_id FROM r WHERE branch = 'main' GROUP BY 1) m FULL JOIN (SELECT * FROM h WHERE tag_name = 'default') d ON m.id = d.id")
def kg_tag_resolve(spark, sf):
    """What the default tag serves, else the newest on main."""
    return revisions.resolved(_revisions(spark, sf), _tags(spark, sf))


@query(f"""
    WITH {REVISIONS}, {TAGS}, n AS (SELECT r.*, h.tag_name, row_number() OVER (PARTITION BY r.id, branch ORDER BY r.revision_id) AS k FROM r LEFT JOIN h ON h.id = r.id AND h.revision_id = r.revision_id),
    g AS (SELECT *, max(CASE WHEN tag_name IS NOT NULL THEN k END) OVER (PARTITION BY id, branch ORDER BY k) AS at FROM n)
    SELECT g.id, g.branch, g.revision_id, x.tag_name, CAST(g.k - coalesce(g.at, 0) AS BIGINT) AS ahead FROM g LEFT JOIN n x ON x.id = g.id AND x.branch = g.branch AND x.k = g.at
""")
def kg_lineage_ahead(spark, sf):
    """J11, L8, W-c: how far each revision is ahead of the nearest tagged one."""
    return revisions.ahead(_revisions(spark, sf), _tags(spark, sf))


@query("""
    WITH asked AS (SELECT p_partkey AS k, p_brand AS b, p_size AS z FROM part),
    v AS (SELECT k, CASE WHEN k % 11 = 0 THEN 3 WHEN b < 'Brand#3' THEN 1 WHEN z % 2 = 0 THEN 0 END AS g, CASE WHEN k % 13 = 0 THEN 3 WHEN z > 40 THEN 2 END AS bl FROM asked)
    SELECT k AS partkey, coalesce(g > coalesce(bl, -1), false) AS allowed FROM v
""")
def kg_acl_can_read(spark, sf):
    """Grants and blocks on paths and above; the nearest counts."""
    part = table(spark, sf, "part")
    path = F.concat(F.lit("/"), "p_brand", F.lit("/"), "p_size", F.lit("/"), "p_partkey")
    who = F.when(F.col("p_size") % 2 == 0, "mailto:even@example.org").otherwise("urn:odd")
    asked = part.select(F.col("p_partkey").alias("partkey"), access.subject(F.when(F.col("p_size") % 2 == 0, "even@example.org").otherwise("odd")).alias("subject"), path.alias("path"))
    none = F.lit(None).cast("array<string>")
    both = F.explode(F.array(F.lit("mailto:even@example.org"), F.lit("urn:odd")))
    one = lambda rows, who, relation, p, types=none: rows.select(who.alias("subject"), F.lit(relation).alias("relation"), p.alias("path"), types.alias("access_types")).distinct()
    brand = F.concat(F.lit("/"), "p_brand")
    tuples = [
        one(part.where("p_partkey % 11 = 0"), who, "external_access", path, F.array(F.lit("read"))),
        one(part.where("p_partkey % 11 = 1"), who, "external_access", path, F.array(F.lit("write"))),
        one(part.where("p_brand < 'Brand#3'"), both, "reader", brand),
        one(part.limit(1), F.lit("mailto:even@example.org"), "owner", F.lit("/")),
        one(part.where("p_partkey % 13 = 0"), who, "blocked", path),
        one(part.where("p_size > 40"), both, "blocked", F.concat(brand, F.lit("/"), "p_size")),
    ]
    return access.check(asked, reduce(DataFrame.union, tuples)).select("partkey", "allowed")


# --- RDF text


@query(f"SELECT {CUSTOMER} || c_custkey AS subject, '{BASE}name' AS predicate, c_name AS object, '{XSD}string' AS datatype FROM customer UNION ALL SELECT {CUSTOMER} || c_custkey, '{BASE}nation', {NATION} || c_nationkey, '' FROM customer")
def kg_ntriples_roundtrip(spark, sf):
    """Quads to lines and back."""
    rows = quads(table(spark, sf, "customer"), TABLES["customer"], ("c_name", "c_nationkey")).where(F.col("predicate") != RDF_TYPE)
    return rdf.statements(rdf.to_ntriples(rows)).select("subject", "predicate", "object", "datatype")


@query(f"SELECT {NATION} || n_nationkey AS subject, chr(233) || n_name || chr(128512) || chr(10) || chr(39) || chr(92) || 'u00e9' AS object FROM nation")
def kg_ntriples_escapes(spark, sf):
    """Escapes of code points, control characters, quotes and of the escape itself."""
    lines = table(spark, sf, "nation").select(F.concat(F.lit(f"<{ex('nation/')}"), "n_nationkey", F.lit(f'> <{ex("name")}> "\\u00e9'), "n_name", F.lit("\\U0001F600\\n\\'\\\\u00e9\" .")).alias("value"))
    return rdf.statements(lines).select("subject", "object")


@query(f"""
    WITH n AS (SELECT {NATION} || n_nationkey AS s, n_name, n_nationkey AS k FROM nation)
    SELECT s AS subject, '{RDF_TYPE}' AS predicate, '{BASE}Nation' AS object, '' AS datatype, '' AS language FROM n
    UNION ALL SELECT s, '{RDF_TYPE}', '{BASE}Place', '', '' FROM n
    UNION ALL SELECT s, '{BASE}name', n_name, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#langString', 'en' FROM n
    UNION ALL SELECT s, '{BASE}name', '007', '{XSD}string', '' FROM n
    UNION ALL SELECT s, '{BASE}code', CAST(k AS VARCHAR), '{XSD}integer', '' FROM n
    UNION ALL SELECT s, '{BASE}code', '2020-01-01', '{XSD}date', '' FROM n
    UNION ALL SELECT s, '{BASE}code', '1.5', '{XSD}double', '' FROM n
    UNION ALL SELECT s, '{BASE}region', s || '/part', '', '' FROM n
    UNION ALL SELECT s || '/part', '{RDF_TYPE}', '{BASE}Place', '', '' FROM n
    UNION ALL SELECT s || '/part', '{BASE}name', 'part', '{XSD}string', '' FROM n
""")
def kg_jsonld_values(spark, sf):
    """S3: several types, values with a datatype or a language, numbers apart from strings of digits, and a nested object."""
    key = F.concat(F.lit(ex("nation/")), F.col("n_nationkey"))
    doc = F.concat(
        F.lit('{"@id": "'), key, F.lit('", "@type": ["Nation", "Place"], "name": [{"@value": "'), F.col("n_name"), F.lit('", "@language": "en"}, "007"], "code": ['), F.col("n_nationkey"),
        F.lit(f', {{"@value": "2020-01-01", "@type": "{XSD}date"}}, 1.5, null], "region": {{"@id": "'), key, F.lit('/part", "@type": "Place", "name": "part"}}'),
    )
    rows = table(spark, sf, "nation").select(doc.alias("json"))
    out = rdf.json_documents(rows, {k: ex(k) for k in ("name", "code", "region")}, BASE, {"Nation": ex("Nation"), "Place": ex("Place")})
    return out.select("subject", "predicate", "object", "datatype", "language")


@query(f"SELECT '{BASE}event/' || event_id AS subject, event_type AS object FROM events")
def kg_json_documents(spark, sf):
    """S3: JSON objects with ids, types and values."""
    rows = table(spark, sf, "events").select(F.to_json(F.struct(F.concat(F.lit(ex("event/")), F.col("event_id")).alias("@id"), F.lit("Event").alias("@type"), F.array("event_type").alias("kind"), F.struct(F.concat(F.lit(ex("user/")), F.col("user_id")).alias("@id")).alias("by"))).alias("json"))
    out = rdf.json_documents(rows, {"kind": ex("kind"), "by": ex("by")}, BASE, {"Event": ex("Event")})
    return out.where(F.col("predicate") == ex("kind")).select("subject", "object")


@query("SELECT 'ex_customer/' || c_custkey AS short FROM customer")
def kg_compact_iri(spark, sf):
    """IRI functions: prefixed names."""
    return quads(table(spark, sf, "customer"), TABLES["customer"], ()).select(c.compact(F.col("subject"), {"ex": BASE}).alias("short"))


# --- streams


@query("SELECT 'i' || strftime(o_orderdate, '%Y%m') AS change_id, count(*) AS inserts, CAST(0 AS BIGINT) AS deletes FROM orders GROUP BY 1 UNION ALL SELECT 'j1', 0, count(*) FROM orders WHERE o_orderkey % 10 = 0 UNION ALL SELECT 'j2', count(*), 0 FROM orders WHERE o_orderkey % 20 = 0")
def kg_stream_change_feed(spark, sf):
    """The feed of a log's changes, read as a stream."""
    path, sink = new_path(spark, "log"), new_path(spark, "feed")
    log(spark, sf, "orders", columns=()).repartition("change_id").write.parquet(path)
    feeds.run(feeds.log_stream(spark, path), feeds.persisted(sink), new_path(spark, "checkpoint"), once=True).awaitTermination()
    return spark.read.parquet(sink).groupBy("change_id").agg(F.sum("inserts").alias("inserts"), F.sum("deletes").alias("deletes"))


@query(f"SELECT {ORDER} || o_orderkey AS id, o_orderstatus AS status FROM {LIVE}")
def kg_subscription_insert(spark, sf):
    """A query run again for the subjects of inserted instances."""
    path, sink = new_path(spark, "log"), new_path(spark, "subscription")
    log(spark, sf, "orders", columns=("o_orderstatus",)).write.parquet(path)
    node = s.Node(ex("Order"), (f("status"),))
    each = feeds.subscription(lambda: spark.read.parquet(path), lambda rows: s.entities(rows, node), sink, feeds.trigger_sign(None, "orderAdded"), ex("Order"))
    feeds.run(feeds.log_stream(spark, path), each, new_path(spark, "checkpoint"), once=True).awaitTermination()
    return spark.read.parquet(sink).select("id", "status").distinct()


def entry(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with their customers, nations and regions."""
    return kg_forward_3hop(spark, sf)

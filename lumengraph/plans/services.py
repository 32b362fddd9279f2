"""Registered queries of what stands around the log: documents, audit, access, batches of requests, results."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumengraph.functions import columns as c
from lumengraph.functions import cursors
from lumengraph.operators import access, changes, documents, events, revisions
from lumengraph.operators import select as s
from lumengraph.operators import state as st
from lumengraph.plans.catalog import CUSTOMER, LIVE, NATION, ORDER, REVISIONS, _revisions, ex, f, flat, log, now, query, table
from lumengraph.sources.mapping import BASE, TABLES, iri, logged, quads

# --- documents and tenants


@query("""
    WITH p AS (SELECT 'http://example.org/document/' || p_partkey AS s, 1600000000 + p_partkey AS t, p_size AS n, p_name AS name, p_partkey AS k FROM part)
    SELECT s AS subject, 'http://www.w3.org/ns/posix/stat#mtime' AS predicate, CAST(t AS VARCHAR) AS object FROM p
    UNION ALL SELECT s, 'http://purl.org/dc/terms/modified', strftime(make_timestamp(CAST(t AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%SZ') FROM p
    UNION ALL SELECT s, 'http://www.w3.org/ns/posix/stat#size', CAST(n AS VARCHAR) FROM p
    UNION ALL SELECT s, 'http://example.org/title', name FROM p WHERE k % 2 = 0
""")
def kg_document_metadata(spark, sf):
    """Q7: what is stored about a document, with its file's time and length."""
    part = table(spark, sf, "part")
    path = F.concat(F.lit(ex("document/")), F.col("p_partkey"))
    files = part.select(path.alias("path"), F.col("p_size").cast("long").alias("length"), F.timestamp_seconds(F.lit(1600000000) + F.col("p_partkey")).alias("modified"))
    about = lambda rows, subject, predicate, value: rows.select(subject.alias("subject"), F.lit(predicate).alias("predicate"), value.cast("string").alias("object"), *(F.lit("").alias(x) for x in ("datatype", "language", "graph")))
    stored = about(part.where("p_partkey % 2 = 0"), path, ex("title"), F.col("p_name")).union(about(part, path, documents.SIZE, F.lit(-1))).union(about(part, F.concat(path, F.lit(".gone")), ex("title"), F.col("p_name")))
    return documents.metadata(files, stored).select("subject", "predicate", "object")


@query("SELECT n_nationkey AS id, CASE WHEN n_nationkey < 10 THEN upper(n_name) || '!' ELSE n_name END AS name FROM nation")
def kg_bootstrap(spark, sf):
    """Q8: what is wanted is made where it isn't yet, once."""
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    there = nation.where("id < 10").withColumn("name", F.concat(F.upper("name"), F.lit("!")))
    return documents.bootstrapped(nation.union(nation), documents.bootstrapped(nation, there))


@query(f"SELECT {NATION} || n_nationkey AS subject, CASE WHEN n_regionkey = 1 THEN lower(n_name) ELSE n_name END AS object, '{BASE}doc/' || n_regionkey AS graph FROM nation")
def kg_document_replace(spark, sf):
    """Q2, Q3, Q4: a document as a named graph, put in place of what it held."""
    rows = quads(table(spark, sf, "nation"), TABLES["nation"], ("n_name",), extra={"region": F.col("n_regionkey")})
    rows = rows.where(F.col("predicate") == ex("name")).withColumn("graph", F.concat(F.lit(ex("doc/")), F.col("region"))).drop("region")
    new = documents.document(rows, ex("doc/1")).withColumn("object", F.lower("object"))
    return documents.replaced(rows, ex("doc/1"), new.union(new)).select("subject", "object", "graph")


@query(f"WITH {REVISIONS} SELECT c_custkey AS id, 1000000000 + c_custkey AS revision_id, m.revision_id AS parent_revision_id FROM customer LEFT JOIN (SELECT id, max(revision_id) AS revision_id FROM r WHERE branch = 'main' GROUP BY 1) m ON m.id = c_custkey")
def kg_revision_append(spark, sf):
    """A new revision of each entity, on top of the newest of its branch."""
    new = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.lit("main").alias("branch"), (F.lit(1000000000) + F.col("c_custkey")).alias("revision_id"))
    return revisions.revised(_revisions(spark, sf), new).where("revision_id >= 1000000000").select("id", "revision_id", "parent_revision_id")


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def kg_revision_conflicts(spark, sf):
    """Q1: names that are taken."""
    return revisions.conflicts(_revisions(spark, sf), table(spark, sf, "customer").select(F.col("c_custkey").alias("id")))


# --- audit and access


@query("""
    SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 3 = 0 THEN '1990-01-01' WHEN o_orderkey % 5 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS seen,
           CASE WHEN o_orderkey % 5 = 0 THEN 'c1' END AS at_change_id, CASE WHEN o_orderkey % 4 = 0 THEN 'FAILED' ELSE 'COMPLETED' END AS status_code, CASE WHEN o_orderkey % 4 = 0 THEN 'no such field' END AS message FROM orders
""")
def kg_query_audit(spark, sf):
    """An event for each query, with the first of its errors and the time that it saw."""
    key = F.col("o_orderkey")
    none = F.lit(None).cast("string")
    asked = table(spark, sf, "orders").select(
        key.cast("string").alias("id"),
        F.col("o_orderdate").cast("timestamp").alias("timestamp"),
        F.col("o_custkey").cast("string").alias("requesting_user"),
        F.col("o_orderstatus").alias("pod_id"),
        none.alias("slice_id"),
        none.alias("slice_tag"),
        F.lit("{ id }").alias("query"),
        F.when(key % 3 == 0, F.lit("1990-01-01").cast("timestamp")).alias("at_timestamp"),
        F.when(key % 5 == 0, "c1").alias("at_change_id"),
        F.when(key % 4 == 0, F.array(F.lit("no such field"), F.lit("another"))).when(key % 4 == 1, F.array().cast("array<string>")).alias("errors"),
    )
    return events.query_events(asked).select("id", F.date_format("at_timestamp", "yyyy-MM-dd").alias("seen"), "at_change_id", "status_code", "message")


@query("""
    SELECT c_custkey AS id, 'SLICE_' || CASE WHEN c_custkey % 5 = 0 THEN 'CREATED' WHEN c_custkey % 7 = 0 THEN 'DELETED' ELSE 'UPDATED' END AS event_type FROM customer
    WHERE (c_custkey % 5 = 0) <> (c_custkey % 7 = 0) OR (c_custkey % 5 <> 0 AND c_custkey % 7 <> 0 AND c_custkey % 3 = 0)
""")
def kg_lifecycle_events(spark, sf):
    """What was created, updated and deleted between two states."""
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("json"))
    after = rows.where("id % 7 <> 0").withColumn("json", F.when(F.col("id") % 3 == 0, F.upper("json")).otherwise(F.col("json")))
    return events.lifecycle_events(rows.where("id % 5 <> 0"), after, "slice")


@query("""
    SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'write' ELSE 'read' END AS access, o_orderkey % 2 = 0 OR o_orderkey % 3 = 0 AS allowed FROM orders
""")
def kg_access_decision(spark, sf):
    """The access that an operation needs, and an external verdict where no grant decides."""
    key = F.col("o_orderkey")
    kind = F.when(F.col("o_orderstatus") == "F", "mutation").when(F.col("o_orderstatus") == "O", "query").otherwise("subscription")
    external = F.when(key % 3 == 0, F.lit(True)).when(key % 3 == 1, F.lit(False))
    return table(spark, sf, "orders").select(key.alias("id"), access.needed_access(kind).alias("access"), access.decision(key % 2 == 0, external).alias("allowed"))


# --- requests


@query("SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 4 = 0 THEN 'c' || o_orderkey END AS change_id, CASE WHEN o_orderkey % 8 = 0 THEN 'COMMITTED' WHEN o_orderkey % 4 = 0 THEN 'VALIDATION_ERROR' ELSE 'QUEUED' END AS status FROM orders")
def kg_pending(spark, sf):
    """Requests with their changes, or as queued."""
    asked = table(spark, sf, "orders").select(F.col("o_orderkey").alias("request_id"))
    done = asked.where("request_id % 4 = 0").select(F.concat(F.lit("c"), F.col("request_id")).alias("id"), "request_id", F.when(F.col("request_id") % 8 == 0, "COMMITTED").otherwise("VALIDATION_ERROR").alias("status"))
    return changes.pending(asked, done)


@query(f"""
    WITH n AS (SELECT n_nationkey AS k, n_regionkey AS r, count(c_custkey) AS n, min(CASE WHEN c_custkey IN (7, 11) THEN 'outside: ' || {CUSTOMER} || c_custkey || ' {BASE}name' END) AS bad FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2)
    SELECT lpad(CAST(k AS VARCHAR), 3, '0') AS request_id, 'pod' || r AS pod_id, CAST(row_number() OVER (PARTITION BY r ORDER BY k) AS INT) AS place, CASE WHEN bad IS NULL AND n > 0 THEN 'COMMITTED' ELSE 'VALIDATION_ERROR' END AS status,
           coalesce(bad, CASE WHEN n = 0 THEN 'a change inserts or deletes something' END) AS message, CASE WHEN bad IS NULL THEN 3 * n ELSE 0 END AS inserts, CAST(0 AS BIGINT) AS deletes FROM n
""")
def kg_change_reports(spark, sf):
    """Requests of several pods, each judged by itself, in the order of its pod."""
    mapped = quads(table(spark, sf, "customer"), TABLES["customer"], ("c_name", "c_mktsegment"), extra={"nation": F.col("c_nationkey")})
    records = logged(mapped, F.concat(F.lit("c"), F.col("nation")), F.lit("2001-01-01"))
    asked = table(spark, sf, "nation").select(F.lpad(F.col("n_nationkey").cast("string"), 3, "0").alias("request_id"), F.concat(F.lit("pod"), F.col("n_regionkey")).alias("pod_id"), F.concat(F.lit("c"), F.col("n_nationkey")).alias("change_id"))
    tests = (("outside", c.outside("Customer#000000007", "Customer#000000011")),)
    shape = changes.Shape(ex("Customer"), (changes.Constraint(ex("name"), required=True, tests=tests), changes.Constraint(ex("mktsegment"))))
    return changes.reports(asked, records, [shape])[0].drop("change_id")


@query(f"""
    SELECT {ORDER} || o_orderkey AS subject, '{BASE}customer' AS predicate, 'class' AS rule FROM orders WHERE o_custkey % 3 = 0
    UNION ALL SELECT {ORDER} || o_orderkey, '{BASE}status', 'no alternative' FROM orders WHERE o_orderstatus = 'P'
    UNION ALL SELECT {ORDER} || o_orderkey, '@id', 'pattern' FROM orders WHERE o_orderkey % 10 = 9
""")
def kg_shape_nested(spark, sf):
    """Shapes: links that lead to instances of a class, several rules for a property, and tests of the subject."""
    asked = table(spark, sf, "orders")
    orders = quads(asked, TABLES["orders"], ("o_orderstatus", "o_custkey"))
    buyers = quads(table(spark, sf, "customer").where("c_custkey % 3 <> 0"), TABLES["customer"], ("c_name",))
    records = logged(orders.unionByName(buyers), F.lit("b1"), F.lit("2001-01-01"))
    status = lambda x: changes.Constraint(ex("status"), required=True, tests=(("in", c.within(x)),))
    order = changes.Shape(ex("Order"), (changes.Constraint(ex("customer"), single=True, cls=ex("Customer")), status("F"), status("O")), (("pattern", c.matching("/order/[0-9]*[0-8]$")),))
    buyer = changes.Shape(ex("Customer"), (changes.Constraint(ex("name"), required=True),))
    count = 3 * asked.count() + 2 * table(spark, sf, "customer").count()
    return changes.violations(records, [order, buyer], count).select("subject", "predicate", "rule")


# --- results and scalars


@query(f"""
    WITH o AS (SELECT {ORDER} || o_orderkey AS id, o_orderpriority AS priority FROM {LIVE} WHERE o_orderstatus = 'P'), p AS (SELECT * FROM o ORDER BY priority, id LIMIT 5 OFFSET 5)
    SELECT '{{"orders":[' || (SELECT string_agg('{{"id":"' || id || '","priority":"' || priority || '"}}', ',' ORDER BY priority, id) FROM p) || ']}}' AS data, '[{{"message":"a field was left out"}}]' AS errors,
           '{{"pagination":{{"orders":{{"totalCount":' || (SELECT count(*) FROM o) || ',"next":"{cursors.encode(10)}"}}}}}}' AS extensions
""")
def kg_result_envelope(spark, sf):
    """A page as data, errors and page information."""
    node = s.Node(ex("Order"), (f("status", test=c.eq("P")), f("priority")), hidden=("status",))
    return s.envelope(flat(spark, sf, node, "orders"), "orders", ["priority"], 5, cursors.encode(5), ["a field was left out"])


@query(f"SELECT {CUSTOMER} || c_custkey AS id, c_name AS name FROM customer WHERE c_custkey IN (1, 2, 3)")
def kg_entity_ids(spark, sf):
    """Entities by their ids."""
    return flat(spark, sf, s.Node(ex("Customer"), (f("name"),), ids=tuple(ex(f"customer/{k}") for k in (1, 2, 3))), "customer")


@query(f"SELECT predicate, count(*) AS n FROM nation, LATERAL (VALUES ('{BASE}name'), ('{BASE}region'), ('http://www.w3.org/1999/02/22-rdf-syntax-ns#type')) v(predicate) GROUP BY 1")
def kg_deduplicated(spark, sf):
    """A3: records written twice count once."""
    rows = log(spark, sf, "nation")
    return st.deduplicated(rows.unionByName(rows)).groupBy("predicate").agg(F.count("*").alias("n"))


@query(f"SELECT {NATION} || n_nationkey AS id, 'Nation' AS type_name, 3 AS n FROM nation UNION ALL SELECT '{BASE}region/' || r_regionkey, 'UntypedResource', 1 FROM region")
def kg_types_and_predicates(spark, sf):
    """A15, A16, unique names: what each subject is and has, typed or not."""
    rows = now(spark, sf, "nation", "region").where((F.col("object") != ex("Region")))
    kinds, has = s.types_of(rows), s.predicates_of(rows)
    name = F.regexp_replace(s.type_name(F.col("types")), "^.*/", "")
    return has.join(kinds, "id", "left").select("id", name.alias("type_name"), F.size("predicates").alias("n"))


@query("SELECT DISTINCT 'http://example.org/#' || sha256(c_mktsegment || chr(31) || 'b' || c_nationkey) AS id FROM customer")
def kg_skolem(spark, sf):
    """A blank node is the same within its document."""
    return table(spark, sf, "customer").select(c.skolem(F.col("c_mktsegment"), F.concat(F.lit("b"), F.col("c_nationkey")), BASE).alias("id")).distinct()


@query("SELECT p_partkey AS id, CAST(1600000000000 + p_partkey * 1000 + p_size AS BIGINT) AS millis, 'http://example.org/part' AS parent FROM part")
def kg_scalar_times(spark, sf):
    """Scalars: the time in a time-ordered id, as milliseconds; the IRI one segment up."""
    hexed = F.lpad(F.lower(F.hex(F.lit(1600000000000) + F.col("p_partkey") * 1000 + F.col("p_size"))), 12, "0")
    name = F.concat(F.substring(hexed, 1, 8), F.lit("-"), F.substring(hexed, 9, 4), F.lit("-7000-8000-000000000000"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), c.epoch_millis(c.uuid7_time(name)).alias("millis"), c.parent(iri("part", F.col("p_partkey"))).alias("parent"))

"""The graph operators on small fixtures."""

import pytest
from pyspark.sql import functions as F

from lumengraph.functions import columns as c
from lumengraph.functions import cursors
from lumengraph.model import LOG, RDF_TYPE, RDFS_RESOURCE, XSD
from lumengraph.operators import access, changes, documents, revisions
from lumengraph.operators import select as s
from lumengraph.operators import state as st
from lumengraph.sources import rdf
from lumengraph.sources.mapping import TABLES, quads
from lumengraph.store import new_path
from lumengraph.streaming import feeds

EX = "http://example.org/"


def log(spark, *rows):
    """Rows (subject, predicate, object[, datatype, language, graph], change, sign), names below EX."""
    out = []
    for subject, predicate, value, *more, change, sign in rows:
        datatype, language, graph = [*more, *["", "", ""][len(more) :]]
        full = lambda x: x if "://" in x else EX + x
        out.append((full(subject), full(predicate), value if datatype else full(value), XSD + datatype if datatype else "", language, graph, None, change, sign))
    return spark.createDataFrame(out, LOG)


def people(spark):
    return log(
        spark,
        ("a", RDF_TYPE, "Person", "c1", 1),
        ("a", "name", "Ann", "string", "c1", 1),
        ("a", "age", "30", "integer", "c1", 1),
        ("a", "knows", "b", "c1", 1),
        ("a", "knows", "someone", "string", "c1", 1),
        ("b", RDF_TYPE, "Person", "c1", 1),
        ("b", RDF_TYPE, "Musician", "c1", 1),
        ("b", "name", "Bob", "string", "c1", 1),
        ("b", "name", "Robert", "string", "en", "c1", 1),
        ("b", "parent", "a", "c1", 1),
        ("d", RDF_TYPE, "Person", "c1", 1),
        ("d", "name", "Dan", "string", "c1", 1),
        ("d", "age", "9", "integer", "c1", 1),
        ("d", "parent", "a", "c1", 1),
    )


def rows(df, *names):
    return sorted(tuple(r[n] for n in (names or df.columns)) for r in df.collect())


def name(x):
    return s.Field("name", EX + "name", test=x)


# --- state


@pytest.mark.parametrize(
    ("history", "holds"),
    [
        ([("c1", 1)], True),
        ([("c1", 1), ("c2", -1)], False),
        ([("c1", 1), ("c2", -1), ("c3", 1)], True),
        ([("c1", 1), ("c2", -1), ("c2", 1)], True),
        ([("c1", 1), ("c1", 1)], True),
        ([("c1", -1)], False),
    ],
)
def test_the_last_change_decides(spark, history, holds):
    got = st.state(log(spark, *(("x", "p", "v", "string", *h) for h in history)))
    assert (got.count() == 1) == holds


def test_quads_differ_in_every_part(spark):
    got = st.state(log(spark, ("x", "p", "1", "integer", "c1", 1), ("x", "p", "1", "string", "c1", 1), ("x", "p", "1", "string", "en", "c1", 1), ("x", "p", "1", "string", "", "g", "c1", 1), ("x", "p", "1", "integer", "c2", -1)))
    assert rows(got, "datatype", "language", "graph") == [(XSD + "string", "", ""), (XSD + "string", "", "g"), (XSD + "string", "en", "")]


def test_time_travel(spark):
    own = log(spark, ("x", "p", "1", "string", "c1", 1), ("x", "p", "2", "string", "c2", 1), ("x", "p", "1", "string", "c3", -1))
    done = spark.createDataFrame([("c1", "COMMITTED", "2020-01-01"), ("c2", "COMMITTED", "2021-01-01"), ("c3", "COMMITTED", "2022-01-01"), ("c9", "QUEUED", "2020-06-01")], "id string, status string, t string").withColumn("timestamp", F.col("t").cast("timestamp"))
    at = lambda t: rows(st.state_at_time(own, done, F.lit(t).cast("timestamp")), "object")
    assert [at(t) for t in ("2019-01-01", "2020-01-01", "2020-12-01", "2021-06-01", "2023-01-01")] == [[], [], [("1",)], [("1",), ("2",)], [("2",)]]
    assert rows(st.state(own, at="c2"), "object", "change_id") == [("1", "c1"), ("2", "c2")]
    assert st.state(own.limit(0)).count() == 0


def test_restrictions_reach_the_scan(spark, tmp_path):
    people(spark).write.parquet(str(tmp_path / "log"))
    df = st.state(spark.read.parquet(str(tmp_path / "log")), at="c1", predicates=[EX + "name"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    pushed = next(line for line in plan.splitlines() if "PushedFilters" in line)
    assert "predicate" in pushed and "change_id" in pushed


def test_metadata(spark):
    got = st.inferred(people(spark))
    own = [(p.removeprefix(EX), k, r.removeprefix(EX).removeprefix(XSD)) for _, p, k, r in rows(got.where(F.col("type_uri") == EX + "Person"))]
    assert own == [("age", "Literal", "integer"), ("knows", "IRI", "Musician"), ("knows", "IRI", "Person"), ("knows", "Literal", "string"), ("name", "Literal", "string"), ("parent", "IRI", "Person")]
    kinds = {r.property_uri.removeprefix(EX): r.t for r in st.properties(got).where(F.col("type_uri") == EX + "Person").select("property_uri", st.field_type(F.col("refs")).alias("t")).collect()}
    assert kinds["knows"] == "RDFNode" and kinds["parent"] == EX + "Person" and kinds["age"] == XSD + "integer"


def test_metadata_by_batch_loses_links_across_batches(spark):
    own = log(spark, ("a", RDF_TYPE, "A", "c1", 1), ("b", RDF_TYPE, "B", "c2", 1), ("b", "to", "a", "c2", 1), ("e", RDF_TYPE, "E", "c2", 1))
    assert rows(st.inferred(own).where("property_uri is not null"), "property_ref") == [(EX + "A",)]
    assert rows(st.inferred(own, batch="change_id").where("property_uri is not null"), "property_ref") == [(RDFS_RESOURCE,)]
    assert st.inferred(own).where("property_uri is null").count() == 2


# --- selections


def test_required_optional_and_values(spark):
    now = st.state(people(spark))
    age = s.Field("age", EX + "age", "bigint")
    assert rows(s.entities(now, s.Node(EX + "Person", (age,)))) == [(EX + "a", 30), (EX + "d", 9)]
    optional = s.Field("age", EX + "age", "bigint", optional=True)
    assert [r.age for r in s.entities(now, s.Node(EX + "Person", (optional,))).orderBy("id").collect()] == [30, None, 9]
    assert rows(s.entities(now, s.Node(EX + "Person", (s.Field("age", EX + "age", "bigint", test=c.lt(10)),))), "id") == [(EX + "d",)]
    many = s.entities(now, s.Node(EX + "Person", (s.Field("name", EX + "name", many=True),)))
    assert {tuple(r.name) for r in many.collect()} == {("Ann",), ("Bob", "Robert"), ("Dan",)}


def test_filters(spark):
    now = st.state(people(spark))
    found = lambda test: [x[0].removeprefix(EX) for x in rows(s.entities(now, s.Node(EX + "Person", (name(test),))), "id")]
    assert found(c.eq("*n")) == ["a", "d"] and found(c.eq("Ro*")) == ["b"] and found(c.eq("*o*")) == ["b"] and found(c.eq("50%*")) == []
    assert found(c.within("Ann", "Dan")) == ["a", "d"] and found(c.outside("Ann", "Dan")) == ["b"]
    assert found(c.matching("^r", "i")) == ["b"] and found(c.either(c.eq("Ann"), c.ge("Robert"))) == ["a", "b"]


def test_forward_reverse_and_nested(spark):
    now = st.state(people(spark))
    child = s.Node(EX + "Person", (s.Field("name", EX + "name"),))
    assert rows(s.flat(now, s.Node(EX + "Person", (s.Field("parent", EX + "parent", node=child),))), "id", "parent_name") == [(EX + "b", "Ann"), (EX + "d", "Ann")]
    children = s.Field("children", EX + "parent", reverse=True, node=child)
    assert rows(s.flat(now, s.Node(EX + "Person", (children,))), "id", "children_name") == [(EX + "a", "Bob"), (EX + "a", "Dan")]
    got = s.nested(now, s.Node(EX + "Person", (children,)), ["-name"], size=1).collect()
    assert [(r.id, [x.name for x in r.children]) for r in got] == [(EX + "a", ["Dan"])]


def test_mixed_values_lead_to_entities_only_by_links(spark):
    now = st.state(people(spark))
    node = s.Node(EX + "Person", (s.Field("knows", EX + "knows", node=s.Node(EX + "Person")),))
    assert rows(s.flat(now, node), "id", "knows_id") == [(EX + "a", EX + "b")]
    assert rows(s.objects_of(now, EX + "knows"), "value", "datatype") == [(EX + "b", ""), ("someone", XSD + "string")]


def test_language(spark):
    now = st.state(people(spark))
    pick = lambda tag: s.entities(now, s.Node(EX + "Musician", (s.Field("name", EX + "name", language=tag, many=True),))).first().name
    assert pick("en") == ["Bob", "Robert"] and pick("de") == ["Bob"]


def test_views_restrict_queries(spark):
    now = st.state(people(spark))
    view = s.Node(EX + "Person", (name(c.ne("Ann")), s.Field("age", EX + "age", "bigint")), must=(EX + "age",))
    asked = s.Node(EX + "Person", (s.Field("name", EX + "name"),))
    assert rows(s.entities(now, view.also(asked))) == [(EX + "d", "Dan")]
    loose = s.Node(EX + "Person", (name(c.ne("Ann")), s.Field("age", EX + "age", "bigint")))
    assert rows(s.entities(now, loose.also(asked)), "id") == [(EX + "b",), (EX + "d",)]


def test_types_predicates_relations(spark):
    now = st.state(people(spark))
    assert {r.id: r.types for r in s.types_of(now).collect()}[EX + "b"] == [EX + "Musician", EX + "Person"]
    assert rows(s.relations_to(now, EX + "a"), "id") == [(EX + "b",), (EX + "d",)]
    assert spark.range(1).select(s.type_name(F.lit(None).cast("array<string>"))).first()[0] == "UntypedResource"


def test_pages_walk_through_all_rows(spark):
    df = spark.createDataFrame([(f"i{n:03}", n % 7) for n in range(95)], "id string, k int")
    want = [r.id for r in df.orderBy(F.desc("k"), "id").collect()]
    got, cursor = [], None
    while True:
        got += [r.id for r in s.page(df, ["-k"], 10, cursor).collect()]
        info = s.page_info(df, 10, cursor)
        assert info["totalCount"] == 95
        if not (cursor := info["next"]):
            break
    assert got == want


def test_cursors():
    assert cursors.decode("gaFvAw==") == 3 and cursors.encode(3) == "gaFvAw=="
    assert all(cursors.decode(cursors.encode(n)) == n for n in (0, 127, 128, 255, 256, 65535, 65536, 1 << 32, 1 << 40))
    assert [cursors.decode(x) for x in (None, "", "nonsense", "gaFv", "!!")] == [0] * 5


# --- sources


def test_ntriples(spark):
    lines = [
        "<http://e.org/s> <http://e.org/p> <http://e.org/o> .",
        '<http://e.org/s> <http://e.org/p> "a \\"q\\" \\\\n\\nb" .',
        '<http://e.org/s> <http://e.org/p> "True"^^<http://www.w3.org/2001/XMLSchema#boolean> <http://e.org/g> . # note',
        '<http://e.org/s> <http://e.org/p> "oui"@fr .',
        "_:b1 <http://e.org/p> _:b1 .",
        "# comment",
        "",
    ]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    got = rdf.statements(df)
    assert got.count() == 5
    literal = {(r.object, r.datatype.rsplit("#")[-1], r.language, r.graph) for r in got.where("datatype <> ''").collect()}
    assert literal == {('a "q" \\n\nb', "string", "", ""), ("True", "boolean", "", "http://e.org/g"), ("oui", "langString", "fr", "")}
    node = got.where("subject like '%#%'").first()
    assert node.subject == node.object and node.subject.startswith("http://example.org/#")
    assert rows(rdf.statements(rdf.to_ntriples(got.where("datatype <> ''")))) == rows(got.where("datatype <> ''"))
    assert spark.range(1).select(c.read(F.lit("True"), "boolean")).first()[0] is True
    bad = spark.createDataFrame([("<javascript:x> <http://e.org/p> <http://e.org/o> .",), ("nonsense",)], "value string")
    assert rdf.statements(bad, strict=False).count() == 0
    with pytest.raises(Exception, match="not a statement"):
        rdf.statements(bad).collect()


def test_json_documents(spark):
    df = spark.createDataFrame([('{"@id": "http://e.org/1", "@type": "T", "n": 5, "tags": ["a", "b"], "to": {"@id": "http://e.org/2"}, "ok": true, "x": 1.5}',), ('{"n": 1}',), (None,)], "json string")
    got = rdf.json_documents(df, {k: EX + k for k in ("n", "tags", "to", "ok", "x")}, "http://e.org/", {"T": EX + "T"})
    own = got.where("subject = 'http://e.org/1'")
    assert [(p.rsplit("/")[-1], o, d.rsplit("#")[-1]) for p, o, d in rows(own.where(F.col("predicate") != RDF_TYPE), "predicate", "object", "datatype")] == [("n", "5", "integer"), ("ok", "true", "boolean"), ("tags", "a", "string"), ("tags", "b", "string"), ("to", "http://e.org/2", ""), ("x", "1.5", "double")]
    assert got.count() == 8


def test_mapping_leaves_out_nulls(spark):
    df = spark.createDataFrame([(1, "x", None), (None, "y", 2)], "n_nationkey int, n_name string, n_regionkey int")
    assert rows(quads(df, TABLES["nation"]), "predicate") == [(EX + "name",), (RDF_TYPE,)]


def test_iris(spark):
    assert c.expand("ex:a/1", {"ex": EX}) == EX + "a/1" == c.expand("ex_a/1", {"ex": EX}) and c.expand("a", {}, EX) == EX + "a"
    with pytest.raises(ValueError, match="no prefix"):
        c.expand("zz", {})
    one = lambda x: spark.range(1).select(x).first()[0]
    assert one(c.parent(F.lit("http://e.org/a/b"))) == "http://e.org/a" and one(c.parent(F.lit("http://e.org/a"))) == "http://e.org"
    assert str(one(c.uuid7_time(F.lit("018bcfe5-687b-7000-8000-000000000000")))) == "2023-11-14 22:13:20.123000"


# --- changes


def test_assertions_gate_a_change(spark):
    now = st.state(people(spark))
    add = people(spark).limit(1)
    done = lambda *a: changes.process(changes.Change("c2", "2024-01-01", inserts=add, assertions=list(a)))[0]
    assert done(("nonempty", now), ("empty", now.limit(0))) == "COMMITTED"
    assert done(("nonempty", now.limit(0))) == done(("empty", now)) == "ASSERTION_FAILED"
    assert changes.process(changes.Change("c2", "2024-01-01"))[0] == "VALIDATION_ERROR"


def test_update_by_template(spark):
    before = people(spark)
    now = st.state(before)
    found = s.entities(now, s.Node(EX + "Person", (s.Field("age", EX + "age", "bigint"),)))
    cell = lambda v: changes.template(found, F.col("id"), (EX + "age", v, XSD + "integer"))
    _, records, _ = changes.process(changes.Change("c2", "2024-01-01", cell(F.col("age") + 1), cell(F.col("age"))))
    after = before.unionByName(records)
    assert rows(st.state(after, predicates=[EX + "age"]), "object") == [("10",), ("31",)]
    assert rows(st.state(changes.rolled_back(after, "c2"), predicates=[EX + "age"]), "object") == [("30",), ("9",)]
    gone = changes.records_of(changes.Change("c3", "2024-01-02", deletes=changes.everything_of(st.state(after), found)))
    assert {r.subject for r in st.state(after.unionByName(gone)).collect()} == {EX + "b"}


def test_violations(spark):
    shape = changes.Shape(
        EX + "Person",
        (
            changes.Constraint(EX + "name", required=True, single=True, datatypes=changes.ACCEPTED["String"], tests=(("pattern", c.matching("^[A-Z]")),)),
            changes.Constraint(EX + "age", max_count=1, datatypes=changes.ACCEPTED["Int"], tests=(("min", c.ge("18")),)),
            changes.Constraint(EX + "parent", iri=True),
        ),
    )
    found = rows(changes.violations(people(spark), [shape]), "subject", "predicate", "rule")
    assert [(a.removeprefix(EX), b.removeprefix(EX), r) for a, b, r in found] == [("a", "knows", "unknown property"), ("a", "knows", "unknown property"), ("b", "name", "max count")]
    lone = log(spark, ("z", RDF_TYPE, "Ghost", "c1", 1), ("z", "name", "zed", "string", "c1", 1), ("y", RDF_TYPE, "Person", "c1", 1), ("y", "parent", "x", "string", "c1", 1))
    assert rows(changes.violations(lone, [shape]), "rule") == [("min count",), ("not an IRI",), ("unknown subject",)]
    assert changes.process(changes.Change("c1", "2024-01-01", inserts=people(spark), shapes=(shape,)))[0] == "VALIDATION_ERROR"


def test_mutation_fields():
    assert changes.field_operations(["addPerson", "insertX", "removePerson", "deleteY"]) == {"addPerson": 1, "insertX": 1, "removePerson": -1, "deleteY": -1}
    with pytest.raises(ValueError, match="neither"):
        changes.field_operations(["person"])


# --- versions, access, documents


def test_revisions_and_tags(spark):
    revs = spark.createDataFrame([("s", "main", f"r{n}") for n in (1, 2, 3)] + [("s", "fix", "r4"), ("t", "main", "r5")], "id string, branch string, revision_id string")
    tags = spark.createDataFrame([("s", "default", "r1", 1), ("s", "default", "r2", 2), ("s", "old", "r1", 1)], "id string, tag_name string, revision_id string, created_at int")
    assert rows(revisions.resolved(revs, tags)) == [("s", "r2"), ("t", "r5")]
    assert rows(revisions.resolved(revs, tags, "old")) == [("s", "r1")]
    assert [r.tag_name for r in revisions.tag_listing(tags, "s").collect()] == ["default", "old"]
    ahead = {(r.id, r.revision_id): (r.tag_name, r.ahead) for r in revisions.ahead(revs, tags).collect()}
    assert ahead[("s", "r3")] == ("default", 1) and ahead[("s", "r1")] == ("old", 0) and ahead[("t", "r5")] == (None, 1)
    more = revisions.revised(revs, spark.createDataFrame([("s", "main", "r9")], "id string, branch string, revision_id string"))
    assert more.where("revision_id = 'r9'").first().parent_revision_id == "r3"
    assert rows(revisions.conflicts(revs, spark.createDataFrame([("s",), ("n",)], "id string"))) == [("s",)]


def test_access(spark):
    tuples = spark.createDataFrame(
        [("u", "owner", "/", None), ("u", "blocked", "/a", None), ("u", "reader", "/a/b/c", None), ("v", "external_access", "/a", ["read"]), ("w", "reader", "/x", None), ("w", "blocked", "/x", None)],
        "subject string, relation string, path string, access_types array<string>",
    )
    asked = spark.createDataFrame([("u", "/"), ("u", "/z/q"), ("u", "/a/b"), ("u", "/a/b/c/d"), ("v", "/a/1"), ("w", "/x/y"), ("n", "/")], "subject string, path string")
    can = lambda how: {(r.subject, r.path): r.allowed for r in access.check(asked, tuples, how).collect()}
    assert can("read") == {("u", "/"): True, ("u", "/z/q"): True, ("u", "/a/b"): False, ("u", "/a/b/c/d"): True, ("v", "/a/1"): True, ("w", "/x/y"): False, ("n", "/"): False}
    assert can("write")[("v", "/a/1")] is False and can("write")[("u", "/a/b/c/d")] is False
    names = spark.createDataFrame([("a@b.c",), ("http://x/y",), ("bob",)], "n string").select(access.subject(F.col("n")))
    assert [r[0] for r in names.collect()] == ["mailto:a@b.c", "http://x/y", "urn:bob"]


def test_documents(spark, tmp_path):
    base = people(spark)
    some, other = base.limit(3), log(spark, ("n", "p", "v", "string", "c1", 1))
    assert documents.patched(base, some, other.union(other)).count() == base.count() - 3 + 1
    assert documents.replaced(st.state(base), "", other).count() == 1
    new = spark.createDataFrame([("/a/b/c.txt",), ("/a/d",)], "path string")
    assert rows(documents.missing_containers(new, spark.createDataFrame([("/",)], "path string"))) == [("/a/",), ("/a/b/",)]
    (tmp_path / "f.txt").write_text("hello")
    assert rows(documents.listing(spark, str(tmp_path)), "length") == [(5,)]


def test_settings():
    assert documents.overlaid({"a": 1, "b": {"x": 1, "y": 2}}, {"b": {"y": None}, "c": 3}) == {"a": 1, "b": {"x": 1, "y": None}, "c": 3}
    assert documents.redacted({"s": {"key": "k", "id": "i"}}, ("s.key", "no.such")) == {"s": {"key": "***", "id": "i"}}
    assert documents.carried_over({"s": {"id": "j"}}, {"s": {"key": "k"}}, ("s.key",)) == {"s": {"id": "j", "key": "k"}}


# --- streams


def test_feed_resumes_where_it_was(spark):
    path, sink, checkpoint = (new_path(spark, x) for x in ("log", "feed", "checkpoint"))
    people(spark).write.parquet(path)
    go = lambda: feeds.run(feeds.log_stream(spark, path), feeds.persisted(sink), checkpoint, once=True).awaitTermination()
    go()
    log(spark, ("z", "p", "1", "string", "c2", -1)).write.mode("append").parquet(path)
    go()
    got = spark.read.parquet(sink).groupBy("change_id").agg(F.sum("inserts").alias("i"), F.sum("deletes").alias("d"))
    assert rows(got) == [("c1", 14, 0), ("c2", 0, 1)]


@pytest.mark.parametrize(("kind", "seen"), [("personAdded", ["Ann", "Bob", "Dan"]), ("personRemoved", ["Dan"])])
def test_subscriptions(spark, kind, seen):
    path, sink = new_path(spark, "log"), new_path(spark, "out")
    people(spark).write.parquet(path)
    gone = log(spark, ("d", RDF_TYPE, "Person", "c2", -1), ("d", "name", "Dan", "string", "c2", -1))
    gone.coalesce(1).write.mode("append").parquet(path)
    node = s.Node(EX + "Person", (s.Field("name", EX + "name"),))
    each = feeds.subscription(lambda: spark.read.parquet(path), lambda now: s.entities(now, node), sink, feeds.trigger_sign(None, kind), EX + "Person")
    whole = spark.read.parquet(path)
    for number, change in enumerate(("c1", "c2")):
        each(whole.where(F.col("change_id") == change), number)
    assert sorted(r.name for r in spark.read.parquet(sink).collect()) == seen
    assert feeds.trigger_sign("DELETE", "x") == -1 and feeds.trigger_sign(None, "changed") is None


def test_uploaded_files_become_changes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.nt").write_text('<http://e.org/s> <http://e.org/p> "v" .\nnonsense\n_:x <http://e.org/p> <http://e.org/s> .\n')
    stream, each = feeds.ingested(spark, str(tmp_path / "in"), str(tmp_path / "log"), EX, lambda n: f"u{n}")
    go = lambda: feeds.run(stream, each, str(tmp_path / "checkpoint"), once=True).awaitTermination()
    go()
    (tmp_path / "in" / "b.nt").write_text('<http://e.org/t> <http://e.org/p> "w" .\n')
    go()
    got = spark.read.parquet(str(tmp_path / "log"))
    assert rows(got.groupBy("change_id").count()) == [("u0", 2), ("u1", 1)]
    assert st.state(got).count() == 3


def test_pending_requests(spark):
    asked = spark.createDataFrame([("r1",), ("r2",)], "request_id string")
    done = spark.createDataFrame([("c1", "r1", "COMMITTED")], "id string, request_id string, status string")
    assert rows(changes.pending(asked, done).fillna("-")) == [("r1", "c1", "COMMITTED"), ("r2", "-", "QUEUED")]

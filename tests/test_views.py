"""Views that nothing leaks from, entities of optional fields, pages of feeds, and lines that can't be read."""

import pytest
from pyspark.sql import functions as F

from lumengraph.functions import columns as c
from lumengraph.model import LOG, RDF_TYPE, XSD
from lumengraph.operators import select as s
from lumengraph.operators import state as st
from lumengraph.sources import rdf
from lumengraph.streaming import feeds

EX = "http://example.org/"


@pytest.fixture(scope="module")
def now(spark):
    quads = []
    for who, kind, links in (("a", "Person", "xyz"), ("b", "Person", "z"), ("c", "Person", ""), ("x", "Pet", ""), ("y", "Pet", ""), ("z", "Pet", "")):
        quads += [(EX + who, RDF_TYPE, EX + kind, ""), (EX + who, EX + "name", who.upper(), XSD + "string"), (EX + who, EX + "secret", "s" + who, XSD + "string")]
        quads += [(EX + who, EX + "owns", EX + to, "") for to in links]
    rows = [(*q, "", "", None, "c1", 1) for q in quads]
    return st.state(spark.createDataFrame(rows, LOG))


def person(*fields, **more):
    return s.Node(EX + "Person", fields, **more)


NAME = s.Field("name", EX + "name")


def test_a_query_sees_nothing_beyond_its_view(now):
    pet = s.Node(EX + "Pet", (s.Field("name", EX + "name", test=c.ne("Z")),))
    view = person(NAME, s.Field("owns", EX + "owns", node=pet), ids=(EX + "a", EX + "b"))
    ids = lambda query: sorted(r.id.removeprefix(EX) for r in s.entities(now, view.also(query)).collect())
    assert ids(person(NAME)) == ["a", "b"]
    assert ids(person(NAME, ids=(EX + "b", EX + "c"))) == ["b"] and ids(person(NAME, ids=(EX + "c",))) == []
    assert [r.name for r in s.entities(now, view.also(person(s.Field("name", EX + "secret"), ids=(EX + "a",)))).collect()] == ["A"]
    owned = person(s.Field("owns", EX + "owns", node=s.Node(None, (NAME,))))
    assert sorted((r.id.removeprefix(EX), r.owns_name) for r in s.flat(now, view.also(owned)).collect()) == [("a", "X"), ("a", "Y")]
    for query in (person(s.Field("secret", EX + "secret")), s.Node(EX + "Pet", (NAME,)), person(s.Field("owns", EX + "owns", node=s.Node(None, (s.Field("secret", EX + "secret"),)))), person(s.Field("name", EX + "name", node=pet))):
        with pytest.raises(ValueError, match="view"):
            view.also(query)


@pytest.mark.parametrize("where", [None, lambda v: F.size(v["name"]) > 0])
def test_optional_entities_that_pass_no_filter_give_one_row(now, where):
    pet = s.Node(EX + "Pet", (s.Field("name", EX + "name", test=c.eq("X")),))
    node = person(NAME, s.Field("owns", EX + "owns", optional=True, node=pet), where=where)
    assert sorted((r.name, r.owns_name) for r in s.flat(now, node).collect()) == [("A", "X"), ("B", None), ("C", None)]
    back = s.Node(EX + "Pet", (NAME, s.Field("owner", EX + "owns", reverse=True, optional=True, node=person(s.Field("name", EX + "name", test=c.eq("B"))))), where=where)
    assert sorted((r.name, r.owner_name) for r in s.flat(now, back).collect()) == [("X", None), ("Y", None), ("Z", "B")]


def test_links_against_the_direction_are_never_gathered(now):
    node = s.Node(EX + "Pet", (s.Field("owner", EX + "owns", reverse=True, node=person(NAME)),))
    plan = s.flat(now, node)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan


def test_events_hold_a_bounded_number_of_records(spark):
    rows = spark.createDataFrame([(EX + str(i), EX + "p", "v", "", "", "", None, "c1", 1) for i in range(95)], LOG).coalesce(1)
    events = feeds.grouped(rows, size=10).collect()
    assert max(len(r.records) for r in events) <= 10 and sum(r.inserts for r in events) == 95


def test_lines_that_cannot_be_read_are_kept_apart(spark):
    lines = spark.createDataFrame([('<http://e.org/s> <http://e.org/p> "v" .',), ("nonsense",), ("# comment",), ("",), (None,), ("<javascript:x> <http://e.org/p> <http://e.org/o> .",)], "value string")
    assert sorted(r.line for r in rdf.rejected(lines).collect()) == ["<javascript:x> <http://e.org/p> <http://e.org/o> .", "nonsense"]
    assert rdf.statements(lines, strict=False).count() == 1


def test_escapes(spark):
    given = r'<http://e.org/s> <http://e.org/p> "\u00e9\U0001F600\b\f\'\\u0041' + "\x00" + '" .'
    assert rdf.statements(spark.createDataFrame([(given,)], "value string")).first().object == "é\U0001f600\b\f'\\u0041\x00"

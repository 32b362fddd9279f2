"""Change requests: assertions, insertions, deletions, templates, validation, rollback."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumengraph.functions.columns import Test
from lumengraph.model import DELETE, INSERT, QUAD, RDF_TYPE, XSD
from lumengraph.operators.state import change_counts, dealt

#: Assertions that are looked at side by side.
ASSERTIONS_AT_ONCE = 4


@dataclass
class Change:
    """What is asked for: assertions (``empty`` or ``nonempty``, rows), quads to insert and to delete, shapes to meet."""

    id: str
    timestamp: str
    inserts: DataFrame | None = None
    deletes: DataFrame | None = None
    assertions: list[tuple[str, DataFrame]] = field(default_factory=list)
    shapes: tuple[Shape, ...] = ()


@dataclass(frozen=True)
class Constraint:
    """A rule for the values of a property of a class; comparisons are those of strings, as are min and max by default.

    With a ``cls`` the values are links to instances of that class, by the types in the same change. Of several rules for one
    property one has to hold.
    """

    predicate: str
    required: bool = False
    single: bool = False
    min_count: int | None = None
    max_count: int | None = None
    datatypes: tuple[str, ...] = ()
    iri: bool = False
    tests: tuple[tuple[str, Test], ...] = ()
    cls: str | None = None


@dataclass(frozen=True)
class Shape:
    """The rules for the properties of a class's instances, and tests of their own IRIs."""

    cls: str
    constraints: tuple[Constraint, ...]
    id_tests: tuple[tuple[str, Test], ...] = ()


#: The datatypes that a field of a kind accepts on writing.
ACCEPTED = {
    "String": (XSD + "string",),
    "Boolean": (XSD + "boolean",),
    "Int": (XSD + "int", XSD + "integer"),
    "Float": (XSD + "double", XSD + "decimal", XSD + "float"),
    "DateTime": (XSD + "dateTime",),
    "Date": (XSD + "date",),
    "Time": (XSD + "time",),
}


def template(rows: DataFrame, subject: Column, *cells: tuple[str, Column, str]) -> DataFrame:
    """Quads from the rows of a query: for each row and each (predicate, value, datatype), where the value isn't null."""
    built = [F.struct(F.lit(p).alias("predicate"), v.cast("string").alias("object"), F.lit(d).alias("datatype")) for p, v, d in cells]
    out = rows.select(subject.alias("subject"), F.explode(F.array(*built)).alias("q")).where("q.object is not null")
    return out.select("subject", "q.*", F.lit("").alias("language"), F.lit("").alias("graph"))


def everything_of(state: DataFrame, rows: DataFrame, column: str = "id") -> DataFrame:
    """All quads of the entities that a query found; what ``*`` deletes."""
    return state.join(rows.select(F.col(column).alias("_id")), F.col("subject") == F.col("_id"), "left_semi").select(*QUAD)


def records_of(change: Change) -> DataFrame | None:
    """A change's records. Order within a change is by sign: deletions come first, since insertions win."""
    out = None
    for rows, sign in ((change.deletes, DELETE), (change.inserts, INSERT)):
        if rows is not None:
            own = rows.select(*QUAD, F.lit(change.timestamp).cast("timestamp").alias("timestamp"), F.lit(change.id).alias("change_id"), F.lit(sign).cast("byte").alias("sign"))
            out = own if out is None else out.unionByName(own)
    return out


def violations(records: DataFrame, shapes: Sequence[Shape], count: int = 0) -> DataFrame:
    """(change_id, subject, predicate, rule, value): where a change's inserted quads break the shapes of their classes.

    Instances are told by their types in the same change; predicates that a class's shape doesn't know, and subjects without a
    known class, are violations too. An instance that breaks all of several rules for one property has the rule
    ``no alternative``.

    An instance's quads are dealt and sorted together once; windows over them tell every rule. ``count`` is the most records
    that there are, if known.
    """
    instance = ["change_id", "subject"]
    rows = records.where(F.col("sign") == INSERT)
    known = {s.cls: s for s in shapes}
    linked = sorted({(c.predicate, c.cls) for s in known.values() for c in s.constraints if c.cls})
    lacks = {cls: f"_lacks{i}" for i, cls in enumerate(sorted({cls for _, cls in linked}))}
    if linked:  # links of these rules meet the types of what they lead to; no other quad is joined
        is_link = (F.col("datatype") == "") & F.col("predicate").isin(*(p for p, _ in linked))
        there = rows.where((F.col("predicate") == RDF_TYPE) & F.col("object").isin(*lacks)).groupBy("change_id", F.col("subject").alias("object"))
        there = there.agg(*(F.max(F.col("object") == cls).alias(name) for cls, name in lacks.items()))
        marked = rows.where(is_link).join(there, ["change_id", "object"], "left")
        marked = marked.select(*rows.columns, *(~F.coalesce(name, F.lit(False)) for name in lacks.values()))
        rows = rows.where(~is_link).select("*", *(F.lit(False).alias(name) for name in lacks.values())).union(marked)

    value = F.col("predicate") != RDF_TYPE
    whole = Window.partitionBy(*instance).orderBy("predicate")
    flag = lambda test: F.coalesce(test, F.lit(False))
    over = lambda c: c.over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = dealt(rows, *instance, records=count).withColumn("_first", F.row_number().over(whole) == 1)
    typed = {cls: f"_typed{k}" for k, cls in enumerate(known)}
    rows = rows.withColumns({name: over(F.max(~value & (F.col("object") == cls))) for cls, name in typed.items()})
    ns = {(k, i): f"_n{k}_{i}" for k, s in enumerate(known.values()) for i in range(len(s.constraints))}
    rows = rows.withColumns({name: over(F.sum(F.when(value & (F.col("predicate") == list(known.values())[k].constraints[i].predicate), 1).otherwise(0))) for (k, i), name in ns.items()})

    def one(test: Column, rule: str, shown: Column, predicate: Column | None = None) -> Column:
        return F.when(test, F.struct((F.col("predicate") if predicate is None else predicate).alias("predicate"), F.lit(rule).alias("rule"), shown.cast("string").alias("value")))

    def by_count(c: Constraint, n: Column) -> list[tuple[str, Column]]:
        least = max(int(c.required), c.min_count or 0)
        most = min([x for x in (1 if c.single else None, c.max_count) if x is not None], default=None)
        return [(rule, off) for rule, off in (("min count", n < least if least else None), ("max count", n > most if most is not None else None)) if off is not None]

    def by_value(c: Constraint) -> list[tuple[str, Column, Column]]:
        mine = value & (F.col("predicate") == c.predicate)
        out = [("not an IRI", mine & (F.col("datatype") != ""), F.col("object"))] if c.iri or c.cls else []
        out += [("class", mine & (F.col("datatype") == "") & F.col(lacks[c.cls]), F.col("object"))] if c.cls else []
        out += [("datatype", mine & ~F.col("datatype").isin(*c.datatypes), F.col("datatype"))] if c.datatypes else []
        return out + [(rule, mine & ~flag(test(F.col("object"))), F.col("object")) for rule, test in c.tests]

    none = F.lit(None).cast("string")
    any_class = reduce(Column.__or__, (F.col(name) for name in typed.values()), F.lit(False))
    found = [one(value & ~any_class, "unknown subject", F.col("object"))]
    for k, (cls, shape) in enumerate(known.items()):
        own, first = F.col(typed[cls]), F.col("_first") & F.col(typed[cls])
        found += [one(first & ~flag(test(F.col("subject"))), rule, F.col("subject"), F.lit("@id")) for rule, test in shape.id_tests]
        rules: dict[str, list[tuple[int, Constraint]]] = {}
        for i, c in enumerate(shape.constraints):
            rules.setdefault(c.predicate, []).append((i, c))
        found.append(one(own & value & ~F.col("predicate").isin(*rules), "unknown property", F.col("object")))
        for predicate, several in rules.items():
            counts = {i: by_count(c, F.col(ns[k, i])) for i, c in several}
            values = {i: by_value(c) for i, c in several}
            if len(several) == 1:
                i = several[0][0]
                found += [one(first & off, rule, F.col(ns[k, i]), F.lit(predicate)) for rule, off in counts[i]]
                found += [one(own & off, rule, shown) for rule, off, shown in values[i]]
            elif all(counts[i] or values[i] for i in counts):  # one without anything to break always holds
                for i in counts:
                    off = [x for _, x in counts[i]] + ([over(F.max(reduce(Column.__or__, (flag(x) for _, x, _ in values[i]))))] if values[i] else [])
                    rows = rows.withColumn(f"_off{k}_{i}", reduce(Column.__or__, off))
                found.append(one(first & reduce(Column.__and__, (F.col(f"_off{k}_{i}") for i in counts)), "no alternative", none, F.lit(predicate)))
    return rows.select(*instance, F.explode(F.array_compact(F.array(*found))).alias("_v")).select(*instance, "_v.*")


def reports(requests: DataFrame, records: DataFrame, shapes: Sequence[Shape] = ()) -> tuple[DataFrame, DataFrame]:
    """(reports, records to write) of a batch of plain requests(request_id, pod_id, change_id) with their records.

    A request that breaks a shape, or holds nothing, fails by itself and writes nothing; the others are written. A report has
    the request's columns, its place among its pod's requests, status, message (one of its faults) and the numbers of quads.
    All pods are judged in one job.
    """
    failed = violations(records, shapes).groupBy("change_id").agg(F.min(F.concat(F.col("rule"), F.lit(": "), F.col("subject"), F.lit(" "), F.col("predicate"))).alias("message")) if shapes else None
    kept = records if failed is None else records.join(failed.select("change_id"), "change_id", "left_anti")
    out = requests.join(change_counts(kept), "change_id", "left")
    out = out.join(failed, "change_id", "left") if failed is not None else out.withColumn("message", F.lit(None).cast("string"))
    out = out.withColumn("message", F.coalesce("message", F.when(F.col("inserts").isNull(), "a change inserts or deletes something")))
    place = F.row_number().over(Window.partitionBy("pod_id").orderBy("request_id"))
    report = out.select(*requests.columns, place.alias("place"), F.when(F.col("message").isNull(), "COMMITTED").otherwise("VALIDATION_ERROR").alias("status"), "message", *(F.coalesce(n, F.lit(0)).alias(n) for n in ("inserts", "deletes")))
    return report, kept


def failed_assertions(assertions: list[tuple[str, DataFrame]]) -> list[str]:
    """The kinds of the assertions that don't hold; each looks at one row at most."""
    holds = lambda a: a[1].limit(1).count() == (0 if a[0] == "empty" else 1)
    with ThreadPoolExecutor(ASSERTIONS_AT_ONCE) as pool:
        return [a[0] for a, ok in zip(assertions, pool.map(holds, assertions), strict=True) if not ok]


def process(change: Change) -> tuple[str, DataFrame | None, str | None]:
    """(status, records to write, message): assertions first, then shapes; nothing is written unless all hold."""
    records = records_of(change)
    if records is None:
        return "VALIDATION_ERROR", None, "a change inserts or deletes something"
    if failed := failed_assertions(change.assertions):
        return "ASSERTION_FAILED", None, f"not {failed[0]}"
    if change.shapes and (bad := violations(records, change.shapes).limit(1).collect()):
        return "VALIDATION_ERROR", None, f"{bad[0].rule}: {bad[0].subject} {bad[0].predicate}"
    return "COMMITTED", records, None


def route(assertions: Column, has_with: Column, refs: Column) -> Column:
    """The queue of a request: stateful if it asks the state, ref if it names files, else plain."""
    return F.when(assertions | has_with, "stateful").when(refs, "ref").otherwise("plain")


def rolled_back(log: DataFrame, change_id: str) -> DataFrame:
    """The log without a change's records."""
    return log.where(F.col("change_id") != change_id)


def visible(log: DataFrame, changes: DataFrame) -> DataFrame:
    """The records of committed changes; a change that isn't committed has not happened."""
    done = changes.where(F.col("status") == "COMMITTED").select(F.col("id").alias("_id"))
    return log.join(done, F.col("change_id") == F.col("_id"), "left_semi")


def pending(requests: DataFrame, changes: DataFrame) -> DataFrame:
    """requests(request_id, ...) with ``change_id`` and ``status``: QUEUED until changes(id, request_id, status) has it."""
    done = changes.select("request_id", F.col("id").alias("change_id"), F.col("status").alias("_status"))
    return requests.join(done, "request_id", "left").withColumn("status", F.coalesce("_status", F.lit("QUEUED"))).drop("_status")


def field_operations(names: Sequence[str]) -> dict[str, int]:
    """What mutation fields do, by their names' beginning."""
    out = {}
    for n in names:
        low = n.lower()
        if low.startswith(("add", "insert")):
            out[n] = INSERT
        elif low.startswith(("remove", "delete")):
            out[n] = DELETE
        else:
            raise ValueError(f"{n!r} neither adds nor removes")
    return out



"""Selections of entities with their fields: from quads to rows, by one aggregation a class."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumengraph.functions import cursors
from lumengraph.functions.columns import Test, read
from lumengraph.model import RDF_TYPE

PAGE = 100


@dataclass(frozen=True)
class Field:
    """A property of the entities selected.

    kind is the Spark type its literals are read as. Values are those that pass ``test`` and, if ``language`` is given, that
    have it or none; an entity needs one, unless the field is optional. With a ``node`` the field leads to other entities,
    against the predicate's direction if ``reverse``. A field that isn't ``many`` is read as its least value. ``order`` and
    ``size`` are those of a nested page.
    """

    name: str
    predicate: str
    kind: str = "string"
    optional: bool = False
    many: bool = False
    test: Test | None = None
    language: str | None = None
    reverse: bool = False
    node: Node | None = None
    order: tuple[str, ...] = ()
    size: int | None = None

    def _asked(self, by: Field) -> Field:
        """This field of a view, as a query asks for it."""
        if by.node and not self.node:
            raise ValueError(f"the view's field {self.name!r} leads nowhere")
        node = self.node.also(by.node) if self.node and by.node else self.node
        return replace(self, optional=self.optional and by.optional, test=_both(self.test, by.test), language=self.language if self.language is not None else by.language, node=node, order=by.order or self.order, size=by.size or self.size)


@dataclass(frozen=True)
class Node:
    """Entities of a class (of any, if None) that have their fields, pass ``where`` (values by field name, as arrays), and
    hold a value for each predicate in ``must``, with the fields named in ``hidden`` used, but not returned."""

    cls: str | None
    fields: tuple[Field, ...] = ()
    ids: tuple[str, ...] = ()
    where: Callable[[dict[str, Column]], Column] | None = None
    must: tuple[str, ...] = ()
    hidden: tuple[str, ...] = ()

    def also(self, query: Node) -> Node:
        """A query on this view: both have to hold, and the query sees nothing beyond the view.

        What a field stands for (predicate, kind, direction, language) is the view's; the query names fields and restricts
        them. Fields, nested ones too, and classes that the view doesn't show are an error, as in a query that a schema
        doesn't fit. The view's tests hold for fields that aren't asked for; such fields keep no entity out for lack of a
        value unless the view names their predicates in ``must``.
        """
        known = {f.name: f for f in self.fields}
        if query.cls and self.cls and query.cls != self.cls:
            raise ValueError(f"the view does not show {query.cls}")
        if unknown := sorted({f.name for f in query.fields} - set(known)):
            raise ValueError(f"the view has no field {unknown[0]!r}")
        asked = {f.name for f in query.fields}
        fields = tuple(known[f.name]._asked(f) for f in query.fields)
        extra = tuple(f for f in self.fields if f.name not in asked)
        unseen = tuple(replace(f, optional=f.predicate not in self.must) for f in extra)
        where = [w for w in (self.where, query.where) if w]
        ids = query.ids or self.ids
        if query.ids and self.ids:
            ids = tuple(x for x in query.ids if x in self.ids) or NOTHING
        return Node(self.cls or query.cls, (*fields, *unseen), ids, (lambda v: _all([w(v) for w in where])) if where else None, (*self.must, *query.must), (*self.hidden, *query.hidden, *(f.name for f in extra)))


#: Ids of no entity.
NOTHING = ("",)


def _both(a: Test | None, b: Test | None) -> Test | None:
    if a is None or b is None:
        return a or b
    return lambda v: a(v) & b(v)


def _all(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def any_of(values: Column, test: Test) -> Column:
    """True if some value passes."""
    return F.coalesce(F.exists(values, test), F.lit(False))


def predicates(node: Node) -> set[str]:
    """What a selection reads: with it the log is restricted before it is collapsed."""
    out = {RDF_TYPE, *node.must}
    for f in node.fields:
        out.add(f.predicate)
        if f.node:
            out |= predicates(f.node)
    return out


def links(state: DataFrame, field: Field) -> DataFrame:
    """(_from, _to): the pairs of entities that a field leads along, each once."""
    rows = state.where((F.col("predicate") == field.predicate) & (F.col("datatype") == ""))
    start, end = ("object", "subject") if field.reverse else ("subject", "object")
    rows = rows.select(F.col(start).alias("_from"), F.col(end).alias("_to")).distinct()
    return rows.where(F.coalesce(field.test(F.col("_to")), F.lit(False))) if field.test else rows


def _by_links(node: Node) -> set[str]:
    """The fields whose entities are found along single links, so that no row ever holds all of an entity's links: those
    against the direction, and optional ones."""
    return set() if node.where else {f.name for f in node.fields if f.node and (f.reverse or f.optional)}


def entities(state: DataFrame, node: Node, without: frozenset[str] | set[str] = frozenset()) -> DataFrame:
    """(id, one column a field): one row an entity; fields that are many, or lead on, as sorted arrays.

    One aggregation by subject gathers all forward fields; reverse fields are gathered by object and joined. Fields named in
    ``without`` are neither gathered nor required. Of a field that is read as its least value only that is gathered, unless
    ``where`` asks for all: such values need no buffer of their own.
    """
    node = replace(node, fields=tuple(f for f in node.fields if f.name not in without))
    plain = [f for f in node.fields if not f.reverse]
    single = set() if node.where else {f.name for f in plain if not (f.many or f.node)}
    needed = {RDF_TYPE, *node.must, *(f.predicate for f in plain)}
    rows = state.where(F.col("predicate").isin(*sorted(needed)))
    if node.ids:
        rows = rows.where(F.col("subject").isin(*node.ids))

    def gathered(f: Field) -> Column:
        value = F.col("object") if f.node else read(F.col("object"), f.kind)
        fits = F.col("predicate") == f.predicate
        if f.node:
            fits = fits & (F.col("datatype") == "")
        if f.language is not None:
            fits = fits & F.col("language").isin("", f.language)
        if f.test is not None:
            fits = fits & F.coalesce(f.test(value), F.lit(False))
        held = F.when(fits, value)
        return (F.min(held) if f.name in single else F.sort_array(F.collect_list(held))).alias(f.name)

    has = [F.max(F.col("predicate") == p).alias(f"_must{i}") for i, p in enumerate(node.must)]
    typed = F.max((F.col("predicate") == RDF_TYPE) & (F.col("object") == node.cls)).alias("_typed") if node.cls else F.lit(True).alias("_typed")
    out = rows.groupBy(F.col("subject").alias("id")).agg(typed, *has, *(gathered(f) for f in plain)).where(_all([F.col("_typed"), *(F.col(f"_must{i}") for i in range(len(has)))]))
    for f in node.fields:
        if f.reverse:
            back = state.where((F.col("predicate") == f.predicate) & (F.col("datatype") == "")).groupBy(F.col("object").alias("id")).agg(F.sort_array(F.collect_set("subject")).alias(f.name))
            out = out.join(back, "id", "left").withColumn(f.name, F.coalesce(f.name, F.array().cast("array<string>")))
    for f in node.fields:
        if not f.optional:
            out = out.where(F.col(f.name).isNotNull() if f.name in single else F.size(f.name) > 0)
    if node.where:
        out = out.where(F.coalesce(node.where({"id": F.array("id"), **{f.name: F.col(f.name) for f in node.fields}}), F.lit(False)))
    shown = [f for f in node.fields if f.name not in node.hidden]
    return out.select("id", *((F.col(f.name) if f.many or f.node or f.name in single else F.get(f.name, F.lit(0))).alias(f.name) for f in shown))


def flat(state: DataFrame, node: Node, prefix: str = "") -> DataFrame:
    """One row for each combination of an entity and those that its fields lead to; columns ``field_subfield``.

    A required field joins its entities; of an optional one, entities that it leads nowhere to have one row with nulls.
    """
    apart = _by_links(node)
    out = entities(state, node, apart).withColumnRenamed("id", f"{prefix}id")
    for f in node.fields:
        own = prefix + f.name
        if f.name in apart:
            below = flat(state, f.node, f"{own}_")
            pairs = links(state, f).join(below, F.col("_to") == below[f"{own}_id"])
            if f.name in node.hidden:
                out = out if f.optional else out.join(pairs, out[f"{prefix}id"] == pairs["_from"], "left_semi")
            else:
                out = out.join(pairs, out[f"{prefix}id"] == pairs["_from"], "left" if f.optional else "inner").drop("_from", "_to")
            continue
        if f.name in node.hidden:
            continue
        out = out.withColumnRenamed(f.name, own) if prefix else out
        if f.node:
            below = flat(state, f.node, f"{own}_")
            if f.optional:  # with a condition on the whole entity: links from its own row
                pairs = out.select(F.col(f"{prefix}id").alias("_from"), F.explode(own).alias("_to")).join(below, F.col("_to") == below[f"{own}_id"])
                out = out.drop(own).join(pairs, out[f"{prefix}id"] == pairs["_from"], "left").drop("_from", "_to")
            else:
                out = out.withColumn(own, F.explode(own)).join(below, F.col(own) == below[f"{own}_id"]).drop(own)
    return out


def nested(state: DataFrame, node: Node, order: Sequence[str] = (), size: int = PAGE) -> DataFrame:
    """One row an entity; a field that leads on holds its entities as an array of structs, in order of id or of ``order``,
    ``size`` of them at most, which a window by parent picks. A field's own ``order`` and ``size`` come before these."""
    apart = _by_links(node)
    out = entities(state, node, apart)
    for f in node.fields:
        if not f.node or f.name in node.hidden:
            continue
        below = nested(state, f.node, order, size)
        own = links(state, f).select(F.col("_from").alias("_parent"), F.col("_to").alias("_child")) if f.name in apart else out.select(F.col("id").alias("_parent"), F.explode(f.name).alias("_child"))
        own = own.join(below, F.col("_child") == below["id"]).drop("_child")
        inside = [o for o in f.order or order if o.lstrip("-") in below.columns]
        own = page(own, inside, f.size or size, per="_parent", drop=False)
        held = own.groupBy("_parent").agg(F.transform(F.sort_array(F.collect_list(F.struct("_nth", F.struct(*below.columns).alias("e")))), lambda x: x["e"]).alias("_held"))
        out = out.join(held, out["id"] == held["_parent"], "left" if f.optional else "inner").withColumn(f.name, F.col("_held")).drop("_held", "_parent")
    return out.select("id", *(f.name for f in node.fields if f.name not in node.hidden))


def keys(order: Sequence[str], tie: str = "id") -> list[Column]:
    """Sort keys from names, ``-`` in front for descending; the id settles ties."""
    out = [F.desc(o[1:]) if o.startswith("-") else F.asc(o) for o in order]
    return out if tie in {o.lstrip("-") for o in order} else [*out, F.asc(tie)]


def page(rows: DataFrame, order: Sequence[str] = (), size: int = PAGE, cursor: str | None = None, per: str | None = None, tie: str = "id", drop: bool = True) -> DataFrame:
    """Rows from the cursor's offset on, ``size`` of them, in a total order; by parent if ``per`` names it."""
    start = cursors.decode(cursor)
    if per is None:
        return rows.orderBy(*keys(order, tie)).offset(start).limit(size)
    nth = F.row_number().over(Window.partitionBy(per).orderBy(*keys(order, tie)))
    out = rows.withColumn("_nth", nth).where((F.col("_nth") > start) & (F.col("_nth") <= start + size))
    return out.drop("_nth") if drop else out


def page_info(rows: DataFrame, size: int = PAGE, cursor: str | None = None) -> dict:
    """How many rows there are, and the next page's cursor if there is one."""
    total, start = rows.count(), cursors.decode(cursor)
    return {"totalCount": total, "next": cursors.encode(start + size) if start + size < total else None}


def envelope(rows: DataFrame, name: str, order: Sequence[str] = (), size: int = PAGE, cursor: str | None = None, errors: Sequence[str] = ()) -> DataFrame:
    """One row (data, errors, extensions) of JSON: a page of rows under a name, the errors' messages (null without any), and
    the page's information. The page is bounded by ``size``, so that it is one row however many rows there are."""
    some = page(rows, order, size, cursor).withColumn("_nth", F.row_number().over(Window.orderBy(*keys(order))))
    held = F.transform(F.sort_array(F.collect_list(F.struct("_nth", F.struct(*rows.columns).alias("e")))), lambda x: x["e"])
    text = lambda c: F.to_json(c, {"ignoreNullFields": "false"})
    said = text(F.array(*(F.struct(F.lit(m).alias("message")) for m in errors))) if errors else F.lit(None).cast("string")
    info = page_info(rows, size, cursor)
    told = F.struct(F.struct(F.lit(info["totalCount"]).alias("totalCount"), F.lit(info["next"]).cast("string").alias("next")).alias(name))
    return some.agg(text(F.struct(held.alias(name))).alias("data")).select("data", said.alias("errors"), text(F.struct(told.alias("pagination"))).alias("extensions"))


def types_of(state: DataFrame) -> DataFrame:
    """(id, types): each subject's classes."""
    return state.where(F.col("predicate") == RDF_TYPE).groupBy(F.col("subject").alias("id")).agg(F.sort_array(F.collect_set("object")).alias("types"))


def type_name(types: Column) -> Column:
    """The class an entity of several is shown as: the first; untyped ones get a name of their own."""
    return F.when(F.coalesce(F.size(types), F.lit(0)) > 0, F.array_min(types)).otherwise(F.lit("UntypedResource"))


def predicates_of(state: DataFrame) -> DataFrame:
    """(id, predicates): the distinct predicates of each subject."""
    return state.groupBy(F.col("subject").alias("id")).agg(F.sort_array(F.collect_set("predicate")).alias("predicates"))


def relations_to(state: DataFrame, target: str) -> DataFrame:
    """(id, relations): the predicates by which subjects link to one IRI."""
    return state.where((F.col("object") == target) & (F.col("datatype") == "")).groupBy(F.col("subject").alias("id")).agg(F.sort_array(F.collect_set("predicate")).alias("relations"))


def objects_of(state: DataFrame, predicate: str) -> DataFrame:
    """(id, value, datatype, language): all values of a predicate, whatever they are."""
    return state.where(F.col("predicate") == predicate).select(F.col("subject").alias("id"), F.col("object").alias("value"), "datatype", "language")

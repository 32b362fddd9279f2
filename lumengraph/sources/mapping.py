"""Relational tables as quads: a row is a subject, a column a predicate, a foreign key a link."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumengraph.model import RDF_TYPE, XSD

BASE = "http://example.org/"
#: The datatype of a column's literals by its Spark type.
DATATYPES = {"int": "integer", "bigint": "integer", "smallint": "integer", "double": "double", "float": "double", "boolean": "boolean", "timestamp": "dateTime", "timestamp_ntz": "dateTime", "date": "date"}


@dataclass(frozen=True)
class Mapping:
    """How a table becomes quads: class, key column, and for each further column its predicate or the class it links to."""

    name: str
    key: str
    literals: dict[str, str]
    links: dict[str, tuple[str, str]] = field(default_factory=dict)

    @property
    def cls(self) -> str:
        return BASE + self.name


def iri(name: str, key: Column) -> Column:
    return F.concat(F.lit(f"{BASE}{name[:1].lower()}{name[1:]}/"), key.cast("string"))


def cells(table: DataFrame, mapping: Mapping, columns: tuple[str, ...] | None = None) -> dict[str, Column]:
    """By predicate, the (predicate, object, datatype) that a row gives; the class is among them."""
    kinds = dict(table.dtypes)
    picked = lambda c: columns is None or c in columns

    def cell(predicate: str, value: Column, datatype: str) -> Column:
        return F.struct(F.lit(predicate).alias("predicate"), value.alias("object"), F.lit(datatype).alias("datatype"))

    out = {RDF_TYPE: cell(RDF_TYPE, F.lit(mapping.cls), "")}
    out |= {BASE + p: cell(BASE + p, F.col(c).cast("string"), XSD + DATATYPES.get(kinds[c], "string")) for c, p in mapping.literals.items() if picked(c)}
    return out | {BASE + p: cell(BASE + p, iri(to, F.col(c)), "") for c, (p, to) in mapping.links.items() if picked(c)}


def quads(table: DataFrame, mapping: Mapping, columns: tuple[str, ...] | None = None, extra: dict[str, Column] | None = None, predicate: str | None = None) -> DataFrame:
    """(subject, predicate, object, datatype, language, graph) of every row: one pass over the columns asked for.

    A null key's row gives nothing, a null value no quad. Extra columns of the row can be carried along. With a ``predicate``
    only its quads come, and of the table only its column is read.
    """
    more = [v.alias(k) for k, v in (extra or {}).items()]
    held = cells(table, mapping, columns)
    q = held[predicate] if predicate else F.explode(F.array(*held.values()))
    rows = table.where(F.col(mapping.key).isNotNull()).select(iri(mapping.name, F.col(mapping.key)).alias("subject"), q.alias("q"), *more)
    return rows.where("q.object is not null").select("subject", "q.*", F.lit("").alias("language"), F.lit("").alias("graph"), *(extra or {}))


def logged(rows: DataFrame, change_id: Column, timestamp: Column, sign: int = 1) -> DataFrame:
    """Quads as records of the log."""
    return rows.select("subject", "predicate", "object", "datatype", "language", "graph", timestamp.cast("timestamp").alias("timestamp"), change_id.alias("change_id"), F.lit(sign).cast("byte").alias("sign"))


#: The tables at hand.
TABLES = {
    "region": Mapping("Region", "r_regionkey", {"r_name": "name"}),
    "nation": Mapping("Nation", "n_nationkey", {"n_name": "name"}, {"n_regionkey": ("region", "Region")}),
    "customer": Mapping("Customer", "c_custkey", {"c_name": "name", "c_acctbal": "acctbal", "c_mktsegment": "mktsegment"}, {"c_nationkey": ("nation", "Nation")}),
    "supplier": Mapping("Supplier", "s_suppkey", {"s_name": "name", "s_acctbal": "acctbal"}, {"s_nationkey": ("nation", "Nation")}),
    "part": Mapping("Part", "p_partkey", {"p_name": "name", "p_brand": "brand", "p_type": "type", "p_size": "size", "p_retailprice": "retailprice"}),
    "orders": Mapping("Order", "o_orderkey", {"o_orderstatus": "status", "o_totalprice": "totalprice", "o_orderdate": "orderdate", "o_orderpriority": "priority"}, {"o_custkey": ("customer", "Customer")}),
    "events": Mapping("Event", "event_id", {"ts": "ts", "event_type": "eventType", "value": "value"}, {"user_id": ("user", "User")}),
}

"""The state of a log: what holds now, or held at an earlier change; and its schema, inferred."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumengraph.model import QUAD, RDF_TYPE, RDFS_RESOURCE, RECORD


def deduplicated(log: DataFrame) -> DataFrame:
    """Records written more than once count once."""
    return log.dropDuplicates(list(RECORD))


#: Records that a task is dealt, where their number is known.
TASK_RECORDS = 250_000


def dealt(rows: DataFrame, *by: str, records: int = 0) -> DataFrame:
    """Rows dealt by columns to as many tasks as the session shuffles to, none merged: the names in quads repeat, so that a
    few shuffled bytes hold many rows, and a task that is filled up to a number of bytes has far more to sort. Where it is
    known that there are up to so many ``records``, more tasks keep each to TASK_RECORDS; joins that follow take over their number."""
    return rows.repartition(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-records // TASK_RECORDS)), *by)


def state(log: DataFrame, at: str | None = None, predicates: Sequence[str] = (), objects: Sequence[str] = (), graphs: Sequence[str] = (), subjects: Sequence[str] = (), by: Sequence[str] = QUAD, records: int = 0) -> DataFrame:
    """(quad, change_id): the quads that hold after all changes up to ``at``, with the last change that speaks of each.

    The record of the greatest change id decides, and in one change an insertion over a deletion. Restrictions and the time
    bound stand below the aggregation, on its grouping columns, so that they reach the scan; an empty one restricts nothing.

    Records are dealt out before they are aggregated: few of a task's records share a quad, and a task over a scan would sort
    the many that a few stored bytes hold. ``by`` names some of a quad's columns to deal by; by subject, a selection that
    follows finds its entities together. ``records`` is the most that there are of them, if known.
    """
    rows = log
    for column, values in (("predicate", predicates), ("object", objects), ("graph", graphs), ("subject", subjects)):
        if values:
            rows = rows.where(F.col(column).isin(*values))
    if at is not None:
        rows = rows.where(F.col("change_id") <= at)
    last = dealt(rows.select(*QUAD, "change_id", "sign"), *by, records=records).groupBy(*QUAD).agg(F.max(F.struct("change_id", "sign")).alias("last"))
    return last.where("last.sign > 0").select(*QUAD, F.col("last.change_id").alias("change_id"))


def change_before(changes: DataFrame, time: Column) -> str | None:
    """The id of the last committed change before a time. None means that there is none: the state is then empty."""
    return changes.where((F.col("status") == "COMMITTED") & (F.col("timestamp") < time)).agg(F.max("id")).first()[0]


def state_at_time(log: DataFrame, changes: DataFrame, time: Column, **restrictions) -> DataFrame:
    """The state before a time; empty before the first change."""
    found = change_before(changes, time)
    return state(log, at=found if found is not None else "", **restrictions)


def of_class(rows: DataFrame, cls: str, types: DataFrame, column: str = "subject") -> DataFrame:
    """The rows whose subject (or object, for a range) is an instance of a class, by the state's type quads."""
    own = types.where((F.col("predicate") == RDF_TYPE) & (F.col("object") == cls)).select(F.col("subject").alias("_instance"))
    return rows.join(own, rows[column] == own["_instance"], "left_semi")


def constrained(rows: DataFrame, constraints: DataFrame, predicates: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The rows of subjects for which some predicate of a list has some value of a list."""
    own = constraints.where(F.col("predicate").isin(*predicates) & F.col("object").isin(*values)).select(F.col("subject").alias("_subject"))
    return rows.join(own, rows["subject"] == own["_subject"], "left_semi")


def inferred(quads: DataFrame, batch: str | None = None, records: int = 0) -> DataFrame:
    """(type_uri, property_uri, property_kind, property_ref): the properties of each class, with the datatypes and classes
    they lead to.

    Types without further properties have a row without one; a link to something untyped leads to rdfs:Resource. Deletions
    don't shrink the schema. With a ``batch`` column only types given in the same batch count; without, all do.
    """
    keys = [batch] if batch else []
    whole = dealt(quads, *keys, "subject", records=records)
    types = whole.where(F.col("predicate") == RDF_TYPE).select(*keys, "subject", F.col("object").alias("type_uri")).distinct()
    held = whole.where(F.col("predicate") != RDF_TYPE).select(*keys, "subject", "predicate", "datatype", F.when(F.col("datatype") == "", F.col("object")).alias("target")).distinct()
    targets = types.withColumnRenamed("subject", "target").withColumnRenamed("type_uri", "target_type")
    # literals come down to a row a property here, links to a row an entity that they lead to
    rows = types.join(held, [*keys, "subject"], "left").select(*keys, "type_uri", "predicate", "datatype", "target").distinct()
    rows = rows.join(targets, [*keys, "target"], "left")
    kind = F.when(F.col("predicate").isNull(), F.lit(None)).when(F.col("datatype") == "", "IRI").otherwise("Literal")
    ref = F.when(F.col("predicate").isNull(), F.lit(None)).when(F.col("datatype") != "", F.col("datatype")).otherwise(F.coalesce("target_type", F.lit(RDFS_RESOURCE)))
    return rows.select("type_uri", F.col("predicate").alias("property_uri"), kind.alias("property_kind"), ref.alias("property_ref")).distinct()


def properties(metadata: DataFrame) -> DataFrame:
    """Each class's properties with the set of what they lead to; rows without a property are left out."""
    return metadata.where("property_uri is not null").groupBy("type_uri", "property_uri").agg(F.sort_array(F.collect_set(F.struct("property_kind", "property_ref"))).alias("refs"))


def field_type(refs: Column) -> Column:
    """What a property is read as: one datatype or class, Resource for several kinds of links, RDFNode for a mixture."""
    links = F.size(F.filter(refs, lambda r: r["property_kind"] == "IRI"))
    return F.when(F.size(refs) == 1, F.get(refs, F.lit(0))["property_ref"]).when(links == F.size(refs), F.lit("Resource")).otherwise(F.lit("RDFNode"))


def records(log: DataFrame, change_id: str | None = None, subjects: Sequence[str] = (), predicates: Sequence[str] = (), objects: Sequence[str] = (), graphs: Sequence[str] = (), sign: int | None = None) -> DataFrame:
    """The records of a change, or of all, that meet every restriction given."""
    rows = log if change_id is None else log.where(F.col("change_id") == change_id)
    for column, values in (("subject", subjects), ("predicate", predicates), ("object", objects), ("graph", graphs)):
        if values:
            rows = rows.where(F.col(column).isin(*values))
    return rows if sign is None else rows.where(F.col("sign") == sign)


def change_counts(log: DataFrame) -> DataFrame:
    """(change_id, inserts, deletes)."""
    one = lambda s: F.sum(F.when(F.col("sign") == s, 1).otherwise(0)).cast("long")
    return log.groupBy("change_id").agg(one(1).alias("inserts"), one(-1).alias("deletes"))


def change_status(history: DataFrame) -> DataFrame:
    """(id, status, error) of changes from history(id, timestamp, status, message): the latest entry's status, and the
    message of the latest entry that ended the change otherwise than by COMMITTED."""
    failed = F.col("status").isin("ASSERTION_FAILED", "VALIDATION_ERROR", "INTERNAL_ERROR", "NO_MATCHES", "TOO_MANY_MATCHES")
    return history.groupBy("id").agg(F.max_by("status", F.struct("timestamp", "status")).alias("status"), F.max_by(F.when(failed, F.col("message")), F.when(failed, F.struct("timestamp", "status"))).alias("error"))

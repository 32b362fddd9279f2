"""Audit rows: queries that ran, and what was created, updated or deleted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The columns of a query's event that come from its request as they are.
REQUEST = ("id", "timestamp", "requesting_user", "pod_id", "slice_id", "slice_tag", "query")


def query_events(requests: DataFrame) -> DataFrame:
    """One event for each row of requests(id, timestamp, requesting_user, pod_id, slice_id, slice_tag, query, at_timestamp,
    at_change_id, errors): FAILED with the first of the errors, else COMPLETED. A query that names neither a time nor a change
    has seen what held when it was asked."""
    failed = F.size(F.coalesce("errors", F.array().cast("array<string>"))) > 0
    seen = F.coalesce("at_timestamp", F.when(F.col("at_change_id").isNull(), F.col("timestamp")))
    return requests.select(
        *REQUEST,
        seen.alias("at_timestamp"),
        "at_change_id",
        F.when(failed, "FAILED").otherwise("COMPLETED").alias("status_code"),
        F.when(failed, F.get("errors", F.lit(0))).alias("message"),
    )


def lifecycle_events(before: DataFrame, after: DataFrame, kind: str) -> DataFrame:
    """(id, event_type): what became of the things of a kind, from tables (id, json) of before and after; ids are distinct.
    What stays the same gives no event."""
    old, new = before.select("id", F.col("json").alias("_old")), after.select("id", F.col("json").alias("_new"))
    both = old.withColumn("_was", F.lit(True)).join(new.withColumn("_is", F.lit(True)), "id", "full")
    what = F.when(F.col("_was").isNull(), "CREATED").when(F.col("_is").isNull(), "DELETED").when(~F.col("_old").eqNullSafe(F.col("_new")), "UPDATED")
    return both.select("id", F.concat(F.lit(f"{kind.upper()}_"), what).alias("event_type")).where("event_type is not null")

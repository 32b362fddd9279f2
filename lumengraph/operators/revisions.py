"""Versioned entities: revisions on branches, tags, lineage; views as such entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAIN, DEFAULT_TAG = "main", "default"


def latest(revisions: DataFrame, branch: str | None = None) -> DataFrame:
    """The newest revision of each entity and branch, from revisions(id, branch, revision_id, ...)."""
    rows = revisions if branch is None else revisions.where(F.col("branch") == branch)
    nth = F.row_number().over(Window.partitionBy("id", "branch").orderBy(F.desc("revision_id")))
    return rows.withColumn("_nth", nth).where(F.col("_nth") == 1).drop("_nth")


def tag_heads(tags: DataFrame) -> DataFrame:
    """(id, tag_name, revision_id, created_at): where each tag points; the newest entry replaces the others."""
    return tags.groupBy("id", "tag_name").agg(F.max_by("revision_id", F.struct("created_at", "revision_id")).alias("revision_id"), F.max("created_at").alias("created_at"))


def tag_listing(tags: DataFrame, entity: str) -> DataFrame:
    """An entity's tags, the newest first."""
    return tag_heads(tags).where(F.col("id") == entity).orderBy(F.desc("created_at"), "tag_name")


def resolved(revisions: DataFrame, tags: DataFrame, tag: str = DEFAULT_TAG) -> DataFrame:
    """(id, revision_id): the revision that a tag serves; for the default tag, else the newest on the main branch."""
    tagged = tag_heads(tags).where(F.col("tag_name") == tag).select("id", F.col("revision_id").alias("_tagged"))
    if tag != DEFAULT_TAG:
        return tagged.select("id", F.col("_tagged").alias("revision_id"))
    head = latest(revisions, MAIN).select("id", "revision_id")
    return head.join(tagged, "id", "full").select("id", F.coalesce("_tagged", "revision_id").alias("revision_id"))


def ahead(revisions: DataFrame, tags: DataFrame) -> DataFrame:
    """(id, branch, revision_id, tag_name, ahead): for each revision the nearest tagged one at or before it on its branch, and
    how many revisions lie between; without such, tag_name is null and ahead counts from the branch's beginning."""
    place = Window.partitionBy("id", "branch").orderBy("revision_id")
    marks = tag_heads(tags).groupBy("id", "revision_id").agg(F.min("tag_name").alias("tag_name"))
    rows = revisions.select("id", "branch", "revision_id").join(marks, ["id", "revision_id"], "left").withColumn("_at", F.row_number().over(place))
    near = place.rowsBetween(Window.unboundedPreceding, 0)
    mark = F.last(F.when(F.col("tag_name").isNotNull(), F.struct("tag_name", "_at")), ignorenulls=True).over(near)
    rows = rows.withColumn("_mark", mark)
    return rows.select("id", "branch", "revision_id", F.col("_mark.tag_name").alias("tag_name"), (F.col("_at") - F.coalesce(F.col("_mark._at"), F.lit(0))).cast("long").alias("ahead"))


def revised(revisions: DataFrame, change: DataFrame) -> DataFrame:
    """The revisions with one more for each row of change(id, branch, revision_id, created_by, json): its parent is the newest
    on its branch. Revisions are never altered."""
    heads = latest(revisions).select("id", "branch", F.col("revision_id").alias("parent_revision_id"))
    return revisions.unionByName(change.join(heads, ["id", "branch"], "left"), allowMissingColumns=True)


def conflicts(revisions: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of new whose id exists already."""
    return new.join(revisions.select("id").distinct(), "id", "left_semi")

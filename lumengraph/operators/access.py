"""Access to hierarchical resources: grants and blocks on a path and those above it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The relations that permit each kind of access.
PERMITS = {"read": ("owner", "reader"), "write": ("owner", "writer"), "delete": ("owner", "deleter")}


def ancestors(path: Column) -> Column:
    """A path and all above it, as structs (path, depth); the root is ``/`` at depth 0."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), n), "/")).alias("path"), n.alias("depth")))


def subject(name: Column) -> Column:
    """Mail addresses as mailto IRIs, IRIs as they are, anything else as a URN."""
    return F.when(name.rlike(r"^[^@\s:/]+@[^@\s/]+$"), F.concat(F.lit("mailto:"), name)).when(name.rlike(r"^[a-z][a-z0-9+.-]*:"), name).otherwise(F.concat(F.lit("urn:"), name))


def check(asked: DataFrame, tuples: DataFrame, access: str = "read") -> DataFrame:
    """asked(subject, path, ...) with ``allowed``, by tuples(subject, relation, path, access_types).

    The nearest grant on the path or above it holds unless a block stands as near or nearer. A conditional grant
    (``external_access``) holds for the access types it lists. Paths are finite, so that no iteration is needed: what stands
    above a path is looked up once for all paths of a folder, so that no row meets the root's tuples but the folders'.
    """
    grant = F.col("relation").isin(*PERMITS[access]) | ((F.col("relation") == "external_access") & F.coalesce(F.array_contains("access_types", access), F.lit(False)))
    stands = tuples.groupBy("subject", "path").agg(F.max(grant).alias("grants"), F.max(F.col("relation") == "blocked").alias("blocks"))
    deepest = lambda where, depth: F.when(F.col(where), depth)
    line = ancestors(F.col("path"))
    ask = asked.withColumn("_own", F.element_at(line, -1)).withColumn("_above", F.try_element_at(line, F.lit(-2))["path"])
    folders = ask.where("_above is not null").select(F.col("subject").alias("_s"), F.col("_above").alias("_folder")).distinct()
    up = folders.select("_s", "_folder", F.explode(ancestors(F.col("_folder"))).alias("_a"))
    met = up.join(stands, (F.col("_s") == F.col("subject")) & (F.col("_a.path") == F.col("path")))
    above = met.groupBy("_s", "_folder").agg(F.max(deepest("grants", F.col("_a.depth"))).alias("_g"), F.max(deepest("blocks", F.col("_a.depth"))).alias("_b"))
    own = stands.select(F.col("subject").alias("_who"), F.col("path").alias("_path"), F.col("grants").alias("_grants"), F.col("blocks").alias("_blocks"))
    out = ask.join(own, (F.col("subject") == F.col("_who")) & (F.col("_own.path") == F.col("_path")), "left")
    out = out.join(above, (F.col("subject") == F.col("_s")) & (F.col("_above") == F.col("_folder")), "left")
    nearest = lambda where, further: F.greatest(deepest(where, F.col("_own.depth")), F.col(further))
    allowed = F.coalesce(nearest("_grants", "_g") > F.coalesce(nearest("_blocks", "_b"), F.lit(-1)), F.lit(False))
    return out.select(*(F.col(f"`{c}`") for c in asked.columns if c != "allowed"), allowed.alias("allowed"))


def needed_access(operation: Column) -> Column:
    """Queries and subscriptions need read access, mutations write access."""
    return F.when(operation == "mutation", "write").otherwise("read")


def decision(internal: Column, external: Column) -> Column:
    """An internal grant decides; else an external verdict, if there is one."""
    return F.when(internal, F.lit(True)).otherwise(F.coalesce(external, F.lit(False)))

"""Documents as named graphs, containers as path prefixes, tenants and their settings."""

from __future__ import annotations

import copy

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumengraph.model import QUAD, XSD

TRIPLE = QUAD[:-1]


def patched(model: DataFrame, deletions: DataFrame, insertions: DataFrame) -> DataFrame:
    """(model without deletions) with insertions; documents are sets."""
    return model.select(*QUAD).subtract(deletions.select(*QUAD)).union(insertions.select(*QUAD)).distinct()


def document(state: DataFrame, graph: str) -> DataFrame:
    return state.where(F.col("graph") == graph)


def replaced(state: DataFrame, graph: str, quads: DataFrame) -> DataFrame:
    """The state with one document's quads in place of what it held; creation and deletion are the same with nothing on one
    side."""
    return state.select(*QUAD).where(F.col("graph") != graph).union(quads.select(*TRIPLE, F.lit(graph).alias("graph"))).distinct()


def containers(path: Column) -> Column:
    """The containers above a path, from the top: all proper prefixes that end in a slash."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), n), "/"), F.when(n > 0, "/").otherwise("")))


def missing_containers(new: DataFrame, existing: DataFrame) -> DataFrame:
    """(path): the containers that new(path) needs and existing(path) lacks."""
    needed = new.select(F.explode(containers(F.col("path"))).alias("path")).distinct()
    return needed.join(existing.select("path"), "path", "left_anti")


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, modified) of a container's files; their content isn't read."""
    return spark.read.format("binaryFile").load(folder).select("path", "length", F.col("modificationTime").alias("modified"))


#: The predicates of what is known of a file.
MTIME, SIZE, MODIFIED = "http://www.w3.org/ns/posix/stat#mtime", "http://www.w3.org/ns/posix/stat#size", "http://purl.org/dc/terms/modified"


def metadata(files: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Quads about documents, from files(path, length, modified) as ``listing`` gives them: when each was last changed, in seconds and
    as a date, and how long it is; with what is stored about those that there are. Stored values of these three give way."""
    cells = [(MTIME, F.unix_timestamp("modified"), "integer"), (MODIFIED, F.date_format(F.to_utc_timestamp("modified", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'"), "dateTime"), (SIZE, F.col("length"), "integer")]
    built = [F.struct(F.lit(p).alias("predicate"), v.cast("string").alias("object"), F.lit(XSD + d).alias("datatype")) for p, v, d in cells]
    own = files.select(F.col("path").alias("subject"), F.explode(F.array(*built)).alias("q")).select("subject", "q.*", F.lit("").alias("language"), F.lit("").alias("graph"))
    if stored is None:
        return own
    kept = stored.select(*QUAD).where(~F.col("predicate").isin(MTIME, MODIFIED, SIZE))
    return own.unionByName(kept.join(files.select(F.col("path").alias("_path")), F.col("subject") == F.col("_path"), "left_semi"))


def bootstrapped(wanted: DataFrame, existing: DataFrame, key: str = "id") -> DataFrame:
    """The existing rows and those of wanted whose key isn't there yet, so that a second start changes nothing. Keys are
    distinct; existing columns that wanted lacks are null."""
    return existing.unionByName(wanted.dropDuplicates([key]).join(existing.select(key), key, "left_anti"), allowMissingColumns=True)


def overlaid(default: dict, override: dict) -> dict:
    """Settings: what an override leaves out comes from the default, what it sets to None is None, maps are merged."""
    out = copy.deepcopy(default)
    for k, v in override.items():
        out[k] = overlaid(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def redacted(settings: dict, paths: tuple[str, ...], mask: str = "***") -> dict:
    """Settings with the values at dotted paths masked."""
    out = copy.deepcopy(settings)
    for p in paths:
        *above, last = p.split(".")
        at = out
        for k in above:
            at = at.get(k) if isinstance(at, dict) else None
        if isinstance(at, dict) and at.get(last) is not None:
            at[last] = mask
    return out


def carried_over(new: dict, old: dict, paths: tuple[str, ...]) -> dict:
    """New settings that keep the old values at dotted paths they leave out."""
    out = copy.deepcopy(new)
    for p in paths:
        *above, last = p.split(".")
        was, at = old, out
        for k in above:
            was = was.get(k) if isinstance(was, dict) else None
            at = at.setdefault(k, {}) if isinstance(at, dict) else None
        if isinstance(was, dict) and isinstance(at, dict) and last in was:
            at.setdefault(last, was[last])
    return out

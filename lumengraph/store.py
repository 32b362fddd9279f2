"""Tables in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_roots: dict[str, str] = {}
#: What the open scratch blocks have written, the innermost last.
_scratch: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """This session's own folder below ``spark.checkpoint.dir``. Where that is unset, a local one serves a session on a single
    machine; on a cluster, whose machines would not see each other's, it is an error."""
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if spark.sparkContext.master.split("[")[0] != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
            base = f"file://{tempfile.mkdtemp(prefix='lumengraph-')}"
        _roots[app] = f"{base.rstrip('/')}/graph-{uuid.uuid4().hex}"
        atexit.register(drop, spark, _roots[app])
    return _roots[app]


def drop(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has ended before; the folder is then left to the cluster's own cleaning
        return


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, stays: bool = False) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, and outlives any executor. One that stays outlives the scratch
    block that it is written in."""
    path = new_path(df.sparkSession, name)
    if _scratch and not stays:
        _scratch[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written within the block go at its end, but for those that stay: what leaves it must not read them."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            drop(spark, path)


def delete_written(df: DataFrame) -> None:
    """Removes a table of ``written`` that no later step reads."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        drop(df.sparkSession, path)

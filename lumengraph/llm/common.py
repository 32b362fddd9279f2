"""What the operators share: training rows, components, byte chunks."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumengraph.store import delete_written, scratch, written

__all__ = ["chunks", "components", "delete_written", "learns", "run_ids", "scratch", "trimmed", "utf8", "without_keys", "written"]

#: Keys of 16 bytes that are broadcast at most; more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000


def learns(doc_id: Column) -> Column:
    """True for the rows that models may learn from: crc32 of the id as text, modulo 4, is not 2."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of edges(a, b): one row (node, root) for each node of an edge; root is the component's smallest node.

    Each round hands every node the smallest label among its neighbours, then lets it jump to its label's label; both are
    joins, and a round's labels are written to the shared folder. Rounds grow with the logarithm of a component's breadth.
    Null nodes and self-loops are ignored; repeated edges count once.
    """
    both = edges.where("a <> b").select("a", "b")
    both = written(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), name)
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), name)
    while True:
        near = (
            both.join(labels, both.b == labels.node)
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("root").alias("offer"))
        )
        step = labels.join(near, "node").select("node", F.least("root", "offer").alias("root"), F.col("root").alias("old"))
        up = labels.select(F.col("node").alias("root"), F.col("root").alias("top"))
        jumped = written(step.join(up, "root", "left").select("node", F.least("root", F.coalesce("top", "root")).alias("root"), "old"), name)
        moved = jumped.where("root <> old").limit(1).count()
        old, labels = labels, jumped.select("node", "root")
        if not moved:
            delete_written(old)
            return labels
        delete_written(old)


def chunks(texts: Iterable[bytes], most: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of whole texts of about ``most`` bytes, with the index of the first; a longer text makes a run of its own."""
    start, size, run = 0, 0, []
    for i, t in enumerate(texts):
        if run and size + len(t) > most:
            yield start, run
            start, size, run = i, 0, []
        run.append(t)
        size += len(t)
    if run:
        yield start, run


def utf8(texts) -> list[bytes]:
    """Texts as UTF-8; null is empty."""
    return [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]


def run_ids(run: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The lengths of the texts in a run, and for each byte the text it belongs to."""
    lengths = np.fromiter(map(len, run), np.int64, len(run))
    return lengths, np.repeat(np.arange(len(run), dtype=np.int32), lengths)


def trimmed() -> None:
    """Hands memory that is free back to the system, since Spark keeps its Python workers from one task to the next."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library, without it
        return


def without_keys(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose key is not among keys(key)."""
    few = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    return rows.join(F.broadcast(keys) if few else keys, "key", "left_anti")

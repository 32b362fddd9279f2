"""Approximate nearest neighbours along several shifted Hilbert curves."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumengraph.llm.common import written

#: Curves, the dimensions vectors are projected to, and the bits of each. A key has DIMENSIONS * BITS bits.
CURVES, DIMENSIONS, BITS = 12, 8, 6
#: Principal axes that each curve's projection is drawn from.
AXES = 16
#: Rows that the axes and bounds are fitted on, and queries that the windows' width is fitted on, both chosen by hash.
BOUND_ROWS, WIDTH_QUERIES = 4096, 128
#: Share of those queries' true neighbours that a window on some curve has to reach.
REACH = 0.95
#: Rows of a block of a curve, and most blocks that queries are gathered from to meet one.
BLOCK, GATHERED = 4096, 16
#: Queries next to each other on a curve that are compared at once.
QUERY_GROUP = 32


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions of cells (rows of small non-negative integers) on the Hilbert curve of that many bits a dimension."""
    axes = [c.astype(np.uint64) for c in cells.T]
    one = np.uint64(1)
    for b in range(bits - 1, 0, -1):
        high, low = np.uint64(1 << b), np.uint64((1 << b) - 1)
        for i in range(len(axes)):
            upper = (axes[i] & high) != 0
            swap = np.where(upper, 0, (axes[0] ^ axes[i]) & low).astype(np.uint64)
            axes[0] = np.where(upper, axes[0] ^ low, axes[0] ^ swap)
            axes[i] = axes[i] ^ swap if i else axes[0]
    for i in range(1, len(axes)):
        axes[i] = axes[i] ^ axes[i - 1]
    gray = np.zeros(len(cells), np.uint64)
    for b in range(bits - 1, 0, -1):
        gray ^= np.where((axes[-1] >> np.uint64(b)) & one, np.uint64((1 << b) - 1), np.uint64(0))
    key = np.zeros(len(cells), np.uint64)
    for b in range(bits - 1, -1, -1):
        for a in axes:
            key = (key << one) | (((a ^ gray) >> np.uint64(b)) & one)
    return key.astype(np.int64)


def usable(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v): one finite, non-zero vector of doubles an id (the least of those)."""
    v = F.col(vector_col).cast("array<double>")
    fine = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    kept = rows.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), fine.alias("fine")).where(F.coalesce("fine", F.lit(False)) & F.col("vec_id").isNotNull())
    return written(kept.groupBy("vec_id").agg(F.min("v").alias("v")), "vectors")


def _stack(column) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.zeros((0, 0))


def _nearest(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> pd.DataFrame:
    """Each query's k nearest among vectors, by exact distance, ties to the smaller id; no query's own row."""
    out = []
    rough = (queries**2).sum(1)[:, None] + (vectors**2).sum(1) - 2 * queries @ vectors.T
    rough[query_ids[:, None] == ids] = np.inf
    for q, row, d in zip(query_ids.tolist(), queries, rough, strict=True):
        most = np.partition(d, k - 1)[k - 1] if len(d) > k else np.inf
        near = np.flatnonzero((d <= most + 1e-9 * (1 + abs(most))) & np.isfinite(d)) if np.isfinite(most) else np.flatnonzero(np.isfinite(d))
        exact = np.sqrt(((vectors[near] - row) ** 2).sum(1))
        first = np.lexsort((ids[near], exact))[:k]
        out.append(pd.DataFrame({"query_id": q, "vec_id": ids[near][first], "score": exact[first]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})


FOUND = "query_id long, vec_id long, score double"


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def brute_force(vectors: DataFrame, query_ids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    """The exact neighbours of a bounded set of queries."""
    sent = vectors.sparkSession.sparkContext.broadcast((query_ids, queries))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, q = sent.value
        for b in batches:
            for i in range(0, len(b), BLOCK):
                part = b.iloc[i : i + BLOCK]
                yield _nearest(part["vec_id"].to_numpy(), _stack(part["v"]), own, q, k)

    return _best(vectors.mapInPandas(run, FOUND), k)


def ranked(vectors: DataFrame, curves: int = CURVES, seed: int = 11) -> DataFrame:
    """(curve, rank, vec_id): every row's place, from 0, on each curve.

    A curve has a projection and a shift of its own: random directions among the principal axes of a sample. Rows are
    range-partitioned and sorted by key; a row's place is its place in its partition behind the rows of the partitions before.
    """
    spark = vectors.sparkSession
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(BOUND_ROWS).select("v").toPandas()["v"]
    width = len(sample.iloc[0])
    rng = np.random.default_rng(seed)
    maps = []
    some = _stack(sample)
    _, turn = np.linalg.eigh(np.cov(some.T).reshape(width, width)) if len(some) > 1 else (None, np.eye(width))
    main = turn[:, ::-1][:, :AXES]
    for _ in range(curves):
        axes = main @ np.linalg.qr(rng.normal(size=(main.shape[1], min(DIMENSIONS, main.shape[1]))))[0]
        y = some @ axes
        low, high = y.min(0), y.max(0)
        span = np.maximum(high - low, 1e-12) * 1.3
        maps.append((axes, low - rng.random(axes.shape[1]) * span * 0.2, span))
    sent = spark.sparkContext.broadcast(maps)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = _stack(b["v"])
            for c, (axes, low, span) in enumerate(sent.value):
                cells = np.clip((x @ axes - low) / span * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
                yield pd.DataFrame({"curve": np.int32(c), "key": hilbert_keys(cells, BITS), "vec_id": b["vec_id"]})

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = vectors.mapInPandas(run, "curve int, key long, vec_id long")
    in_order = keys.repartitionByRange(parts, "curve", "key", "vec_id").sortWithinPartitions("curve", "key", "vec_id")
    placed = written(in_order.select("curve", "vec_id", F.monotonically_increasing_id().alias("at")).withColumn("part", F.shiftright("at", 33)), "curve-order")
    counts = placed.groupBy("curve", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))  # a row a curve and partition
    before = Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    start = counts.select("curve", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return placed.join(F.broadcast(start), ["curve", "part"]).select("curve", (F.col("at") + F.col("shift")).alias("rank"), "vec_id")


def window_width(vectors: DataFrame, ranks: DataFrame, queries: DataFrame, k: int) -> int:
    """How far apart a query and its neighbours stand on their best curve, for REACH of a sample's true neighbours."""
    some = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(WIDTH_QUERIES).toPandas()
    true = brute_force(vectors, some["vec_id"].to_numpy(), _stack(some["v"]), k)
    a = ranks.select("curve", F.col("vec_id").alias("query_id"), F.col("rank").alias("a"))
    near = true.select("query_id", "vec_id").join(ranks.select("curve", "vec_id", F.col("rank").alias("b")), "vec_id").join(a, ["curve", "query_id"])
    apart = near.groupBy("query_id", "vec_id").agg(F.min(F.abs(F.col("a") - F.col("b"))).alias("apart"))
    return int(apart.agg(F.coalesce(F.percentile("apart", REACH), F.lit(0))).first()[0]) + 1


def search(vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", curves: int = CURVES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of all other rows for every row that is_query (a condition on vec_id) picks.

    score is the Euclidean distance of the original vectors in double precision; ties go to the smaller id. On each curve a
    query is compared with the rows in a window around its own place, and what the curves find is merged and ranked by exact
    distance. The window's width is fitted so that a sample of queries finds REACH of its true neighbours: data without any
    structure make it wide, and then much is compared. Vectors that are null, zero, or that hold null or non-finite numbers
    take no part, nor do null ids; vectors of another length have no distance to a query, so that each length is searched
    by itself; of rows with one id the least vector counts. With fewer than k candidates all are found; an empty table gives
    an empty table.
    """
    clean = usable(vectors, id_col, vector_col)
    lengths = sorted(r.n for r in clean.select(F.size("v").alias("n")).distinct().collect())
    if len(lengths) < 2:
        return _search(clean, is_query, k, curves)
    return reduce(DataFrame.union, (_search(clean.where(F.size("v") == n), is_query, k, curves) for n in lengths))


def _search(clean: DataFrame, is_query, k: int, curves: int) -> DataFrame:
    """search among vectors of one length."""
    queries = clean.where(is_query(F.col("vec_id")))
    n, n_queries = clean.count(), queries.count()
    if not n_queries:
        return clean.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    ranks = written(ranked(clean, curves), "curve-ranks")
    width = window_width(clean, ranks, queries, k)
    # a block meets the queries of so long a stretch of the curve at a time; where all rows are queries that is a few blocks
    stretch = BLOCK * min(GATHERED, max(1, n // n_queries))
    block = lambda place: F.floor(place / BLOCK)
    group = lambda place: F.floor(F.greatest(place, F.lit(0)) / stretch)
    blocks = F.sequence(block(F.greatest(F.col("rank") - width, F.lit(0))), block(F.col("rank") + width))
    asked = ranks.join(queries, "vec_id").select("curve", F.explode(blocks).alias("block"), group(F.col("rank")).alias("group"), "rank", "vec_id", "v")
    asked = written(asked, "curve-queries")
    begin = block(F.col("rank")) * BLOCK
    there = ranks.join(clean, "vec_id").select("curve", block(F.col("rank")).alias("block"), F.explode(F.sequence(group(begin - width), group(begin + BLOCK - 1 + width))).alias("group"), "rank", "vec_id", "v")

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        if not len(a) or not len(b):
            return none
        a, b = a.sort_values("rank"), b.sort_values("rank")
        own, vectors, ids, asking = _stack(a["v"]), _stack(b["v"]), b["vec_id"].to_numpy(), a["vec_id"].to_numpy()
        first = np.searchsorted(b["rank"], a["rank"] - width)
        past = np.searchsorted(b["rank"], a["rank"] + width, "right")
        parts = []
        for i in range(0, len(a), QUERY_GROUP):
            lo, hi = int(first[i]), int(past[min(i + QUERY_GROUP, len(a)) - 1])
            parts.append(_nearest(ids[lo:hi], vectors[lo:hi], asking[i : i + QUERY_GROUP], own[i : i + QUERY_GROUP], k))
        return pd.concat(parts) if parts else none

    keys = ["curve", "block", "group"]
    return _best(asked.groupBy(*keys).cogroup(there.groupBy(*keys)).applyInPandas(meet, FOUND), k)

"""Quality scores from a linear classifier over naive Bayes features (NBSVM)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumengraph.llm.common import chunks, learns, utf8

#: Byte n-gram lengths, and buckets they are hashed to.
GRAMS, BUCKETS = (1, 2, 3, 4), 1 << 16
#: Lengths of the n-grams that are one word repeated.
REPEATS = (2, 3, 4, 6, 9, 14, 22)
#: Most training rows of each class; which ones is settled by a hash of the id.
SAMPLE_PER_CLASS = 3000
#: Smoothing of the counts, cost of a violated margin, passes of the coordinate descent.
ALPHA, COST, PASSES = 1.0, 1.0, 15


def indicators(texts: list[bytes]) -> Iterator[np.ndarray]:
    """The sorted buckets of each text's n-grams. The first buckets stand for n-grams of one word, over and over, by length."""
    for t in texts:
        a = np.frombuffer(b" " + t + b" ", np.uint8).astype(np.uint64)
        seen = np.zeros(BUCKETS, bool)
        code = np.zeros(len(a), np.uint64)
        for n in range(1, max(GRAMS) + 1):
            code = (code[: len(a) - n + 1] << np.uint64(8)) | a[n - 1 :]
            if n in GRAMS:
                h = (code + np.uint64(n << 40)) * np.uint64(0x9E3779B97F4A7C15)
                seen[(h >> np.uint64(48)).astype(np.int64)] = True
        seen[: len(REPEATS)] = False
        words = t.split()
        same = np.fromiter((x == y for x, y in zip(words, words[1:], strict=False)), bool, max(0, len(words) - 1))
        if same.any():
            edges = np.flatnonzero(np.diff(np.concatenate(([0], same.astype(np.int8), [0]))))
            longest = int((edges[1::2] - edges[::2]).max()) + 1
            seen[: len(REPEATS)] = longest >= np.array(REPEATS)
        yield np.flatnonzero(seen)


def fit(rows: list[np.ndarray], labels: list[int]) -> tuple[np.ndarray, float, float, float]:
    """(weights, bias, slope, offset): weights by bucket for indicators, and the logistic curve from margins to scores.

    Indicators are scaled by the log ratio of their smoothed class frequencies; the hinge-loss model over them is found by
    dual coordinate descent.
    """
    y = np.where(np.array(labels) == 1, 1.0, -1.0)
    good, bad = np.full(BUCKETS, ALPHA), np.full(BUCKETS, ALPHA)
    for r, s in zip(rows, y, strict=True):
        (good if s > 0 else bad)[r] += 1
    ratio = np.log(good / (y > 0).sum().clip(1)) - np.log(bad / (y < 0).sum().clip(1))
    scale = [1 / max(1e-9, np.sqrt((ratio[r] ** 2).sum() + 1)) for r in rows]
    w, b, alpha = np.zeros(BUCKETS), 0.0, np.zeros(len(rows))
    balance = np.where(y > 0, len(y) / max(1, 2 * (y > 0).sum()), len(y) / max(1, 2 * (y < 0).sum()))
    rng = np.random.default_rng(7)
    for _ in range(PASSES):
        for i in rng.permutation(len(rows)):
            r, s = rows[i], scale[i]
            x = ratio[r] * s
            gradient = y[i] * (w[r] @ x + b * s) - 1
            new = min(max(alpha[i] - gradient, 0.0), COST * balance[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[r] += step * x
                b += step * s
                alpha[i] = new
    margins = np.array([(w[r] @ ratio[r] + b) * s for r, s in zip(rows, scale, strict=True)])
    target = np.where(y > 0, ((y > 0).sum() + 1) / ((y > 0).sum() + 2), 1 / ((y < 0).sum() + 2))
    slope, offset = 2.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-(slope * margins + offset)))
        g = np.array([((p - target) * margins).sum() + 1e-3 * slope, (p - target).sum()])
        v = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(v * margins * margins).sum() + 1e-3, (v * margins).sum()], [(v * margins).sum(), v.sum() + 1e-6]])
        move = np.linalg.solve(h, g)
        slope, offset = slope - move[0], offset - move[1]
        if abs(move).max() < 1e-9:
            break
    return np.stack([w * ratio, ratio**2]), b, float(slope), float(offset)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = SAMPLE_PER_CLASS):
    """The model learned from at most ``most`` labelled texts of each class whose ids may be learned from; None if a class
    has none. Of several labels of one id the lowest counts; null labels and texts are left out."""
    marked = labels.where(F.col(label_col).isNotNull() & F.coalesce(learns(F.col(id_col)), F.lit(False))).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("label"))
    picked = None
    for k in (0, 1):
        own = marked.where(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(most)
        picked = own if picked is None else picked.union(own)
    pairs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null").join(F.broadcast(picked), "id")

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "label": b["label"], "f": [x.astype(np.uint16).tobytes() for x in indicators(utf8(b["text"]))]})

    got = pairs.select("id", "label", "text").mapInPandas(features, "id long, label int, f binary").collect()
    got.sort(key=lambda r: (r.id, bytes(r.f)))
    if len({r.label for r in got}) < 2:
        return None
    return fit([np.frombuffer(bytes(r.f), np.uint16).astype(np.int64) for r in got], [r.label for r in got])


def score(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every row of docs: how likely label 1 is, from 0 to 1. A null text counts as empty; without a
    model each score is 0.5. Texts are read whole, however long; repeated rows and null ids are kept, and other columns are not
    looked at; an empty table gives an empty table."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if model is None:
        return rows.select("doc_id", F.lit(0.5).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(zlib.compress(cloudpickle.dumps(model), 1))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables, bias, slope, offset = cloudpickle.loads(zlib.decompress(sent.value))
        for b in batches:
            out = np.empty(len(b))
            for start, part in chunks(utf8(b["text"])):
                for i, f in enumerate(indicators(part)):
                    raw, norm = tables[:, f].sum(1)
                    out[start + i] = (raw + bias) / np.sqrt(norm + 1)
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "score": 1 / (1 + np.exp(-np.clip(slope * out + offset, -700, 700)))})

    return rows.mapInPandas(run, "doc_id long, score double")

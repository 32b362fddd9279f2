"""Benchmark decontamination by latent semantic retrieval, confirmed by longest common subsequences and answers."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumengraph.llm.common import trimmed, without_keys, written

#: Words of a passage of a text, and the words from one passage to the next. Longer items are cut into passages of as many.
PASSAGE, STRIDE = 48, 16
#: Most latent dimensions, and the spare ones of the randomised factorisation.
RANK, SPARE = 256, 8
#: Items of which a passage has less than this share of its weight in the latent space are searched for in groups of up to
#: RANK passages, whose own space holds them whole; and such groups in one round over the encoded documents.
SHARE, ROUND_GROUPS = 0.9, 8
#: Least cosine of a candidate, and least share of an item's weight that it holds; least share of an item's words in order
#: for a copy, and for a paraphrase with the answer.
COSINE, WEIGHT, COPY, PARAPHRASE = 0.45, 0.2, 0.8, 0.5
#: Words at an item's end that stand for its answer where none is given.
ANSWER_WORDS = 6
#: Items that are searched for at once; bounds what is broadcast. More items take more rounds over the encoded documents.
BLOCK_ITEMS = 20_000

_words = re.compile(r"\w+").findall


def words(text: str | None) -> list[str]:
    return _words(text.lower()) if text else []


def encoded(docs: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """(doc_id, key, n, ids): each text as the numbers of its words, -1 for words outside the vocabulary, compressed."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, squeeze = sent.value.get, zstandard.ZstdCompressor(1)
        for b in batches:
            counts, packed = [], []
            for t in b.column(2):
                ids = np.array([get(w, -1) for w in words(t.as_py())], np.int32)
                counts.append(len(ids) if (ids >= 0).any() else 0)
                packed.append(squeeze.compress(ids.tobytes()) if counts[-1] else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(counts, pa.int32()), pa.array(packed, pa.binary())], ["doc_id", "key", "n", "ids"])
        trimmed()

    return docs.select("doc_id", "key", "text").mapInArrow(run, "doc_id long, key binary, n int, ids binary")


def _ids(packed: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.int32)


def document_counts(coded: DataFrame, size: int) -> np.ndarray:
    """For each term of the vocabulary, the documents that hold it; over all of them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size, np.int64)
        for b in batches:
            for p in b["ids"]:
                held = np.unique(_ids(p))
                total[held[held >= 0]] += 1
        term = np.flatnonzero(total)
        yield pd.DataFrame({"term": term.astype(np.int32), "n": total[term]})

    got = coded.where("n > 0").select("ids").mapInPandas(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size, np.int64)
    out[got["term"].to_numpy(np.int64)] = got["n"]
    return out


def latent_terms(passages: DataFrame, size: int, passage_count: int, rank: int = RANK, seed: int = 3) -> np.ndarray:
    """The terms' latent directions (terms by rank): right singular vectors of the TF-IDF matrix of passages(terms, weights).

    A randomised factorisation in two passes: each task multiplies its rows with the current basis and back, the products
    are summed term by term, and only arrays of terms by rank meet at the driver.
    """
    width = min(rank + SPARE, passage_count, size)

    def both_ways(basis: np.ndarray) -> np.ndarray:
        sent = passages.sparkSession.sparkContext.broadcast(basis)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total, hit = np.zeros(sent.value.shape), np.zeros(len(sent.value), bool)
            for b in batches:
                for terms, weights in zip(b["terms"], b["weights"], strict=True):
                    total[terms] += np.outer(weights, weights @ sent.value[terms])
                    hit[terms] = True
            term = np.flatnonzero(hit)
            yield pd.DataFrame({"term": term.astype(np.int32), "row": [x.tobytes() for x in total[term]]})

        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total: dict[int, np.ndarray] = {}
            for b in batches:
                for term, row in zip(b["term"], b["row"], strict=True):
                    total[term] = total[term] + np.frombuffer(row) if term in total else np.frombuffer(row)
            yield pd.DataFrame({"term": np.array(list(total), np.int32), "row": [x.tobytes() for x in total.values()]})

        sums = passages.mapInPandas(run, "term int, row binary").repartition("term").mapInPandas(add, "term int, row binary").collect()
        out = np.zeros(basis.shape)
        for term, row in sums:
            out[term] = np.frombuffer(row)
        return out

    basis = np.random.default_rng(seed).normal(size=(size, width))
    for _ in range(2):
        basis = np.linalg.qr(both_ways(basis))[0]
    values, turn = np.linalg.eigh(basis.T @ both_ways(basis))
    kept = np.argsort(-values)[: min(rank, int((values > values.max() * 1e-9).sum()))]
    return basis @ turn[:, kept]


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, a bit of an integer for each element of a."""
    at: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b.tolist():
        if same := at.get(y):
            u = row & same
            row = (row + u | row - u) & full
    return len(a) - row.bit_count()


def _contains(text: np.ndarray, part: np.ndarray) -> bool:
    if not len(part) or len(part) > len(text):
        return False
    return bool((np.lib.stride_tricks.sliding_window_view(text, len(part)) == part).all(1).any())


def _confirmed(ids: np.ndarray, x: np.ndarray, cut: dict[int, np.ndarray], answer: np.ndarray, met: list[tuple[float, float, int, int]]) -> tuple[float, float, bool] | None:
    """(cosine, share, answer) of the first candidate (weight, cosine, first word, passage) at which a text holds an item's
    words x, or, of an item that is cut, the words of the passage that was met.

    Once the first one fails, candidates whose words overlap are merged into stretches: where a whole stretch holds too few
    of the item's words in order, none of its candidates holds more.
    """
    reach = lambda start, n: (max(0, start - n), start + PASSAGE + n)
    tried: set[tuple[int, int]] = set()
    hopeless: set[int] = set()
    for n, (_, cosine, start, passage) in enumerate(met):
        if n == 1 and not cut:
            stretches: list[list[int]] = []
            for at in sorted({m[2] for m in met} - {t[0] for t in tried}):
                if stretches and reach(at, len(x))[0] < reach(stretches[-1][-1], len(x))[1]:
                    stretches[-1].append(at)
                else:
                    stretches.append([at])
            for own in stretches:
                if common_subsequence(x, ids[reach(own[0], len(x))[0] : reach(own[-1], len(x))[1]]) < PARAPHRASE * len(x):
                    hopeless.update(own)
        if start in hopeless:
            continue
        for which, wanted in ((-1, x), *([(passage, cut[passage])] if cut else [])):
            if (start, which) in tried:
                continue
            tried.add((start, which))
            part = ids[slice(*reach(start, len(wanted)))]
            share = common_subsequence(wanted, part) / len(wanted)
            said = _contains(part, answer)
            if share >= COPY or share >= PARAPHRASE and said:
                return cosine, share, said
    return None


def _passages(ids: list[int]) -> list[list[int]]:
    if len(ids) <= PASSAGE + STRIDE:
        return [ids]
    return [ids[min(i, len(ids) - PASSAGE) : min(i, len(ids) - PASSAGE) + PASSAGE] for i in range(0, len(ids), PASSAGE)]


def _rounds(items: list[list[int]]) -> list[list[list[int]]]:
    """Rounds of groups of up to RANK passages each, for the passages of each item; those of one item share a round."""
    rounds, groups = [], [[]]
    for own in items:
        if len(groups) > ROUND_GROUPS or len(groups) == ROUND_GROUPS and len(groups[-1]) + len(own) > RANK:
            rounds.append(groups)
            groups = [[]]
        for p in own:
            if len(groups[-1]) == RANK:
                groups.append([])
            groups[-1].append(p)
    return [*rounds, groups] if groups[-1] else rounds


FOUND = "doc_id long, key binary, item_id long, cosine double, lcs double, answer boolean"


def _search(docs: DataFrame, items: list[tuple[int, list[str], list[str]]]) -> DataFrame:
    """The confirmed pairs with a block of items (item_id, words, answer's words)."""
    spark = docs.sparkSession
    vocabulary = {w: i for i, w in enumerate(sorted({w for _, x, _ in items for w in x}))}
    size = len(vocabulary)
    coded = written(encoded(docs, vocabulary), "encoded")
    n_docs = max(1, coded.count())
    held = document_counts(coded, size)
    numbers = [(item, np.array([vocabulary[w] for w in x], np.int32), np.array([vocabulary.get(w, -1) for w in y], np.int32)) for item, x, y in items]
    idf = np.log((1 + n_docs) / (1 + held)) + 1e-3  # terms that all documents hold weigh next to nothing, but take part
    rows, owner, norms = [], [], []
    cut: dict[int, dict[int, np.ndarray]] = {}  # the passages of items that are cut
    for i, (_, x, _) in enumerate(numbers):
        own = _passages(x.tolist())
        for p in own:
            terms, n = np.unique(np.array(p), return_counts=True)
            weights = n * idf[terms]
            if norm := float(np.sqrt((weights**2).sum())):
                if len(own) > 1:
                    cut.setdefault(i, {})[len(rows)] = np.array(p, np.int32)
                rows.append((terms, weights / norm))
                owner.append(i)
                norms.append(norm)
    if not rows:
        return spark.createDataFrame([], FOUND)
    passages = spark.createDataFrame([(t.tolist(), w.tolist()) for t, w in rows], "terms array<int>, weights array<double>").repartition(max(1, len(rows) // 500))
    latent = latent_terms(passages, size, len(rows), RANK)
    weak = {owner[i] for i, (t, w) in enumerate(rows) if np.linalg.norm(w @ latent[t]) < SHARE}
    of_weak: dict[int, list[int]] = {}
    for i, o in enumerate(owner):
        if o in weak:
            of_weak.setdefault(o, []).append(i)
    strong = [i for i, o in enumerate(owner) if o not in weak]

    def group(own: list[int], latent: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """What a group of passages is searched for with: the numbers of its terms, their directions, the passages' directions,
        their numbers and items, and the least weights. Without latent directions it gets its own, which hold all of its passages."""
        used = np.unique(np.concatenate([rows[i][0] for i in own]))
        at = np.full(size, -1, np.int32)
        at[used] = np.arange(len(used))
        if latent is None:
            whole = np.zeros((len(own), len(used)))
            for k, i in enumerate(own):
                whole[k, at[rows[i][0]]] = rows[i][1]
            values, turn = np.linalg.eigh(whole @ whole.T)
            held = values > values.max() * 1e-9
            directions = whole.T @ (turn[:, held] / np.sqrt(values[held]))
        else:
            directions = latent[used]
        table = np.stack([rows[i][1] @ directions[at[rows[i][0]]] for i in own]).astype(np.float32)
        length = np.maximum(np.linalg.norm(table, axis=1), 1e-9)
        least = (WEIGHT * length * np.array([norms[i] for i in own])).astype(np.float32)
        return at, (directions * idf[used, None]).astype(np.float32), table / length[:, None], np.array(own), np.array([owner[i] for i in own]), least

    k = PASSAGE // STRIDE

    def meets(ids: np.ndarray, number: np.ndarray, terms: np.ndarray, table: np.ndarray, passage: np.ndarray, owner: np.ndarray, least: np.ndarray) -> Iterator[tuple[int, float, float, int, int]]:
        """(item, weight, cosine, window, passage) of the windows of a text that come near a passage of a group."""
        at = np.flatnonzero((ids >= 0) & (number[ids] >= 0))
        if not len(at):
            return
        strips, first = np.unique(at // STRIDE, return_index=True)
        sums = np.zeros((int(strips[-1]) + k, terms.shape[1]), np.float32)
        sums[strips] = np.add.reduceat(terms[number[ids[at]]], first, axis=0)
        n = len(sums) - k + 1
        window = sums[:n].copy()
        for j in range(1, k):
            window += sums[j : n + j]
        heavy = np.flatnonzero(np.einsum("ij,ij->i", window, window) >= least.min() ** 2)
        for start in range(0, len(heavy), 1 << 14):
            some = heavy[start : start + (1 << 14)]
            weight, size = window[some] @ table.T, np.linalg.norm(window[some], axis=1)
            for i, j in zip(*np.nonzero((weight >= COSINE * size[:, None]) & (weight >= least)), strict=True):
                yield int(owner[j]), float(weight[i, j]), float(weight[i, j] / size[i]), int(some[i]), int(passage[j])

    def candidates(ids: np.ndarray, groups: list[tuple[np.ndarray, ...]]) -> dict[int, list[tuple[float, float, int, int]]]:
        """(weight, cosine, first word, passage) of the passages of a text that come near an item, by item: first those that are the
        heaviest of all that overlap them, then the others, each the heaviest first."""
        near: dict[int, list[tuple[float, float, int, int]]] = {}
        for g in groups:
            for item, *met in meets(ids, *g):
                near.setdefault(item, []).append(tuple(met))
        out = {}
        for item, all_ in near.items():
            most: dict[int, float] = {}
            for w, _, i, _ in all_:
                most[i] = max(w, most.get(i, 0.0))
            peak = [all(w >= most.get(i + d, 0.0) for d in range(1 - k, k)) for w, _, i, _ in all_]
            out[item] = [(w, c, i * STRIDE, p) for _, (w, c, i, p) in sorted(zip(peak, all_, strict=True), reverse=True)]
        return out

    def search(groups: list[tuple[np.ndarray, ...]], last: bool) -> DataFrame:
        sent = spark.sparkContext.broadcast(zlib.compress(cloudpickle.dumps((groups, numbers, cut)), 1))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            groups, numbers, cut = cloudpickle.loads(zlib.decompress(sent.value))
            for b in batches:
                out = []
                for doc, key, packed in zip(b["doc_id"], b["key"], b["ids"], strict=True):
                    ids = _ids(packed)
                    for i, met in candidates(ids, groups).items():
                        item, x, answer = numbers[i]
                        if held := _confirmed(ids, x, cut.get(i, {}), answer, met):
                            out.append((doc, key, item, *held))
                yield pd.DataFrame(out, columns=["doc_id", "key", "item_id", "cosine", "lcs", "answer"]).astype({"doc_id": "Int64", "item_id": "int64", "cosine": "float64", "lcs": "float64", "answer": "bool"})
            trimmed()

        found = coded.where("n > 0").select("doc_id", "key", "ids").mapInPandas(run, FOUND)
        if last:
            return found
        found = written(found, "found")
        sent.destroy()
        return found

    rounds = ([[strong]] if strong else []) + _rounds(list(of_weak.values()))
    each = [search([group(own, latent if own is strong else None) for own in groups], n == len(rounds)) for n, groups in enumerate(rounds, 1)]
    return reduce(DataFrame.unionByName, each)


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", answer_col: str | None = None) -> DataFrame:
    """(doc_id, key, item_id, cosine, lcs, answer): the pairs of a row of docs and an item that it holds.

    Passages of the texts and of the items are compared in a latent space of the items' terms, weighted by how few documents
    hold them. A candidate counts as a copy if its longest common subsequence covers COPY of the item's words, and as a
    paraphrase from PARAPHRASE on if the answer (an item's last words, if there is no such column) stands there in one
    piece; so does one that covers as much of a passage, of an item that is longer than one: such an item leaks in part, and
    lcs is then the passage's share. key is the MD5 of the text, so that rows can be told by their texts. Texts are searched whole,
    however long; other columns are not looked at. Items without a word, null items and null texts give nothing; a repeated
    row gives its pairs each time; empty tables give an empty table.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")))).alias("key"), F.col(text_col).alias("text"))
    picked = benchmark.where(F.col(item_text_col).isNotNull() & F.col(item_col).isNotNull()).select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text"), (F.col(answer_col) if answer_col else F.lit(None).cast("string")).alias("answer")).distinct()
    blocks = max(1, math.ceil(picked.count() / BLOCK_ITEMS))
    out = spark.createDataFrame([], FOUND)
    for k in range(blocks):
        own = picked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        items = sorted((r.item_id, x, words(r.answer) or x[-ANSWER_WORDS:]) for r in own if (x := words(r.text)))
        if items:
            out = out.unionByName(_search(rows, items)) if blocks > 1 else _search(rows, items)
    return out


def without_leaks(docs: DataFrame, found: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, whose text holds no item, by the keys of ``leaks``, which are reckoned here."""
    keys = written(found.select("key").distinct(), "leaking", stays=True)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.unhex(F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))).alias("key"))
    return without_keys(rows, keys).select(*(F.col("row")[c].alias(c) for c in docs.columns))

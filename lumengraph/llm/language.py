"""Language identification by prediction by partial matching (PPM, escape method C) over bytes."""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumengraph.llm.common import chunks, learns, run_ids, trimmed, utf8

#: Longest context in bytes. A text is read as if this many line feeds stood before it.
ORDER = 3
#: Most training texts of each language; which ones is settled by a hash of the text. Bounds the model's size.
SAMPLE_PER_LANGUAGE = 400
#: Parts that a language's texts are ranked in before the best of them are ranked as one.
RANKED_PARTS = 16


@dataclass
class Contexts:
    """The context trees of all languages, folded into tables.

    symbol maps a byte to its column; all bytes that no language has seen share one, since no tree tells them apart. A node
    is a context of up to ORDER bytes that some language has seen; one, two and step lead from the last bytes to the longest
    such node. bits[node, symbol, language] is the exact code length of the symbol there: escapes down to the longest
    context of that language that knows the symbol, in the end one of 256 bytes.
    """

    languages: list[str]
    symbol: np.ndarray
    two: np.ndarray
    step: np.ndarray
    bits: np.ndarray


def train_counts(rows: list[tuple[str, str]]) -> dict[str, list[dict[bytes, dict[int, int]]]]:
    """For each language, by context length, the counts of the bytes that followed each context."""
    trees: dict[str, list[dict[bytes, dict[int, int]]]] = {}
    for lang, text in rows:
        tree = trees.setdefault(lang, [{} for _ in range(ORDER + 1)])
        data = b"\n" * ORDER + utf8([text])[0]
        a = np.frombuffer(data, np.uint8).astype(np.uint32)
        for k in range(ORDER + 1):
            code = np.zeros(len(a) - ORDER, np.uint32)
            for j in range(k + 1):
                code |= a[ORDER - j : len(a) - j] << np.uint32(8 * j)
            for g, n in zip(*np.unique(code, return_counts=True), strict=True):
                g = int(g)
                follow = tree[k].setdefault((g >> 8).to_bytes(k, "big"), {})
                follow[g & 255] = follow.get(g & 255, 0) + int(n)
    return trees


def fold(trees: dict[str, list[dict[bytes, dict[int, int]]]]) -> Contexts:
    languages = sorted(trees)
    seen = sorted({s for t in trees.values() for s in t[0].get(b"", {})} | set(b"\n"))  # a text's context begins with line feeds
    symbol = np.full(256, len(seen), np.int32)
    symbol[seen] = np.arange(len(seen))
    width = len(seen) + 1
    contexts = sorted({c for t in trees.values() for level in t for c in level}, key=lambda c: (len(c), c))
    node = {c: i for i, c in enumerate(contexts)}
    bits = np.empty((len(contexts), width, len(languages)), np.float32)
    for i, c in enumerate(contexts):
        for k, lang in enumerate(languages):
            tree = trees[lang]
            shorter = bits[node[c[1:]], :, k] if c else np.full(width, 8.0, np.float32)
            follow = tree[len(c)].get(c)
            if follow is None:
                bits[i, :, k] = shorter
                continue
            total, kinds = sum(follow.values()), len(follow)
            bits[i, :, k] = shorter + np.float32(np.log2((total + kinds) / kinds))
            for s, n in follow.items():
                bits[i, symbol[s], k] = np.log2((total + kinds) / n)

    def longest(c: bytes) -> int:
        while c not in node:
            c = c[1:]
        return node[c]

    names = [*(bytes([s]) for s in seen), None]
    two = np.array([[0 if y is None else longest((x or b"") + y if x else y) for y in names] for x in names], np.int32)
    short = [c for c in contexts if len(c) < ORDER]
    step = np.zeros((len(short), width), np.int32)
    for i, c in enumerate(short):
        for s, name in enumerate(names):
            step[i, s] = longest(c + name) if name else 0
    return Contexts(languages, symbol, two, step, bits)


def code_lengths(m: Contexts, run: list[bytes]) -> np.ndarray:
    """Bits that each language takes for each text: an array of texts by languages."""
    lengths, _ = run_ids(run)
    pad = b"\n" * ORDER
    a = m.symbol[np.frombuffer(b"".join(pad + t for t in run), np.uint8)]
    node = m.step[m.two[a[:-3], a[1:-2]], a[2:-1]]
    rows = m.bits.reshape(-1, len(m.languages))[node.astype(np.int64) * m.bits.shape[1] + a[3:]]
    ends = np.cumsum(lengths + ORDER)
    out = np.zeros((len(run), len(m.languages)))
    for i, (e, n) in enumerate(zip(ends.tolist(), lengths.tolist(), strict=True)):
        out[i] = rows[e - ORDER - n : e - ORDER].sum(0, dtype=np.float64)
    return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = SAMPLE_PER_LANGUAGE) -> Contexts | None:
    """The trees learned from at most ``most`` labelled texts a language; None where no row may be learned from.

    Only rows with a text, a language, and an id whose crc32 modulo 4 is not 2 are looked at.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.coalesce(F.length(text_col) > 0, F.lit(False)) & F.coalesce(learns(F.col(id_col)), F.lit(False))).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    keys = rows.select("lang", F.xxhash64("text").alias("h")).distinct().withColumn("part", F.pmod("h", F.lit(RANKED_PARTS)))
    for per in (["lang", "part"], ["lang"]):  # first within parts of a language, so that a common one is not ranked in one task
        keys = keys.withColumn("nth", F.row_number().over(Window.partitionBy(*per).orderBy("h"))).where(F.col("nth") <= most)
    keys = keys.select("lang", "h")
    picked = rows.withColumn("h", F.xxhash64("text")).join(F.broadcast(keys), ["lang", "h"]).dropDuplicates(["lang", "h"]).select("lang", "text")
    got = [(r.lang, r.text) for r in picked.collect()]
    return fold(train_counts(sorted(got))) if got else None


def tagged(docs: DataFrame, model: Contexts | None, text_col: str = "text", lang_name: str = "lang_pred", score_name: str = "score") -> DataFrame:
    """docs with two more columns, lang_pred and score (or as lang_name and score_name say; columns of these names are
    replaced), for every row.

    lang_pred is the language whose trees code the whole text in the fewest bits, the first in the alphabet where several
    do; ``und`` where the text is null or has no letter (score 0), or where there is no model. score is that language's
    share of the likelihoods, tempered to the text's bits a byte: 1 means that no other language comes near. Repeated rows,
    nulls and further columns stay as they are; an empty table gives an empty table.
    """
    kept = [f"`{c}`" for c in docs.columns if c not in (lang_name, score_name)]
    if model is None:
        return docs.select(*kept, F.lit("und").alias(lang_name), F.lit(0.0).alias(score_name))
    rows = docs.select(*kept, F.col(text_col).alias("_text"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("_letters"))
    schema = docs.select(*kept).schema.add(lang_name, "string").add(score_name, "double")
    sent = docs.sparkSession.sparkContext.broadcast(zlib.compress(cloudpickle.dumps(model), 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pickle.loads(zlib.decompress(sent.value))
        names = np.array([*m.languages, "und"], object)
        for b in batches:
            best, score = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows)
            texts, letters = b.column(b.num_columns - 2).cast(pa.binary()), b.column(b.num_columns - 1).to_numpy(zero_copy_only=False)
            for start, part in chunks(t.as_py() or b"" for t in texts):
                bits = code_lengths(m, part)
                n = np.maximum(1, [len(t) for t in part])[:, None]
                gap = (bits - bits.min(1, keepdims=True)) / n * 20
                best[start : start + len(part)] = bits.argmin(1)
                score[start : start + len(part)] = 1 / np.exp2(-gap).sum(1)
            out = [*b.columns[:-2], pa.array(names[np.where(letters, best, len(m.languages))], pa.string()), pa.array(np.where(letters, score, 0.0))]
            yield pa.RecordBatch.from_arrays(out, [f.name for f in schema])
        trimmed()

    return rows.mapInArrow(run, schema)


def identify(docs: DataFrame, model: Contexts | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for every row of docs, as ``tagged`` has them."""
    return tagged(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), model).select("doc_id", "lang_pred", "score")

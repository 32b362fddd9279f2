"""SimHash near-duplicates found by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumengraph.llm.common import components, scratch, trimmed, utf8, without_keys, written

#: Segments of a fingerprint, and the errors looked for in each: two differing bits leave one half with one at most.
SEGMENT_BITS, MOST_BITS = 32, 2
#: Index keys with more fingerprints than this are split further by the other half's thirds; both ways are exact.
WIDE_KEY = 256


def fingerprint(text: bytes, width: int = 3) -> int:
    """The SimHash of a text as a signed 64-bit integer; zero for a text without words."""
    words = text.lower().split()  # on bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - width + 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    ends = (starts + lengths)[min(width, len(words)) - 1 :]
    h = xxhash.xxh64_intdigest
    hashes = np.fromiter((h(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), ends.tolist(), strict=True)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 14):
        part = hashes[i : i + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, fp) for every row; a null text counts as empty, an empty one has fingerprint zero. key is an MD5 of id and text,
    so that rows of one id can be told apart."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "key": b["key"], "fp": [fingerprint(t, width) for t in utf8(b["text"])]})
        trimmed()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(docs, id_col, text_col).alias("key"), F.col(text_col).alias("text")).mapInPandas(run, "doc_id long, key binary, fp long")


def row_key(docs: DataFrame, id_col: str, text_col: str) -> Column:
    return F.unhex(F.md5(F.concat_ws(":", F.coalesce(docs[id_col].cast("string"), F.lit("-")), F.coalesce(docs[text_col], F.lit("")))))


def links(prints: DataFrame) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints of prints(fp), a < b, that differ in 1 or 2 bits; each pair once.

    Two such fingerprints agree in one 32-bit half but for one bit. Each fingerprint asks for the 33 keys of that ball, for
    each half; the table of halves answers, and complete distances decide. Below a key that many fingerprints share, the
    other half (at most two bits off) is matched by thirds, one of which has to be equal.
    """
    p = prints.where("fp is not null").select("fp").distinct()
    halves = [F.shiftrightunsigned("fp", SEGMENT_BITS), F.col("fp").bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1))]
    ball = [0, *(1 << k for k in range(SEGMENT_BITS))]
    half = lambda i: F.struct(F.lit(i).alias("seg"), halves[i].alias("key"), halves[1 - i].alias("rest"))
    table = p.select("fp", F.explode(F.array(half(0), half(1))).alias("h")).select("fp", "h.*")
    probe = table.select("fp", "seg", "rest", F.explode(F.array(*(F.lit(m) for m in ball))).alias("m"), "key").select(F.col("fp").alias("a"), "seg", F.col("key").bitwiseXOR(F.col("m")).alias("key"), F.col("rest").alias("rest_a"))
    index = table.withColumnRenamed("fp", "b").withColumnRenamed("rest", "rest_b")
    wide = written(index.groupBy("seg", "key").count().where(F.col("count") > WIDE_KEY).select("seg", "key"), "wide")
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MOST_BITS

    found = probe.join(index.join(wide, ["seg", "key"], "left_anti").hint("shuffle_hash"), ["seg", "key"]).where((F.col("a") < F.col("b")) & close).select("a", "b")
    if wide.limit(1).count():
        thirds = lambda c: F.explode(F.array(*(F.struct(F.lit(t).alias("third"), F.shiftrightunsigned(c, s).bitwiseAND(F.lit((1 << n) - 1)).alias("part")) for t, s, n in ((0, 0, 11), (1, 11, 11), (2, 22, 10)))))
        crowd = index.join(wide, ["seg", "key"], "left_semi").select("seg", "key", "b", thirds("rest_b").alias("t")).select("seg", "key", "b", "t.*")
        asks = probe.join(wide, ["seg", "key"], "left_semi").select("seg", "key", "a", thirds("rest_a").alias("t")).select("seg", "key", "a", "t.*")
        found = found.union(asks.join(crowd.hint("shuffle_hash"), ["seg", "key", "third", "part"]).where((F.col("a") < F.col("b")) & close).select("a", "b"))
    return found.distinct()


def _rooted(first: DataFrame) -> DataFrame:
    """first(fp, ...), one row a fingerprint, with the component (root) that links of at most two bits put it in."""
    reach = components(written(links(first), "links"), "fp-components")
    return first.join(reach, first.fp == reach.node, "left").select(first["*"], F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs: fingerprint as 16 hex digits, component_id the smallest id
    that links of at most two bits reach.

    Rows with equal fingerprints are linked, so empty, null and repeated texts come together; a repeated doc_id gives a row
    each time; a null doc_id keeps its row and is never chosen as the smallest unless a component has no other id. Texts are
    read whole, however long. An empty table gives an empty table. Other columns of docs are not looked at.
    """
    prints = written(fingerprints(docs, width, id_col, text_col).select("doc_id", "fp"), "fingerprints")
    rooted = _rooted(written(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "first"))
    lowest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_print = written(rooted.join(lowest, "root").select("fp", "component_id"), "of-print")
    return prints.join(of_print, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, that stay when one row of each group of near duplicates is kept: that with the
    smallest id, and of several texts with that id any one, always the same. Rows without an id stay.

    Of rows that agree in id and text, whatever their other columns hold, one is kept. Null and empty texts are near
    duplicates of each other; an empty table gives an empty table. Only the keys of rows that go, or that stay once out of
    several, meet the texts: they are broadcast up to a bound, so that texts are not shuffled.
    """
    with scratch(docs.sparkSession):
        prints = written(fingerprints(docs.where(docs[id_col].isNotNull()), width, id_col, text_col), "fingerprints")
        rooted = _rooted(written(prints.groupBy("fp").agg(F.min(F.struct("doc_id", "key")).alias("lead")), "first"))
        leads = rooted.groupBy("root").agg(F.min("lead").alias("lead")).select("lead.key", F.lit(True).alias("leads"))
        by_key = prints.groupBy("key").agg(F.count("*").alias("n")).join(leads, "key", "left")
        decided = written(by_key.where("leads is null or n > 1").select("key", F.col("leads").isNotNull().alias("once")), "near-duplicates", stays=True)
    rows = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), row_key(docs, id_col, text_col).alias("key"))
    kept = without_keys(rows, decided.select("key"))
    once = decided.where("once").select("key")
    if once.limit(1).count():
        again = rows.join(once, "key", "left_semi").groupBy("key").agg(F.first("row").alias("row"))
        kept = kept.select("key", "row").unionByName(again.select("key", "row"))
    return kept.select(*(F.col("row")[c].alias(c) for c in docs.columns))

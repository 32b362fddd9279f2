"""Removal of word windows that occur more than once, counted in minimiser buckets of super-k-mers."""

from __future__ import annotations

import hashlib
import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumengraph.llm.common import chunks, utf8

#: Words of a window; words of the grams whose smallest hash is a window's minimiser.
WINDOW, GRAM = 35, 5
#: A longer run of windows is cut, so that no packed string outgrows a task. Cuts change no count: windows are compared one by one.
MOST_RUN = 1024
#: A task packs what about so many bytes of text hold before it sends them on.
PACK_BYTES = 12 << 20
#: Buckets for each shuffle partition.
BUCKETS_PER_PARTITION = 4
#: About so many windows share a minimiser's place, so that a gram with one of so many places of a bucket's windows could fill it.
WINDOWS_PER_PLACE = 16
#: Grams that a task counts at once.
COUNTED_GRAMS = 2 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def _span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of values[start:end] by prefix sums of a polynomial modulo 2^64; equal spans have equal hashes."""
    n = len(values)
    powers = np.full(n + 1, _ODD)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    back = np.full(n + 1, np.uint64(pow(int(_ODD), -1, 1 << 64)))
    back[0] = 1
    back = np.multiply.accumulate(back)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers[:n], out=sums[1:])
    return _mix((sums[ends] - sums[starts]) * back[starts])


def _split(run: list[bytes]) -> tuple[np.ndarray, bytes, np.ndarray, np.ndarray]:
    """The words of a run of texts: how many each text has, all of them joined, and where each starts and ends in that."""
    split = [t.split() for t in run]
    words = [w for s in split for w in s]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(lengths + 1) - lengths - 1
    return np.fromiter(map(len, split), np.int64, len(split)), b" ".join(words), starts, starts + lengths


def _hashed(text: bytes, starts: np.ndarray, ends: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, and of the grams that start at them."""
    word_hash = _span_hashes(np.frombuffer(text, np.uint8).astype(np.uint64) + np.uint64(1), starts, ends)
    at = np.arange(max(0, len(starts) - gram + 1))
    return word_hash, _span_hashes(word_hash, at, at + gram)


def common_grams(rows: DataFrame, buckets: int, gram: int = GRAM) -> np.ndarray:
    """Sorted hashes of the grams of rows(text) that are so common that windows around one alone could fill a bucket.

    A gram of that share of all places has it in some task's grams, too. So a task tells only grams of half that share of its
    own, which is a bounded number; what it leaves out is less than half of any share sought. At most 32 grams a bucket come out.
    """
    share = 1 / (WINDOWS_PER_PLACE * buckets)

    def told(grams: list[np.ndarray]) -> pa.RecordBatch:
        values, times = np.unique(np.concatenate(grams), return_counts=True)
        n = int(times.sum())
        kept = times >= max(2, share * n / 2)
        return pa.RecordBatch.from_arrays([pa.array([None, *values[kept].view(np.int64).tolist()], pa.int64()), pa.array([n, *times[kept].tolist()], pa.int64())], ["gram", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, size = [], 0
        for b in batches:
            for _, run in chunks((t.as_py() or b"" for t in b.column(0).cast(pa.binary())), 2 << 20):
                _, text, starts, ends = _split(run)
                if len(starts) < gram:
                    continue
                grams.append(_hashed(text, starts, ends, gram)[1])
                size += len(grams[-1])
                if size >= COUNTED_GRAMS:
                    yield told(grams)
                    grams, size = [], 0
        if grams:
            yield told(grams)

    sums = rows.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    most = sums.orderBy(F.desc("n"), F.asc_nulls_first("gram")).limit(2 * WINDOWS_PER_PLACE * buckets + 1).collect()
    total = most[0].n if most else 0
    return np.sort(np.array([r.gram for r in most if r.gram is not None and r.n >= share * total / 2], np.int64).view(np.uint64))


def super_kmers(run: list[bytes], window: int = WINDOW, gram: int = GRAM, common: np.ndarray | None = None) -> Iterator[tuple[int, int, int, bytes, bool]]:
    """(minimiser, text's index in run, first word, packed words, whether a window in it may repeat nearby) for each run of
    windows that share a minimiser. Grams with hashes in common come last in the order, so that they are minimisers only of
    windows that have no others."""
    counts, text, starts, ends = _split(run)
    n = len(starts)
    if n < window:
        return
    of = np.repeat(np.arange(len(run)), counts)
    first = np.repeat(np.cumsum(counts) - counts, counts)
    word_hash, low = _hashed(text, starts, ends, gram)
    late = np.isin(low, common) if common is not None and len(common) else np.zeros(len(low), bool)
    low = low >> np.uint64(1) | late.astype(np.uint64) << np.uint64(63)
    width, span = 1, window - gram + 1
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if span > width:
        low = np.minimum(low[: width - span], low[span - width :])
    whole = of[: n - window + 1] == of[window - 1 :]
    fresh = np.ones(len(low), bool)
    fresh[1:] = (low[1:] != low[:-1]) | (of[1 : len(low)] != of[: len(low) - 1])
    at = np.flatnonzero(whole)
    if not len(at):
        return
    window_hash = _span_hashes(word_hash, at, at + window)
    _, back, times = np.unique(window_hash, return_inverse=True, return_counts=True)
    again = np.concatenate(([0], np.cumsum(times[back] > 1)))
    begin = fresh[at]
    begin[0] = True
    begin[1:] |= np.diff(at) > 1
    opens = np.flatnonzero(begin)
    for i, j in zip(opens.tolist(), [*(opens[1:].tolist()), len(at)], strict=True):
        for k in range(i, j, MOST_RUN):
            a, b = int(at[k]), int(at[min(k + MOST_RUN, j) - 1]) + window - 1
            yield int(low[a]), int(of[a]), int(a - first[a]), text[starts[a] : ends[b]], bool(again[min(k + MOST_RUN, j)] > again[k])


def _runs(flags: list[bool]) -> Iterator[tuple[int, int]]:
    start = None
    for i, f in enumerate([*flags, False]):
        if f and start is None:
            start = i
        elif not f and start is not None:
            yield start, i
            start = None


def counted(entries: list[tuple[int, bytes, int, bytes, bool]], window: int = WINDOW) -> Iterator[tuple[bytes, int, int]]:
    """(key, first, past) word ranges of entries (minimiser, key, first word, packed, may repeat) under repeated windows.

    Sorted by minimiser, equal windows stand together. An entry with first word -1 stands for copies that a task has settled
    already: it counts twice and takes no range.
    """
    entries.sort(key=lambda e: e[0])
    i = 0
    while i < len(entries):
        j = i
        strings: dict[bytes, list] = {}
        while j < len(entries) and entries[j][0] == entries[i][0]:
            _, key, start, packed, again = entries[j]
            own = strings.setdefault(packed, [0, set(), again])
            own[0] += 1 if start >= 0 else 2
            if start >= 0:
                own[1].add((key, start))
            j += 1
        i = j
        cut = {p: p.split(b" ") for p, own in strings.items() if len(strings) > 1 or own[2] and own[0] == 1}
        seen: Counter[bytes] = Counter()
        for p, words in cut.items():
            for k in range(len(words) - window + 1):
                seen[b" ".join(words[k : k + window])] += strings[p][0]
        for p, (n, places, _) in strings.items():
            if n > 1:
                spans = [(0, p.count(b" ") + 1)] if places else []
            elif p in cut:
                words = cut[p]
                spans = [(a, b + window - 1) for a, b in _runs([seen[b" ".join(words[k : k + window])] > 1 for k in range(len(words) - window + 1)])]
            else:
                continue
            for key, start in places:
                for a, b in spans:
                    yield key, start + a, start + b


def repeated(rows: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(key, first, past) word ranges of rows(key, text) that windows cover whose words also start anywhere else.

    A task packs runs of windows with one minimiser, settles equal packed strings of its own, and sends the rest to the
    minimiser's bucket: of copies within a task one goes on, so that a bucket gets a row a task of a passage that a third of
    all rows hold. Grams that many different windows share, such as those of a phrase that a third of all texts repeat, give
    way to rarer ones, so that these windows go to many buckets; which grams give way changes no result.
    """
    buckets = BUCKETS_PER_PARTITION * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    common = common_grams(rows, buckets, gram)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(6)

        def rows_of(to: dict[int, object]) -> pa.RecordBatch:
            ids = sorted(to)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array([squeeze.compress(pickle.dumps(to[i])) for i in ids], pa.binary())], ["bucket", "packed"])

        def sent(strings: dict) -> pa.RecordBatch:
            to: dict[int, list] = {}
            for (mini, packed), (n, key, start, again) in strings.items():
                to.setdefault(mini % buckets, []).append((mini, key if n == 1 else b"", start if n == 1 else -1, packed, again))
            return rows_of({b: list(zip(*sorted(own, key=lambda e: e[3]), strict=True)) for b, own in to.items()})

        def settled(done: set) -> pa.RecordBatch:
            by: dict[int, list] = {}
            for d in done:
                by.setdefault(int.from_bytes(d[0][:4], "big") % buckets, []).append(d)
            return rows_of({b: ("settled", own) for b, own in by.items()})

        strings, done, size = {}, set(), 0
        for b in batches:
            keys = b.column(0).to_pylist()
            for at, run in chunks((t.as_py() for t in b.column(1).cast(pa.binary())), 2 << 20):
                for mini, i, start, packed, again in super_kmers(run, window, gram, common):
                    own = strings.get((mini, packed))
                    if own is None:
                        strings[mini, packed] = [1, keys[at + i], start, again]
                        continue
                    past = packed.count(b" ") + 1
                    if own[0] == 1:
                        done.add((own[1], own[2], own[2] + past))
                    own[0] = 2
                    done.add((keys[at + i], start, start + past))
                size += sum(map(len, run))
                if size >= PACK_BYTES:
                    yield sent(strings)
                    yield settled(done)
                    strings, done, size = {}, set(), 0
        yield sent(strings)
        yield settled(done)

    def count(b: pd.DataFrame) -> pd.DataFrame:
        out, entries, open_ = [], [], zstandard.ZstdDecompressor()
        for p in b["packed"]:
            got = pickle.loads(open_.decompress(p))
            if got[0] == "settled":
                out += got[1]
            else:
                entries += zip(*got, strict=True)
        out += counted(entries, window)
        return pd.DataFrame(out, columns=["key", "first", "past"]).astype({"first": "int32", "past": "int32"})

    return rows.select("key", "text").mapInArrow(pack, "bucket int, packed binary").groupBy("bucket").applyInPandas(count, "key binary, first int, past int")


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for every row of docs: kept are the words, joined by one space, that no window
    covers whose ``window`` words also start anywhere else in the table, in the same text included.

    A null or empty text has no words; texts shorter than a window lose none; a repeated row counts each time, so copies of a
    text of ``window`` or more words lose them all. Texts are read whole, however long, and other columns are not looked at. A null
    doc_id keeps its row. An empty table gives an empty table.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("key", F.unhex(F.md5("text")))
    ranges = repeated(rows, window, gram).distinct().groupBy("key").agg(F.collect_list(F.struct("first", "past")).alias("ranges"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n_words, n_removed, kept = [], [], []
            for text, spans in zip(utf8(b["text"]), b["ranges"], strict=True):
                words = text.split()
                gone = np.zeros(len(words), bool)
                for s in spans if spans is not None else ():
                    gone[s["first"] : s["past"]] = True
                n_words.append(len(words))
                n_removed.append(int(gone.sum()))
                kept.append(b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g).decode("utf-8", "surrogatepass"))
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "n_words": n_words, "n_removed": n_removed, "kept": kept})

    joined = rows.join(ranges.hint("shuffle_hash"), "key", "left").select("doc_id", "text", "ranges")
    return joined.mapInPandas(cut, "doc_id long, n_words long, n_removed long, kept string")


def digest(kept: str) -> str:
    return hashlib.sha256(kept.encode()).hexdigest()

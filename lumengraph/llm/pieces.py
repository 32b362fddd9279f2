"""SentencePiece encoding over a relational lattice of words, and decoding."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lumengraph.llm.common import trimmed, written

SPACE = "▁"
#: A word is a run of spaces with what follows it; line feeds, tabs and returns, which no piece holds, stand alone.
WORD = re.compile(f"{SPACE}+[^{SPACE}\n\t\r]*|[^{SPACE}\n\t\r]+|[\n\t\r]+")
#: Characters of text whose words are looked up together, and the parts that words are dealt to for each shuffle partition.
BLOCK_CHARS, PARTS_PER_PARTITION = 8 << 20, 4
#: Words longer than this are cut wherever no piece holds two neighbouring characters, not only beside letters.
SHORT = 24
#: Characters of a word that one row of its lattice is made from, and edges of a lattice that are folded with one window.
CHUNK, WINDOW = 64, 256
#: Score of a character that is no piece and falls back to its bytes, below the lowest piece's.
FALLBACK = -10.0


def load(spark: SparkSession, path: str) -> DataFrame:
    """(piece, id, score, bytes) of a model file: bytes says whether a piece stands for one byte.

    A unigram model's scores are log-probabilities. The scores of a BPE model are ranks of merges; a piece then gets the
    log of its rank's reciprocal, as if frequencies fell by Zipf's law. Scores are of single precision, as in unigram models;
    sums of them in double precision are exact, so that rounding never decides between paths that are equally good.
    """
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    unigram = model.trainer_spec.model_type == 1
    kinds = pb.ModelProto.SentencePiece
    rows = [(p.piece, i, float(p.score) if unigram else float(np.float32(-math.log(i + 1))), p.type == kinds.BYTE) for i, p in enumerate(model.pieces) if p.type in (kinds.NORMAL, kinds.USER_DEFINED, kinds.BYTE)]
    return spark.createDataFrame(rows, "piece string, id int, score double, bytes boolean")


def normalized(text: str) -> str:
    """Spaces as marks, with one in front."""
    return SPACE + text.replace(" ", SPACE) if text else ""


@dataclass(frozen=True)
class Cuts:
    """Places within a word that no piece reaches across: the parts on either side have lattices of their own, and far fewer of
    them are distinct than words are. beside finds such places between a letter and another character; pairs are all
    neighbours within pieces, so that a longer word can be cut between any two others; stops are marks that no piece holds
    beside a letter."""

    beside: re.Pattern
    pairs: frozenset[str]
    stops: str

    def parts(self, word: str) -> list[str]:
        bare = word.rstrip(self.stops)  # most words are letters with a stop behind
        if len(word) <= SHORT and bare[1:].isalpha() and bare[-1].isalpha():
            return [bare, word[len(bare) :]] if len(bare) < len(word) else [word]
        return [p for x in self.beside.split(word) for p in ([x] if len(x) <= SHORT else self._finely(x))]

    def _finely(self, word: str) -> list[str]:
        at = [0, *(i for i in range(1, len(word)) if word[i - 1 : i + 1] not in self.pairs), len(word)]
        return [word[a:b] for a, b in zip(at, at[1:], strict=False)]


def cuts(pieces: DataFrame) -> Cuts:
    texts = [r.piece for r in pieces.where(~F.col("bytes")).select("piece").collect()]
    odd = {c for t in texts for c in t if re.match(r"[^\W\d_]", c) and not c.isalpha()}
    beside = {SPACE} | {b if a.isalpha() else a for t in texts for a, b in zip(t, t[1:], strict=False) if a.isalpha() != b.isalpha()}
    odd, beside = (re.escape("".join(sorted(x))) for x in (odd, beside))
    letter, other = rf"[^\W\d_{odd}]", rf"(?:(?![{beside}])[\W\d_{odd}])"
    pattern = re.compile(rf"(?<={letter})(?={other})|(?<!{letter})(?<![{beside}])(?={letter})(?!^)")
    stops = "".join(c for c in ".,;:!?" if not re.match(f"[{beside}]", c))
    return Cuts(pattern, frozenset(t[i : i + 2] for t in texts for i in range(len(t) - 1)), stops)


def lattice(words: DataFrame, pieces: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start, end, score, id, word): the edges of each word's lattice, for words(keys, word); word is null but for an edge
    from the word's first character, that of the single character.

    Substrings of up to the longest piece's length are joined to the pieces. A character that is none has the number of its
    UTF-8 bytes, below zero, for an id. Words are read in chunks, so that a long one takes time in proportion to its length.
    The table of pieces is broadcast: it is a vocabulary, of a size fixed by its file.
    """
    own = pieces.where(~F.col("bytes"))
    longest, lowest = own.agg(F.max(F.length("piece")), F.min("score")).first()
    chunks = words.where("word <> ''").select(*keys, "word", F.explode(F.sequence(F.lit(0), F.length("word") - 1, F.lit(CHUNK))).alias("base"))
    chunks = chunks.select(*keys, F.when(F.col("base") == 0, F.col("word")).alias("word"), "base", F.substring("word", F.col("base") + 1, F.lit(CHUNK + longest - 1)).alias("chunk"))
    starts = chunks.select(*keys, "word", "base", "chunk", F.explode(F.sequence(F.lit(0), F.least(F.lit(CHUNK), F.length("chunk")) - 1)).alias("at"))
    cut = starts.select(*keys, "word", "base", "chunk", "at", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("chunk") - F.col("at")))).alias("n"))
    cut = cut.select(*keys, (F.col("base") + F.col("at")).alias("start"), "n", F.substring("chunk", F.col("at") + 1, F.col("n")).alias("piece"), F.when((F.col("at") == 0) & (F.col("n") == 1), F.col("word")).alias("word"))
    met = cut.join(F.broadcast(own.select("piece", "id", "score")), "piece", "left").where("id is not null or n = 1")
    code = -1 - F.conv(F.hex(F.encode("piece", "UTF-8")), 16, 10).cast("long")
    return met.select(*keys, "start", (F.col("start") + F.col("n")).alias("end"), F.coalesce("score", F.lit(lowest + FALLBACK)).alias("score"), F.coalesce("id", code).alias("id"), "word")


def spelled_out(ids: Column, zero: int | None) -> Column:
    """Ids with those of bytes in place of negative ones; zero is the id of byte 0, and unknown characters are 0 without it."""

    def one(x: Column) -> Column:
        code = F.hex(-1 - x)
        code = F.lpad(code, F.length(code) + F.length(code) % 2, F.lit("0"))
        pairs = F.sequence(F.lit(1), F.length(code), F.lit(2))
        own = F.transform(pairs, lambda i: F.conv(F.substring(code, i, F.lit(2)), 16, 10).cast("int") + F.lit(zero or 0)) if zero is not None else F.array(F.lit(0))
        return F.when(x >= 0, F.array(x.cast("int"))).otherwise(own)

    return F.when(F.exists(ids, lambda x: x < 0), F.flatten(F.transform(ids, one))).otherwise(ids.cast("array<int>"))


def _bound(value: Column, use) -> Column:
    """use(value), with the value reckoned once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def viterbi(edges: Column, longest: int) -> Column:
    """The ids of the best path over edges (end, start, score, id), sorted: the greatest sum of scores, of equal ones the
    path with the longest last piece. No edge is longer than longest."""
    return F.when(F.size(edges) <= WINDOW, _fold(edges)).otherwise(_windowed_fold(edges, longest))


def _fold(edges: Column) -> Column:
    """viterbi for a short word: the state holds the best path to each character."""
    kind = "array<struct<score:double,ids:array<bigint>>>"
    origin = F.array(F.struct(F.lit(0.0).alias("score"), F.array().cast("array<bigint>").alias("ids"))).cast(kind)

    def step(state: Column, e: Column) -> Column:
        before = F.get(state, e["start"])
        total = before["score"] + e["score"]
        path = F.struct(total.alias("score"), F.array_append(before["ids"], e["id"]).alias("ids"))
        return F.when(e["end"] == F.size(state), F.array_append(state, path)).when(total > F.get(state, e["end"])["score"], F.array_append(F.slice(state, F.lit(1), e["end"]), path)).otherwise(state)

    return F.element_at(F.aggregate(edges, origin, step), -1)["ids"]


def _windowed_fold(edges: Column, longest: int) -> Column:
    """viterbi for a long word: edges are taken WINDOW at a time. The state holds the best edge to each of the last characters
    that an edge can start from; those before are put away in lists, from which the path is read at the end."""
    entry = "struct<score:double,start:int,id:bigint>"
    origin = F.struct(F.lit(0).alias("low"), F.array(F.struct(F.lit(0.0).alias("score"), F.lit(-1).alias("start"), F.lit(0).cast("long").alias("id"))).cast(f"array<{entry}>").alias("recent"), F.array().cast(f"array<array<{entry}>>").alias("done"))

    def step(low: Column):
        def one(recent: Column, e: Column) -> Column:
            total = F.get(recent, e["start"] - low)["score"] + e["score"]
            new = F.struct(total.alias("score"), e["start"].cast("int").alias("start"), e["id"].alias("id"))
            at = e["end"] - low
            return F.when(at == F.size(recent), F.array_append(recent, new)).when(total > F.get(recent, at)["score"], F.array_append(F.slice(recent, F.lit(1), at), new)).otherwise(recent)

        return one

    def part(state: Column, k: Column) -> Column:
        met = F.aggregate(F.slice(edges, k * WINDOW + 1, F.lit(WINDOW)), state["recent"], step(state["low"]))

        def put_away(recent: Column) -> Column:
            out = F.greatest(F.lit(0), F.size(recent) - (longest + 1))
            return F.struct((state["low"] + out).alias("low"), F.slice(recent, out + 1, F.size(recent)).alias("recent"), F.concat(state["done"], F.array(F.slice(recent, F.lit(1), out))).alias("done"))

        return _bound(met, put_away)

    forward = F.aggregate(F.sequence(F.lit(0), F.floor((F.size(edges) - 1) / WINDOW).cast("int")), origin, part)
    best = _bound(forward, lambda s: F.flatten(F.concat(s["done"], F.array(s["recent"]))))

    def back(best: Column) -> Column:
        none = F.array().cast("array<bigint>")
        end = F.struct((F.size(best) - 1).alias("at"), F.array().cast("array<array<bigint>>").alias("ids"))

        def one(state: Column, _: Column) -> Column:
            here = F.get(best, state["at"])
            return F.when(state["at"] <= 0, state).otherwise(F.struct(here["start"].alias("at"), F.concat(F.array(here["id"]), state["ids"]).alias("ids")))

        def run(state: Column, _: Column) -> Column:
            own = F.aggregate(F.sequence(F.lit(1), F.lit(WINDOW)), F.struct(state["at"].alias("at"), none.alias("ids")), one)
            return _bound(own, lambda x: F.struct(x["at"].alias("at"), F.concat(F.array(x["ids"]), state["ids"]).alias("ids")))

        return F.flatten(F.aggregate(F.sequence(F.lit(0), F.floor(F.size(best) / WINDOW).cast("int")), end, run)["ids"])

    return _bound(best, back)


def encode_words(words: DataFrame, pieces: DataFrame, keys: list[str]) -> DataFrame:
    """words(keys, word), distinct, with the ids of each word. Empty words are left out.

    A word is known by a number while its lattice is built and grouped. One of n characters takes time in proportion to n, and
    the memory of its edges in one row: some 50 bytes for each, of which a character has as many as pieces end there.
    """
    longest = pieces.where(~F.col("bytes")).agg(F.max(F.length("piece"))).first()[0]
    edges = lattice(words.where("word <> ''").withColumn("_w", F.monotonically_increasing_id()), pieces, [*keys, "_w"])
    by = edges.groupBy(*keys, "_w").agg(F.sort_array(F.collect_list(F.struct("end", "start", "score", "id"))).alias("edges"), F.max("word").alias("word"))
    zero = pieces.where(F.col("piece") == "<0x00>").select("id").first()
    return by.select(*keys, "word", _bound(viterbi(F.col("edges"), longest), lambda ids: spelled_out(ids, zero.id if zero else None)).alias("ids"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, list[str]]]:
    """(block, doc ids, texts) of whole texts; blocks are numbered within the task's partition of the input."""
    part, n, size, ids, texts = TaskContext.get().partitionId(), 0, 0, [], []
    for b in batches:
        for i, t in zip(b.column(0), b.column(1), strict=True):
            ids.append(i.as_py())
            texts.append(t.as_py() or "")
            size += len(texts[-1])
            if size >= BLOCK_CHARS:
                yield part << 32 | n, ids, texts
                n, size, ids, texts = n + 1, 0, [], []
    if ids:
        yield part << 32 | n, ids, texts


def _spans(text: str) -> list[str]:
    """The words of a text, spaces as marks, without the space in front that each has but for those that begin with a line feed:
    ``_word`` of them, put together, is normalized(text)."""
    if SPACE in text:
        text = text.replace(SPACE, " ")
    if not text:
        return []
    if "\n" not in text:
        return _line(text) if text[0] != " " else _line(" " + text)[1:]
    out, feeds = [], ""
    lines = text.split("\n")
    for k, line in enumerate(lines):
        if line or k in (0, len(lines) - 1):
            own = _line(line) if k or line[:1] != " " else _line(" " + line)[1:]
            own[0] = feeds + own[0]
            out += own
            feeds = ""
        feeds += "\n"
    return out


def _line(line: str) -> list[str]:
    """A line cut at the spaces that begin a word: of several spaces at the first, and the others are marks of the word."""
    if "  " not in line:
        return line.split(" ")
    head = line[: line.index(" ")]
    return [head, *(x[1:].replace(" ", SPACE) for x in re.findall(" +[^ ]*", line[len(head) :]))]


def _word(span: str) -> str:
    return span if span[:1] == "\n" else SPACE + span


def _vocabulary(spans: Iterable[str], parts: int) -> dict[int, list[str]]:
    """The distinct spans by the part they are dealt to, parts and spans sorted. The first characters decide, so that words that
    differ in what stands behind them share their parts' lattices."""
    out: dict[int, list[str]] = {}
    for w in sorted(spans):
        out.setdefault(zlib.crc32(w[:6].encode()) % parts, []).append(w)
    return {p: out[p] for p in sorted(out)}


def _digest(words: dict[int, list[str]]) -> int:
    h = hashlib.blake2b(digest_size=8)
    for w in words.values():
        h.update(_BETWEEN.join(w).encode())
    return int.from_bytes(h.digest(), "little", signed=True)


def _numbered(number: dict[str, int], spans: list[str]) -> np.ndarray:
    """The numbers of spans; new ones get the next."""
    for s in set(spans).difference(number):
        number[s] = len(number)
    return np.fromiter(map(number.__getitem__, spans), np.uint32, len(spans))


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers below 2^32, compressed: all lowest bytes first, then all second ones, since each kind is alike in itself."""
    return zstandard.ZstdCompressor(3).compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _gathered(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The runs of values numbered by which, one after another."""
    n = lengths[which]
    shift = np.repeat(starts[which] - np.cumsum(n) + n, n)
    return values[shift + np.arange(len(shift))]


#: Ids that are decoded at once.
_DECODED = 1 << 18


def _spellings(pieces: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all ids' pieces, one after another, and their lengths; the last one, without any, stands for unknown ids."""
    codes = {r.id: bytes([int(r.piece[3:5], 16)]) if r.bytes else r.piece.replace(SPACE, " ").encode() for r in pieces.collect()}
    own = [codes.get(i, b"") for i in range(max(codes, default=-1) + 2)]
    return np.frombuffer(b"".join(own), np.uint8), np.fromiter(map(len, own), np.int64, len(own))


def _slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of lists, given where each begins and the last one ends, that hold about _DECODED ids; a longer list is one."""
    at, offsets = 0, offsets.astype(np.int64)
    while at < len(offsets) - 1:
        past = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _DECODED, "right")) - 1)
        yield at, past
        at = past


def _texts(ids: np.ndarray, offsets: np.ndarray, letters: np.ndarray, lengths: np.ndarray) -> list[str]:
    """The texts of lists of ids."""
    other = len(lengths) - 1
    ids = np.where((ids < 0) | (ids >= other), other, ids)
    starts = np.cumsum(lengths) - lengths
    data = b"".join(_gathered(letters, starts, lengths, ids[i : i + _DECODED]).tobytes() for i in range(0, len(ids), _DECODED))
    ends = np.concatenate([[0], np.cumsum(lengths[ids])])[offsets].tolist()
    texts = (data[a:z].decode("utf-8", "replace") for a, z in zip(ends, ends[1:], strict=False))
    return [t[1:] if t[:1] == " " else t for t in texts]


#: Stands between the spans of a part; no span holds it.
_BETWEEN = " "
_BINARY = pa.binary()


def encode(docs: DataFrame, pieces: DataFrame, id_col: str = "doc_id", text_col: str = "text", stable: bool = False, decoded: bool = False) -> DataFrame:
    """(doc_id, n_words, n_pieces, ids) for every row of docs: ids of the best path through each word's lattice, in order. If
    decoded, text is one more column: what the ids stand for, as ``decode`` has it.

    Only distinct words meet the lattice: a block of texts sends its vocabulary to the words' parts, each part's distinct
    words are encoded there, the ids go back to the block, and the block's texts, which travel as numbers of words, are
    written in ids. The rows are read twice for that. stable says that they come in the same partitions and the same order
    each time, as those of files do; if not, they are written to a table first. A block is known by its vocabulary too, so
    that a broken promise ends in an error and never in wrong ids.

    A null or empty text has no pieces; repeated rows and null ids are kept, and other columns are not looked at; an empty table
    gives an empty table. Very long texts make blocks of their own, and very long words take time in proportion to their
    length (``encode_words``).
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows if stable else written(rows, "texts")
    parts = PARTS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = cuts(pieces)
    spellings = _spellings(pieces) if decoded else ()

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(3)
        for block, _, texts in _blocks(batches):
            spans: set[str] = set()
            for t in texts:
                spans.update(_spans(t))
            words = _vocabulary(spans, parts)
            digest, packed = _digest(words), [squeeze.compress(_BETWEEN.join(w).encode()) for w in words.values()]
            yield pa.RecordBatch.from_arrays([pa.array([block] * len(words), pa.int64()), pa.array([digest] * len(words), pa.int64()), pa.array(list(words), pa.int32()), pa.array(packed, _BINARY)], ["block", "digest", "part", "spans"])
        trimmed()

    at_part = written(rows.mapInArrow(send, "block long, digest long, part int, spans binary"), "vocabularies").repartition(parts, "part")

    def unpack(data: bytes) -> list[str]:
        return zstandard.ZstdDecompressor().decompress(data).decode().split(_BETWEEN)

    def spelled(span: str) -> tuple[int, list[str]]:
        """How many words a span has, and the parts of these between cuts."""
        if span.isalpha() and len(span) < SHORT:
            return 1, [SPACE + span]
        words = WORD.findall(_word(span))
        return len(words), [p for w in words for p in cut.parts(w)]

    def distinct(asks: pa.Table) -> pa.Table:
        spans: set[str] = set()
        for data in asks["spans"].to_pylist():
            spans.update(unpack(data))
        words = sorted({w for s in spans for w in spelled(s)[1]})
        return pa.table({"part": pa.array([asks["part"][0].as_py()] * len(words), pa.int32()), "word": pa.array(words, pa.string())})

    # dealt once more, since Spark can't know that a function on groups leaves rows where they are; the lattices then stay there
    words = at_part.groupBy("part").applyInArrow(distinct, "part int, word string").repartition(parts, "part")
    table = encode_words(words, pieces, ["part"])

    def answer(asks: pa.Table, known: pa.Table) -> pa.Table:
        number = {w: i for i, w in enumerate(known["word"].to_pylist())}
        lists = pa.concat_arrays(known["ids"].chunks) if len(known) else pa.array([], pa.list_(pa.int32()))
        ids, lengths = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
        of_span: dict[str, int] = {}
        starts, out = np.cumsum(lengths) - lengths, []
        runs = [_numbered(of_span, unpack(data)) for data in asks["spans"].to_pylist()]
        words_in, which = [], []
        for s in of_span:
            n, own = spelled(s)
            words_in.append(n)
            which.append([number[w] for w in own])
        parts_in = np.fromiter(map(len, which), np.int64, len(which))
        which, words_in = np.fromiter((x for own in which for x in own), np.int64), np.array(words_in, np.int64)
        span_ids = _gathered(ids, starts, lengths, which)
        ends = np.concatenate([[0], np.cumsum(lengths[which])])[np.concatenate([[0], np.cumsum(parts_in)])]
        for run in runs:
            n = np.diff(ends)[run]
            out.append((_packed(words_in[run]), _packed(n), _packed(_gathered(span_ids, ends[:-1], np.diff(ends), run))))
        trimmed()
        return pa.table({"block": asks["block"], "digest": asks["digest"], "part": asks["part"], **{k: pa.array([o[i] for o in out], _BINARY) for i, k in enumerate(("words", "lengths", "ids"))}})

    back = at_part.groupBy("part").cogroup(table.select(F.col("part").alias("own_part"), "word", "ids").groupBy("own_part")).applyInArrow(answer, "block long, digest long, part int, words binary, lengths binary, ids binary")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, texts in _blocks(batches):
            number: dict[str, int] = {}
            runs = [np.zeros(0, np.uint32), *(_numbered(number, _spans(t)) for t in texts)]
            words = _vocabulary(number, parts)
            listed = np.empty(len(number), np.uint32)
            listed[np.fromiter((number[s] for w in words.values() for s in w), np.int64, len(number))] = np.arange(len(number))
            sizes = np.fromiter(map(len, runs[1:]), np.uint32, len(texts))
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([_digest(words)], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([_packed(sizes)], _BINARY), pa.array([_packed(listed[np.concatenate(runs)])], _BINARY)], ["block", "digest", "doc_ids", "sizes", "spans"])
        trimmed()

    def write(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        answers = answers.sort_by("part")
        none = np.zeros(0, np.uint32)
        words_in, lengths, ids = (np.concatenate([none, *map(_unpacked, answers[k].to_pylist())]) for k in ("words", "lengths", "ids"))
        lengths = lengths.astype(np.int64)
        starts = np.cumsum(lengths) - lengths
        docs_, n_words, n_ids, values = [], [], [], []
        for doc_ids, sizes, run in zip(blocks["doc_ids"].to_pylist(), map(_unpacked, blocks["sizes"].to_pylist()), map(_unpacked, blocks["spans"].to_pylist()), strict=True):
            if len(run) and run.max() >= len(lengths):
                raise RuntimeError("the rows came in another order when they were read again: call encode with stable=False")
            ends = np.cumsum(sizes.astype(np.int64))
            at = 0
            for doc, end in zip(doc_ids, ends.tolist(), strict=True):
                own = run[at:end]
                docs_.append(doc)
                n_words.append(int(words_in[own].sum()))
                values.append(_gathered(ids, starts, lengths, own).astype(np.int32))
                n_ids.append(len(values[-1]))
                at = end
        offsets = np.concatenate([[0], np.cumsum(np.array(n_ids, np.int64))])
        values = np.concatenate([none.astype(np.int32), *values])
        out = {"doc_id": pa.array(docs_, pa.int64()), "n_words": pa.array(n_words, pa.int64()), "n_pieces": pa.array(n_ids, pa.int64())}
        out["ids"] = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))
        if decoded:
            runs = ((offsets[lo : hi + 1] - offsets[lo], values[offsets[lo] : offsets[hi]]) for lo, hi in _slices(offsets))
            out["text"] = pa.chunked_array([pa.array(_texts(ids, at, *spellings), pa.string()) for at, ids in runs], pa.string())
        del values
        trimmed()
        return pa.table(out)

    packed = rows.mapInArrow(pack, "block long, digest long, doc_ids array<long>, sizes binary, spans binary")
    keys = ["block", "digest"]
    return packed.groupBy(*keys).cogroup(back.groupBy(*keys)).applyInArrow(write, "doc_id long, n_words long, n_pieces long, ids array<int>" + ", text string" * decoded)


def decode(rows: DataFrame, pieces: DataFrame, keys: list[str], ids_col: str = "ids") -> DataFrame:
    """(keys, text): the text that each row's ids stand for, for every row; it is put together within the row, so that keys may
    be null or repeated. Null ids give null, none give an empty text, and ids outside the vocabulary are left out, as are null
    ones in a list. Marks in the original text come back as spaces, as they do in the format itself."""
    sent = rows.sparkSession.sparkContext.broadcast(_spellings(pieces))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo, hi in _slices(whole.column(whole.num_columns - 1).offsets.to_numpy()):
                b = whole.slice(lo, hi - lo)
                lists = b.column(b.num_columns - 1)
                offsets = lists.offsets.to_numpy().astype(np.int64)
                ids = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).fill_null(-1).to_numpy(zero_copy_only=False)
                texts = _texts(ids, offsets - offsets[0], *sent.value)
                texts = [t if there else None for t, there in zip(texts, lists.is_valid().to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], [*b.schema.names[:-1], "text"])
        trimmed()

    own_keys = rows.select(*keys)
    return rows.select(*keys, F.col(ids_col).cast("array<int>").alias("_ids")).mapInArrow(run, StructType([*own_keys.schema.fields, StructField("text", StringType())]))

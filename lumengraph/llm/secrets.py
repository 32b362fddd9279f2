"""Secret scans over a trigram inverted index; DataFrame functions only."""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from re import _constants as op
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumengraph.llm.common import written


@dataclass(frozen=True)
class Rule:
    """A match of pattern counts if its group has at least ``least`` characters."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0


#: The three base kinds, in their order of listing.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]+", 32),
)
#: Further kinds; their spans are added to those of the base.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 39),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 20),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\x20\x09-\x0D]*-----END [A-Z ]*PRIVATE KEY-----", 1),
)
#: Most literal strings that alternatives are multiplied out to before a query stops growing there.
MOST_STRINGS = 64
#: Trigrams of one literal string that are looked up; the rarest are, and any of them is mandatory.
MOST_TRIGRAMS = 3
#: Candidates are broadcast up to so many rows of 16 bytes; beyond that they are joined by a shuffle.
BROADCAST_ROWS = 1_000_000

#: All of (any of (all of these trigrams)); an empty query holds for every text.
Query = list[list[frozenset[str]]]


def _common(trigram: str) -> tuple[int, str]:
    """Smaller for trigrams that prose has less of."""
    return sum("etaoinshrdlu".find(c) < 0 for c in trigram) * -1, trigram


def trigram_query(pattern: str) -> Query:
    """What the lower-cased trigrams of any text with a match of pattern satisfy. Empty if none is mandatory."""
    query: Query = []

    def close(strings: set[str]) -> None:
        every = [frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in sorted(strings)]
        options = sorted({x for x in every if not any(y < x for y in every)}, key=sorted)
        if options and all(options):
            query.append([frozenset(sorted(x, key=_common)[:MOST_TRIGRAMS]) for x in options])

    def times(left: set[str], right: set[str]) -> set[str] | None:
        return {a + b for a, b in itertools.product(left, right)} if len(left) * len(right) <= MOST_STRINGS else None

    def exact(items) -> set[str] | None:
        """All strings that items can match, lower-cased; None if they are many or unbounded."""
        out: set[str] | None = {""}
        for what, arg in items:
            own = exact_one(what, arg)
            out = times(out, own) if own is not None else None
            if out is None:
                return None
        return out

    def exact_one(what, arg) -> set[str] | None:
        if what is op.LITERAL:
            return {chr(arg).lower()}
        if what is op.IN and all(w is op.LITERAL for w, _ in arg):
            return {chr(a).lower() for _, a in arg}
        if what is op.SUBPATTERN:
            return exact(arg[3])
        if what is op.BRANCH:
            parts = [exact(x) for x in arg[1]]
            return set().union(*parts) if None not in parts else None
        if what in (op.MAX_REPEAT, op.MIN_REPEAT) and arg[1] <= 2:
            once, out = exact(arg[2]), {""} if arg[0] == 0 else set()
            for n in range(max(1, arg[0]), arg[1] + 1):
                if once is None:
                    return None
                out |= {"".join(x) for x in itertools.product(once, repeat=n)}
            return out
        return None

    def walk(items, strings: set[str]) -> set[str]:
        for what, arg in items:
            own = exact_one(what, arg)
            grown = times(strings, own) if own is not None else None
            if grown is not None:
                strings = grown
            elif what is op.SUBPATTERN:
                strings = walk(arg[3], strings)
            elif what in (op.MAX_REPEAT, op.MIN_REPEAT) and arg[0] > 0:
                walk_end = walk(arg[2], strings)
                close(walk_end)
                strings = {""}
            else:
                close(strings)
                strings = {""} if own is None else own
        return strings

    close(walk(_parser.parse(pattern), {""}))
    return query


def postings(texts: DataFrame, trigrams: list[str]) -> DataFrame:
    """(trigram, key) for texts(key, text): which of the trigrams each lower-cased text holds; each pair once."""
    low = texts.select("key", F.lower("text").alias("low"))
    held = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams)))
    return low.select("key", F.explode(held).alias("trigram")).distinct()


def candidates(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(key, rules): numbers of the rules whose trigram query a text's postings satisfy; texts without any are left out.
    Rules without mandatory trigrams are not looked up: they scan every text."""
    queries = {i: q for i, r in enumerate(rules) if (q := trigram_query(r.pattern))}
    needed = sorted({t for q in queries.values() for any_ in q for all_ in any_ for t in all_})
    has = lambda t: F.array_contains("held", t)

    def holds(query: Query) -> Column:
        out = F.lit(True)
        for any_ in query:
            either = F.lit(False)
            for all_ in any_:
                both = F.lit(True)
                for t in sorted(all_):
                    both = both & has(t)
                either = either | both
            out = out & either
        return out

    held = postings(texts, needed).groupBy("key").agg(F.collect_set("trigram").alias("held"))
    found = F.array_compact(F.array(*(F.when(holds(q), F.lit(i)) for i, q in queries.items())))
    return held.select("key", found.alias("rules")).where(F.size("rules") > 0)


def spans_of(text: Column, rule: Rule, number: int) -> Column:
    """The spans of a rule's matches as structs (start, number, end, kind); leftmost, non-overlapping, in code points.

    Each match is set between two marks that the text does not hold otherwise, and the lengths between marks are summed.
    """
    marked = F.regexp_replace(F.translate(text, "\x01\x02", "\x03\x03"), F.lit(rule.pattern), F.lit("\x01$0\x02"))
    parts = F.split(marked, "[\x01\x02]")
    none = F.array().cast("array<struct<start:int,number:int,end:int,kind:string>>")
    length = lambda p: F.length(F.regexp_extract(p, rule.pattern, rule.group) if rule.group else p)

    def step(acc: Column, p: Column) -> Column:
        past = acc["at"] + F.length(p)
        one = F.struct(acc["at"].alias("start"), F.lit(number).alias("number"), past.alias("end"), F.lit(rule.kind).alias("kind"))
        took = F.when(acc["match"] & (length(p) >= rule.least), F.concat(acc["out"], F.array(one))).otherwise(acc["out"])
        return F.struct(past.alias("at"), (~acc["match"]).alias("match"), took.alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.lit(False).alias("match"), none.alias("out"))
    return F.when(F.regexp_like(text, F.lit(rule.pattern if rule.kind != "hex" else f"[0-9a-f]{{{rule.least}}}")), F.aggregate(parts, zero, step)["out"]).otherwise(none)


def find(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, text_col: str = "text", out_col: str = "secrets") -> DataFrame:
    """docs with one more column ``secrets`` (or as out_col says): the spans (start, number, end, kind) of every rule's matches in the whole text,
    by start, then in the order of the rules; empty for a null or empty text and for one without any.

    Rows and columns of docs stay as they are, whatever their names, nulls and repetitions; a column of that name is
    replaced. Equal texts share their postings. Texts are scanned whole, however long. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), text.alias("text"), F.xxhash64(text).alias("key"))
    scanned = {i for i, r in enumerate(rules) if not trigram_query(r.pattern)}
    found = written(candidates(keyed.select("key", "text"), rules), "secret-candidates")
    few = found.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    joined = keyed.join(F.broadcast(found) if few else found, "key", "left")
    none = F.array().cast("array<struct<start:int,number:int,end:int,kind:string>>")
    spans = [spans_of(F.col("text"), r, i) if i in scanned else F.when(F.coalesce(F.array_contains("rules", i), F.lit(False)), spans_of(F.col("text"), r, i)).otherwise(none) for i, r in enumerate(rules)]
    out = joined.select("row", F.sort_array(F.concat(*spans)).alias("_spans"))
    return out.select(*(F.col("row")[c].alias(c) for c in docs.columns if c != out_col), F.col("_spans").alias(out_col))


def redacted(text: Column, secrets: Column, mask: str = "[SECRET]") -> Column:
    """text with each secret replaced by mask; overlapping spans are replaced once."""
    def step(acc: Column, s: Column) -> Column:
        begin, past = F.greatest(acc["at"], s["start"]), F.greatest(acc["at"], s["end"])
        more = F.concat(acc["out"], F.substring(text, acc["at"] + 1, begin - acc["at"]), F.when(s["start"] >= acc["at"], F.lit(mask)).otherwise(""))
        return F.struct(past.alias("at"), F.when(past > acc["at"], more).otherwise(acc["out"]).alias("out"))

    end = F.aggregate(secrets, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    return F.when(F.size(secrets) == 0, text).otherwise(F.concat(end["out"], F.substring(text, end["at"] + 1, F.length(text))))

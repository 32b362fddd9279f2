"""Filters, casts and IRI helpers as Spark columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Test = Callable[[Column], Column]


def read(value: Column, kind: str) -> Column:
    """A literal's lexical form as a Spark value; null where it is none. Booleans are read without regard to case."""
    if kind == "boolean":
        low = F.lower(value)
        return F.when(low.isin("true", "1"), F.lit(True)).when(low.isin("false", "0"), F.lit(False))
    return value if kind == "string" else value.try_cast(kind)


def eq(x) -> Test:
    """Equality; in a string, a leading or trailing ``*`` stands for any characters, and nothing else is special."""
    if isinstance(x, str) and len(x) > 1 and (x.startswith("*") or x.endswith("*")):
        core = x.strip("*")
        if x.startswith("*") and x.endswith("*"):
            return lambda v: F.contains(v, F.lit(core))
        return lambda v: F.endswith(v, F.lit(core)) if x.startswith("*") else F.startswith(v, F.lit(core))
    return lambda v: v == F.lit(x)


def ne(x) -> Test:
    same = eq(x)
    return lambda v: ~same(v)


def lt(x) -> Test:
    return lambda v: v < F.lit(x)


def le(x) -> Test:
    return lambda v: v <= F.lit(x)


def gt(x) -> Test:
    return lambda v: v > F.lit(x)


def ge(x) -> Test:
    return lambda v: v >= F.lit(x)


def within(*xs) -> Test:
    return lambda v: v.isin(*xs)


def outside(*xs) -> Test:
    return lambda v: ~v.isin(*xs)


def matching(pattern: str, flags: str = "") -> Test:
    """True where the pattern is found anywhere; of the flags, i is known."""
    return lambda v: v.rlike(f"(?i){pattern}" if "i" in flags else pattern)


def both(*tests: Test) -> Test:
    def test(v: Column) -> Column:
        out = F.lit(True)
        for t in tests:
            out = out & t(v)
        return out

    return test


def either(*tests: Test) -> Test:
    def test(v: Column) -> Column:
        out = F.lit(False)
        for t in tests:
            out = out | t(v)
        return out

    return test


#: Schemes that an IRI may have.
SCHEMES = ("http", "https", "urn", "mailto", "ftp", "sftp", "tel")


def is_iri(value: Column) -> Column:
    return F.coalesce(value.rlike(rf"^(?:{'|'.join(SCHEMES)}):[^\s<>\"{{}}|\\^`]+$"), F.lit(False))


def expand(name: str, prefixes: dict[str, str], vocab: str | None = None) -> str:
    """The IRI of a prefixed name, with ``:`` or ``_`` behind the prefix; a full IRI stays."""
    for mark in (":", "_"):
        prefix, found, local = name.partition(mark)
        if found and prefix in prefixes:
            return prefixes[prefix] + local
    if "://" in name or name.startswith(("urn:", "mailto:", "tel:")):
        return name
    if vocab is None:
        raise ValueError(f"no prefix of {name!r} is known")
    return vocab + name


def compact(iri: Column, prefixes: dict[str, str]) -> Column:
    """prefix_local of an IRI by the longest namespace that fits; without any, its namespace's hash stands for the prefix."""
    space, local = F.regexp_extract(iri, r"^(.*[/#])", 1), F.regexp_extract(iri, r"([^/#]*)$", 1)
    out = F.concat(F.lit("ns"), F.hex(F.xxhash64(space)), F.lit("_"), local)
    for prefix, name in sorted(prefixes.items(), key=lambda p: len(p[1])):
        out = F.when(F.startswith(iri, F.lit(name)), F.concat(F.lit(f"{prefix}_"), F.substring(iri, F.lit(len(name) + 1), F.length(iri)))).otherwise(out)
    return out


def parent(iri: Column) -> Column:
    """The IRI one path segment up; the root's is itself."""
    up = F.regexp_extract(iri, r"^([a-z]+://[^/]+(?:/.*)?)/[^/]+/?$", 1)
    return F.when(up != "", up).otherwise(iri)


def skolem(document: Column, label: Column, base: str) -> Column:
    """An IRI for a blank node: the same label in the same document gives the same one, on every attempt."""
    return F.concat(F.lit(base), F.lit("#"), F.sha2(F.concat_ws("\x1f", document, label), 256))


def uuid7_time(change_id: Column) -> Column:
    """The time in a time-ordered UUID."""
    return F.timestamp_millis(F.conv(F.substring(F.regexp_replace(change_id, "-", ""), 1, 12), 16, 10).cast("long"))


def epoch_millis(time: Column) -> Column:
    """A time as milliseconds since 1970."""
    return F.unix_millis(time)

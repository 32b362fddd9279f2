"""Encoding of rows that come in another order each time, and of long words."""

import random

import pytest
from pyspark.sql import functions as F

from lumengraph.llm import pieces, queries


@pytest.fixture(scope="module")
def model(spark):
    return pieces.load(spark, queries.TOKENIZER)


def test_spans_put_together_are_the_text():
    rng = random.Random(2)
    for _ in range(20_000):
        text = "".join(rng.choice("ab  \n\n▁.") for _ in range(rng.randrange(0, 9)))
        words = [pieces._word(s) for s in pieces._spans(text)]
        assert "".join(words) == pieces.normalized(text)
        assert [y for x in words for y in pieces.WORD.findall(x)] == pieces.WORD.findall(pieces.normalized(text))


def test_rows_may_come_in_another_order(spark, model, monkeypatch):
    monkeypatch.setattr(pieces, "BLOCK_CHARS", 200)
    rng = random.Random(5)
    rows = spark.createDataFrame([(i, " ".join(rng.choice(["alpha", "beta", "ab", "ba", "x1"]) for _ in range(30))) for i in range(60)], "doc_id long, text string").repartition(3)
    shuffled = rows.orderBy(F.rand())
    want = {r.doc_id: r.text for r in rows.collect()}
    assert {r.doc_id: r.text for r in pieces.encode(shuffled, model, decoded=True).collect()} == want


def test_a_broken_promise_is_an_error(spark, model, monkeypatch):
    rows = spark.createDataFrame([(1, "one two"), (2, "three")], "doc_id long, text string").coalesce(1)
    real, calls = pieces.written, []

    def other(df, name, **more):  # what the vocabularies were made from is not what is read later
        calls.append(name)
        return real(df.withColumn("digest", F.col("digest") + 1), name, **more)

    monkeypatch.setattr(pieces, "written", other)
    with pytest.raises(Exception, match="another order"):
        pieces.encode(rows, model, stable=True).collect()
    assert calls == ["vocabularies"]


def test_long_words(spark, model):
    rng = random.Random(7)
    han = "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(20_000))
    mixed = "".join(rng.choice(["th", "e", "in", "漢", "é", "xx"]) for _ in range(3_000))
    rows = spark.createDataFrame([(1, han), (2, "a" * 5_000), (3, mixed)], "doc_id long, text string")
    got = {r.doc_id: r for r in pieces.encode(rows, model, decoded=True).collect()}
    assert [got[i].text for i in (1, 2, 3)] == [han, "a" * 5_000, mixed] and all(r.n_words == 1 for r in got.values())


def test_windows_give_the_same_paths(spark, model, monkeypatch):
    rng = random.Random(1)
    words = ["".join(rng.choice(["th", "e", "in", "on", "a", "é", "漢", "xx", pieces.SPACE]) for _ in range(n)) for n in (1, 5, 12, 25, 40)]
    table = spark.createDataFrame([(w,) for w in words], "word string")
    whole = {r.word: list(r.ids) for r in pieces.encode_words(table, model, []).collect()}
    monkeypatch.setattr(pieces, "WINDOW", 16)
    assert {r.word: list(r.ids) for r in pieces.encode_words(table, model, []).collect()} == whole

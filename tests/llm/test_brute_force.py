"""What no SQL states: features and fit of the quality model, paraphrases, kept rows, rules of common tokens."""

import random

import duckdb
import numpy as np

from lumengraph.llm import decontaminate, language, quality, queries, simhash, urls

SF = "/root/testdata/sf0.01"


def test_indicators_are_the_hashed_grams():
    rng = random.Random(1)
    for _ in range(30):
        text = " ".join(rng.choice(["ab", "b", "é", "xyz"]) for _ in range(rng.randrange(12))).encode()
        padded, want = b" " + text + b" ", set()
        for n in quality.GRAMS:
            for i in range(len(padded) - n + 1):
                want.add(((int.from_bytes(padded[i : i + n], "big") + (n << 40)) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 48)
        words, most = text.split(), 1
        for i in range(len(words)):
            j = i
            while j < len(words) and words[j] == words[i]:
                j += 1
            most = max(most, j - i)
        want = {x for x in want if x >= len(quality.REPEATS)} | {k for k, r in enumerate(quality.REPEATS) if most >= r}
        assert set(next(iter(quality.indicators([text]))).tolist()) == want


def test_the_fit_is_the_optimum(monkeypatch):
    monkeypatch.setattr(quality, "PASSES", 4000)
    rng = np.random.default_rng(3)
    rows = [np.sort(rng.choice(12, 5, replace=False)) for _ in range(40)]
    labels = [int(3 in r or rng.random() < 0.2) for r in rows]
    (weights, squares), bias, _, _ = quality.fit(rows, labels)
    x = np.zeros((40, quality.BUCKETS))
    for i, r in enumerate(rows):
        x[i, r] = 1
    y = np.where(np.array(labels) == 1, 1.0, -1.0)
    ratio = np.log((x[y > 0].sum(0) + 1) / (y > 0).sum()) - np.log((x[y < 0].sum(0) + 1) / (y < 0).sum())
    scaled = np.hstack([x[:, :12] * ratio[:12], np.ones((40, 1))])
    scaled /= np.sqrt((scaled**2).sum(1, keepdims=True))
    cost = np.where(y > 0, 40 / (2 * (y > 0).sum()), 40 / (2 * (y < 0).sum()))
    w, alpha = np.zeros(13), np.zeros(40)
    for _ in range(20_000):  # plain dual coordinate descent, in order
        for i in range(40):
            new = np.clip(alpha[i] - (y[i] * (scaled[i] @ w) - 1), 0, cost[i])
            w += (new - alpha[i]) * y[i] * scaled[i]
            alpha[i] = new
    assert np.allclose(weights[:12], w[:12] * ratio[:12], atol=1e-3) and abs(bias - w[12]) < 1e-3 and np.allclose(squares, ratio**2)


def test_paraphrases_are_found(spark):
    rng = random.Random(9)
    items = {r.item_id: r.text.split() for r in queries.table(spark, SF, "benchmark").collect()}
    filler = [w for r in queries.table(spark, SF, "documents").limit(200).collect() for w in (r.text or "").split()]
    planted, texts = {}, []
    for k, (item, words) in enumerate(items.items()):
        body, end = words[:-6], words[-6:]
        if k % 3 == 0:
            body = [w for w in body if rng.random() > 0.25]  # words left out
        elif k % 3 == 1:
            for i in range(0, len(body) - 1, 4):  # words swapped
                body[i], body[i + 1] = body[i + 1], body[i]
        else:
            body = [rng.choice(filler) if rng.random() < 0.25 else w for w in body]  # words replaced
        noise = lambda: " ".join(rng.choice(filler) for _ in range(150))
        planted[len(texts)] = item
        texts.append(f"{noise()} {' '.join(body + end)} {noise()}")
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    everything = rows.unionByName(queries.table(spark, SF, "documents").selectExpr("doc_id + 1000000 as doc_id", "text"))
    found = {(r.doc_id, r.item_id) for r in decontaminate.leaks(everything, queries.table(spark, SF, "benchmark")).where("doc_id < 1000000").collect()}
    assert len(found & set(planted.items())) >= 0.9 * len(planted)
    assert len(found - set(planted.items())) <= 0.05 * len(planted)


def test_one_row_of_each_group_is_kept(spark):
    long = " ".join(f"word{i}" for i in range(60))
    data = [(1, long, "a"), (1, long, "b"), (2, long, "c"), (3, "other words here", "d"), (3, "quite another text", "e"), (None, "only one without an id", "f"), (None, long, "g"), (4, None, "h"), (5, "", "i"), (6, " ", "j")]
    rows = spark.createDataFrame(data, "doc_id long, text string, key string").withColumnRenamed("key", "row")
    for given in (rows, rows.repartition(3)):
        kept = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in simhash.keep_one(given).collect())
        assert kept == [(False, 1, long), (False, 3, "other words here"), (False, 3, "quite another text"), (False, 4, ""), (True, 0, "only one without an id"), (True, 0, long)]
        assert simhash.keep_one(given).columns == ["doc_id", "text", "row"]


def test_a_token_of_all_urls(spark):
    given = [(f"https://site.net/{'win' if i % 4 == 0 else 'news'}/{'été' if i % 2 else 'x'}/{i}", i % 4 == 0) for i in range(80)]
    labelled = spark.createDataFrame(given, "url string, blocked boolean")
    rules = urls.mine(labelled)
    assert {"p:win"} <= {r.token for r in rules.collect()}
    got = {r.url for r in urls.matches(labelled.select("url"), rules).collect()}
    assert got == {u for u, b in given if b}
    assert "p:été" in spark.createDataFrame([(given[1][0],)], "url string").select(urls.tokens(urls.F.col("url")).alias("t")).first().t


def test_urls_match_their_sql(spark):
    own = duckdb.connect()
    for n in ("pages", "labels"):
        own.execute(f"CREATE VIEW {n} AS SELECT * FROM '{SF}/{n}.parquet'")
    want = own.sql(queries.ORACLE_SQL["op6_urls"])
    names = want.columns
    assert sorted(map(repr, want.fetchall())) == sorted(repr(tuple(r[c] for c in names)) for r in queries.op6_urls(spark, SF).collect())


def test_languages_by_plain_code_lengths(spark):
    """Predictions against code lengths reckoned byte by byte from the counts, escape by escape."""
    docs = queries.table(spark, "/root/testdata/sf0.001", "documents")
    rows = [(r.lang, r.text) for r in docs.where("lang is not null and length(text) > 0").limit(60).collect()]
    trees = language.train_counts(rows)
    model = language.fold(trees)

    def bits(tree, text):
        data, total = b"\n" * language.ORDER + text, 0.0
        for i in range(language.ORDER, len(data)):
            for k in range(language.ORDER, -1, -1):
                follow = tree[k].get(data[i - k : i])
                if follow is None:
                    continue
                n, kinds = sum(follow.values()), len(follow)
                if data[i] in follow:
                    total += np.log2((n + kinds) / follow[data[i]])
                    break
                total += np.log2((n + kinds) / kinds)
            else:
                total += 8
        return total

    texts = [r.text[:400].encode() for r in docs.limit(40).collect() if r.text] + [b"", "漢字 x".encode()]
    got = language.code_lengths(model, texts)
    for t, own in zip(texts, got, strict=True):
        assert np.allclose(own, [bits(trees[x], t) for x in model.languages], rtol=1e-4, atol=1e-3)

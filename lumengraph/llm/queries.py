"""The queries of this subpackage: thin calls of the operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumengraph.llm import decontaminate, html, language, neighbours, pieces, quality, secrets, simhash, urls, windows
from lumengraph.llm.common import learns

#: The vocabulary file that texts are encoded with; a parameter of the query.
TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = language.identify(docs, language.train(docs))
    return out.select("doc_id", F.coalesce(~learns(F.col("doc_id")), F.lit(True)).alias("held_out"), "lang_pred", "score")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(~learns(F.col("doc_id")), F.lit(True)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_pieces(spark: SparkSession, sf_dir: str, model: str = TOKENIZER) -> DataFrame:
    """Each document's ids, and the text that these decode to."""
    return pieces.encode(table(spark, sf_dir, "documents"), pieces.load(spark, model), stable=True, decoded=True)


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page is labelled through the document whose number its path ends with: blocked if that is of low quality or toxic."""
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    number = F.expr("try_cast(regexp_extract(url, '://[^/?#]*/[a-z]+/([0-9]+)', 1) as bigint)")
    marks = labels.groupBy(F.col("doc_id").alias("number")).agg(F.max((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("blocked"))
    return urls.judge(pages, pages.select("url", number.alias("number")).join(marks, "number").select("url", "blocked"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "cosine", "lcs", "answer")


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("secrets", lambda s: s["number"] < len(secrets.BASE))
    return found.select("doc_id", *(count(r.kind) for r in secrets.BASE), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("secrets")).alias("spans"))


def op10_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language": op1_language,
    "op2_pieces": op2_pieces,
    "op3_html": op3_html,
    "op4_quality": op4_quality,
    "op5_simhash": op5_simhash,
    "op6_urls": op6_urls,
    "op7_decontaminate": op7_decontaminate,
    "op8_neighbours": op8_neighbours,
    "op9_secrets": op9_secrets,
    "op10_windows": op10_windows,
}

ORACLE_SQL: dict[str, str] = {
    "op6_urls": r"""
        WITH parts AS (
            SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest,
                   try_cast(regexp_extract(url, '://[^/?#]*/[a-z]+/([0-9]+)', 1) AS BIGINT) AS number FROM pages),
        p AS (
            SELECT page_id, url, number, translate(regexp_extract(coalesce(rest, ''), '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(coalesce(rest, ''), '(?s)^[^/?#]*([^?#]*)', 1) AS path,
                   regexp_extract(coalesce(rest, ''), '(?s)^[^?#]*(.*)$', 1) AS extra, regexp_extract(coalesce(url, ''), '(?s)^(.*?)://', 1) AS scheme FROM parts),
        token AS (
            SELECT DISTINCT url, t FROM (
                SELECT url, 's:' || lower(unnest(regexp_extract_all(scheme, '\p{L}+'))) AS t FROM p
                UNION ALL SELECT url, 'h:' || lower(unnest(regexp_extract_all(host, '\p{L}+'))) FROM p
                UNION ALL SELECT url, 'p:' || lower(unnest(regexp_extract_all(path, '\p{L}+'))) FROM p
                UNION ALL SELECT url, 'q:' || lower(unnest(regexp_extract_all(extra, '\p{L}+'))) FROM p)),
        bag AS (SELECT url, list_sort(list(t)) AS ts FROM token GROUP BY url),
        sets AS (SELECT url, list_sort(list(t)) AS s FROM (SELECT url, m, unnest(ts) AS t, generate_subscripts(ts, 1) AS i FROM (SELECT url, ts, unnest(range(1, 1 << len(ts))) AS m FROM bag)) WHERE (m >> (i - 1)) & 1 = 1 GROUP BY url, m),
        marks AS (SELECT doc_id AS number, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS blocked FROM labels GROUP BY 1),
        labelled AS (SELECT url, blocked FROM p JOIN marks USING (number)),
        rules AS (
            SELECT s FROM labelled JOIN sets USING (url) GROUP BY s
            HAVING sum(blocked) >= ceil(least(1.0, greatest(0.002, 5 / (SELECT count(*) FROM labelled))) * (SELECT count(*) FROM labelled)) AND sum(blocked) / count(*) >= 0.6),
        hit AS (SELECT DISTINCT url FROM sets JOIN rules USING (s)),
        listed(rh, rp, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
        own AS (
            SELECT page_id, url, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS v FROM p JOIN listed
            ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY 1, 2)
        SELECT p.page_id, host, path, rule, coalesce(v, CASE WHEN hit.url IS NULL THEN 'allow' ELSE 'block' END) AS verdict
        FROM p LEFT JOIN own ON p.page_id = own.page_id AND p.url = own.url LEFT JOIN hit ON p.url = hit.url
    """,
    "op10_windows": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT r, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
        k AS (SELECT r, i, count(*) OVER (PARTITION BY md5(array_to_string(w[i:i + 34], ' '))) AS n FROM s JOIN d USING (r)),
        gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM k WHERE n > 1),
        words AS (SELECT r, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d),
        kept AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (r, p) GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (r)
    """,
}

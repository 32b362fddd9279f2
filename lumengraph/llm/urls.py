"""URL filtering by listed rules and by association rules that FP-growth mines from labelled URLs; DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumengraph.llm.common import written

#: Mined rules hold for this share of the labelled URLs, for so many at least, and are right for this share of their URLs.
MIN_SUPPORT, LEAST_URLS, MIN_CONFIDENCE = 0.002, 5, 0.6
#: Mined rules are broadcast up to so many; beyond that they are joined by a shuffle.
BROADCAST_RULES = 50_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Listed:
    host: str
    path: str
    verdict: str


#: The listed rules.
LISTED = (
    Listed("org", "/", "allow"),
    Listed("example.org", "/es/", "block"),
    Listed("example.org", "/en/1", "block"),
    Listed("com", "/fr/", "allow"),
    Listed("com", "/de/", "block"),
)


def _rest(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"(?s)^([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def listed(h: Column, p: Column, rules: tuple[Listed, ...] = LISTED) -> Column:
    """The longest listed rule that fits a host, its subdomains included, and the start of a path: struct (rule, verdict)."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: len(r.host + r.path)):
        fits = ((h == r.host) | F.endswith(h, F.lit(f".{r.host}"))) & F.startswith(p, F.lit(r.path))
        out = F.when(fits, F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(url: Column) -> Column:
    """The distinct words of a URL that no number is part of, each with the part of the URL it stands in."""
    words = lambda text, part: F.transform(F.regexp_extract_all(text, F.lit(r"\p{L}+"), 0), lambda w: F.concat(F.lit(part), F.lower(w)))
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    extra = F.regexp_extract(_rest(url), r"(?s)^[^?#]*(.*)$", 1)
    return F.array_sort(F.array_distinct(F.concat(words(scheme, "s:"), words(host(url), "h:"), words(path(url), "p:"), words(extra, "q:"))))


def mine(labelled: DataFrame) -> DataFrame:
    """(rule, token, size): the tokens of each mined combination that stands for blocking, from labelled(url, blocked).

    One basket a row, repeated rows included; null urls and labels are left out. No label, no rule.
    """
    mark = "!blocked"
    baskets = written(labelled.where("url is not null and blocked is not null").select(F.concat(tokens(F.col("url")), F.when(F.col("blocked"), F.array(F.lit(mark))).otherwise(F.array().cast("array<string>"))).alias("items")).where(F.size("items") > 0), "url-baskets")
    n = baskets.count()
    empty = baskets.select(F.lit("").alias("rule"), F.lit("").alias("token"), F.lit(0).alias("size")).limit(0)
    if not n:
        return empty
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(MIN_SUPPORT, LEAST_URLS / n)), minConfidence=MIN_CONFIDENCE).fit(baskets)
    rules = model.associationRules.where(F.col("consequent") == F.array(F.lit(mark))).select(F.array_sort("antecedent").alias("antecedent"))
    return written(rules.select(F.array_join("antecedent", " ").alias("rule"), F.explode("antecedent").alias("token"), F.size("antecedent").alias("size")), "url-rules")


def matches(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url): the distinct urls of urls(url) that hold all tokens of any rule.

    The inverted index has each rule under the one of its tokens that fewest urls hold, so that a token which nearly every url
    has brings no url and rule together unless a rule consists of such tokens; the rule's other tokens are then looked for
    in the url. Null urls hold none.
    """
    held = urls.where("url is not null").distinct().select("url", tokens(F.col("url")).alias("tokens"))
    each = held.select("url", "tokens", F.explode("tokens").alias("token"))
    counts = each.join(rules.select("token").distinct(), "token", "left_semi").groupBy("token").count()
    rare = F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "token"))["token"].alias("token")
    index = written(rules.join(counts, "token", "left").groupBy("rule").agg(rare, F.collect_set("token").alias("wanted")).select("token", "wanted"), "url-index")
    few = index.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES
    hits = each.join(F.broadcast(index) if few else index, "token")
    return hits.where(F.size(F.array_except("wanted", "tokens")) == 0).select("url").distinct()


def judge(pages: DataFrame, labelled: DataFrame, rules: tuple[Listed, ...] = LISTED, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of pages.

    The longest listed rule that fits decides, and is named in rule. Else rule is null, and the verdict is block if a mined
    rule matches the url, and allow if not. A null url, or one without ``://``, has an empty host and path, and is allowed
    if no mined rule matches. Repeated rows and null ids are kept; an empty table gives an empty table.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"))
    hit = matches(rows.select("url"), mine(labelled)).select("url", F.lit(True).alias("hit"))
    out = rows.join(hit, "url", "left").select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), "hit")
    own = listed(F.col("host"), F.col("path"), rules)
    return out.select("page_id", "host", "path", own["rule"].alias("rule"), F.coalesce(own["verdict"], F.when(F.col("hit"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"))

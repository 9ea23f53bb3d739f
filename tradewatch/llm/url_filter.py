"""URL filters: listed rules first, mined association rules for the rest.

Listed rules name a host (with its subdomains) and a path prefix; the longest that fits decides.
For other urls FP-growth mines combinations of url tokens from labelled pages. A combination with
enough bad pages (support) of which enough are bad (confidence) becomes a blocking rule. Mined rules
are matched by an inverted index: every rule is filed under its rarest token, a url looks up its
tokens, and the few rules found are verified against its token set.

Work at scale: listed rules are expressions, evaluated row by row. FP-growth distributes its
conditional trees. Matching sees distinct urls and joins on the rarest token of a rule, so a token
that most urls share (a hot host, a top-level domain) is a look-up key only for rules that have
nothing rarer. All joins are ordinary equi-joins, sized by Spark at run time.

Defined results: a NULL url or one without ``://`` has an empty host and path, no tokens, and the
method's verdict allow. Repeated urls get the same verdict. Labels that are NULL do not count as
bad; pages without a label are not mined. Without labels nothing is mined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewatch.llm.common import written

#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))
MIN_SUPPORT, MIN_PAGES, MIN_CONFIDENCE = 0.002, 10, 0.6
_BAD = "@bad"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def listed_rule(host_col: Column, path_col: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest fitting rule (ties: the longer host), else NULL."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]))):
        fits = ((host_col == h) | F.endswith(host_col, F.lit("." + h))) & F.startswith(path_col, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(url: Column) -> Column:
    """Distinct tokens: labels of the host, segments of the path (numbers as #), names of the query."""
    host_parts = F.transform(F.split(host(url), "[.]"), lambda x: F.concat(F.lit("h:"), x))
    path_parts = F.transform(F.split(path(url), "/"), lambda x: F.concat(F.lit("p:"), F.regexp_replace(x, "[0-9]+", "#")))
    query = F.regexp_extract(url, "(?s)^[^?#]*[?]([^#]*)", 1)
    query_parts = F.transform(F.split(query, "&"), lambda x: F.concat(F.lit("q:"), F.regexp_extract(x, "^[^=]*", 0)))
    every = F.array_distinct(F.concat(host_parts, path_parts, query_parts))
    return F.coalesce(F.filter(every, lambda x: F.length(x) > 2), F.array().cast("array<string>"))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_pages: int = MIN_PAGES,
         min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(url, bad) to rules (items, confidence, support): token sets of any size. A rule needs
    ``min_support`` of all labelled pages, and ``min_pages`` of them, to be bad with it. Rules that
    hold another rule and one token more are left out: whatever they hit, the smaller one hits."""
    spark = labelled.sparkSession
    none = spark.sql("SELECT array('') AS items, 0D AS confidence, 0D AS support WHERE false")
    baskets = labelled.select(F.concat(tokens(F.col("url")), F.when(F.col("bad"), F.array(F.lit(_BAD))).otherwise(
        F.array().cast("array<string>"))).alias("items"))
    baskets = written(baskets, "baskets")
    n = baskets.count()
    if not n:
        return none
    least = max(min_pages, -int(-min_support * n // 1))
    if least > n:
        return none
    model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / n, minConfidence=min_confidence).fit(baskets)
    rules = model.associationRules.filter(F.element_at("consequent", 1) == _BAD)
    rules = written(rules.select(F.array_sort("antecedent").alias("items"), "confidence", "support"), "url-rules")
    smaller = F.transform("items", lambda x: F.array_remove("items", x))
    larger = rules.select("items", F.explode(smaller).alias("less")).join(rules.select(F.col("items").alias("less")), "less", "left_semi")
    return written(rules.join(larger.select("items").distinct(), "items", "left_anti"), "least-url-rules")


def matched_urls(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct urls (column url) that hold all tokens of some rule."""
    has = urls.select("url").distinct().withColumn("tokens", tokens(F.col("url")))
    posted = has.select("url", "tokens", F.explode("tokens").alias("token"))
    # only tokens that occur in rules are counted
    in_rules = rules.select(F.explode("items").alias("token")).distinct()
    seen = posted.join(in_rules, "token", "left_semi").groupBy("token").count()
    filed = rules.withColumn("rule", F.monotonically_increasing_id()).select("rule", "items", F.explode("items").alias("token"))
    filed = filed.join(seen, "token").groupBy("rule").agg(F.min(F.struct("count", "token")).alias("least"), F.first("items").alias("items"))
    index = filed.select(F.col("least.token").alias("token"), "items")
    hits = posted.join(index, "token").filter(F.size(F.array_except("items", "tokens")) == 0)
    return hits.select("url").distinct()


def judge(pages: DataFrame, labels: DataFrame, url_col: str = "url", page_id: str = "page_id", label_id: str = "doc_id",
          rules: Sequence[tuple[str, str, str]] = RULES, **mining) -> DataFrame:
    """``pages`` with host, path, rule and verdict. A page is bad if its label has quality 0 or
    toxic 1."""
    rest = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    bad = labels.groupBy(F.col(label_id).alias("_id")).agg(
        F.coalesce(F.max((F.col("quality") == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)), F.lit(False)).alias("bad"))
    keyed = pages.select(F.col(page_id).alias("_id"), F.col(url_col).alias("url"))
    mined = mine(keyed.join(bad, "_id").select("url", "bad"), **mining)
    out = pages.select(*rest, host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))
    out = out.withColumn("_listed", listed_rule(F.col("host"), F.col("path"), rules))
    open_urls = out.filter(F.col("_listed").isNull() & F.col(url_col).isNotNull()).select(F.col(url_col).alias("url"))
    hits = matched_urls(open_urls, mined).select(F.col("url").alias("_hit"))
    out = out.join(hits, F.col(url_col) == F.col("_hit"), "left")
    verdict = F.coalesce(F.col("_listed.verdict"), F.when(F.col("_hit").isNotNull(), "block").otherwise("allow"))
    return out.select(*rest, "host", "path", F.col("_listed.rule").alias("rule"), verdict.alias("verdict"))


SQL = f"""
WITH u AS (SELECT page_id, url, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}'), '') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
  coalesce(regexp_extract(url, '(?s)^[^?#]*[?]([^#]*)', 1), '') AS query FROM pages),
tok AS (SELECT DISTINCT page_id, url, token FROM (
  SELECT page_id, url, unnest(list_transform(string_split(host, '.'), lambda x: 'h:' || x)
    || list_transform(string_split(path, '/'), lambda x: 'p:' || regexp_replace(x, '[0-9]+', '#', 'g'))
    || list_transform(string_split(query, '&'), lambda x: 'q:' || regexp_extract(x, '^[^=]*'))) AS token FROM u) WHERE length(token) > 2),
lab AS (SELECT doc_id, coalesce(bool_or(quality = 0 OR coalesce(toxic, 0) = 1), false) AS bad FROM labels GROUP BY doc_id),
n AS (SELECT greatest({MIN_PAGES}, ceil({MIN_SUPPORT} * count(*))) AS least FROM u JOIN lab ON page_id = doc_id),
t AS (SELECT tok.*, bad FROM tok JOIN lab ON page_id = doc_id),
combos AS (SELECT page_id, bad, [token] AS items FROM t
  UNION ALL SELECT a.page_id, a.bad, [a.token, b.token] FROM t a JOIN t b ON a.page_id = b.page_id AND a.token < b.token
  UNION ALL SELECT a.page_id, a.bad, [a.token, b.token, c.token] FROM t a JOIN t b ON a.page_id = b.page_id AND a.token < b.token
    JOIN t c ON a.page_id = c.page_id AND b.token < c.token),
rules AS (SELECT items FROM combos, n GROUP BY items, least
  HAVING count(*) FILTER (bad) >= least AND count(*) FILTER (bad) / count(*)::DOUBLE >= {MIN_CONFIDENCE}),
hit AS (SELECT DISTINCT url FROM (SELECT page_id, url, list(token) AS tokens FROM tok GROUP BY ALL), rules WHERE list_has_all(tokens, items)),
l AS (SELECT v.*, h || p AS rule, length(h) + length(p) AS size, length(h) AS host_size FROM (VALUES
  {', '.join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)}) v(verdict, h, p)),
fit AS (SELECT page_id, url, arg_max(rule, (size, host_size)) AS rule, arg_max(verdict, (size, host_size)) AS verdict
  FROM u JOIN l ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY ALL)
SELECT u.page_id, host, path, fit.rule, coalesce(fit.verdict, CASE WHEN hit.url IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN fit ON u.page_id = fit.page_id AND u.url = fit.url LEFT JOIN hit ON u.url = hit.url
"""

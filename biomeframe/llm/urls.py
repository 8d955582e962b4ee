"""URL filters by redirect equivalence, in DataFrame functions only.

Explicit rules (host, path prefix) judge a URL first.  URLs tied by redirects or canonical links are
aliases: distributed connected components over those edges give their classes, and a class with a blocked
member and no explicitly allowed one blocks its members that no rule names.
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import cut, prepare, small
from .components import connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (action, host, path): a rule fits its host and all subdomains where the path starts with its path.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]

LINK = r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""
REFRESH = r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""
HREF = r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)"""
TARGET = r"""(?is)\burl\s*=\s*["']?([^"'\s>]+)"""

#: Numeric references to C1 controls, which mean Windows-1252 characters.
WINDOWS = {str(n): bytes([n]).decode("cp1252") for n in range(0x80, 0xA0) if n not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def node_of(url: Column) -> Column:
    """The URL without its fragment; the node of redirects and canonical links."""
    return F.regexp_extract(url, r"(?s)^([^#]*)", 1)


def unescape(text: Column) -> Column:
    """An attribute's text with its character references decoded as HTML does."""
    names = F.from_json(F.lit(json.dumps(html5)), "map<string,string>")
    windows = F.from_json(F.lit(json.dumps(WINDOWS)), "map<string,string>")

    def number(digits: Column, base: int) -> Column:
        digits = F.regexp_replace(digits, "^0+(?=.)", "")
        n = F.when(F.length(digits) <= 7, F.conv(digits, base, 10).cast("long"))
        known = (n > 0) & (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
        return F.coalesce(F.try_element_at(windows, n.cast("string")), F.when(known, char), F.lit("\ufffd"))

    def piece(x: Column) -> Column:
        whole = F.regexp_extract(x, r"^&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;?)", 0)
        rest = F.substr(x, F.length(whole) + 1)
        tens, hexes = F.regexp_extract(whole, "^&#([0-9]+)", 1), F.regexp_extract(whole, "^&#[xX]([0-9a-fA-F]+)", 1)
        named = F.when(whole.endswith(";") | ~rest.startswith("="), F.try_element_at(names, F.substr(whole, F.lit(2))))
        return F.concat(F.coalesce(F.when(tens != "", number(tens, 10)), F.when(hexes != "", number(hexes, 16)), named, whole), rest)

    return F.when(text.contains("&"), F.array_join(F.transform(F.split(text, "(?=&)"), piece), "")).otherwise(text)


def without_dots(path: Column) -> Column:
    """A path that starts with ``/``, without its ``.`` and ``..`` segments."""
    parts = F.split(path, "/", -1)
    dots = F.array(F.lit("."), F.lit(".."))
    up = lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(x == ".", acc).otherwise(F.concat(acc, F.array(x)))
    kept = F.aggregate(F.slice(parts, 2, F.size(parts)), F.array().cast("array<string>"), up)
    end = F.when(F.array_contains(dots, F.element_at(parts, -1)), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.lit("/"), F.array_join(F.concat(kept, end), "/"))


def resolve(target: Column, url: Column) -> Column:
    """The target as an absolute URL without fragment, seen from a page's URL; null if it names no other page."""
    to = node_of(target)
    scheme, site = F.regexp_extract(url, r"^([^/?#:]*:)//", 1), F.regexp_extract(url, r"^([^/?#]*://[^/?#]*)", 1)
    path = F.when(path_of(url) == "", "/").otherwise(path_of(url))
    own, query = F.regexp_extract(to, r"(?s)^([^?]*)", 1), F.regexp_extract(to, r"(?s)(\?.*)$", 1)
    under = F.concat(F.regexp_extract(path, r"(?s)^(.*/)", 1), own)
    absolute = F.when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.when(to.contains("://"), to)).when((to == "") | (site == ""), F.lit(None))
    absolute = absolute.when(to.startswith("//"), F.concat(scheme, to)).when(to.startswith("?"), F.concat(site, path, to))
    return absolute.otherwise(F.concat(site, without_dots(F.when(to.startswith("/"), own).otherwise(under)), query))


def page_edges(pages: DataFrame) -> DataFrame:
    """``(src, dst)`` between a page's URL and its canonical link or refresh target, where there is one.

    Null urls and html give no edge, repeated ones give one.

    Character references in targets are decoded, and relative targets are resolved against the page's URL.
    """
    link = F.regexp_extract(F.regexp_extract("html", LINK, 0), HREF, 1)
    refresh = F.regexp_extract(F.regexp_extract("html", REFRESH, 0), TARGET, 1)
    found = pages.where("url is not null and html is not null").where(F.col("html").rlike(r"(?i)canonical|http-equiv"))
    found = found.select("url", F.explode(F.array(link, refresh)).alias("to")).where("to != ''")
    # The table of names is a large literal: the cut keeps the plans from holding it at each use of the target.
    found = cut(found.select("url", unescape(F.col("to")).alias("to")))
    found = found.select(node_of(F.col("url")).alias("src"), resolve(F.col("to"), F.col("url")).alias("dst")).distinct()
    return found.where("src != dst")


def rule_verdicts(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``url, host, path, rule, action`` per distinct URL; rule and action are null where none fits.

    Each URL is joined with the rules of its host's suffixes; the longest rule wins, allow before block on ties.
    """
    urls = urls.select("url").distinct().select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    tried = urls.select("url", "path", F.explode(F.array_distinct(suffixes)).alias("rule_host"))
    rules = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "action")
    fits = tried.join(small(rules), "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    rule = F.concat("rule_host", "rule_path")
    best = fits.groupBy("url").agg(F.max(F.struct(F.length(rule).alias("n"), (F.col("action") == "allow").alias("a"), rule.alias("rule"), "action")).alias("best"))
    return urls.join(best, "url", "left").select("url", "host", "path", "best.rule", "best.action")


def filter_urls(pages: DataFrame, rules: DataFrame, edges: DataFrame) -> DataFrame:
    """``page_id, host, path, rule, verdict`` per row of pages (columns page_id, url).

    A null or empty URL has an empty host and path, fits no rule, has no aliases and is allowed, without a join, so that
    such rows are no hot key.  One without ``://`` has an empty host and path too, but may have aliases.
    Repeated rows are judged alike; an empty table gives an empty result; empty rules or edges are fine.
    """
    prepare(pages.sparkSession)
    pages = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"))
    plain = pages.where("url = ''").select("page_id", F.lit("").alias("host"), F.lit("").alias("path"), F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    pages = pages.where("url != ''")
    edges = cut(edges)
    classes = cut(connected_components(edges))
    every = pages.select("url").union(classes.select(F.col("node").alias("url")))
    judged = cut(rule_verdicts(every, rules))
    ruled = judged.where("action is not null").select(node_of(F.col("url")).alias("node"), "action")
    spread = classes.join(ruled, "node").groupBy("component").agg(
        F.max((F.col("action") == "allow").cast("int")).alias("allows"), F.max((F.col("action") == "block").cast("int")).alias("blocks")
    )
    blocked = cut(classes.join(spread.where("blocks = 1 and allows = 0"), "component").select("node", F.lit(True).alias("aliased")))
    out = pages.join(judged, "url").withColumn("node", node_of(F.col("url"))).join(small(blocked), "node", "left")
    verdict = F.coalesce("action", F.when(F.col("aliased"), F.lit("block")), F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict")).unionByName(plain)


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    values = ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in RULES)
    return filter_urls(pages, spark.sql(f"select * from values {values} as r(action, host, path)"), page_edges(pages))


OP5_SQL = r"""
WITH RECURSIVE rules(action, host, path) AS (VALUES %s),
pg AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
targets AS (
  SELECT url, regexp_extract(regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>', 0), '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) AS dst FROM pg
  UNION ALL
  SELECT url, regexp_extract(regexp_extract(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>', 0), '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1) FROM pg),
absolute AS (
  SELECT url, CASE WHEN dst LIKE '/%%' AND dst NOT LIKE '//%%' THEN regexp_extract(url, '^([^/?#]*://[^/?#]*)', 1) || dst ELSE dst END AS dst
  FROM targets WHERE dst <> ''),
links AS (SELECT DISTINCT split_part(url, '#', 1) AS a, split_part(dst, '#', 1) AS b FROM absolute WHERE dst LIKE '%%://%%'),
both_ways AS (SELECT a, b FROM links WHERE a <> b UNION SELECT b, a FROM links WHERE a <> b),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON l.a = r.b),
urls AS (SELECT DISTINCT url FROM pg UNION SELECT a FROM both_ways),
parts AS (
  SELECT url, translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path FROM urls),
judged AS (
  SELECT p.url, p.host, p.path, r.host || r.path AS rule, r.action,
         row_number() OVER (PARTITION BY p.url ORDER BY length(r.host || r.path) DESC, r.action) AS k
  FROM parts p LEFT JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)),
best AS (SELECT * FROM judged WHERE k = 1),
spread AS (
  SELECT r.a, max(CASE WHEN v.action = 'block' THEN 1 ELSE 0 END) AS blocks, max(CASE WHEN v.action = 'allow' THEN 1 ELSE 0 END) AS allows
  FROM reach r JOIN best v ON split_part(v.url, '#', 1) = r.b GROUP BY r.a)
SELECT pg.page_id, v.host, v.path, v.rule, coalesce(v.action, CASE WHEN s.blocks = 1 AND s.allows = 0 THEN 'block' END, 'allow') AS verdict
FROM pg JOIN best v ON v.url = pg.url LEFT JOIN spread s ON s.a = split_part(pg.url, '#', 1)
""" % ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in RULES)

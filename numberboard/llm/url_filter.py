"""URL filter over redirect equivalence: block decisions reach every alias of a blocked page.

Pages and the targets of their canonical links and redirects are vertices, known by lower-cased host
and the rest of the url without its fragment (a scheme makes no difference). The connected components
of these links are the sets of aliases. A url's own longest rule decides. A url without one takes the
decision of its aliases: allow if any alias is explicitly allowed, else block if any is blocked, else
allow.

Defined cases: a null url or one without ``://`` has empty host and path, fits no rule, has no
aliases and is allowed. Null or empty html has no links. Links to pages outside the table count.
Repeated rows each give a row. Equal rules with different verdicts: allow wins. An empty table gives
an empty result. Other columns of the table are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from numberboard.llm.components import components
from numberboard.llm.frames import written

#: (host, path, verdict): a rule fits its host and all subdomains below its path.
PRODUCTION_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
RULES_SCHEMA = "rule_host string, rule_path string, rule_verdict string"

LINK_TAG = r"(?i)<link\b[^>]*>"
META_TAG = r"(?i)<meta\b[^>]*>"
CANONICAL = r"""(?i)\brel\s*=\s*["']?canonical\b"""
REFRESH = r"""(?i)\bhttp-equiv\s*=\s*["']?refresh\b"""
HREF = r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)"""
REFRESH_URL = r"""(?i)\burl\s*=\s*["']?([^"'\s>;]+)"""


def lower_ascii(x: Column) -> Column:
    return F.translate(x, string.ascii_uppercase, string.ascii_lowercase)


def url_parts(url: Column) -> dict[str, Column]:
    """``host``, ``path`` and the vertex ``node`` of a url; empty, empty and null without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3, F.length(url)))
    host = lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0))
    return {
        "host": F.coalesce(host, F.lit("")),
        "path": F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit("")),
        "node": F.concat(host, F.regexp_extract(rest, r"^[^/?#]*([^#]*)", 1)),
    }


def link_targets(html: Column) -> Column:
    """Urls that the page names as its canonical form or sends its readers to."""
    links = F.filter(F.regexp_extract_all(html, F.lit(LINK_TAG), 0), lambda x: x.rlike(CANONICAL))
    metas = F.filter(F.regexp_extract_all(html, F.lit(META_TAG), 0), lambda x: x.rlike(REFRESH))
    found = F.concat(
        F.transform(links, lambda x: F.regexp_extract(x, HREF, 1)),
        F.transform(metas, lambda x: F.regexp_extract(x, REFRESH_URL, 1)),
    )
    return F.transform(F.filter(found, lambda x: x != ""), lambda x: F.replace(x, F.lit("&amp;"), F.lit("&")))


def resolved(target: Column, host: Column, path: Column) -> Column:
    """An absolute url of a link found on a page."""
    site = F.concat(F.lit("http://"), host)
    return (
        F.when(F.locate("://", target) > 0, target)
        .when(target.startswith("//"), F.concat(F.lit("http:"), target))
        .when(target.startswith("/"), F.concat(site, target))
        .otherwise(F.concat(site, F.coalesce(F.nullif(F.regexp_extract(path, "^.*/", 0), F.lit("")), F.lit("/")), target))
    )


def page_links(pages: DataFrame) -> DataFrame:
    """Edges (a, b) between vertices from canonical links and redirects in the html."""
    found = pages.select(*(c.alias(n) for n, c in url_parts(F.col("url")).items()), F.explode(link_targets(F.col("html"))).alias("target"))
    found = found.where("node IS NOT NULL").withColumn("target", resolved(F.col("target"), F.col("host"), F.col("path")))
    return found.select(F.col("node").alias("a"), url_parts(F.col("target"))["node"].alias("b"))


def host_suffixes(host: Column) -> Column:
    """``a.b.c`` -> [a.b.c, b.c, c]."""
    labels = F.split(host, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )


def longest_rule(addresses: DataFrame, rules: DataFrame) -> DataFrame:
    """The longest fitting rule of each distinct (host, path): columns host, path, rule, own.

    Equi-join on host suffixes: each address offers a few, so the work doesn't grow with rules x urls.
    """
    offers = addresses.select("host", "path").where("host <> ''").distinct()
    offers = offers.select("host", "path", F.explode(F.array_distinct(host_suffixes(F.col("host")))).alias("rule_host"))
    fits = offers.join(rules, "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    text = F.concat("rule_host", "rule_path")
    best = F.max(F.struct(F.length(text).alias("size"), text.alias("rule"), (F.col("rule_verdict") == "allow").alias("allow")))
    best = fits.groupBy("host", "path").agg(best.alias("best"))
    return best.select(
        "host", "path", "best.rule", F.when(F.col("best.allow"), "allow").otherwise("block").alias("own")
    )


def judge_urls(urls: DataFrame, links: DataFrame, rules: DataFrame) -> DataFrame:
    """Rule and verdict of every row of ``urls`` (url and any columns), ``links`` being edges (a, b) of vertices.

    Returns the columns of ``urls`` except url and html, then host, path, rule, verdict.
    """
    kept = [c for c in urls.columns if c not in ("url", "html")]
    keyed = urls.select(F.struct(*kept).alias("row"), *(c.alias(n) for n, c in url_parts(F.col("url")).items()))
    groups = written(components(links, "url-aliases"), "url-aliases")
    member = url_parts(F.concat(F.lit("http://"), F.col("id")))
    members = groups.select("component", member["host"].alias("host"), member["path"].alias("path"))
    ruled = written(longest_rule(keyed.select("host", "path").union(members.select("host", "path")), rules), "url-rules")
    decided = (
        members.join(ruled.hint("merge"), ["host", "path"])
        .groupBy("component")
        .agg(F.when(F.max(F.col("own") == "allow"), "allow").otherwise("block").alias("passed"))
    )
    passed = groups.join(decided, "component").select(F.col("id").alias("node"), "passed")
    # Both sides grow with the urls; their files are small for their rows, so their size tells nothing.
    judged = keyed.join(ruled.hint("merge"), ["host", "path"], "left").join(passed.hint("merge"), "node", "left")
    return judged.select("row.*", "host", "path", "rule", F.coalesce("own", "passed", F.lit("allow")).alias("verdict"))


def judge_pages(pages: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame = PRODUCTION_RULES) -> DataFrame:
    """Verdict of every page: page_id, host, path, rule (null if none fits), verdict."""
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(list(rules), T._parse_datatype_string(RULES_SCHEMA))
    pages = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return judge_urls(pages.select("page_id", "url"), page_links(pages), rules)

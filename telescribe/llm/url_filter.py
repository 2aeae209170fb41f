"""URL filtering by host and path rules, with decisions carried over redirects and canonical links.

Addresses that redirect or name each other as canonical are one resource: distributed connected components over those
edges carry a block to every alias, unless the address or an alias is explicitly allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telescribe.llm.common import components, written

#: Fixed values: (verdict, host, path) of the rules.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def undotted(path: Column) -> Column:
    """The path with its . and .. segments taken out."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1).isin(".", "..")
    up = lambda out: F.when(F.size(out) > 1, F.slice(out, 1, F.size(out) - 1)).otherwise(out)
    step = lambda out, x: F.when(x == ".", out).when(x == "..", up(out)).otherwise(F.concat(out, F.array(x)))
    kept = F.aggregate(F.slice(parts, 2, F.size(parts)), F.slice(parts, 1, 1), step)
    clean = F.array_join(F.when(last, F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/")
    return F.when(path.rlike(r"(?:^|/)\.\.?(?:/|$)"), clean).otherwise(path)


def address(url: Column) -> Column:
    """What two urls of one address have in common: host, path and query, without scheme and fragment; null without a host."""
    path = undotted(path_of(url))
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1)
    return F.when(host_of(url) != "", F.concat(host_of(url), F.when(path == "", "/").otherwise(path), query))


def resolved(target: Column, url: Column) -> Column:
    """The whole url that a link's target means on the page of a url; null where it means the page or no address."""
    scheme, site = F.regexp_extract(url, r"(?s)^(.*?)://", 1), F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(path_of(url), r"(?s)^(.*/)", 1)
    return (
        F.when((target == "") | target.startswith("#") | (site == ""), F.lit(None))
        .when(target.rlike(SCHEME + "//"), target)
        .when(target.rlike(SCHEME), F.lit(None))
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(site, target))
        .when(target.startswith("?"), F.concat(site, path_of(url), target))
        .otherwise(F.concat(site, F.when(folder == "", "/").otherwise(folder), target))
    )


def attribute(tag: Column, name: str) -> Column:
    found = F.regexp_extract(tag, rf"""(?is)\s{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1)
    return F.trim(F.replace(F.regexp_replace(found, r"""^["']|["']$""", ""), F.lit("&amp;"), F.lit("&")))


def links(pages: DataFrame, url: str, html: str) -> DataFrame:
    """(source, target): whole urls of every canonical link and refresh of a page; those in comments are none."""
    tags = F.regexp_extract_all(F.regexp_replace(html, r"(?s)<!--.*?-->", ""), F.lit(r"(?i)<(?:link|meta)\s[^>]*>"), F.lit(0))
    tag = pages.where(F.col(html).rlike("(?i)canonical|http-equiv") & F.col(url).isNotNull()).select(F.col(url).alias("source"), F.explode(tags).alias("tag"))
    t = F.col("tag")
    named = F.array_contains(F.split(F.lower(attribute(t, "rel")), r"\s+"), "canonical")
    refresh = F.trim(F.regexp_extract(attribute(t, "content"), r"""(?is)url\s*=\s*["']?([^"'>]+)""", 1))
    target = F.when(t.rlike("(?i)^<link") & named, attribute(t, "href")).when(t.rlike("(?i)^<meta") & (F.lower(attribute(t, "http-equiv")) == "refresh"), refresh)
    return tag.select("source", resolved(target, F.col("source")).alias("target")).where("target is not null")


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule, verdict = F.when(fits, name + start).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", redirects: DataFrame | None = None, rules=RULES) -> DataFrame:
    """page id, host, path, rule, verdict of every row.

    redirects: (source, target) urls besides the canonical links and refresh targets in the pages, whose targets are
    resolved against the page's url. An address is host, path and query; addresses that edges tie together are aliases,
    whether a page of theirs is in the table or not. A page's own rule decides; without one, an explicit allow of any
    alias, else a block of any alias, else allow. A null url, or one without ://, has an empty host and path, no aliases,
    and is allowed. Repeated rows give repeated rows; a null html has no edges; other columns are not read.
    """
    page = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("_url"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), F.col(html_col).alias("_html"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    page = page.select("*", rule.alias("rule"), verdict.alias("_own"))
    found = links(page, "_url", "_html")
    if redirects is not None:
        found = found.unionByName(redirects.select("source", "target"))
    ends = found.select("source", "target", address(F.col("source")).alias("a"), address(F.col("target")).alias("b")).where("a is not null and b is not null")
    edges = written(ends, "links")
    if not edges.limit(1).count():
        return page.select("page_id", "host", "path", "rule", F.coalesce("_own", F.lit("allow")).alias("verdict"))
    comp = components(edges.select("a", "b"))
    page = page.withColumn("_node", address(F.col("_url")))
    seen = page.where("_own is not null and _node is not null").select(F.col("_node").alias("node"), F.col("_own").alias("own"))
    for node, url in (("a", "source"), ("b", "target")):
        own = rule_of(host_of(F.col(url)), path_of(F.col(url)), rules)[1].alias("own")
        seen = seen.unionByName(edges.select(F.col(node).alias("node"), own).where("own is not null"))
    # 'allow' sorts before 'block', so the smallest verdict of a component is its explicit allow if there is one
    decided = comp.join(seen.distinct().join(comp, "node").groupBy("component").agg(F.min("own").alias("alias")), "component").select("node", "alias")
    out = page.drop("_html").join(decided, F.col("_node") == F.col("node"), "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("_own", "alias", F.lit("allow")).alias("verdict"))

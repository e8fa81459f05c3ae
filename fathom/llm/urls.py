"""URL filtering by host and path rules, extended to aliases.

A url's own rule is the longest whose host is the url's or a parent domain of it and whose
path begins the url's. Redirect and canonical-link edges join urls into classes of aliases
(distributed connected components); a url without a rule takes the class's decision: allow
if any member is explicitly allowed, else block if any is blocked, else the default.

A null url, or one without "://", has an empty host and path, fits no rule and has no
aliases. Repeated urls get one decision each row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, discard, saved

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"://([^/?#]*)([^?#]*)"
_UNREAD = r"(?is)<!--.*?(?:-->|\z)|<(script|style|textarea|title)\b.*?(?:</\1\s*>|\z)"
_LINK_TAG = r"(?i)<(?:link|meta)\b[^<>]*>"
_VALUE = r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
#: Of a link tag: whether it names the canonical page, and where; of a meta tag: whether it
#: redirects, and where.
_CANONICAL, _HREF = r"""(?i)^<link\b.*\srel\s*=\s*["']?[^"'>]*\bcanonical\b""", rf"(?i)\shref{_VALUE}"
_REFRESH, _CONTENT = r"""(?i)^<meta\b.*\shttp-equiv\s*=\s*["']?\s*refresh\b""", r"""(?i)\burl\s*=\s*["']?([^"'\s>]+)"""


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _URL, 1), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def key(url: Column) -> Column:
    """What names a url in the alias graph: host, path and query; null without "://"."""
    query = F.regexp_extract(url, r"://[^?#]*(\?[^#]*)", 1)
    return F.when(url.contains("://"), F.concat(host(url), path(url), query))


def rule_of(host_col: Column, path_col: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest fitting rule of (text like "example.com/en/7", verdict), null if none fits."""
    out = F.lit(None).cast("string")
    for text, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        domain, _, rest = text.partition("/")
        fits = ((host_col == domain) | host_col.endswith("." + domain)) & path_col.startswith("/" + rest)
        out = F.when(fits, F.lit(text)).otherwise(out)
    return out


def verdict_of(rule: Column, rules: list[tuple[str, str]]) -> Column:
    out = F.lit(None).cast("string")
    for text, verdict in rules:
        out = F.when(rule == text, F.lit(verdict)).otherwise(out)
    return out


def _without_dots(where: Column) -> Column:
    """A path from "/" on without its "." and ".." segments."""
    parts = F.split(F.regexp_replace(where, r"(/\.\.?)$", "$1/"), "/", -1)
    step = lambda done, x: F.when(x == ".", done).when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))).otherwise(F.concat(done, F.array(x)))
    return F.when(where.contains("/."), F.array_join(F.aggregate(F.slice(parts, 2, F.size(parts)), F.array(F.lit("")), step), "/")).otherwise(where)


def resolved(source: Column, to: Column) -> Column:
    """The url that `to` names on the page `source`; null for schemes without "://"."""
    site, own = F.regexp_extract(source, r"^([\s\S]*?://[^/?#]*)", 1), path(source)
    ask = F.regexp_extract(source, r"://[^?#]*(\?[^#]*)", 1)
    begin, rest = F.regexp_extract(to, r"^([^?#]*)", 1), F.regexp_extract(to, r"^[^?#]*([\s\S]*)", 1)
    folder = F.when(own.contains("/"), F.regexp_extract(own, r"^([\s\S]*/)", 1)).otherwise("/")
    return (
        F.when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.when(to.contains("://"), to))
        .when(to.startswith("//"), F.concat(F.lit("http:"), to))
        .when(to.startswith("#"), F.concat(site, own, ask))
        .when(to.startswith("?"), F.concat(site, own, to))
        .otherwise(F.concat(site, _without_dots(F.when(to.startswith("/"), begin).otherwise(F.concat(folder, begin))), rest))
    )


def _targets(html: Column) -> Column:
    """The targets of a page's canonical links and refresh redirects, as an array.

    Comments, scripts, styles, titles and text areas are left out first. A tag ends at the
    first ">" and holds no "<", so that every pattern reads a page once.
    """
    tags = F.regexp_extract_all(F.regexp_replace(html, _UNREAD, ""), F.lit(_LINK_TAG), F.lit(0))
    href = lambda t: F.concat(*[F.regexp_extract(t, _HREF, k) for k in (1, 2, 3)])
    to = F.transform(F.transform(tags, lambda t: F.regexp_replace(t, r"\s+", " ")), lambda t: F.when(t.rlike(_CANONICAL), href(t)).when(t.rlike(_REFRESH), F.regexp_extract(t, _CONTENT, 1)))
    some = F.when(html.rlike("(?i)canonical|refresh"), to)
    return F.transform(F.filter(some, lambda x: x.isNotNull() & (F.trim(x) != "")), lambda x: F.trim(x))


def alias_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Edges (source, target) of urls from canonical links and refresh redirects in the html.

    Every link of a page counts, but for those in comments and scripts. Relative targets are
    resolved against the page's url.
    """
    found = pages.select(F.col(url).cast("string").alias("source"), F.col(html).cast("string").alias("html")).where("source is not null")
    found = found.select("source", F.explode(_targets(F.col("html"))).alias("to"))
    to = F.regexp_replace("to", "&amp;", "&")
    return found.select("source", resolved(F.col("source"), to).alias("target")).where("target is not null and target like '%://%'")


def judge(pages: DataFrame, rules: list[tuple[str, str]], edges: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict of every row of pages(page_id, url).

    edges(source, target) are urls that lead to one another; they are written once, as they
    may come from all of the pages' html.
    """
    edges = saved(edges.select("source", "target").distinct(), "aliases")
    urls = edges.select(F.explode(F.array("source", "target")).alias("url")).distinct()
    known = urls.select(key(F.col("url")).alias("node"), verdict_of(rule_of(host(F.col("url")), path(F.col("url")), rules), rules).alias("v"))
    parts = components(edges.select(key(F.col("source")).alias("u"), key(F.col("target")).alias("v")))
    decided = (
        parts.join(known, "node")
        .groupBy("component")
        .agg(F.max(F.when(F.col("v") == "allow", 2).when(F.col("v") == "block", 1)).alias("d"))
        .where("d is not null")
    )
    alias = saved(parts.join(decided, "component").select("node", F.when(F.col("d") == 2, "allow").otherwise("block").alias("by_alias")), "decided")
    discard(edges, parts)
    own = pages.select("page_id", F.col("url").cast("string").alias("url")).select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), key(F.col("url")).alias("node"))
    own = own.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    return own.join(alias, "node", "left").select("page_id", "host", "path", "rule", F.coalesce(verdict_of(F.col("rule"), rules), "by_alias", F.lit(default)).alias("verdict"))

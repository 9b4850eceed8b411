"""URL filters: host and path rules, and block decisions carried to aliases over redirects and canonical links.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.llm.common import ascii_lower, broadcast_if_small, components, cut

#: (verdict, host, path): a rule fits its host and every subdomain where the url's path starts with the rule's.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
RULE_SCHEMA = "verdict string, host string, path string"
BROADCAST_ROWS = 1_000_000
#: So many blocked components, named by a url each, are broadcast; more are joined by shuffle.
BROADCAST_URLS = 100_000
#: Query parameters that say where a visitor came from, not which page is meant.
TRACKING = r"(?:utm_[a-z]+|ref|fbclid|gclid)=[^&#]*"


def rest_of(url: Column) -> Column:
    """The url after its first ``://``; empty for null or without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(rest_of(url), r"^([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(rest_of(url), r"^[^/?#]*([^?#]*)", 1)


def rules_frame(spark: SparkSession, rules: tuple = RULES) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rules], RULE_SCHEMA)


def with_rule(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``(url, host, path, rule, ruled)`` for each distinct ``url``: the longest fitting rule and its verdict, or nulls.

    A host is joined by each of its suffixes, so the work follows the labels of a host and not the number of rules. Of two
    rules of one length an allow wins.
    """
    parsed = urls.select("url").distinct().select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    asked = parsed.select("url", "host", "path", F.explode(suffixes).alias("suffix")).where("suffix <> ''")
    known = rules.select(
        F.lower("host").alias("suffix"), F.col("path").alias("prefix"), F.concat("host", "path").alias("rule"), F.col("verdict").alias("ruled")
    )
    best = (
        asked.join(broadcast_if_small(known, BROADCAST_ROWS), "suffix")
        .where(F.col("path").startswith(F.col("prefix")))
        .groupBy("url")
        .agg(F.max(F.struct(F.length("rule").alias("n"), (F.col("ruled") == "allow").alias("allows"), "rule", "ruled")).alias("best"))
        .select("url", "best.rule", "best.ruled")
    )
    return parsed.alias("p").join(best.alias("b"), F.expr("p.url <=> b.url"), "left").select("p.url", "host", "path", "rule", "ruled")


def _without_dots(path: Column) -> Column:
    """A path with its ``.`` and ``..`` segments resolved."""
    segments = F.split(F.substring(path, F.lit(2), F.length(path)), "/")
    start = F.array().cast("array<string>")
    end = lambda done: F.array_append(F.filter(done, lambda x: x != "."), F.lit(""))
    step = lambda done, s: F.when(s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(s == ".", done).otherwise(F.array_append(done, s))
    kept = F.aggregate(segments, start, step)
    open_end = F.element_at(segments, -1).isin(".", "..")
    resolved = F.concat(F.lit("/"), F.array_join(F.when(open_end, end(kept)).otherwise(kept), "/"))
    return F.when(path.rlike(r"/\.{1,2}(?:/|$)"), resolved).otherwise(path)


def absolute(base: Column, link: Column) -> Column:
    """``link`` as found in the html of the page ``base``, made absolute; null if it names no web page."""
    link = F.regexp_replace(F.regexp_replace(link, "&amp;|&#38;", "&"), "#.*$", "")
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)
    site = F.concat(scheme, F.lit("://"), F.regexp_extract(rest_of(base), r"^([^/?#]*)", 1))
    folder = F.regexp_extract(path_of(base), r"^(.*/)", 1)
    path, query = F.regexp_extract(link, r"^([^?]*)", 1), F.regexp_extract(link, r"(\?.*)$", 1)
    return (
        F.when(link.rlike("^(?i)https?://"), link)
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | (link == ""), F.lit(None).cast("string"))
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(site, _without_dots(path), query))
        .when(link.startswith("?"), F.concat(site, path_of(base), link))
        .otherwise(F.concat(site, _without_dots(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), path)), query))
    )


def same_url(url: Column) -> Column:
    """What is the same for all ways to write one url: scheme and host in lower case, no fragment, ``/`` for an empty path."""
    scheme = ascii_lower(F.regexp_extract(url, r"^([^/?#]*)://", 1))
    path = path_of(url)
    return F.when(host_of(url) != "", F.concat(scheme, F.lit("://"), host_of(url), F.when(path == "", F.lit("/")).otherwise(path), F.regexp_extract(url, r"(\?[^#]*)", 1)))


def canonical_form(url: Column) -> Column:
    """What the usual redirects of a site lead to: no scheme, no www. or m., no fragment, tracking or closing slash."""
    host = F.regexp_replace(host_of(url), r"^(?:www|m)\.", "")
    path = F.regexp_replace(path_of(url), r"(?:/index)?(?:\.html?)?/*$", "")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    kept = F.regexp_replace(F.regexp_replace(query, rf"(?:^|&){TRACKING}(?=&|$)", ""), "^&", "")
    return F.when(host != "", F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def alias_links(pages: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """Distinct ``(source, target)``: what a url redirects to or declares canonical.

    Canonical links and refresh redirects are read from ``pages(url, html)``; ``redirects(source, target)`` adds others,
    as from a crawl log.
    """
    html = F.col("html")
    link = F.regexp_extract(html, r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>", 0)
    href = F.regexp_extract(link, r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)
    meta = F.regexp_extract(html, r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>", 0)
    target = F.regexp_extract(meta, r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1)
    url = F.col("url")
    declares, refreshes = html.rlike("(?i)<link[^>]*canonical"), html.rlike("(?i)<meta[^>]*refresh")
    named = F.array(F.when(declares & (href != ""), absolute(url, href)), F.when(refreshes & (target != ""), absolute(url, target)))
    links = pages.where(declares | refreshes).select(url.alias("source"), F.explode(named).alias("target"))
    if redirects is not None:
        links = links.unionByName(redirects.select("source", "target"))
    return links.where("source IS NOT NULL AND target IS NOT NULL").distinct()


def verdicts(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None, spellings: bool = False, exact: bool = False) -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` for every row of ``pages(page_id, url, html)``.

    The longest fitting rule decides. A page without one is blocked if a url in its connected component of redirects and
    canonical links is blocked by a rule, else allowed. An explicit allow always stands: it is never overruled by an
    alias, and it covers only the pages that it fits. Ways to write one url (case of the host, fragments) are one node;
    with ``spellings`` so are its usual variants (see ``canonical_form``), for which there is no evidence in the pages, and with
    ``exact`` every way to write a url is a node of its own, for logs that name urls as the pages do. Null
    urls and urls without ``://`` have an empty host and path, no aliases and no rule, and are allowed. Null html has no
    links. Repeated rows come back as often as they came in; other columns are ignored; an empty table gives an empty
    result.
    """
    plain = lambda url: F.when(host_of(url) != "", url)
    node = plain if exact else canonical_form if spellings else same_url
    links = cut(alias_links(pages.select("url", "html"), redirects))
    urls = pages.select("url").union(links.select("source")).union(links.select("target")).where("url IS NOT NULL")
    ruled = with_rule(urls, rules).withColumn("node", node(F.col("url")))
    members = cut(components(links.select(node(F.col("source")).alias("a"), node(F.col("target")).alias("b"))))
    grouped = cut(ruled.join(members, "node", "left").select("url", "host", "path", "rule", "ruled", F.coalesce("component", "node").alias("component")))
    # Aggregates are stored before they are joined, so that both sides are dealt anew and a hub's urls can be split.
    blocked = cut(grouped.where("ruled = 'block' AND component IS NOT NULL").select("component").distinct())
    carried = broadcast_if_small(blocked.withColumn("carried", F.lit(True)), BROADCAST_URLS)
    known = cut(grouped.join(carried, "component", "left"))
    verdict = F.coalesce("ruled", F.when(F.col("carried"), F.lit("block")), F.lit("allow"))
    return (
        pages.select("page_id", "url")
        .join(known, "url", "left")
        .select("page_id", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "rule", verdict.alias("verdict"))
    )

"""URL filters over redirect equivalence.

A page's own rule decides first: of the rules that fit its host (or a parent domain) and the start of its path, the longest. Pages
without one ask their aliases. Two addresses are one place if they differ in scheme, fragment, tracking parameters or a last slash
only; places are linked by redirects (meta refresh, and any table of redirects that is given) and by canonical links, and the connected
components of these links are what a decision holds for. A component with a page that a rule blocks blocks its pages without a
rule, unless a rule allows one of its pages: an explicit allow takes precedence there as it does for the page itself.
Everything else is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotlens.llm.components import connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules as (verdict, host, path).
RULES = (
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"),
)
#: Parameters that name no other page.
TRACKING = r"^(utm_[a-z]+|gclid|fbclid)(=|$)"
OUT = ("host", "path", "rule", "verdict")


def host(url: Column) -> Column:
    """From the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lowered; empty without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    """From the host to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def place(url: Column) -> Column:
    """What addresses of one page have in common: host, path without last slashes, parameters that aren't for tracking. Null without a host."""
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    own = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)), "&")
    whole = F.concat(host(url), F.regexp_replace(path(url), "/+$", ""), F.when(own != "", F.concat(F.lit("?"), own)).otherwise(F.lit("")))
    return F.when(host(url) != "", whole)


def rule_of(rules, host_col: str = "host", path_col: str = "path") -> Column:
    """The longest rule (by its host and path) that fits, as a struct of rule and verdict; null if none does."""
    h, p = F.col(host_col), F.col(path_col)
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((h == rule_host) | F.endswith(h, F.lit("." + rule_host))) & F.startswith(p, F.lit(start))
        out = F.when(fits, F.struct(F.lit(rule_host + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _attribute(tag: Column, name: str) -> Column:
    """A tag's attribute, quoted or not; empty without it."""
    quoted = rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return F.concat(*[F.regexp_extract(tag, quoted, i) for i in (1, 2, 3)])


def resolved(href: Column, url: Column) -> Column:
    """The address that ``href`` stands for on the page ``url``; null for an empty one."""
    h = F.replace(F.regexp_replace(href, r"^\s+|\s+$", ""), F.lit("&amp;"), F.lit("&"))
    scheme = F.regexp_extract(url, r"(?s)^(.*?://)", 1)
    root = F.concat(scheme, host(url))
    folder = F.coalesce(F.nullif(F.regexp_extract(path(url), r"(?s)^(.*/)", 1), F.lit("")), F.lit("/"))
    return (
        F.when(h == "", None).when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), h)
        .when(F.startswith(h, F.lit("//")), F.concat(F.regexp_replace(scheme, "//$", ""), h)).when(F.startswith(h, F.lit("/")), F.concat(root, h))
        .when(F.startswith(h, F.lit("#")), url).when(F.startswith(h, F.lit("?")), F.concat(root, path(url), h)).otherwise(F.concat(root, folder, h))
    )


def alias_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(a, b): places that a page's canonical links and meta refreshes join. Comments, scripts and styles are not read."""
    tags = F.regexp_extract_all(F.regexp_replace(F.col(html_col), r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", " "), F.lit(r"(?is)<(?:link|meta)\s[^>]*>"), F.lit(0))
    rows = pages.where(F.col(html_col).rlike(r"(?i)canonical|refresh")).select(F.col(url_col).alias("url"), F.explode(tags).alias("tag"))
    canonical = _attribute(F.col("tag"), "rel").rlike(r"(?i)(^|\s)canonical(\s|$)") & F.col("tag").rlike(r"(?i)^<link")
    refresh = F.lower(_attribute(F.col("tag"), "http-equiv")) == "refresh"
    to = F.when(canonical, _attribute(F.col("tag"), "href")).when(refresh, F.regexp_extract(_attribute(F.col("tag"), "content"), r"""(?is)^[^;,]*[;,]\s*(?:url\s*=\s*)?["']?([^"']*)""", 1))
    links = rows.select(place(F.col("url")).alias("a"), place(resolved(to, F.col("url"))).alias("b"))
    return links.where("a != b")


def judge_urls(pages: DataFrame, redirects: DataFrame | None = None, rules=RULES, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``pages`` with host, path, rule (null if none fits) and verdict, without the html.

    redirects: (source, target) addresses known from elsewhere, joined like those in the pages. A null address, or one without ``://``,
    has empty host and path, no rule and no aliases, and is allowed; null html has no links. Of repeated rules the verdict that sorts last
    wins; repeated rows are judged alike. Texts of any length are read whole. Columns of ``pages`` named like an output column
    are replaced; an empty table gives an empty result.
    """
    links = alias_links(pages, url_col, html_col)
    if redirects is not None:
        links = links.unionByName(redirects.select(place(F.col("source")).alias("a"), place(F.col("target")).alias("b")).where("a != b"))
    rows = pages.drop(html_col, *[c for c in OUT if c != url_col]).withColumns({"host": host(F.col(url_col)), "path": path(F.col(url_col)), "__place": place(F.col(url_col))})
    rows = rows.withColumn("__rule", rule_of(rules))

    # a place's own verdicts meet first, so that a component gets a row a place
    said = lambda v: F.max(F.coalesce(F.col("__rule.verdict") == v, F.lit(False)))
    places = rows.where("__place IS NOT NULL").groupBy("__place").agg(said("allow").alias("allowed"), said("block").alias("blocked"), F.max(F.col("__rule").isNull()).alias("asks"))
    linked = connected_components(links)
    places = places.join(linked, places["__place"] == linked["node"], "left").withColumn("root", F.coalesce("root", "__place"))
    roots = places.where("allowed OR blocked").groupBy("root").agg((F.max("blocked") & ~F.max("allowed")).alias("spreads")).where("spreads")
    caught = places.where("asks").join(roots, "root", "left_semi").select("__place", F.lit(True).alias("__caught"))
    out = rows.join(caught, "__place", "left")
    verdict = F.when(F.col("__rule").isNotNull(), F.col("__rule.verdict")).when(F.col("__caught"), "block").otherwise("allow")
    return out.withColumns({"rule": F.col("__rule.rule"), "verdict": verdict}).drop("__place", "__rule", "__caught")

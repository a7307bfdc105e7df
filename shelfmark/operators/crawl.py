"""Crawling as tables: links, allowed URLs, bounded breadth-first search, change detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.urls import normalize_url, site_of
from shelfmark.session import written

BLOCKED = r"(?i)\.(jpe?g|png|gif|svg|css|js|zip|mp[34]|ico)$"


def url_allowed(url: Column, site: Column, keep_query: bool = False) -> Column:
    """Whether a URL is http(s), of the site, without a query unless kept, and no blocked kind of file."""
    ok = F.lower(url).rlike(r"^https?://[^/]+") & (site_of(url) == site) & ~url.rlike(BLOCKED)
    return F.coalesce(ok if keep_query else ok & ~F.contains(url, F.lit("?")), F.lit(False))


def discovered_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """`url, link` of the distinct links of pages of HTML; rooted and absolute targets are resolved."""
    hrefs = F.regexp_extract_all(html_col, F.lit(r"(?i)<a\s[^>]*href\s*=\s*[\"']([^\"'#]+)"), 1)
    rows = pages.select(F.col(url_col).alias("url"), F.explode(hrefs).alias("href"))
    root = F.regexp_extract("url", r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+)", 1)
    target = F.when(F.col("href").rlike(r"^https?://"), F.col("href")).when(F.col("href").startswith("/"), F.concat(root, "href"))
    return rows.select("url", normalize_url(target).alias("link")).where("link is not null").distinct()


def crawl_levels(seeds: DataFrame, links: DataFrame, max_depth: int) -> DataFrame:
    """`url, depth` of every page within `max_depth` links of a seed, at its least depth.

    `seeds(url)`, `links(url, link)`. One join a level; what was visited is left out, so cycles
    end. Every level is written, which cuts the lineage and survives lost executors.
    """
    visited = written(seeds.select("url").where("url is not null").distinct().withColumn("depth", F.lit(0)), "visited")
    frontier = visited
    for depth in range(1, max_depth + 1):
        found = frontier.join(links, "url").select(F.col("link").alias("url")).where("url is not null").distinct()
        frontier = written(found.join(visited, "url", "left_anti").withColumn("depth", F.lit(depth)), "frontier")
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    return visited


def changed_pages(pages: DataFrame, state: DataFrame) -> DataFrame:
    """`url, change` of pages against the hashes of the last crawl: new, changed or unchanged."""
    old = state.select("url", F.col("content_hash").alias("old_hash")).dropDuplicates(["url"])
    change = F.when(F.col("old_hash").isNull(), "new").when(~F.col("content_hash").eqNullSafe(F.col("old_hash")), "changed").otherwise("unchanged")
    return pages.join(old, "url", "left").select("url", change.alias("change"))

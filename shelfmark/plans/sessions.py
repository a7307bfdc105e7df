"""Queries on history, URLs and streams, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmark.functions.urls import normalize_url, site_of
from shelfmark.operators import crawl, history
from shelfmark.operators.registry import content_key, current_documents, document_of, key_of
from shelfmark.session import written
from shelfmark.sources.tables import table
from shelfmark.streaming import lifecycle


def history_last_turns(spark: SparkSession, folder: str) -> DataFrame:
    return history.last_turns(table(spark, folder, "conversation_history")).select("session_id", "turn", "id")


def ranked_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The chunks of each label's document in order, as a ranked result."""
    chunks = table(spark, folder, "data_hkpl_knowledge").select(document_of(F.col("node_id")).alias("doc"), "node_id", "text").distinct()
    labels = table(spark, folder, "evaluation_dataset").select(F.col("id").alias("query_id"), key_of(F.col("source_document_id")).alias("doc")).distinct()
    place = F.regexp_extract("node_id", r":c(\d+):", 1).cast("int") + 1
    return labels.join(chunks, "doc").select("query_id", "doc", "node_id", place.alias("rank"), "text")


def context_packing(spark: SparkSession, folder: str) -> DataFrame:
    packed = history.packed_context(ranked_chunks(spark, folder), F.col("text"))
    return packed.groupBy("query_id").agg(F.count("*").alias("n_chunks"), F.sum("tokens").alias("tokens"))


def citations(spark: SparkSession, folder: str) -> DataFrame:
    return history.citations(ranked_chunks(spark, folder), ["doc", "node_id"])


def keyword_policy(spark: SparkSession, folder: str) -> DataFrame:
    """The category names of the registry are the keywords, looked for in the questions asked."""
    keywords = table(spark, folder, "knowledge_documents").where("category is not null").select(F.col("category").alias("keyword"), F.lit(True).alias("is_active")).distinct()
    messages = table(spark, folder, "conversation_history").select("id", "content").distinct()
    return history.keyword_hits(messages, keywords, "id", "content")


def url_normal_forms(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "knowledge_documents").where("trim(source_url) != ''")
    return rows.select(normalize_url(F.col("source_url")).alias("url"), site_of(F.col("source_url")).alias("site")).distinct()


def url_allowed(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "knowledge_documents").where("source_url is not null").select("source_url").distinct()
    allowed = crawl.url_allowed(F.trim("source_url"), site_of(F.col("source_url")))
    return rows.groupBy(site_of(F.col("source_url")).alias("site"), allowed.alias("allowed")).agg(F.count("*").alias("n_urls"))


def crawl_bfs(spark: SparkSession, folder: str) -> DataFrame:
    """Every document of a site leads to the next one and to the tenth after it in order of id; the search starts at
    the site's first document and goes eight links far."""
    sites = current_documents(table(spark, folder, "knowledge_documents"), "source_url").select("document_id", site_of(F.col("source_url")).alias("site")).where("site is not null")
    # The place within a site, from counts of ranges: a hot site is numbered in as many tasks as it has ranges.
    parts = sites.withColumn("part", F.left("document_id", F.lit(2)))
    before = parts.groupBy("site", "part").count().select("site", "part", (F.sum("count").over(W.partitionBy("site").orderBy("part")) - F.col("count")).alias("before"))
    pages = parts.join(before, ["site", "part"]).withColumn("no", F.col("before") + F.row_number().over(W.partitionBy("site", "part").orderBy("document_id")))
    pages = pages.select("site", "no", F.col("document_id").alias("url"))
    steps = pages.select("site", "url", F.explode(F.array(F.col("no") + 1, F.col("no") + 10)).alias("no"))
    links = steps.join(pages.withColumnRenamed("url", "link"), ["site", "no"]).select("url", "link")
    return crawl.crawl_levels(pages.where("no = 1"), written(links, "links"), 8)


def discovered_links(spark: SparkSession, folder: str) -> DataFrame:
    """Pages made of the registry: each links to its own address, a rooted one and a mailbox."""
    rows = table(spark, folder, "knowledge_documents").where("trim(source_url) != ''").select("document_id", normalize_url(F.col("source_url")).alias("url")).distinct()
    html = F.concat(F.lit('<a class="x" href="'), "url", F.lit('">a</a><a href="/about">b</a><A HREF="mailto:x@y.example">c</A><p href="/no">'))
    return crawl.discovered_links(rows.where("url is not null").select("url", html.alias("html")))


def ingestion_once(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of the deliveries, each once however often it comes, as a stream."""
    return lifecycle.run_to_table(lifecycle.ingested_once(lifecycle.stream_of(spark, folder, "ingest_batches")), "once")


def change_detection(spark: SparkSession, folder: str) -> DataFrame:
    """The first state of each URL is the last crawl, its current one comes in."""
    rows = table(spark, folder, "knowledge_documents").where("trim(source_url) != ''").withColumn("url", normalize_url(F.col("source_url")))
    key = content_key(F.col("content_hash"))
    order = F.struct("updated_at", "version", "document_id")
    old = rows.where("version = 1").groupBy("url").agg(F.min_by(key, order).alias("content_hash"))
    new = rows.groupBy("url").agg(F.max_by(key, order).alias("content_hash"))
    return crawl.changed_pages(new, old)


def event_windows(spark: SparkSession, folder: str) -> DataFrame:
    stream = lifecycle.event_windows(lifecycle.stream_of(spark, folder, "events"))
    found = lifecycle.run_to_table(stream, "windows", "complete")
    return found.withColumn("total", F.round("total", 4))


QUERIES = {
    f.__name__: f
    for f in (history_last_turns, context_packing, citations, keyword_policy, url_normal_forms, url_allowed, crawl_bfs, change_detection, event_windows, discovered_links, ingestion_once)
}
_SITE = r"nullif(regexp_replace(regexp_replace(regexp_extract(lower(trim(source_url)), '^[a-z][a-z0-9+.-]*://([^/?#\s]*)', 1), ':\d*$', ''), '^www\.', ''), '')"
_URL = r"""lower(regexp_extract(trim(source_url), '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) || '://' || lower(regexp_extract(trim(source_url), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))
    || CASE WHEN regexp_extract(regexp_replace(trim(source_url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)', 1) = '' THEN '/'
       ELSE regexp_extract(regexp_replace(trim(source_url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)', 1) END"""
_RANKED = r"""(SELECT DISTINCT l.id AS query_id, c.doc, c.node_id, CAST(regexp_extract(c.node_id, ':c(\d+):', 1) AS INTEGER) + 1 AS rank, c.text
    FROM (SELECT DISTINCT id, lower(trim(source_document_id)) AS doc FROM evaluation_dataset) l
    JOIN (SELECT DISTINCT lower(split_part(node_id, ':', 1)) AS doc, node_id, text FROM data_hkpl_knowledge) c ON c.doc = l.doc)"""
ORACLES = {
    "history_last_turns": """
        WITH m AS (SELECT DISTINCT * FROM conversation_history WHERE regexp_matches(session_id, '\\S') AND regexp_matches(content, '\\S')),
        r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC NULLS LAST, id DESC, role, content) AS back FROM m)
        SELECT session_id, CAST(max(back) OVER (PARTITION BY session_id) - back + 1 AS INTEGER) AS turn, id FROM (SELECT * FROM r WHERE back <= 6)""",
    "context_packing": f"""
        WITH t AS (SELECT *, CAST(CASE WHEN length(text) > 0 THEN greatest(1, round_even(length(text) / 4, 0)) ELSE 0 END AS BIGINT) AS tokens FROM {_RANKED}),
        u AS (SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS used FROM t)
        SELECT query_id, count(*) AS n_chunks, CAST(sum(tokens) AS BIGINT) AS tokens FROM u WHERE used <= 600 OR rank = 1 GROUP BY query_id""",
    "citations": f"""
        WITH f AS (SELECT query_id, doc, node_id, min(rank) AS rank FROM {_RANKED} GROUP BY ALL),
        n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, doc, node_id) AS no FROM f)
        SELECT query_id, 'Sources:' || chr(10) || string_agg(doc || ' | ' || node_id, chr(10) ORDER BY no) AS citation FROM n WHERE no <= 3 GROUP BY query_id""",
    "keyword_policy": """
        WITH k AS (SELECT DISTINCT lower(trim(category)) AS w FROM knowledge_documents WHERE trim(category) <> ''), m AS (SELECT DISTINCT id, content FROM conversation_history)
        SELECT id, keyword FROM (SELECT id, content, arg_max(w, (length(w), w)) AS keyword FROM m JOIN k ON contains(lower(content), w) GROUP BY id, content)""",
    "url_normal_forms": f"SELECT DISTINCT {_URL} AS url, {_SITE} AS site FROM knowledge_documents WHERE trim(source_url) <> ''",
    "url_allowed": rf"""SELECT {_SITE} AS site, coalesce(regexp_matches(lower(trim(source_url)), '^https?://[^/]+') AND {_SITE} IS NOT NULL AND NOT contains(source_url, '?')
        AND NOT regexp_matches(trim(source_url), '(?i)\.(jpe?g|png|gif|svg|css|js|zip|mp[34]|ico)$'), false) AS allowed, count(*) AS n_urls
        FROM (SELECT DISTINCT source_url FROM knowledge_documents WHERE source_url IS NOT NULL) GROUP BY 1, 2""",
    "crawl_bfs": f"""
        WITH RECURSIVE cur AS (SELECT lower(trim(document_id)) AS url, arg_max_null({_SITE}, (updated_at, version, status, source_url)) AS site FROM knowledge_documents GROUP BY 1),
        p AS (SELECT url, site, row_number() OVER (PARTITION BY site ORDER BY url) AS no FROM cur WHERE site IS NOT NULL AND url <> ''),
        w AS (SELECT site, no, 0 AS depth FROM p WHERE no = 1 UNION SELECT p.site, p.no, w.depth + 1 FROM w JOIN p ON p.site = w.site AND p.no - w.no IN (1, 10) WHERE w.depth < 8)
        SELECT url, CAST(min(depth) AS INTEGER) AS depth FROM w JOIN p USING (site, no) GROUP BY 1""",
    "discovered_links": f"""
        WITH u AS (SELECT DISTINCT {_URL} AS url FROM knowledge_documents WHERE trim(source_url) <> '')
        SELECT url, regexp_replace(url, '["''#].*$', '') AS link FROM u UNION SELECT url, regexp_extract(url, '^([a-z][a-z0-9+.-]*://[^/?#]+)', 1) || '/about' FROM u""",
    "ingestion_once": "SELECT DISTINCT lower(trim(document_id)) AS document_id FROM ingest_batches WHERE trim(document_id) <> '' AND received_at IS NOT NULL",
    "change_detection": rf"""
        WITH r AS (SELECT {_URL} AS url, nullif(regexp_replace(lower(content_hash), '\s+|^\s*[a-z0-9-]+:', '', 'g'), '') AS h, version, (updated_at, version, document_id) AS o
                   FROM knowledge_documents WHERE trim(source_url) <> ''),
        o AS (SELECT url, arg_min_null(h, o) AS h FROM r WHERE version = 1 GROUP BY url), n AS (SELECT url, arg_max_null(h, o) AS h FROM r GROUP BY url)
        SELECT n.url, CASE WHEN o.h IS NULL THEN 'new' WHEN n.h IS DISTINCT FROM o.h THEN 'changed' ELSE 'unchanged' END AS change FROM n LEFT JOIN o USING (url)""",
    "event_windows": """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n_events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""",
}

"""Queries on changes of the registry, the chunks and the labels, and the same in SQL.

Each reads the tables as they are, applies a change that is taken from them, and gives the new rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators import corpus as C
from shelfmark.operators import labels as L
from shelfmark.operators import publish as P
from shelfmark.operators.registry import current_documents, document_of, key_of
from shelfmark.plans.corpora import ORACLES as CORPORA
from shelfmark.session import new_path
from shelfmark.sources.tables import table

AT = "2030-01-01 00:00:00"
_ROW = ["document_id", "version", "status", "chunk_count", "content_hash", "updated_at"]


def _registry(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "knowledge_documents")


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    return C.chunk_table(table(spark, folder, "data_hkpl_knowledge"))


def registry_insert(spark: SparkSession, folder: str) -> DataFrame:
    """What is registered before 2024 receives the documents that were registered later."""
    rows = _registry(spark, folder)
    old = rows.where("uploaded_at < '2024-01-01'")
    return P.inserted(old, rows.where("uploaded_at >= '2024-01-01'").select("document_id", "source_title", "content_hash"), AT).select(*_ROW, "source_title")


def _failed(rows: DataFrame) -> DataFrame:
    return current_documents(rows, "status").where("status = 'failed'").select("document_id")


def registry_replace(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that failed come in again with other content."""
    rows = _registry(spark, folder)
    return P.replaced(rows, _failed(rows).select("document_id", F.concat(F.lit("again-"), "document_id").alias("content_hash")), AT).select(_ROW)


def registry_reindex(spark: SparkSession, folder: str) -> DataFrame:
    rows = _registry(spark, folder)
    asked = rows.where("category is not null").select("document_id", F.when(F.col("file_type") == "html", "structured").alias("document_type"))
    return P.reindexed(rows, asked).select("document_id", "version", "status", "document_type")


def documents_deleted(spark: SparkSession, folder: str) -> DataFrame:
    """The chunks that stay once the documents that failed are deleted."""
    rows = _registry(spark, folder)
    _, chunks = P.deleted_documents(rows, table(spark, folder, "data_hkpl_knowledge"), _failed(rows), AT)
    return chunks.groupBy("node_id").agg(F.count("*").alias("n_rows"))


def registry_deleted_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = _registry(spark, folder)
    registry, _ = P.deleted_documents(rows, table(spark, folder, "data_hkpl_knowledge"), _failed(rows), AT)
    return registry.select(_ROW)


def old_versions_removed(spark: SparkSession, folder: str) -> DataFrame:
    kept = P.current_versions(_chunks(spark, folder), _registry(spark, folder))
    return kept.groupBy("node_id").agg(F.count("*").alias("n_rows"))


def dataset_replace(spark: SparkSession, folder: str) -> DataFrame:
    """The set of the noise paragraphs is replaced by the chunks without a type."""
    chunks = _chunks(spark, folder).select("node_id", "dataset", "document_type", "text")
    noise = chunks.where("document_type is null")
    rows = P.dataset_replaced(chunks, noise, C.NOISE_SETS[0])
    return rows.groupBy("node_id", C.dataset_of(F.col("dataset")).alias("dataset")).agg(F.count("*").alias("n_rows"))


def primary_cleared(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks that name no set count as news here, so that something is left."""
    chunks = _chunks(spark, folder).withColumn("dataset", F.when(F.length("dataset") > 0, F.col("dataset")).otherwise(C.NOISE_SETS[1]))
    return P.without_primary(chunks).groupBy("node_id").agg(F.count("*").alias("n_rows"))


def titled_faq_removed(spark: SparkSession, folder: str) -> DataFrame:
    """Question lists whose title several documents have are removed."""
    current = current_documents(_registry(spark, folder), "source_title")
    titles = current.groupBy(key_of(F.col("source_title")).alias("title")).count().where("count > 1 and title is not null").select("title")
    named = current.select(F.col("document_id").alias("d"), F.col("source_title").alias("title"))
    chunks = _chunks(spark, folder)
    chunks = chunks.join(named, chunks.document_id == named.d, "left").select("node_id", "document_type", "title")
    return P.without_titled(chunks, titles).groupBy("node_id").agg(F.count("*").alias("n_rows"))


def rebuild_preflight(spark: SparkSession, folder: str) -> DataFrame:
    return P.rebuild_faults(_chunks(spark, folder), _registry(spark, folder))


def label_repair_applied(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "evaluation_dataset")
    repairs = L.repaired_labels(labels, table(spark, folder, "data_hkpl_knowledge"))
    return P.labels_repaired(labels, repairs).select("id", "source_document_id", "source_chunk_id")


def crawl_state_merge(spark: SparkSession, folder: str) -> DataFrame:
    """The first versions are the state before, all others what was crawled since."""
    rows = _registry(spark, folder).select(F.trim("source_url").alias("url"), "content_hash", "version").where("url != ''")
    state = rows.where("version = 1").groupBy("url").agg(F.max("content_hash").alias("content_hash"))
    found = P.crawl_state(state, rows.where("version > 1"))
    return found.select("url", "content_hash", P.raw_content_name(F.col("url"), F.lit(".html")).alias("kept_as"))


def registry_audit_log(spark: SparkSession, folder: str) -> DataFrame:
    """What registering again changed, as it comes back from a log of JSON lines."""
    rows = _registry(spark, folder)
    side = lambda r: r.groupBy(key_of(F.col("document_id")).alias("doc")).agg(F.max("status").alias("status"), F.max("version").alias("version")).where("doc is not null")
    log = P.audit_log(side(rows.where("version = 1")), side(rows), "doc")
    path = new_path(spark, "log")
    P.append_json(log, path)
    return spark.read.schema(log.schema).json(path)


def vector_append(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks appended to a vector table in two goes, as they come back from it."""
    chunks = _chunks(spark, folder).select("node_id", "dataset", "dims")
    path = new_path(spark, "vectors")
    P.write_vectors(chunks.where("dims is null"), path)
    P.write_vectors(chunks.where("dims is not null"), path)
    return spark.read.schema("node_id string, dims int, dataset string").parquet(path).groupBy("node_id", "dataset", "dims").agg(F.count("*").alias("n_rows"))


def labels_csv(spark: SparkSession, folder: str) -> DataFrame:
    """The labels written as CSV and read again; blank and null fields come back as null."""
    labels = table(spark, folder, "evaluation_dataset").select("id", "domain", "query", "expected_answer_text").distinct()
    path = new_path(spark, "labels-csv")
    P.write_csv(labels.withColumn("refs", F.array("id")), path)
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema("id bigint, domain string, query string, expected_answer_text string, refs string").csv(path)
    empty = lambda c: F.when(F.col(c) != "", F.col(c)).alias(c)
    return back.select("id", empty("domain"), F.md5(empty("query")).alias("query"), F.md5(empty("expected_answer_text")).alias("answer"), "refs")


def versions_published(spark: SparkSession, folder: str) -> DataFrame:
    """The completed documents published twice: the latest version is read, the one before is still there."""
    base = new_path(spark, "published")
    current = current_documents(_registry(spark, folder), "status", "version")
    P.publish(current.select("document_id", "version"), base)
    P.publish(current.where("status = 'completed'").select("document_id", "version"), base)
    latest, before = P.published(spark, base), P.published(spark, base, 1)
    return before.join(latest.select("document_id", F.lit(True).alias("latest")), "document_id", "left").select("document_id", "version", F.col("latest").isNotNull().alias("latest"))


def messages_appended(spark: SparkSession, folder: str) -> DataFrame:
    rows = P.messages_to_append(table(spark, folder, "conversation_history"))
    return rows.groupBy("session_id").agg(F.count("*").alias("n_rows"), F.min("id").alias("first_id"))


QUERIES = {
    f.__name__: f
    for f in (
        registry_insert, registry_replace, registry_reindex, documents_deleted, registry_deleted_rows, old_versions_removed, dataset_replace, primary_cleared,
        titled_faq_removed, rebuild_preflight, label_repair_applied, crawl_state_merge, registry_audit_log, vector_append, labels_csv, versions_published, messages_appended,
    )
}

_KEY = lambda c: f"nullif(lower(regexp_replace({c}, '^\\s+|\\s+$', '', 'g')), '')"
_HASH = lambda c: f"nullif(regexp_replace(lower({c}), '\\s+|^\\s*[a-z0-9-]+:', '', 'g'), '')"
_LATEST = f"""(SELECT * FROM (SELECT *, {_KEY('document_id')} AS k, row_number() OVER (PARTITION BY {_KEY('document_id')} ORDER BY updated_at DESC NULLS LAST, version DESC, status DESC, source_title DESC) AS r
    FROM knowledge_documents WHERE {_KEY('document_id')} IS NOT NULL) WHERE r = 1)"""
_FAILED = f"(SELECT k FROM {_LATEST} WHERE status = 'failed')"
_DOC = _KEY("split_part(node_id, ':', 1)")
_META = lambda k: f"json_extract_string(metadata_, '$.{k}')"
_SET = f"coalesce(nullif({_META('dataset')}, ''), 'hkpl')"
_T = f"TIMESTAMP '{AT}'"
ORACLES = {
    "registry_insert": f"""
        WITH o AS (SELECT * FROM knowledge_documents WHERE uploaded_at < '2024-01-01')
        SELECT document_id, version, status, chunk_count, content_hash, updated_at, source_title FROM o
        UNION ALL SELECT m.document_id, 1, 'uploaded', 0, m.content_hash, {_T}, m.source_title FROM (
            SELECT *, row_number() OVER (PARTITION BY {_KEY('document_id')} ORDER BY document_id NULLS FIRST, content_hash NULLS FIRST, source_title NULLS FIRST) AS r,
                   {_KEY('document_id')} AS k FROM knowledge_documents WHERE uploaded_at >= '2024-01-01') m
        WHERE r = 1 AND k IS NOT NULL AND k NOT IN (SELECT {_KEY('document_id')} FROM o WHERE {_KEY('document_id')} IS NOT NULL)""",
    "registry_replace": f"""
        SELECT document_id, CASE WHEN hit THEN coalesce(version, 0) + 1 ELSE version END AS version, CASE WHEN hit THEN 'uploaded' ELSE status END AS status,
               CASE WHEN hit THEN 0 ELSE chunk_count END AS chunk_count, CASE WHEN hit THEN 'again-' || k ELSE content_hash END AS content_hash, CASE WHEN hit THEN {_T} ELSE updated_at END AS updated_at
        FROM (SELECT d.*, f.k, f.k IS NOT NULL AND status IS DISTINCT FROM 'deleted' AND {_HASH('content_hash')} IS DISTINCT FROM {_HASH("'again-' || f.k")} AS hit
              FROM knowledge_documents d LEFT JOIN {_FAILED} f ON f.k = {_KEY('d.document_id')})""",
    "registry_reindex": f"""
        SELECT document_id, version, CASE WHEN hit THEN 'uploaded' ELSE status END AS status, CASE WHEN hit THEN coalesce(asked, nullif(document_type, ''), 'auto') ELSE document_type END AS document_type
        FROM (SELECT d.*, a.asked, a.k IS NOT NULL AND status IS DISTINCT FROM 'deleted' AS hit FROM knowledge_documents d
              LEFT JOIN (SELECT {_KEY('document_id')} AS k, max(CASE WHEN file_type = 'html' THEN 'structured' END) AS asked FROM knowledge_documents WHERE category IS NOT NULL GROUP BY 1) a
              ON a.k = {_KEY('d.document_id')})""",
    "documents_deleted": f"SELECT node_id, count(*) AS n_rows FROM data_hkpl_knowledge WHERE {_DOC} IS NULL OR {_DOC} NOT IN {_FAILED} GROUP BY 1",
    "registry_deleted_rows": f"""
        SELECT document_id, version, CASE WHEN hit THEN 'deleted' ELSE status END AS status, chunk_count, content_hash, CASE WHEN hit THEN {_T} ELSE updated_at END AS updated_at
        FROM (SELECT *, {_KEY('document_id')} IN {_FAILED} AND status IS DISTINCT FROM 'deleted' AS hit FROM knowledge_documents)""",
    "old_versions_removed": f"""
        SELECT node_id, count(*) AS n_rows FROM data_hkpl_knowledge LEFT JOIN {_LATEST} l ON l.k = {_DOC}
        WHERE l.k IS NULL OR TRY_CAST({_META('document_version')} AS INTEGER) IS NOT DISTINCT FROM l.version GROUP BY 1""",
    "dataset_replace": f"""
        SELECT node_id, dataset, count(*) AS n_rows FROM (
            SELECT node_id, {_SET} AS dataset FROM data_hkpl_knowledge WHERE {_SET} <> 'hotpotqa'
            UNION ALL SELECT node_id, 'hotpotqa' FROM data_hkpl_knowledge WHERE {_META('document_type')} IS NULL) GROUP BY 1, 2""",
    "primary_cleared": f"""
        SELECT node_id, count(*) AS n_rows FROM data_hkpl_knowledge WHERE coalesce(lower(trim({_META('corpus_role')})) = 'distractor', false)
        OR lower(trim(coalesce(nullif({_META('dataset')}, ''), 'webz_news'))) IN ('hotpotqa', 'webz_news') GROUP BY 1""",
    "titled_faq_removed": f"""
        WITH t AS (SELECT {_KEY('source_title')} AS t FROM {_LATEST} WHERE {_KEY('source_title')} IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
        SELECT node_id, count(*) AS n_rows FROM data_hkpl_knowledge LEFT JOIN {_LATEST} l ON l.k = {_DOC}
        WHERE NOT (coalesce({_META('document_type')} = 'faq', false) AND coalesce({_KEY('l.source_title')} IN (SELECT t FROM t), false)) GROUP BY 1""",
    "rebuild_preflight": f"""
        WITH c AS (SELECT node_id, text, embedding, l.k, l.status FROM data_hkpl_knowledge LEFT JOIN {_LATEST} l ON l.k = {_DOC}),
        w AS (SELECT node_id FROM c GROUP BY 1 HAVING count(DISTINCT text) > 1)
        SELECT node_id, 'no_text' AS fault FROM c WHERE length(trim(coalesce(text, ''))) = 0 UNION SELECT node_id, 'no_embedding' FROM c WHERE embedding IS NULL
        UNION SELECT node_id, 'several_texts' FROM w UNION SELECT node_id, 'unknown_document' FROM c WHERE k IS NULL UNION SELECT node_id, 'deleted_document' FROM c WHERE status = 'deleted'
        UNION SELECT node_id, 'no_id' FROM c WHERE node_id IS NULL""",
    "label_repair_applied": f"""
        SELECT l.id, CASE WHEN r.new_chunk_id IS NOT NULL THEN split_part(r.new_chunk_id, ':', 1) ELSE source_document_id END AS source_document_id,
               coalesce(r.new_chunk_id, source_chunk_id) AS source_chunk_id
        FROM evaluation_dataset l LEFT JOIN (SELECT id, min(new_chunk_id) AS new_chunk_id FROM ({CORPORA["label_repair"]}) GROUP BY 1) r ON r.id = l.id""",
    "crawl_state_merge": """
        WITH r AS (SELECT trim(source_url) AS url, content_hash AS h, version > 1 AS new FROM knowledge_documents WHERE trim(source_url) <> '' AND version IS NOT NULL AND content_hash IS NOT NULL)
        SELECT url, max(h) FILTER (new = top) AS content_hash, 'webpage_' || left(sha256(url), 16) || '.html' AS kept_as
        FROM (SELECT *, max(new) OVER (PARTITION BY url) AS top FROM r) GROUP BY url""",
    "registry_audit_log": f"""
        WITH a AS (SELECT {_KEY('document_id')} AS doc, max(status) AS status, max(version) AS version FROM knowledge_documents WHERE version = 1 GROUP BY 1),
        b AS (SELECT {_KEY('document_id')} AS doc, max(status) AS status, max(version) AS version FROM knowledge_documents GROUP BY 1)
        SELECT doc, CASE WHEN a.doc IS NULL THEN 'insert' ELSE 'update' END AS action,
               CASE WHEN a.doc IS NOT NULL THEN '{{' || concat_ws(',', '"status":"' || a.status || '"', '"version":' || a.version) || '}}' END AS old_value,
               '{{' || concat_ws(',', '"status":"' || b.status || '"', '"version":' || b.version) || '}}' AS new_value
        FROM b LEFT JOIN a USING (doc) WHERE doc IS NOT NULL AND (a.doc IS NULL OR (a.status, a.version) IS DISTINCT FROM (b.status, b.version))""",
    "vector_append": f"SELECT node_id, {_SET} AS dataset, CAST(len(embedding) AS INTEGER) AS dims, count(*) AS n_rows FROM data_hkpl_knowledge GROUP BY ALL",
    "labels_csv": """
        SELECT id, nullif(domain, '') AS domain, md5(nullif(query, '')) AS query, md5(nullif(expected_answer_text, '')) AS answer, '[' || id || ']' AS refs
        FROM (SELECT DISTINCT id, domain, query, expected_answer_text FROM evaluation_dataset)""",
    "versions_published": f"SELECT k AS document_id, version, coalesce(status = 'completed', false) AS latest FROM {_LATEST}",
    "messages_appended": "SELECT session_id, count(*) AS n_rows, min(id) AS first_id FROM conversation_history WHERE regexp_matches(session_id, '\\S') AND regexp_matches(content, '\\S') GROUP BY 1",
}

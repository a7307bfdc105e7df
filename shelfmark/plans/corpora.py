"""Queries on the corpus, the registry and the labels, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators import corpus as C
from shelfmark.operators import labels as L
from shelfmark.operators import registry as R
from shelfmark.sources.tables import table


#: Dimensions of the vectors in the given chunk table.
DIMENSIONS = 8


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    return C.chunk_table(table(spark, folder, "data_hkpl_knowledge"))


def _registry(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "knowledge_documents")


def _labels(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "evaluation_dataset")


def corpus_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _chunks(spark, folder).groupBy(C.dataset_of(F.col("dataset")).alias("dataset")).agg(F.count("*").alias("n_vectors"))


def corpus_roles(spark: SparkSession, folder: str) -> DataFrame:
    name, role = C.normalised_role(F.col("dataset"), F.col("corpus_role"))
    rows = _chunks(spark, folder).select(name.alias("dataset"), role.alias("role"), C.is_distractor(F.col("dataset"), F.col("corpus_role")).alias("distractor"))
    return rows.groupBy("dataset", "role", "distractor").agg(F.count("*").alias("n_chunks"))


def audit_summary(spark: SparkSession, folder: str) -> DataFrame:
    return C.audit_summary(_chunks(spark, folder), DIMENSIONS)


def chunk_type_distribution(spark: SparkSession, folder: str) -> DataFrame:
    n = F.length("text")
    return _chunks(spark, folder).groupBy("document_type").agg(
        F.count("*").alias("n_chunks"), F.round(F.avg(n), 1).alias("avg_length"), F.min(n).alias("min_length"), F.max(n).alias("max_length")
    )


def chunks_per_document(spark: SparkSession, folder: str) -> DataFrame:
    return _chunks(spark, folder).groupBy("document_id").agg(F.count("*").alias("n_chunks"), F.count_distinct("section_index").alias("n_sections"))


def registry_mismatches(spark: SparkSession, folder: str) -> DataFrame:
    return C.registry_mismatches(_chunks(spark, folder), _registry(spark, folder))


def stale_or_orphaned(spark: SparkSession, folder: str) -> DataFrame:
    return C.stale_or_orphaned(_chunks(spark, folder), _registry(spark, folder))


def split_sections(spark: SparkSession, folder: str) -> DataFrame:
    rows = _chunks(spark, folder).groupBy("document_id", "section_index").agg(F.count_distinct("node_id").alias("n_chunks"))
    return rows.where("n_chunks > 1")


def duplicate_groups(spark: SparkSession, folder: str) -> DataFrame:
    return C.duplicate_groups(_chunks(spark, folder)).select("text_hash", "copies", "n_documents")


def audit_checks(spark: SparkSession, folder: str) -> DataFrame:
    return C.audit_checks(_chunks(spark, folder), _registry(spark, folder), DIMENSIONS)


def registry_latest(spark: SparkSession, folder: str) -> DataFrame:
    return R.current_documents(_registry(spark, folder), "status", "version", "updated_at")


def registry_counts(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.coalesce(F.when(F.col("source_kind") != "", F.col("source_kind")), F.when(F.col("source_type") != "", F.col("source_type")), F.lit("unknown"))
    rows = R.current_documents(_registry(spark, folder), "source_kind", "source_type", "status").where("status != 'deleted'")
    return rows.groupBy(kind.alias("source_kind"), "status").agg(F.count("*").alias("n_documents"))


def completed_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return R.completed_duplicates(_registry(spark, folder))


def active_web_documents(spark: SparkSession, folder: str) -> DataFrame:
    return R.active_web_documents(_registry(spark, folder))


def registry_delete(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with a failed state are deleted; the states of the registry afterwards."""
    registry = _registry(spark, folder)
    after = R.soft_deleted(registry, registry.where("status = 'failed'"), "2026-01-01 00:00:00")
    return after.select("document_id", "version", "status", F.coalesce(F.col("updated_at") == F.lit("2026-01-01 00:00:00").cast("timestamp_ntz"), F.lit(False)).alias("changed"))


def upload_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """Every registered page comes in again with the hash of its first state."""
    registry = _registry(spark, folder)
    incoming = registry.where("source_url is not null").groupBy(F.trim("source_url").alias("url")).agg(F.min("content_hash").alias("content_hash"))
    return R.upload_decisions(incoming, registry).select("url", "action")


def status_lifecycle(spark: SparkSession, folder: str) -> DataFrame:
    return R.folded_status(_registry(spark, folder))


def label_semi_join(spark: SparkSession, folder: str) -> DataFrame:
    found = L.labels_with_chunks(_labels(spark, folder), table(spark, folder, "data_hkpl_knowledge"))
    return found.select("id", "source_chunk_id").distinct()


def label_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return L.label_coverage(_labels(spark, folder), table(spark, folder, "data_hkpl_knowledge"))


def label_repair(spark: SparkSession, folder: str) -> DataFrame:
    return L.repaired_labels(_labels(spark, folder), table(spark, folder, "data_hkpl_knowledge"))


def label_merge(spark: SparkSession, folder: str) -> DataFrame:
    return L.merged_labels(_labels(spark, folder))


def label_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """The labels up to 2024 are stored, all labels come in; the latest of a query counts on both sides."""
    rows = _labels(spark, folder).where("query is not null")
    latest = lambda df: df.groupBy("query").agg(
        F.max_by("expected_answer_text", F.struct("created_at", "id")).alias("expected_answer_text"), F.max_by("domain", F.struct("created_at", "id")).alias("domain")
    )
    merged = L.upserted_labels(latest(rows.where("created_at < '2024-01-01'")), latest(rows), ["expected_answer_text", "domain"])
    return merged.select(F.md5("query").alias("query"), F.md5("expected_answer_text").alias("answer"), "domain", "change")


def label_sampling(spark: SparkSession, folder: str) -> DataFrame:
    return L.sampled_chunks(_chunks(spark, folder))


def evidence_hits(spark: SparkSession, folder: str) -> DataFrame:
    return L.evidence_hits(_labels(spark, folder), table(spark, folder, "data_hkpl_knowledge"))


QUERIES = {
    f.__name__: f
    for f in (
        corpus_counts, corpus_roles, audit_summary, chunk_type_distribution, chunks_per_document, registry_mismatches, stale_or_orphaned, split_sections,
        duplicate_groups, audit_checks, registry_latest, registry_counts, completed_duplicates, active_web_documents, registry_delete, upload_decisions, status_lifecycle,
        label_semi_join, label_coverage, label_repair, label_merge, label_upsert, label_sampling, evidence_hits,
    )
}

_S = r"'^\s+|\s+$', '', 'g'"
_KEY = lambda c: rf"nullif(lower(regexp_replace({c}, {_S})), '')"
_FORM = lambda c: rf"""regexp_replace(regexp_replace(regexp_replace(lower({c}), '\s+', ' ', 'g'), {_S}), '["''“”‘’]', '', 'g')"""
_COMPACT = lambda c: rf"regexp_replace(replace(lower({c}), 'ß', 'ss'), '[^\p{{L}}\p{{N}}_]+', '', 'g')"
_HASH = lambda c: rf"nullif(regexp_replace(lower({c}), '\s+|^\s*[a-z0-9-]+:', '', 'g'), '')"
_CHUNKS = f"""(SELECT node_id, text, {_KEY("split_part(node_id, ':', 1)")} AS document_id, metadata_->>'dataset' AS dataset, metadata_->>'corpus_role' AS corpus_role,
    metadata_->>'document_type' AS document_type, CAST(metadata_->>'document_version' AS INTEGER) AS version, CAST(metadata_->>'section_index' AS INTEGER) AS section_index,
    CAST(metadata_->>'chunk_index' AS INTEGER) AS chunk_index, embedding FROM data_hkpl_knowledge)"""
_CURRENT = f"""(SELECT * FROM (SELECT * REPLACE ({_KEY('document_id')} AS document_id), min(uploaded_at) OVER (PARTITION BY {_KEY('document_id')}) AS first_uploaded_at,
    row_number() OVER (PARTITION BY {_KEY('document_id')} ORDER BY updated_at DESC NULLS LAST, version DESC, status DESC) AS r FROM knowledge_documents) WHERE r = 1)"""
_AUDIT = f"""SELECT count(*) AS n_chunks, count(DISTINCT document_id) AS n_documents, count(*) FILTER (embedding IS NULL) AS no_embedding,
    count(*) FILTER (len(embedding) <> 8) AS bad_dims, count(*) FILTER (length(coalesce(text, '')) < 50) AS too_short,
    count(*) FILTER (coalesce(dataset, '') = '') AS no_dataset, count(*) FILTER (chunk_index IS NULL) AS no_index FROM {_CHUNKS}"""
_MISMATCH = f"""SELECT c.document_id, c.chunk_count, coalesce(s.stored, 0) AS stored FROM {_CURRENT} c
    LEFT JOIN (SELECT document_id, count(DISTINCT node_id) AS stored FROM {_CHUNKS} GROUP BY 1) s USING (document_id)
    WHERE c.status = 'completed' AND coalesce(c.chunk_count, 0) <> coalesce(s.stored, 0)"""
_STALE = f"""SELECT DISTINCT node_id, CASE WHEN c.document_id IS NULL THEN 'orphaned' ELSE 'stale' END AS kind FROM {_CHUNKS} k
    LEFT JOIN (SELECT * FROM {_CURRENT} WHERE status = 'completed') c ON c.document_id = k.document_id
    WHERE c.document_id IS NULL OR k.version IS DISTINCT FROM c.version"""
_WEB = """SELECT trim(source_url) AS url, arg_max(document_id, (updated_at, version, document_id)) AS document_id, count(*) AS n_rows FROM knowledge_documents
    WHERE status <> 'deleted' AND source_type IN ('crawler', 'webpage') AND trim(source_url) <> '' GROUP BY 1"""
_STORED = f"""(SELECT node_id, {_KEY("split_part(node_id, ':', 1)")} AS doc, min(text) AS text FROM data_hkpl_knowledge WHERE text IS NOT NULL GROUP BY node_id)"""
_ROLE = """CASE WHEN d IN ('hotpotqa', 'webz_news') THEN 'distractor' WHEN corpus_role <> '' THEN corpus_role WHEN d = 'hkpl' THEN 'primary' ELSE 'distractor' END"""
ORACLES = {
    "corpus_counts": f"SELECT coalesce(nullif(dataset, ''), 'hkpl') AS dataset, count(*) AS n_vectors FROM {_CHUNKS} GROUP BY 1",
    "corpus_roles": f"""SELECT d AS dataset, {_ROLE} AS role, coalesce(lower(trim(corpus_role)) = 'distractor', false)
        OR coalesce(lower(trim(dataset)) IN ('hotpotqa', 'webz_news'), false) AS distractor, count(*) AS n_chunks
        FROM (SELECT *, coalesce(nullif(dataset, ''), 'hkpl') AS d FROM {_CHUNKS}) GROUP BY 1, 2, 3""",
    "audit_summary": _AUDIT,
    "chunk_type_distribution": f"""SELECT document_type, count(*) AS n_chunks, round(avg(length(text)), 1) AS avg_length, CAST(min(length(text)) AS INTEGER) AS min_length,
        CAST(max(length(text)) AS INTEGER) AS max_length FROM {_CHUNKS} GROUP BY 1""",
    "chunks_per_document": f"SELECT document_id, count(*) AS n_chunks, count(DISTINCT section_index) AS n_sections FROM {_CHUNKS} GROUP BY 1",
    "registry_mismatches": _MISMATCH,
    "stale_or_orphaned": _STALE,
    "split_sections": f"SELECT document_id, section_index, count(DISTINCT node_id) AS n_chunks FROM {_CHUNKS} GROUP BY 1, 2 HAVING count(DISTINCT node_id) > 1",
    "duplicate_groups": f"""SELECT md5(text) AS text_hash, count(*) AS copies, count(DISTINCT document_id) AS n_documents FROM {_CHUNKS} WHERE text IS NOT NULL
        GROUP BY 1 HAVING count(*) > 1 ORDER BY copies DESC, text_hash LIMIT 20""",
    "audit_checks": f"""WITH a AS ({_AUDIT}), c AS (
        SELECT unnest(['no_embedding', 'bad_dims', 'too_short', 'no_dataset', 'no_index']) AS check_name, unnest([no_embedding, bad_dims, too_short, no_dataset, no_index]) AS n_found FROM a
        UNION ALL SELECT 'registry_mismatch', count(*) FROM ({_MISMATCH}) UNION ALL SELECT 'stale_or_orphaned', count(*) FROM ({_STALE})
        UNION ALL SELECT 'doubled_id', count(*) FROM (SELECT node_id FROM data_hkpl_knowledge GROUP BY 1 HAVING count(*) > 1))
        SELECT check_name, n_found, n_found = 0 AS passed FROM c UNION ALL SELECT 'overall', CAST(sum(n_found) AS BIGINT), sum(n_found) = 0 FROM c""",
    "registry_latest": f"SELECT document_id, status, version, updated_at, first_uploaded_at FROM {_CURRENT}",
    "registry_counts": f"SELECT coalesce(nullif(source_kind, ''), nullif(source_type, ''), 'unknown') AS source_kind, status, count(*) AS n_documents FROM {_CURRENT} WHERE status <> 'deleted' GROUP BY 1, 2",
    "completed_duplicates": f"""WITH k AS (SELECT document_id, {_HASH('content_hash')} AS h, first_uploaded_at AS up FROM {_CURRENT} WHERE status = 'completed'),
        f AS (SELECT h, arg_min(document_id, (up, document_id)) AS original FROM k WHERE h IS NOT NULL GROUP BY h HAVING count(*) > 1)
        SELECT document_id, original FROM k JOIN f USING (h) WHERE document_id <> original""",
    "active_web_documents": _WEB,
    "registry_delete": f"""WITH g AS (SELECT DISTINCT {_KEY('document_id')} AS k FROM knowledge_documents WHERE status = 'failed'),
        r AS (SELECT document_id, version, status, g.k IS NOT NULL AND status IS DISTINCT FROM 'deleted' AS hit FROM knowledge_documents d LEFT JOIN g ON g.k = {_KEY('d.document_id')})
        SELECT document_id, version, CASE WHEN hit THEN 'deleted' ELSE status END AS status, hit AS changed FROM r""",
    "upload_decisions": f"""WITH i AS (SELECT trim(source_url) AS url, {_HASH('min(content_hash)')} AS h FROM knowledge_documents WHERE source_url IS NOT NULL GROUP BY 1),
        w AS ({_WEB}), c AS (SELECT document_id, status, {_HASH('content_hash')} AS h FROM {_CURRENT}), d AS (SELECT DISTINCT h FROM c WHERE status = 'completed' AND h IS NOT NULL)
        SELECT i.url, CASE WHEN w.document_id IS NOT NULL AND c.h IS NOT DISTINCT FROM i.h THEN 'unchanged' WHEN w.document_id IS NOT NULL THEN 'replace'
                    WHEN d.h IS NOT NULL THEN 'duplicate' ELSE 'create' END AS action
        FROM i LEFT JOIN w USING (url) LEFT JOIN c ON c.document_id = w.document_id LEFT JOIN d ON d.h = i.h""",
    "status_lifecycle": f"""WITH r AS (SELECT DISTINCT * FROM knowledge_documents)
        SELECT {_KEY('document_id')} AS document_id, arg_max_null(status, (updated_at, version, status)) AS status, arg_max_null(error_message, (updated_at, version, status)) AS error_message,
               arg_max(chunk_count, (updated_at, version, status)) FILTER (chunk_count IS NOT NULL) AS chunk_count, count(*) AS n_states FROM r GROUP BY 1""",
    "label_semi_join": f"SELECT DISTINCT id, source_chunk_id FROM evaluation_dataset WHERE {_KEY('source_chunk_id')} IN (SELECT {_KEY('node_id')} FROM data_hkpl_knowledge)",
    "label_coverage": f"""WITH l AS (SELECT DISTINCT * FROM evaluation_dataset), c AS (SELECT {_KEY('node_id')} AS k, min(text) AS text FROM data_hkpl_knowledge GROUP BY 1)
        SELECT count(*) AS n_labels, count(text) AS chunk_found,
               count(*) FILTER (contains({_FORM('text')}, {_FORM('expected_context_snippet')}) AND length({_FORM('expected_context_snippet')}) > 0) AS snippet_found,
               count(*) FILTER (contains({_FORM('text')}, {_FORM('expected_answer_text')}) AND length({_FORM('expected_answer_text')}) > 0) AS answer_found
        FROM l LEFT JOIN c ON c.k = {_KEY('source_chunk_id')}""",
    "label_repair": f"""WITH s AS (SELECT DISTINCT id, expected_answer_text AS a, expected_context_snippet AS e, {_KEY('source_document_id')} AS doc FROM evaluation_dataset
            WHERE {_KEY('source_chunk_id')} IS NULL OR {_KEY('source_chunk_id')} NOT IN (SELECT {_KEY('node_id')} FROM data_hkpl_knowledge)),
        h AS (SELECT id, node_id, length(text) AS n, unnest([CASE WHEN length(trim(e)) > 0 AND contains({_FORM('text')}, {_FORM('e')}) THEN 1 END,
                CASE WHEN length({_COMPACT('e')}) >= 40 AND contains({_COMPACT('text')}, {_COMPACT('e')}) THEN 2 END,
                CASE WHEN length(trim(a)) > 0 AND contains({_FORM('text')}, {_FORM('a')}) THEN 3 END,
                CASE WHEN length({_COMPACT('a')}) >= 40 AND contains({_COMPACT('text')}, {_COMPACT('a')}) THEN 4 END]) AS tier FROM s JOIN {_STORED} USING (doc)),
        b AS (SELECT * FROM (SELECT *, min(tier) OVER (PARTITION BY id) AS best FROM h WHERE tier IS NOT NULL) WHERE tier = best),
        c AS (SELECT id, CASE WHEN tier <= 2 OR count(DISTINCT node_id) = 1 THEN arg_min(node_id, (n, node_id)) END AS new_chunk_id, CAST(tier AS INTEGER) AS tier FROM b GROUP BY id, tier)
        SELECT i.id, new_chunk_id, tier, CASE WHEN tier IS NULL THEN 'not_found' WHEN new_chunk_id IS NULL THEN 'ambiguous' ELSE 'repaired' END AS outcome FROM (SELECT DISTINCT id FROM s) i LEFT JOIN c ON c.id = i.id""",
    "label_merge": f"""WITH l AS (SELECT DISTINCT *, {_FORM('query')} AS form FROM evaluation_dataset)
        SELECT arg_max(id, (created_at, id)) AS id, count(DISTINCT id) AS n_labels, count(DISTINCT coalesce({_FORM('expected_answer_text')}, '')) > 1 AS conflicting
        FROM l WHERE form <> '' GROUP BY form""",
    "label_upsert": """WITH o AS (SELECT query, arg_max_null(expected_answer_text, (created_at, id)) AS a, arg_max_null(domain, (created_at, id)) AS d FROM evaluation_dataset WHERE query IS NOT NULL AND created_at < '2024-01-01' GROUP BY 1),
        n AS (SELECT query, arg_max_null(expected_answer_text, (created_at, id)) AS a, arg_max_null(domain, (created_at, id)) AS d FROM evaluation_dataset WHERE query IS NOT NULL GROUP BY 1)
        SELECT md5(coalesce(n.query, o.query)) AS query, md5(CASE WHEN n.query IS NOT NULL THEN n.a ELSE o.a END) AS answer, CASE WHEN n.query IS NOT NULL THEN n.d ELSE o.d END AS domain,
               CASE WHEN o.query IS NULL THEN 'inserted' WHEN n.query IS NOT NULL AND (n.a, n.d) IS DISTINCT FROM (o.a, o.d) THEN 'updated' ELSE 'kept' END AS change
        FROM o FULL JOIN n ON n.query = o.query""",
    "label_sampling": f"""SELECT node_id, document_id, CAST(n AS INTEGER) AS n FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY node_id) AS n
        FROM (SELECT DISTINCT node_id, document_id FROM {_CHUNKS} WHERE length(trim(text)) >= 120)) WHERE n <= 8""",
    "evidence_hits": f"""WITH l AS (SELECT DISTINCT id, {_KEY('source_document_id')} AS doc, {_KEY('source_chunk_id')} AS k, {_FORM('expected_context_snippet')} AS f FROM evaluation_dataset),
        s AS (SELECT DISTINCT {_KEY('node_id')} AS k FROM data_hkpl_knowledge), t AS (SELECT DISTINCT {_KEY("split_part(node_id, ':', 1)")} AS doc, {_FORM('text')} AS form FROM data_hkpl_knowledge WHERE text IS NOT NULL),
        n AS (SELECT DISTINCT id FROM l JOIN t USING (doc) WHERE length(f) > 0 AND contains(form, f))
        SELECT l.id, min(CASE WHEN s.k IS NOT NULL THEN 'exact_chunk' WHEN n.id IS NOT NULL THEN 'equivalent_evidence' ELSE 'missing' END) AS match_mode
        FROM l LEFT JOIN s ON s.k = l.k LEFT JOIN n ON n.id = l.id GROUP BY l.id""",
}

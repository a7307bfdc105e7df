"""Queries on references, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfmark.operators.references import orphan_references, orphan_report
from shelfmark.sources.tables import table


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return orphan_references(
        table(spark, folder, "evaluation_dataset"),
        table(spark, folder, "knowledge_documents"),
        table(spark, folder, "data_hkpl_knowledge").select("node_id"),
    )


def p4_report(spark: SparkSession, folder: str) -> DataFrame:
    return orphan_report(p4_found(spark, folder))


P4_SQL = r"""
    WITH reg AS (
        SELECT lower(regexp_replace(document_id, '^\s+|\s+$', '', 'g')) AS doc, status, updated_at, version, uploaded_at
        FROM knowledge_documents),
    docs AS (
        SELECT doc, arg_max(status, (updated_at, version, status)) AS status, min(uploaded_at) AS first_uploaded
        FROM reg GROUP BY doc),
    chunks AS (SELECT DISTINCT lower(regexp_replace(node_id, '^\s+|\s+$', '', 'g')) AS node FROM data_hkpl_knowledge),
    refs AS (
        SELECT DISTINCT id, created_at, 'source_document_id' AS ref_column,
               lower(regexp_replace(source_document_id, '^\s+|\s+$', '', 'g')) AS key FROM evaluation_dataset
        UNION
        SELECT DISTINCT id, created_at, 'source_chunk_id',
               lower(regexp_replace(source_chunk_id, '^\s+|\s+$', '', 'g')) FROM evaluation_dataset),
    judged AS (
        SELECT r.id, r.ref_column, strftime(r.created_at, '%Y-%m') AS period,
               CASE WHEN d.status = 'deleted' THEN 'deleted'
                    WHEN d.doc IS NULL OR (r.ref_column = 'source_chunk_id' AND c.node IS NULL) THEN 'missing'
                    WHEN d.first_uploaded > r.created_at THEN 'later' END AS orphan_kind
        FROM refs r LEFT JOIN docs d ON d.doc = split_part(r.key, ':', 1)
        LEFT JOIN chunks c ON c.node = r.key WHERE r.key <> '')
    SELECT DISTINCT id, ref_column, period, orphan_kind FROM judged WHERE orphan_kind IS NOT NULL"""

QUERIES = {"p4_found": p4_found, "p4_report": p4_report}
ORACLES = {
    "p4_found": P4_SQL,
    "p4_report": f"SELECT ref_column, period, orphan_kind, count(*) AS n_orphans FROM ({P4_SQL}) GROUP BY ALL",
}

"""The queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.boilerplate import frame_found, frame_lines
from shelfmark.llm.bpe import encode_corpus
from shelfmark.llm.canonical import canonical_text, odd_characters
from shelfmark.llm.conversations import closed_segments, conversations, session_defects
from shelfmark.llm.dedup import repeated_deliveries
from shelfmark.llm.lines import repeated_lines, without_repeated_lines
from shelfmark.llm.packing import packed_texts
from shelfmark.llm.pairs import defective_pairs
from shelfmark.llm.pieces import split_texts
from shelfmark.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return defective_pairs(table(spark, folder, "evaluation_dataset"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_deliveries(
        table(spark, folder, "ingest_batches"),
        table(spark, folder, "knowledge_documents"),
        table(spark, folder, "data_hkpl_knowledge"),
    )


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    segments = closed_segments(spark, f"{folder}/conversation_history.parquet")
    return session_defects(segments).where("defect is not null")


def p3_conversations(spark: SparkSession, folder: str) -> DataFrame:
    return conversations(closed_segments(spark, f"{folder}/conversation_history.parquet"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return frame_found(table(spark, folder, "data_hkpl_knowledge"), table(spark, folder, "knowledge_documents"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_lines(table(spark, folder, "data_hkpl_knowledge"), table(spark, folder, "knowledge_documents"))


def p6_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Each chunk's text without the lines repeated on its site, as its hash."""
    pages = table(spark, folder, "data_hkpl_knowledge")
    cut = without_repeated_lines(pages, repeated_lines(pages, table(spark, folder, "knowledge_documents")))
    return cut.select("node_id", F.md5("text").alias("text"))


def p5_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The main body of each document as its hash: its article lines in order."""
    lines = frame_lines(table(spark, folder, "data_hkpl_knowledge"), table(spark, folder, "knowledge_documents"), with_text=True)
    kept = F.array_sort(F.collect_list(F.when(~F.col("frame"), F.struct("chunk_index", "node_id", "line_no", "line"))))
    return lines.groupBy("doc").agg(kept.alias("lines")).select("doc", F.md5(F.array_join("lines.line", "\n")).alias("body"), F.size("lines").alias("n_lines"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    chunks = canonical_text(table(spark, folder, "data_hkpl_knowledge"), "node_id", "text", "data_hkpl_knowledge")
    labels = canonical_text(
        table(spark, folder, "evaluation_dataset"), "id", "expected_context_snippet", "evaluation_dataset"
    )
    return odd_characters(chunks.unionByName(labels))


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_corpus(table(spark, folder, "documents"))


def p9_groups(spark: SparkSession, folder: str) -> DataFrame:
    return packed_texts(table(spark, folder, "documents"))


def p10_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return split_texts(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p3_conversations": p3_conversations,
    "p5_found": p5_found,
    "p5_texts": p5_texts,
    "p6_found": p6_found,
    "p6_texts": p6_texts,
    "p7_found": p7_found,
    "p8_ids": p8_ids,
    "p9_groups": p9_groups,
    "p10_pieces": p10_pieces,
}

_SESSIONS_SQL = r"""
        WITH m AS (
            SELECT session_id, id, created_at,
                   CASE lower(regexp_replace(role, '^[\s\x{A0}]+|[\s\x{A0}]+$', '', 'g')) WHEN 'user' THEN 'user' WHEN 'human' THEN 'user'
                        WHEN 'assistant' THEN 'assistant' WHEN 'bot' THEN 'assistant' WHEN 'ai' THEN 'assistant'
                        WHEN 'system' THEN 'system' END AS who,
                   regexp_replace(content, '^[\s\x{A0}\x{3000}]+|[\s\x{A0}\x{3000}]+$', '', 'g') AS say,
                   coalesce(regexp_replace(content, '[\s\p{Z}\x{200B}-\x{200F}\x{2060}-\x{2064}\x{FEFF}\x{AD}]+', '', 'g') <> '', false) AS shown
            FROM conversation_history WHERE trim(coalesce(session_id, '')) <> ''),
        rough AS (
            SELECT *, lag(who) OVER w AS pw, lag(say) OVER w AS ps FROM m
            WHERE shown AND who IN ('user', 'assistant') WINDOW w AS (PARTITION BY session_id ORDER BY created_at, id, who, say)),
        turns AS (
            SELECT session_id, id, created_at, say, who, lag(who) OVER v AS pw, lead(who) OVER v AS nw FROM rough
            WHERE NOT coalesce(who = pw AND say = ps, false) WINDOW v AS (PARTITION BY session_id ORDER BY created_at, id, who, say)),
        a AS (SELECT session_id, bool_or(shown) AS visible, bool_or(created_at IS NULL OR who IS NULL) AS bad FROM m GROUP BY 1),
        b AS (SELECT session_id, bool_or(who = 'assistant' AND coalesce(pw, 'assistant') = 'assistant') AS broken,
                     bool_or(who = 'user' AND coalesce(nw, 'user') = 'user') AS lacks FROM turns GROUP BY 1),
        judged AS (SELECT a.session_id, CASE WHEN NOT visible THEN 'empty' WHEN bad OR broken THEN 'broken'
                              WHEN lacks THEN 'missing_reply' END AS defect FROM a LEFT JOIN b USING (session_id))"""

_REPEATED_SQL = r"""
        WITH cur AS (
            SELECT document_id, regexp_replace(regexp_replace(regexp_extract(lower(trim(source_url)),
                       '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1), ':[0-9]*$', ''), '^www\.', '') AS site
            FROM (SELECT lower(trim(document_id)) AS document_id, source_url, row_number() OVER (
                      PARTITION BY lower(trim(document_id)) ORDER BY updated_at DESC NULLS LAST, version DESC, status DESC) AS r
                  FROM knowledge_documents) WHERE r = 1),
        lines AS (
            SELECT node_id, lower(split_part(node_id, ':', 1)) AS doc, generate_subscripts(ls, 1) AS line_no, unnest(ls) AS line
            FROM (SELECT node_id, string_split(text, chr(10)) AS ls FROM data_hkpl_knowledge)),
        forms AS (
            SELECT node_id, doc, line_no, regexp_replace(regexp_replace(lower(line),
                       '[\s\x0B\p{Z}\x{1C}-\x{1F}\x{85}\p{Nd}]+', '', 'g'), '[.!?:;,。…]+$', '') AS form FROM lines),
        placed AS (SELECT f.*, site FROM forms f JOIN cur ON doc = document_id WHERE site <> '' AND form <> ''),
        often AS (SELECT site, form FROM placed GROUP BY site, form HAVING count(DISTINCT doc) >= 8)
        SELECT DISTINCT node_id, CAST(line_no AS INTEGER) AS line_no FROM placed JOIN often USING (site, form)"""

#: The same in SQL, where SQL can say it.
ORACLES: dict[str, str] = {
    "p3_found": _SESSIONS_SQL + " SELECT session_id, defect FROM judged WHERE defect IS NOT NULL",
    "p3_conversations": _SESSIONS_SQL + """
        SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY created_at, id, who, say) AS turn_no, who AS role, say AS content, id
        FROM turns JOIN judged USING (session_id) WHERE defect IS NULL""",
    "p6_found": _REPEATED_SQL,
    "p6_texts": rf"""
        WITH gone AS ({_REPEATED_SQL}), t AS (SELECT node_id, min(text) AS text FROM data_hkpl_knowledge GROUP BY 1),
        l AS (SELECT node_id, generate_subscripts(ls, 1) AS line_no, unnest(ls) AS line FROM (SELECT node_id, string_split(text, chr(10)) AS ls FROM t)),
        k AS (SELECT node_id, string_agg(line, chr(10) ORDER BY line_no) AS text FROM l ANTI JOIN gone USING (node_id, line_no) GROUP BY 1)
        SELECT t.node_id, CASE WHEN t.text IS NOT NULL THEN md5(coalesce(k.text, '')) END AS text FROM t LEFT JOIN k USING (node_id)""",
}

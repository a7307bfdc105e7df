"""Queries on texts and chunks, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import text as T
from shelfmark.operators import chunking as C
from shelfmark.sources.tables import table

NORMAL_SQL = r"""regexp_replace(regexp_replace(regexp_replace(replace(replace(text, chr(160), ' '), chr(0), ''), '[ \t]+', ' ', 'g'),
                 '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"""
LINES_SQL = "SELECT doc_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)"


def _sections_sql(opens: str, where: str = "true") -> str:
    return rf"""
        SELECT doc_id, section_index, regexp_replace(string_agg(line, chr(10) ORDER BY pos), '^\s+|\s+$', '', 'g') AS text
        FROM (SELECT doc_id, pos, line, CAST(sum(CASE WHEN {opens} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS section_index
              FROM ({LINES_SQL}) WHERE {where}) GROUP BY doc_id, section_index
        HAVING length(regexp_replace(string_agg(line, chr(10) ORDER BY pos), '^\s+|\s+$', '', 'g')) > 0"""


def _digest(df: DataFrame) -> DataFrame:
    """Long texts as their hash, so that results stay small."""
    return df.withColumn("text", F.sha2("text", 256)) if "text" in df.columns else df


def text_functions(spark: SparkSession, folder: str) -> DataFrame:
    text = F.col("text")
    return table(spark, folder, "documents").where("text is not null").select(
        "doc_id", F.sha2(T.normalize_text(text), 256).alias("normal"), F.md5(T.label_form(text)).alias("label_form"),
        F.length(T.compact_form(text)).alias("compact_length"), T.estimated_tokens(text).alias("tokens"),
        T.slug(text).alias("slug"), F.length(T.one_line(text)).alias("line_length"),
    )


def token_usage(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").withColumn("tokens", T.estimated_tokens(F.col("text")))
    return docs.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.bool_or(F.col("text").isNull()).alias("any_missing"), F.count("*").alias("n_docs"))


def document_type_detect(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    kind = C.document_type(F.col("text"), F.col("title"), explicit=F.when(F.col("document_type") != "auto", F.col("document_type")))
    return docs.select("doc_id", kind.alias("kind"), C.strategy_of(kind).alias("strategy"))


def type_rules(spark: SparkSession, folder: str) -> DataFrame:
    kind = C.document_type(F.col("text"), F.col("title"))
    return table(spark, folder, "documents").groupBy(kind.alias("kind")).agg(F.count("*").alias("n_docs"))


def heading_sections(spark: SparkSession, folder: str) -> DataFrame:
    return _digest(C.heading_sections(table(spark, folder, "documents")))


def marked_sections(spark: SparkSession, folder: str) -> DataFrame:
    return _digest(C.marked_sections(table(spark, folder, "documents")))


def announcement_entries(spark: SparkSession, folder: str) -> DataFrame:
    return _digest(C.announcement_entries(table(spark, folder, "documents")))


def announcement_listing(spark: SparkSession, folder: str) -> DataFrame:
    """The dated entries of a listing for each category, made of the titles in the registry under their dates."""
    rows = table(spark, folder, "knowledge_documents").where("effective_date is not null and source_title is not null").select(
        "category", "effective_date", F.trim(F.regexp_replace("source_title", r"\s+", " ")).alias("title")
    ).where("title != ''").distinct()
    line = F.concat(F.date_format("effective_date", "dd.MM.yyyy"), F.lit(" "), "title")
    listing = rows.groupBy("category").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("lines"))
    name = F.coalesce("category", F.lit("other"))
    return _digest(C.announcement_entries(listing.select(name.alias("doc_id"), F.concat(F.lit("Notices of "), name, F.lit("\n\n"), "lines").alias("text"))))


def conformity_checks(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "data_hkpl_knowledge").select("node_id", F.get_json_object("metadata_", "$.document_type").alias("document_type"), "text")
    return C.conformity_faults(rows)


def titled_chunks(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").where("text is not null")
    return docs.select("doc_id", F.md5(C.titled(F.left("text", F.lit(1800)), F.col("title"))).alias("text"))


def whole_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Documents kept whole, in pieces without overlap only where they are too long."""
    return _digest(C.greedy_pieces(table(spark, folder, "documents"), *C.ATOMIC))


def faq_entries(spark: SparkSession, folder: str) -> DataFrame:
    return _digest(C.faq_entries(table(spark, folder, "documents")))


def paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    return _digest(C.paragraphs(table(spark, folder, "documents")))


def chunk_ids(spark: SparkSession, folder: str) -> DataFrame:
    return C.content_chunks(C.paragraphs(table(spark, folder, "documents"))).select("chunk_id", "doc_id", "chunk_index", F.length("text").alias("n"))


def sentence_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return _digest(C.greedy_pieces(table(spark, folder, "documents")))


def news_clean(spark: SparkSession, folder: str) -> DataFrame:
    return _digest(C.cleaned_lines(table(spark, folder, "documents")))


def record_texts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "knowledge_documents").distinct()
    columns = ["source_title", "file_type", "language", "category"]
    return docs.groupBy(F.md5(C.record_lines(docs, columns)).alias("record")).agg(F.count("*").alias("n_rows"))


def directory_entries(spark: SparkSession, folder: str) -> DataFrame:
    return _digest(C.directory_entries(table(spark, folder, "documents")))


def shared_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    return C.shared_paragraphs(table(spark, folder, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        text_functions, token_usage, document_type_detect, type_rules, heading_sections, marked_sections, announcement_entries,
        faq_entries, paragraphs, chunk_ids, sentence_pieces, news_clean, record_texts,
        directory_entries, shared_paragraphs, announcement_listing, conformity_checks, titled_chunks, whole_pieces,
    )
}

_STRIP = r"'^\s+|\s+$', '', 'g'"
_PARA = rf"""SELECT doc_id, section_index, text FROM (
        SELECT doc_id, CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS section_index, regexp_replace(unnest(p), {_STRIP}) AS text
        FROM (SELECT doc_id, regexp_split_to_array(text, '\n\s*\n') AS p FROM documents WHERE text IS NOT NULL)) WHERE length(text) > 0"""
_DATED = r"^\(?\s*\d{1,2}[./-]\d{1,2}[./-]\d{2,4}\s*\)?(?:\s+|$)"


def _entries_sql(texts: str) -> str:
    """Dated entries of `texts(doc_id, text)`, in the words of SQL."""
    return rf"""
        WITH t AS ({texts}), l AS (SELECT * FROM (SELECT doc_id, pos, regexp_replace(line, {_STRIP}) AS line FROM (
            SELECT doc_id, generate_subscripts(p, 1) AS pos, unnest(p) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM t WHERE text IS NOT NULL))) WHERE line <> ''),
        d AS (SELECT *, regexp_matches(line, '{_DATED}') AS dated FROM l),
        e AS (SELECT *, CAST(sum(CAST(dated AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS entry, sum(CAST(dated AS INTEGER)) OVER (PARTITION BY doc_id) AS n FROM d),
        g AS (SELECT doc_id, entry, string_agg(line, chr(10) ORDER BY pos) AS part FROM e WHERE n >= 2 GROUP BY 1, 2)
        SELECT g.doc_id, g.entry AS entry_index, concat_ws(chr(10) || chr(10), h.part, g.part) AS text FROM g LEFT JOIN (SELECT * FROM g WHERE entry = -1) h USING (doc_id) WHERE g.entry >= 0
        UNION ALL SELECT doc_id, 0, text FROM t WHERE text IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM g)"""


_KINDS = ("faq", "directory", "announcement", "policy", "structured", "record_based", "news", "prose")
_KIND_SQL = rf"""CASE
    WHEN regexp_matches(text, '(?is)\bquestion\s*:.*?\banswer\s*:') OR len(list_filter(regexp_extract_all(text, '(?i)\bq(\d+)\s*[:.)]', 1),
         lambda n: regexp_matches(text, '(?is)\bq' || n || '\s*[:.)].*\ba' || n || '\s*[:.)]'))) > 0 THEN 'faq'
    WHEN regexp_matches(text, '(?is)\bdistrict\b.*\bpublic library\b.*\btel\s*:') THEN 'directory'
    WHEN regexp_matches(title, '(?is)\bannouncements?\b|\bnotices?\b|\btemporary closure\b|\bsuspension\b') THEN 'announcement'
    WHEN regexp_matches(text, '(?is)\bpolicy\b|\brules?\b|\bregulations?\b|\bguidelines?\b') THEN 'policy'
    WHEN regexp_matches(text, '(?is)(?:^|\n)##\s+') THEN 'structured' ELSE 'prose' END"""
_TYPED = f"(SELECT doc_id, document_type, {_KIND_SQL} AS kind FROM (SELECT doc_id, document_type, coalesce(text, '') AS text, coalesce(title, '') AS title FROM documents))"
ORACLES = {
    "text_functions": rf"""
        SELECT doc_id, sha256({NORMAL_SQL}) AS normal,
               md5(regexp_replace(regexp_replace(regexp_replace(lower(text), '\s+', ' ', 'g'), {_STRIP}), '["''“”‘’]', '', 'g')) AS label_form,
               CAST(length(regexp_replace(replace(lower(text), 'ß', 'ss'), '[^\p{{L}}\p{{N}}_]+', '', 'g')) AS INTEGER) AS compact_length,
               CAST(CASE WHEN length(text) > 0 THEN greatest(1, round_even(length(text) / 4, 0)) ELSE 0 END AS INTEGER) AS tokens,
               left(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 48) AS slug,
               CAST(length(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), {_STRIP})) AS INTEGER) AS line_length
        FROM documents WHERE text IS NOT NULL""",
    "token_usage": """
        SELECT source, CAST(sum(CASE WHEN length(text) > 0 THEN greatest(1, round_even(length(text) / 4, 0)) ELSE 0 END) AS BIGINT) AS tokens,
               bool_or(text IS NULL) AS any_missing, count(*) AS n_docs FROM documents GROUP BY source""",
    "heading_sections": _sections_sql(r"regexp_matches(line, '^#{1,6}\s+\S')"),
    "marked_sections": f"""SELECT * FROM ({_sections_sql(r"regexp_matches(line, '^##\s')")})
        WHERE len(list_filter(regexp_split_to_array(regexp_replace(text, '(?m)^##\\s+', '', 'g'), '\\s+'), lambda w: w <> '')) >= 5""",
    "announcement_entries": _entries_sql("SELECT doc_id, text FROM documents"),
    "announcement_listing": _entries_sql(r"""
        SELECT coalesce(category, 'other') AS doc_id, 'Notices of ' || coalesce(category, 'other') || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY line) AS text
        FROM (SELECT DISTINCT category, strftime(effective_date, '%d.%m.%Y') || ' ' || trim(regexp_replace(source_title, '\s+', ' ', 'g'), ' ') AS line
              FROM knowledge_documents WHERE effective_date IS NOT NULL AND trim(regexp_replace(source_title, '\s+', ' ', 'g'), ' ') <> '') GROUP BY category"""),
    "document_type_detect": f"""SELECT doc_id, kind, CASE kind WHEN 'faq' THEN 'faq_entries' WHEN 'directory' THEN 'directory_sections' WHEN 'announcement' THEN 'announcement_entries'
        WHEN 'structured' THEN 'marked_sections' WHEN 'record_based' THEN 'atomic' ELSE 'prose' END AS strategy
        FROM (SELECT doc_id, CASE WHEN lower(trim(document_type, ' ')) IN {_KINDS} THEN lower(trim(document_type, ' ')) ELSE kind END AS kind FROM {_TYPED})""",
    "type_rules": f"SELECT kind, count(*) AS n_docs FROM {_TYPED} GROUP BY 1",
    "titled_chunks": rf"""
        SELECT doc_id, md5(CASE WHEN length(t) > 0 AND NOT starts_with(x, 'Title: ' || t) THEN 'Title: ' || t || chr(10) || chr(10) || x ELSE x END) AS text
        FROM (SELECT doc_id, left(text, 1800) AS x, regexp_replace(title, {_STRIP}) AS t FROM documents WHERE text IS NOT NULL)""",
    "conformity_checks": rf"""
        WITH c AS (SELECT node_id, json_extract_string(metadata_, '$.document_type') AS kind, text, list_sort(list_distinct(regexp_extract_all(text, '(?im)^\s*Q(\d+)\s*[:.)]', 1))) AS q,
                   list_sort(list_distinct(regexp_extract_all(text, '(?im)^\s*A(\d+)\s*[:.)]', 1))) AS a FROM data_hkpl_knowledge)
        SELECT node_id, 'labels_differ' AS fault FROM c WHERE kind = 'faq' AND q <> a UNION SELECT node_id, 'several_questions' FROM c WHERE kind = 'faq' AND len(q) > 1
        UNION SELECT node_id, 'no_library' FROM c WHERE kind = 'directory' AND NOT regexp_matches(text, '(?im)^\s*Library:\s*\S')
        UNION SELECT node_id, 'no_date' FROM c WHERE kind = 'announcement' AND NOT regexp_matches(text, '(?m){_DATED}')""",
    "faq_entries": rf"""
        WITH s AS (SELECT doc_id, text, regexp_replace(text, '(?im)^(\s*Q\d+\s*[:.)])', chr(1) || '\1', 'g') AS m FROM documents WHERE text IS NOT NULL),
        p AS (SELECT doc_id, text, string_split(m, chr(1)) AS p FROM s),
        h AS (SELECT doc_id, text, nullif(regexp_replace(p[1], {_STRIP}), '') AS head, p[2:] AS e FROM p)
        SELECT doc_id, CAST(generate_subscripts(e, 1) - 1 AS INTEGER) AS entry_index, sha256(concat_ws(chr(10) || chr(10), head, regexp_replace(unnest(e), {_STRIP}))) AS text FROM h WHERE len(e) > 0
        UNION ALL SELECT doc_id, 0, sha256(text) FROM h WHERE len(e) = 0""",
    "paragraphs": _PARA,
    "chunk_ids": rf"""
        WITH p AS (SELECT doc_id, section_index, row_number() OVER (PARTITION BY doc_id ORDER BY section_index) - 1 AS chunk_index, {NORMAL_SQL} AS text FROM ({_PARA})),
        u AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sha256(text) ORDER BY chunk_index) AS r FROM p WHERE length(regexp_replace(text, {_STRIP})) >= 50)
        SELECT doc_id || ':v1:s' || section_index || ':c' || chunk_index || ':' || left(sha256(text), 16) AS chunk_id, doc_id,
               CAST(chunk_index AS INTEGER) AS chunk_index, CAST(length(text) AS INTEGER) AS n FROM u WHERE r = 1""",
    "news_clean": rf"""
        WITH l AS (SELECT doc_id, pos, regexp_replace(regexp_replace(line, '\s+', ' ', 'g'), {_STRIP}) AS line FROM ({LINES_SQL})),
        k AS (SELECT * FROM (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM l WHERE line <> '') WHERE before IS NULL OR before <> line),
        f AS (SELECT k.*, min(CASE WHEN line IS DISTINCT FROM regexp_replace(regexp_replace(title, '\s+', ' ', 'g'), {_STRIP}) THEN pos END) OVER (PARTITION BY doc_id) AS first
              FROM k JOIN (SELECT doc_id, title FROM documents) USING (doc_id))
        SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM f WHERE pos >= first GROUP BY doc_id""",
    "shared_paragraphs": f"""
        SELECT left(sha256(coalesce(title, '') || chr(10) || text), 24) AS paragraph_id, min(coalesce(title, '')) AS title, count(DISTINCT doc_id) AS n_documents, min(doc_id) AS first_id
        FROM ({_PARA}) JOIN (SELECT doc_id, title FROM documents) USING (doc_id) GROUP BY 1""",
    "directory_entries": rf"""
        WITH l AS (SELECT *, regexp_replace(regexp_replace(raw, '^(.*?)## ', '\1'), {_STRIP}) AS line FROM (SELECT doc_id, pos, regexp_replace(line, {_STRIP}) AS raw FROM ({LINES_SQL})) WHERE raw <> ''),
        a AS (SELECT *, contains(raw, '## ') AND len(regexp_split_to_array(line, '\s+')) <= 6 AND NOT regexp_matches(line, '\d')
                     AND NOT regexp_matches(lower(line), 'library|tel|road|street|building|floor|estate|services|enquiries|website') AS is_area FROM l WHERE line <> ''),
        b AS (SELECT *, NOT is_area AND len(regexp_split_to_array(line, '\s+')) <= 8 AND contains(lower(line), 'library') AND NOT starts_with(lower(line), 'hong kong public libraries') AS is_library FROM a),
        c AS (SELECT *, coalesce(last_value(CASE WHEN is_area THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos), '') AS area,
                     sum(CASE WHEN is_library OR is_area THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS entry FROM b),
        g AS (SELECT doc_id, entry, min(area) AS area, min(CASE WHEN is_library THEN line END) AS library, string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT is_library AND NOT is_area) AS body FROM c GROUP BY 1, 2)
        SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY entry) - 1 AS INTEGER) AS section_index, area, library,
               sha256(concat_ws(chr(10), 'Area: ' || area, 'Library: ' || library, body)) AS text FROM g WHERE library IS NOT NULL""",
    "record_texts": r"""
        WITH r AS (SELECT DISTINCT * FROM knowledge_documents)
        SELECT md5(concat_ws(chr(10), """ + ", ".join(
        rf"'{c}: ' || nullif(regexp_replace({c}, '^\s+|\s+$', '', 'g'), '')" for c in ("source_title", "file_type", "language", "category")
    ) + ")) AS record, count(*) AS n_rows FROM r GROUP BY 1",
}
for _name in ("heading_sections", "marked_sections", "announcement_entries", "announcement_listing", "paragraphs", "news_clean"):
    ORACLES[_name] = f"SELECT * REPLACE (sha256(text) AS text) FROM ({ORACLES[_name]})"

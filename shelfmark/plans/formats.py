"""Queries of the readers, over files of each format that are made of the given tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import text as T
from shelfmark.sources import readers as R
from shelfmark.sources.tables import table


def _marked(col: Column) -> Column:
    """A text fit to stand between tags: without characters that have no place there."""
    plain = F.regexp_replace(col, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]", "")
    return F.replace(F.replace(F.replace(plain, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def html_sections(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as pages: lines with a mark are headings, others paragraphs, between a menu and a footer."""
    docs = table(spark, folder, "documents").where("text is not null")
    line = lambda x: F.when(F.startswith(x, F.lit("#")), F.concat(F.lit("<h2>"), x, F.lit("</h2>"))).otherwise(F.concat(F.lit("<p>"), x, F.lit("</p>")))
    body = F.array_join(F.transform(F.split(_marked(F.col("text")), "\n"), line), "\n")
    pages = docs.select(F.col("doc_id").cast("string").alias("path"), F.concat(F.lit("<html><body><nav><p>Menu</p></nav>"), body, F.lit("<footer><p>End</p></footer></body></html>")).alias("text"))
    found = R.html_sections(pages)
    squeeze = lambda c: F.regexp_replace(c, r"[\s\x{85}\p{Z}\x{1C}-\x{1F}]+", "")
    return found.select(F.col("path").cast("bigint").alias("doc_id"), "section_index", F.md5(squeeze(F.col("heading"))).alias("heading"), F.md5(squeeze(F.col("text"))).alias("text"))


def json_sections(spark: SparkSession, folder: str) -> DataFrame:
    """Labels as one JSON object each."""
    rows = table(spark, folder, "evaluation_dataset").select("id", "domain", "query").distinct()
    files = rows.select(F.col("id").cast("string").alias("path"), F.to_json(F.struct("id", "domain", "query")).alias("text"))
    return R.json_sections(files).select("path", "section_index", F.md5("text").alias("text"))


def csv_sections(spark: SparkSession, folder: str) -> DataFrame:
    """The labels of a domain as one CSV file each, in order of id."""
    rows = table(spark, folder, "evaluation_dataset").where("domain is not null").select("id", "domain", "query").distinct()
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.struct("id", F.coalesce("query", F.lit("")).alias("q"), F.concat_ws(",", F.col("id").cast("string"), quoted(F.col("query"))).alias("line"))
    files = rows.groupBy(F.col("domain").alias("path")).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    files = files.select("path", F.concat(F.lit("id,query\n"), F.array_join("lines.line", "\n")).alias("text"))
    return R.csv_sections(files).select("path", "section_index", F.md5("text").alias("text"))


def xml_sections(spark: SparkSession, folder: str) -> DataFrame:
    """Registry rows as one XML document each, a child a column."""
    rows = table(spark, folder, "knowledge_documents").select("document_id", "version", "file_type", "category", "language").distinct()
    child = lambda c: F.concat(F.lit(f"<{c}>"), _marked(F.coalesce(c, F.lit(""))), F.lit(f"</{c}>"))
    body = F.concat(*[child(c) for c in ("file_type", "category", "language")])
    key = F.concat_ws("/", "document_id", "version", *[F.coalesce(c, F.lit("-")) for c in ("file_type", "category", "language")])
    files = rows.select(key.alias("path"), F.concat(F.lit("<r xmlns='urn:x'>"), body, F.lit("</r>")).alias("text"))
    return R.xml_sections(files)


def main_content(spark: SparkSession, folder: str) -> DataFrame:
    """`path, n_chars, low_content` of pages of the given chunks: their text without menu and footer, and whether it is too short to keep."""
    rows = table(spark, folder, "data_hkpl_knowledge").where("text is not null").select("node_id", "text").distinct()
    page = F.concat(F.lit("<html><nav><p>Menu</p></nav><p>"), _marked(F.regexp_replace("text", r"[^A-Za-z0-9 .,]+", " ")), F.lit("</p><footer><p>End</p></footer></html>"))
    found = R.html_sections(rows.select(F.md5(F.concat("node_id", "text")).alias("path"), page.alias("text")))
    return found.groupBy("path").agg(F.sum(F.length("text")).alias("n_chars")).withColumn("low_content", F.col("n_chars") < 200)


def normal_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Texts in compatibility form, normalised."""
    return table(spark, folder, "documents").select("doc_id", F.sha2(T.normalize_document(F.col("text")), 256).alias("text"))


QUERIES = {f.__name__: f for f in (html_sections, json_sections, csv_sections, xml_sections, main_content, normal_texts)}

_SQUEEZE = r"[\s\x{85}\p{Z}\x{1C}-\x{1F}]+"
ORACLES = {
    "html_sections": rf"""
        WITH l AS (SELECT doc_id, generate_subscripts(p, 1) AS pos, unnest(p) AS line FROM (
                SELECT doc_id, string_split(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x{{FFFE}}\x{{FFFF}}]', '', 'g'), chr(10)) AS p FROM documents WHERE text IS NOT NULL)),
        s AS (SELECT doc_id, pos, starts_with(line, '#') AS head, regexp_replace(line, '{_SQUEEZE}', '', 'g') AS line FROM l),
        k AS (SELECT *, CAST(sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS INTEGER) AS section_index FROM s WHERE line <> '')
        SELECT doc_id, section_index, md5(max(line) FILTER (head)) AS heading, md5(string_agg(line, '' ORDER BY pos) FILTER (NOT head)) AS text
        FROM k GROUP BY 1, 2 HAVING count(*) FILTER (NOT head) > 0""",
    "json_sections": """
        SELECT CAST(id AS VARCHAR) AS path, 0 AS section_index, md5(concat_ws(chr(10), 'id: ' || id, 'domain: ' || domain, 'query: ' || query)) AS text
        FROM (SELECT DISTINCT id, domain, query FROM evaluation_dataset)""",
    "csv_sections": r"""
        WITH r AS (SELECT DISTINCT id, domain, query FROM evaluation_dataset WHERE domain IS NOT NULL),
        n AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY id, coalesce(query, '')) + 1 AS no FROM r)
        SELECT domain AS path, CAST(no AS INTEGER) AS section_index,
               md5(concat_ws(chr(10), 'id: ' || id, 'query: ' || nullif(regexp_replace(query, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), ''))) AS text FROM n""",
    "xml_sections": r"""
        WITH r AS (SELECT DISTINCT document_id, version, file_type, category, language FROM knowledge_documents),
        c AS (SELECT concat_ws('/', document_id, version, coalesce(file_type, '-'), coalesce(category, '-'), coalesce(language, '-')) AS path, unnest([0, 1, 2]) AS i,
                     unnest(['file_type', 'category', 'language']) AS heading, unnest([file_type, category, language]) AS v FROM r),
        k AS (SELECT *, regexp_replace(v, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS text FROM c)
        SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY i) - 1 AS INTEGER) AS section_index, heading, text FROM k WHERE text <> ''""",
    "main_content": r"""
        WITH r AS (SELECT DISTINCT node_id, text FROM data_hkpl_knowledge WHERE text IS NOT NULL),
        t AS (SELECT md5(node_id || text) AS path, trim(regexp_replace(regexp_replace(text, '[^A-Za-z0-9 .,]+', ' ', 'g'), ' +', ' ', 'g'), ' ') AS x FROM r)
        SELECT path, CAST(length(x) AS BIGINT) AS n_chars, length(x) < 200 AS low_content FROM t WHERE x <> ''""",
}

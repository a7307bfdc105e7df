"""Queries on evaluation results and projections, and the same in SQL.

The judges aren't available; lengths and overlaps of the given texts stand in for their scores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.text import label_form
from shelfmark.operators import evaluation as E
from shelfmark.operators import labels as L
from shelfmark.operators import retrieval as R
from shelfmark.operators.registry import current_documents, key_of
from shelfmark.plans import retrieval as PR
from shelfmark.plans.corpora import ORACLES as CORPORA
from shelfmark.plans.retrieval import _METRICS_SQL, _top_sql
from shelfmark.plans.sessions import _RANKED, ranked_chunks
from shelfmark.sources.tables import table

CUTOFF = 3


def _labels(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "evaluation_dataset").select(F.col("id").alias("query_id"), F.col("expected_context_snippet").alias("snippet"))
    return rows.groupBy("query_id").agg(F.min("snippet").alias("snippet"))


def evidence_at_k(spark: SparkSession, folder: str) -> DataFrame:
    ranked = ranked_chunks(spark, folder).select("query_id", "rank", F.col("node_id").alias("chunk_id"), "text")
    return E.evidence_at_k(_labels(spark, folder), ranked, CUTOFF)


def _results(spark: SparkSession, folder: str) -> DataFrame:
    """Stand-ins for judged results: labels that have an answer."""
    rows = table(spark, folder, "evaluation_dataset").where(F.length("expected_answer_text") > 0).groupBy(F.col("id").alias("query_id")).agg(
        F.min("expected_answer_text").alias("answer"), F.min("query").alias("query"), F.min("expected_context_snippet").alias("snippet")
    )
    n = F.length("answer")
    return rows.select(
        "query_id", (n % 6).cast("double").alias("correctness"), ((n % 11) / 10).alias("faithfulness"), (F.length(F.coalesce("query", F.lit(""))) % 5 / 4).alias("relevancy")
    )


def results_with_failures(spark: SparkSession, folder: str) -> DataFrame:
    rows = E.with_failed_rows(table(spark, folder, "evaluation_dataset").select(F.col("id").alias("query_id")), _results(spark, folder))
    return rows.select("query_id", "correctness", *[F.round(c, 6).alias(c) for c in ("faithfulness", "relevancy", "hallucination")], "failed")


def judged_summary(spark: SparkSession, folder: str) -> DataFrame:
    found = E.judged_summary(results_with_failures(spark, folder))
    return found.select("n_questions", "n_judged", *[F.round(c, 6).alias(c) for c in found.columns[2:]])


def _diagnosed(spark: SparkSession, folder: str) -> DataFrame:
    rows = results_with_failures(spark, folder)
    modes = L.evidence_hits(table(spark, folder, "evaluation_dataset"), table(spark, folder, "data_hkpl_knowledge")).withColumnRenamed("id", "query_id")
    hits = evidence_at_k(spark, folder).select("query_id", F.col("hit") > 0)
    rows = rows.join(modes, "query_id").join(hits.toDF("query_id", "hit"), "query_id")
    reranked = E.match_mode(F.lit(False), F.col("hit") | (F.col("match_mode") == "exact_chunk"))
    found = E.diagnosis(F.col("match_mode"), reranked, F.col("match_mode"), F.col("correctness"), F.col("faithfulness"), F.col("relevancy"), F.col("failed"))
    return rows.select("query_id", found.alias("diagnosis"))


def diagnosis(spark: SparkSession, folder: str) -> DataFrame:
    return _diagnosed(spark, folder)


def diagnosis_rates(spark: SparkSession, folder: str) -> DataFrame:
    return E.diagnosis_rates(_diagnosed(spark, folder)).withColumn("rate", F.round("rate", 6))


def distractor_counts(spark: SparkSession, folder: str) -> DataFrame:
    ranked = PR._labelled(spark, folder, PR._topk(spark, folder))
    found = E.merged_distractors(ranked, F.col("label") > PR.PRIMARY, F.concat(F.lit("Set-"), "label"), R.CUTOFFS)
    return found.withColumn("per_query", F.round("per_query", 6))


def metrics_long(spark: SparkSession, folder: str) -> DataFrame:
    metrics = PR.retrieval_metrics_at_k(spark, folder)
    return E.long_form(metrics, [c for c in metrics.columns if c != "query_id"])


def missing_items(spark: SparkSession, folder: str) -> DataFrame:
    """What the search doesn't bring of the five nearest of a query's label."""
    vectors = table(spark, folder, "embeddings")
    expected = R.nearest_alike(vectors.where("vec_id % 20 = 0"), vectors, 5).select("query_id", F.col("vec_id").alias("item_id"))
    ranked = PR._topk(spark, folder).select("query_id", "rank", F.col("vec_id").alias("item_id"))
    return E.missing_items(expected, ranked, R.TOP_K).withColumn("missing", F.array_join("missing", ","))


def trace_rows(spark: SparkSession, folder: str) -> DataFrame:
    return E.trace_rows(table(spark, folder, "data_hkpl_knowledge")).withColumn("preview", F.md5("preview"))


def base_metadata(spark: SparkSession, folder: str) -> DataFrame:
    return E.base_metadata(table(spark, folder, "knowledge_documents")).select("document_id", "source_title", "file_type", "source_url", "error_message")


def post_filter(spark: SparkSession, folder: str) -> DataFrame:
    """The search without vectors of label 0, cut to five again."""
    ranked = PR._labelled(spark, folder, PR._topk(spark, folder))
    return E.kept_after_filter(ranked, F.col("label") != 0, 5).select("query_id", "rank", "vec_id", "n_filtered")


def assembled_context(spark: SparkSession, folder: str) -> DataFrame:
    ranked = ranked_chunks(spark, folder).where("text is not null and rank <= 5").groupBy("query_id", "node_id").agg(F.min("rank").alias("place"), F.min("text").alias("text"))
    ranked = ranked.select("query_id", F.struct("place", "node_id").alias("rank"), "text")
    return E.assembled_context(ranked, F.col("text")).withColumn("context", F.md5("context"))


def confidence_gate(spark: SparkSession, folder: str) -> DataFrame:
    found = E.confident(PR._topk(spark, folder).where("vec_id != query_id"), 0.5)
    return found.withColumn("best", F.round("best", 4))


def zipped_arrays(spark: SparkSession, folder: str) -> DataFrame:
    """The words of a label's question beside those of its answer."""
    rows = table(spark, folder, "evaluation_dataset").select("id", F.split("query", " ").alias("q"), F.split("expected_answer_text", " ").alias("a")).distinct()
    return E.zipped(rows, "q", "a").groupBy("id").agg(F.count("*").alias("n_pairs"), F.count_if(F.col("q") == F.col("a")).alias("n_equal"))


def document_or_url(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "evaluation_dataset").select("id", key_of(F.col("source_document_id")).alias("source_document_id"), F.trim("source_url").alias("source_url")).distinct()
    documents = current_documents(table(spark, folder, "knowledge_documents"), "source_url").withColumn("source_url", F.trim("source_url"))
    return E.document_or_url(labels, documents)


def questions_with(spark: SparkSession, folder: str) -> DataFrame:
    """Labels by their question: it contains a word, or is the commonest one, both without case and outer spaces."""
    form = F.lower(F.trim("query"))
    rows = table(spark, folder, "evaluation_dataset").where("query is not null").select("id", form.alias("q")).distinct()
    most = rows.groupBy("q").agg(F.count("*").alias("n")).agg(F.max_by("q", F.struct("n", "q")).alias("most"))
    rows = rows.crossJoin(F.broadcast(most))  # one row
    return rows.select("id", F.contains("q", F.lit("library")).alias("has_word"), (F.col("q") == F.col("most")).alias("is_commonest"))


def label_page(spark: SparkSession, folder: str) -> DataFrame:
    """The third page of a hundred labels, by id: a page is the feature."""
    rows = table(spark, folder, "evaluation_dataset").select("id", F.md5(label_form(F.col("query"))).alias("query")).distinct()
    return rows.orderBy("id", "query").offset(200).limit(100)


QUERIES = {
    f.__name__: f
    for f in (
        evidence_at_k, results_with_failures, judged_summary, diagnosis, diagnosis_rates, distractor_counts, metrics_long, missing_items, trace_rows, base_metadata,
        post_filter, assembled_context, confidence_gate, zipped_arrays, document_or_url, questions_with, label_page,
    )
}

_FORM = lambda c: f"""regexp_replace(regexp_replace(regexp_replace(lower({c}), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g'), '["''“”‘’]', '', 'g')"""
_KEY = lambda c: f"nullif(lower(regexp_replace({c}, '^\\s+|\\s+$', '', 'g')), '')"
_META = lambda k: f"nullif(json_extract_string(metadata_, '$.{k}'), '')"
_EVIDENCE = f"""
    WITH l AS (SELECT id AS query_id, min({_FORM('expected_context_snippet')}) AS f FROM (SELECT id, min(expected_context_snippet) AS expected_context_snippet FROM evaluation_dataset GROUP BY 1) GROUP BY 1),
    r AS (SELECT query_id, rank, node_id, {_FORM('text')} AS form FROM {_RANKED} WHERE rank <= 3),
    j AS (SELECT l.query_id, rank, node_id, coalesce(length(f) > 0 AND contains(form, f), false) AS hit FROM l LEFT JOIN r USING (query_id))
    SELECT query_id, CAST(bool_or(hit) AS DOUBLE) AS hit, coalesce(list_transform(list_sort(list(DISTINCT (rank, node_id)) FILTER (hit)), lambda x: x[2]), []) AS matched_ids FROM j GROUP BY 1"""
_FAILED = """
    WITH r AS (SELECT id AS query_id, length(min(expected_answer_text)) AS n, length(coalesce(min(query), '')) AS m FROM evaluation_dataset WHERE length(expected_answer_text) > 0 GROUP BY 1),
    s AS (SELECT DISTINCT e.id AS query_id, n IS NULL AS failed, n, m FROM evaluation_dataset e LEFT JOIN r ON r.query_id = e.id)
    SELECT query_id, CAST(coalesce(n % 6, 0) AS DOUBLE) AS correctness, round(coalesce(n % 11 / 10, 0.0), 6) AS faithfulness, round(coalesce(m % 5 / 4, 0.0), 6) AS relevancy,
           round(CASE WHEN failed THEN 1.0 ELSE 1 - coalesce(n % 11 / 10, 0.0) END, 6) AS hallucination, failed FROM s"""
_DIAGNOSIS = f"""
    SELECT r.query_id, CASE WHEN failed THEN 'evaluation_failed' WHEN m.match_mode = 'missing' THEN 'retrieval_problem'
        WHEN NOT (e.hit > 0 OR m.match_mode = 'exact_chunk') THEN 'reranker_problem' WHEN correctness < 3 THEN 'llm_generation_problem'
        WHEN correctness >= 4 AND (faithfulness < 0.5 OR relevancy < 0.5) THEN 'evaluator_or_dataset_issue' ELSE 'working_correctly' END AS diagnosis
    FROM ({_FAILED}) r JOIN ({CORPORA["evidence_hits"]}) m ON m.id = r.query_id JOIN ({_EVIDENCE}) e ON e.query_id = r.query_id"""
_MEANS = ", ".join(f"round(avg({c}) FILTER (NOT failed), 6) AS avg_{c}" for c in ("correctness", "faithfulness", "relevancy", "hallucination"))
_NAMES = [f"{m}_{k}" for k in R.CUTOFFS for m in ("hit", "recall", "complete")] + ["reciprocal_rank"]
_LATEST = f"""(SELECT * FROM (SELECT *, {_KEY('document_id')} AS k, row_number() OVER (PARTITION BY {_KEY('document_id')} ORDER BY updated_at DESC NULLS LAST, version DESC, status DESC, source_url DESC) AS r
    FROM knowledge_documents WHERE {_KEY('document_id')} IS NOT NULL) WHERE r = 1)"""
ORACLES = {
    "evidence_at_k": _EVIDENCE,
    "results_with_failures": _FAILED,
    "judged_summary": f"SELECT count(*) AS n_questions, count(*) FILTER (NOT failed) AS n_judged, {_MEANS} FROM ({_FAILED})",
    "diagnosis": _DIAGNOSIS,
    "diagnosis_rates": f"SELECT diagnosis, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS rate FROM ({_DIAGNOSIS}) GROUP BY 1",
    "distractor_counts": f"""
        SELECT k, 'set-' || label AS dataset, count(*) AS n, round(count(*) / (SELECT count(DISTINCT query_id) FROM ({_top_sql()})), 6) AS per_query
        FROM ({_top_sql()}), (VALUES (1), (3), (5)) AS ks(k) WHERE rank <= k AND label > 6 GROUP BY 1, 2""",
    "metrics_long": " UNION ALL ".join(f"SELECT query_id, '{n}' AS name, CAST({n} AS DOUBLE) AS score FROM m" for n in _NAMES).join((f"WITH m AS ({_METRICS_SQL}) ", "")),
    "missing_items": f"""
        WITH e AS (SELECT query_id, vec_id FROM (
            SELECT q.vec_id AS query_id, c.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) DESC, c.vec_id) AS r
            FROM embeddings q JOIN embeddings c ON c.label = q.label AND c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0 AND q.embedding IS NOT NULL AND c.embedding IS NOT NULL) WHERE r <= 5),
        t AS ({_top_sql()})
        SELECT query_id, string_agg(CAST(vec_id AS VARCHAR), ',' ORDER BY vec_id) AS missing FROM e WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.query_id = e.query_id AND t.vec_id = e.vec_id) GROUP BY 1""",
    "trace_rows": f"""
        SELECT node_id, coalesce({_META('kb_document_id')}, {_META('document_id')}, nullif(split_part(node_id, ':', 1), ''), '') AS document_id,
               coalesce({_META('source_title')}, {_META('title')}, {_META('original_file_name')}, '') AS title, coalesce({_META('source_url')}, {_META('url')}, '') AS url,
               md5(left(coalesce(text, ''), 700)) AS preview FROM data_hkpl_knowledge""",
    "base_metadata": r"""
        SELECT document_id, coalesce(nullif(source_title, ''), nullif(regexp_replace(original_file_name, '\.[^.]+$', ''), ''), '') AS source_title,
               coalesce(file_type, '') AS file_type, coalesce(source_url, '') AS source_url, coalesce(error_message, '') AS error_message FROM knowledge_documents""",
    "post_filter": f"""
        WITH t AS (SELECT *, count(*) FILTER (label = 0) OVER (PARTITION BY query_id) AS n_filtered FROM ({_top_sql()})),
        k AS (SELECT query_id, vec_id, n_filtered, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INTEGER) AS rank FROM t WHERE label <> 0)
        SELECT * FROM k WHERE rank <= 5""",
    "assembled_context": f"""
        WITH r AS (SELECT query_id, node_id, min(rank) AS place, min(text) AS text FROM {_RANKED} WHERE text IS NOT NULL AND rank <= 5 GROUP BY 1, 2),
        n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place, node_id) AS no FROM r)
        SELECT query_id, md5(string_agg('[Source ' || no || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY no)) AS context FROM n GROUP BY 1""",
    "confidence_gate": f"SELECT query_id, round(max(score), 4) AS best, max(score) >= 0.5 AS confident FROM ({_top_sql()}) WHERE vec_id <> query_id GROUP BY 1",
    "zipped_arrays": """
        WITH r AS (SELECT DISTINCT id, string_split(query, ' ') AS q, string_split(expected_answer_text, ' ') AS a FROM evaluation_dataset),
        z AS (SELECT id, q, a, unnest(range(1, least(len(q), len(a)) + 1)) AS i FROM r WHERE q IS NOT NULL AND a IS NOT NULL)
        SELECT id, count(*) AS n_pairs, count(*) FILTER (q[i] = a[i]) AS n_equal FROM z GROUP BY 1""",
    "document_or_url": f"""
        WITH l AS (SELECT DISTINCT id, {_KEY('source_document_id')} AS d, trim(source_url, ' ') AS u FROM evaluation_dataset)
        SELECT id, k AS document_id FROM l JOIN {_LATEST} x ON x.k = l.d UNION SELECT id, k FROM l JOIN {_LATEST} x ON trim(x.source_url, ' ') = l.u WHERE l.u <> ''""",
    "questions_with": """
        WITH r AS (SELECT DISTINCT id, lower(trim(query, ' ')) AS q FROM evaluation_dataset WHERE query IS NOT NULL),
        m AS (SELECT q AS most FROM r GROUP BY q ORDER BY count(*) DESC, q DESC LIMIT 1)
        SELECT id, contains(q, 'library') AS has_word, q = most AS is_commonest FROM r, m""",
    "label_page": f"SELECT DISTINCT id, md5({_FORM('query')}) AS query FROM evaluation_dataset ORDER BY id, query NULLS FIRST LIMIT 100 OFFSET 200",
}

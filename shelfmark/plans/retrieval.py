"""Queries on vectors: every row whose id is divisible by 20 searches all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators import retrieval as R
from shelfmark.sources.tables import table

#: Labels up to this one are the primary corpus, those above it distractors.
PRIMARY = 6


def _topk(spark: SparkSession, folder: str, primary: bool = False, k: int = R.TOP_K) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    corpus = vectors.where(F.col("label") <= PRIMARY) if primary else vectors
    return R.vector_topk(vectors.where("vec_id % 20 = 0"), corpus, k)


def _labelled(spark: SparkSession, folder: str, ranked: DataFrame) -> DataFrame:
    labels = table(spark, folder, "embeddings").select("vec_id", "label")
    own = labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_label"))
    return ranked.join(labels, "vec_id").join(own, "query_id")


def vector_topk(spark: SparkSession, folder: str) -> DataFrame:
    return _topk(spark, folder).withColumn("score", F.round("score", 4))


def vector_topk_primary(spark: SparkSession, folder: str) -> DataFrame:
    return _topk(spark, folder, primary=True).withColumn("score", F.round("score", 4))


def rerank_topn(spark: SparkSession, folder: str) -> DataFrame:
    """The second score is the cosine with a bonus for the query's own label."""
    ranked = _labelled(spark, folder, _topk(spark, folder))
    score = F.round("score", 6) + F.when(F.col("label") == F.col("query_label"), 0.1).otherwise(0.0)
    best = R.reranked(ranked, score)
    return best.select("query_id", "new_rank", "vec_id", F.col("rank").alias("old_rank"))


def retrieval_metrics_at_k(spark: SparkSession, folder: str) -> DataFrame:
    """The three nearest other vectors of the query's label are expected, wherever they stand among all
    vectors; a query whose label has no other vector expects nothing and scores 0."""
    ranked = _labelled(spark, folder, _topk(spark, folder).where("vec_id != query_id"))
    vectors = table(spark, folder, "embeddings")
    queries = vectors.where("vec_id % 20 = 0")
    expected = R.nearest_alike(queries, vectors, 3).select("query_id", F.col("vec_id").alias("item_id"))
    searched = queries.where("embedding is not null").select(F.col("vec_id").alias("query_id"))
    expected = searched.join(expected, "query_id", "left")
    metrics = R.metrics_at_k(expected, ranked.select("query_id", "rank", F.col("vec_id").alias("item_id")))
    return metrics.select(*[F.round(c, 6).alias(c) if c.startswith("rec") else F.col(c) for c in metrics.columns])


def evaluation_summary(spark: SparkSession, folder: str) -> DataFrame:
    metrics = retrieval_metrics_at_k(spark, folder)
    names = [c for c in metrics.columns if c != "query_id"]
    return metrics.agg(F.count("*").alias("n_queries"), *[F.round(F.avg(c), 4).alias(f"avg_{c}") for c in names])


def distractor_rate_at_k(spark: SparkSession, folder: str) -> DataFrame:
    ranked = _labelled(spark, folder, _topk(spark, folder))
    rates = R.distractor_rates(ranked, F.col("label") > PRIMARY)
    return rates.withColumn("rate", F.round("rate", 4))


QUERIES = {
    f.__name__: f
    for f in (vector_topk, vector_topk_primary, rerank_topn, retrieval_metrics_at_k, evaluation_summary, distractor_rate_at_k)
}


def _top_sql(k: int = 10, where: str = "true") -> str:
    return f"""
    SELECT query_id, rank, vec_id, score, label, query_label FROM (
        SELECT q.vec_id AS query_id, c.vec_id, c.label, q.label AS query_label,
               list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS score,
               CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) DESC, c.vec_id) AS INTEGER) AS rank
        FROM embeddings q, embeddings c WHERE q.vec_id % 20 = 0 AND {where}) WHERE rank <= {k}"""


_METRICS_SQL = f"""
    WITH top AS ({_top_sql()}),
    expected AS (
        SELECT query_id, vec_id FROM (
            SELECT q.vec_id AS query_id, c.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) DESC, c.vec_id) AS r
            FROM embeddings q JOIN embeddings c ON c.label = q.label AND c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0 AND q.embedding IS NOT NULL AND c.embedding IS NOT NULL) WHERE r <= 3),
    found AS (SELECT q.vec_id AS query_id, e.vec_id, t.rank FROM embeddings q LEFT JOIN expected e ON e.query_id = q.vec_id LEFT JOIN (SELECT * FROM top WHERE vec_id <> query_id) t
              ON t.query_id = e.query_id AND t.vec_id = e.vec_id WHERE q.vec_id % 20 = 0 AND q.embedding IS NOT NULL)
    SELECT query_id, {", ".join(f'''CAST(count(*) FILTER (rank <= {k}) > 0 AS INTEGER) AS hit_{k},
           round(coalesce(count(*) FILTER (rank <= {k}) / nullif(count(vec_id), 0), 0.0), 6) AS recall_{k},
           CAST(count(*) FILTER (rank <= {k}) = count(vec_id) AND count(vec_id) > 0 AS INTEGER) AS complete_{k}''' for k in (1, 3, 5))},
           round(coalesce(1.0::DOUBLE / min(rank), 0.0), 6) AS reciprocal_rank
    FROM found GROUP BY query_id"""
_NAMES = [f"{m}_{k}" for k in (1, 3, 5) for m in ("hit", "recall", "complete")] + ["reciprocal_rank"]
ORACLES = {
    "vector_topk": f"SELECT query_id, rank, vec_id, round(score, 4) AS score FROM ({_top_sql()})",
    "vector_topk_primary": f"SELECT query_id, rank, vec_id, round(score, 4) AS score FROM ({_top_sql(where='c.label <= 6')})",
    "rerank_topn": f"""
        SELECT query_id, new_rank, vec_id, old_rank FROM (
            SELECT query_id, vec_id, rank AS old_rank, CAST(row_number() OVER (PARTITION BY query_id
                   ORDER BY round(score, 6) + CASE WHEN label = query_label THEN 0.1::DOUBLE ELSE 0 END DESC, rank) AS INTEGER) AS new_rank
            FROM ({_top_sql()})) WHERE new_rank <= 5""",
    "retrieval_metrics_at_k": _METRICS_SQL,
    "evaluation_summary": f"SELECT count(*) AS n_queries, {', '.join(f'round(avg({n}), 4) AS avg_{n}' for n in _NAMES)} FROM ({_METRICS_SQL})",
    "distractor_rate_at_k": f"""
        SELECT query_id, k, count(*) FILTER (label > 6) AS n_distractors, round(count(*) FILTER (label > 6) / count(*), 4) AS rate
        FROM ({_top_sql()}), (VALUES (1), (3), (5)) AS ks(k) WHERE rank <= k GROUP BY query_id, k""",
}

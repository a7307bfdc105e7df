"""Exact filtered vector search for a batch of queries, reranking, and retrieval metrics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TOP_K, TOP_N, CUTOFFS = 10, 5, (1, 3, 5)
#: Queries that are compared with the corpus in one pass over it; with 1,024 dimensions they take 64 MB of a task.
QUERY_ROUND = 8192


def _best(query: np.ndarray, score: np.ndarray, item: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best (query, score, item) of each query; ties go to the smaller item."""
    order = np.lexsort((item, -score, query))
    query, score, item = query[order], score[order], item[order]
    first = np.searchsorted(query, query, "left")
    kept = np.arange(len(query)) - first < k
    return query[kept], score[kept], item[kept]


def vector_topk(
    queries: DataFrame, corpus: DataFrame, k: int = TOP_K, id_col: str = "vec_id", vec_col: str = "embedding", alike: str | None = None, query_round: int = QUERY_ROUND
) -> DataFrame:
    """`query_id, rank, vec_id, score`: the `k` nearest corpus vectors of each query by cosine.

    Ties go to the smaller id; rank starts at 1; null vectors take no part and a zero vector has
    score 0. With `alike`, only vectors with the query's value in that column count. The corpus is
    read once for each round of at most about `query_round` queries, which every task gets whole;
    a task multiplies them with its rows batch by batch and keeps k rows a query, and only those
    are shuffled and ranked again. The corpus itself is never shuffled.
    """
    spark = queries.sparkSession
    present = F.col(vec_col).isNotNull() & F.col(id_col).isNotNull()
    group = F.xxhash64(alike) if alike else F.lit(0).cast("bigint")
    told = lambda rows: rows.where(present & (F.col(alike).isNotNull() if alike else F.lit(True))).select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("v"), group.alias("g"))
    wanted, rows = told(queries), told(corpus)
    rounds = max(1, -(-wanted.count() // query_round))

    def searcher(found: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q, groups = found.value
            norms = np.linalg.norm(q, axis=1)
            best = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
            for batch in batches:
                if not batch.num_rows:
                    continue
                items, of = batch.column(0).to_numpy(), batch.column(2).to_numpy()
                c = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
                scale = norms[:, None] * np.linalg.norm(c, axis=1)[None, :]
                scores = np.divide(q @ c.T, scale, out=np.zeros_like(scale), where=scale > 0)
                if alike:
                    scores[groups[:, None] != of[None, :]] = -np.inf
                least = np.partition(scores, len(items) - k, axis=1)[:, len(items) - k] if len(items) > k else np.full(len(ids), -2.0)
                # Equal vectors must tie whatever batch they are multiplied in.
                at, which = np.nonzero(scores >= np.maximum(least, -2.0)[:, None] - 1e-12)
                best = _best(*(np.concatenate(x) for x in zip(best, (at, scores[at, which].round(12), items[which]))), k)
            yield pa.RecordBatch.from_arrays([pa.array(ids[best[0]]), pa.array(best[2]), pa.array(best[1])], names=["query_id", "vec_id", "score"])

        return run

    out = None
    for r in range(rounds):
        mine = wanted.where(F.pmod(F.xxhash64("id"), F.lit(rounds)) == r).toArrow()  # about query_round rows
        if not mine.num_rows:
            continue
        vectors = np.array(mine.column("v").to_pylist(), dtype=np.float64)
        block = spark.sparkContext.broadcast((mine.column("id").to_numpy(), vectors, mine.column("g").to_numpy()))
        part = rows.mapInArrow(searcher(block), "query_id bigint, vec_id bigint, score double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_alike(queries: DataFrame, corpus: DataFrame, k: int, label_col: str = "label", id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """`query_id, rank, vec_id, score`: the `k` nearest other vectors of each query's own label, among all of
    that label; a query without any has no rows."""
    found = vector_topk(queries, corpus, k + 1, id_col, vec_col, alike=label_col)
    order = W.partitionBy("query_id").orderBy("rank")
    others = found.where(F.col("vec_id") != F.col("query_id")).withColumn("rank", F.row_number().over(order))
    return others.where(F.col("rank") <= k)


def reranked(candidates: DataFrame, score: Column, n: int = TOP_N) -> DataFrame:
    """The best `n` of each query by `score`; null scores come last, in the order they had."""
    order = W.partitionBy("query_id").orderBy(score.desc_nulls_last(), "rank")
    return candidates.withColumn("new_rank", F.row_number().over(order)).where(F.col("new_rank") <= n)


def metrics_at_k(expected: DataFrame, ranked: DataFrame, cutoffs: tuple[int, ...] = CUTOFFS) -> DataFrame:
    """`query_id`, hit, recall and complete at each cutoff, and `reciprocal_rank`.

    `expected(query_id, item_id)` and `ranked(query_id, rank, item_id)`; queries without results
    score 0, and a query expecting nothing hits nothing and is not complete.
    """
    found = expected.distinct().join(ranked.groupBy("query_id", "item_id").agg(F.min("rank").alias("rank")), ["query_id", "item_id"], "left")
    n = F.count("item_id")
    measures = []
    for k in cutoffs:
        hits = F.count_if(F.col("rank") <= k)
        measures += [
            (hits > 0).cast("int").alias(f"hit_{k}"), F.coalesce(F.try_divide(hits, n), F.lit(0.0)).alias(f"recall_{k}"),
            ((hits == n) & (n > 0)).cast("int").alias(f"complete_{k}"),
        ]
    return found.groupBy("query_id").agg(*measures, F.coalesce(F.lit(1.0) / F.min("rank"), F.lit(0.0)).alias("reciprocal_rank"))


def distractor_rates(ranked: DataFrame, is_distractor: Column, cutoffs: tuple[int, ...] = CUTOFFS) -> DataFrame:
    """`query_id, k, n_distractors, rate` over the ranks up to each cutoff; the rate's base is what was found."""
    ks = ranked.withColumn("k", F.explode(F.array(*[F.lit(k) for k in cutoffs]))).where(F.col("rank") <= F.col("k"))
    n = F.count_if(is_distractor)
    return ks.groupBy("query_id", "k").agg(n.alias("n_distractors"), (n / F.count("*")).alias("rate"))

"""Results of an evaluation run: evidence, diagnosis, summary, long form; projections for answers and traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmark.functions.text import clamped_share, label_form, present

#: Characters of a preview.
PREVIEW = 700
METRICS = ("correctness", "faithfulness", "relevancy")


def evidence_at_k(labels: DataFrame, ranked: DataFrame, k: int) -> DataFrame:
    """`query_id, hit, matched_ids` for `labels(query_id, snippet)` and `ranked(query_id, rank, chunk_id, text)`.

    A result up to rank `k` matches if it holds the snippet but for case, spaces and quotes; the ids are in
    order of rank. A blank snippet matches nothing; a label without results has no hit.
    """
    # Both sides are normalised once, before they meet.
    wanted = labels.select("query_id", label_form(F.col("snippet")).alias("snippet"))
    found = ranked.where(F.col("rank") <= k).select("query_id", "rank", "chunk_id", label_form(F.col("text")).alias("form"))
    joined = wanted.join(found, "query_id", "left")
    hit = F.coalesce((F.length("snippet") > 0) & F.contains("form", "snippet"), F.lit(False))
    ids = F.array_sort(F.collect_set(F.when(hit, F.struct("rank", F.coalesce("chunk_id", F.lit("")).alias("id")))))
    out = joined.groupBy("query_id").agg(F.bool_or(hit).cast("double").alias("hit"), F.transform(ids, lambda x: x["id"]).alias("matched_ids"))
    return out


def match_mode(exact: Column, evidence: Column) -> Column:
    return F.when(exact, "exact_chunk").when(evidence, "equivalent_evidence").otherwise("missing")


def diagnosis(retrieval: Column, reranker: Column, context: Column, correctness: Column, faithfulness: Column, relevancy: Column, failed: Column | None = None) -> Column:
    """The first stage at which evidence or answer went wrong."""
    found = F.when(retrieval == "missing", "retrieval_problem").when(reranker == "missing", "reranker_problem").when(context == "missing", "context_building_problem")
    found = found.when(correctness < 3, "llm_generation_problem")
    found = found.when((correctness >= 4) & ((faithfulness < 0.5) | (relevancy < 0.5)), "evaluator_or_dataset_issue").otherwise("working_correctly")
    return found if failed is None else F.when(failed, "evaluation_failed").otherwise(found)


def hallucination(faithfulness: Column, failed: Column) -> Column:
    """What isn't faithful, between 0 and 1; a judgement that failed counts as none."""
    return F.when(failed, 0.0).otherwise(1 - clamped_share(F.coalesce(faithfulness, F.lit(0.0)), F.lit(1.0)))


def with_failed_rows(asked: DataFrame, results: DataFrame) -> DataFrame:
    """A result for every question asked: where there is none, all metrics are 0, hallucination is 1 and it failed."""
    joined = asked.select("query_id").distinct().join(results.withColumn("answered", F.lit(True)), "query_id", "left")
    failed = F.col("answered").isNull()
    metrics = [F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in METRICS]
    lost = F.when(failed, 1.0).otherwise(hallucination(F.col("faithfulness"), F.lit(False)))
    return joined.select("query_id", *metrics, lost.alias("hallucination"), failed.alias("failed"))


def judged_summary(results: DataFrame) -> DataFrame:
    """One row: how many questions, how many judged, and averages over those that were judged only."""
    judged = ~F.col("failed")
    means = [F.avg(F.when(judged, F.col(c))).alias(f"avg_{c}") for c in (*METRICS, "hallucination")]
    return results.agg(F.count("*").alias("n_questions"), F.count_if(judged).alias("n_judged"), *means)


def diagnosis_rates(results: DataFrame) -> DataFrame:
    """`diagnosis, n, rate` over all results; six rows at most."""
    counts = results.groupBy("diagnosis").agg(F.count("*").alias("n"))
    return counts.withColumn("rate", F.col("n") / F.sum("n").over(W.partitionBy(F.lit(0))))


def merged_distractors(ranked: DataFrame, is_distractor: Column, dataset: Column, cutoffs: tuple[int, ...]) -> DataFrame:
    """`k, dataset, n, per_query`: distractors up to each cutoff over all queries, by set, and per query that has results."""
    total = ranked.agg(F.count_distinct("query_id").alias("queries"))
    ks = ranked.withColumn("k", F.explode(F.array(*map(F.lit, cutoffs)))).where(F.col("rank") <= F.col("k"))
    counts = ks.where(is_distractor).groupBy("k", F.lower(F.coalesce(dataset, F.lit("unknown"))).alias("dataset")).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(total)).select("k", "dataset", "n", (F.col("n") / F.col("queries")).alias("per_query"))  # one row


def long_form(metrics: DataFrame, columns: list[str], id_col: str = "query_id") -> DataFrame:
    """`id, name, score` of each metric of each query."""
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("score")) for c in columns])
    return metrics.select(id_col, F.explode(pairs).alias("m")).select(id_col, "m.name", "m.score")


def missing_items(expected: DataFrame, ranked: DataFrame, k: int) -> DataFrame:
    """`query_id, missing` of expected items that aren't among the first `k`, sorted."""
    found = ranked.where(F.col("rank") <= k).select("query_id", "item_id").distinct()
    rest = expected.distinct().join(found, ["query_id", "item_id"], "left_anti")
    return rest.groupBy("query_id").agg(F.array_sort(F.collect_set("item_id")).alias("missing"))


def trace_rows(chunks: DataFrame) -> DataFrame:
    """Chunks as they are shown in a trace: the id of the document from the first field that has one, title and
    URL likewise, and a preview of the text."""
    meta = lambda key: present(F.get_json_object("metadata_", f"$.{key}"))
    document = F.coalesce(meta("kb_document_id"), meta("document_id"), present(F.substring_index("node_id", ":", 1)), F.lit(""))
    title = F.coalesce(meta("source_title"), meta("title"), meta("original_file_name"), F.lit(""))
    url = F.coalesce(meta("source_url"), meta("url"), F.lit(""))
    return chunks.select("node_id", document.alias("document_id"), title.alias("title"), url.alias("url"), F.left(F.coalesce("text", F.lit("")), F.lit(PREVIEW)).alias("preview"))


def base_metadata(registry: DataFrame) -> DataFrame:
    """The metadata of each registry row: the title falls back to the file's name without extension, other fields to ''."""
    stem = F.regexp_replace("original_file_name", r"\.[^.]+$", "")
    columns = [c for c, t in registry.dtypes if t == "string" and c not in ("document_id", "source_title")]
    filled = [F.coalesce(present(F.col(c)), F.lit("")).alias(c) for c in columns]
    return registry.select("document_id", F.coalesce(present(F.col("source_title")), present(stem), F.lit("")).alias("source_title"), *filled)


def kept_after_filter(ranked: DataFrame, keep: Column, k: int) -> DataFrame:
    """`ranked` without what isn't kept, cut to `k` again, with `rank` anew and `n_filtered`, how many went."""
    rows = ranked.withColumn("kept", F.coalesce(keep, F.lit(False)))
    query = W.partitionBy("query_id")
    rows = rows.withColumn("n_filtered", F.count_if(~F.col("kept")).over(query)).where("kept")
    rows = rows.withColumn("new_rank", F.row_number().over(query.orderBy("rank")))
    return rows.where(F.col("new_rank") <= k).drop("kept", "rank").withColumnRenamed("new_rank", "rank")


def assembled_context(ranked: DataFrame, text: Column) -> DataFrame:
    """`query_id, context`: the chunks in order, each under its number, with a blank line between."""
    part = F.struct("rank", F.concat(F.lit("[Source "), F.col("no"), F.lit("]\n"), text).alias("part"))
    numbered = ranked.withColumn("no", F.row_number().over(W.partitionBy("query_id").orderBy("rank")))
    parts = F.array_sort(F.collect_list(part))
    return numbered.groupBy("query_id").agg(F.array_join(F.transform(parts, lambda p: p["part"]), "\n\n").alias("context"))


def confident(scores: DataFrame, threshold: float) -> DataFrame:
    """`query_id, best, confident`: whether the best score of a query reaches the threshold; no score does not."""
    best = scores.groupBy("query_id").agg(F.max("score").alias("best"))
    return best.withColumn("confident", F.coalesce(F.col("best") >= threshold, F.lit(False)))


def zipped(rows: DataFrame, left: str, right: str) -> DataFrame:
    """The elements of two arrays side by side, as far as the shorter one goes; null arrays have none."""
    n = F.least(F.size(left), F.size(right))
    pairs = F.arrays_zip(F.slice(left, F.lit(1), n).alias("l"), F.slice(right, F.lit(1), n).alias("r"))
    other = [c for c in rows.columns if c not in (left, right)]
    return rows.where(n > 0).select(*other, F.posexplode(pairs).alias("pos", "pair")).select(*other, "pos", F.col("pair.l").alias(left), F.col("pair.r").alias(right))


def document_or_url(labels: DataFrame, documents: DataFrame) -> DataFrame:
    """`id, document_id` of the documents a label means, by id or by a URL that isn't blank: two equi-joins, each pair once."""
    by_id = labels.join(documents.select("document_id"), labels.source_document_id == F.col("document_id")).select("id", "document_id")
    urls = documents.where(F.length("source_url") > 0).select("document_id", F.col("source_url").alias("url"))
    return by_id.unionByName(labels.join(urls, labels.source_url == F.col("url")).select("id", "document_id")).distinct()

"""Evaluation labels: coverage, repair, sampling, merging."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmark.functions.text import compact_form, label_form, present
from shelfmark.operators.registry import document_of, key_of


def labels_with_chunks(labels: DataFrame, chunks: DataFrame) -> DataFrame:
    """Labels whose chunk is stored (a semi-join: each label once, whatever the copies of its chunk)."""
    keys = chunks.select(key_of(F.col("node_id")).alias("chunk_key"))
    return labels.withColumn("chunk_key", key_of(F.col("source_chunk_id"))).join(keys, "chunk_key", "left_semi").drop("chunk_key")


def label_coverage(labels: DataFrame, chunks: DataFrame) -> DataFrame:
    """How many distinct labels have a chunk, a snippet within it and an answer within it."""
    one = chunks.select(key_of(F.col("node_id")).alias("chunk_key"), "text").groupBy("chunk_key").agg(F.min("text").alias("text"))
    joined = labels.distinct().withColumn("chunk_key", key_of(F.col("source_chunk_id"))).join(one, "chunk_key", "left")
    inside = lambda c: F.coalesce(F.contains(label_form(F.col("text")), label_form(F.col(c))) & (F.length(label_form(F.col(c))) > 0), F.lit(False))
    return joined.agg(
        F.count("*").alias("n_labels"), F.count_if(F.col("text").isNotNull()).alias("chunk_found"),
        F.count_if(inside("expected_context_snippet")).alias("snippet_found"), F.count_if(inside("expected_answer_text")).alias("answer_found"),
    )


def repaired_labels(labels: DataFrame, chunks: DataFrame, least: int = 40) -> DataFrame:
    """`id, new_chunk_id, tier, outcome` of labels whose chunk is missing, by the first tier that matches.

    Candidates are the chunks of the label's document. 1: the snippet as it is, 2: the snippet but for
    formatting (at least `least` letters), both take the shortest chunk; 3: the answer as it is, 4: but for
    formatting, both only if one chunk matches, else the label is ambiguous. What no tier matches is
    not_found. Both sides are normalised before they meet, each label and chunk once.
    """
    keys = chunks.select(key_of(F.col("node_id")).alias("chunk_key"))
    stale = labels.select("id", "expected_answer_text", "expected_context_snippet", "source_document_id", "source_chunk_id").distinct()
    stale = stale.withColumn("chunk_key", key_of(F.col("source_chunk_id"))).join(keys, "chunk_key", "left_anti")
    snippet, answer = F.col("expected_context_snippet"), F.col("expected_answer_text")
    wanted = stale.select(
        "id", key_of(F.col("source_document_id")).alias("document_id"), *[F.when(F.length(F.trim(c)) > 0, label_form(c)).alias(f"{n}_form") for n, c in (("s", snippet), ("a", answer))],
        *[F.when(F.length(compact_form(c)) >= least, compact_form(c)).alias(f"{n}_compact") for n, c in (("s", snippet), ("a", answer))],
    )
    stored = chunks.where("text is not null").groupBy("node_id").agg(F.min("text").alias("text"))
    stored = stored.select("node_id", document_of(F.col("node_id")).alias("document_id"), F.length("text").alias("n"), label_form(F.col("text")).alias("form"), compact_form(F.col("text")).alias("compact"))
    holds = (F.contains("form", "s_form"), F.contains("compact", "s_compact"), F.contains("form", "a_form"), F.contains("compact", "a_compact"))
    tiers = F.array(*[F.when(c, F.lit(k)) for k, c in enumerate(holds, 1)])
    hits = wanted.join(stored, "document_id").select("id", "node_id", "n", F.explode(F.array_compact(tiers)).alias("tier"))
    best = hits.withColumn("best", F.min("tier").over(W.partitionBy("id"))).where("tier = best")
    chosen = best.groupBy("id", "tier").agg(F.min_by("node_id", F.struct("n", "node_id")).alias("shortest"), F.count_distinct("node_id").alias("matches"))
    new = F.when((F.col("tier") <= 2) | (F.col("matches") == 1), F.col("shortest"))
    out = stale.select("id").distinct().join(chosen.select("id", new.alias("new_chunk_id"), "tier"), "id", "left")
    return out.withColumn("outcome", F.when(F.col("tier").isNull(), "not_found").when(F.col("new_chunk_id").isNull(), "ambiguous").otherwise("repaired"))


def merged_labels(labels: DataFrame) -> DataFrame:
    """One row a query (compared without case, spaces and quotes): the latest, and whether answers differed."""
    form = label_form(F.col("query"))
    rows = labels.where(present(form).isNotNull()).distinct().withColumn("form", form)
    answers = rows.groupBy("form").agg(
        F.max_by("id", F.struct("created_at", "id")).alias("id"), F.count_distinct("id").alias("n_labels"),
        (F.count_distinct(F.coalesce(label_form(F.col("expected_answer_text")), F.lit(""))) > 1).alias("conflicting"),
    )
    return answers.select("id", "n_labels", "conflicting")


def upserted_labels(labels: DataFrame, incoming: DataFrame, columns: list[str]) -> DataFrame:
    """`query` and `columns` after merging `incoming` by query, with `change`: inserted, updated or kept.

    Both sides hold a query once; a row that equals the stored one in all columns is kept.
    """
    old = labels.select("query", F.struct(*columns).alias("old"))
    new = incoming.select("query", F.struct(*columns).alias("new"))
    both = old.join(new, "query", "full")
    change = F.when(F.col("old").isNull(), "inserted").when(F.col("new").isNotNull() & ~F.col("new").eqNullSafe(F.col("old")), "updated").otherwise("kept")
    return both.select("query", F.coalesce("new", "old").alias("row"), change.alias("change")).select("query", "row.*", "change")


def sampled_chunks(chunks: DataFrame, per_document: int = 8, least: int = 120) -> DataFrame:
    """The first `per_document` long chunks of each document, by id: a sampling operator."""
    rows = chunks.where(F.length(F.trim("text")) >= least).select("node_id", "document_id").distinct()
    order = W.partitionBy("document_id").orderBy("node_id")
    return rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_document)


def evidence_hits(labels: DataFrame, chunks: DataFrame) -> DataFrame:
    """`id, match_mode` of each label: exact_chunk, equivalent_evidence (another chunk of its document holds the
    snippet) or missing."""
    rows = labels.select("id", "source_document_id", "source_chunk_id", "expected_context_snippet").distinct()
    keys = chunks.select(key_of(F.col("node_id")).alias("stored")).distinct()
    exact = rows.join(keys, key_of(F.col("source_chunk_id")) == F.col("stored"), "left")
    texts = chunks.where("text is not null").select(document_of(F.col("node_id")).alias("doc"), label_form(F.col("text")).alias("form")).distinct()
    snippet = label_form(F.col("expected_context_snippet"))
    near = rows.where(F.length(snippet) > 0).join(texts, key_of(F.col("source_document_id")) == F.col("doc")).where(F.contains(F.col("form"), snippet))
    near = near.select(F.col("id").alias("near_id")).distinct()
    mode = F.when(F.col("stored").isNotNull(), "exact_chunk").when(F.col("near_id").isNotNull(), "equivalent_evidence").otherwise("missing")
    best = exact.join(near, F.col("id") == F.col("near_id"), "left").select("id", mode.alias("match_mode"))
    return best.groupBy("id").agg(F.min("match_mode").alias("match_mode"))

"""Corpus management and audit over the chunk table and the registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.text import one_line, present
from shelfmark.operators.registry import current_documents, document_of

# The primary dataset, and datasets that only serve as noise.
PRIMARY_SET, NOISE_SETS = "hkpl", ("hotpotqa", "webz_news")


def chunk_table(pages: DataFrame) -> DataFrame:
    """One row a chunk with its metadata as columns; a key missing from the JSON, or JSON that can't be read, is null.

    Doubled rows stay: audits count what is stored.
    """
    meta = lambda key: F.get_json_object("metadata_", f"$.{key}")
    return pages.select(
        "node_id", "text", document_of(F.col("node_id")).alias("document_id"), meta("dataset").alias("dataset"), meta("corpus_role").alias("corpus_role"),
        meta("document_type").alias("document_type"), meta("document_version").cast("int").alias("version"), meta("section_index").cast("int").alias("section_index"),
        meta("chunk_index").cast("int").alias("chunk_index"), F.size("embedding").alias("dims"), F.col("embedding").isNull().alias("no_embedding"),
    )


def dataset_of(dataset: Column) -> Column:
    return F.coalesce(present(dataset), F.lit(PRIMARY_SET))


def is_distractor(dataset: Column, role: Column) -> Column:
    """By role, or by dataset whatever the role says."""
    return F.coalesce(F.lower(F.trim(role)) == "distractor", F.lit(False)) | F.coalesce(F.lower(F.trim(dataset)).isin(*NOISE_SETS), F.lit(False))


def normalised_role(dataset: Column, role: Column) -> tuple[Column, Column]:
    """(dataset, role): a missing dataset is the primary one, noise sets are distractors, a missing role is
    primary in the primary set and distractor elsewhere."""
    name = dataset_of(dataset)
    return name, F.when(name.isin(*NOISE_SETS), "distractor").when(present(role).isNotNull(), role).when(name == PRIMARY_SET, "primary").otherwise("distractor")


def audit_summary(chunks: DataFrame, dims: int) -> DataFrame:
    """Counts of all chunks, distinct documents, and what is missing, too short or not of `dims` dimensions."""
    return chunks.agg(
        F.count("*").alias("n_chunks"), F.count_distinct("document_id").alias("n_documents"), F.count_if("no_embedding").alias("no_embedding"),
        F.count_if(~F.col("no_embedding") & (F.col("dims") != dims)).alias("bad_dims"), F.count_if(F.length(F.coalesce("text", F.lit(""))) < 50).alias("too_short"),
        F.count_if(present(F.col("dataset")).isNull()).alias("no_dataset"), F.count_if(F.col("chunk_index").isNull()).alias("no_index"),
    )


def registry_mismatches(chunks: DataFrame, registry: DataFrame) -> DataFrame:
    """Completed documents whose recorded number of chunks isn't the number stored (each chunk once)."""
    stored = chunks.select("document_id", "node_id").distinct().groupBy("document_id").agg(F.count("*").alias("stored"))
    current = current_documents(registry, "status", "chunk_count").where("status = 'completed'")
    found = current.join(stored, "document_id", "left").withColumn("stored", F.coalesce("stored", F.lit(0)))
    return found.where("coalesce(chunk_count, 0) != stored").select("document_id", "chunk_count", "stored")


def stale_or_orphaned(chunks: DataFrame, registry: DataFrame) -> DataFrame:
    """Chunks whose document isn't registered as completed, or at another version: the true number, not a sample."""
    current = current_documents(registry, "status", "version").where("status = 'completed'")
    current = current.select(F.col("document_id").alias("known"), F.col("version").alias("current_version"))
    found = chunks.join(current, chunks.document_id == current.known, "left")
    kind = F.when(F.col("known").isNull(), "orphaned").when(~F.col("version").eqNullSafe(F.col("current_version")), "stale")
    return found.select("node_id", kind.alias("kind")).where("kind is not null").distinct()


def duplicate_groups(chunks: DataFrame, top: int = 20) -> DataFrame:
    """The texts stored most often: copies, documents and a preview of at most 180 characters (a top list)."""
    grouped = chunks.where("text is not null").groupBy(F.md5("text").alias("text_hash")).agg(
        F.count("*").alias("copies"), F.count_distinct("document_id").alias("n_documents"), F.left(F.min(one_line(F.col("text"))), F.lit(180)).alias("preview")
    )
    return grouped.where("copies > 1").orderBy(F.col("copies").desc(), "text_hash").limit(top)


def audit_checks(chunks: DataFrame, registry: DataFrame, dims: int) -> DataFrame:
    """`check_name, n_found, passed`: each invariant with the number of rows that break it, and `overall` with their sum."""
    counts = audit_summary(chunks, dims)
    names = ("no_embedding", "bad_dims", "too_short", "no_dataset", "no_index")
    rows = counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check_name"), F.col(n).alias("n_found")) for n in names])).alias("r")).select("r.*")
    one = lambda df, name: df.agg(F.count("*").alias("n_found")).select(F.lit(name).alias("check_name"), "n_found")
    rows = rows.unionByName(one(registry_mismatches(chunks, registry), "registry_mismatch"))
    rows = rows.unionByName(one(stale_or_orphaned(chunks, registry), "stale_or_orphaned"))
    rows = rows.unionByName(one(chunks.groupBy("node_id").count().where("count > 1"), "doubled_id"))
    rows = rows.unionByName(rows.agg(F.lit("overall").alias("check_name"), F.sum("n_found").alias("n_found")).select("check_name", "n_found"))
    return rows.withColumn("passed", F.col("n_found") == 0)

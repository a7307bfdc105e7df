"""The document registry: current rows and what hangs on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.urls import site_of


def key_of(col: Column) -> Column:
    """A key without case and outer spaces; null where blank."""
    key = F.lower(F.regexp_replace(col.cast("string"), r"^\s+|\s+$", ""))
    return F.when(key != "", key)


def document_of(node_id: Column) -> Column:
    """The document a chunk belongs to: what stands before the first colon of its id."""
    return key_of(F.substring_index(node_id, ":", 1))


def current_documents(registry: DataFrame, *columns: str) -> DataFrame:
    """One row a document: `document_id` and `columns` of the row with the latest `updated_at`.

    Of rows with the same time the higher version counts, then the greater status; rows without
    a time come last. `first_uploaded_at` is the earliest upload over all rows of the document.
    Aggregated before the shuffle, so doubled rows and hot documents cost nothing.
    """
    order = F.struct(
        F.col("updated_at").isNotNull(), F.col("updated_at"), F.col("version"), F.col("status"), *[F.col(c) for c in columns]
    )
    rows = registry.select(
        key_of(F.col("document_id")).alias("document_id"),
        F.struct(*[F.col(c) for c in columns]).alias("row"),
        order.alias("rank"),
        F.col("uploaded_at"),
    ).where("document_id is not null")
    latest = rows.groupBy("document_id").agg(
        F.max_by("row", "rank").alias("row"), F.min("uploaded_at").alias("first_uploaded_at")
    )
    return latest.select("document_id", "row.*", "first_uploaded_at")


def document_sites(registry: DataFrame) -> DataFrame:
    """`document_id` and `site` of every document; site is null without a URL."""
    current = current_documents(registry, "source_url")
    return current.select("document_id", site_of(F.col("source_url")).alias("site"))


def content_key(content_hash: Column) -> Column:
    """A content hash without case, spaces and the name of its algorithm; null where blank."""
    bare = F.regexp_replace(F.lower(content_hash), r"\s+|^\s*[a-z0-9-]+:", "")
    return F.when(bare != "", bare)


def completed_duplicates(registry: DataFrame) -> DataFrame:
    """Current completed documents that share a content hash with one uploaded earlier, and the first of them."""
    current = current_documents(registry, "status", "content_hash").where("status = 'completed'")
    keyed = current.select("document_id", content_key(F.col("content_hash")).alias("hash_key"), F.col("first_uploaded_at").alias("at"))
    keyed = keyed.where("hash_key is not null")
    first = keyed.groupBy("hash_key").agg(F.min_by("document_id", F.struct("at", "document_id")).alias("original"), F.count("*").alias("n"))
    return keyed.join(first.where("n > 1"), "hash_key").where("document_id != original").select("document_id", "original")


def active_web_documents(registry: DataFrame) -> DataFrame:
    """The latest row that isn't deleted of each crawled URL; blank URLs have none."""
    rows = registry.where((F.col("status") != "deleted") & F.col("source_type").isin("crawler", "webpage") & (F.trim("source_url") != ""))
    latest = rows.groupBy(F.trim("source_url").alias("url")).agg(
        F.max_by("document_id", F.struct("updated_at", "version", "document_id")).alias("document_id"), F.count("*").alias("n_rows")
    )
    return latest


def soft_deleted(registry: DataFrame, deleted: DataFrame, at: str) -> DataFrame:
    """The registry after deleting `deleted(document_id)` at a given time; what is deleted already stays as it is."""
    gone = deleted.select(key_of(F.col("document_id")).alias("gone")).distinct()
    hit = F.col("gone").isNotNull() & ~F.col("status").eqNullSafe(F.lit("deleted"))
    joined = registry.join(gone, key_of(registry["document_id"]) == F.col("gone"), "left")
    return joined.withColumn("updated_at", F.when(hit, F.lit(at).cast("timestamp_ntz")).otherwise(F.col("updated_at"))).withColumn(
        "status", F.when(hit, "deleted").otherwise(F.col("status"))
    ).drop("gone")


def upload_decisions(incoming: DataFrame, registry: DataFrame) -> DataFrame:
    """`url, content_hash` of incoming pages with an `action`: unchanged, replace, duplicate or create."""
    web = active_web_documents(registry).select("url", F.col("document_id").alias("active_id"))
    current = current_documents(registry, "status", "content_hash")
    hashes = current.select(F.col("document_id").alias("known_id"), content_key(F.col("content_hash")).alias("known_hash"), "status")
    by_id = hashes.select(F.col("known_id").alias("active_id"), F.col("known_hash").alias("active_hash"))
    by_hash = hashes.where("status = 'completed' and known_hash is not null").groupBy("known_hash").agg(F.min("known_id").alias("duplicate_of"))
    keyed = incoming.select(F.trim("url").alias("url"), content_key(F.col("content_hash")).alias("hash_key"))
    found = keyed.join(web, "url", "left").join(by_id, "active_id", "left").join(by_hash, F.col("hash_key") == F.col("known_hash"), "left")
    action = (
        F.when(F.col("active_id").isNotNull() & F.col("active_hash").eqNullSafe(F.col("hash_key")), "unchanged")
        .when(F.col("active_id").isNotNull(), "replace").when(F.col("duplicate_of").isNotNull(), "duplicate").otherwise("create")
    )
    return found.select("url", "hash_key", action.alias("action"))


def folded_status(registry: DataFrame) -> DataFrame:
    """`document_id, status, error_message, chunk_count, n_states`: the states of a document folded in order of
    `updated_at`; status and message are the last ones, even if null, the chunk count the last one given."""
    order = F.struct("updated_at", "version", "status")
    rows = registry.distinct().withColumn("key", key_of(F.col("document_id"))).where("key is not null")
    last = F.max_by(F.struct("status", "error_message"), order)
    count = F.max_by("chunk_count", F.when(F.col("chunk_count").isNotNull(), order))
    out = rows.groupBy(F.col("key").alias("document_id")).agg(last.alias("last"), count.alias("chunk_count"), F.count("*").alias("n_states"))
    return out.select("document_id", "last.status", "last.error_message", "chunk_count", "n_states")

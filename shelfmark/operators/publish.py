"""Changes of tables, as functions from the old table and the change to the new one, and their sinks.

Nothing is updated in place: a change gives the rows of the new version, and `publish` writes them as a
version beside the earlier ones. A reader sees a version only when it is complete.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.text import present, slug
from shelfmark.operators.corpus import PRIMARY_SET, dataset_of, is_distractor
from shelfmark.operators.registry import content_key, current_documents, document_of, key_of, soft_deleted
from shelfmark.session import exists, save

TIME = "timestamp_ntz"


# Registry


def inserted(registry: DataFrame, incoming: DataFrame, at: str) -> DataFrame:
    """The registry with one row a new document of `incoming`: version 1, status uploaded, no chunks.

    Documents that are registered already, and rows without an id, are not inserted; columns that
    `incoming` lacks are null. Of several rows of one id the least counts.
    """
    known = registry.select(key_of(F.col("document_id")).alias("key")).distinct()
    new = incoming.withColumn("key", key_of(F.col("document_id"))).where("key is not null")
    given = [c for c in registry.columns if c in incoming.columns]
    new = new.groupBy("key").agg(F.min(F.struct(*given)).alias("row")).join(known, "key", "left_anti").select("row.*")
    fixed = {"version": F.lit(1), "status": F.lit("uploaded"), "chunk_count": F.lit(0), "error_message": F.lit(None), "uploaded_at": F.lit(at), "updated_at": F.lit(at)}
    columns = [fixed.get(f.name, F.col(f.name) if f.name in given else F.lit(None)).cast(f.dataType).alias(f.name) for f in registry.schema]
    return registry.unionByName(new.select(columns))


def replaced(registry: DataFrame, incoming: DataFrame, at: str) -> DataFrame:
    """The registry after new content `incoming(document_id, content_hash)`: the version goes up by one, status,
    chunks and error start anew. Deleted documents stay as they are, as do documents whose content is the same."""
    new = incoming.select(key_of(F.col("document_id")).alias("key"), F.col("content_hash").alias("new_hash")).where("key is not null")
    new = new.groupBy("key").agg(F.min("new_hash").alias("new_hash"))
    rows = registry.join(new, key_of(registry["document_id"]) == F.col("key"), "left")
    same = content_key(F.col("content_hash")).eqNullSafe(content_key(F.col("new_hash")))
    hit = F.col("key").isNotNull() & ~F.col("status").eqNullSafe(F.lit("deleted")) & ~same
    fixed = {
        "content_hash": F.col("new_hash"), "version": F.coalesce("version", F.lit(0)) + 1, "status": F.lit("uploaded"), "chunk_count": F.lit(0),
        "error_message": F.lit(None), "updated_at": F.lit(at),
    }
    return rows.select([F.when(hit, fixed[f.name].cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name) if f.name in fixed else F.col(f.name) for f in registry.schema])


def reindexed(registry: DataFrame, requests: DataFrame) -> DataFrame:
    """The registry after `requests(document_id, document_type)`: the type is the one asked for, else the one it had,
    else auto, and the document waits to be indexed again."""
    asked = requests.select(key_of(F.col("document_id")).alias("key"), present(F.col("document_type")).alias("asked")).where("key is not null")
    asked = asked.groupBy("key").agg(F.max("asked").alias("asked"))
    rows = registry.join(asked, key_of(registry["document_id"]) == F.col("key"), "left")
    hit = F.col("key").isNotNull() & ~F.col("status").eqNullSafe(F.lit("deleted"))
    kind = F.when(hit, F.coalesce("asked", present(F.col("document_type")), F.lit("auto"))).otherwise(F.col("document_type"))
    return rows.withColumns({"document_type": kind, "status": F.when(hit, "uploaded").otherwise(F.col("status"))}).select(registry.columns)


# Chunks


def without_documents(chunks: DataFrame, deleted: DataFrame) -> DataFrame:
    """The chunks of all documents but `deleted(document_id)`."""
    gone = deleted.select(key_of(F.col("document_id")).alias("gone")).where("gone is not null").distinct()
    return chunks.join(gone, document_of(chunks["node_id"]) == F.col("gone"), "left_anti")


def deleted_documents(registry: DataFrame, chunks: DataFrame, deleted: DataFrame, at: str) -> tuple[DataFrame, DataFrame]:
    """(registry, chunks) after deleting documents: their rows stay as deleted, their chunks go."""
    return soft_deleted(registry, deleted, at), without_documents(chunks, deleted)


def current_versions(chunks: DataFrame, registry: DataFrame) -> DataFrame:
    """The chunks (with `document_id, version`) at the current version of their document; chunks of unknown documents stay."""
    current = current_documents(registry, "version").select(F.col("document_id").alias("known"), F.col("version").alias("current"))
    rows = chunks.join(current, chunks.document_id == current.known, "left")
    return rows.where(F.col("known").isNull() | F.col("version").eqNullSafe(F.col("current"))).select(chunks.columns)


def dataset_replaced(chunks: DataFrame, incoming: DataFrame, dataset: str) -> DataFrame:
    """The chunks with those of one `dataset` replaced by `incoming`; the primary set and a blank name are refused."""
    if dataset.strip().lower() in ("", PRIMARY_SET):
        raise ValueError(f"the set {dataset!r} can't be replaced")
    return chunks.where(dataset_of(F.col("dataset")) != dataset).unionByName(incoming.withColumn("dataset", F.lit(dataset)), allowMissingColumns=True)


def without_primary(chunks: DataFrame) -> DataFrame:
    """Only the chunks that serve as distractors."""
    return chunks.where(is_distractor(F.col("dataset"), F.col("corpus_role")))


def without_titled(chunks: DataFrame, titles: DataFrame, kind: str = "faq") -> DataFrame:
    """The chunks but for those of type `kind` whose document has one of `titles(title)`, compared without case and outer spaces."""
    named = titles.select(key_of(F.col("title")).alias("named")).where("named is not null").distinct()
    of_kind = F.coalesce(F.col("document_type") == kind, F.lit(False))
    return chunks.join(named, of_kind & (key_of(chunks["title"]) == F.col("named")), "left_anti")


def rebuild_faults(chunks: DataFrame, registry: DataFrame) -> DataFrame:
    """`node_id, fault` of what must not be published: text, embedding or id missing, the same id with several texts,
    a document that isn't registered or is deleted."""
    current = current_documents(registry, "status").select(F.col("document_id").alias("known"), "status")
    twice = chunks.groupBy("node_id").agg(F.count_distinct("text").alias("texts")).where("texts > 1").select(F.col("node_id").alias("twice"))
    rows = chunks.join(current, chunks.document_id == current.known, "left").join(twice, F.col("node_id") == F.col("twice"), "left")
    faults = {
        "no_id": F.col("node_id").isNull(), "no_text": F.length(F.trim(F.coalesce("text", F.lit("")))) == 0, "no_embedding": F.col("no_embedding"),
        "several_texts": F.col("twice").isNotNull(), "unknown_document": F.col("known").isNull(), "deleted_document": F.coalesce(F.col("status") == "deleted", F.lit(False)),
    }
    names = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in faults.items()]))
    return rows.select("node_id", F.explode(names).alias("fault")).distinct()


def rebuilt(spark: SparkSession, chunks: DataFrame, registry: DataFrame, base: str) -> DataFrame:
    """Publish the chunks as a new version if nothing is wrong with them; else fail before anything is touched."""
    faults = rebuild_faults(chunks, registry)
    if found := faults.groupBy("fault").count().collect():  # one row a kind of fault
        raise ValueError("not published: " + ", ".join(f"{r['count']} {r['fault']}" for r in sorted(found)))
    publish(chunks, base)
    return published(spark, base)


# Labels


def labels_repaired(labels: DataFrame, repairs: DataFrame) -> DataFrame:
    """The labels with the chunk that `repairs(id, new_chunk_id)` gives, and its document; blanks change nothing."""
    new = repairs.select(F.col("id").alias("repaired"), present(F.trim("new_chunk_id")).alias("new")).where("new is not null")
    new = new.groupBy("repaired").agg(F.min("new").alias("new"))
    rows = labels.join(new, labels.id == new.repaired, "left")
    document = F.when(F.col("new").isNotNull(), F.substring_index("new", ":", 1)).otherwise(F.col("source_document_id"))
    return rows.withColumns({"source_document_id": document, "source_chunk_id": F.coalesce("new", "source_chunk_id")}).drop("repaired", "new")


# State, logs and versions


def crawl_state(state: DataFrame, crawled: DataFrame) -> DataFrame:
    """`url, content_hash` after a crawl: what was crawled last counts, null hashes change nothing."""
    rows = state.select("url", "content_hash", F.lit(0).alias("new")).unionByName(crawled.select("url", "content_hash", F.lit(1).alias("new")))
    return rows.where("url is not null and content_hash is not null").groupBy("url").agg(F.max_by("content_hash", F.struct("new", "content_hash")).alias("content_hash"))


def raw_content_name(url: Column, extension: Column, prefix: str = "webpage") -> Column:
    """The name under which the content of a page is kept."""
    return F.concat(F.lit(f"{prefix}_"), F.left(F.sha2(url, 256), F.lit(16)), F.coalesce(extension, F.lit("")))


def audit_log(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """`key, action, old_value, new_value` of each row that differs, the values as JSON without nulls."""
    columns = [c for c in before.columns if c != key]
    old = before.select(key, F.struct(*columns).alias("old"))
    new = after.select(key, F.struct(*columns).alias("new"))
    rows = old.join(new, key, "full").where(~F.col("old").eqNullSafe(F.col("new")))
    action = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete").otherwise("update")
    return rows.select(key, action.alias("action"), F.to_json("old").alias("old_value"), F.to_json("new").alias("new_value"))


def messages_to_append(messages: DataFrame) -> DataFrame:
    """The messages that may be stored: session and content are not blank."""
    return messages.where(F.col("session_id").rlike(r"\S") & F.col("content").rlike(r"\S"))


def result_name(name: str, filters: DataFrame) -> DataFrame:
    """`name` of each run's results: the filters of a partial run (`filters(label, row_limit)`) are part of it."""
    tag = present(slug(F.coalesce("label", F.lit(""))))
    limit = F.when(F.col("row_limit") > 0, F.concat(F.lit("limit-"), "row_limit"))
    return filters.select("*", F.concat_ws("-", F.lit(name), tag, limit).alias("name"))


def as_csv(df: DataFrame) -> DataFrame:
    """The rows with arrays, maps and structs as JSON, fit for CSV."""
    nested = {f.name for f in df.schema if f.dataType.typeName() in ("array", "map", "struct")}
    return df.select([F.to_json(c).alias(c) if c in nested else F.col(c) for c in df.columns])


def write_csv(df: DataFrame, path: str) -> None:
    """Append rows as CSV files with a header; fields may hold quotes and line breaks."""
    as_csv(df).write.mode("append").option("header", True).option("escape", '"').option("quoteAll", True).option("emptyValue", '""').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_vectors(chunks: DataFrame, path: str) -> None:
    """Append chunks to a vector table, a folder for each dataset."""
    rows = chunks.withColumn("dataset", dataset_of(F.col("dataset"))).hint("rebalance", "dataset")
    save(rows.write.mode("append").partitionBy("dataset"), chunks.sparkSession, path)


def append_json(df: DataFrame, path: str) -> None:
    """Append rows to a log of JSON lines."""
    df.write.mode("append").json(path)


def versions(spark: SparkSession, base: str) -> list[int]:
    """The complete versions of a published table."""
    if not exists(spark, base):
        return []
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [(s.getPath().getName(), s.getPath()) for s in fs.listStatus(path)]
    done = [int(n[2:]) for n, p in names if n.startswith("v=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(done)


def publish(df: DataFrame, base: str) -> int:
    """Write a new version beside the earlier ones; it counts once it is complete."""
    number = max(versions(df.sparkSession, base), default=0) + 1
    save(df.write.mode("overwrite"), df.sparkSession, f"{base}/v={number}")
    return number


def published(spark: SparkSession, base: str, version: int | None = None) -> DataFrame:
    """The latest version of a table, or the one named."""
    return spark.read.parquet(f"{base}/v={version or versions(spark, base)[-1]}")


def migrated(df: DataFrame, schema: str) -> DataFrame:
    """The rows in a schema that may have more columns than they were written with: those are null, others stay at the end."""
    wanted = df.sparkSession.createDataFrame([], schema).schema
    named = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in wanted]
    return df.select(*named, *[c for c in df.columns if c not in wanted.names])

"""References to records that do not exist.

Keys become integers by their place in the sorted dictionary of all keys; the parents' integers
are compressed to runs of neighbours, and each reference is matched as of the last run that
starts at or before it: beyond that run's end there is no parent. Most references exist, so the
runs are long and few, whatever the number of parents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmark.operators.registry import current_documents, document_of, key_of
from shelfmark.session import written


def coded_keys(parents: DataFrame, references: DataFrame) -> DataFrame:
    """`key, code, is_parent` of every distinct `key` of both, in the order of the keys.

    Codes are dense over range partitions: a count per partition, never the keys, gives the
    offsets. Null keys are left out; repeated keys count once.
    """
    both = parents.select("key", F.lit(1).alias("is_parent")).unionByName(
        references.select("key", F.lit(0).alias("is_parent"))
    )
    distinct = both.where("key is not null").groupBy("key").agg(F.max("is_parent").alias("is_parent"))
    spread = distinct.repartitionByRange("key").withColumn("part", F.spark_partition_id())
    spread = written(spread, "keys")  # the partition numbers must not change when a task is run again
    sizes = spread.groupBy("part").count()
    offsets = sizes.select(
        "part", (F.sum("count").over(W.orderBy("part")) - F.col("count")).alias("before")
    )  # one row a partition
    inside = spread.withColumn("place", F.row_number().over(W.partitionBy("part").orderBy("key")))
    return inside.join(F.broadcast(offsets), "part").select(
        "key", "part", (F.col("before") + F.col("place")).alias("code"), F.col("is_parent").cast("boolean").alias("is_parent")
    )


def parent_runs(coded: DataFrame) -> DataFrame:
    """`part, run_start, run_end` of each run of neighbouring parent codes of a partition."""
    order = W.partitionBy("part").orderBy("code")
    parents = coded.where("is_parent").withColumn("run", F.col("code") - F.row_number().over(order))
    return parents.groupBy("part", "run").agg(F.min("code").alias("run_start"), F.max("code").alias("run_end")).drop("run")


def missing_keys(parents: DataFrame, references: DataFrame) -> DataFrame:
    """`key` of every distinct reference (`references(key)`) that `parents(key)` does not hold."""
    coded = coded_keys(parents, references)
    runs = parent_runs(coded)
    # As-of match within a range partition: the runs and the references in one order, run first.
    line = runs.select("part", F.col("run_start").alias("code"), F.lit(0).alias("kind"), "run_end", F.lit(None).cast("string").alias("key"))
    line = line.unionByName(
        coded.select("part", "code", F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("run_end"), "key")
    )
    order = W.partitionBy("part").orderBy("code", "kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    matched = line.withColumn("reach", F.last("run_end", ignorenulls=True).over(order))
    return matched.where((F.col("kind") == 1) & (F.col("reach").isNull() | (F.col("code") > F.col("reach")))).select("key")


def orphan_references(labels: DataFrame, registry: DataFrame, chunks: DataFrame) -> DataFrame:
    """`id, ref_column, period, orphan_kind` of every reference of `labels` to what is not there.

    `labels(id, source_document_id, source_chunk_id, created_at)` refer to documents and chunks.
    deleted: the current registry row of the document has that status; else missing: no such
    document, or no such chunk; else later: first uploaded after the label. Keys ignore case and
    outer spaces, a blank or null one is no reference; without a time the period is null and
    nothing is later; doubled labels give one case; with an empty registry all are missing.
    Distinct keys are matched, so a document that a third of the labels refer to is matched once;
    the join back is split by AQE where a key is hot.
    """
    documents = current_documents(registry, "status")
    refs = labels.select(
        "id", "created_at",
        F.explode(F.array(
            F.struct(F.lit("source_document_id").alias("ref_column"), key_of(F.col("source_document_id")).alias("key")),
            F.struct(F.lit("source_chunk_id").alias("ref_column"), key_of(F.col("source_chunk_id")).alias("key")),
        )).alias("r"),
    ).select("id", "created_at", "r.*").where("key is not null").distinct()
    is_chunk: Column = F.col("ref_column") == "source_chunk_id"
    refs = refs.withColumn("document_id", F.when(is_chunk, document_of(F.col("key"))).otherwise(F.col("key")))
    # Documents and chunks share one dictionary, apart by the first letter.
    tagged = F.concat(F.when(is_chunk, F.lit("c")).otherwise(F.lit("d")), F.col("key"))
    refs = refs.withColumn("tagged", tagged)
    parents = documents.select(F.concat(F.lit("d"), "document_id").alias("key")).unionByName(
        chunks.select(F.concat(F.lit("c"), key_of(F.col("node_id"))).alias("key"))
    )
    gone = missing_keys(parents, refs.select(F.col("tagged").alias("key"))).select(F.col("key").alias("gone"))
    placed = refs.join(documents, "document_id", "left").join(gone, refs.tagged == gone.gone, "left")
    kind = (
        F.when(F.lower(F.trim("status")) == "deleted", "deleted")
        .when(F.col("gone").isNotNull() | F.col("status").isNull() & F.col("first_uploaded_at").isNull(), "missing")
        .when(F.col("first_uploaded_at") > F.col("created_at"), "later")
    )
    found = placed.select(
        "id", "ref_column", F.date_format("created_at", "yyyy-MM").alias("period"), kind.alias("orphan_kind")
    )
    return found.where("orphan_kind is not null").distinct()


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans counted per column, period and kind."""
    return orphans.groupBy("ref_column", "period", "orphan_kind").agg(F.count("*").alias("n_orphans"))

"""Filling contexts of fixed capacity with texts.

Dynamic programming over the global histogram of sizes chooses length buckets with the least
padding; batches form inside each bucket under the token budget. A batch of one bucket alone
leaves the room beyond its last item unused, so the batches of a bucket are topped up from the
largest buckets that still fit: the plan is made of bucket counts only, and every item finds its
group by its place within its bucket.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmark.llm.bpe import TOKENIZER_DIR, token_counts
from shelfmark.session import written

CAPACITY, BUCKETS, SALTS = 2048, 128, 64
PLAN_SCHEMA = "bucket int, first_place bigint, last_place bigint, first_group bigint, per_group int"


def length_buckets(histogram: dict[int, int], n_buckets: int = BUCKETS) -> list[int]:
    """Upper bounds of at most `n_buckets` buckets of sizes with the least total padding.

    The histogram has at most as many entries as the capacity, whatever the number of items.
    """
    sizes = np.array(sorted(histogram), dtype=np.int64)
    counts = np.array([histogram[s] for s in sizes.tolist()], dtype=np.int64)
    n = len(sizes)
    if n <= n_buckets:
        return sizes.tolist()
    seen = np.concatenate(([0], np.cumsum(counts))).astype(np.float64)
    mass = np.concatenate(([0], np.cumsum(counts * sizes))).astype(np.float64)
    # cost[i, j]: padding when the sizes i..j-1 share the bound sizes[j-1]
    cost = np.full((n + 1, n + 1), np.inf)
    for j in range(1, n + 1):
        cost[:j, j] = (seen[j] - seen[:j]) * sizes[j - 1] - (mass[j] - mass[:j])
    best = cost[0].copy()
    best[0] = 0
    steps = []
    for _ in range(n_buckets - 1):
        total = best[:, None] + cost
        step = np.argmin(total, axis=0)
        new = total[step, np.arange(n + 1)]
        better = new < best
        steps.append(np.where(better, step, -1))
        best = np.where(better, new, best)
    bounds, j = [], n
    for step in reversed(steps):
        if j > 0 and step[j] > 0:
            bounds.append(int(sizes[j - 1]))
            j = int(step[j])
    bounds.append(int(sizes[j - 1]))
    return sorted(set(bounds))


def batch_plan(bounds: list[int], counts: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Rows of PLAN_SCHEMA: which places of a bucket go to which groups.

    Largest bucket first: as many items as the budget holds, then the room left is filled with
    the largest buckets that fit. One composition serves as many groups as the counts allow, so
    the plan grows with the buckets, not with the items.
    """
    left, used = list(counts), [0] * len(counts)
    plan: list[tuple[int, int, int, int, int]] = []
    group = 0
    while any(left):
        room, members = capacity, []
        for b in range(len(bounds) - 1, -1, -1):
            if left[b] and bounds[b] <= room:
                take = min(left[b], room // bounds[b])
                members.append((b, take))
                room -= take * bounds[b]
        times = min(left[b] // take for b, take in members)
        for b, take in members:
            plan.append((b, used[b], used[b] + take * times - 1, group, take))
            used[b] += take * times
            left[b] -= take * times
        group += times
    return plan


def sized_pieces(sizes: DataFrame, capacity: int) -> DataFrame:
    """`doc_id, piece_no, first_token, size`: items up to the capacity whole, larger ones in full
    pieces and a rest; items of size 0 or null as one piece of 0."""
    n = F.coalesce(F.col("n_tokens"), F.lit(0))
    pieces = F.greatest(F.ceil(n / F.lit(capacity)), F.lit(1)).cast("int")
    out = sizes.select("doc_id", n.alias("n"), F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece_no"))
    first = F.col("piece_no") * capacity
    return out.select("doc_id", "piece_no", first.alias("first_token"), F.least(F.col("n") - first, F.lit(capacity)).cast("int").alias("size"))


def packed(sizes: DataFrame, capacity: int = CAPACITY, n_buckets: int = BUCKETS) -> DataFrame:
    """`group_id, doc_id, piece_no, first_token, size` of every item of `sizes(doc_id, n_tokens)`.

    The sizes of a group sum to the capacity at most; an item is divided only if it alone is
    larger. Items of no tokens take no room and have no group (null). Repeated rows are items of
    their own; an empty table gives no rows. The driver sees the histogram (at most `capacity`
    rows) and the plan. Places within a bucket come from salted counts, so a bucket that holds a
    third of all items is spread over many tasks.
    """
    spark = sizes.sparkSession
    items = written(sized_pieces(sizes, capacity), "items")
    histogram = {r["size"]: r["count"] for r in items.where("size > 0").groupBy("size").count().collect()}
    if not histogram:
        return items.select(F.lit(None).cast("bigint").alias("group_id"), "doc_id", "piece_no", "first_token", "size")
    bounds = length_buckets(histogram, n_buckets)
    counts = np.zeros(len(bounds), dtype=np.int64)
    np.add.at(counts, np.searchsorted(bounds, list(histogram)), list(histogram.values()))
    plan = F.broadcast(_plan_table(spark, batch_plan(bounds, counts.tolist(), capacity)))

    # The bucket of a size is looked up in a list of one entry per possible size.
    of_size = np.searchsorted(bounds, np.arange(capacity + 1)).tolist()
    bucket = F.element_at(F.lit(of_size), F.col("size") + 1)
    placed = items.where("size > 0").withColumn("bucket", bucket.cast("int"))
    placed = placed.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(SALTS)).cast("int"))
    offsets = placed.groupBy("bucket", "salt").count()
    offsets = offsets.select(
        "bucket", "salt",
        (F.sum("count").over(W.partitionBy("bucket").orderBy("salt")) - F.col("count")).alias("before"),
    )
    inside = W.partitionBy("bucket", "salt").orderBy("size", "doc_id", "piece_no")
    placed = placed.withColumn("inside", F.row_number().over(inside) - 1)
    placed = placed.join(F.broadcast(offsets), ["bucket", "salt"]).withColumn("place", F.col("before") + F.col("inside"))
    found = placed.join(
        plan, (placed["bucket"] == plan["bucket"]) & F.col("place").between(F.col("first_place"), F.col("last_place"))
    )
    group = F.col("first_group") + F.floor((F.col("place") - F.col("first_place")) / F.col("per_group"))
    columns = ["group_id", "doc_id", "piece_no", "first_token", "size"]
    out = found.withColumn("group_id", group.cast("bigint")).select(*columns)
    none = items.where("size <= 0").withColumn("group_id", F.lit(None).cast("bigint")).select(*columns)
    return out.unionByName(none)


def _plan_table(spark: SparkSession, plan: list[tuple[int, int, int, int, int]]) -> DataFrame:
    return spark.createDataFrame(plan, PLAN_SCHEMA)


def packed_texts(
    documents: DataFrame, capacity: int = CAPACITY, n_buckets: int = BUCKETS, tokenizer_dir: str = TOKENIZER_DIR
) -> DataFrame:
    """`packed` over the texts of `documents(doc_id, text)`, sized in tokens."""
    return packed(token_counts(documents, tokenizer_dir=tokenizer_dir), capacity, n_buckets)

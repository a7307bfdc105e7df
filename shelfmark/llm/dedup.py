"""Deduplicating deliveries against everything accepted before.

What is accepted lives in a store at a path: winnowed content fingerprints, the texts behind
them, and partitioned Bloom filters. Each delivery is one admission: its fingerprints are screened
against the filters, texts that pass are compared with the store's texts of about their size, pairs
that share enough are verified word by word, the order of delivery decides what is accepted, and
store and filters are extended by that. History is never framed or fingerprinted again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.boilerplate import article_texts
from shelfmark.llm.fingerprints import BAG, ONE_IN, WINNOW, described, within_distance, word_hashes
from shelfmark.operators.registry import content_key, current_documents, key_of
from shelfmark.session import BROADCAST_ROWS, exists, let_go, measured, new_path, save, scratch, small_or_not, written

#: Bloom filters: bits a fingerprint, words of 64 bits in a block; a fingerprint sets one bit in each word of its block.
BLOOM_BITS, BLOOM_WORDS = 12, 8
#: Near texts share a tenth of the fingerprints of the one that has fewer at least: at a distance of
#: exactly one word in ten they share 39 % in the mean, and no less than this in the trials of the tests.
COVERAGE = 0.10
#: Pairs for each of its fingerprints (in a cell: of its texts) that a delivery may give before leaders are settled first.
PAIRS_A_ROW = 100
#: Words in the texts of one block of a size class, and postings that are looked at together.
CELL_WORDS, POSTINGS = 6_000_000, 1_000_000
#: Documents and links that are settled in one task; beyond that they are settled in rounds.
TASK_ROWS = 200_000
#: Batches that come at once are admitted together until they have this share of what the store holds: an
#: admission has a cost of its own, so a hundred small ones in a row would cost more than their rows.
GATHER = 0.25

#: Fingerprints of a text that are tried before all others.
FIRST = 8

TEXT_SCHEMA = "doc string, text string, digest bigint, size int, fps array<bigint>, places array<int>, packed binary"
ORD = "struct<batch:int,time:bigint,doc:string>"
DOCUMENT_SCHEMA = "doc string, hash_key string, digest bigint, accepted boolean, repeats array<string>"


def articles(pages: DataFrame, registry: DataFrame) -> DataFrame:
    """TEXT_SCHEMA of every document with chunks: its article in order, without the page frame.

    Words ignore case, punctuation, line breaks and look-alike characters; each Chinese character
    is a word. The digest is null for an article without words. Only the lines of one document
    are ever in one row; they stay where their order was told.
    """
    return article_texts(pages, registry, with_fingerprints, TEXT_SCHEMA)


def with_fingerprints(docs: list[str], texts: list[str]) -> pa.RecordBatch:
    """TEXT_SCHEMA of some texts."""
    found = described(texts)
    digests, sizes, fps, places, packed = zip(*found) if found else ((), (), (), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(docs, pa.string()), pa.array(texts, pa.string()), pa.array(digests, pa.int64()), pa.array(sizes, pa.int32()),
         _lists(fps, np.int64), _lists(places, np.int32), pa.array(packed, pa.binary())],
        names=["doc", "text", "digest", "size", "fps", "places", "packed"],
    )


def _lists(values: tuple[np.ndarray, ...], kind: type) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*values, np.zeros(0, dtype=kind)]).astype(kind)))


def first_deliveries(batches: DataFrame) -> DataFrame:
    """`doc, batch_no, ord` of each document's first delivery; `ord` sorts as the deliveries came.

    Order is batch, time, then id. Nulls come last. Repeated deliveries count once.
    """
    order = F.struct(F.col("batch_no").isNull().alias("b0"), "batch_no", F.col("received_at").isNull().alias("r0"), "received_at")
    first = batches.select(key_of(F.col("document_id")).alias("doc"), order.alias("at")).where("doc is not null")
    first = first.groupBy("doc").agg(F.min("at").alias("at"))
    stamp = F.coalesce(F.unix_micros(F.col("at.received_at").cast("timestamp")), F.lit((1 << 63) - 1))
    ord_ = F.struct(F.coalesce("at.batch_no", F.lit(2147483647)).alias("batch"), stamp.alias("time"), F.col("doc").alias("doc"))
    return first.select("doc", F.col("at.batch_no").alias("batch_no"), ord_.alias("ord"))


def sketch(texts: DataFrame) -> DataFrame:
    """`fp, digest, place, n, size` of every fingerprint of `texts`."""
    rows = texts.select(F.explode(F.arrays_zip("fps", "places")).alias("f"), "digest", F.size("fps").alias("n"), "size")
    return rows.select(F.col("f.fps").alias("fp"), "digest", F.col("f.places").alias("place"), "n", "size")


class Store:
    """What has been accepted, as tables below one path that only grow; opening the path again continues it.

    documents: doc, hash_key, digest of all delivered documents, whether accepted, and the accepted ones of
    the same delivery it repeats. sketch: digest, size, fps, places, packed of each accepted text. texts: digest, text. blooms: bits, block, w0 ... w7, a filter of 2 ** bits blocks for each delivery. Each delivery
    adds a folder to every table and, when all are there, its row to `deliveries`; what a lost driver
    left half written has no row, isn't read, and is written anew.
    """

    SCHEMAS = {
        "documents": DOCUMENT_SCHEMA,
        "sketch": "digest bigint, size int, fps array<bigint>, places array<int>, packed binary",
        "texts": "digest bigint, text string",
        "blooms": "block bigint, " + ", ".join(f"w{i} bigint" for i in range(BLOOM_WORDS)),
        "deliveries": "delivery int, bits int, n_fps bigint, n_documents bigint",
    }

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or new_path(spark, "store")
        self.deliveries: list[tuple[int, int, int, int]] = []
        if exists(spark, f"{self.path}/deliveries"):  # one row a delivery
            rows = spark.read.schema(self.SCHEMAS["deliveries"]).parquet(f"{self.path}/deliveries").collect()
            self.deliveries = sorted(map(tuple, rows))

    def table(self, name: str, deliveries: list[int] | None = None) -> DataFrame:
        """The rows of a table, of all deliveries or of those given."""
        names = [d for d, *_ in self.deliveries] if deliveries is None else deliveries
        if not names:
            return self.spark.createDataFrame([], self.SCHEMAS[name])
        return self.spark.read.schema(self.SCHEMAS[name]).parquet(*[f"{self.path}/{name}/delivery={d}" for d in names])

    def add(self, name: str, delivery: int, rows: DataFrame) -> None:
        save(rows.write.mode("overwrite"), self.spark, f"{self.path}/{name}/delivery={delivery}")

    def next(self) -> int:
        return max((d for d, *_ in self.deliveries), default=0) + 1

    def accepted(self) -> DataFrame:
        """The accepted documents, to be joined by broadcast if there are few."""
        known = self.table("documents").where("accepted")
        return F.broadcast(known) if self.n_documents() <= BROADCAST_ROWS else known

    def n_documents(self) -> int:
        return sum(d[3] for d in self.deliveries)

    def extend(self, number: int, n_documents: int, taken: DataFrame, texts: DataFrame) -> None:
        """Close a delivery whose documents are added already: its accepted texts, `taken(digest)` of `texts`."""
        # Of each text one document at most is accepted.
        taken = taken.where("digest is not null").select("digest")
        texts = texts.join(F.broadcast(taken) if n_documents <= BROADCAST_ROWS else taken, "digest", "left_semi")
        self.add("texts", number, texts.select("digest", "text"))
        seen = Observation()
        kept = [c.split()[0] for c in self.SCHEMAS["sketch"].split(", ") if c.split()[0] in texts.columns]
        self.add("sketch", number, texts.select(*kept).observe(seen, F.sum(F.size("fps")).alias("n_fps")))
        n_fps = (seen.get or {}).get("n_fps") or 0
        bits = max(0, math.ceil(math.log2(max(1, n_fps * BLOOM_BITS / (64 * BLOOM_WORDS)))))
        self.add("blooms", number, bloom_filter(self.table("sketch", [number]).select(F.explode("fps").alias("fp")), bits))
        row = (number, bits, n_fps, n_documents)
        told = self.spark.range(1).select(*[F.lit(v).cast(t.split()[1]).alias(t.split()[0]) for v, t in zip(row, self.SCHEMAS["deliveries"].split(", "))])
        save(told.coalesce(1).write.mode("append"), self.spark, f"{self.path}/deliveries")
        self.deliveries.append(row)


def _block(bits: int) -> F.Column:
    return F.shiftrightunsigned(F.xxhash64("fp"), 64 - bits) if bits else F.lit(0).cast("bigint")


def _masks() -> list[F.Column]:
    """The bit that a fingerprint sets in each word of its block."""
    return [F.expr(f"shiftleft(1L, cast(shiftrightunsigned(xxhash64(fp, {i // 4}), {6 * (i % 4)}) & 63 as int))") for i in range(BLOOM_WORDS)]


def bloom_filter(sketch: DataFrame, bits: int) -> DataFrame:
    """`block, w0 ... w7`: a filter of 2 ** bits blocks over the fingerprints of a sketch, partitioned by block."""
    masks = [m.alias(f"w{i}") for i, m in enumerate(_masks())]
    rows = sketch.select(_block(bits).alias("block"), *masks)
    return rows.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(BLOOM_WORDS)])


def screened(fps: DataFrame, store: Store, key: str = "fp") -> DataFrame:
    """`fp` of `fps(fp)` that some filter of the store may hold (no false negatives), or another `key` of such rows.

    Filters of one size are read together, so the fingerprints are tried once for each size, of which
    there are as many as the deliveries differ in powers of two.
    """
    parts = []
    for bits in sorted({b for _, b, n, *_ in store.deliveries if n}):
        of_size = [(d, n) for d, b, n, *_ in store.deliveries if b == bits and n]
        blooms = store.table("blooms", [d for d, _ in of_size])
        # At most 2 ** bits blocks a delivery, known from the store's own count.
        blooms = F.broadcast(blooms) if len(of_size) << bits <= TASK_ROWS else blooms
        probe = fps.select(key, _block(bits).alias("block"), *[m.alias(f"m{i}") for i, m in enumerate(_masks())])
        held = reduce(lambda a, b: a & b, [F.col(f"w{i}").bitwiseAND(F.col(f"m{i}")) == F.col(f"m{i}") for i in range(BLOOM_WORDS)])
        parts.append(probe.join(blooms, "block").where(held).select(key))
    if not parts:
        return fps.where("false").select(key)
    return reduce(DataFrame.unionByName, parts).distinct()


@cache
def size_classes(most: int) -> np.ndarray:
    """Where classes of sizes begin, up to `most`: near texts stand in one class or in two that follow each other."""
    bounds = [1]
    while bounds[-1] <= most:
        n = bounds[-1]
        n += (n - 1) // (ONE_IN - 1)  # the first whose nearest shorter texts all reach the last bound
        while n - n // ONE_IN < bounds[-1]:
            n += 1
        bounds.append(max(n, bounds[-1] + 1))
    return np.array(bounds)


def class_of(sizes: np.ndarray | list[int]) -> np.ndarray:
    most = int(max(sizes, default=1))
    return np.searchsorted(size_classes(1 << most.bit_length()), sizes, "right")


CELL_SCHEMA = "cell bigint, side int, home boolean, old boolean, digest bigint, size int, packed binary"
CELL_TYPES = [pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.int64(), pa.int32(), pa.binary()]


def in_cells(texts: DataFrame, blocks: dict[int, int]) -> DataFrame:
    """CELL_SCHEMA of `texts(digest, size, packed, old)`: each text in the cells of its size class and of the next.

    A cell is a class, or two of its `blocks` where it is too large for a task; classes without blocks are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, sizes, packed, old = (batch.column(i).to_pylist() for i in range(4))
            rows = []
            for k, c in enumerate(class_of(sizes).tolist()):
                told = (old[k], digests[k], sizes[k], packed[k])
                for home, where in ((True, c), (False, c + 1)):
                    n = blocks.get(where, 0)
                    own = digests[k] % max(n, 1)
                    rows += [((where << 40) + (min(own, j) << 20) + max(own, j), int(own > j), home, *told) for j in range(n)]
            columns = zip(*rows) if rows else [()] * len(CELL_TYPES)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, CELL_TYPES)], names=[c.split()[0] for c in CELL_SCHEMA.split(", ")])

    return texts.select("digest", "size", "packed", "old").mapInArrow(run, CELL_SCHEMA)


def sharing_in_cell(cell: pa.Table, pairs_a_text: float) -> pa.Table:
    """`x, y`: the pairs of one cell that share COVERAGE of their fingerprints at nearly the same place and whose bags
    differ by no more words than near texts do; one pair of nulls if there are more than `pairs_a_text` for each new text.

    Of each text a few of the commonest fingerprints, half of the least share, are not looked up, and pairs need
    so many less. Only pairs with a new text, and of two blocks in a cell only those across them, are told.
    """
    key, side, home, old, digest, size = (cell.column(i).to_numpy() for i in range(6))
    packed = cell.column(6).to_pylist()
    n = np.array([(len(p) - BAG) // 6 for p in packed], dtype=np.int64)
    rank = np.lexsort((digest, n))
    side, home, old, digest, size, n = (v[rank] for v in (side, home, old, digest, size, n))
    packed = [packed[k] for k in rank]
    bag = np.frombuffer(b"".join([p[:BAG] for p in packed]), dtype=np.uint8).reshape(-1, BAG)
    fp = np.frombuffer(b"".join([p[BAG : BAG + 4 * m] for p, m in zip(packed, n.tolist())]), dtype=np.uint32).astype(np.uint64)
    place = np.frombuffer(b"".join([p[BAG + 4 * m :] for p, m in zip(packed, n.tolist())]), dtype=np.uint16).astype(np.int32)
    across = ((int(key[0]) >> 20) ^ int(key[0])) & 0xFFFFF
    owner = np.repeat(np.arange(len(n)), n)
    # A pair is looked for from the text with fewer fingerprints; ones of the store look for new ones only.
    order = np.argsort((fp << np.uint64(32)) | owner.astype(np.uint64))
    fp, owner, place = fp[order], owner[order], place[order]
    is_old = old[owner]
    fresh, n_new = np.flatnonzero(~is_old), np.cumsum(~is_old)
    # Where the entries of a fingerprint end, told for each of them.
    runs = np.flatnonzero(np.append(fp[1:] != fp[:-1], True)[: len(fp)]) + 1
    ends = np.repeat(runs, np.diff(runs, prepend=0))
    begin = np.where(is_old, n_new, np.arange(1, len(fp) + 1))
    hits = np.where(is_old, n_new[ends - 1], ends) - begin
    skipped = (n * (COVERAGE / 2)).astype(np.int64)
    met = np.flatnonzero(hits > 0)
    met = met[np.lexsort((-hits[met], owner[met]))]  # the entries of each text that meet others, commonest first
    starts = np.searchsorted(owner[met], np.arange(len(n)))
    use = met[np.arange(len(met)) - starts[owner[met]] >= skipped[owner[met]]]
    found, total = [], 0
    limit = pairs_a_text * int((~old).sum())
    texts = owner[use]
    looked = np.cumsum(np.bincount(texts, hits[use], len(n)))
    last = 0
    while last < len(n):  # whole texts at a time, so that counts are whole
        first, last = last, max(last + 1, int(np.searchsorted(looked, (looked[last - 1] if last else 0) + POSTINGS, "right")))
        e = use[slice(*np.searchsorted(texts, [first, last]))]
        times = hits[e]
        to = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times - begin[e], times)
        e = np.repeat(e, times)
        if len(fresh):
            to = np.where(is_old[e], fresh[np.minimum(to, len(fresh) - 1)], to)
        x, y = owner[e], owner[to]
        most = np.maximum(size[x], size[y]) // ONE_IN
        px, py = place[e], place[to]
        ok = (np.abs(size[x] - size[y]) <= most) & ((np.abs(px - py) <= most + WINNOW) | (np.maximum(px, py) == 65535))
        pair, shared = np.unique(x[ok] * len(n) + y[ok], return_counts=True)
        x, y = pair // len(n), pair % len(n)
        ok = (shared >= COVERAGE * n[x] - skipped[x]) & (home[x] | home[y]) & ~(old[x] & old[y]) & (digest[x] != digest[y])
        if across:
            ok &= side[x] != side[y]
        x, y = x[ok], y[ok]
        # A word that is replaced leaves one count and enters another.
        gap = bag[x].astype(np.int16) - bag[y]
        ok = np.maximum(np.maximum(gap, 0).sum(1), np.maximum(-gap, 0).sum(1)) <= np.maximum(size[x], size[y]) // ONE_IN
        x, y = x[ok], y[ok]
        total += len(x)
        if total > limit:
            return pa.table({"x": pa.array([None], pa.int64()), "y": pa.array([None], pa.int64())})
        found.append((digest[x], digest[y]))
    x, y = (np.concatenate(v) if found else np.zeros(0, dtype=np.int64) for v in (zip(*found) if found else ((), ())))
    return pa.table({"x": pa.array(x, pa.int64()), "y": pa.array(y, pa.int64())})


def held_texts(texts: DataFrame, store: Store) -> DataFrame:
    """`digest` of the texts with a fingerprint that some filter of the store may hold; all fingerprints are
    tried only where none of the first FIRST is held."""
    tried = lambda rows, fps: screened(rows.select("digest", F.explode(fps).alias("fp")), store, "digest")
    first = small_or_not(tried(texts, F.slice("fps", 1, FIRST)), "first")
    rest = tried(texts.join(first, "digest", "left_anti"), F.col("fps"))
    return small_or_not(first.unionByName(rest), "known")


def sharing_pairs(x: DataFrame, y: DataFrame, once: bool = False) -> DataFrame:
    """`x, y`: texts of `x` and other texts of `y` (fp, digest, place, n, size) that share COVERAGE of their fingerprints.

    Near texts differ in size by one word in ONE_IN at most, and no place they share moves further.
    With `once`, pairs of two texts that `x` holds both (`old` is false) come in one order only.
    """
    side = lambda rows, k, *more: rows.select("fp", *more, *[F.col(c).alias(f"{c}_{k}") for c in ("digest", "place", "n", "size")])
    most = F.floor(F.greatest("size_x", "size_y") / ONE_IN)
    near = F.abs(F.col("place_x") - F.col("place_y")) <= most + WINNOW
    close = (F.abs(F.col("size_x") - F.col("size_y")) <= most) & (near | (F.least("place_x", "place_y") < 0))
    other = F.expr("digest_x > digest_y or (old and digest_x != digest_y)") if once else F.col("digest_x") != F.col("digest_y")
    hits = side(x, "x").join(side(y, "y", *["old"] * once), "fp").where(close & other)
    need = COVERAGE * F.least("n_x", "n_y")
    hits = hits.groupBy(F.col("digest_x").alias("x"), F.col("digest_y").alias("y")).agg(F.count("*").alias("n"), F.max(need).alias("need"))
    return hits.where("n >= need").select("x", "y")


def near_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs of texts (`digest, text`) that differ in at most one word in ONE_IN, of the longer of the two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                words, at = word_hashes([a, b])
                a, b = words[: at[1]], words[at[1] :]
                keep.append(within_distance(a, b, max(len(a), len(b)) // ONE_IN))
            found = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([found.column(0), found.column(1)], names=["x", "y"])

    a, b = (texts.select(F.col("digest").alias(k), F.col("text").alias(f"t{k}")) for k in "xy")
    return pairs.join(a, "x").join(b, "y").select("x", "y", "tx", "ty").mapInArrow(run, "x bigint, y bigint")


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct()


def near_in_delivery(live: DataFrame, order: DataFrame, texts: DataFrame, pair_limit: float) -> list[DataFrame]:
    """Near pairs among the texts of one delivery, given its fingerprints that several of them hold
    (`fp, digest, place, n, size`) and the `order(digest, ord)`, where these would give more pairs than `pair_limit`.

    A text none of whose predecessors can be near it leads; texts near a leader drop out, since
    they cannot be accepted, and are compared with the others' leaders only. Families of
    near-copies thus cost their size, not its square. Once what is left gives few pairs, or a
    round settles less than a tenth, the rest is compared pair by pair, so no pair that matters
    is lost: missing are pairs of two texts that both dropped out.
    """
    near, open_, kept, dropped = [], live, None, None
    while True:
        counts = open_.groupBy("fp").count()
        if (counts.agg(F.sum(F.expr("count * (count - 1) / 2"))).first()[0] or 0) <= pair_limit:
            break
        heads = open_.join(order, "digest").groupBy("fp").agg(F.min(F.struct("ord", "digest")).alias("head")).select("fp", F.col("head.digest").alias("head"))
        later = F.count_if(F.col("head") != F.col("digest"))
        lead = open_.join(heads, "fp").groupBy("digest").agg(later.alias("later"), F.max("n").alias("n"))
        lead = lead.where(F.col("later") < F.greatest(F.lit(1), F.col("n") * COVERAGE / 2))
        lead = written(lead.select("digest"), "leaders")
        leaders = open_.join(lead, "digest", "left_semi")
        found = written(near_texts(sharing_pairs(open_.join(lead, "digest", "left_anti"), leaders), texts), "near")
        found_late = found.join(order.withColumnsRenamed({"digest": "x", "ord": "ox"}), "x").join(order.withColumnsRenamed({"digest": "y", "ord": "oy"}), "y")
        out = written(found_late.where("ox > oy").select(F.col("x").alias("digest")).distinct(), "dropped")
        n_out = out.count()
        near.append(found)
        dropped = out if dropped is None else dropped.unionByName(out)
        kept = leaders if kept is None else kept.unionByName(leaders)
        before = open_.select("digest").distinct().count()
        open_ = written(open_.join(out, "digest", "left_anti").join(lead, "digest", "left_anti"), "open")
        if (n_out + lead.count()) * 10 < before:
            break
    near.append(near_texts(sharing_pairs(open_, open_.withColumn("old", F.lit(False)), once=True), texts))
    if dropped is not None:
        rest = live.join(dropped, "digest", "left_semi")
        near.append(near_texts(sharing_pairs(rest, kept.unionByName(open_)), texts))
    return near


def in_order(documents: pd.DataFrame, near: list[tuple[str, str]]) -> tuple[list[bool], list[list[str]]]:
    """(whether it is accepted, the accepted ones it repeats) of each document, in order of delivery.

    `held` documents repeat something accepted in an earlier delivery and are not accepted.
    """
    around: dict[str, list[str]] = {}
    for x, y in near:
        around.setdefault(x, []).append(y)
    hashes: dict[str, str] = {}
    texts: dict[str, str] = {}
    accepted, repeats = [], []
    for doc, h, d, held in zip(documents["doc"], documents["hash_key"], documents["digest"], documents["held"]):
        h, d = None if pd.isna(h) else h, None if pd.isna(d) else d
        found = {hashes.get(h), texts.get(d), *(texts.get(y) for y in around.get(d, ()))} - {None}
        free = not found and not held
        if free:
            if h is not None:
                hashes[h] = doc
            if d is not None:
                texts[d] = doc
        accepted.append(free)
        repeats.append(sorted(found))
    return accepted, repeats


def settled_at_once(delivery: DataFrame, near: DataFrame) -> DataFrame:
    """DOCUMENT_SCHEMA of a delivery `doc, ord, hash_key, digest, held` and its `near(x, y)` texts both ways,
    in one task; for a size that was checked before."""
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in delivery.schema]
    no_link = [F.lit(None).cast("bigint").alias(k) for k in "xy"]
    rows = delivery.select("*", *no_link).unionByName(near.select(*blank, "x", "y"))
    rows = rows.select(F.col("ord.batch").alias("batch"), F.col("ord.time").alias("time"), "doc", "hash_key", *[F.col(k).cast("string").alias(k) for k in ("digest", "x", "y")], "held", F.lit(0).alias("one"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        links = pdf[pdf["x"].notna()]
        docs = pdf[pdf["doc"].notna()].sort_values(["batch", "time", "doc"])
        accepted, repeats = in_order(docs, list(zip(links["x"], links["y"])))
        return docs.assign(accepted=accepted, repeats=repeats)[["doc", "hash_key", "digest", "accepted", "repeats"]]

    out = rows.groupBy("one").applyInPandas(run, DOCUMENT_SCHEMA.replace("digest bigint", "digest string"))
    return out.withColumn("digest", F.col("digest").cast("bigint"))


def settled_in_rounds(delivery: DataFrame, near: DataFrame) -> DataFrame:
    """The same over any number of documents.

    Of documents with the same hash and text only the first counts. A document is accepted once
    nothing before it that it repeats is accepted or open, drops out once something before it is
    accepted, and each round settles at least the earliest open one of every group, until none is
    open. Classes are aggregated to their first member, never listed.
    """
    open_ = delivery.where("not held").groupBy("hash_key", "digest", F.when(F.expr("hash_key is null and digest is null"), F.col("doc")).alias("alone"))
    open_ = open_.agg(F.min("ord").alias("ord")).select(F.col("ord.doc").alias("doc"), "ord", "hash_key", "digest")
    rounds, done = [], None
    while True:
        members = open_.withColumn("taken", F.lit(False))
        if done is not None:
            members = members.unionByName(done.withColumn("taken", F.lit(True)))
        first = lambda key: (
            members.where(F.col(key).isNotNull()).groupBy(key)  # noqa: B023
            .agg(F.min(F.when(F.col("taken"), F.col("ord"))).alias("t"), F.min(F.when(~F.col("taken"), F.col("ord"))).alias("o"))
        )
        by_text = first("digest")
        around = near.join(by_text.withColumnRenamed("digest", "y"), "y").groupBy("x").agg(F.min("t").alias("nt"), F.min("o").alias("no"))
        state = (
            open_.join(first("hash_key").withColumnsRenamed({"t": "ht", "o": "ho"}), "hash_key", "left")
            .join(by_text.withColumnsRenamed({"t": "tt", "o": "to"}), "digest", "left")
            .join(around.withColumnRenamed("x", "digest"), "digest", "left")
        )
        before = lambda *names: F.coalesce(F.least(*[F.col(n) for n in names]) < F.col("ord"), F.lit(False))
        verdict = F.when(before("ht", "tt", "nt"), "repeat").when(before("ho", "to", "no"), "open").otherwise("accepted")
        state = written(state.select("doc", "ord", "hash_key", "digest", verdict.alias("state")), "settled")
        took = state.where("state = 'accepted'").drop("state")
        rounds.append(state)
        done = took if done is None else done.unionByName(took)
        open_ = state.where("state = 'open'").drop("state")
        if open_.isEmpty():
            break
    rest = delivery.join(done.select("doc"), "doc", "left_anti")
    taken = [done.select(key, F.col("doc").alias("a"), F.col("ord").alias("oa")) for key in ("hash_key", "digest")]
    found = [
        rest.join(taken[0], "hash_key"), rest.join(taken[1], "digest"),
        rest.join(near, rest.digest == near.x).join(taken[1].withColumnRenamed("digest", "y"), "y"),
    ]
    found = reduce(DataFrame.unionByName, [f.select("doc", "ord", "a", "oa") for f in found])
    found = found.where("oa < ord").groupBy("doc").agg(F.array_sort(F.collect_set("a")).alias("repeats"))
    out = delivery.join(done.select("doc", F.lit(True).alias("accepted")), "doc", "left").join(found, "doc", "left")
    none = F.array().cast("array<string>")
    return out.select("doc", "hash_key", "digest", F.col("accepted").isNotNull().alias("accepted"), F.coalesce("repeats", none).alias("repeats"))


def candidates(new: DataFrame, known: DataFrame | None, store: Store, pairs_a_text: float) -> DataFrame:
    """`x, y`: what `sharing_in_cell` tells of new texts with each other and with the store's texts of the sizes
    that texts of `known(digest)` can be near to; other sizes of the store are not read."""
    told = new.select("digest", "size").where("size > 0")
    told = told.withColumn("held", F.lit(False)) if known is None else told.join(known.withColumn("held", F.lit(True)), "digest", "left")
    loads = told.groupBy("size").agg(F.count("*"), F.count_if("held")).collect()  # one row a size
    mine, held = {int(r[0]): r[1] for r in loads}, {int(r[0]): r[2] for r in loads if r[2]}
    reached = {int(c) + k for c in class_of(list(held)) for k in (-1, 0, 1)} if held else set()
    kept = ["digest", "size", "packed"]
    rows, words = new.where("size > 0").select(*kept, F.lit(False).alias("old")), dict(mine)
    if reached:
        bounds = size_classes(2 << max(held).bit_length()).tolist()
        low, high = bounds[max(0, min(reached) - 1)], bounds[min(max(reached), len(bounds) - 1)]
        theirs = store.table("sketch").where(F.col("size").between(low, high))
        for size, n in theirs.groupBy("size").count().collect():
            words[size] = words.get(size, 0) + n
        rows = rows.unionByName(theirs.select(*kept, F.lit(True).alias("old")))
    load: dict[int, int] = {}
    for size, c in zip(words, class_of(list(words)).tolist()):
        for where in (c, c + 1):
            load[where] = load.get(where, 0) + size * words[size]
    asked = {c + k for c in class_of(list(mine)).tolist() for k in (0, 1)}
    blocks = {c: -(-n // CELL_WORDS) for c, n in load.items() if c in asked}
    return in_cells(rows, blocks).groupBy("cell").applyInArrow(lambda cell: sharing_in_cell(cell, pairs_a_text), "x bigint, y bigint")


def near_by_leaders(new: DataFrame, texts: DataFrame, every: DataFrame, store: Store, pairs_a_row: float) -> tuple[DataFrame, DataFrame]:
    """The near pairs of an admission by joins of single fingerprints, for families of near-copies; and the table they are read from."""
    rows = sketch(new)
    counted = rows.groupBy("fp").count()
    known = screened(counted.select("fp"), store).withColumn("held", F.lit(True))
    live = counted.join(known, "fp", "left").where("count > 1 or held").withColumn("known", F.col("held").isNotNull()).drop("held")
    # Fingerprints that something else may hold.
    live, seen = measured(rows.join(live, "fp"), "live")
    parts = near_in_delivery(live.where("count > 1").drop("known", "count"), texts.select("digest", "ord"), every, pairs_a_row * seen["n"])
    if store.deliveries:
        looked_up = sketch(store.table("sketch")).join(live.where("known").select("fp").distinct(), "fp", "left_semi").withColumn("old", F.lit(True))
        parts.append(near_texts(sharing_pairs(live.where("known"), looked_up), every))
    return reduce(DataFrame.unionByName, parts), live


def admit(delivery: DataFrame, texts: DataFrame, store: Store, n_documents: int, pairs_a_row: float = PAIRS_A_ROW, task_rows: int = TASK_ROWS) -> DataFrame:
    """Pairs of a delivery of `n_documents` new documents; the store is extended by those that are accepted.

    `delivery(doc, ord, hash_key, digest)` are the new documents and `texts` (TEXT_SCHEMA and `ord`)
    their distinct texts. Pairs are `document_id_a, document_id_b`, smaller first: a document and the
    accepted document before it that it repeats, by hash or by text.
    """
    empty, number = not store.deliveries, store.next()
    old = store.accepted()
    new = texts if empty else texts.join(old.select("digest"), "digest", "left_anti")
    every = new.select("digest", "text").unionByName(store.table("texts"))
    # Texts without a fingerprint that the store may hold are not compared with it.
    known = None if empty else held_texts(new, store)
    pairs, seen = measured(candidates(new, known, store, pairs_a_row), "pairs", over=F.count_if(F.col("x").isNull()))
    if not seen.get("over"):
        if seen["n"] <= BROADCAST_ROWS:
            wanted = pairs.select(F.explode(F.array("x", "y")).alias("digest")).distinct()
            every = every.join(F.broadcast(wanted), "digest", "left_semi")
        near, live = near_texts(pairs, every), None
    else:
        near, live = near_by_leaders(new, texts, every, store, pairs_a_row)
    near, seen = measured(both_ways(near), "near")

    if empty:
        held, delivery = None, delivery.withColumn("held", F.lit(False))
    else:
        # Whatever repeats a document accepted in an earlier delivery is turned down at once.
        own = F.array_compact(F.array(F.concat(F.lit("h"), "hash_key"), F.concat(F.lit("d"), F.col("digest").cast("string"))))
        keys = old.select(F.explode(own).alias("key"), F.col("doc").alias("a"))
        mine = delivery.select("doc", F.explode(own).alias("key"))
        mine = mine.unionByName(delivery.join(near, delivery.digest == near.x).select("doc", F.concat(F.lit("d"), F.col("y").cast("string")).alias("key")))
        held = written(mine.join(keys, "key").select("doc", "a").distinct(), "held")
        delivery = delivery.join(held.select("doc", F.lit(True).alias("held")).distinct(), "doc", "left").withColumn("held", F.col("held").isNotNull())
    settle = settled_at_once if n_documents + seen["n"] <= task_rows else settled_in_rounds
    store.add("documents", number, settle(delivery, near))
    told = store.table("documents", [number])
    store.extend(number, n_documents, told.where("accepted"), texts)
    found = told.select("doc", F.explode("repeats").alias("a"))
    found = found if held is None else found.unionByName(held)
    let_go(pairs, near, *[t for t in (known, live) if t is not None])
    # The cleaner frees what this delivery broadcast once the driver's references are collected.
    store.spark._jvm.System.gc()
    return found.select(F.least("doc", "a").alias("document_id_a"), F.greatest("doc", "a").alias("document_id_b"))


def gathered(counts: list[tuple[int, int]], known: int, gather: float) -> dict[int, int]:
    """Which admission each batch comes in: a batch of its own if it has `gather` of the documents before it, else
    with the next ones until they have. With 0, each batch is an admission."""
    out, number, held = {}, 0, 0
    for batch, n in sorted(counts):
        out[batch] = number
        held += n
        if held >= gather * known:
            known, number, held = known + held, number + 1, 0
    return out


def repeated_deliveries(
    batches: DataFrame, registry: DataFrame, pages: DataFrame, store: Store | None = None, gather: float = GATHER, pairs_a_row: float = PAIRS_A_ROW, task_rows: int = TASK_ROWS
) -> DataFrame:
    """`document_id_a, document_id_b` over all deliveries, admitted in order; the result is the same for any `gather`.

    `store` continues an earlier one, whose documents take no part again. Documents without
    delivery take no part; documents without registry row have no hash; documents without
    article text are compared by hash only. Empty tables give no rows. The pages are framed once,
    as they come in (operator 5); an admission reads the articles of its own batches.
    """
    spark = batches.sparkSession
    store = store or Store(spark)
    deliveries = first_deliveries(batches)
    if store.deliveries:  # what was delivered to the store before
        deliveries = deliveries.join(store.table("documents").select("doc"), "doc", "left_anti")
    hashes = current_documents(registry, "content_hash").select(F.col("document_id").alias("doc"), content_key(F.col("content_hash")).alias("hash_key"))
    documents = small_or_not(deliveries.join(hashes, "doc", "left"), "documents")
    counts = documents.groupBy(F.col("ord.batch")).count().collect()  # one row a batch
    admissions = gathered([tuple(r) for r in counts], store.n_documents(), gather)
    if not admissions:
        return spark.createDataFrame([], "document_id_a string, document_id_b string")
    places = F.create_map(*[F.lit(x) for pair in admissions.items() for x in pair])
    with scratch(spark) as keep:  # the lines and their statistics go once the articles are written
        told = articles(pages, registry).join(documents, "doc").withColumn("admission", places[F.col("ord.batch")])
        told = keep(written(told.select("doc", "ord", "hash_key", "digest", "text", "size", "fps", "places", "packed", "admission"), "articles", ["admission"], "zstd"))
    # One row a distinct text of an admission, with its first delivery.
    firsts = told.where("digest is not null").groupBy("admission", "digest").agg(F.min("ord").alias("ord"))
    firsts = written(firsts.select(F.col("ord.doc").alias("doc"), "admission"), "firsts", ["admission"])
    plain = documents.join(told.select("doc"), "doc", "left_anti").withColumn("admission", places[F.col("ord.batch")]).withColumn("digest", F.lit(None).cast("bigint"))
    plain = written(plain.select("doc", "ord", "hash_key", "digest", "admission"), "plain", ["admission"])
    out = []
    for number in sorted(set(admissions.values())):
        n_documents = sum(n for batch, n in counts if admissions[batch] == number)
        mine = told.where(F.col("admission") == number).drop("admission")
        picked = firsts.where(F.col("admission") == number).select("doc")
        texts = mine.join(F.broadcast(picked) if n_documents <= BROADCAST_ROWS else picked, "doc", "left_semi")
        delivery = mine.select("doc", "ord", "hash_key", "digest").unionByName(plain.where(F.col("admission") == number).drop("admission"))
        out.append(admit(delivery, texts.select("digest", "ord", "text", "size", "fps", "places", "packed"), store, n_documents, pairs_a_row, task_rows))
    return reduce(DataFrame.unionByName, out)

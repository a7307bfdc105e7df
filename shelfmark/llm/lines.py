"""Lines repeated across one site's documents.

Text is cut by content: a rolling hash over the characters sets landmarks, so that the same
words give the same chunks wherever they stand; the end of a line closes a chunk too, since
lines are what is removed. Chunks are counted by site and document; a line goes if repeated
chunks cover it, and, where it has several, if an exact count of that line agrees.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.operators.registry import document_of, document_sites
from shelfmark.session import written

#: A line is excessive from so many documents of a site on.
MIN_DOCUMENTS = 8
#: Characters of the rolling window; a landmark on average every 2 ** LANDMARK_BITS characters.
WINDOW, LANDMARK_BITS = 12, 6

# Punctuation that may close a line without making it another one.
CLOSING = ".!?:;,。…"

_NOISE = re.compile(r"[\s\d]+")
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def line_form(line: str) -> str:
    """What two equal lines share: no letter case, digits, white space or closing punctuation."""
    return _NOISE.sub("", line.lower()).rstrip(CLOSING)


def content_chunks(forms: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line of each chunk, hash of each chunk, hash of each line) of line forms, none of them empty."""
    lengths = np.fromiter(map(len, forms), np.int64, len(forms))
    ends = np.cumsum(lengths)
    starts = ends - lengths
    codes = np.frombuffer("".join(forms).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    n = len(codes)
    with np.errstate(over="ignore"):
        mixed = (codes + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        powers = np.full(n + 1, _BASE, dtype=np.uint64)
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        inverse = np.full(n + 1, np.uint64(pow(int(_BASE), -1, 1 << 64)), dtype=np.uint64)
        inverse[0] = 1
        inverse = np.multiply.accumulate(inverse)
        prefix = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(mixed * powers[:n], out=prefix[1:])
        # The rolling hash of the window that ends at each character, within its line only.
        rolling = np.zeros(n, dtype=np.uint64)
        if n >= WINDOW:
            at = np.arange(n - WINDOW + 1)
            rolling[WINDOW - 1 :] = (prefix[WINDOW:] - prefix[: n - WINDOW + 1]) * inverse[at]
        rolling ^= rolling >> np.uint64(29)
        rolling *= np.uint64(0xBF58476D1CE4E5B9)
        line_at = np.repeat(np.arange(len(forms)), lengths)
        inside = np.arange(n) - starts[line_at] >= WINDOW - 1
        landmark = inside & (rolling >> np.uint64(64 - LANDMARK_BITS) == 0)
        landmark[ends - 1] = True
        chunk_ends = np.flatnonzero(landmark) + 1
        chunk_starts = np.concatenate(([0], chunk_ends[:-1]))
        hashes = (prefix[chunk_ends] - prefix[chunk_starts]) * inverse[chunk_starts]
        hashes ^= hashes >> np.uint64(31)
        # A chunk that is a whole line differs from the same words within one.
        alone = np.bincount(line_at[chunk_starts], minlength=len(forms))[line_at[chunk_starts]] == 1
        hashes[alone] ^= np.uint64(0x94D049BB133111EB)
        whole = (prefix[ends] - prefix[starts]) * inverse[starts]
        whole ^= lengths.astype(np.uint64) << np.uint64(48)
    return line_at[chunk_starts], hashes.view(np.int64), whole.view(np.int64)


def chunked_lines(pages: DataFrame) -> DataFrame:
    """`node_id, doc, line_no, line_key, chunks` of every line with letters in `pages(node_id, text)`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms, row, number = [], [], []
            for r, text in enumerate(batch.column(2).to_pylist()):
                for k, line in enumerate((text or "").split("\n"), 1):
                    if form := line_form(line):
                        forms.append(form)
                        row.append(r)
                        number.append(k)
            if not forms:
                continue
            of_line, hashes, keys = content_chunks(forms)
            offsets = np.concatenate((np.searchsorted(of_line, np.arange(len(forms))), [len(hashes)]))
            at = pa.array(row, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(at),
                    batch.column(1).take(at),
                    pa.array(number, pa.int32()),
                    pa.array(keys, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(hashes, pa.int64())),
                ],
                names=["node_id", "doc", "line_no", "line_key", "chunks"],
            )

    picked = pages.select(
        "node_id", document_of(F.col("node_id")).alias("doc"), F.col("text").cast("string").alias("text")
    )
    return picked.mapInArrow(run, "node_id string, doc string, line_no int, line_key bigint, chunks array<bigint>")


def repeated_lines(pages: DataFrame, registry: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """`node_id, line_no`: each line that stands in at least `min_documents` documents of its site.

    Documents without a URL have no site and no cases; null and empty texts have no lines;
    doubled rows give one case. Only hashes travel: chunks are counted as (site, chunk) after
    partial aggregation, a hot site or line therefore never gathers its rows in one task, and
    AQE splits what is left of skew in the joins. Line keys are 64-bit hashes with the length
    mixed in; two different lines of one site meet in one key with odds of about n^2 / 2^65.
    """
    sites = document_sites(registry).where("site is not null")
    sites = sites.select("document_id", F.xxhash64("site").alias("site"))
    lines = chunked_lines(pages)
    placed = lines.join(sites, lines.doc == sites.document_id).select(
        "node_id", "line_no", "chunks", "site", F.xxhash64("doc").alias("doc"), F.xxhash64("site", "line_key").alias("line")
    )
    placed = written(placed, "lines")
    chunk_docs = placed.select("doc", F.explode("chunks").alias("chunk"), "site")
    often = (
        chunk_docs.select(F.xxhash64("site", "chunk").alias("chunk_key"), "doc")
        .distinct()
        .groupBy("chunk_key")
        .count()
        .where(F.col("count") >= min_documents)
        .select("chunk_key")
    )
    # A line of one chunk is repeated if its chunk is. Of longer ones all chunks must be, which leaves
    # lines put together of repeated parts; an exact count of those lines decides.
    n = F.size("chunks")
    one = placed.where(n == 1).select("node_id", "line_no", F.xxhash64("site", F.col("chunks")[0]).alias("chunk_key"))
    one = one.join(often, "chunk_key", "left_semi").select("node_id", "line_no")
    parts = placed.where(n > 1).select("node_id", "line_no", "doc", "line", n.alias("n"), F.posexplode("chunks").alias("at", "chunk"), "site")
    parts = parts.select("node_id", "line_no", "doc", "line", "n", "at", F.xxhash64("site", "chunk").alias("chunk_key")).join(often, "chunk_key", "left_semi")
    covered = parts.groupBy("node_id", "line_no", "doc", "line").agg(F.count_distinct("at").alias("covered"), F.max("n").alias("n")).where("covered = n")
    counted = covered.select("line", "doc").distinct().groupBy("line").count().where(F.col("count") >= min_documents)
    long = covered.join(counted.select("line"), "line", "left_semi").select("node_id", "line_no")
    return one.unionByName(long).distinct()


def without_repeated_lines(pages: DataFrame, repeated: DataFrame) -> DataFrame:
    """`node_id, text` of every page text with its repeated lines removed; a text may become empty."""
    cut = repeated.groupBy("node_id").agg(F.collect_set("line_no").alias("cut"))
    texts = pages.groupBy("node_id").agg(F.min("text").alias("text"))
    kept = F.expr(
        "array_join(filter(transform(split(text, '\\n'), (l, i) -> struct(l, i + 1 as n)), "
        "x -> not array_contains(coalesce(cut, array()), x.n)).l, '\\n')"
    )
    return texts.join(cut, "node_id", "left").select("node_id", kept.alias("text"))

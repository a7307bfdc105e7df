"""Splitting long texts at natural boundaries, by content-defined chunking.

A rolling hash over the tokens sets landmarks that depend on a few tokens only; each cut snaps
to the natural boundary nearest to its landmark, between a least and a greatest size. After an
edit the landmarks behind it are the same, so only neighbouring pieces change.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from shelfmark.llm.bpe import TOKENIZER_DIR, BytePairEncoder, encoder

MAX_TOKENS, OVERLAP = 512, 64
#: Fresh tokens of a piece at least, where the text has boundaries there.
MIN_FRESH = 160
#: Tokens in the rolling window; a landmark on average every 2 ** LANDMARK_BITS tokens.
WINDOW, LANDMARK_BITS = 8, 7

# Natural boundaries from strong to weak: ends of paragraphs and lines, of sentences, of clauses, of words.
_BOUNDARIES = (
    re.compile(r"\n+"),
    re.compile(r"[.!?…]+[\"'”’)\]]*(?=\s)|[。！？]+[”’」』）]*"),
    re.compile(r"[;:,](?=\s)|[，；：、]"),
    re.compile(r"(?<=\S)(?=\s)"),
)
PIECE_SCHEMA = "piece_no int, first_token int, end_token int, n_tokens int, boundary string, text string"
LEVELS = ("word", "clause", "sentence", "line")


def boundary_levels(text: str, byte_at: np.ndarray, char_to_byte: np.ndarray) -> np.ndarray:
    """For each cut 0..n between tokens (at byte `byte_at`): 4 line, 3 sentence, 2 clause, 1 word, 0 none
    within a word, -1 within a character."""
    strength = np.zeros(int(char_to_byte[-1]) + 1, dtype=np.int8)
    strength -= 1
    strength[char_to_byte] = 0
    for level, pattern in zip((1, 2, 3, 4), reversed(_BOUNDARIES)):
        ends = [m.end() for m in pattern.finditer(text)]
        strength[char_to_byte[ends]] = level
    return strength[byte_at]


def landmarks(ids: np.ndarray) -> np.ndarray:
    """Cuts after which the rolling hash of the last WINDOW tokens has its low bits zero."""
    with np.errstate(over="ignore"):
        mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        rolling = np.zeros(max(len(ids) - WINDOW + 1, 0), dtype=np.uint64)
        for k in range(WINDOW if len(rolling) else 0):
            rolling = rolling * np.uint64(0xBF58476D1CE4E5B9) + mixed[k : k + len(rolling)]
        rolling ^= rolling >> np.uint64(31)
        rolling *= np.uint64(0x94D049BB133111EB)
    return np.flatnonzero(rolling >> np.uint64(64 - LANDMARK_BITS) == 0) + WINDOW


def cuts_of(levels: np.ndarray, marks: np.ndarray, n: int, max_tokens: int, overlap: int, min_fresh: int) -> list[int]:
    """Ends of the fresh parts of the pieces of a text of n tokens; the last is n."""
    ends: list[int] = []
    start = 0
    while n - start > (room := max_tokens - (overlap if ends else 0)):
        low, high = start + min(min_fresh, room), start + room
        # The strongest kind of boundary within the sizes; below the least size only if there is none.
        choice = np.zeros(0, dtype=np.int64)
        for a, b in ((low, high), (start + 1, low - 1)):
            window = levels[a : b + 1]
            if len(window) and (top := min(int(window.max()), 3)) >= 1:
                choice = np.flatnonzero(window >= top) + a
                break
        if not len(choice):
            inside = np.flatnonzero(levels[start + 1 : high + 1] >= 0)
            end = start + 1 + int(inside[-1]) if len(inside) else high
        else:
            k = np.searchsorted(marks, low)
            if k < len(marks) and marks[k] <= high:
                end = int(choice[np.argmin(np.abs(choice - marks[k]))])
            else:
                end = int(choice[-1])
        ends.append(end)
        start = end
    ends.append(n)
    return ends


def pieces_of(
    text: str, enc: BytePairEncoder, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP, min_fresh: int = MIN_FRESH
) -> list[tuple[int, int, int, str, str]]:
    """(first token, end token, tokens, boundary, text) of each piece of a text."""
    ids = np.array(enc.encode(text), dtype=np.int64)
    n = len(ids)
    if n <= max_tokens:
        return [(0, n, n, "end", text)]
    raw = text.encode("utf-8", "replace")
    byte_at = np.concatenate(([0], np.cumsum(enc.lengths[ids])))
    lead = np.frombuffer(raw, dtype=np.uint8)
    char_to_byte = np.append(np.flatnonzero((lead & 0xC0) != 0x80), len(raw))
    levels = boundary_levels(text, byte_at, char_to_byte)
    out, fresh = [], 0
    for end in cuts_of(levels, landmarks(ids), n, max_tokens, overlap, min_fresh):
        first = max(fresh - overlap, 0)
        a = char_to_byte[np.searchsorted(char_to_byte, byte_at[first])]  # a split character belongs to the piece before
        kind = "end" if end == n else LEVELS[levels[end] - 1] if levels[end] >= 1 else "none"
        out.append((first, end, end - first, kind, raw[a : byte_at[end]].decode("utf-8", "replace")))
        fresh = end
    return out


def split_texts(
    documents: DataFrame, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP, min_fresh: int = MIN_FRESH,
    keep_small: bool = False, tokenizer_dir: str = TOKENIZER_DIR,
) -> DataFrame:
    """`doc_id` and the pieces of every text of `documents(doc_id, text)` above `max_tokens` tokens.

    A piece has at most `max_tokens` tokens and, but for the first, begins with the last `overlap`
    tokens of the one before; the text of a piece starts at the first whole character. Cuts lie at
    the ends of lines or sentences, else clauses, else words, else between characters. Texts within
    the limit come out as one piece with `keep_small`, null and empty ones never. Repeated rows are
    split each. One pass without a shuffle.
    """
    if not 0 <= overlap < max_tokens:
        raise ValueError("the overlap must be smaller than the limit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_dir)
        for batch in batches:
            rows, columns = [], [[] for _ in range(6)]
            for r, text in enumerate(batch.column(1).to_pylist()):
                if not text or (not keep_small and len(text) * 4 <= max_tokens):
                    continue
                found = pieces_of(text, enc, max_tokens, overlap, min_fresh)
                if len(found) == 1 and not keep_small:
                    continue
                for k, (first, end, n, kind, piece) in enumerate(found):
                    rows.append(r)
                    for column, value in zip(columns, (k, first, end, n, kind, piece)):
                        column.append(value)
            kinds = [pa.int32()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int32())), *(pa.array(c, t) for c, t in zip(columns, kinds))],
                names=["doc_id", *(c.split()[0] for c in PIECE_SCHEMA.split(", "))],
            )

    key = documents.schema["doc_id"].dataType.simpleString()
    picked = documents.select("doc_id", documents["text"].cast("string").alias("text"))
    return picked.mapInArrow(run, f"doc_id {key}, {PIECE_SCHEMA}")

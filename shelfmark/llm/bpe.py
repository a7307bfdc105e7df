"""Encoding of a corpus with a public byte-level BPE vocabulary.

The bytes of a text are mapped to Latin-1 characters, so that an Aho-Corasick automaton of
the vocabulary finds the longest token at every position in one pass. The encoder takes the
longest match, steps back to shorter ones where two adjacent tokens could not both have come
out of the merges, and remembers which pairs of tokens go together. The ids are exactly those
of the merges by rank, in time linear in the text.
"""

from __future__ import annotations

import base64
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Folder of the vocabulary files; a parameter of every operator, never copied from there.
TOKENIZER_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"

#: The split of text before merging, a fixed value of the public vocabulary.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Pieces remembered by a worker; beyond that the memory is emptied and filled anew.
REMEMBERED_PIECES = 300_000

_encoders: dict[str, "BytePairEncoder"] = {}


class BytePairEncoder:
    """Ids of texts by the vocabulary in a file of base64 tokens and ranks."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, "rb") as f:
            self.ids = {base64.b64decode(t).decode("latin-1"): int(i) for t, i in map(bytes.split, f)}
        self.token = dict(zip(self.ids.values(), self.ids))
        self.length = {i: len(t) for t, i in self.ids.items()}
        self.lengths = np.zeros(max(self.length) + 1, dtype=np.int64)
        self.lengths[list(self.length)] = list(self.length.values())
        self.automaton = ahocorasick.Automaton()
        for t, i in self.ids.items():
            self.automaton.add_word(t, i)
        self.automaton.make_automaton()
        # A merge across two bytes gives a token that holds both: where no token does, text can be cut.
        joined = np.zeros(65536, dtype=bool)
        for t in self.ids:
            b = t.encode("latin-1")
            for x, y in zip(b, b[1:]):
                joined[x * 256 + y] = True
        self.joined = joined
        self.shorter = {i: self._prefix(t) for t, i in self.ids.items()}
        self.compatible: dict[tuple[int, int], bool] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self._find_parts()
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.atoms: dict[bytes, tuple[int, ...]] = {}
        self.exact = regex.compile(SPLIT_PATTERN).findall
        # The standard module is faster and splits alike wherever its classes agree.
        self.fast = re.compile(r" ?[^\W\d_]+|'(?:[stmd]|re|ve|ll)| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+").findall
        every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
        self.differing: set[str] = set()
        for exact, fast in ((r"\p{L}", r"[^\W\d_]"), (r"\p{N}", r"\d"), (r"\s", r"\s")):
            self.differing |= set(regex.findall(exact, every)) ^ set(re.findall(fast, every))

    def _prefix(self, t: str) -> int | None:
        for k in range(len(t) - 1, 0, -1):
            if (i := self.ids.get(t[:k])) is not None:
                return i
        return None

    def _find_parts(self) -> None:
        """The two tokens each token is merged from; a token of one byte is its own part."""
        for i, t in sorted(self.token.items()):
            self.parts[i] = (i, i)
            left = self.shorter[i]
            while left is not None:
                right = self.ids.get(t[self.length[left] :])
                if right is not None and left < i and right < i and self._goes(left, right):
                    self.parts[i] = (left, right)
                    break
                left = self.shorter[left]
        self.compatible.clear()

    def _goes(self, left: int, right: int) -> bool:
        """Whether merging the text of both gives just these two tokens."""
        key = (left, right)
        if (known := self.compatible.get(key)) is not None:
            return known
        ids, token, parts = self.ids, self.token, self.parts
        limit, answer = 1 << 30, True
        a, b = left, right
        while True:
            merged = ids.get(token[a] + token[b])
            if merged is not None and merged in parts and parts[merged] == (a, b) and merged < limit:
                answer = False
                break
            # Undo the later of the two merges, on the side next to the cut.
            if a > b:
                limit, a = a, parts[a][1]
                if a == limit:
                    limit, b = b + 1, parts[b][0]
                    if b + 1 == limit:
                        break
            else:
                limit, b = b + 1, parts[b][0]
                if b + 1 == limit:
                    limit, a = a, parts[a][1]
                    if a == limit:
                        break
        self.compatible[key] = answer
        return answer

    def _backtrack(self, t: str) -> tuple[int, ...]:
        """Ids of one piece given as Latin-1 text."""
        whole = self.ids.get(t)
        if whole is not None:
            return (whole,)
        n, length, shorter, goes = len(t), self.length, self.shorter, self._goes
        compatible = self.compatible
        longest = [0] * n
        for end, i in self.automaton.iter(t):
            longest[end + 1 - length[i]] = i  # ends ascend, so the longest comes last
        dead = bytearray(n + 1)
        out: list[int] = []
        at, nxt = 0, longest[0]
        while True:
            token = nxt
            last = out[-1] if out else -1
            while True:
                end = at + length[token]
                if last < 0:
                    fits = True
                elif (fits := compatible.get((last, token))) is None:
                    fits = goes(last, token)
                if fits and not dead[end]:
                    out.append(token)
                    at = end
                    if at == n:
                        return tuple(out)
                    nxt = longest[at]
                    break
                token = shorter[token]
                if token is None:
                    dead[at] = 1
                    out.pop()
                    at -= length[last]
                    nxt = last
                    break

    def _piece(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode("utf-8", "replace")
        if len(raw) > 24:
            b = np.frombuffer(raw, dtype=np.uint8).astype(np.int32)
            cuts = np.flatnonzero(~self.joined[b[:-1] * 256 + b[1:]]) + 1
            if len(cuts):
                out: list[int] = []
                atoms, start = self.atoms, 0
                for end in [*cuts.tolist(), len(raw)]:
                    part = raw[start:end]
                    known = atoms.get(part)
                    if known is None:
                        known = self._backtrack(part.decode("latin-1"))
                        if len(part) <= 24:
                            atoms[part] = known
                    out += known
                    start = end
                return tuple(out)
        return self._backtrack(raw.decode("latin-1"))

    def _forget(self) -> None:
        self.pieces.clear()
        self.atoms.clear()
        self.compatible.clear()

    def split(self, text: str) -> list[str]:
        return self.fast(text) if self.differing.isdisjoint(set(text)) else self.exact(text)

    def encode(self, text: str) -> list[int]:
        """Ids of a text; no string in it counts as a special token."""
        out: list[int] = []
        pieces = self.pieces
        if len(pieces) + len(self.atoms) > REMEMBERED_PIECES:
            self._forget()
        for p in self.split(text):
            known = pieces.get(p)
            if known is None:
                known = self._piece(p)
                if len(p) <= 32:
                    pieces[p] = known
            out += known
        return out

    def count(self, text: str) -> int:
        pieces, n = self.pieces, 0
        if len(pieces) + len(self.atoms) > REMEMBERED_PIECES:
            self._forget()
        for p in self.split(text):
            known = pieces.get(p)
            if known is None:
                known = self._piece(p)
                if len(p) <= 32:
                    pieces[p] = known
            n += len(known)
        return n


def encoder(tokenizer_dir: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> BytePairEncoder:
    """The worker's encoder, built once in each Python process."""
    path = os.path.join(tokenizer_dir, vocabulary)
    if path not in _encoders:
        _encoders[path] = BytePairEncoder(path)
    return _encoders[path]


def encode_corpus(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_dir: str = TOKENIZER_DIR
) -> DataFrame:
    """`id_col` and `ids array<int>` of every row, without special tokens.

    Null and empty texts both give the empty list, blank ones the ids of their blanks.
    Repeated rows are encoded each; rows with a null id stay; other columns are left aside.
    One pass without a shuffle: a task sees its own rows only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_dir)
        for batch in batches:
            flat, offsets = array("i"), [0]
            for text in batch.column(1).to_pylist():
                if text:
                    flat.extend(enc.encode(text))
                offsets.append(len(flat))
            ids = pa.ListArray.from_arrays(
                pa.array(offsets, pa.int32()), pa.array(np.frombuffer(flat, dtype=np.int32), pa.int32())
            )
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["key", "ids"])

    key = df.schema[id_col].dataType.simpleString()
    picked = df.select(df[id_col].alias("key"), df[text_col].cast("string").alias("text"))
    return picked.mapInArrow(run, f"key {key}, ids array<int>").withColumnRenamed("key", id_col)


def token_counts(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_dir: str = TOKENIZER_DIR
) -> DataFrame:
    """`id_col` and `n_tokens int` of every row; 0 for null and empty texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_dir)
        for batch in batches:
            sizes = [enc.count(t) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32())], names=["key", "n_tokens"])

    key = df.schema[id_col].dataType.simpleString()
    picked = df.select(df[id_col].alias("key"), df[text_col].cast("string").alias("text"))
    return picked.mapInArrow(run, f"key {key}, n_tokens int").withColumnRenamed("key", id_col)

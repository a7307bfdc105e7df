"""Words, winnowed fingerprints and distance of texts.

Everything here is exact arithmetic on one batch of texts inside a task: words are hashed with
64 bits each, many texts at once, shingles and winnowing windows are shifts of those arrays.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
import xxhash

from shelfmark.llm.boilerplate import ODD, plain_line

#: Words of a shingle, shingles of a winnowing window.
SHINGLE, WINNOW = 5, 5
#: Texts differ in at most one word in so many.
ONE_IN = 10
#: Texts of fewer words keep every shingle as a fingerprint. In longer ones a fingerprint is two winnowed
#: shingles that follow each other, which single phrases of a template seldom share.
SHORT = 101
#: Texts of so many words keep single shingles beside the pairs: they may be near texts below SHORT.
MIXED = SHORT + SHORT // (ONE_IN - 1)
#: Characters hashed at once.
GROUP = 400_000
#: Counts of words by hash in the bag of a text.
BAG = 128

# Blocks of Chinese characters, each of which is a word.
HAN = ((0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2FFFF))

_MIX = np.uint64(0xD6E8FEB86659FD93)


@cache
def _classes() -> np.ndarray:
    """0 for what separates words, 1 for what makes them, 2 for characters that are words."""
    table = np.frombuffer(bytes(map(str.isalnum, map(chr, range(0x110000)))), dtype=np.uint8).copy()
    for low, high in HAN:
        table[low : high + 1] = np.where(table[low : high + 1] > 0, 2, 0)
    table[0xD800:0xE000] = 0  # surrogates
    return table


@cache
def _mixed() -> np.ndarray:
    """What each character adds to the hash of its word; 0 for what separates words."""
    with np.errstate(over="ignore"):
        mixed = np.arange(1, 0x110001, dtype=np.uint64) * _MIX
        mixed ^= mixed >> np.uint64(32)
        mixed *= _MIX
    mixed[_classes() == 0] = 0
    return mixed


@cache
def _powers(bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        powers = np.full(1 << bits, np.uint64(0x9E3779B97F4A7C15 | 1), dtype=np.uint64)
        powers[0] = 1
        return np.multiply.accumulate(powers)


def plain_text(text: str) -> str:
    """A text in one form: compatibility forms, invisible characters, look-alikes and case don't count."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
        if ODD.search(text):
            text = "\n".join(plain_line(x) if ODD.search(x) else x for x in text.split("\n"))
    return text.lower()


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word of all texts in order, where each text's words begin and the last ones end)."""
    joined = "\x00".join([*map(plain_text, texts), ""])
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kind = _classes()[codes]
    other = kind != 1
    starts = np.flatnonzero((kind == 2) | (~other & np.concatenate(([True], other[:-1]))))
    ends_of_texts = np.flatnonzero(codes == 0)
    offsets = np.concatenate(([0], np.searchsorted(starts, ends_of_texts)))
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), offsets
    with np.errstate(over="ignore"):
        mixed = _mixed()[codes[starts[0] :]]
        at = starts - starts[0]
        place = np.arange(len(mixed)) - np.repeat(at, np.diff(np.append(at, len(mixed))))
        h = np.add.reduceat(mixed * _powers(int(place.max()).bit_length() + 1)[place], at)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h, offsets


Fingerprinted = tuple[int | None, int, np.ndarray, np.ndarray]


def fingerprinted(texts: list[str]) -> list[Fingerprinted]:
    """(digest, words, fingerprints in ascending order, place of each) of each text.

    The digest of no words is null; the place of a shingle that stands in a text twice is -1.
    """
    return [told[:4] for told in described(texts)]


def described(texts: list[str]) -> list[tuple[int | None, int, np.ndarray, np.ndarray, bytes]]:
    """What `fingerprinted` gives and it packed: the bag of each text, BAG counts of its words by hash up to 255,
    then the upper 32 bits of each fingerprint, then 16 bits of each place; 65535 is anywhere, and beyond."""
    out: list[tuple] = []
    group: list[str] = []
    held = 0
    for k, text in enumerate(texts):
        group.append(text)
        held += len(text)
        if held >= GROUP or k == len(texts) - 1:
            out += _fingerprinted(group)
            group, held = [], 0
    return out


def _fingerprinted(texts: list[str]) -> list[tuple]:
    words, offsets = word_hashes(texts)
    shingles = _rolled(words)
    least = shingles
    for k in range(1, WINNOW):
        least = np.minimum(least[: len(least) - 1] if len(least) else least, shingles[k:])
    buckets = (words >> np.uint64(40)).astype(np.int64) % BAG
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        n = b - a
        if not n:
            out.append((None, 0, shingles[:0], np.zeros(0, dtype=np.int32), bytes(BAG)))
            continue
        digest = xxhash.xxh64_intdigest(words[a:b].tobytes()) - (1 << 63)
        every = shingles[a : b - SHINGLE + 1] if n >= SHINGLE else _rolled(words[a:b])
        at = np.arange(len(every))
        if n >= SHORT:
            window = least[a : b - SHINGLE - WINNOW + 2]
            single = every if n < MIXED else every[:0]
            at = np.flatnonzero(np.concatenate(([True], window[1:] != window[:-1])))
            chosen = window[at].view(np.uint64)
            with np.errstate(over="ignore"):
                every = ((chosen[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ chosen[1:]) * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)
            every, at = np.concatenate((every, single)), np.concatenate((at[:-1], np.arange(len(single))))
        order = every.argsort()
        every = every[order]
        first = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
        own, places = every[first], at[order[first]].astype(np.int32)
        places[np.append(first[1:], len(every)) - first > 1] = -1
        bag = np.minimum(np.bincount(buckets[a:b], minlength=BAG), 255).astype(np.uint8)
        upper = (own >> 32).astype(np.uint32)
        near = np.where((places < 0) | (places > 65534), 65535, places).astype(np.uint16)
        out.append((digest, n, own, places, bag.tobytes() + upper.tobytes() + near.tobytes()))
    return out


def _rolled(words: np.ndarray) -> np.ndarray:
    """The hash of each run of SHINGLE words (of all of them, if there are fewer)."""
    n = len(words)
    k = min(SHINGLE, n)
    if not n:
        return np.zeros(0, dtype=np.int64)
    with np.errstate(over="ignore"):
        h = np.zeros(n - k + 1, dtype=np.uint64)
        for i in range(k):
            h = h * np.uint64(0x100000001B3) + words[i : i + len(h)]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h.view(np.int64)


def within_distance(a: np.ndarray, b: np.ndarray, most: int) -> bool:
    """Whether at most `most` words must be replaced, put in or left out to turn one into the other."""
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return False
    a_values, a_counts = np.unique(a, return_counts=True)
    b_values, b_counts = np.unique(b, return_counts=True)
    _, ia, ib = np.intersect1d(a_values, b_values, assume_unique=True, return_indices=True)
    if max(n, m) - int(np.minimum(a_counts[ia], b_counts[ib]).sum()) > most:
        return False
    x, y = a.tolist(), b.tolist()
    far = {0: 0}  # furthest place in x on each diagonal (place in x - place in y)
    for edits in range(most + 1):
        grown: dict[int, int] = {}
        for d in range(-edits, edits + 1):
            i = max(far.get(d, -1) + 1, far.get(d - 1, -1) + 1, far.get(d + 1, -1)) if edits else 0
            i = min(i, n, m + d)
            j = i - d
            if i < 0 or j < 0:
                continue
            while i < n and j < m and x[i] == y[j]:
                i += 1
                j += 1
            if i >= n and j >= m:
                return True
            # What is left needs at least as many edits as it differs in length.
            if abs((n - i) - (m - j)) <= most - edits:
                grown[d] = i
        far = grown
    return False

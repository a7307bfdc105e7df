"""Token ids against the public library; packing and splitting by their properties."""

from __future__ import annotations

import base64
import os
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfmark.llm.bpe import SPLIT_PATTERN, TOKENIZER_DIR, VOCABULARY, encode_corpus, encoder, token_counts
from shelfmark.llm.packing import batch_plan, length_buckets, packed
from shelfmark.llm.pieces import pieces_of, split_texts

PATH = os.path.join(TOKENIZER_DIR, VOCABULARY)
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary")


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    ranks = {base64.b64decode(t): int(i) for t, i in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})


PARTS = ["a", "the", " the", "ing", "  ", "\n", "\n\n", "é", "中文字", "圖書館", "😀", "‍", "１", "½", "<|endoftext|>", "'s", "\x1c", "　", "====", "Ⅳ", "x" * 40]


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.text(max_size=60), st.lists(st.sampled_from(PARTS), max_size=30).map("".join)))
def test_ids_are_exact(reference, text):
    assert encoder().encode(text) == reference.encode_ordinary(text)
    assert encoder().count(text) == len(reference.encode_ordinary(text))


def test_defined_cases(spark, reference):
    rows = [(1, None, "x"), (2, "", "x"), (3, "  ", "x"), (4, "<|endoftext|>", None), (4, "<|endoftext|>", None), (5, "字" * 20000, ""), (None, "a", "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    found = sorted((r.doc_id or 0, len(r.ids)) for r in encode_corpus(docs).collect())
    assert found == sorted((i or 0, len(reference.encode_ordinary(t or ""))) for i, t, _ in rows)
    assert encode_corpus(docs.where("false")).count() == 0
    assert {r.doc_id: r.n_tokens for r in token_counts(docs).collect()}[1] == 0


def test_buckets_are_optimal():
    rnd = random.Random(1)
    for _ in range(20):
        histogram = {s: rnd.randint(1, 9) for s in rnd.sample(range(1, 13), 6)}
        waste = lambda bounds: sum(c * (min(b for b in bounds if b >= s) - s) for s, c in histogram.items())  # noqa: E731, B023
        from itertools import combinations

        best = min(waste((*c, max(histogram))) for c in combinations(sorted(histogram)[:-1], 2))
        found = length_buckets(histogram, 3)
        assert len(found) <= 3 and waste(found) == best


def test_plan_uses_every_item_once():
    plan = batch_plan([3, 5, 8, 10], [7, 4, 6, 2], 10)
    for b, n in enumerate([7, 4, 6, 2]):
        places = sorted(p for k, first, last, _, _ in plan if k == b for p in range(first, last + 1))
        assert places == list(range(n))


def test_groups_fit(spark):
    rnd = random.Random(2)
    sizes = [(i, rnd.choice([rnd.randint(1, 200), rnd.randint(1, 900), rnd.randint(1, 2048), 5000])) for i in range(3000)] + [(5000, 0), (5001, None), (1, 700)]
    rows = packed(spark.createDataFrame(sizes, "doc_id bigint, n_tokens int"), 2048, 64).toPandas()
    assert rows["size"].sum() == sum(n or 0 for _, n in sizes)
    groups = rows.dropna(subset="group_id").groupby("group_id")["size"].sum()
    assert groups.max() <= 2048 and groups.sum() / (2048 * len(groups)) > 0.95
    assert set(rows[rows.group_id.isna()].doc_id) == {5000, 5001}
    assert rows[(rows.doc_id == 5000)].shape[0] == 1
    assert packed(spark.createDataFrame([], "doc_id bigint, n_tokens int")).count() == 0


def check_pieces(text, found, most=512, overlap=64):
    ids = encoder().encode(text)
    assert found[0][0] == 0 and found[-1][1] == len(ids)
    for (_, end, _, _, _), (first, _, _, _, _) in zip(found, found[1:]):
        assert first == max(end - overlap, 0)
    for first, end, n, _, piece in found:
        assert n == end - first <= most and encoder().count(piece) <= most


def test_pieces():
    rnd = random.Random(3)
    words = ["library", "Primorfell", "the", "opens", "at", "9:15", "圖書館", "閱覽室", "é", "😀"]
    sentence = lambda: " ".join(rnd.choice(words) for _ in range(rnd.randint(3, 25))) + rnd.choice([". ", ".\n", "\n\n", "。", " "])
    for n in (5, 60, 400):
        text = "".join(sentence() for _ in range(n))
        check_pieces(text, pieces_of(text, encoder()))
    for text in ("x" * 9000, "字" * 5000, "😀" * 3000, " " * 4000, "a\n" * 3000):
        check_pieces(text, pieces_of(text, encoder()))
    text = "One two three four five six seven. " * 400
    assert all(k in ("sentence", "end") for *_, k, _ in pieces_of(text, encoder()))


def test_edit_changes_neighbours_only():
    rnd = random.Random(4)
    words = [f"word{i}" for i in range(300)]
    text = " ".join(rnd.choice(words) + rnd.choice(["", "", ".", ""]) for _ in range(6000))
    a = {p for *_, p in pieces_of(text, encoder())}
    b = {p for *_, p in pieces_of(re.sub(r"^(\S+ ){5}", "another beginning ", text), encoder())}
    assert len(a & b) >= 0.8 * len(a)


def test_split_texts_cases(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "short", 1), (4, "a b. " * 600, 1), (4, "a b. " * 600, 1)], "doc_id bigint, text string, piece_no int")
    found = split_texts(docs).collect()
    assert {r.doc_id for r in found} == {4} and len(found) % 2 == 0
    assert {r.doc_id for r in split_texts(docs, keep_small=True).collect()} == {3, 4}
    assert split_texts(docs.where("false")).count() == 0
    with pytest.raises(ValueError):
        split_texts(docs, 64, 64)


def test_numpy_is_not_needed_by_callers():
    assert isinstance(encoder().encode("abc")[0], int) and np is not None

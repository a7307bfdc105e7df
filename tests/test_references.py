"""Orphan references on hand-made cases."""

from __future__ import annotations

import random
from datetime import datetime

import pytest

from shelfmark.operators.references import missing_keys, orphan_references
from shelfmark.plans import catalogue

LABELS = "id bigint, source_document_id string, source_chunk_id string, created_at timestamp_ntz, status string"
REGISTRY = "document_id string, status string, version int, uploaded_at timestamp_ntz, updated_at timestamp_ntz"
D = datetime


def run(spark, labels, registry, chunks):
    found = orphan_references(
        spark.createDataFrame(labels, LABELS), spark.createDataFrame(registry, REGISTRY), spark.createDataFrame(chunks, "node_id string, id int")
    )
    return sorted((r.id, r.ref_column[7:8], r.period, r.orphan_kind) for r in found.collect())


def test_kinds(spark):
    registry = [
        ("A", "completed", 1, D(2024, 1, 1), D(2024, 1, 2)), ("b", "completed", 1, D(2024, 1, 1), D(2024, 1, 1)), ("b", "deleted", 1, D(2024, 1, 1), D(2024, 3, 1)),
        ("c", "deleted", 1, D(2024, 1, 1), D(2024, 1, 1)), ("c", "completed", 2, D(2024, 5, 1), D(2024, 5, 1)), ("a", "completed", 1, D(2024, 1, 1), D(2024, 1, 2)),
    ]
    chunks = [("a:v1:s0:c0:x", 1), ("b:v1:s0:c0:x", 2), ("a:v1:s0:c0:x", 3), (None, 4)]
    t = D(2024, 2, 10)
    labels = [
        (1, " a ", "A:v1:s0:c0:X", t, "x"), (2, "b", "b:v1:s0:c0:x", t, None), (3, "zz", "a:v1:s0:c9:x", t, None), (4, "", None, t, None),
        (5, "a", "zz:v1:s0:c0:x", D(2023, 1, 1), None), (3, "zz", "a:v1:s0:c9:x", t, None), (6, "zz", None, None, None), (7, "c", None, t, None),
    ]
    assert run(spark, labels, registry, chunks) == [
        (2, "c", "2024-02", "deleted"), (2, "d", "2024-02", "deleted"), (3, "c", "2024-02", "missing"), (3, "d", "2024-02", "missing"),
        (5, "c", "2023-01", "missing"), (5, "d", "2023-01", "later"), (6, "d", None, "missing"),
    ]


def test_empty_tables(spark):
    assert run(spark, [], [], []) == []
    assert run(spark, [(1, "a", "a:1", D(2024, 1, 1), None)], [], []) == [(1, "c", "2024-01", "missing"), (1, "d", "2024-01", "missing")]


@pytest.mark.parametrize("seed", range(3))
def test_missing_keys_like_sets(spark, seed):
    rnd = random.Random(seed)
    parents = [f"k{rnd.randint(0, 400)}" for _ in range(250)] + [None]
    refs = [f"k{rnd.randint(0, 400)}" for _ in range(300)] + ["k1"] * 200 + [None, "", "x" * 5000]
    frame = lambda rows: spark.createDataFrame([(r,) for r in rows], "key string")
    found = sorted(r.key for r in missing_keys(frame(parents), frame(refs)).collect())
    assert found == sorted({r for r in refs if r is not None} - {p for p in parents if p is not None})


def test_registered():
    assert "p4_found" in catalogue.QUERIES and "p4_found" in catalogue.ORACLES

"""Changes of tables, chunking and evaluation on small cases, with nulls, ties, repeated and empty rows."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import text as T
from shelfmark.operators import chunking as C
from shelfmark.operators import evaluation as E
from shelfmark.operators import publish as P

REGISTRY = (
    "document_id string, content_hash string, source_title string, status string, version int, chunk_count int, error_message string, document_type string, "
    "uploaded_at timestamp_ntz, updated_at timestamp_ntz"
)
AT = "2030-01-01 00:00:00"


def registry(spark, rows):
    return spark.createDataFrame([(d, h, "t", s, v, 3, "e", k, None, None) for d, h, s, v, k in rows], REGISTRY)


def test_registry_changes(spark):
    old = registry(spark, [("A", "h1", "completed", 1, "faq"), ("B ", "h2", "deleted", 2, None), ("c", None, None, None, ""), ("A", "h1", "completed", 1, "faq")])
    more = spark.createDataFrame([("a", "x", 1), ("D", "y", 2), ("d ", "z", 3), (None, "q", 4), (" ", "q", 5)], "document_id string, content_hash string, extra int")
    new = [r for r in P.inserted(old, more, AT).collect() if r.status == "uploaded"]
    assert [(r.document_id, r.content_hash, r.version, r.chunk_count, r.source_title) for r in new] == [("D", "y", 1, 0, None)]
    change = spark.createDataFrame([("a", "h9"), ("B", "h9"), ("C", "h9"), ("c", "h8")], "document_id string, content_hash string")
    rows = sorted((r.document_id, r.content_hash, r.version, r.status) for r in P.replaced(old, change, AT).collect())
    assert rows == [("A", "h9", 2, "uploaded"), ("A", "h9", 2, "uploaded"), ("B ", "h2", 2, "deleted"), ("c", "h8", 1, "uploaded")]
    same = spark.createDataFrame([("a", "SHA256:H1")], "document_id string, content_hash string")
    assert P.replaced(old, same, AT).where("version = 2 and document_id = 'A'").count() == 0
    asked = spark.createDataFrame([("a", None), ("c", ""), ("b", "news")], "document_id string, document_type string")
    kinds = {r.document_id: (r.document_type, r.status) for r in P.reindexed(old, asked).collect()}
    assert kinds == {"A": ("faq", "uploaded"), "B ": (None, "deleted"), "c": ("auto", "uploaded")}
    assert P.inserted(old.where("false"), more.where("false"), AT).count() == 0


def test_chunk_changes(spark):
    chunks = spark.createDataFrame(
        [("a:v1", "a", 1, None, "primary", "faq", "T "), ("a:v2", "a", 2, "hotpotqa", None, None, None), ("x:v1", "x", None, "", None, "faq", "u"), (None, None, None, None, None, None, None)],
        "node_id string, document_id string, version int, dataset string, corpus_role string, document_type string, title string",
    )
    reg = registry(spark, [("A", "h", "completed", 2, None)])
    assert {r.node_id for r in P.current_versions(chunks, reg).collect()} == {"a:v2", "x:v1", None}
    gone = spark.createDataFrame([("A ",), (None,)], "document_id string")
    assert {r.node_id for r in P.without_documents(chunks, gone).collect()} == {"x:v1", None}
    assert [r.node_id for r in P.without_primary(chunks).collect()] == ["a:v2"]
    assert {r.node_id for r in P.without_titled(chunks, spark.createDataFrame([("t",), (None,)], "title string")).collect()} == {"a:v2", "x:v1", None}
    for name in ("", " ", "HKPL"):
        with pytest.raises(ValueError):
            P.dataset_replaced(chunks, chunks, name)
    after = P.dataset_replaced(chunks, chunks.where("node_id = 'x:v1'"), "hotpotqa")
    assert sorted((r.node_id or "", r.dataset or "") for r in after.collect()) == [("", ""), ("a:v1", ""), ("x:v1", ""), ("x:v1", "hotpotqa")]


def test_versions_and_preflight(spark, tmp_path):
    base = f"file://{tmp_path}/table"
    good = spark.createDataFrame([("a:1", "text", "a", False)], "node_id string, text string, document_id string, no_embedding boolean")
    reg = registry(spark, [("a", "h", "completed", 1, None), ("d", "h", "deleted", 1, None)])
    assert P.rebuilt(spark, good, reg, base).count() == 1
    bad = good.union(spark.createDataFrame([("d:1", " ", "d", True), ("a:1", "other", "a", False), (None, "x", "z", False)], good.schema))
    found = {(r.node_id, r.fault) for r in P.rebuild_faults(bad, reg).collect()}
    assert found == {("d:1", "no_text"), ("d:1", "no_embedding"), ("d:1", "deleted_document"), ("a:1", "several_texts"), (None, "no_id"), (None, "unknown_document")}
    with pytest.raises(ValueError):
        P.rebuilt(spark, bad, reg, base)
    assert P.versions(spark, base) == [1] and P.publish(good.where("false"), base) == 2
    assert P.published(spark, base).count() == 0 and P.published(spark, base, 1).count() == 1
    assert P.versions(spark, f"file://{tmp_path}/nothing") == []
    wide = P.migrated(good, "text string, added int, node_id string")
    assert wide.columns == ["text", "added", "node_id", "document_id", "no_embedding"] and wide.first().added is None
    names = spark.createDataFrame([("Any Filter!", 5), (None, None), ("", 0)], "label string, row_limit int")
    assert [r.name for r in P.result_name("run", names).collect()] == ["run-any-filter-limit-5", "run", "run"]


def test_entries(spark):
    docs = spark.createDataFrame(
        [
            (1, "Notices\n\n 01.02.2024 One \nmore\n(3/4/24) Two"), (2, "01.02.2024 only one"), (3, None), (4, ""), (5, "FAQ head\nQ1: a?\nA1: b\n q2) c?\nA2: d"),
            (6, "## Kowloon\nEast Library\n1 Road\n\nTel: 5\nHong Kong Public Libraries\nWest Library\n## Opening 24 hours\nx"),
        ],
        "doc_id int, text string",
    )
    found = {(r.doc_id, r.entry_index): r.text for r in C.announcement_entries(docs).collect()}
    assert found[1, 0] == "Notices\n\n01.02.2024 One\nmore" and found[1, 1] == "Notices\n\n(3/4/24) Two" and found[2, 0] == "01.02.2024 only one" and (3, 0) not in found
    found = {(r.doc_id, r.entry_index): r.text for r in C.faq_entries(docs).collect()}
    assert found[5, 0] == "FAQ head\n\nQ1: a?\nA1: b" and found[5, 1] == "FAQ head\n\nq2) c?\nA2: d" and found[1, 0].startswith("Notices")
    found = {r.section_index: (r.area, r.library, r.text) for r in C.directory_entries(docs.where("doc_id = 6")).collect()}
    assert found[0] == ("Kowloon", "East Library", "Area: Kowloon\nLibrary: East Library\n1 Road\nTel: 5\nHong Kong Public Libraries")
    assert found[1][2] == "Area: Kowloon\nLibrary: West Library\n## Opening 24 hours\nx"


def test_types(spark):
    cases = [
        ("Question: x Answer: y", "t", "faq"), ("Q1. a\nA2. b", "t", "prose"), ("Q1. a\nA1. b", "t", "faq"), ("noticeable rules of thumb", "Noticeable", "policy"),
        ("text", "A notice", "announcement"), ("a notice", "t", "prose"), ("x\n## y", None, "structured"), (None, None, "prose"), ("rulers", "t", "prose"),
    ]
    rows = spark.createDataFrame([(k, a, b) for k, (a, b, _) in enumerate(cases)], "k int, a string, b string")
    found = {r.k: r.kind for r in rows.select("k", C.document_type(F.col("a"), F.col("b")).alias("kind")).collect()}
    assert [found[k] for k in range(len(cases))] == [c[2] for c in cases]
    rules = C.merged_rules({"policy": {"minimum": 2}, "poem": {"patterns": ["rhyme"], "strategy": "prose"}})
    one = spark.createDataFrame([("one rule", ""), ("rule and policy", ""), ("rhyme", "")], "a string, b string")
    assert [r[0] for r in one.select(C.document_type(F.col("a"), F.col("b"), rules=rules)).collect()] == ["prose", "policy", "poem"]
    kinds = one.select(C.document_type(F.col("a"), F.col("b"), F.lit(".CSV"), F.when(F.col("a") == "rhyme", F.lit(" News ")))).collect()
    assert [r[0] for r in kinds] == ["record_based", "record_based", "news"]


def test_pieces_like_brute_force(spark):
    rnd = random.Random(4)
    texts = [" ".join("w" * rnd.randint(1, 30) + rnd.choice([".", "", "!"]) for _ in range(rnd.randint(0, 40))) for _ in range(40)] + ["", None, "x" * 500]

    def pieces(text, size, overlap):
        cost = lambda s: max(1, round(len(s) / 4))
        done, cur, n = [], [], 0
        for s in [x for x in re.split(r"(?<=[.!?。！？])\s+|\n+", text) if x]:
            if n == 0 or n + cost(s) <= size:
                cur, n = [*cur, s], n + cost(s)
                continue
            done.append(" ".join(cur))
            kept, used = [], 0
            for x in reversed(cur):
                if used + cost(x) > min(overlap, size - cost(s)):
                    break
                kept, used = [x, *kept], used + cost(x)
            cur, n = [*kept, s], used + cost(s)
        return done + ([" ".join(cur)] if n else [])

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for size, overlap in ((40, 15), (25, 0), (20, 50)):
        found = {}
        for r in C.greedy_pieces(docs, size, overlap).orderBy("doc_id", "piece_no").collect():
            found.setdefault(r.doc_id, []).append(r.text)
        assert found == {k: p for k, t in enumerate(texts) if t is not None and (p := pieces(t, size, overlap))}


def test_evaluation_rows(spark):
    asked = spark.createDataFrame([(1,), (2,), (2,), (3,)], "query_id int")
    results = spark.createDataFrame([(1, 4.0, 0.9, 1.0), (3, None, None, 2.0)], "query_id int, correctness double, faithfulness double, relevancy double")
    rows = {r.query_id: r for r in E.with_failed_rows(asked, results).collect()}
    assert (rows[2].failed, rows[2].hallucination, rows[3].hallucination, round(rows[1].hallucination, 6)) == (True, 1.0, 1.0, 0.1)
    total = E.judged_summary(E.with_failed_rows(asked, results)).first()
    assert (total.n_questions, total.n_judged, total.avg_correctness) == (3, 2, 2.0)
    labels = spark.createDataFrame([(1, " The  HALL "), (2, ""), (3, None), (4, "x")], "query_id int, snippet string")
    ranked = spark.createDataFrame([(1, 1, "c1", "in the hall"), (1, 2, "c2", None), (1, 3, "c3", "THE HALL"), (2, 1, "c4", "x")], "query_id int, rank int, chunk_id string, text string")
    found = {r.query_id: (r.hit, r.matched_ids) for r in E.evidence_at_k(labels, ranked, 3).collect()}
    assert found == {1: (1.0, ["c1", "c3"]), 2: (0.0, []), 3: (0.0, []), 4: (0.0, [])}
    kept = E.kept_after_filter(ranked, F.col("text").isNotNull(), 1).select("query_id", "rank", "chunk_id", "n_filtered").orderBy("query_id").collect()
    assert [tuple(r) for r in kept] == [(1, 1, "c1", 1), (2, 1, "c4", 0)]
    pairs = spark.createDataFrame([(1, ["a", "b"], ["x"]), (2, None, ["x"]), (3, [], [])], "id int, l array<string>, r array<string>")
    assert [(r.id, r.pos, r.l, r.r) for r in E.zipped(pairs, "l", "r").collect()] == [(1, 0, "a", "x")]


def test_natural_order(spark):
    names = ["a10", "a9", "B2", "a" + "9" * 30, "a1" + "0" * 30, "a007"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").orderBy(T.natural_key(F.col("n"))).collect()
    assert [r.n for r in rows] == ["a007", "a9", "a10", "a" + "9" * 30, "a1" + "0" * 30, "B2"]

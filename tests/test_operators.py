"""Core operators on small hand-made inputs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from shelfmark.functions import text as T
from shelfmark.functions.urls import normalize_url, site_of
from shelfmark.operators import chunking as C
from shelfmark.operators import crawl, history
from shelfmark.operators import labels as L
from shelfmark.operators.retrieval import metrics_at_k, vector_topk
from shelfmark.plans.retrieval import retrieval_metrics_at_k


def values(spark, column, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(column(F.col("t"))).collect()]


def test_text_forms(spark):
    assert values(spark, T.normalize_text, " a  b\t c\n\n\n\nd ", None, "") == ["a b c\n\nd", None, ""]
    assert values(spark, T.label_form, " “A  b” ", None) == ["a b", None]
    assert values(spark, T.compact_form, "Straße, 1_2!") == ["strasse1_2"]
    assert values(spark, T.estimated_tokens, None, "", "ab", "x" * 10, "x" * 14) == [0, 0, 1, 2, 4]
    assert values(spark, T.json_in, 'so {"a": {"b": 1}} there', "none") == ['{"a": {"b": 1}}', None]
    a, b = values(spark, T.natural_key, "f10.json", "f9.json")
    assert b < a


def test_urls(spark):
    assert values(spark, site_of, "HTTPS://WWW.A.example:443/x", "http://u@b.example", "x", None, "") == ["a.example", "b.example", None, None, None]
    assert values(spark, normalize_url, "HTTP://A.example#f", "http://a.example/B?q=1#z") == ["http://a.example/", "http://a.example/B"]


def test_sections_and_chunks(spark):
    docs = spark.createDataFrame([(1, "intro\n## A\nx\n## B\none two three four five"), (2, None), (3, "")], "doc_id int, text string")
    assert [(r.section_index, r.text) for r in C.heading_sections(docs).orderBy("section_index").collect()] == [
        (0, "intro"), (1, "## A\nx"), (2, "## B\none two three four five")
    ]
    assert [r.section_index for r in C.marked_sections(docs).collect()] == [2]
    faq = spark.createDataFrame([(1, "Head\nQ1: a?\nA1: b.\nQ2: c?\nA2: d."), (2, "plain")], "doc_id int, text string")
    assert [(r.doc_id, r.text) for r in C.faq_entries(faq).orderBy("doc_id", "entry_index").collect()] == [
        (1, "Head\n\nQ1: a?\nA1: b."), (1, "Head\n\nQ2: c?\nA2: d."), (2, "plain")
    ]
    dated = spark.createDataFrame([(1, "News\n1.2.2024 one\nmore\n3.2.2024 two"), (2, "1.2.2024 alone")], "doc_id int, text string")
    assert [r.text for r in C.announcement_entries(dated).orderBy("doc_id", "entry_index").collect()] == [
        "News\n\n1.2.2024 one\nmore", "News\n\n3.2.2024 two", "1.2.2024 alone"
    ]
    long = "word " * 20
    chunks = C.content_chunks(C.paragraphs(spark.createDataFrame([(1, f"{long}\n\nshort\n\n{long}\n\nother {long}")], "doc_id int, text string")))
    assert sorted(r.chunk_index for r in chunks.collect()) == [0, 3]


def test_types(spark):
    kinds = lambda *t: values(spark, lambda c: C.document_type(c, F.lit("Title")), *t)
    assert kinds("Q1: x A1: y", "the rules", "## a", "x", None, "Question: a Answer: b") == ["faq", "policy", "structured", "prose", "prose", "faq"]


def test_vector_search_like_brute_force(spark):
    rnd = np.random.default_rng(3)
    vectors = rnd.normal(size=(300, 8)).round(2)
    vectors[7] = vectors[3]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)] + [(999, None)], "vec_id bigint, embedding array<double>")
    found = vector_topk(rows.where("vec_id % 20 = 0"), rows, 5).orderBy("query_id", "rank").collect()
    rounds = vector_topk(rows.where("vec_id % 20 = 0"), rows, 5, query_round=4).orderBy("query_id", "rank").collect()
    assert rounds == found and vector_topk(rows.where("false"), rows, 5).count() == 0
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    for q in range(0, 300, 20):
        best = np.lexsort((np.arange(300), -(unit @ unit[q]).round(12)))[:5]
        assert [r.vec_id for r in found if r.query_id == q] == best.tolist()


def test_metrics(spark):
    expected = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "query_id int, item_id string")
    ranked = spark.createDataFrame([(1, 1, "x"), (1, 2, "a"), (1, 3, "b")], "query_id int, rank int, item_id string")
    m = {r.query_id: r for r in metrics_at_k(expected, ranked).collect()}
    assert (m[1].hit_1, m[1].hit_3, m[1].recall_3, m[1].complete_3, m[1].reciprocal_rank) == (0, 1, 1.0, 1, 0.5)
    assert (m[2].hit_5, m[2].recall_5, m[2].complete_5, m[2].reciprocal_rank) == (0, 0.0, 0, 0.0)


def test_expected_items_stand_anywhere(spark, tmp_path):
    # One item of the query's label is next to it, two stand behind 60 of another label; query 100 is alone with its label.
    rows = [(0, 1, [1.0, 0.0]), (1, 1, [1.0, 0.001]), (2, 1, [0.0, 1.0]), (3, 1, [-1.0, 0.0]), (100, 3, [1.0, 0.5])]
    rows += [(1001 + 20 * i, 2, [1.0, 0.01 + i / 1000]) for i in range(60)]
    spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = {r.query_id: r for r in retrieval_metrics_at_k(spark, str(tmp_path)).collect()}
    assert (found[0].recall_3, found[0].complete_3) == (0.333333, 0)
    assert (found[100].recall_5, found[100].complete_5, found[100].reciprocal_rank) == (0, 0, 0) and len(found) == 2


def test_crawl_ends_on_cycles(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", None)], "url string, link string")
    found = {r.url: r.depth for r in crawl.crawl_levels(spark.createDataFrame([("a",)], "url string"), links, 2).collect()}
    assert found == {"a": 0, "b": 1, "c": 2}
    pages = spark.createDataFrame([("http://a.example/x", '<a href="/y">1</a><A class=z HREF=\'http://b.example\'>')], "url string, html string")
    assert sorted(r.link for r in crawl.discovered_links(pages).collect()) == ["http://a.example/y", "http://b.example/"]


def test_context_keeps_the_first(spark):
    ranked = spark.createDataFrame([(1, 1, "x" * 4000), (1, 2, "y"), (2, 1, "a" * 40), (2, 2, "b" * 4000)], "query_id int, rank int, t string")
    assert sorted((r.query_id, r.rank) for r in history.packed_context(ranked, F.col("t"), 100).collect()) == [(1, 1), (2, 1)]


def test_upsert_twice_changes_nothing(spark):
    old = spark.createDataFrame([("q1", "a"), ("q2", "b")], "query string, answer string")
    new = spark.createDataFrame([("q2", "c"), ("q3", "d")], "query string, answer string")
    once = L.upserted_labels(old, new, ["answer"])
    assert sorted((r.query, r.change) for r in once.collect()) == [("q1", "kept"), ("q2", "updated"), ("q3", "inserted")]
    assert {r.change for r in L.upserted_labels(once.select("query", "answer"), new, ["answer"]).collect()} == {"kept"}

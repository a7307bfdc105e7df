"""Canonical forms, repeated lines, page frames."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa

from shelfmark.llm.boilerplate import BLANK, LINE, SURE, _nameless, _path_sums, _without_numbers, article_texts, frame_found, frame_lines, line_paths, plain_line
from shelfmark.llm.canonical import canonical_text, odd_characters
from shelfmark.llm.lines import content_chunks, line_form, repeated_lines, without_repeated_lines

REGISTRY = "document_id string, source_url string, version int, status string, uploaded_at timestamp_ntz, updated_at timestamp_ntz, node_id string"


def registry(spark, sites):
    return spark.createDataFrame([(d, u, 1, "completed", None, None, "x") for d, u in sites], REGISTRY)


def test_canonical_cases(spark):
    cases = {
        "a": ("P𝗅𝖾𝖺𝗌𝖾 note", ["compat"], "Please note"), "b": ("Dоnatіons", ["lookalike"], "Donations"), "c": ("читальня βιβλίο", [], "читальня βιβλίο"),
        "d": ("éa", ["combining"], "éa"), "e": (None, [], None), "f": ("", [], ""), "g": ("a\xa0b​c", ["invisible", "space"], "a bc"),
        "h": ("oﬃce ＡＢ１", ["compat"], "office AB1"), "i": ("DVD影碟，。（）", [], "DVD影碟，。（）"), "j": ("𝗅о​х", ["compat", "invisible", "lookalike"], "lox"),
        "k": ("a\tb\nc", [], "a\tb\nc"), "l": ("x" * 50000 + "　", ["space"], "x" * 50000 + " "),
    }
    rows = spark.createDataFrame([(k, t, "y") for k, (t, _, _) in cases.items()], "k string, t string, canonical string")
    for r in canonical_text(rows, "k", "t").collect():
        assert (sorted(r.char_kinds), r.canonical) == (cases[r.rec_key][1], cases[r.rec_key][2]), r.rec_key
    twice = canonical_text(rows.union(rows), "k", "t", "tab")
    assert odd_characters(twice).count() == sum(len(k) for _, k, _ in cases.values())
    again = canonical_text(canonical_text(rows, "k", "t").select("rec_key", "canonical"), "rec_key", "canonical")
    assert odd_characters(again).count() == 0  # the form is stable
    assert canonical_text(rows.where("false"), "k", "t").count() == 0


def test_chunks_follow_the_content():
    rnd = random.Random(1)
    a, b = "".join(rnd.choice("abcdefghijklmnop") for _ in range(900)), "zz"
    line, hashes, keys = content_chunks([a, b, a])
    first, last = hashes[line == 0].tolist(), hashes[line == 2].tolist()
    assert first == last and keys[0] == keys[2] != keys[1]
    _, moved, _ = content_chunks(["x" + a])
    assert set(moved.tolist()) & set(first)


def test_repeated_lines_like_brute_force(spark):
    rnd = random.Random(5)
    pool = ["Skip to content", "Home", "EN | 繁 | 简", "Page views: {n}", "Contact us.", "12 34", "...", "", "ALL RIGHTS RESERVED © {n}", "A long notice that stands on every page of the site. " * 3]
    docs, pages = [], []
    for d in range(60):
        url = rnd.choice(["https://www.a.example/x", "HTTP://A.example:80/y", "http://b.example", None])
        docs.append((f"D{d}", url))
        for c in range(rnd.randint(1, 3)):
            lines = [rnd.choice(pool).format(n=rnd.randint(1, 999)) for _ in range(6)] + ["Own line " + "".join(rnd.choice("abcdefghij") for _ in range(12))]
            lines = [x.upper() if rnd.random() < 0.2 else x + rnd.choice(["", "", "  ", ".", "…"]) for x in lines]
            rnd.shuffle(lines)
            pages.append((f"d{d}:v1:s0:c{c}:h", "\n".join(lines), d))
    pages += pages[:5] + [("d1:v1:s0:c9:h", None, 1), ("nobody:v1:s0:c0:h", "Home", 1)]
    frame = spark.createDataFrame(pages, "node_id string, text string, site int")
    found = {(r.node_id, r.line_no) for r in repeated_lines(frame, registry(spark, docs)).collect()}
    site = {d.lower(): None if u is None else ("a" if "a.example" in u.lower() else "b") for d, u in docs}
    where = defaultdict(set)
    places = []
    for node, text, _ in pages:
        doc = node.split(":")[0]
        for k, line in enumerate((text or "").split("\n"), 1):
            if site.get(doc) and line_form(line):
                where[site[doc], line_form(line)].add(doc)
                places.append((node, k, site[doc], line_form(line)))
    assert found == {(n, k) for n, k, s, f in places if len(where[s, f]) >= 8} and found
    kept = {r.node_id: r.text for r in without_repeated_lines(frame, repeated_lines(frame, registry(spark, docs))).collect()}
    assert all("own line" in t.lower() for n, t in kept.items() if t and n[0] == "d") and len(kept) == len({p[0] for p in pages})
    assert repeated_lines(frame.where("false"), registry(spark, [])).count() == 0


def test_line_paths():
    assert line_paths("Follow Ash Library on social channels")[2] == "text/#/on/social/channels"
    assert line_paths("Home / Events / A talk")[3] == "rows/home"
    assert plain_line("Skір​ tо  main") == "Skip to main"


def test_names_like_word_by_word():
    rnd = random.Random(2)
    words = ["The", "desk", "Ash", "ÉCU", "#", "##", "#b", "12", "Á9", "a.", ".", "?!", "U2", "/", "x/#", "…", "opens", "٣", "H8:15", "ǅ"]
    for _ in range(20_000):
        line = " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 9)))
        if exact := _without_numbers(line.lower()).rstrip(".!?:;,。… "):
            told = exact.split()
            if not line.isupper():
                told[1:] = ["#" if o[0].isupper() else w for o, w in zip(line.split()[1:], told[1:])]
                if told[1:2] == ["#"] and line[0].isupper():
                    told[0] = "#"
                told = [w for k, w in enumerate(told) if w != "#" or not k or told[k - 1] != "#"]
            assert _nameless(line, exact) == " ".join(told), line


def test_path_sums_like_brute_force():
    rnd = np.random.default_rng(3)
    told = np.zeros(400, LINE)
    for c, most in (("form", 30), ("whole", 9), ("lead", 5), ("length", 90), ("punctuation", 7)):
        told[c] = rnd.integers(0, most, len(told))
    told["flags"] = rnd.choice([0, BLANK, SURE], len(told))
    batch = pa.RecordBatch.from_arrays([pa.array([4, 7], pa.int64()), pa.array([told[:150].tobytes(), told[150:].tobytes()], pa.binary())], names=["site", "lines"])
    shared, none = np.array([3, 8, 21]), np.zeros(0, np.int64)
    expected: dict[int, list[int]] = defaultdict(lambda: [0, 0, 0, 0])
    for x in told[told["flags"] != BLANK]:
        for path in (x["whole"], x["lead"]):
            for k, v in enumerate((1, x["form"] in shared or x["flags"] == SURE, x["length"], x["punctuation"])):
                expected[int(path)][k] += int(v)
    (found,) = _path_sums(iter([batch]), none, shared)
    assert {r["path"]: [r[c] for c in ("n", "repeated", "length", "punctuation")] for r in found.to_pylist()} == expected


def test_frame_of_small_sites(spark):
    pages, docs = [], []
    for site in range(3):
        for d in range(12):
            doc, name = f"s{site}d{d}", "abcdefghijkl"[d] * 3 + "xyz"[site]
            docs.append((doc, f"https://www.site{site}.example/{d}"))
            text = [
                "Skip to main content", f"Home / Events / A talk in P{name}", f"A talk in P{name}", f"Readers of P{name} may borrow {d} books, at the desk of H{name}.",
                "See also", f"› New books at T{name} and H{name}", f"› Guide to maps in V{name}", f"The desk of H{name} opens at {d}:15, but closes on Monday in week {d}.",
                f"Tags: p{name}, h{name}", "Back to top", "", f"Page views: {d}17",
            ]
            pages.append((f"{doc}:v1:s0:c0:h", "\n".join(text), "x"))
    pages += [pages[0], ("s0d1:v1:s0:c1:h", None, "x"), ("s0d2:v1:s0:c1:h", "", "x")]
    frame = spark.createDataFrame(pages, "node_id string, text string, frame string")
    found = {(r.node_id, r.line_no) for r in frame_found(frame, registry(spark, docs)).collect()}
    assert {k for n, k in found if n.startswith("s1d3:")} == {1, 2, 5, 6, 7, 9, 10, 12}
    assert len(found) == 8 * 36
    assert frame_lines(frame.where("false"), registry(spark, [])).count() == 0


def test_articles_need_no_shuffle_of_lines(spark):
    # Links of doubled and of split chunks; forms, paths and headings at hand or joined.
    docs = [(f"s{site}d{d}", f"https://www.site{site}.example/{d}") for site in range(2) for d in range(9)]
    pages = []
    for k, (doc, _) in enumerate(docs):
        name = "abcdefghi"[k % 9] * 3 + "xy"[k // 9]
        first = ["Skip to main content", f"Readers of P{name} may borrow {k} books, at the desk of H{name}.", "See also", f"› New books at T{name} and H{name}"]
        second = [f"› Guide to maps in V{name}", f"The desk of H{name} opens at {k}:15, but closes on Monday in week {k}.", "", "Back to top"]
        pages += [(f"{doc}:v1:s0:c10:h", "\n".join(second)), (f"{doc}:v1:s0:c9:h", "\n".join(first))]
    pages += [pages[0], (pages[1][0], "Skip to main content\nRead on"), (":s0:c0:", "Back to top\nNowhere"), (None, "Back to top"), ("s0d1:v1:s0:c11:h", "")]
    frame, known = spark.createDataFrame(pages, "node_id string, text string"), registry(spark, docs)
    tell = lambda docs, texts: pa.RecordBatch.from_arrays([pa.array(docs, pa.string()), pa.array(texts, pa.string())], names=["doc", "text"])
    at_hand, joined = (article_texts(frame, known, tell, "doc string, text string", n) for n in (1000, 0))
    assert "Exchange" not in at_hand._jdf.queryExecution().executedPlan().toString()
    found = dict(map(tuple, at_hand.collect()))
    assert found == dict(map(tuple, joined.collect())) and len(found) == len(docs)
    assert found["s1d2"].split("\n") == ["Readers of Pcccy may borrow 11 books, at the desk of Hcccy.", "The desk of Hcccy opens at 11:15, but closes on Monday in week 11."]
    lines = [(r.doc, r.node_id, r.line_no) for r in frame_lines(frame, known).collect()]
    assert len(lines) == len(set(lines)) == 18 * 7 + 3

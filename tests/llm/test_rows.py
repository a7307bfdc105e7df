"""Conversations, repeated deliveries, broken pairs."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa

from shelfmark.llm.conversations import MESSAGE_SCHEMA, closed_segments, conversations, late_messages, session_defects
from shelfmark.llm.dedup import Store, class_of, repeated_deliveries, screened, sharing_in_cell
from shelfmark.llm.fingerprints import described, fingerprinted, within_distance
from shelfmark.llm.pairs import defective_pairs, fit_defects, language, made_pairs, pair_features

T0 = datetime(2024, 1, 1, 23, 0)


def brute(rows):
    names = {"user": "user", "human": "user", "assistant": "assistant", "bot": "assistant", "ai": "assistant", "system": "system"}
    out = {}
    for session in {r[1] for r in rows if (r[1] or "").strip()}:
        own = sorted({r for r in rows if r[1] == session}, key=lambda r: (r[4] or datetime(2000, 1, 1), r[0], r[2] or "", r[3] or ""))
        roles = [names.get((r[2] or "").strip().lower()) for r in own]
        shown = [bool((r[3] or "").replace("​", "").strip()) for r in own]
        kept = []
        for r, role, s in zip(own, roles, shown):
            if s and role in ("user", "assistant") and (not kept or kept[-1] != (role, r[3].strip())):
                kept.append((role, r[3].strip()))
        turns = [k for k, _ in kept]
        if not any(shown):
            out[session] = "empty"
        elif any(r[4] is None for r in own) or None in roles or turns[:1] == ["assistant"] or ("assistant", "assistant") in zip(turns, turns[1:]):
            out[session] = "broken"
        elif any(a == "user" and b != "assistant" for a, b in zip(turns, [*turns[1:], None])):
            out[session] = "missing_reply"
        else:
            out[session] = None
    return out


def test_conversations_like_brute_force(spark, tmp_path):
    rnd = random.Random(6)
    rows = []
    for s in range(80):
        at = T0 + timedelta(hours=rnd.randint(0, 90))
        for turn in range(rnd.randint(1, 9)):
            at += timedelta(minutes=rnd.choice([0, 1, 30, 700]))
            role = ["user", "assistant"][turn % 2] if rnd.random() < 0.93 else rnd.choice(["assistant", "user", "system", "robot", None])
            role = rnd.choice([role, f" {role} ", str(role).upper(), {"user": "Human", "assistant": "bot"}.get(role, role)]) if role else role
            content = rnd.choice([f"text {turn}", f"text {turn}", f"text {turn}", f" text {turn}", "", "​", None]) if s % 9 else rnd.choice(["", " ", None])
            rows.append((len(rows), f"s{s}", role, content, at if rnd.random() < 0.99 else None))
    rows += rows[:20] + [(900, None, "user", "x", T0), (901, " ", "user", "x", T0)]
    rnd.shuffle(rows)
    path = f"{tmp_path}/messages"
    spark.createDataFrame(rows, MESSAGE_SCHEMA).repartition(3).write.parquet(path)
    segments = closed_segments(spark, path)
    found = {r.session_id: r.defect for r in session_defects(segments).collect()}
    assert found == brute(rows)
    turns = conversations(segments).collect()
    assert {r.session_id for r in turns} <= {s for s, d in found.items() if d is None}
    for s in {r.session_id for r in turns}:
        own = sorted((r for r in turns if r.session_id == s), key=lambda r: r.turn_no)
        assert [r.turn_no for r in own] == list(range(1, len(own) + 1))
        assert [r.role for r in own] == ["user", "assistant"] * (len(own) // 2)
    empty = f"{tmp_path}/none"
    spark.createDataFrame([], MESSAGE_SCHEMA).write.parquet(empty)
    assert session_defects(closed_segments(spark, empty)).count() == 0


def test_later_files_lose_nothing(spark, tmp_path):
    at = lambda d, m=0: T0 + timedelta(days=d, minutes=m)
    files = [
        [(1, "a", "user", "q", at(0)), (2, "a", "bot", "r", at(0, 40)), (3, "b", "user", "q", at(0)), (4, "c", "user", "q", at(0)), (5, "c", "ai", "r", at(0, 1))],
        [(6, "b", "assistant", "r", at(1)), (7, "d", "user", "q", at(60)), (8, "d", "assistant", "r", at(60)), (9, "c", "user", "more", None), (10, "a", "user", "late", at(0, 41))],
        [(11, "e", "user", "q", at(61))],
    ]
    path, base = f"{tmp_path}/messages", f"{tmp_path}/stream"
    seen = []
    for rows in files:
        spark.createDataFrame(rows, MESSAGE_SCHEMA).coalesce(1).write.mode("append").parquet(path)
        segments = closed_segments(spark, path, base)
        seen.append({r.session_id: r.defect for r in session_defects(segments).collect()})
    assert seen[0] == {"a": None, "b": "missing_reply", "c": None}
    # b's answer and a's last question came for slices that were open or closed: told, never lost silently
    late = {r.session_id: r.n_late for r in late_messages(spark.read.schema(MESSAGE_SCHEMA).parquet(path), segments).collect()}
    assert set(late) <= {"a", "b"} and late["a"] == 1
    assert seen[2]["d"] is None and seen[2]["c"] == "broken" and seen[2]["e"] == "missing_reply" and seen[2]["a"] is None


def test_distance():
    rnd = random.Random(7)

    def full(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    for _ in range(300):
        a = [rnd.randint(0, 5) for _ in range(rnd.randint(0, 14))]
        b = [x if rnd.random() < 0.8 else rnd.randint(0, 5) for x in a if rnd.random() < 0.9] + [1] * rnd.randint(0, 2)
        for most in range(6):
            assert within_distance(np.array(a, dtype=int), np.array(b, dtype=int), most) == (full(a, b) <= most)


def test_near_texts_share_enough():
    rnd = np.random.default_rng(3)
    for n in (20, 60, 100, 101, 150, 200, 500):
        for _ in range(200):
            words = rnd.integers(0, 10**9, n)
            other = words.copy()
            other[rnd.choice(n, n // 10, replace=False)] = rnd.integers(0, 10**9, n // 10)
            (_, _, a, _), (_, _, b, _) = fingerprinted([" ".join(map(str, words)), " ".join(map(str, other))])
            assert len(np.intersect1d(a, b)) >= 0.1 * min(len(a), len(b))


def test_near_texts_share_enough_at_the_limit_of_short_texts():
    rnd = np.random.default_rng(4)
    for n in range(101, 112):
        for _ in range(50):
            words = rnd.integers(0, 10**9, n)
            (_, _, a, _), (_, _, b, _) = fingerprinted([" ".join(map(str, t)) for t in (words, np.delete(words, rnd.choice(n, n - 100, replace=False)))])
            assert len(np.intersect1d(a, b)) >= 0.1 * min(len(a), len(b))


def test_near_texts_stand_in_neighbouring_classes():
    sizes = np.arange(1, 20000)
    classes = class_of(sizes)
    assert (classes - classes[sizes - sizes // 10 - 1] <= 1).all() and classes[0] == 1 and (np.diff(classes) >= 0).all()


def test_a_cell_like_brute_force():
    rnd = np.random.default_rng(1)
    texts = []
    for _ in range(20):
        base = rnd.integers(0, 5000, 106)
        for _ in range(5):
            texts.append(base[: rnd.integers(97, 107)].copy())
            texts[-1][rnd.integers(0, 97, 4)] = rnd.integers(0, 5000, 4)
    told = described([" ".join(f"w{x}" for x in t) for t in texts])
    old = [k % 3 == 0 for k in range(len(texts))]

    def cell(sides, key):
        columns = [[key] * len(told), pa.array(sides, pa.int32()), [True] * len(told), old, [t[0] for t in told], pa.array([t[1] for t in told], pa.int32()), [t[4] for t in told]]
        return pa.table(dict(zip(("cell", "side", "home", "old", "digest", "size", "packed"), columns)))

    def found(sides, key):
        out = sharing_in_cell(cell(sides, key), 100)
        return {tuple(sorted(p)) for p in zip(out["x"].to_pylist(), out["y"].to_pylist())}

    sides = [k % 2 for k in range(len(texts))]
    near = [(i, j) for i in range(len(texts)) for j in range(i) if not (old[i] and old[j]) and told[i][0] != told[j][0]]
    near = [(i, j) for i, j in near if within_distance(texts[i], texts[j], max(len(texts[i]), len(texts[j])) // 10)]
    name = lambda pairs: {tuple(sorted((told[i][0], told[j][0]))) for i, j in pairs}
    whole, across = found([0] * len(texts), 5 << 40), found(sides, (5 << 40) + 1)
    assert whole >= name(near) and len(near) > 50 and len(whole) < 2 * len(near)
    assert across >= name((i, j) for i, j in near if sides[i] != sides[j]) and across < whole
    assert sharing_in_cell(cell([0] * len(texts), 5 << 40), 0)["x"].to_pylist() == [None]


def test_filters_lose_nothing(spark):
    store = Store(spark)
    assert screened(spark.range(5).withColumnRenamed("id", "fp"), store).count() == 0
    text = "digest bigint, ord struct<batch:int,time:bigint,doc:string>, text string, size int, fps array<bigint>, places array<int>"
    for part in (range(700), range(700, 1000)):
        rows = spark.createDataFrame([(k, (1, k, f"d{k}"), "t", 9, [k * 7919 - 10**12, k * 7919 + 5], [0, 1]) for k in part], text)
        store.extend(store.next(), len(part), spark.createDataFrame([(k,) for k in part], "digest bigint"), rows)
    probe = spark.createDataFrame([(k * 7919 - 10**12,) for k in range(20000)], "fp bigint")
    passed = {r.fp for r in screened(probe, Store(spark, store.path)).collect()}
    assert passed >= {k * 7919 - 10**12 for k in range(1000)} and len(passed) < 1300


def deliveries(spark, seed):
    rnd = random.Random(seed)
    name = lambda i: "".join("bcdfghjklm"[int(c)] + "aeiou"[int(c) % 5] for c in f"{i:04d}")
    words = [name(i) for i in range(4000)]
    texts = []
    for _ in range(90):
        base = rnd.choice(texts) if texts and rnd.random() < 0.5 else [rnd.choice(words) for _ in range(rnd.randint(40, 160))]
        n = rnd.choice([0, 0.04, 0.08, 0.15, 0.5])
        texts.append([rnd.choice(words) if rnd.random() < n else w for w in base])
    hashes = [f"h{rnd.randint(0, 300)}" if rnd.random() < 0.95 else rnd.choice(["", None]) for _ in texts]
    batches = sorted(rnd.randint(1, 5) for _ in texts)
    at = lambda i: T0 + timedelta(minutes=i)
    registry = [(f"D{i}", rnd.choice([h, f"SHA256:{h.upper()} "]) if h else h, f"http://s{i % 3}.example/{i}", "completed", 1, at(0), at(0)) for i, h in enumerate(hashes)]
    pages = [(f"d{i}:v1:s0:c0:h", ". ".join(" ".join(t[k : k + 12]) for k in range(0, len(t), 12)) + ".", i) for i, t in enumerate(texts)]
    rows = [(b, f"d{i}", at(i)) for i, b in enumerate(batches)]
    rows += [(b + 1, d, t + timedelta(days=1)) for b, d, t in rows[:7]]
    frames = (
        spark.createDataFrame(rows, "batch_no int, document_id string, received_at timestamp_ntz"),
        spark.createDataFrame(registry, "document_id string, content_hash string, source_url string, status string, version int, uploaded_at timestamp_ntz, updated_at timestamp_ntz"),
        spark.createDataFrame(pages + pages[:3], "node_id string, text string, doc int"),
    )
    keys = [h if h else None for h in hashes]
    place = {w: i for i, w in enumerate(words)}
    ids = [np.array([place[w] for w in t]) for t in texts]
    accepted, pairs = [], set()
    for i in sorted(range(len(texts)), key=lambda i: (batches[i], i)):
        hit = [a for a in accepted if (keys[a] and keys[a] == keys[i]) or within_distance(ids[a], ids[i], max(len(ids[a]), len(ids[i])) // 10)]
        pairs |= {tuple(sorted((f"d{a}", f"d{i}"))) for a in hit}
        if not hit:
            accepted.append(i)
    return frames, pairs


def test_deliveries_like_brute_force(spark):
    frames, pairs = deliveries(spark, 8)
    found = {(r.document_id_a, r.document_id_b) for r in repeated_deliveries(*frames).collect()}
    assert found == pairs and len(pairs) > 20
    # leaders first, and rounds instead of one task
    found = {(r.document_id_a, r.document_id_b) for r in repeated_deliveries(*frames, gather=0, pairs_a_row=0, task_rows=0).collect()}
    assert found == pairs


def test_store_is_continued(spark):
    frames, pairs = deliveries(spark, 12)
    store, found = Store(spark), set()
    for upper in (2, 4, 9):  # the whole table each time; what was delivered before takes no part
        known = Store(spark, store.path)
        found |= {(r.document_id_a, r.document_id_b) for r in repeated_deliveries(frames[0].where(f"batch_no <= {upper}"), *frames[1:], store=known).collect()}
    assert found == pairs and len(known.deliveries) > 3


def test_common_fingerprints_lose_no_repeat(spark):
    # Two families of texts over the limit of common fingerprints: B has another block of words than A.
    rnd = random.Random(5)
    words = [a + b + c for a in "bcdfghjkl" for b in "aeiou" for c in "mnprstvwx"]
    a = [rnd.choice(words) for _ in range(400)]
    b = a[:200] + [rnd.choice(words) for _ in range(50)] + a[250:]
    texts = [a, b] + [[rnd.choice(words) if rnd.random() < 0.02 else w for w in base] for base in (a, b) for _ in range(80)]
    place = {w: i for i, w in enumerate(words)}
    ids = [np.array([place[w] for w in t]) for t in texts]
    accepted, pairs = [], set()
    for i in range(len(texts)):
        hit = [x for x in accepted if within_distance(ids[x], ids[i], 40)]
        pairs |= {tuple(sorted((f"d{x}", f"d{i}"))) for x in hit}
        if not hit:
            accepted.append(i)
    rows = [(1, f"d{i}", T0 + timedelta(minutes=i)) for i in range(len(texts))]
    registry = [(f"d{i}", f"h{i}", f"http://s{i}.example/", "completed", 1, T0, T0) for i in range(len(texts))]
    found = repeated_deliveries(
        spark.createDataFrame(rows, "batch_no int, document_id string, received_at timestamp_ntz"),
        spark.createDataFrame(registry, "document_id string, content_hash string, source_url string, status string, version int, uploaded_at timestamp_ntz, updated_at timestamp_ntz"),
        spark.createDataFrame([(f"d{i}:v1:s0:c0:h", " ".join(t)) for i, t in enumerate(texts)], "node_id string, text string"),
    )
    assert {(r.document_id_a, r.document_id_b) for r in found.collect()} == pairs and accepted == [0, 1]


def test_a_batch_of_repeats_only(spark):
    text = " ".join(f"word{k}" for k in range(30))
    rows = [(1, "a", T0), (2, "b", T0), (2, "c", T0), (2, "c", T0), (3, "d", None), (None, "e", None), (3, None, T0)]
    registry = [(d, h, "http://s.example/", "completed", 1, T0, T0) for d, h in (("a", "h1"), ("b", None), ("c", "H1"), ("d", " "), ("e", None))]
    pages = [("a:v1:s0:c0:h", text), ("b:v1:s0:c0:h", text.upper()), ("c:v1:s0:c0:h", None), ("d:v1:s0:c0:h", "")]
    found = repeated_deliveries(
        spark.createDataFrame(rows, "batch_no int, document_id string, received_at timestamp_ntz"),
        spark.createDataFrame(registry, "document_id string, content_hash string, source_url string, status string, version int, uploaded_at timestamp_ntz, updated_at timestamp_ntz"),
        spark.createDataFrame(pages, "node_id string, text string"),
        gather=0,
    )
    assert sorted(map(tuple, found.collect())) == [("a", "b"), ("a", "c")]


def test_no_deliveries(spark):
    frames, _ = deliveries(spark, 9)
    assert repeated_deliveries(frames[0].where("false"), frames[1].where("false"), frames[2].where("false")).count() == 0


def test_languages():
    assert [language(t) for t in ("What are the rules for maps here?", "有甚麼規定？", "La biblioteca presta hasta tres libros por persona", "", "Der Saal ist für drei Tage zu")] == [
        "en", "zh", "es", "", "de"
    ]


def sound_rows(n):
    rnd = random.Random(10)
    nouns = ["maps", "atlases", "postcards", "board games", "picture books", "exam papers", "cookbooks", "pamphlets"]
    rows = []
    for i in range(n):
        noun, name, number = rnd.choice(nouns), f"{rnd.choice(['Ash', 'Bram', 'Cor', 'Dun', 'Elm'])}{rnd.choice(['ford', 'wick', 'ley', 'by'])}", rnd.randint(2, 60)
        answer = rnd.choice([
            f"Reserved {noun} are kept for {number} days at the counter of {name} and are then offered to the next reader.",
            f"Overdue {noun} are charged at {number} cents a day, up to a ceiling of 9 dollars for each item at {name}.",
            f"We are sorry that {noun} were unavailable at {name} on {number} May 2024; all fines have been waived.",
            f"Readers who lose {noun} should report the loss in person and quote the shelf mark shown by the {name} branch.",
        ])
        rows.append((i, f"What are the rules for {noun} at {name}?", answer, f"- {answer} Group visits to {name} are arranged on request."))
    return rows


def test_held_out_accuracy(spark):
    rows = sound_rows(500)
    schema = "id bigint, query string, expected_answer_text string, expected_context_snippet string"
    model = fit_defects(spark.createDataFrame(rows[:400], schema), 400)
    assert all(f1 > 0.9 for f1 in model.report.values()), model.report
    made = made_pairs([r for r in rows[400:]])
    labels = spark.createDataFrame([(i, q, a, s) for i, (q, a, s, _) in enumerate(made)], schema)
    found = {r.id: r.defect for r in defective_pairs(labels, model).collect()}
    right = sum(found.get(i, "") == d for i, (*_, d) in enumerate(made))
    assert right / len(made) > 0.93
    assert defective_pairs(labels.where("false")).count() == 0
    odd = spark.createDataFrame([(1, None, None, None), (1, None, None, None), (2, "Where?", "x" * 40000, ""), (3, "", "​", None)], schema)
    assert {r.id: r.defect for r in defective_pairs(odd, model).collect() if r.id != 2} == {1: "empty", 3: "empty"}


def test_evidence_places():
    place = lambda a, s: next(f for f in pair_features("What is it?", a, s) if f.startswith("p:place="))
    assert place("The hall opens at nine", "The hall opens at nine. More.") == "p:place=closed"
    assert place("The hall opens", "The hall opens at nine. More.") == "p:place=goes_on"
    assert place("at nine", "The hall opens at nine or so.") == "p:place=inside"

"""Broken question-answer pairs.

A multi-label linear classifier (empty, truncated, refusal, copies_question, other_language) over
hashed n-grams of the answer and features of the pair: how much of the answer is new against the
question, how much of it the evidence holds, where its last sentence stands in the evidence, and
which languages both are in. It is trained on pairs made from sound ones of the same table, whose
answers are cut, swapped, replaced by refusals, placeholders or the question; the threshold of each
defect is calibrated on made pairs that were held out. The score alone decides.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.boilerplate import plain_line

DEFECTS = ("empty", "truncated", "refusal", "copies_question", "other_language")
#: Sound pairs the classifier is fitted on at most, taken by hash of their id; part held out.
TRAIN_PAIRS, HELD_OUT = 5000, 4
#: Hashed features; passes over the made pairs, pairs in a step, length of a step and weight of the penalty.
N_FEATURES, EPOCHS, STEP_PAIRS, STEP, PENALTY = 1 << 16, 8, 256, 0.4, 1e-6
#: Thresholds whose F1 is so near the best count as good as it.
NEARLY = 0.001

# What stands in for an answer in the made pairs.
BLANKS = (
    "", " ", "\u200b", "-", "--", "---", "...", "…", ".", "?", "??", "*", "_", "/", "N/A", "n/a", "n.a.", "NA", "None", "none", "null", "NULL", "nil", "NaN", "undefined",
    "TBC", "TBD", "tbc", "TODO", "to do", "To be confirmed", "to be confirmed.", "To be added", "to be completed", "To follow", "Answer to follow", "answer to follow.", "Pending",
    "pending review", "See above", "see below", "as above", "Not available", "not available.", "Not applicable", "Unknown", "unknown", "blank", "(blank)", "[blank]", "(empty)",
    "[empty]", "void", "[no answer]", "No answer", "(no answer)", "No answer given", "no answer provided.", "Answer:", "A:", "Ans.", "Answer", "[answer]", "<answer>", "{answer}",
    "placeholder", "[placeholder]", "xxx", "XXXX", "test", "lorem ipsum", "[insert answer here]", "insert answer", "#N/A", "missing", "(missing)", "no data", "no text", "no content",
)
BLANKS_ZH = (
    "", "-", "--", "…", "？", "N/A", "n/a", "null", "TBC", "無", "无", "（無）", "暫無", "暂无", "待定", "待補", "待补", "待確認", "空白", "（空白）", "沒有答案", "没有答案", "不適用", "不适用",
    "未有答案", "答案：", "答：", "[答案]", "未填", "（未填寫）", "從缺", "略", "（略）", "沒有資料", "暫無資料", "請填寫",
)
# The commonest function words of languages in Latin letters.
FUNCTION_WORDS = {
    "en": "the of and to in is are for be by on at with from a an or not this that will can may you we it as they have has must "
    "i what who when where why how which should do does there any about before know need my me",
    "fr": "le la les des du de et est pour dans une un sur au aux qui que par ce cette sont être doit avec pas moins il en ne leur",
    "de": "der die das und ist für von den dem ein eine einer zu mit auf im wird werden sind nicht bei vor wegen pro sich aus zum",
    "es": "el la los las de y es para en un una por con del que se al su pueden debe hasta días cada antes sus como son no hay",
    "pt": "o a os as de e é para em um uma por com do da dos das que se ao no na até dias cada antes deve ser não são pelo pela",
    "it": "il lo la i gli le di e è per in un una da con del della che si al alla sono deve giorni ogni prima non come nel nella",
    "nl": "de het een en van in is voor op met te zijn niet aan bij worden wordt dat die door naar dagen elke moet kunnen of als",
}
# Parts of refusals for the made pairs.
REFUSAL_OPENERS = (
    "", "", "", "I'm sorry, but ", "Sorry, ", "Unfortunately, ", "I apologise: ", "My apologies. ", "I regret that ", "To be honest, ", "At this time ",
    "As a virtual assistant, ", "As an automated helper, ", "As an AI, ", "Thank you for asking, however ", "Based on what I was given, ", "I'm afraid ",
)
REFUSALS = (
    "I am unable to answer this question", "I'm not able to assist here", "I cannot help with that request", "I can't provide details of that kind",
    "I don't have enough information to respond", "I have no knowledge of this matter", "there is nothing in my sources on this",
    "that is something I can't look up", "I would rather not comment on that", "this lies outside what I may discuss", "I do not know the answer",
    "no answer could be given from the context", "the supplied passages do not say anything about it", "the context does not mention this",
    "I must decline to answer", "this question cannot be answered", "I can't discuss this topic", "I could not find any information about this",
    "the provided documents contain no relevant information", "I am not allowed to share that", "it is not possible for me to say",
)
REFUSAL_CLOSERS = (
    "", "", "", " Could you rephrase?", " Try again later.", " I hope you understand.", " Is there anything else I can do?",
    " Please contact the library.", ", so please ask a member of staff.",
)
REFUSALS_ZH = (
    "對不起，所提供的資料沒有相關內容。", "很遺憾，我不能提供這方面的協助。", "暫時未能解答閣下的提問。", "這超出我的服務範圍，請見諒。", "我沒有足夠資料回應，請直接向職員查詢。",
    "抱歉，我無法回答這個問題。", "我不便就此發表意見。", "未能找到有關資料，請稍後再試。", "對不起，我不清楚這件事。", "很抱歉，無法提供您所需的資訊。", "资料中没有提及，无法作答。",
)
# Dresses of a question given back, and openers and short answers that are sound.
DRESSES = (
    "{q}", "{q}", "{q} {q}", "Q: {q}", "Question: {q}", "You asked: {q}", "The question is: {q}", "You would like to know: {q}",
    "You would like to know: {q} — is that right?", "So you are asking: {q}", "Your question was: {q}", "You want to know {q}", "\"{q}\"",
)
DRESSES_ZH = ("{q}", "{q}{q}", "問題：{q}", "你想知道：{q}", "閣下的問題是：{q}", "請問{q}", "「{q}」")
SOUND_OPENERS = ("Sorry for the trouble. ", "Thank you for asking. ", "You asked about this. ", "Certainly. ", "Good question. ", "We apologise for the delay. ")
SHORT_SOUND = (
    "Yes", "No.", "Yes.", "No", "3 June 2024", "11.07.2022", "2025-10-19", "July 4, 2025", "Ground floor, {n} Library", "Level 3, {n} Library", "{n}", "Counter 2, {n} Library", "Room 4, {n} Library", "{n} Library", "Hall B", "On Monday", "Every Tuesday at 14:00", "15 days",
    "8 dollars", "From 9:00 to 17:30", "At the counter", "Free of charge", "On request", "有。", "不需要", "二樓", "免費", "8元", "需要。",
)
FOREIGN = (
    "Le prêt des livres est limité à {d} jours et peut être prolongé au comptoir de {n}.", "La salle de lecture de {n} est fermée pour travaux pendant {d} jours.",
    "Der Lesesaal in {n} bleibt wegen Bauarbeiten für {d} Tage geschlossen.", "Die Ausleihe in {n} ist auf {d} Bände pro Person begrenzt.",
    "La biblioteca de {n} abre todos los días y presta hasta {d} libros por persona.", "El archivo de {n} estará cerrado durante {d} días por obras en la sala.",
    "A biblioteca de {n} empresta até {d} livros por pessoa e o prazo pode ser renovado.", "O arquivo de {n} fica fechado durante {d} dias para obras na sala.",
    "La biblioteca di {n} presta fino a {d} libri per persona e il prestito si rinnova ogni mese.", "De bibliotheek in {n} is wegens werken {d} dagen gesloten.",
)
ZH_SENTENCES = ("申請者須於{d}日前把表格交到圖書館。", "讀者每次最多可借閱{d}冊圖書，借期為{d}天。", "閱覽室將暫停開放{d}天，原因是維修工程。", "如需使用服務，請到詢問處登記。")

HAN = re.compile(r"[㐀-鿿]")
TOKEN = re.compile(r"[㐀-鿿]|[^\W_㐀-鿿]+")
CLOSE = ".!?。！？"
BROKEN_OFF = re.compile(r"\s*(?:\.{2,}|…+|⋯+|\[[.…]*\]|\((?:see|cont\w*)?|[-–—])\s*$", re.I)
SENTENCES = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])|\n+")
ITEM = re.compile(r"^\s*(?:[-•*]\s+|[AQ]\d*\s*[:.)]\s*)")


def language(text: str) -> str:
    """zh, a language of FUNCTION_WORDS, another script, or '' if there is too little to tell."""
    if not text.isascii():
        letters = sum(c.isalpha() for c in text)
        if len(HAN.findall(text)) * 3 > letters:
            return "zh" if letters else ""
        if sum(not c.isascii() and ord(c) > 0x24F for c in text if c.isalpha()) * 2 > letters:
            return "other"
    words = re.findall(r"[^\W\d_]+", text.lower())
    hits = dict.fromkeys(_WORDS, 0)
    for w in words:
        for k in _LANGUAGES_OF.get(w, ()):
            hits[k] += 1
    best = max(hits, key=lambda k: (hits[k], k == "en"))
    if hits[best] < 2:
        return "en" if hits["en"] and len(words) > 3 else ""
    return best if best == "en" or hits[best] > hits["en"] else "en"


_WORDS = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}
_LANGUAGES_OF = {w: tuple(k for k, v in _WORDS.items() if w in v) for v in _WORDS.values() for w in v}


def _masked(word: str, first: bool) -> str:
    return "0" if word[0].isdigit() else "#" if word[:1].isupper() and not first else word.lower()


def pair_features(query: str | None, answer: str | None, snippet: str | None) -> list[str]:
    """The features of a pair as strings; nulls count as empty."""
    q, raw, s = (plain_line((x or "").replace("\n", " ")) for x in (query, answer, snippet))
    a = raw
    cut_mark = bool(m := BROKEN_OFF.search(a)) and len(a) > len(m[0])
    if cut_mark:
        a = a[: m.start()].rstrip()
    bare = re.sub(r"[\W_]+", "", raw.lower())
    ta, tq, ts = TOKEN.findall(a), set(TOKEN.findall(q.lower())), set(TOKEN.findall(s.lower()))
    n = len(ta)
    low = [t.lower() for t in ta]
    new = sum(t not in tq for t in low) / n if n else 1.0
    back = len(tq.intersection(low)) / len(tq) if tq else 0.0
    held = sum(t in ts for t in low) / n if n else 0.0
    lq, la = language(q), language(a)
    # Where the answer's last sentence stands in the evidence.
    closed = a[-1:] in tuple(CLOSE)
    body = a.rstrip(CLOSE + " ")
    sentence = next((x for x in reversed(SENTENCES.split(body)) if x.strip()), "").strip()
    place = "none"
    if len(sentence) >= 4 and s:
        at = s.find(sentence)
        if at < 0 and len(sentence) > 30:  # a dirty start does not matter
            tail = sentence[-30:]
            at = s.find(tail)
            before = "x"
            rest = s[at + len(tail) :] if at >= 0 else ""
            aligned = at >= 0
        else:
            rest = s[at + len(sentence) :] if at >= 0 else ""
            before = s[:at].rstrip() if at > 0 else ""
            aligned = not before or before[-1:] in tuple(CLOSE + ":-•*") or before[-1:] in "。"
        if at >= 0:
            place = "end" if not rest.strip() else "closed" if rest.lstrip()[:1] in tuple(CLOSE) else "goes_on" if aligned else "inside"
    ev = "blank" if not s else "some"
    out = [
        f"p:lang&place={lq and la and lq != la}&{place}", f"p:lang&held={lq and la and lq != la}&{int(held * 2)}",
        f"p:letters={min(len(bare), 6)}", f"p:len={min(n // 6, 6)}",
        f"p:new={int(new * 5)}", f"p:back={int(back * 5)}", f"p:new&back={int(new * 5)}&{int(back * 5)}",
        f"p:held={int(held * 5) if s else 'x'}", f"p:lang={'same' if not lq or not la or lq == la else 'differs'}",
        f"p:place={place}", f"p:place&closed={place}&{closed}&{cut_mark}", f"p:closed={closed}", f"p:cut={cut_mark}", f"p:evidence={ev}",
        f"p:place&long={place}&{n > 5}&{closed}",
    ]
    if HAN.search(a):
        words = [("0" if t.isdigit() else t) for t in ta]
    else:
        words = [_masked(t, k == 0) for k, t in enumerate(ta)]
    out += [f"w:{w}" for w in words] + [f"b:{x} {y}" for x, y in zip(words, words[1:])]
    out += ["h:" + " ".join(words[:k]) for k in (1, 2, 3)]
    if place == "none" and n:
        out += [f"t{closed}:" + " ".join(words[-k:]) for k in (1, 2, 3)]
        out.append(f"t:last={min(len(ta[-1]), 4)}&{words[-1] in {'#', '0'}}&{closed}")
    # What speaks for and against a defect, taken together.
    complete = closed and not cut_mark
    differs = bool(lq and la and lq != la)
    rests = "closed" if place in ("closed", "inside") else "complete" if complete and place in ("none", "end") else "open"
    out += [
        f"e:rests={rests}&{new < 0.1}&{n > 0}", f"e:rests&new={rests}&{int(new * 3)}&{cut_mark}", f"e:held={held >= 0.7 and n > 3}&{bool(s)}",
        f"e:copied={new <= 0.55 and back >= 0.6}", f"e:copied&new={new <= 0.2}&{back >= 0.8}", f"e:lang={differs}", f"e:lang&names={la}&{differs}", f"e:words={min(n, 8)}",
        f"e:says={n > 0}&{len(bare) > 14}", f"e:short&held={n < 8}&{held >= 0.5}&{closed}", f"e:bracket={raw[:1] in '([{<（［'}&{n < 8}", "bias",
    ]
    if n < 8:
        text = f"^{bare[:40]}$"
        out += [f"c:{text[i : i + 3]}" for i in range(len(text) - 2)] + [f"all:{text}"]
    return out


def hashed_features(query: str | None, answer: str | None, snippet: str | None) -> list[int]:
    """The places of a pair's features among N_FEATURES, each once."""
    return sorted({xxhash.xxh32_intdigest(f.encode("utf-8", "replace")) % N_FEATURES for f in pair_features(query, answer, snippet)})


def made_pairs(rows: list[tuple]) -> list[tuple[str, str, str, str]]:
    """(query, answer, snippet, defect or '') made from sound rows (id, query, answer, snippet)."""
    zh = [r[2] for r in rows if HAN.search(r[2] or "")]
    en = [r[2] for r in rows if r[2] and not HAN.search(r[2])]
    out = []
    for ident, q, a, s in rows:
        rnd = random.Random(int(ident or 0) * 7919 + 17)
        chinese = bool(HAN.search(q))
        name = next(iter(re.findall(r"\b[A-ZÀ-Þ]\w{4,}", a)), "Ashby")
        number = str(rnd.randint(2, 60))
        without = lambda: s if rnd.random() < 0.6 else rnd.choice(("", s[: max(20, len(s) // 3)]))  # noqa: E731, B023
        bare = a.rstrip(CLOSE)
        out.append((q, a, without(), ""))
        if rnd.random() < 0.6:
            out.append((q, bare, without(), ""))
        for _ in range(2):
            short = [x for x in SHORT_SOUND if bool(HAN.search(x)) == chinese]
            out.append((q, rnd.choice(short).format(n=name), s, ""))
        if rnd.random() < 0.3 and not chinese:
            out.append((q, rnd.choice(SOUND_OPENERS) + a, s, ""))
        for _ in range(2):
            low = max(4, len(bare) // 6) if chinese else 12
            if len(bare) > low + 4:
                at = rnd.randint(low, len(bare) - 3)
                if not chinese and rnd.random() < 0.6:
                    at = bare.rfind(" ", 0, at + 1)
                part = bare[:at].rstrip(" ,，、;；") if at > 0 else ""
                if len(part) >= 4 and part[-1] not in CLOSE:
                    out.append((q, part + rnd.choice(("", "", "", "", "...", "…", "……", " [...]", " (see")), without(), "truncated"))
        if chinese and rnd.random() < 0.9:
            out.append((q, rnd.choice(REFUSALS_ZH), s, "refusal"))
        else:
            core = rnd.choice(REFUSALS)
            opener = rnd.choice(REFUSAL_OPENERS)
            core = core if opener and not opener.endswith(". ") else core[0].upper() + core[1:]
            closer = rnd.choice(REFUSAL_CLOSERS)
            end = "" if closer.startswith(",") else rnd.choice((".", ".", "!", ""))
            more = f" The {name} desk may know more." if rnd.random() < 0.3 else ""
            out.append((q, opener + core + end + closer + more, s, "refusal"))
        dress = rnd.choice(DRESSES_ZH if chinese else DRESSES)
        asked = q if rnd.random() < 0.6 else q.rstrip("?？.") + rnd.choice(("", ".", "。" if chinese else "."))
        asked = asked if rnd.random() < 0.7 else asked.lower()
        out.append((q, dress.format(q=asked), s, "copies_question"))
        for told in (0, 1):
            if chinese:
                foreign = rnd.choice(en) if en and (told or rnd.random() < 0.4) else rnd.choice(FOREIGN).format(n="Ashby", d=number)
            else:
                foreign = rnd.choice(zh or list(ZH_SENTENCES)) if told or rnd.random() < 0.2 else rnd.choice(FOREIGN).format(n=name, d=number)
            foreign = foreign.replace("{d}", number)
            foreign = foreign if rnd.random() < 0.7 else foreign.rstrip(CLOSE)
            # Its evidence may be in its own language, and hold it.
            out.append((q, foreign, rnd.choice((foreign, f"{rnd.choice(zh or en or [s])} {foreign}", s, "")), "other_language"))
        for _ in range(2):
            out.append((q, rnd.choice(BLANKS_ZH if chinese else BLANKS), without(), "empty"))
    return out


def training_pairs(labels: DataFrame, train_pairs: int = TRAIN_PAIRS) -> DataFrame:
    """`key, features, defect` of pairs made from at most `train_pairs` sound labels; the key tells pairs apart.

    Sound: an answer of over 20 characters that ends a sentence and stands in its evidence.
    """
    sound = labels.where(
        (F.length("expected_answer_text") > 20)
        & F.col("expected_answer_text").rlike(r"[.。]\s*$")
        & F.expr("contains(expected_context_snippet, expected_answer_text)")
        & (F.length("query") > 3)
    )
    sound = sound.dropDuplicates(["query", "expected_answer_text"]).orderBy(F.xxhash64("id", "query")).limit(train_pairs)
    sound = sound.select("id", "query", "expected_answer_text", "expected_context_snippet").repartition(6, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = made_pairs(list(zip(*(batch.column(i).to_pylist() for i in range(4)))))
            keys = [xxhash.xxh64_intdigest("\x00".join((q, a, s or "", d)).encode("utf-8", "replace")) >> 1 for q, a, s, d in made]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array([hashed_features(q, a, s) for q, a, s, _ in made], pa.list_(pa.int32())), pa.array([d for *_, d in made], pa.string())],
                names=["key", "features", "defect"],
            )

    return sound.mapInArrow(run, "key bigint, features array<int>, defect string")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fitted_weights(rows: list[np.ndarray], target: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression on sparse binary rows, by steps scaled to each feature's history."""
    weights, history = np.zeros(N_FEATURES), np.full(N_FEATURES, 1e-6)
    sizes = np.array([len(r) for r in rows])
    flat, ends = np.concatenate(rows), np.cumsum(sizes)
    for _ in range(EPOCHS):
        for at in range(0, len(rows), STEP_PAIRS):
            to = min(at + STEP_PAIRS, len(rows))
            features = flat[ends[at] - sizes[at] : ends[to - 1]]
            pair = np.repeat(np.arange(to - at), sizes[at:to])
            off = _sigmoid(np.bincount(pair, weights[features], to - at)) - target[at:to]
            slope = np.bincount(features, off[pair], N_FEATURES) / (to - at) + PENALTY * weights
            history += slope * slope
            weights -= STEP * slope / np.sqrt(history)
    return weights


class DefectModel:
    """Weights and threshold of each defect, in the order of DEFECTS, and its F1 on held-out made pairs."""

    def __init__(self, weights: np.ndarray, thresholds: list[float], report: dict[str, float]):
        self.weights, self.thresholds, self.report = weights, thresholds, report

    def scored(self, labels: DataFrame) -> DataFrame:
        """`id, scores` of every label: the probability of each defect, in the order of DEFECTS."""
        weights = np.ascontiguousarray(self.weights.T)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                scores = [_sigmoid(weights[hashed_features(*row)].sum(axis=0)) for row in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)))]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.list_(pa.float64()))], names=["id", "scores"])

        return labels.select("id", "query", "expected_answer_text", "expected_context_snippet").mapInArrow(run, "id bigint, scores array<double>")


def fit_defects(labels: DataFrame, train_pairs: int = TRAIN_PAIRS) -> DefectModel | None:
    """The classifier fitted on pairs made from `labels`; None if they hold no sound pair.

    Each defect is fitted by a task of its own on the same bounded sample. Its threshold is the
    middle one of those whose F1 on the held-out pairs is within NEARLY of the best.
    """
    made = training_pairs(labels, train_pairs).withColumn("label", F.explode(F.array(*map(F.lit, DEFECTS))))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("key").sort_values("key")  # the order of the rows must not depend on the cluster
        rows, target = [np.asarray(f) for f in pdf["features"]], (pdf["defect"] == pdf["label"]).to_numpy(dtype=float)
        held = (pdf["key"] // 7 % HELD_OUT == 0).to_numpy()
        weights = fitted_weights([r for r, h in zip(rows, held) if not h], target[~held])
        p = _sigmoid(np.array([weights[r].sum() for r, h in zip(rows, held) if h]))
        order = np.argsort(-p, kind="stable")
        p, good = p[order], np.cumsum(target[held][order])
        f1 = 2 * good / (np.arange(1, len(p) + 1) + max(1.0, target[held].sum()))
        best = f1.max() if len(p) else 0.0
        good_ones = p[f1 >= best - NEARLY] if len(p) else np.array([0.5])
        threshold = (good_ones.min() + good_ones.max()) / 2
        return pd.DataFrame({"label": [pdf["label"].iloc[0]], "weights": [weights], "threshold": [float(threshold)], "f1": [float(best)]})

    found = {r.label: r for r in made.groupBy("label").applyInPandas(fit, "label string, weights array<double>, threshold double, f1 double").collect()}  # five rows
    if not found:
        return None
    return DefectModel(np.array([found[d].weights for d in DEFECTS]), [found[d].threshold for d in DEFECTS], {d: found[d].f1 for d in DEFECTS})


def labelled_defects(labels: DataFrame, model: DefectModel) -> DataFrame:
    """`id, defects` of every label: all defects it has by their thresholds, the surest first."""
    margins = [
        F.struct(((F.col("scores")[k] - t) / max(1.0 - t, 1e-9)).alias("margin"), F.lit(d).alias("defect"))
        for k, (d, t) in enumerate(zip(DEFECTS, model.thresholds))
    ]
    return model.scored(labels).select("id", F.reverse(F.array_sort(F.filter(F.array(*margins), lambda m: m["margin"] >= 0))).alias("defects"))


def defective_pairs(labels: DataFrame, model: DefectModel | None = None, train_pairs: int = TRAIN_PAIRS) -> DataFrame:
    """`id, defect` of each defective label, the most certain defect only.

    Doubled rows give one case; rows of one id that differ are judged each, the defect of the
    surest one counts. Null, blank or missing queries and snippets are no defect; without any
    sound pair to train on (as in an empty table) only answers without a letter or digit are found. Training is on a
    bounded sample, scoring covers every row.
    """
    rows = labels.select("id", "query", "expected_answer_text", "expected_context_snippet").distinct()
    model = model or fit_defects(rows, train_pairs)
    if model is None:
        says = F.coalesce("expected_answer_text", F.lit("")).rlike(r"[\p{L}\p{N}]")
        return rows.where(~says).select("id", F.lit("empty").alias("defect")).distinct()
    best = labelled_defects(rows, model).where(F.size("defects") > 0).select("id", F.col("defects")[0].alias("best"))
    return best.groupBy("id").agg(F.max("best").alias("best")).select("id", "best.defect")

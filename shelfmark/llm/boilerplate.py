"""The main body of web pages, apart from the frame of their site.

The pages come as text, so each line gets the path it would have had in the page's tree: the
form of its block (list item, link row, heading, paragraph), the words it opens with, and its
whole form without names and numbers. Text length and punctuation are added up per path, the
share of lines that stand in many pages of their site is smoothed towards the corpus, both are
fused into a ratio of frame to content, and paths beyond a threshold are taken as frame. Side
blocks are followed from their heading to the last of their links.
"""

from __future__ import annotations

import re
import struct
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.canonical import LOOK_ALIKES
from shelfmark.operators.registry import document_of, document_sites
from shelfmark.session import BROADCAST_ROWS, let_go, measured, small_or_not, written

#: A line form is the site's own from so many different pages on.
MIN_PAGES = 4
#: A path is frame from this ratio on; lines of corpus-wide prior in the smoothing.
THRESHOLD, PRIOR = 0.25, 4.0
#: Pages after the first at which the repetition of one line counts half.
HALF_PAGES = 12.0
#: Share of its occurrences after which two links must follow for a frame line to head a side block.
HEAD_SHARE = 0.3

# Openings of link rows that differ on every page.
LINK_LEADS = ("tags:", "標籤:", "標籤：", "标签：", "previous:", "next:", "←", "→", "«", "上一頁", "下一頁", "上一篇", "下一篇")
HOME_LEADS = ("home", "主頁", "主页", "首頁", "首页")
# Marks between the links of a row, before an item, and at the end of a sentence;
# numbers (streets, telephones, dates) belong to content as well. Plain lines have single spaces only, and
# patterns that begin with one set of characters are searched for several times as fast as alternatives.
LINK_MARKS = re.compile(r" [/|·›>»→←«]+ ")
ITEM_MARK = re.compile(r"^([-–•·›»*▪‣]+)\s*")
SENTENCE_END = re.compile(r"[.!?。！？…;；:：\d](?:(?<=\d)|(?<=[.!?。！？])(?:['\"”’」）)]*$|\s)|(?<=[…;；:：])$)")
CLOSING = ".!?:;,。… "
PUNCTUATION = re.compile(r"[,.;:!?，。；：！？、]")

_HAN = re.compile(r"[㐀-鿿]")
_DIGITS = re.compile(r"\d\d*")
_ZEROS = bytes.maketrans(b"123456789", b"000000000")
_NAMES = re.compile(r" [A-Z][^ ]*(?: [A-Z][^ ]*)*")
_PLAIN = {**{ord(k): v for k, v in LOOK_ALIKES.items()}, **dict.fromkeys(map(ord, "​‌‍⁠﻿­"))}
ODD = re.compile("[" + "".join(map(chr, _PLAIN)) + "]")
_LATIN = re.compile(r"[a-zA-Z]")


def plain_line(line: str) -> str:
    """A line in compatibility form, without invisible characters and look-alikes in Latin words."""
    if line.isascii():
        return " ".join(line.split())
    line = unicodedata.normalize("NFKC", line)
    if ODD.search(line):
        line = " ".join([w.translate(_PLAIN) if _LATIN.search(w) else w for w in line.split(" ")])
    return " ".join(line.split())


def _without_numbers(line: str) -> str:
    """Each run of digits as one 0."""
    if not line.isascii():
        return _DIGITS.sub("0", line)
    line = line.encode().translate(_ZEROS).decode()
    while "00" in line:
        line = line.replace("00", "0")
    return line


def _nameless(line: str, exact: str) -> str:
    """The words of `exact`, the form of `line`, with # for each row of names."""
    if line.isupper():
        return exact
    if line.isascii():
        path = _without_numbers(_NAMES.sub(" #", line).lower()).rstrip(CLOSING)
    else:
        words, originals = exact.split(), line.split()
        path = " ".join(words[:1] + ["#" if o[0].isupper() else w for o, w in zip(originals[1:], words[1:])])
    path += " "
    at = path.index(" ")
    if line[0].isupper() and path.startswith(" # ", at):  # a name that opens the line
        path = path[at + 1 :]
    path = f" {path}"
    while " # # " in path:
        path = path.replace(" # # ", " # ")
    return path[1:-1]


def line_paths(line: str) -> tuple[str, str, str, str]:
    """(item mark, exact form, whole path, leading path) of a plain line that isn't blank."""
    mark = ""
    if m := ITEM_MARK.match(line):
        mark, line = m[1], line[m.end() :]
    low = line.lower()
    exact = _without_numbers(low).rstrip(CLOSING)
    if not exact:
        return mark, mark, mark, mark
    if not line.isascii() and _HAN.search(line):
        if LINK_MARKS.search(line):
            return mark, exact, f"rows/{exact}", "rows/" + LINK_MARKS.split(exact, maxsplit=1)[0]
        return mark, exact, f"text/{exact}", f"text/{exact[:6]}"
    path = _nameless(line, exact)
    if LINK_MARKS.search(line):
        first = LINK_MARKS.split(exact, maxsplit=1)[0]
        return mark, exact, "rows/" + path.replace(" ", "/"), "rows/" + "/".join(first.split()[:4])
    block = "item" if mark else "head" if low.startswith("##") else "text"
    return mark, exact, f"{block}/" + path.replace(" ", "/"), f"{block}/" + "/".join(path.split(" ", 4)[:4])


#: What is told of a line: its paths and mark as hashes, its measures, and BLANK, LINKISH, SURE and DOUBLED.
LINE = np.dtype([(c, "<i8") for c in ("form", "whole", "lead", "mark")] + [("length", "<i4"), ("punctuation", "<i4"), ("flags", "u1")])
PACKED = struct.Struct("<qqqqiiB")
BLANK, LINKISH, SURE, DOUBLED = 1, 2, 4, 8
DOCUMENT_SCHEMA = (
    "k string, doc string, site bigint, nodes array<string>, indexes array<int>, counts array<int>, contexts array<bigint>, "
    "lines binary, n int, length bigint, punctuation bigint, text string"
)
DOCUMENT_TYPES = [pa.string(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64())]
DOCUMENT_TYPES += [pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
#: Shorter lines are told once by a task, as long as it remembers them.
SEEN_LENGTH = 400
#: Characters of text in one batch of documents, and bytes of their lines that are looked at together.
BATCH_CHARS, BATCH_BYTES = 1 << 20, 4 << 20
#: A link is shorter than this.
LINK_LENGTH = 140
_INDEX = re.compile(r":s(\d+):c(\d+):")
def _hash(s: str) -> int:
    return xxhash.xxh64_intdigest(s.encode("utf-8", "replace")) - (1 << 63)


@cache
def _mark(mark: str) -> int:
    return _hash(mark)


def _told(raw: str) -> bytes:
    """What LINE holds of one line."""
    line = plain_line(raw)
    if not line:
        return PACKED.pack(0, 0, 0, _mark(""), 0, 0, BLANK)
    mark, exact, whole, lead = line_paths(line)
    row = lead.startswith("rows/")
    # A row of links whose words differ on every page has its opening as its path.
    opening = None
    if line.startswith(LINK_LEADS) or exact.startswith(LINK_LEADS):
        opening = next(x for x in LINK_LEADS if line.startswith(x) or exact.startswith(x))
    lead = f"rows/{opening}" if opening else lead
    sure = opening is not None or row and lead[5:].strip() in HOME_LEADS
    linkish = not row and len(line) < LINK_LENGTH and not exact.startswith("#") and not SENTENCE_END.search(line)
    return PACKED.pack(_hash(exact), _hash(whole), _hash(lead), _mark(mark), len(line), len(PUNCTUATION.findall(line)), LINKISH * linkish | SURE * sure)


def page_documents(pages: DataFrame, sites: DataFrame, with_text: bool = False) -> DataFrame:
    """DOCUMENT_SCHEMA: the lines of `pages(node_id, text)` by document, in order, with the site of the document in
    `sites(document_id, site)`, 0 for none; null texts have no lines, and documents without lines no row.

    Each has its chunks as they follow (`nodes`, `indexes`, how many lines, `contexts`), its lines as LINE, and the
    sums over those that aren't blank. Chunks without a document stand alone, by `k`. The context is the chunk's
    longest line: copies of a page share it and count once. Lines of a doubled chunk are marked. The text is null
    unless asked for.
    """

    def document(k: str | None, chunks: list[tuple]) -> tuple:
        m = [_INDEX.search(c[0] or "") for c in chunks]
        placed = sorted(((int(x[2]) if x else 0, c[0] is not None, c[0] or "", c[2], c[0]) for x, c in zip(m, chunks)), key=lambda c: c[:4])
        rows, counts, contexts, doubled, held = [], [], [], [], 0
        for j, (*_, text, node) in enumerate(placed):
            lines = text.split("\n")
            contexts.append(_hash("".join(max(lines, key=len).split()).lower()))
            held = held if j and node == placed[j - 1][-1] else 0
            if held:
                doubled.append((len(rows), len(rows) + min(held, len(lines))))
            held = max(held, len(lines))
            counts.append(len(lines))
            for raw in lines:
                known = seen.get(raw)
                if known is None:
                    known = _told(raw)
                    if len(raw) < SEEN_LENGTH:
                        if len(seen) > 50_000:
                            seen.clear()
                        seen[raw] = known
                rows.append(known)
        packed = b"".join(rows)
        told = np.frombuffer(packed, LINE)
        if doubled:
            told = told.copy()
            for a, b in doubled:
                told["flags"][a:b] |= DOUBLED
            packed = told.tobytes()
        n = len(rows) - int((told["flags"] & BLANK).sum())
        sums = [int(told[c].sum(dtype=np.int64)) for c in ("length", "punctuation")]
        text = "\n".join(c[3] for c in placed) if with_text else None
        return (k, chunks[0][1], chunks[0][3], [c[4] for c in placed], [c[0] for c in placed], counts, contexts, packed, n, *sums, text)

    seen: dict[str, bytes] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in DOCUMENT_SCHEMA.split(", ")]
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), DOCUMENT_TYPES)], names=names)
        rows, chars = [], 0
        chunks = (c for b in batches for c in zip(*(b.column(i).to_pylist() for i in range(5))))
        for k, own in groupby(chunks, lambda c: c[0]):
            rows.append(document(k, [c[1:] for c in own]))
            chars += len(rows[-1][7]) + len(rows[-1][11] or "")
            if chars > BATCH_CHARS:
                yield batch(rows)
                rows, chars = [], 0
        if rows:
            yield batch(rows)

    picked = pages.select("node_id", document_of(F.col("node_id")).alias("doc"), F.col("text").cast("string").alias("text"))
    picked = picked.where("text is not null").join(sites, picked.doc == sites.document_id, "left")
    picked = picked.select(F.coalesce("doc", "node_id").alias("k"), "node_id", "doc", "text", F.coalesce("site", F.lit(0).cast("bigint")).alias("site"))
    return picked.repartition("k").sortWithinPartitions("k").mapInArrow(run, DOCUMENT_SCHEMA)


def _form_keys(site: np.ndarray, form: np.ndarray) -> np.ndarray:
    """The form within its site, as one number."""
    with np.errstate(over="ignore"):
        h = form.view(np.uint64) ^ (site.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return (h ^ (h >> np.uint64(32))).view(np.int64)


class _Lines:
    """The lines of a batch of documents as arrays: `told` (LINE), `owner` (the place of its document), `key`."""

    def __init__(self, batch: pa.RecordBatch):
        packed = batch.column("lines").to_pylist()
        self.told = np.frombuffer(b"".join(packed), LINE)
        self.n = np.array([len(p) // LINE.itemsize for p in packed], dtype=np.int64)
        self.owner = np.repeat(np.arange(len(packed)), self.n)
        self.begin = np.cumsum(self.n) - self.n
        self.key = _form_keys(batch.column("site").to_numpy(zero_copy_only=False)[self.owner], self.told["form"].copy())

    def flag(self, flag: int) -> np.ndarray:
        return (self.told["flags"] & flag) > 0

    def within(self, batch: pa.RecordBatch, name: str, column: np.ndarray, found: np.ndarray | None) -> np.ndarray:
        """Whether each line's `column` is found; the places of those that are stand in the batch where `found` isn't at hand."""
        out = np.zeros(len(self.told), dtype=bool)
        if found is None:
            for k, places in enumerate(batch.column(name).to_pylist()):
                out[self.begin[k] + np.array(places or [], dtype=np.int64)] = True
        elif len(found):
            at = np.minimum(np.searchsorted(found, column), len(found) - 1)
            out = found[at] == column
        return out


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, so few at once that their lines take about BATCH_BYTES."""
    for batch in batches:
        sizes = np.cumsum(pc.binary_length(batch.column("lines")).to_numpy(zero_copy_only=False).astype(np.int64))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(sizes, (sizes[first - 1] if first else 0) + BATCH_BYTES, "right")))
            yield batch.slice(first, last - first)
            first = last


def flat_lines(documents: DataFrame, schema: str) -> DataFrame:
    """The columns of `schema` of every line that isn't blank: k and place (its number in the document), context, key, sure, and those of LINE."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in schema.split(", ")]
        for batch in _pieces(batches):
            lines = _Lines(batch)
            shown = np.flatnonzero(~lines.flag(BLANK))
            owner = lines.owner[shown]
            columns = []
            for name in names:
                if name == "k":
                    columns.append(batch.column("k").take(pa.array(owner)))
                elif name == "place":
                    columns.append(pa.array((shown - lines.begin[owner]).astype(np.int32)))
                elif name == "context":
                    counts = np.concatenate(batch.column("counts").to_pylist() or [[]]).astype(np.int64)
                    columns.append(pa.array(np.repeat(np.concatenate(batch.column("contexts").to_pylist() or [[]]).astype(np.int64), counts)[shown]))
                else:
                    columns.append(pa.array(lines.key[shown] if name == "key" else lines.flag(SURE)[shown] if name == "sure" else lines.told[name][shown]))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    needed = ["site", "lines", *["k"] * ("k string" in schema), *["counts", "contexts"] * ("context" in schema)]
    return documents.select(*needed).mapInArrow(run, schema)


PATH_SCHEMA = "path bigint, n bigint, repeated bigint, length bigint, punctuation bigint"


def _path_sums(batches: Iterator[pa.RecordBatch], own: np.ndarray, shared: np.ndarray) -> Iterator[pa.RecordBatch]:
    """PATH_SCHEMA: the lines of each path in some documents, how many of them are repeated, and their measures."""
    for batch in _pieces(batches):
        lines = _Lines(batch)
        told = lines.told
        repeated = lines.within(batch, "own", lines.key, own) | lines.within(batch, "shared", told["form"], shared) | lines.flag(SURE)
        shown = np.flatnonzero(~lines.flag(BLANK))
        path, group = np.unique(np.concatenate((told["whole"][shown], told["lead"][shown])), return_inverse=True)
        add = lambda x: pa.array(np.bincount(group, np.tile(x[shown], 2), len(path)).astype(np.int64))  # noqa: B023, E731
        columns = [pa.array(path), *map(add, (np.ones(len(told)), repeated, told["length"], told["punctuation"]))]
        yield pa.RecordBatch.from_arrays(columns, names=["path", "n", "repeated", "length", "punctuation"])


def _ratio(share: F.Column, content: F.Column) -> F.Column:
    """How much a path is frame: long, well-punctuated paths must repeat more before they count as such."""
    return share / (share + 0.3 * (1 - share) * (1 + F.least(content, F.lit(3.0))))


def _few(found: DataFrame, at_hand: int) -> np.ndarray | None:
    """The values of the first column in order, if they are no more than `at_hand`."""
    values = found.limit(at_hand + 1).toArrow().column(0).to_numpy()
    return np.sort(values) if len(values) <= at_hand else None


class Framed:
    """Documents with what tells their frame; `told` gives it of one batch of them."""

    def __init__(self, documents: DataFrame, paths: DataFrame, own: DataFrame, at_hand: int):
        self.documents, self.at_hand = documents, at_hand
        self.sets: dict[str, np.ndarray | None] = {}
        self.find("own", "key", own)
        self.find("w_path", "whole", paths)
        self.find("l_path", "lead", paths)

    def find(self, name: str, column: str, found: DataFrame) -> None:
        """Tell the lines whose `column` is among the rows of `found`: by their values if they are few, else by a join."""
        self.sets[name] = _few(found, self.at_hand)
        if self.sets[name] is not None:
            return
        held = flat_lines(self.documents, f"k string, place int, {column} bigint").join(found.select(F.col(found.columns[0]).alias(column)), column, "left_semi")
        held = held.groupBy(F.col("k").alias("held_k")).agg(F.collect_list("place").alias(name))
        self.documents = written(self.documents.join(held, F.col("k").eqNullSafe(F.col("held_k")), "left").drop("held_k"), "held", codec="zstd")

    def run(self, columns: list[str], tell: Callable[[pa.RecordBatch, _Lines, dict[str, np.ndarray]], pa.RecordBatch], schema: str) -> DataFrame:
        sets = dict(self.sets)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _pieces(batches):
                lines = _Lines(batch)
                yield tell(batch, lines, _judged(batch, lines, sets))

        asked = list(dict.fromkeys(["site", "lines", *columns, *[k for k, v in sets.items() if v is None]]))
        return self.documents.select(*asked).mapInArrow(run, schema)


def _judged(batch: pa.RecordBatch, lines: _Lines, sets: dict[str, np.ndarray | None]) -> dict[str, np.ndarray]:
    """`at`, the lines that aren't doubled in their order, and of each: base, next_two (whether two links follow) and, once heads are known, frame."""
    base = lines.within(batch, "own", lines.key, sets["own"])
    for name, column in (("w_path", "whole"), ("l_path", "lead")):
        base |= lines.within(batch, name, lines.told[column], sets[name])
    base &= ~lines.flag(BLANK)
    at = np.flatnonzero(~lines.flag(DOUBLED))
    owner, base, mark = lines.owner[at], base[at], lines.told["mark"][at]
    link = lines.flag(LINKISH)[at] & ~base
    same = np.append(owner[1:] == owner[:-1], False)  # whether the next line is of the same document
    follows = same & np.append(link[1:], False)
    out = {"at": at, "base": base, "next_two": follows & np.append(follows[1:], False)}
    if "head" in sets:
        head = base & lines.within(batch, "head", lines.told["whole"], sets["head"])[at]
        # A block runs from its heading over links with one mark; anything else ends it.
        after = np.append(False, same[:-1])[: len(at)]  # whether there is a line before
        before_alike = after & np.append(False, mark[1:] == mark[:-1])[: len(at)]
        after_head = after & np.append(False, head[:-1])[: len(at)]
        broken = ~head & (~link | (~after_head & ~before_alike))
        block = np.cumsum(broken)
        headed = np.maximum.accumulate(np.where(head, block, -1)) if len(at) else block
        out["frame"] = base | (link & ~broken & (headed == block))
    return out


def framed(pages: DataFrame, registry: DataFrame, with_text: bool = False, at_hand: int = BROADCAST_ROWS) -> Framed:
    """The documents of `pages` and what tells the frame of each of their lines.

    Pages without a URL share no site but take part in the paths; unknown documents count as
    pages without a URL. Null texts have no lines. Statistics are hashes and counts, aggregated
    before they are shuffled; a hot site or line is only ever counted. The lines of one document
    are in one row, never those of a site. Up to `at_hand` forms, paths or headings of the frame
    go to the tasks as they are; more are joined.
    """
    sites = small_or_not(document_sites(registry).select("document_id", F.xxhash64("site").alias("site")), "sites")
    sums = {c: F.sum(c) for c in ("length", "punctuation")}
    documents, seen = measured(page_documents(pages, sites, with_text), "frame", codec="zstd", lines=F.sum("n"), **sums)
    mean = lambda c, seen: F.lit(seen[c] / seen["lines"] if seen.get("lines") else None).cast("double")

    # The most specific path is a line's form within its site. Its pages are told apart by context; they
    # and what is written in it give its ratio.
    told = flat_lines(documents, "key bigint, form bigint, context bigint, length int, punctuation int")
    forms = told.groupBy("key", "form", "context").agg(F.max("length").alias("length"), F.max("punctuation").alias("punctuation"))
    forms = written(forms.groupBy("key", "form").agg(F.count("*").alias("count"), F.avg("length").alias("length"), F.avg("punctuation").alias("punctuation")), "forms")
    content = F.sqrt(F.col("length") / mean("length", seen) * F.col("punctuation") / (mean("punctuation", seen) + F.lit(1e-9)))
    pages = F.col("count") - 1
    sited = forms.where(F.col("count") >= MIN_PAGES)
    own = small_or_not(sited.where(_ratio(pages / (pages + HALF_PAGES), content) >= THRESHOLD).select(F.col("key").alias("own_key")), "own")
    # Phrases that several sites share, each too seldom to tell by itself.
    shared = forms.groupBy("form").agg(F.sum("count").alias("pages"), F.count("*").alias("sites"))
    shared = shared.where((F.col("pages") >= 2 * MIN_PAGES) & (F.col("sites") >= 2)).select(F.col("form").alias("shared_form"))
    shared = small_or_not(shared, "shared")
    let_go(forms, sites)
    # What speaks for the frame: the line is repeated, or opens like a row of links.
    few = [_few(own, at_hand), _few(shared, at_hand)]
    if all(x is not None for x in few):
        paths = documents.select("site", "lines").mapInArrow(lambda batches: _path_sums(batches, *few), PATH_SCHEMA)
    else:
        marked = flat_lines(documents, "key bigint, form bigint, whole bigint, lead bigint, sure boolean, length int, punctuation int")
        marked = marked.join(own, marked.key == own.own_key, "left").join(shared, marked.form == shared.shared_form, "left")
        marked = marked.withColumn("own", F.col("own_key").isNotNull() | F.col("shared_form").isNotNull() | F.col("sure"))
        paths = marked.select(F.explode(F.array("whole", "lead")).alias("path"), F.lit(1).alias("n"), F.col("own").cast("int").alias("repeated"), *sums)
    paths = paths.groupBy("path").agg(*[F.sum(c).alias(c) for c in ("n", "repeated", *sums)])
    # Each line counts in two paths, so the means over the paths are those over the lines.
    paths, seen = measured(paths, "scored", lines=F.sum("n"), repeated=F.sum("repeated"), **sums)
    smooth = lambda x: (F.col(x) + PRIOR * mean(x, seen) * F.lit(0.1)) / (F.col("n") + PRIOR * F.lit(0.1))
    scored = paths.select(
        "path", "n", smooth("repeated").alias("share"),
        F.sqrt(smooth("length") / mean("length", seen) * smooth("punctuation") / (mean("punctuation", seen) + F.lit(1e-9))).alias("content"),
    )
    frame_paths = scored.where((F.col("n") >= 4) & (_ratio(F.col("share"), F.col("content")) >= THRESHOLD)).select("path")
    frame_paths = written(frame_paths, "paths")
    out = Framed(documents, frame_paths, own, at_hand)

    def heads(batch: pa.RecordBatch, lines: _Lines, told: dict[str, np.ndarray]) -> pa.RecordBatch:
        at = told["at"][told["base"]]
        whole, group = np.unique(lines.told["whole"][at], return_inverse=True)
        n, followed = np.bincount(group, minlength=len(whole)), np.bincount(group, told["next_two"][told["base"]], len(whole))
        return pa.RecordBatch.from_arrays([pa.array(whole), pa.array(n.astype(np.int64)), pa.array(followed.astype(np.int64))], names=["head", "n", "followed"])

    found = out.run([], heads, "head bigint, n bigint, followed bigint").groupBy("head").agg(F.sum("n").alias("n"), F.sum("followed").alias("followed"))
    out.find("head", "whole", written(found.where((F.col("n") >= 3) & (F.col("followed") / F.col("n") >= HEAD_SHARE)).select("head"), "heads"))
    return out


def frame_lines(pages: DataFrame, registry: DataFrame, with_text: bool = False) -> DataFrame:
    """`doc, node_id, chunk_index, line_no, frame` of every line that isn't blank, doubled rows once;
    on request with the `line` itself."""

    def tell(batch: pa.RecordBatch, lines: _Lines, told: dict[str, np.ndarray]) -> pa.RecordBatch:
        shown = ~lines.flag(BLANK)[told["at"]]
        at, frame = told["at"][shown], told["frame"][shown]
        counts = np.concatenate(batch.column("counts").to_pylist() or [[]]).astype(np.int64)
        chunk = np.repeat(np.arange(len(counts)), counts)[at]
        line_no = (at - (np.cumsum(counts) - counts)[chunk] + 1).astype(np.int32)
        doc = batch.column("doc").take(pa.array(lines.owner[at]))
        node, index = (batch.column(c).flatten().take(pa.array(chunk)) for c in ("nodes", "indexes"))
        columns = [doc, node, index.cast(pa.int32()), pa.array(line_no), pa.array(frame)]
        if with_text:
            every = [x for t in batch.column("text").to_pylist() for x in t.split("\n")]
            columns.append(pa.array([every[k] for k in at.tolist()], pa.string()))
        return pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc string, node_id string, chunk_index int, line_no int, frame boolean" + ", line string" * with_text
    names = [c.split()[0] for c in schema.split(", ")]
    return framed(pages, registry, with_text).run(["doc", "nodes", "indexes", "counts", *["text"] * with_text], tell, schema)


def article_texts(pages: DataFrame, registry: DataFrame, tell: Callable[[list, list], pa.RecordBatch], schema: str, at_hand: int = BROADCAST_ROWS) -> DataFrame:
    """What `tell(docs, texts)` makes of the documents and their articles: the lines in order without the frame."""

    def run(batch: pa.RecordBatch, lines: _Lines, told: dict[str, np.ndarray]) -> pa.RecordBatch:
        kept = told["at"][~told["frame"] & ~lines.flag(BLANK)[told["at"]]]
        upto = np.searchsorted(kept, np.append(lines.begin, len(lines.told))).tolist()
        rows = []
        for k, (doc, n, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("doc", "n", "text")))):
            if doc is not None and n:
                own = text.split("\n")
                rows.append((doc, "\n".join([own[j] for j in (kept[upto[k] : upto[k + 1]] - lines.begin[k]).tolist()])))
        return tell([r[0] for r in rows], [r[1] for r in rows])

    return framed(pages, registry, True, at_hand).run(["doc", "n", "text"], run, schema)


def frame_found(pages: DataFrame, registry: DataFrame) -> DataFrame:
    """`node_id, line_no` of each line that is not article; blank lines are no cases."""
    return frame_lines(pages, registry).where("frame").select("node_id", "line_no")

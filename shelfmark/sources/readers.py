"""Files of several formats as section rows.

`files` reads a folder as `path, extension, content`; the readers turn rows of one format into
`path, section_index, heading, text`. Only the parsing of one file is Python, inside Arrow
batches; sections are put together by Spark.
"""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Callable, Iterator
from functools import reduce
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmark.functions.text import normalize_document
from shelfmark.operators.chunking import heading_sections, paragraphs

# Extensions with a reader, older ones that have to be converted first, and blocks of HTML.
SUPPORTED = ("txt", "md", "html", "htm", "csv", "json", "jsonl", "xml")
LEGACY = ("doc", "ppt", "xls")
SKIPPED_TAGS = ("script", "style", "nav", "footer", "noscript", "svg")
HEADING_TAGS = ("h1", "h2", "h3", "h4", "h5", "h6")
BLOCK_TAGS = (*HEADING_TAGS, "p", "li", "table")
MAX_BYTES = 25 * 1024 * 1024


# How files of a kind begin.
SIGNATURES = {
    "pdf": ("25504446",), "docx": ("504B0304",), "xlsx": ("504B0304",), "pptx": ("504B0304",), "zip": ("504B0304",), "doc": ("D0CF11E0",), "xls": ("D0CF11E0",),
    "ppt": ("D0CF11E0",), "png": ("89504E47",), "gif": ("47494638",), "jpg": ("FFD8FF",), "jpeg": ("FFD8FF",),
}


def signature_fits(extension: Column, content: Column) -> Column:
    """Whether a file begins as its extension says; a text kind may not begin as any of the others do."""
    head = F.hex(F.substring(content, 1, 4))
    starts = lambda marks: reduce(lambda a, b: a | b, [F.startswith(head, F.lit(m)) for m in marks])
    found = ~starts(sorted({m for marks in SIGNATURES.values() for m in marks}))
    for kind, marks in SIGNATURES.items():
        found = F.when(extension == kind, starts(marks)).otherwise(found)
    return found


def files(spark: SparkSession, folder: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """`path, extension, outcome, content` of all files below a folder; content only of those that are read.

    outcome: ok, mismatched (its first bytes belong to another kind), too_large, legacy or
    unsupported. Size and extension are filters on the listing, so other files are never loaded.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    small, known = F.col("length") <= max_bytes, extension.isin(*SUPPORTED)
    read = found.where(small & known).select("path", extension.alias("extension"), "content")
    fits = signature_fits(F.col("extension"), F.col("content"))
    read = read.select("path", "extension", F.when(fits, "ok").otherwise("mismatched").alias("outcome"), F.when(fits, F.col("content")).alias("content"))
    outcome = F.when(~small, "too_large").when(extension.isin(*LEGACY), "legacy").otherwise("unsupported")
    rest = found.where(~(small & known)).select("path", extension.alias("extension"), outcome.alias("outcome"), F.lit(None).cast("binary").alias("content"))
    return read.unionByName(rest)


class _Blocks(HTMLParser):
    """(tag, text) of the blocks of a page in order; nested blocks give their text once each."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, str]] = []
        self.open: list[tuple[str, int, list[str]]] = []
        self.skipping = 0
        self.loose: list[str] = []
        self.title: list[str] | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in SKIPPED_TAGS:
            self.skipping += 1
        elif tag == "title":
            self.title = []
        elif tag in BLOCK_TAGS and not self.skipping:
            self.blocks.append((tag, ""))
            self.open.append((tag, len(self.blocks) - 1, []))

    def handle_endtag(self, tag: str) -> None:
        if tag in SKIPPED_TAGS:
            self.skipping = max(0, self.skipping - 1)
        elif tag == "title" and self.title is not None:
            self.blocks.insert(0, ("title", " ".join(self.title)))
            self.open = [(t, i + 1, x) for t, i, x in self.open]
            self.title = None
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                _, at, parts = self.open.pop(k)
                self.blocks[at] = (tag, " ".join(parts))
                break

    def handle_data(self, data: str) -> None:
        text = " ".join(data.split())
        if not text:
            return
        if self.title is not None:
            self.title.append(text)
        elif not self.skipping:
            self.loose.append(text)
            for _, _, parts in self.open:
                parts.append(text)


class Malformed(ValueError):
    """A document that can't be read."""


def html_blocks(html: str) -> list[tuple[str, str]]:
    """The blocks of a page, or all its text as one if it has none."""
    parser = _Blocks()
    parser.feed(html)
    parser.close()
    for tag, at, parts in parser.open:
        parser.blocks[at] = (tag, " ".join(parts))
    found = [(t, x) for t, x in parser.blocks if x]
    if all(t == "title" for t, _ in found) and parser.loose:
        found.append(("p", " ".join(parser.loose)))
    return found


def xml_blocks(xml: str) -> list[tuple[str, str]]:
    """(local name, text) of each child of the root, or of the root if it has none. Declarations of entities are
    not followed; of a document that breaks off, what came before counts."""
    parser = ElementTree.XMLPullParser(events=("start",))
    try:
        parser.feed(re.sub(r"<!DOCTYPE[^\[>]*(\[.*?\]\s*)?>", "", xml, count=1, flags=re.S))
        parser.close()
    except ElementTree.ParseError:
        pass
    try:
        root = next((e for _, e in parser.read_events()), None)
    except ElementTree.ParseError:
        root = None
    if root is None:
        raise Malformed
    parts = [(e.tag.rpartition("}")[2], "\n".join(t.strip() for t in e.itertext() if t.strip())) for e in (list(root) or [root])]
    return [(t, x) for t, x in parts if x]


def json_blocks(text: str) -> list[tuple[str, str]]:
    """(number, `key: value` lines) of each record of a list, an object, or lines of objects."""
    try:
        try:
            found = json.loads(text)
        except ValueError:
            found = [json.loads(x) for x in text.splitlines() if x.strip()]
    except ValueError:
        raise Malformed from None
    shown = lambda v: json.dumps(v, ensure_ascii=False, sort_keys=True) if isinstance(v, (dict, list)) else str(v)
    rows = found if isinstance(found, list) else [found]
    return [(str(k), "\n".join(f"{a}: {shown(b)}" for a, b in r.items()) if isinstance(r, dict) else shown(r)) for k, r in enumerate(rows)]


def csv_blocks(text: str) -> list[tuple[str, str]]:
    """(row number, `column: value` lines without empty values) of each row; the header is row 1."""
    rows = csv.DictReader(io.StringIO(text.removeprefix("\ufeff"), newline=""))
    out = []
    try:
        for k, row in enumerate(rows, 2):
            lines = [f"{c.strip()}: {v.strip()}" for c, v in row.items() if c is not None and isinstance(v, str) and v.strip()]
            out.append((str(k), "\n".join(lines)))
    except csv.Error:
        raise Malformed from None
    return out


def _parsed(rows: DataFrame, parse: Callable[[str], list[tuple[str, str]]]) -> DataFrame:
    """`path, pos, tag, block` of every block that `parse` finds in `rows(path, text)`; what can't be read gives one
    row at pos -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, columns = [], ([], [], [])
            for r, text in enumerate(batch.column(1).to_pylist()):
                try:
                    blocks = list(enumerate(parse(text) if text else ()))
                except Malformed:
                    blocks = [(-1, ("malformed", ""))]
                for pos, (tag, block) in blocks:
                    at.append(r)
                    for column, value in zip(columns, (pos, tag, block)):
                        column.append(value)
            kinds = (pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int32())), *(pa.array(c, t) for c, t in zip(columns, kinds))], names=["path", "pos", "tag", "block"]
            )

    return rows.select("path", "text").mapInArrow(run, "path string, pos int, tag string, block string")


def html_sections(pages: DataFrame) -> DataFrame:
    """`path, section_index, heading, text` of `pages(path, text)` of HTML: a section starts at each heading.

    The page's title is the heading of what precedes the first one. Navigation, scripts, styles and
    footers are left out. Pages without blocks have no sections.
    """
    blocks = _parsed(pages, html_blocks).where("pos >= 0")
    is_head = F.col("tag").isin("title", *HEADING_TAGS)
    order = W.partitionBy("path").orderBy("pos")
    blocks = blocks.withColumn("section_index", F.sum(is_head.cast("int")).over(order)).withColumn("is_head", is_head)
    lines = F.array_sort(F.collect_list(F.when(~F.col("is_head"), F.struct("pos", "block"))))
    out = blocks.groupBy("path", "section_index").agg(
        F.first(F.when(F.col("is_head"), F.col("block")), ignorenulls=True).alias("heading"), F.array_join(F.transform(lines, lambda x: x["block"]), "\n").alias("text")
    )
    return out.where("text != ''").withColumn("section_index", F.col("section_index").cast("int"))


def xml_sections(rows: DataFrame) -> DataFrame:
    """A section for each child of the root; its heading is the child's name."""
    return _parsed(rows, xml_blocks).select("path", F.col("pos").alias("section_index"), F.col("tag").alias("heading"), F.col("block").alias("text"))


def json_sections(rows: DataFrame) -> DataFrame:
    """A section for each record. Malformed documents give one row at -1."""
    return _parsed(rows, json_blocks).select("path", F.col("pos").alias("section_index"), F.lit(None).cast("string").alias("heading"), F.col("block").alias("text"))


def csv_sections(rows: DataFrame) -> DataFrame:
    """A section for each row of CSV texts with a header of their own, numbered as in the file: the header is row 1.
    Rows without a value have none."""
    found = _parsed(rows, csv_blocks)
    number = F.when(F.col("pos") < 0, F.col("pos")).otherwise(F.col("tag").cast("int"))
    return found.where("pos < 0 or block != ''").select("path", number.alias("section_index"), F.lit(None).cast("string").alias("heading"), F.col("block").alias("text"))


def _all_sections(rows: DataFrame) -> DataFrame:
    of = lambda *kinds: rows.where(F.col("extension").isin(*kinds))
    no_head = F.lit(None).cast("string").alias("heading")
    out = paragraphs(of("txt"), "path").select("path", "section_index", no_head, "text")
    parts = (
        heading_sections(of("md"), "path").select("path", F.col("section_index").cast("int").alias("section_index"), no_head, "text"),
        html_sections(of("html", "htm")), xml_sections(of("xml")), json_sections(of("json", "jsonl")), csv_sections(of("csv")),
    )
    for part in parts:
        out = out.unionByName(part)
    return out


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    return files(spark, folder).where("outcome = 'ok'").select("path", "extension", F.decode("content", "UTF-8").alias("text"))


def sections(spark: SparkSession, folder: str) -> DataFrame:
    """`path, section_index, heading, text` of all files of a folder that have a reader, in compatibility form and
    normalised, without empty sections."""
    out = _all_sections(_texts(spark, folder)).where("section_index >= 0")
    return out.withColumn("text", normalize_document(F.col("text"))).where("text != ''")


def outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """`path, outcome, n_sections` of every file: as `files` tells, or malformed, or empty where nothing is in it."""
    found = _all_sections(_texts(spark, folder)).groupBy("path").agg(F.count_if(F.col("section_index") >= 0).alias("n"), F.bool_or(F.col("section_index") < 0).alias("bad"))
    rows = files(spark, folder).select("path", "outcome").join(found, "path", "left")
    outcome = F.when(F.col("outcome") != "ok", F.col("outcome")).when(F.col("bad"), "malformed").when(F.coalesce("n", F.lit(0)) == 0, "empty").otherwise("ok")
    return rows.select("path", outcome.alias("outcome"), F.coalesce("n", F.lit(0)).alias("n_sections"))

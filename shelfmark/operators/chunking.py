"""From texts to sections to typed, deduplicated, content-addressed chunks.

Sections are gaps and islands: a flag on each line that opens one, a running count, and the
lines of each island joined in order. Everything is a Catalyst expression over exploded lines;
a window or group is one document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmark.functions.text import normalize_text, one_line, present, strip

MIN_CHUNK, MIN_SECTION_WORDS = 50, 5
#: Sizes and overlaps of pieces in estimated tokens: prose, documents kept whole, records.
PROSE, ATOMIC, RECORD = (512, 64), (2048, 0), (8192, 0)
# The types in the order they are tried, with their strategy and what tells them.
TYPE_RULES: dict[str, dict] = {
    "faq": {"strategy": "faq_entries", "patterns": [r"\bquestion\s*:.*?\banswer\s*:", r"\bq(\d+)\s*[:.)].*?\ba\1\s*[:.)]"]},
    "directory": {"strategy": "directory_sections", "patterns": [r"\bdistrict\b.*\bpublic library\b.*\btel\s*:"]},
    "announcement": {
        "strategy": "announcement_entries", "title": True, "title_only": True,
        "patterns": [r"\bannouncements?\b", r"\bnotices?\b", r"\btemporary closure\b", r"\bsuspension\b"],
    },
    "policy": {"strategy": "prose", "patterns": [r"\bpolicy\b", r"\brules?\b", r"\bregulations?\b", r"\bguidelines?\b"]},
    "structured": {"strategy": "marked_sections", "patterns": [r"(?:^|\n)##\s+"]},
    "record_based": {"strategy": "atomic", "file_types": ["csv", "xlsx", "xlsm", "json", "jsonl", "xml"], "patterns": []},
    "news": {"strategy": "prose", "patterns": []},
    "prose": {"strategy": "prose", "patterns": []},
}
# A line that opens a dated entry, a line that opens a numbered question.
DATED = r"^\(?\s*\d{1,2}[./-]\d{1,2}[./-]\d{2,4}\s*\)?(?:\s+|$)"
QUESTION = r"(?im)(?=^\s*Q\d+\s*[:.)])"
# Parts of a line that isn't an area, and the start of one that isn't a library.
NOT_AREA = ("library", "tel", "road", "street", "building", "floor", "estate", "services", "enquiries", "website")
NOT_LIBRARY = "hong kong public libraries"


def merged_rules(overrides: dict[str, dict]) -> dict[str, dict]:
    """The rules with the entries of `overrides` put over them; new types come last."""
    for name, values in overrides.items():
        if not isinstance(values, dict):
            raise ValueError(f"the rule {name!r} must be a mapping")
    rules = {name: {**rule, **overrides.get(name, {})} for name, rule in TYPE_RULES.items()}
    return rules | {name: dict(values) for name, values in overrides.items() if name not in rules}


def document_type(text: Column, title: Column, extension: Column | None = None, explicit: Column | None = None, rules: dict[str, dict] | None = None) -> Column:
    """The type of a document: what is given, else by file, else the first rule that matches, else prose.

    A rule looks at the title if it says so, and unless it is for titles only, its patterns together
    must match the text `minimum` times (once by default). Null texts and titles are empty.
    """
    rules = rules or TYPE_RULES
    text, title = F.coalesce(text, F.lit("")), F.coalesce(title, F.lit(""))
    flagged = lambda p: F.lit("(?is)" + p)
    found = F.lit("prose")
    for name, rule in reversed(rules.items()):
        if not rule.get("patterns"):
            continue
        hits = []
        if rule.get("title"):
            hits += [F.regexp(title, flagged(p)) for p in rule["patterns"]]
        if not rule.get("title_only"):
            least = rule.get("minimum", 1)
            if least <= 1:
                hits += [F.regexp(text, flagged(p)) for p in rule["patterns"]]
            else:
                hits.append(sum((F.regexp_count(text, flagged(p)) for p in rule["patterns"]), F.lit(0)) >= least)
        found = F.when(reduce(lambda a, b: a | b, hits), name).otherwise(found)
    if extension is not None:
        for name, rule in reversed(rules.items()):
            if rule.get("file_types"):
                found = F.when(F.ltrim(F.lower(extension), F.lit(".")).isin(*rule["file_types"]), name).otherwise(found)
    if explicit is not None:
        given = F.lower(F.trim(explicit))
        found = F.when(given.isin(*rules), given).otherwise(found)
    return found


def strategy_of(kind: Column) -> Column:
    """How documents of a type are split; unknown types are prose."""
    names = F.create_map(*[F.lit(x) for name, rule in TYPE_RULES.items() for x in (name, rule["strategy"])])
    return F.coalesce(F.try_element_at(names, kind), F.lit("prose"))


def lines_of(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """`pos, line` of every line of each document, from 0; null texts have none."""
    return documents.select("*", F.posexplode(F.split(text_col, "\n")).alias("pos", "line")).drop(text_col)


def sections(documents: DataFrame, opens: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id, section_index, text`: a new section starts at each line for which `opens` holds.

    The lines before the first such line are section 0 and left out if blank; the numbers keep
    their gaps. `opens` refers to `line`.
    """
    lines = lines_of(documents.select(id_col, text_col), text_col).withColumn("opens", F.coalesce(opens, F.lit(False)).cast("int"))
    lines = lines.withColumn("section_index", F.sum("opens").over(W.partitionBy(id_col).orderBy("pos")))
    joined = F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"])
    out = lines.groupBy(id_col, "section_index").agg(strip(F.array_join(joined, "\n")).alias("text"))
    return out.where(F.length("text") > 0)


def heading_sections(documents: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Sections at Markdown headings; the heading stays in the text."""
    return sections(documents, F.col("line").rlike(r"^#{1,6}\s+\S"), id_col)


def marked_sections(documents: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Sections at `## ` headings with at least MIN_SECTION_WORDS words besides the mark; numbers keep their gaps."""
    words = F.size(F.filter(F.split(F.regexp_replace("text", r"(?m)^##\s+", ""), r"\s+"), lambda w: w != ""))
    return sections(documents, F.col("line").rlike(r"^##\s"), id_col).where(words >= MIN_SECTION_WORDS)


def announcement_entries(documents: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """`id, entry_index, text` of each dated entry, with what stands before the first one and a blank line above it.

    Lines are stripped and blank ones dropped. A text with less than two dated lines stays whole, as entry 0.
    """
    lines = lines_of(documents.select(id_col, "text")).withColumn("line", strip(F.col("line"))).where("line != ''")
    lines = lines.withColumn("dated", F.col("line").rlike(DATED).cast("int"))
    lines = lines.withColumns({"entry": F.sum("dated").over(W.partitionBy(id_col).orderBy("pos")) - 1, "n": F.sum("dated").over(W.partitionBy(id_col))}).where("n >= 2")
    joined = F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"])
    parts = lines.groupBy(id_col, "entry").agg(F.array_join(joined, "\n").alias("part"))
    head = F.max(F.when(F.col("entry") < 0, F.col("part"))).over(W.partitionBy(id_col))
    entries = parts.withColumn("head", head).where("entry >= 0")
    entries = entries.select(id_col, F.col("entry").cast("int").alias("entry_index"), F.concat_ws("\n\n", "head", "part").alias("text"))
    whole = documents.where("text is not null").join(entries.select(id_col).distinct(), id_col, "left_anti")
    return entries.unionByName(whole.select(id_col, F.lit(0).alias("entry_index"), "text"))


def faq_entries(documents: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """`id, entry_index, text` of each numbered question with its answer, with what precedes the first one and a
    blank line above it; texts without numbered questions stay whole."""
    starts = r"(?i)^\s*Q\d+\s*[:.)]"
    parts = F.split("text", QUESTION)
    head = F.when(~parts[0].rlike(starts), present(strip(parts[0])))
    entries = F.transform(F.filter(parts, lambda p: p.rlike(starts)), lambda p: F.concat_ws("\n\n", head, strip(p)))
    entries = F.when(F.size(entries) > 0, entries).otherwise(F.array("text"))
    return documents.where("text is not null").select(id_col, F.posexplode(entries).alias("entry_index", "text"))


def paragraphs(documents: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """`id, section_index, text` of each paragraph (blank lines between) with text; numbers keep their gaps."""
    parts = documents.select(id_col, F.posexplode(F.split("text", r"\n\s*\n")).alias("section_index", "text"))
    return parts.withColumn("text", strip(F.col("text"))).where(F.length("text") > 0)


def record_lines(rows: DataFrame, columns: list[str]) -> Column:
    """A record as `column: value` lines without empty values."""
    pairs = F.array(*[F.struct(F.lit(c).alias("k"), strip(F.col(c).cast("string")).alias("v")) for c in columns])
    return F.array_join(F.transform(F.filter(pairs, lambda p: p["v"] != ""), lambda p: F.concat(p["k"], F.lit(": "), p["v"])), "\n")


def content_chunks(parts: DataFrame, id_col: str = "doc_id", version: int = 1) -> DataFrame:
    """`chunk_id, id, section_index, chunk_index, text` of sections as chunks addressed by content.

    Chunks below MIN_CHUNK characters are dropped after they are numbered, so indexes keep their
    gaps; of the same text in one document the first counts.
    """
    parts = parts.withColumn("text", normalize_text(F.col("text")))
    parts = parts.withColumn("chunk_index", F.row_number().over(W.partitionBy(id_col).orderBy("section_index")) - 1)
    parts = parts.where(F.length(strip(F.col("text"))) >= MIN_CHUNK).withColumn("hash", F.sha2("text", 256))
    first = W.partitionBy(id_col, "hash").orderBy("chunk_index")
    parts = parts.withColumn("n", F.row_number().over(first)).where("n = 1")
    chunk_id = F.concat_ws(
        ":", F.col(id_col).cast("string"), F.lit(f"v{version}"), F.concat(F.lit("s"), "section_index"), F.concat(F.lit("c"), "chunk_index"), F.left("hash", F.lit(16))
    )
    return parts.select(chunk_id.alias("chunk_id"), id_col, "section_index", "chunk_index", "text")


def greedy_pieces(documents: DataFrame, size: int = PROSE[0], overlap: int = PROSE[1], id_col: str = "doc_id") -> DataFrame:
    """`id, piece_no, text`: sentences packed in order up to `size` estimated tokens; a longer sentence stands alone.

    A piece begins with the last whole sentences of the one before that together have at most
    `overlap` tokens, as far as they fit beside its first own sentence. Null texts have no pieces,
    texts without a sentence neither.
    """
    cost = lambda s: F.greatest(F.lit(1), F.bround(F.length(s) / 4).cast("int"))
    sentences = F.filter(F.split("text", r"(?<=[.!?。！？])\s+|\n+"), lambda s: F.length(s) > 0)
    none = F.expr("cast(array() as array<string>)")
    start = F.struct(F.expr("cast(array() as array<string>)").alias("done"), none.alias("cur"), F.lit(0).alias("n"))

    def tail(cur: Column, room: Column) -> Column:
        """struct(t, c): the last sentences of a piece within `overlap` and `room`, and their tokens."""
        first = F.struct(none.alias("t"), F.lit(0).alias("c"), F.lit(True).alias("open"))
        fits = lambda a, s: a["open"] & (a["c"] + cost(s) <= F.least(F.lit(overlap), room))
        return F.aggregate(
            F.reverse(cur), first,
            lambda a, s: F.when(fits(a, s), F.struct(F.concat(F.array(s), a["t"]).alias("t"), (a["c"] + cost(s)).alias("c"), F.lit(True).alias("open")))
            .otherwise(F.struct(a["t"].alias("t"), a["c"].alias("c"), F.lit(False).alias("open"))),
        )

    def step(acc: Column, s: Column) -> Column:
        added = F.struct(acc["done"].alias("done"), F.concat(acc["cur"], F.array(s)).alias("cur"), (acc["n"] + cost(s)).alias("n"))
        kept = tail(acc["cur"], F.lit(size) - cost(s)) if overlap else F.struct(none.alias("t"), F.lit(0).alias("c"))
        begun = F.struct(
            F.concat(acc["done"], F.array(F.array_join(acc["cur"], " "))).alias("done"), F.concat(kept["t"], F.array(s)).alias("cur"), (kept["c"] + cost(s)).alias("n")
        )
        return F.when((acc["n"] == 0) | (acc["n"] + cost(s) <= size), added).otherwise(begun)

    done = F.aggregate(sentences, start, step, lambda a: F.when(a["n"] > 0, F.concat(a["done"], F.array(F.array_join(a["cur"], " ")))).otherwise(a["done"]))
    return documents.where("text is not null").select(id_col, F.posexplode(done).alias("piece_no", "text"))


def titled(text: Column, title: Column) -> Column:
    """A chunk with its title above it, unless it begins with it or there is none."""
    line = F.concat(F.lit("Title: "), strip(title))
    return F.when((F.length(strip(title)) > 0) & ~F.startswith(text, line), F.concat(line, F.lit("\n\n"), text)).otherwise(text)


def conformity_faults(chunks: DataFrame, id_col: str = "node_id") -> DataFrame:
    """`id, fault` of chunks (`document_type, text`) that aren't what their type promises.

    faq: the numbers of its questions and answers differ, or it has several; directory: no library
    is named; announcement: no dated line.
    """
    numbers = lambda letter: F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(rf"(?im)^\s*{letter}(\d+)\s*[:.)]"), 1)))
    of = lambda kind, fault: (F.col("document_type") == kind) & fault
    faults = {
        "labels_differ": of("faq", numbers("Q") != numbers("A")), "several_questions": of("faq", F.size(numbers("Q")) > 1),
        "no_library": of("directory", ~F.col("text").rlike(r"(?im)^\s*Library:\s*\S")), "no_date": of("announcement", ~F.col("text").rlike("(?m)" + DATED)),
    }
    names = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in faults.items()]))
    return chunks.select(id_col, F.explode(names).alias("fault")).distinct()


def cleaned_lines(documents: DataFrame, id_col: str = "doc_id", title_col: str = "title") -> DataFrame:
    """`id, text`: blank lines gone, single spaces, a line equal to the one before dropped, and the title not
    repeated at the start."""
    lines = lines_of(documents.select(id_col, title_col, "text")).withColumn("line", one_line(F.col("line"))).where("line != ''")
    order = W.partitionBy(id_col).orderBy("pos")
    lines = lines.where(F.col("line").isNotNull()).withColumn("before", F.lag("line").over(order)).where("before is null or before != line")
    first = F.min(F.when(~F.col("line").eqNullSafe(one_line(F.col(title_col))), F.col("pos"))).over(W.partitionBy(id_col))
    lines = lines.withColumn("first", first).where("pos >= first")
    joined = F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"])
    return lines.groupBy(id_col).agg(F.array_join(joined, "\n").alias("text"))


def directory_entries(documents: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """`id, section_index, area, library, text` of each library entry of a directory.

    An entry starts at a line of at most 8 words that names a library, and holds the lines up to
    the next one; a `## ` heading of at most 6 words without digits or words of addresses names the
    area of the entries below it and closes the one above. Lines are stripped, blank ones dropped.
    """
    lines = lines_of(documents.select(id_col, "text")).withColumn("raw", strip(F.col("line"))).where("raw != ''")
    lines = lines.withColumn("line", strip(F.regexp_replace("raw", r"^(.*?)## ", "$1"))).where("line != ''")
    low, n_words = F.lower("line"), F.size(F.split("line", r"\s+"))
    no_address = ~reduce(lambda a, b: a | b, [F.contains(low, F.lit(x)) for x in NOT_AREA])
    area = F.contains("raw", F.lit("## ")) & (n_words <= 6) & ~F.col("line").rlike(r"\d") & no_address
    library = ~area & (n_words <= 8) & F.contains(low, F.lit("library")) & ~F.startswith(low, F.lit(NOT_LIBRARY))
    lines = lines.withColumns({"is_area": area, "is_library": library})
    order = W.partitionBy(id_col).orderBy("pos")
    lines = lines.withColumns(
        {
            "area": F.coalesce(F.last(F.when(F.col("is_area"), F.col("line")), ignorenulls=True).over(order), F.lit("")),
            "entry": F.sum((F.col("is_library") | F.col("is_area")).cast("int")).over(order),
        }
    )
    body = F.array_sort(F.collect_list(F.when(~F.col("is_library") & ~F.col("is_area"), F.struct("pos", "raw"))))
    out = lines.groupBy(id_col, "entry").agg(
        F.min("area").alias("area"), F.min(F.when(F.col("is_library"), F.col("line"))).alias("library"), F.transform(body, lambda x: x["raw"]).alias("body")
    ).where("library is not null")
    head = F.array(F.concat(F.lit("Area: "), "area"), F.concat(F.lit("Library: "), "library"))
    index = F.row_number().over(W.partitionBy(id_col).orderBy("entry")) - 1
    return out.select(id_col, index.alias("section_index"), "area", "library", F.array_join(F.concat(head, "body"), "\n").alias("text"))


def shared_paragraphs(documents: DataFrame, id_col: str = "doc_id", title_col: str = "title") -> DataFrame:
    """`paragraph_id, title, n_documents, first_id` of each distinct paragraph under its title."""
    titles = documents.select(id_col, title_col)
    rows = paragraphs(documents, id_col).join(titles, id_col)
    name = F.coalesce(F.col(title_col), F.lit(""))
    key = F.left(F.sha2(F.concat(name, F.lit("\n"), "text"), 256), F.lit(24))
    return rows.groupBy(key.alias("paragraph_id")).agg(F.min(name).alias("title"), F.count_distinct(id_col).alias("n_documents"), F.min(id_col).alias("first_id"))

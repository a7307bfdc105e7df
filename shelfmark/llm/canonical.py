"""One form for text that looks the same in other characters.

DuckDB runs inside each task over the Arrow batches that Spark hands it: `nfc_normalize`,
`translate` and regular expressions in embedded SQL find and map compatibility forms, accents
apart from their letters, characters without width, other spaces and look-alike letters.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters of other scripts that read like Latin ones.
LOOK_ALIKES = {
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p",
    "ԛ": "q", "ѕ": "s", "у": "y", "х": "x", "ԝ": "w", "ѵ": "v", "г": "r", "к": "k", "ї": "ï", "ё": "ë",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O",
    "Р": "P", "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X", "Ԛ": "Q", "Ԝ": "W", "Ѵ": "V", "Ԍ": "G", "Ї": "Ï", "Ё": "Ë",
    "α": "a", "ο": "o", "ν": "v", "ι": "i", "ρ": "p", "υ": "u", "κ": "k", "τ": "t", "χ": "x", "γ": "y", "ω": "w",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ϲ": "c", "ϳ": "j", "Ϲ": "C",
    "օ": "o", "ս": "u", "հ": "h", "ո": "n", "զ": "q", "ց": "g", "Ս": "U", "Օ": "O",
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭼ": "E", "Ꮋ": "H", "Ꮖ": "I", "Ꮶ": "K", "Ꮇ": "M", "Ꮲ": "P", "Ꮪ": "S", "Ꭲ": "T",
}

OTHER_SCRIPTS = r"\p{Greek}\p{Cyrillic}\p{Armenian}\p{Cherokee}\p{Coptic}"
MARKS = r"\x{0300}-\x{036F}\x{1AB0}-\x{1AFF}\x{1DC0}-\x{1DFF}\x{3099}\x{309A}\x{FE20}-\x{FE2F}"

FOUND_SCHEMA = "tab string, rec_key string, char_kinds array<string>, canonical string"


def _class(chars: list[str]) -> str:
    """Characters as ranges of a regular expression's class."""
    codes, out, i = sorted(map(ord, chars)), [], 0
    while i < len(codes):
        j = i
        while j + 1 < len(codes) and codes[j + 1] == codes[j] + 1:
            j += 1
        out.append(f"\\x{{{codes[i]:X}}}" + (f"-\\x{{{codes[j]:X}}}" if j > i else ""))
        i = j + 1
    return "".join(out)


@lru_cache(1)
def _tables() -> dict[str, str]:
    """Classes and maps by rule from the Unicode database.

    compat: letters and numbers whose decomposition is tagged, with a form of letters and
    digits; invisible: format characters and selectors; space: separators but U+0020.
    """
    single, several, invisible, space = {}, {}, [], []
    for code in range(0xA0, sys.maxunicode + 1):
        c = chr(code)
        kind = unicodedata.category(c)
        if kind == "Cf" or 0xFE00 <= code <= 0xFE0F or code in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164):
            invisible.append(c)
        elif kind == "Zs":
            space.append(c)
        elif kind[0] in "LN" or kind == "So":
            if unicodedata.decomposition(c).startswith("<"):
                plain = unicodedata.normalize("NFKC", c)
                if plain != c and plain.isalnum():
                    if len(plain) == 1:
                        single[c] = plain
                    elif kind[0] == "L" and plain.isascii():  # ligatures and digraphs
                        several[c] = plain
    return {
        "compat": _class([*single, *several]), "invisible": _class(invisible), "space": _class(space),
        "from": "".join(single), "to": "".join(single.values()), "several": several,
        "space_from": "".join(space), "space_to": " " * len(space),
        "like_from": "".join(LOOK_ALIKES), "like_to": "".join(LOOK_ALIKES.values()),
    }


def _sql() -> str:
    t = _tables()
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    letters = rf"[\p{{Latin}}{OTHER_SCRIPTS}{MARKS}]"
    mixed = rf"\p{{Latin}}{letters}*[{OTHER_SCRIPTS}]|[{OTHER_SCRIPTS}]{letters}*\p{{Latin}}"
    # Forms of several letters, such as ligatures, are spelled out one kind after the other.
    expand = "thin"
    for c, plain in t["several"].items():
        expand = f"replace({expand}, {quote(c)}, {quote(plain)})"
    return f"""
    WITH odd AS (
        SELECT row, text,
               regexp_matches(text, '[{t["compat"]}]') AS compat,
               regexp_matches(text, '\\p{{L}}[{t["invisible"]}]*[{MARKS}]') AS combining,
               regexp_matches(text, '[{t["invisible"]}]') AS invisible,
               regexp_matches(text, '[{t["space"]}]') AS space,
               regexp_replace(translate(text, {quote(t["space_from"])}, {quote(t["space_to"])}),
                              '[{t["invisible"]}]', '', 'g') AS thin
        FROM batch WHERE regexp_matches(text, '[^\\x00-\\x7F]')),
    plain AS (
        SELECT * EXCLUDE (thin),
               nfc_normalize(CASE WHEN compat THEN translate({expand}, {quote(t["from"])}, {quote(t["to"])})
                                  ELSE thin END) AS plain
        FROM odd),
    mixed AS (SELECT *, regexp_matches(plain, '{mixed}') AS lookalike FROM plain)
    SELECT row, compat, combining, invisible, space, lookalike,
           CASE WHEN lookalike THEN list_aggregate(list_transform(
                    regexp_extract_all(plain, '{letters}+|[^\\p{{Latin}}{OTHER_SCRIPTS}{MARKS}]+'),
                    lambda w: CASE WHEN regexp_matches(w, '{mixed}')
                              THEN translate(w, {quote(t["like_from"])}, {quote(t["like_to"])}) ELSE w END),
                    'string_agg', '')
                ELSE plain END AS canonical
    FROM mixed"""


KINDS = ("combining", "compat", "invisible", "lookalike", "space")


def canonical_text(df: DataFrame, key_col: str, text_col: str, tab: str = "") -> DataFrame:
    """`tab`, `rec_key`, `char_kinds` (sorted, empty for clean text) and `canonical` of every row.

    A null text stays null without kinds; an empty one stays empty. Repeated rows come out
    repeated; other columns are left aside. Compatibility letters and digits take their plain
    form, accents join their letter, characters without width go, other spaces become U+0020
    and look-alike letters in a word with Latin ones become Latin. Chinese punctuation and
    words wholly in another script stay. One pass without a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        sql = _sql()
        for batch in batches:
            n = batch.num_rows
            texts = batch.column(1)
            con.register("batch", pa.table({"row": pa.array(range(n), pa.int64()), "text": texts}))
            found = con.sql(sql).to_arrow_table()
            con.unregister("batch")
            canonical = texts.to_pylist()
            kinds: list[list[str]] = [[] for _ in range(n)]
            flags = [found.column(k).to_pylist() for k in KINDS]
            for at, (row, text) in enumerate(zip(found.column("row").to_pylist(), found.column("canonical").to_pylist())):
                canonical[row] = text
                kinds[row] = [k for k, f in zip(KINDS, flags) if f[at]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([tab] * n, pa.string()), batch.column(0), pa.array(kinds, pa.list_(pa.string())), pa.array(canonical, pa.string())],
                names=["tab", "rec_key", "char_kinds", "canonical"],
            )

    picked = df.select(df[key_col].cast("string").alias("rec_key"), df[text_col].cast("string").alias("text"))
    return picked.mapInArrow(run, FOUND_SCHEMA)


def odd_characters(canonical: DataFrame) -> DataFrame:
    """`tab`, `rec_key`, `char_kind`: one row for each kind in a record; repeated records count once."""
    return canonical.select("tab", "rec_key", F.explode("char_kinds").alias("char_kind")).distinct()

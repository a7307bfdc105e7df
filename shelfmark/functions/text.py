"""Text expressions shared by the operators; all of them stay in the JVM."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

def present(col: Column) -> Column:
    """The value, or null where it is empty: missing, null and '' are one."""
    return F.when(col != "", col)


def strip(col: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(col, r"^\s+|\s+$", "")


def nfkc(col: Column) -> Column:
    """The text in composed compatibility form; Spark has no expression for it. Null stays null."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t.isascii() else unicodedata.normalize("NFKC", t), na_action="ignore")

    return F.pandas_udf(run, "string")(col)


def normalize_document(col: Column) -> Column:
    """`normalize_text` of the text in compatibility form: what a reader keeps of a file."""
    return normalize_text(nfkc(col))


def normalize_text(col: Column) -> Column:
    """No-break spaces as spaces, no NULs, runs of blanks as one, at most one empty line, stripped."""
    col = F.regexp_replace(F.regexp_replace(col, " ", " "), "\u0000", "")
    return strip(F.regexp_replace(F.regexp_replace(col, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def one_line(col: Column) -> Column:
    """All white space as single spaces, stripped."""
    return strip(F.regexp_replace(col, r"\s+", " "))


def label_form(col: Column) -> Column:
    """Lower case, single spaces, stripped, then without quotes: the form in which labels are compared."""
    return F.regexp_replace(one_line(F.lower(col)), "[\"'“”‘’]", "")


def compact_form(col: Column) -> Column:
    """Letters, digits and underscores only, case folded (ß as ss)."""
    return F.regexp_replace(F.replace(F.lower(col), F.lit("ß"), F.lit("ss")), r"[^\p{L}\p{N}_]+", "")


def tolerant_contains(text: Column, part: Column, least: int = 40) -> Column:
    """Whether `text` holds `part` but for formatting, if the part has at least `least` letters and digits."""
    compact = compact_form(part)
    return (F.length(compact) >= least) & F.contains(compact_form(text), compact)


def estimated_tokens(col: Column) -> Column:
    """A quarter of the characters, rounded half to even, at least 1; 0 for empty and null texts."""
    n = F.length(col)
    return F.when(n > 0, F.greatest(F.lit(1), F.bround(n / 4).cast("int"))).otherwise(0)


def clamped_share(value: Column, most: Column) -> Column:
    """value / most between 0 and 1; 0 where `most` isn't positive."""
    return F.when(most > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), value / most))).otherwise(F.lit(0.0))


def slug(col: Column, size: int = 48) -> Column:
    """Lower-case letters and digits joined by hyphens, at most `size` characters."""
    return F.left(F.regexp_replace(F.regexp_replace(F.lower(col), r"[^a-z0-9]+", "-"), r"^-+|-+$", ""), F.lit(size))


def safe_name(col: Column, default: str = "upload") -> Column:
    """A file name of letters, digits, dots, underscores and hyphens."""
    return F.coalesce(present(F.regexp_replace(col, r"[^A-Za-z0-9._-]", "_")), F.lit(default))


def natural_key(col: Column) -> Column:
    """A key that sorts runs of digits as numbers and ignores case."""
    parts = F.regexp_extract_all(col, F.lit(r"(\d+|\D+)"), 1)
    # The number of digits stands before them, so runs of any length sort as numbers.
    digits = lambda p: F.ltrim(p, F.lit("0"))
    number = lambda p: F.concat(F.lpad(F.length(digits(p)).cast("string"), 10, "0"), F.lit(":"), digits(p))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d+$"), number(p)).otherwise(F.lower(p))), "")


def json_in(col: Column) -> Column:
    """The JSON object within a text, from its first to its last brace; null if there is none."""
    return present(F.regexp_extract(col, r"(?s)\{.*\}", 0))

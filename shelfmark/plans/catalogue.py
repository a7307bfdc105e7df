"""Every query of the core by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfmark.plans import corpora, evaluation, formats, publishing, references, retrieval, sessions, texts

_MODULES = (references, retrieval, texts, corpora, publishing, sessions, evaluation, formats)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLES: dict[str, str] = {k: s for m in _MODULES for k, s in m.ORACLES.items()}

"""Conversation history: last turns, context packing, citations and keywords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmark.functions.text import estimated_tokens

LAST_TURNS, CONTEXT_TOKENS = 6, 600


def last_turns(messages: DataFrame, n: int = LAST_TURNS) -> DataFrame:
    """The last `n` messages of each session, in order (`turn` from 1); blank sessions and contents have none.

    Doubled rows count once; equal times go by id, messages without a time are the oldest. A hot
    session is cut to n rows before it is shuffled.
    """
    rows = messages.where(F.col("session_id").rlike(r"\S") & F.col("content").rlike(r"\S")).dropDuplicates(["id", "session_id", "role", "content", "created_at"])
    newest = W.partitionBy("session_id").orderBy(F.col("created_at").desc_nulls_last(), F.col("id").desc(), "role", "content")
    kept = rows.withColumn("back", F.row_number().over(newest)).where(F.col("back") <= n)
    total = F.max("back").over(W.partitionBy("session_id"))
    return kept.withColumn("turn", (total - F.col("back") + 1)).select("session_id", "turn", "id", "role", "content")


def packed_context(ranked: DataFrame, text: Column, budget: int = CONTEXT_TOKENS, by: str = "query_id") -> DataFrame:
    """The prefix of each query's ranked rows within `budget` tokens; the first row always stays."""
    order = W.partitionBy(by).orderBy("rank").rowsBetween(W.unboundedPreceding, W.currentRow)
    tokens = ranked.withColumn("tokens", estimated_tokens(text)).withColumn("used", F.sum("tokens").over(order))
    return tokens.where((F.col("used") <= budget) | (F.col("rank") == 1))


def citations(rows: DataFrame, keys: list[str], by: str = "query_id", n: int = 3) -> DataFrame:
    """`by`, `citation`: the first `n` distinct sources of each query in rank order, as one text."""
    first = rows.groupBy(by, *keys).agg(F.min("rank").alias("rank"))
    numbered = first.withColumn("no", F.row_number().over(W.partitionBy(by).orderBy("rank", *keys))).where(F.col("no") <= n)
    parts = F.array_sort(F.collect_list(F.struct("no", F.concat_ws(" | ", *keys).alias("t"))))
    return numbered.groupBy(by).agg(F.concat(F.lit("Sources:\n"), F.array_join(F.transform(parts, lambda p: p["t"]), "\n")).alias("citation"))


def keyword_hits(texts: DataFrame, keywords: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """`id, keyword`: the longest active keyword each text holds, without case; equal lengths go by the keyword.

    Texts and keywords meet by the first three characters of the keyword (by all of a shorter one),
    which a text must hold anywhere; so any number of keywords is joined by equality.
    """
    words = keywords.where("is_active and trim(keyword) != ''").select(F.lower(F.trim("keyword")).alias("keyword")).distinct()
    words = words.withColumn("gram", F.left("keyword", F.lit(3)))
    low = F.lower(F.col(text_col))
    starts = F.sequence(F.lit(1), F.length(low))
    grams = F.flatten(F.transform(F.array(*map(F.lit, (1, 2, 3))), lambda k: F.transform(starts, lambda i: F.substring(low, i, k))))
    rows = texts.where(F.length(text_col) > 0).select(F.col(id_col), low.alias("low"), F.explode(F.array_distinct(grams)).alias("gram"))
    hits = rows.join(words, "gram").where(F.contains("low", "keyword"))
    return hits.groupBy(id_col, "low").agg(F.max_by("keyword", F.struct(F.length("keyword"), "keyword")).alias("keyword")).select(id_col, "keyword")

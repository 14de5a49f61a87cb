"""Stupid-backoff scores with one row for each n-gram: count tables, joins and sums of DataFrames.

The same scores as ``stupid_backoff.score_documents``, which exchanges packed lists in place of rows.
An n-gram of ``m`` words is a 64-bit hash; ``count_table`` groups all documents' n-grams by it, after each
task has added up its own. ``log_table`` makes the counts into log S of the n-gram: its count over its
context's, once for each distinct n-gram. The exploded words meet these tables from the longest n-gram
down, take the first that is there, and are summed for each document. A hot n-gram's words are left to
adaptive skew joins; its count is one row for each task.

Defined cases are those of ``stupid_backoff``. Rows are numbered as they are read, so repeated rows each
keep their score.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from numberboard.llm.frames import texts, written
from numberboard.llm.stupid_backoff import BACKOFF, CUTOFF, ORDER

WHITE = r"[\x20\x09-\x0D]+"


def exploded(documents: DataFrame, order: int = ORDER) -> DataFrame:
    """A row for each word: row, doc_id, the hashes g1 to g<order> of the n-grams that it ends (null: too few words
    before) and those of their contexts, c2 to c<order>.

    A text without words has one row without n-grams.
    """

    def ending(word: Column, place: Column) -> Column:
        def gram(last: int, m: int) -> Column:
            words = [F.get("hashes", place - k) for k in range(last + m - 1, last - 1, -1)]
            return words[0] if m == 1 else F.xxhash64(*words)

        def full(m: int, value: Column) -> Column:
            return F.when(place >= m - 1, value)

        own = [full(m, gram(0, m)).alias(f"g{m}") for m in range(1, order + 1)]
        contexts = [full(m, gram(1, m - 1)).alias(f"c{m}") for m in range(2, order + 1)]
        return F.struct(*own, *contexts)

    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), WHITE), "")
    hashed = texts(documents).select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.transform(words, lambda w: F.xxhash64(w)).alias("hashes")
    )
    return hashed.select("row", "doc_id", F.explode_outer(F.transform("hashes", ending)).alias("word")).select("row", "doc_id", "word.*")


def count_table(words: DataFrame, m: int) -> DataFrame:
    """gram, n and context (the gram of the words before the last; null for single words) of every n-gram of ``m`` words."""
    context = F.col(f"c{m}") if m > 1 else F.lit(None).cast("long")
    of = words.where(F.col(f"g{m}").isNotNull()).select(F.col(f"g{m}").alias("gram"), context.alias("context"))
    counted = of.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.max("context").alias("context"))
    return counted.where(F.col("n") >= CUTOFF) if m > 1 else counted


def log_tables(words: DataFrame, order: int = ORDER) -> list[DataFrame]:
    """For each order from 1: gram and log S of the n-grams that are scored without backing off."""
    counts = [written(count_table(words, m), f"backoff-counts-{m}") for m in range(1, order + 1)]
    total = counts[0].select(F.sum("n")).first()[0] or 1
    logs = [counts[0].select("gram", F.log(F.col("n") / F.lit(total)).alias("log"))]
    for shorter, longer in zip(counts, counts[1:]):
        whole = shorter.select(F.col("gram").alias("context"), F.col("n").alias("whole"))
        logs.append(longer.join(whole, "context").select("gram", F.log(F.col("n") / F.col("whole")).alias("log")))
    return logs


def score_documents(documents: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, n_words and log_score (four decimals) of every document."""
    words = exploded(documents, order)
    found = words.select("row", "doc_id", *(f"g{m}" for m in range(1, order + 1)))
    for m, table in enumerate(log_tables(words, order), start=1):
        # A word without this n-gram meets nothing: its row stands in for the key, so that such words are spread.
        key = F.coalesce(f"g{m}", F.xxhash64("row", F.lit(m)))
        found = found.withColumn("key", key).join(table.select(F.col("gram").alias("key"), F.col("log").alias(f"log{m}")), "key", "left").drop("key")
    score, tries = F.lit(None).cast("double"), F.lit(0)
    for m in range(order, 0, -1):
        score = F.coalesce(score, F.when(F.col(f"g{m}").isNotNull(), F.col(f"log{m}") + tries * math.log(BACKOFF)))
        tries = tries + F.col(f"g{m}").isNotNull().cast("int")
    scored = found.select("row", "doc_id", "g1", score.alias("score"))
    total = F.round(F.coalesce(F.sum("score"), F.lit(0.0)), 4)
    return scored.groupBy("row", "doc_id").agg(F.count("g1").alias("n_words"), total.alias("log_score")).drop("row")

"""Quality rules from a threshold table, compiled into one projection of built-in functions.

Base measures of a text: words are runs of characters other than 0x20 and 0x09-0x0D. Repeated words
are found by sorting (fingerprint, place) of the text's own three-word windows and comparing
neighbours, words included, so the work of a text is n log n and no shuffle is needed.

Defined cases: a null or empty text has zero words and fails the base rule. A ratio whose base is
zero counts as zero. Repeated rows each give a row. An empty table gives an empty result. Other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

#: Frequent function words of the four languages.
STOP_WORDS = tuple(
    (
        "the of and to in is that it for on as with was by are this be from at or an a "
        "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch "
        "de la le et les des en un du une que est pour qui dans par sur au plus pas avec il elle "
        "el los las y del se por con no su para lo como al más o sus le ha me si sin sobre"
    ).split()
)

#: (ratio, least, most): a text is kept if every ratio lies within its bounds, null for none.
PRODUCTION_THRESHOLDS = (
    ("word_length", 2.0, 20.0),
    ("symbols_per_word", None, 0.25),
    ("stop_word_share", 0.03, None),
    ("duplicate_line_share", None, 0.5),
    ("words_per_line", 2.0, None),
)


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(0.0))


def ratios() -> dict[str, Column]:
    """Ratios a threshold table may name, over the columns of ``measures``."""
    return {
        "word_length": _share(F.col("word_chars"), F.col("n_words")),
        "symbols_per_word": _share(F.col("n_symbols"), F.col("n_words")),
        "stop_word_share": _share(F.col("n_stop_words"), F.col("n_words")),
        "duplicate_line_share": _share(F.col("n_dup_lines"), F.col("n_lines")),
        "words_per_line": _share(F.col("n_words"), F.col("n_lines")),
    }


def compile_thresholds(thresholds) -> Column:
    """One boolean column that holds if all bounds do."""
    known, kept = ratios(), F.lit(True)
    for name, least, most in thresholds:
        if least is not None:
            kept = kept & (known[name] >= F.lit(float(least)))
        if most is not None:
            kept = kept & (known[name] <= F.lit(float(most)))
    return kept


def _repeat_words(words: Column, places: Column) -> Column:
    """Words inside windows that are met twice or more; ``places``: (h, i) of all windows, sorted."""

    def same(x: Column, y: Column) -> Column:
        equal = x["h"] == y["h"]
        for k in range(3):
            equal = equal & (F.get(words, x["i"] + k) == F.get(words, y["i"] + k))
        return F.coalesce(equal, F.lit(False))

    met = F.filter(places, lambda x, k: same(x, F.get(places, k - 1)) | same(x, F.get(places, k + 1)))
    begins = F.sort_array(F.transform(met, lambda x: x["i"]))
    nothing = F.struct(F.lit(0).alias("total"), F.lit(0).alias("reach"))
    return F.aggregate(
        begins,
        nothing,
        lambda seen, i: F.struct(
            (seen["total"] + i + 3 - F.greatest(i, seen["reach"])).alias("total"), (i + 3).alias("reach")
        ),
        lambda seen: seen["total"],
    )


BASE_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measures(documents: DataFrame) -> DataFrame:
    """Counts of every text: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_stop_words."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = documents.select(
        "doc_id",
        F.array_remove(F.split(text, WHITE), "").alias("words"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).alias("n_symbols"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    window = F.transform(
        F.when(F.size("words") >= 3, F.sequence(F.lit(0), F.size("words") - 3)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(
            F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)).alias("h"), i.alias("i")
        ),
    )
    found = found.select(
        "doc_id",
        "words",
        "n_symbols",
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.size(F.filter("words", lambda x: F.lower(x).isin(*STOP_WORDS))).alias("n_stop_words"),
        F.sort_array(window).alias("places"),
    )
    counts = {
        "n_words": F.size("words"),
        "word_chars": F.length(F.array_join("words", "")),
        "n_symbols": F.col("n_symbols"),
        "n_dup_lines": F.col("n_dup_lines"),
        "n_repeat_words": _repeat_words(F.col("words"), F.col("places")),
        "n_lines": F.col("n_lines"),
        "n_stop_words": F.col("n_stop_words"),
    }
    return found.select("doc_id", *(c.cast("long").alias(n) for n, c in counts.items()))


def apply_rules(documents: DataFrame, thresholds=PRODUCTION_THRESHOLDS) -> DataFrame:
    """Counts, ``base_failed`` and the verdict ``kept`` of every text."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    judged = measures(documents).withColumn("base_failed", failed)
    kept = ~F.col("base_failed") & compile_thresholds(thresholds)
    return judged.select("doc_id", *BASE_COUNTS, "base_failed", kept.alias("kept"), "n_lines", "n_stop_words")

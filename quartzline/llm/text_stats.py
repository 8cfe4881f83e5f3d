"""Per-document text statistics as DataFrame expressions: no shuffle, no Python.

A word is a maximal run of code points other than the space and the controls 9 to 13.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def words(text: Column) -> Column:
    """All words of a text, in order; none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def with_base_stats(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (long) and the helper arrays
    __words and __lines. Null text counts as empty: all zero. Columns of these names are replaced.

    n_repeat_words: words inside a window of three that occurs twice or more in the text. The windows are hashed,
    sorted with their positions, and the flagged positions are folded into covered words; texts in which
    no window repeats skip the sort.
    """
    d = df.withColumn("__t", F.coalesce(F.col(text), F.lit("")))
    d = d.withColumns(
        {
            "__words": F.regexp_extract_all("__t", F.lit(WORD), F.lit(0)),
            "__lines": F.filter(F.split("__t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        }
    )
    w = F.col("__words")
    grams = F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    d = d.withColumn("__grams", F.slice(grams, 1, F.greatest(F.size(w) - 2, F.lit(0))))
    g = F.col("__grams")
    indexed = F.array_sort(F.transform(g, lambda v, i: F.struct(v.alias("v"), i.alias("i"))))
    d = d.withColumn("__dups", F.when(F.size(F.array_distinct(g)) < F.size(g), indexed))
    s = F.col("__dups")

    def flagged(e, k):
        same = F.coalesce(F.get(s, k + 1)["v"] == e["v"], F.lit(False)) | F.coalesce(F.get(s, k - 1)["v"] == e["v"], F.lit(False))
        return F.when(same, e["i"])

    covered = F.aggregate(
        F.array_sort(F.array_compact(F.transform(s, flagged))),
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    t, lines = F.col("__t"), F.col("__lines")
    return d.withColumns(
        {
            "n_words": F.size(w).cast("long"),
            "word_chars": F.length(without(t, SPACES)).cast("long"),
            "n_symbols": (F.length(t) - F.length(without(t, SYMBOLS))).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
        }
    ).drop("__grams", "__dups")

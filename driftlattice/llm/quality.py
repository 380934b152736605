"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Every rule is a row of THRESHOLDS: a ratio's name, its least and its greatest admissible value. `ratios` gives the
ratios as column expressions over a whole text, and `compile_rules` folds the table into one boolean column.

Defined results: a null or empty text has no words, so all counts are 0, base_failed is true and kept false. Repeated
rows are judged one by one. Columns besides the text pass through `quality_rules`; its own columns replace columns of
the same name (without regard to case).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Word separators, as a Java pattern: space and tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: Common words of the languages the thresholds were set on.
STOP_WORDS = {
    "en": "the of and to in a is that it for on was with as be by this are at from or an",
    "fr": "le la les de des du et un une que qui dans pour par sur est en au",
    "de": "der die das und in von zu den mit ist auf ein eine sich dem nicht",
    "es": "el la los las de que y en un una por con para se no su",
}
#: ratio, least, greatest (None: no bound). Applied to every text that passed the base rules.
THRESHOLDS = (
    ("word_length", 2.0, 12.0),  # code points in a word, on average
    ("symbol_ratio", None, 0.5),  # symbols to a word
    ("stop_ratio", 0.02, None),  # stop words among words
    ("dup_line_ratio", None, 0.5),  # repeated lines among lines with a word
    ("repeat_ratio", None, 0.5),  # words in repeated 3-word windows
)


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def lines_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def repeated_words(words: Column, n: int = 3) -> Column:
    """Words that lie in an n-word window whose words occur in another window of the text.

    The windows are sorted beside their places, so equal windows are neighbours: n log n, however often they repeat.
    """
    windows = F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.struct(F.concat_ws(" ", *[F.get(words, i + k) for k in range(n)]).alias("w"), i.alias("at")))
    return F.when(F.size(words) > n, F.sort_array(windows))


def covered(ordered: Column, n: int = 3) -> Column:
    """From sorted windows, the number of words that repeated ones cover."""
    starts = F.filter(
        F.transform(ordered, lambda x, i: F.when((F.get(ordered, i - 1)["w"] == x["w"]) | (F.get(ordered, i + 1)["w"] == x["w"]), x["at"])), lambda p: p.isNotNull()
    )
    spots = F.flatten(F.transform(starts, lambda p: F.sequence(p, p + (n - 1))))
    return F.coalesce(F.size(F.array_distinct(spots)), F.lit(0)).cast("long")


def compile_rules(table=THRESHOLDS) -> Column:
    """One condition from a threshold table over the columns that it names."""
    out = F.lit(True)
    for name, least, most in table:
        if least is not None:
            out = out & (F.col(name) >= least)
        if most is not None:
            out = out & (F.col(name) <= most)
    return out


def quality_rules(df: DataFrame, text: str = "text", table=THRESHOLDS, min_words: int = 50, repeat_percent: int = 50) -> DataFrame:
    """df with the counts, the ratios of the table, base_failed and kept."""
    stop = F.array(*[F.lit(w) for w in sorted({w for x in STOP_WORDS.values() for w in x.split()})])
    own = "n_words word_chars n_symbols n_dup_lines n_repeat_words n_lines n_stop word_length symbol_ratio stop_ratio dup_line_ratio repeat_ratio base_failed kept".split()
    rest = [c for c in df.columns if c.lower() not in own]
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    df = df.select(*[F.col(f"`{c}`").alias(f"__rest{k}") for k, c in enumerate(rest)], t.alias("__t"), words_of(t).alias("__w"), lines_of(t).alias("__l"))
    df = df.withColumn("__o", repeated_words(F.col("__w")))
    pure = F.length(F.regexp_replace("__t", SPACE, ""))
    w, lines = F.col("__w"), F.col("__l")
    df = df.select(
        *[F.col(f"__rest{k}") for k in range(len(rest))],
        F.size(w).cast("long").alias("n_words"),
        pure.cast("long").alias("word_chars"),
        (F.length("__t") - F.length(F.regexp_replace("__t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        covered(F.col("__o")).alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
        F.size(F.filter(w, lambda x: F.lower(x).isin(*sorted({w for x in STOP_WORDS.values() for w in x.split()})))).cast("long").alias("n_stop"),
    )
    n = F.greatest(F.col("n_words"), F.lit(1))
    df = df.withColumns(
        {
            "word_length": F.col("word_chars") / n,
            "symbol_ratio": F.col("n_symbols") / n,
            "stop_ratio": F.col("n_stop") / n,
            "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
            "repeat_ratio": F.col("n_repeat_words") / n,
            "base_failed": (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words")),
        }
    )
    df = df.withColumn("kept", ~F.col("base_failed") & compile_rules(table))
    return df.select(*[F.col(f"__rest{k}").alias(c) for k, c in enumerate(rest)], *own)

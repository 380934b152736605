"""Change coupling: files that change together in commits(seq, files)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recent(commits: DataFrame, history_depth: int) -> DataFrame:
    """The last commits by seq; none for a depth of 0."""
    return commits.orderBy(F.desc("seq")).limit(history_depth) if history_depth > 0 else commits.limit(0)


def pair_counts(commits: DataFrame) -> DataFrame:
    """(source, target, cochange_count): unordered pairs out of each commit, counted once a commit.

    Pairs are unfolded inside each row, file by file, so the only shuffle is that of their counts.
    """
    files = F.array_sort(F.array_distinct(F.filter("files", lambda f: f.isNotNull())))
    rows = commits.select(files.alias("f")).select("f", F.posexplode("f").alias("i", "source"))
    rows = rows.select("source", F.explode(F.slice("f", F.col("i") + 2, F.size("f"))).alias("target"))
    return rows.groupBy("source", "target").agg(F.count(F.lit(1)).alias("cochange_count"))


def summary(commits: DataFrame, history_depth: int = 500) -> DataFrame:
    """One row: commits_analyzed (those without files too), distinct_files_touched."""
    window = recent(commits, history_depth)
    touched = window.select(F.explode("files").alias("f")).agg(F.countDistinct("f").alias("distinct_files_touched"))
    return window.agg(F.count(F.lit(1)).alias("commits_analyzed")).crossJoin(touched)  # one row times one row


def change_coupling(commits: DataFrame, min_frequency: float = 0.6, history_depth: int = 500, least: int = 2) -> DataFrame:
    """(source, target, frequency, cochange_count) of pairs seen `least` times and often enough, in order."""
    if not 0.0 <= min_frequency <= 1.0:
        raise ValueError(f"min_frequency must be between 0 and 1: {min_frequency}")
    window = recent(commits, history_depth)
    n = window.agg(F.count(F.lit(1)).alias("n"))
    pairs = pair_counts(window).crossJoin(F.broadcast(n)).withColumn("frequency", F.col("cochange_count") / F.col("n"))  # one row
    return pairs.filter((F.col("cochange_count") >= least) & (F.col("frequency") >= min_frequency)).select("source", "target", "frequency", "cochange_count").orderBy("source", "target")


def coupling_weights(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(source, target, weight = 1 + frequency) of pairs whose ends are nodes."""
    ids = nodes.select(F.col("id").alias("__id"))
    known = pairs.join(ids, F.col("source") == F.col("__id"), "left_semi").join(ids, F.col("target") == F.col("__id"), "left_semi")
    return known.select("source", "target", (1.0 + F.col("frequency")).alias("weight"))

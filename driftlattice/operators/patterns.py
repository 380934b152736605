"""Pattern metrics over instances(category, fingerprint, ...) and over catalogs(category, fingerprint, count)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlattice.functions.classify import hint_category
from driftlattice.functions.fingerprint import with_fingerprints
from driftlattice.functions.paths import matches_any

MIN_PATTERN_NODES = 5


def pattern_counts(instances: DataFrame) -> DataFrame:
    return instances.groupBy("category", "fingerprint").agg(F.count(F.lit(1)).alias("count"))


def category_metrics(counts: DataFrame) -> DataFrame:
    """category, total, n_distinct, raw entropy in bits, normalized entropy in [0, 1], convention drift.

    Entropy comes from sums of n and n log n, so a category's counts meet in a partial aggregate and never in a list.
    """
    n = F.col("count").cast("double")
    sums = counts.filter("count > 0").groupBy("category").agg(F.sum("count").alias("total"), F.count(F.lit(1)).alias("n_distinct"), F.sum(n * F.log2(n)).alias("__nlogn"))
    raw = F.greatest(F.lit(0.0), F.log2("total") - F.col("__nlogn") / F.col("total"))
    share = F.least(F.greatest(F.col("entropy_raw") / F.log2("n_distinct"), F.lit(0.0)), F.lit(1.0))
    return (
        sums.withColumn("entropy_raw", F.when(F.col("n_distinct") <= 1, 0.0).otherwise(raw))
        .withColumn("entropy_normalized", F.when(F.col("n_distinct") <= 1, 0.0).otherwise(share))
        .withColumn("convention_drift", F.col("n_distinct") / F.col("total"))
        .drop("__nlogn")
    )


def pattern_metrics(instances: DataFrame) -> DataFrame:
    """Metrics of foreign instances: raw entropy."""
    return category_metrics(pattern_counts(instances)).select("category", "total", "n_distinct", F.col("entropy_raw").alias("entropy"), "convention_drift")


def catalog_metrics(counts: DataFrame) -> DataFrame:
    """Metrics of a catalog: normalized entropy."""
    return category_metrics(counts).select("category", "total", "n_distinct", F.col("entropy_normalized").alias("entropy"), "convention_drift")


def totals(metrics: DataFrame) -> DataFrame:
    """One row: sum of entropies, mean of drifts; 0 where there are no categories."""
    return metrics.agg(F.coalesce(F.sum("entropy"), F.lit(0.0)).alias("total_entropy"), F.coalesce(F.avg("convention_drift"), F.lit(0.0)).alias("convention_drift"))


def at_least(counts: DataFrame, least: int = MIN_PATTERN_NODES) -> DataFrame:
    return counts.filter(F.col("count") >= least)


def hint_rows(records: DataFrame) -> DataFrame:
    """A row for each hint of feature records, with its place in the file's list."""
    rows = records.select("path", "language", F.posexplode("pattern_hints").alias("ordinal", "hint"))
    return rows.select("path", "language", "ordinal", "hint.*")


def catalog(records: DataFrame, min_pattern_nodes: int = MIN_PATTERN_NODES, scope_exclude: list[str] | None = None) -> DataFrame:
    """category, fingerprint, count and locations (in order of path and of place in the file) of classified hints."""
    rows = hint_rows(records)
    if scope_exclude:
        rows = rows.filter(~matches_any(F.col("path"), scope_exclude))
    rows = with_fingerprints(rows.withColumn("category", hint_category(F.col("node_kind"), F.col("text"), F.col("language"))).filter("category IS NOT NULL"))
    place = F.struct(F.split("path", "/").alias("k"), F.col("ordinal"), F.col("path").alias("file"), F.col("start_row"), F.col("start_col"))
    grouped = rows.groupBy("category", "fingerprint").agg(F.count(F.lit(1)).alias("count"), F.sort_array(F.collect_list(place)).alias("__at"))
    spots = F.transform("__at", lambda x: F.struct(x["file"].alias("file"), x["start_row"].alias("start_row"), x["start_col"].alias("start_col")))
    return at_least(grouped, min_pattern_nodes).select("category", "fingerprint", "count", spots.alias("locations"))

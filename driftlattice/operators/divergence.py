"""Deltas between snapshots, trends, and threshold gates.

snapshots(seq, density, community_count, violation_count, convention_drift); categories(seq, category, entropy,
convention_drift). violation_count is null where no boundaries are declared; null never turns into 0.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPSILON = 1e-9
NEVER = datetime.date(9999, 12, 31)
RATES = {"pattern_entropy": 2.0, "convention_drift": 3.0, "coupling_delta": 0.15, "boundary_violations": 2.0}


def snapshot_entropy(categories: DataFrame) -> DataFrame:
    return categories.groupBy("seq").agg(F.sum("entropy").alias("total_entropy"))


def snapshot_deltas(snapshots: DataFrame, categories: DataFrame) -> DataFrame:
    """A row for each snapshot: its change against the one before; all null for the first."""
    df = snapshots.join(snapshot_entropy(categories), "seq", "left").withColumn("total_entropy", F.coalesce("total_entropy", F.lit(0.0)))
    order = Window.orderBy("seq")  # a row for each snapshot
    d = lambda c: F.col(c) - F.lag(c).over(order)
    return df.select(
        "seq",
        d("total_entropy").alias("pattern_entropy_delta"),
        d("convention_drift").alias("convention_drift_delta"),
        d("density").alias("coupling_delta"),
        d("community_count").cast("long").alias("community_count_delta"),
        d("violation_count").cast("long").alias("boundary_violation_delta"),
    )


def category_deltas(categories: DataFrame, before: int, after: int) -> DataFrame:
    """(category, entropy_delta, drift_delta) between two snapshots; a category that one lacks counts 0 there."""
    side = lambda seq, p: categories.filter(F.col("seq") == seq).select("category", F.col("entropy").alias(f"{p}e"), F.col("convention_drift").alias(f"{p}d"))
    both = side(before, "a").join(side(after, "b"), "category", "full_outer")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return both.select("category", (zero("be") - zero("ae")).alias("entropy_delta"), (zero("bd") - zero("ad")).alias("drift_delta"))


def null_summary(spark) -> DataFrame:
    return spark.sql("SELECT CAST(NULL AS DOUBLE) pattern_entropy_delta, CAST(NULL AS DOUBLE) convention_drift_delta, CAST(NULL AS DOUBLE) coupling_delta, CAST(NULL AS BIGINT) community_count_delta, CAST(NULL AS BIGINT) boundary_violation_delta")


def trend(snapshots: DataFrame, last_n: int | None = None) -> DataFrame:
    """One row: snapshot_count and mean first differences of the last snapshots; null for fewer than two."""
    if last_n is not None:
        snapshots = snapshots.orderBy(F.desc("seq")).limit(last_n) if last_n > 0 else snapshots.limit(0)
    order = Window.orderBy("seq")  # a row for each snapshot
    names = {"total_entropy": "pattern_entropy_slope", "convention_drift": "convention_drift_slope", "density": "coupling_slope", "community_count": "community_count_slope"}
    diffs = snapshots.select("seq", *[(F.col(c).cast("double") - F.lag(F.col(c).cast("double")).over(order)).alias(c) for c in names])
    return diffs.agg(F.count("seq").alias("snapshot_count"), *[F.avg(c).alias(s) for c, s in names.items()])


def breaches(delta: Column, limit: Column) -> Column:
    return delta > limit + F.lit(EPSILON)


def applied_overrides(overrides: DataFrame, today: datetime.date = NEVER) -> DataFrame:
    """overrides(category, rates, expires) with active, expires as a date and expired_reason."""
    day = F.try_to_date(F.when(F.col("expires").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.col("expires")), "yyyy-MM-dd")
    active = F.coalesce(F.lit(today) <= day, F.lit(False))
    reason = F.when(day.isNull(), "failed to parse expires date").when(~active, F.concat(F.lit("expired on "), day.cast("string")))
    return overrides.withColumn("active", active).withColumn("expired_reason", reason).withColumn("expires_on", F.coalesce(day, F.lit(datetime.date(1970, 1, 1))))


def threshold_breaches(summary: DataFrame, categories: DataFrame, overrides: DataFrame | None = None, rates: dict | None = None, today: datetime.date = NEVER) -> DataFrame:
    """(ordinal, dimension, category, actual, limit) of what is exceeded.

    summary: a row of deltas; categories(category, entropy_delta, drift_delta). An active override replaces the limit
    of its category; the four totals always keep the general limits.
    """
    rates = RATES | (rates or {})
    totals = [("pattern_entropy", "pattern_entropy_delta"), ("convention_drift", "convention_drift_delta"), ("coupling_delta", "coupling_delta"), ("boundary_violations", "boundary_violation_delta")]
    rows = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(d).alias("dimension"), F.lit(None).cast("string").alias("category"), F.col(c).cast("double").alias("actual"), F.lit(float(rates[d])).alias("limit")) for i, (d, c) in enumerate(totals)])
    out = summary.select(F.explode(rows).alias("x")).select("x.*")
    per = categories.select("category", "entropy_delta", "drift_delta")
    if overrides is not None:
        on = applied_overrides(overrides, today).filter("active").select("category", "pattern_entropy_rate", "convention_drift_rate")
        per = per.join(F.broadcast(on), "category", "left")  # an override is a line of a configuration
    else:
        per = per.withColumn("pattern_entropy_rate", F.lit(None).cast("double")).withColumn("convention_drift_rate", F.lit(None).cast("double"))
    pairs = [(4, "pattern_entropy", "entropy_delta", "pattern_entropy_rate"), (5, "convention_drift", "drift_delta", "convention_drift_rate")]
    rows = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(d).alias("dimension"), F.col("category"), F.col(c).alias("actual"), F.coalesce(r, F.lit(float(rates[d]))).alias("limit")) for i, d, c, r in pairs])
    out = out.unionByName(per.select(F.explode(rows).alias("x")).select("x.*"))
    return out.filter(breaches(F.col("actual"), F.col("limit"))).orderBy("ordinal", "category")

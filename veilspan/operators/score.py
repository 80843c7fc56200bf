"""Precision, recall and latency of the detection on labelled samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .joins import attach, cut_lineage

# The gates a run must pass.
PRECISION_GATE, RECALL_GATE, LATENCY_GATE_MS = 0.98, 0.90, 50.0


def covers(hit: Column, expected: Column) -> Column:
    """A hit counts when it contains the expected secret or is contained in it."""
    return F.contains(hit, expected) | F.contains(expected, hit)


def positive_counts(df: DataFrame, hits: str, expected: str, besides: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One expected secret per row: tp or fn, and every hit beside it a fp when it was found.

    ``besides`` names an array of further credentials of the row, which are no false hits.
    """
    covered = F.exists(hits, lambda h: covers(h, F.col(expected)))
    known = F.array(expected) if besides is None else F.concat(F.array(expected), F.col(besides))
    extra = F.size(F.filter(hits, lambda h: ~F.exists(known, lambda e: covers(h, e))))
    return df.select(*keep, covered.cast("bigint").alias("tp"), F.when(covered, extra).otherwise(0).cast("bigint").alias("fp"),
                     (~covered).cast("bigint").alias("fn"))


def found_counts(df: DataFrame, hits: str, expected: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Several expected secrets per row, found or not; other hits are counted elsewhere."""
    found = F.size(F.filter(expected, lambda e: F.exists(hits, lambda h: covers(h, e)))).cast("bigint")
    return df.select(*keep, found.alias("tp"), F.lit(0).cast("bigint").alias("fp"), (F.size(expected) - found).cast("bigint").alias("fn"))


def negative_counts(df: DataFrame, hits: str, keep: tuple[str, ...] = ()) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    return df.select(*keep, zero.alias("tp"), F.size(hits).cast("bigint").alias("fp"), zero.alias("fn"))


def mixed_counts(df: DataFrame, hits: str, expected: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Several expected secrets per row, which claim the first hit that covers them; a hit that none claims is extra."""
    claimed = F.transform(F.col(expected), lambda e: F.get(F.filter(hits, lambda h: covers(h, e)), F.lit(0)))
    found = F.size(F.array_compact(claimed))
    extra = F.size(F.filter(hits, lambda h: ~F.coalesce(F.array_contains(F.array_compact(claimed), h), F.lit(False))))
    return df.select(*keep, found.cast("bigint").alias("tp"), extra.cast("bigint").alias("fp"),
                     (F.size(expected) - found).cast("bigint").alias("fn"))


def scores(counts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Totals, for each group of ``by``, with precision, recall and F1; an empty denominator gives 1, 1 and 0."""
    sums = counts.groupBy(*by).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")])

    def ratio(part: Column, whole: Column, empty: float) -> Column:
        return F.when(whole == 0, F.lit(empty)).otherwise(part / whole)
    p = ratio(F.col("tp"), F.col("tp") + F.col("fp"), 1.0)
    r = ratio(F.col("tp"), F.col("tp") + F.col("fn"), 1.0)
    rated = sums.withColumn("precision", p).withColumn("recall", r)
    return rated.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"), 0.0))


def nearest_rank(df: DataFrame, value: str, quantiles: list[float], by: list[str] | None = None) -> DataFrame:
    """Value at sorted position floor(n * q), exactly, also for one group too large for a task.

    Distinct values are counted, range-partitioned and ranked inside each partition; only the
    totals per partition are put in sequence.
    """
    by = by or []
    counted = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    ranged = cut_lineage(counted.repartitionByRange(*by, value).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy(*by, "_part").orderBy(value)
    group = Window.partitionBy(*by)
    earlier = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = (ranged.groupBy(*by, "_part").agg(F.sum("_n").alias("_t"))
              .withColumn("_before", F.coalesce(F.sum("_t").over(earlier), F.lit(0)))
              .withColumn("_all", F.sum("_t").over(group)).drop("_t"))
    ranked = attach(ranged.withColumn("_upto", F.sum("_n").over(inside)), totals, [*by, "_part"])
    last = F.col("_before") + F.col("_upto")
    picks = []
    for q in quantiles:
        place = F.least(F.floor(F.col("_all") * q), F.col("_all") - 1)
        picks.append(F.max(F.when((last > place) & (last - F.col("_n") <= place), F.col(value))).alias(f"p{round(q * 100)}"))
    return ranked.groupBy(*by).agg(*picks)


def score_deltas(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Metric tables (metric, value) of two runs with the difference."""
    return (current.join(previous.select("metric", F.col("value").alias("previous")), "metric", "left")
            .withColumn("delta", F.col("value") - F.col("previous")))


def gates(metrics: DataFrame) -> DataFrame:
    """Pass or fail of each gated metric (metric, value)."""
    value = F.col("value")
    passed = (F.when(F.col("metric") == "precision", value >= PRECISION_GATE)
              .when(F.col("metric") == "recall", value >= RECALL_GATE)
              .when(F.col("metric") == "p99_ms", value <= LATENCY_GATE_MS))
    return metrics.withColumn("passed", passed).filter(F.col("passed").isNotNull())

"""Fixed-bound histograms.

A histogram is one row per label set: ``n``, ``total`` (sum of the observed values) and ``buckets``, the count
per bound (not cumulative). Observations above the last bound are only in ``n`` and ``total``, except
under the ``log2`` rule, which keeps them in the last bucket. Rows add up, so partial results merge.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bucket bounds. Gaps: 0.001 * 2^i ms; interrupt latency and call duration: 5^i microseconds.
GAP_BOUNDS_MS = tuple(0.001 * 2**i for i in range(15))
LATENCY_BOUNDS_US = tuple(float(5**i) for i in range(11))
DURATION_BOUNDS_US = tuple(float(5**i) for i in range(12))


def histogram(
    df: DataFrame,
    value: Column,
    labels: Sequence[str],
    bounds: Sequence[float],
    rule: str = "first_ge",
    total: Column | None = None,
) -> DataFrame:
    """Histogram of ``value`` per label set, in one aggregation.

    ``first_ge``: the first bound not below the value. ``log2``: bound i takes values with
    ``floor(log2(value)) == i`` (0 counts as 0), the last bound everything beyond; ``value`` is then an
    integer in units of the first bound. ``total`` overrides what is summed.
    """
    if rule == "first_ge":
        below = [value <= F.lit(b) for b in bounds]
    elif rule == "log2":
        below = [value < F.lit(1 << (i + 1)).cast("bigint") for i in range(len(bounds) - 1)] + [value.isNotNull()]
    else:
        raise ValueError(f"unknown rule {rule!r}")
    counted = df.groupBy(*labels).agg(
        F.count(value).alias("n"),
        F.sum(value if total is None else total).alias("total"),
        *[F.count_if(test).alias(f"_le{i}") for i, test in enumerate(below)],
    )
    steps = [F.col("_le0")] + [F.col(f"_le{i}") - F.col(f"_le{i - 1}") for i in range(1, len(bounds))]
    return counted.select(*labels, "n", "total", F.array(*steps).alias("buckets"))


def merge_histograms(a: DataFrame, b: DataFrame, labels: Sequence[str], bounds: Sequence[float]) -> DataFrame:
    """Add two histograms with the same labels and bounds."""
    return add_histograms(a.unionByName(b), labels, bounds)


def add_histograms(parts: DataFrame, labels: Sequence[str], bounds: Sequence[float]) -> DataFrame:
    return (
        parts.groupBy(*labels)
        .agg(
            F.sum("n").alias("n"),
            F.sum("total").alias("total"),
            *[F.sum(F.get("buckets", F.lit(i))).alias(f"_b{i}") for i in range(len(bounds))],
        )
        .select(*labels, "n", "total", F.array(*[f"_b{i}" for i in range(len(bounds))]).alias("buckets"))
    )


def cumulative(h: DataFrame, bounds: Sequence[float]) -> DataFrame:
    """One row per label set and bound: ``le`` and the running total ``bucket_count``; every bound is present."""
    labels = [c for c in h.columns if c != "buckets"]
    running, steps = F.lit(0).cast("bigint"), []
    for i, bound in enumerate(bounds):
        running = running + F.get("buckets", F.lit(i))
        steps.append(F.struct(F.lit(float(bound)).alias("le"), running.alias("bucket_count")))
    return h.select(*labels, F.inline(F.array(*steps)))

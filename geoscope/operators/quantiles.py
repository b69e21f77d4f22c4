"""Exact medians that never gather a group in one task.

Spark's ``median`` keeps every distinct value of a group in one aggregation buffer, so one hot
group (or the global median) is bound to a single task. Here a group's median is found by
counting instead: values fall into ordered buckets of a monotone scale, bucket counts combine
map-side, and only the bucket that holds the middle rank is looked at more closely.

``rank_buckets`` / ``middle_values`` are written against counts, so the same steps serve plain
groups (``exact_median``) and overlapping zones (``distributions.zone_median``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# log1p buckets of width 2**-12 first (some 70k up to 1e7), then 2**-30 (2**18 per first bucket).
# What is left in a second bucket are distinct doubles closer than one part in a billion.
COARSE_BITS, FINE_BITS = 12, 30


def bucket(value: Column | str, bits: int) -> Column:
    """Order-preserving bucket number: equal values share it, larger values never get a smaller one.

    For values that are not null. It is a join key and marked as never null, so that Catalyst adds
    no null tests to one branch of a shared plan only.
    """
    v = F.col(value) if isinstance(value, str) else value
    scale = F.signum(v) * F.log1p(F.abs(v))
    return F.coalesce(F.floor(scale * float(2**bits)), F.lit(0).cast("long"))


def rank_buckets(hist: DataFrame, keys: Sequence[str], bucket_col: str, parent: str | None = None) -> DataFrame:
    """The bucket(s) of each key that hold its two middle ranks.

    ``hist`` has keys, ``bucket_col``, ``n`` and, below the first level, ``parent``, ``total``
    and ``before`` (rows of the key in smaller buckets). The window runs over bucket counts,
    whose number per key is limited by the scale, not by the data.
    """
    inside = [*keys, parent] if parent else list(keys)
    # Without keys this is a one-partition window over one row per bucket.
    order = Window.partitionBy(*inside).orderBy(bucket_col)
    ranked = hist
    if parent is None:
        everything = Window.partitionBy(*inside)
        ranked = ranked.withColumn("total", F.sum("n").over(everything)).withColumn("before", F.lit(0).cast("long"))
    upto = F.col("before") + F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))
    ranked = ranked.withColumn("_upto", upto)
    low_rank, high_rank = _middle_ranks("total")
    return ranked.filter((F.col("_upto") >= low_rank) & (F.col("_upto") - F.col("n") < high_rank)).select(
        *keys, bucket_col, "total", (F.col("_upto") - F.col("n")).alias("before")
    )


def _middle_ranks(total: str) -> tuple[Column, Column]:
    n = F.col(total)
    return F.floor((n + 1) / 2), F.floor(n / 2) + 1


def middle_values(values: DataFrame, keys: Sequence[str], value: str, parent: str) -> DataFrame:
    """(keys, median) from distinct values with count ``n`` inside the last buckets."""
    hits = rank_buckets(values, keys, value, parent)
    return hits.groupBy(*keys).agg(((F.min(value) + F.max(value)) / 2).alias("median"))


def exact_median(df: DataFrame, keys: Sequence[str], value: str, few_keys: bool = False) -> DataFrame:
    """Exact median of ``value`` per group: (keys, median). Nulls are ignored, empty groups absent.
    Without keys there is always one row, with a null median when there are no values.

    ``few_keys`` states that the number of groups has a proven small bound (years, decades,
    none), so the table of at most two target buckets per group is sent to every executor and
    the data is not shuffled. Otherwise the join is left to Spark: keyed by group *and* bucket,
    so a hot group is spread, and split further by AQE.
    """
    keys = list(keys)
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    rows = rows.withColumn("_b1", bucket("_v", COARSE_BITS))

    coarse = rows.groupBy(*keys, "_b1").agg(F.count(F.lit(1)).alias("n"))
    first = rank_buckets(coarse, keys, "_b1")
    near = rows.join(F.broadcast(first) if few_keys else first, [*keys, "_b1"])
    # Distinct values of the target buckets only; a repeated value collapses before the shuffle.
    distinct = near.groupBy(*keys, "_b1", "_v", "total", "before").agg(F.count(F.lit(1)).alias("n"))
    distinct = distinct.withColumn("_b2", bucket("_v", FINE_BITS))

    fine = distinct.groupBy(*keys, "_b1", "_b2", "total", "before").agg(F.sum("n").alias("n"))
    second = rank_buckets(fine, keys, "_b2", parent="_b1")
    if few_keys:
        second = F.broadcast(second)
    nearest = distinct.drop("total", "before").join(second, [*keys, "_b2"])
    return middle_values(nearest, keys, "_v", parent="_b2")

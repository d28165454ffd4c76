"""Ranks, cumulative counts and exact quantiles that never sort a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.session import cut


def ordered_counts(df: DataFrame, keys: Sequence[str], value: str, weights: dict[str, object] | None = None) -> DataFrame:
    """Per group and distinct value: its count, ``before`` (rows with smaller values) and ``total``.

    Rows with a null value or key are left out. Values are counted first, ranged over all tasks by (group, value),
    and the counts of the ranges before are added, so a group that holds most rows is spread like any other.
    ``weights`` names further sums: each gives <name>, before_<name> and total_<name>.
    """
    sums = {"count": F.count(F.lit(1)), **{n: F.sum(c) for n, c in (weights or {}).items()}}
    rows = df.where(F.col(value).isNotNull()).dropna(subset=list(keys)) if keys else df.where(F.col(value).isNotNull())
    flat = rows.groupBy(*keys, value).agg(*[c.alias(n) for n, c in sums.items()])
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the range bounds are drawn anew with every run, so the ranges are written once and read from there
    ranged = cut(flat.repartitionByRange(parts, *keys, value).withColumn("__part", F.spark_partition_id()))
    per = ranged.groupBy(*keys, "__part").agg(*[F.sum(n).alias(n) for n in sums])
    ahead = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select(*keys, "__part", *[F.coalesce(F.sum(n).over(ahead), F.lit(0)).alias(f"__o_{n}") for n in sums], *[F.sum(n).over(Window.partitionBy(*keys)).alias(f"__t_{n}") for n in sums])
    within = Window.partitionBy(*keys, "__part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(offsets, [*keys, "__part"])
    names = {"count": ("before", "total")}
    columns = [c for n in sums for c in (F.col(n), (F.coalesce(F.sum(n).over(within), F.lit(0)) + F.col(f"__o_{n}")).alias(names.get(n, (f"before_{n}", ""))[0]), F.col(f"__t_{n}").alias(names.get(n, ("", f"total_{n}"))[1]))]
    return out.select(*keys, value, *columns)


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probabilities: dict[str, float]) -> DataFrame:
    """Exact quantiles per group with linear interpolation, and ``n``; groups without values are absent."""
    counted = ordered_counts(df, keys, value)
    aggregates = [F.max("total").alias("n")]
    for name, p in probabilities.items():
        at = (F.col("total") - 1) * F.lit(p)
        low, high = F.floor(at), F.ceil(at)
        inside = lambda k: (F.col("before") <= k) & (k < F.col("before") + F.col("count"))
        aggregates += [F.max(F.when(inside(low), F.col(value))).alias(f"__l_{name}"), F.max(F.when(inside(high), F.col(value))).alias(f"__h_{name}"), F.max(at - low).alias(f"__f_{name}")]
    out = counted.groupBy(*keys).agg(*aggregates)
    return out.select(*keys, "n", *[(F.col(f"__l_{n}") + (F.col(f"__h_{n}") - F.col(f"__l_{n}")) * F.col(f"__f_{n}")).alias(n) for n in probabilities])


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, rank: str = "rank") -> DataFrame:
    """Per group and distinct value its rank from 1, ties averaged, and as a share of the group (``<rank>_share``)."""
    c = ordered_counts(df, keys, value)
    r = F.col("before") + (F.col("count") + 1) / 2
    return c.select(*keys, value, r.alias(rank), (r / F.col("total")).alias(f"{rank}_share"))


def ecdf(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Empirical distribution function at each distinct value."""
    c = ordered_counts(df, keys, value)
    return c.select(*keys, value, ((F.col("before") + F.col("count")) / F.col("total")).alias("share"))

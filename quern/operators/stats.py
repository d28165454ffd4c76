"""Descriptive statistics, tests, correlations and the cluster bootstrap."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.ordered import average_ranks, exact_quantiles, ordered_counts

QUARTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75}


def feature_summaries(df: DataFrame, keys: Sequence[str], features: Sequence[str], entity: str, samples: dict[str, Column] | None = None) -> DataFrame:
    """Per group and feature: n_rows and n_countries with a value, mean, median, quartiles and their distance.

    ``samples`` (names and conditions, which may overlap) are told apart by ``sample``: values are counted once, with the
    number of each sample beside it, so rows are never repeated for the samples that they belong to.
    """
    conditions = [F.lit(True)] if samples is None else list(samples.values())
    flags = [f"__s{i}" for i in range(len(conditions))]
    member = [F.coalesce(c, F.lit(False)).cast("int").alias(f) for f, c in zip(flags, conditions)]
    long = df.select(*keys, F.col(entity).alias("__e"), *member, F.expr(f"stack({len(features)}, {', '.join(f'{chr(39)}{f}{chr(39)}, cast({f} as double)' for f in features)}) as (feature, value)"))
    long = long.where(F.col("value").isNotNull() & ~F.isnan("value"))
    by = [*keys, "feature"]
    entities = long.groupBy(*by, "__e").agg(*[F.max(f).alias(f) for f in flags]).groupBy(*by).agg(*[F.count_if((F.col(f) == 1) & F.col("__e").isNotNull()).alias(f"__c{i}") for i, f in enumerate(flags)])
    counted = ordered_counts(long, by, "value", {f: F.col(f) for f in flags})
    each = []
    for i, f in enumerate(flags):
        own, before, total = F.col(f), F.col(f"before_{f}"), F.col(f"total_{f}")
        value_at = lambda k, own=own, before=before: F.max(F.when((before <= k) & (k < before + own), F.col("value")))
        parts = [F.max(total).alias("n_rows"), (F.sum(F.col("value") * own) / F.nullif(F.max(total), F.lit(0))).alias("mean")]
        for name, p in QUARTILES.items():
            at = (total - 1) * F.lit(p)
            low, high = F.floor(at), F.ceil(at)
            parts.append((value_at(low) + (value_at(high) - value_at(low)) * F.max(at - low)).alias(name))
        each.append(F.struct(*parts).alias(f"__r{i}"))
    out = counted.groupBy(*by).agg(*each).join(entities, by)
    listed = F.array(*[F.struct(F.lit(name).alias("sample"), F.col(f"__c{i}").alias("n_countries"), F.col(f"__r{i}").alias("r")) for i, name in enumerate(samples or {"": None})])
    long_out = out.withColumn("__x", F.explode(listed)).where("__x.r.n_rows > 0")
    first = ["__x.sample"] if samples is not None else []
    return long_out.select(*first, *by, "__x.r.n_rows", "__x.n_countries", *[f"__x.r.{c}" for c in ("mean", "q25", "median", "q75")]).withColumn("iqr", F.col("q75") - F.col("q25"))


def wide_quantiles(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Quartiles of several columns per group as <column>_q25 and so on; the columns are put under one another first, so that
    the table is read and counted once for all of them."""
    long = df.select(*keys, F.expr(f"stack({len(values)}, {', '.join(f'{chr(39)}{v}{chr(39)}, cast({v} as double)' for v in values)}) as (feature, value)"))
    found = exact_quantiles(long, [*keys, "feature"], "value", QUARTILES)
    each = [F.max(F.when(F.col("feature") == v, F.col(n))).alias(f"{v}_{n}") for v in values for n in QUARTILES]
    return found.groupBy(*keys).agg(*each)


def box_stats(df: DataFrame, keys: Sequence[str], value: str, reach: float = 1.5) -> DataFrame:
    """Quartiles and the whiskers: the extreme values within ``reach`` interquartile ranges of the box."""
    q = exact_quantiles(df, keys, value, QUARTILES)
    spread = reach * (F.col("q75") - F.col("q25"))
    inside = F.col(value).between(F.col("q25") - spread, F.col("q75") + spread)
    ends = df.join(q, list(keys)).where(inside).groupBy(*keys).agg(F.min(value).alias("whisker_low"), F.max(value).alias("whisker_high"))
    return q.join(ends, list(keys))


def _moments(df: DataFrame, group: str, value: str) -> DataFrame:
    two = F.col(group)
    rows = df.where(two.isin(0, 1) & F.col(value).isNotNull())
    return rows.agg(*[a for g in (0, 1) for a in (
        F.count(F.when(two == g, F.col(value))).alias(f"n{g}"), F.avg(F.when(two == g, F.col(value))).alias(f"m{g}"), F.var_samp(F.when(two == g, F.col(value))).alias(f"v{g}"))])


def t_test(df: DataFrame, group: str, value: str) -> DataFrame:
    """Student's t for group 1 against 0 with equal variances: n0, n1, m0, m1, t, degrees of freedom and two-sided p."""
    n0, n1 = F.col("n0"), F.col("n1")
    pooled = ((n0 - 1) * F.col("v0") + (n1 - 1) * F.col("v1")) / F.nullif(n0 + n1 - 2, F.lit(0))
    error = F.sqrt(pooled * (1 / F.nullif(n0, F.lit(0)) + 1 / F.nullif(n1, F.lit(0))))
    out = _moments(df, group, value).withColumn("t", (F.col("m1") - F.col("m0")) / F.nullif(error, F.lit(0.0))).withColumn("df", n0 + n1 - 2)
    p = F.pandas_udf(lambda t, d: t.combine(d, two_sided_p), "double")
    return out.select("n0", "n1", "m0", "m1", "t", "df", p("t", "df").alias("p_value"))


def two_sided_p(t: float, df: float) -> float:
    """Tail probability of Student's distribution by the continued fraction of the incomplete beta function."""
    if t is None or df is None or math.isnan(t) or math.isnan(df) or df <= 0:
        return float("nan")
    x = df / (df + t * t)
    a, b = df / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0

    def fraction(a: float, b: float, x: float) -> float:
        c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
        d = 1 / (d or 1e-300)
        h = d
        for m in range(1, 300):
            for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / ((1 + top * d) or 1e-300)
                c = (1 + top / c) or 1e-300
                h *= d * c
            if abs(d * c - 1) < 1e-14:
                break
        return h

    if x >= 1:
        return 1.0
    if x < (a + 1) / (a + b + 2):
        return front * fraction(a, b, x) / a
    return 1 - front * fraction(b, a, 1 - x) / b


def cohens_d(df: DataFrame, group: str, value: str) -> DataFrame:
    """Difference of means of group 1 and 0 over the pooled standard deviation."""
    n0, n1 = F.col("n0"), F.col("n1")
    pooled = F.nullif(F.sqrt(((n0 - 1) * F.col("v0") + (n1 - 1) * F.col("v1")) / F.nullif(n0 + n1 - 2, F.lit(0))), F.lit(0.0))
    return _moments(df, group, value).select("n0", "n1", ((F.col("m1") - F.col("m0")) / pooled).alias("cohens_d"))


def correlation(a: Column, b: Column) -> Column:
    """Pearson's correlation over rows with both values; null where one of them is constant."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def pearson(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Correlation of every pair of columns over the rows that have both, in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(*[correlation(F.col(a), F.col(b)).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(F.expr(f"stack({len(pairs)}, {', '.join(f'{chr(39)}{a}{chr(39)}, {chr(39)}{b}{chr(39)}, c{i}' for i, (a, b) in enumerate(pairs))}) as (a, b, correlation)"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Correlation of average ranks over the rows that have both values."""
    both = df.select(F.col(a).alias("a"), F.col(b).alias("b")).dropna()
    ranked = both.join(average_ranks(both, [], "a", "ra"), "a").join(average_ranks(both, [], "b", "rb"), "b")
    return ranked.agg(correlation(F.col("ra"), F.col("rb")).alias("correlation")).select(F.lit(a).alias("a"), F.lit(b).alias("b"), "correlation")


# -- bootstrap ---------------------------------------------------------------------------------------------------

REPLICATES = 2000
#: Clusters that may be drawn; the table of draws has replicates times clusters rows.
MAX_CLUSTERS = 100_000
SEED = 20260925
#: Support below which an interval is not reported, or reported with a warning.
LEAST_GROUP, SPARSE_ROWS, SPARSE_ENTITIES, IMBALANCE, LEAST_VALID = 2, 20, 10, 0.10, 0.80


def hashed_weights(entities: DataFrame, entity: str, replicates: int, seed: str = "b") -> DataFrame:
    """replicate, entity, weight: how often each entity is drawn when as many are drawn as there are.

    Draw k of replicate r takes the entity at a place given by a hash, so any engine gets the same draws. The
    table is small: replicates times entities.
    """
    found = entities.select(entity).where(F.col(entity).isNotNull()).distinct().limit(MAX_CLUSTERS + 1).collect()
    if len(found) > MAX_CLUSTERS:
        raise ValueError(f"over {MAX_CLUSTERS} clusters; draw coarser ones")
    listed = sorted(r[0] for r in found)
    spark, n = entities.sparkSession, len(listed)
    place = spark.createDataFrame(list(enumerate(listed)), f"__place int, {entity} string")
    draws = spark.range(replicates).withColumnRenamed("id", "replicate").withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(max(0, n - 1)))))
    hashed = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "replicate", "__k")), 1, 8), 16, 10).cast("long")
    drawn = draws.withColumn("__place", (hashed % n).cast("int")).groupBy("replicate", "__place").agg(F.count(F.lit(1)).alias("weight"))
    return drawn.join(F.broadcast(place), "__place").select("replicate", entity, "weight")


def multinomial_weights(spark, entities: Sequence[str], entity: str, replicates: int = REPLICATES, seed: int = SEED) -> DataFrame:
    """The same from a seeded multinomial generator on the driver."""
    listed = sorted(entities)
    drawn = np.random.default_rng(seed).multinomial(len(listed), np.repeat(1 / len(listed), len(listed)), size=replicates)
    rows = [(int(r), listed[c], int(drawn[r, c])) for r, c in zip(*np.nonzero(drawn))]
    return spark.createDataFrame(rows, f"replicate long, {entity} string, weight long")


def cluster_bootstrap(df: DataFrame, weights: DataFrame, *, entity: str, group: str, contrasts: Sequence[tuple[str, str]], features: Sequence[str], replicates: int, keys: Sequence[str] = ()) -> DataFrame:
    """Difference of means of two groups per feature, with a cluster-bootstrap interval and its status.

    ``contrasts`` are pairs of reference and contrast; ``keys`` (samples) are treated apart. Rows are reduced to sums and
    counts per entity, group and feature first; the draws meet only those, once for all contrasts, features and keys,
    which therefore share them. The ladder of statuses: too few rows or entities, too few valid replicates, sparse,
    imbalanced, ok; the interval is given from 'sparse' on.
    """
    long = df.select(*keys, entity, F.col(group).alias("__g"), F.expr(f"stack({len(features)}, {', '.join(f'{chr(39)}{f}{chr(39)}, cast({f} as double)' for f in features)}) as (feature, value)"))
    sums = long.where("value is not null and not isnan(value)").groupBy(*keys, "feature", entity, "__g").agg(F.sum("value").alias("s"), F.count(F.lit(1)).alias("n"))
    sides = F.array(*[F.struct(F.lit(r).alias("reference"), F.lit(c).alias("contrast"), F.lit(g).alias("own"), F.lit(i).alias("side")) for r, c in contrasts for i, g in enumerate((r, c))])
    cells = sums.withColumn("__c", F.explode(F.filter(sides, lambda x: x["own"] == F.col("__g")))).select(*keys, "__c.reference", "__c.contrast", "feature", entity, "__c.side", "s", "n")
    by = [*keys, "reference", "contrast", "feature"]
    one = lambda side, c: F.sum(F.when(F.col("side") == side, c))
    drawn = cells.join(weights, entity).groupBy(*by, "replicate").agg(*[one(g, F.col("weight") * F.col(x)).alias(f"{x}{g}") for g in (0, 1) for x in ("s", "n")])
    differences = drawn.where("n0 > 0 and n1 > 0").select(*by, (F.col("s1") / F.col("n1") - F.col("s0") / F.col("n0")).alias("d"))
    interval = differences.groupBy(*by).agg(F.percentile("d", F.array(F.lit(0.025), F.lit(0.975))).alias("q"), F.count(F.lit(1)).alias("valid"))
    observed = cells.groupBy(*by).agg(
        *[one(g, F.col("n")).alias(f"rows{g}") for g in (0, 1)], *[F.count(F.when(F.col("side") == g, 1)).alias(f"entities{g}") for g in (0, 1)], *[(one(g, F.col("s")) / one(g, F.col("n"))).alias(f"mean{g}") for g in (0, 1)]
    ).fillna(0, ["rows0", "rows1"])
    least_rows, most_rows, least_entities = F.least("rows0", "rows1"), F.greatest("rows0", "rows1"), F.least("entities0", "entities1")
    valid = F.coalesce("valid", F.lit(0))
    enough = (least_rows >= LEAST_GROUP) & (least_entities >= LEAST_GROUP)
    drawn_enough = valid >= max(20, math.ceil(LEAST_VALID * replicates))
    status = (
        F.when(~enough, "insufficient_group_support")
        .when(~drawn_enough, "insufficient_valid_bootstrap_replicates")
        .when((least_entities < SPARSE_ENTITIES) | (least_rows < SPARSE_ROWS), "sparse_group_warning")
        .when(least_rows / most_rows < IMBALANCE, "severe_row_imbalance_warning")
        .otherwise("ok")
    )
    out = observed.join(interval, by, "left")
    shown = lambda i: F.when(enough & drawn_enough, F.col("q")[i])
    return out.select(
        *keys, F.col("reference").alias("reference_transition"), F.col("contrast").alias("contrast_transition"), "feature", F.col("rows0").alias("n_rows_reference"), F.col("rows1").alias("n_rows_contrast"),
        F.col("entities0").alias("n_countries_reference"), F.col("entities1").alias("n_countries_contrast"), F.col("mean0").alias("mean_reference"), F.col("mean1").alias("mean_contrast"),
        (F.col("mean1") - F.col("mean0")).alias("mean_difference"), shown(0).alias("ci_low"), shown(1).alias("ci_high"), valid.cast("long").alias("replicates_valid"), status.alias("status"),
    )


def resampled_bootstrap(df: DataFrame, *, entity: str, group: str, contrasts: Sequence[tuple[str, str]], features: Sequence[str], replicates: int, seed: str = "b") -> DataFrame:
    """The variant that draws from the entities of the rows it compares, as if their rows were put together anew for each
    replicate: a row counts as often as its entity is drawn."""
    rows = df.where(F.col(group).isin(*{g for pair in contrasts for g in pair}))
    return cluster_bootstrap(rows, hashed_weights(rows, entity, replicates, seed), entity=entity, group=group, contrasts=contrasts, features=features, replicates=replicates)


def rate(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole)

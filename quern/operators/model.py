"""Prediction of the next year: features scaled on the training years alone, a ladder of logits, tie-aware metrics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.ordered import ordered_counts


@dataclass(frozen=True)
class Fold:
    """Train on years up to ``train_end``, test on the years after it up to ``test_end``."""

    name: str
    train_end: int
    test_end: int


def expanding_folds(ends: Sequence[int], years: int) -> list[Fold]:
    return [Fold(f"{e + 1}-{e + years}", e, e + years) for e in ends]


def scaling(train: DataFrame, features: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of the training rows; a constant feature is divided by 1."""
    row = train.agg(*[a for f in features for a in (F.avg(f).alias(f"m_{f}"), F.stddev_pop(f).alias(f"s_{f}"))]).head()
    return {f: (row[f"m_{f}"] or 0.0, row[f"s_{f}"] or 1.0) for f in features}


def scaled(df: DataFrame, scale: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({f: (F.col(f) - m) / s for f, (m, s) in scale.items()})


#: Most levels of a category.
MAX_LEVELS = 10_000


def levels_of(train: DataFrame, column: str) -> list[str]:
    """The levels of a category in the training rows, sorted; null is none. A column with more than MAX_LEVELS is no category."""
    found = train.select(column).where(F.col(column).isNotNull()).distinct().limit(MAX_LEVELS + 1).collect()
    if len(found) > MAX_LEVELS:
        raise ValueError(f"{column} has over {MAX_LEVELS} levels")
    return sorted(r[0] for r in found)


def one_hot(df: DataFrame, column: str, levels: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """One 0/1 column per level of the training rows; unknown and missing levels are 0 everywhere."""
    names = [f"{column}_{i}" for i, _ in enumerate(levels)]
    return df.withColumns({n: F.coalesce((F.col(column) == v).cast("double"), F.lit(0.0)) for n, v in zip(names, levels)}), names


@dataclass
class Logit:
    """A fitted model: coefficients per standard deviation, and what prediction needs."""

    features: list[str]
    category: str | None
    levels: list[str]
    scale: dict[str, tuple[float, float]]
    model: object

    def coefficients(self) -> dict[str, float]:
        names = [*self.features, *[f"{self.category}={v}" for v in self.levels]]
        return {**dict(zip(names, map(float, self.model.coefficients))), "intercept": float(self.model.intercept)}


def _assembled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(columns), outputCol="__x").transform(df)


def fit_logit(train: DataFrame, features: Sequence[str], target: str, category: str | None = None, c: float = 1.0) -> Logit:
    """Logistic regression with an L2 penalty of 1 / C on all but the intercept; the category enters one-hot, all levels."""
    from pyspark.ml.classification import LogisticRegression

    scale = scaling(train, features)
    levels = levels_of(train, category) if category else []
    rows = scaled(train, scale)
    rows, hot = one_hot(rows, category, levels) if category else (rows, [])
    n = train.count()
    made = LogisticRegression(featuresCol="__x", labelCol=target, regParam=1 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=1000, tol=1e-10)
    return Logit(list(features), category, levels, scale, made.fit(_assembled(rows, [*features, *hot]).select("__x", target)))


def predict(logit: Logit, df: DataFrame, name: str = "score") -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    kept = df.columns
    rows = scaled(df.withColumns({f"__raw_{f}": F.col(f) for f in logit.features}), logit.scale)
    rows, hot = one_hot(rows, logit.category, logit.levels) if logit.category else (rows, [])
    out = logit.model.transform(_assembled(rows, [*logit.features, *hot]))
    own = [F.col(f"__raw_{c}").alias(c) if c in logit.features else F.col(c) for c in kept]
    return out.select(*own, vector_to_array("probability")[1].alias(name))


def expanding_predictions(df: DataFrame, folds: Sequence[Fold], ladder: dict[str, Sequence[str]], *, year: str, target: str, category: str | None = None) -> tuple[DataFrame, dict]:
    """Predictions of every model of the ladder for the test years of every fold, and the fitted models.

    An empty list of features stands for persistence: the present state is the score.
    """
    out, models = None, {}
    for fold in folds:
        train, test = df.where(F.col(year) <= fold.train_end), df.where((F.col(year) > fold.train_end) & (F.col(year) <= fold.test_end))
        for name, features in ladder.items():
            if features:
                models[fold.name, name] = fit_logit(train, features, target, category)
                made = predict(models[fold.name, name], test)
            else:
                made = test.withColumn("score", F.col("conflict_active_t").cast("double"))
            rows = made.select(F.lit(fold.name).alias("period"), F.lit(name).alias("model"), "entity_id", year, "conflict_active_t", F.col(target).cast("int").alias("target"), "score")
            out = rows if out is None else out.unionByName(rows)
    return out, models


def metrics(predictions: DataFrame, keys: Sequence[str], score: str = "score", target: str = "target", entity: str | None = None) -> DataFrame:
    """n_rows, positives, average precision, ROC AUC and Brier score per group, and n_entities if ``entity`` is named.

    Ties are one threshold: precision and recall are taken after all rows of a score. Groups without positives
    have no average precision; groups of one class have no AUC. Null scores are left out.
    """
    rows = predictions.where(F.col(target).isNotNull())
    t = F.col(target)
    c = ordered_counts(rows, keys, score, {"positives": t, "squares": (F.col(score) - t) * (F.col(score) - t)})
    at_or_above = F.col("total") - F.col("before")
    hits = F.col("total_positives") - F.col("before_positives")
    negatives_below = F.col("before") - F.col("before_positives")
    precision = F.sum(F.col("positives") * hits / at_or_above) / F.max("total_positives")
    n, p = F.max("total"), F.max("total_positives")
    wins = F.sum(F.col("positives") * (negatives_below + (F.col("count") - F.col("positives")) / 2))
    out = c.groupBy(*keys).agg(
        n.alias("n_rows"), p.cast("long").alias("positives"), F.when(p > 0, precision).alias("average_precision"), F.when((p > 0) & (p < n), wins / (p * (n - p))).alias("roc_auc"), (F.max("total_squares") / n).alias("brier")
    )
    if entity is None:
        return out
    return out.join(rows.where(F.col(score).isNotNull()).groupBy(*keys).agg(F.countDistinct(entity).alias("n_entities")), list(keys))


def paired_bootstrap(predictions: DataFrame, weights: DataFrame, models: tuple[str, str], entity: str = "entity_id", keys: Sequence[str] = ()) -> DataFrame:
    """Interval of the gain in average precision and Brier score of one model over another, entities drawn anew.

    ``keys`` (strata) are treated apart and share the draws. Replicates without a positive are skipped. Rows are reduced
    to counts and sums per entity, model and score before the draws multiply them.
    """
    error = F.col("score") - F.col("target")
    sums = predictions.where(F.col("model").isin(*models)).groupBy(*keys, entity, "model", "score").agg(F.count(F.lit(1)).alias("n"), F.sum("target").alias("p"), F.sum(error * error).alias("s"))
    drawn = sums.join(weights, entity).groupBy(*keys, "replicate", "model", "score")
    flat = drawn.agg(*[F.sum(F.col("weight") * F.col(c)).alias(c) for c in ("n", "p", "s")])
    down = Window.partitionBy(*keys, "replicate", "model").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    run = flat.select("*", F.sum("n").over(down).alias("cn"), F.sum("p").over(down).alias("cp"))
    each = run.groupBy(*keys, "replicate", "model").agg((F.sum(F.col("p") * F.col("cp") / F.col("cn")) / F.nullif(F.sum("p"), F.lit(0))).alias("ap"), (F.sum("s") / F.sum("n")).alias("brier"))
    gain = each.groupBy(*keys, "replicate").agg(*[(F.max(F.when(F.col("model") == models[1], F.col(m))) - F.max(F.when(F.col("model") == models[0], F.col(m)))).alias(m) for m in ("ap", "brier")])
    long = gain.where("ap is not null").select(*keys, "replicate", F.expr("stack(2, 'average_precision', ap, 'brier', brier) as (metric, gain)"))
    out = long.groupBy(*keys, "metric").agg(F.count(F.lit(1)).alias("replicates_valid"), F.avg("gain").alias("mean_gain"), F.percentile("gain", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    return out.select(*keys, "metric", "replicates_valid", "mean_gain", F.col("q")[0].alias("ci_low"), F.col("q")[1].alias("ci_high"))

"""Queries on distributions, tests, the bootstrap and prediction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import model, ordered, relational, stats, windows
from quern.plans import base
from quern.plans.panel import _OBSERVED, _WITH_SAMPLES, _observed, _samples
from quern.session import cut, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
#: As many as the published intervals take.
REPLICATES = stats.REPLICATES
CONTRASTS = (("continued_peace", "onset"), ("continued_conflict", "cessation"))


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, as the order of sums differs between engines."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


_LONG = "long AS (" + " UNION ALL ".join(f"SELECT sample, transition, entity_id, '{f}' AS feature, {f} AS value FROM sampled WHERE {f} IS NOT NULL" for f in base.FEATURES) + ")"


@query(_WITH_SAMPLES + f""", {_LONG} SELECT sample, transition, feature, count(*) AS n_rows, count(DISTINCT entity_id) AS n_countries, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS median,
round(quantile_cont(value, 0.75), 6) AS q75, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr FROM long GROUP BY 1, 2, 3""")
def feature_summaries(spark: SparkSession, folder: str) -> DataFrame:
    """Mean, quartiles and counts of each feature by sample and transition."""
    return _rounded(stats.feature_summaries(_observed(spark, folder), ["transition"], base.FEATURES, "entity_id", _samples()))


@query(f"""WITH {base.PASSAGES} SELECT year, count(*) AS n_rows, count(DISTINCT entity_id) AS n_countries, round(avg(trust), 6) AS trust_mean, round(quantile_cont(trust, 0.5), 6) AS trust_median, round(quantile_cont(trust, 0.25), 6) AS trust_q25,
round(quantile_cont(trust, 0.75), 6) AS trust_q75, round(avg(threat), 6) AS threat_mean, round(quantile_cont(threat, 0.5), 6) AS threat_median, round(quantile_cont(threat, 0.25), 6) AS threat_q25, round(quantile_cont(threat, 0.75), 6) AS threat_q75 FROM pass GROUP BY 1""")
def annual_trends(spark: SparkSession, folder: str) -> DataFrame:
    """Means and quartiles of both scores by year; the quartiles of both come from one count of values."""
    rows = base.passages(spark, folder)
    out = rows.groupBy("year").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("entity_id").alias("n_countries"), F.avg("trust").alias("trust_mean"), F.avg("threat").alias("threat_mean"))
    return _rounded(out.join(stats.wide_quantiles(rows, ["year"], ["trust", "threat"]), "year", "left"))


@query(f"WITH {base.PASSAGES}, y AS (SELECT year, avg(trust) AS trust_mean FROM pass GROUP BY 1) SELECT year, round(trust_mean, 6) AS trust_mean, round(avg(trust_mean) OVER (ORDER BY year ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS trust_rolling3 FROM y")
def rolling3_centered(spark: SparkSession, folder: str) -> DataFrame:
    """Rolling mean of the yearly table, which has a row per year whatever the size of the data."""
    years = base.passages(spark, folder).groupBy("year").agg(F.avg("trust").alias("trust_mean"))
    return _rounded(years.withColumn("trust_rolling3", windows.rolling_mean(years, "trust_mean", "year")))


@query(f"""WITH {base.PASSAGES}, r AS (SELECT row_id, trust, (rank() OVER (ORDER BY trust) + (count(*) OVER (PARTITION BY trust) - 1) / 2.0) / CAST(count(*) OVER () AS DOUBLE) AS share FROM pass WHERE trust IS NOT NULL)
SELECT row_id, trust, round(share, 9) AS share FROM r WHERE share BETWEEN 0.45 AND 0.55""")
def pct_rank_band(spark: SparkSession, folder: str) -> DataFrame:
    """Rows in the middle tenth by rank, ties averaged."""
    rows = base.passages(spark, folder).select("row_id", "trust").where("trust is not null")
    band = cut(ordered.average_ranks(rows, [], "trust").where("rank_share between 0.45 and 0.55"))
    ends = band.agg(F.min("trust"), F.max("trust")).head()
    inside = rows.where(F.col("trust").between(*[F.lit(x) for x in ends]))  # a range, so that the rows outside are never joined
    return inside.join(band, "trust").select("row_id", "trust", F.round("rank_share", 9).alias("share"))


@query(f"WITH {base.PASSAGES} SELECT DISTINCT conflict_active_t, milex, round(cume_dist() OVER (PARTITION BY conflict_active_t ORDER BY milex), 9) AS share FROM pass WHERE milex IS NOT NULL AND conflict_active_t IS NOT NULL")
def ecdf(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(ordered.ecdf(base.passages(spark, folder), ["conflict_active_t"], "milex"), 9)


@query(f"""WITH {base.PASSAGES}, q AS (SELECT transition, count(threat) AS n, quantile_cont(threat, 0.25) AS q25, quantile_cont(threat, 0.5) AS median, quantile_cont(threat, 0.75) AS q75 FROM pass WHERE transition IS NOT NULL AND threat IS NOT NULL GROUP BY 1)
SELECT q.transition, q.n, round(q25, 6) AS q25, round(median, 6) AS median, round(q75, 6) AS q75, round(min(p.threat), 6) AS whisker_low, round(max(p.threat), 6) AS whisker_high FROM q JOIN pass p ON p.transition = q.transition AND p.threat BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25) GROUP BY ALL""")
def box_stats(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(stats.box_stats(base.passages(spark, folder).where("transition is not null"), ["transition"], "threat"))


@query(f"""WITH {base.PASSAGES}, m AS (SELECT count(*) FILTER (g = 0) AS n0, count(*) FILTER (g = 1) AS n1, avg(trust) FILTER (g = 0) AS m0, avg(trust) FILTER (g = 1) AS m1, var_samp(trust) FILTER (g = 0) AS v0, var_samp(trust) FILTER (g = 1) AS v1
FROM (SELECT trust, conflict_active_t1 AS g FROM pass WHERE trust IS NOT NULL AND conflict_active_t1 IN (0, 1))),
t AS (SELECT n0, n1, m0, m1, (m1 - m0) / sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2) * (1.0 / n0 + 1.0 / n1)) AS t, n0 + n1 - 2 AS df FROM m),
area AS (SELECT sum((CASE WHEN i IN (0, 20000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(lgamma((df + 1) / 2.0) - lgamma(df / 2.0) - 0.5 * ln(pi() * df) - (df + 1) / 2.0 * ln(1 + pow(abs(t) * i / 20000.0, 2) / df))) * max(abs(t)) / 20000.0 / 3 AS a FROM t, range(20001) r(i))
SELECT n0, n1, round(m0, 6) AS m0, round(m1, 6) AS m1, round(t, 6) AS t, df, round(greatest(0.0, 1 - 2 * a), 6) AS p_value FROM t, area""")
def ttest_moments(spark: SparkSession, folder: str) -> DataFrame:
    """Student's t of trust by the next year's state with its p-value; SQL integrates the density."""
    return _rounded(stats.t_test(base.passages(spark, folder), "conflict_active_t1", "trust"))


@query(f"""WITH {base.PASSAGES}, m AS (SELECT count(*) FILTER (g = 0) AS n0, count(*) FILTER (g = 1) AS n1, avg(trust) FILTER (g = 0) AS m0, avg(trust) FILTER (g = 1) AS m1, var_samp(trust) FILTER (g = 0) AS v0, var_samp(trust) FILTER (g = 1) AS v1
FROM (SELECT trust, conflict_active_t1 AS g FROM pass WHERE trust IS NOT NULL AND conflict_active_t1 IN (0, 1)))
SELECT n0, n1, round((m1 - m0) / sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2)), 6) AS cohens_d FROM m""")
def cohens_d(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(stats.cohens_d(base.passages(spark, folder), "conflict_active_t1", "trust"))


@query(f"WITH {base.PASSAGES} SELECT conflict_active_t1, count(trust) AS n, round(avg(trust), 6) AS mean, round(stddev_samp(trust), 6) AS std FROM pass WHERE conflict_active_t1 IS NOT NULL GROUP BY 1")
def outcome_moments(spark: SparkSession, folder: str) -> DataFrame:
    rows = base.passages(spark, folder).where("conflict_active_t1 is not null").groupBy("conflict_active_t1")
    return _rounded(rows.agg(F.count("trust").alias("n"), F.avg("trust").alias("mean"), F.stddev_samp("trust").alias("std")))


@query(f"WITH {base.PASSAGES} SELECT 'trust' AS a, 'threat' AS b, round(corr(trust, threat), 6) AS correlation FROM pass UNION ALL SELECT 'trust', 'milex', round(corr(trust, milex), 6) FROM pass UNION ALL SELECT 'threat', 'milex', round(corr(threat, milex), 6) FROM pass")
def pearson_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(stats.pearson(base.passages(spark, folder), base.FEATURES))


_PAIRS = (("trust", "threat"), ("trust", "milex"), ("threat", "milex"))
_SPEARMAN = " UNION ALL ".join(
    f"""SELECT '{a}' AS a, '{b}' AS b, round(corr(ra, rb), 6) AS correlation FROM (SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0 AS ra,
rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0 AS rb FROM pass WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"""
    for a, b in _PAIRS
)


@query(f"WITH {base.PASSAGES} {_SPEARMAN}")
def spearman_matrix(spark: SparkSession, folder: str) -> DataFrame:
    rows = base.passages(spark, folder)
    parts = [stats.spearman(rows, a, b) for a, b in _PAIRS]
    return _rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]))


def _boot(population: str, pairs: tuple, universe: str) -> str:
    """SQL of the cluster bootstrap over the rows of ``population`` (with sample), drawing from the entities of ``universe``."""
    sides = ", ".join(f"('{r}', '{c}', '{g}', {i})" for r, c in pairs for i, g in enumerate((r, c)))
    return f"""sides AS (SELECT * FROM (VALUES {sides}) v(reference, contrast, own, side)),
sub AS (SELECT sample, entity_id, transition, feature, value FROM (SELECT sample, entity_id, transition, unnest(['trust', 'threat', 'milex']) AS feature, unnest([trust, threat, milex]) AS value FROM {population}) WHERE value IS NOT NULL),
cells AS (SELECT sample, reference, contrast, feature, entity_id, side, sum(value) AS s, count(*) AS n FROM sub JOIN sides ON own = transition GROUP BY ALL),
ent AS (SELECT entity_id, row_number() OVER (ORDER BY entity_id) - 1 AS place, count(*) OVER () AS total FROM (SELECT DISTINCT entity_id FROM {universe} WHERE entity_id IS NOT NULL)),
places AS (SELECT r.replicate, CAST('0x' || substr(md5('b:' || r.replicate || ':' || k.draw), 1, 8) AS BIGINT) % (SELECT count(*) FROM ent) AS place FROM range({REPLICATES}) r(replicate), range((SELECT count(*) FROM ent)) k(draw)),
draws AS (SELECT replicate, entity_id, count(*) AS weight FROM places JOIN ent USING (place) GROUP BY 1, 2),
rep AS (SELECT sample, reference, contrast, feature, replicate, sum(weight * s) FILTER (side = 0) AS s0, sum(weight * n) FILTER (side = 0) AS n0, sum(weight * s) FILTER (side = 1) AS s1, sum(weight * n) FILTER (side = 1) AS n1 FROM cells JOIN draws USING (entity_id) GROUP BY ALL),
ci AS (SELECT sample, reference, contrast, feature, count(*) AS valid, quantile_cont(s1 / n1 - s0 / n0, 0.025) AS lo, quantile_cont(s1 / n1 - s0 / n0, 0.975) AS hi FROM rep WHERE n0 > 0 AND n1 > 0 GROUP BY ALL),
o AS (SELECT sample, reference, contrast, feature, CAST(coalesce(sum(n) FILTER (side = 0), 0) AS BIGINT) AS r0, CAST(coalesce(sum(n) FILTER (side = 1), 0) AS BIGINT) AS r1, count(*) FILTER (side = 0) AS e0, count(*) FILTER (side = 1) AS e1,
sum(s) FILTER (side = 0) / sum(n) FILTER (side = 0) AS m0, sum(s) FILTER (side = 1) / sum(n) FILTER (side = 1) AS m1 FROM cells GROUP BY ALL),
j AS (SELECT o.*, coalesce(ci.valid, 0) AS valid, lo, hi, least(r0, r1) >= 2 AND least(e0, e1) >= 2 AS enough FROM o LEFT JOIN ci USING (sample, reference, contrast, feature)),
k AS (SELECT *, valid >= greatest(20, ceil(0.8 * {REPLICATES})) AS drawn FROM j)
SELECT sample, reference AS reference_transition, contrast AS contrast_transition, feature, r0 AS n_rows_reference, r1 AS n_rows_contrast, e0 AS n_countries_reference, e1 AS n_countries_contrast, round(m0, 6) AS mean_reference, round(m1, 6) AS mean_contrast,
round(m1 - m0, 6) AS mean_difference, CASE WHEN enough AND drawn THEN round(lo, 6) END AS ci_low, CASE WHEN enough AND drawn THEN round(hi, 6) END AS ci_high, valid AS replicates_valid,
CASE WHEN NOT enough THEN 'insufficient_group_support' WHEN NOT drawn THEN 'insufficient_valid_bootstrap_replicates' WHEN least(e0, e1) < 10 OR least(r0, r1) < 20 THEN 'sparse_group_warning'
WHEN least(r0, r1) / CAST(greatest(r0, r1) AS DOUBLE) < 0.1 THEN 'severe_row_imbalance_warning' ELSE 'ok' END AS status FROM k"""


@query(_WITH_SAMPLES + ", " + _boot("sampled", CONTRASTS, "obs"))
def cluster_bootstrap(spark: SparkSession, folder: str) -> DataFrame:
    """Onset against continued peace and cessation against continued conflict, in both samples; entities of the whole
    population are drawn anew, with the same draws for all."""
    rows = _observed(spark, folder)
    weights = cut(stats.hashed_weights(rows, "entity_id", REPLICATES))
    sampled = relational.in_samples(rows, _samples())
    return _rounded(stats.cluster_bootstrap(sampled, weights, entity="entity_id", group="transition", contrasts=CONTRASTS, features=base.FEATURES, replicates=REPLICATES, keys=["sample"]))


@query(f"WITH {base.PASSAGES}, {_OBSERVED}, few AS (SELECT *, 'compared' AS sample FROM obs WHERE transition IN ('continued_peace', 'onset')), " + _boot("few", CONTRASTS[:1], "few"))
def resampled_bootstrap(spark: SparkSession, folder: str) -> DataFrame:
    """The variant that draws from the entities of the compared rows alone."""
    out = stats.resampled_bootstrap(_observed(spark, folder), entity="entity_id", group="transition", contrasts=CONTRASTS[:1], features=base.FEATURES, replicates=REPLICATES)
    return _rounded(out.select(F.lit("compared").alias("sample"), "*"))


# -- prediction --------------------------------------------------------------------------------------------------

#: A score that any engine computes alike.
_SCORE = "round(0.6 * conflict_active_t + 0.3 * coalesce(threat, 0) + 0.1 * (1 - coalesce(trust, 0)), 3)"
_EY = f"WITH {base.ENTITY_YEARS}, scored AS (SELECT entity_id, year, conflict_active_t, target, {_SCORE} AS score, CASE WHEN year <= 2010 THEN 'early' ELSE 'late' END AS period FROM ey)"


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    return base.entity_years(spark, folder).selectExpr("entity_id", "year", "conflict_active_t", "target", f"{_SCORE} as score", "case when year <= 2010 then 'early' else 'late' end as period")


_AP = """, c AS (SELECT period, score, count(*) AS n, sum(target) AS p FROM scored GROUP BY 1, 2),
r AS (SELECT period, n, p, sum(n) OVER w AS cn, sum(p) OVER w AS cp, sum(p) OVER (PARTITION BY period) AS tp FROM c WINDOW w AS (PARTITION BY period ORDER BY score DESC)) """


@query(_EY + _AP + "SELECT period, round(sum(p * cp / CAST(cn AS DOUBLE)) / max(tp), 6) AS average_precision FROM r GROUP BY 1")
def average_precision(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(model.metrics(_scored(spark, folder), ["period"]).select("period", "average_precision"))


@query(_EY + """, k AS (SELECT period, target, rank() OVER (PARTITION BY period ORDER BY score) + (count(*) OVER (PARTITION BY period, score) - 1) / 2.0 AS rk FROM scored)
SELECT period, round((sum(rk) FILTER (target = 1) - count(*) FILTER (target = 1) * (count(*) FILTER (target = 1) + 1) / 2.0) / (count(*) FILTER (target = 1) * count(*) FILTER (target = 0)), 6) AS roc_auc FROM k GROUP BY 1""")
def roc_auc(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(model.metrics(_scored(spark, folder), ["period"]).select("period", "roc_auc"))


@query(_EY + "SELECT period, count(*) AS n_rows, CAST(sum(target) AS BIGINT) AS positives, round(avg((score - target) * (score - target)), 6) AS brier FROM scored GROUP BY 1")
def brier(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(model.metrics(_scored(spark, folder), ["period"]).select("period", "n_rows", "positives", "brier"))


@query(_EY.replace(_SCORE, "conflict_active_t") + _AP + "SELECT period, round(sum(p * cp / CAST(cn AS DOUBLE)) / max(tp), 6) AS average_precision FROM r GROUP BY 1")
def persistence_baseline(spark: SparkSession, folder: str) -> DataFrame:
    rows = _scored(spark, folder).withColumn("score", F.col("conflict_active_t").cast("double"))
    return _rounded(model.metrics(rows, ["period"]).select("period", "average_precision"))


@query(_EY.replace("FROM ey)", "FROM ey WHERE conflict_active_t = 0)") + _AP + "SELECT period, CAST(max(tp) AS BIGINT) AS onsets, CAST(sum(n) AS BIGINT) AS n_rows, round(sum(p * cp / CAST(cn AS DOUBLE)) / max(tp), 6) AS average_precision FROM r GROUP BY 1")
def peaceful_stratum(spark: SparkSession, folder: str) -> DataFrame:
    """The same metric on rows at peace now."""
    out = model.metrics(_scored(spark, folder).where("conflict_active_t = 0"), ["period"])
    return _rounded(out.select("period", F.col("positives").alias("onsets"), "n_rows", "average_precision"))


@query(f"WITH {base.ENTITY_YEARS}, s AS (SELECT avg(trust) AS m, stddev_pop(trust) AS d FROM ey WHERE year <= 2010) SELECT entity_id, year, round((trust - m) / d, 6) AS trust_scaled FROM ey, s WHERE trust IS NOT NULL")
def standardise_train_only(spark: SparkSession, folder: str) -> DataFrame:
    rows = base.entity_years(spark, folder)
    scale = model.scaling(rows.where("year <= 2010"), ["trust"])
    return _rounded(model.scaled(rows.where("trust is not null"), scale).select("entity_id", "year", F.col("trust").alias("trust_scaled")))


#: Four rounds of validation and the last period.
FOLDS = [*model.expanding_folds([2004, 2008, 2012, 2016], 4), model.Fold("2021-2024", 2020, 2024)]
LADDER = {"persistence": [], "history": ["conflict_active_t", "any_war_t", "n_conflicts_t", "past5", "year"], "history_rhetoric": ["conflict_active_t", "any_war_t", "n_conflicts_t", "past5", "year", "trust", "threat"]}


def _modelling(spark: SparkSession, folder: str) -> DataFrame:
    """Complete rows with their history, in doubles."""
    rows = base.entity_years(spark, folder).where("trust is not null and threat is not null")
    active = rows.where("conflict_active_t = 1").select("entity_id", "year")
    rows = windows.look_back(rows, active, "entity_id", "year", 5, "past5").withColumn("target", F.col("target").cast("double"))
    return rows.withColumns({c: F.col(c).cast("double") for c in ("any_war_t", "n_conflicts_t", "past5")})


def _rounds(spark: SparkSession, folder: str):
    """Complete rows of both samples with their predictions by round and model, each sample with its ladder."""
    rows = cut(_modelling(spark, folder).withColumn("log_spending", F.log1p(100 * F.col("milex"))))
    more = [*LADDER["history"], "log_spending"]
    ladders = {"all": (rows, LADDER), "spending": (rows.where("log_spending is not null"), {"persistence": [], "history": LADDER["history"], "history_spending": more, "history_spending_rhetoric": [*more, "trust", "threat"]})}
    out = None
    for sample, (own, ladder) in ladders.items():
        made, _ = model.expanding_predictions(own, FOLDS, ladder, year="year", target="target", category="post")
        made = made.withColumn("sample", F.lit(sample))
        out = made if out is None else out.unionByName(made)
    return out


@query()
def logit_ladder(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics of every model of both ladders in all five rounds."""
    return _rounded(model.metrics(_rounds(spark, folder), ["sample", "period", "model"], entity="entity_id"))


_FOLD_ROWS = ", ".join(f"('{f.name}', {f.train_end}, {f.test_end})" for f in FOLDS)
#: One feature, so that SQL can follow Newton's steps: the mean of trust, scaled on the training years of each round.
_NEWTON = f"""WITH RECURSIVE {base.ENTITY_YEARS}, rows AS (SELECT 'all' AS sample, entity_id, year, conflict_active_t, CAST(target AS DOUBLE) AS y, trust FROM ey WHERE trust IS NOT NULL UNION ALL
SELECT 'spending', entity_id, year, conflict_active_t, CAST(target AS DOUBLE), trust FROM ey WHERE trust IS NOT NULL AND milex IS NOT NULL),
folds AS (SELECT * FROM (VALUES {_FOLD_ROWS}) v(period, train_end, test_end)),
scale AS (SELECT sample, period, avg(trust) AS m, stddev_pop(trust) AS d FROM rows JOIN folds ON year <= train_end GROUP BY 1, 2),
train AS (SELECT sample, period, (trust - m) / d AS x, y FROM rows JOIN folds ON year <= train_end JOIN scale USING (sample, period)),
fit(i, sample, period, a, b) AS (SELECT 0, sample, period, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM scale UNION ALL
SELECT i + 1, sample, period, a + (h22 * ga - h12 * gb) / (h11 * h22 - h12 * h12), b + (h11 * gb - h12 * ga) / (h11 * h22 - h12 * h12) FROM (
SELECT i, sample, period, a, b, sum(y - p) AS ga, sum((y - p) * x) - b AS gb, sum(p * (1 - p)) AS h11, sum(p * (1 - p) * x) AS h12, sum(p * (1 - p) * x * x) + 1 AS h22
FROM (SELECT f.*, t.x, t.y, 1 / (1 + exp(-(f.a + f.b * t.x))) AS p FROM fit f JOIN train t USING (sample, period)) GROUP BY i, sample, period, a, b) WHERE i < 12),
done AS (SELECT sample, period, a, b FROM fit WHERE i = 12),
scored AS (SELECT sample, period, 'trust' AS model, entity_id, conflict_active_t, CAST(y AS INT) AS target, round(1 / (1 + exp(-(a + b * (trust - m) / d))), 9) AS score FROM rows JOIN folds ON year > train_end AND year <= test_end JOIN scale USING (sample, period) JOIN done USING (sample, period)
UNION ALL SELECT sample, period, 'persistence', entity_id, conflict_active_t, CAST(y AS INT), CAST(conflict_active_t AS DOUBLE) FROM rows JOIN folds ON year > train_end AND year <= test_end)"""


def _one_feature(spark: SparkSession, folder: str) -> tuple[DataFrame, list[tuple]]:
    """Predictions of persistence and of one feature in all rounds and samples, and the fitted coefficients."""
    rows = cut(base.entity_years(spark, folder).where("trust is not null").withColumn("target", F.col("target").cast("double")))
    out, fitted = None, []
    for sample, own in (("all", rows), ("spending", rows.where("milex is not null"))):
        made, models = model.expanding_predictions(own, FOLDS, {"persistence": [], "trust": ["trust"]}, year="year", target="target")
        fitted += [(sample, period, f, v) for (period, _), m in models.items() for f, v in m.coefficients().items()]
        made = made.withColumn("sample", F.lit(sample)).withColumn("score", F.round("score", 9))
        out = made if out is None else out.unionByName(made)
    return out, fitted


@query(_NEWTON + """ SELECT sample, period, unnest(['trust', 'intercept']) AS feature, unnest([round(b, 5), round(a, 5)]) AS coefficient, unnest([round(exp(b), 4), round(exp(a), 4)]) AS odds_ratio FROM done""")
def logit_coefficients(spark: SparkSession, folder: str) -> DataFrame:
    """Coefficient and odds ratio per standard deviation in every round and sample, as Newton's method in SQL gives them."""
    made = spark.createDataFrame(_one_feature(spark, folder)[1], "sample string, period string, feature string, coefficient double")
    return made.select("sample", "period", "feature", F.round("coefficient", 5).alias("coefficient"), F.round(F.exp("coefficient"), 4).alias("odds_ratio"))


@query(_NEWTON + """, c AS (SELECT sample, period, model, score, count(*) AS n, sum(target) AS p, sum((score - target) * (score - target)) AS q FROM scored GROUP BY ALL),
r AS (SELECT *, sum(n) OVER w AS cn, sum(p) OVER w AS cp, sum(p) OVER (PARTITION BY sample, period, model) AS tp FROM c WINDOW w AS (PARTITION BY sample, period, model ORDER BY score DESC)),
m AS (SELECT sample, period, model, CAST(sum(n) AS BIGINT) AS n_rows, CAST(max(tp) AS BIGINT) AS positives, round(sum(p * cp / CAST(cn AS DOUBLE)) / max(tp), 5) AS average_precision, round(sum(q) / sum(n), 5) AS brier FROM r GROUP BY ALL)
SELECT m.*, e.n_entities FROM m JOIN (SELECT sample, period, model, count(DISTINCT entity_id) AS n_entities FROM scored GROUP BY ALL) e USING (sample, period, model)""")
def logit_rounds(spark: SparkSession, folder: str) -> DataFrame:
    """Rows, entities, positives and metrics of two models over identical rows, in five rounds and two samples."""
    out = model.metrics(_one_feature(spark, folder)[0], ["sample", "period", "model"], entity="entity_id")
    return _rounded(out.select("sample", "period", "model", "n_rows", "n_entities", "positives", "average_precision", "brier"), 5)


@query(_NEWTON + ", w AS (SELECT sample, period, entity_id, max(score) FILTER (model = 'trust') AS s FROM scored WHERE period = '2021-2024' GROUP BY ALL) SELECT sample, entity_id, round(s, 5) AS best_score FROM w")
def logit_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """The highest predicted probability of each entity in the last period."""
    rows = _one_feature(spark, folder)[0].where("period = '2021-2024' and model = 'trust'")
    return rows.groupBy("sample", "entity_id").agg(F.round(F.max("score"), 5).alias("best_score"))


@query(_NEWTON + " SELECT feature, max(v) FILTER (sample = 'all') AS \"all\", max(v) FILTER (sample = 'spending') AS spending FROM (SELECT sample, unnest(['trust', 'intercept']) AS feature, unnest([round(b, 5), round(a, 5)]) AS v FROM done WHERE period = '2021-2024') GROUP BY 1")
def coefficient_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """Coefficients of the last round with samples as columns, aligned by feature."""
    rows = logit_coefficients(spark, folder).where("period = '2021-2024'")
    return rows.groupBy("feature").pivot("sample", ["all", "spending"]).agg(F.first("coefficient"))


@query()
def coefficients(spark: SparkSession, folder: str) -> DataFrame:
    """Coefficients and odds ratios per standard deviation of the last fold's largest model."""
    rows = _modelling(spark, folder)
    fitted = model.fit_logit(rows.where("year <= 2016"), LADDER["history_rhetoric"], "target", "post")
    made = [(k, round(v, 6)) for k, v in fitted.coefficients().items()]
    return spark.createDataFrame(made, "feature string, coefficient double").withColumn("odds_ratio", F.round(F.exp("coefficient"), 6))


_PAIRED = _EY + f""", late AS (SELECT *, CAST(conflict_active_t AS DOUBLE) AS persistence FROM scored WHERE period = 'late'),
ent AS (SELECT entity_id, row_number() OVER (ORDER BY entity_id) - 1 AS place, count(*) OVER () AS total FROM (SELECT DISTINCT entity_id FROM late WHERE entity_id IS NOT NULL)),
places AS (SELECT r.replicate, CAST('0x' || substr(md5('b:' || r.replicate || ':' || k.draw), 1, 8) AS BIGINT) % (SELECT count(*) FROM ent) AS place FROM range({REPLICATES}) r(replicate), range((SELECT count(*) FROM ent)) k(draw)),
draws AS (SELECT replicate, entity_id, count(*) AS weight FROM places JOIN ent USING (place) GROUP BY 1, 2),
strata AS (SELECT 'all' AS stratum, * FROM late UNION ALL SELECT 'peaceful', * FROM late WHERE conflict_active_t = 0),
pair AS (SELECT stratum, entity_id, target, 'score' AS model, score FROM strata UNION ALL SELECT stratum, entity_id, target, 'persistence', persistence FROM strata),
flat AS (SELECT stratum, replicate, model, score, sum(weight) AS n, sum(weight * target) AS p, sum(weight * (score - target) * (score - target)) AS s FROM pair JOIN draws USING (entity_id) GROUP BY ALL),
run AS (SELECT *, sum(n) OVER w AS cn, sum(p) OVER w AS cp FROM flat WINDOW w AS (PARTITION BY stratum, replicate, model ORDER BY score DESC)),
one AS (SELECT stratum, replicate, model, sum(p * cp / CAST(cn AS DOUBLE)) / nullif(sum(p), 0) AS ap, sum(s) / sum(n) AS brier FROM run GROUP BY ALL),
gain AS (SELECT stratum, replicate, max(ap) FILTER (model = 'score') - max(ap) FILTER (model = 'persistence') AS ap, max(brier) FILTER (model = 'score') - max(brier) FILTER (model = 'persistence') AS brier FROM one GROUP BY ALL),
long AS (SELECT stratum, 'average_precision' AS metric, ap AS g FROM gain WHERE ap IS NOT NULL UNION ALL SELECT stratum, 'brier', brier FROM gain WHERE ap IS NOT NULL)
SELECT stratum, metric, count(*) AS replicates_valid, round(avg(g), 6) AS mean_gain, round(quantile_cont(g, 0.025), 6) AS ci_low, round(quantile_cont(g, 0.975), 6) AS ci_high FROM long GROUP BY ALL"""


@query(_PAIRED)
def paired_bootstrap_metric(spark: SparkSession, folder: str) -> DataFrame:
    """Gain of the deterministic score over persistence with its interval, on all rows and on those at peace."""
    scored = relational.in_samples(_scored(spark, folder).where("period = 'late'"), {"all": F.lit(True), "peaceful": F.col("conflict_active_t") == 0}).withColumnRenamed("sample", "stratum")
    rows = scored.withColumn("model", F.lit("score")).unionByName(scored.withColumn("score", F.col("conflict_active_t").cast("double")).withColumn("model", F.lit("persistence")))
    weights = cut(stats.hashed_weights(scored, "entity_id", REPLICATES))
    return _rounded(model.paired_bootstrap(rows, weights, ("persistence", "score"), keys=["stratum"]))


@query(_EY + " SELECT entity_id, year, round(max(score), 6) AS score, max(conflict_active_t) AS persistence FROM scored GROUP BY 1, 2")
def pivot_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Predictions with models as columns."""
    from quern.operators.reshape import wide_form

    scored = _scored(spark, folder).select("entity_id", "year", "score", "conflict_active_t")
    long = scored.select("entity_id", "year", F.lit("score").alias("model"), "score").unionByName(scored.select("entity_id", "year", F.lit("persistence").alias("model"), F.col("conflict_active_t").cast("double").alias("score")))
    return wide_form(long, ["entity_id", "year"], "model", ["score", "persistence"], F.first("score")).select("entity_id", "year", F.round("score", 6).alias("score"), F.col("persistence").cast("int").alias("persistence"))


_PARTS = " || ',' || ".join(f"CAST(sum(CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT)) AS VARCHAR)" for i in range(8))


@query(f"SELECT sha256({_PARTS}) AS fingerprint FROM (SELECT sha256(coalesce(entity_id, '') || '|' || coalesce(CAST(year AS VARCHAR), '') || '|' || sha256(coalesce(speech_clean, ''))) AS h FROM speeches)")
def corpus_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    """One hash of the whole corpus."""
    from quern.operators.quality import corpus_fingerprint as fingerprint

    return fingerprint(table(spark, folder, "speeches"), ["entity_id", "year"], "speech_clean")


@query(_EY + ", b AS (SELECT avg(target) AS p FROM scored WHERE year <= 2010) SELECT s.period, round(avg((b.p - s.target) * (b.p - s.target)), 6) AS brier FROM scored s, b WHERE s.year > 2010 GROUP BY 1")
def prevalence_baseline(spark: SparkSession, folder: str) -> DataFrame:
    """The share of the training years as everybody's score."""
    rows = _scored(spark, folder)
    share = rows.where("year <= 2010").agg(F.avg("target")).head()[0] or 0.0
    later = rows.where("year > 2010").withColumn("score", F.lit(float(share)))
    return _rounded(model.metrics(later, ["period"]).select("period", "brier"))


@query(f"WITH {base.PASSAGES} SELECT row_id, round(ln(speech_token_count), 9) AS log_words, round(ln(1 + 100 * milex), 9) AS log_spending FROM pass WHERE speech_token_count > 0")
def log_features(spark: SparkSession, folder: str) -> DataFrame:
    rows = base.passages(spark, folder).where("speech_token_count > 0")
    return rows.select("row_id", F.round(F.log("speech_token_count"), 9).alias("log_words"), F.round(F.log1p(100 * F.col("milex")), 9).alias("log_spending"))


@query("""WITH levels AS (SELECT level, CAST(row_number() OVER (ORDER BY level) - 1 AS INTEGER) AS level_no FROM (SELECT DISTINCT speaker_post_group AS level FROM modelling_rows WHERE year <= 2010 AND speaker_post_group IS NOT NULL))
SELECT row_id, level_no, CASE WHEN speaker_post_group = level THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hot FROM modelling_rows, levels""")
def one_hot(spark: SparkSession, folder: str) -> DataFrame:
    """The levels of the training years as columns, here under one another; a level they don't have is zero in all of them."""
    rows = table(spark, folder, "modelling_rows").select("row_id", "year", "speaker_post_group")
    encoded, names = model.one_hot(rows, "speaker_post_group", model.levels_of(rows.where("year <= 2010"), "speaker_post_group"))
    long = encoded.unpivot(["row_id"], names, "level", "hot")
    return long.select("row_id", F.regexp_extract("level", r"(\d+)$", 1).cast("int").alias("level_no"), "hot")


@query(_EY + _AP.rstrip() + ", a AS (SELECT period, sum(p * cp / CAST(cn AS DOUBLE)) / max(tp) AS ap FROM r GROUP BY 1) SELECT 'score' AS model, round(max(ap) FILTER (period = 'early'), 6) AS early, round(max(ap) FILTER (period = 'late'), 6) AS late, round(avg(ap), 6) AS mean FROM a")
def metric_by_period(spark: SparkSession, folder: str) -> DataFrame:
    """A metric with periods as columns and the mean of those at hand."""
    scores = model.metrics(_scored(spark, folder), ["period"]).withColumn("model", F.lit("score"))
    wide = scores.groupBy("model").pivot("period", ["early", "late"]).agg(F.first("average_precision"))
    at_hand = F.array_compact(F.array("early", "late"))
    return _rounded(wide.withColumn("mean", F.aggregate(at_hand, F.lit(0.0), lambda a, x: a + x) / F.size(at_hand)))

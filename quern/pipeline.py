"""From the raw files to the panel, its tables and its predictions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text
from quern.functions.entity import entity_status, main_population
from quern.operators import model, ordered, quality, relational, reshape, stats, windows
from quern.plans.base import TRANSITIONS, transition
from quern.session import cut
from quern.sources import connectors, text_tree
from quern.sources.sinks import Paths, write_result

FIRST, LAST = 1990, 2025
SPENDING_YEARS = range(1949, 2026)
RULES = "source_name string, entity_id string, country_name string, valid_from int, valid_to int, mapping_rationale string, exclusion_status string"
FEATURES = ("trust_score", "threat_score", "milex_share_gdp_t")


@dataclass
class Prepared:
    """The panel with its inputs and audits."""

    panel: DataFrame
    speeches: DataFrame
    conflicts: DataFrame
    spending: DataFrame
    audits: dict[str, DataFrame] = field(default_factory=dict)

    def write_audits(self, folder: str) -> list[str]:
        for name, df in self.audits.items():
            write_result(df, f"{folder}/{name}")
        return [f"{folder}/{name}" for name in self.audits]


def load_speeches(spark: SparkSession, paths: Paths, *, corrections: DataFrame, entity_rules: DataFrame, countries: DataFrame, sessions: int | None = 80) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Speeches with their metadata, entity, status and group of post; audits of what did not fit.

    ``corrections``: iso, session, year, corrected. ``entity_rules``: source_label, valid_from, valid_to, entity_id,
    entity_type. ``countries``: entity_id, country_name.
    """
    connectors.register(spark)
    raw = spark.read.format("xlsx").option("path", str(paths.metadata_path)).load()
    columns = {"Year": ("year", "int"), "Session": ("session", "int"), "ISO Code": ("source_iso", "string"), "Country": ("country_name_raw", "string"), "Name of Person Speaking": ("speaker_name", "string"), "Post": ("speaker_post_raw", "string")}
    rows = relational.typed(quality.require_columns(raw, list(columns)), columns)
    rows = rows.withColumn("source_iso_raw", F.col("source_iso"))
    rows = relational.corrected(rows, corrections.withColumnRenamed("iso", "source_iso_raw"), ["source_iso_raw", "session", "year"], "source_iso")
    keys = ["source_iso", "session", "year"]
    metadata = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("metadata_rows"), (F.count(F.lit(1)) > 1).alias("metadata_ambiguous"), *[relational.text_set(c).alias(c) for c in ("source_iso_raw", "country_name_raw", "speaker_name", "speaker_post_raw")]
    )
    files, rejected = text_tree.read_tree(spark, str(paths.speech_dir), sessions)
    relational.assert_unique(files, keys, "speech files")
    joined = relational.join_checked(files, metadata, keys, "left", "many_to_one").withColumn("metadata_rows", F.coalesce("metadata_rows", F.lit(0)))
    joined = joined.withColumn("__row", F.concat_ws("|", *keys))
    found = entity_rules.select(F.col("source_label").alias("__l"), "valid_from", "valid_to", F.col("entity_id").alias("__e"), "entity_type")
    ruled = joined.join(found, (joined["source_iso"] == found["__l"]) & joined["year"].between(found["valid_from"], found["valid_to"]), "left")
    relational.assert_unique(ruled, ["__row"], "entity rules")
    listed = countries.select(F.col("entity_id"), F.col("country_name")).dropDuplicates(["entity_id"])
    out = ruled.withColumn("entity_id", F.coalesce("__e", "source_iso")).join(listed, "entity_id", "left")
    out = out.withColumn("entity_status", entity_status(F.col("entity_id"), F.col("entity_type"), F.col("country_name").isNotNull()))
    out = out.withColumn("main_population", main_population(F.col("entity_status"))).withColumn("speaker_post_group", text.post_group(F.col("speaker_post_raw")))
    out = out.drop("__row", "__l", "__e", "valid_from", "valid_to", "entity_type")
    audits = {
        "invalid_files": rejected,
        "speeches_without_metadata": relational.unmatched(files.select(*keys, "speech_path"), metadata, keys),
        "metadata_without_speech": relational.unmatched(metadata, files, keys),
        "duplicate_metadata": metadata.where("metadata_ambiguous"),
        "excluded_entities": out.where(~F.col("main_population")).groupBy("entity_id", "entity_status").agg(F.count(F.lit(1)).alias("n_rows")),
    }
    return out, audits


def load_spending(spark: SparkSession, paths: Paths, crosswalk: DataFrame, years: range = SPENDING_YEARS, header: int = 5, sheet: str = "Share of GDP") -> DataFrame:
    """entity_id, year, milex_share_gdp_t and its status; the sheet's names must be those of the crosswalk."""
    connectors.register(spark)
    raw = spark.read.format("xlsx").option("path", str(paths.spending_path)).option("sheet", sheet).option("header", header).option("typed", "true").load()
    columns = [str(y) for y in years]
    if [c for c in raw.columns if c.isdigit()] != columns:
        raise relational.ContractError("other year columns than expected")
    rows = raw.withColumn("source_name", F.substring("Country", 3, 1000)).where(F.col("source_name").isNotNull() & F.coalesce(*[F.col(f"`{c}`") for c in columns]).isNotNull())
    relational.same_domain(rows, crosswalk, "source_name")
    kept = relational.join_checked(rows, crosswalk.select("source_name", "entity_id", "exclusion_status"), ["source_name"]).where("exclusion_status = 'included'")
    long = reshape.long_form(kept.select("entity_id", *[f"`{c}`" for c in columns]), ["entity_id"], columns, "year", "cell")
    cell = F.substring("cell", 3, 1000)
    out = long.select("entity_id", F.col("year").cast("int").alias("year"), F.expr("try_cast(substring(cell, 3) as double)").alias("milex_share_gdp_t"), reshape.cell_status(cell, F.coalesce(F.col("cell").startswith("n:"), F.lit(False))).alias("milex_status_t"))
    return relational.assert_unique(out, ["entity_id", "year"], "spending")


def load_conflicts(spark: SparkSession, paths: Paths, crosswalk: DataFrame) -> DataFrame:
    """Conflict per entity and year; every label must be valid in its year for exactly one entry."""
    raw = connectors.read_csv(spark, str(paths.conflicts_path), "conflict_id long, location string, year int, intensity_level int")
    rows = reshape.labels(raw, "location", ", ").withColumn("__row", F.monotonically_increasing_id())
    rows = cut(rows.withColumn("label", F.trim("label")))
    relational.same_domain(rows.select(F.col("label").alias("source_name")), crosswalk, "source_name")
    matches = relational.valid_in(rows, crosswalk, name="label", year="year", rule_name="source_name", row_id="__row")
    status = crosswalk.select(F.col("entity_id"), "exclusion_status").where("exclusion_status = 'included'").select("entity_id").distinct()
    mapped = relational.exactly_one(rows, matches, "__row").join(status, "entity_id", "left_semi")
    out = mapped.groupBy("entity_id", "year").agg(
        F.lit(1).alias("conflict_active_t"), F.max("intensity_level").alias("max_intensity_t"), F.countDistinct("conflict_id").alias("n_conflicts_t"), F.max((F.col("intensity_level") == 2).cast("int")).alias("any_war_t")
    )
    return relational.assert_unique(out, ["entity_id", "year"], "conflicts")


def with_text_features(df: DataFrame) -> DataFrame:
    """Cleaned text, its words, and the terms of every dictionary per thousand words."""
    out = text.clean_speech(df, "speech_raw", "year")
    c = F.col("speech_clean")
    out = out.withColumn("speech_token_count", text.word_count(c))
    out = out.withColumns({f"dict_{k}_count": text.dictionary_count(c, k) for k in text.DICTIONARIES})
    return out.withColumns({f"dict_{k}_per_1k": text.per_thousand(F.col(f"dict_{k}_count"), F.col("speech_token_count")) for k in text.DICTIONARIES}).withColumn("dictionary_version", F.lit(text.DICTIONARY_VERSION))


def build_panel(speeches: DataFrame, conflicts: DataFrame, spending: DataFrame, first: int = FIRST, last: int = LAST) -> DataFrame:
    """Speeches of the years in scope with conflict and spending of the year and conflict of the year after.

    Absence of conflict is 0 in the main population alone; absent spending is never 0. A target beyond ``last`` is
    missing.
    """
    rows = relational.assert_unique(speeches.where(F.col("year").between(first, last)), ["entity_id", "year"], "speeches")
    out = relational.join_checked(rows, conflicts, ["entity_id", "year"])
    main = F.col("main_population")
    out = out.withColumn("ucdp_status_t", F.when(F.col("conflict_active_t").isNotNull(), "recorded").when(main, "zero_filled").otherwise("not_eligible"))
    out = out.withColumns({c: relational.filled(c, main) for c in ("conflict_active_t", "n_conflicts_t", "any_war_t", "max_intensity_t")})
    out = relational.join_checked(out, spending, ["entity_id", "year"]).withColumn("milex_status_t", F.coalesce("milex_status_t", F.lit("no_country_row")))
    out = relational.at_lag(out.withColumn("target_year", F.col("year") + 1), conflicts, "entity_id", "year", 1, {"conflict_active_t": "conflict_active_t1"})
    return out.withColumn("conflict_active_t1", relational.filled("conflict_active_t1", main & (F.col("target_year") <= last)))


def prepare(spark: SparkSession, paths: Paths, *, corrections: DataFrame, entity_rules: DataFrame, countries: DataFrame, spending_crosswalk: DataFrame, conflict_crosswalk: DataFrame, sessions: int | None = 80) -> Prepared:
    """The whole preparation, with its audits."""
    paths.validate()
    speeches, audits = load_speeches(spark, paths, corrections=corrections, entity_rules=entity_rules, countries=countries, sessions=sessions)
    spending, conflicts = load_spending(spark, paths, spending_crosswalk), load_conflicts(spark, paths, conflict_crosswalk)
    panel = relational.same_rows(speeches.where(F.col("year").between(FIRST, LAST)), with_text_features(build_panel(speeches, conflicts, spending)))
    quality.enforce(panel, {"empty text": F.col("speech_token_count") == 0})
    audits |= {
        "missing_spending": panel.where("milex_share_gdp_t is null").groupBy("milex_status_t").agg(F.count(F.lit(1)).alias("n_rows")),
        "coverage_by_year": panel.groupBy("year").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("main_population").alias("main_rows"), F.count("milex_share_gdp_t").alias("with_spending"), F.count("conflict_active_t1").alias("with_target")),
    }
    return Prepared(panel, speeches, conflicts, spending, audits)


def population(scored: DataFrame, first: int = FIRST, last: int = LAST - 1) -> DataFrame:
    """Main-population rows with both states, and their transition; raises where a score is missing or out of range."""
    rules = {f"{c} missing or out of range": ~F.coalesce(F.col(c).between(0, 1), F.lit(False)) for c in FEATURES[:2]}
    rules["spending without observation"] = F.col("milex_share_gdp_t").isNotNull() & (F.col("milex_status_t") != "observed")
    rows = quality.enforce(relational.assert_unique(scored, ["entity_id", "year"], "panel"), rules)
    rows = rows.where(F.col("main_population") & F.col("year").between(first, last)).withColumn("transition", transition("conflict_active_t", "conflict_active_t1"))
    return rows.where(F.col("transition").isNotNull())


def explore(scored: DataFrame, *, replicates: int = stats.REPLICATES, seed: int = stats.SEED) -> dict[str, DataFrame]:
    """Transition counts, summaries, trends, distributions and bootstrap contrasts of a scored panel."""
    rows = cut(population(scored))
    complete = F.lit(True)
    for c in FEATURES:
        complete = complete & F.col(c).isNotNull()
    samples = {"all_target_observed": F.lit(True), "spending_complete": complete & (F.col("milex_status_t") == "observed")}
    sampled = relational.in_samples(rows, samples)
    counts = sampled.groupBy("sample", "transition").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("entity_id").alias("n_countries"))
    names = rows.sparkSession.createDataFrame([(s,) for s in samples], "sample string")
    counts = relational.completed(counts, names, {"transition": TRANSITIONS}, {"n_rows": 0, "n_countries": 0})
    total = counts.groupBy("sample").agg(F.sum("n_rows").alias("sample_rows"))
    entities = [r[0] for r in rows.select("entity_id").distinct().limit(stats.MAX_CLUSTERS + 1).collect()]
    if len(entities) > stats.MAX_CLUSTERS:
        raise ValueError(f"over {stats.MAX_CLUSTERS} clusters; draw coarser ones")
    weights = cut(stats.multinomial_weights(rows.sparkSession, entities, "entity_id", replicates, seed))
    pairs = [("continued_peace", "onset"), ("continued_conflict", "cessation")]
    contrasts = stats.cluster_bootstrap(sampled, weights, entity="entity_id", group="transition", contrasts=pairs, features=FEATURES, replicates=replicates, keys=["sample"])
    trends = rows.groupBy("year").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("entity_id").alias("n_countries"), *[F.avg(c).alias(f"{c}_mean") for c in FEATURES[:2]])
    trends = trends.join(stats.wide_quantiles(rows, ["year"], FEATURES[:2]), "year", "left")
    return {
        "transition_counts": counts.join(total, "sample").withColumn("row_share", stats.rate(F.col("n_rows"), F.col("sample_rows"))),
        "feature_summaries": stats.feature_summaries(rows, ["transition"], FEATURES, "entity_id", samples),
        "bootstrap_differences": contrasts,
        "annual_trends": trends,
        "spending_distribution": ordered.ecdf(rows.where("milex_share_gdp_t is not null"), ["transition"], "milex_share_gdp_t"),
        "correlations": stats.pearson(rows, FEATURES),
    }


def context_review(panel: DataFrame, per_cell: int = 4, seed: str = "c1") -> DataFrame:
    """Sentences in which the dictionaries' terms occur, for review, by category and period."""
    period = reshape.right_closed(F.col("year"), [1989, 2001, 2013, 2025], ["1990-2001", "2002-2013", "2014-2025"])
    rows = panel.withColumn("period", period).where("period is not null").withColumn("key", F.concat_ws("|", "entity_id", "year"))
    return text.context_review(rows, "speech_clean", "key", ["period"], per_cell=per_cell, seed=seed)


HISTORY = ["conflict_active_t", "any_war_t", "n_conflicts_t", "past5"]
CONTROLS = ["year", "log_words"]
RHETORIC = ["trust_score", "threat_score"]
VALIDATION, FINAL = model.expanding_folds([2004, 2008, 2012, 2016], 4), [model.Fold("2021-2024", 2020, 2024)]


def modelling_table(scored: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Population rows with conflict history, log of words and log of spending, in doubles."""
    rows = windows.look_back(population(scored), conflicts, "entity_id", "year", 5, "past5")
    rows = rows.withColumn("log_words", F.log("speech_token_count")).withColumn("log_spending", F.log1p(100 * F.col("milex_share_gdp_t")))
    return rows.withColumns({c: F.col(c).cast("double") for c in (*HISTORY, "year")} | {"target": F.col("conflict_active_t1").cast("double")})


def samples_and_ladders(data: DataFrame) -> dict[str, tuple[DataFrame, dict[str, list[str]]]]:
    """The full sample with two models over persistence, and the rows with spending with three."""
    base = HISTORY + CONTROLS
    return {
        "all": (data, {"persistence": [], "history": base, "history_rhetoric": base + RHETORIC}),
        "spending": (data.where("log_spending is not null"), {"persistence": [], "history": base, "history_spending": base + ["log_spending"], "history_spending_rhetoric": base + ["log_spending"] + RHETORIC}),
    }


def predict(scored: DataFrame, conflicts: DataFrame) -> dict[str, DataFrame]:
    """Metrics of all models on the validation rounds and the last period, for all and for peaceful rows, and coefficients."""
    data = cut(modelling_table(scored, conflicts))
    made, coefficients = None, []
    for sample, (rows, ladder) in samples_and_ladders(data).items():
        for kind, folds in (("validation", VALIDATION), ("final", FINAL)):
            predictions, models = model.expanding_predictions(rows, folds, ladder, year="year", target="target", category="speaker_post_group")
            predictions = predictions.withColumn("sample", F.lit(sample)).withColumn("kind", F.lit(kind))
            made = predictions if made is None else made.unionByName(predictions)
            if kind == "final":
                coefficients += [(sample, name, f, v) for (_, name), m in models.items() for f, v in m.coefficients().items()]
    made = cut(made)
    keys = ["sample", "kind", "period", "model"]
    peaceful = model.metrics(made.where("conflict_active_t = 0"), keys).select(*keys, F.col("average_precision").alias("average_precision_peaceful"), F.col("positives").alias("onsets"))
    scores = model.metrics(made, keys, entity="entity_id").join(peaceful, keys, "left")
    table = scores.where("kind = 'validation'").groupBy("sample", "model").pivot("period", [f.name for f in VALIDATION]).agg(F.first("average_precision"))
    table = table.withColumn("mean", F.expr(" + ".join(f"`{f.name}`" for f in VALIDATION)) / len(VALIDATION))
    listed = data.sparkSession.createDataFrame(coefficients, "sample string, model string, feature string, coefficient double").withColumn("odds_ratio", F.exp("coefficient"))
    models = [f"{s}:{n}" for s, (_, ladder) in samples_and_ladders(data).items() for n, f in ladder.items() if f]
    matrix = listed.withColumn("fitted", F.concat_ws(":", "sample", "model")).groupBy("feature").pivot("fitted", models).agg(F.first("coefficient"))
    return {"predictions": made, "scores": scores, "average_precision_by_round": table, "coefficients": listed, "coefficient_matrix": matrix}

"""Tables that the queries share, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.relational import at_lag, filled
from quern.operators.reshape import labels
from quern.session import table

#: Years that the conflict source covers; the target is observed up to the year before the last.
FIRST_YEAR, LAST_YEAR = 1946, 2024
TRANSITIONS = ("continued_peace", "onset", "cessation", "continued_conflict")
FEATURES = ("trust", "threat", "milex")


def transition(now: str, following: str) -> Column:
    """Pair of states to one of four transitions; null where a state is unknown."""
    a, b = F.col(now), F.col(following)
    return F.when((a == 0) & (b == 0), TRANSITIONS[0]).when((a == 0) & (b == 1), TRANSITIONS[1]).when((a == 1) & (b == 0), TRANSITIONS[2]).when((a == 1) & (b == 1), TRANSITIONS[3])


def cells(spark: SparkSession, folder: str) -> DataFrame:
    """Standing speeches per entity and year."""
    rows = table(spark, folder, "speeches").where("deleted_at is null")
    return rows.groupBy("entity_id", "year").agg(F.count(F.lit(1)).alias("n_speeches"), F.sum("speech_token_count").alias("tokens"))


def conflicts(spark: SparkSession, folder: str) -> DataFrame:
    """Conflict episodes per entity and year; aggregated before any join with the panel."""
    episodes = labels(table(spark, folder, "ucdp_conflicts").select("conflict_id", "location", "year", "intensity_level"), "location")
    names = table(spark, folder, "region_income_snapshot").select("entity_id", F.col("country_name").alias("label"))
    mapped = episodes.join(names, "label")
    return mapped.groupBy("entity_id", "year").agg(
        F.lit(1).alias("conflict_active"), F.max("intensity_level").alias("max_intensity"), F.countDistinct("conflict_id").alias("n_conflicts"), F.max(F.when(F.col("intensity_level") == 2, 1).otherwise(0)).alias("any_war")
    )


def panel(spark: SparkSession, folder: str) -> DataFrame:
    """One row per entity and year with speeches: conflict now and at exactly t + 1; missing is 0 inside the coverage alone."""
    war = conflicts(spark, folder)
    rows = cells(spark, folder).join(war, ["entity_id", "year"], "left")
    covered, next_covered = F.col("year").between(FIRST_YEAR, LAST_YEAR), (F.col("year") + 1).between(FIRST_YEAR, LAST_YEAR)
    rows = rows.select("entity_id", "year", "n_speeches", "tokens", *[filled(c, covered).alias(f"{c}_t") for c in ("conflict_active", "n_conflicts", "any_war")], F.col("max_intensity").alias("max_intensity_t"))
    rows = at_lag(rows, war, "entity_id", "year", 1, {"conflict_active": "conflict_active_t1"}).withColumn("conflict_active_t1", filled("conflict_active_t1", next_covered))
    return rows.withColumn("transition", transition("conflict_active_t", "conflict_active_t1"))


def passages(spark: SparkSession, folder: str) -> DataFrame:
    """Scored passages with invalid scores as null and their transition."""
    rows = table(spark, folder, "modelling_rows")
    valid = lambda c: F.when(~F.isnan(c) & F.col(c).between(0, 1), F.col(c))
    return rows.withColumns({"trust": valid("trust_score"), "threat": valid("threat_score"), "milex": F.col("milex_share_gdp_t"), "transition": transition("conflict_active_t", "conflict_active_t1")})


def entity_years(spark: SparkSession, folder: str) -> DataFrame:
    """Passages of the main population as an entity-year panel for prediction."""
    rows = passages(spark, folder).where("main_population and conflict_active_t is not null and conflict_active_t1 is not null")
    return rows.groupBy("entity_id", "year").agg(
        F.max("conflict_active_t").alias("conflict_active_t"), F.max("any_war_t").alias("any_war_t"), F.max("n_conflicts_t").alias("n_conflicts_t"), F.max("conflict_active_t1").alias("target"),
        F.avg("trust").alias("trust"), F.avg("threat").alias("threat"), F.avg("milex").alias("milex"), F.log1p(F.avg("speech_token_count")).alias("log_words"), F.min("speaker_post_group").alias("post"),
    )


CONFLICTS = r"""conf AS (
  SELECT r.entity_id, x.year, 1 AS conflict_active, max(x.intensity_level) AS max_intensity, count(DISTINCT x.conflict_id) AS n_conflicts, max(CASE WHEN x.intensity_level = 2 THEN 1 ELSE 0 END) AS any_war
  FROM (SELECT conflict_id, year, intensity_level, unnest(regexp_split_to_array(location, '\s*[,;|]\s*')) AS label FROM ucdp_conflicts) x JOIN region_income_snapshot r ON r.country_name = x.label GROUP BY 1, 2)"""
CELLS = """cells AS (SELECT entity_id, year, count(*) AS n_speeches, CAST(sum(speech_token_count) AS BIGINT) AS tokens FROM speeches WHERE deleted_at IS NULL GROUP BY 1, 2)"""
CASE = """CASE WHEN {a} = 0 AND {b} = 0 THEN 'continued_peace' WHEN {a} = 0 AND {b} = 1 THEN 'onset' WHEN {a} = 1 AND {b} = 0 THEN 'cessation' WHEN {a} = 1 AND {b} = 1 THEN 'continued_conflict' END"""
PANEL = (
    CONFLICTS + ", " + CELLS + f""", joined AS (
  SELECT c.entity_id, c.year, c.n_speeches, c.tokens,
         CASE WHEN c.year BETWEEN {FIRST_YEAR} AND {LAST_YEAR} THEN coalesce(w.conflict_active, 0) ELSE w.conflict_active END AS conflict_active_t,
         CASE WHEN c.year BETWEEN {FIRST_YEAR} AND {LAST_YEAR} THEN coalesce(w.n_conflicts, 0) ELSE w.n_conflicts END AS n_conflicts_t,
         CASE WHEN c.year BETWEEN {FIRST_YEAR} AND {LAST_YEAR} THEN coalesce(w.any_war, 0) ELSE w.any_war END AS any_war_t,
         w.max_intensity AS max_intensity_t,
         CASE WHEN c.year + 1 BETWEEN {FIRST_YEAR} AND {LAST_YEAR} THEN coalesce(n.conflict_active, 0) ELSE n.conflict_active END AS conflict_active_t1
  FROM cells c LEFT JOIN conf w ON w.entity_id = c.entity_id AND w.year = c.year LEFT JOIN conf n ON n.entity_id = c.entity_id AND n.year = c.year + 1
), panel AS (SELECT *, {CASE.format(a='conflict_active_t', b='conflict_active_t1')} AS transition FROM joined)"""
)
PASSAGES = f"""pass AS (
  SELECT *, CASE WHEN NOT isnan(trust_score) AND trust_score BETWEEN 0 AND 1 THEN trust_score END AS trust, CASE WHEN NOT isnan(threat_score) AND threat_score BETWEEN 0 AND 1 THEN threat_score END AS threat,
         milex_share_gdp_t AS milex, {CASE.format(a='conflict_active_t', b='conflict_active_t1')} AS transition FROM modelling_rows)"""
ENTITY_YEARS = PASSAGES + """, ey AS (
  SELECT entity_id, year, max(conflict_active_t) AS conflict_active_t, max(any_war_t) AS any_war_t, max(n_conflicts_t) AS n_conflicts_t, max(conflict_active_t1) AS target, avg(trust) AS trust, avg(threat) AS threat, avg(milex) AS milex
  FROM pass WHERE main_population AND conflict_active_t IS NOT NULL AND conflict_active_t1 IS NOT NULL GROUP BY 1, 2)"""

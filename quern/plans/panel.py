"""Queries on panels: joins, look-backs, samples, audits, reshaping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.entity import entity_status, main_population
from quern.functions.text import post_group
from quern.operators import quality, relational, reshape, windows
from quern.plans import base
from quern.session import table



def _samples() -> dict:
    complete = F.col("trust").isNotNull() & F.col("threat").isNotNull() & F.col("milex").isNotNull() & (F.col("milex_status_t") == "observed")
    return {"all_target_observed": F.lit(True), "spending_complete": complete}


def _observed(spark: SparkSession, folder: str) -> DataFrame:
    return base.passages(spark, folder).where("main_population and transition is not null")


_OBSERVED = "obs AS (SELECT * FROM pass WHERE main_population AND transition IS NOT NULL)"
_SAMPLED = """sampled AS (SELECT *, 'all_target_observed' AS sample FROM obs UNION ALL
  SELECT *, 'spending_complete' FROM obs WHERE trust IS NOT NULL AND threat IS NOT NULL AND milex IS NOT NULL AND milex_status_t = 'observed')"""
_WITH_SAMPLES = f"WITH {base.PASSAGES}, {_OBSERVED}, {_SAMPLED} "

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(f"WITH {base.PANEL} SELECT * FROM panel")
def panel_build(spark: SparkSession, folder: str) -> DataFrame:
    return base.panel(spark, folder)


@query(_WITH_SAMPLES + """SELECT sample, transition, count(*) AS n_rows, count(DISTINCT entity_id) AS n_countries, round(count(*) / sum(count(*)) OVER (PARTITION BY sample), 9) AS row_share FROM sampled GROUP BY 1, 2""")
def panel_transition_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Rows, entities and row share of each transition, for the full and the complete sample in one pass."""
    rows = relational.in_samples(_observed(spark, folder), _samples())
    counts = rows.groupBy("sample", "transition").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("entity_id").alias("n_countries"))
    totals = counts.groupBy("sample").agg(F.sum("n_rows").alias("__all"))
    return counts.join(totals, "sample").select("sample", "transition", "n_rows", "n_countries", F.round(F.col("n_rows") / F.col("__all"), 9).alias("row_share"))


@query(f"WITH {base.PANEL} SELECT entity_id, year, conflict_active_t, lead(conflict_active_t) OVER (PARTITION BY entity_id ORDER BY year) AS next_row_active FROM panel")
def panel_lead_variant(spark: SparkSession, folder: str) -> DataFrame:
    """The next row at hand instead of the next year."""
    return base.panel(spark, folder).select("entity_id", "year", "conflict_active_t", windows.next_row("conflict_active_t", "entity_id", "year").alias("next_row_active"))


_LOOK = "SELECT c.entity_id, c.year, CAST(count(DISTINCT w.year) AS BIGINT) AS past5 FROM cells c LEFT JOIN conf w ON w.entity_id = c.entity_id AND w.year BETWEEN c.year - 5 AND c.year - 1 GROUP BY 1, 2"


@query(f"WITH {base.CONFLICTS}, {base.CELLS} {_LOOK}")
def panel_history5(spark: SparkSession, folder: str) -> DataFrame:
    """Years with conflict among the five calendar years before."""
    rows = base.cells(spark, folder).select("entity_id", "year")
    return windows.look_back(rows, base.conflicts(spark, folder), "entity_id", "year", 5, "past5").withColumn("past5", F.col("past5").cast("long"))


@query(f"""WITH {base.CONFLICTS}, {base.CELLS}, starts AS (SELECT entity_id, min(year) AS start FROM cells GROUP BY 1)
SELECT c.entity_id, c.year, CAST(count(DISTINCT w.year) AS BIGINT) AS past5, greatest(0, least(5, c.year - s.start)) AS observed_history_years
FROM cells c JOIN starts s USING (entity_id) LEFT JOIN conf w ON w.entity_id = c.entity_id AND w.year BETWEEN c.year - 5 AND c.year - 1 AND w.year >= s.start GROUP BY c.entity_id, c.year, s.start""")
def panel_history5_identity(spark: SparkSession, folder: str) -> DataFrame:
    """The same within the years of the entity's identity, here from its first speech on."""
    rows = base.cells(spark, folder).select("entity_id", "year")
    starts = rows.groupBy("entity_id").agg(F.min("year").alias("start"))
    own = base.conflicts(spark, folder).join(starts, "entity_id").where("year >= start")
    out = windows.look_back(rows, own, "entity_id", "year", 5, "past5").join(starts, "entity_id")
    return out.select("entity_id", "year", F.col("past5").cast("long").alias("past5"), windows.observed_years("year", "start").alias("observed_history_years"))


@query(r"""WITH x AS (SELECT episode_id, year, unnest(regexp_split_to_array(location, '\s*[,;|]\s*')) AS label, generate_subscripts(regexp_split_to_array(location, '\s*[,;|]\s*'), 1) - 1 AS p FROM ucdp_conflicts WHERE location IS NOT NULL)
SELECT x.episode_id, CAST(x.p AS INTEGER) AS label_pos, count(c.source_name) AS n_matches, min(c.entity_id) AS least_entity, max(c.entity_id) AS greatest_entity FROM x
LEFT JOIN ucdp_country_crosswalk c ON c.source_name = x.label AND x.year BETWEEN c.valid_from AND c.valid_to AND c.exclusion_status = 'included' GROUP BY 1, 2""")
def crosswalk_range_join(spark: SparkSession, folder: str) -> DataFrame:
    """Labels matched to crosswalk entries that are valid in the episode's year; more than one match is an ambiguity."""
    rows = reshape.labels(table(spark, folder, "ucdp_conflicts").select("episode_id", "location", "year").where("location is not null"), "location")
    rows = rows.withColumn("row", F.struct("episode_id", "label_pos"))
    rules = table(spark, folder, "ucdp_country_crosswalk").where("exclusion_status = 'included'")
    found = relational.valid_in(rows, rules, name="label", year="year", rule_name="source_name", row_id="row")
    return found.select("row.*", "n_matches", "least_entity", "greatest_entity")


@query("""SELECT r.region, s.year, count(*) AS n_speeches FROM (SELECT entity_id, trim(region) AS region FROM region_income_snapshot) r JOIN speeches s USING (entity_id) GROUP BY 1, 2""")
def join_many_to_one_region(spark: SparkSession, folder: str) -> DataFrame:
    """Speeches per region; the dimension's key is checked, and its counts are joined after aggregation."""
    regions = table(spark, folder, "region_income_snapshot").select("entity_id", F.trim("region").alias("region"))
    counts = table(spark, folder, "speeches").groupBy("entity_id", "year").agg(F.count(F.lit(1)).alias("n"))
    return relational.join_checked(counts, regions, ["entity_id"], "inner", "many_to_one").groupBy("region", "year").agg(F.sum("n").alias("n_speeches"))


_SPEAKER_KEYS = "SELECT DISTINCT iso_code AS entity_id, year FROM speakers_by_session WHERE iso_code IS NOT NULL AND year IS NOT NULL"


@query(f"SELECT DISTINCT entity_id, year FROM speeches s WHERE NOT EXISTS (SELECT 1 FROM ({_SPEAKER_KEYS}) k WHERE k.entity_id = s.entity_id AND k.year = s.year)")
def anti_unmatched_left(spark: SparkSession, folder: str) -> DataFrame:
    """Speeches without metadata."""
    keys = table(spark, folder, "speakers_by_session").select(F.col("iso_code").alias("entity_id"), "year").dropna()
    return relational.unmatched(table(spark, folder, "speeches").select("entity_id", "year").distinct(), keys, ["entity_id", "year"])


@query(f"SELECT * FROM ({_SPEAKER_KEYS}) k WHERE NOT EXISTS (SELECT 1 FROM speeches s WHERE k.entity_id = s.entity_id AND k.year = s.year)")
def anti_unmatched_right(spark: SparkSession, folder: str) -> DataFrame:
    """Metadata without speeches."""
    keys = table(spark, folder, "speakers_by_session").select(F.col("iso_code").alias("entity_id"), "year").dropna().distinct()
    return relational.unmatched(keys, table(spark, folder, "speeches").select("entity_id", "year"), ["entity_id", "year"])


@query("""SELECT value, side FROM (SELECT DISTINCT source_name AS value, 'new' AS side FROM sipri_country_crosswalk WHERE source_name IS NOT NULL AND source_name NOT IN (SELECT source_name FROM ucdp_country_crosswalk WHERE source_name IS NOT NULL)
UNION ALL SELECT DISTINCT source_name, 'missing' FROM ucdp_country_crosswalk WHERE source_name IS NOT NULL AND source_name NOT IN (SELECT source_name FROM sipri_country_crosswalk WHERE source_name IS NOT NULL))""")
def domain_set_diff(spark: SparkSession, folder: str) -> DataFrame:
    """Names that only one crosswalk has."""
    return relational.domain_difference(table(spark, folder, "sipri_country_crosswalk"), table(spark, folder, "ucdp_country_crosswalk"), "source_name")


@query(f"""WITH {base.PANEL}, t AS (SELECT unnest(['continued_peace', 'onset', 'cessation', 'continued_conflict']) AS transition), r AS (SELECT DISTINCT trim(region) AS region FROM region_income_snapshot)
SELECT r.region, t.transition, coalesce(x.n_rows, 0) AS n_rows FROM r CROSS JOIN t LEFT JOIN
(SELECT trim(g.region) AS region, p.transition, count(*) AS n_rows FROM panel p JOIN region_income_snapshot g USING (entity_id) GROUP BY 1, 2) x ON x.region = r.region AND x.transition = t.transition""")
def dense_completion(spark: SparkSession, folder: str) -> DataFrame:
    """Transitions by region, with zeros where a pair has no row."""
    regions = table(spark, folder, "region_income_snapshot").select("entity_id", F.trim("region").alias("region"))
    counts = base.panel(spark, folder).join(regions, "entity_id").groupBy("region", "transition").agg(F.count(F.lit(1)).alias("n_rows"))
    return relational.completed(counts, regions.select("region").distinct(), {"transition": base.TRANSITIONS}, {"n_rows": 0})


@query("""SELECT iso_code, year, count(*) AS metadata_rows, nullif(array_to_string(list_sort(list_distinct(list(nullif(trim(post), '')) FILTER (nullif(trim(post), '') IS NOT NULL))), ' | '), '') AS posts,
nullif(array_to_string(list_sort(list_distinct(list(nullif(trim(name_of_person_speaking), '')) FILTER (nullif(trim(name_of_person_speaking), '') IS NOT NULL))), ' | '), '') AS names FROM speakers_by_session GROUP BY 1, 2""")
def set_agg_strings(spark: SparkSession, folder: str) -> DataFrame:
    """Posts and names of each key as sorted sets; null keys are groups of their own."""
    rows = table(spark, folder, "speakers_by_session").groupBy("iso_code", "year")
    return rows.agg(F.count(F.lit(1)).alias("metadata_rows"), relational.text_set("post").alias("posts"), relational.text_set("name_of_person_speaking").alias("names"))


@query(f"WITH {base.CONFLICTS} SELECT * FROM conf")
def episode_agg(spark: SparkSession, folder: str) -> DataFrame:
    return base.conflicts(spark, folder)


@query("""SELECT year, count(*) AS n_rows, count(milex_share_gdp_t) AS with_spending, count(*) FILTER (main_population) AS main_rows, count(*) FILTER (conflict_active_t1 IS NULL) AS target_missing,
round(count(milex_share_gdp_t) / CAST(count(*) AS DOUBLE), 9) AS spending_rate, count(DISTINCT entity_id) AS n_countries FROM modelling_rows GROUP BY 1""")
def coverage_by_year(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "modelling_rows").groupBy("year")
    n = F.count(F.lit(1))
    return rows.agg(n.alias("n_rows"), F.count("milex_share_gdp_t").alias("with_spending"), F.count_if("main_population").alias("main_rows"), F.count_if(F.col("conflict_active_t1").isNull()).alias("target_missing"),
                    F.round(F.count("milex_share_gdp_t") / n, 9).alias("spending_rate"), F.countDistinct("entity_id").alias("n_countries"))


@query("""SELECT * FROM (VALUES (1, 'input rows'), (2, 'main population'), (3, 'target observed'), (4, 'spending observed')) s(step_no, step) JOIN (
SELECT unnest([1, 2, 3, 4]) AS step_no, unnest([count(*), count(*) FILTER (m), count(*) FILTER (m AND o), count(*) FILTER (m AND o AND x)]) AS n_rows,
unnest([count(DISTINCT entity_id), count(DISTINCT entity_id) FILTER (m), count(DISTINCT entity_id) FILTER (m AND o), count(DISTINCT entity_id) FILTER (m AND o AND x)]) AS n_countries
FROM (SELECT entity_id, main_population AS m, conflict_active_t IS NOT NULL AND conflict_active_t1 IS NOT NULL AS o, coalesce(milex_status_t = 'observed', false) AS x FROM modelling_rows)) c USING (step_no)""")
def funnel_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Nested filters with their rows and entities: entities are reduced to their deepest steps before they are counted."""
    main = F.coalesce("main_population", F.lit(False))
    observed = main & F.col("conflict_active_t").isNotNull() & F.col("conflict_active_t1").isNotNull()
    spending = observed & F.coalesce(F.col("milex_status_t") == "observed", F.lit(False))
    steps = {"input rows": F.lit(True), "main population": main, "target observed": observed, "spending observed": spending}
    rows = table(spark, folder, "modelling_rows").groupBy("entity_id").agg(*[F.count_if(c).alias(f"n{i}") for i, c in enumerate(steps.values(), 1)])
    total = rows.agg(*[a for i in range(1, len(steps) + 1) for a in (F.sum(f"n{i}").alias(f"r{i}"), F.count(F.when((F.col(f"n{i}") > 0) & F.col("entity_id").isNotNull(), 1)).alias(f"c{i}"))])
    listed = ", ".join(f"{i}, '{s}', r{i}, c{i}" for i, s in enumerate(steps, 1))
    return total.select(F.expr(f"stack({len(steps)}, {listed}) as (step_no, step, n_rows, n_countries)"))


@query(f"WITH {base.PANEL} SELECT conflict_active_t, count(*) FILTER (conflict_active_t1 = 0) AS t1_0, count(*) FILTER (conflict_active_t1 = 1) AS t1_1 FROM panel WHERE conflict_active_t1 IS NOT NULL GROUP BY 1")
def crosstab_t_t1(spark: SparkSession, folder: str) -> DataFrame:
    rows = base.panel(spark, folder).where("conflict_active_t1 is not null")
    out = reshape.wide_form(rows, ["conflict_active_t"], "conflict_active_t1", [0, 1], F.count(F.lit(1)))
    return out.select("conflict_active_t", *[F.coalesce(f"`{i}`", F.lit(0)).alias(f"t1_{i}") for i in (0, 1)])


@query(f"WITH {base.PANEL}, h AS ({_LOOK}) SELECT h.past5, count(*) AS n_rows, round(avg(p.conflict_active_t1), 9) AS onset_share FROM panel p JOIN h USING (entity_id, year) WHERE p.conflict_active_t = 0 AND p.conflict_active_t1 IS NOT NULL GROUP BY 1")
def recurrence_table(spark: SparkSession, folder: str) -> DataFrame:
    """Share of onsets among peaceful rows by the number of recent years with conflict."""
    rows = base.panel(spark, folder).where("conflict_active_t = 0 and conflict_active_t1 is not null").select("entity_id", "year", "conflict_active_t1")
    back = windows.look_back(rows, base.conflicts(spark, folder), "entity_id", "year", 5, "past5")
    return back.groupBy(F.col("past5").cast("long").alias("past5")).agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.avg("conflict_active_t1"), 9).alias("onset_share"))


@query(f"WITH {base.PASSAGES} SELECT year, round(avg(trust) FILTER (conflict_active_t1 = 0), 6) AS outcome_0, round(avg(trust) FILTER (conflict_active_t1 = 1), 6) AS outcome_1 FROM pass WHERE conflict_active_t1 IS NOT NULL GROUP BY 1")
def pivot_year_outcome(spark: SparkSession, folder: str) -> DataFrame:
    rows = base.passages(spark, folder).where("conflict_active_t1 is not null")
    out = reshape.wide_form(rows, ["year"], "conflict_active_t1", [0, 1], F.avg("trust"))
    return out.select("year", *[F.round(f"`{i}`", 6).alias(f"outcome_{i}") for i in (0, 1)])


@query(f"""WITH {base.PANEL} SELECT entity_id, year, unnest(['n_speeches', 'tokens', 'max_intensity_t']) AS measure, unnest([n_speeches, tokens, CAST(max_intensity_t AS BIGINT)]) AS value FROM panel""")
def unpivot_long(spark: SparkSession, folder: str) -> DataFrame:
    """Wide to long, with the null cells kept."""
    rows = base.panel(spark, folder).select("entity_id", "year", "n_speeches", "tokens", F.col("max_intensity_t").cast("long").alias("max_intensity_t"))
    return reshape.long_form(rows, ["entity_id", "year"], ["n_speeches", "tokens", "max_intensity_t"], "measure", "value")


@query(f"""WITH {base.PANEL} SELECT * FROM (SELECT entity_id, year, unnest(['n_speeches', 'tokens', 'max_intensity_t']) AS measure, unnest([n_speeches, tokens, CAST(max_intensity_t AS BIGINT)]) AS value FROM panel) WHERE value IS NOT NULL""")
def unpivot_without_nulls(spark: SparkSession, folder: str) -> DataFrame:
    rows = base.panel(spark, folder).select("entity_id", "year", "n_speeches", "tokens", F.col("max_intensity_t").cast("long").alias("max_intensity_t"))
    return reshape.long_form(rows, ["entity_id", "year"], ["n_speeches", "tokens", "max_intensity_t"], "measure", "value", keep_null=False)


_CELL = "CASE milex_status_t WHEN 'not_independent_or_nonexistent' THEN 'xxx' WHEN 'unavailable' THEN CASE row_id % 3 WHEN 0 THEN '...' WHEN 1 THEN ' ..' ELSE '. . ' END WHEN 'no_country_row' THEN CAST(row_id AS VARCHAR(20)) END"


@query(f"""SELECT row_id, CASE WHEN is_number THEN 'observed' WHEN trim(cell) = 'xxx' THEN 'not_independent_or_nonexistent' WHEN trim(cell) IN ('...', '..', '. .') THEN 'unavailable' ELSE 'blank' END AS status, TRY_CAST(cell AS DOUBLE) AS value
FROM (SELECT row_id, milex_share_gdp_t IS NOT NULL AS is_number, CASE WHEN milex_share_gdp_t IS NOT NULL THEN CAST(CAST(row_id AS DOUBLE) / 8 AS VARCHAR) ELSE {_CELL} END AS cell FROM modelling_rows)""")
def status_value_parse(spark: SparkSession, folder: str) -> DataFrame:
    """Status and value of the spending cells of all rows, numbers and markers as they are typed: a number typed as text has a value but the status blank."""
    number = F.col("milex_share_gdp_t").isNotNull()
    cell = F.when(number, (F.col("row_id").cast("double") / 8).cast("string")).otherwise(F.expr(_CELL))
    cells = table(spark, folder, "modelling_rows").select("row_id", number.alias("is_number"), cell.alias("cell"))
    return cells.select("row_id", reshape.cell_status(F.col("cell"), F.col("is_number")).alias("status"), F.expr("try_cast(cell as double)").alias("value"))


@query(r"""SELECT episode_id, CAST(generate_subscripts(a, 1) - 1 AS INTEGER) AS label_pos, unnest(a) AS label FROM (SELECT episode_id, regexp_split_to_array(location, '\s*[,;|]\s*') AS a FROM ucdp_conflicts WHERE location IS NOT NULL)""")
def explode_split(spark: SparkSession, folder: str) -> DataFrame:
    """Labels of plainly delimited fields, loss-free by position."""
    rows = table(spark, folder, "ucdp_conflicts").select("episode_id", "location").where("location is not null")
    return reshape.labels(rows, "location").select("episode_id", "label_pos", "label")


_CHUNKS = """SELECT score_id, CAST(json_extract(c, '$.start_char') AS INTEGER) AS s, CAST(json_extract(c, '$.end_char') AS INTEGER) AS e, CAST(json_extract(c, '$.tokens') AS INTEGER) AS tokens,
CAST(json_extract(c, '$.trust') AS DOUBLE) AS trust, CAST(json_extract(c, '$.threat') AS DOUBLE) AS threat, CAST(i - 1 AS INTEGER) AS chunk_no, entity_id, year, speech_no FROM (
SELECT score_id, trim(entity_id) AS entity_id, year, speech_no, unnest(json_extract(payload, '$.chunks[*]')) AS c, generate_subscripts(json_extract(payload, '$.chunks[*]'), 1) AS i FROM (SELECT * FROM scores WHERE json_valid(payload)))"""


@query(f"SELECT score_id, chunk_no, s AS start_char, e AS end_char, tokens, trust, threat FROM ({_CHUNKS})")
def posexplode_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of the payloads with their order; broken payloads give none."""
    rows = table(spark, folder, "scores").select("score_id", reshape.payload(F.col("payload")).alias("p")).select("score_id", F.posexplode("p.chunks").alias("chunk_no", "c"))
    return rows.select("score_id", "chunk_no", "c.start_char", "c.end_char", "c.tokens", "c.trust", "c.threat")


@query("""SELECT key0 AS source, n_rows FROM (SELECT 'speeches' AS key0, count(*) AS n_rows FROM speeches UNION ALL SELECT 'scores', count(*) FROM scores UNION ALL SELECT 'speakers', count(*) FROM speakers_by_session)""")
def union_labelled(spark: SparkSession, folder: str) -> DataFrame:
    """Tables under one another, each row with its origin, counted."""
    parts = [table(spark, folder, t).select(F.lit(n).alias("source")) for n, t in (("speeches", "speeches"), ("scores", "scores"), ("speakers", "speakers_by_session"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"))


@query("SELECT entity_id, year, speech_no, count(*) AS n_rows FROM speeches GROUP BY 1, 2, 3 HAVING count(*) > 1")
def dup_keys(spark: SparkSession, folder: str) -> DataFrame:
    return windows.duplicate_keys(table(spark, folder, "speeches"), ["entity_id", "year", "speech_no"])


@query("""SELECT speaker_post_group, row_id, pick FROM (SELECT speaker_post_group, row_id, CAST(row_number() OVER (PARTITION BY speaker_post_group ORDER BY md5('s1' || row_id)) AS INTEGER) AS pick FROM modelling_rows) WHERE pick <= 4""")
def hash_sample_per_group(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "modelling_rows").select("speaker_post_group", "row_id")
    return windows.hash_sample(rows, ["speaker_post_group"], F.col("row_id").cast("string"), 4, "s1").select("speaker_post_group", "row_id", "pick")


@query(f"""WITH RECURSIVE {base.PASSAGES}, own AS (SELECT CASE WHEN year > 1989 AND year <= 2001 THEN '1990-2001' WHEN year > 2001 AND year <= 2013 THEN '2002-2013' WHEN year > 2013 AND year <= 2025 THEN '2014-2025' END AS era,
CASE WHEN trust < 0.2 THEN 'low' WHEN trust < 0.4 THEN 'middle' ELSE 'high' END AS band, row_id, trim(g.region) AS region, md5('r1' || row_id) AS h FROM pass JOIN region_income_snapshot g USING (entity_id) WHERE trust IS NOT NULL AND g.region IS NOT NULL),
cand AS (SELECT *, dense_rank() OVER (ORDER BY era, band) AS cell FROM own WHERE era IS NOT NULL),
few AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cell, region ORDER BY h, row_id) AS k FROM cand) WHERE k <= 9),
step(cell, units, regions, era, band, row_id, region) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS VARCHAR[]), '', '', CAST(0 AS BIGINT), '' UNION ALL
SELECT n.cell, list_append(n.units, n.row_id), list_append(n.regions, n.region), n.era, n.band, n.row_id, n.region FROM (SELECT c.cell, s.units, s.regions, c.era, c.band, c.row_id, c.region,
row_number() OVER (ORDER BY len(list_filter(s.regions, lambda x: x = c.region)), c.h, c.row_id) AS k FROM step s JOIN few c ON c.cell = s.cell + 1 AND NOT list_contains(s.units, c.row_id)) n WHERE k = 1)
SELECT era, band, row_id, region FROM step WHERE cell > 0""")
def balanced_sample(spark: SparkSession, folder: str) -> DataFrame:
    """One passage per theme, era and band: no speech twice, regions in turn."""
    ranked = base.passages(spark, folder).where("trust is not null").select("entity_id", "year", "row_id", "trust")
    regions = table(spark, folder, "region_income_snapshot").select("entity_id", F.trim("region").alias("region"))
    era = reshape.right_closed(F.col("year"), [1989, 2001, 2013, 2025], ["1990-2001", "2002-2013", "2014-2025"])
    band = F.when(F.col("trust") < 0.2, "low").when(F.col("trust") < 0.4, "middle").otherwise("high")
    rows = ranked.withColumn("era", era).withColumn("band", band).where("era is not null").join(regions, "entity_id")
    picks = windows.balanced_sample(rows, ["era", "band"], "row_id", "region", "r1")
    return spark.createDataFrame(picks, "era string, band string, row_id long, region string")


@query("""SELECT row_id, CASE WHEN year > 1989 AND year <= 2001 THEN '1990-2001' WHEN year > 2001 AND year <= 2013 THEN '2002-2013' WHEN year > 2013 AND year <= 2025 THEN '2014-2025' END AS era FROM modelling_rows""")
def bin_right_closed(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "modelling_rows").select("row_id", reshape.right_closed(F.col("year"), [1989, 2001, 2013, 2025], ["1990-2001", "2002-2013", "2014-2025"]).alias("era"))


@query("""SELECT status, main, count(*) AS n_rows, count(DISTINCT k) AS codes FROM (SELECT trim(s.iso_code) AS k, CASE WHEN trim(s.iso_code) = 'EU' THEN 'excluded_non_state' WHEN trim(s.iso_code) = 'VAT' THEN 'excluded_observer_no_sipri'
WHEN trim(s.iso_code) = 'PSE' THEN 'sensitivity_observer' WHEN trim(s.iso_code) IN ('CSK', 'DDR', 'YUG', 'YMD', 'SUN', 'BYSSR', 'UASSR') THEN 'excluded_historical' WHEN r.entity_id IS NOT NULL THEN 'main_un_member' ELSE 'unresolved_iso' END AS status,
status = 'main_un_member' AS main FROM speakers_by_session s LEFT JOIN region_income_snapshot r ON r.entity_id = trim(s.iso_code) WHERE s.iso_code IS NOT NULL) GROUP BY 1, 2""")
def entity_status_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Codes of the speaker rows by status; the code list is joined after the codes are counted."""
    codes = table(spark, folder, "speakers_by_session").where("iso_code is not null").groupBy(F.trim("iso_code").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    listed = table(spark, folder, "region_income_snapshot").select(F.col("entity_id").alias("k"), F.lit(True).alias("listed"))
    rows = codes.join(listed, "k", "left").withColumn("status", entity_status(F.col("k"), F.lit(None).cast("string"), F.coalesce("listed", F.lit(False))))
    return rows.withColumn("main", main_population(F.col("status"))).groupBy("status", "main").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("codes"))


@query(r"""SELECT post_group, count(*) AS n_rows FROM (SELECT CASE WHEN post IS NULL OR trim(post) = '' THEN 'unknown'
WHEN regexp_matches(p, '\b(prime minister|head of government|chancellor)\b') THEN 'head_of_government' WHEN regexp_matches(p, '\b(president|king|queen|emir|amir|prince|head of state)\b') THEN 'head_of_state'
WHEN regexp_matches(p, '\b(foreign affairs|external affairs|foreign minister)\b') THEN 'foreign_minister' WHEN regexp_matches(p, '\b(representative|delegation|ambassador)\b') THEN 'representative' ELSE 'other' END AS post_group
FROM (SELECT post, trim(regexp_replace(lower(strip_accents(post)), '[^a-z0-9]+', ' ', 'g')) AS p FROM speakers_by_session)) GROUP BY 1""")
def text_post_group(spark: SparkSession, folder: str) -> DataFrame:
    """Rows by group of post; each post is classified once."""
    posts = table(spark, folder, "speakers_by_session").groupBy("post").agg(F.count(F.lit(1)).alias("n"))
    return posts.withColumn("post_group", post_group(F.col("post"))).groupBy("post_group").agg(F.sum("n").alias("n_rows"))




@query("""WITH e AS (SELECT entity_id, year, speech_no, max(sha256(speech_clean)) AS expected_hash FROM speeches WHERE deleted_at IS NULL AND speech_clean IS NOT NULL GROUP BY 1, 2, 3),
s AS (SELECT trim(entity_id) AS entity_id, year, speech_no, text_hash, trust_score, threat_score, json_extract_string(payload, '$.spec_hash') AS spec_hash, CAST(json_extract(payload, '$.token_coverage') AS DOUBLE) AS token_coverage,
CAST(json_extract(payload, '$.tokens_scored') AS INTEGER) AS tokens_scored, CAST(json_extract(payload, '$.model_token_count') AS INTEGER) AS model_token_count FROM scores WHERE json_valid(payload)),
j AS (SELECT e.expected_hash, s.* FROM e LEFT JOIN s ON s.entity_id = e.entity_id AND s.year = e.year AND s.speech_no = e.speech_no)
SELECT unnest(['missing', 'stale', 'wrong_specification', 'incomplete_coverage', 'token_counts_differ', 'score_out_of_range']) AS rule, unnest([count(*) FILTER (text_hash IS NULL), count(*) FILTER (text_hash IS NOT NULL AND coalesce(expected_hash <> text_hash, true)),
count(*) FILTER (text_hash IS NOT NULL AND coalesce(spec_hash <> '2e47289bc38fc584af29a86da0eaa1795f53a7fe925b4b029a6abde544cf06f5', true)), count(*) FILTER (text_hash IS NOT NULL AND coalesce(token_coverage <> 1, true)),
count(*) FILTER (text_hash IS NOT NULL AND coalesce(tokens_scored <> model_token_count, true)), count(*) FILTER (text_hash IS NOT NULL AND coalesce(NOT (trust_score BETWEEN 0 AND 1 AND threat_score BETWEEN 0 AND 1), true))]) AS n_rows FROM j""")
def validate_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Rules that the score cache breaks, counted in one pass."""
    keys = ["entity_id", "year", "speech_no"]
    speeches = table(spark, folder, "speeches").where("deleted_at is null and speech_clean is not null")
    expected = quality.expected_hashes(speeches, keys, "speech_clean").groupBy(*keys).agg(F.max("expected_hash").alias("expected_hash"))
    cache = table(spark, folder, "scores").withColumn("p", reshape.payload(F.col("payload"))).where("p is not null and p.text_hash is not null")
    cache = cache.select(F.trim("entity_id").alias("entity_id"), "year", "speech_no", "text_hash", "trust_score", "threat_score", "p.spec_hash", "p.token_coverage", "p.tokens_scored", "p.model_token_count")
    return quality.violations(expected.join(cache, keys, "left"), quality.score_rules(SPEC_HASH))


SPEC_HASH = "2e47289bc38fc584af29a86da0eaa1795f53a7fe925b4b029a6abde544cf06f5"


@query("""SELECT DISTINCT s.entity_id, s.year, s.speech_no FROM speeches s WHERE s.deleted_at IS NULL AND s.speech_clean IS NOT NULL AND NOT EXISTS (SELECT 1 FROM scores c WHERE trim(c.entity_id) = s.entity_id AND c.year = s.year AND c.speech_no = s.speech_no)""")
def resume_pending(spark: SparkSession, folder: str) -> DataFrame:
    """Speeches that the score cache does not have."""
    from quern.streaming.scoring import pending

    keys = ["entity_id", "year", "speech_no"]
    inputs = table(spark, folder, "speeches").where("deleted_at is null and speech_clean is not null").select(*keys).distinct()
    return pending(inputs, table(spark, folder, "scores").withColumn("entity_id", F.trim("entity_id")), keys)


@query(f"""SELECT score_id, round(sum(trust * tokens) / sum(tokens), 9) AS trust, round(sum(threat * tokens) / sum(tokens), 9) AS threat, count(*) AS chunk_count, min(tokens) AS chunk_tokens_min,
quantile_cont(CAST(tokens AS DOUBLE), 0.5) AS chunk_tokens_median, max(tokens) AS chunk_tokens_max, CAST(sum(tokens) AS BIGINT) AS tokens_scored FROM ({_CHUNKS}) WHERE tokens > 0 AND trust BETWEEN 0 AND 1 AND threat BETWEEN 0 AND 1 GROUP BY 1""")
def weighted_mean_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of payloads from their chunks, weighted by tokens; chunks that break the rules are left out here."""
    from quern.streaming.scoring import weighted_scores

    chunks = posexplode_chunks(spark, folder).where("tokens > 0 and trust between 0 and 1 and threat between 0 and 1")
    out = weighted_scores(chunks, ["score_id"], ["trust", "threat"])
    return out.withColumns({c: F.round(c, 9) for c in ("trust", "threat")})


_MEANS = "score_id, round(sum(trust * tokens) / sum(tokens), 9) AS trust, round(sum(threat * tokens) / sum(tokens), 9) AS threat, min(tokens) AS chunk_tokens_min, quantile_cont(CAST(tokens AS DOUBLE), 0.5) AS chunk_tokens_median, max(tokens) AS chunk_tokens_max, CAST(sum(tokens) AS BIGINT) AS tokens_scored"


@query(f"""WITH ch AS ({_CHUNKS}), per AS (SELECT score_id, count(*) AS n_chunks, count(*) FILTER (NOT coalesce(tokens > 0 AND trust BETWEEN 0 AND 1 AND threat BETWEEN 0 AND 1, false)) AS n_bad_chunks FROM ch GROUP BY 1),
m AS (SELECT {_MEANS} FROM ch WHERE score_id IN (SELECT score_id FROM per WHERE n_bad_chunks = 0) GROUP BY 1) SELECT per.score_id, CASE WHEN n_bad_chunks > 0 THEN 'bad_chunk' ELSE 'scored' END AS status, n_chunks, n_bad_chunks, m.* EXCLUDE (score_id) FROM per LEFT JOIN m USING (score_id)""")
def weighted_mean_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """Payloads with chunks and their status; one chunk that breaks the rules or lacks a value leaves all means null."""
    from quern.streaming.scoring import weighted_scores

    chunks = posexplode_chunks(spark, folder)
    good = F.expr("coalesce(tokens > 0 and trust between 0 and 1 and threat between 0 and 1, false)")
    per = chunks.groupBy("score_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.count_if(~good).alias("n_bad_chunks"))
    out = weighted_scores(chunks.join(per.where("n_bad_chunks = 0"), "score_id", "left_semi"), ["score_id"], ["trust", "threat"])
    status = F.when(F.col("n_bad_chunks") > 0, "bad_chunk").otherwise("scored").alias("status")
    out = out.drop("chunk_count").withColumns({c: F.round(c, 9) for c in ("trust", "threat")})
    return per.select("score_id", status, "n_chunks", "n_bad_chunks").join(out, "score_id", "left")


@query(f"""SELECT c.score_id, c.chunk_no, substring(s.speech_clean, c.s + 1, c.e - c.s) AS passage FROM ({_CHUNKS}) c JOIN (SELECT entity_id, year, speech_no, min(speech_id) AS speech_id FROM speeches WHERE speech_clean IS NOT NULL GROUP BY 1, 2, 3) k
ON k.entity_id = c.entity_id AND k.year = c.year AND k.speech_no = c.speech_no JOIN speeches s ON s.speech_id = k.speech_id""")
def chunk_passages(spark: SparkSession, folder: str) -> DataFrame:
    """The text of each chunk, cut from its speech by character; the first row of a speech's key is taken."""
    keys = ["entity_id", "year", "speech_no"]
    scores = table(spark, folder, "scores").select("score_id", F.trim("entity_id").alias("entity_id"), "year", "speech_no", reshape.payload(F.col("payload")).alias("p"))
    speeches = table(spark, folder, "speeches").where("speech_clean is not null")
    # ids are grouped and joined first; only the texts that are cut are moved
    first = speeches.groupBy(*keys).agg(F.min("speech_id").alias("speech_id"))
    wanted = scores.where("p.chunks is not null").select("score_id", *keys, F.col("p.chunks").alias("chunks")).join(first, keys).select("score_id", "speech_id", "chunks")
    joined = wanted.join(speeches.select("speech_id", "speech_clean"), "speech_id")
    return reshape.passages(joined, "speech_clean", "chunks").select("score_id", "chunk_no", "passage")


@query("""SELECT c.entity_id, coalesce(m.name, r.country_name, c.entity_id) AS display_name FROM (SELECT DISTINCT trim(iso_code) AS entity_id FROM speakers_by_session WHERE trim(iso_code) <> '') c LEFT JOIN region_income_snapshot r USING (entity_id)
LEFT JOIN (VALUES ('KOR', 'Korea, South'), ('BRN', 'Brunei'), ('SUN', 'Soviet Union')) m(entity_id, name) USING (entity_id)""")
def display_names(spark: SparkSession, folder: str) -> DataFrame:
    from quern.functions.entity import display_name

    codes = table(spark, folder, "speakers_by_session").select(F.trim("iso_code").alias("entity_id")).where("entity_id <> ''").distinct()
    return display_name(codes, "entity_id", table(spark, folder, "region_income_snapshot")).select("entity_id", "display_name")


def _swapped(rows: DataFrame) -> DataFrame:
    """Both conditions look at the code as it came; rows outside the mask are unchanged."""
    swap = rows.sparkSession.createDataFrame([("EHR", 1995, "HRE"), ("HRE", 1995, "EHR")], "iso_code string, year int, corrected string")
    out = rows.join(F.broadcast(swap), ["iso_code", "year"], "left")
    return out.withColumn("iso_code", F.coalesce("corrected", "iso_code")).select(*rows.columns)


@query("""SELECT * REPLACE (CASE WHEN year = 1995 AND iso_code = 'EHR' THEN 'HRE' WHEN year = 1995 AND iso_code = 'HRE' THEN 'EHR' ELSE iso_code END AS iso_code) FROM speakers_by_session""")
def conditional_update_all(spark: SparkSession, folder: str) -> DataFrame:
    """All speaker rows and columns, with two codes of 1995 swapped."""
    return _swapped(table(spark, folder, "speakers_by_session"))


@query(f"WITH {base.CONFLICTS}, {base.CELLS} SELECT entity_id, year FROM cells c WHERE EXISTS (SELECT 1 FROM conf w WHERE w.entity_id = c.entity_id AND w.year = c.year)")
def semi_membership(spark: SparkSession, folder: str) -> DataFrame:
    """Cells with conflict."""
    return base.cells(spark, folder).select("entity_id", "year").join(base.conflicts(spark, folder).select("entity_id", "year"), ["entity_id", "year"], "left_semi")


@query("SELECT k.speaker_row_id, s.n_speeches FROM speakers_by_session k LEFT JOIN (SELECT entity_id, year, count(*) AS n_speeches FROM speeches GROUP BY 1, 2) s ON s.entity_id = k.iso_code AND s.year = k.year")
def update_all_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Every metadata row of a key gets what its speeches give."""
    speeches = table(spark, folder, "speeches").groupBy(F.col("entity_id").alias("iso_code"), "year").agg(F.count(F.lit(1)).alias("n_speeches"))
    rows = table(spark, folder, "speakers_by_session").select("speaker_row_id", "iso_code", "year")
    return relational.join_checked(rows, speeches, ["iso_code", "year"], "left", "many_to_one").select("speaker_row_id", "n_speeches")


@query("SELECT speaker_post_group, count(*) AS n_rows, count(DISTINCT entity_id) AS n_countries, round(avg(speech_token_count), 6) AS mean_tokens, max(speech_token_count) AS most_tokens FROM modelling_rows GROUP BY 1")
def value_counts(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "modelling_rows").groupBy("speaker_post_group")
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("entity_id").alias("n_countries"), F.round(F.avg("speech_token_count"), 6).alias("mean_tokens"), F.max("speech_token_count").alias("most_tokens"))


@query("SELECT DISTINCT entity_id, year FROM modelling_rows WHERE entity_id IS NOT NULL")
def distinct_keys(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "modelling_rows").select("entity_id", "year").where("entity_id is not null").distinct()


@query("""SELECT entity_id, year, speech_no FROM (SELECT DISTINCT entity_id, year, speech_no FROM speeches s WHERE s.deleted_at IS NULL AND s.speech_clean IS NOT NULL AND NOT EXISTS
(SELECT 1 FROM scores c WHERE trim(c.entity_id) = s.entity_id AND c.year = s.year AND c.speech_no = s.speech_no)) ORDER BY year, entity_id, speech_no LIMIT 8""")
def pending_queue(spark: SparkSession, folder: str) -> DataFrame:
    """The next batch to score: the first eight pending keys in order."""
    return resume_pending(spark, folder).orderBy("year", "entity_id", "speech_no").limit(8)


@query("""SELECT count(*) AS n_rows, count(*) FILTER (milex_status_t <> 'observed' AND milex_share_gdp_t IS NOT NULL) AS spending_unobserved, count(*) FILTER (milex_status_t = 'observed' AND milex_share_gdp_t IS NULL) AS observed_missing,
count(*) FILTER (trust_score IS NULL) AS trust_missing, count(*) FILTER (isnan(trust_score)) AS trust_nan FROM modelling_rows""")
def missingness_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Missing is not zero: what is missing, and whether status and value agree."""
    rows = table(spark, folder, "modelling_rows")
    observed = F.col("milex_status_t") == "observed"
    return rows.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(~observed & F.col("milex_share_gdp_t").isNotNull()).alias("spending_unobserved"), F.count_if(observed & F.col("milex_share_gdp_t").isNull()).alias("observed_missing"),
        F.count_if(F.col("trust_score").isNull()).alias("trust_missing"), F.count_if(F.isnan("trust_score")).alias("trust_nan"),
    )


@query("""SELECT name, CAST(sum(u) AS BIGINT) AS in_conflicts, CAST(sum(m) AS BIGINT) AS in_spending, CAST(max(l) AS INTEGER) AS listed FROM (SELECT source_name AS name, 1 AS u, 0 AS m, 0 AS l FROM ucdp_country_crosswalk
UNION ALL SELECT source_name, 0, 1, 0 FROM sipri_country_crosswalk UNION ALL SELECT country_name, 0, 0, 1 FROM region_income_snapshot) WHERE name IS NOT NULL GROUP BY 1""")
def name_accounting(spark: SparkSession, folder: str) -> DataFrame:
    """How often each name occurs in the two sources, and whether the list has it."""
    parts = [
        table(spark, folder, t).select(F.col(c).alias("name"), *[F.lit(int(i == k)).alias(n) for k, n in enumerate(("u", "m", "l"))])
        for i, (t, c) in enumerate((("ucdp_country_crosswalk", "source_name"), ("sipri_country_crosswalk", "source_name"), ("region_income_snapshot", "country_name")))
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).where("name is not null").groupBy("name")
    return rows.agg(F.sum("u").alias("in_conflicts"), F.sum("m").alias("in_spending"), F.max("l").alias("listed"))

"""Queries on packed fields and orphan references, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.orphans import find_orphans, orphan_report
from quern.operators.packed import MAX_NAMES, split_packed
from quern.session import table


def _reference_names(spark: SparkSession, folder: str) -> list[str]:
    """The fixed reference list; one row more than the bound is asked for, so that the operator can refuse it."""
    rows = table(spark, folder, "region_income_snapshot").select("country_name").where("country_name is not null").distinct().limit(MAX_NAMES + 1).collect()
    return sorted(r[0] for r in rows)


def _split(spark: SparkSession, folder: str) -> DataFrame:
    episodes = table(spark, folder, "ucdp_conflicts").select("episode_id", "location").where("location is not null")
    return split_packed(episodes, "location", names=_reference_names(spark, folder), value="label", count="n_labels")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Labels of the episodes that name two places or more."""
    return _split(spark, folder).where("n_labels >= 2").select("episode_id", "pos", "label")


def p2_places(spark: SparkSession, folder: str) -> DataFrame:
    """Labels of all episodes."""
    return _split(spark, folder).select("episode_id", "pos", "label", "n_labels")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Orphan references of speaker rows and scores."""
    speakers = table(spark, folder, "speakers_by_session")
    entities, sessions, speeches, scores = (table(spark, folder, t) for t in ("region_income_snapshot", "sessions", "speeches", "scores"))
    times = {"ref_received": "received_at", "parent_received": "received_at", "parent_deleted": "deleted_at"}
    parts = [
        ("speakers_by_session", "iso_code", "speaker_row_id", find_orphans(speakers, entities, row_id="speaker_row_id", ref_keys=["iso_code"], parent_keys=["entity_id"], carry=["year"], **times)),
        ("speakers_by_session", "session", "speaker_row_id", find_orphans(speakers, sessions, row_id="speaker_row_id", ref_keys=["session"], parent_keys=["session"], carry=["year"], **times)),
        ("scores", "entity_id", "score_id", find_orphans(scores, speeches, row_id="score_id", ref_keys=["entity_id", "year", "speech_no"], parent_keys=["entity_id", "year", "speech_no"], carry=["year"], **times)),
    ]
    out = None
    for name, field, row_id, found in parts:
        rows = found.select(F.lit(name).alias("ref_table"), F.lit(field).alias("ref_field"), F.col(row_id).alias("row_id"), F.col("year").alias("ref_year"), "reason")
        out = rows if out is None else out.unionByName(rows)
    return out


def p4_report(spark: SparkSession, folder: str) -> DataFrame:
    """Orphans counted per table, field, year and reason."""
    return orphan_report(p4_found(spark, folder), "ref_year")


QUERIES = {"p2_found": p2_found, "p2_places": p2_places, "p4_found": p4_found, "p4_report": p4_report}

_P4 = """
WITH refs AS (
  SELECT 'speakers_by_session' AS ref_table, 'iso_code' AS ref_field, speaker_row_id AS row_id, year AS ref_year, trim(iso_code, ' ') AS k, received_at FROM speakers_by_session WHERE trim(iso_code, ' ') <> ''
  UNION ALL SELECT 'speakers_by_session', 'session', speaker_row_id, year, CAST(session AS VARCHAR), received_at FROM speakers_by_session WHERE session IS NOT NULL
  UNION ALL SELECT 'scores', 'entity_id', score_id, year, trim(entity_id, ' ') || '|' || year || '|' || speech_no, received_at FROM scores WHERE trim(entity_id, ' ') <> '' AND year IS NOT NULL AND speech_no IS NOT NULL
), parents AS (
  SELECT 'iso_code' AS ref_field, trim(entity_id, ' ') AS k, min(received_at) AS born, min(deleted_at) AS gone FROM region_income_snapshot GROUP BY 1, 2
  UNION ALL SELECT 'session', CAST(session AS VARCHAR), min(received_at), min(deleted_at) FROM sessions GROUP BY 1, 2
  UNION ALL SELECT 'entity_id', trim(entity_id, ' ') || '|' || year || '|' || speech_no, min(received_at), min(deleted_at) FROM speeches GROUP BY 1, 2
), found AS (
  SELECT r.ref_table, r.ref_field, r.row_id, r.ref_year,
         CASE WHEN p.k IS NULL THEN 'missing' WHEN p.gone <= r.received_at THEN 'deleted' WHEN p.born > r.received_at THEN 'late' END AS reason
  FROM refs r LEFT JOIN parents p ON p.ref_field = r.ref_field AND p.k = r.k
)
"""

#: SQL looks for names where the operator looks for delimiters: those of the list, and those that stand alone in a field.
_P2 = r"""
WITH names AS (SELECT country_name AS n FROM region_income_snapshot WHERE country_name IS NOT NULL UNION SELECT DISTINCT trim(location) FROM ucdp_conflicts WHERE regexp_matches(location, '^[^,;|/&"''、\[\]{}\n\t]*\p{L}[^,;|/&"''、\[\]{}\n\t]*$') AND NOT regexp_matches(location, '\band\b')),
pattern AS (SELECT string_agg(regexp_escape(n), '|' ORDER BY length(n) DESC, n) AS p FROM names WHERE n <> ''),
x AS (SELECT episode_id, regexp_extract_all(location, p) AS a FROM ucdp_conflicts, pattern WHERE location IS NOT NULL)
SELECT episode_id, CAST(generate_subscripts(a, 1) AS INTEGER) AS pos, unnest(a) AS label FROM x WHERE len(a) >= 2
"""

ORACLE = {
    "p2_found": _P2,
    "p4_found": _P4 + "SELECT ref_table, ref_field, row_id, ref_year, reason FROM found WHERE reason IS NOT NULL",
    "p4_report": _P4 + "SELECT ref_table, ref_field, ref_year, reason, count(*) AS orphans FROM found WHERE reason IS NOT NULL GROUP BY 1, 2, 3, 4",
}

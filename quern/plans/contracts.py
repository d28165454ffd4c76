"""Queries on sources, sinks, checked joins and contracts: what is written to the shared folder and read back is compared."""

from __future__ import annotations

import json
import sqlite3
import uuid
import zipfile
from collections.abc import Callable, Iterable
from pathlib import Path
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import text
from quern.operators import quality, relational, reshape, windows
from quern.plans import base
from quern.session import ensure_checkpoint_dir, table
from quern.sources import connectors, sinks, text_tree
from quern.streaming import scoring

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


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _local(path: str) -> Path:
    """The same as a path of the file system; workbooks and databases are single files that are opened as such."""
    found = Path(path.removeprefix("file://").removeprefix("file:"))
    found.parent.mkdir(parents=True, exist_ok=True)
    return found


# -- sources -----------------------------------------------------------------------------------------------------

_FILES = """files AS (SELECT speech_id, '/data/' || speech_path AS path, CASE WHEN speech_clean IS NULL THEN true ELSE false END AS broken FROM speeches WHERE speech_path IS NOT NULL),
parts AS (SELECT *, regexp_extract(path, '/Session (\\d{2}) - (\\d{4})/[^/]*$', 1) AS fs, regexp_extract(path, '/Session (\\d{2}) - (\\d{4})/[^/]*$', 2) AS fy, regexp_extract(path, '/([A-Z]{2,3})_(\\d{1,2})_(\\d{4})\\.txt$', 1) AS iso,
regexp_extract(path, '/([A-Z]{2,3})_(\\d{1,2})_(\\d{4})\\.txt$', 2) AS s, regexp_extract(path, '/([A-Z]{2,3})_(\\d{1,2})_(\\d{4})\\.txt$', 3) AS y FROM files),
judged AS (SELECT *, CASE WHEN fs = '' THEN 'folder name' WHEN iso = '' THEN 'file name' WHEN CAST(fs AS INT) <> CAST(s AS INT) OR CAST(fy AS INT) <> CAST(y AS INT) THEN 'folder and file disagree' WHEN broken THEN 'not UTF-8' END AS reason FROM parts)"""


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """The speeches as files; those without a text have bytes that are no text."""
    rows = table(spark, folder, "speeches").where("speech_path is not null")
    return rows.select(F.concat(F.lit("/data/"), "speech_path").alias("path"), F.coalesce(F.encode("speech_clean", "UTF-8"), F.unhex(F.lit("FFFE00"))).alias("content"))


@query(f"WITH {_FILES} SELECT iso AS source_iso, CAST(s AS INT) AS session, CAST(y AS INT) AS year, count(*) AS n_files FROM judged WHERE reason IS NULL GROUP BY 1, 2, 3")
def source_tree_accepted(spark: SparkSession, folder: str) -> DataFrame:
    """Files by the keys in their paths."""
    good = text_tree.accepted(text_tree.judge_files(_files(spark, folder)))
    return good.groupBy("source_iso", "session", "year").agg(F.count(F.lit(1)).alias("n_files"))


@query(f"WITH {_FILES} SELECT path AS speech_path, reason, count(*) AS n_files FROM judged WHERE reason IS NOT NULL GROUP BY 1, 2")
def source_tree_rejected(spark: SparkSession, folder: str) -> DataFrame:
    """Files set aside, with the reason."""
    judged = text_tree.judge_files(_files(spark, folder)).where("reason is not null")
    return judged.groupBy("speech_path", "reason").agg(F.count(F.lit(1)).alias("n_files"))


@query("""SELECT CASE WHEN len(p) = 3 AND TRY_CAST(p[2] AS INT) IS NOT NULL AND TRY_CAST(p[3] AS INT) IS NOT NULL THEN 'matched' ELSE 'skipped' END AS outcome, count(*) AS files
FROM (SELECT string_split(regexp_replace(string_split(speech_path, '/')[-1], '\\.txt$', ''), '_') AS p FROM speeches WHERE speech_path IS NOT NULL) GROUP BY 1""")
def source_lenient(spark: SparkSession, folder: str) -> DataFrame:
    """File names in three parts with two numbers, and others."""
    return text_tree.count_lenient(_files(spark, folder).select("path"))


_CSV = "entry_id long, source_name string, entity_id string, country_name string, valid_from int, valid_to int, mapping_rationale string, exclusion_status string"
_COLUMNS = ", ".join(c.split()[0] for c in _CSV.split(", "))


@query(f"SELECT {_COLUMNS} FROM ucdp_country_crosswalk")
def source_csv(spark: SparkSession, folder: str) -> DataFrame:
    """A crosswalk written as CSV by several tasks and read back with its schema."""
    path = scratch(spark, "csv")
    table(spark, folder, "ucdp_country_crosswalk").select(*_COLUMNS.split(", ")).write.options(**sinks.CSV).csv(path)
    return connectors.read_csv(spark, path, _CSV)


@query("SELECT entity_id, region, iso2 FROM region_income_snapshot")
def sink_result(spark: SparkSession, folder: str) -> DataFrame:
    """A small result as one CSV file, and back; blanks at the ends of cells are kept."""
    path = scratch(spark, "result")
    sinks.write_result(table(spark, folder, "region_income_snapshot").select("entity_id", "region", "iso2"), path)
    return connectors.read_csv(spark, path, "entity_id string, region string, iso2 string")


def _workbook(path: Path, rows: Iterable[list[object]]) -> None:
    """A workbook of one sheet; numbers as numbers, text inline, None as no cell. Rows are written as they come."""
    head = '<?xml version="1.0" encoding="UTF-8"?>'
    main, links = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{links}"><sheets><sheet name="Share of GDP" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{links}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        with z.open("xl/worksheets/sheet1.xml", "w") as f:
            f.write(f'{head}<worksheet xmlns="{main}"><sheetData>'.encode())
            for n, row in enumerate(rows, 1):
                cells = []
                for i, v in enumerate(row):
                    at = ""
                    while i >= 0:
                        at, i = chr(65 + i % 26) + at, i // 26 - 1
                    if isinstance(v, int | float):
                        cells.append(f'<c r="{at}{n}"><v>{v!r}</v></c>')
                    elif v is not None:
                        cells.append(f'<c r="{at}{n}" t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>')
                f.write(f'<row r="{n}">{"".join(cells)}</row>'.encode())
            f.write(b"</sheetData></worksheet>")


#: Most rows of the fixed reference list that are put into a single file.
MAX_LISTED = 100_000
_YEARS = ("2001", "2002", "2003")


def _listed(spark: SparkSession, folder: str, name: str, columns: str) -> list:
    """Rows of a fixed reference table, checked to be few."""
    rows = table(spark, folder, name).select(*columns.split()).limit(MAX_LISTED + 1).collect()
    if len(rows) > MAX_LISTED:
        raise ValueError(f"{name} has over {MAX_LISTED} rows")
    return rows


_SHEET = """cells AS (SELECT country_name, year, CASE (length(country_name) + year) % 5 WHEN 0 THEN 'xxx' WHEN 1 THEN '...' WHEN 2 THEN '. .' WHEN 3 THEN NULL END AS marker,
CASE WHEN (length(country_name) + year) % 5 = 4 THEN length(country_name) / 8.0 END AS value FROM region_income_snapshot, (SELECT unnest([2001, 2002, 2003]) AS year) WHERE country_name IS NOT NULL)"""


@query(f"""WITH {_SHEET} SELECT country_name, CAST(year AS INT) AS year, CAST(value AS DOUBLE) AS value, CASE WHEN value IS NOT NULL THEN 'observed' WHEN marker = 'xxx' THEN 'not_independent_or_nonexistent' WHEN marker IS NOT NULL THEN 'unavailable' ELSE 'blank' END AS status
FROM cells WHERE country_name IN (SELECT country_name FROM cells WHERE marker IS NOT NULL OR value IS NOT NULL)""")
def source_sheet(spark: SparkSession, folder: str) -> DataFrame:
    """A sheet with rows before its header, region headings, numbers and markers: read, checked, made long, with a status."""
    path = _local(scratch(spark, "sheet") + ".xlsx")
    names = sorted(r[0] for r in _listed(spark, folder, "region_income_snapshot", "country_name") if r[0])
    cell = lambda n, y: {0: "xxx", 1: "...", 2: ". .", 3: None, 4: len(n) / 8.0}[(len(n) + y) % 5]
    rows = [["Title"], [], ["Source"], [], [], ["Country", "Notes", *_YEARS], ["A region"], *[[n, None, *[cell(n, int(y)) for y in _YEARS]] for n in names]]
    _workbook(path, rows)
    connectors.register(spark)
    sheet = spark.read.format("xlsx").option("path", str(path)).option("sheet", "Share of GDP").option("header", 5).option("typed", "true").load()
    quality.require_columns(sheet, ["Country", *_YEARS])
    filled = sheet.where(F.coalesce(*[F.col(f"`{y}`") for y in _YEARS]).isNotNull()).withColumn("country_name", F.substring("Country", 3, 1000))
    long = reshape.long_form(filled.select("country_name", *[f"`{y}`" for y in _YEARS]), ["country_name"], list(_YEARS), "year", "cell")
    status = reshape.cell_status(F.substring("cell", 3, 1000), F.coalesce(F.col("cell").startswith("n:"), F.lit(False)))
    return long.select("country_name", F.col("year").cast("int").alias("year"), F.expr("try_cast(substring(cell, 3) as double)").alias("value"), status.alias("status"))


@query("SELECT session, session_year, title FROM sessions")
def source_sqlite(spark: SparkSession, folder: str) -> DataFrame:
    """JSON payloads in a database file, read in ranges and parsed."""
    path = _local(scratch(spark, "database") + ".db")
    rows = _listed(spark, folder, "sessions", "session session_year title")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE rows (session INTEGER PRIMARY KEY, payload TEXT)")
        db.executemany("INSERT INTO rows VALUES (?, ?)", [(r[0], json.dumps(r.asDict())) for r in rows])
    connectors.register(spark)
    found = spark.read.format("sqlite").option("path", str(path)).option("dbtable", "rows").option("numPartitions", 4).load()
    return found.select(F.from_json("payload", "session int, session_year int, title string").alias("p")).select("p.*")


_LEVELS = base.TRANSITIONS


# -- sinks -------------------------------------------------------------------------------------------------------


@query(f"WITH {base.PANEL} SELECT * FROM panel")
def sink_table(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch(spark, "panel")
    sinks.write_table(base.panel(spark, folder), path)
    return spark.read.parquet(path)


_SETTINGS = {"budget": 480, "labels": ["trust", "threat"], "years": [1990, 2025]}


@query(f"SELECT sha256('{json.dumps(_SETTINGS, sort_keys=True)}') AS settings_hash, (SELECT count(*) FROM speeches) AS n_speeches, (SELECT count(*) FROM scores) AS n_scores")
def sink_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The record of a run: rows, settings and their canonical hash, written and read back."""
    path = _local(scratch(spark, "manifest") + ".json")
    rows = {t: table(spark, folder, t).count() for t in ("speeches", "scores")}
    sinks.write_manifest(path, sources=[], rows=rows, fingerprint="", settings=dict(reversed(_SETTINGS.items())))
    read = spark.read.json(str(path), multiLine=True)
    return read.select("settings_hash", F.col("rows.speeches").alias("n_speeches"), F.col("rows.scores").alias("n_scores"))


_HASHED = "SELECT speech_id, sha256(speech_clean) AS text_hash, sha256('{\"budget\": 480}') AS spec_hash FROM speeches WHERE length(speech_clean) > 0"


@query(_HASHED + " AND speech_id IN (SELECT speech_id FROM speeches WHERE regexp_matches(speech_clean, '[^\\s\\p{Z}\\x{85}]'))")
def sink_cache(spark: SparkSession, folder: str) -> DataFrame:
    """The score cache: the texts of early years in one run, then all that are left in a second, which finds the first's."""
    path, spec = scratch(spark, "scores"), sinks.canonical_hash({"budget": 480})
    rows = table(spark, folder, "speeches").select("speech_id", "year", "speech_clean").where("length(speech_clean) > 0")
    for part in (rows.where("year <= 2005"), rows):
        todo = scoring.to_score(part, scoring.open_cache(spark, path, spec), ["speech_id"], "speech_clean")
        scoring.scored(todo, ["speech_id"], "speech_clean", spec).write.mode("append").parquet(path)
    return spark.read.parquet(path).select("speech_id", "text_hash", "spec_hash")


@query("""SELECT speaker_post_group, row_id, pick FROM (SELECT speaker_post_group, row_id, CAST(row_number() OVER (PARTITION BY speaker_post_group ORDER BY md5('w1' || row_id)) AS INTEGER) AS pick FROM modelling_rows) WHERE pick <= 3""")
def sink_write_once(spark: SparkSession, folder: str) -> DataFrame:
    """A review sheet that is written once; the second run is about the same rows and leaves it as it is."""
    path = scratch(spark, "review")
    rows = table(spark, folder, "modelling_rows").select("speaker_post_group", "row_id")
    sheet = windows.hash_sample(rows, ["speaker_post_group"], F.col("row_id").cast("string"), 3, "w1").select("speaker_post_group", "row_id", "pick")
    sinks.write_once(sheet, path, ["row_id"])
    return sinks.write_once(sheet, path, ["row_id"])


@query("SELECT '## ' || title AS heading FROM sessions WHERE title IS NOT NULL")
def sink_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """Headings of the fixed list of sessions, exported and read back."""
    path = _local(scratch(spark, "review") + ".md")
    sinks.write_markdown(table(spark, folder, "sessions").where("title is not null").select("title", F.col("session_year").alias("text")), path, "title", "text")
    return spark.read.text(str(path)).where(F.col("value").startswith("## ")).select(F.col("value").alias("heading"))


_DRAWN = f"""WITH {base.PASSAGES}, y AS (SELECT year, avg(trust) AS m, avg(milex) AS x FROM pass GROUP BY 1), b AS (SELECT DISTINCT transition FROM pass WHERE transition IS NOT NULL AND threat IS NOT NULL)
SELECT unnest(['trends', 'trends', 'trends', 'spending', 'transitions', 'distribution', 'correlations']) AS figure, unnest(['band', 'line', 'step', 'points', 'bars', 'boxes', 'heat']) AS layer,
unnest([(SELECT count(*) FROM y WHERE m IS NOT NULL), (SELECT count(*) FROM y WHERE m IS NOT NULL), (SELECT count(*) FROM y WHERE m IS NOT NULL), (SELECT count(*) FROM y WHERE x IS NOT NULL), (SELECT count(DISTINCT transition) FROM pass), (SELECT count(*) FROM b), 9]) AS n_points"""


@query(_DRAWN)
def sink_figures(spark: SparkSession, folder: str) -> DataFrame:
    """Figures of the descriptive tables, written and read back: what each layer shows."""
    from quern.operators import stats
    from quern.sources.figures import Figure, rows_of, symlog

    rows = base.passages(spark, folder)
    years = rows.groupBy("year").agg(F.avg("trust").alias("m"), F.stddev_samp("trust").alias("s"), F.avg("milex").alias("x"))
    drawn = rows_of(years, "year", "m", "s", "x")
    trends = Figure("Trust by year", "year", "mean").add("band", [(y, m and m - (s or 0), m and m + (s or 0)) for y, m, s, _ in drawn], "one deviation").add("line", [(y, m) for y, m, _, _ in drawn], "mean").add("step", [(y, m) for y, m, _, _ in drawn])
    spending = Figure("Spending by year", "year", "share of product", symlog).add("points", [(y, x) for y, _, _, x in drawn])
    levels = list(_LEVELS)
    counts = rows_of(rows.groupBy("transition").agg(F.count(F.lit(1)).alias("n")), "transition", "n")
    transitions = Figure("Transitions", labels=levels).add("bars", counts)
    boxes = rows_of(stats.box_stats(rows.where("transition is not null"), ["transition"], "threat"), "transition", "whisker_low", "q25", "median", "q75", "whisker_high")
    distribution = Figure("Threat by transition", labels=levels).add("boxes", boxes)
    pairs = rows_of(stats.pearson(rows, base.FEATURES), "a", "b", "correlation")
    names = list(base.FEATURES)
    cells = [(a, b, c or 0.0) for a, b, c in pairs] + [(b, a, c or 0.0) for a, b, c in pairs] + [(n, n, 1.0) for n in names]
    figures = {"trends": trends, "spending": spending, "transitions": transitions, "distribution": distribution, "correlations": Figure("Correlations", labels=names).add("heat", cells)}
    folder_ = _local(scratch(spark, "figures") + "/trends.svg").parent
    for name, figure in figures.items():
        figure.write(folder_ / f"{name}.svg")
    lines = spark.read.text(str(folder_)).select(F.regexp_extract(F.input_file_name(), r"/(\w+)\.svg$", 1).alias("figure"), F.regexp_extract("value", 'class="(\\w+)" data-points="(\\d+)"', 1).alias("layer"), F.regexp_extract("value", 'data-points="(\\d+)"', 1).alias("n"))
    return lines.where("layer <> ''").groupBy("figure", "layer").agg(F.sum(F.col("n").cast("long")).alias("n_points"))


# -- projections, checked joins ------------------------------------------------------------------------------------


@query("SELECT speaker_row_id AS row_no, CAST(year AS BIGINT) AS speech_year, CAST(session AS VARCHAR) AS session_text, country AS country_name_raw FROM speakers_by_session")
def typed_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Columns under new names and types."""
    columns = {"speaker_row_id": ("row_no", "long"), "year": ("speech_year", "long"), "session": ("session_text", "string"), "country": ("country_name_raw", "string")}
    return relational.typed(table(spark, folder, "speakers_by_session"), columns)


@query("SELECT * REPLACE (CASE WHEN iso_code <> upper(trim(iso_code)) THEN upper(trim(iso_code)) ELSE iso_code END AS iso_code) FROM speakers_by_session")
def corrected_cells(spark: SparkSession, folder: str) -> DataFrame:
    """All speaker rows with untidy codes corrected by a reviewed list, each of whose corrections meets exactly one row."""
    rows = table(spark, folder, "speakers_by_session")
    tidy = F.upper(F.trim("iso_code"))
    corrections = rows.where(F.col("iso_code") != tidy).select("speaker_row_id", tidy.alias("corrected"))
    return relational.corrected(rows, corrections, ["speaker_row_id"], "iso_code")


#: Fixed value: a broken formula and what it stood for.
BROKEN_CELLS = {"29+C70+A7+D71:E74": "Ethiopia"}


@query("SELECT speaker_row_id, CASE WHEN trim(country) = '29+C70+A7+D71:E74' THEN 'Ethiopia' WHEN trim(country) = '' THEN NULL ELSE trim(country) END AS country FROM speakers_by_session")
def repaired_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Countries trimmed, a broken formula replaced by what it stood for, blank cells null."""
    country = text.repaired(F.col("country"), BROKEN_CELLS)
    return table(spark, folder, "speakers_by_session").select("speaker_row_id", F.nullif(country, F.lit("")).alias("country"))


@query("SELECT k.speaker_row_id, r.country_name FROM speakers_by_session k LEFT JOIN region_income_snapshot r ON r.entity_id = k.iso_code")
def join_same_rows(spark: SparkSession, folder: str) -> DataFrame:
    """A left join that is checked to keep the number of rows."""
    rows = table(spark, folder, "speakers_by_session").select("speaker_row_id", F.col("iso_code").alias("entity_id"))
    names = table(spark, folder, "region_income_snapshot").select("entity_id", "country_name")
    return relational.same_rows(rows, relational.join_checked(rows, names, ["entity_id"], "left", "many_to_one").select("speaker_row_id", "country_name"))


@query("SELECT a.row_id, a.trust_score, b.threat_score FROM modelling_rows a JOIN modelling_rows b USING (row_id)")
def join_one_to_one(spark: SparkSession, folder: str) -> DataFrame:
    """Two halves of a table put together by a key that is checked on both sides."""
    rows = table(spark, folder, "modelling_rows")
    return relational.join_checked(rows.select("row_id", "trust_score"), rows.select("row_id", "threat_score"), ["row_id"], "inner", "one_to_one")


_LOOKUP = r"""x AS (SELECT episode_id, year, unnest(regexp_split_to_array(location, '\s*[,;|]\s*')) AS label, generate_subscripts(regexp_split_to_array(location, '\s*[,;|]\s*'), 1) - 1 AS p FROM ucdp_conflicts WHERE location IS NOT NULL),
m AS (SELECT x.episode_id, CAST(x.p AS INTEGER) AS label_pos, count(c.source_name) AS n, min(c.entity_id) AS entity_id FROM x LEFT JOIN ucdp_country_crosswalk c ON c.source_name = x.label AND x.year BETWEEN c.valid_from AND c.valid_to AND c.exclusion_status = 'included' GROUP BY 1, 2)"""


@query(f"WITH {_LOOKUP} SELECT episode_id, label_pos, entity_id FROM m WHERE n = 1")
def rule_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """The entity of each label that exactly one rule of its year matches."""
    rows = reshape.labels(table(spark, folder, "ucdp_conflicts").select("episode_id", "location", "year").where("location is not null"), "location")
    rows = rows.withColumn("row", F.concat_ws("|", "episode_id", "label_pos"))
    rules = table(spark, folder, "ucdp_country_crosswalk").where("exclusion_status = 'included'")
    matches = relational.valid_in(rows, rules, name="label", year="year", rule_name="source_name", row_id="row").where("n_matches = 1")
    return relational.exactly_one(rows.join(matches.select("row"), "row", "left_semi"), matches, "row").select("episode_id", "label_pos", "entity_id")


@query(f"""WITH {base.PASSAGES} SELECT transition, CAST(list_position({list(_LEVELS)}, transition) - 1 AS INTEGER) AS ordinal, count(*) AS n_rows FROM pass WHERE transition IS NOT NULL GROUP BY 1""")
def ordered_levels(spark: SparkSession, folder: str) -> DataFrame:
    """Transitions in the order of a list, with their rows."""
    counts = base.passages(spark, folder).where("transition is not null").groupBy("transition").agg(F.count(F.lit(1)).alias("n_rows"))
    return relational.with_ordinal(counts, "transition", _LEVELS).orderBy("ordinal")


@query("SELECT speaker_post_group AS level, CAST(row_number() OVER (ORDER BY min(row_id), speaker_post_group) - 1 AS INTEGER) AS ordinal FROM modelling_rows WHERE speaker_post_group IS NOT NULL GROUP BY 1")
def level_appearance(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of posts in the order of their first rows."""
    return relational.first_appearance(table(spark, folder, "modelling_rows"), "speaker_post_group", "row_id").withColumnRenamed("speaker_post_group", "level")


# -- contracts ---------------------------------------------------------------------------------------------------


def _holds(check: Callable[[], object]) -> bool:
    try:
        check()
    except relational.ContractError:
        return False
    return True


_NATURAL = "entity_id, year, speech_no"


@query(f"""SELECT unnest(['columns', 'other columns', 'years', 'years of the sheet', 'speech id', 'natural key', 'listed codes', 'listed names', 'scores in range']) AS rule,
unnest([true, false, (SELECT coalesce(min(year) >= 1946 AND max(year) <= 2025, true) FROM speeches), (SELECT coalesce(min(year) >= 1949 AND max(year) <= 1960, true) FROM speeches), (SELECT count(*) = count(DISTINCT speech_id) FROM speeches),
(SELECT count(*) = 0 FROM (SELECT 1 FROM speeches GROUP BY {_NATURAL} HAVING count(*) > 1)),
(SELECT count(*) = 0 FROM (SELECT entity_id FROM region_income_snapshot WHERE entity_id IS NOT NULL EXCEPT SELECT entity_id FROM region_income_snapshot)),
(SELECT count(*) = 0 FROM ((SELECT source_name FROM sipri_country_crosswalk WHERE source_name IS NOT NULL EXCEPT SELECT source_name FROM ucdp_country_crosswalk) UNION ALL (SELECT source_name FROM ucdp_country_crosswalk WHERE source_name IS NOT NULL EXCEPT SELECT source_name FROM sipri_country_crosswalk))),
(SELECT count(*) = 0 FROM modelling_rows WHERE trust_score IS NOT NULL AND NOT isnan(trust_score) AND NOT trust_score BETWEEN 0 AND 1)]) AS holds""")
def contracts(spark: SparkSession, folder: str) -> DataFrame:
    """Which rules the tables keep; each is checked by the operator that would stop a run."""
    speeches, listed = table(spark, folder, "speeches"), table(spark, folder, "region_income_snapshot")
    sipri, ucdp = (table(spark, folder, f"{t}_country_crosswalk") for t in ("sipri", "ucdp"))
    score = F.col("trust_score")
    checks = {
        "columns": lambda: quality.require_columns(speeches, ["speech_id", "speech_clean"]),
        "other columns": lambda: quality.require_columns(speeches, ["speech_id", "Speech ID"]),
        "years": lambda: quality.require_range(speeches, "year", 1946, 2025),
        "years of the sheet": lambda: quality.require_range(speeches, "year", 1949, 1960),
        "speech id": lambda: relational.assert_unique(speeches, ["speech_id"]),
        "natural key": lambda: relational.assert_unique(speeches, _NATURAL.split(", ")),
        "listed codes": lambda: relational.same_domain(listed, listed, "entity_id"),
        "listed names": lambda: relational.same_domain(sipri, ucdp, "source_name"),
        "scores in range": lambda: quality.enforce(table(spark, folder, "modelling_rows"), {"range": score.isNotNull() & ~F.isnan(score) & ~score.between(0, 1)}),
    }
    return spark.createDataFrame([(name, _holds(check)) for name, check in checks.items()], "rule string, holds boolean")


@query("SELECT unnest(['null text', 'empty text', 'no words']) AS rule, unnest([count(*) FILTER (speech_clean IS NULL), count(*) FILTER (length(speech_clean) = 0), count(*) FILTER (speech_clean IS NOT NULL AND NOT regexp_matches(speech_clean, '[\\p{L}\\p{Nl}\\p{No}]'))]) AS n_rows FROM speeches")
def empty_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Texts that are missing, empty or without a word."""
    clean = F.col("speech_clean")
    return quality.violations(table(spark, folder, "speeches"), {"null text": clean.isNull(), "empty text": F.length(clean) == 0, "no words": clean.isNotNull() & (text.word_count(clean) == 0)})


@query(f"""WITH {_LOOKUP} SELECT CASE WHEN n = 0 THEN 'unmatched' WHEN n = 1 THEN 'one' ELSE 'ambiguous' END AS outcome, count(*) AS labels, count(*) = (SELECT count(*) FROM m) AS all_labels FROM m GROUP BY 1""")
def mapping_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the mapping of labels is exhaustive and unambiguous: labels by the number of rules that match."""
    rows = reshape.labels(table(spark, folder, "ucdp_conflicts").select("episode_id", "location", "year").where("location is not null"), "location")
    rows = rows.withColumn("row", F.concat_ws("|", "episode_id", "label_pos"))
    rules = table(spark, folder, "ucdp_country_crosswalk").where("exclusion_status = 'included'")
    n = F.col("n_matches")
    found = relational.valid_in(rows, rules, name="label", year="year", rule_name="source_name", row_id="row").groupBy(F.when(n == 0, "unmatched").when(n == 1, "one").otherwise("ambiguous").alias("outcome"))
    counts = found.agg(F.count(F.lit(1)).alias("labels"))
    # three rows at most are left here
    return counts.select("outcome", "labels", (F.col("labels") == F.sum("labels").over(Window.partitionBy())).alias("all_labels"))


_RULED = """codes AS (SELECT trim(iso_code) AS k, count(*) AS n FROM speakers_by_session WHERE iso_code IS NOT NULL GROUP BY 1),
ruled AS (SELECT c.k, c.n, r.entity_id IS NOT NULL AS listed, CASE WHEN length(c.k) = 2 THEN 'observer_state' WHEN length(c.k) = 4 THEN 'non_state_aggregate' WHEN length(c.k) > 4 THEN 'former_state' WHEN c.k = 'PSE' THEN 'observer_state' END AS kind FROM codes c LEFT JOIN region_income_snapshot r ON r.entity_id = c.k)"""


@query(f"""WITH {_RULED} SELECT k AS entity_id, CASE WHEN kind = 'observer_state' AND k = 'PSE' THEN 'sensitivity_observer' WHEN kind = 'observer_state' THEN 'excluded_observer_no_sipri' WHEN kind = 'non_state_aggregate' THEN 'excluded_non_state' WHEN kind IS NOT NULL THEN 'excluded_historical'
WHEN k = 'EU' THEN 'excluded_non_state' WHEN k = 'VAT' THEN 'excluded_observer_no_sipri' WHEN k IN ('CSK', 'DDR', 'YUG', 'YMD', 'SUN', 'BYSSR', 'UASSR') THEN 'excluded_historical' WHEN listed THEN 'main_un_member' ELSE 'unresolved_iso' END AS status, n AS n_rows FROM ruled""")
def entity_status_ruled(spark: SparkSession, folder: str) -> DataFrame:
    """Status of each code under rules by its form, which go before the code list."""
    from quern.functions.entity import entity_status

    codes = table(spark, folder, "speakers_by_session").where("iso_code is not null").groupBy(F.trim("iso_code").alias("entity_id")).agg(F.count(F.lit(1)).alias("n_rows"))
    listed = table(spark, folder, "region_income_snapshot").select("entity_id", F.lit(True).alias("listed"))
    size = F.length("entity_id")
    kind = F.when(size == 2, "observer_state").when(size == 4, "non_state_aggregate").when(size > 4, "former_state").when(F.col("entity_id") == "PSE", "observer_state")
    rows = codes.join(listed, "entity_id", "left").withColumn("kind", kind)
    return rows.select("entity_id", entity_status(F.col("entity_id"), F.col("kind"), F.coalesce("listed", F.lit(False))).alias("status"), "n_rows")

import random
import zipfile

import pytest
from pyspark.sql import functions as F

from quern import pipeline
from quern.operators.relational import ContractError, corrected
from quern.sources.sinks import Paths

MAIN, REL = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def write_xlsx(path, name, rows):
    def cell(v):
        if v is None:
            return "<c/>"
        if isinstance(v, (int, float)):
            return f"<c><v>{v}</v></c>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{v}</t></is></c>'

    body = "".join(f"<row>{''.join(cell(v) for v in r)}</row>" for r in rows)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{REL}"><sheets><sheet name="{name}" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/worksheets/s.xml", f'<worksheet xmlns="{MAIN}"><sheetData>{body}</sheetData></worksheet>')


@pytest.fixture
def inputs(spark, tmp_path):
    for session, year in ((74, 2019), (75, 2020)):
        folder = tmp_path / "speeches" / f"Session {session} - {year}"
        folder.mkdir(parents=True)
        for iso in ("AAA", "BBB", "EU"):
            (folder / f"{iso}_{session}_{year}.txt").write_text(f"We trust {iso}. War, reform and cooperation.", encoding="utf-8")
    header = ["Year", "Session", "ISO Code", "Country", "Name of Person Speaking", "Post"]
    rows = [[2019, 74, "AAA", "Aland", "Ms. X", "President"], [2020, 75, "AAX", "Aland", "Ms. X", "President"], [2019, 74, "BBB", "Bland", "Mr. Y", None], [2019, 74, "BBB", "Bland", "Mr. Z", "Ambassador"], [2020, 75, "CCC", "Cland", "Mr. Q", "King"]]
    write_xlsx(tmp_path / "Speakers_by_session.xlsx", "S", [header, *rows])
    years = list(range(1949, 2026))
    sheet = [["Title"]] * 5 + [["Country", "Notes", *years], ["Aland", None, *[0.0 if y == 2019 else 0.5 for y in years]], ["Bland", None, *["xxx" if y < 2020 else "..." for y in years]], ["Region", *[None] * 78]]
    write_xlsx(tmp_path / "spending.xlsx", "Share of GDP", sheet)
    (tmp_path / "conflicts.csv").write_text('conflict_id,location,year,intensity_level\n1,"Aland, Old",2020,2\n2,Aland,2020,1\n3,Bland,2021,1\n')
    return Paths.from_env(tmp_path, {})


def options(spark):
    xw = "source_name string, entity_id string, valid_from int, valid_to int, exclusion_status string"
    return dict(
        corrections=spark.createDataFrame([("AAX", 75, 2020, "AAA")], "iso string, session int, year int, corrected string"),
        entity_rules=spark.createDataFrame([("EU", 1990, 2030, "EU", "non_state_aggregate")], "source_label string, valid_from int, valid_to int, entity_id string, entity_type string"),
        countries=spark.createDataFrame([("AAA", "Aland"), ("BBB", "Bland")], "entity_id string, country_name string"),
        spending_crosswalk=spark.createDataFrame([("Aland", "AAA", 0, 0, "included"), ("Bland", "BBB", 0, 0, "included")], xw),
        conflict_crosswalk=spark.createDataFrame([("Aland", "AAA", 1946, 2030, "included"), ("Bland", "BBB", 1946, 2030, "included"), ("Old", "OLD", 1946, 2030, "included")], xw),
        sessions=2,
    )


def test_prepare(spark, inputs, tmp_path):
    made = pipeline.prepare(spark, inputs, **options(spark))
    rows = {(r.entity_id, r.year): r for r in made.panel.collect()}
    assert len(rows) == 6
    a, b, eu = rows["AAA", 2019], rows["BBB", 2020], rows["EU", 2019]
    assert (a.conflict_active_t, a.conflict_active_t1, a.milex_share_gdp_t, a.milex_status_t, a.speaker_post_group) == (0, 1, 0.0, "observed", "head_of_state")
    assert (b.conflict_active_t1, b.milex_share_gdp_t, b.milex_status_t, b.metadata_rows) == (1, None, "unavailable", 0)
    assert rows["BBB", 2019].milex_status_t == "not_independent_or_nonexistent" and rows["BBB", 2019].metadata_ambiguous
    assert (eu.entity_status, eu.conflict_active_t, eu.conflict_active_t1, eu.milex_status_t) == ("excluded_non_state", None, None, "no_country_row")
    assert rows["AAA", 2020].n_conflicts_t == 2 and rows["AAA", 2020].any_war_t == 1 and rows["AAA", 2020].speaker_name == "Ms. X"
    assert a.dict_trust_dialogue_salience_count == 1 and a.dict_security_threat_salience_count == 1
    assert made.audits["metadata_without_speech"].count() == 1 and made.audits["speeches_without_metadata"].count() == 3
    assert len(made.write_audits(str(tmp_path / "audits"))) == len(made.audits)
    wrong = options(spark) | {"spending_crosswalk": options(spark)["spending_crosswalk"].limit(1)}
    with pytest.raises(ContractError):
        pipeline.prepare(spark, inputs, **wrong)


def test_corrections_meet_one_row(spark):
    df = spark.createDataFrame([("SWE", 1), ("CHE", 1), ("X", 2), ("X", 2)], "k string, y int").withColumn("iso", F.col("k"))
    fix = lambda *rows: spark.createDataFrame(list(rows), "k string, y int, corrected string")
    assert sorted(r.iso for r in corrected(df, fix(("SWE", 1, "CHE"), ("CHE", 1, "SWE")), ["k", "y"], "iso").collect()) == ["CHE", "SWE", "X", "X"]
    for bad in (("X", 2, "Y"), ("Z", 1, "Y")):
        with pytest.raises(ContractError):
            corrected(df, fix(bad), ["k", "y"], "iso")


def test_explore_and_predict(spark):
    r = random.Random(4)
    rows, war = [], []
    for e in range(12):
        active = 0
        for y in range(1990, 2025):
            following = int(r.random() < (0.75 if active else 0.12))
            rows.append((f"E{e:02}", y, True, active, active, active, following, r.random(), r.random(), r.random() * 0.05 if e % 3 else None, "observed" if e % 3 else "blank", r.randrange(100, 900), r.choice(["head_of_state", "other"])))
            if active:
                war.append((f"E{e:02}", y))
            active = following
    scored = spark.createDataFrame(rows, "entity_id string, year int, main_population boolean, conflict_active_t int, any_war_t int, n_conflicts_t int, conflict_active_t1 int, trust_score double, threat_score double, milex_share_gdp_t double, milex_status_t string, speech_token_count int, speaker_post_group string")
    found = pipeline.explore(scored, replicates=50)
    counts = found["transition_counts"].collect()
    assert len(counts) == 8 and sum(c.n_rows for c in counts if c.sample == "all_target_observed") == len(rows)
    assert abs(sum(c.row_share for c in counts if c.sample == "spending_complete") - 1) < 1e-9
    assert found["bootstrap_differences"].count() == 2 * 2 * 3 and found["annual_trends"].count() == 35
    with pytest.raises(ContractError):
        pipeline.explore(scored.withColumn("trust_score", F.lit(2.0)), replicates=5)
    conflicts = spark.createDataFrame(war, "entity_id string, year int")
    small = {"VALIDATION": pipeline.model.expanding_folds([2008], 4)}
    kept = pipeline.VALIDATION
    try:
        pipeline.VALIDATION = small["VALIDATION"]
        out = pipeline.predict(scored, conflicts)
        scores = {(s.sample, s.kind, s.model): s for s in out["scores"].collect()}
        assert len(scores) == 14 and scores["all", "final", "history"].roc_auc > 0.6
        assert out["average_precision_by_round"].count() == 7 and out["coefficients"].where("feature = 'past5'").count() == 5
    finally:
        pipeline.VALIDATION = kept


def test_commands(spark, inputs, tmp_path, monkeypatch):
    from quern import __main__ as cli

    monkeypatch.setattr(cli, "local_session", lambda: spark)
    config, out = tmp_path / "config", tmp_path / "out"
    config.mkdir()
    (config / "corrections.csv").write_text("iso,session,year,corrected\nAAX,75,2020,AAA\n")
    (config / "entity_rules.csv").write_text("source_label,valid_from,valid_to,entity_id,entity_type\nEU,1990,2030,EU,non_state_aggregate\n")
    (config / "countries.csv").write_text("entity_id,country_name\nAAA,Aland\nBBB,Bland\n")
    header = "source_name,entity_id,country_name,valid_from,valid_to,mapping_rationale,exclusion_status\n"
    (config / "spending_crosswalk.csv").write_text(header + "Aland,AAA,Aland,0,0,r,included\nBland,BBB,Bland,0,0,r,included\n")
    (config / "conflict_crosswalk.csv").write_text(header + "Aland,AAA,Aland,1946,2030,r,included\nBland,BBB,Bland,1946,2030,r,included\nOld,OLD,Old,1946,2030,r,included\n")
    args = ["--root", str(tmp_path), "--config", str(config), "--output", str(out), "--sessions", "2"]
    cli.main(["prepare", *args])
    assert (out / "manifest.json").exists()
    cli.main(["score", *args, "--limit", "2"])
    cli.main(["score", *args])
    cli.main(["score", *args])
    assert spark.read.parquet(str(out / "scores")).count() == 6
    cli.main(["explore", *args, "--replicates", "20"])
    assert spark.read.csv(str(out / "explore" / "transition_counts"), header=True).count() == 8


def test_context_review(spark):
    rows = [("A", y, f"We fear war {i}. We trust you. Reform now! Nothing here.") for i, y in enumerate(range(1990, 2025))]
    df = spark.createDataFrame(rows, "entity_id string, year int, speech_clean string")
    out = pipeline.context_review(df, per_cell=3)
    cells = {(r.category, r.period): r.n for r in out.groupBy("category", "period").agg(F.count("*").alias("n")).collect()}
    assert set(c for c, _ in cells) == {"security_threat_salience", "trust_dialogue_salience", "reform_salience"} and set(cells.values()) == {3}
    assert pipeline.context_review(df.limit(0)).count() == 0

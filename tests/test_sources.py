import sqlite3
import zipfile

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.operators.relational import ContractError
from quern.sources import connectors, sinks, text_tree
from quern.streaming import scoring


def test_text_tree(spark, tmp_path):
    good = tmp_path / "Session 75 - 2020"
    good.mkdir()
    (good / "ABC_75_2020.txt").write_text("hello", encoding="utf-8")
    (good / "ABD_75_2019.txt").write_text("other year", encoding="utf-8")
    (good / "ABE_75_2020.txt").write_bytes(b"\xff\xfe\xff")
    (good / "notes.txt").write_text("x")
    speeches, rejected = text_tree.read_tree(spark, str(tmp_path), sessions=1)
    assert [(r.source_iso, r.session, r.year, r.speech_raw) for r in speeches.collect()] == [("ABC", 75, 2020, "hello")]
    assert sorted(r.reason for r in rejected.collect()) == ["file name", "folder and file disagree", "not UTF-8"]
    with pytest.raises(ValueError):
        text_tree.read_tree(spark, str(tmp_path), sessions=80)
    assert {r.outcome: r.files for r in text_tree.read_lenient(spark, str(tmp_path)).collect()} == {"matched": 3, "skipped": 1}


def test_sqlite(spark, tmp_path):
    connectors.register(spark)
    with sqlite3.connect(tmp_path / "c.db") as db:
        db.execute("CREATE TABLE scores (entity_id TEXT, year INTEGER, payload TEXT, PRIMARY KEY (entity_id, year))")
        db.executemany("INSERT INTO scores VALUES (?, ?, ?)", [(f"e{i}", i, None if i == 3 else "{}") for i in range(25)])
        db.execute("CREATE TABLE empty_one (a TEXT)")
    df = spark.read.format("sqlite").option("path", str(tmp_path / "c.db")).option("dbtable", "scores").option("numPartitions", "4").load()
    assert df.count() == 25 and df.where("payload is null").count() == 1 and dict(df.dtypes)["year"] == "bigint"
    assert spark.read.format("sqlite").option("path", str(tmp_path / "c.db")).option("dbtable", "empty_one").load().count() == 0


def test_xlsx(spark, tmp_path):
    connectors.register(spark)
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    sheet = f'<worksheet xmlns="{main}"><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>Title</t></is></c></row><row r="3"><c r="A3" t="s"><v>0</v></c><c r="C3"><v>1949</v></c></row><row r="4"><c r="A4" t="s"><v>1</v></c><c r="C4"><v>0.5</v></c></row></sheetData></worksheet>'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="Share" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>Country</t></si><si><t>Abc</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", sheet)
    df = spark.read.format("xlsx").option("path", str(tmp_path / "b.xlsx")).option("sheet", "Share").option("header", "2").load()
    assert df.columns == ["Country", "column_1", "1949"] and [tuple(r) for r in df.collect()] == [("Abc", None, "0.5")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.123456)], "k int, x double")
    sinks.write_result(df, str(tmp_path / "r"), 2)
    assert spark.read.csv(str(tmp_path / "r"), header=True).head().x == "0.12"
    sheet = str(tmp_path / "sheet")
    sinks.write_once(df, sheet, ["k"])
    assert sinks.write_once(df.withColumn("x", F.lit(9.0)), sheet, ["k"]).head().x == 0.123456
    with pytest.raises(ContractError):
        sinks.write_once(df.withColumn("k", F.lit(2)), sheet, ["k"])
    made = sinks.write_manifest(tmp_path / "m.json", sources=[], rows={"a": 1}, fingerprint="f", settings={"b": 1, "a": 2})
    assert made["settings_hash"] == sinks.canonical_hash({"a": 2, "b": 1})
    sinks.write_markdown(df, tmp_path / "x.md", "k", "x")
    assert "## 1" in (tmp_path / "x.md").read_text()


def test_paths(tmp_path):
    (tmp_path / "speeches" / "TXT").mkdir(parents=True)
    p = sinks.Paths.from_env(tmp_path, {"CONFLICTS_PATH": str(tmp_path / "other.csv")})
    assert p.speech_dir.name == "TXT" and p.conflicts_path.name == "other.csv"
    with pytest.raises(FileNotFoundError, match="other.csv"):
        p.validate()


def slow_chunks(text, spans, budget):
    """By the rule, one token after another."""
    out, at = [], 0
    while at < len(spans):
        to = min(at + budget, len(spans))
        if to < len(spans):
            good = [k for k in range(at + max(1, budget // 2), to + 1) if ends_sentence(text, spans[k - 1][1])]
            to = good[-1] if good else to
        out.append([at, to, spans[at][0], spans[to - 1][1]])
        at = to
    return out


def ends_sentence(text, at):
    body = text[:at]
    return (at == len(text) or text[at].isspace()) and (body[-1] in ".!?" or body[-1] in "\"”’'" and body[-2:-1] in (".", "!", "?"))


def test_chunks_part_the_tokens():
    text = " ".join(f"word{i}." if i % 7 == 6 else f"word{i}" for i in range(500))
    spans = scoring.token_spans(text)
    chunks = scoring.chunks_of(text, spans, 40).tolist()
    assert chunks[0][0] == 0 and chunks[-1][1] == len(spans) and all(a[1] == b[0] for a, b in zip(chunks, chunks[1:]))
    assert all(text[c[2] : c[3]].endswith(".") for c in chunks[:-1]) and max(c[1] - c[0] for c in chunks) <= 40
    assert scoring.chunks_of("", []).tolist() == []
    with pytest.raises(ValueError):
        scoring.chunks_of("a", [(0, 1)], 0)


@settings(max_examples=200, deadline=None)
@given(st.text("ab.!?\"’ \n\u00a0é中", max_size=80), st.integers(1, 12))
def test_chunks_by_brute_force(text, budget):
    spans = scoring.token_spans(text)
    assert scoring.chunks_of(text, spans, budget).tolist() == slow_chunks(text, spans, budget)


def test_pairs_are_bounded():
    assert scoring.pair_of("a b.", "c") == scoring.Pair("[CLS] a b. [SEP] c [SEP]", 7)
    with pytest.raises(ContractError):
        scoring.pair_of("a " * 600, "c")
    assert scoring.pair_of("a " * 600, "c", cut=True).tokens == scoring.PAIR_BUDGET
    assert abs(scoring.entailment(np.array([[1.0, 1.0], [800.0, 0.0]])) - [0.5, 1.0]).max() < 1e-12


def test_batches_and_whole_texts(spark):
    df = spark.createDataFrame([(1, "One two. " * 400), (2, "Three."), (3, None), (4, "")], "id long, t string").coalesce(1)
    rows = scoring.score_chunks(df, ["id"], "t").collect()
    again = scoring.score_chunks(df, ["id"], "t", batch=1).collect()
    assert rows == again and {r.id for r in rows} == {1, 2} and sum(r.tokens for r in rows) == 1200 + 2
    one = scoring.score_chunks(df, ["id"], "t", whole=True).collect()
    assert [(r.id, r.chunk_no, r.end_token) for r in one] == [(1, 0, 1200), (2, 0, 2)] and one[0].tokens < 512 < one[0].end_token

    def counting():  # pairs come in batches, not one by one
        inner = scoring.stand_in()

        def score(pairs):
            return np.full((len(pairs), 2), 0.0) + len(pairs) * (np.arange(2) == 0) if len(pairs) > 2 else inner(pairs)

        return score

    assert max(r.trust for r in scoring.score_chunks(df, ["id"], "t", load=counting).collect()) > 0.99


def test_stream_resumes(spark, tmp_path):
    schema = "entity_id string, year int, speech_clean string"
    one = spark.createDataFrame([("A", 1, "Hello. World."), ("A", 1, "Hello. World."), ("B", 1, "Text")], schema)
    one.write.parquet(str(tmp_path / "in"))
    args = dict(keys=["entity_id", "year"], text="speech_clean", spec_hash="s")
    scoring.score_stream(spark, str(tmp_path / "in"), schema, str(tmp_path / "cache"), str(tmp_path / "cp"), **args).awaitTermination()
    spark.createDataFrame([("B", 1, "Text"), ("C", 2, "New")], schema).write.mode("append").parquet(str(tmp_path / "in"))
    scoring.score_stream(spark, str(tmp_path / "in"), schema, str(tmp_path / "cache"), str(tmp_path / "cp"), **args).awaitTermination()
    cache = spark.read.parquet(str(tmp_path / "cache"))
    assert sorted(r.entity_id for r in cache.collect()) == ["A", "B", "C"]
    changed = spark.createDataFrame([("A", 1, "Changed")], schema)
    assert scoring.stale(changed, cache, ["entity_id", "year"], "speech_clean").count() == 1


def test_a_cache_that_cannot_be_read_is_not_empty(spark, tmp_path):
    schema, cache = "entity_id string, year int, speech_clean string", tmp_path / "cache"
    spark.createDataFrame([("A", 1, "Hello.")], schema).write.parquet(str(tmp_path / "in"))
    run = lambda spec, cp: scoring.score_stream(spark, str(tmp_path / "in"), schema, str(cache), str(tmp_path / cp), keys=["entity_id", "year"], text="speech_clean", spec_hash=spec).awaitTermination()
    run("s", "c1")
    before = sorted(p.name for p in cache.glob("*.parquet"))
    with pytest.raises(Exception, match="specification"):
        run("other", "c2")
    broken = cache / "part-broken.parquet"
    broken.write_bytes(b"no parquet at all")
    with pytest.raises(Exception):
        run("s", "c3")
    assert sorted(p.name for p in cache.glob("*.parquet")) == sorted([*before, broken.name])


def test_weighted_scores_refuse_bad_chunks(spark):
    ok = spark.createDataFrame([(1, 2, 0.5), (1, 6, 0.9)], "k int, tokens int, trust double")
    r = scoring.weighted_scores(ok, ["k"], ["trust"]).head()
    assert abs(r.trust - 0.8) < 1e-12 and (r.chunk_count, r.chunk_tokens_median) == (2, 4.0)
    for bad in ((1, 0, 0.5), (1, 1, 1.5), (1, 1, None)):
        with pytest.raises(Exception, match="not positive"):
            scoring.weighted_scores(spark.createDataFrame([bad], "k int, tokens int, trust double"), ["k"], ["trust"]).collect()


def test_figures(tmp_path):
    from xml.etree import ElementTree

    from quern.sources.figures import Figure, symlog

    assert symlog(0.5) == 0.5 and symlog(-1) == -1 and abs(symlog(np.e) - 2) < 1e-12 and symlog(-np.e) == -symlog(np.e)
    figure = Figure("a < b", "x", "y", symlog).add("line", [(1, 2.0), (2, None), (3, float("nan")), (4, 900.0)], "one").add("band", [(1, 0.0, 2.0), (4, 1.0, 3.0)]).add("step", [(1, 1), (4, 2)]).add("points", [(2, 2)])
    boxes = Figure("b", labels=["p", "q"]).add("boxes", [("q", 0, 1, 2, 3, 4)]).add("bars", [("p", -2)])
    for i, f in enumerate((figure, boxes, Figure("h", labels=["p", "q"]).add("heat", [("p", "q", -0.5), ("q", "p", 1.0)]), Figure("empty").add("line", []))):
        f.write(tmp_path / f"{i}.svg")
        ElementTree.parse(tmp_path / f"{i}.svg")
    assert (tmp_path / "0.svg").read_text().count('data-points="2"') == 3
    with pytest.raises(ValueError):
        figure.add("pie", [])


def test_figures_of_large_tables_are_refused(spark):
    from quern.sources import figures

    assert figures.rows_of(spark.range(3).selectExpr("cast(2 - id as int) as a", "id as b"), "a", "b") == [(0, 2), (1, 1), (2, 0)]
    with pytest.raises(ValueError):
        figures.rows_of(spark.range(figures.MAX_ROWS + 1), "id")

"""The queries of the subpackage on the smallest tables."""

import os

import pytest

from quern.llm.queries import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables are not here")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_runs(spark, name):
    df = QUERIES[name](spark, FOLDER)
    rows = df.collect()
    if name in ORACLE:
        import duckdb

        con = duckdb.connect()
        for t in ("speeches", "scores", "modelling_rows", "annual_score_trends", "transition_feature_summaries"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
        result = con.execute(ORACLE[name])
        columns = [d[0] for d in result.description]
        assert sorted(columns) == sorted(df.columns)
        assert sorted(tuple(r[c] for c in columns) for r in rows) == sorted(result.fetchall())


def _documents():
    import pyarrow.parquet as pq

    return pq.read_table(f"{FOLDER}/documents.parquet").to_pylist()


def test_containers_hold_every_document_once(spark):
    sizes = {r["doc_id"]: r["text"] for r in _documents() if r["text"]}
    rows = QUERIES["p7_contents"](spark, FOLDER).collect()
    used = {}
    for r in rows:
        used[r.spec_id, r.container] = used.get((r.spec_id, r.container), 0) + r.n_tokens
        assert r.n_tokens <= r.capacity_tokens
    capacity = {r.spec_id: r.capacity_tokens for r in rows}
    assert all(n <= capacity[spec] for (spec, _), n in used.items())
    for spec in capacity:
        mine = [(r.doc_id, r.part_no) for r in rows if r.spec_id == spec]
        assert len(mine) == len(set(mine)) and {d for d, _ in mine} == {d for d, t in sizes.items() if t}
        assert all(r.n_tokens == capacity[spec] for r in rows if r.spec_id == spec and (r.doc_id, r.part_no + 1) in set(mine))  # only what exceeds the capacity is divided
    summary = {r.spec_id: r for r in QUERIES["p7_summary"](spark, FOLDER).collect()}
    assert all(s.containers <= 1.01 * s.lower_bound + 1 and s.containers == sum(1 for spec, _ in used if spec == i) for i, s in summary.items())


def test_shares_are_reached(spark):
    rows = [r for r in QUERIES["p8_shares"](spark, FOLDER).collect() if r.available_tokens]
    for mix in {r.mix_id for r in rows}:
        own = [r for r in rows if r.mix_id == mix]
        whole = sum(r.target_share for r in own)
        assert all(abs(r.reached_share - r.target_share / whole) < 0.02 and r.most_copies <= r.max_repeats for r in own)


def test_sentences_part_every_document(spark):
    texts = {r["doc_id"]: r["text"] for r in _documents() if r["text"] and not r["text"].isspace()}
    found = {}
    for r in QUERIES["p9_sentences"](spark, FOLDER).collect():
        found.setdefault(r.doc_id, []).append(r)
    assert set(found) == set(texts)
    for i, rows in found.items():
        rows.sort(key=lambda r: r.sent_no)
        assert [r.sent_no for r in rows] == list(range(1, len(rows) + 1)) and all(texts[i][r.sent_start : r.sent_end] == r.sentence for r in rows)
        assert "".join("".join(r.sentence.split()) for r in rows) == "".join(texts[i].split())


def test_pairs_look_the_same_and_none_is_lost(spark):
    """Against a form made in another way: compatibility composition, invisible characters and look-alikes by replacement."""
    import unicodedata

    import pyarrow.parquet as pq

    from quern.llm import lookalikes

    alike = str.maketrans({x: latin for latin, others in lookalikes.LOOKALIKES.items() for x in others} | {"\u2010": "-", "\u2011": "-", "\u034f": None})

    def plain(text):
        text = "".join(" " if unicodedata.category(c) == "Zs" else c for c in text if unicodedata.category(c) != "Cf")
        return unicodedata.normalize("NFC", unicodedata.normalize("NFD", unicodedata.normalize("NFKC", text).translate(alike)).translate(alike))

    rows = [(r["speech_id"], r["speech_clean"]) for r in pq.read_table(f"{FOLDER}/speeches.parquet", columns=["speech_id", "speech_clean"]).to_pylist() if r["speech_clean"] is not None]
    by = {}
    for i, t in rows:
        by.setdefault(plain(t), []).append((i, t))
    wanted = {(a, b) for group in by.values() for a, s in group for b, t in group if a < b and s != t}
    assert {tuple(r) for r in QUERIES["p5_found"](spark, FOLDER).collect()} == wanted and wanted


def test_every_typed_value_gets_an_answer(spark):
    import pyarrow.parquet as pq

    entries = pq.read_table(f"{FOLDER}/region_income_snapshot.parquet").to_pylist()
    names, codes = {r["country_name"] for r in entries}, {r["entity_id"] for r in entries}
    wanted = set()
    for name, field, exact in (("ucdp", "source_name", names), ("sipri", "source_name", names), ("sipri", "entity_id", codes)):
        for r in pq.read_table(f"{FOLDER}/{name}_country_crosswalk.parquet").to_pylist():
            if r[field] and r[field].strip() and r[field] not in exact:
                wanted.add((f"{name}_country_crosswalk", field, r["entry_id"]))
    rows = QUERIES["p6_found"](spark, FOLDER).collect()
    assert len(rows) == len(wanted) and {(r.crosswalk, r.field_name, r.entry_id) for r in rows} == wanted
    assert {r.entity_id for r in rows} <= codes | {"UNMATCHED"}

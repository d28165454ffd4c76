from datetime import datetime as d

import pytest
from pyspark.sql import functions as F

from quern.operators import orphans
from quern.operators.orphans import find_orphans, orphan_report

PARENTS = [("A", d(2020, 1, 1), None), ("A", d(2019, 1, 1), d(2022, 1, 1)), (" B ", d(2021, 1, 1), None), (None, d(2000, 1, 1), None), ("", d(2000, 1, 1), None)]
REFS = [
    (1, "A", d(2021, 1, 1), 10), (2, " A", d(2022, 1, 1), 10), (3, "B", d(2020, 6, 1), 11), (4, "B", d(2021, 1, 1), 11), (5, "a", d(2021, 1, 1), 11), (6, None, d(2021, 1, 1), 11),
    (7, "  ", d(2021, 1, 1), 11), (8, "Z", d(2021, 1, 1), None), (8, "Z", d(2021, 1, 1), None), (9, "B", None, 12), (10, "A", d(2018, 1, 1), 12),
]
EXPECTED = [(2, "deleted"), (3, "late"), (5, "missing"), (8, "missing"), (8, "missing"), (10, "late")]


@pytest.fixture
def tables(spark):
    parents = spark.createDataFrame(PARENTS, "key string, received_at timestamp_ntz, deleted_at timestamp_ntz")
    refs = spark.createDataFrame(REFS, "id long, ref string, received_at timestamp_ntz, year int")
    return refs, parents


def run(refs, parents):
    return find_orphans(refs, parents, row_id="id", ref_keys=["ref"], parent_keys=["key"], ref_received="received_at", parent_received="received_at", parent_deleted="deleted_at", carry=["year"])


def test_reasons(tables):
    assert sorted((r.id, r.reason) for r in run(*tables).collect()) == EXPECTED


def test_more_keys_than_a_filter_takes(spark, monkeypatch):
    """A budget of 4,096 bits and 4,000 keys: ten blocks, each probed with its own filter, and none of them let all through."""
    monkeypatch.setattr(orphans, "MAX_BITS", 4096)
    made = []
    bloom = orphans._bloom
    monkeypatch.setattr(orphans, "_bloom", lambda keys, n: made.append(bloom(keys, n)) or made[-1])
    parents = spark.range(4000).selectExpr("concat('k', id) as key", "timestamp_ntz'2020-01-01' as received_at", "cast(null as timestamp_ntz) as deleted_at")
    refs = spark.range(3000, 9000).selectExpr("id", "concat('k', id) as ref", "timestamp_ntz'2021-01-01' as received_at", "2021 as year")
    assert sorted((r.id, r.reason) for r in run(refs, parents).collect()) == [(i, "missing") for i in range(4000, 9000)]
    assert len(made) == 10 and max(map(len, made)) < 4096 // 8 * 2
    narrow = refs.selectExpr("id", "ref as __k0")
    hashed = parents.selectExpr("xxhash64(key) as h")
    hit = orphans._probed(narrow, hashed, F.xxhash64("__k0"), 4000).where("__hit").count()
    assert 1000 <= hit < 1300


def test_filters_of_blocks_give_the_same(tables, monkeypatch):
    monkeypatch.setattr(orphans, "MAX_BITS", 16)
    assert sorted((r.id, r.reason) for r in run(*tables).collect()) == EXPECTED


def test_no_silent_way_round_the_filter(tables, monkeypatch):
    def absent(*_):
        raise TypeError("'JavaPackage' object is not callable")

    monkeypatch.setattr(orphans, "_might_contain", absent)
    with pytest.raises(TypeError):
        run(*tables)


def test_empty_tables(tables):
    refs, parents = tables
    assert run(refs.limit(0), parents).count() == 0
    assert {r.reason for r in run(refs, parents.limit(0)).collect()} == {"missing"}


def test_several_keys_and_other_columns(spark):
    parents = spark.createDataFrame([("A", 1, d(2020, 1, 1), "x"), ("A", None, d(2020, 1, 1), "x")], "e string, y int, received_at timestamp_ntz, reason string")
    refs = spark.createDataFrame([(1, "A", 1, d(2021, 1, 1)), (2, "A", 2, d(2021, 1, 1)), (3, "A", None, d(2021, 1, 1))], "id long, e string, y int, received_at timestamp_ntz")
    out = find_orphans(refs, parents, row_id="id", ref_keys=["e", "y"], parent_keys=["e", "y"], ref_received="received_at", parent_received="received_at")
    assert [(r.id, r.reason) for r in out.collect()] == [(2, "missing")]


def test_report(tables):
    from pyspark.sql import functions as F

    found = run(*tables).withColumns({"ref_table": F.lit("t"), "ref_field": F.lit("ref")})
    assert {(r.year, r.reason): r.orphans for r in orphan_report(found, "year").collect()} == {(10, "deleted"): 1, (11, "late"): 1, (11, "missing"): 1, (None, "missing"): 2, (12, "late"): 1}


def test_parents_without_a_key(tables):
    refs, parents = tables
    assert {r.reason for r in run(refs, parents.where("key is null or key = ''")).collect()} == {"missing"}

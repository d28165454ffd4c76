import pyarrow as pa
import pytest

from quern.operators.packed import MAX_NAMES, protected_pattern, split_array, split_packed

NAMES = ["Tamber, Isles of", "Saint Weskel and Moor", "Ostrel/Vann", "Ildwyn (Upper)", "Ka'lorra", "Tarvia"]

CASES = [
    ("Tarvia", ["Tarvia"]),
    ("A, B; C | D / E & F and G\nH\tI、J", list("ABCDEFGHIJ")),
    ("Tamber, Isles of, Saint Weskel and Moor and Ostrel/Vann", ["Tamber, Isles of", "Saint Weskel and Moor", "Ostrel/Vann"]),
    ('"Far, Away"; B', ["Far, Away", "B"]),
    ('"""Velloch, Free State of"", B, C"', ["Velloch, Free State of", "B", "C"]),
    ("'Ka'lorra','Tarvia'", ["Ka'lorra", "Tarvia"]),
    ("“A”, “B, C”", ["A", "B, C"]),
    ('"A" "B"', ["A", "B"]),
    ('["A", "B"]', ["A", "B"]),
    ("{A,B}", ["A", "B"]),
    ("A, , A;", ["A", "A"]),
    ('A" , B', ["A", "B"]),
    ("Sandland, Andor", ["Sandland", "Andor"]),
    ("  A  ,B", ["A", "B"]),
    (None, []),
    ("", []),
    (" ;, \n", []),
    ("and", []),
]


@pytest.mark.parametrize("text,values", CASES)
def test_one_field(text, values):
    assert split_array(pa.array([text], pa.string()), protected_pattern(NAMES)).to_pylist() == [values]


def test_a_batch_gives_what_its_rows_give():
    column = pa.array([t for t, _ in CASES] * 50, pa.string())
    assert split_array(column, protected_pattern(NAMES)).to_pylist() == [v for _, v in CASES] * 50


def test_slices_and_empty_batches():
    column = pa.array(["X, Y", "A, B", None, "C"], pa.string())
    assert split_array(column.slice(1, 3)).to_pylist() == [["A", "B"], [], ["C"]]
    assert split_array(pa.array([], pa.string())).to_pylist() == []


def test_very_long_field():
    text = ", ".join(f"v{i}" for i in range(200_000))
    assert split_array(pa.array([text]))[0].as_py()[-1] == "v199999"


def test_rows_with_other_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "A, B", "x", 9), (1, "A, B", None, 9), (None, None, "y", 9), (2, "", "z", 9)], "id int, f string, extra string, pos int")
    out = split_packed(df, "f", count="n").orderBy("extra", "pos").collect()
    assert [(r.id, r.extra, r.pos, r.value, r.n) for r in out] == [(1, None, 1, "A", 2), (1, None, 2, "B", 2), (1, "x", 1, "A", 2), (1, "x", 2, "B", 2)]
    assert split_packed(df.limit(0), "f").count() == 0


def test_too_many_names(spark):
    with pytest.raises(ValueError):
        split_packed(spark.createDataFrame([("a",)], "f string"), "f", names=["x"] * (MAX_NAMES + 1))


def test_many_names_by_brute_force():
    """The longest name from left to right that no letter continues, as an alternation of all names finds it."""
    import random
    import re

    r = random.Random(5)
    names = sorted({f"{a}, {b}" for a in ("A", "AB", "B", "é") for b in ("B", "BC", "C of D, E", "é")})
    pattern = re.compile(rb"(?<![A-Za-z0-9\x80-\xff])(?:" + b"|".join(re.escape(n.encode()) for n in sorted(names, key=lambda n: (-len(n), n))) + rb")(?![A-Za-z0-9\x80-\xff])")
    found = protected_pattern(names)
    for _ in range(400):
        data = "".join(r.choice(["A", "B", "C", ", ", " ", "é", " of ", "D, E", ";"]) for _ in range(14)).encode()
        assert list(found.spans(data)) == [m.span() for m in pattern.finditer(data)]

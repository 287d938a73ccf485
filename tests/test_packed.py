"""The packed-field grammar and operator."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veritrove.operators.packed import authors_of, is_placeholder, split_packed, unpack


def values(text, kind="names"):
    return [v for v, _ in split_packed(text, kind)]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        (None, []),
        ("", []),
        ("  \t\n", []),
        (" ; ,, ", []),
        ("Ana Roe", ["Ana Roe"]),
        ("Ana Roe, Bo Lee", ["Ana Roe", "Bo Lee"]),
        ("Ana Roe,, Bo Lee,", ["Ana Roe", "Bo Lee"]),
        ("Roe, Ana; Lee, Bo", ["Roe, Ana", "Lee, Bo"]),
        ("Roe, Ana | Lee Bo|et al.", ["Roe, Ana", "Lee Bo"]),
        ("Ana Roe, Bo Lee and Cy Poe", ["Ana Roe", "Bo Lee", "Cy Poe"]),
        ("Ana Roe, Bo Lee, & Cy Poe", ["Ana Roe", "Bo Lee", "Cy Poe"]),
        ("Ana Roe; and Bo Lee", ["Ana Roe", "Bo Lee"]),
        ("Ana Roe\nBo Lee\r\nCy Poe", ["Ana Roe", "Bo Lee", "Cy Poe"]),
        ("Ana Roe / Bo Lee/", ["Ana Roe", "Bo Lee"]),
        ('"Roe, Ana"', ["Roe, Ana"]),
        ('"Roe, Ana","Lee, Bo",et al.', ["Roe, Ana", "Lee, Bo"]),
        ("'Jo O'Dee'; 'Roe, Ana'", ["Jo O'Dee", "Roe, Ana"]),
        ("['Ana Roe', 'Jo O'Dee']", ["Ana Roe", "Jo O'Dee"]),
        ('"She said ""x""", Bo', ['She said "x"', "Bo"]),
        ("N/A", ["N/A"]),
        ("Ana Roe, Ana Roe", ["Ana Roe", "Ana Roe"]),
        ("Roe et al.", ["Roe"]),
        ("Ana (Dept, Univ), Bo", ["Ana (Dept, Univ)", "Bo"]),
        ("Sandy Anders, Andy Land", ["Sandy Anders", "Andy Land"]),
    ],
)
def test_names(text, expected):
    assert values(text) == expected


@pytest.mark.parametrize("text", ["A-1, B-2", "A-1; B-2;", "A-1 B-2", "A-1\nB-2", "A-1 + B-2+", "A-1 / B-2/", "['A-1', 'B-2']", '"A-1";"B-2"', "A-1|B-2|"])
def test_codes(text):
    assert values(text, "codes") == ["A-1", "B-2"]


def test_flags():
    assert split_packed('"Ana Roe, Bo') == (("Ana Roe", "quote"), ("Bo", None))
    assert split_packed("Ana (x, Bo") == (("Ana (x", "bracket"), ("Bo", None))
    assert split_packed("Unknown") == (("Unknown", "placeholder"),)
    assert is_placeholder("n.a.") and is_placeholder("-") and not is_placeholder("Nona Anon Lee")


@given(st.text(alphabet="ab,;|&/\n'\"[]() é", max_size=60))
@settings(max_examples=300, deadline=None)
def test_any_text_is_read(text):
    for kind in ("names", "codes"):
        for value, _ in split_packed(text, kind):
            assert value and value == value.strip()
    assert split_packed(text) == split_packed(text)


@given(st.lists(st.text(alphabet="abcdef", min_size=1, max_size=8), min_size=2, max_size=6), st.sampled_from([", ", ";", " | ", "\n", " / "]))
@settings(max_examples=100, deadline=None)
def test_round_trip(names, sep):
    assert values(sep.join(f"x{n} y{n}" for n in names)) == [f"x{n} y{n}" for n in names]


@pytest.mark.parametrize("text", ["A (" * 300_000, '"a, ' * 300_000, "'a" * 300_000, "(a)" * 300_000, "-" * 10**6 + "x", "n" + " " * 10**6 + "x", "[" * 10**6, '"' * 10**6, "et al " * 200_000, '""a,' * 200_000, "},(" * 200_000])
def test_no_field_stops_a_job(spark, text):
    """Read in time that grows with the length, whatever does not close."""
    df = spark.createDataFrame([(1, text, text)], "record_id long, authors string, fraud_types string")
    assert unpack(df, "record_id", {"authors": "names", "fraud_types": "codes"}).count() >= 0


def test_placeholder_of_any_length():
    long = "-" * 60 + " unknown authors " + "-" * 60
    assert is_placeholder(long) and is_placeholder("n / a") and not is_placeholder("x" + "-" * 60)
    assert split_packed(long) == (("-" * 60 + " unknown authors " + "-" * 60, "placeholder"),)
    assert split_packed("unknown / " + "-" * 60)[0][1] == "placeholder"


def test_operator(spark):
    rows = [(1, "A B; C D", None), (2, None, "X-1, X-1"), (None, "E F", ""), (4, "", "x" * 50_000)]
    df = spark.createDataFrame(rows, "record_id long, authors string, fraud_types string").selectExpr("*", "1 as pos", "2 as field_name", "3 as _id")
    got = {tuple(r) for r in unpack(df, "record_id", {"authors": "names", "fraud_types": "codes"}).select("record_id", "field_name", "pos", "n_values", "item_value").collect()}
    assert got == {(1, "authors", 1, 2, "A B"), (1, "authors", 2, 2, "C D"), (2, "fraud_types", 1, 2, "X-1"), (2, "fraud_types", 2, 2, "X-1"), (None, "authors", 1, 1, "E F"), (4, "fraud_types", 1, 1, "x" * 50_000)}
    assert unpack(df.limit(0), "record_id", {"authors": "names"}).count() == 0
    assert {r[1] for r in authors_of(spark.createDataFrame([(1, "Unknown; A B; N/A")], "record_id long, authors string")).collect()} == {"A B"}

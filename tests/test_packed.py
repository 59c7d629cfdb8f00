import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quirework.functions.packed import Grammar
from quirework.operators.packed_values import split_packed

TERMS = ["Railways; essays", "Tides, collected", "Herbals/19th century", "Rivers & toys", "Toys", "Toys, collected"]
SUBJECTS, PEOPLE = Grammar(TERMS), Grammar((), people=True)


@pytest.mark.parametrize(("text", "values"), [
    ("Toys;Clocks", ["Toys", "Clocks"]), ("Railways; essays", ["Railways; essays"]), ("Toys, collected, Clocks", ["Toys, collected", "Clocks"]), ('"a;b" | c', ["a;b", "c"]), ('"the ""x"" y";z', ['the "x" y', "z"]),
    ("Herbals/19th century", ["Herbals/19th century"]), ("a / b/ c", ["a", "b", "c"]), ("a\\, b, c", ["a, b", "c"]), ("a;; b;", ["a", "b"]), ("Toys;", ["Toys"]), ('the "x" y', ['the "x" y']), ('"a', ['"a']), ('"a; b', ['"a', "b"]),
    ("a|b ; c", ["a", "b", "c"]), ("a\nb\tc", ["a", "b", "c"]), ("a、b", ["a", "b"]), ("[a; b]", ["a", "b"]), ("Rivers & toys", ["Rivers & toys"]), ("", []), (None, []), (" ; ", []), ("Railways; essays; Toys", ["Railways; essays", "Toys"]),
])
def test_subjects(text, values):
    assert SUBJECTS.parse(text)[0] == values


@pytest.mark.parametrize(("text", "values"), [
    ("Doe, Jane", ["Doe, Jane"]), ("Jane Doe and Max Roe", ["Jane Doe", "Max Roe"]), ("A B, C D, and E F", ["A B", "C D", "E F"]), ("Ann Lee, Bo Roe & Cy Poe", ["Ann Lee", "Bo Roe", "Cy Poe"]), ("Lee & Roe Society", ["Lee & Roe Society"]),
    ("Doe, Jane; Roe, Max", ["Doe, Jane", "Roe, Max"]), ('"Doe, Jane","Roe, Max"', ["Doe, Jane", "Roe, Max"]), ("Jane Doe with Max Roe", ["Jane Doe", "Max Roe"]), ("Doe, Jane & Roe, Max", ["Doe, Jane", "Roe, Max"]), ("van Doe, Jane", ["van Doe, Jane"]),
    ("Lane Press, Ltd.", ["Lane Press, Ltd."]), ("Jane Doe, Jr.", ["Jane Doe, Jr."]), ("Doe, J. P.", ["Doe, J. P."]), ("Jane Doe, Max Roe", ["Jane Doe", "Max Roe"]),
])
def test_people(text, values):
    single = PEOPLE.parse(text)[0]
    assert (single if len(single) > 1 else [text]) == values


def test_malformed_quotes_are_flagged():
    assert SUBJECTS.parse('"a; b')[1] == "malformed_quote" and SUBJECTS.parse("a; b")[1] == "ok" and SUBJECTS.parse("a")[1] == "single"


@pytest.mark.parametrize(("text", "values"), [("[a; b]; c", ["a", "b", "c"]), ("c | [a | b] | d", ["c", "a", "b", "d"]), ('["a;x"; b]; c', ["a;x", "b", "c"]), ("[a]; c", ["[a]", "c"]), ("[a; b", ["[a", "b"]), ("[a; b] c; d", ["[a", "b] c", "d"])])
def test_bracketed_lists_are_items(text, values):
    assert SUBJECTS.parse(text)[0] == values


def test_malformed_quotes_of_name_lists_are_flagged():
    assert PEOPLE.parse('"Jane Doe and Max Roe') == (['"Jane Doe', "Max Roe"], "malformed_quote") and PEOPLE.parse("Jane Doe and Max Roe")[1] == "ok"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8", exclude_characters="\\"), min_size=1).map(str.strip).filter(bool), min_size=2, max_size=5))
def test_quoted_lists_round_trip(values):
    assert SUBJECTS.parse(";".join('"' + v.replace('"', '""') + '"' for v in values))[0] == values


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_anything_parses(text):
    SUBJECTS.parse(text)
    PEOPLE.parse(text)


def test_operator_edge_cases(spark):
    data = [(1, ["a;b", None, "", "c"], 7), (2, None, 7), (3, [], 7), (1, ["a;b", None, "", "c"], 7), (4, ["x" * 20000 + ";y"], 7)]
    frame = spark.createDataFrame(data, "id int, s array<string>, part_text int")
    got = sorted((r.id, r.elem_pos, r.part_pos, r.part_text[:2], r.n_parts) for r in split_packed(frame, "id", "s").collect())
    assert got == [(1, 0, 0, "a", 2)] * 2 + [(1, 0, 1, "b", 2)] * 2 + [(1, 3, 0, "c", 1)] * 2 + [(4, 0, 0, "xx", 2), (4, 0, 1, "y", 2)]
    assert split_packed(frame.where("false"), "id", "s").count() == 0

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quirework.llm import names as n

GIVEN = frozenset("jane max marieclaude william".split())
SHORT = {"bill": "william"}


@pytest.mark.parametrize(("text", "form"), [
    ("Jane Doe", "jane doe"), ("Doe, Jane", "jane doe"), ("DOE, Jane", "jane doe"), ("Doe Jane", "jane doe"), ("Dr. Jane  Doe", "jane doe"), ("J. Doe", "j. doe"), ("Doe, J.", "j. doe"), ("Doe J", "j. doe"), ("J.K. Doe", "j. k. doe"), ("Doe, J. K.", "j. k. doe"),
    ("Jane van Doe", "jane van_doe"), ("van Doe, Jane", "jane van_doe"), ("Doe, Jane van", "jane van_doe"), ("Bill Doe", "william doe"), ("Jan. Doe", "jan. doe"), ("Marie-Claude Döe", "marieclaude doe"), ("Jane Roe-Doe", "jane roedoe"), ("Doe", "doe"),
])
def test_person_forms(text, form):
    assert n.form(text, "any", GIVEN, SHORT)[:2] == ("person", form)


@pytest.mark.parametrize("text", ["Lane & Roe Publishing House", "The Lane and Roe Publ. House", "LANE + ROE PUBLISHING HOUSE", "Lane&Roe Pub. Hse.", "Lane & Roe Publishing House, Ltd.", "Lane & Roe Publisting House"])
def test_organisation_forms(text):
    assert n.form(text, "org", GIVEN, SHORT)[:2] == ("org", "lane roe publishers house")


def test_more_organisations():
    assert n.organisation_form("Institute of Tidal Studies, Harbour") == n.organisation_form("Harbour Inst. for Tidal Studies")
    assert n.organisation_form("Lane UP") == n.organisation_form("Lane U. Pr.") == ["lane", "university", "press"] and n.form("LRPH", "org", GIVEN, SHORT)[0] == "acronym"


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=6), st.text("abc", max_size=6))
def test_one_edit_equals_brute_force(a, b):
    near = {a[:i] + a[i + 1 :] for i in range(len(a))} | {a[:i] + c + a[i:] for i in range(len(a) + 1) for c in "abc"} | {a[:i] + c + a[i + 1 :] for i in range(len(a)) for c in "abc"}
    near |= {a[:i] + a[i + 1] + a[i] + a[i + 2 :] for i in range(len(a) - 1)}
    assert n.one_edit(a, b) == (b in near and a != b)


@settings(max_examples=200, deadline=None)
@given(st.text("abcdef", min_size=5, max_size=9), st.integers(0, 8), st.sampled_from("xdst"))
def test_index_meets_every_single_edit(token, at, kind):
    at %= len(token)
    other = {"x": token[:at] + "z" + token[at + 1 :], "d": token[:at] + token[at + 1 :], "s": token[:at] + "z" + token[at:], "t": token[:at] + token[at + 1 : at + 2] + token[at] + token[at + 2 :]}[kind]
    keys = lambda t: {k for k, _ in n.deletions(["jane", t])}
    assert keys(token) & keys(other)


def test_assignment():
    assert n.assignment(["j."], ["jane"]) == 1 and n.assignment(["jane"], ["max"]) is None and n.assignment(["j.", "k."], ["jane", "kim"]) == 2 and n.assignment(["k.", "j."], ["jane", "kim"]) == 2.5 and n.assignment(["j."], ["jane", "kim"]) is None


def test_linking(spark):
    people = ["Jane Doe", "Doe, Jane", "J. Doe", "Jnae Doe", "Jane Doe", "Max Roe", "Bill Poe", "William Poe", "Jane Doe; Max Roe", "", None, "Lane & Roe Press", "Mei Kim", "Max Kim", "M. Kim", "Bo Fox Law", "Bo Law"]
    frame = spark.createDataFrame([(i, [p], None, "Lane & Roe Press" if i % 2 else "LRP", "clash") for i, p in enumerate(people)] + [(99, None, [], " The Lane and Roe Press", "clash")], "id int, authors array<string>, contributors array<string>, publisher string, entity string")
    short = spark.createDataFrame([("William", "Bill"), (None, "x")], "given string, short_form string")
    got = {(r.spelling_a, r.spelling_b) for r in n.pairs(n.linked(frame, ["authors", "contributors"], ["publisher"], short)).collect()}
    doe, lane = ["Doe, Jane", "J. Doe", "Jane Doe", "Jnae Doe"], ["LRP", "Lane & Roe Press", "The Lane and Roe Press"]
    assert got == {(a, b) for g in (doe, lane, ["Bill Poe", "William Poe"]) for a in g for b in g if a < b}
    assert n.pairs(n.linked(frame.where("false"), ["authors"], ["publisher"], short)).count() == 0


def test_dropped_middle_names(spark):
    assert n.without_middle(["jane"], ["jane", "kim"]) and n.without_middle(["j."], ["jane", "k."]) and n.without_middle(["jane", "lee"], ["jane", "kim", "lee"])
    assert not n.without_middle(["kim"], ["jane", "kim"]) and not n.without_middle(["jane", "kim"], ["jane", "kim"]) and not n.without_middle(["jane", "lee", "kim"], ["jane", "kim", "lee", "max"])
    people = ["Jane Kim Doe"] * 3 + ["Doe, Jane", "Jane K. Doe"] + ["Max Lee Roe", "Max Kim Roe", "Max Roe"] + ["Bo Fox Law"] * 2 + ["Bo Law"] * 2 + ["Jane Kim Zimmer"] * 3 + ["John Zimmer", "J. Zimmer"]
    frame = spark.createDataFrame([([p], None) for p in people], "authors array<string>, publisher string")
    short = spark.createDataFrame([], "given string, short_form string")
    got = {(r.spelling_a, r.spelling_b) for r in n.pairs(n.linked(frame, ["authors"], ["publisher"], short)).collect()}
    doe = ["Doe, Jane", "Jane K. Doe", "Jane Kim Doe"]
    assert got == {(a, b) for a in doe for b in doe if a < b} | {("J. Zimmer", "John Zimmer")}


def test_components(spark):
    links = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}") for i in range(60)] + [("x", "y"), ("y", "x")], "a string, b string")
    got = {r.node: r.component for r in n.components(links).collect()}
    assert got["n060"] == "n000" and got["y"] == "x" and len(got) == 63

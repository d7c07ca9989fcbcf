"""Fuzzy matching, spans, dates, cleaning and parsing: literal expectations, and simple models on random text."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st

from kgloom.functions import matching as M
from kgloom.functions import spans as P
from kgloom.operators import alignment
from kgloom.operators import extraction as E
from kgloom.session import store

SHORT = st.text("abAB .", max_size=12)


def _table(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@given(SHORT, SHORT)
def test_lcs_is_that_of_the_table(a, b):
    assert M.lcs_length(a, b) == _table(a, b) and 0 <= M.ratio(a, b) <= 1


@given(SHORT, SHORT)
def test_partial_ratio_is_the_best_stretch(a, b):
    a, b = sorted((a, b), key=len)
    cuts = [b[i:j] for i in range(len(b) + 1) for j in range(i, len(b) + 1) if j - i == len(a) or j - i < len(a) and (i == 0 or j == len(b)) and j > i]
    expected = max((M.ratio(a, c) for c in cuts), default=0.0) if a else float(not b)
    assert M.partial_ratio(a, b) == pytest.approx(expected)


@pytest.mark.parametrize(
    ("a", "b", "score"),
    [("Smith Alice", "Alice Smith", 1.0), ("A. Smith", "Alice Smith", 1.0), ("J. Doe", "John Doe", 1.0), ("J. Doe", "K. Doe", 0.05), ("B. Smith", "Alice Smith", None), ("J. K. Rowling", "Joanne K. Rowling", 1.0)],
)
def test_initials(a, b, score):
    got = M.initial_score(a, b)
    assert got == pytest.approx(M.initial_score(b, a))
    assert got == pytest.approx(score) if score is not None else got < 0.75


def test_ascii_and_tokens():
    assert M.to_ascii("šūė Ångström ﬁ") == "sue Angstrom fi" and M.sorted_tokens("b, A_c! b") == "a_c b b"


TEXT = "Intro. Deep Learning for Graphs was written on 10th of May 2026. Constr\nuction wi th L L Ms. See 0000-0001-2345-6789."


@pytest.mark.parametrize(
    ("value", "confidence", "part"),
    [
        ("Deep Learning", 1.0, "Deep Learning"), ("deep learning", 0.95, "Deep Learning"), ("2026-05-10", 0.95, "10th of May 2026"), ("Construction with LLMs", 0.9, "Constr\nuction wi th L L Ms"),
        ("https://orcid.org/0000-0001-2345-6789", 0.85, "0000-0001-2345-6789"), ("Deep  Learning", 0.9, "Deep Learning"),
    ],
)
def test_ladder(value, confidence, part):
    found = P.find_in(TEXT, value)
    assert (TEXT[found.start : found.end], found.confidence) == (part, confidence)


def test_ladder_ends():
    assert P.find_in(TEXT, "  ") is None and P.find_in("", "x") is None and P.find_in(TEXT, "zzzz qqqq jjjj xxxx") is None
    assert 0.8 < P.find_in("We study machine lerning here today.", "machine learning").confidence < 1
    assert P.find_in(TEXT, "Construction wlth Lxx", exact_only=True) is None
    assert P.find_in("the **Bold** claim", "the Bold claim").confidence == 0.88
    found = P.find_in("noise KG Graph noise", "Knowledge Graph")
    assert found.confidence >= 0.5


@pytest.mark.parametrize(
    ("text", "value", "confidence"),
    [("on 10/05/2026 we", "2026-05-10", 0.95), ("on 05/10/2026 we", "2026-05-10", 0.95), ("May 10, 2026", "2026-05-10", 0.95), ("in May 2026", "2026-05-10", 0.75), ("in June 2026", "2026-05-10", None), ("10 May 2025", "2026-05-10", None), ("Sept. 3, 2020", "2020-09-03", 0.95), ("x", "2026-13-40", None)],
)
def test_dates(text, value, confidence):
    found = P.date_span(text, value)
    assert (found and found.confidence) == confidence


def test_windows_and_penalties():
    text = "# Head\nnothing here\n# Methods\nthe value stands here\n# End\n" + "x " * 200 + "late thing"
    head = P.Window("head", 10)
    assert P.section(text, "methods") == (text.index("# Methods") + 9, text.index("# End"))
    assert P.find_span(text, "value", [P.Window("section", heading="Methods")])[2:] == (1.0, True)
    assert P.find_span(text, "value", [head], P.Penalties(distance=0))[2:] == (0.8, False)
    assert P.find_span(text, "late thing", [head])[2] < P.find_span(text, "value", [head])[2]
    assert P.find_span(text, "late thing", [P.Window("section", heading="none")])[3] is True
    assert P.find_span(text, "thing", [P.Window("tail", 20), head])[2:] == (1.0, True)


@given(st.text("ab \n.!?é", max_size=60))
def test_sentences_are_slices(text):
    for start, sentence in P.sentences(text):
        assert text[start : start + len(sentence)] == sentence == sentence.strip() != ""


def test_sentences_and_windows():
    assert P.sentences("One. Prof. Smith came! Next\n\nlast") == [(0, "One. Prof. Smith came!"), (23, "Next"), (29, "last")]
    assert P.best_window("xx hello yy", "helo!") in {(3, 8), (2, 7)} and P.best_window("ab", "abc") == (0, 2)
    assert P.occurrences("aAa", "aa") == [0, 1] and P.occurrences("abc", "") == []


def test_relocation():
    text = "2020" + " " * 50 + "The Title" + " " * 12 + "2020"
    members = [{"value": "2020", "span_start": 0, "span_end": 4}, {"value": "The Title", "span_start": 54, "span_end": 63}]
    assert P.relocate(members, text)[0]["span_start"] == 75
    assert P.relocate(members[:1], text) == members[:1] and members[0]["span_start"] == 0


# ---- extraction -----------------------------------------------------------------------------------------------


def test_ids():
    slots = E.Slots(names=("name", "title"))
    cut = lambda item: E.fallback_id(item, slots, "d").rpartition("_")[0]
    assert cut({"name": "John Smith"}) == "kg:Smith_J" and cut({"name": "Anna Bea Chen Jr."}) == "kg:Chen_AB" and cut({"name": "Einstein"}) == "kg:Einstein"
    assert cut({"title": "A very long title that goes on and on and on and on"}) == "kg:A_very_long_title_that_goes_on_and_on" and cut({"x": 1}) == "kg:entity"
    assert E.fallback_id({"name": "A"}, slots, "d") != E.fallback_id({"name": "A"}, slots, "e")


def test_cleaning():
    slots = E.Slots(uris=frozenset(["url"]), names=("name",))
    raw = {"id": "AUTO", "name": "Ann­B​", "url": "nope", "links": [], "by": {"id": "x"}, "of": [{"id": "k:1", "name": "P"}, {"id": "k:1", "name": "", "mail": "m"}, None, "", {}, "AUTO:3", {"id": "only"}, "text"]}
    got = E.clean(raw, slots, "doc")
    assert got["name"] == "Ann-B" and got["id"].startswith("kg:Ann-B_") and "url" not in got and "links" not in got and "by" not in got
    assert got["of"] == [{"id": "k:1", "name": "P", "mail": "m"}, "text"]
    assert E.clean(got, slots, "doc") == got


def test_parsing():
    assert E.parse('```json\n{"a": [1]}\n```') == {"a": [1]}
    many = frozenset(["author"])
    assert E.parse("Title: One\n two\nAuthors: A; B\n1. C\n- D", many, frozenset(["title"])) == {"title": "One two", "author": ["A", "B", "C", "D"]}
    assert E.parse("no fields at all") == {}


@given(st.text("ab. !\n", max_size=80), st.integers(1, 20))
def test_chunks_put_together_are_the_text(text, size):
    parts = E.chunks(text, size)
    assert "".join(parts) == text and all(0 < len(p) <= size for p in parts)


def test_random_spans_lie_in_the_text():
    rng = random.Random(2)
    for _ in range(100):
        text = "".join(rng.choice("ab cde.\n*") for _ in range(80))
        at = rng.randrange(60)
        value = "".join(c for c in text[at : at + 12] if rng.random() > 0.1)
        found = P.find_in(text, value)
        if value.strip():
            assert found is None or 0 <= found.start < found.end <= len(text) and 0 <= found.confidence <= 1


def test_similar_names_against_all_pairs(spark):
    """Any bound, on names that are short, empty, equal but for their order, or written with marks and odd letters."""
    rng = random.Random(7)
    words = ["ana", "anna", "Maria", "jo", "x", "ß", "I\u0307z", "e\u0301a", "\u0130zmir", "lee", "leeds", "aaaa", "abab"]
    names = sorted({" ".join(rng.choices(words, k=rng.randint(0, 4))) for _ in range(90)} | {"", "!", "a", "b", "ab", "ba", "aaaaaaaa", "aaaaaaaaa"})
    df = spark.createDataFrame([(b, n) for b in "pq" for n in names if b == "p" or len(n) % 2] + [("p", None)], "block string, name string")
    for least in (0.6, 0.7, 0.8, 0.9, 1.0):
        got = {(r.block, r["__x"], r["__y"]): r.fuzz for r in alignment.similar_names(df, ["block"], "name", least).collect()}
        of = {b: [n for n in names if b == "p" or len(n) % 2] for b in "pq"}
        want = {(b, x, y): M.fuzz_score(x, y) for b in "pq" for x in of[b] for y in of[b] if x <= y and M.fuzz_score(x, y) >= least}
        assert got == want, least


def test_few_names_of_a_large_block_meet(spark):
    rng = random.Random(3)
    syllables = [a + b + c for a in "bcdfghklmnprstvz" for b in "aeiou" for c in ("", "n", "r", "ss", "th")]
    names = list({" ".join("".join(rng.choices(syllables, k=rng.randint(2, 4))) for _ in range(3)) for _ in range(3000)})
    names += [n[:-1] + "x" for n in names[:100]]
    met = []

    def keep(df):
        out = store(df)
        if "__y" in out.columns:
            met.append(out.count())
        return out

    df = spark.createDataFrame([("one", n) for n in names], "block string, name string")
    found = {(r["__x"], r["__y"]) for r in alignment.similar_names(df, ["block"], "name", 0.9, keep).where("__x <> __y").collect()}
    close = {tuple(sorted((n, n[:-1] + "x"))) for n in names[:100] if M.fuzz_score(n, n[:-1] + "x") >= 0.9}
    assert found >= close and len(close) > 50
    assert met[0] < len(names) ** 2 / 2 / 20


@given(st.text("aB *_`–—\n\t\u2003\U0001f600", max_size=40), st.booleans())
def test_collapsed_texts_have_small_places(text, marks):
    out, places = [], []
    for i, c in enumerate(text):
        if marks and c in "*_`" or c.isspace() and (not out or out[-1] == " "):
            continue
        out.append(" " if c.isspace() else "-" if marks and c in "–—" else c)
        places.append(i)
    flat, found = P.collapse(text, marks)
    assert (flat, list(found)) == ("".join(out), places) and found.nbytes == 4 * len(places)


def test_collapse_keeps_nulls(spark):
    got = spark.createDataFrame([(1, None), (2, " a  b")], "n int, t string").select("n", P.collapse_udf(False)("t").alias("x")).orderBy("n").collect()
    assert got[0]["x"] is None or got[0]["x"]["flat"] is None
    assert got[1]["x"].asDict() == {"flat": "a b", "places": [1, 2, 4]}


def test_windows_are_given_for_few_texts_at_a_time(spark):
    assert [len(x) for x in P.few([pa.array(range(130)), pa.array([1])])] == [64, 64, 2, 1]
    seen = []

    def noted(texts):
        return (x for x in P.windows_udf({"head": P.Window("head", 3)}).func(seen.append(len(t)) or t for t in texts))

    assert [len(x) for x in noted([pa.array(["abcd", None] * 100)])] == [64, 64, 64, 8] and seen == [200]


def test_a_cut_stretch_is_not_in_its_window():
    text, tail = "x" * 50 + " needle here", [P.Window("tail", 11)]
    assert P.find_span(text, " needle here", tail, exact_only=True)[2:] == (0.9, True)
    assert P.find_span(text, " needle here", tail, exact_only=True, rungs=P.LITERAL) == (50, 62, 0.8, False)


def test_penalties_round_halves_up():
    assert [P._rounded(x) for x in (0.57095, 0.74195, 0.64125, 0.25, 0.99995)] == [0.571, 0.742, 0.6413, 0.25, 1.0]


@given(SHORT, SHORT)
def test_best_stretch_passes_over_none_that_is_better(a, b):
    if a and len(a) <= len(b):
        every = [_table(a, b[i : i + len(a)]) for i in range(len(b) - len(a) + 1)]
        assert M.best_stretch(a, b) == (max(every), every.index(max(every)))


@given(SHORT, SHORT)
def test_partial_ratio_is_the_best_of_all_stretches(a, b):
    a, b = sorted((a, b), key=len)
    n = len(a)
    stretches = [b[i : i + n] for i in range(len(b) - n + 1)] + [x for i in range(1, n) for x in (b[:i], b[-i:])]
    wanted = max((2 * _table(a, s) / (n + len(s)) for s in stretches), default=0.0) if a else 0.0 if b else 1.0
    assert M.partial_ratio(a, b) == wanted


def test_similar_stretches_of_a_long_text_are_passed_over(monkeypatch):
    looked, common = [], M._common
    monkeypatch.setattr(M, "_common", lambda hits, full: looked.append(1) or common(hits, full))
    assert M.best_stretch("needle in the hay", "abcdefgh" * 100 + "needle is the hay" + "abcdefgh" * 100) == (16, 800) and len(looked) < 800

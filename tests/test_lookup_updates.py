"""Lookup, clients, YAML, updates, curation, similar pairs: literal expectations and brute force."""

from __future__ import annotations

import json
import random
import statistics
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kgloom.functions import matching as M
from kgloom.functions import spans as P
from kgloom.operators import access, algebra, passages
from kgloom.operators import alignment as A
from kgloom.operators import confidence as C
from kgloom.operators import extraction as E
from kgloom.operators import lookup as L
from kgloom.operators import statements as S
from kgloom.plans import sparql
from kgloom.session import clear, store, work_folder
from kgloom.sources import clients, files, yaml

# ---- clients and lookup ---------------------------------------------------------------------------------------


def test_answers_are_batched_and_tried_again():
    asked, fails = [], [2]

    def call(some: list[str]) -> list[str]:
        asked.append(len(some))
        if fails[0]:
            fails[0] -= 1
            raise OSError("busy")
        return [x.upper() for x in some]

    assert list(clients.answers(["a", "b", "c"], call, batch=2, pause=0)) == ["A", "B", "C"] and asked == [2, 2, 2, 1]
    fails[0] = 9
    with pytest.raises(clients.ServiceError):
        list(clients.answers(["a"], call, pause=0))
    with pytest.raises(clients.ServiceError):
        list(clients.answers(["a", "b"], lambda some: ["x"], pause=0))


def test_each_text_is_asked_once(spark):
    rows = spark.createDataFrame([("a",), ("a",), ("b",), (None,), (" ",)], "text string")
    got = clients.ask(rows, "text", lambda some: [[float(len(x))] for x in some], "array<double>", tasks=2)
    assert sorted((r.text, r.answer) for r in got.collect()) == [("a", [1.0]), ("b", [1.0])]
    assert sorted(str(r.embedding) for r in clients.embedded(rows, "text", got).collect()) == ["None", "None", "[1.0]", "[1.0]", "[1.0]"]


def test_rules_and_queries(spark):
    entities = spark.createDataFrame([("u", "t", {"name": [" A ", "", "B"], "work": ["W"]}), ("v", "t", {"work": ["W"]}), ("w", "other", {"name": ["A"]}), ("x", "t", {"id": ["1"], "name": [" "]})], f"uri string, type string, literals {L.LITERALS}")
    rules = L.TypeRules((L.Rule(("name",), optional=("work",)), L.Rule(("name", "work")), L.Rule(("name", "none"), require_all=True)), require_any_of=("name",))
    source = L.Source("s", {"t": rules}, lambda q: q, entities, identifier="id", field_names={"name": "n"})
    got = {(r.uri, r.query) for r in L.queries(entities, source).collect()}
    assert got == {("u", 'n:"A" AND work:"W"'), ("u", 'n:"B" AND work:"W"')}
    with pytest.raises(ValueError):
        L.candidate_literals(F.lit("x"), F.col("d"), {"p": [("string_claims", None)]})
    with pytest.raises(ValueError):
        L.candidate_literals(F.lit("x"), F.col("d"), {"p": [("elsewhere", None)]})


# ---- YAML -----------------------------------------------------------------------------------------------------

SCALARS = st.none() | st.booleans() | st.integers(-(10**9), 10**9) | st.floats(allow_nan=False, allow_infinity=False) | st.text("abc :#-[]{}'\"\\\n,é|>&*!%@`~0.1e", max_size=12)
VALUES = st.recursive(SCALARS, lambda inner: st.lists(inner, max_size=4) | st.dictionaries(st.text("abc _-é", min_size=1, max_size=6), inner, max_size=4), max_leaves=12)


@settings(max_examples=300, deadline=None)
@given(VALUES)
def test_yaml_round_trip(value):
    assert yaml.load(yaml.dump(value)) == value


def test_yaml_forms():
    text = "# c\na: 1  # one\nb:\n  - x: 'it''s'\n    y: [1, two, {k: v}]\n  -\n    - deep\nc: |\n  line\n    more\nd: >-\n  folded\n  text\ne: plain\n  goes on\n'f': {p: [q]}\ng: ~\nh: 1.5e3\nurl: http://x/y#z\n"
    assert yaml.load(text) == {"a": 1, "b": [{"x": "it's", "y": [1, "two", {"k": "v"}]}, ["deep"]], "c": "line\n  more\n", "d": "folded text", "e": "plain goes on", "f": {"p": ["q"]}, "g": None, "h": 1500.0, "url": "http://x/y#z"}
    for bad in ("a: *ref\n", "a: &x 1\n", "a: [1, 2\n", "a: 1\n   b: 2\nc"):
        with pytest.raises(yaml.YamlError):
            yaml.load(bad)


def test_config_defaults(tmp_path):
    assert files.parse_config("settings:\n  a: 2\n", {"settings": {"a": 1, "b": 3}, "c": 4}) == {"settings": {"a": 2, "b": 3}, "c": 4}
    assert files.read_config(f"{tmp_path}/none.yaml", {"x": 1}) == {"x": 1}


# ---- queries and updates --------------------------------------------------------------------------------------


def _quads(spark):
    return spark.createDataFrame([("g", "a", "p", "b"), ("g", "b", "p", "c"), ("h", "a", "p", "z")], "g string, s string, p string, o string")


def test_updates(spark):
    text = "INSERT DATA { GRAPH <n> { <x> <y> <z> } } ; WITH <g> DELETE { ?s <p> ?o } INSERT { GRAPH <i> { ?o <q> ?s } } WHERE { ?s <p> ?o FILTER(?o = 'b') } ; DROP SILENT GRAPH <none> ; CLEAR GRAPH <h> ; DELETE DATA { GRAPH <g> { <b> <p> <c> } }"
    assert sorted(map(tuple, sparql.update(text, _quads(spark), store).collect())) == [("i", "b", "q", "a"), ("n", "x", "y", "z")]
    for bad in ("INSERT DATA { <a> <b> ?c }", "DELETE { ?s <p>+ ?o } WHERE { ?s <p> ?o }", "INSERT { <a> <b> <c> }", "SELECT * { ?s ?p ?o }", "DROP <x>"):
        with pytest.raises(sparql.QueryError):
            sparql.update(bad, _quads(spark), store)


def test_graphs_and_time(spark):
    quads = _quads(spark)
    run = lambda q, **more: sorted(map(tuple, sparql.run(q, quads, **more).collect()))
    assert run("SELECT ?g ?o { GRAPH ?g { <a> <p> ?o } }") == [("g", "b"), ("h", "z")] and run("SELECT ?g ?o { GRAPH ?g { <a> <p> ?o } }", graph="g") == [("g", "b")]
    assert run("SELECT ?o { GRAPH <h> { <a> <p> ?o } }", graph="g") == [] and run("SELECT ?s { GRAPH <g> { ?s <p>+ <c> } }") == [("a",), ("b",)]
    assert run("CONSTRUCT { ?o <q> ?s } WHERE { ?s <p> ?o }", graph="g") == [("b", "q", "a"), ("c", "q", "b")]
    with pytest.raises(sparql.QueryError):
        run("SELECT ?s { GRAPH ?g { ?s <p>* ?o } }")
    with pytest.raises(sparql.QueryTimeout):
        sparql.within(spark.range(10**12).select(F.sum(F.sqrt("id"))), 0.5)
    assert sparql.within(spark.range(3), 60, lambda df: df.count()) == 3


def test_paths_of_any_graph(spark):
    rng = random.Random(3)
    for _ in range(3):
        edges = list({(rng.randrange(14), rng.randrange(14)) for _ in range(18)}) + [(100 + i, 101 + i) for i in range(20)]
        reach = set(edges)
        while more := {(a, d) for a, b in reach for c, d in edges if b == c} - reach:
            reach |= more
        seeds = [0, 1, 5, 100, 110, 999]
        got = algebra.path_plus(spark.createDataFrame(edges, "src int, dst int"), spark.createDataFrame([(s,) for s in seeds], "start int"), store).collect()
        assert sorted(map(tuple, got)) == sorted((a, b) for a, b in reach if a in seeds)


# ---- curation -------------------------------------------------------------------------------------------------


def test_access(spark):
    members = spark.createDataFrame([("u", 1, "owner"), ("v", 1, "editor")], "user_id string, workspace_id int, role string")
    asked = spark.createDataFrame([("u", 1, ["owner"]), ("v", 1, ["owner"]), ("v", 1, ["owner", "editor"]), ("w", 1, ["owner"]), ("u", 2, ["owner"])], "user_id string, workspace_id int, roles array<string>")
    got = access.decide(asked, members, spark.createDataFrame([(1,)], "workspace_id int"))
    assert sorted((r.user_id, r.workspace_id, len(r.roles), r.answer) for r in got.collect()) == [("u", 1, 1, 200), ("u", 2, 1, 404), ("v", 1, 1, 403), ("v", 1, 2, 200), ("w", 1, 1, 403)]


def test_tasks_and_tables(spark):
    tasks = spark.createDataFrame([(1, "Queued", "a"), (2, "Failed", "a"), (3, "Done", "a"), (4, "Running", "a")], "doc_id int, status string, stage string")
    changes = spark.createDataFrame([(1, "Done", "b"), (2, "Running", "b"), (3, "Running", "b"), (4, "Waiting", "b")], "doc_id int, status string, stage string")
    assert sorted(map(tuple, S.update_tasks(tasks, changes).collect())) == [(1, "Queued", "a"), (2, "Failed", "a"), (3, "Done", "a"), (4, "Waiting", "b")]
    table = spark.createDataFrame([(1, "a", None), (2, "b", "x")], "k int, v string, w string")
    new = files.changed(table, "k", inserts=spark.createDataFrame([(3, "c", "y")], "k int, v string, w string"), updates=spark.createDataFrame([(1, None), (9, "z")], "k int, v string"), deletes=spark.createDataFrame([(2,)], "k int"))
    assert sorted(map(tuple, new.collect())) == [(1, None, None), (3, "c", "y")]


# ---- scores ---------------------------------------------------------------------------------------------------


def test_similar_pairs_are_those_of_all_pairs(spark):
    rng = random.Random(8)
    names = [" ".join("".join(rng.choice("abcd") for _ in range(rng.randrange(1, 7))) for _ in range(rng.randrange(1, 4))) for _ in range(60)] + [None, ""]
    rows = [(f"u{i:03d}", rng.choice(names), rng.randrange(2)) for i in range(150)]
    got = A.similar_pairs(spark.createDataFrame(rows, "uri string, name string, b int"), ["b"], "name", 0.8)
    want = sorted((x[0], y[0]) for x in rows for y in rows if x[0] < y[0] and x[2] == y[2] and x[1] is not None and y[1] is not None and M.fuzz_score(x[1], y[1]) >= 0.8)
    assert sorted((r.a_uri, r.b_uri) for r in got.collect()) == want and len(want) > 100


def test_medians_of_the_others(spark):
    rng = random.Random(2)
    rows = [(g, f"{g}-{i}", rng.randrange(9)) for g in range(12) for i in range(g)]
    got = {r.i: r.others for r in C.others_median(spark.createDataFrame(rows, "g int, i string, x int"), "g", "i", "x").collect()}
    assert got == {i: (float(statistics.median(others)) if (others := [y for h, j, y in rows if h == g and j != i]) else None) for g, i, _ in rows}


def test_links_by_strategy(spark):
    literals = spark.createDataFrame([("a", "http://x/name", 10, 0.5), ("b", "http://x/name", 110, 0.9), ("b", "http://x/date", 130, 0.7), ("c", "http://x/name", 900, 0.4)], "s string, p string, start int, confidence double")
    links = spark.createDataFrame([("a", f"http://x/{p}", o) for p in ("t", "pair", "near", "in", "lead", "skip") for o in ("b", "c", "d")], "s string, p string, o string")
    strategies = {"pair": C.Strategy("pair"), "near": C.Strategy("cooccurrence", outliers=True), "in": C.Strategy("sections", sections=((100, 200),)), "lead": C.Strategy("hierarchy", sections=((0, 200),), leading=("date",))}
    got = {(r.p[9:], r.o): r.confidence for r in C.annotate_links(links, literals, F.lit(1000), strategies, excluded=frozenset(["skip"])).collect()}
    near = {o: round((0.5 + m) / 2 * max(0.3, 1 - abs(at - 10) / 1000), 4) for o, m, at in (("b", 0.8, 120), ("c", 0.4, 900))}
    assert got == {
        ("t", "b"): 0.8, ("t", "c"): 0.4, ("pair", "b"): 0.7, ("pair", "c"): 0.45, ("pair", "d"): 0.5, ("in", "b"): 0.8, ("in", "c"): round(0.4 * 0.8 * 0.3, 4), ("lead", "b"): 0.8,
        ("near", "b"): round(near["b"] * (1 - 390 / 1000), 4), ("near", "c"): round(near["c"] * (1 - 390 / 1000), 4),
    }


def test_type_settings():
    config = {"settings": {"default_threshold": 0.7}, "entity_types": {"P": {"threshold": 0.9, "weights": {"syntactic": 1.0}}, "Q": {"weights": {"syntactic": 0.4}}}}
    assert A.type_config(config, "P").threshold == 0.9 and A.type_config(config, "P").semantic == 0 and A.type_config(config, "other").threshold == 0.7 and A.type_config({}, "x").structural == 0.15
    with pytest.raises(ValueError):
        A.type_config(config, "Q")
    A.check_weights({}, "none")


# ---- extraction and spans -------------------------------------------------------------------------------------


def test_objects_of_chunks():
    assert E.merge_objects([{"a": [1, 2], "b": "x", "c": ""}, {"a": [2, 3, 3], "b": "", "c": "y"}, {"d": 0}]) == {"a": [1, 2, 3], "b": "x", "c": "y", "d": 0}
    assert E.payload({"extracted_object": None, "prompt": "p", "x": [None, {}, {"y": [None]}]}) == {"x": [{"y": []}]}
    assert json.loads(json.dumps(E.payload({"extracted_object": {"a": 1}}))) == {"a": 1}


@pytest.mark.parametrize(
    ("text", "value", "languages", "found"),
    [
        ("am 3. März 2021 war", "2021-03-03", ("de",), ("3. März 2021", 0.95)), ("le 14 juillet 1999,", "1999-07-14", ("en", "fr"), ("14 juillet 1999", 0.95)), ("el 3 de mayo de 2020", "2020-05-03", ("es",), ("3 de mayo de 2020", 0.95)),
        ("am 3. März 2021", "2021-03-03", ("en",), None), ("04/05/2020", "2020-04-05", ("en",), ("04/05/2020", 0.95)), ("Sept. 2020", "2020-09-03", ("en",), ("Sept. 2020", 0.75)), ("in maart 2019", "2019-03-01", ("nl",), ("maart 2019", 0.75)),
    ],
)
def test_dates_in_languages(text, value, languages, found):
    got = P.date_span(text, value, languages)
    assert (got and (text[got.start : got.end], got.confidence)) == found


def test_occurrences_of_many():
    rng = random.Random(1)
    text = "".join(rng.choice("abAB ") for _ in range(400))
    values = ["a", "ab", "aba", "bb", "zz", " a", ""]
    assert P.occurrences_of(text, values) == {v: P.occurrences(text, v) for v in values}


def test_window_choice():
    text = "x" * 50 + "needle" + "y" * 44
    assert P.find_span(text, "needle", [P.Window("head", 20)]) == (50, 56, round(0.8 * (1 - 30 / 100), 4), False)
    assert P.find_span(text, "needle", [P.Window("tail", 60)]) == (50, 56, 1.0, True) and P.find_span(text, "needle") == (50, 56, 1.0, True)
    assert P.find_span(text, "needle", [P.Window("head", 60), P.Window("section", heading="none")])[3] and P.find_span("", "x", [P.Window("head", 5)]) is None


# ---- many values, and what is left behind -----------------------------------------------------------------------


def test_values_in_parts(spark, monkeypatch):
    rng = random.Random(5)
    texts = [(i, "".join(rng.choice("abc ") for _ in range(200))) for i in range(20)]
    values = [(i, "".join(rng.choice("abc ") for _ in range(rng.randrange(0, 5)))) for i in range(80)] + [(99, None)]
    want = sorted((i, k, t.find(x)) for i, t in texts for k, x in values if x and x in t)
    df, asked = spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame(values, "k int, value string")
    for most in (20_000_000, 60):
        monkeypatch.setattr(passages, "MOST_CHARS", most)
        assert sorted((r.id, r.k, r.start) for r in passages.find_values(df, asked, "id", "text", "k", "value").collect()) == want
    monkeypatch.setattr(passages, "LONGEST", 2)
    found = passages.find_values(df, asked, "id", "text", "k", "value").collect()
    assert sorted((r.id, r.k, r.start) for r in found) == want and all(r.end - r.start == len(dict(values)[r.k]) for r in found)


def test_rules_for_all_other_types(spark):
    """Entities of any number of types are asked for, none is left out."""
    entities = spark.createDataFrame([(f"u{i}", f"t{i}", {"name": [f"n{i}"]}) for i in range(250)], f"uri string, type string, literals {L.LITERALS}")
    source = L.Source("s", {"t3": L.TypeRules((L.Rule(("none",)),))}, lambda q: q, entities, join_with=" ", others=L.TypeRules((L.Rule(("name",)),)))
    assert {(r.uri, r.query) for r in L.queries(entities, source).collect()} == {(f"u{i}", f"n{i}") for i in range(250) if i != 3}


def test_intermediate_tables_can_be_cleared(spark):
    kept = store(spark.range(5).toDF("id"))
    folder = Path(work_folder(spark).removeprefix("file:"))
    assert kept.count() == 5 and any(folder.iterdir())
    clear(spark)
    assert not folder.exists() and store(spark.range(2).toDF("id")).count() == 2


def test_derived_literals(spark):
    """Both directions, missing and null values, several rules for a name, repeated relations."""
    rows = [("a", "P", {"id": ["http://x/1", "http://y/1", "2"]}), ("b", "P", {"id": []}), ("o", "O", {"name": ["N", None]}), ("w", "W", {"doi": ["d2", "d1"]}), ("v", "W", {"doi": ["d1"]})]
    entities = spark.createDataFrame(rows, f"uri string, type string, literals {L.LITERALS}")
    relations = spark.createDataFrame([("w", "author", "a"), ("w", "author", "a"), ("v", "author", "a"), ("a", "at", "o"), ("b", "at", "gone"), ("o", "at", "o")], "s string, p string, o string")
    rules = [L.Derivation("P", "key", "id"), L.Derivation("P", "doi", "doi", "author", True), L.Derivation("P", "place", "id"), L.Derivation("P", "place", "name", "at")]
    got = {r.uri: r.literals for r in L.derive(entities, relations, rules).collect()}
    assert got["a"] == {"id": ["http://x/1", "http://y/1", "2"], "key": ["1", "2"], "doi": ["d1", "d2"], "place": ["N"]}
    assert got["b"] == {"id": []} and got["o"] == {"name": ["N", None]} and len(got) == 5

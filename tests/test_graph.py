"""The algebra, paths, components, the statement log, the SPARQL front-end and the RDF sources."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from kgloom.operators import algebra as A
from kgloom.operators import alignment, export
from kgloom.operators import statements as S
from kgloom.operators.components import connected_components
from kgloom.plans.sparql import QueryError, parse, query_prefixes, run
from kgloom.session import store
from kgloom.sources import rdf

TRIPLES = [("a", "knows", "b"), ("b", "knows", "c"), ("c", "knows", "a"), ("a", "name", "Ann"), ("b", "name", "Bob"), ("d", "knows", "d"), ("a", "age", "30"), ("b", "age", "4")]


@pytest.fixture(scope="module")
def graph(spark):
    return spark.createDataFrame(TRIPLES, "s string, p string, o string").cache()


def _rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_patterns_and_joins(graph):
    assert _rows(A.pattern(graph, "?x", "knows", "?x"), "x") == [("d",)]
    assert _rows(A.bgp(graph, [("?x", "knows", "?y"), ("?y", "name", "?n")]), "x", "n") == [("a", "Bob"), ("c", "Ann")]
    optional = A.optional(A.pattern(graph, "?x", "knows", "?y"), A.pattern(graph, "?y", "name", "?n"), F.col("n") == "Ann")
    assert sorted((r.x, r.n) for r in optional.collect() if r.n) == [("c", "Ann")] and optional.count() == 4
    assert A.values(graph, ["s", "p"], [("a", None), ("b", "name")]).count() == 4
    assert A.ask(A.pattern(graph, "a", "knows", "c")).first().answer is False
    assert _rows(A.minus(A.pattern(graph, "?x", "knows", "?y"), A.pattern(graph, "?x", "name", "?n")), "x") == [("c",), ("d",)]


def test_updates_keep_sets(graph):
    more = graph.limit(0).union(graph.where("p = 'name'"))
    assert A.insert_data(graph, more).count() == len(TRIPLES)
    assert A.delete_data(graph, more).count() == len(TRIPLES) - 2
    renamed = A.modify(graph, A.pattern(graph, "?x", "name", "?n"), [("?x", "name", "?n")], [("?x", "label", "?n")])
    assert _rows(A.pattern(renamed, "?x", "label", "?n"), "x") == [("a",), ("b",)] and renamed.count() == len(TRIPLES)


def test_paths_against_search(spark):
    rng = random.Random(4)
    edges = [(str(rng.randrange(12)), str(rng.randrange(12))) for _ in range(14)]
    df = spark.createDataFrame(edges, "src string, dst string")
    seeds = spark.createDataFrame([(str(i),) for i in range(13)], "start string")
    expected = set()
    for i in range(13):
        front, seen = {str(i)}, set()
        while front:
            front = {d for s, d in edges if s in front} - seen
            seen |= front
        expected |= {(str(i), x) for x in seen}
    assert {tuple(r) for r in A.path_plus(df, seeds, store).select("start", "node").collect()} == expected
    assert {tuple(r) for r in A.path_star(df, seeds, store).select("start", "node").collect()} == expected | {(str(i), str(i)) for i in range(13)}


@pytest.mark.parametrize("seed, most", [(294, 12), (0, 3_500)])
def test_what_a_path_stores_follows_what_its_seeds_reach(spark, seed, most):
    """A chain of 300 edges: one seed near its end stores little, one at its start no square of it, in few rounds."""
    stored = []

    def keep(df):
        out = store(df)
        stored.append(out.count())
        return out

    edges = spark.range(300).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    found = A.path_plus(edges, spark.createDataFrame([(seed,)], "start long"), keep)
    assert {r.node for r in found.collect()} == set(range(seed + 1, 301))
    assert sum(stored) <= most and len(stored) < 40


def test_long_inline_data(spark, monkeypatch):
    monkeypatch.setattr(A, "INLINE_ROWS", 2)
    left = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", None)], "s string, p string")
    rows = [("a", "x"), ("a", None), (None, "y"), ("b", "y"), (None, None), ("z", "z")]
    want = sorted((s, str(p)) for s, p in [("a", "x"), ("a", "x"), ("b", "y"), ("b", "y"), ("a", "x"), ("b", "y"), ("c", None)])
    assert sorted((r.s, str(r.p)) for r in A.values(left, ["s", "p"], rows).collect()) == want
    assert A.values(left, ["s", "p"], []).count() == 0


@pytest.mark.parametrize("kind", ["random", "path", "empty"])
def test_components_against_union_find(spark, kind):
    rng = random.Random(5)
    edges = {"random": [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(3, 3), (None, 4)], "path": [(i, i + 1) for i in range(40)], "empty": []}[kind]
    parent = {x: x for e in edges if None not in e for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = connected_components(spark.createDataFrame(edges, "src long, dst long"), store).collect()
    assert {r.node: r.component for r in got} == {x: find(x) for x in parent}


# ---- the log --------------------------------------------------------------------------------------------------

VERSION = "doc_id long, stmt_id string, root_id string, version_no long, parent_id string, parent_kind string, s string, p string, o string, o_kind string, is_current boolean, status string, activity_type string, activity_id string, confidence double, span_start long, span_end long"


@pytest.fixture
def log(spark):
    rows = [(i, f"s{i}", f"s{i}", 0, f"doc{i}", "document", f"e{i}", "name", f"text {i}", "literal", True, "pending", "extraction", f"x{i}", 0.5, 1, 5) for i in range(3)]
    return spark.createDataFrame(rows, VERSION)


def _ids(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "stmt_id string")


def test_accept_reject_reset(spark, log):
    data = log.select("s", "p", "o").limit(0)
    one, data = S.accept(log, data, _ids(spark, "s0", "s1"))
    one, data = store(one), store(data)
    assert data.count() == 2 and one.count() == 5 and one.where("is_current").count() == 3
    with pytest.raises(S.ActionError):
        S.accept(one, data, _ids(spark, "s0"))
    with pytest.raises(S.ActionError):
        S.accept(one, data, _ids(spark, "s0+1", "s2"))
    with pytest.raises(S.ActionError):
        S.reset(one, data, _ids(spark, "s2"))
    two, data = S.reject(one, data, _ids(spark, "s0+1"))
    two, data = store(two), store(data)
    assert _rows(data, "s") == [("e1",)]
    three, data = S.edit(two, data, _ids(spark, "s1+1"), o=F.lit("new"))
    three, data = store(three), store(data)
    assert data.count() == 0 and _rows(S.current(three), "o", "status") == [("new", "accepted"), ("text 0", "rejected"), ("text 2", "pending")]
    four, _ = S.reset(three, data, _ids(spark, "s1+2"))
    assert _rows(S.current(four).where("root_id = 's1'"), "o", "status", "stmt_id") == [("text 1", "pending", "s1+3")]
    left, _ = S.delete_document(four, data, 1)
    assert left.where("doc_id = 1").count() == 0 and left.count() == four.count() - 4
    counts = {r.doc_id: (r.triples, r.pending) for r in S.triple_counts(four, spark.createDataFrame([(0,), (1,), (9,)], "doc_id long")).collect()}
    assert counts == {0: (1, 0), 1: (1, 1), 9: (0, 0)}


# ---- alignment and export -------------------------------------------------------------------------------------


def test_identifier_conflicts(spark):
    rows = [("a", "T", ["1"], ["x"]), ("b", "T", ["1"], ["y"]), ("c", "T", ["2"], []), ("d", "T", [], []), ("e", "U", ["1"], ["x"])]
    entities = spark.createDataFrame(rows, "uri string, type string, doi array<string>, issn array<string>")
    kept = alignment.candidate_pairs(entities, ["type"], ~alignment.conflict(["doi", "issn"], "a", "b"))
    assert _rows(kept, "a_uri", "b_uri") == [("a", "b"), ("a", "d"), ("b", "d"), ("c", "d")]


def test_scores(spark):
    config = alignment.TypeConfig(0.8, 0.6, 0.3, 0.1, sparsity=0.5, hard_match=(("name", 0.9),))
    with pytest.raises(ValueError):
        alignment.TypeConfig(0.8, 0.9, 0.3, 0.3)
    df = spark.createDataFrame([(1.0, 0.5), (0.8, None), (None, None)], "x double, y double")
    got = df.select(alignment.syntactic([F.col("x"), F.col("y")], config).alias("s"), alignment.combined(config, F.lit(1.0), F.lit(1.0), F.lit(0.4), {"name": F.col("x")}).alias("c")).collect()
    assert [(r.s, round(r.c, 6)) for r in got] == [(0.75, 0.94), (0.4, 0.0), (0.0, 0.94)]


def test_deduplicated_export(spark):
    triples = spark.createDataFrame([("http://x/a_0a1b2c", "name", "A"), ("http://x/b_0a1b2d", "name", "B"), ("http://x/a_0a1b2c", "sameAs", "http://x/b_0a1b2d"), ("http://x/b_0a1b2d", "knows", "http://x/a_0a1b2c"), ("http://x/c_111111", "name", "C"), ("http://x/c_222222", "name", "C")], "s string, p string, o string")
    pairs = spark.createDataFrame([("http://x/b_0a1b2d", "http://x/a_0a1b2c")], "a string, b string")
    got = _rows(export.deduplicated(triples, pairs, store), "s", "p", "o")
    assert got == [("http://x/a", "name", "A"), ("http://x/a", "name", "B"), ("http://x/c_111111", "name", "C"), ("http://x/c_222222", "name", "C")]


# ---- SPARQL and RDF -------------------------------------------------------------------------------------------


def _sparql(text, graph):
    got = run("PREFIX : <>\n" + text, graph)
    return sorted(tuple("" if x is None else str(x) for x in r) for r in got.collect())


def test_select_forms(graph):
    assert _sparql("SELECT * { ?s :name ?o }", graph) == [("Ann", "a"), ("Bob", "b")]
    assert _sparql("SELECT DISTINCT ?n WHERE { ?x :knows+ ?y . ?y :name ?n }", graph) == [("Ann",), ("Bob",)]
    assert _sparql("SELECT ?y { :a :knows/:knows ?y }", graph) == [("c",)] and _sparql("SELECT ?y { ?y ^:knows :c }", graph) == [("a",)]
    assert _sparql("SELECT ?x ?v { ?x :name|:age ?v FILTER(?x = 'a') }", graph) == [("a", "30"), ("a", "Ann")]
    assert _sparql("SELECT ?x { ?x :age ?v FILTER(?v > 10 && !(?v = 31)) }", graph) == [("a",)]
    assert _sparql("SELECT ?x ?n { ?x :knows ?y OPTIONAL { ?x :name ?n } FILTER(!BOUND(?n) || ?n != 'Bob') }", graph) == [("a", "Ann"), ("c", ""), ("d", "")]
    assert _sparql("SELECT ?x ?k { { ?x :name ?n BIND(CONCAT(?n, '!') AS ?k) } UNION { ?x :age ?k FILTER(?k IN ('4')) } }", graph) == [("a", "Ann!"), ("b", "4"), ("b", "Bob!")]
    assert _sparql("SELECT ?x { ?x :knows ?y FILTER NOT EXISTS { ?x :name ?n } }", graph) == [("c",), ("d",)]
    assert _sparql("SELECT (COUNT(*) AS ?n) (SUM(?v) AS ?sum) (MAX(?x) AS ?m) { ?x :age ?v }", graph) == [("2", "34.0", "b")]
    assert _sparql("SELECT ?p (COUNT(DISTINCT ?s) AS ?n) { ?s ?p ?o } GROUP BY ?p HAVING (COUNT(DISTINCT ?s) > 2)".replace("HAVING (COUNT(DISTINCT ?s) > 2)", "HAVING (?n > 2)"), graph) == [("knows", "4")]
    assert _sparql("SELECT ?x { { SELECT ?x { ?x :age ?v } ORDER BY ?v LIMIT 1 } }", graph) == [("a",)]
    assert _sparql("SELECT ?x { ?x :knows* :a } ORDER BY ?x OFFSET 1 LIMIT 2", graph) == [("b",), ("c",)]
    assert _sparql("ASK { :a :knows :b }", graph) == [("True",)] and _sparql("ASK { :a :knows :d }", graph) == [("False",)]


@pytest.mark.parametrize("text", ["SELECT", "SELECT ?x { ?x }", "SELECT ?x { ?x x:y ?z }", "SELECT * { ?s ?p ?o", "DELETE { ?s ?p ?o }", "SELECT ?x { ?x ?p ?o FILTER(NOPE(?x)) } ~"])
def test_malformed_queries(graph, text):
    with pytest.raises(QueryError):
        run(text, graph)


def test_prefixes():
    assert query_prefixes("prefix a: <http://a/>\nPREFIX b:<http://b#> ASK {}") == {"a": "http://a/", "b": "http://b#"}
    assert parse("SELECT ?x { ?x <p> 'it\\'s' }").select[0][1] == "x"


def test_turtle_and_ntriples(spark, tmp_path):
    text = '@prefix ex: <http://ex/> .\nex:s a ex:T ; ex:p "x\\ny"@en, "2024"^^ex:year , 3, true .\n# note\n_:b ex:p ex:s . ex:s ex:q [ ex:r "in" ] .\n<http://ex/t> ex:p """long "one" here""" .\n'
    (tmp_path / "a.ttl").write_text(text)
    got = rdf.read_turtle(spark, str(tmp_path / "a.ttl"))
    assert _rows(got.where("o_kind = 'literal'"), "s", "o") == [("http://ex/s", "2024"), ("http://ex/s", "3"), ("http://ex/s", "true"), ("http://ex/s", "x\ny"), ("http://ex/t", 'long "one" here')]
    rdf.write_ntriples(got.select("s", "p", "o", "o_kind"), str(tmp_path / "nt"))
    back = rdf.read_ntriples(spark, str(tmp_path / "nt"))
    assert _rows(back, "s", "p", "o", "o_kind") == _rows(got, "s", "p", "o", "o_kind")
    with pytest.raises(rdf.TurtleError):
        list(rdf.parse_turtle("<a> <b> (1 2) ."))

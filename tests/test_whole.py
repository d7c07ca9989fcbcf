"""Queries over all rows: what a subset of them would get wrong."""

from __future__ import annotations

import statistics

from hypothesis import given
from hypothesis import strategies as st

from kgloom import queries as library
from kgloom.functions import matching as M
from kgloom.functions import spans as P
from kgloom.operators import confidence as C
from kgloom.views import NS


def _written(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_hash_strip_sees_every_uri(spark, tmp_path):
    rows = [(1, "web"), (2, "news"), (500, "web"), (501, "book")]
    got = library.queries()["hash_strip"](spark, _written(spark, tmp_path, documents=(rows, "doc_id long, source string"))).collect()
    short = {r["uri"][:-7]: r["short"] for r in got if "/web_" not in r["uri"]}
    assert len(got) == 4 and short == {f"{NS}d/news": f"{NS}d/news", f"{NS}d/book": f"{NS}d/book"}
    assert all(r["short"] == r["uri"] for r in got if "/web_" in r["uri"])


def test_semantic_similarity_scores_every_pair(spark, tmp_path):
    rows = [(3, "a", [1.0, 0.0]), (7, "a", [0.0, 1.0]), (10, "a", [1.0, 1.0]), (20, "b", [1.0, 0.0]), (23, "b", [2.0, 0.0])]
    got = library.queries()["semantic_similarity"](spark, _written(spark, tmp_path, embeddings=(rows, "vec_id long, label string, embedding array<float>"))).collect()
    assert {(r["a"], r["b"]): r["score"] for r in got} == {(3, 7): 0.0, (3, 10): 0.707107, (7, 10): 0.707107, (20, 23): 1.0}


def test_find_span_searches_the_whole_text(spark, tmp_path):
    texts = {i: "0123456789" * 40 + " ".join(f"Word{chr(97 + j % 26)}{chr(97 + j // 26)} stands here." for j in range(300)) for i in range(24)}
    got = library.queries()["find_span"](spark, _written(spark, tmp_path, documents=(list(texts.items()), "doc_id long, text string"))).collect()
    assert len(got) == 24 and any(r["start"] > 2000 and not r["in_window"] for r in got)
    assert all(0 <= r["start"] < r["end"] <= len(texts[r["doc_id"]]) for r in got)


@given(st.text("abcd. ", max_size=80), st.text("abcd. ", min_size=1, max_size=12).filter(str.strip))
def test_fuzzy_is_the_best_sentence(text, value):
    best = (0.0, 0, "")
    for start, sentence in P.sentences(text):
        if len(sentence) >= max(len(value) * 0.5, 5) and (score := M.partial_ratio(value.lower(), sentence.lower())) > best[0]:
            best = score, start, sentence
    begin, end = P.best_window(best[2], value)
    assert P._fuzzy(text, value) == (None if best[0] < P.LEAST else (best[1] + begin, best[1] + end, best[0]))


def _moved(members, text):
    out = [dict(m) for m in members]
    for i, m in enumerate(out):
        places, ends = P.occurrences(text, m["value"]), [x["span_end"] for j, x in enumerate(out) if j != i]
        if len(m["value"]) <= 20 and len(places) > 1 and ends:
            start = min(places, key=lambda p: (abs(p - statistics.median(ends)), p))
            m["span_start"], m["span_end"] = start, start + len(m["value"])
    return out


@given(st.text("abA ", max_size=60))
def test_relocate_is_that_of_brute_force(text):
    members = [{"value": x, "span_start": text.find(x), "span_end": text.find(x) + len(x)} for x in text.split()]
    assert P.relocate(members, text) == _moved(members, text)


def test_relocate_spans_takes_the_whole_text(spark, tmp_path):
    text = "key " + "x" * 30 + " " + " ".join(f"w{i:05d}" for i in range(1000)) + " key end"
    got = library.queries()["relocate_spans"](spark, _written(spark, tmp_path, documents=([(1, text)], "doc_id long, text string"))).collect()
    assert len(got) == 1003 and {r["span_start"] for r in got if r["value"] == "key"} >= {text.rindex("key")}


def test_every_user_and_statement_takes_part(spark, tmp_path):
    turns = [(c, t, "user", "hello") for c in (2, 3, 6) for t in range(3)]
    users = [(1, "a", "X", 0), (2, "b", "X", 0), (5, "c", "X", 0)]
    folder = _written(
        spark, tmp_path, conversations=(turns, "conv_id long, turn int, role string, text string"),
        customer=(users, "c_custkey long, c_name string, c_mktsegment string, c_nationkey int"), nation=([(0, "N")], "n_nationkey int, n_name string"),
    )
    rows = {name: library.queries()[f"{name}"](spark, folder).count() for name in ("user_workspaces", "path_star", "path_plus", "path_inverse")}
    assert rows == {"user_workspaces": 3, "path_star": 9, "path_plus": 6, "path_inverse": 9}


def test_relocate_spans_gives_rows_as_they_come(spark, tmp_path):
    folder = _written(spark, tmp_path, documents=([(1, "a b a"), (2, None), (3, "")], "doc_id long, text string"))
    got = library.queries()["relocate_spans"](spark, folder)
    assert sorted(map(tuple, got.collect()))[0][:2] == (1, "a") and got.count() == 3
    # No array holds the rows of a text, let alone of a batch of texts.
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()


def test_literals_are_annotated_letter_by_letter(spark):
    text = "x" * 50 + " needle here"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    triples = spark.createDataFrame([(1, "s", "quote", " needle here", "literal")], "doc_id long, s string, p string, o string, o_kind string")
    got = C.annotate_literals(triples, docs, {"quote": [P.Window("tail", 11)]}, exact=frozenset(["quote"]), literal=frozenset(["quote"])).first()
    assert (got["start"], got["confidence"], got["in_window"]) == (50, 0.8, False)


def test_merge_chunks_keeps_a_last_zero(spark, tmp_path):
    rows = [(1, 7, "view", 2.5), (2, 7, "error", 0.0)]
    got = library.queries()["merge_chunks"](spark, _written(spark, tmp_path, events=(rows, "event_id long, user_id long, event_type string, value double"))).first()
    assert tuple(got) == (7, 0.0, "error,view", "view")

"""Calls of services that fail on the way, and services inside of queries."""

from __future__ import annotations

import os
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from kgloom.plans import sparql
from kgloom.sources import clients


def _asked(folder: Path) -> list[str]:
    return sorted(x for p in folder.iterdir() for x in p.read_text().split())


def _counting(folder: Path, dies: str | None = None, fails: str | None = None):
    """A client that writes down what it is asked; its worker dies once at ``dies``, and ``fails`` never gets an answer."""
    log, told = str(folder / "log"), str(folder / "died")

    def call(inputs: list[str]) -> list[str]:
        with open(f"{log}-{os.getpid()}", "a") as out:
            out.write("".join(f"{x}\n" for x in inputs))
        if dies in inputs and not os.path.exists(told):
            open(told, "w").close()
            os._exit(1)
        if fails in inputs:
            raise OSError("busy")
        return [None if x == "x7" else x.upper() for x in inputs]

    return call


def test_answers_outlive_a_failure(spark, tmp_path):
    """A worker dies: what other tasks have asked is kept, and only the rest is asked again."""
    log = tmp_path / "log"
    log.mkdir()
    rows = spark.createDataFrame([(f"x{i}",) for i in range(60)] * 2 + [(None,), (" ",)], "q string")
    call = _counting(log, dies="x33")
    ask = lambda some: {r.q: r.answer for r in clients.ask_stored(some, "q", call, "string", str(tmp_path / "answers"), tasks=20, batch=2, attempts=1, per_task=3).collect()}
    with pytest.raises(Exception, match="(?i)crashed|exited|died|EOF|aborted"):
        ask(rows)
    first = _asked(log)
    kept = spark.read.parquet(str(tmp_path / "answers")).count()
    assert 0 < kept < 60
    assert ask(rows) == {f"x{i}": f"X{i}" for i in range(60) if i != 7}
    again = len(_asked(log)) - len(first)
    assert again == 60 - kept
    assert ask(rows.where("q <> 'x7'")) == {f"x{i}": f"X{i}" for i in range(60) if i != 7} and len(_asked(log)) - len(first) == again


def test_failed_requests_are_left_out_and_asked_again(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    rows = spark.createDataFrame([(f"y{i}",) for i in range(6)], "q string")
    ask = lambda call: {r.q: r.answer for r in clients.ask_stored(rows, "q", call, "string", str(tmp_path / "a"), tasks=2, batch=1, attempts=2, pause=0.01).collect()}
    assert ask(_counting(log, fails="y3")) == {f"y{i}": f"Y{i}" for i in range(6) if i != 3}
    assert _asked(log).count("y3") == 2
    assert ask(_counting(log)) == {f"y{i}": f"Y{i}" for i in range(6)} and _asked(log).count("y0") == 1
    assert clients.ask_stored(rows.where("false"), "q", _counting(log), "string", str(tmp_path / "none")).count() == 0


def test_requests_a_second(spark, tmp_path):
    rows = spark.createDataFrame([(f"z{i}",) for i in range(12)], "q string")
    began = time.monotonic()
    got = clients.ask_stored(rows, "q", lambda some: list(some), "string", str(tmp_path / "a"), tasks=2, batch=1, per_second=8)
    assert got.count() == 12 and time.monotonic() - began >= 12 / 8 * 0.6


def test_completed(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "id int, prompt string")
    log = tmp_path / "log"
    log.mkdir()
    got = clients.completed(rows, "prompt", _counting(log), str(tmp_path / "a"))
    assert {r.id: r.completion for r in got.collect()} == {1: "A", 2: "A", 3: None} and _asked(log) == ["a"]


def test_services_in_queries(spark, tmp_path):
    triples = spark.createDataFrame([("a", "p", "b"), ("a", "p", "c"), ("d", "p", "b")], "s string, p string, o string")
    text = "SELECT ?x ?xLabel ?y { ?x <p> ?y SERVICE <l> { <x> <language> 'fr,en' } }"
    log = tmp_path / "log"
    log.mkdir()
    service = sparql.labels_from(_counting(log), str(tmp_path / "answers"))
    got = sorted(tuple(r) for r in sparql.run(text, triples, services={"l": service}).collect())
    assert got == [("a", "A\tFR,EN", "b"), ("a", "A\tFR,EN", "c"), ("d", "D\tFR,EN", "b")]
    assert [x.split("\t")[0] for x in _asked(log) if len(x) < 3] == ["a", "d"]
    seen = []

    def other(bindings, group):
        seen.append(sorted(r.y for r in bindings.collect()))
        return bindings.withColumn("z", F.concat("y", F.lit("!")))

    joined = sparql.run("SELECT ?x ?z { ?x <p> ?y SERVICE <s> { ?y <q> ?z } }", triples, services={"s": other})
    assert sorted(tuple(r) for r in joined.collect()) == [("a", "b!"), ("a", "c!"), ("d", "b!")] and seen == [["b", "c"]]
    with pytest.raises(sparql.QueryError):
        sparql.run("SELECT * { ?x <p> ?y SERVICE <s> { ?y <q> ?z } }", triples)
    with pytest.raises(sparql.QueryError):
        sparql.run("SELECT * { ?x <p> ?y SERVICE <s> { ?u <q> ?z } }", triples, services={"s": other})
    assert sparql.run("SELECT ?x { ?x <p> ?y SERVICE SILENT <s> { ?y <q> ?z } }", triples).count() == 3

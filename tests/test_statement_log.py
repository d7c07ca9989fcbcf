"""The merge-on-read log: what actions write, readers beside writers, conflicts, compaction, and edge inputs of actions."""

from __future__ import annotations

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from kgloom.operators import access, algebra
from kgloom.operators import statements as S
from kgloom.operators.alignment import score_strings
from kgloom.operators.statement_log import StatementLog
from kgloom.session import store
from kgloom.sources import files
from kgloom.sources.manifests import Conflict, Manifests

COLUMNS = "doc_id long, stmt_id string, parent_id string, parent_kind string, root_id string, version_no int, s string, p string, o string, o_kind string, is_current boolean, status string, activity_type string, activity_id string, confidence double, span_start int, span_end int"


def _versions(spark, n: int):
    rows = [(i % 5 if i % 7 else None, f"r{i}", f"d{i}", "document", f"r{i}", 0, f"s{i % 9}", "p", f"o{i % 4}", "literal", True, ("pending", "accepted")[i % 2], "extraction", f"a{i}", 0.5, 1, 2) for i in range(n)]
    return spark.createDataFrame(rows, COLUMNS)


def _log(spark, path, n: int) -> StatementLog:
    log, versions = StatementLog(spark, str(path)), _versions(spark, n)
    log.create(versions, versions.where("status = 'accepted'").select("s", "p", "o"))
    return log


def _ids(spark, *ids: str):
    return spark.createDataFrame([(i,) for i in ids], "stmt_id string")


def _content(log: StatementLog):
    return sorted(map(str, log.versions().collect())), sorted(map(str, log.data().collect()))


def test_an_action_writes_what_its_ids_ask_for(spark, tmp_path):
    """Bytes of an action on one id don't depend on the size of the log."""
    size = []
    for n in (20, 4000):
        log = _log(spark, tmp_path / str(n), n)
        before = {p for p in Path(tmp_path / str(n)).rglob("*.parquet")}
        state = log.accept(_ids(spark, "r4"))
        size.append(sum(p.stat().st_size for p in Path(tmp_path / str(n)).rglob("*.parquet") if p not in before))
        assert state.parts("log", "delta")[0].rows == 1
        assert log.versions().where("root_id = 'r4' and is_current").first().stmt_id == "r4+1"
    assert abs(size[0] - size[1]) < 200


def test_log_against_plain_rewrites(spark, tmp_path):
    """Random actions agree with those that rewrite everything, before and after compaction; documents are null at times."""
    rng = random.Random(4)
    log, versions = _log(spark, tmp_path, 60), _versions(spark, 60)
    data = versions.where("status = 'accepted'").select("s", "p", "o").distinct()
    for turn in range(8):
        able = [r.stmt_id for r in versions.where("is_current and status <> 'accepted'").collect()]
        some = _ids(spark, *rng.sample(sorted(able), 3), able[0], able[0])
        if turn % 4 == 0:
            log.accept(some)
            versions, data = S.accept(versions, data, some)
        elif turn % 4 == 1:
            log.edit(some, o=F.lit(f"new {turn}"))
            versions, data = S.edit(versions, data, some, o=F.lit(f"new {turn}"))
        elif turn % 4 == 2:
            some = _ids(spark, *[r.stmt_id for r in versions.where("is_current and version_no > 0").orderBy("stmt_id").limit(2).collect()])
            log.reset(some)
            versions, data = S.reset(versions, data, some)
        else:
            some = _ids(spark, *[r.stmt_id for r in versions.where("is_current and status = 'accepted'").orderBy("stmt_id").limit(2).collect()])
            log.reject(some)
            versions, data = S.reject(versions, data, some)
        versions, data = store(versions), store(data)
        assert _content(log) == (sorted(map(str, versions.collect())), sorted(map(str, data.collect())))
    log.delete_documents(spark.createDataFrame([(3,), (None,)], "doc_id long"))
    versions, data = S.delete_document(versions, data, 3)
    log.retire(_ids(spark, "r10"))
    versions = S.set_not_current(versions, _ids(spark, "r10"))
    assert _content(log) == (sorted(map(str, versions.collect())), sorted(map(str, data.collect())))
    assert log.versions().where("doc_id is null").count() > 0
    before = _content(log)
    state = log.compact()
    assert _content(log) == before and not state.parts("log", "delta") and not state.parts("deleted") and len(state.parts("data")) == 1


def test_refused_actions_write_no_state(spark, tmp_path):
    log = _log(spark, tmp_path, 20)
    for act in (lambda: log.accept(_ids(spark, "r1")), lambda: log.accept(_ids(spark, "r2", "none")), lambda: log.edit(_ids(spark, "r2")), lambda: log.reset(_ids(spark, "r2"))):
        with pytest.raises(S.ActionError):
            act()
    assert log.tables.versions() == [1]


def test_two_writers(spark, tmp_path):
    """Of two writers on one state one gets a conflict, and its retry sees what the other did; both tables switch together."""
    log, other = _log(spark, tmp_path, 20), StatementLog(spark, str(tmp_path))
    base = log.tables.state()
    other.accept(_ids(spark, "r2"))
    with pytest.raises(Conflict):
        log.tables.commit(base, {"log": base.parts("log")})
    assert other.tables.state().version == 2
    tried = []

    def action(state):
        if not tried:
            other.accept(_ids(spark, "r4"))
        tried.append(state.version)
        return {"retired": [log.tables.write(_ids(spark, "r6"), state, "retired", "delta")]}

    log.tables.change(action)
    assert tried == [2, 3] and log.tables.state().version == 4
    now = log.versions().where("is_current").select("stmt_id").collect()
    assert {"r2+1", "r4+1"} <= {r.stmt_id for r in now} and "r6" not in {r.stmt_id for r in now}
    assert {(r.s, r.o) for r in log.data().collect()} >= {("s2", "o2"), ("s4", "o0")}


def test_a_killed_writer_leaves_the_old_state(spark, tmp_path, monkeypatch):
    log = _log(spark, tmp_path, 20)
    before = _content(log)

    def killed(*_):
        raise SystemExit

    with monkeypatch.context() as m:
        m.setattr(Manifests, "_publish", killed)
        with pytest.raises(SystemExit):
            log.accept(_ids(spark, "r2"))
    assert _content(log) == before and log.tables.state().version == 1
    assert log.accept(_ids(spark, "r2")).version == 2


def test_clean(spark, tmp_path):
    log = _log(spark, tmp_path, 20)
    log.accept(_ids(spark, "r2"))
    log.compact()
    log.accept(_ids(spark, "r4"))
    before = _content(log)
    gone = log.tables.clean(keep=1)
    assert len(gone) >= 3 and log.tables.versions() == [4] and _content(log) == before


# ---- edge inputs ----------------------------------------------------------------------------------------------


def test_rows_without_document_or_graph_stay(spark):
    versions = _versions(spark, 20)
    kept, _ = S.delete_document(versions, versions.select("s", "p", "o"), 3)
    assert kept.where("doc_id is null").count() == versions.where("doc_id is null").count() > 0 and kept.where("doc_id = 3").isEmpty()
    quads = spark.createDataFrame([("g", "a", "b", "c"), (None, "a", "b", "c"), ("h", "a", "b", "c")], "g string, s string, p string, o string")
    assert {r.g for r in algebra.drop_graph(quads, "g").collect()} == {None, "h"}


def test_repeated_changes(spark):
    tasks = spark.createDataFrame([(1, "Queued", "extract"), (2, "Failed", "extract")], "doc_id long, status string, stage string")
    changes = spark.createDataFrame([(1, "Running", "a", 1), (1, "Failed", None, 2), (1, "Running", "b", 0), (2, "Queued", "a", 1)], "doc_id long, status string, stage string, at int")
    assert sorted(tuple(r) for r in S.update_tasks(tasks, changes, "at").collect()) == [(1, "Failed", "extract"), (2, "Failed", "extract")]
    assert S.update_tasks(tasks, changes).count() == 2
    table = spark.createDataFrame([(1, "a"), (2, "b")], "id int, x string")
    updates = spark.createDataFrame([(1, "u", 2), (1, "v", 1)], "id int, x string, at int")
    assert sorted(tuple(r) for r in files.changed(table, "id", updates=updates, order="at").collect()) == [(1, "u"), (2, "b")]
    users = spark.createDataFrame([(1, "x", "e", "u", 1), (1, "a", "f", "v", 2)], "id int, name string, email string, username string, at int")
    curators = spark.createDataFrame([], "id int, name string, email string, username string, is_deleted boolean")
    assert [r.name for r in S.upsert_curators(curators, users, "at").collect()] == ["a"] and [r.name for r in S.upsert_curators(curators, users.drop("at")).collect()] == ["x"]


def test_a_member_with_two_roles(spark):
    members = spark.createDataFrame([(1, 1, "owner"), (1, 1, "editor"), (2, 1, "owner")], "user_id int, workspace_id int, role string")
    requests = spark.createDataFrame([(1, 1, ["editor"]), (2, 1, ["editor"]), (3, 1, ["editor"]), (1, 2, ["editor"])], "user_id int, workspace_id int, roles array<string>")
    found = access.decide(requests, members, members.select("workspace_id")).collect()
    assert {(r.user_id, r.workspace_id): r.answer for r in found} == {(1, 1): 200, (2, 1): 403, (3, 1): 403, (1, 2): 404}


def test_a_missing_name_has_no_similarity(spark):
    pairs = spark.createDataFrame([("abc", None), (None, "abc"), (None, None), ("abc", "abc"), ("b", "a")], "a string, b string")
    assert {(r.a, r.b): r.f for r in score_strings(pairs, "a", "b", "f").collect()} == {("abc", None): None, (None, "abc"): None, (None, None): None, ("abc", "abc"): 1.0, ("b", "a"): 0.0}

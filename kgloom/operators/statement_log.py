"""The statement log and its data graph as merge-on-read tables: an action writes what it adds, and nothing else.

The log has base files, in which ``is_current`` is settled, and deltas of new versions.  At read the highest
``version_no`` of a chain is current; only chains that deltas touch are looked at, the others are as the base says.
Retired versions, deleted documents and changes of the data graph are deltas too.  ``compact`` folds all of them into new base
files.  Every action is one commit that switches the log and the data graph together.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import store
from ..sources.manifests import Manifests, Part, State
from . import statements as S

#: What deltas say about the base is broadcast up to this many rows (keys of at most a few hundred bytes).
BROADCAST_ROWS = 50_000
TRIPLE = ["s", "p", "o"]


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


class StatementLog:
    """A workspace's log and data graph below one folder.

    Rows of the log have at least stmt_id, root_id, version_no, s, p, o, status, activity_type and doc_id; a document
    that isn't there is null.  Chains are named by ``root_id``, which is never null.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.tables = Manifests(spark, root)

    def create(self, versions: DataFrame, data: DataFrame) -> State:
        """The first state: versions with ``is_current``, and a set of triples."""
        base = self.tables.state(0)
        return self.tables.commit(base, {"log": [self.tables.write(versions, base, "log")], "data": [self.tables.write(data.select(*TRIPLE).distinct(), base, "data")]})

    # ---- reads ----

    def _parts(self, state: State, table: str, kind: str) -> tuple[DataFrame | None, int]:
        parts = state.parts(table, kind)
        read = [self.tables.read(p).withColumn("__commit", F.lit(p.version)) for p in parts]
        return (reduce(DataFrame.unionByName, read) if read else None), sum(p.rows for p in parts)

    def versions(self, state: State | None = None) -> DataFrame:
        """All versions, with ``is_current``."""
        state = state or self.tables.state()
        out, _ = self._parts(state, "log", "base")
        columns = [c for c in out.columns if c != "__commit"]
        delta, n = self._parts(state, "log", "delta")
        if delta is not None:
            tops = _small(delta.groupBy("root_id").agg(F.max("version_no").alias("__top")), n)
            old = out.join(tops, "root_id", "left").withColumn("is_current", F.col("is_current") & F.col("__top").isNull())
            new = delta.join(tops, "root_id").withColumn("is_current", F.col("version_no") == F.col("__top"))
            out = old.unionByName(new)
        retired, n = self._parts(state, "retired", "delta")
        if retired is not None:
            marks = _small(retired.select("stmt_id", F.lit(True).alias("__retired")).distinct(), n)
            out = out.join(marks, "stmt_id", "left").withColumn("is_current", F.col("is_current") & F.col("__retired").isNull())
        gone, n = self._parts(state, "deleted", "delta")
        if gone is not None:
            last = _small(gone.groupBy("doc_id").agg(F.max("__commit").alias("__gone")), n)
            out = out.join(last, "doc_id", "left").where("__gone is null or __commit > __gone")
        return out.select(*columns)

    def data(self, state: State | None = None) -> DataFrame:
        """The data graph: of the changes of a triple the last one holds."""
        state = state or self.tables.state()
        base, _ = self._parts(state, "data", "base")
        changes, n = self._parts(state, "data", "delta")
        if changes is None:
            return base.select(*TRIPLE)
        last = changes.groupBy(*TRIPLE).agg(F.max(F.struct("__commit", "added")).getField("added").alias("added"))
        same = [base[c].eqNullSafe(F.col(f"x.{c}")) for c in TRIPLE]
        kept = base.join(_small(last, n).alias("x"), reduce(lambda a, b: a & b, same), "left_anti").select(*TRIPLE)
        return kept.union(last.where("added").select(*TRIPLE))

    # ---- actions ----

    def _act(self, ids: DataFrame, already: str | None, make: Callable[[DataFrame, DataFrame], DataFrame], data: Callable[[DataFrame], DataFrame]) -> State:
        """Append what ``make`` makes of the chosen versions, and the changes of the data graph, all or nothing."""
        asked = store(ids.select("stmt_id").distinct())
        few = _small(asked, asked.count())

        def action(state: State) -> dict[str, list[Part]]:
            versions = self.versions(state)
            chosen = store(versions.join(few, "stmt_id", "left_semi"))
            S.check(chosen, asked, already)
            new = make(chosen, versions).select(*[c for c in versions.columns if c != "is_current"])
            parts = {"log": [*state.parts("log"), self.tables.write(new, state, "log", "delta")]}
            return parts | self._changed(state, data(chosen))

        return self.tables.change(action)

    def _changed(self, state: State, changes: DataFrame) -> dict[str, list[Part]]:
        part = self.tables.write(changes.select(*TRIPLE, "added").distinct(), state, "data", "delta")
        return {"data": [*state.parts("data"), part]} if part.rows else {}

    def accept(self, ids: DataFrame) -> State:
        """Accept all or nothing; the triples go to the data graph."""
        return self._act(ids, "accepted", lambda chosen, _: S.next_versions(chosen, "accept", F.lit("accepted")), lambda c: c.select(*TRIPLE, F.lit(True).alias("added")))

    def reject(self, ids: DataFrame) -> State:
        return self._act(ids, "rejected", lambda chosen, _: S.next_versions(chosen, "reject", F.lit("rejected")), _lost)

    def edit(self, ids: DataFrame, **changes: Column) -> State:
        """Change s, p or o; the status stays, and a triple that was accepted leaves the data graph."""
        if not changes:
            raise S.ActionError("an edit must change something")
        return self._act(ids, None, lambda chosen, _: S.next_versions(chosen, "edit", F.col("status"), **changes), _lost)

    def reset(self, ids: DataFrame) -> State:
        """Back to the original's content, pending; the original itself can't be reset."""

        def make(chosen: DataFrame, versions: DataFrame) -> DataFrame:
            roots = chosen.select("root_id").distinct()
            return S.back_to_first(chosen, S.originals(versions).join(_small(roots, chosen.count()), "root_id", "left_semi"))

        return self._act(ids, None, make, _lost)

    def retire(self, ids: DataFrame) -> State:
        """Versions that aren't current from now on, without another one in their place."""
        asked = store(ids.select("stmt_id").distinct())
        return self.tables.change(lambda state: {"retired": [*state.parts("retired"), self.tables.write(asked, state, "retired", "delta")]})

    def delete_documents(self, ids: DataFrame) -> State:
        """Without the statements of documents (doc_id) and the data triples that any version of them had."""
        asked = store(ids.select("doc_id").where("doc_id is not null").distinct())
        few = _small(asked, asked.count())

        def action(state: State) -> dict[str, list[Part]]:
            gone = self.versions(state).join(few, "doc_id", "left_semi").select(*TRIPLE, F.lit(False).alias("added"))
            return {"deleted": [*state.parts("deleted"), self.tables.write(asked, state, "deleted", "delta")]} | self._changed(state, gone)

        return self.tables.change(action)

    def compact(self) -> State:
        """The same content in base files alone."""
        return self.tables.change(lambda state: {
            "log": [self.tables.write(self.versions(state), state, "log")], "data": [self.tables.write(self.data(state), state, "data")], "retired": [], "deleted": [],
        })


def _lost(chosen: DataFrame) -> DataFrame:
    """The triples of accepted versions, which leave the data graph when these are revised."""
    return chosen.where("status = 'accepted'").select(*TRIPLE, F.lit(False).alias("added"))

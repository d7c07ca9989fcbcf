"""The versioned statement log: named reads, and curation actions as appended versions.

A statement is a chain of versions; ``root_id`` names its first one and ``version_no`` its place, both written when a
version is appended, so that reads that ask for the original or the current version are joins on ``root_id`` and not
walks along derivation edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import local_name, short_id

SAME_AS = "sameAs"


def same_as() -> Column:
    return F.endswith(F.col("p"), F.lit(SAME_AS))


def current(versions: DataFrame) -> DataFrame:
    return versions.where("is_current")


def originals(versions: DataFrame) -> DataFrame:
    return versions.where("version_no = 0")


def of_activity(versions: DataFrame, *kinds: str) -> DataFrame:
    """Current versions whose original was made by one of these kinds of activity."""
    roots = originals(versions).where(F.col("activity_type").isin(*kinds)).select("root_id")
    return current(versions).join(roots, "root_id", "left_semi")


def pair(a: str = "s", b: str = "o") -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def existing_pairs(versions: DataFrame) -> DataFrame:
    """Unordered pairs of current alignments, whatever their status (a rejected pair isn't proposed again)."""
    return current(versions).where(same_as()).select(*pair()).distinct()


def accepted_pairs(versions: DataFrame) -> DataFrame:
    """Accepted current alignments that alignment, not lookup, has made."""
    return of_activity(versions, "alignment").where(same_as() & (F.col("status") == "accepted")).select("s", "o").distinct()


def prior_entities(versions: DataFrame, excluded: list[int]) -> DataFrame:
    """Current statements that aren't alignments or rejected, without those of excluded documents.

    Only first versions keep the link to their document, so revised statements have none and are kept.
    """
    document = F.when(F.col("parent_kind") == "document", F.col("doc_id"))
    kept = current(versions).where(~same_as() & (F.col("status") != "rejected")).withColumn("source_document", document)
    return kept.where(F.col("source_document").isNull() | ~F.col("source_document").isin(excluded)).select("s", "p", "o", "o_kind", "source_document")


def triple_counts(versions: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, triples, pending) for every row of ``documents``; (0, 0) where it has no statements."""
    counts = of_activity(versions, "extraction").groupBy("doc_id").agg(F.count("*").alias("triples"), F.count_if(F.col("status") == "pending").alias("pending"))
    return documents.join(counts, "doc_id", "left").select("doc_id", F.coalesce("triples", F.lit(0)).alias("triples"), F.coalesce("pending", F.lit(0)).alias("pending"))


def dedup_counts(versions: DataFrame) -> DataFrame:
    """One row (total, pending) of alignments and lookups; (0, 0) if there are none."""
    rows = of_activity(versions, "alignment", "lookup").select("stmt_id", (F.col("status") == "pending").cast("int").alias("is_pending")).distinct()
    return rows.agg(F.count("*").alias("total"), F.coalesce(F.sum("is_pending"), F.lit(0)).alias("pending"))


def neighborhood(versions: DataFrame, entity: str) -> DataFrame:
    """(direction, p, other, status) of current statements about ``entity``, literals among the outgoing."""
    now = current(versions)
    incoming = now.where((F.col("o") == entity) & (F.col("o_kind") == "iri")).select(F.lit("in").alias("direction"), "p", F.col("s").alias("other"), "status")
    return incoming.union(now.where(F.col("s") == entity).select(F.lit("out"), "p", "o", "status"))


def related_spans(versions: DataFrame, doc_id: int) -> DataFrame:
    rows = of_activity(versions, "extraction").where(F.col("doc_id") == doc_id)
    return rows.select("s", "o", "span_start", "span_end")


def document_rows(versions: DataFrame) -> DataFrame:
    """Current statements of extraction beside their originals."""
    now = of_activity(versions, "extraction").select("root_id", "doc_id", "stmt_id", "s", "p", "o", "status", "confidence")
    first = originals(versions).select("root_id", F.col("s").alias("s0"), F.col("p").alias("p0"), F.col("o").alias("o0"))
    return now.join(first, "root_id")


def export_document(versions: DataFrame) -> DataFrame:
    """Accepted current triples by document."""
    return of_activity(versions, "extraction").where("status = 'accepted'").select("doc_id", "s", "p", "o").distinct()


# ---- curation actions -----------------------------------------------------------------------------------------


class ActionError(ValueError):
    """The action asks for a version that doesn't exist, isn't current, or already is what it should become."""


def _chosen(versions: DataFrame, ids: DataFrame) -> DataFrame:
    return versions.join(ids.select("stmt_id").distinct(), "stmt_id", "left_semi")


def invalid(versions: DataFrame, ids: DataFrame, already: str | None = None) -> DataFrame:
    """The ids that can't be acted on: unknown, not current, or already of that status."""
    found = ids.select("stmt_id").distinct().join(versions.select("stmt_id", "is_current", "status"), "stmt_id", "left")
    return found.where(~F.coalesce("is_current", F.lit(False)) | (F.coalesce(F.col("status") == already, F.lit(False)) if already else F.lit(False))).select("stmt_id")


def append(versions: DataFrame, chosen: DataFrame, action: str, status: Column, **changes: Column) -> DataFrame:
    """``versions`` with a new current version of each chosen one, derived from it; the old one stops being current.

    The new version keeps subject, predicate, object and confidence unless ``changes`` say otherwise.
    """
    return append_rows(versions, chosen, next_versions(chosen, action, status, **changes))


def append_rows(versions: DataFrame, chosen: DataFrame, fresh: DataFrame) -> DataFrame:
    return set_not_current(versions, chosen).unionByName(fresh.select(*versions.columns))


def next_versions(chosen: DataFrame, action: str, status: Column, **changes: Column) -> DataFrame:
    """The version that an action appends to each of the ``chosen`` ones."""
    ident = F.concat("root_id", F.lit("+"), F.col("version_no") + 1)
    return chosen.withColumns({
        "__id": ident, "status": status, "activity_type": F.lit(action), "is_current": F.lit(True), "parent_id": F.col("stmt_id"), "parent_kind": F.lit("statement"),
        "activity_id": F.concat(F.lit(f"{action}-"), ident), "version_no": F.col("version_no") + 1, **changes,
    }).withColumn("stmt_id", F.col("__id")).drop("__id")


def accept(versions: DataFrame, data: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accept all or nothing; the bare triples go to the data graph, which stays a set."""
    check(versions, ids, "accepted")
    chosen = _chosen(versions, ids)
    triples = chosen.select("s", "p", "o").distinct()
    return append(versions, chosen, "accept", F.lit("accepted")), data.unionByName(triples.join(data, ["s", "p", "o"], "left_anti"))


def reject(versions: DataFrame, data: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    check(versions, ids, "rejected")
    chosen = _chosen(versions, ids)
    return append(versions, chosen, "reject", F.lit("rejected")), _without(data, chosen)


def edit(versions: DataFrame, data: DataFrame, ids: DataFrame, **changes: Column) -> tuple[DataFrame, DataFrame]:
    """Change s, p or o; the status stays, and a triple that was accepted leaves the data graph."""
    if not changes:
        raise ActionError("an edit must change something")
    check(versions, ids, None)
    chosen = _chosen(versions, ids)
    return append(versions, chosen, "edit", F.col("status"), **changes), _without(data, chosen)


def reset(versions: DataFrame, data: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Back to the original's content, pending; the original itself can't be reset."""
    check(versions, ids, None)
    chosen = _chosen(versions, ids)
    return append_rows(versions, chosen, back_to_first(chosen, originals(versions))), _without(data, chosen)


def back_to_first(chosen: DataFrame, first: DataFrame) -> DataFrame:
    """Next versions of the ``chosen`` ones, none of which is an original, with the content of the ``first`` ones."""
    if not chosen.where("version_no = 0").isEmpty():
        raise ActionError("an original can't be reset")
    own = ("s", "p", "o", "o_kind", "confidence", "span_start", "span_end")
    said = first.select("root_id", *[F.col(c).alias(f"__{c}") for c in own])
    return next_versions(chosen.join(said, "root_id"), "reset", F.lit("pending"), **{c: F.col(f"__{c}") for c in own}).drop(*[f"__{c}" for c in own])


def check(versions: DataFrame, ids: DataFrame, already: str | None) -> None:
    wrong = invalid(versions, ids, already).limit(5).collect()
    if wrong:
        raise ActionError(f"not current or already {already}: {', '.join(str(r.stmt_id) for r in wrong)}")


def _without(data: DataFrame, chosen: DataFrame) -> DataFrame:
    return data.join(chosen.where("status = 'accepted'").select("s", "p", "o").distinct(), ["s", "p", "o"], "left_anti")


def delete_document(versions: DataFrame, data: DataFrame, doc_id: int) -> tuple[DataFrame, DataFrame]:
    """Without the document's statements and the data triples that any version of them had.

    Versions of no document, as those of alignments and lookups, stay.
    """
    own = F.col("doc_id").eqNullSafe(F.lit(doc_id))
    gone = versions.where(own)
    return versions.where(~own), data.join(gone.select("s", "p", "o").distinct(), ["s", "p", "o"], "left_anti")


def last_per_key(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The last row of each key."""
    window = Window.partitionBy(*keys).orderBy(*[c.desc() for c in order])
    return rows.withColumn("__n", F.row_number().over(window)).where("__n = 1").drop("__n")


def is_pending(strict: bool = False) -> Column:
    """Whether a version is pending; ``strict`` leaves out edited ones, whose status some stores keep as plain text
    that no longer equals the status term."""
    pending = F.col("status") == "pending"
    return pending & (F.col("activity_type") != "edit") if strict else pending


def alignment_id(workspace: str, run: str, documents: Column, duplicate: Column, canonical: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", F.lit(workspace), F.lit(run), F.array_join(F.array_sort(F.array_distinct(documents)), ","), duplicate, canonical), 256), 1, 24)


def write_candidates(triples: DataFrame, annotations: DataFrame, workspace: str, run: str) -> DataFrame:
    """First versions of the statements of documents: ``triples`` (doc_id, at, s, p, o, o_kind) with their annotations.

    ``annotations`` (doc_id, s, name, value, start, end, confidence) join by subject, the predicate's local name and
    the value; of several the last by ``start`` counts.  What has none has confidence 0 and no span.  The id is made of
    workspace, run, document, place and triple.
    """
    key = F.struct("start", "end", "confidence")
    one = annotations.groupBy("doc_id", "s", "name", "value").agg(F.max(key).alias("x"))
    named = triples.withColumn("name", local_name(F.col("p")))
    joined = named.join(one.withColumnRenamed("value", "o"), ["doc_id", "s", "name", "o"], "left")
    ident = short_id(F.lit(workspace), F.lit(run), "doc_id", "at", "s", "p", "o")
    return joined.select(
        "doc_id", ident.alias("stmt_id"), "s", "p", "o", "o_kind", F.lit("pending").alias("status"), F.lit(True).alias("is_current"), F.lit("extraction").alias("activity_type"),
        F.concat(F.lit(f"extract-{run}-"), "doc_id").alias("activity_id"), F.coalesce("x.confidence", F.lit(0.0)).alias("confidence"), F.col("x.start").alias("span_start"), F.col("x.end").alias("span_end"),
    )


def set_not_current(versions: DataFrame, ids: DataFrame) -> DataFrame:
    """``versions`` in which those of ``ids`` (stmt_id) aren't current."""
    marked = versions.join(ids.select("stmt_id", F.lit(True).alias("__old")).distinct(), "stmt_id", "left")
    return marked.withColumn("is_current", F.col("is_current") & F.col("__old").isNull()).select(*versions.columns)


# ---- curators, workspaces and tasks ---------------------------------------------------------------------------


def upsert_curators(curators: DataFrame, users: DataFrame, order: str | None = None) -> DataFrame:
    """``curators`` (id, name, email, username, is_deleted) after ``users`` (id, name, email, username) acted: theirs
    are replaced or added, once each; a name falls back to the user name and then to the id.

    Of several rows of a user the last by ``order`` counts, and of such the largest (name, email, username).
    """
    name = F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.nullif(F.trim("username"), F.lit("")), F.col("id").cast("string"))
    last = F.max(F.struct(*([F.col(order).alias("__order")] if order else []), name.alias("name"), "email", "username"))
    fresh = users.groupBy("id").agg(last.alias("x")).select("id", "x.name", "x.email", "x.username", F.lit(False).alias("is_deleted"))
    return curators.join(fresh.select("id"), "id", "left_anti").unionByName(fresh)


def anonymise_curator(curators: DataFrame, ident: Column) -> DataFrame:
    """``curators`` of all graphs, with the one of this id as a deleted user without e-mail and user name."""
    gone = F.col("id") == ident
    none = F.lit(None).cast("string")
    return curators.withColumns({
        "name": F.when(gone, "Deleted user").otherwise(F.col("name")), "email": F.when(gone, none).otherwise(F.col("email")),
        "username": F.when(gone, none).otherwise(F.col("username")), "is_deleted": gone | F.col("is_deleted"),
    })


def drop_workspace(tables: dict[str, DataFrame], workspace: Column) -> dict[str, DataFrame]:
    """The tables without a workspace: those with ``workspace_id`` lose its rows, tasks those of its runs."""
    runs = tables["runs"].where(F.col("workspace_id") == workspace).select("run_id")
    out = {n: t.where(~F.col("workspace_id").eqNullSafe(workspace)) if "workspace_id" in t.columns else t for n, t in tables.items()}
    if "tasks" in tables:
        out["tasks"] = tables["tasks"].join(runs, "run_id", "left_anti")
    return out


#: The states of a task and what may follow each.
NEXT = {"Queued": ("Running", "Failed"), "Running": ("Waiting", "Done", "Failed"), "Waiting": ("Running", "Done", "Failed"), "Failed": ("Queued",), "Done": ()}
#: The first stage of a file's kind.
FIRST_STAGE = {"pdf": "convert"}


def update_tasks(tasks: DataFrame, changes: DataFrame, order: str | None = None) -> DataFrame:
    """``tasks`` (doc_id, status, stage) after ``changes`` (doc_id, status, stage); failed tasks are skipped, as are
    changes that don't follow from a task's state.

    Of several changes of a task the last by ``order`` counts, and of such the largest (status, stage).
    """
    may = F.map_from_entries(F.array(*[F.struct(F.lit(k), F.array(*map(F.lit, v)).cast("array<string>")) for k, v in NEXT.items()]))
    last = F.max(F.struct(*([F.col(order).alias("at")] if order else []), "status", "stage"))
    wanted = changes.groupBy("doc_id").agg(last.alias("x")).select("doc_id", F.col("x.status").alias("__status"), F.col("x.stage").alias("__stage"))
    joined = tasks.join(wanted, "doc_id", "left")
    allowed = F.coalesce((F.col("status") != "Failed") & ((F.col("__status") == F.col("status")) | F.array_contains(F.try_element_at(may, F.col("status")), F.col("__status"))), F.lit(False))
    return joined.withColumns({"status": F.when(allowed, F.col("__status")).otherwise(F.col("status")), "stage": F.when(allowed, F.coalesce("__stage", "stage")).otherwise(F.col("stage"))}).select(*tasks.columns)


def retry(tasks: DataFrame, versions: DataFrame, data: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Failed tasks (doc_id, status, stage, kind) queued again at the first stage of their kind, without the statements
    and data triples of their documents."""
    failed = F.col("status") == "Failed"
    stage = F.lit("extract")
    for kind, first in FIRST_STAGE.items():
        stage = F.when(F.col("kind") == kind, first).otherwise(stage)
    ids = tasks.where(failed).select("doc_id").distinct()
    gone = versions.join(ids, "doc_id", "left_semi").select("s", "p", "o").distinct()
    again = tasks.withColumns({"stage": F.when(failed, stage).otherwise(F.col("stage")), "status": F.when(failed, "Queued").otherwise(F.col("status"))})
    return again, versions.join(ids, "doc_id", "left_anti"), data.join(gone, ["s", "p", "o"], "left_anti")

"""Queries of writes: candidates, curators, workspaces, tasks, access, table snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import access, statements as S
from ..session import work_folder
from ..sources import files
from ..views import Views, with_views

QUERIES: dict = {}


def register(sql: str | None, *views: str):
    def add(function):
        QUERIES[function.__name__] = (function, with_views(sql, *views) if sql and views else sql)
        return function

    return add


@register("""SELECT substr(sha256('ws|run|' || v.doc_id || '|' || version_no || '|' || v.s || '|' || v.p || '|' || v.o), 1, 24) AS stmt_id, v.doc_id, 'pending' AS status, 'extract-run-' || v.doc_id AS activity_id,
coalesce(a.x.c, 0.0)::DOUBLE AS confidence, a.x.a AS span_start, a.x.b AS span_end FROM versions v
LEFT JOIN (SELECT doc_id, s, p, o, max({'a': span_start + 1, 'b': span_end, 'c': confidence}) AS x FROM versions WHERE doc_id % 2 = 0 GROUP BY ALL) a ON a.doc_id = v.doc_id AND a.s = v.s AND a.p = v.p AND a.o = v.o""", "versions")
def write_candidates(v: Views) -> DataFrame:
    """Extracted triples as first versions, with their annotations where they have any."""
    triples = v.versions.select("doc_id", F.col("version_no").alias("at"), "s", "p", "o", "o_kind")
    name = F.substring_index("p", "/", -1)
    notes = v.versions.where("doc_id % 2 = 0").select("doc_id", "s", name.alias("name"), F.col("o").alias("value"), F.col("span_start").alias("start"), F.col("span_end").alias("end"), "confidence")
    later = notes.withColumn("start", F.col("start") + 1)
    return S.write_candidates(triples, notes.unionByName(later), "ws", "run").select("stmt_id", "doc_id", "status", "activity_id", "confidence", "span_start", "span_end")


@register("SELECT stmt_id, is_current AND doc_id % 4 <> 1 AS is_current FROM versions", "versions")
def set_not_current(v: Views) -> DataFrame:
    ids = v.versions.where("doc_id % 4 = 1").select("stmt_id")
    return S.set_not_current(v.versions, ids.union(ids)).select("stmt_id", "is_current")


# ---- curators -------------------------------------------------------------------------------------------------

_CURATORS = """old AS (SELECT c_custkey AS id, c_name AS name, 'a@b' AS email, 'u' || c_custkey AS username, c_custkey % 9 = 0 AS is_deleted FROM customer WHERE c_custkey % 3 = 0),
acting AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN ' ' ELSE c_mktsegment END AS name, 'c@d' AS email, CASE WHEN c_custkey % 8 <> 0 THEN 'u' || c_custkey END AS username FROM customer WHERE c_custkey % 2 = 0)"""


def _curators(v: Views) -> tuple[DataFrame, DataFrame]:
    c, k = v.table("customer"), F.col("c_custkey")
    user = F.concat(F.lit("u"), k)
    old = c.where("c_custkey % 3 = 0").select(k.alias("id"), F.col("c_name").alias("name"), F.lit("a@b").alias("email"), user.alias("username"), (k % 9 == 0).alias("is_deleted"))
    acting = c.where("c_custkey % 2 = 0").select(k.alias("id"), F.when(k % 4 == 0, " ").otherwise(F.col("c_mktsegment")).alias("name"), F.lit("c@d").alias("email"), F.when(k % 8 != 0, user).alias("username"))
    return old, acting


@register(f"""WITH {_CURATORS} SELECT * FROM old WHERE id NOT IN (SELECT id FROM acting)
UNION ALL SELECT id, CASE WHEN trim(name) <> '' THEN name ELSE coalesce(username, id::VARCHAR) END, email, username, FALSE FROM acting""")
def upsert_curator(v: Views) -> DataFrame:
    """Curators who acted are replaced or added; a name falls back to the user name and then to the id."""
    old, acting = _curators(v)
    return S.upsert_curators(old, acting.union(acting))


@register(f"WITH {_CURATORS} SELECT id, CASE WHEN id = 6 THEN 'Deleted user' ELSE name END AS name, CASE WHEN id <> 6 THEN email END AS email, CASE WHEN id <> 6 THEN username END AS username, is_deleted OR id = 6 AS is_deleted FROM old")
def anonymize_curator(v: Views) -> DataFrame:
    return S.anonymise_curator(_curators(v)[0], F.lit(6))


# ---- workspaces and tasks -------------------------------------------------------------------------------------


@register("""SELECT 'runs' AS kind, n_nationkey AS id FROM nation WHERE n_regionkey <> 3 UNION ALL SELECT 'tasks', c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 3)
UNION ALL SELECT 'documents', s_suppkey FROM supplier WHERE s_nationkey % 5 <> 3 UNION ALL SELECT 'others', r_regionkey FROM region""")
def drop_workspace(v: Views) -> DataFrame:
    """A workspace's documents, its runs and the tasks of these go; tables without workspaces stay."""
    name = lambda key: F.concat(F.lit("w"), key)
    tables = {
        "runs": v.table("nation").select(F.col("n_nationkey").alias("run_id"), name(F.col("n_regionkey")).alias("workspace_id"), F.col("n_nationkey").alias("id")),
        "tasks": v.table("customer").select(F.col("c_nationkey").alias("run_id"), F.col("c_custkey").alias("id")),
        "documents": v.table("supplier").select(F.col("s_suppkey").alias("id"), name(F.col("s_nationkey") % 5).alias("workspace_id")),
        "others": v.table("region").select(F.col("r_regionkey").alias("id")),
    }
    left = S.drop_workspace(tables, F.lit("w3"))
    parts = [left[n].select(F.lit(n).alias("kind"), F.col("id").cast("long").alias("id")) for n in tables]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@register("""WITH t AS (SELECT event_id AS doc_id, ['Queued', 'Running', 'Waiting', 'Done', 'Failed'][1 + event_id % 5] AS old, ['Running', 'Done', 'Queued', 'Failed'][1 + event_id % 4] AS new, CASE WHEN event_id % 2 = 1 THEN 'lookup' END AS stage FROM events),
a AS (SELECT *, event_id_ok AND (old, new) IN (('Queued', 'Queued'), ('Queued', 'Running'), ('Queued', 'Failed'), ('Running', 'Running'), ('Running', 'Done'), ('Running', 'Failed'), ('Waiting', 'Running'), ('Waiting', 'Done'), ('Waiting', 'Failed'), ('Done', 'Done')) AS ok
  FROM (SELECT *, doc_id % 7 <> 0 AS event_id_ok FROM t))
SELECT doc_id, CASE WHEN ok THEN new ELSE old END AS status, CASE WHEN ok THEN coalesce(stage, 'extract') ELSE 'extract' END AS stage FROM a""")
def task_status(v: Views) -> DataFrame:
    """Tasks take changes that follow from their state; failed ones are skipped."""
    pick = lambda names: F.get(F.array(*map(F.lit, names)), (F.col("event_id") % len(names)).cast("int"))
    events = v.table("events")
    tasks = events.select(F.col("event_id").alias("doc_id"), pick(["Queued", "Running", "Waiting", "Done", "Failed"]).alias("status"), F.lit("extract").alias("stage"))
    changes = events.where("event_id % 7 <> 0").select(F.col("event_id").alias("doc_id"), pick(["Running", "Done", "Queued", "Failed"]).alias("status"), F.when(F.col("event_id") % 2 == 1, "lookup").alias("stage"))
    return S.update_tasks(tasks, changes)


def _retried(v: Views):
    docs = v.table("documents")
    tasks = docs.select("doc_id", F.when(F.col("doc_id") % 5 == 0, "Failed").otherwise("Done").alias("status"), F.lit("lookup").alias("stage"), F.when(F.col("doc_id") % 2 == 0, "pdf").otherwise("md").alias("kind"))
    return S.retry(tasks, v.versions, v.versions.where("is_current and status = 'accepted'").select("s", "p", "o").distinct())


@register("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'Queued' ELSE 'Done' END AS status, CASE WHEN doc_id % 5 <> 0 THEN 'lookup' WHEN doc_id % 2 = 0 THEN 'convert' ELSE 'extract' END AS stage FROM documents")
def retry_reset(v: Views) -> DataFrame:
    """Failed documents start again, at the first stage of their kind."""
    return _retried(v)[0].select("doc_id", "status", "stage")


@register("SELECT 'statement' AS kind, stmt_id AS id FROM versions WHERE doc_id % 5 <> 0 UNION ALL SELECT 'triple', s || ' ' || p FROM (SELECT DISTINCT s, p, o FROM versions WHERE is_current AND status = 'accepted' EXCEPT SELECT s, p, o FROM versions WHERE doc_id % 5 = 0)", "versions")
def retry_data(v: Views) -> DataFrame:
    """What failed documents had made is gone, from the log and from the data."""
    _, versions, data = _retried(v)
    return versions.select(F.lit("statement").alias("kind"), F.col("stmt_id").alias("id")).union(data.select(F.lit("triple"), F.concat_ws(" ", "s", "p")))


# ---- access ---------------------------------------------------------------------------------------------------


@register("""SELECT c_custkey AS user_id, CASE WHEN c_custkey % 7 = 0 THEN 404 WHEN c_custkey % 3 = 0 THEN 200 WHEN c_custkey % 3 = 1 AND c_custkey % 2 = 1 THEN 200 ELSE 403 END AS answer,
CASE WHEN c_custkey % 3 = 0 THEN 'curation' ELSE 'data' END AS graph, c_custkey % 3 = 0 OR c_custkey % 2 = 1 AS may FROM customer""")
def access_rules(v: Views) -> DataFrame:
    """Owners and editors, users without a role, and workspaces that don't exist; what an owner alone may do."""
    c, k = v.table("customer"), F.col("c_custkey")
    role = F.when(k % 3 == 0, "owner").when(k % 3 == 1, "editor")
    requests = c.select(k.alias("user_id"), F.when(k % 7 == 0, F.lit(-1)).otherwise(F.col("c_nationkey")).alias("workspace_id"), F.when(k % 2 == 0, F.array(F.lit("owner"))).otherwise(F.array(F.lit("owner"), F.lit("editor"))).alias("roles"))
    members = c.where("c_custkey % 3 < 2").select(k.alias("user_id"), F.col("c_nationkey").alias("workspace_id"), role.alias("role"))
    decided = access.decide(requests, members, v.table("nation").select(F.col("n_nationkey").alias("workspace_id")))
    key = F.col("user_id")
    own = F.when(key % 3 == 0, "owner").when(key % 3 == 1, "editor").otherwise("none")
    action = F.when(key % 2 == 0, "delete-document").otherwise("read")
    return decided.select("user_id", "answer", access.visible_graph(own, F.lit("curation")).alias("graph"), access.may(own, action).alias("may"))


# ---- tables ---------------------------------------------------------------------------------------------------


@register("""SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'moved' ELSE c_mktsegment END AS segment FROM customer WHERE c_custkey % 7 <> 0 UNION ALL SELECT -1 - c_custkey, 'new' FROM customer WHERE c_custkey % 11 = 0""")
def write_table(v: Views) -> DataFrame:
    """A table's next snapshot after inserts, updates and deletes by key, committed and read again."""
    rows = v.table("customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    root = f"{work_folder(v.spark)}/table-{uuid.uuid4().hex}"
    files.commit(rows, root, 1)
    before = files.snapshot(v.spark, root, 1)
    after = files.changed(
        before, "c_custkey",
        inserts=rows.where("c_custkey % 11 = 0").select((-1 - F.col("c_custkey")).alias("c_custkey"), F.lit("new").alias("segment")),
        updates=rows.where("c_custkey % 5 = 0").select("c_custkey", F.lit("moved").alias("segment")), deletes=rows.where("c_custkey % 7 = 0").select("c_custkey"),
    )
    files.commit(after, root, 2)
    return files.snapshot(v.spark, root, 2)

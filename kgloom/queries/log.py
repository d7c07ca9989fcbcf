"""Queries of the statement log: named reads and curation actions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import statements as S
from ..views import NS, Views, with_views

QUERIES: dict = {}
_OF = "root_id IN (SELECT root_id FROM versions WHERE version_no = 0 AND activity_type IN ({}))"
EXTRACTED = "is_current AND " + _OF.format("'extraction'")
LINKED = "is_current AND " + _OF.format("'alignment', 'lookup'")


def register(sql: str | None, *views: str):
    def add(function):
        QUERIES[function.__name__] = (function, with_views(sql, *views) if sql and views else sql)
        return function

    return add


@register("""SELECT s, p, o, o_kind, CASE WHEN parent_kind = 'document' THEN doc_id END AS source_document FROM versions
WHERE is_current AND NOT ends_with(p, 'sameAs') AND status <> 'rejected' AND NOT coalesce(CASE WHEN parent_kind = 'document' THEN doc_id END IN (3, 4, 8), FALSE)""", "versions")
def prior_entities(v: Views) -> DataFrame:
    return S.prior_entities(v.versions, [3, 4, 8])


@register("SELECT DISTINCT least(s, o) AS a, greatest(s, o) AS b FROM versions WHERE is_current AND ends_with(p, 'sameAs')", "versions")
def existing_pairs(v: Views) -> DataFrame:
    return S.existing_pairs(v.versions)


@register("SELECT DISTINCT s, o FROM versions WHERE ends_with(p, 'sameAs') AND status = 'accepted' AND is_current AND " + _OF.format("'alignment'"), "versions")
def accepted_pairs(v: Views) -> DataFrame:
    return S.accepted_pairs(v.versions)


@register(f"SELECT s, o, span_start, span_end FROM versions WHERE {EXTRACTED} AND doc_id = 7", "versions")
def related_spans(v: Views) -> DataFrame:
    return S.related_spans(v.versions, 7)


@register(f"""SELECT v.root_id, v.doc_id, v.stmt_id, v.s, v.p, v.o, v.status, v.confidence, f.s AS s0, f.p AS p0, f.o AS o0
FROM (SELECT * FROM versions WHERE {EXTRACTED}) v JOIN versions f ON f.root_id = v.root_id AND f.version_no = 0""", "versions")
def doc_statement_rows(v: Views) -> DataFrame:
    return S.document_rows(v.versions)


@register(f"SELECT stmt_id, s, p, o, status FROM versions WHERE {LINKED}", "versions")
def dedup_statement_rows(v: Views) -> DataFrame:
    return S.of_activity(v.versions, "alignment", "lookup").select("stmt_id", "s", "p", "o", "status")


@register(f"SELECT count(*) AS total, coalesce(sum((status = 'pending')::INTEGER), 0) AS pending FROM versions WHERE {LINKED}", "versions")
def dedup_counts(v: Views) -> DataFrame:
    return S.dedup_counts(v.versions)


@register(f"""SELECT 'in' AS direction, p, s AS other, status FROM versions WHERE is_current AND o = '{NS}e/6' AND o_kind = 'iri'
UNION ALL SELECT 'out', p, o, status FROM versions WHERE is_current AND s = '{NS}e/6'""", "versions")
def neighborhood(v: Views) -> DataFrame:
    return S.neighborhood(v.versions, f"{NS}e/6")


@register(f"""SELECT d.doc_id, count(v.doc_id) AS triples, coalesce(sum((v.status = 'pending')::INTEGER), 0) AS pending
FROM documents d LEFT JOIN (SELECT * FROM versions WHERE {EXTRACTED}) v USING (doc_id) GROUP BY d.doc_id""", "versions")
def triple_counts(v: Views) -> DataFrame:
    return S.triple_counts(v.versions, v.table("documents").select("doc_id"))


@register(f"""SELECT d.doc_id, d.lang, d.source, d.n_chars, count(v.doc_id) AS triples, coalesce(sum((v.status = 'pending')::INTEGER), 0) AS pending
FROM documents d LEFT JOIN (SELECT * FROM versions WHERE {EXTRACTED}) v USING (doc_id) GROUP BY ALL""", "versions")
def list_documents(v: Views) -> DataFrame:
    docs = v.table("documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(S.triple_counts(v.versions, docs.select("doc_id")), "doc_id")


@register("SELECT a.stmt_id, b.stmt_id AS current_id FROM versions a JOIN versions b ON a.root_id = b.root_id AND b.is_current", "versions")
def current_version(v: Views) -> DataFrame:
    return v.versions.select("stmt_id", "root_id").join(S.current(v.versions).select("root_id", F.col("stmt_id").alias("current_id")), "root_id").drop("root_id")


@register("SELECT stmt_id, root_id AS original_id FROM versions", "versions")
def original_version(v: Views) -> DataFrame:
    return v.versions.select("stmt_id", F.col("root_id").alias("original_id"))


@register(f"SELECT DISTINCT doc_id, s, p, o FROM versions WHERE {EXTRACTED} AND status = 'accepted'", "versions")
def export_doc_data(v: Views) -> DataFrame:
    return S.export_document(v.versions)


@register("""SELECT 'statement' AS kind, stmt_id AS subject, doc_id FROM versions WHERE doc_id = 7 UNION SELECT 'activity', activity_id, doc_id FROM versions WHERE doc_id = 7
UNION SELECT 'agent', agent_id, doc_id FROM versions WHERE doc_id = 7""", "versions")
def export_doc_provenance(v: Views) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("subject")) for k, c in (("statement", "stmt_id"), ("activity", "activity_id"), ("agent", "agent_id"))])
    return v.versions.where("doc_id = 7").select(F.explode(cells).alias("x"), "doc_id").select("x.kind", "x.subject", "doc_id").distinct()


@register("SELECT x.n AS position, x.id AS stmt_id, v.s IS NOT NULL AS found FROM (VALUES (0, '7-0'), (1, '3-0'), (2, 'none')) x(n, id) LEFT JOIN versions v ON v.stmt_id = x.id", "versions")
def load_statements(v: Views) -> DataFrame:
    """Asked ids in the order asked for; what isn't found is told."""
    asked = v.spark.createDataFrame([(0, "7-0"), (1, "3-0"), (2, "none")], "position int, stmt_id string")
    return F.broadcast(asked).join(v.versions.select("stmt_id", "s"), "stmt_id", "left").select("position", "stmt_id", F.col("s").isNotNull().alias("found"))


@register("""SELECT doc_id, max(CASE WHEN version_no = 0 THEN o END) AS first_text, max(CASE WHEN is_current THEN o END) AS last_text, max(CASE WHEN is_current THEN status END) AS status,
max(CASE WHEN is_current THEN confidence END) AS confidence FROM versions GROUP BY doc_id""", "versions")
def statement_pivot(v: Views) -> DataFrame:
    now = F.col("is_current")
    return v.versions.groupBy("doc_id").agg(
        F.max(F.when(F.col("version_no") == 0, F.col("o"))).alias("first_text"), F.max(F.when(now, F.col("o"))).alias("last_text"),
        F.max(F.when(now, F.col("status"))).alias("status"), F.max(F.when(now, F.col("confidence"))).alias("confidence"),
    )


@register("SELECT stmt_id, s, p, o, count(*) OVER (PARTITION BY s) AS relations FROM versions WHERE is_current", "versions")
def relation_rank(v: Views) -> DataFrame:
    """Statements by (relations of the subject, most first; subject; predicate; object)."""
    counts = S.current(v.versions).groupBy("s").agg(F.count("*").alias("relations"))
    return S.current(v.versions).join(counts, "s").select("stmt_id", "s", "p", "o", "relations").orderBy(F.desc("relations"), "s", "p", "o")


@register("SELECT s, o, stmt_id FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY p, stmt_id) AS n FROM versions WHERE is_current) WHERE n <= 6", "versions")
def neighbor_cap(v: Views) -> DataFrame:
    order = Window.partitionBy("s").orderBy("p", "stmt_id")
    return S.current(v.versions).withColumn("n", F.row_number().over(order)).where("n <= 6").select("s", "o", "stmt_id")


@register("SELECT chain_id, event_id, action FROM (SELECT *, row_number() OVER (PARTITION BY chain_id ORDER BY log.\"at\" DESC, event_id DESC) AS n FROM log) WHERE n = 1", "log")
def last_per_key(v: Views) -> DataFrame:
    return S.last_per_key(v.log, ["chain_id"], F.col("at"), F.col("event_id")).select("chain_id", "event_id", "action")


@register("SELECT chain_id, count(*) AS n, bool_and(action = 'reject') AS all_failed FROM log GROUP BY chain_id", "log")
def all_failed(v: Views) -> DataFrame:
    return v.log.groupBy("chain_id").agg(F.count("*").alias("n"), F.bool_and(F.col("action") == "reject").alias("all_failed"))


@register("""SELECT a.event_id, coalesce(min((b.action IN ('accept', 'reject'))::INTEGER), 1) = 1 AS others_finished FROM log a
LEFT JOIN log b ON a.chain_id = b.chain_id AND a.event_id <> b.event_id GROUP BY a.event_id""", "log")
def others_finished(v: Views) -> DataFrame:
    """Whether all other events of the chain are final: one count for each chain, less the event's own share."""
    final = F.col("action").isin("accept", "reject")
    open_ = v.log.groupBy("chain_id").agg(F.count_if(~final).alias("open"))
    return v.log.join(open_, "chain_id").select("event_id", (F.col("open") - (~final).cast("int") == 0).alias("others_finished"))


@register("SELECT chain_id, count(*) FILTER (action = 'accept') AS owners FROM log GROUP BY chain_id", "log")
def owner_count(v: Views) -> DataFrame:
    return v.log.groupBy("chain_id").agg(F.count_if(F.col("action") == "accept").alias("owners"))


@register("SELECT e.event_id, e.action, c.c_name FROM log e JOIN customer c ON e.agent_id = 'user-' || c.c_custkey WHERE c.c_nationkey = 3", "log")
def list_run_tasks(v: Views) -> DataFrame:
    users = v.table("customer").where("c_nationkey = 3").select(F.concat(F.lit("user-"), "c_custkey").alias("agent_id"), "c_name")
    return v.log.join(users, "agent_id").select("event_id", "action", "c_name")


@register("SELECT n.n_name AS workspace, c.c_name AS name, c.c_mktsegment AS role FROM nation n JOIN customer c ON c.c_nationkey = n.n_nationkey")
def user_workspaces(v: Views) -> DataFrame:
    users = v.table("customer").select("c_nationkey", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("role"))
    return users.join(v.table("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("workspace"), "name", "role")


@register("SELECT n.n_name AS workspace, c.c_mktsegment AS role, count(*) AS members FROM nation n JOIN customer c ON c.c_nationkey = n.n_nationkey GROUP BY ALL")
def member_list(v: Views) -> DataFrame:
    joined = v.table("customer").join(v.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy(F.col("n_name").alias("workspace"), F.col("c_mktsegment").alias("role")).agg(F.count("*").alias("members")).orderBy(F.desc("role"), "workspace")


@register("SELECT c_custkey, c_name FROM customer WHERE c_name = 'Customer#000000042' OR (c_custkey = 42 AND NOT EXISTS (SELECT 1 FROM customer WHERE c_name = 'Customer#000000042')) ORDER BY 1 LIMIT 1")
def user_lookup(v: Views) -> DataFrame:
    """By name, and else by key: the first match."""
    named = (F.col("c_name") == "Customer#000000042").cast("int")
    found = v.table("customer").where("c_name = 'Customer#000000042' or c_custkey = 42")
    return found.orderBy(named.desc(), "c_custkey").limit(1).select("c_custkey", "c_name")


# ---- actions --------------------------------------------------------------------------------------------------

#: Versions that the actions below take.
_PICK = "is_current AND status = 'pending' AND doc_id % 3 = 0"
_NEW = "root_id || '+' || (version_no + 1)"
_DATA = "SELECT DISTINCT s, p, o FROM versions WHERE is_current AND status = 'accepted'"


def _data(v: Views) -> DataFrame:
    return v.versions.where("is_current and status = 'accepted'").select("s", "p", "o").distinct()


def _acted(action: str, status: str, pick: str, o: str = "o") -> str:
    kept = "stmt_id, root_id, version_no, status, activity_type, o"
    return f"""SELECT {kept}, is_current AND NOT ({pick}) AS is_current FROM versions
UNION ALL SELECT {_NEW}, root_id, version_no + 1, {status}, '{action}', {o}, TRUE FROM versions WHERE {pick}"""


_SHOWN = ["stmt_id", "root_id", "version_no", "status", "activity_type", "o", "is_current"]


@register(_acted("accept", "'accepted'", _PICK), "versions")
def bulk_accept(v: Views) -> DataFrame:
    ids = v.versions.where(_PICK).select("stmt_id")
    return S.accept(v.versions, _data(v), ids)[0].select(*_SHOWN)


@register(f"{_DATA} UNION SELECT s, p, o FROM versions WHERE {_PICK}", "versions")
def accept_data_graph(v: Views) -> DataFrame:
    return S.accept(v.versions, _data(v), v.versions.where(_PICK).select("stmt_id"))[1]


_REJECT = "is_current AND status = 'accepted' AND doc_id % 3 = 1"


@register(_acted("reject", "'rejected'", _REJECT), "versions")
def reject(v: Views) -> DataFrame:
    return S.reject(v.versions, _data(v), v.versions.where(_REJECT).select("stmt_id"))[0].select(*_SHOWN)


@register(f"{_DATA} EXCEPT SELECT s, p, o FROM versions WHERE {_REJECT}", "versions")
def reject_data_graph(v: Views) -> DataFrame:
    return S.reject(v.versions, _data(v), v.versions.where(_REJECT).select("stmt_id"))[1]


_EDIT = "is_current AND doc_id % 7 = 2"


@register(_acted("edit", "status", _EDIT, "'edited ' || doc_id"), "versions")
def edit(v: Views) -> DataFrame:
    ids = v.versions.where(_EDIT).select("stmt_id")
    return S.edit(v.versions, _data(v), ids, o=F.concat(F.lit("edited "), F.col("doc_id")), o_kind=F.lit("literal"))[0].select(*_SHOWN)


_RESET = "is_current AND version_no > 0 AND doc_id % 5 = 1"


@register(f"""SELECT stmt_id, root_id, version_no, status, activity_type, o, is_current AND NOT ({_RESET}) AS is_current FROM versions
UNION ALL SELECT v.root_id || '+' || (v.version_no + 1), v.root_id, v.version_no + 1, 'pending', 'reset', f.o, TRUE
FROM (SELECT * FROM versions WHERE {_RESET}) v JOIN versions f ON f.root_id = v.root_id AND f.version_no = 0""", "versions")
def reset(v: Views) -> DataFrame:
    return S.reset(v.versions, _data(v), v.versions.where(_RESET).select("stmt_id"))[0].select(*_SHOWN)


@register("SELECT stmt_id, s, p, o FROM versions WHERE doc_id <> 7", "versions")
def delete_document(v: Views) -> DataFrame:
    return S.delete_document(v.versions, _data(v), 7)[0].select("stmt_id", "s", "p", "o")


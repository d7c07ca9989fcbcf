"""Queries of the merge-on-read statement log and of commits over several graphs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.statement_log import StatementLog
from ..plans import sparql
from ..session import store, work_folder
from ..sources.manifests import Manifests
from ..views import Views, with_views
from .log import _data
from .sources import _PREFIX, _QUADS, _quads

QUERIES: dict = {}
_ACCEPTED, _REJECTED, _EDITED, _RESET, _RETIRED = (
    "is_current AND status <> 'accepted' AND doc_id % 5 = 0", "is_current AND status = 'accepted' AND doc_id % 5 = 1", "is_current AND doc_id % 5 = 2",
    "is_current AND version_no > 0 AND doc_id % 5 = 3", "is_current AND doc_id % 5 = 4 AND doc_id % 2 = 0",
)


def register(sql: str, *views: str):
    def add(function):
        QUERIES[function.__name__] = (function, with_views(sql, *views))
        return function

    return add


def _log(v: Views) -> StatementLog:
    """The versions as a log of its own."""
    log = StatementLog(v.spark, f"{work_folder(v.spark)}/log-{uuid.uuid4().hex}")
    log.create(v.versions, _data(v))
    return log


def _acted(v: Views) -> StatementLog:
    """Five actions, each on what the ones before it left."""
    log = _log(v)
    ids = lambda where: v.versions.where(where).select("stmt_id")
    log.accept(ids(_ACCEPTED))
    log.reject(ids(_REJECTED))
    log.edit(ids(_EDITED), o=F.concat(F.lit("edited "), F.col("doc_id")), o_kind=F.lit("literal"))
    log.reset(ids(_RESET))
    log.retire(ids(_RETIRED))
    return log


_SHOWN = ["stmt_id", "root_id", "version_no", "status", "activity_type", "o", "is_current"]
_OLD = f"SELECT stmt_id, root_id, version_no, status, activity_type, o, is_current AND NOT (({_ACCEPTED}) OR ({_REJECTED}) OR ({_EDITED}) OR ({_RESET}) OR ({_RETIRED})) AS is_current FROM versions"


def _new(action: str, status: str, pick: str, o: str = "o") -> str:
    return f"SELECT root_id || '+' || (version_no + 1) AS stmt_id, root_id, version_no + 1, {status}, '{action}', {o}, TRUE FROM versions WHERE {pick}"


_AFTER = f"""{_OLD} UNION ALL {_new("accept", "'accepted'", _ACCEPTED)} UNION ALL {_new("reject", "'rejected'", _REJECTED)} UNION ALL {_new("edit", "status", _EDITED, "'edited ' || doc_id")}
UNION ALL SELECT v.root_id || '+' || (v.version_no + 1), v.root_id, v.version_no + 1, 'pending', 'reset', f.o, TRUE FROM (SELECT * FROM versions WHERE {_RESET}) v JOIN versions f ON f.root_id = v.root_id AND f.version_no = 0"""
_DATA_AFTER = f"""(SELECT s, p, o FROM versions WHERE is_current AND status = 'accepted' UNION SELECT s, p, o FROM versions WHERE {_ACCEPTED})
EXCEPT SELECT s, p, o FROM versions WHERE status = 'accepted' AND (({_REJECTED}) OR ({_EDITED}) OR ({_RESET}))"""


@register(_AFTER, "versions")
def merged_log(v: Views) -> DataFrame:
    """The log after five actions, merged from base and deltas."""
    return _acted(v).versions().select(*_SHOWN)


@register(_AFTER, "versions")
def compacted_log(v: Views) -> DataFrame:
    """The same after a compaction, when base files alone hold it."""
    log = _acted(v)
    log.compact()
    return log.versions().select(*_SHOWN)


@register(_DATA_AFTER, "versions")
def merged_data(v: Views) -> DataFrame:
    """The data graph after the same actions: of the changes of a triple the last one holds."""
    return _acted(v).data()


@register("""SELECT 'statement' AS kind, stmt_id AS a, s AS b FROM versions WHERE doc_id % 7 <> 2
UNION ALL SELECT 'triple', s, p FROM (SELECT s, p, o FROM versions WHERE is_current AND status = 'accepted' EXCEPT SELECT s, p, o FROM versions WHERE doc_id % 7 = 2)""", "versions")
def deleted_documents(v: Views) -> DataFrame:
    """Log and data graph without some documents: one commit that writes their ids and triples."""
    log = _log(v)
    log.delete_documents(v.versions.where("doc_id % 7 = 2").select("doc_id"))
    return log.versions().select(F.lit("statement").alias("kind"), F.col("stmt_id").alias("a"), F.col("s").alias("b")).union(log.data().select(F.lit("triple"), "s", "p"))


@register(f""", {_QUADS} SELECT * FROM quads WHERE g <> 'curation' UNION SELECT 'index', o, 'of', s FROM quads WHERE g = 'data'""", "versions")
def committed_graphs(v: Views) -> DataFrame:
    """Two updates of one request over three graphs, published as one state and read from it, graph by graph."""
    tables = Manifests(v.spark, f"{work_folder(v.spark)}/graphs-{uuid.uuid4().hex}")
    request = _PREFIX + "INSERT { GRAPH <index> { ?o <of> ?s } } WHERE { GRAPH <data> { ?s ?p ?o } } ; DROP SILENT GRAPH <curation>"
    quads = store(sparql.update(request, _quads(v), store, graph="data"))
    base = tables.state()
    tables.commit(base, {g: [tables.write(quads.where(F.col("g") == g), base, g)] for g in ("data", "index", "curation")})
    state = tables.state()
    read = [tables.read(p) for g in ("data", "index", "curation") for p in state.parts(g)]
    return read[0].union(read[1]).union(read[2])

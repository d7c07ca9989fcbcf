"""Queries of the algebra: patterns, joins, paths, updates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import algebra as A
from ..session import store
from ..views import NS, Views, with_views

P = f"{NS}p/"
CUSTOMER = [("?c", f"{P}type", f"{NS}c/Customer"), ("?c", f"{P}inNation", "?n"), ("?n", f"{P}name", "?name")]
REVISIONS = "parent_kind = 'statement'"

QUERIES: dict = {}


def register(sql: str | None, *views: str):
    def add(function):
        QUERIES[function.__name__] = (function, with_views(sql, *views) if sql and views else sql)
        return function

    return add


@register("SELECT s, p, o, o_kind FROM triples WHERE o_kind = 'iri'", "triples")
def graph_scan(v: Views) -> DataFrame:
    return v.triples.where("o_kind = 'iri'")


@register(f"SELECT s AS c, o AS segment FROM triples WHERE p = '{P}segment'", "triples")
def bgp_const(v: Views) -> DataFrame:
    return A.pattern(v.triples, "?c", f"{P}segment", "?segment")


@register(f"""SELECT a.s AS c, b.o AS n, d.o AS name FROM triples a JOIN triples b ON a.s = b.s JOIN triples d ON b.o = d.s
WHERE a.p = '{P}type' AND a.o = '{NS}c/Customer' AND b.p = '{P}inNation' AND d.p = '{P}name'""", "triples")  # fmt: skip
def bgp_join(v: Views) -> DataFrame:
    return A.bgp(v.triples, CUSTOMER)


@register("SELECT CASE WHEN conv_id % 2 = 0 THEN 'data' ELSE 'curation' END AS g, count(*) AS n FROM conversations GROUP BY ALL")
def graph_var(v: Views) -> DataFrame:
    graph = F.when(F.col("doc_id") % 2 == 0, "data").otherwise("curation")
    return v.versions.groupBy(graph.alias("g")).agg(F.count("*").alias("n"))


@register(f"SELECT DISTINCT o AS segment FROM triples WHERE p = '{P}segment'", "triples")
def select_distinct(v: Views) -> DataFrame:
    return A.pattern(v.triples, "?c", f"{P}segment", "?segment").select("segment").distinct()


@register(f"SELECT s, o FROM triples WHERE p = '{P}priority' AND (o = '1-URGENT' OR NOT (o = '2-HIGH')) AND o NOT IN ('5-LOW')", "triples")
def filter_terms(v: Views) -> DataFrame:
    o = F.col("o")
    return v.triples.where((F.col("p") == f"{P}priority") & ((o == "1-URGENT") | ~(o == "2-HIGH")) & ~o.isin("5-LOW")).select("s", "o")


@register("SELECT doc_id, lang, quality FROM doc_status", "doc_status")
def optional_left(v: Views) -> DataFrame:
    labels = v.table("labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return A.optional(v.table("documents").select("doc_id", "lang"), labels)


@register("""SELECT d.doc_id, l.q AS quality, CASE WHEN l.q IS NOT NULL THEN l.t END AS toxic
FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS q, max(toxic) AS t FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id AND l.q = 1""")
def optional_nested(v: Views) -> DataFrame:
    labels = v.table("labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    first = A.optional(v.table("documents").select("doc_id"), labels.select("doc_id", "quality"), F.col("quality") == 1)
    second = A.optional(first, labels.select("doc_id", "toxic"))
    return second.select("doc_id", "quality", F.when(F.col("quality").isNotNull(), F.col("toxic")).alias("toxic"))


@register("""SELECT stmt_id, 'accepted' AS found, s, NULL::VARCHAR AS agent_id FROM versions WHERE status = 'accepted'
UNION ALL SELECT stmt_id, 'edited', NULL, agent_id FROM versions WHERE activity_type = 'edit'""", "versions")
def union_branches(v: Views) -> DataFrame:
    one = v.versions.where("status = 'accepted'").select("stmt_id", F.lit("accepted").alias("found"), "s")
    two = v.versions.where("activity_type = 'edit'").select("stmt_id", F.lit("edited").alias("found"), "agent_id")
    return A.union(one, two)


@register(f"SELECT s, p, o FROM triples WHERE (s = '{NS}nation/3' AND p = '{P}name') OR (s = '{NS}nation/5' AND p = '{P}inRegion')", "triples")
def values_join(v: Views) -> DataFrame:
    return A.values(v.triples.select("s", "p", "o"), ["s", "p"], [(f"{NS}nation/3", f"{P}name"), (f"{NS}nation/5", f"{P}inRegion")])


@register("SELECT stmt_id, CASE WHEN status = 'pending' THEN 1 ELSE 0 END AS is_pending FROM versions WHERE is_current", "versions")
def bind_if(v: Views) -> DataFrame:
    return v.versions.where("is_current").select("stmt_id", F.when(F.col("status") == "pending", 1).otherwise(0).alias("is_pending"))


@register("SELECT count(*) AS n, sum(x) AS pending FROM (SELECT DISTINCT s, (status = 'pending')::INTEGER AS x FROM versions WHERE is_current)", "versions")
def subselect_counts(v: Views) -> DataFrame:
    inner = v.versions.where("is_current").select("s", (F.col("status") == "pending").cast("int").alias("x")).distinct()
    return inner.agg(F.count("*").alias("n"), F.sum("x").alias("pending"))


@register("""SELECT lang, count(*) AS n, count(quality) AS labelled, count(DISTINCT source) AS sources, sum(n_chars) AS chars, max(n_chars) AS longest,
min(doc_id) AS first FROM doc_status GROUP BY lang HAVING count(*) > 5""", "doc_status")
def agg_counts(v: Views) -> DataFrame:
    out = v.doc_status.groupBy("lang").agg(
        F.count("*").alias("n"), F.count("quality").alias("labelled"), F.count_distinct("source").alias("sources"), F.sum("n_chars").alias("chars"),
        F.max("n_chars").alias("longest"), F.min("doc_id").alias("first"),
    )
    return out.where("n > 5")


@register("SELECT s, o, o_kind FROM triples WHERE p = '%sname'" % P, "triples")
def order_terms(v: Views) -> DataFrame:
    return v.triples.where(F.col("p") == f"{P}name").select("s", "o", "o_kind").orderBy(*A.term_order("o", "o_kind"), "s")


@register(f"SELECT s, o FROM triples WHERE p = '{P}name' ORDER BY o, s LIMIT 50 OFFSET 10", "triples")
def limit_rows(v: Views) -> DataFrame:
    return A.pattern(v.triples, "?s", f"{P}name", "?o").orderBy("o", "s").offset(10).limit(50)


def _edges(v: Views) -> DataFrame:
    return v.versions.where(REVISIONS).select(F.col("stmt_id").alias("src"), F.col("parent_id").alias("dst"))


def _starts(v: Views, where: str) -> DataFrame:
    return v.versions.where(where).select(F.col("stmt_id").alias("start"))


@register("SELECT a.stmt_id AS start, b.stmt_id AS node FROM versions a JOIN versions b ON a.doc_id = b.doc_id AND b.version_no <= a.version_no WHERE a.is_current", "versions")
def path_star(v: Views) -> DataFrame:
    """All versions that current ones are derived from, themselves included."""
    return A.path_star(_edges(v), _starts(v, "is_current"), store)


@register("SELECT a.stmt_id AS start, b.stmt_id AS node FROM versions a JOIN versions b ON a.doc_id = b.doc_id AND b.version_no < a.version_no WHERE a.is_current", "versions")
def path_plus(v: Views) -> DataFrame:
    return A.path_plus(_edges(v), _starts(v, "is_current"), store)


@register("SELECT a.stmt_id AS start, b.stmt_id AS node FROM versions a JOIN versions b ON a.doc_id = b.doc_id AND b.version_no >= a.version_no WHERE a.version_no = 0", "versions")
def path_inverse(v: Views) -> DataFrame:
    return A.path_star(_edges(v), _starts(v, "version_no = 0"), store, src="dst", dst="src")


@register("SELECT DISTINCT s, p, o FROM versions WHERE is_current AND status = 'accepted'", "versions")
def construct_accepted(v: Views) -> DataFrame:
    return A.construct(v.versions.where("is_current and status = 'accepted'"), [("?s", "?p", "?o")])


@register("SELECT count(*) > 0 AS answer FROM versions WHERE status = 'accepted' AND is_current", "versions")
def ask_exists(v: Views) -> DataFrame:
    return A.ask(v.versions.where("status = 'accepted' and is_current"))


@register("SELECT s, p, o FROM versions WHERE version_no = 0 UNION SELECT s, p, o FROM versions WHERE is_current", "versions")
def insert_data(v: Views) -> DataFrame:
    graph = v.versions.where("version_no = 0").select("s", "p", "o")
    return A.insert_data(graph, v.versions.where("is_current").select("s", "p", "o"))


@register("SELECT s, p, o FROM versions EXCEPT SELECT s, p, o FROM versions WHERE status = 'rejected'", "versions")
def delete_data(v: Views) -> DataFrame:
    return A.delete_data(v.versions.select("s", "p", "o").distinct(), v.versions.where("status = 'rejected'").select("s", "p", "o"))


@register(f"""SELECT s, p, CASE WHEN p = '{P}priority' AND o = '5-LOW' THEN 'low' ELSE o END AS o FROM triples""", "triples")
def modify_where(v: Views) -> DataFrame:
    low = A.pattern(v.triples, "?x", f"{P}priority", "5-LOW")
    return A.modify(v.triples.select("s", "p", "o"), low, [("?x", f"{P}priority", "5-LOW")], [("?x", f"{P}priority", "low")])


@register(f"SELECT s AS c FROM triples WHERE p = '{P}type' AND o = '{NS}c/Customer' AND s IN (SELECT o FROM triples WHERE p = '{P}placedBy')", "triples")
def filter_exists(v: Views) -> DataFrame:
    return A.exists(A.pattern(v.triples, "?c", f"{P}type", f"{NS}c/Customer"), A.pattern(v.triples, "?order", f"{P}placedBy", "?c"))

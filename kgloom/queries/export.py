"""Queries of merging, serialisation and user queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import export as X
from ..plans.sparql import labels_over, service_over, within
from ..plans.sparql import run as sparql
from ..session import store
from ..views import NS, Views, with_views

QUERIES: dict = {}


def register(sql: str | None, *views: str):
    def add(function):
        QUERIES[function.__name__] = (function, with_views(sql, *views) if sql and views else sql)
        return function

    return add


@register("SELECT uri, min(m) AS canonical FROM (SELECT a AS uri, least(min(a) OVER (PARTITION BY b), b) AS m FROM copies UNION ALL SELECT b, least(min(a) OVER (PARTITION BY b), b) FROM copies) GROUP BY uri", "copies")
def dedup_components(v: Views) -> DataFrame:
    return X.canonical(v.copies, store)


_WHOLE = f"SELECT DISTINCT '{NS}d/' || source || '_' || substr(md5(doc_id::VARCHAR), 1, 6) AS uri FROM documents"


@register(f"WITH u AS ({_WHOLE}), c AS (SELECT uri, regexp_replace(uri, '_[0-9a-f]{{6}}$', '') AS cut FROM u) SELECT uri, CASE WHEN count(*) OVER (PARTITION BY cut) = 1 THEN cut ELSE uri END AS short FROM c")
def hash_strip(v: Views) -> DataFrame:
    """URIs of all documents without the digits at their end, where these aren't needed to tell them apart."""
    return X.strip_hashes(v.table("documents").select(F.concat(F.lit(f"{NS}d/"), "source", F.lit("_"), F.substring(F.md5(F.col("doc_id").cast("string")), 1, 6)).alias("uri")))


def _doc_triples(v: Views) -> DataFrame:
    docs, s = v.table("documents"), F.concat(F.lit(f"{NS}doc/"), "doc_id")
    cells = F.array(F.struct(F.lit(f"{NS}p/lang").alias("p"), F.col("lang").alias("o")), F.struct(F.lit(f"{NS}p/source").alias("p"), F.col("source").alias("o")))
    return docs.select(s.alias("s"), F.explode(cells).alias("x")).select("s", "x.p", "x.o")


@register(f"""SELECT DISTINCT coalesce(n.m, d.s) AS s, d.p, d.o FROM
(SELECT '{NS}doc/' || doc_id AS s, '{NS}p/lang' AS p, lang AS o FROM documents UNION ALL SELECT '{NS}doc/' || doc_id, '{NS}p/source', source FROM documents) d
LEFT JOIN (SELECT uri, min(m) AS m FROM (SELECT a AS uri, least(min(a) OVER (PARTITION BY b), b) AS m FROM copies UNION ALL SELECT b, least(min(a) OVER (PARTITION BY b), b) FROM copies) GROUP BY uri) n ON n.uri = d.s""", "copies")
def dedup_export(v: Views) -> DataFrame:
    return X.deduplicated(_doc_triples(v), v.copies, store)


@register("SELECT '<' || s || '> <' || p || '> ' || CASE WHEN o_kind = 'iri' THEN '<' || o || '>' ELSE '\"' || o || '\"' END || ' .' AS line FROM triples", "triples")
def export_ntriples(v: Views) -> DataFrame:
    return X.ntriples(v.triples)


@register(f"""SELECT s, '{{"@id":"' || s || '",' || string_agg(k, ',' ORDER BY k) || '}}' AS node FROM
(SELECT s, '"' || p || '":[' || string_agg(x, ',' ORDER BY x) || ']' AS k FROM (SELECT DISTINCT s, p, CASE WHEN o_kind = 'iri' THEN '{{"@id":"' || o || '"}}' ELSE '{{"@value":' || to_json(o)::VARCHAR || '}}' END AS x FROM triples) GROUP BY s, p) GROUP BY s""", "triples")
def export_jsonld(v: Views) -> DataFrame:
    return X.jsonld(v.triples)


@register(f"SELECT s, p, o FROM triples UNION SELECT a, '{NS}p/sameAs', b FROM copies", "triples", "copies")
def merge_graphs(v: Views) -> DataFrame:
    return v.triples.select("s", "p", "o").union(v.copies.select("a", F.lit(f"{NS}p/sameAs"), "b")).distinct()


@register(f"""SELECT s AS uri, min(CASE WHEN p = '{NS}p/type' THEN regexp_extract(o, '[^/]*$') END) AS type, count(*) FILTER (o_kind = 'literal') AS literals,
count(*) FILTER (o_kind = 'iri' AND p <> '{NS}p/type') AS links FROM triples GROUP BY s""", "triples")
def entity_pivot(v: Views) -> DataFrame:
    """Entities from triples: types, literals and links of each subject, by one aggregation."""
    from ..functions.columns import local_name

    is_type, link = F.col("p") == f"{NS}p/type", F.col("o_kind") == "iri"
    return v.triples.groupBy(F.col("s").alias("uri")).agg(
        F.min(F.when(is_type, local_name(F.col("o")))).alias("type"), F.count_if(~link).alias("literals"), F.count_if(link & ~is_type).alias("links")
    )


# ---- the text front-end ---------------------------------------------------------------------------------------

_PREFIX = f"PREFIX p: <{NS}p/> PREFIX c: <{NS}c/>\n"


@register(f"""SELECT c.s AS c, g.o AS segment, n.o AS name FROM triples c JOIN triples i ON i.s = c.s AND i.p = '{NS}p/inNation' JOIN triples n ON n.s = i.o AND n.p = '{NS}p/name'
LEFT JOIN triples g ON g.s = c.s AND g.p = '{NS}p/segment' AND g.o <> 'BUILDING' WHERE c.p = '{NS}p/type' AND c.o = '{NS}c/Customer'""", "triples")
def user_select(v: Views) -> DataFrame:
    return sparql(_PREFIX + "SELECT ?c ?segment ?name WHERE { ?c a c:Customer ; p:inNation ?n . ?n p:name ?name . OPTIONAL { ?c p:segment ?segment FILTER(?segment != 'BUILDING') } }", v.triples, {"a": f"{NS}p/type"})


@register(f"SELECT o AS segment, count(*) AS n FROM triples WHERE p = '{NS}p/segment' GROUP BY o HAVING count(*) > 3", "triples")
def user_group(v: Views) -> DataFrame:
    return sparql(_PREFIX + "SELECT ?segment (COUNT(*) AS ?n) { ?c p:segment ?segment } GROUP BY ?segment HAVING (?n > 3) ORDER BY DESC(?n)", v.triples)


_LABELS = "labels AS (SELECT '" + NS + "customer/' || c_custkey AS item, unnest(CASE c_custkey % 3 WHEN 0 THEN ['en'] WHEN 1 THEN ['en', 'de'] ELSE ['fr'] END) AS lang, c_name || ' ' || c_custkey % 3 AS label FROM customer)"


@register(f""", {_LABELS}, best AS (SELECT item, coalesce(max(label || ' ' || lang) FILTER (lang = 'de'), max(label || ' ' || lang) FILTER (lang = 'en')) AS label FROM labels GROUP BY item)
SELECT t.s AS c, coalesce(b.label, t.s) AS "cLabel" FROM triples t LEFT JOIN best b ON b.item = t.s WHERE t.p = '{NS}p/segment' AND t.o = 'BUILDING'""", "triples")
def service_labels(v: Views) -> DataFrame:
    """A label service beside a pattern: the items that it binds, once each, get a label of the preferred language."""
    k = F.col("c_custkey")
    languages = F.when(k % 3 == 0, F.array(F.lit("en"))).when(k % 3 == 1, F.array(F.lit("en"), F.lit("de"))).otherwise(F.array(F.lit("fr")))
    labels = v.table("customer").select(F.concat(F.lit(f"{NS}customer/"), k).alias("item"), F.explode(languages).alias("lang"), F.concat("c_name", F.lit(" "), k % 3).alias("label"))
    labels = labels.withColumn("label", F.concat_ws(" ", "label", "lang"))
    text = f"""PREFIX p: <{NS}p/> PREFIX bd: <http://bd/> PREFIX wikibase: <http://wikibase/>
      SELECT ?c ?cLabel {{ SERVICE wikibase:label {{ bd:serviceParam wikibase:language "de, en" }} ?c p:segment 'BUILDING' }}"""
    return sparql(text, v.triples, services={"http://wikibase/label": labels_over(labels)})


@register(f"""SELECT a.s AS c, b.o AS n, d.o AS region FROM triples a JOIN triples b ON a.s = b.s JOIN triples c ON c.s = b.o JOIN triples d ON d.s = c.o
WHERE a.p = '{NS}p/segment' AND a.o = 'BUILDING' AND b.p = '{NS}p/inNation' AND c.p = '{NS}p/inRegion' AND d.p = '{NS}p/name'""", "triples")
def service_join(v: Views) -> DataFrame:
    """A pattern that another service answers for the nations that the rest of the query binds."""
    here, there = v.triples.where(~F.contains("s", F.lit("/nation/")) & ~F.contains("s", F.lit("/region/"))), v.triples
    text = f"PREFIX p: <{NS}p/> SELECT ?c ?n ?region {{ ?c p:segment 'BUILDING' ; p:inNation ?n SERVICE <http://places/> {{ ?n p:inRegion ?r . ?r p:name ?region }} }}"
    return sparql(text, here, services={"http://places/": service_over(there)})


@register(f"SELECT s AS c, o AS n FROM triples WHERE p = '{NS}p/name' AND contains(s, '/customer/')", "triples")
def timed_query(v: Views) -> DataFrame:
    """A user's query that ends, or is cancelled, within its time limit: its result is stored by then."""
    found = sparql(f"PREFIX p: <{NS}p/> SELECT ?c ?n {{ ?c p:name ?n ; p:segment ?s }}", v.triples)
    return within(found, 600.0, store)


@register(f"SELECT count(*) > 0 AS answer FROM triples WHERE p = '{NS}p/inRegion'", "triples")
def user_ask(v: Views) -> DataFrame:
    return sparql(_PREFIX + "ASK { ?n p:inRegion ?r }", v.triples)


@register(f"""SELECT DISTINCT o.s AS order, n.o AS region FROM triples o JOIN triples c ON c.s = o.o AND c.p = '{NS}p/inNation' JOIN triples n ON n.s = c.o AND n.p = '{NS}p/inRegion'
WHERE o.p = '{NS}p/placedBy' AND o.s NOT IN (SELECT s FROM triples WHERE p = '{NS}p/priority' AND o = '5-LOW')""".replace("AS order", 'AS "order"'), "triples")  # fmt: skip
def user_path(v: Views) -> DataFrame:
    return sparql(_PREFIX + "SELECT DISTINCT ?order ?region { ?order p:placedBy/p:inNation/p:inRegion ?region . MINUS { ?order p:priority '5-LOW' } }", v.triples)


@register(f"""SELECT s, o AS name FROM triples WHERE p = '{NS}p/name' AND (s = '{NS}nation/1' OR s = '{NS}nation/2')
UNION ALL SELECT s, o FROM triples WHERE p = '{NS}p/segment' AND o = 'MACHINERY'""", "triples")
def user_union(v: Views) -> DataFrame:
    return sparql(_PREFIX + f"SELECT ?s ?name {{ {{ ?s p:name ?name . VALUES ?s {{ <{NS}nation/1> <{NS}nation/2> }} }} UNION {{ ?s p:segment ?name FILTER(?name = 'MACHINERY') }} }}", v.triples)

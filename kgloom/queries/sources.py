"""Queries of sources and sinks, of extraction records, of prefixes, and of graphs by name."""

from __future__ import annotations

import json
import uuid

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns, matching
from ..operators import algebra as A
from ..operators import export as X
from ..operators import extraction as E
from ..plans import sparql
from ..session import work_folder, store
from ..sources import files, yaml
from ..views import NS, Views, with_views

QUERIES: dict = {}


def register(sql: str | None, *views: str):
    def add(function):
        QUERIES[function.__name__] = (function, with_views(sql, *views) if sql and views else sql)
        return function

    return add


# ---- files ----------------------------------------------------------------------------------------------------


@register("SELECT user_id::VARCHAR AS source_document, 'e/' || event_type AS subject, 'p' || (event_id % 5) AS predicate, arg_max(value, event_id)::DOUBLE AS confidence, max(event_id)::INTEGER AS span_start FROM events GROUP BY ALL")
def load_annotations(v: Views) -> DataFrame:
    """Annotations written as JSON, an object for each document, and read again; of equal keys the last counts."""
    cells = F.struct(F.col("event_id").alias("span_start"), F.concat(F.lit("e/"), "event_type").alias("subject"), F.concat(F.lit("http://x/y#p"), F.col("event_id") % 5).alias("predicate"), F.lit("x").alias("value"), F.col("value").alias("confidence"))
    rows = v.table("events").groupBy(F.col("user_id").cast("string").alias("source_document")).agg(F.array_sort(F.collect_list(cells)).alias("annotations"))
    path = f"{work_folder(v.spark)}/notes-{uuid.uuid4().hex}"
    rows.write.json(path)
    return files.read_annotations(v.spark, path, lines=True).select("source_document", "subject", "predicate", "confidence", "span_start")


@register("SELECT doc_id::VARCHAR AS source_document, s AS subject, stmt_id AS predicate, o AS value, span_start, confidence FROM versions", "versions")
def write_annotations(v: Views) -> DataFrame:
    """Annotations written by document and read again."""
    rows = v.versions.select(F.col("doc_id").cast("string").alias("source_document"), F.col("s").alias("subject"), F.col("stmt_id").alias("predicate"), F.col("o").alias("value"), "span_start", "span_end", "confidence")
    path = f"{work_folder(v.spark)}/notes-{uuid.uuid4().hex}"
    files.write_annotations(rows, path)
    return files.read_annotations(v.spark, path, lines=True).select("source_document", "subject", "predicate", F.col("key").alias("value"), "span_start", "confidence")


def _text_udf(kernel, kind: str = "string"):
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else kernel(t))

    return F.pandas_udf(run, kind)


_DEFAULTS = {"settings": {"limit": 5, "language": "en"}, "name": "none"}


@register("""SELECT n_nationkey, n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey ELSE 5 END::INTEGER AS "limit", 'en' AS language, CASE n_nationkey % 3 WHEN 0 THEN 'a,b # c' WHEN 1 THEN 'x' ELSE '' END AS items FROM nation""")
def read_configs(v: Views) -> DataFrame:
    """Configurations as YAML text, with defaults for what they don't say."""
    n = F.col("n_nationkey")
    limit = F.when(n % 2 == 0, F.concat(F.lit("settings:\n  limit: "), n, F.lit("  # hits\n"))).otherwise(F.lit("# nothing\n"))
    items = F.when(n % 3 == 0, "items:\n- a\n- \"b # c\"\n").when(n % 3 == 1, "items: [x]\n").otherwise("items: []\n")
    text = F.concat(F.lit("name: "), "n_name", F.lit("\n"), limit, items)
    read = _text_udf(lambda t: json.dumps(files.parse_config(t, _DEFAULTS)))
    x = F.from_json(read(text), "name string, settings struct<limit:int,language:string>, items array<string>")
    return v.table("nation").select("n_nationkey", x.alias("x")).select("n_nationkey", "x.name", "x.settings.limit", "x.settings.language", F.array_join("x.items", ",").alias("items"))


@register("SELECT n_nationkey, 'home' || n_nationkey AS uris, 'name,note' || n_nationkey AS names, 'k' || n_regionkey AS prefix, 'http://x/' || n_nationkey AS namespace, 'Person' AS root FROM nation")
def scan_schema(v: Views) -> DataFrame:
    """What schemas say of their fields: links, text fields, prefixes and the root class."""
    n = F.col("n_nationkey")
    text = F.concat(
        F.lit("default_prefix: k"), "n_regionkey", F.lit("\nprefixes:\n  k:\n    prefix_reference: http://x/"), n, F.lit("\n  other: http://y/\nclasses:\n  Thing: {}\n  Person:\n    tree_root: true\nslots:\n  home"),
        n, F.lit(":\n    range: uri\n  name:\n  note"), n, F.lit(":\n    range: string\n    multivalued: true\n  size: {range: integer}\n"),
    )
    read = _text_udf(lambda t: json.dumps(files.slots(yaml.load(t))))
    x = F.from_json(read(text), "uris array<string>, names array<string>, prefix string, prefixes map<string,string>, root string")
    return v.table("nation").select("n_nationkey", x.alias("x")).select("n_nationkey", F.array_join("x.uris", ",").alias("uris"), F.array_join("x.names", ",").alias("names"), "x.prefix", F.col("x.prefixes")["k"].alias("namespace"), "x.root")


@register("SELECT doc_id, text, lang, n_chars FROM documents")
def yaml_round_trip(v: Views) -> DataFrame:
    """Records as YAML text and back."""
    rows = v.table("documents").select("doc_id", F.to_json(F.struct("text", F.struct("lang", F.array("n_chars", "n_chars").alias("sizes")).alias("about"))).alias("x"))
    again = _text_udf(lambda t: json.dumps(yaml.load(yaml.dump(json.loads(t)))))
    x = F.from_json(again("x"), "text string, about struct<lang:string,sizes:array<long>>")
    return rows.select("doc_id", x.alias("x")).select("doc_id", "x.text", "x.about.lang", F.get("x.about.sizes", F.lit(1)).alias("n_chars"))


# ---- extraction -----------------------------------------------------------------------------------------------


@register("""SELECT user_id, event_type AS id, min(event_id) + 1 AS n, arg_min(value, event_id) FILTER (event_id % 2 = 0 AND value <> 0)::DOUBLE AS a FROM events GROUP BY ALL""")
def merge_by_id(v: Views) -> DataFrame:
    """Items of one id merged: the first counts, its empty fields filled by later ones."""
    a = F.when((F.col("event_id") % 2 == 0) & (F.col("value") != 0), F.col("value").cast("string")).otherwise("")
    item = F.to_json(F.struct(F.col("event_type").alias("id"), (F.col("event_id") + 1).alias("n"), a.alias("a")))
    lists = v.table("events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", item.alias("x")))), lambda e: e["x"]).alias("items"))
    merged = lists.select("user_id", F.explode(F.from_json(E.merge_udf()("items"), "array<struct<id:string,n:long,a:string>>")).alias("x"))
    return merged.select("user_id", "x.id", "x.n", F.nullif("x.a", F.lit("")).cast("double").alias("a"))


@register("""SELECT user_id, last(value ORDER BY event_id)::DOUBLE AS v, array_to_string(list_transform(list_sort(list(DISTINCT event_type)), lambda x: x), ',') AS kinds, arg_max(event_type, event_id) FILTER (event_type <> 'error') AS kind FROM events GROUP BY user_id""")
def merge_chunks(v: Views) -> DataFrame:
    """Objects of the chunks of a text as one: lists united, of other values the last that isn't empty."""
    kind = F.when(F.col("event_type") != "error", F.col("event_type")).otherwise("")
    item = F.to_json(F.struct(F.col("value").alias("v"), F.array("event_type").alias("kinds"), kind.alias("kind")))
    lists = v.table("events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", item.alias("x")))), lambda e: e["x"]).alias("items"))
    x = F.from_json(E.merge_objects_udf()("items"), "v double, kinds array<string>, kind string")
    return lists.select("user_id", x.alias("x")).select("user_id", "x.v", F.array_join(F.array_sort("x.kinds"), ",").alias("kinds"), F.nullif("x.kind", F.lit("")).alias("kind"))


_ID = "substr(md5({0}), 1, 6)"


@register(f"""SELECT p_partkey, '{{"brand": "' || p_brand || '", "id": "kg:' || string_split(p_name, ' ')[2] || '_' || left(p_name, 1) || '_' || {_ID.format("'{\"_doc\": \"doc\", \"brand\": \"' || p_brand || '\", \"id\": \"AUTO\", \"name\": \"' || p_name || '\"}'")}
|| '", "name": "' || p_name || '"}}' AS cleaned FROM part""")
def clean_result(v: Views) -> DataFrame:
    """Records without empty lists and bad links, with an id made of the name."""
    item = F.to_json(F.struct(F.col("p_name").alias("name"), F.lit("AUTO").alias("id"), F.array(F.lit("")).alias("urls"), F.lit("no link").alias("home"), F.col("p_brand").alias("brand")))
    return v.table("part").select("p_partkey", E.clean_udf(E.Slots(names=("name", "brand"), uris=frozenset(["home"])))(item, F.lit("doc")).alias("cleaned"))


@register(f"""SELECT c_custkey, 'kg:' || CASE WHEN c_custkey % 2 = 0 THEN 'Roe_J' ELSE replace(c_name, '#', '') END || '_' || {_ID.format("'{\"_doc\": \"d' || c_custkey || '\", \"name\": \"' || name || '\"}'")} AS id
FROM (SELECT *, CASE WHEN c_custkey % 2 = 0 THEN 'Jane Roe Jr.' ELSE c_name END AS name FROM customer)""")
def fallback_id(v: Views) -> DataFrame:
    """Ids of a last name, initials and a digest; of a single word; titles don't count."""
    name = F.when(F.col("c_custkey") % 2 == 0, "Jane Roe Jr.").otherwise(F.col("c_name"))
    cleaned = E.clean_udf(E.Slots(names=("name",)))(F.to_json(F.struct(name.alias("name"))), F.concat(F.lit("d"), "c_custkey"))
    return v.table("customer").select("c_custkey", F.get_json_object(cleaned, "$.id").alias("id"))


@register("""SELECT p_partkey, '{"name": "' || p_name || '", "sizes": ["1", "2", "' || p_brand || '"]}' AS parsed FROM part""")
def parse_completion(v: Views) -> DataFrame:
    """Completions as fields with list items, or as fenced JSON."""
    lines = F.concat(F.lit("Name: "), "p_name", F.lit("\nsize: 1; 2\n- "), "p_brand")
    fenced = F.concat(F.lit("```json\n{\"sizes\":[\"1\",\"2\",\""), "p_brand", F.lit("\"],\"name\":\""), "p_name", F.lit("\"}\n```"))
    text = F.when(F.col("p_partkey") % 2 == 0, lines).otherwise(fenced)
    return v.table("part").select("p_partkey", E.parse_udf(frozenset(["sizes"]), frozenset(["name"]))(text).alias("parsed"))


@register("""WITH RECURSIVE c AS (SELECT doc_id, -1 AS n, '' AS chunk, text AS rest FROM documents
UNION ALL SELECT doc_id, n + 1, left(rest, k), substr(rest, k + 1) FROM (SELECT *, CASE WHEN length(rest) <= 500 THEN length(rest) WHEN regexp_matches(left(rest, 500), '[.!?]\\s') THEN length(regexp_extract(left(rest, 500), '(?s)^.*[.!?]\\s')) ELSE 500 END AS k FROM c WHERE rest <> ''))
SELECT doc_id, n, chunk FROM c WHERE n >= 0""")
def chunk_text(v: Views) -> DataFrame:
    """Texts in pieces of at most 500 characters, cut behind sentences where there are any."""
    return v.table("documents").select("doc_id", "text").lateralJoin(E.ChunkTable(F.col("text").outer(), F.lit(500))).drop("text")


@register("SELECT event_id, CASE event_type WHEN 'click' THEN 'Click' WHEN 'view' THEN 'VIEW' WHEN 'purchase' THEN 'purchase' END AS grounded FROM events")
def enum_ground(v: Views) -> DataFrame:
    return v.table("events").select("event_id", E.ground(F.upper("event_type"), ["Click", "VIEW", "purchase", "Purchase"]).alias("grounded"))


@register("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '{"name": "' || p_name || '", "tags": ["a", {"b": 1}]}' ELSE '{"brand": "' || p_brand || '", "list": []}' END AS payload FROM part""")
def extracted_object(v: Views) -> DataFrame:
    """The extracted object of a record, or the record without bookkeeping; no nulls and empty objects in lists."""
    one = F.concat(F.lit('{"extracted_object":{"name":"'), "p_name", F.lit('\0","tags":["a",null,{},{"b":1}]},"prompt":"x"}'))
    two = F.concat(F.lit('{"extracted_object":null,"prompt":"x","input_text":"y","brand":"'), "p_brand", F.lit('","list":[null]}'))
    return v.table("part").select("p_partkey", E.payload_udf()(F.when(F.col("p_partkey") % 2 == 0, one).otherwise(two)).alias("payload"))


_SLOTS = [E.Slot("name", description="the name"), E.Slot("tags", many=True), E.Slot("brand", values=("A", "B")), E.Slot("home", iri=True, prompt="a link"), E.Slot("inner", skipped=True)]


@register("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'Split the following piece of text into fields in the following format:' ELSE 'From the text below, extract the following entities in the following format:' END || chr(10) || chr(10)
|| 'name: <the name>' || chr(10) || 'tags: <semicolon-separated list of tagss>' || chr(10) || 'brand: <the value for brandMust be one of: A, B>' || chr(10) || 'home: <a link>' || chr(10) || chr(10) || chr(10) || 'Text:' || chr(10)
|| p_name || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE chr(10) || 'x' END || chr(10) || chr(10) || '===' || chr(10) || chr(10) AS prompt FROM part""")
def completion_prompt(v: Views) -> DataFrame:
    """What a language model is asked: a line for each field of the class, then the text."""
    text = F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, "").otherwise("\nx"))
    return v.table("part").select("p_partkey", E.prompt(_SLOTS, text).alias("prompt"))


@register(f"""SELECT 'part/' || p_partkey AS s, x.p, x.o, x.k AS o_kind FROM (SELECT p_partkey, unnest([{{'p': '{NS}type', 'o': '{NS}Part', 'k': 'iri'}}, {{'p': '{NS}name', 'o': p_name, 'k': 'literal'}}, {{'p': '{NS}tags', 'o': p_brand, 'k': 'literal'}},
{{'p': '{NS}tags', 'o': p_type, 'k': 'literal'}}, {{'p': '{NS}home', 'o': CASE WHEN p_size > 10 THEN 'http://x/' || p_size END, 'k': 'iri'}}]) AS x FROM part) WHERE x.o IS NOT NULL""")
def flatten_to_triples(v: Views) -> DataFrame:
    """Records as triples of their class and its fields."""
    rows = v.table("part").select("p_partkey", F.col("p_name").alias("name"), F.array("p_brand", "p_type").alias("tags"), F.lit("").alias("brand"), F.when(F.col("p_size") > 10, F.concat(F.lit("http://x/"), "p_size")).alias("home"))
    return E.to_triples(rows, F.concat(F.lit("part/"), "p_partkey"), [s for s in _SLOTS if not s.skipped], NS, "Part")


# ---- prefixes and labels --------------------------------------------------------------------------------------


def _named(v: Views, every: int, text: str) -> DataFrame:
    return v.table("nation").where(f"n_nationkey % {every} = 0").select(F.col("n_name").alias("prefix"), F.concat(F.lit(text), "n_nationkey").alias("namespace"))


@register("SELECT n_name AS prefix, CASE WHEN n_nationkey % 2 = 0 THEN 'http://base/' ELSE 'http://schema/' END || n_nationkey AS namespace FROM nation WHERE n_nationkey % 2 = 0 OR n_nationkey % 3 = 0")
def prefix_map(v: Views) -> DataFrame:
    """Base prefixes win on a collision."""
    return X.prefix_map(_named(v, 2, "http://base/"), _named(v, 3, "http://schema/"))


@register("SELECT n_name AS prefix FROM nation WHERE n_nationkey % 2 = 0 AND n_nationkey % 3 <> 0")
def prefixes_for_graph(v: Views) -> DataFrame:
    """The data graph has no prefixes that only curation needs."""
    return X.data_prefixes(_named(v, 2, "http://base/"), _named(v, 3, "")).select("prefix")


@register("SELECT page_id, n, CASE n WHEN 0 THEN 'ex' ELSE '' END AS prefix, CASE n WHEN 0 THEN replace(url, '>', '') ELSE 'http://kg.example/' END AS namespace FROM pages, (VALUES (0), (1)) t(n)")
def query_prefixes(v: Views) -> DataFrame:
    text = F.concat(F.lit("PREFIX ex: <"), F.replace("url", F.lit(">"), F.lit("")), F.lit(">\nprefix : <http://kg.example/>\nSELECT * { ?s ?p ?o }"))
    return v.table("pages").select("page_id", F.posexplode(X.declared_prefixes(text)).alias("n", "x")).select("page_id", "n", "x.*")


@register("SELECT stmt_id, printf('%.2f%%', confidence * 100) AS shown FROM versions", "versions")
def percentage(v: Views) -> DataFrame:
    return v.versions.select("stmt_id", columns.percentage(F.col("confidence")).alias("shown"))


@register("SELECT stmt_id, confidence FROM versions WHERE is_current AND confidence >= 35 / 100.0::DOUBLE", "versions")
def threshold_filter(v: Views) -> DataFrame:
    """Statements that a reader who asks for at least 35 per cent sees."""
    return v.versions.where(F.col("is_current") & columns.at_least(F.col("confidence"), F.lit(35))).select("stmt_id", "confidence")


@register("SELECT doc_id, strip_accents(text) AS ascii FROM documents")
def to_ascii(v: Views) -> DataFrame:
    return v.table("documents").select("doc_id", matching.to_ascii_udf("text").alias("ascii"))


# ---- graphs by name -------------------------------------------------------------------------------------------

_QUADS = "quads AS (SELECT DISTINCT CASE WHEN doc_id % 2 = 0 THEN 'data' ELSE 'curation' END AS g, s, p, stmt_id AS o FROM versions)"
_PREFIX = f"PREFIX p: <{NS}p/>\n"


def _quads(v: Views) -> DataFrame:
    graph = F.when(F.col("doc_id") % 2 == 0, "data").otherwise("curation")
    return v.versions.select(graph.alias("g"), "s", "p", F.col("stmt_id").alias("o")).distinct()


@register(f", {_QUADS} SELECT s, o FROM quads WHERE g = 'curation'", "versions")
def pinned_graph(v: Views) -> DataFrame:
    """A query that is pinned to one graph sees its triples, and none of another one that it names."""
    return sparql.run("SELECT ?s ?o { { ?s ?p ?o } UNION { GRAPH <data> { ?s ?p ?o } } }", _quads(v), graph="curation")


@register(f", {_QUADS} SELECT a.g, a.s, a.o AS x, b.o AS y FROM quads a JOIN quads b ON a.g = b.g AND a.s = b.s WHERE a.p = '{NS}p/user' AND b.p = '{NS}p/assistant'", "versions")
def named_graphs(v: Views) -> DataFrame:
    """Triples that stand in the same graph, whichever it is."""
    return sparql.run(_PREFIX + "SELECT ?g ?s ?x ?y { GRAPH ?g { ?s p:user ?x ; p:assistant ?y } }", _quads(v))


@register(f", {_QUADS} SELECT g, s, p, o FROM quads WHERE g <> 'data'", "versions")
def drop_graph(v: Views) -> DataFrame:
    return A.drop_graph(_quads(v), "data")


@register(f"SELECT s AS c FROM triples WHERE p = '{NS}p/type' AND o = '{NS}c/Customer' AND s NOT IN (SELECT a.o FROM triples a JOIN triples b ON a.s = b.s AND a.p = '{NS}p/placedBy' AND b.p = '{NS}p/priority' AND b.o = '1-URGENT')", "triples")
def minus_pattern(v: Views) -> DataFrame:
    """Customers without an urgent order."""
    urgent = A.bgp(v.triples, [("?order", f"{NS}p/placedBy", "?c"), ("?order", f"{NS}p/priority", "1-URGENT")])
    return A.minus(A.pattern(v.triples, "?c", f"{NS}p/type", f"{NS}c/Customer"), urgent)


@register("SELECT s, p, o FROM triples ORDER BY s, p, o LIMIT 100 OFFSET 100", "triples")
def page_statements(v: Views) -> DataFrame:
    """The second page of a hundred."""
    return v.triples.select("s", "p", "o").orderBy("s", "p", "o").offset(100).limit(100)


@register(f"SELECT DISTINCT b.o AS s, '{NS}p/hasCustomer' AS p, a.s AS o FROM triples a JOIN triples b ON a.s = b.s WHERE a.p = '{NS}p/segment' AND a.o = 'BUILDING' AND b.p = '{NS}p/inNation'", "triples")
def user_construct(v: Views) -> DataFrame:
    """A CONSTRUCT query."""
    return sparql.run(_PREFIX + "CONSTRUCT { ?n p:hasCustomer ?c } WHERE { ?c p:segment 'BUILDING' ; p:inNation ?n }", v.triples)


@register(f""", {_QUADS}, one AS (SELECT * FROM quads UNION SELECT 'new', 'a', 'b', 'c'),
two AS (SELECT * FROM one WHERE NOT (g = 'data' AND p = '{NS}p/user') UNION SELECT 'data', s, '{NS}p/asked', o FROM one WHERE g = 'data' AND p = '{NS}p/user' UNION SELECT 'index', o, '{NS}p/of', s FROM one WHERE g = 'data' AND p = '{NS}p/user'),
three AS (SELECT * FROM two WHERE g <> 'curation') SELECT * FROM three WHERE NOT (g = 'data' AND p = '{NS}p/assistant')""", "versions")
def user_update(v: Views) -> DataFrame:
    """Four updates in one request: data put in, triples renamed and indexed, a graph dropped, triples deleted."""
    request = _PREFIX + """INSERT DATA { GRAPH <new> { <a> <b> <c> } } ;
      WITH <data> DELETE { ?s p:user ?o } INSERT { ?s p:asked ?o . GRAPH <index> { ?o p:of ?s } } WHERE { ?s p:user ?o } ;
      DROP SILENT GRAPH <curation> ;
      DELETE WHERE { ?s p:assistant ?o }"""
    return sparql.update(request, _quads(v), store, graph="data")


_TURTLE_IRI = f"""CASE WHEN starts_with({{0}}, '{NS}p/') AND regexp_matches(substr({{0}}, {len(NS) + 3}), '^[A-Za-z_][\\w\\-]*$') THEN 'p:' || substr({{0}}, {len(NS) + 3}) WHEN starts_with({{0}}, '{NS}c/') AND regexp_matches(substr({{0}}, {len(NS) + 3}), '^[A-Za-z_][\\w\\-]*$') THEN 'c:' || substr({{0}}, {len(NS) + 3}) ELSE '<' || {{0}} || '>' END"""


@register(f"""SELECT s, {_TURTLE_IRI.format("s")} || ' ' || string_agg(k, ' ;' || chr(10) || '    ' ORDER BY a, b) || ' .' AS block FROM (SELECT DISTINCT s, {_TURTLE_IRI.format("p")} AS a, CASE WHEN o_kind = 'iri' THEN {_TURTLE_IRI.format("o")} ELSE '"' || o || '"' END AS b, a || ' ' || b AS k FROM triples) GROUP BY s""", "triples")
def export_turtle(v: Views) -> DataFrame:
    return X.turtle(v.triples, {"kg": NS, "p": f"{NS}p/", "c": f"{NS}c/"})

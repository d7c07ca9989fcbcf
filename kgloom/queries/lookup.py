"""Queries of entity lookup, and of scores and settings that alignment and lookup share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import matching
from ..functions.columns import cosine
from ..operators import alignment as A
from ..operators import lookup as L
from ..session import store, work_folder
from ..sources import clients
from ..views import Views, with_views
from .alignment import _LCS

QUERIES: dict = {}


def register(sql: str | None, *views: str):
    def add(function):
        QUERIES[function.__name__] = (function, with_views(sql, *views) if sql and views else sql)
        return function

    return add


#: SQL of the entities with the number of their part, and whose ``known`` says which ids they carry.
_E = "e AS (SELECT *, p_partkey AS k, p_type AS type, p_name AS name, p_brand AS brand, p_size AS size, 'part/' || p_partkey AS uri FROM part)"
_KNOWN = "CASE k % 4 WHEN 0 THEN ['ext/' || k] WHEN 1 THEN ['gone'] ELSE [] END"


def _parts(v: Views) -> DataFrame:
    """(k, uri, type, name, literals) of parts: two of them in four carry an id, one of these an unknown one."""
    k, size = F.col("p_partkey"), F.col("p_size")
    known = F.when(k % 4 == 0, F.array(F.concat(F.lit("ext/"), k))).when(k % 4 == 1, F.array(F.lit("gone")))
    cells = [("name", F.array(F.concat(F.lit(" "), "p_name"), F.lit("  "))), ("brand", F.array("p_brand", F.concat("p_type", F.lit("\t")))), ("size", F.when(size > 10, F.array(size.cast("string")))), ("known", known)]
    entries = F.filter(F.array(*[F.struct(F.lit(n).alias("key"), x.alias("value")) for n, x in cells]), lambda c: c["value"].isNotNull())
    return v.table("part").select(k.alias("k"), F.concat(F.lit("part/"), k).alias("uri"), F.col("p_type").alias("type"), F.col("p_name").alias("name"), F.map_from_entries(entries).alias("literals"))


@register(f"""WITH {_E} SELECT uri, 'brand=' || b || CASE WHEN size > 10 THEN '&size=' || size ELSE '' END AS terms FROM (SELECT uri, size, unnest([brand, type]) AS b FROM e)
UNION ALL SELECT uri, 'name=' || name || '&size=' || size FROM e WHERE size > 10 UNION ALL SELECT uri, 'name=' || name || '&brand=' || brand FROM e""")
def resolve_queries(v: Views) -> DataFrame:
    """What three rules ask for: each value of one predicate, two that must both be there, and the first of two."""
    rules = [L.Rule(("brand",), optional=("size",)), L.Rule(("name", "size"), require_all=True), L.Rule(("name", "brand"))]
    sets = F.concat(*[L.value_sets(F.col("literals"), r) for r in rules])
    terms = F.array_join(F.transform("x", lambda t: F.concat_ws("=", t["predicate"], t["value"])), "&")
    return _parts(v).select("uri", F.explode(sets).alias("x")).select("uri", terms.alias("terms"))


@register(f"WITH {_E} SELECT uri, size > 10 OR k % 4 < 2 AS sufficient FROM e")
def sufficient_data(v: Views) -> DataFrame:
    return _parts(v).select("uri", L.sufficient(F.col("literals"), ("size",), "known").alias("sufficient"))


def _nothing(queries: DataFrame) -> DataFrame:
    return queries.where("false").select("query", F.lit(0).alias("rank"), F.lit("").alias("candidate"))


@register(f"""WITH {_E} SELECT uri, 0 AS "at", 'name:"' || name || '" AND maker:"' || brand || '"' AS query FROM e WHERE type = 'PROMO'
UNION ALL SELECT uri, n, 'maker:"' || b || '"' FROM (SELECT uri, unnest([0, 1]) AS n, unnest([brand, type]) AS b FROM e WHERE type = 'SMALL' AND size > 10)""")
def build_query(v: Views) -> DataFrame:
    """Each distinct query of an entity once, fields under the source's names."""
    types = {"PROMO": L.TypeRules((L.Rule(("name", "brand")), L.Rule(("name", "brand")))), "SMALL": L.TypeRules((L.Rule(("brand",)),), require_any_of=("size",))}
    source = L.Source("things", types, _nothing, v.table("part").select(F.lit("").alias("candidate")), field_names={"brand": "maker"})
    return L.queries(_parts(v), source)


@register(f"WITH {_E} SELECT uri, name || ' ' || brand AS query FROM e")
def build_plain_query(v: Views) -> DataFrame:
    """The values of a rule put together, for sources without fields."""
    source = L.Source("things", {}, _nothing, v.table("part"), join_with=" ", others=L.TypeRules((L.Rule(("name", "brand")),)))
    return L.queries(_parts(v), source).select("uri", "query")


# ---- candidates -----------------------------------------------------------------------------------------------


def _records(v: Views) -> DataFrame:
    """The candidates that exist: not those whose number is a multiple of 8."""
    return v.table("part").where("p_partkey % 8 <> 0").select(F.concat(F.lit("ext/"), "p_partkey").alias("candidate"), F.col("p_name").alias("found_name"))


def _by_name(v: Views):
    """A source that finds records by name, the smallest numbers first."""

    def search(queries: DataFrame) -> DataFrame:
        # A source answers with its first hits; a dozen is more than anyone asks for.
        place = F.row_number().over(Window.partitionBy("p_name").orderBy("p_partkey")) - 1
        hits = v.table("part").where("p_partkey % 8 <> 0").select("p_name", F.col("p_partkey").alias("k"), place.alias("rank")).where("rank < 12")
        found = queries.join(hits, F.col("query") == F.concat(F.lit('name:"'), "p_name", F.lit('"')))
        return found.select("query", "rank", F.concat(F.lit("ext/"), "k").alias("candidate"))

    return search


def _people(v: Views, *types: str) -> L.Source:
    """People of some types, or of all."""
    rules = L.TypeRules((L.Rule(("name",)),), unresolved_penalty=0.4, fuzzy_penalty=0.1)
    return L.Source("people", dict.fromkeys(types, rules), _by_name(v), _records(v), identifier="known", limit=3, others=None if types else rules)


_HITS = """ranked AS (SELECT name, k, row_number() OVER (PARTITION BY name ORDER BY k) AS n FROM e WHERE k % 8 <> 0),
found AS (SELECT uri, type, k, 'ext/' || k AS candidate, FALSE AS fuzzy_match, FALSE AS unresolved FROM e WHERE k % 8 = 4
  UNION ALL SELECT e.uri, e.type, e.k, 'ext/' || r.k, TRUE, e.k % 4 < 2 FROM e JOIN ranked r ON e.name = r.name AND r.n <= 3 WHERE e.k % 8 <> 4)"""


@register(f"WITH {_E}, {_HITS} SELECT uri, candidate, fuzzy_match, unresolved FROM found")
def generate_candidates(v: Views) -> DataFrame:
    """Carried ids that exist; else the first three hits by name, unresolved where an id was carried."""
    return L.candidates(_parts(v), _people(v))


def _details(v: Views) -> DataFrame:
    made = F.concat(
        F.lit('{"aliases":{"en":[{"value":"'), "p_brand", F.lit('"},{"value":" "}],"de":[{"value":"x"}]},"claims":{"P1":[{"mainsnak":{"datavalue":{"value":"'), "p_type",
        F.lit('"}}},{"mainsnak":{}}],"P31":[{"mainsnak":{"datavalue":{"value":{"id":"Q'), "p_size", F.lit('","entity-type":"item"}}}}]}}'),
    )
    return v.table("part").select(F.concat(F.lit("part/"), "p_partkey").alias("uri"), "p_name", F.from_json(made, L.DETAILS).alias("details"))


@register(f"WITH {_E} SELECT uri, size IN (7, 8, 9) AS fits FROM e")
def class_filter(v: Views) -> DataFrame:
    return _details(v).select("uri", L.passes_class(L.claims(F.col("details"), "P31", items=True), ("Q7", "Q8", "Q9")).alias("fits"))


@register(f"""WITH {_E} SELECT uri, 'name' AS predicate, name || '|' || brand AS found FROM e UNION ALL SELECT uri, 'kind', type FROM e
UNION ALL SELECT uri, 'class', 'label ' || size FROM e WHERE size <= 10""")
def candidate_literals(v: Views) -> DataFrame:
    """A candidate's literals from its label, aliases, string claims and the labels of its classes."""
    config = {"name": [("label", None), ("aliases", None)], "kind": [("string_claims", "P1")], "class": [("item_claim_labels", "P31")], "none": [("string_claims", "P9")]}
    labels = F.create_map(*[F.lit(x) for i in range(1, 11) for x in (f"Q{i}", f"label {i}")])
    literals = L.candidate_literals(F.col("p_name"), F.col("details"), config, labels)
    return _details(v).select("uri", F.explode(literals).alias("predicate", "x")).select("uri", "predicate", F.array_join("x", "|").alias("found"))


# ---- scores ---------------------------------------------------------------------------------------------------


@register(f"""WITH {_E}, {_HITS} SELECT f.uri, f.candidate, round((CASE WHEN unresolved THEN 0.6 ELSE 1.0 END)::DOUBLE * (CASE WHEN fuzzy_match THEN 0.9 ELSE 1.0 END)::DOUBLE * least(1.0, 0.5 + k % 7 / 10), 9) AS score
FROM found f WHERE (CASE WHEN unresolved THEN 0.6 ELSE 1.0 END)::DOUBLE * least(1.0, 0.5 + k % 7 / 10) >= 0.55""")
def score_lookup(v: Views) -> DataFrame:
    """The penalty for unresolved candidates counts before the threshold, the one for fuzzy ones after it."""
    pairs = L.candidates(_parts(v), _people(v)).join(_parts(v).select("uri", "k"), "uri")
    scored = pairs.withColumn("score", F.least(F.lit(1.0), 0.5 + F.col("k") % 7 / 10))
    return L.judged(scored, F.lit(0.55), F.lit(0.4), F.lit(0.1)).select("uri", "candidate", F.round("score", 9).alias("score"))


@register(f"""WITH {_E} SELECT uri, CASE WHEN k % 3 <> 0 THEN array_to_string({_KNOWN}, ',') ELSE CASE WHEN k % 4 = 1 THEN 'gone,' ELSE '' END || 'ext/' || k || ',ext/x' END AS known FROM e""")
def feed_back(v: Views) -> DataFrame:
    """Ids that one source found go into the literals that the next one is asked with, each once."""
    parts = _parts(v)
    own, other = parts.where("k % 3 = 0").select("uri", F.concat(F.lit("ext/"), "k").alias("value")), parts.where("k % 3 = 0").select("uri", F.lit("ext/x").alias("value"))
    fed = L.feed_back(parts, own.unionByName(other).unionByName(own), "known")
    return fed.select("uri", F.array_join(F.coalesce(F.try_element_at("literals", F.lit("known")), F.array().cast("array<string>")), ",").alias("known"))


_RUN = f"""WITH {_E}, {_HITS}, one AS (SELECT uri, candidate, CASE WHEN fuzzy_match THEN 0.9 ELSE 1.0 END::DOUBLE AS score FROM found WHERE type = 'PROMO' AND NOT unresolved),
ids AS (SELECT uri, 0 AS place, unnest({_KNOWN}) AS id FROM e WHERE type IN ('PROMO', 'SMALL') UNION ALL SELECT uri, 1, candidate FROM one),
asked AS (SELECT uri, id, min(place) AS place FROM ids WHERE starts_with(id, 'ext/') GROUP BY ALL),
two AS (SELECT *, row_number() OVER (PARTITION BY uri ORDER BY place, id) AS n FROM asked)
SELECT 'people' AS source, uri, candidate, score FROM one
UNION ALL SELECT 'things', uri, replace(id, 'ext', 'item'), 0.8::DOUBLE FROM two WHERE n <= 2"""


def _run(v: Views) -> DataFrame:
    def things(queries: DataFrame) -> DataFrame:
        number = F.regexp_extract("query", r'^known:"ext/(\d+)"$', 1)
        return queries.where(number != "").select("query", F.lit(0).alias("rank"), F.concat(F.lit("item/"), number).alias("candidate"))

    items = v.table("part").select(F.concat(F.lit("item/"), "p_partkey").alias("candidate"), F.col("p_name").alias("found_name"))
    rules = {t: L.TypeRules((L.Rule(("known",)),), fuzzy_penalty=0.2) for t in ("PROMO", "SMALL")}
    sources = [_people(v, "PROMO"), L.Source("things", rules, things, items, limit=2)]
    same = F.when(F.array_contains(L.values_of(F.col("literals"), "name"), F.col("found_name")), 1.0).otherwise(0.5)
    return L.run(_parts(v), sources, lambda pairs: pairs.withColumn("score", same), store)


@register(_RUN)
def run_lookup(v: Views) -> DataFrame:
    """Two sources one after the other; the second is asked with what the first one found."""
    return _run(v)


@register(f"SELECT source, count(*) AS results FROM ({_RUN}) GROUP BY source")
def lookup_totals(v: Views) -> DataFrame:
    return L.totals(_run(v))


# ---- clients --------------------------------------------------------------------------------------------------

_VECTOR = "[length(p_name)::DOUBLE, (length(p_name) - length(replace(p_name, 'e', '')))::DOUBLE, 1.0::DOUBLE]"


def _vectors(v: Views) -> DataFrame:
    """A client's vectors of all names: their length and number of e's (a service's would be longer)."""

    def call(texts: list[str]) -> list[list[float]]:
        return [[float(len(t)), float(t.count("e")), 1.0] for t in texts]

    return clients.ask(v.table("part").select(F.col("p_name").alias("text")), "text", call, "array<double>")


@register(f"SELECT DISTINCT p_name AS text, {_VECTOR} AS answer FROM part".replace("AS answer", "AS vector"))
def embedding_lookup(v: Views) -> DataFrame:
    """Each distinct text goes to the embedding client once, in batches."""
    return _vectors(v).withColumnRenamed("answer", "vector")


@register(f"""SELECT a.p_partkey AS a, b.p_partkey AS b, round(list_cosine_similarity(a.x, b.x), 6) AS score FROM (SELECT p_partkey, {_VECTOR} AS x FROM part) a
JOIN (SELECT p_partkey, {_VECTOR} AS x FROM part) b ON a.p_partkey + 1 = b.p_partkey""")
def embedding_similarity(v: Views) -> DataFrame:
    """The semantic score of neighbours: texts joined with their vectors, then the cosine."""
    rows = clients.embedded(v.table("part").select("p_partkey", F.col("p_name").alias("text")), "text", _vectors(v))
    a, b = rows.select(F.col("p_partkey").alias("a"), F.col("embedding").alias("x")), rows.select((F.col("p_partkey") - 1).alias("a"), F.col("p_partkey").alias("b"), F.col("embedding").alias("y"))
    return a.join(b, "a").select("a", "b", F.round(cosine(F.col("x"), F.col("y")), 6).alias("score"))


@register("SELECT c_custkey, lpad(c_custkey::VARCHAR, 4, '0') AS candidate, 'A ' || c_name AS name FROM customer")
def person_hits(v: Views) -> DataFrame:
    """People from the JSON that a search answers with."""
    answer = F.to_json(F.struct(F.array(F.struct(F.lpad(F.col("c_custkey").cast("string"), 4, "0").alias("orcid-id"), F.lit("A").alias("given-names"), F.col("c_name").alias("family-names"))).alias("expanded-result"), F.lit(1).alias("num-found")))
    return v.table("customer").select("c_custkey", F.explode(clients.person_hits(answer)).alias("x")).select("c_custkey", "x.candidate", "x.name")


@register("SELECT p_partkey, n AS rank, 'Q' || (p_partkey + n) AS candidate, CASE n WHEN 0 THEN p_name ELSE p_brand END AS name FROM part, (VALUES (0), (1)) t(n)")
def entity_hits(v: Views) -> DataFrame:
    hit = lambda n, name: F.struct(F.concat(F.lit("Q"), F.col("p_partkey") + n).alias("id"), F.col(name).alias("label"))
    answer = F.to_json(F.struct(F.array(hit(0, "p_name"), hit(1, "p_brand")).alias("search")))
    return v.table("part").select("p_partkey", F.explode(clients.entity_hits(answer)).alias("x")).select("p_partkey", "x.*")


def _shout(prompts: list[str]) -> list[str]:
    return [p.upper() for p in prompts]


def _folder(v: Views) -> str:
    return f"{work_folder(v.spark)}/answers-{uuid.uuid4().hex}"


@register("SELECT p_partkey, upper(p_name) AS completion FROM part")
def complete_prompts(v: Views) -> DataFrame:
    """A language model's client (here one that shouts) over all prompts."""
    prompts = v.table("part").select("p_partkey", F.col("p_name").alias("prompt"))
    return clients.completed(prompts, "prompt", _shout, _folder(v)).select("p_partkey", "completion")


@register("SELECT DISTINCT p_name AS prompt, upper(p_name) AS answer FROM part WHERE trim(p_name) <> ''")
def stored_answers(v: Views) -> DataFrame:
    """Some prompts are asked first, then all: only those without a stored answer go to the client."""
    prompts, folder = v.table("part").select("p_partkey", F.col("p_name").alias("prompt")), _folder(v)
    clients.ask_stored(prompts.where("p_partkey % 3 = 0"), "prompt", _shout, "string", folder)
    return clients.ask_stored(prompts, "prompt", _shout, "string", folder)


# ---- scores of names, and settings ----------------------------------------------------------------------------


@register("""SELECT p_partkey, form, CASE form WHEN 'initial' THEN 1.0 WHEN 'other' THEN 0.05 WHEN 'swap' THEN 1.0 END::DOUBLE AS score FROM part, (VALUES ('initial'), ('other'), ('swap')) t(form)""")
def initial_score(v: Views) -> DataFrame:
    """Names against themselves turned, with an initial, and an initial against another one."""
    word = lambda i: F.get(F.split("p_name", " "), F.lit(i))
    short = F.concat(F.left(word(0), F.lit(1)), F.lit(". "), word(1))
    other = F.concat(F.translate(F.left(word(0), F.lit(1)), "abcdefghijklmnopqrstuvwxyz", "bcdefghijklmnopqrstuvwxyza"), F.lit(". "), word(1))
    cells = F.array(F.struct(F.lit("initial").alias("form"), F.col("p_name").alias("a"), short.alias("b")), F.struct(F.lit("other").alias("form"), short.alias("a"), other.alias("b")), F.struct(F.lit("swap").alias("form"), F.col("p_name").alias("a"), F.concat_ws(" ", word(1), word(0)).alias("b")))
    rows = v.table("part").select("p_partkey", F.explode(cells).alias("x")).select("p_partkey", "x.*")
    return A.score_strings(rows, "a", "b", "score", initials=True).select("p_partkey", "form", "score")


@register(f"""WITH names AS (SELECT DISTINCT lower(p_brand) AS p, lower(p_name) AS q FROM part), pairs AS (SELECT p, q, CASE WHEN length(p) <= length(q) THEN p ELSE q END AS a, CASE WHEN length(p) <= length(q) THEN q ELSE p END AS b FROM names),
cuts AS (SELECT p, q, a AS x, unnest(list_concat(list_transform(range(1, length(b) - length(a) + 2), lambda i: substr(b, i, length(a))),
  list_transform(range(1, length(a)), lambda i: left(b, i)), list_transform(range(1, length(a)), lambda i: right(b, i)))) AS y FROM pairs),
each AS (SELECT x, y, 2.0::DOUBLE * {_LCS} / (length(x) + length(y)) AS r FROM (SELECT DISTINCT x, y FROM cuts))
SELECT p, q, round(max(r), 9) AS score FROM cuts JOIN each USING (x, y) GROUP BY p, q""")
def partial_ratio(v: Views) -> DataFrame:
    names = v.table("part").select(F.lower("p_brand").alias("p"), F.lower("p_name").alias("q")).distinct()
    return names.select("p", "q", F.round(matching.partial_ratio_udf("p", "q"), 9).alias("score"))


@register("SELECT uri, name || ' ' || brand AS text FROM entities", "entities")
def semantic_text(v: Views) -> DataFrame:
    """The text that stands for an entity: its fields that are there, joined by blanks."""
    return v.entities.select("uri", A.semantic_text({"name": F.array("name"), "none": F.array().cast("array<string>"), "brand": F.array("brand")}).alias("text"))


_CONFIG = {"settings": {"default_threshold": 0.7, "default_sparsity_penalty": 0.5}, "entity_types": {"PROMO": {"threshold": 0.95, "weights": {"syntactic": 1.0}, "hard_match_predicates": {"name": 0.5}}, "SMALL": {"expand_initials": True}}}


@register("""SELECT DISTINCT p_type AS type, CASE p_type WHEN 'PROMO' THEN 0.95 ELSE 0.7 END::DOUBLE AS threshold, CASE p_type WHEN 'PROMO' THEN 1.0 ELSE 0.5 END::DOUBLE AS syntactic,
CASE p_type WHEN 'PROMO' THEN 0.0 ELSE 0.35 END::DOUBLE AS semantic, 0.5::DOUBLE AS sparsity, p_type = 'SMALL' AS initials FROM part""")
def type_settings(v: Views) -> DataFrame:
    """The settings of each type: its own, then those of all types, then the built-in ones."""
    found = A.settings_columns(_CONFIG, F.col("type"))
    kinds = v.table("part").select(F.col("p_type").alias("type")).distinct()
    return kinds.select("type", *[found[c].alias(c) for c in ("threshold", "syntactic", "semantic", "sparsity", "initials")])


@register("""SELECT p_partkey, p_size % 4 = 0 OR abs(CASE WHEN p_size % 3 > 0 THEN p_size / 50.0::DOUBLE ELSE 0 END + 0.5 - 1) <= 1e-6 AS valid FROM part""")
def validate_weights(v: Views) -> DataFrame:
    """Which rows of weights are allowed: those that sum to 1, and those without any."""
    size = F.col("p_size")
    given = size % 4 != 0
    return v.table("part").select("p_partkey", A.valid_weights(F.when(given & (size % 3 > 0), size / 50.0), F.when(given, F.lit(0.5))).alias("valid"))

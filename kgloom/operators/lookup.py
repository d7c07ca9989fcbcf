"""Lookup of entities in external sources: queries from literals, candidates, class filter, scores, dispatch.

Entities are (uri, type, literals), where literals are a map from predicate names to arrays of values.  Sources answer
through tables or through functions from a table of queries to a table of hits, so that each distinct query is asked
once, by whatever client a caller plugs in (``sources.clients``).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LITERALS = "map<string,array<string>>"
_TERMS = "array<array<struct<predicate:string,value:string>>>"
DETAILS = "aliases map<string,array<struct<value:string>>>, claims map<string,array<struct<mainsnak:struct<datavalue:struct<value:string>>>>>"


@dataclass(frozen=True)
class Rule:
    """Which literals make queries: each value of a single predicate one, or the first values of several together."""

    predicates: tuple[str, ...]
    optional: tuple[str, ...] = ()
    require_all: bool = False


@dataclass(frozen=True)
class TypeRules:
    """How entities of a type are looked up and judged."""

    rules: tuple[Rule, ...]
    require_any_of: tuple[str, ...] = ()
    instance_of: tuple[str, ...] = ()
    threshold: float = 0.8
    unresolved_penalty: float = 0.0
    fuzzy_penalty: float = 0.0


@dataclass(frozen=True)
class Source:
    """An external source: ``search`` maps (query) to hits (query, rank, candidate), ``records`` has the candidates
    that are known to exist.  ``identifier`` names the literal that may already hold a candidate.  ``others`` are the
    rules of all types that ``types`` doesn't name; without them such entities aren't looked up."""

    name: str
    types: Mapping[str, TypeRules]
    search: Callable[[DataFrame], DataFrame]
    records: DataFrame
    identifier: str | None = None
    field_names: Mapping[str, str] = field(default_factory=dict)
    join_with: str | None = None
    limit: int = 5
    others: TypeRules | None = None


# ---- queries --------------------------------------------------------------------------------------------------


def values_of(literals: Column, predicate: str) -> Column:
    """The values of a predicate, trimmed, without blank ones."""
    found = F.coalesce(F.try_element_at(literals, F.lit(predicate)), F.array().cast("array<string>"))
    return F.filter(F.transform(found, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def value_sets(literals: Column, rule: Rule) -> Column:
    """The sets of (predicate, value) that a rule asks for, one for each query."""
    first = lambda names: F.filter(F.array(*[F.struct(F.lit(p).alias("predicate"), F.get(values_of(literals, p), F.lit(0)).alias("value")) for p in names]), lambda t: t["value"].isNotNull())
    none = F.array().cast(_TERMS)
    also = first(rule.optional) if rule.optional else F.array().cast("array<struct<predicate:string,value:string>>")
    if len(rule.predicates) == 1:
        name = rule.predicates[0]
        sets = F.transform(values_of(literals, name), lambda v: F.concat(F.array(F.struct(F.lit(name).alias("predicate"), v.alias("value"))), also))
    else:
        together = first(rule.predicates)
        enough = F.size(together) == len(rule.predicates) if rule.require_all else F.size(together) > 0
        sets = F.when(enough, F.array(F.concat(together, also))).otherwise(none)
    return sets.cast(_TERMS)


def render(terms: Column, field_names: Mapping[str, str], join_with: str | None = None) -> Column:
    """A query's text: fields with quoted values that must all hold, or bare values put together."""
    if join_with is not None:
        return F.array_join(F.transform(terms, lambda t: t["value"]), join_with)
    named = F.map_from_entries(F.array(*[F.struct(F.lit(k), F.lit(v)) for k, v in field_names.items()])) if field_names else None
    name = lambda t: F.coalesce(F.try_element_at(named, t["predicate"]), t["predicate"]) if named is not None else t["predicate"]
    return F.array_join(F.transform(terms, lambda t: F.concat(name(t), F.lit(':"'), t["value"], F.lit('"'))), " AND ")


def sufficient(literals: Column, require_any_of: tuple[str, ...], identifier: str | None = None) -> Column:
    """Whether one of the required literals is there; always if none is required or the entity's id is known."""
    if not require_any_of:
        return F.lit(True)
    names = [*require_any_of, *([identifier] if identifier else [])]
    return F.exists(F.array(*[F.size(F.coalesce(F.try_element_at(literals, F.lit(n)), F.array().cast("array<string>"))) for n in names]), lambda n: n > 0)


def queries(entities: DataFrame, source: Source) -> DataFrame:
    """(uri, at, query) of all entities with enough data, in the order of the rules; equal ones of an entity once."""
    none = F.array().cast("array<string>")

    def asked(rules: TypeRules) -> Column:
        sets = F.concat(*[value_sets(F.col("literals"), r) for r in rules.rules])
        texts = F.transform(sets, lambda terms: render(terms, source.field_names, source.join_with))
        return F.when(sufficient(F.col("literals"), rules.require_any_of, source.identifier), texts).otherwise(none)

    texts = asked(source.others) if source.others else none
    for kind, rules in source.types.items():
        texts = F.when(F.col("type") == kind, asked(rules)).otherwise(texts)
    rows = entities.select("uri", F.posexplode(texts).alias("at", "query")).where("query <> ''")
    return rows.groupBy("uri", "query").agg(F.min("at").alias("at")).select("uri", "at", "query")


# ---- derived literals -----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Derivation:
    """A literal ``name`` that entities of a type get: from their own ``literal``, as its part after the last slash, or
    with ``relation`` from that literal of the entities that the relation leads to, or with ``incoming`` comes from."""

    type: str
    name: str
    literal: str
    relation: str | None = None
    incoming: bool = False


def derive(entities: DataFrame, relations: DataFrame, rules: list[Derivation]) -> DataFrame:
    """``entities`` with the literals that ``rules`` derive, from the literals as they were given.

    ``relations`` are (s, p, o) between entities.  A literal's values are distinct, in the order of the entity that they
    come from; one that a rule finds nothing for stays as it is, and of several rules for a name the last that finds
    something counts.  Related entities that aren't there, and null values, give nothing.
    """
    table = [(i, r.type, r.name, r.literal, r.relation, r.incoming) for i, r in enumerate(rules)]
    known = F.broadcast(entities.sparkSession.createDataFrame(table, "rule int, type string, name string, literal string, relation string, incoming boolean"))
    values = entities.select("uri", F.explode("literals").alias("literal", "xs")).select("uri", "literal", F.posexplode("xs").alias("place", "value")).where("value is not null")
    typed = entities.select("uri", "type")
    own = typed.join(known.where("relation is null"), "type").join(values, ["uri", "literal"])
    own = own.select("uri", "rule", "name", F.lit("").alias("via"), "place", F.element_at(F.split("value", "/"), -1).alias("value"))
    ends = F.array(F.struct(F.col("s").alias("uri"), F.col("o").alias("via"), F.lit(False).alias("incoming")), F.struct(F.col("o").alias("uri"), F.col("s").alias("via"), F.lit(True).alias("incoming")))
    links = relations.select(F.col("p").alias("relation"), F.explode(ends).alias("e")).select("relation", "e.*").join(known.where("relation is not null"), ["relation", "incoming"])
    found = links.join(typed, ["uri", "type"]).join(values.withColumnRenamed("uri", "via"), ["via", "literal"]).select("uri", "rule", "name", "via", "place", "value")
    first = own.unionByName(found).groupBy("uri", "rule", "name", "value").agg(F.min(F.struct("via", "place")).alias("at"))
    lists = first.groupBy("uri", "rule", "name").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]).alias("value"))
    last = lists.groupBy("uri", "name").agg(F.max(F.struct("rule", "value")).getField("value").alias("value"))
    more = last.groupBy("uri").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("__more"))
    joined = F.map_concat(F.map_filter("literals", lambda k, _: ~F.array_contains(F.map_keys("__more"), k)), "__more")
    return entities.join(more, "uri", "left").withColumn("literals", F.when(F.col("__more").isNull(), F.col("literals")).otherwise(joined)).drop("__more")


# ---- candidates -----------------------------------------------------------------------------------------------


def candidates(entities: DataFrame, source: Source) -> DataFrame:
    """(uri, candidate, fuzzy_match, unresolved) of each entity.

    Ids that an entity carries are looked up; where at least one exists, those are its candidates.  Other entities get
    the hits of their queries, unique and at most ``limit``, as fuzzy matches; ``unresolved`` if they carried ids.
    """
    known = F.coalesce(F.try_element_at("literals", F.lit(source.identifier)), F.array().cast("array<string>")) if source.identifier else F.array().cast("array<string>")
    carried = entities.select("uri", F.explode(F.slice(known, 1, source.limit)).alias("candidate")).distinct()
    verified = carried.join(source.records.select("candidate").distinct(), "candidate", "left_semi")
    rest = entities.join(verified.select("uri").distinct(), "uri", "left_anti")
    asked = queries(rest, source)
    hits = source.search(asked.select("query").distinct())
    found = asked.join(hits, "query").groupBy("uri", "candidate").agg(F.min(F.struct("at", "rank")).alias("place"))
    top = found.withColumn("n", F.row_number().over(Window.partitionBy("uri").orderBy("place", "candidate"))).where(F.col("n") <= source.limit)
    had = carried.select("uri").distinct().withColumn("unresolved", F.lit(True))
    searched = top.join(had, "uri", "left").select("uri", "candidate", F.lit(True).alias("fuzzy_match"), F.coalesce("unresolved", F.lit(False)).alias("unresolved"))
    return verified.select("uri", "candidate", F.lit(False).alias("fuzzy_match"), F.lit(False).alias("unresolved")).unionByName(searched)


def passes_class(classes: Column, instance_of: tuple[str, ...]) -> Column:
    """Whether one of the classes is wanted; always if none is named."""
    return F.arrays_overlap(classes, F.array(*map(F.lit, instance_of))) if instance_of else F.lit(True)


def claims(details: Column, name: str, items: bool = False) -> Column:
    """The values of a claim of an entity's details (``DETAILS``): strings, or with ``items`` the ids of entities."""
    values = F.transform(F.coalesce(F.try_element_at(details["claims"], F.lit(name)), F.array().cast("array<struct<mainsnak:struct<datavalue:struct<value:string>>>>")), lambda c: c["mainsnak"]["datavalue"]["value"])
    values = F.transform(values, lambda v: F.get_json_object(v, "$.id")) if items else F.filter(values, lambda v: ~F.startswith(v, F.lit("{")))
    return F.filter(values, lambda v: v.isNotNull())


def candidate_literals(label: Column, details: Column, config: Mapping[str, list[tuple[str, str | None]]], labels: Column | None = None, language: str = "en") -> Column:
    """A candidate's literals by ``config``: predicate -> sources ("label", None), ("aliases", None), ("string_claims",
    claim) or ("item_claim_labels", claim).  ``labels`` is a map from entity ids to labels, for the last kind."""

    def of(kind: str, name: str | None) -> Column:
        if kind == "label":
            return F.array(label)
        if kind == "aliases":
            return F.transform(F.coalesce(F.try_element_at(details["aliases"], F.lit(language)), F.array().cast("array<struct<value:string>>")), lambda a: a["value"])
        if kind in ("string_claims", "item_claim_labels") and not name:
            raise ValueError(f"{kind} needs the name of a claim")
        if kind == "string_claims":
            return claims(details, name)
        if kind == "item_claim_labels":
            return F.transform(claims(details, name, items=True), lambda i: F.try_element_at(labels, i))
        raise ValueError(f"unknown source of literals: {kind}")

    cells = []
    for predicate, kinds in config.items():
        values = F.transform(F.concat(*[of(*k) for k in kinds]), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
        cells.append(F.struct(F.lit(predicate).alias("key"), F.array_distinct(F.filter(values, lambda x: x != "")).alias("value")))
    return F.map_from_entries(F.filter(F.array(*cells), lambda c: F.size(c["value"]) > 0))


# ---- judging --------------------------------------------------------------------------------------------------


def judged(scored: DataFrame, threshold: Column, unresolved_penalty: Column, fuzzy_penalty: Column) -> DataFrame:
    """``scored`` (with score, fuzzy_match, unresolved) above the threshold: what is unresolved counts less before the
    threshold is looked at, what is fuzzy after it."""
    before = F.col("score") * F.when(F.col("unresolved"), 1 - unresolved_penalty).otherwise(F.lit(1.0))
    after = F.when(F.col("fuzzy_match"), 1 - fuzzy_penalty).otherwise(F.lit(1.0))
    return scored.withColumn("score", before).where(F.col("score") >= threshold).withColumn("score", F.col("score") * after)


def by_type(source: Source, attribute: str) -> Column:
    out = F.lit(float(getattr(source.others, attribute)) if source.others else None).cast("double")
    for kind, rules in source.types.items():
        out = F.when(F.col("type") == kind, F.lit(float(getattr(rules, attribute)))).otherwise(out)
    return out


def feed_back(entities: DataFrame, found: DataFrame, identifier: str) -> DataFrame:
    """``entities`` with the ids that a source ``found`` (uri, value) appended to their literals, each once."""
    more = found.where("value is not null").groupBy("uri").agg(F.array_sort(F.collect_set("value")).alias("__found"))
    own = F.coalesce(F.try_element_at("literals", F.lit(identifier)), F.array().cast("array<string>"))
    others = F.map_filter("literals", lambda k, _: k != identifier)
    joined = F.map_concat(others, F.create_map(F.lit(identifier), F.array_distinct(F.concat(own, "__found"))))
    return entities.join(more, "uri", "left").withColumn("literals", F.when(F.col("__found").isNull(), F.col("literals")).otherwise(joined)).drop("__found")


def run(entities: DataFrame, sources: list[Source], score: Callable[[DataFrame], DataFrame], keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(source, uri, candidate, score) of all sources, asked one after the other.

    ``score`` adds ``score`` to pairs (uri, type, literals, candidate and what ``records`` have); ``keep`` stores a
    result.  Ids that a source with an ``identifier`` finds go into the literals that the next one is asked with.
    """
    out: DataFrame | None = None
    for source in sources:
        wanted = entities if source.others else entities.where(F.col("type").isin(list(source.types)))
        pairs = candidates(wanted, source).join(wanted, "uri").join(source.records, "candidate")
        kept = judged(score(pairs), *[by_type(source, a) for a in ("threshold", "unresolved_penalty", "fuzzy_penalty")])
        results = keep(kept.select(F.lit(source.name).alias("source"), "uri", "candidate", "score"))
        if source.identifier:
            entities = keep(feed_back(entities, results.select("uri", F.col("candidate").alias("value")), source.identifier))
        out = results if out is None else out.unionByName(results)
    return out


def totals(results: DataFrame) -> DataFrame:
    """(source, results) of what ``run`` found."""
    return results.groupBy("source").agg(F.count("*").alias("results"))

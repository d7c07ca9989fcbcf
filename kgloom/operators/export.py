"""Merging aligned entities and serialising graphs."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import shorten
from .components import connected_components


def canonical(pairs: DataFrame, store: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(uri, canonical) for all members of aligned pairs (a, b): the smallest URI of the component."""
    found = connected_components(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")), store)
    return found.select(F.col("node").alias("uri"), F.col("component").alias("canonical"))


def rewrite(triples: DataFrame, names: DataFrame) -> DataFrame:
    """``triples`` (s, p, o) with the names (uri, canonical) put in, as a set; loops that arise by it are dropped."""
    s, o = names.select(F.col("uri").alias("s"), F.col("canonical").alias("s2")), names.select(F.col("uri").alias("o"), F.col("canonical").alias("o2"))
    joined = triples.join(s, "s", "left").join(o, "o", "left").select(F.coalesce("s2", "s").alias("s2"), "p", F.coalesce("o2", "o").alias("o2"), (F.col("s") == F.col("o")).alias("loop"))
    return joined.where("loop or s2 <> o2").select(F.col("s2").alias("s"), "p", F.col("o2").alias("o")).distinct()


def strip_hashes(uris: DataFrame) -> DataFrame:
    """(uri, short): without ``_`` and six hexadecimal digits at the end, where no other URI would get the same name.

    Names come back to their URIs by the URI, as many URIs can share a form.
    """
    cut = uris.select("uri").distinct().withColumn("cut", F.regexp_replace("uri", "_[0-9a-f]{6}$", ""))
    alone = cut.groupBy("cut").agg(F.count("*").alias("n"), F.min("uri").alias("uri")).where("n = 1").select("uri", "cut")
    return cut.select("uri").join(alone, "uri", "left").select("uri", F.coalesce("cut", "uri").alias("short"))


def deduplicated(triples: DataFrame, pairs: DataFrame, store: Callable[[DataFrame], DataFrame], link: str = "sameAs") -> DataFrame:
    """The graph with aligned entities merged, without alignment statements, and with short names where they are unique."""
    merged = store(rewrite(triples.where(~F.endswith(F.col("p"), F.lit(link))), canonical(pairs, store)))
    uris = merged.select(F.col("s").alias("uri")).union(merged.where(F.col("o").rlike("^https?://")).select("o"))
    return rewrite(merged, strip_hashes(uris).select("uri", F.col("short").alias("canonical")))


# ---- prefixes -------------------------------------------------------------------------------------------------


def prefix_map(base: DataFrame, schema: DataFrame) -> DataFrame:
    """(prefix, namespace) of both tables, each prefix once; on a collision the base's counts."""
    return base.select("prefix", "namespace").unionByName(schema.select("prefix", "namespace").join(base.select("prefix"), "prefix", "left_anti"))


def data_prefixes(prefixes: DataFrame, curation: DataFrame) -> DataFrame:
    """The prefixes of the data graph: without those that only curation needs."""
    return prefixes.join(curation.select("prefix"), "prefix", "left_anti")


def declared_prefixes(query: Column) -> Column:
    """The (prefix, namespace) pairs that a query's text declares, in their order."""
    found = F.regexp_extract_all(query, F.lit(r"(?i)(\bPREFIX\s+(?:[A-Za-z][\w-]*)?\s*:\s*<[^>]*>)"))
    part = lambda x, i: F.regexp_extract(x, r"(?i)PREFIX\s+([A-Za-z][\w-]*)?\s*:\s*<([^>]*)>", i)
    return F.transform(found, lambda x: F.struct(part(x, 1).alias("prefix"), part(x, 2).alias("namespace")))


def default_query(prefixes: Mapping[str, str], rows: int = 50) -> str:
    """The query that a user starts from: all prefixes in order, and the first triples."""
    return "".join(f"PREFIX {p}: <{n}>\n" for p, n in sorted(prefixes.items())) + f"\nSELECT ?s ?p ?o\nWHERE {{ ?s ?p ?o }}\nLIMIT {rows}"


# ---- serialisation --------------------------------------------------------------------------------------------


def escape(text: Column) -> Column:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def term(value: Column, kind: Column, datatype: Column | None = None) -> Column:
    """A term as N-Triples."""
    literal = F.concat(F.lit('"'), escape(value), F.lit('"'))
    if datatype is not None:
        literal = F.when(datatype.isNotNull(), F.concat(literal, F.lit("^^<"), datatype, F.lit(">"))).otherwise(literal)
    return F.when(kind == "iri", F.concat(F.lit("<"), value, F.lit(">"))).otherwise(literal)


def ntriples(triples: DataFrame) -> DataFrame:
    """A line for each triple (s, p, o, o_kind)."""
    return triples.select(F.concat(F.lit("<"), "s", F.lit("> <"), "p", F.lit("> "), term(F.col("o"), F.col("o_kind")), F.lit(" .")).alias("line"))


def _short(iri: Column, prefixes: Mapping[str, str]) -> Column:
    """As ``prefix:local`` where the rest is a plain local name, else in angle brackets."""
    name = shorten(iri, prefixes)
    plain = (name != iri) & name.rlike(r"^[A-Za-z][\w\-]*:[A-Za-z_][\w\-]*$")
    return F.when(plain, name).otherwise(F.concat(F.lit("<"), iri, F.lit(">")))


def turtle(triples: DataFrame, prefixes: Mapping[str, str]) -> DataFrame:
    """(s, block): the Turtle of each subject, predicates and objects in order.  Subjects are bounded by what one
    entity has; the prefix header is ``turtle_header``."""
    o = F.when(F.col("o_kind") == "iri", _short(F.col("o"), prefixes)).otherwise(term(F.col("o"), F.col("o_kind")))
    lines = triples.select("s", F.struct(_short(F.col("p"), prefixes).alias("p"), o.alias("o")).alias("x"))
    body = F.array_join(F.transform(F.array_sort(F.collect_set("x")), lambda x: F.concat(x["p"], F.lit(" "), x["o"])), " ;\n    ")
    return lines.groupBy("s").agg(F.concat(_short(F.first("s"), prefixes), F.lit(" "), body, F.lit(" .")).alias("block"))


def turtle_header(prefixes: Mapping[str, str]) -> str:
    return "".join(f"@prefix {p}: <{n}> .\n" for p, n in sorted(prefixes.items()))


def jsonld(triples: DataFrame) -> DataFrame:
    """(s, node): each subject as an expanded JSON-LD node."""
    value = F.when(F.col("o_kind") == "iri", F.to_json(F.struct(F.col("o").alias("@id")))).otherwise(F.to_json(F.struct(F.col("o").alias("@value"))))
    by = triples.select("s", "p", value.alias("x")).groupBy("s", "p").agg(F.array_join(F.array_sort(F.collect_set("x")), ",").alias("x"))
    quoted = lambda c: F.concat(F.lit('"'), escape(c), F.lit('"'))
    cells = F.array_sort(F.collect_list(F.concat(quoted(F.col("p")), F.lit(":["), "x", F.lit("]"))))
    return by.groupBy("s").agg(F.concat(F.lit('{"@id":'), quoted(F.first("s")), F.lit(","), F.array_join(cells, ","), F.lit("}")).alias("node"))

"""Queries of scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..views import NS, Views, with_views

QUERIES: dict = {}


def register(sql: str | None, *views: str):
    def add(function):
        QUERIES[function.__name__] = (function, with_views(sql, *views) if sql and views else sql)
        return function

    return add


_LOCAL = "regexp_extract(regexp_extract({0}, '[^#]*$'), '[^/]*$')"


@register(f"SELECT page_id, CASE WHEN starts_with(url, 'http') THEN {_LOCAL.format('url')} ELSE url END AS name FROM pages")
def local_name(v: Views) -> DataFrame:
    return v.table("pages").select("page_id", C.local_name(F.col("url")).alias("name"))


@register(f"SELECT stmt_id, {_LOCAL.format('p')} AS name FROM versions", "versions")
def pred_local_name(v: Views) -> DataFrame:
    return v.versions.select("stmt_id", C.pred_local_name(F.col("p")).alias("name"))


@register("SELECT page_id, regexp_extract(url, '[^/]*$') AS segment FROM pages")
def last_segment(v: Views) -> DataFrame:
    return v.table("pages").select("page_id", C.last_segment(F.col("url")).alias("segment"))


_TOKENS = r"array_to_string(list_sort(list_filter(string_split_regex(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}\p{{M}}_]', ' ', 'g'), '\s+'), lambda w: w <> '')), ' ')"


@register(f"SELECT p_partkey, {_TOKENS.format('p_name')} AS tokens FROM part")
def normalize_tokens(v: Views) -> DataFrame:
    return v.table("part").select("p_partkey", C.normalize_tokens(F.col("p_name")).alias("tokens"))


@register("SELECT doc_id, regexp_replace(translate(text, '‐‑–—', '----'), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x9F]', '', 'g') AS cleaned FROM documents")
def normalize_unicode(v: Views) -> DataFrame:
    return v.table("documents").select("doc_id", C.normalize_unicode(F.col("text")).alias("cleaned"))


@register("SELECT doc_id, replace(replace(replace(text, '¨a', 'ä'), '¨o', 'ö'), '¨u', 'ü') AS fixed FROM documents")
def fix_modifiers(v: Views) -> DataFrame:
    return v.table("documents").select("doc_id", C.fix_modifiers(F.col("text")).alias("fixed"))


_SEMI = "regexp_replace({0}, '&(a|b|ab|xy|am|ampx|foo|bar);', '&\\1', 'g')"


@register(f"SELECT page_id, {_SEMI.format("concat('&foo; &amp; &bar; ', url)")} AS cleaned FROM pages")
def semicolon_clean(v: Views) -> DataFrame:
    return v.table("pages").select("page_id", C.semicolon_clean(F.concat(F.lit("&foo; &amp; &bar; "), "url")).alias("cleaned"))


@register("""SELECT doc_id, regexp_replace(regexp_replace(replace(text, '. ', E'.\\n\\n\\n\\n'), '\\n{3,}', E'\\n\\n', 'g'), '[ \\t]{2,}', ' ', 'g') AS cleaned FROM documents""")
def clean_markdown(v: Views) -> DataFrame:
    marked = F.concat(F.lit("**==> picture 1 <==**"), F.replace("text", F.lit(". "), F.lit(".\n\n\n\n")))
    return v.table("documents").select("doc_id", C.clean_markdown(marked).alias("cleaned"))


PREFIXES = {"kg": NS, "pred": f"{NS}p/", "cls": f"{NS}c/"}
_SHORT = f"CASE WHEN starts_with({{0}}, '{NS}p/') THEN 'pred:' || substr({{0}}, {len(NS) + 3}) WHEN starts_with({{0}}, '{NS}c/') THEN 'cls:' || substr({{0}}, {len(NS) + 3}) WHEN starts_with({{0}}, '{NS}') THEN 'kg:' || substr({{0}}, {len(NS) + 1}) ELSE {{0}} END"


@register(f"SELECT s, {_SHORT.format('s')} AS short FROM triples WHERE p = '{NS}p/type'", "triples")
def shorten_uri(v: Views) -> DataFrame:
    return v.triples.where(F.col("p") == f"{NS}p/type").select("s", C.shorten(F.col("s"), PREFIXES).alias("short"))


@register(f"SELECT {_SHORT.format('s')} AS s, {_SHORT.format('p')} AS p, CASE WHEN o_kind = 'iri' THEN {_SHORT.format('o')} ELSE o END AS o FROM triples", "triples")
def shorten_results(v: Views) -> DataFrame:
    o = F.when(F.col("o_kind") == "iri", C.shorten(F.col("o"), PREFIXES)).otherwise(F.col("o"))
    return v.triples.select(C.shorten(F.col("s"), PREFIXES).alias("s"), C.shorten(F.col("p"), PREFIXES).alias("p"), o.alias("o"))


@register(r"SELECT page_id, regexp_matches(trim(url), '^https?://\S+$') AS valid FROM pages")
def is_valid_uri(v: Views) -> DataFrame:
    return v.table("pages").select("page_id", C.is_valid_uri(F.col("url")).alias("valid"))


@register(r"SELECT page_id, regexp_matches(replace(url, 'http:', 'http'), '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+') AS valid FROM pages")
def validate_iri(v: Views) -> DataFrame:
    return v.table("pages").select("page_id", C.validate_iri(F.replace("url", F.lit("http:"), F.lit("http"))).alias("valid"))


@register("SELECT stmt_id, o_kind = 'iri' AS iri FROM versions", "versions")
def is_iri(v: Views) -> DataFrame:
    return v.versions.select("stmt_id", C.is_iri(F.col("o")).alias("iri"))


_ORCID = "lpad((event_id % 10000)::VARCHAR, 4, '0') || '-0000-0001-000' || CASE WHEN event_id % 11 = 10 THEN 'X' WHEN event_id % 11 = 9 THEN 'Y' ELSE (event_id % 11)::VARCHAR END"


@register(f"SELECT event_id, event_id % 11 <> 9 AS valid FROM events")
def orcid_valid(v: Views) -> DataFrame:
    e = F.col("event_id")
    last = F.when(e % 11 == 10, "X").when(e % 11 == 9, "Y").otherwise((e % 11).cast("string"))
    made = F.concat(F.lpad((e % 10000).cast("string"), 4, "0"), F.lit("-0000-0001-000"), last)
    return v.table("events").select("event_id", C.orcid_valid(made).alias("valid"))


@register(f"SELECT s, CASE WHEN starts_with(s, '{NS}nation') THEN 'onto:' ELSE '' END || regexp_extract(s, '[^/#]*$') AS label FROM triples WHERE p = '{NS}p/name'", "triples")
def entity_label(v: Views) -> DataFrame:
    return v.triples.where(F.col("p") == f"{NS}p/name").select("s", C.entity_label(F.col("s"), f"{NS}nation").alias("label"))


@register(r"""SELECT page_id, regexp_replace(url, '[\\/:"*?<>|\r\n]+', '_', 'g') AS name FROM pages""")
def safe_filename(v: Views) -> DataFrame:
    return v.table("pages").select("page_id", C.safe_filename(F.col("url")).alias("name"))


@register("SELECT doc_id, substr(md5(text), 1, 6) AS short FROM documents")
def hash_id(v: Views) -> DataFrame:
    return v.table("documents").select("doc_id", F.substring(F.md5("text"), 1, 6).alias("short"))


@register("SELECT stmt_id, greatest(0.3::DOUBLE, 1 - 1.0::DOUBLE * span_start / 400) AS factor FROM versions", "versions")
def decay_factor(v: Views) -> DataFrame:
    return v.versions.select("stmt_id", C.decay(F.col("span_start"), F.lit(400), 1.0, 0.3).alias("factor"))


@register("""SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score
FROM embeddings a JOIN embeddings b ON a.vec_id + 1 = b.vec_id""")
def cosine_similarity(v: Views) -> DataFrame:
    t = v.table("embeddings")
    left, right = t.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x")), t.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    return left.join(right, "a").select("a", "b", F.round(C.cosine(F.col("x"), F.col("y")), 6).alias("score"))


@register("SELECT doc_id, \"at\", (\"at\" + length(regexp_replace(left(text, \"at\"), '[^\\x{10000}-\\x{10FFFF}]', '', 'g')))::INTEGER AS utf16 FROM (SELECT doc_id, concat('😀 ', text) AS text, 5 AS \"at\" FROM documents)")
def utf16_offsets(v: Views) -> DataFrame:
    docs = v.table("documents").select("doc_id", F.concat(F.lit("😀 "), "text").alias("text"), F.lit(5).alias("at"))
    return docs.select("doc_id", "at", C.utf16_offset(F.col("text"), F.col("at")).alias("utf16"))


@register("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def claim_ids(v: Views) -> DataFrame:
    return v.table("events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@register("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def claim_strings(v: Views) -> DataFrame:
    return v.table("events").select("event_id", F.variant_get(F.parse_json("props"), "$.k", "string").alias("k"))


@register("SELECT doc_id, array_to_string(list_distinct_ordered, ',') AS items FROM (SELECT doc_id, [lang, source] AS list_distinct_ordered FROM documents)")
def ordered_distinct(v: Views) -> DataFrame:
    """Duplicates go, the first of each stays in its place."""
    return v.table("documents").select("doc_id", F.array_join(F.array_distinct(F.array("lang", "source", "lang", "source")), ",").alias("items"))


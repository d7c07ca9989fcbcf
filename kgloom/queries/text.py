"""Queries of uploads, of passages found in texts, of spans side by side and of the confidence model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import confidence as C
from ..operators import intervals
from ..operators.passages import find_values
from ..session import store
from ..views import Views, with_views

QUERIES: dict = {}


def register(sql: str | None, *views: str):
    def add(function):
        QUERIES[function.__name__] = (function, with_views(sql, *views) if sql and views else sql)
        return function

    return add


@register("SELECT min(doc_id) AS doc_id, sha256(text) AS content_hash, CASE min(doc_id) % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN 'md' ELSE 'txt' END AS kind FROM documents GROUP BY sha256(text)")
def intake_dedup(v: Views) -> DataFrame:
    """The first document of each content; its kind by the file name's ending."""
    name = F.concat(F.lit("file"), "doc_id", F.when(F.col("doc_id") % 3 == 0, ".PDF").when(F.col("doc_id") % 3 == 1, ".md").otherwise(".txt"))
    docs = v.table("documents").select("doc_id", F.sha2("text", 256).alias("content_hash"), F.lower(F.regexp_extract(name, r"\.(\w+)$", 1)).alias("kind"))
    first = docs.groupBy("content_hash").agg(F.min(F.struct("doc_id", "kind")).alias("x"))
    return first.select("x.doc_id", "content_hash", "x.kind")


_FOUND = "SELECT d.doc_id, b.item_id, strpos({0}d.text{1}, {0}b.text{1}) - 1 AS start, strpos({0}d.text{1}, {0}b.text{1}) - 1 + length(b.text) AS \"end\" FROM documents d JOIN benchmark b ON contains({0}d.text{1}, {0}b.text{1})"


@register(_FOUND.format("", ""))
def find_span_exact(v: Views) -> DataFrame:
    return find_values(v.table("documents"), v.table("benchmark"), "doc_id", "text", "item_id", "text")


@register(_FOUND.format("lower(", ")"))
def find_span_ci(v: Views) -> DataFrame:
    return find_values(v.table("documents"), v.table("benchmark"), "doc_id", "text", "item_id", "text", any_case=True)


_SECTION = "'# ' || source || chr(10) || text || chr(10) || '## end' || chr(10) || 'tail'"


@register("SELECT a.stmt_id AS a, b.stmt_id AS b FROM versions a JOIN versions b ON a.doc_id = b.doc_id AND a.stmt_id < b.stmt_id AND a.span_start < b.span_end AND a.span_end > b.span_start", "versions")
def span_overlap(v: Views) -> DataFrame:
    """Spans of one document that overlap: those that don't hardly meet."""
    return intervals.overlapping_pairs(v.versions, "doc_id", "span_start", "span_end", "stmt_id").select("a", "b")


@register("""SELECT c.doc_id, c.x AS start, c."end", CASE WHEN count(*) FILTER (v.o_kind = 'iri') > 0 THEN 'object' WHEN count(v.stmt_id) > 0 THEN 'subject' END AS role
FROM (SELECT doc_id, x, lead(x) OVER (PARTITION BY doc_id ORDER BY x) AS "end" FROM (SELECT doc_id, span_start AS x FROM versions UNION SELECT doc_id, span_end FROM versions)) c
LEFT JOIN versions v ON v.doc_id = c.doc_id AND v.span_start <= c.x AND v.span_end >= c."end" WHERE c."end" IS NOT NULL GROUP BY c.doc_id, c.x, c."end" """, "versions")
def highlight_segments(v: Views) -> DataFrame:
    """The pieces that a document's spans cut it into, an object's role before a subject's."""
    roles = v.versions.withColumn("role", F.when(F.col("o_kind") == "iri", "object").otherwise("subject"))
    return intervals.segments(roles, "doc_id", "span_start", "span_end", "role", store)


@register(""", v AS (SELECT doc_id // 4 AS doc_id, stmt_id, s, o, o_kind, span_start AS a, span_end AS b FROM versions WHERE is_current)
SELECT stmt_id, a AS span_start, b AS span_end, 'object' AS role, 0 AS rank FROM v WHERE o_kind = 'literal'
UNION ALL SELECT DISTINCT x.stmt_id, y.a, y.b, 'subject', 1 FROM v x JOIN v y ON x.doc_id = y.doc_id AND x.s = y.s WHERE NOT (x.o_kind = 'literal' AND x.a = y.a AND x.b = y.b)
UNION ALL SELECT DISTINCT x.stmt_id, y.a, y.b, 'object', 2 FROM v x JOIN v y ON x.doc_id = y.doc_id AND x.o = y.s WHERE x.o_kind = 'iri'""", "versions")
def display_spans(v: Views) -> DataFrame:
    """A statement's own span, then those of its subject except an equal one, then those of its object."""
    now = v.versions.where("is_current").withColumn("doc_id", F.floor(F.col("doc_id") / 4))
    return intervals.shown_spans(now, now)


@register("SELECT s, round(sum(confidence::DECIMAL(18, 9))::DOUBLE / count(*), 9) AS mean, count(*) AS n FROM versions GROUP BY s", "versions")
def entity_avg_conf(v: Views) -> DataFrame:
    return C.averages(v.versions, "s", digits=9).select("s", "mean", "n")


_JOINED = "FROM links l LEFT JOIN means a ON a.s = l.s LEFT JOIN means b ON b.s = l.o"


def _links(v: Views) -> DataFrame:
    return v.versions.where("o_kind = 'iri'").select("s", "o").distinct()


def _means(v: Views) -> DataFrame:
    return C.averages(v.versions.where("o_kind = 'literal'"), "s", digits=9)


@register("SELECT l.s, l.o, b.mean AS target " + _JOINED, "versions", "means", "links")
def target_avg(v: Views) -> DataFrame:
    return _links(v).join(_means(v).select(F.col("s").alias("o"), F.col("mean").alias("target")), "o", "left").select("s", "o", "target")


@register("SELECT l.s, l.o, round((coalesce(a.t, 0) + coalesce(b.t, 0)) / nullif(coalesce(a.n, 0) + coalesce(b.n, 0), 0), 9) AS pooled " + _JOINED, "versions", "means", "links")
def pair_avg_conf(v: Views) -> DataFrame:
    return C.pooled(_links(v), _means(v), "s", "o", "s", digits=9)


def _both(v: Views) -> DataFrame:
    places = v.versions.where("o_kind = 'literal'").groupBy("s").agg(F.median("span_start").alias("place"))
    both = _means(v).join(places, "s")
    a, b = both.select("s", F.col("mean").alias("m1"), F.col("place").alias("p1")), both.select(F.col("s").alias("o"), F.col("mean").alias("m2"), F.col("place").alias("p2"))
    return _links(v).join(a, "s", "left").join(b, "o", "left")


@register("SELECT l.s, l.o, round(coalesce((a.mean + b.mean) / 2, b.mean) * greatest(0.3::DOUBLE, 1 - 1.0::DOUBLE * coalesce(abs(a.place - b.place), 0) / 487), 4) AS score " + _JOINED + " WHERE b.mean IS NOT NULL", "versions", "means", "links")
def cooccurrence_score(v: Views) -> DataFrame:
    score = C.cooccurrence(F.col("m1"), F.col("m2"), F.abs(F.col("p1") - F.col("p2")), F.lit(487))
    return _both(v).where("m2 is not null").select("s", "o", score.alias("score"))


@register("""SELECT l.s, l.o, CASE WHEN b.place IS NULL OR b.place BETWEEN 100 AND 200 OR b.place BETWEEN 300 AND 350 THEN b.mean
ELSE round(b.mean * 0.8 * greatest(0.3::DOUBLE, 1 - 1.0::DOUBLE * least(abs(b.place - 100), abs(b.place - 200), abs(b.place - 300), abs(b.place - 350)) / 487), 4) END AS score """ + _JOINED, "versions", "means", "links")
def section_containment(v: Views) -> DataFrame:
    starts, ends = F.array(F.lit(100.0), F.lit(300.0)), F.array(F.lit(200.0), F.lit(350.0))
    return _both(v).select("s", "o", C.containment(F.col("m2"), F.col("p2"), starts, ends, F.lit(487)).alias("score"))


@register("""SELECT stmt_id, round(confidence * CASE WHEN count(*) OVER w >= 2 THEN greatest(0.2::DOUBLE, 1 - 1.0::DOUBLE * abs(span_start - median(span_start) OVER w) / 487) ELSE 1.0 END, 4) AS confidence
FROM versions WINDOW w AS (PARTITION BY s)""", "versions")
def entity_outlier(v: Views) -> DataFrame:
    return C.outliers(v.versions.select("stmt_id", "s", "span_start", "confidence"), ["s"], "span_start", F.lit(487)).select("stmt_id", "confidence")


@register("""SELECT stmt_id, round(confidence * CASE WHEN count(*) OVER w >= 2 THEN greatest(0.2::DOUBLE, 1 - 1.0::DOUBLE * abs(span_start - median(span_start) OVER w) / 487) ELSE 1.0 END, 4) AS confidence
FROM versions WINDOW w AS (PARTITION BY s, p)""", "versions")
def object_outlier(v: Views) -> DataFrame:
    return C.outliers(v.versions.select("stmt_id", "s", "p", "span_start", "confidence"), ["s", "p"], "span_start", F.lit(487)).select("stmt_id", "confidence")


@register("SELECT s, median(span_start) AS place FROM versions GROUP BY s", "versions")
def entity_median_span(v: Views) -> DataFrame:
    return v.versions.groupBy("s").agg(F.median("span_start").alias("place"))


@register("SELECT a.stmt_id, median(b.span_start) AS others FROM versions a LEFT JOIN versions b ON a.doc_id = b.doc_id AND a.stmt_id <> b.stmt_id GROUP BY a.stmt_id", "versions")
def loo_median(v: Views) -> DataFrame:
    return C.others_median(v.versions.select("doc_id", "stmt_id", "span_start"), "doc_id", "stmt_id", "span_start")


@register("SELECT stmt_id FROM versions WHERE is_current AND status = 'pending' AND activity_type <> 'lookup' AND confidence >= 0.4", "versions")
def bulk_acceptable(v: Views) -> DataFrame:
    return v.versions.where("is_current and status = 'pending' and activity_type <> 'lookup' and confidence >= 0.4").select("stmt_id")

"""Deterministic knowledge-graph views of the star schema and text tables, as DataFrames and as SQL.

They put the engine's data model over tables that exist: turns of a conversation are versions of a statement, rows of
the star schema are triples, parts are entities, equal texts are pairs of aligned entities.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NS = "http://kg.example/"
#: Status, activity and predicate names of the views.
STATUS = ("pending", "accepted", "rejected")

SQL = {
    "versions": f"""versions AS (
  SELECT conv_id AS doc_id, conv_id || '-' || turn AS stmt_id,
    CASE WHEN turn = 0 THEN 'doc-' || conv_id ELSE conv_id || '-' || (turn - 1) END AS parent_id, CASE WHEN turn = 0 THEN 'document' ELSE 'statement' END AS parent_kind,
    conv_id || '-0' AS root_id, turn AS version_no, '{NS}e/' || (conv_id // 3) AS s,
    CASE WHEN conv_id % 5 = 0 THEN '{NS}p/sameAs' ELSE '{NS}p/' || role END AS p,
    CASE WHEN conv_id % 5 = 0 THEN '{NS}e/' || (conv_id // 2 + 1) ELSE text END AS o, CASE WHEN conv_id % 5 = 0 THEN 'iri' ELSE 'literal' END AS o_kind,
    turn = max(turn) OVER (PARTITION BY conv_id) AS is_current, ['pending', 'accepted', 'rejected'][1 + (conv_id * 7 + turn) % 3] AS status,
    CASE WHEN turn > 0 THEN 'edit' WHEN conv_id % 10 = 0 THEN 'alignment' WHEN conv_id % 5 = 0 THEN 'lookup' ELSE 'extraction' END AS activity_type,
    'act-' || conv_id || '-' || turn AS activity_id, 'agent-' || (conv_id % 7) AS agent_id,
    ((conv_id * 37 + turn * 11) % 100) / 100.0::DOUBLE AS confidence, (conv_id * 13 + turn * 7) % 500 AS span_start, (conv_id * 13 + turn * 7) % 500 + 1 + length(text) % 40 AS span_end
  FROM conversations)""",
    "triples": f"""triples AS (
  SELECT '{NS}region/' || r_regionkey AS s, '{NS}p/name' AS p, r_name AS o, 'literal' AS o_kind FROM region
  UNION ALL SELECT '{NS}region/' || r_regionkey, '{NS}p/type', '{NS}c/Region', 'iri' FROM region
  UNION ALL SELECT '{NS}nation/' || n_nationkey, '{NS}p/type', '{NS}c/Nation', 'iri' FROM nation
  UNION ALL SELECT '{NS}nation/' || n_nationkey, '{NS}p/name', n_name, 'literal' FROM nation
  UNION ALL SELECT '{NS}nation/' || n_nationkey, '{NS}p/inRegion', '{NS}region/' || n_regionkey, 'iri' FROM nation
  UNION ALL SELECT '{NS}customer/' || c_custkey, '{NS}p/type', '{NS}c/Customer', 'iri' FROM customer
  UNION ALL SELECT '{NS}customer/' || c_custkey, '{NS}p/name', c_name, 'literal' FROM customer
  UNION ALL SELECT '{NS}customer/' || c_custkey, '{NS}p/segment', c_mktsegment, 'literal' FROM customer
  UNION ALL SELECT '{NS}customer/' || c_custkey, '{NS}p/inNation', '{NS}nation/' || c_nationkey, 'iri' FROM customer
  UNION ALL SELECT '{NS}order/' || o_orderkey, '{NS}p/type', '{NS}c/Order', 'iri' FROM orders
  UNION ALL SELECT '{NS}order/' || o_orderkey, '{NS}p/placedBy', '{NS}customer/' || o_custkey, 'iri' FROM orders
  UNION ALL SELECT '{NS}order/' || o_orderkey, '{NS}p/priority', o_orderpriority, 'literal' FROM orders)""",
    "doc_status": """doc_status AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, CASE l.quality WHEN 1 THEN 'accepted' WHEN 0 THEN 'rejected' ELSE 'pending' END AS status, l.quality
  FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l USING (doc_id))""",
    "entities": f"""entities AS (
  SELECT '{NS}part/' || p_partkey AS uri, p_type AS type, p_name AS name, p_brand AS brand, p_size AS size, p_partkey % 4 AS source_doc, p_partkey % 3 = 0 AS is_prior FROM part)""",
    "copies": f"""copies AS (
  SELECT '{NS}doc/' || a.doc_id AS a, '{NS}doc/' || b.doc_id AS b FROM documents a
  JOIN (SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text) b ON a.text = b.text AND a.doc_id <> b.doc_id)""",
    "means": """means AS (
  SELECT s, sum(confidence::DECIMAL(18, 9))::DOUBLE AS t, count(confidence) AS n, round(sum(confidence::DECIMAL(18, 9))::DOUBLE / count(confidence), 9) AS mean, median(span_start) AS place
  FROM versions WHERE o_kind = 'literal' GROUP BY s)""",
    "links": "links AS (SELECT DISTINCT s, o FROM versions WHERE o_kind = 'iri')",
    "log": """log AS (
  SELECT event_id, user_id || '@' || strftime(ts, '%Y-%m-%d') AS chain_id, ts AS "at", 'user-' || user_id AS agent_id, value,
    CASE event_type WHEN 'signup' THEN 'extract' WHEN 'view' THEN 'pending' WHEN 'click' THEN 'edit' WHEN 'purchase' THEN 'accept' ELSE 'reject' END AS action FROM events)""",
}


def with_views(body: str, *names: str) -> str:
    """SQL of ``body`` over the named views."""
    return "WITH " + ", ".join(SQL[n] for n in names) + "\n" + body


class Views:
    """The views over one folder of tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def versions(self) -> DataFrame:
        """One row for each version of a statement; see ``schema.STATEMENT``."""
        t = self.table("conversations")
        last = t.groupBy("conv_id").agg(F.max("turn").alias("last"))
        conv, turn = F.col("conv_id"), F.col("turn")
        ident = lambda n: F.concat(conv, F.lit("-"), n)
        aligned = conv % 5 == 0
        start = (conv * 13 + turn * 7) % 500
        return t.join(last, "conv_id").select(
            conv.alias("doc_id"), ident(turn).alias("stmt_id"),
            F.when(turn == 0, F.concat(F.lit("doc-"), conv)).otherwise(ident(turn - 1)).alias("parent_id"), F.when(turn == 0, "document").otherwise("statement").alias("parent_kind"),
            ident(F.lit(0)).alias("root_id"), turn.alias("version_no"), F.concat(F.lit(f"{NS}e/"), F.floor(conv / 3)).alias("s"),
            F.when(aligned, f"{NS}p/sameAs").otherwise(F.concat(F.lit(f"{NS}p/"), "role")).alias("p"),
            F.when(aligned, F.concat(F.lit(f"{NS}e/"), F.floor(conv / 2) + 1)).otherwise(F.col("text")).alias("o"), F.when(aligned, "iri").otherwise("literal").alias("o_kind"),
            (turn == F.col("last")).alias("is_current"), F.get(F.array(*map(F.lit, STATUS)), ((conv * 7 + turn) % 3).cast("int")).alias("status"),
            F.when(turn > 0, "edit").when(conv % 10 == 0, "alignment").when(aligned, "lookup").otherwise("extraction").alias("activity_type"),
            F.concat(F.lit("act-"), conv, F.lit("-"), turn).alias("activity_id"), F.concat(F.lit("agent-"), conv % 7).alias("agent_id"),
            (((conv * 37 + turn * 11) % 100) / 100.0).alias("confidence"), start.alias("span_start"), (start + 1 + F.length("text") % 40).alias("span_end"),
        )

    @cached_property
    def triples(self) -> DataFrame:
        """(s, p, o, o_kind) of the star schema: one scan a table, columns turned into triples in place."""
        iri = lambda kind, key: F.concat(F.lit(f"{NS}{kind}/"), F.col(key))

        def of(table: str, kind: str, key: str, cls: str, literals: dict, links: dict) -> DataFrame:
            rows = [("type", F.lit(f"{NS}c/{cls}"), "iri")] + [(p, F.col(c), "literal") for p, c in literals.items()] + [(p, iri(k, c), "iri") for p, (k, c) in links.items()]
            cells = F.array(*[F.struct(F.lit(f"{NS}p/{p}").alias("p"), o.alias("o"), F.lit(k).alias("o_kind")) for p, o, k in rows])
            return self.table(table).select(iri(kind, key).alias("s"), F.explode(cells).alias("t")).select("s", "t.p", "t.o", "t.o_kind")

        return (
            of("region", "region", "r_regionkey", "Region", {"name": "r_name"}, {})
            .union(of("nation", "nation", "n_nationkey", "Nation", {"name": "n_name"}, {"inRegion": ("region", "n_regionkey")}))
            .union(of("customer", "customer", "c_custkey", "Customer", {"name": "c_name", "segment": "c_mktsegment"}, {"inNation": ("nation", "c_nationkey")}))
            .union(of("orders", "order", "o_orderkey", "Order", {"priority": "o_orderpriority"}, {"placedBy": ("customer", "o_custkey")}))
        )

    @cached_property
    def doc_status(self) -> DataFrame:
        labels = self.table("labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
        status = F.when(F.col("quality") == 1, "accepted").when(F.col("quality") == 0, "rejected").otherwise("pending")
        return self.table("documents").join(labels, "doc_id", "left").select("doc_id", "text", "lang", "source", "n_chars", status.alias("status"), "quality")

    @cached_property
    def entities(self) -> DataFrame:
        key = F.col("p_partkey")
        return self.table("part").select(
            F.concat(F.lit(f"{NS}part/"), key).alias("uri"), F.col("p_type").alias("type"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"),
            F.col("p_size").alias("size"), (key % 4).alias("source_doc"), (key % 3 == 0).alias("is_prior"),
        )

    @cached_property
    def copies(self) -> DataFrame:
        """Pairs (copy, first document with the text): a star for each group, not all pairs."""
        docs = self.table("documents").select("doc_id", F.sha2("text", 256).alias("h"))
        first = docs.groupBy("h").agg(F.min("doc_id").alias("first"))
        iri = lambda c: F.concat(F.lit(f"{NS}doc/"), F.col(c))
        return docs.join(first, "h").where("doc_id <> first").select(iri("doc_id").alias("a"), iri("first").alias("b"))

    @cached_property
    def log(self) -> DataFrame:
        kind = F.col("event_type")
        action = F.when(kind == "signup", "extract").when(kind == "view", "pending").when(kind == "click", "edit").when(kind == "purchase", "accept").otherwise("reject")
        day = F.date_format("ts", "yyyy-MM-dd")
        return self.table("events").select("event_id", F.concat("user_id", F.lit("@"), day).alias("chain_id"), F.col("ts").alias("at"), F.concat(F.lit("user-"), "user_id").alias("agent_id"), "value", action.alias("action"))

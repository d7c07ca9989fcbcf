"""Other sources and sinks: annotations as JSON, uploads, configuration, schemas, and snapshots of tables."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import pred_local_name
from . import yaml
from .manifests import Manifests

ANNOTATION = (
    "source_document string, annotations array<struct<subject:string,predicate:string,value:string,object:string,span_start:int,span_end:int,span_text:string,confidence:double,triple_type:string>>"
)


def read_annotations(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Annotations by (subject, predicate's local name, value or object); of repeated keys the last counts.

    A file is one document's object (or an array of such), or with ``lines``, as ``write_annotations`` writes it, has
    one object a line.
    """
    rows = spark.read.schema(ANNOTATION).json(path, multiLine=not lines).select("source_document", F.posexplode("annotations").alias("at", "a"))
    rows = rows.select("source_document", "at", "a.*").withColumns({"predicate": pred_local_name(F.col("predicate")), "key": F.coalesce("value", "object")})
    return rows.groupBy("source_document", "subject", "predicate", "key").agg(F.max_by(F.struct("span_start", "span_end", "span_text", "confidence", "triple_type"), "at").alias("x")).select("source_document", "subject", "predicate", "key", "x.*")


def write_annotations(rows: DataFrame, path: str) -> None:
    """One JSON object a line for each document, as ``read_annotations`` takes it."""
    cells = F.struct(*[c for c in ("subject", "predicate", "value", "object", "span_start", "span_end", "span_text", "confidence", "triple_type") if c in rows.columns])
    rows.groupBy("source_document").agg(F.collect_list(cells).alias("annotations")).write.json(path)


def read_uploads(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """New files by content: (path, kind, content_hash, text); PDFs have no text, other kinds than .pdf .md .txt are left out.

    ``known`` has the hashes (content_hash) that are there already; of equal files the first by path counts.
    """
    kind = F.lower(F.regexp_extract("path", r"\.(\w+)$", 1))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.select("path", kind.alias("kind"), F.sha2("content", 256).alias("content_hash"), F.when(kind != "pdf", F.col("content").cast("string")).alias("text")).where("kind in ('pdf', 'md', 'txt')")
    first = files.groupBy("content_hash").agg(F.min(F.struct("path", "kind", "text")).alias("x")).select("x.path", "x.kind", "content_hash", "x.text")
    return first if known is None else first.join(known.select("content_hash"), "content_hash", "left_anti")


def parse_config(text: str, defaults: dict | None = None) -> dict:
    """A YAML or JSON configuration; what it doesn't say comes from ``defaults``, also inside of mappings."""
    return _over(defaults or {}, json.loads(text) if text.lstrip()[:1] == "{" else yaml.load(text) or {})


def read_config(path: str, defaults: dict | None = None) -> dict:
    """The configuration in a file, on the driver; the defaults alone if there is no such file."""
    file = Path(path)
    return parse_config(file.read_text(encoding="utf-8"), defaults) if file.exists() else dict(defaults or {})


def _over(below: dict, above: dict) -> dict:
    return {**below, **{k: _over(below[k], v) if isinstance(v, dict) and isinstance(below.get(k), dict) else v for k, v in above.items()}}


def slots(schema: dict) -> dict:
    """What a schema with ``slots`` and ``prefixes`` says: link fields, text fields, prefix, prefixes."""
    found = {n: d if isinstance(d, dict) else {} for n, d in schema.get("slots", {}).items()}
    prefixes = {n: p["prefix_reference"] if isinstance(p, dict) else p for n, p in schema.get("prefixes", {}).items()}
    return {
        "uris": sorted(n for n, d in found.items() if d.get("range") == "uri"),
        "names": [n for n, d in found.items() if d.get("range", "string") == "string"],
        "prefix": schema.get("default_prefix", "kg"),
        "prefixes": prefixes,
        "root": next((n for n, c in schema.get("classes", {}).items() if isinstance(c, dict) and c.get("tree_root")), None),
    }


def commit(df: DataFrame, root: str, version: int, partition: str = "workspace_id") -> str:
    """Write a table's next snapshot; a version that exists isn't overwritten, so one of two writers gets a
    ``Conflict``, and one that dies leaves no version behind."""
    tables = Manifests(df.sparkSession, root)
    base = tables.state(version - 1)
    part = tables.write(df, base, "table", partition=[partition] if partition in df.columns else None)
    tables.commit(base, {"table": [part]})
    return part.path


def snapshot(spark: SparkSession, root: str, version: int) -> DataFrame:
    tables = Manifests(spark, root)
    (part,) = tables.state(version).parts("table")
    return tables.read(part)


def changed(table: DataFrame, key: str, inserts: DataFrame | None = None, updates: DataFrame | None = None, deletes: DataFrame | None = None, order: str | None = None) -> DataFrame:
    """``table`` after changes by ``key``: rows updated, then rows deleted, then rows added.

    ``updates`` have the key and the columns that change; of several for a key the last by ``order`` counts, and of such
    the largest by its values.  Keys that aren't there change nothing.
    """
    out = table
    if updates is not None:
        names = [c for c in updates.columns if c not in (key, order)]
        first = [F.col(order).alias("__order")] if order else []
        new = updates.groupBy(key).agg(F.max(F.struct(*first, *names)).alias("__new"))
        joined = out.join(new, key, "left")
        out = joined.select(*[F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c) if c in names else F.col(c) for c in table.columns])
    if deletes is not None:
        out = out.join(deletes.select(key).distinct(), key, "left_anti")
    return out if inserts is None else out.unionByName(inserts)

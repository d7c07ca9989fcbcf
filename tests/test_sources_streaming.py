"""File sources, snapshots and the curation stream."""

from __future__ import annotations

import datetime
import json

import pytest
from pyspark.sql import functions as F

from kgloom.operators.passages import find_values
from kgloom.sources import files
from kgloom.streaming import curation


def test_annotations(spark, tmp_path):
    note = {"subject": "s", "predicate": "http://x/p#name", "value": "v", "span_start": 1, "span_end": 2, "confidence": 0.5, "triple_type": "literal"}
    (tmp_path / "a.json").write_text(json.dumps({"source_document": "d", "annotations": [note, note | {"confidence": 0.7}, note | {"value": None, "object": "o", "span_start": None}]}))
    rows = {(r.key): r for r in files.read_annotations(spark, str(tmp_path / "a.json")).collect()}
    assert rows["v"].confidence == 0.7 and rows["v"].predicate == "name" and rows["o"].span_start is None


def test_uploads(spark, tmp_path):
    for name, text in (("a.md", "one"), ("b.TXT", "two"), ("c.md", "one"), ("d.pdf", "%PDF"), ("e.exe", "x")):
        (tmp_path / name).write_text(text)
    got = {r.path.rsplit("/", 1)[-1]: (r.kind, r.text) for r in files.read_uploads(spark, str(tmp_path)).collect()}
    assert got == {"a.md": ("md", "one"), "b.TXT": ("txt", "two"), "d.pdf": ("pdf", None)}
    known = spark.range(1).select(F.sha2(F.lit("one"), 256).alias("content_hash"))
    assert files.read_uploads(spark, str(tmp_path), known).count() == 2


def test_schema_and_snapshots(spark, tmp_path):
    schema = {"slots": {"name": None, "url": {"range": "uri"}, "year": {"range": "integer"}}, "default_prefix": "ex", "prefixes": {"ex": "http://ex/", "o": {"prefix_reference": "http://o/"}}, "classes": {"Doc": {"tree_root": True}}}
    assert files.slots(schema) == {"uris": ["url"], "names": ["name"], "prefix": "ex", "prefixes": {"ex": "http://ex/", "o": "http://o/"}, "root": "Doc"}
    df = spark.createDataFrame([("w", 1)], "workspace_id string, x int")
    assert spark.read.parquet(files.commit(df, str(tmp_path), 1)).count() == 1
    with pytest.raises(Exception, match="(?i)exist"):
        files.commit(df, str(tmp_path), 1)


def test_find_values(spark):
    texts = spark.createDataFrame([(1, "xaab aab"), (2, None), (3, ""), (4, "AB")], "id long, text string")
    values = spark.createDataFrame([("p", "aab"), ("q", "ab"), ("r", "ab"), ("s", ""), ("t", None)], "name string, value string")
    got = find_values(texts, values, "id", "text", "name", "value")
    assert sorted(tuple(r) for r in got.collect()) == [(1, "p", 1, 4), (1, "q", 2, 4), (1, "r", 2, 4)]
    assert find_values(texts, values, "id", "text", "name", "value", any_case=True).where("id = 4").count() == 2


def test_stream(spark, tmp_path):
    at = lambda h, m: datetime.datetime(2026, 1, 1, h, m)
    rows = [(1, "a", at(1, 0), "extract"), (1, "a", at(1, 0), "extract"), (2, "a", at(1, 30), "accept"), (3, "b", at(1, 10), "extract"), (4, "a", at(9, 0), "reset")]
    spark.createDataFrame(rows, curation.ACTION).coalesce(1).write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema(curation.ACTION).parquet(str(tmp_path / "in"))

    def run(df, name, mode):
        query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination(120)
        return spark.table(name).collect()

    counts = run(curation.windowed_counts(curation.deduplicated(source()), late=None), "counts", "append")
    assert {(r.start.hour, r.action): r.n for r in counts} == {(1, "extract"): 2, (1, "accept"): 1}


def test_status_in_any_order_and_its_end(spark, tmp_path):
    """Batches of a log in any order within the watermark end as the whole log does; chains at rest lose their state."""
    spark.conf.set(*curation.STATE_STORE)
    at = lambda h, m: datetime.datetime(2026, 1, 1, h, m)
    log = [(i, f"c{i % 3}", at(1, (i * 7) % 50), f"act{i}") for i in range(12)]
    want = {c: (4, max((r for r in log if r[1] == c), key=lambda r: (r[2], r[0]))[3]) for c in ("c0", "c1", "c2")}
    for n, order in enumerate((log, log[::-1])):
        folder, seen = tmp_path / f"in{n}", []
        for batch in [order[:5], order[5:], [(90, "c9", at(9, 0), "other")], [(91, "c9", at(9, 1), "other")], [(92, "c0", at(9, 2), "again")]]:
            spark.createDataFrame(batch, curation.ACTION).coalesce(1).write.mode("append").parquet(str(folder))
            events = spark.readStream.schema(curation.ACTION).parquet(str(folder))
            status = curation.current_status(events, "1 hour", 60_000)
            query = status.writeStream.foreachBatch(lambda df, _: seen.extend(df.collect())).outputMode("update").option("checkpointLocation", str(tmp_path / f"cp{n}")).trigger(availableNow=True).start()
            query.awaitTermination(120)
        closed = {r.chain_id: (r.version, r.action) for r in seen if r.closed}
        assert {c: closed[c] for c in want} == want
        assert [(r.version, r.action) for r in seen if r.chain_id == "c0" and not r.closed][-1] == (1, "again")

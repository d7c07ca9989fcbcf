"""Ranked search, decontamination and as-of join against brute force, on the cases that their docstrings define."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict
from types import SimpleNamespace

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kgloom.llm import asof, decontaminate, queries, ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _terms(text: str | None) -> list[str]:
    lower = "".join(c.lower() if c.isascii() else c for c in text or "")
    return TERM.findall(lower)


# ---- ranked search --------------------------------------------------------------------------------------------


def _ranked(docs: list[tuple], items: list[tuple], k: int) -> list[tuple]:
    counts = [(i, Counter(_terms(t))) for i, t in docs]
    n, total = sum(1 for _, c in counts if c), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for name, text in set(items):
        scores = []
        for i, c in counts:
            m = 10 + (90 * sum(c.values()) * n) // max(total, 1)
            own = [(df[t], c[t]) for t in set(_terms(text)) if c[t]]
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) * ((10**9 * tf) // (1000 * tf + 8 * m)) for d, tf in own)
            if score:
                scores.append((-score, i is None, i or 0, i))
        out += [(name, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k])]
    return out


def _made_docs(rng: random.Random, n: int) -> list[tuple]:
    words = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choices(words, weights=range(60, 0, -1), k=rng.randint(1, 40)))) for i in range(n)]
    docs += [(n + i, docs[3][1]) for i in range(30)] + [(None, docs[5][1]), (7, docs[7][1]), (n + 50, None), (n + 51, ""), (n + 52, " .\n"), (n + 53, "w1 " * 5000)]
    return docs


@pytest.mark.parametrize("odd", [False, True])
def test_rank(spark, monkeypatch, odd):
    rng = random.Random(5)
    docs = _made_docs(rng, 300)
    items = [(i, " ".join(rng.choices([f"W{i}" for i in range(70)], k=rng.randint(1, 12)))) for i in range(12)] + [(90, None), (91, "..."), (92, "unheard of"), (3, "w1 w2"), (4, "w3"), (4, "w3")]
    if odd:
        monkeypatch.setattr(ranked, "QUERY_CHARS", 60)
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("x")).repartition(3)
    got = ranked.rank(frame, spark.createDataFrame(items, "item_id int, text string"), 10)
    assert got.schema["rank"].dataType.simpleString() == "int"
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, _ranked(docs, items, 10)))


def test_rank_of_nothing(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert ranked.rank(docs, items).count() == 0
    assert ranked.rank(spark.createDataFrame([(1, "a")], "doc_id long, text string"), items).count() == 0
    assert ranked.rank(docs, spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0


def test_shards_stop_early_and_lose_nothing(monkeypatch):
    """Many shards of one task give what a full count gives, and few postings of common terms are looked at."""
    rng = np.random.default_rng(3)
    vocabulary, docs, k = 50, 5_000, 10
    df = np.linspace(0.01, 0.9, vocabulary)
    weights = np.array([ranked.weight(int(x * docs), docs) for x in df])
    holds = rng.random((docs, vocabulary)) < df
    tf, lengths = rng.integers(1, 9, (docs, vocabulary)), rng.integers(20, 3000, docs)
    total = int(lengths.sum())
    items = [np.sort(rng.choice(vocabulary, 12, replace=False)) for _ in range(20)]
    rows = [(i, int(lengths[i]), np.flatnonzero(holds[i]).astype("<i4").tobytes(), tf[i][holds[i]].astype("<i4").tobytes()) for i in range(docs)]
    batches = [pa.record_batch([pa.array(c) for c in zip(*rows[a : a + 100], strict=True)], ["id", "n", "terms", "counts"]) for a in range(0, docs, 100)]
    monkeypatch.setattr(ranked, "SHARD_POSTINGS", 20_000)
    completed = []
    whole = ranked.Shard._complete
    monkeypatch.setattr(ranked.Shard, "_complete", lambda self, item, able, least: completed.append(len(able)) or whole(self, item, able, least))
    got = pa.Table.from_batches(ranked._search(SimpleNamespace(value=(weights, items, docs, total)), k)(iter(batches))).to_pylist()
    impact = ranked.impacts(weights, tf, lengths[:, None], docs, total) * holds
    for i, item in enumerate(items):
        score = impact[:, item].sum(axis=1)
        want = sorted((-int(s), d) for d, s in enumerate(score) if s > 0)[:k]
        assert [(-r["score"], r["id"]) for r in got if r["item"] == i] == want
    assert len(completed) > 20 and max(completed) <= ranked.FEW * k


# ---- decontamination ------------------------------------------------------------------------------------------


def _passages(text: str | None, items: list[tuple]) -> tuple[int, set[int], list[str], list[tuple[int, int]]]:
    places = [m.span() for m in TERM.finditer("".join(c.lower() if c.isascii() else c for c in text or ""))]
    words, hit, names = _terms(text), set(), set()
    for name, own in items:
        own = _terms(own)
        size = min(10, len(own))
        known = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if size else set()
        for i in range(len(words) - size + 1):
            if tuple(words[i : i + size]) in known:
                hit.update(range(i, i + size))
                names.add("" if name is None else str(name))
    return len(words), hit, sorted(names), [places[i] for i in sorted(hit)]


@pytest.mark.parametrize("piece, chars", [(1 << 22, 2_000_000), (40, 300)])
def test_find_passages(spark, monkeypatch, piece, chars):
    rng = random.Random(11)
    words = ["É", "ab", "c4", "日本", "Tom", "x"]
    make = lambda n: "".join(rng.choice(words) + rng.choice([" ", ", ", "\n", "__"]) for _ in range(n))
    items = [(i, make(rng.choice([0, 3, 9, 10, 11, 30, 60]))) for i in range(25)] + [(None, "the null item"), (30, None), (31, "..."), (32, "same"), (32, "other same"), (33, "x x x x x x x x x x x x x x x x")]
    docs = []
    for i in range(60):
        other = rng.choice(items)[1] or ""
        docs.append((i, make(rng.randint(0, 30)) + (other.upper() if i % 3 else "") + make(rng.randint(0, 30))))
    docs += [(60, None), (61, ""), (62, "The NULL, item! same-same"), (62, "x " * 300), (None, "ab" * 300)]
    monkeypatch.setattr(decontaminate, "AUTOMATON_CHARS", chars)
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("items", F.lit(1))
    got = decontaminate.find_passages(frame, spark.createDataFrame(items, "item_id int, text string")).collect()
    assert len(got) == len(docs)
    want = Counter()
    for i, text in docs:
        n, hit, names, places = _passages(text, items)
        want[(i, n, len(hit), tuple(names), tuple(text[a:b] for a, b in places))] += 1
    texts = defaultdict(list)
    for i, text in docs:
        texts[i].append(text or "")
    found = Counter()
    for r in got:
        # Rows that share an id are told apart by their number of words.
        text = next(t for t in texts[r.doc_id] if len(_terms(t)) == r.n_words)
        hits = tuple(x for s in r.spans for x in TERM.findall(text[s["start"] : s["end"]]))
        assert sum(s["after"] - s["first"] for s in r.spans) == r.n_hit
        found[(r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), hits)] += 1
    assert found == want
    monkeypatch.setattr(decontaminate, "PIECE", piece)
    passages = decontaminate.Passages([(n, (t or "").encode()) for n, (_, t) in enumerate(items)])
    for _, text in docs:
        data = (text or "").encode()
        hit, _ = passages.scan(data)
        n, wanted, _, places = _passages(text, items)
        assert len(hit) == n and {i for i, x in enumerate(hit) if x} == wanted
        spans = decontaminate.runs(hit)
        assert [(text or "")[a:b] for a, b in decontaminate.offsets(data, spans).tolist()] == [(text or "")[places[sorted(wanted).index(a)][0] : places[sorted(wanted).index(b - 1)][1]] for a, b in spans.tolist()]


def test_find_passages_of_nothing(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.n_hit, r["items"]) for r in decontaminate.find_passages(docs, items).collect()] == [(2, 0, [])]
    assert decontaminate.find_passages(docs.where("false"), docs.select(F.lit(1).alias("item_id"), "text")).count() == 0


# ---- as-of join -----------------------------------------------------------------------------------------------


def _latest(left: list[tuple], right: list[tuple], tolerance: int) -> Counter:
    out = Counter()
    by = defaultdict(list)
    for r in right:
        if r[0] is not None and r[1] is not None:
            by[r[0]].append(r)
    least = lambda x: (x is not None, x or 0)
    for name, key, at in left:
        able = [r for r in by[key] if at is not None and at - tolerance <= r[1] <= at] if key is not None else []
        top = max((r[1] for r in able), default=None)
        tied = [r for r in able if r[1] == top]
        best = max(tied, key=lambda r: (least(r[2]), least(r[3]))) if tied else (None,) * 4
        out[(name, key, at, best[1], len(tied), best[2], best[3])] += 1
    return out


@pytest.mark.parametrize("small, cells, few", [(2_000, 1024, 20_000), (5, 1024, 20_000), (5, 64, 0)])
def test_asof_join(spark, monkeypatch, small, cells, few):
    rng = random.Random(2)
    for name, value in (("SMALL", small), ("CELLS", cells), ("BROADCAST_CELLS", few), ("SHARD_ROWS", 64)):
        monkeypatch.setattr(asof, name, value)
    key = lambda: rng.choice([1, 1, 1, 1, 2, 3, 4, None])
    at = lambda: rng.choice([rng.randint(-300, 300), rng.randint(0, 3) * 24, None, 48, 48])
    left = [(i, key(), at()) for i in range(600)] + [(5, 1, 48)] * 40
    right = [(key(), at(), rng.choice([None, 1, 2, 3]), rng.choice([None, *range(9)])) for _ in range(300)] + [(4, 10, None, None), (9, 9, 1, 1)]
    a = spark.createDataFrame(left, "name long, key long, at long").withColumn("shard", F.col("name"))
    b = spark.createDataFrame(right, "key long, at long, p int, q int")
    for tolerance in (1, 24, 100):
        got = asof.asof_join(a, b, "key", "at", tolerance, [F.col("p"), F.col("q")], ["p", "q"])
        assert got.columns == ["name", "key", "at", "shard", "matched_at", "n_tied", "p", "q"]
        assert Counter(tuple(r) for r in got.drop("shard").collect()) == _latest(left, right, tolerance)
    assert asof.asof_join(a.where("false"), b, "key", "at", 1, [F.col("p")], ["q"]).count() == 0
    alone = asof.asof_join(a, b.where("false"), "key", "at", 1, [F.col("p")], ["q"]).collect()
    assert len(alone) == len(left) and all(r.n_tied == 0 and r.q is None and r.matched_at is None for r in alone)


def test_micros(spark):
    rows = spark.sql("SELECT timestamp_ntz'1969-12-31 23:59:59.999999' AS t UNION ALL SELECT timestamp_ntz'2024-03-31 02:30:00.000001' UNION ALL SELECT NULL")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        assert {r[0] for r in rows.select(asof.micros(F.col("t"))).collect()} == {-1, 1711852200000001, None}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize("name", ["op11_ranked", "op12_decontaminate", "op13_asof"])
def test_registered_query(spark, tmp_path, name):
    """Null ids and texts, copies, rows that tie, and columns that nothing asks for, against the query's own SQL."""
    docs = [(1, "The cat sat, on the mat and then it ran off home"), (1, "The cat sat, on the mat and then it ran off home"), (2, None), (None, "mat mat"), (3, "dog"), (4, "mat mat")]
    spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    items = [(1, "the cat sat on the mat and then it ran off"), (2, "Dog"), (2, "mat"), (None, "home"), (5, None), (6, "mat"), (6, "mat")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    time = lambda s: F.to_timestamp_ntz(F.lit(s))
    clicks = spark.range(40).select(F.col("id").alias("click_id"), time("2024-01-05 10:00:00").alias("ts"), F.pmod("id", F.lit(3)).alias("client_id"), F.lit("v").alias("kind"))
    broken = spark.range(4).select(F.lit(None).cast("long").alias("click_id"), time(None).alias("ts"), F.col("id").alias("client_id"), F.lit("v").alias("kind"))
    clicks.union(clicks.where("click_id < 9")).union(broken).write.parquet(f"{tmp_path}/clicks.parquet")
    sales = spark.range(60).select(F.when(F.col("id") < 59, F.col("id")).alias("sale_id"), F.when(F.col("id") % 7 > 0, F.col("id") % 3).alias("client_id"), (F.col("id") / 3).alias("total"),
        F.expr("timestampadd(HOUR, cast(id % 9 as int), timestamp_ntz'2024-01-05 06:00:00')").alias("sold_at"), F.when(F.col("id") % 5 > 0, (F.col("id") % 5).cast("int")).alias("priority"))
    sales.union(sales.where("sale_id = 4")).write.parquet(f"{tmp_path}/sales.parquet")
    con = duckdb.connect()
    for table in ("documents", "benchmark", "clicks", "sales"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
    got = queries.queries()[name](spark, str(tmp_path))
    found = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(got.columns)
    assert Counter(map(tuple, got.select(*columns).collect())) == Counter(found.fetchall())

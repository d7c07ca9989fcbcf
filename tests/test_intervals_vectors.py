"""Overlaps, segments and displayed spans against brute force; what the index of vectors finds."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from kgloom.functions.spans import SentenceTable, iter_sentences
from kgloom.operators import extraction as E
from kgloom.operators import intervals, vectors
from kgloom.queries import queries
from kgloom.session import store


def _spans(rng: random.Random, n: int, width: int):
    out = []
    for i in range(n):
        start = rng.randrange(width)
        out.append((rng.choice(["d", "d", "e", None]), i, start if rng.random() > 0.05 else None, start + rng.choice([0, 1, 2, 7, 8, 9, 300, -2]), rng.choice(["object", "subject", "subject", None])))
    return out + [out[0], ("d", 500, 0, 1_000_000, "object"), ("d", 501, 5, 5, "subject")]


def test_overlaps(spark):
    rng = random.Random(6)
    one, two = _spans(rng, 80, 400), _spans(rng, 60, 400)
    schema = "key string, id int, start int, end int, role string"
    a, b = spark.createDataFrame(one, schema).withColumnRenamed("id", "x"), spark.createDataFrame(two, schema).withColumnRenamed("id", "y")
    meets = lambda p, q: None not in (p[0], p[2], p[3], q[2], q[3]) and p[0] == q[0] and p[2] < q[3] and p[3] > q[2]
    assert sorted(tuple(r) for r in intervals.overlaps(a, b, "key", "start", "end", "x", "y").collect()) == sorted((p[0], p[1], q[1]) for p in one for q in two if meets(p, q))
    pairs = intervals.overlapping_pairs(spark.createDataFrame(one[:-3], schema), "key", "start", "end", "id").collect()
    assert sorted((r.a, r.b) for r in pairs) == sorted((p[1], q[1]) for p in one[:-3] for q in one[:-3] if p[1] < q[1] and meets(p, q))


def test_disjoint_spans_hardly_meet(spark):
    """One span over all others and 4,000 disjoint ones: rows that meet in a bin are linear in them."""
    n = 4000
    df = spark.range(n).select(F.lit(1).alias("key"), "id", (F.col("id") * 10).alias("start"), (F.col("id") * 10 + 1 + F.col("id") % 9).alias("end")).union(spark.sql(f"SELECT 1, {n}L, 0L, {n * 10}L"))
    assert intervals.overlapping_pairs(df, "key", "start", "end", "id").count() == n
    # Rows that share a bin, before their bounds are compared.
    spans, met = df.collect(), {}
    for s in spans:
        level = max((s.end - s.start - 1).bit_length(), 0)
        met.setdefault(level, []).append((s.start, s.end))
    rows = 0
    for level, own in met.items():
        bins = {}
        for a, b in own:
            for x in range(a >> level, ((b - 1) >> level) + 1):
                bins[x] = bins.get(x, 0) + 1
        for s in spans:
            if level >= (s.end - s.start - 1).bit_length():
                rows += sum(bins.get(x, 0) for x in range(s.start >> level, ((s.end - 1) >> level) + 1))
    assert rows <= 12 * n


def test_segments(spark, monkeypatch):
    """Blocks of any width give what each piece's covering spans say."""
    rng = random.Random(9)
    spans = _spans(rng, 60, 500)
    df = spark.createDataFrame(spans, "key string, id int, start int, end int, role string")
    good = [s for s in spans if s[2] is not None and s[2] < s[3]]
    want = []
    for key in {s[0] for s in good}:
        own = [s for s in good if s[0] == key]
        cuts = sorted({x for s in own for x in s[2:4]})
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            roles = {s[4] or "subject" for s in own if s[2] <= a and s[3] >= b}
            want.append((key, a, b, "object" if "object" in roles else "subject" if roles else None))
    for width in (1 << 16, 64):
        monkeypatch.setattr(intervals, "BLOCK", width)
        got = intervals.segments(df.where("key is not null"), "key", "start", "end", "role", store).collect()
        assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, (w for w in want if w[0] is not None)))


def test_shown_spans(spark):
    rows = [(1, "a", "S", "lit", "literal", 5, 9), (1, "b", "S", "T", "iri", 1, 2), (1, "c", "T", "lit", "literal", 3, 4), (1, "d", "S", "lit", "literal", 5, 9), (2, "e", "S", "T", "iri", 7, 8), (1, "f", "S", "lit", "literal", None, None)]
    df = spark.createDataFrame(rows, "doc_id int, stmt_id string, s string, o string, o_kind string, span_start int, span_end int")
    got = {}
    for r in intervals.shown_spans(df, df).collect():
        got.setdefault(r.stmt_id, set()).add((r["rank"], r.role, r.span_start, r.span_end))
    assert got["a"] == {(0, "object", 5, 9), (1, "subject", 1, 2)}
    assert got["b"] == {(1, "subject", 5, 9), (1, "subject", 1, 2), (2, "object", 3, 4)}
    assert got["e"] == {(1, "subject", 7, 8)} and got["f"] == {(1, "subject", 5, 9), (1, "subject", 1, 2)}


def test_recall_of_nearest_vectors(spark):
    """Of the true neighbours at least nine in ten, on the driver's vectors and on random ones; the exact way finds all."""
    folder = "/root/testdata/sf0.01"
    both = [{(r.a, r.b) for r in queries()[n](spark, folder).collect()} for n in ("nearest_vectors", "nearest_exact")]
    assert len(both[0] & both[1]) >= 0.9 * len(both[1]) > 0
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 16))
    df = spark.createDataFrame([(i, [float(v) for v in row], i % 2) for i, row in enumerate(x)], "vec_id long, embedding array<float>, label int")
    asks = df.where("vec_id % 25 = 0")
    near, exact = ({(r.a, r.b) for r in vectors.nearest(df, asks, 10, exact=e).collect()} for e in (False, True))
    few = {(r.a, r.b) for r in vectors.nearest(df, asks, 10, cells=16, probes=10).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(a, int(b)) for a in range(0, 1500, 25) for b in [j for j in np.argsort(-unit @ unit[a]) if j != a and j % 2 == a % 2][:10]}
    assert len(exact & want) >= len(want) - 2 and len(near & want) >= 0.9 * len(want)
    assert 0.9 * len(want) <= len(few & want) < len(want)


def test_vectors_without_neighbours(spark):
    rows = [(1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [0.0, 0.0], 0), (4, None, 0), (5, [1.0, 1.0], None), (6, [1.0, 1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    for exact in (False, True):
        got = {(r.a, r["rank"], r.b, round(r.score, 6)) for r in vectors.nearest(df, df, 5, exact=exact).collect()}
        assert got == {(1, 1, 2, 1.0), (1, 2, 3, 0.0), (2, 1, 1, 1.0), (2, 2, 3, 0.0), (3, 1, 1, 0.0), (3, 2, 2, 0.0)}
        assert vectors.nearest(df.where("false"), df.where("false"), 5, exact=exact).count() == 0


def test_long_texts_become_rows_one_by_one(spark):
    """A text of 6 MB: its sentences and chunks come as rows, and only one of them is held at a time."""
    import tracemalloc

    text = "Some words of Dr. No elsewhere. " * 200_000
    for rows, least in ((iter_sentences(text), 200_000), (E.iter_chunks(text, 500), 12_000)):
        tracemalloc.start()
        assert sum(1 for _ in rows) >= least
        assert tracemalloc.get_traced_memory()[1] < 1_000_000
        tracemalloc.stop()
    df = spark.createDataFrame([(1, "A b. C d.\n\nE"), (2, None), (3, "")], "id int, text string")
    got = df.lateralJoin(SentenceTable(F.col("text").outer())).drop(df.text).collect()
    assert sorted((r.id, r.n) for r in got)[0] == (1, 0) and {r.id for r in got} == {1}
    pieces = df.lateralJoin(E.ChunkTable(F.col("text").outer(), F.lit(4))).collect()
    assert "".join(r.chunk for r in sorted(pieces, key=lambda r: r.n)) == "A b. C d.\n\nE"

"""Duplicates of all kinds against brute force, on rows with nulls, ties, repeats, long and empty texts."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgloom.llm import exact, near, substring, words

SCHEMA = "doc_id long, text string, lang string, kept string"


def _prose(rng: random.Random, n: int) -> list[str]:
    return [f"w{rng.randrange(4000)}" for _ in range(n)]


@pytest.fixture(scope="module")
def rows() -> list[tuple]:
    rng = random.Random(5)
    base, passage, long = _prose(rng, 160), _prose(rng, 60), _prose(rng, 30_000)
    texts: list[str | None] = [None, "", " \n\t ", "one two", "One  TWO", "one two three four five"]
    for i in range(25):  # a family of near copies, and exact copies of some of them
        near_copy = list(base)
        for _ in range(i % 7):
            near_copy[rng.randrange(160)] = f"edit{rng.randrange(10**6)}"
        texts += [" ".join(near_copy)] * (1 + i % 3)
    for _ in range(20):  # a passage that many documents share
        texts.append(" ".join(_prose(rng, rng.randrange(5, 80)) + passage + _prose(rng, rng.randrange(5, 80))))
    texts += [" ".join(_prose(rng, 120)) for _ in range(20)]
    texts += [" ".join(long), " ".join(long[:20_000]), "a " * 300, "é\u00a0" * 80, "x\x1cy " * 60]
    rng.shuffle(texts)
    out = [(i * 3 % 101 if i % 17 else None, t, "en", "mine") for i, t in enumerate(texts)]
    return out + [out[3], out[3], out[10]]


def _windows(text: str | None, size: int) -> tuple[list[bytes], list[tuple]]:
    w = (text or "").encode().replace(b"\x1c", b"\x1c").split(b" ")
    w = [x for chunk in w for x in chunk.split() if x]
    return w, [tuple(w[i : i + size]) for i in range(len(w) - size + 1)]


def test_exact(spark, rows):
    got = exact.exact_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    groups: dict[str, list] = {}
    for i, text, *_ in rows:
        groups.setdefault(text or "", []).append(i)
    assert len(got) == len(rows)
    top = lambda ids: max((i for i in ids if i is not None), default=None)
    expected = sorted((str(i), str(top(groups[t or ""])), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in rows)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == expected
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) == len({r.text_sha256 for r in kept}) and all(r.doc_id == r.keep_id for r in kept)


def test_exact_stage_keeps_columns_and_one_row(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    out = exact.drop_duplicates(df)
    assert out.columns == df.columns
    assert out.count() == len({t or "" for _, t, *_ in rows})


def test_exact_where_digests_fail(spark, rows, monkeypatch):
    """With digests that collide all the time, bytes decide, and no row is lost."""
    monkeypatch.setattr(exact, "digest_of", lambda text: F.unhex(F.sha2(F.length(F.coalesce(text, F.lit(""))).cast("string"), 256)))
    df = spark.createDataFrame(rows, SCHEMA)
    groups: dict[str, list] = {}
    for i, text, *_ in rows:
        groups.setdefault(text or "", []).append(i)
    assert len({len(t) for t in groups}) < len(groups)
    got = exact.exact_duplicates(df).collect()
    top = lambda ids: max((i for i in ids if i is not None), default=None)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size) for r in got) == sorted((str(i), str(top(groups[t or ""])), len(groups[t or ""])) for i, t, *_ in rows)
    assert sum(r.kept for r in got) == len(groups)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in exact.drop_duplicates(df).collect()) == sorted((top(ids) is None, top(ids) or 0, t) for t, ids in groups.items())


def test_one_order_and_two_texts(spark):
    """Rows that share their order, or are null in it, are told apart by their texts in all three."""
    rows = [(None, "a b c d e f"), (None, "g h i j k l"), (1, "m n o p q"), (1, "r s t u v"), (None, None), (None, "")]
    df = spark.createDataFrame([(*r, "en", "x", 1) for r in rows], "doc_id long, text string, lang string, `a.b` string, __row int")
    for run in (exact.drop_duplicates, near.drop_duplicates):
        got = run(df)
        assert got.columns == df.columns
        texts = sorted(r.text or "" for r in got.collect())
        assert texts == sorted({t or "" for _, t in rows} if run is exact.drop_duplicates else [t or "" for _, t in rows])
    assert substring.remove_repeats(df).count() == len(rows)


def test_near_stage_agrees_with_the_operator(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    assert near.drop_duplicates(df).count() == near.near_duplicates(df).where("kept").count()


@pytest.mark.parametrize("values", [[], [0], [5], [0, 1, 2, 3], sorted(random.Random(1).sample(range(1 << 40), 500))])
def test_golomb_round_trip(values):
    for bits in (0, 3, 17, 30) if len(values) < 100 else (26, 33):
        data = exact.golomb_encode(np.array(values, np.uint64), bits) if max(values, default=0) >> bits < 1 << 20 else None
        if data is not None:
            assert exact.golomb_decode(data, bits).tolist() == values


def _near(rows) -> dict[int, int]:
    sets = []
    for _, text, *_ in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least: dict[int, list] = {}
    for i in range(len(rows)):
        least.setdefault(find(i), []).append(rows[i][0])
    return [(str(rows[i][0]), len(sets[i]), str(min((x for x in least[find(i)] if x is not None), default=None))) for i in range(len(rows))]


def test_near(spark, rows):
    got = near.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == sorted(_near(rows))
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_in_many_blocks(spark, rows, monkeypatch):
    """Buckets and clusters of several blocks have the same components."""
    monkeypatch.setattr(near, "BLOCK", 3)
    monkeypatch.setattr(near, "SLICE", 2)
    got = near.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == sorted(_near(rows))


def test_near_in_groups_that_are_dealt_again(spark, rows, monkeypatch):
    """Where many members are outside of the largest component, groups are dealt by further bands, and nothing is lost."""
    monkeypatch.setattr(near, "BLOCK", 2)
    monkeypatch.setattr(near, "FEW", 2)
    dealt, finer = [], near._finer
    monkeypatch.setattr(near, "_finer", lambda *a: dealt.append(1) or finer(*a))
    some = rows[:40]
    got = near.near_duplicates(spark.createDataFrame(some, SCHEMA)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == sorted(_near(some))
    assert dealt


def test_a_row_that_repeats_often(spark, monkeypatch):
    """Its text is looked at once: by sketches and shingles, and by windows."""
    rng = random.Random(8)
    text, other = _prose(rng, 80), _prose(rng, 70)
    rows = [(1, " ".join(text))] * 500 + [(2, " ".join(text[:79] + ["x"])), (3, " ".join(other)), (4, " ".join(other + ["y"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near.near_duplicates(df)
    assert sorted((r.doc_id, r.component_id, r["count"]) for r in got.groupBy("doc_id", "component_id").count().collect()) == [(1, 1, 500), (2, 1, 1), (3, 3, 1), (4, 3, 1)]
    removed = substring.remove_repeats(df, 50).groupBy("doc_id", "n_removed").count().collect()
    assert sorted(tuple(r) for r in removed) == [(1, 0, 500), (2, 79, 1), (3, 0, 1), (4, 70, 1)]


def test_estimates_are_close():
    rng = np.random.default_rng(2)
    for share in (0.3, 0.6, 0.75, 0.9):
        a = np.unique(rng.integers(0, 1 << 62, 3000, dtype=np.uint64))
        k = round(3000 * 2 * share / (1 + share))
        b = np.unique(np.concatenate([a[:k], rng.integers(0, 1 << 62, 3000 - k, dtype=np.uint64)]))
        found = near.estimate(near.registers([a]), near.registers([b]), np.array([len(a)]), np.array([len(b)]))[0]
        assert abs(found - k / (len(a) + len(b) - k)) < 0.13
    merged = np.maximum(near.registers([a]), near.registers([b]))
    assert (merged == near.registers([np.union1d(a, b)])).all()


def _repeats(rows, size: int):
    first: dict[tuple, int] = {}
    order = lambda i: substring.LAST if i is None else i
    for i, text, *_ in rows:
        for w in _windows(text, size)[1]:
            first[w] = min(first.get(w, substring.LAST), order(i))
    out = []
    for i, text, *_ in rows:
        w, windows = _windows(text, size)
        gone = [False] * len(w)
        for k, x in enumerate(windows):
            if first[x] < order(i):
                gone[k : k + size] = [True] * size
        out.append((str(i), len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return sorted(out)


def test_substring(spark, rows):
    got = substring.remove_repeats(spark.createDataFrame(rows, SCHEMA), 50, with_text=True).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == _repeats(rows, 50)
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got)


def test_substring_in_small_shards(spark, rows, monkeypatch):
    """Minimizers whose stretches fill several shards have the same results."""
    monkeypatch.setattr(substring, "SHARD_WORDS", 90)
    got = substring.remove_repeats(spark.createDataFrame(rows, SCHEMA), 50).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == _repeats(rows, 50)


def test_automaton_against_brute_force():
    rng = random.Random(3)
    for size in (2, 5):
        sequences = [[rng.randrange(3) for _ in range(rng.randrange(1, 30))] for _ in range(40)]
        labels = [rng.randrange(20) for _ in sequences]
        automaton = substring.SuffixAutomaton.of(sequences, labels)
        asked = [*sequences, [2, 2, 2, 0, 1, 0, 1, 2] * 3, [], [0, 1, -1, 1, 2, 0, -1, 0, 0, 1, 2, 1]]
        for s, found in zip(asked, automaton.least([np.array(x, np.int64) for x in asked], size), strict=True):
            want = [min((x for t, x in zip(sequences, labels, strict=True) if any(t[k : k + size] == s[i : i + size] for k in range(len(t) - size + 1))), default=substring.LAST) for i in range(len(s) - size + 1)]
            assert found.tolist() == want


@pytest.mark.parametrize("run", [exact.exact_duplicates, near.near_duplicates, substring.remove_repeats])
def test_empty_table(spark, run):
    assert run(spark.createDataFrame([], SCHEMA)).count() == 0


def test_word_hashes():
    texts = [b"", b"  ", b"a b\tc", "é ü  a".encode(), b"a"]
    hashes, starts, ends, bounds = words.word_hashes(texts)
    joined = b" ".join(texts)
    found = [joined[a:b] for a, b in zip(starts, ends, strict=True)]
    assert found == [w for t in texts for w in t.split()] and bounds.tolist() == [0, 0, 0, 3, 6, 7]
    assert hashes[0] == hashes[5] == hashes[6] and len(set(hashes.tolist())) == 5
    assert substring.sliding_min(np.array([5, 3, 4, 1, 7]), 3).tolist() == [3, 1, 1]

"""Registered queries against brute force on small tables; columns of any names; very long texts; recall of candidates."""

from __future__ import annotations

import hashlib
import heapq
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgloom.llm import chat, common, exact, html, mixing, near, packing, quality, queries, sharding, substring, urls, words

TEXTS = [None, "", " \n", "Hello, world. It's 12 o'clock!", "a b c " * 400, "é Ünï ÀÉ ﬁn", "same", "same", "same"] + [f"text {i} " + "word " * (i * 7 % 50) for i in range(60)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("small")
    rows = [(i if i != 20 else None, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None, len(t or "")) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return str(out), rows


def test_op1_pieces(spark, folder):
    from tokenizers import Tokenizer

    path, rows = folder
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    got = queries.op1_packing(spark, path).collect()
    whole = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, queries.PACK_END] for i, t, *_ in rows}
    by, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
        assert r.ids_crc32 == zlib.crc32(np.array(whole[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) and r.doc_tokens == len(whole[r.doc_id])
    assert {i: sorted((r.start, r.length) for r in rs)[0][0] for i, rs in by.items()} == dict.fromkeys(whole, 0)
    assert all(sum(r.length for r in by[i]) == len(x) for i, x in whole.items()) and all(sum(r.length for r in s) <= queries.PACK_WINDOW for s in sequences.values())


def test_op3_without_labels(spark, folder):
    """No labels prove no cutoff, so only the base rules reject."""
    got = queries.op3_quality(spark, folder[0]).collect()
    assert len(got) == len(TEXTS) and all(r.kept == (not r.base_failed) for r in got)


def test_op5_columns(spark, folder):
    path, rows = folder
    got = queries.op5_sharding(spark, path).collect()
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None} and all(0 <= r.shard < queries.SHARDS for r in got)
    homes, slots = defaultdict(set), defaultdict(list)
    for r in got:
        homes[r.text_crc32].add(r.shard)
        slots[r.shard].append(r.slot)
    assert all(len(h) == 1 for h in homes.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    again = queries.op5_sharding(spark, path).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_sharding_is_longest_first_where_all_groups_are_large(spark):
    """With few groups every one is scheduled by itself, so the schedule is the textbook's."""
    rng = random.Random(4)
    sizes = {g: rng.choice([50, 70, 90, 110]) for g in range(40)}
    rows = [(g, n // 2) for g, n in sizes.items() for _ in range(2)]
    got = {r.g: r.shard for r in sharding.assign_shards(spark.createDataFrame(rows, "g long, n long"), 3, "g", "n").collect()}
    heap, want = [(0, s) for s in range(3)], {}
    for g, n in sorted(((g, 2 * (n // 2)) for g, n in sizes.items()), key=lambda x: (-x[1], str(x[0]))):
        load, shard = heapq.heappop(heap)
        want[g] = shard
        heapq.heappush(heap, (load + n, shard))
    assert got == want


# ---- names ------------------------------------------------------------------------------------------------------

ODD = "`a.b` string, `a b` int, __s string, __row int, `row` struct<`x y`:int,`z.w`:string>, __id long, `__block` int, g long, stratum string, cutoff_symbol_share double"
EXTRA = ("q", 3, "s", 4, (5, "t"), 6, 7, 8, "st", 0.5)


def _odd(spark, rows: list[tuple], schema: str):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], f"{schema}, {ODD}")


def test_columns_of_any_name_are_kept(spark):
    docs = [(1, "a b c d e f g h i j k", "en", "s"), (1, "a b c d e f g h i j k", "en", "s"), (2, "l m n o p q r s t u v", None, None), (3, None, "en", "s")]
    df = _odd(spark, docs, "doc_id long, text string, lang string, source string")
    names = [f.name for f in df.schema if f.name not in ("doc_id", "text", "lang", "source")]
    metrics = quality.with_metrics(df)
    cutoffs = quality.learn(metrics, spark.createDataFrame([(1, 1), (2, None)], "doc_id long, quality int"), "lang", text_key="text")
    sized = df.withColumn("size", F.length("text").cast("long"))
    made = {
        "metrics": metrics, "judge": quality.judge(metrics, cutoffs, "lang"), "exact": exact.drop_duplicates(df), "near": near.drop_duplicates(df),
        "mix": mixing.mix(sized, [5, 2, 1]), "repeat": mixing.repeat_rows(mixing.mix(sized, [5, 2, 1])), "shards": sharding.assign_shards(sized, 2, "doc_id", "size"),
        "number": common.number_within(df, "doc_id", ["lang", "text"], "place"), "total": common.running_total(sized, "size", "doc_id", "upto"),
        "urls": urls.filter_urls(df, spark.createDataFrame(queries.URL_RULES, urls.RULE_SCHEMA), url="text"), "html": html.extract_text(df, page="text"),
    }
    for name, out in made.items():
        assert [c for c in out.columns if c in names] == names, name
        assert {tuple(r[c] for c in names) for r in out.collect()} == {EXTRA}, name
    assert {n: made[n].count() for n in ("metrics", "judge", "exact", "near", "mix", "shards", "number", "urls", "html")} == {"metrics": 4, "judge": 4, "exact": 3, "near": 4, "mix": 4, "shards": 4, "number": 4, "urls": 4, "html": 4}


def test_columns_named_oddly_are_read(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f")], "`my.id` long, `the text` string")
    assert [r.kept for r in exact.exact_duplicates(df, "the text", "my.id").orderBy("`my.id`").collect()] == [False, True]
    assert [r.kept for r in near.near_duplicates(df, "the text", "my.id").orderBy("`my.id`").collect()] == [True, False]
    assert substring.remove_repeats(df, 3, "the text", "my.id").agg(F.sum("n_removed")).first()[0] == 6


# ---- very long texts ----------------------------------------------------------------------------------------------


def test_very_long_texts(spark):
    """Two megabytes of words, one word of a megabyte, and copies of both."""
    rng = random.Random(6)
    prose = " ".join(f"w{rng.randrange(10**6)}" for _ in range(250_000))
    rows = [(1, prose), (2, prose + " end"), (3, "x" * 1_000_000), (4, "x" * 1_000_000), (5, " " * 1_000_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in near.near_duplicates(df).collect()}
    assert [got[i].component_id for i in range(1, 6)] == [1, 1, 3, 3, 5] and got[1].n_shingles == len(set(zip(*[prose.split()[k:] for k in range(5)], strict=False)))
    removed = {r.doc_id: (r.n_words, r.n_removed) for r in substring.remove_repeats(df).collect()}
    assert removed == {1: (250_000, 0), 2: (250_001, 250_000), 3: (1, 0), 4: (1, 0), 5: (0, 0)}
    assert sorted(r.kept for r in exact.exact_duplicates(df).collect()) == [False] + [True] * 4


def test_words_in_pieces(monkeypatch):
    """Words are the same however a text is cut to look at it, and no polynomial of their letters."""
    rng = random.Random(9)
    texts = [" ".join("".join(rng.choice("ab\x00é") for _ in range(rng.randrange(1, 20))) for _ in range(80)).encode(), b"", b"\t\n ", b"12345678 1234567 12345678\x00 1234567\x00"]
    whole = words.word_hashes(texts)
    monkeypatch.setattr(words, "PIECE", 7)
    for a, b in zip(whole, words.word_hashes(texts), strict=True):
        assert (a == b).all()
    found = [b" ".join(texts)[a:b] for a, b in zip(whole[1], whole[2], strict=True)]
    assert found == [w for t in texts for w in t.split()] and len(set(zip(found, whole[0].tolist(), strict=True))) == len(set(found)) == len(set(whole[0].tolist()))
    morse = "0"
    while len(morse) < 4096:
        morse += morse.translate(str.maketrans("01", "10"))
    pair = [morse.replace("0", "a").replace("1", "b").encode(), morse.replace("0", "b").replace("1", "a").encode()]
    assert len(set(words.word_hashes(pair)[0].tolist())) == 2 and (words.word_hashes(pair, key=1)[0] != words.word_hashes(pair)[0]).all()


# ---- recall -------------------------------------------------------------------------------------------------------


def test_recall_of_links_just_above_the_bound():
    """Of 10,000 pairs of similarity 0.75 to 0.80 all but a few share a band and pass the estimate."""
    rng = np.random.default_rng(3)
    missed_bands = missed_estimate = 0
    for _ in range(20):
        a_sets, b_sets = [], []
        for _ in range(500):
            n, share = int(rng.integers(60, 140)), rng.uniform(0.75, 0.80)
            common_part = int(np.ceil(2 * n * share / (1 + share)))
            both = rng.integers(0, 1 << 63, common_part, dtype=np.uint64)
            a_sets.append(np.concatenate([both, rng.integers(0, 1 << 63, n - common_part, dtype=np.uint64)]))
            b_sets.append(np.concatenate([both, rng.integers(0, 1 << 63, n - common_part, dtype=np.uint64)]))
        a, b = near.registers(a_sets), near.registers(b_sets)
        bands = (a.reshape(-1, near.BANDS, near.ROWS) == b.reshape(-1, near.BANDS, near.ROWS)).all(axis=2).any(axis=1)
        sizes = np.array([len(x) for x in a_sets], float)
        fits = (near.estimate(a, b, sizes, sizes) >= near.ESTIMATE) & ((a == b).sum(axis=1) >= near.LEAST_EQUAL)
        missed_bands += int((~bands).sum())
        missed_estimate += int((~fits).sum())
    assert missed_bands + missed_estimate <= 10, (missed_bands, missed_estimate)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    metrics = quality.with_metrics(docs)
    cutoffs = quality.learn(metrics, spark.createDataFrame([], "doc_id long, quality int"), "lang")
    assert quality.judge(metrics, cutoffs, "lang").count() == 0 and cutoffs.count() == 0
    assert common.number_within(docs, "lang", ["doc_id"], "place").count() == 0 and mixing.repeat_rows(docs.withColumns({"size": F.lit(1), "taken": F.lit(1)})).count() == 0
    assert packing.pack(docs, queries.tokenizer_path()).count() == 0 and hashlib.sha256(b"").hexdigest() and chat.canonical({}) == "{}"

"""Packing, chat, quality, URLs, sharding, mixing and HTML against brute force and exact round trips."""

from __future__ import annotations

import json
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgloom.llm import chat, common, mixing, packing, quality, queries, sharding, urls

TEXTS = [None, "", " \n", "Hello, world. It's 12 o'clock!", "a b c " * 3000, "é Ünï ÀÉ ﬁn σας ΣΑΣ", "x\x1cy <|endoftext|> z", "日本語 テスト", "same", "same"]


# ---- packing --------------------------------------------------------------------------------------------------


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    rng = random.Random(1)
    rows = [(i, t, 7) for i, t in enumerate(TEXTS)] + [(100 + i, " ".join(f"w{rng.randrange(500)}" for _ in range(rng.randrange(1, 900))), 7) for i in range(60)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, n long"), queries.tokenizer_path(), 512, 2).collect()
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, text, _ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        mine = sorted(pieces[i], key=lambda r: r.start)
        assert [x for r in mine for x in np.frombuffer(r.ids, "<u4").tolist()] == ids
        assert all(r.doc_tokens == len(ids) and r.length == len(r.ids) // 4 for r in mine)
        assert [r.start for r in mine] == [sum(x.length for x in mine[:k]) for k in range(len(mine))]
    for found in sequences.values():
        found.sort(key=lambda r: r.offset)
        assert [r.offset for r in found] == [sum(x.length for x in found[:k]) for k in range(len(found))]
        assert sum(r.length for r in found) <= 512
    total = sum(r.length for r in got)
    assert len(sequences) <= math.ceil(total / 512) + 1


def test_packing_empty_and_repeated(spark):
    schema = "doc_id long, text string"
    assert packing.pack(spark.createDataFrame([], schema), queries.tokenizer_path()).count() == 0
    assert packing.pack(spark.createDataFrame([(None, "a b"), (None, "a b")], schema), queries.tokenizer_path()).count() == 2


def test_chunks_have_the_tokens_of_whole_texts():
    with open(queries.tokenizer_path()) as file:
        short = packing.ChunkTokenizer(file.read(), limit=50)
    texts = [t or "" for t in TEXTS] + ["we'll'd ___a-b É. é, ŉ ǅ ẞ ß", "'a'S B'VE ''s 'sx 1a2b \x7f \x00q", "한국어. ไทย नमस्ते ÅÅ", "e.g., ###%%% on,&&& ... ,, .", "İx I\u0307"]
    for t, got in zip(texts, short.texts(texts), strict=True):
        assert np.frombuffer(got, short.width).tolist() == short.inner.encode(t, add_special_tokens=False).ids, t


def test_chunks_of_every_code_point():
    """Each assigned code point by itself, between two letters and before a combining mark."""
    import unicodedata

    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    short, whole = packing.ChunkTokenizer(open(path, encoding="utf-8").read(), limit=10**7), Tokenizer.from_file(path)
    points = [chr(i) for i in range(0x110000) if unicodedata.category(chr(i)) not in ("Cn", "Co", "Cs")]
    for form in ("{}", "a{}b", "{}\u0301"):
        texts = [form.format(c) for c in points]
        for at in range(0, len(texts), 100_000):
            some = texts[at : at + 100_000]
            want = [np.array(e.ids, short.width).tobytes() for e in whole.encode_batch_fast(some, add_special_tokens=False)]
            wrong = [t for t, got, ids in zip(some, short.texts(some), want, strict=True) if got != ids]
            assert not wrong, [hex(ord(t[form.index("{")])) for t in wrong[:20]]


def test_mixing_with_a_table_of_weights(spark):
    """Sources that the table lacks, or names with no or a negative weight, keep their rows and give nothing; doubled weights count once."""
    docs = spark.createDataFrame([(1, "a", 10), (2, "b", 10), (3, None, 10), (4, "c", 10), (5, "d", 10)], "doc_id long, source string, size long")
    weights = spark.createDataFrame([("a", 1), ("a", 1), (None, 4), ("c", None), ("d", -1), ("x", 9)], "source string, weight int")
    got = {r.doc_id: (r.source_size, r.target, r.taken) for r in mixing.mix(docs, weights, 3).collect()}
    assert got == {1: (10, 20.0, 20), 2: (10, 0.0, 0), 3: (10, 30.0, 30), 4: (10, 0.0, 0), 5: (10, 0.0, 0)}
    alone = {r.doc_id: r.target for r in mixing.mix(docs, weights.where("false"), 3).collect()}
    assert alone == dict.fromkeys(range(1, 6), 0.0)


def test_null_group_is_a_group_of_its_own(spark):
    rows = spark.createDataFrame([(None, 100), (-1, 100), (None, 1), (-1, 1)], "g long, size long")
    got = sharding.assign_shards(rows, 2, "g", "size").collect()
    homes = {g: {r.shard for r in got if r.g == g} for g in (None, -1)}
    assert len(homes[None]) == len(homes[-1]) == 1 and homes[None] != homes[-1]


def test_sharding_of_small_groups_is_even(spark):
    """The path that large corpora take, groups in bundles: no shard far above the mean."""
    sizes = defaultdict(int)
    for r in queries.op5_sharding(spark, "/root/testdata/sf0.01").select("shard", "size").collect():
        sizes[r.shard] += r["size"]
    assert len(sizes) == queries.SHARDS and max(sizes.values()) <= 1.01 * sum(sizes.values()) / queries.SHARDS


def test_settings_of_writers_beside_each_other(spark):
    """Two threads that write at once leave the session as it was."""
    from concurrent.futures import ThreadPoolExecutor

    name = common._SmallBatches.name
    before = spark.conf.get(name)
    with ThreadPoolExecutor(4) as pool:
        assert sum(pool.map(lambda i: common.materialise(spark.range(i), "x").count(), range(12))) == 66
    assert spark.conf.get(name) == before and not common._SmallBatches.users


def test_nnls_is_optimal():
    rng = np.random.default_rng(0)
    for _ in range(20):
        a, b = rng.random((12, 30)), rng.random(12) * 10
        x = packing.nnls(a, b)
        gradient = a.T @ (b - a @ x)
        assert (x >= 0).all() and gradient.max() < 1e-6 and np.abs(gradient[x > 0]).max(initial=0) < 1e-6


def test_combinations_fill_the_window():
    shapes = packing.combinations(12)
    assert (shapes @ (np.arange(12) + 1) == 12).all() and ((shapes > 0).sum(axis=1) <= 3).all()
    assert len({tuple(s) for s in shapes}) == len(shapes)


# ---- chat -----------------------------------------------------------------------------------------------------


def test_chat_links(spark):
    schema = {"add": {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer"}, "b": {"type": "array", "items": {"type": "number"}}}, "additionalProperties": False}}
    calls = [
        (1, "x", 0, "add", '{"a": 1}', []), (1, "y", 1, "add", '{"a": "1", "c": 2}', ["x"]), (1, "z", 2, "add", "not json", ["y", "x", "gone"]), (1, "p", 3, "other", None, ["q"]), (1, "q", 4, "add", '{"b":[1,"x"],"a":2}', ["p"]),
        (2, "x", 0, "add", '{"a": 5}', None), (2, "x", 1, "add", '{"a": 6}', None), (None, "x", 0, "add", '{"a": 5}', None), (3, None, 0, "add", '{"a": 5}', ["x"]),
    ]
    results = [(1, "x", "é"), (1, "x", "a"), (1, "lost", "r"), (2, "x", None), (None, "x", "r"), (1, "z", "t")]
    got = chat.link_tool_calls(
        spark.createDataFrame(calls, "conv_id long, call_id string, position long, name string, arguments string, after array<string>").withColumn("status", F.lit("clash")),
        spark.createDataFrame(results, "conv_id long, call_id string, content string"), schema,
    ).collect()
    by = {(r.conv_id, r.call_id, r.position): r for r in got}
    assert len(got) == len(calls) + 2
    assert [(by[1, c, p].level, by[1, c, p].status, len(by[1, c, p].errors)) for c, p in (("x", 0), ("y", 1), ("z", 2), ("p", 3), ("q", 4))] == [(0, "linked", 0), (1, "unanswered", 2), (2, "linked", 1), (None, "cycle", 1), (None, "cycle", 1)]
    assert by[1, "x", 0].n_results == 2 and json.loads(by[1, "x", 0].json)["result"] == "a"
    assert by[1, "lost", None].status == by[None, "x", None].status == "orphan"
    assert by[None, "x", 0].status == by[3, None, 0].status == "unanswered"
    assert by[1, "x", 0].json == '{"arguments":{"a":1},"call_id":"x","level":0,"name":"add","result":"a","status":"linked"}'
    empty = chat.link_tool_calls(spark.createDataFrame([], "conv_id long, call_id string, position long, name string, arguments string, after array<string>"), spark.createDataFrame([], "conv_id long, call_id string, content string"), schema)
    assert empty.count() == 0


def test_chat_levels_of_any_graph(spark):
    rng = random.Random(11)
    graphs = {1: {i: [i - 1] for i in range(1, 90)}, 2: {i: rng.sample(range(i), min(i, 3)) for i in range(1, 40)}, 3: {i: [rng.randrange(12) for _ in range(2)] for i in range(12)}, 4: {0: [1], 1: [2], 2: [0], 3: [2, 4], 5: [4, 9]}}
    calls, expected = [], {}
    for conv, edges in graphs.items():
        nodes = set(edges) | {d for ds in edges.values() for d in ds}
        level: dict[int, int] = {}
        while ready := [n for n in nodes - level.keys() if all(d in level for d in edges.get(n, []))]:
            level |= {n: 1 + max((level[d] for d in edges.get(n, [])), default=-1) for n in ready}
        expected |= {(conv, str(n)): level.get(n) for n in nodes}
        calls += [(conv, str(n), rng.randrange(100), "f", "{}", [str(d) for d in edges.get(n, [])]) for n in nodes]
    df = spark.createDataFrame(calls, "conv_id long, call_id string, position long, name string, arguments string, after array<string>")
    got = chat.link_tool_calls(df, spark.createDataFrame([], "conv_id long, call_id string, content string"), {}).collect()
    assert {(r.conv_id, r.call_id): r.level for r in got} == expected


@pytest.mark.parametrize(
    ("text", "written"),
    [
        ('{"b":1.0,"a":[1e21,1e-7,0.000001,-0.0,123456789012345680000,1.5e300,-2.50,0.1,100.0,1E2]}', '{"a":[1e+21,1e-7,0.000001,0,123456789012345680000,1.5e+300,-2.5,0.1,100,100],"b":1}'), ('"\\ud800"', '"\\ud800"'),
        ('"\\ud83d\\ude00\\u0041\\/\\u0001é"', '"\U0001f600A/\\u0001é"'), ('{"\\udfff":1,"a":1,"a":2}', '{"a":2,"\\udfff":1}'), ("[" * 150 + "]" * 150, "[" * 150 + "]" * 150), ("9" * 5000, "9" * 5000), ("-0", "0"),
        ("1e400", None), ("-1e400", None), ("NaN", None), ("[Infinity]", None), ("[" * 100_000, None), ("[" * 100_000 + "]" * 100_000, None), ('{"a":' * 300 + "1" + "}" * 300, None), ("", None), (" ", None), ("01", None), ("\ufeff1", None), ("'a'", None),
    ],
)
def test_json_is_canonical_or_refused(text, written):
    if written is None:
        with pytest.raises(ValueError):
            chat.parse(text)
    else:
        assert chat.canonical(chat.parse(text)) == written and chat.canonical(chat.parse(written)) == written
        written.encode()


def test_chat_takes_any_text(spark):
    texts = ['{"prompt":"\\ud800"}', "[" * 100_000, "NaN", "1e400", "9" * 5000, "", None, '{"\\udc00":1}', '{"prompt":1.0}', "x" * 2_000_000]
    calls = spark.createDataFrame([(1, str(i), i, "f" if i % 2 else None, t, [], "clash") for i, t in enumerate(texts)], "conv_id long, call_id string, position long, name string, arguments string, after array<string>, `a.b` string")
    got = {r.position: r for r in chat.link_tool_calls(calls, spark.createDataFrame([(1, "0", "r"), (1, "0", "r")], "conv_id long, call_id string, content string"), {"f": {"type": "object", "additionalProperties": False}}).collect()}
    assert len(got) == len(texts) and all(chat.parse(r.json)["call_id"] == r.call_id for r in got.values())
    assert got[0].json == '{"arguments":{"prompt":"\\ud800"},"call_id":"0","level":0,"name":null,"result":"r","status":"linked"}'
    assert [list(got[i].errors) for i in (1, 2, 3, 4, 5, 6, 7)] == [["$: too deep"], ["$: not JSON"], ["$: not JSON"], ["$: no schema of None"], ["$: not JSON"], ["$: no schema of None"], ["$.\\udc00: unknown"]]
    assert chat.parse(got[1].json)["arguments"] == texts[1] and got[8].json.startswith('{"arguments":{"prompt":1},')


# ---- quality --------------------------------------------------------------------------------------------------


def _metrics(text: str | None) -> tuple:
    w = [x for x in (text or "").replace("\n", " ").replace("\t", " ").split(" ") if x]
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count, hit = Counter(windows), [False] * len(w)
    for i, x in enumerate(windows):
        if count[x] > 1:
            hit[i : i + 5] = [True] * 5
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), sum(hit)


def test_quality_metrics(spark):
    rng = random.Random(4)
    texts = [*TEXTS, "line\nline\n\nline \nx", "a b c d e f a b c d e g", "a a a a a a", "# * $ %|&<>", "one\u00a0two"]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randrange(40))) for _ in range(60)]
    rows = [(i, t, "clash") for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in quality.with_metrics(spark.createDataFrame(rows, "doc_id long, text string, n_lines string")).collect()}
    for i, t, _ in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == _metrics(t), t
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)


def test_binomial_bound(spark):
    cases = [(0, 10, 0.3), (3, 40, 0.2), (50, 9000, 0.0066), (0, 1, 0.5), (200, 100_000, 0.003)]
    for k, n, p in cases:
        exact = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))
        got = spark.range(1).select(quality.binomial_tail(F.lit(k).cast("long"), F.lit(n).cast("long"), p)).first()[0]
        assert got == pytest.approx(exact, rel=1e-8)


def test_cutoffs_are_proven_by_stratum(spark):
    rng = random.Random(6)
    rows = []
    for i in range(6000):
        stratum, good = ("a", "b", None)[i % 3], i % 5 != 0
        share = 0.0 if good and stratum != "b" else rng.random()
        rows.append((i, stratum, good, share, 0.0, 0.0))
    df = spark.createDataFrame(rows, "doc_id long, lang string, good boolean, symbol_share double, dup_line_share double, repeat_share double")
    found = {(r.stratum, r.rule): r for r in quality.select_cutoffs(df, "lang", F.col("good"), risk=0.03).collect()}
    assert found["a", "symbol_share"].cutoff == found[None, "symbol_share"].cutoff == quality.SOFT_RULES["symbol_share"][-1]
    assert ("b", "symbol_share") not in found and found["b", "repeat_share"].n_rejected == 0
    assert quality.select_cutoffs(df.where("false"), "lang", F.col("good")).count() == 0


# ---- URLs -----------------------------------------------------------------------------------------------------

_RULES = [*queries.URL_RULES, ("block", "deep.example.net", "/en/x"), ("allow", "com", "/")]


def _judged(url: str | None) -> tuple:
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    path = rest[len(host) :].split("?")[0].split("#")[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in _RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    best = max(fits, key=lambda r: (len(r[1] + r[2]), len(r[1]), r[0] == "block"), default=None)
    return host, path, best and best[1] + best[2], best[0] if best else "allow"


def test_urls(spark):
    found = [None, "", "nothing", "http://", "http://NET/", "http://net", "http://x.net/a?b#c", "https://a.Example.net/en/1", "http://deep.example.net/en/xyz", "http://myexample.com/de/", "http://a.example.com/de/?x", "http://example.com/d", "ftp://x.org/fr/#/", "http://a..net/", "x://net/://", "http://x.net?/en/", "http://É.net/" + "a/" * 3000, "http://" + "a." * 500 + "org/fr/", "http://x.net/", "http://x.net/"]
    rows = [(i, u, "clash") for i, u in enumerate(found)] + [(1, None, "clash")]
    rules = spark.createDataFrame(_RULES, urls.RULE_SCHEMA)
    got = urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string, host string"), rules).collect()
    assert len(got) == len(rows)
    assert sorted(map(str, ((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got))) == sorted(map(str, ((i, *_judged(u)) for i, u, _ in rows)))
    none = urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string, host string"), rules.where("false"))
    assert {r.verdict for r in none.collect()} == {"allow"} and urls.filter_urls(spark.createDataFrame([], "page_id long, url string"), rules).count() == 0


# ---- sharding -------------------------------------------------------------------------------------------------


def test_sharding(spark):
    rng = random.Random(8)
    rows = [(i, int(10 ** (1 + 3 * rng.random())), i // 3 if i % 4 else i) for i in range(6000)] + [(9000 + i, 50, 77_777) for i in range(300)] + [(None, None, None), (1, 5, None), (1, 5, None)]
    placed = common.number_within(sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, size long, g long"), 6, "g", "size"), "shard", ["doc_id", "g"], "slot").collect()
    load, slots, homes = Counter(), defaultdict(list), defaultdict(set)
    for r in placed:
        load[r.shard] += r["size"] or 0
        slots[r.shard].append(r.slot)
        homes[r.g].add(r.shard)
    assert len(placed) == len(rows) and all(len(x) == 1 for x in homes.values())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(load.values()) - min(load[s] for s in range(6)) <= 0.01 * sum(load.values()) / 6
    empty = sharding.assign_shards(spark.createDataFrame([], "doc_id long, size long, g long"), 6, "g", "size")
    assert empty.count() == 0 and empty.schema["shard"].dataType.simpleString() == "int"


def test_least_loaded_is_longest_first():
    assert sharding.least_loaded([("a", 7), ("b", 6), ("c", 5), ("d", 4), ("e", 1)], 2) == {"a": 0, "b": 1, "c": 1, "d": 0, "e": 0}


# ---- mixing ---------------------------------------------------------------------------------------------------


def test_mixing(spark):
    rng = random.Random(9)
    sources = ["a"] * 700 + ["b"] * 20 + ["ä"] * 200 + [None] * 30 + ["zero"] * 3
    rows = [(i, s, None if s == "zero" else rng.randrange(1, 400), "t", -1.0) for i, s in enumerate(sources)] + [(5, "a", 9, "t", -1.0)] * 2
    df = spark.createDataFrame(rows, "doc_id long, source string, size long, text string, target double")
    got = mixing.mix(df, [5, 2, 1], 3).collect()
    size = Counter()
    for _, s, n, *_ in rows:
        size[s] += n or 0
    order = sorted((s for s in size if s), key=str) + [None]
    weight, target = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, {}
    while True:  # clamp, share the excess, repeat
        free = [s for s in size if s not in target]
        rest = sum(size.values()) - sum(target.values())
        over = [s for s in free if rest * weight[s] > 3 * size[s] * sum(weight[x] for x in free)]
        if not over:
            target |= {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
            break
        target |= {s: 3 * size[s] for s in over}
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
        assert r.target == pytest.approx(target[r.source]) and r.source_size == size[r.source] and 0 <= r.taken <= 3 * r["size"]
    assert len(got) == len(rows) and all(taken[s] == math.floor(target[s] + 1e-9) for s in size)
    again = mixing.mix(df.repartition(3), [5, 2, 1], 3).collect()
    key = lambda r: (r.doc_id, r["size"], r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    whole = mixing.repeat_rows(spark.createDataFrame([(1, 10, 25), (2, 10, 24), (3, 10, 4), (4, 0, 0)], "doc_id long, size long, taken long")).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in whole} == {1: 3, 2: 2}
    assert mixing.mix(df.where("false"), [5, 2, 1]).count() == 0

"""The stages of the pipeline one after the other, each against brute force on what the one before it kept."""

from __future__ import annotations

import random

import numpy as np
import pytest

import corpus_pipeline
from kgloom.llm import common, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, target double, n_words string, kept boolean, __i long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents whose columns clash with what the operators call theirs."""
    rng = random.Random(12)
    prose = lambda n: " ".join(f"w{rng.randrange(900)}" for _ in range(n))
    texts: list[str | None] = [None, "", "too few words", "again and again " * 30] + [prose(rng.randrange(10, 300)) for _ in range(60)]
    base = prose(120).split()
    texts += [" ".join([*base[:k], "edit", *base[k + 1 :]]) for k in range(0, 60, 10)] + [texts[10], texts[10], texts[11]]
    rows = [(i, t, "en" if i % 7 else None, f"s{i % 4}" if i % 5 else None, len(t or ""), "size", -1.0, "n", False, 7) for i, t in enumerate(texts)]
    out = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return str(out), rows


def test_stages(spark, folder):
    path, rows = folder
    docs, stages = common.documents(spark, path), dict(corpus_pipeline.STAGES)
    step = lambda name, df: common.materialise(stages[name](spark, df, path), name)

    good = step("quality", docs)
    words = lambda t: (t or "").split()
    windows = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    expected = [r for r in rows if len(words(r[1])) >= 10 and len(set(windows(words(r[1])))) == len(windows(words(r[1])))]
    assert good.columns == docs.columns and sorted(tuple(r) for r in good.collect()) == sorted(expected, key=lambda r: r[0])

    one = step("exact", good)
    top = {r[1]: r for r in sorted(expected, key=lambda r: r[0])}
    assert sorted(tuple(r) for r in one.collect()) == sorted(top.values())

    near = step("near", one)
    family = [r for r in top.values() if "edit" in r[1]]
    first = min(family)
    assert sorted(tuple(r) for r in near.collect()) == sorted([r for r in top.values() if "edit" not in r[1]] + [first])

    mixed = step("mix", near)
    kept = {r.doc_id: tuple(r) for r in near.collect()}
    times: dict[int, int] = {}
    for r in mixed.collect():
        assert tuple(r) == kept[r.doc_id]
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert max(times.values()) <= 3

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    got = stages["pack"](spark, mixed, path).collect()
    total = {i: len(tokenizer.encode(kept[i][1], add_special_tokens=False).ids) + 1 for i in times}
    assert sum(r.length for r in got) == sum(total[i] * n for i, n in times.items())
    assert all(len(np.frombuffer(r.ids, "<u4")) == r.length and r.doc_tokens == total[r.doc_id] for r in got)


def test_run_and_names(spark, folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact", "near", "mix", "pack"]
    assert corpus_pipeline.run(spark, folder[0]).count() > 0


def test_empty_table(spark, folder, tmp_path):
    docs = common.documents(spark, folder[0]).where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder[0]).count() == 0, name

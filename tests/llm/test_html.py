"""HTML extraction: hand-written pages, random trees against the scoring's definition, broken and deep pages in linear time."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from kgloom.llm import html, queries

_LONG = "A long paragraph, with commas, clauses, and more than enough words to be the main text of a page, as the scoring sees it."
PAGES = [
    (None, ""), ("", ""), ("   <br> ", ""), ("plain &lt;text&gt; &amp;&nbsp;more", "plain <text> & more"), ("<p>one<p>two", "one\ntwo"), ("<script>var x='<p>no</p>'</script><p>yes", "yes"),
    (f"<html><head><title>t</title></head><body><nav><a href=/>menu</a></nav><article><h1>Head</h1><p><b>bold.<br><p>{_LONG}</p></article><footer>foot</footer>", f"Head\nbold.\n{_LONG}"),
    (f'<body><header>Site</header><div id="main"><h2>H</h2><p>{_LONG}</p><p>short</p></div><div class="side"><ul><li><a href=1>link one, two</a></li></ul></div>', f"H\n{_LONG}\nshort"),
    (f'<main><p>{_LONG}</p><form><p>Name, please, and mail, here</p></form><section id="comments"><p>{_LONG} I liked it.</p></section><div class="cookie-notice"><p>{_LONG}</p></div></main>', _LONG),
    (f"<article><ul><li>a<li>b<ul><li>c</ul><li>d</ul><table><tr><td>1<td>2</table><p>{_LONG}</article>", f"a\nb\nc\nd\n1\n2\n{_LONG}"),
    (f'<div class="layout has-sidebar"><div id="content"><p>{_LONG}</p></div><div class="leftSidebar"><p>{_LONG}</p></div></div>', _LONG),
    ('<article><p>a <!-- <p>no</p> --> b</p><p title="x>y">c</p></article', "a b\nc"), ("<p>x</b></i></div>y</p>", "xy"), ("<" * 3, "<<<"), ("<div>" * 3000 + "deep", "deep"),
    # Names in context: what only sounds like a menu or a notice stays.
    (f'<article><header class="entry-header"><h1>T</h1></header><p>{_LONG}</p><p class="social-history">{_LONG}</p><h2 id="discussion">Discussion</h2><p>x</p></article>', f"T\n{_LONG}\n{_LONG}\nDiscussion\nx"),
    (f'<div id="content"><p>{_LONG}</p><section id="related-work"><h2>Related work</h2><p>{_LONG}</p></section><section id="notice"><h2>Notice</h2><p>{_LONG}</p></section></div>', f"{_LONG}\nRelated work\n{_LONG}\nNotice\n{_LONG}"),
    (f'<article><p>{_LONG}</p><div class="share-buttons">share</div><div class="related-posts"><a href=x>y</a></div><section id="related"><h2>Related</h2><ul><li><a href=1>read on</a></ul></section></article>', _LONG),
    (f'<div class="widget-7a"><p>{_LONG}</p><p>{_LONG}</p></div><div class="sidebar-x7"><p>side</p></div>', f"{_LONG}\n{_LONG}"),
    (f'<div><p>{_LONG}</p><div class="commentList"><p>{_LONG}</p><p>{_LONG}</p></div><article class="comment"><p>{_LONG}</p></article></div>', _LONG),
    (f'<article><p>{_LONG}</p><a href=/menu/>m</a> <span hidden>no</span><span data-id="ad" class=x>yes</span></article>', f"{_LONG}\nm yes"),
    ("<p>&#0000000065; &#99999999999999; &#x110000; &#xD800; &#x000041</p>", "A � � � A"), ("<p>a <b>x</p>", "a x"), ('<p>a <i title="never closed>b</i> <b>c</b></p>', "a b c"),
]


@pytest.mark.parametrize(("page", "text"), PAGES)
def test_page(page, text):
    assert html.extract(page) == text


def test_entities_of_any_length():
    assert html.extract("<p>x&#" + "9" * 100_000 + ";y &#x" + "f" * 100_000 + ";") == "x�y �"


BROKEN = {
    "starts": "<a " * 350_000, "quotes": '<a "' * 250_000, "deep": "<div>x" * 200_000, "spans": "<span><p>x" * 100_000, "swallowed": "<a b='>'" * 120_000, "comments": "<!-- " * 200_000,
    "scripts": "<script></script " * 60_000, "lists": "<ul><li>a" * 100_000, "attributes": "<a " + "b='" * 300_000 + ">x", "ends": "<b>" * 100_000 + "</i>" * 100_000, "cells": "<table><tr><td>x" * 60_000,
    "names": '<div class="sidebar-x7 x">y' * 50_000, "less": "<" * 1_000_000,
}


@pytest.mark.parametrize("kind", BROKEN)
def test_time_is_linear(kind):
    """A page of about a megabyte takes seconds; a quadratic step would take hours."""
    began = time.perf_counter()
    html.extract(BROKEN[kind])
    assert time.perf_counter() - began < 25


# ---- random trees by the definition -----------------------------------------------------------------------------

_BOXES, _LEAVES = ["div", "section", "article", "main", "ul", "nav", "div"], ["p", "h2", "p", "li", "td"]


def _grow(rng: random.Random, depth: int) -> tuple:
    """(tag, children): children are trees, or (text, in a link)."""
    if depth == 0 or rng.random() < 0.4:
        words = lambda: " ".join(rng.choice(["word", "other,", "more", "x"]) for _ in range(rng.randrange(1, 60)))
        return rng.choice(_LEAVES), [(words(), rng.random() < 0.2) for _ in range(rng.randrange(1, 3))]
    return rng.choice(_BOXES), [_grow(rng, depth - 1) for _ in range(rng.randrange(1, 4))]


def _write(tree: tuple) -> str:
    tag, children = tree
    return f"<{tag}>" + "".join((f"<a href=x>{c[0]}</a> " if c[1] else c[0] + " ") if isinstance(c[1], bool) else _write(c) for c in children) + f"</{tag}>"


def _brute(tree: tuple) -> str:
    """Every sum is taken over all paragraphs, by the paths from the root to them."""
    found = []  # (path of element ids, tags, text, link characters)

    def walk(node: tuple, path: tuple, tags: tuple) -> None:
        tag, children = node
        if tag == "nav":
            return
        path, tags = (*path, id(node)), (*tags, tag)
        if children and isinstance(children[0][1], bool):
            text = " ".join(c[0] for c in children)
            found.append((path, tags, text, min(len(text), sum(len(c[0]) for c in children if c[1]))))
            return
        for c in children:
            walk(c, path, tags)

    walk(tree, (), ())
    nodes, kinds, siblings = [], {}, {}

    def known(node: tuple, parent: int | None) -> None:
        nodes.append(id(node))
        kinds[id(node)] = node[0]
        siblings.setdefault(parent, []).append(id(node))
        for c in node[1]:
            if not isinstance(c[1], bool):
                known(c, id(node))

    known(tree, None)
    up = {n: p for p, ns in siblings.items() for n in ns}
    size = lambda n: sum(len(t) for p, _, t, _ in found if n in p)
    links = lambda n: sum(k for p, _, _, k in found if n in p)

    def score(n: int) -> float:
        out = 0.0
        for path, tags, text, k in found:
            if tags[-1] == "h2" or n not in path:
                continue
            chain = [x for x in reversed(path[:-1])]
            level = chain.index(n) + 1 if n in chain else 0
            if 1 <= level <= html.REACH:
                worth = (1 + text.count(",") + min(3, len(text) // 100)) * (1 - k / len(text)) * (0.2 if len(text) < 25 else 1)
                out += worth * (1 if level == 1 else 0.5 if level == 2 else 1 / (3 * level))
        return out

    final = lambda n: (score(n) + (25 if kinds[n] in ("article", "main") else 0)) * (1 - links(n) / size(n))
    order = []
    for path, *_ in found:
        order += [n for n in reversed(path) if n not in order and kinds[n] not in html.PARAGRAPH]
    if not order:
        return "\n".join(t for _, _, t, _ in found)
    best = max(order, key=final)
    at = best
    while at is not None:
        if kinds[at] in ("article", "main") and size(at) > links(at):
            best = at
            break
        at = up[at]
    least, kept = max(10.0, 0.2 * final(best)), {best}
    for n in siblings[up[best]]:
        if kinds[n] == "nav" or not size(n):
            continue
        density = links(n) / size(n)
        if kinds[best] in ("article", "main"):
            if kinds[n] == kinds[best] and final(n) >= max(least, 35):
                kept.add(n)
        elif kinds[n] == "h2" and density < 0.25 or score(n) * (1 - density) >= least or kinds[n] == "p" and size(n) > 80 and density < 0.25:
            kept.add(n)
    return "\n".join(t for path, _, t, _ in found if kept & set(path))


def test_random_trees_against_the_definition():
    rng = random.Random(4)
    for _ in range(400):
        tree = ("body", [_grow(rng, rng.randrange(1, 6)) for _ in range(rng.randrange(1, 4))])
        assert html.extract(_write(tree)) == _brute(tree), _write(tree)


# ---- tables -----------------------------------------------------------------------------------------------------


def test_table(spark):
    rows = [(i, p, "clash", 1, (2, "z")) for i, (p, _) in enumerate(PAGES)] + [(0, PAGES[6][0], "clash", 1, (2, "z"))] * 2
    got = html.extract_text(spark.createDataFrame(rows, "page_id long, html string, text string, `a.b` int, row struct<`a b`:int,`c.d`:string>"))
    assert got.columns == ["page_id", "a.b", "row", "text", "n_chars"]
    assert sorted((r.page_id, r.text, r.n_chars) for r in got.collect()) == sorted([(i, t, len(t)) for i, (_, t) in enumerate(PAGES)] + [(0, PAGES[6][1], len(PAGES[6][1]))] * 2)
    assert {(r["a.b"], tuple(r.row)) for r in got.collect()} == {(1, (2, "z"))}
    assert html.extract_text(spark.createDataFrame([], "page_id long, html string")).count() == 0
    assert html.extract_text(spark.createDataFrame([("<p>x",)], "html string")).first().asDict() == {"text": "x", "n_chars": 1}


def test_query(spark, tmp_path):
    spark.createDataFrame([(i, f"http://x/{i}", p) for i, (p, _) in enumerate(PAGES)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.op9_html(spark, str(tmp_path)).where(F.col("url") == F.concat(F.lit("http://x/"), "page_id")).collect()
    assert {r.page_id: (r.text, r.n_chars) for r in got} == {i: (t, len(t)) for i, (_, t) in enumerate(PAGES)}

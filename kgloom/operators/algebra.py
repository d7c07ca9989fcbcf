"""Query algebra over triples: patterns, joins, optional parts, unions, inline data, paths and updates.

A solution table has a column for each variable.  A variable's value is its lexical form; where kinds matter the
column ``<variable>_kind`` goes with it.  Everything is a DataFrame composition, so Catalyst sees the whole query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pattern(triples: DataFrame, s: str, p: str, o: str, g: str | None = None) -> DataFrame:
    """Solutions of one triple pattern: terms that start with ``?`` are variables, all others constants.

    Constants become filters (pushed to the scan); a variable that stands twice must have equal values.  ``g`` is the
    term for the graph of a table that has the column ``g``.
    """
    out, names = triples, {}
    for column, term in (("s", s), ("p", p), ("o", o), *((("g", g),) if g is not None else ())):
        if not term.startswith("?"):
            out = out.where(F.col(column) == term)
        elif term[1:] in names:
            out = out.where(F.col(column) == F.col(names[term[1:]]))
        else:
            names[term[1:]] = column
    return out.select(*[F.col(c).alias(v) for v, c in names.items()])


def natural_join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on all shared variables; without one every pair of solutions is compatible."""
    shared = [c for c in left.columns if c in right.columns]
    return left.join(right, shared, how) if shared else left.join(right, F.lit(True), "left" if how.startswith("left") else "inner")


def bgp(triples: DataFrame, patterns: Iterable[Sequence[str]]) -> DataFrame:
    """A basic graph pattern: the natural join of its patterns, those that share variables next to each other."""
    left = [pattern(triples, *x) for x in patterns]
    out = left.pop(0)
    while left:
        i = next((i for i, x in enumerate(left) if set(x.columns) & set(out.columns)), 0)
        out = natural_join(out, left.pop(i))
    return out


def optional(left: DataFrame, right: DataFrame, condition: Column | None = None) -> DataFrame:
    """``left`` with the compatible solutions of ``right`` where there are any; ``condition`` belongs to the join."""
    if condition is None:
        return natural_join(left, right, "left")
    shared = [c for c in left.columns if c in right.columns]
    renamed = right.select(*[F.col(c).alias(f"__{c}") if c in shared else F.col(c) for c in right.columns])
    on = reduce(lambda a, b: a & b, [left[c] == renamed[f"__{c}"] for c in shared], condition)
    return left.join(renamed, on, "left").drop(*[f"__{c}" for c in shared])


def union(*branches: DataFrame) -> DataFrame:
    """All solutions of all branches; variables that a branch lacks are unbound in it."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), branches)


def minus(left: DataFrame, right: DataFrame) -> DataFrame:
    shared = [c for c in left.columns if c in right.columns]
    return left.join(right.select(*shared).distinct(), shared, "left_anti") if shared else left


def exists(left: DataFrame, right: DataFrame, negated: bool = False) -> DataFrame:
    shared = [c for c in left.columns if c in right.columns]
    return left.join(right.select(*shared).distinct(), shared, "left_anti" if negated else "left_semi")


#: Inline data of up to this many rows is broadcast.
INLINE_ROWS = 10_000


def values(left: DataFrame, names: Sequence[str], rows: Sequence[Sequence[str]]) -> DataFrame:
    """Join with inline data; None is unbound and matches anything.

    Rows that leave the same variables unbound are joined together, on the others.  Beyond ``INLINE_ROWS`` the data
    isn't broadcast but joined like any table.
    """
    by: dict[tuple[str, ...], list[tuple]] = {}
    for row in rows:
        bound = tuple(n for n, x in zip(names, row, strict=True) if x is not None)
        by.setdefault(bound, []).append(tuple(x for x in row if x is not None))
    parts = []
    for bound, data in by.items():
        if not bound:
            parts += [left] * len(data)
            continue
        table = left.sparkSession.createDataFrame(data, ", ".join(f"`{n}` string" for n in bound))
        parts.append(natural_join(left, F.broadcast(table) if len(data) <= INLINE_ROWS else table))
    return union(*parts) if parts else left.where("false")


def term_order(name: str, kind: str | None = None) -> list[Column]:
    """Sort keys of a term: unbound, blank, IRI, literal; then the value by code point."""
    keys = [F.col(name).isNotNull()]
    if kind:
        keys.append(F.when(F.col(kind) == "blank", 0).when(F.col(kind) == "iri", 1).otherwise(2))
    return [*keys, F.col(name)]


def construct(solutions: DataFrame, template: Iterable[Sequence[str]]) -> DataFrame:
    """Distinct triples (s, p, o) of ``template``; solutions that leave a term unbound give none."""
    term = lambda t: F.col(t[1:]) if t.startswith("?") else F.lit(t)
    cells = F.array(*[F.struct(term(s).alias("s"), term(p).alias("p"), term(o).alias("o")) for s, p, o in template])
    return solutions.select(F.explode(cells).alias("t")).select("t.*").where("s is not null and p is not null and o is not null").distinct()


def construct_quads(solutions: DataFrame, template: Iterable[Sequence[str]]) -> DataFrame:
    """As ``construct`` for (g, s, p, o)."""
    term = lambda t: F.col(t[1:]) if t.startswith("?") else F.lit(t)
    cells = F.array(*[F.struct(*[term(x).alias(n) for n, x in zip("gspo", row, strict=True)]) for row in template])
    return solutions.select(F.explode(cells).alias("t")).select("t.*").where("g is not null and s is not null and p is not null and o is not null").distinct()


def drop_graph(quads: DataFrame, graph: str) -> DataFrame:
    """``quads`` (g, s, p, o) without a graph; one that isn't there is no error.  A null graph is the default one and stays."""
    return quads.where(~F.col("g").eqNullSafe(F.lit(graph)))


def pinned(quads: DataFrame, graph: str) -> DataFrame:
    """The one graph that a query may see."""
    return quads.where(F.col("g") == graph)


def ask(solutions: DataFrame) -> DataFrame:
    """One row: whether there is a solution."""
    return solutions.select(F.lit(1).alias("x")).limit(1).agg((F.count("*") > 0).alias("answer"))


def insert_data(graph: DataFrame, triples: DataFrame) -> DataFrame:
    """The graph as a set with ``triples`` in it."""
    return graph.unionByName(triples.join(graph, graph.columns, "left_anti")).distinct()


def delete_data(graph: DataFrame, triples: DataFrame) -> DataFrame:
    return graph.join(triples.select(*graph.columns).distinct(), graph.columns, "left_anti")


def modify(graph: DataFrame, solutions: DataFrame, delete: list[Sequence[str]], insert: list[Sequence[str]]) -> DataFrame:
    """Delete and insert the templates' triples for all solutions; deletions come first."""
    out = delete_data(graph, construct(solutions, delete)) if delete else graph
    return insert_data(out, construct(solutions, insert)) if insert else out


# ---- paths ----------------------------------------------------------------------------------------------------


#: Rounds that follow edges one by one before a chain is jumped along, and parts of a result that are read together.
FRONTIER_ROUNDS, PARTS = 8, 16


def path_plus(edges: DataFrame, seeds: DataFrame, store: Callable[[DataFrame], DataFrame], src: str = "src", dst: str = "dst") -> DataFrame:
    """(start, node): nodes that one or more ``edges`` lead to from the ``seeds`` (start), as a set.

    Each round follows the edges of what the last one has added, and only that is stored, so the work is bound by what
    the seeds reach.  Where that takes more than a few rounds and no node has several edges (versions derived from
    versions), pointers that double their length go on: a logarithmic number of rounds for chains of any length, each
    with a row for a node at most.  Other graphs take as many rounds as the longest of the shortest ways.  Cycles end, as
    nothing is added twice.  ``store`` cuts the lineage after each round; ``edges`` are read in each, so what is costly
    to make should be stored before.
    """
    steps = edges.select(F.col(src).alias("node"), F.col(dst).alias("to")).where("node is not null and to is not null").distinct()
    added = store(seeds.select(F.col("start"), F.col("start").alias("node")).distinct().join(steps, "node").select("start", F.col("to").alias("node")).distinct())
    parts = [added]
    for turn in count(1):
        if added.isEmpty():
            break
        if turn == FRONTIER_ROUNDS and steps.groupBy("node").count().where("count > 1").isEmpty():
            parts.append(_jump(added, steps, store))
            break
        if len(parts) > PARTS:
            parts = [store(reduce(DataFrame.union, parts))]
        known = reduce(DataFrame.union, parts)
        added = store(added.join(steps, "node").select("start", F.col("to").alias("node")).distinct().join(known, ["start", "node"], "left_anti"))
        parts.append(added)
    return reduce(DataFrame.union, parts).distinct()


def _jump(reached: DataFrame, steps: DataFrame, store: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``reached`` (start, node) leads to where every node has one step (node, to) at most, itself included."""
    while True:
        further = reached.join(steps, "node").select("start", F.col("to").alias("node")).distinct().join(reached, ["start", "node"], "left_anti")
        further = store(further)
        if further.isEmpty():
            return reached
        reached = store(reached.union(further))
        steps = store(steps.join(steps.toDF("to", "next"), "to").select("node", F.col("next").alias("to")))


def path_star(edges: DataFrame, seeds: DataFrame, store: Callable[[DataFrame], DataFrame], src: str = "src", dst: str = "dst") -> DataFrame:
    """As ``path_plus``, with every seed reaching itself."""
    return seeds.select("start", F.col("start").alias("node")).union(path_plus(edges, seeds, store, src, dst)).distinct()

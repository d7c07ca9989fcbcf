"""The confidence model: averages, outlier penalties, distances and sections."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import decay, local_name
from ..functions.spans import Penalties, Window as Part, find_spans_udf


def averages(rows: DataFrame, by: str, value: str = "confidence", digits: int = 4) -> DataFrame:
    """(by, total, n, mean) of a confidence; sums are exact to nine places, so their order doesn't matter."""
    out = rows.groupBy(by).agg(F.sum(F.col(value).cast("decimal(18,9)")).cast("double").alias("total"), F.count(value).alias("n"))
    return out.withColumn("mean", F.round(F.col("total") / F.col("n"), digits))


def pooled(pairs: DataFrame, means: DataFrame, a: str, b: str, by: str, digits: int = 4) -> DataFrame:
    """``pairs`` with ``pooled``: all confidences of both entities averaged together; of one if the other has none."""
    one = means.select(F.col(by).alias(a), F.col("total").alias("t1"), F.col("n").alias("n1"))
    two = means.select(F.col(by).alias(b), F.col("total").alias("t2"), F.col("n").alias("n2"))
    joined = pairs.join(one, a, "left").join(two, b, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return joined.withColumn("pooled", F.round(F.try_divide(zero("t1") + zero("t2"), zero("n1") + zero("n2")), digits)).drop("t1", "t2", "n1", "n2")


def outliers(rows: DataFrame, by: list[str], at: str, length: Column, weight: float = 1.0, floor: float = 0.2, value: str = "confidence") -> DataFrame:
    """Confidences less by the distance of their place from the exact median of their group, if it has two or more."""
    middle = rows.groupBy(*by).agg(F.median(at).alias("__middle"), F.count("*").alias("__n"))
    factor = F.when(F.col("__n") >= 2, decay(F.abs(F.col(at) - F.col("__middle")), length, weight, floor)).otherwise(F.lit(1.0))
    return rows.join(middle, by).withColumn(value, F.round(F.col(value) * factor, 4)).drop("__middle", "__n")


def others_median(rows: DataFrame, by: str, ident: str, value: str) -> DataFrame:
    """(ident, others): the median of ``value`` over the other rows of the group, null for a row alone.

    Rows are ranked by value within their group; leaving one out moves the middle by its rank, so the medians are
    among the group's few middle values, which a sum over the group picks out: no row holds a whole group.
    """
    group = Window.partitionBy(by)
    ranked = rows.select(by, ident, value, F.row_number().over(group.orderBy(value, ident)).alias("__rank"), F.count("*").over(group).alias("__n"))
    half = F.floor((F.col("__n") - 1) / 2)
    # Ranks (from 1) of the middle of n - 1 values, before and after the one that is left out.
    picked = [F.max(F.when(F.col("__rank") == half + i, F.col(value))).over(group).alias(f"__{i}") for i in range(3)]
    rows = ranked.select(ident, "__rank", "__n", half.alias("__half"), *picked)
    skip = lambda i: F.when(F.col("__rank") <= F.col("__half") + i, F.col(f"__{i + 1}")).otherwise(F.col(f"__{i}"))
    middle = F.when((F.col("__n") - 1) % 2 == 1, skip(1).cast("double")).otherwise((skip(0) + skip(1)) / 2)
    return rows.select(ident, F.when(F.col("__n") > 1, middle).alias("others"))


def cooccurrence(source: Column, target: Column, distance: Column, length: Column, weight: float = 1.0, floor: float = 0.3) -> Column:
    """The mean of both means (the target's alone if the source has none) times the decay of the distance."""
    return F.round(F.coalesce((source + target) / 2, target) * decay(F.coalesce(distance, F.lit(0)), length, weight, floor), 4)


def containment(base: Column, at: Column, starts: Column, ends: Column, length: Column, outside: float = 0.8, weight: float = 1.0, floor: float = 0.3) -> Column:
    """``base`` inside a section (bounds included), without sections, or without a place; else less by the distance
    to the nearest bound."""
    inside = F.exists(F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda x: (at >= x["s"]) & (at <= x["e"]))
    nearest = F.array_min(F.transform(F.concat(starts, ends), lambda x: F.abs(at - x)))
    return F.when(at.isNull() | (F.size(starts) == 0) | inside, base).otherwise(F.round(base * outside * decay(nearest, length, weight, floor), 4))


def hierarchy(primary: Column, pooled_score: Column, target: Column, at: Column, start: Column, end: Column) -> Column:
    """Entities with a literal of a leading predicate count with both sides' confidences; others with the target's, if
    it stands in the fallback section, and else not at all."""
    return F.when(primary, pooled_score).when((at >= start) & (at <= end), target)


# ---- annotation -----------------------------------------------------------------------------------------------


def type_index(triples: DataFrame, type_predicate: str) -> DataFrame:
    """(s, types): the local names of each subject's types, sorted."""
    return triples.where((F.col("p") == type_predicate) & (F.col("o_kind") == "iri")).groupBy("s").agg(F.array_sort(F.collect_set(local_name(F.col("o")))).alias("types"))


def annotate_literals(triples: DataFrame, docs: DataFrame, windows: Mapping[str, list[Part]] | None = None, exact: frozenset[str] = frozenset(), penalties: Penalties = Penalties(), type_predicate: str = "type", literal: frozenset[str] = frozenset()) -> DataFrame:
    """(doc_id, s, p, o, start, end, confidence, in_window) of the literals that are found in their document.

    ``triples`` (doc_id, s, p, o, o_kind) count if their object is a literal, or an IRI of a predicate in ``exact``;
    these are matched by the strict rungs only, and predicates in ``literal`` letter by letter.  ``windows`` are given by the predicate's local name.  A document's text
    is joined once to the list of its values, not to each of them.
    """
    name = local_name(F.col("p"))
    wanted = triples.where((name != type_predicate) & ((F.col("o_kind") == "literal") | name.isin(list(exact)))).withColumn("name", name)
    lists = wanted.groupBy("doc_id").agg(F.collect_set(F.struct("name", F.col("o").alias("value"))).alias("values"))
    found = docs.select("doc_id", "text").join(lists, "doc_id")
    rows = found.select("doc_id", F.explode(find_spans_udf(windows or {}, penalties, exact, literal=literal)("text", "values")).alias("x")).select("doc_id", "x.*")
    rows = rows.withColumn("confidence", F.round("confidence", 4))
    return wanted.join(rows, (wanted["doc_id"] == rows["doc_id"]) & (wanted["name"] == rows["name"]) & (F.col("o") == F.col("value"))).select(wanted["doc_id"], "s", "p", "o", "start", "end", "confidence", "in_window")


def annotate_types(triples: DataFrame, literals: DataFrame, type_predicate: str) -> DataFrame:
    """(s, type, confidence): each type of a subject that has annotated literals, with the mean of their confidences."""
    types = triples.where((F.col("p") == type_predicate) & (F.col("o_kind") == "iri")).select("s", F.col("o").alias("type")).distinct()
    return types.join(averages(literals, "s").select("s", F.col("mean").alias("confidence")), "s")


@dataclass(frozen=True)
class Strategy:
    """How links of a predicate are scored: "target", "pair", "cooccurrence", "sections" or "hierarchy"."""

    kind: str = "target"
    sections: tuple[tuple[float, float], ...] = ()
    leading: tuple[str, ...] = ()
    outliers: bool = False


def annotate_links(links: DataFrame, literals: DataFrame, length: Column, strategies: Mapping[str, Strategy], default: Strategy = Strategy(), excluded: frozenset[str] = frozenset()) -> DataFrame:
    """(s, p, o, confidence) of ``links`` (s, p, o: IRIs), each by the strategy of its predicate's local name.

    ``literals`` (s, p, start, confidence) are the annotated literals of the entities.  A link without a score has no
    row.  One join with the entities' means serves all strategies.
    """
    name = local_name(F.col("p"))
    kept = links.where(~name.isin(list(excluded))) if excluded else links
    means = averages(literals, "s", digits=9).join(literals.groupBy("s").agg(F.median("start").alias("place"), F.array_sort(F.collect_set(local_name(F.col("p")))).alias("names")), "s")
    one = means.select("s", F.col("total").alias("t1"), F.col("n").alias("n1"), F.col("mean").alias("m1"), F.col("place").alias("p1"), "names")
    two = means.select(F.col("s").alias("o"), F.col("total").alias("t2"), F.col("n").alias("n2"), F.col("mean").alias("m2"), F.col("place").alias("p2"))
    both = kept.join(one, "s", "left").join(two, "o", "left").withColumn("__name", name)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    pair = F.round(F.try_divide(zero("t1") + zero("t2"), zero("n1") + zero("n2")), 4)

    def scored(strategy: Strategy) -> Column:
        starts, ends = (F.array(*[F.lit(float(x[i])) for x in strategy.sections]) if strategy.sections else F.array().cast("array<double>") for i in (0, 1))
        if strategy.kind == "target":
            return F.round("m2", 4)
        if strategy.kind == "pair":
            return pair
        if strategy.kind == "cooccurrence":
            return F.when(F.col("m2").isNotNull(), cooccurrence(F.col("m1"), F.col("m2"), F.abs(F.col("p1") - F.col("p2")), length))
        if strategy.kind == "sections":
            return F.when(F.col("m2").isNotNull(), containment(F.round("m2", 4), F.col("p2"), starts, ends, length))
        if strategy.kind == "hierarchy":
            leads = F.coalesce(F.arrays_overlap("names", F.array(*map(F.lit, strategy.leading))), F.lit(False))
            return hierarchy(leads, pair, F.round("m2", 4), F.col("p2"), F.lit(strategy.sections[0][0]), F.lit(strategy.sections[0][1]))
        raise ValueError(f"unknown strategy {strategy.kind}")

    score, apart = scored(default), F.lit(default.outliers)
    for predicate, strategy in strategies.items():
        score = F.when(F.col("__name") == predicate, scored(strategy)).otherwise(score)
        apart = F.when(F.col("__name") == predicate, F.lit(strategy.outliers)).otherwise(apart)
    out = both.select("s", "p", "o", "p2", score.alias("confidence"), apart.alias("__apart")).where("confidence is not null")
    placed = out.where("__apart and p2 is not null")
    return out.where("not __apart or p2 is null").select("s", "p", "o", "confidence").unionByName(outliers(placed, ["s", "p"], "p2", length).select("s", "p", "o", "confidence"))

"""Spans of texts: which ones overlap, the segments that they cut a text into, and what is shown beside a statement.

Spans are half-open, with whole offsets of 0 or more.  Two overlap if each starts before the other ends.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Levels of bins: those of level n are 2^n wide.
LEVELS = 40
#: Width of the blocks of a text in which cut points are summed up one by one.
BLOCK = 1 << 16


def _level(start: Column, end: Column) -> Column:
    """The lowest level whose bins are no narrower than the span."""
    length = F.greatest(end - start, F.lit(1)).cast("long")
    return F.length(F.bin(length - 1)) * (length > 1).cast("int")


def overlaps(left: DataFrame, right: DataFrame, key: str, start: str, end: str, a: str, b: str) -> DataFrame:
    """(key, a, b): the spans ``a`` of ``left`` and ``b`` of ``right`` of the same ``key`` that overlap, each pair once.

    Every span stands in the bins of its own length, two at most.  A span looks for those that are no shorter in the
    bins of their lengths, and a pair is taken in the bin where the later one of the two starts.  So spans that don't
    overlap hardly meet, however long or short they are, and rows grow with the spans and with the pairs that there are.
    Spans with a null key, start or end overlap nothing; repeated rows make a pair each; empty ones (start = end) overlap
    what goes on around them.
    """

    def ready(df: DataFrame, name: str, n: int) -> DataFrame:
        cells = df.select(F.col(key).alias("__key"), F.col(name).alias(f"__id{n}"), F.col(start).cast("long").alias(f"__s{n}"), F.col(end).cast("long").alias(f"__e{n}"))
        return cells.where(f"__key is not null and __s{n} is not null and __e{n} is not null").withColumn(f"__l{n}", _level(F.col(f"__s{n}"), F.col(f"__e{n}")))

    def bins(df: DataFrame, n: int, levels: DataFrame | None) -> DataFrame:
        """A row for each bin of the span's own level, or of all of ``levels`` from its own (or above) on."""
        last = F.greatest(F.col(f"__e{n}") - 1, F.col(f"__s{n}"))
        if levels is None:
            leveled = df.withColumn("__level", F.col(f"__l{n}"))
        else:
            leveled = df.join(levels, (F.col("__level") >= F.col(f"__l{n}")) if n == 1 else (F.col("__level") > F.col(f"__l{n}")))
        first_bin, last_bin = (F.call_function("shiftright", c, F.col("__level")) for c in (F.col(f"__s{n}"), last))
        return leveled.withColumn("__bin", F.explode(F.sequence(first_bin, last_bin)))

    one, two = ready(left, a, 1), ready(right, b, 2)
    # The levels that occur: one row for each, at most LEVELS.
    levels = F.broadcast(one.select(F.col("__l1").alias("__level")).union(two.select("__l2")).distinct())
    low = bins(one, 1, levels).join(bins(two, 2, None), ["__key", "__level", "__bin"])
    high = bins(one, 1, None).join(bins(two, 2, levels), ["__key", "__level", "__bin"])
    later = F.greatest("__s1", "__s2")
    both = low.unionByName(high).where((F.col("__s1") < F.col("__e2")) & (F.col("__e1") > F.col("__s2")) & (F.call_function("shiftright", later, F.col("__level")) == F.col("__bin")))
    return both.select(F.col("__key").alias(key), F.col("__id1").alias(a), F.col("__id2").alias(b))


def overlapping_pairs(spans: DataFrame, key: str, start: str, end: str, name: str) -> DataFrame:
    """(key, a, b): the overlapping spans of each ``key``, by their ``name`` with a < b."""
    return overlaps(spans.withColumnRenamed(name, "a"), spans.withColumnRenamed(name, "b"), key, start, end, "a", "b").where("a < b")


def segments(spans: DataFrame, key: str, start: str, end: str, role: str, store: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(key, start, end, role): the pieces between the cut points of the spans of each ``key``, with the role that they
    are shown in: ``object`` where such a span covers them, else ``subject`` where one does, else null.

    Cut points are summed up: in blocks of the text first, then from each block's sum on, so no task holds all of a
    long text.  Spans that aren't longer than nothing, or lack a bound, are left out; a null role counts as a subject's.
    """
    good = spans.where(F.col(start) < F.col(end))
    object_ = F.coalesce(F.col(role) == "object", F.lit(False)).cast("int")
    event = lambda at, sign: F.struct(at.cast("long").alias("at"), (object_ * sign).alias("o"), ((1 - object_) * sign).alias("s"))
    ends = good.select(F.col(key).alias("__key"), F.explode(F.array(event(F.col(start), 1), event(F.col(end), -1))).alias("x"))
    cuts = ends.groupBy("__key", "x.at").agg(F.sum("x.o").alias("o"), F.sum("x.s").alias("s")).withColumn("block", F.floor(F.col("at") / BLOCK))
    cuts = store(cuts)
    blocks = cuts.groupBy("__key", "block").agg(F.sum("o").alias("bo"), F.sum("s").alias("bs"), F.min("at").alias("first"))
    over = Window.partitionBy("__key").orderBy("block")
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    sums = blocks.select("__key", "block", F.coalesce(F.sum("bo").over(before), F.lit(0)).alias("bo"), F.coalesce(F.sum("bs").over(before), F.lit(0)).alias("bs"), F.lead("first").over(over).alias("next"))
    inside = Window.partitionBy("__key", "block").orderBy("at")
    upto = lambda c: F.sum(c).over(inside.rowsBetween(Window.unboundedPreceding, 0)) + F.col(f"b{c}")
    shown = F.when(upto("o") > 0, "object").when(upto("s") > 0, "subject")
    out = cuts.join(sums, ["__key", "block"]).select(F.col("__key").alias(key), F.col("at").alias("start"), F.coalesce(F.lead("at").over(inside), F.col("next")).alias("end"), shown.alias("role"))
    return out.where("end is not null")


def shown_spans(statements: DataFrame, spans: DataFrame) -> DataFrame:
    """(stmt_id, span_start, span_end, role, rank): what is highlighted beside each of ``statements`` (doc_id, stmt_id,
    s, o, o_kind, span_start, span_end), from ``spans`` (doc_id, s, span_start, span_end) of its document.

    A literal's own span comes first (0), as an object's; then the spans of its subject but one that equals it (1); an
    IRI's object has its own spans, as those of a subject (2).  Repeated spans of a subject are shown once.
    """
    known = spans.where("span_start is not null and span_end is not null").select("doc_id", F.col("s").alias("of"), F.col("span_start").alias("start"), F.col("span_end").alias("end")).distinct()
    literal = (F.col("o_kind") == "literal") & F.col("span_start").isNotNull() & F.col("span_end").isNotNull()
    told = statements.select("doc_id", "stmt_id", "s", "o", F.when(literal, F.col("span_start")).alias("a"), F.when(literal, F.col("span_end")).alias("b"), (F.col("o_kind") == "iri").alias("linked"))
    own = told.where("a is not null").select("stmt_id", F.col("a").alias("span_start"), F.col("b").alias("span_end"), F.lit("object").alias("role"), F.lit(0).alias("rank"))
    same = F.coalesce((F.col("start") == F.col("a")) & (F.col("end") == F.col("b")), F.lit(False))
    subject = told.join(known.withColumnRenamed("of", "s"), ["doc_id", "s"]).where(~same).select("stmt_id", F.col("start").alias("span_start"), F.col("end").alias("span_end"), F.lit("subject").alias("role"), F.lit(1).alias("rank"))
    object_ = told.where("linked").join(known.withColumnRenamed("of", "o"), ["doc_id", "o"]).select("stmt_id", F.col("start").alias("span_start"), F.col("end").alias("span_end"), F.lit("object").alias("role"), F.lit(2).alias("rank"))
    return own.union(subject).union(object_)

"""Mixing sources to target weights by capped water-filling.

Each source asks for its weight's share of all words.  A source is clamped at a maximum number of epochs; what it
cannot take is shared among the others by weight until no target is above its clamp.  A target is then met by
whole repetitions of all documents of the source and one fractional repetition: documents in a seeded order, each
whole, until the remainder is used up.  Only built-in functions are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import column, fresh, materialise, wrapped

#: Tables with one row for each source are broadcast up to this many sources (about 100 bytes a row).
BROADCAST_SOURCES = 50_000
#: Hexadecimal digits of the seeded order that make up a bucket, found in two steps of 256: 65,536 buckets a source.
BUCKET_DIGITS = 4
COARSE = 256


def water_fill(sources: DataFrame, epochs: int = 3) -> DataFrame:
    """Targets of ``sources`` (source, source_size long, weight long): adds ``target`` double.

    All sources together get the sum of all sizes.  Targets are ``least(epochs * source_size, weight * level)``,
    where the level is what remains after the clamped sources, by remaining weight: repeating "clamp, then share
    the excess" ends at the lowest level at which the next source in the order of ``epochs * source_size / weight``
    isn't clamped.  A source of size 0 gets 0, and so does one of weight 0.  The table has one row for each source, so the cumulative sums over
    it run in one task.
    """
    limit = F.col("source_size") * F.lit(epochs)
    order = Window.orderBy(F.try_divide(limit, F.col("weight")).asc_nulls_last(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    steps = sources.select(
        "*", limit.alias("limit"),
        (F.sum("source_size").over(whole) - F.coalesce(F.sum(limit).over(before), F.lit(0))).alias("rest"),
        (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("rest_weight"),
    )
    wide = lambda name: F.col(name).cast("decimal(19,0)")
    free = (F.col("weight") > 0) & (wide("rest") * wide("weight") <= wide("limit") * wide("rest_weight"))
    level = steps.where(free).agg(F.max(F.struct("rest_weight", "rest")).alias("level"))
    target = F.least(F.col("limit").cast("double"), (wide("weight") * wide("level.rest")).cast("double") / F.col("level.rest_weight").cast("double"))
    return steps.crossJoin(F.broadcast(level)).select(*[F.col(c) for c in sources.columns], F.when(F.col("weight") > 0, F.coalesce(target, F.lit(0.0))).otherwise(F.lit(0.0)).alias("target"))


def rank_weights(sources: DataFrame, weights: list[int]) -> DataFrame:
    """Adds ``weight``: ``weights`` repeated over the sources by code point, null last."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.withColumn("weight", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int")))


def _weighted(sources: DataFrame, weights: DataFrame) -> DataFrame:
    """``sources`` with the weights of a table; 0 for what it lacks."""
    given = weights.groupBy(F.col("source").alias("__s")).agg(F.greatest(F.max("weight"), F.lit(0)).cast("long").alias("__w"))
    joined = sources.join(given, F.col("source").eqNullSafe(F.col("__s")), "left")
    return joined.select(*sources.columns, F.coalesce("__w", F.lit(0)).alias("weight"))


def mix(rows: DataFrame, weights: list[int] | DataFrame, epochs: int = 3, seed: str = "mix") -> DataFrame:
    """What a mix takes of ``rows`` (doc_id, source, size long): adds ``source_size``, ``target`` and ``taken``.

    ``weights`` are dealt to the sources in code-point order, or given as a table (source, weight), in which the largest
    weight of a source counts; sources that it lacks, and those of a null or negative weight, have weight 0, and nothing
    is taken of their rows, which stay.  A source's target is rounded down to whole words.  ``taken`` counts words: ``floor(target / source_size)`` times the
    document, and once more if the document comes early enough in the seeded order (MD5 of seed and doc_id, then
    doc_id and size); the one document in which the remainder ends gives only the words still missing.  So each
    source meets its target to a word, no document gives more than ``epochs`` times its size, and reruns agree.

    Null sources form one source; null sizes count as 0; documents without words give 0.  Repeated rows are
    separate documents; ties in the order are rows that take the same.  An empty table gives no rows.  Other columns
    are kept whatever their names; ``source_size``, ``target`` and ``taken`` are replaced.
    """
    names = [c for c in rows.columns if c not in ("source_size", "target", "taken")]
    spread = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    base = wrapped(rows, "doc_id", "source", "size", without=("source_size", "target", "taken"))
    base = base.withColumns({"size": F.coalesce(F.col("size"), F.lit(0)).cast("long"), "__order": spread})
    base = materialise(base.withColumn("__bucket", F.conv(F.substring("__order", 1, BUCKET_DIGITS), 16, 10).cast("int")), "mix")
    sources = base.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    weighted = rank_weights(sources, weights) if isinstance(weights, list) else _weighted(sources, weights)
    quota = F.floor("target").cast("long")
    safe = F.greatest("source_size", F.lit(1))
    plan = water_fill(weighted, epochs).withColumn("__whole", F.floor(quota / safe).cast("long"))
    plan = materialise(plan.withColumn("__rest", quota - F.col("__whole") * F.col("source_size")), "mix-plan")
    few = plan.count() <= BROADCAST_SOURCES
    small = F.broadcast if few else (lambda df: df)

    # The bucket of each source in which the remainder ends: first among 256, then among the 256 parts of that one.
    buckets = base.groupBy("source", "__bucket").agg(F.sum("size").alias("n"))
    rests = plan.select("source", F.col("__rest").alias("rest"), F.lit(0).cast("long").alias("before"))
    coarse = _ending(buckets.groupBy("source", F.floor(F.col("__bucket") / COARSE).alias("at")).agg(F.sum("n").alias("n")), rests, small)
    inside = _join(buckets.withColumnRenamed("source", "__s"), small(coarse), "__s").where(F.floor(F.col("__bucket") / COARSE) == F.col("at"))
    ends = _ending(inside.select(F.col("__s").alias("source"), F.col("__bucket").alias("at"), "n"), coarse.select("source", "rest", "before"), small)
    ends = ends.select("source", F.struct(F.col("at").alias("__bucket"), "before").alias("__end"))
    plan = _join(plan.withColumnRenamed("source", "__s"), small(ends), "__s", "left").select(F.col("__s").alias("source"), "source_size", "target", "__whole", "__rest", "__end").transform(lambda df: materialise(df, "mix-ends"))

    out = _join(base.withColumnRenamed("source", "__s"), small(plan), "__s").drop("source").withColumnRenamed("__s", "source")
    at = F.col("__end.__bucket")
    inside = F.coalesce(F.col("__bucket") == at, F.lit(False))
    upto = F.sum("size").over(Window.partitionBy("source", "__bucket").orderBy("__order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))
    ending = out.where(inside).withColumn("__more", F.greatest(F.lit(0), F.least(F.col("size"), F.col("__rest") - F.col("__end.before") - upto + F.col("size"))))
    others = out.where(~inside).withColumn("__more", F.when(at.isNull() | (F.col("__bucket") < at), F.col("size")).otherwise(F.lit(0)))
    taken = (F.col("__whole") * F.col("size") + F.col("__more")).cast("long")
    both = ending.unionByName(others)
    own = {"size": F.col("size")}
    return both.select(*[own.get(c, F.col("row").getField(c)).alias(c) for c in names], "source_size", "target", taken.alias("taken"))


def _ending(parts: DataFrame, rests: DataFrame, small) -> DataFrame:
    """(source, at, rest, before): of each source's parts (source, at, n) the first with which the sum of n, counted on
    from ``before``, exceeds ``rest``; none if the sum stays below.  There are few parts of a source."""
    counted = _join(parts.withColumnRenamed("source", "__s"), small(rests), "__s")
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("source").orderBy("at"))
    over = counted.withColumn("upto", upto).where("upto > rest")
    return over.groupBy("source").agg(F.min(F.struct("at", "rest", (F.col("upto") - F.col("n")).alias("before"))).alias("e")).select("source", "e.*")


def _join(left: DataFrame, right: DataFrame, name: str, how: str = "inner") -> DataFrame:
    return left.join(right, F.col(name).eqNullSafe(F.col("source")), how)


def repeat_rows(mixed: DataFrame) -> DataFrame:
    """The rows of a mix (with size and taken), each as often as it is taken: whole repetitions, and the last one if it
    is at least half taken.

    Rows that are taken less than half, and those without words, are left out; null counts as 0.  Repeated rows are
    repeated one by one, an empty table stays empty, other columns may have any names.
    """
    size, taken = F.coalesce(column("size"), F.lit(0)), F.coalesce(column("taken"), F.lit(0))
    whole = F.floor(taken / F.greatest(size, F.lit(1)))
    times = (whole + F.when((taken - whole * size) * 2 >= F.greatest(size, F.lit(1)), 1).otherwise(0)).cast("int")
    count, each = fresh(mixed.columns, "__times"), fresh(mixed.columns, "__each")
    return mixed.withColumn(count, times).where(F.col(count) > 0).withColumn(each, F.explode(F.sequence(F.lit(1), F.col(count)))).drop(count, each)

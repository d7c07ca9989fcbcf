"""As-of join with a tolerance: for every row the latest row of another table at or before it, and not too long before.

Rows of the right table that tie in key and time are one row beforehand: the preferred one, and their number.  Time is
cut into chunks of four tolerances, and a cell is a chunk of one key.  A cell that holds more than a small share of all
rows is cut further, into narrower chunks, and if rows to be matched crowd at one moment, these are dealt to parts by
their number.  Cells go to shards by a hash.  Each also gets a halo: of every earlier cell within the tolerance its
last row, which is all of that cell that can still be the latest.  In a shard DuckDB's ``ASOF LEFT JOIN`` finds the rows.
"""

from __future__ import annotations

from functools import cache

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, materialise, tasks_for, wrapped

#: Tolerances in a chunk: one in so many rows of the right table is near enough to the end of its chunk for a halo.
CHUNK = 4
#: A cell is cut further if it has over one in CELLS of all rows, or over CELL_ROWS; up to SMALL rows it never is.
CELLS, CELL_ROWS, SMALL = 1024, 1_000_000, 2_000
#: Lists of cut cells (at most CELLS, or rows / CELL_ROWS) are broadcast up to this many rows of about 50 bytes.
BROADCAST_CELLS = 20_000
#: Rows of a shard, which one call of DuckDB sees.
SHARD_ROWS = 32_768


def micros(moment: Column) -> Column:
    """Microseconds since 1970 of the wall clock of a timestamp, without a time zone coming in."""
    parts = F.unix_date(moment.cast("date")).cast("long") * 86_400 + F.hour(moment) * 3_600 + F.minute(moment) * 60
    seconds = F.extract(F.lit("SECOND"), moment)
    return parts * 1_000_000 + (seconds * 1_000_000).cast("long")


def asof_join(left: DataFrame, right: DataFrame, key: str, at: str, tolerance: int, prefer: list[Column], take: list[str]) -> DataFrame:
    """``left`` with the latest row of ``right`` of the same ``key`` whose ``at`` (a long, in both) is at most its own
    and at most ``tolerance`` smaller: adds ``matched_at`` long, ``n_tied`` long, and ``take``, columns of that row.

    Of rows that tie in key and ``at`` the one with the largest ``prefer`` (then ``take``) is meant, where null is
    smaller than anything; ``n_tied`` counts all of them, repeated ones too.  Rows of ``left`` that match nothing, as
    those whose key or ``at`` is null, have nulls and ``n_tied`` 0; repeated rows are matched each.  Null keys and
    moments of ``right`` match nothing.  An empty ``right`` leaves all unmatched, an empty ``left`` gives no rows.
    Columns of ``left`` may have any names; those of the names that are added are replaced.
    """
    spark, added = left.sparkSession, ("matched_at", "n_tied", *take)
    chunk = CHUNK * tolerance
    rows = materialise(wrapped(left, key, at, without=(key, at, *added)).toDF("key", "at", "row").withColumn("rid", F.monotonically_increasing_id()), "asof-left")
    asks = rows.where("key is not null and at is not null")
    best = F.max(F.struct(F.struct(*prefer).alias("by"), F.struct(*map(column, take)).alias("took")))
    told = right.where(column(key).isNotNull() & column(at).isNotNull())
    ties = told.groupBy(column(key).alias("key"), column(at).alias("at")).agg(best.getField("took").alias("took"), F.count("*").alias("n_tied"))
    ties = materialise(ties, "asof-ties")

    total = rows.count() + ties.count()
    most = max(SMALL, min(CELL_ROWS, total // CELLS))
    place = {"chunk": F.expr(f"(at - pmod(at, {chunk}L)) div {chunk}L"), "off": F.expr(f"pmod(at, {chunk}L)")}
    cells = asks.select("key", "at").union(ties.select("key", "at")).withColumns(place).groupBy("key", "chunk").agg(F.count("*").alias("n"))
    cut = _Cells(cells.where(F.col("n") > most).select("key", "chunk", F.ceil(F.col("n") / most).alias("subs")), "cut-cells")

    def placed(df: DataFrame) -> DataFrame:
        with_subs = cut.join(df.withColumns(place), ["key", "chunk"]).withColumn("subs", F.coalesce("subs", F.lit(1).cast("long")))
        return with_subs.withColumn("width", F.ceil(F.lit(chunk) / F.col("subs")).cast("long")).withColumn("sub", F.expr("off div width"))

    asked = materialise(placed(asks).select("key", "at", "row", "rid", "chunk", "sub", "subs"), "asof-cells")
    many = asked.where("subs > 1").groupBy("key", "chunk", "sub").agg(F.count("*").alias("n")).where(F.col("n") > 2 * most)
    crowded = _Cells(many.select("key", "chunk", "sub", F.ceil(F.col("n") / most).alias("parts")), "crowded-cells", none=not cut.rows)

    known = placed(ties)
    shown = known.select("key", "chunk", "sub", "at", "took", "n_tied")
    rest = F.least((F.col("sub") + 1) * F.col("width"), F.lit(chunk)) - F.col("off")
    last = known.where(rest <= tolerance).groupBy("key", "chunk", "sub", "subs", "width").agg(F.max(F.struct("at", "off", "took", "n_tied")).alias("last"))
    last = last.select("key", "chunk", "sub", "subs", "width", "last.at", "last.off", "last.took", "last.n_tied")
    after = cut.frame.select("key", (F.col("chunk") - 1).alias("chunk"), F.col("subs").alias("next")) if cut.rows else None
    last = cut.join(last, ["key", "chunk"], after).withColumn("next", F.coalesce("next", F.lit(1).cast("long"))) if cut.rows else last.withColumn("next", F.lit(1).cast("long"))
    reach = F.col("off") + tolerance
    here = _span(F.col("sub") + 1, F.least(F.col("subs") - 1, F.floor(reach / F.col("width"))), F.col("chunk"))
    next_width = F.ceil(F.lit(chunk) / F.col("next"))
    there = _span(F.lit(0).cast("long"), F.when(reach >= chunk, F.least(F.col("next") - 1, F.floor((reach - chunk) / next_width))).otherwise(F.lit(-1)), F.col("chunk") + 1)
    halo = last.select("key", F.explode(F.concat(here, there)).alias("to"), "at", "took", "n_tied").select("key", "to.chunk", "to.sub", "at", "took", "n_tied")
    shown = shown.union(halo)

    shards = tasks_for(spark, total, SHARD_ROWS)
    in_parts = lambda df: crowded.join(df, ["key", "chunk", "sub"]).withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))
    shard = F.pmod(F.xxhash64("key", "chunk", "sub", "part"), F.lit(shards)).cast("int").alias("shard")
    one = in_parts(asked).withColumn("part", F.pmod(F.xxhash64("rid"), F.col("parts"))).select(shard, "key", "at", "row")
    two = in_parts(shown).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select(shard, "key", "at", "took", "n_tied")

    schema = T.StructType([*(rows.schema[c] for c in ("key", "at", "row")), T.StructField("matched_at", T.LongType()), T.StructField("took", ties.schema["took"].dataType), T.StructField("n_tied", T.LongType())])
    found = one.groupBy("shard").cogroup(two.groupBy("shard")).applyInArrow(_latest(tolerance), schema)
    nothing = {"matched_at": F.lit(None).cast("long"), "took": F.lit(None).cast(schema["took"].dataType), "n_tied": F.lit(None).cast("long")}
    out = found.union(rows.where("key is null or at is null").withColumns(nothing).select(*found.columns))
    own = {key: F.col("key"), at: F.col("at")} | {c: F.col("row").getField(c) for c in left.columns if c not in (key, at)}
    tied = F.coalesce("n_tied", F.lit(0).cast("long"))
    return out.select(*[own[c].alias(c) for c in left.columns if c not in added], "matched_at", tied.alias("n_tied"), *[F.col("took").getField(c).alias(c) for c in take])


class _Cells:
    """A stored list of few cells, and joins with it: broadcast if its size, which is counted, allows it."""

    def __init__(self, frame: DataFrame, label: str, none: bool = False):
        self.frame = frame if none else materialise(frame, label)
        self.rows = 0 if none else self.frame.count()

    def join(self, df: DataFrame, by: list[str], frame: DataFrame | None = None) -> DataFrame:
        other = self.frame if frame is None else frame
        name = next(c for c in other.columns if c not in by)
        if not self.rows:
            return df.withColumn(name, F.lit(None).cast("long"))
        return df.join(F.broadcast(other) if self.rows <= BROADCAST_CELLS else other, by, "left")


def _span(first: Column, last: Column, chunk: Column) -> Column:
    """The cells (chunk, sub) from ``first`` to ``last``, none if that is before it."""
    subs = F.when(last >= first, F.sequence(first.cast("long"), last.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.transform(subs, lambda i: F.struct(chunk.alias("chunk"), i.alias("sub")))


@cache
def _duckdb() -> duckdb.DuckDBPyConnection:
    return duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "1GB"})


def _latest(tolerance: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        con = _duckdb()
        con.register("asks", pa.table({"i": np.arange(left.num_rows), "key": left["key"], "at": left["at"]}))
        con.register("known", pa.table({"j": np.arange(right.num_rows), "key": right["key"], "at": right["at"]}))
        found = con.execute("SELECT i, j FROM asks ASOF LEFT JOIN known ON asks.key = known.key AND asks.at >= known.at").fetchnumpy()
        at = np.full(left.num_rows, -1, np.int64)
        at[found["i"]] = np.ma.filled(found["j"].astype(np.int64), -1)
        hit = np.flatnonzero(at >= 0)
        lag = left["at"].to_numpy()[hit] - right["at"].to_numpy()[at[hit]]
        at[hit[lag > tolerance]] = -1
        got = right.take(pa.array(at, mask=at < 0))
        return pa.table([left["key"], left["at"], left["row"], got["at"], got["took"], got["n_tied"]], ["key", "at", "row", "matched_at", "took", "n_tied"])

    return run

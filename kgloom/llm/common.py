"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import work_folder

#: Separators of words: space and the five ASCII controls 0x09 to 0x0D.  Everything else belongs to a word.
WORD_GAP = r"[\x20\x09-\x0D]+"


#: Rows of an Arrow batch while a table is written: with whole texts in them, batches of the usual size are large.
BATCH_ROWS = 2_000


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    It cuts the lineage at a file that outlives any executor, so what is computed once (also what depends on
    row order, such as generated row numbers) stays the same for every later read.
    """
    spark = df.sparkSession
    path = f"{work_folder(spark)}/{label}-{uuid.uuid4().hex}"
    with _SmallBatches(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class _SmallBatches:
    """While any thread is inside, Arrow batches of the session have at most ``BATCH_ROWS`` rows; the last to leave puts
    back what the first has found."""

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    lock, users = threading.Lock(), {}

    def __init__(self, spark: SparkSession):
        self.spark, self.key = spark, id(spark._jsparkSession)

    def __enter__(self) -> None:
        with self.lock:
            inside, before = self.users.get(self.key, (0, self.spark.conf.get(self.name)))
            self.users[self.key] = (inside + 1, before)
            self.spark.conf.set(self.name, min(int(before), BATCH_ROWS) if int(before) > 0 else BATCH_ROWS)

    def __exit__(self, *_) -> None:
        with self.lock:
            inside, before = self.users.pop(self.key)
            if inside > 1:
                self.users[self.key] = (inside - 1, before)
            else:
                self.spark.conf.set(self.name, before)


def one_of_each(rows: DataFrame, wanted: DataFrame, keys: DataFrame) -> DataFrame:
    """``wanted`` (row, once each, and other columns) with the text of ``rows`` (row, text), once for each.

    ``keys`` has the ``row`` of all rows.  Texts whose row repeats are brought down to one before anything is done with
    them; the others are joined as they are.
    """
    again = materialise(keys.groupBy("row").agg(F.count("*").alias("n")).where("n > 1").select("row"), "repeated")
    if again.isEmpty():
        return rows.join(wanted, "row")
    single = rows.join(wanted.join(again, "row", "left_anti"), "row")
    texts = rows.join(wanted.join(again, "row", "left_semi").select("row"), "row").groupBy("row").agg(F.max("text").alias("text"))
    return single.unionByName(texts.join(wanted, "row"))


def column(name: str) -> Column:
    """The column of exactly this name, which may hold dots, blanks and backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(names: list[str], stem: str) -> str:
    """A name like ``stem`` that none of ``names`` is, whatever the case."""
    taken = {n.lower() for n in names}
    while stem.lower() in taken:
        stem += "_"
    return stem


def row_key(order: Column, text: Column) -> Column:
    """32 bytes that name a row by its ``order`` and ``text``; only rows equal in both (nulls too) share them.

    SHA-256 of both with the length of the first in front, so nothing in them can be taken for the other.
    """
    first = F.coalesce(order.cast("string"), F.lit(""))
    sign = F.concat(order.isNull().cast("int").cast("string"), text.isNull().cast("int").cast("string"))
    return F.unhex(F.sha2(F.concat_ws(":", sign, F.length(first).cast("string"), first, F.coalesce(text, F.lit(""))), 256))


def tasks_for(spark: SparkSession, rows: int, each: int) -> int:
    """Partitions for work of which ``each`` rows are enough for a task, whatever their bytes: at least one a core."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // each))


def words_of(text: Column) -> Column:
    """The words of a text as an array; null and texts without a word give an empty array."""
    parts = F.split(F.coalesce(text, F.lit("")), WORD_GAP)
    return F.filter(parts, lambda w: w != "")


def count_words(text: Column) -> Column:
    """The number of words of a text as a long."""
    return F.size(words_of(text)).cast("long")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, whatever the optimizer does with projections."""
    return F.element_at(F.transform(F.array(value), body), 1)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def pages(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/pages.parquet")


#: Rows of a block that is numbered or summed up by itself, and the least number of blocks.
BLOCK_ROWS, BLOCKS = 200_000, 512


def _blocks(rows: DataFrame) -> int:
    return max(BLOCKS, -(-rows.count() // BLOCK_ROWS))


def number_within(rows: DataFrame, group: str, by: list[str], name: str) -> DataFrame:
    """Adds ``name`` (long): the place of a row among those of its ``group``, gapless from 0, in an order that ``by`` fixes.

    A group is cut into blocks by a hash of ``by``, as many as the rows ask for; each block is numbered by itself and
    starts where the blocks before it end, so no task holds a whole group.  Rows equal in ``by`` follow each other in
    any order.  A null group is a group; an empty table stays empty; other columns may have any names.  ``rows`` are
    counted first, so they should be stored.
    """
    block, start, n, row, own = (fresh([*rows.columns, name], x) for x in ("__block", "__start", "__n", "__row", "__group"))
    blocked = rows.withColumns({block: F.pmod(F.xxhash64(*map(column, by)), F.lit(_blocks(rows))).cast("long"), own: column(group)})
    counts = blocked.groupBy(own, block).agg(F.count("*").alias(n))
    before = Window.partitionBy(own).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(own).alias(f"{own}2"), F.col(block).alias(f"{block}2"), F.coalesce(F.sum(n).over(before), F.lit(0)).alias(start))
    numbered = blocked.withColumn(row, F.row_number().over(Window.partitionBy(own, block).orderBy(*map(column, by))))
    joined = numbered.join(starts, F.col(own).eqNullSafe(F.col(f"{own}2")) & (F.col(block) == F.col(f"{block}2")))
    return joined.select(*[column(c) for c in rows.columns if c != name], (F.col(start) + F.col(row) - 1).cast("long").alias(name))


def running_total(rows: DataFrame, value: str, by: str, name: str) -> DataFrame:
    """Adds ``name`` (long): the sum of ``value`` over the rows before this one, in an order that ``by`` (unique) fixes.

    As ``number_within``: blocks are summed first, then each block's rows start at its sum.
    """
    block, start, n, total = (fresh([*rows.columns, name], x) for x in ("__block", "__start", "__n", "__sum"))
    blocked = rows.withColumn(block, F.pmod(F.xxhash64(column(by)), F.lit(_blocks(rows))).cast("long"))
    sums = blocked.groupBy(block).agg(F.sum(column(value)).alias(n))
    before = Window.orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(block, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(start))
    inner = Window.partitionBy(block).orderBy(column(by)).rowsBetween(Window.unboundedPreceding, -1)
    summed = blocked.withColumn(total, F.coalesce(F.sum(column(value)).over(inner), F.lit(0)))
    joined = summed.join(starts, block)
    return joined.select(*[column(c) for c in rows.columns if c != name], (F.col(start) + F.col(total)).cast("long").alias(name))


def wrapped(rows: DataFrame, *names: str, without: tuple[str, ...] = (), row: str = "row") -> DataFrame:
    """The named columns, and all of ``rows`` but ``without`` as the struct ``row``, so that they clash with nothing."""
    kept = [c for c in rows.columns if c not in without]
    whole = F.struct(*[column(c) for c in kept]) if kept else F.struct(F.lit(0).alias("_"))
    return rows.select(*[column(n).alias(n) for n in names], whole.alias(row))


def fields(wrapped_rows: DataFrame, row: str = "row") -> list[Column]:
    """The columns that ``wrapped`` put into ``row``."""
    names = [f.name for f in wrapped_rows.schema[row].dataType.fields]
    return [F.col(row).getField(n).alias(n) for n in names if names != ["_"]]

"""Exact duplicates by a Golomb-coded fingerprint exchange.

1. Every partition of the input fingerprints its rows, once for each distinct text in it, and sends each owner (a
   range of fingerprints) its sorted fingerprints as Golomb-Rice coded gaps: a few bits a fingerprint.
2. An owner marks the fingerprints that several partitions sent and answers each with a bitmap.
3. Rows whose bit is set, and texts found twice within a partition, are suspects.  Their texts are shuffled and
   compared byte by byte: grouped by digest and text, so copies of a text that one task has travel as one.  Texts of
   other rows never move.  Rows of equal digests are a group if their bytes turned out equal, and are grouped by their
   bytes if not.

The fingerprint is a prefix of the digest and long enough that under one row in a thousand is a false suspect.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import column, fresh, materialise

#: Fingerprints an owner holds at about the same time; with more than ``OWNERS`` owners, up to ``OWNER_MOST`` (a message
#: costs some bytes, so they shouldn't hold too few each).
OWNER_ROWS, OWNERS, OWNER_MOST = 1_000_000, 4_096, 16_000_000
#: Rows of a partition that are packed together (about 50 bytes a row).
PACK_ROWS = 200_000
#: The filter of suspects that is broadcast: bits for each suspect digest, and bytes at most.
FILTER_BITS, FILTER_BYTES = 16, 64 << 20


# ---- the code -------------------------------------------------------------------------------------------------


def golomb_encode(values: np.ndarray, bits: int) -> bytes:
    """Sorted distinct unsigned values as Golomb-Rice coded gaps with ``bits`` low bits.

    The quotients come first, in unary, then all remainders, so both parts decode without a loop over values.
    """
    gaps = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    quotients = (gaps >> np.uint64(bits)).astype(np.int64)
    ends = np.cumsum(quotients + 1) - 1
    unary = np.ones(int(ends[-1]) + 1 if len(ends) else 0, np.uint8)
    unary[ends] = 0
    low = ((gaps[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel()
    head = np.array([len(values), len(unary)], "<u4").tobytes()
    return head + np.packbits(unary).tobytes() + np.packbits(low).tobytes()


def golomb_decode(data: bytes, bits: int) -> np.ndarray:
    count, size = np.frombuffer(data, "<u4", 2).tolist()
    unary = np.unpackbits(np.frombuffer(data, np.uint8, (size + 7) // 8, 8), count=size)
    quotients = np.diff(np.flatnonzero(unary == 0), prepend=-1) - 1
    low = np.unpackbits(np.frombuffer(data, np.uint8, offset=8 + (size + 7) // 8), count=count * bits).reshape(count, bits)
    remainders = (low.astype(np.uint64) << np.arange(bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return np.cumsum((quotients.astype(np.uint64) << np.uint64(bits)) + remainders)


def rice_bits(span: int, count: int) -> int:
    """The number of low bits that suits ``count`` values spread evenly over ``span``."""
    return max(0, (max(1, span // max(1, count))).bit_length() - 1)


# ---- the exchange ---------------------------------------------------------------------------------------------


class _Plan:
    """What all tasks agree on: the width of a fingerprint, the owners, and their parameter of the code."""

    def __init__(self, rows: int, parts: int):
        self.width = min(56, max(12, (max(rows, 1) - 1).bit_length() + 10))
        self.owners = max(8, min(-(-rows // OWNER_ROWS), max(OWNERS, -(-rows // OWNER_MOST))))
        self.span = -(-(1 << self.width) // self.owners)
        self.bits = rice_bits(self.span, max(1, rows // (self.owners * max(parts, 1))))


def _fingerprints(digests: np.ndarray, width: int) -> np.ndarray:
    """The first ``width`` bits of digests given as rows of 32 bytes."""
    first = digests[:, :8].copy().view(">u8").ravel().astype(np.uint64)
    return first >> np.uint64(64 - width)


def _unpack(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, np.uint8).reshape(-1, 32)


def _send(plan: _Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, blob in zip(batch["part"].to_pylist(), batch["digests"].to_pylist(), strict=True):
                prints = np.unique(_fingerprints(_unpack(blob), plan.width))
                owners = (prints // np.uint64(plan.span)).astype(np.int64)
                starts = np.flatnonzero(np.diff(owners, prepend=-1))
                ends = np.append(starts[1:], len(prints))
                out = [(int(owners[a]), part, golomb_encode(prints[a:b] - np.uint64(owners[a] * plan.span), plan.bits)) for a, b in zip(starts, ends, strict=True)]
                yield pa.record_batch([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.binary())], ["owner", "part", "message"])

    return run


def _answer(plan: _Plan):
    def run(table: pa.Table) -> pa.Table:
        sent = [golomb_decode(m, plan.bits) for m in table["message"].to_pylist()]
        every = np.sort(np.concatenate(sent))
        twice = np.unique(every[1:][every[1:] == every[:-1]])
        maps = [np.packbits(np.isin(x, twice, assume_unique=True)).tobytes() for x in sent]
        return pa.table({"part": table["part"].cast(pa.int64()), "owner": table["owner"].cast(pa.int64()), "bitmap": pa.array(maps, pa.binary())})

    return run


def _resolve(plan: _Plan):
    """Of one pack: its rows with their digests and the marks of suspects, from the owners' bitmaps."""

    def run(packs: pa.Table, replies: pa.Table) -> pa.Table:
        bitmaps = dict(zip(replies["owner"].to_pylist(), replies["bitmap"].to_pylist(), strict=True))
        out = []
        for rows, blob in zip(packs["rows"].to_pylist(), packs["digests"].to_pylist(), strict=True):
            prints = _fingerprints(_unpack(blob), plan.width)
            unique, inverse, counts = np.unique(prints, return_inverse=True, return_counts=True)
            owners = (unique // np.uint64(plan.span)).astype(np.int64)
            marks = counts > 1
            starts = np.flatnonzero(np.diff(owners, prepend=-1))
            for a, b in zip(starts, np.append(starts[1:], len(unique)), strict=True):
                marks[a:b] |= np.unpackbits(np.frombuffer(bitmaps[int(owners[a])], np.uint8), count=int(b - a)).astype(bool)
            table = pa.ipc.open_stream(rows).read_all().combine_chunks()
            digests = pa.array([blob[i : i + 32] for i in range(0, len(blob), 32)], pa.binary())
            out.append(pa.table({"rid": table["rid"], "id": table["id"], "digest": digests, "suspect": pa.array(marks[inverse])}))
        return pa.concat_tables(out)

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (rid, id, digest) as few rows of packed columns; ``part`` tells them apart over all partitions."""
    held: list[pa.RecordBatch] = []

    def flush() -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        blob = b"".join(table["digest"].to_pylist())
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.drop_columns(["digest"]).schema) as out:
            out.write_table(table.drop_columns(["digest"]))
        return pa.record_batch([table["rid"].slice(0, 1).combine_chunks(), pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([blob], pa.binary())], ["part", "rows", "digests"])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(x.num_rows for x in held) >= PACK_ROWS:
            yield flush()
    if held:
        yield flush()


def suspects(rows: DataFrame) -> DataFrame:
    """Of ``rows`` (rid long, unique; id; digest binary of 32 bytes): the same with ``suspect``.

    ``suspect`` is true for every row whose digest occurs in another row, and for a few others.
    """
    spark, kind = rows.sparkSession, rows.schema["id"].dataType.simpleString()
    packed = materialise(rows.select("rid", "id", "digest").mapInArrow(_pack, "part long, rows binary, digests binary"), "fingerprints")
    size = packed.agg(F.coalesce(F.sum(F.length("digests") / 32), F.lit(0)).cast("long").alias("n"), F.count("*").alias("parts")).first()
    plan = _Plan(size.n, size.parts)
    messages = packed.select("part", "digests").mapInArrow(_send(plan), "owner long, part long, message binary")
    replies = messages.groupBy("owner").applyInArrow(_answer(plan), "part long, owner long, bitmap binary")

    # A pack and its answers meet again: fingerprints and row ids, no texts.
    return packed.groupBy("part").cogroup(replies.groupBy("part")).applyInArrow(_resolve(plan), f"rid long, id {kind}, digest binary, suspect boolean")


def digest_of(text: Column) -> Column:
    """SHA-256 of the UTF-8 bytes; null counts as the empty text."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _held(slots: int, bits: Broadcast):
    """Rows (id, text) whose digest may be that of a suspect, with their digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.frombuffer(bits.value, np.uint8)
        for batch in batches:
            first = _slots(b"".join([d[:8] for d in batch["digest"].to_pylist()]), slots)
            yield batch.filter(pa.array((marks[first >> 3] >> (first & 7).astype(np.uint8) & 1).astype(bool)))

    return run


def _slots(firsts: bytes, slots: int) -> np.ndarray:
    return (np.frombuffer(firsts, ">u8").astype(np.uint64) % np.uint64(slots)).astype(np.int64)


def _filter_of(digests: DataFrame) -> tuple[int, bytes]:
    """A bitmap of the first 8 bytes of ``digests``: at most ``FILTER_BYTES``, whatever their number.

    Tasks hand on their part of it as (block, 8,192 bytes); the driver sets them together.
    """
    count = digests.count()
    slots = min(FILTER_BYTES * 8, max(1 << 16, 1 << (count * FILTER_BITS - 1).bit_length()))
    block = 1 << 16

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = np.unique(_slots(b"".join(d[:8] for d in batch["digest"].to_pylist()), slots)) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.record_batch([pa.array(first // block), pa.array((first % block).astype(np.int32))], ["block", "place"])

    def bitmap(key: tuple, table: pa.Table) -> pa.Table:
        out = np.zeros(block, np.uint8)
        out[table["place"].to_numpy()] = 1
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(out, bitorder="little").tobytes()], pa.binary())})

    found = digests.select("digest").mapInArrow(marks, "block long, place int").distinct().groupBy("block").applyInArrow(bitmap, "block long, bits binary")
    whole = bytearray(slots // 8)
    for row in found.toLocalIterator():
        whole[row.block * block // 8 : (row.block + 1) * block // 8] = row.bits
    return slots, bytes(whole)


def unequal(docs: DataFrame, digests: DataFrame, text: str, order: str) -> DataFrame:
    """Rows (id, text, digest) of the digests, among ``digests``, that texts of different bytes share.

    All texts whose digest is among ``digests`` are compared byte by byte; with SHA-256 nothing is ever found.
    """
    body = F.coalesce(column(text), F.lit(""))
    slots, bits = _filter_of(digests)
    sent = docs.sparkSession.sparkContext.broadcast(bits)
    kind = docs.schema[order].dataType.simpleString()
    rows = docs.select(column(order).alias("id"), body.alias("text"), digest_of(column(text)).alias("digest"))
    held = rows.mapInArrow(_held(slots, sent), f"id {kind}, text string, digest binary")
    texts = held.groupBy("digest", "text").agg(F.count("*").alias("n"))
    clashes = materialise(texts.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest"), "clashes")
    if clashes.isEmpty():
        return rows.where("false")
    return materialise(held.join(clashes, "digest", "left_semi").select("id", "text", "digest"), "unequal")


def exact_duplicates(docs: DataFrame, text: str = "text", order: str = "doc_id") -> DataFrame:
    """One row for each row of ``docs``: ``order``, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are, which is looked at for all texts of equal digests; null is the empty text.
    Of equal texts the row with the largest ``order`` stays (nulls are smallest); of several rows with that same
    ``order``, repeated rows too, exactly one stays.  ``keep_id`` is the ``order`` of the row that stays.  Texts may be
    of any length.  An empty table gives no rows; other columns are not read.
    """
    found = _judged(docs, text, order)
    return found.select(F.col("id").alias(order), "keep_id", F.col("group_size").cast("long").alias("group_size"), "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def _judged(docs: DataFrame, text: str, order: str) -> DataFrame:
    base = docs.select(column(order).alias("id"), F.monotonically_increasing_id().alias("rid"), digest_of(column(text)).alias("digest"))
    marked = materialise(suspects(base), "suspects")
    nothing = F.lit(None).cast("string").alias("clash")
    alone = marked.where("not suspect").select("id", "digest", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), nothing)
    groups = materialise(marked.where("suspect").groupBy("digest").agg(F.max(F.struct("id", "rid")).alias("top"), F.count("*").alias("group_size")), "groups")
    shared = groups.where("group_size > 1")
    other = unequal(docs, shared, text, order)
    rest = marked.where("suspect").join(other.select("digest").distinct(), "digest", "left_anti")
    joined = rest.join(groups, "digest").select("id", "digest", F.col("top.id").alias("keep_id"), "group_size", (F.col("rid") == F.col("top.rid")).alias("kept"), nothing)
    # Digests that failed: their few rows are grouped by the bytes themselves.
    own = Window.partitionBy("digest", "text")
    place = F.row_number().over(own.orderBy(F.col("id").desc_nulls_last()))
    apart = other.select("id", "digest", F.max("id").over(own).alias("keep_id"), F.count("*").over(own).alias("group_size"), (place == 1).alias("kept"), F.col("text").alias("clash"))
    return alone.unionByName(joined).unionByName(apart)


def _name(order: Column, digest: Column) -> Column:
    """32 bytes that tell a row by its order and its text's digest."""
    return F.unhex(F.sha2(F.concat_ws(":", order.isNull().cast("string"), F.coalesce(order.cast("string"), F.lit("")), F.hex(digest)), 256))


def drop_duplicates(docs: DataFrame, text: str = "text", order: str = "doc_id") -> DataFrame:
    """``docs`` without the rows that ``exact_duplicates`` doesn't keep, with all columns whatever their names.

    A row is told by its order, the digest of its text and, where digests fail, the text; of repeated rows one stays.
    """
    row, clash = fresh(docs.columns, "__row"), fresh(docs.columns, "__clash")
    kept = _judged(docs, text, order).where("kept").select(_name(F.col("id"), F.col("digest")).alias(row), F.col("clash").alias(clash))
    kept = materialise(kept, "kept")
    keyed = docs.withColumn(row, _name(column(order), digest_of(column(text))))
    out = keyed.join(kept.where(F.col(clash).isNull()).select(row), row, "left_semi").dropDuplicates([row])
    failed = kept.where(F.col(clash).isNotNull())
    if not failed.isEmpty():
        told = keyed.withColumn(clash, F.coalesce(column(text), F.lit("")))
        out = out.unionByName(told.join(failed, [row, clash], "left_semi").dropDuplicates([row, clash]).drop(clash))
    return out.drop(row)

"""Ranked lexical search: postings in the order of their impact, scores a group at a time.

Impacts are whole numbers: what a term adds to the score of a document.  A task reads documents' postings in shards of
a bounded size, inverts a shard into lists by term, grouped by exact impact, largest first, and searches every item in
it: the groups of all of the item's terms are processed by falling impact into accumulators.  What is left of each list
bounds what any document can still gain; once no other document can reach the k best any more, the few candidates that
can have their scores completed from their own postings.  The k best that a task has found so far go on into its next
shard as a bound, so later shards stop sooner.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import column, materialise
from .decontaminate import pieces, words_of
from .words import batches_of

#: Postings of a shard that a task inverts at once (about 60 bytes each), and bytes of a batch of texts.
SHARD_POSTINGS, BATCH_BYTES = 1_000_000, 1 << 22
#: Code points of items that are searched together: their terms and lists are sent to all tasks.
QUERY_CHARS = 2_000_000
#: Postings of the first batch of groups (each batch takes twice as many), and candidates for each of the k best
#: that are few enough to be completed.
FIRST_BATCH, FEW = 2_048, 16
#: Parts into which an item's finds are dealt before the last selection.
SALTS = 256


# ---- the score ------------------------------------------------------------------------------------------------


def weight(df: int, documents: int) -> int:
    """A term's weight, from the number of documents that hold it and that of all with terms."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def impacts(weights: np.ndarray, tf: np.ndarray, lengths: np.ndarray, documents: int, total: int) -> np.ndarray:
    """What terms of these weights add to the scores of documents that hold them ``tf`` times and have ``lengths``."""
    m = 10 + (90 * lengths * documents) // max(total, 1)
    return weights * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


# ---- postings -------------------------------------------------------------------------------------------------


_SENT: dict[str, object] = {}


def _once(name: str, make):
    """What ``make`` returns, kept in this worker until another name comes."""
    if name not in _SENT:
        _SENT.clear()
        _SENT[name] = make()
    return _SENT[name]


def _count(terms: Broadcast):
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = _once(name, lambda: {t: i for i, t in enumerate(terms.value)})
        for whole in batches:
            for a, b in batches_of(pc.binary_length(whole["text"]).to_numpy(zero_copy_only=False), BATCH_BYTES):
                batch = whole.slice(a, b - a)
                lengths, own_terms, own_counts = [], [], []
                for text in batch["text"].to_pylist():
                    n, found = 0, Counter()
                    for low, high in pieces(text):
                        words = words_of(text[low:high])
                        n += len(words)
                        found.update(words)
                    both = [(i, c) for i, c in zip(map(number.get, found, repeat(-1)), found.values(), strict=True) if i >= 0]
                    pairs = np.array(both, "<i4").reshape(-1, 2)
                    lengths.append(n)
                    own_terms.append(pairs[:, 0].tobytes())
                    own_counts.append(pairs[:, 1].tobytes())
                yield pa.record_batch([batch["id"], pa.array(lengths, pa.int64()), pa.array(own_terms, pa.binary()), pa.array(own_counts, pa.binary())], ["id", "n", "terms", "counts"])

    return run


def _frequencies(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for batch in batches:
            df += np.bincount(np.frombuffer(b"".join(batch["terms"].to_pylist()), "<i4"), minlength=size)
        seen = np.flatnonzero(df)
        yield pa.record_batch([pa.array(seen), pa.array(df[seen])], ["term", "df"])

    return run


# ---- a shard --------------------------------------------------------------------------------------------------


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start, as many as its size says, one range after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class Shard:
    """The postings of some documents: by document as they came, and inverted by term and falling impact."""

    def __init__(self, doc_sizes: np.ndarray, terms: np.ndarray, impact: np.ndarray, vocabulary: int):
        self.docs = len(doc_sizes)
        self.doc_starts = np.cumsum(doc_sizes) - doc_sizes
        self.doc_sizes, self.terms, self.impact = doc_sizes, terms, impact
        order = np.lexsort((-impact, terms))
        order = order[impact[order] > 0]
        self.posting_docs = np.repeat(np.arange(self.docs), doc_sizes)[order]
        sorted_terms, sorted_impact = terms[order], impact[order]
        new = np.ones(len(order), bool)
        new[1:] = (sorted_terms[1:] != sorted_terms[:-1]) | (sorted_impact[1:] != sorted_impact[:-1])
        #: Groups of postings of a term with one impact: where they start, how many they are, their impact.
        self.starts = np.flatnonzero(new)
        self.sizes = np.diff(np.append(self.starts, len(order)))
        self.levels = sorted_impact[self.starts]
        self.bounds = np.searchsorted(sorted_terms[self.starts], np.arange(vocabulary + 1))
        self.asked = np.zeros(vocabulary, bool)

    def search(self, item: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores), scores above 0 and at least ``least``, among which are all of the ``k`` best of such.

        ``item`` has the numbers of its distinct terms.
        """
        first, count = self.bounds[item], np.diff(self.bounds)[item]
        groups = _ranges(first, count)
        lists = np.repeat(np.arange(len(item)), count)
        falling = np.argsort(-self.levels[groups], kind="stable")
        groups, lists = groups[falling], lists[falling]
        upto = np.cumsum(self.sizes[groups])
        score = np.zeros(self.docs, np.int64)
        done, batch = 0, FIRST_BATCH
        taken = np.zeros(len(item), np.int64)
        while done < len(groups):
            end = max(done + 1, int(np.searchsorted(upto, (upto[done - 1] if done else 0) + batch, "right")))
            some = groups[done:end]
            places = _ranges(self.starts[some], self.sizes[some])
            np.add.at(score, self.posting_docs[places], np.repeat(self.levels[some], self.sizes[some]))
            taken += np.bincount(lists[done:end], minlength=len(item))
            done, batch = end, 2 * batch
            left = taken < count
            rest = int(self.levels[(first + taken)[left]].sum())
            bound = max(least, int(np.partition(score, -k)[-k]) if self.docs >= k else 0)
            # A document that no group has reached yet gains at most the rest; equal scores still matter.
            if rest < bound:
                able = np.flatnonzero(score + rest >= bound)
                if len(able) <= FEW * k:
                    return self._complete(item, able, least)
        found = np.flatnonzero(score >= max(least, 1))
        return found, score[found]

    def _complete(self, item: np.ndarray, docs: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        self.asked[item] = True
        sizes = self.doc_sizes[docs]
        places = _ranges(self.doc_starts[docs], sizes)
        own = np.where(self.asked[self.terms[places]], self.impact[places], 0)
        self.asked[item] = False
        score = np.zeros(len(docs), np.int64)
        np.add.at(score, np.repeat(np.arange(len(docs)), sizes), own)
        good = score >= max(least, 1)
        return docs[good], score[good]


def _search(sent: Broadcast, k: int):
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, items, documents, total = _once(name, lambda: sent.value)
        none = np.zeros(0, np.int64)
        best = [(none, none, none)] * len(items)
        for shard, ids, no_id in _shards(batches, weights, documents, total):
            for i, item in enumerate(items):
                scores, names, nameless = best[i]
                docs, found = shard.search(item, k, int(scores[-1]) if len(scores) == k else 1)
                if len(docs):
                    scores, names, nameless = (np.concatenate(x) for x in ((scores, found), (names, ids[docs]), (nameless, no_id[docs])))
                    order = np.lexsort((names, nameless, -scores))[:k]
                    best[i] = scores[order], names[order], nameless[order]
        lengths = [len(scores) for scores, _, _ in best]
        scores, names, nameless = (np.concatenate([none, *x]) for x in zip(*best, strict=True)) if best else (none, none, none)
        yield pa.record_batch([pa.array(np.repeat(np.arange(len(best)), lengths), pa.int64()), pa.array(names, pa.int64(), mask=nameless > 0), pa.array(scores, pa.int64())], ["item", "id", "score"])

    return run


def _shards(batches: Iterator[pa.RecordBatch], weights: np.ndarray, documents: int, total: int) -> Iterator[tuple[Shard, np.ndarray, np.ndarray]]:
    held: list[pa.RecordBatch] = []
    size = 0

    def made() -> tuple[Shard, np.ndarray, np.ndarray]:
        rows = pa.Table.from_batches(held)
        terms, counts = (np.frombuffer(b"".join(rows[c].to_pylist()), "<i4").astype(np.int64) for c in ("terms", "counts"))
        doc_sizes = pc.binary_length(rows["terms"]).to_numpy().astype(np.int64) // 4
        lengths = np.repeat(rows["n"].to_numpy(), doc_sizes)
        shard = Shard(doc_sizes, terms, impacts(weights[terms], counts, lengths, documents, total), len(weights))
        ids = pc.fill_null(rows["id"], 0).to_numpy()
        return shard, ids, pc.is_null(rows["id"]).to_numpy().astype(np.int64)

    for batch in batches:
        held.append(batch)
        size += sum(pc.binary_length(batch["terms"]).to_pylist()) // 4
        if size >= SHARD_POSTINGS:
            yield made()
            held, size = [], 0
    if held:
        yield made()


# ---- the operator ---------------------------------------------------------------------------------------------


def rank(docs: DataFrame, items: DataFrame, k: int = 10, order: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The ``k`` best documents of each item: ``item``, rank int (from 1), ``order``, score long.

    Only scores above 0 count; equal ones rank by ``order`` (a whole number; null last).  Null texts have no terms, and
    items without terms find nothing.  Texts of any length are counted in pieces.  Repeated documents are ranked each;
    repeated items (equal in id and text) are one, and items that share only the id are ranked each under it.  Empty
    tables give no rows.  Other columns are not read, whatever their names.

    Items are searched ``QUERY_CHARS`` code points of text at a time, so what all tasks get of them is bounded; the
    documents are read once for each such set.
    """
    if not isinstance(docs.schema[order].dataType, T.IntegralType):
        raise TypeError(f"{order} is no whole number")
    texts = docs.select(column(order).cast("long").alias("id"), F.coalesce(column(text), F.lit("")).cast("binary").alias("text"))
    known = items.select(column(item).alias("name"), F.coalesce(column(item_text), F.lit("")).alias("text")).distinct()
    parts = -(-(known.agg(F.sum(F.length("text"))).first()[0] or 1) // QUERY_CHARS)
    if parts > 1:
        known = materialise(known, "items")
    out = None
    for part in range(parts):
        own = known.where(F.pmod(F.xxhash64("name", "text"), F.lit(parts)) == part) if parts > 1 else known
        one = _rank_some(texts, own.select("name", F.col("text").cast("binary").alias("text")).collect(), known.schema["name"].dataType, k)
        out = one if out is None else out.union(one)
    return out.select(F.col("name").alias(item), F.col("rank").cast("int").alias("rank"), F.col("id").cast(docs.schema[order].dataType).alias(order), "score")


def _rank_some(texts: DataFrame, items: list, kind: T.DataType, k: int) -> DataFrame:
    spark = texts.sparkSession
    lists = [sorted(set(words_of(bytes(r.text)))) for r in items]
    terms = sorted({t for own in lists for t in own})
    number = {t: i for i, t in enumerate(terms)}
    counted = texts.mapInArrow(_count(spark.sparkContext.broadcast(terms)), "id long, n long, terms binary, counts binary")
    postings = materialise(counted.where("n > 0"), "postings")
    documents, total = postings.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    partial = postings.select("terms").mapInArrow(_frequencies(len(terms)), "term long, df long")
    weights = np.zeros(len(terms), np.int64)
    for r in partial.groupBy("term").agg(F.sum("df").alias("df")).collect():  # a row for each term of the items
        weights[r.term] = weight(r.df, documents)
    asked = [np.array([number[t] for t in own], np.int64) for own in lists]
    sent = spark.sparkContext.broadcast((weights, asked, documents, total))
    found = postings.mapInArrow(_search(sent, k), "item long, id long, score long")

    # A task finds k documents at most for an item; there may be many tasks.
    by = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("id").asc_nulls_last()))
    salted = found.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    few = salted.withColumn("rank", by("item", "salt")).where(F.col("rank") <= k).select("item", "id", "score")
    ranked = few.withColumn("rank", by("item")).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, r.name) for i, r in enumerate(items)], T.StructType([T.StructField("item", T.LongType()), T.StructField("name", kind)]))
    return ranked.join(F.broadcast(names), "item").select("name", "rank", "id", "score")

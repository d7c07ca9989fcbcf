"""Benchmark decontamination: which words of documents stand in test questions or answers.

Texts are normalised to lower-case words with one blank between them.  Ten consecutive words of an item are a window.
One Aho-Corasick automaton holds every fifth stretch of five words of all items, so each window has one of them in it,
and items too short for a window as a whole; it reads each document once.  Around what it finds, the windows of the
document are looked up among those of the items, word for word.  Hits are told in words and in code points of the
original text.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, materialise
from .words import batches_of

#: Words of a window, and of the stretches that the automaton holds: two of them less a word fit into any window.
WINDOW, BLOCK = 10, 5
#: Code points of items in one automaton, which is built by each worker (about 100 bytes of memory for each).
AUTOMATON_CHARS = 2_000_000
#: Bytes of a text that are looked at together, and bytes of a batch of texts.
PIECE, BATCH_BYTES = 1 << 22, 1 << 22

#: A word's bytes: digits, letters of ASCII and everything above it.
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_NORMAL = bytes(b + 32 if 0x41 <= b <= 0x5A else b if _IS_WORD[b] else 0x20 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_NORMAL).split()


def pieces(text: bytes) -> Iterator[tuple[int, int]]:
    """Stretches of about ``PIECE`` bytes that end where no word goes on."""
    at = 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and _IS_WORD[text[end]]:
            end += 1
        yield at, min(end, len(text))
        at = end


class Passages:
    """The windows of items (number, text) and the automaton that finds where to look for them."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.windows: dict[bytes, list[int]] = {}
        short: dict[bytes, tuple[int, list[int]]] = {}
        blocks: set[bytes] = set()
        for number, text in items:
            words = words_of(text)
            if not words:
                continue
            if len(words) < WINDOW:
                short.setdefault(b" ".join(words), (len(words), []))[1].append(number)
                continue
            for i in range(len(words) - WINDOW + 1):
                self.windows.setdefault(b" ".join(words[i : i + WINDOW]), []).append(number)
            blocks.update(b" ".join(words[i : i + BLOCK]) for i in range(0, len(words) - BLOCK + 1, BLOCK))
        # Bytes as letters of the same number, with a blank on each side so that only whole words are found.
        self.automaton = ahocorasick.Automaton()
        for key in blocks | short.keys():
            self.automaton.add_word(f" {key.decode('latin-1')} ", (key in blocks, *short.get(key, (0, []))))
        if len(self.automaton):
            self.automaton.make_automaton()

    def scan(self, text: bytes) -> tuple[bytearray, set[int]]:
        """A byte for each word of ``text``, 1 where it is hit, and the numbers of the items that occur in it."""
        hit, found, tail = bytearray(), set(), []
        for low, high in pieces(text):
            own = words_of(text[low:high])
            words = tail + own
            base = len(hit) - len(tail)
            hit.extend(bytes(len(own)))
            if len(self.automaton) and words:
                self._scan(words, base, hit, found)
            tail = words[1 - WINDOW :]
        return hit, found

    def _scan(self, words: list[bytes], base: int, hit: bytearray, found: set[int]) -> None:
        line = b" " + b" ".join(words) + b" "
        gaps, after = None, 0
        for end, (block, size, items) in self.automaton.iter(line.decode("latin-1")):
            if gaps is None:
                gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 0x20)
            stop = int(np.searchsorted(gaps, end))
            if size:
                hit[base + stop - size : base + stop] = b"\1" * size
                found.update(items)
            if block:
                for i in range(max(after, stop - WINDOW), min(stop - BLOCK, len(words) - WINDOW) + 1):
                    if numbers := self.windows.get(b" ".join(words[i : i + WINDOW])):
                        hit[base + i : base + i + WINDOW] = b"\1" * WINDOW
                        found.update(numbers)
                after = max(after, stop - BLOCK + 1)


def runs(hit: bytearray) -> np.ndarray:
    """(first, after the last) of each run of hit words."""
    flags = np.concatenate([[0], np.frombuffer(bytes(hit), np.int8), [0]])
    return np.flatnonzero(np.diff(flags)).reshape(-1, 2)


def offsets(text: bytes, spans: np.ndarray) -> np.ndarray:
    """Spans of words as spans of code points of ``text``."""
    out, words, points = np.zeros_like(spans), 0, 0
    for low, high in pieces(text):
        data = np.frombuffer(text, np.uint8, high - low, low)
        inside = np.concatenate([[False], _IS_WORD[data], [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1]).reshape(-1, 2)
        before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)]) + points
        for side, place in ((0, spans[:, 0]), (1, spans[:, 1] - 1)):
            here = (place >= words) & (place < words + len(edges))
            out[here, side] = before[edges[place[here] - words, side]]
        words, points = words + len(edges), int(before[-1])
    return out


_KNOWN: dict[str, Passages] = {}


def _find(items: Broadcast):
    name_of_set = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name_of_set not in _KNOWN:
            _KNOWN.clear()
            _KNOWN[name_of_set] = Passages([(i, text) for i, (_, text) in enumerate(items.value)])
        passages, names = _KNOWN[name_of_set], [name for name, _ in items.value]
        for whole in batches:
            for a, b in batches_of(pc.binary_length(whole["text"]).to_numpy(zero_copy_only=False), BATCH_BYTES):
                batch = whole.slice(a, b - a)
                counts, spans, told = [], [], []
                for text in batch["text"].to_pylist():
                    hit, found = passages.scan(text)
                    own = runs(hit) if found else np.zeros((0, 2), np.int64)
                    counts.append(len(hit))
                    spans.append([dict(zip(_SPAN, x, strict=True)) for x in np.hstack([own, offsets(text, own)]).tolist()] if found else [])
                    told.append(sorted({names[i] for i in found}))
                kept = [batch[c] for c in batch.schema.names if c != "text"]
                kind = pa.list_(pa.struct([(c, pa.int64()) for c in _SPAN]))
                made = [pa.array(counts, pa.int64()), pa.array(spans, kind), pa.array(told, pa.list_(pa.string()))]
                yield pa.record_batch(kept + made, [*(c for c in batch.schema.names if c != "text"), "n_words", "spans", "items"])

    return run


#: A run of hit words: its first word and the one after it, and the same in code points of the text.
_SPAN = ("first", "after", "start", "end")
_SPANS = f"array<struct<{', '.join(f'{c}: bigint' for c in _SPAN)}>>"
_MADE = f"n_words long, spans {_SPANS}, items array<string>"


def find_passages(docs: DataFrame, items: DataFrame, order: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """For each row of ``docs``: ``order``, n_words, n_hit (long), spans and items.

    ``spans`` are the runs of hit words, from ``first`` to before ``after`` in words and from ``start`` to before
    ``end`` in code points of the text, from 0.  ``items`` are the ids of occurring items as strings, sorted.

    A word is hit if it lies in a window of ten words of an item, or in a whole item of fewer words; items without
    words occur nowhere.  Null texts have no words; texts of any length are read in pieces.  Repeated rows are judged
    each; an empty table gives no rows, and without items nothing is hit.  Items with the same id are one item; a null
    id is the empty string.  Other columns are not read, whatever their names.

    Up to ``AUTOMATON_CHARS`` code points of items go into one automaton, which is sent to all tasks.  More items are
    dealt to as many automata as that takes, and documents are read once for each.
    """
    spark, kind = docs.sparkSession, docs.schema[order].dataType.simpleString()
    rows = docs.select(column(order).alias("id"), F.coalesce(column(text), F.lit("")).cast("binary").alias("text"))
    known = items.select(F.coalesce(column(item).cast("string"), F.lit("")).alias("name"), F.coalesce(column(item_text), F.lit("")).alias("text")).distinct()
    parts = -(-(known.agg(F.sum(F.length("text"))).first()[0] or 1) // AUTOMATON_CHARS)
    if parts > 1:
        known = materialise(known, "items")
        rows = materialise(rows.withColumn("rid", F.monotonically_increasing_id()), "documents")
    found = None
    for part in range(parts):
        own = known.where(F.pmod(F.xxhash64("name", "text"), F.lit(parts)) == part) if parts > 1 else known
        sent = spark.sparkContext.broadcast([(r.name, bytes(r.text)) for r in own.select("name", F.col("text").cast("binary").alias("text")).collect()])
        keys = f"id {kind}, rid long" if parts > 1 else f"id {kind}"
        one = rows.select("text", *[c for c in ("id", "rid") if c in rows.columns]).mapInArrow(_find(sent), f"{keys}, {_MADE}")
        if parts > 1:
            one = materialise(one.where("size(items) > 0") if part else one, "passages")
        found = one if found is None else found.unionByName(one)
    if parts > 1:
        spans = F.flatten(F.collect_list("spans")).alias("spans")
        names = F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
        found = found.groupBy("rid").agg(F.first("id").alias("id"), F.max("n_words").alias("n_words"), spans, names)
        found = found.withColumn("spans", _united("spans"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, r: n + r["after"] - r["first"])
    return found.select(F.col("id").alias(order), "n_words", n_hit.alias("n_hit"), "spans", "items")


def _united(name: str):
    """The union of a document's runs: sorted, and joined where they meet."""
    start = F.array().cast(_SPANS)

    def put(done, run):
        last = F.try_element_at(done, F.lit(-1))
        both = F.struct(last["first"].alias("first"), F.greatest(last["after"], run["after"]).alias("after"), last["start"].alias("start"), F.greatest(last["end"], run["end"]).alias("end"))
        meets = F.coalesce(last["after"] >= run["first"], F.lit(False))
        return F.when(meets, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(both))).otherwise(F.concat(done, F.array(run)))

    return F.aggregate(F.array_sort(name), start, put)

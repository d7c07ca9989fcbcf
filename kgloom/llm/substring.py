"""Substring dedup with suffix automata of reference shards.

A window is a run of words of fixed length.  Documents are cut into runs of windows that share a minimizer (the least
hash among the 16-word grams of a window), so equal windows have equal minimizers.  Runs whose minimizer only one text
has are left out, the others are trimmed to windows whose hash two texts have; this only routes: it says which
stretches may be shared, not which are.

The reference is the corpus itself: its distinct stretches, in the order of their minimizers, are cut into shards of a
bounded number of words.  Of each shard a suffix automaton is built and frozen into sorted arrays; its states know the
smallest document of their occurrences.  Every stretch of every document is then streamed through the automata of the
shards that hold its minimizer.  The matching statistics tell, for each window, in which document it stands first,
word for word, and so the maximal spans to remove.

Automata aren't sent to documents, as those of a corpus grow with it and are over ten times its words: the stretches
go to the shards and stream past their automata, so a task holds one automaton of bounded size, whatever it is asked.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, materialise, one_of_each, row_key, tasks_for
from .words import batches_of, window_hashes, word_hashes

#: Words of a gram; the minimizer of a window is the least hash of its grams.
GRAM = 16
#: Words of a shard, at most (a longer stretch makes a shard of its own): about 10 MB of arrays.
SHARD_WORDS = 100_000
#: Shards that a task builds one after the other.
TASK_SHARDS = 10
#: Bytes of text that a worker looks at together, and stretches that it streams together.
BATCH_BYTES, BATCH_SEGMENTS = 1_000_000, 2_000
#: Stands for a null order, above all others.
LAST = (1 << 63) - 1


# ---- windows --------------------------------------------------------------------------------------------------


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` consecutive values."""
    if len(values) < width:
        return values[:0]
    out, span = values, 1
    while span * 2 <= width:
        out = np.minimum(out[: len(out) - span], out[span:])
        span *= 2
    return np.minimum(out[: len(values) - width + 1], out[width - span : width - span + len(values) - width + 1])


def runs_of(hashes: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(minimizer, first window, number of windows, text) of the runs of windows in all texts.

    Windows are numbered by their first word over all texts; runs stay within a text.
    """
    least = sliding_min(window_hashes(hashes, GRAM), size - GRAM + 1)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(least)]
    valid = np.arange(len(least)) + size <= bounds[text + 1]
    at = np.flatnonzero(valid)
    if not len(at):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    new = np.concatenate([[True], (np.diff(at) != 1) | (least[at][1:] != least[at][:-1]) | (text[at][1:] != text[at][:-1])])
    first = np.flatnonzero(new)
    return least[at[first]], at[first], np.diff(np.append(first, len(at))), text[at[first]]


def _texts(whole: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    sizes = pc.binary_length(whole["text"]).to_numpy(zero_copy_only=False)
    for a, b in batches_of(sizes, BATCH_BYTES):
        batch = whole.slice(a, b - a)
        yield batch, batch["text"].to_pylist()


def _scan(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, texts in _texts(whole):
                hashes, _, _, bounds = word_hashes(texts)
                least, first, count, text = runs_of(hashes, bounds, size)
                offsets = np.searchsorted(text, np.arange(len(texts) + 1)).astype(np.int32)
                items = pa.StructArray.from_arrays([pa.array(least.view(np.int64)), pa.array((first - bounds[text]).astype(np.int32)), pa.array(count.astype(np.int32))], ["m", "start", "count"])
                digests = [hashlib.sha256(b" ".join(t.split())).digest() for t in texts]
                yield pa.record_batch([batch["rid"], batch["id"], batch["row"], pa.array(np.diff(bounds)), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), items)], ["rid", "id", "row", "n_words", "digest", "runs"])

    return run


def _window_hashes(size: int):
    """(rid, m, start, hashes) for each candidate run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, texts in _texts(whole):
                hashes, _, _, bounds = word_hashes(texts)
                windows = window_hashes(hashes, size).view(np.int64)
                rows: list[tuple] = []
                for row, low, runs in zip(batch["rid"].to_pylist(), bounds.tolist(), batch["runs"].to_pylist(), strict=False):
                    rows += [(row, r["m"], r["start"], windows[low + r["start"] : low + r["start"] + r["count"]]) for r in runs]
                values = [x[3] for x in rows]
                offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
                flat = pa.array(np.concatenate(values) if values else np.zeros(0, np.int64))
                yield pa.record_batch(
                    [pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.int64()), pa.array([x[2] for x in rows], pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), flat)],
                    ["rid", "m", "start", "hashes"],
                )

    return run


def _segments(size: int):
    """(rid, id, start, m, segment, name) for each maximal stretch of windows of a run that may be shared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, texts in _texts(whole):
                rows: list[tuple] = []
                for row, order, text, found in zip(batch["rid"].to_pylist(), batch["id"].to_pylist(), texts, batch["windows"].to_pylist(), strict=True):
                    words = text.split()
                    places = sorted((w["start"], w["m"]) for w in found)
                    at = 0
                    for i in range(1, len(places) + 1):
                        if i == len(places) or places[i][0] != places[i - 1][0] + 1 or places[i][1] != places[i - 1][1]:
                            start, m = places[at]
                            part = b" ".join(words[start : places[i - 1][0] + size])
                            rows.append((row, order, start, m, part, hashlib.blake2b(part, digest_size=32).digest()))
                            at = i
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.record_batch([pa.array([x[i] for x in rows], k) for i, k in enumerate(kinds)], ["rid", "id", "start", "m", "segment", "name"])

    return run


# ---- automata -------------------------------------------------------------------------------------------------


class Builder:
    """A suffix automaton of several sequences of symbols while it grows, with a label for each of them.

    Edges are kept in arrays, those of a state as a chain; one table finds an edge by state and symbol.
    """

    def __init__(self) -> None:
        self.edge: dict[int, int] = {}
        self.symbol: list[int] = []
        self.target: list[int] = []
        self.chain: list[int] = []
        self.first = [-1]
        self.link = [-1]
        self.length = [0]
        self.label = [LAST]

    def _state(self, link: int, length: int) -> int:
        self.first.append(-1)
        self.link.append(link)
        self.length.append(length)
        self.label.append(LAST)
        return len(self.link) - 1

    def _connect(self, state: int, symbol: int, target: int) -> None:
        self.edge[state << 32 | symbol] = len(self.target)
        self.symbol.append(symbol)
        self.target.append(target)
        self.chain.append(self.first[state])
        self.first[state] = len(self.target) - 1

    def _split(self, p: int, q: int, symbol: int) -> int:
        """A copy of ``q`` for the shorter strings that lead there, by way of ``p`` and its suffixes."""
        copy = self._state(self.link[q], self.length[p] + 1)
        at = self.first[q]
        while at >= 0:
            self._connect(copy, self.symbol[at], self.target[at])
            at = self.chain[at]
        self.link[q] = copy
        edge, target = self.edge, self.target
        while p >= 0 and target[edge[p << 32 | symbol]] == q:
            target[edge[p << 32 | symbol]] = copy
            p = self.link[p]
        return copy

    def add(self, sequence: list[int], label: int) -> None:
        last, edge, target, link, length = 0, self.edge, self.target, self.link, self.length
        symbols, chain, first = self.symbol, self.chain, self.first
        for symbol in sequence:
            at = edge.get(last << 32 | symbol, -1)
            if at >= 0:
                q = target[at]
                last = q if length[q] == length[last] + 1 else self._split(last, q, symbol)
            else:
                new, p = self._state(0, length[last] + 1), last
                while p >= 0 and (key := p << 32 | symbol) not in edge:
                    edge[key] = len(target)
                    symbols.append(symbol)
                    target.append(new)
                    chain.append(first[p])
                    first[p] = len(target) - 1
                    p = link[p]
                if p >= 0:
                    q = target[edge[p << 32 | symbol]]
                    link[new] = q if length[q] == length[p] + 1 else self._split(p, q, symbol)
                last = new
            if label < self.label[last]:
                self.label[last] = label


class SuffixAutomaton:
    """A finished automaton: edges sorted by state and symbol, and for each state its suffix link, the length of its
    longest string and the least label of the sequences that it occurs in."""

    def __init__(self, keys: np.ndarray, targets: np.ndarray, link: np.ndarray, length: np.ndarray, label: np.ndarray):
        self.keys, self.targets, self.link, self.length, self.label = keys, targets, link, length, label

    @classmethod
    def of(cls, sequences: list[list[int]], labels: list[int]) -> SuffixAutomaton:
        built = Builder()
        for sequence, label in zip(sequences, labels, strict=True):
            built.add(sequence, label)
        keys = np.fromiter(built.edge.keys(), np.int64, len(built.edge))
        targets = np.array(built.target, np.int32)[np.fromiter(built.edge.values(), np.int64, len(built.edge))]
        order = np.argsort(keys)
        link, length, label = np.array(built.link, np.int32), np.array(built.length, np.int32), np.array(built.label, np.int64)
        # Labels go up the suffix links, longest strings first.
        by = np.argsort(-length, kind="stable")
        cuts = np.flatnonzero(np.diff(length[by], prepend=-1))
        for a, b in zip(cuts, np.append(cuts[1:], len(by)), strict=True):
            some = by[a:b]
            some = some[link[some] >= 0]
            np.minimum.at(label, link[some], label[some])
        return cls(keys[order], targets[order], link, length, label)

    def least(self, sequences: list[np.ndarray], size: int) -> list[np.ndarray]:
        """For every window of ``size`` symbols of each sequence the least label of a sequence that has it (``LAST`` if
        none has).  All sequences are read side by side, a symbol at a time; negative symbols stand nowhere."""
        lengths = np.array([len(x) for x in sequences], np.int64)
        order = np.argsort(-lengths, kind="stable")
        starts = np.concatenate([[0], np.cumsum(lengths)])[:-1][order]
        codes = np.concatenate([np.asarray(x, np.int64) for x in sequences]) if len(sequences) else np.zeros(0, np.int64)
        widths = np.maximum(lengths - size + 1, 0)
        places = np.concatenate([[0], np.cumsum(widths)])
        out = np.full(int(places[-1]), LAST, np.int64)
        first = places[:-1][order]
        state, matched = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        ended = lengths[order]
        for t in range(int(lengths.max(initial=0))):
            active = int(np.searchsorted(-ended, -t, side="left"))
            symbol = codes[starts[:active] + t]
            open_ = np.flatnonzero(symbol >= 0)
            lost = np.flatnonzero(symbol < 0)
            state[lost] = matched[lost] = 0
            while len(open_):
                key = state[open_] << 32 | symbol[open_]
                at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
                hit = self.keys[at] == key if len(self.keys) else np.zeros(len(open_), bool)
                went = open_[hit]
                state[went] = self.targets[at[hit]]
                matched[went] += 1
                open_ = open_[~hit]
                stuck = state[open_] == 0
                matched[open_[stuck]] = 0
                open_ = open_[~stuck]
                state[open_] = self.link[state[open_]]
                matched[open_] = self.length[state[open_]]
            # The shortest strings that still hold a window are those that occur most.
            far = np.arange(active)
            while len(far):
                up = self.link[state[far]]
                far, up = far[up >= 0], up[up >= 0]
                more = self.length[up] >= size
                far, up = far[more], up[more]
                state[far] = up
                matched[far] = self.length[up]
            if t + 1 >= size:
                out[first[:active] + t + 1 - size] = np.where(matched[:active] >= size, self.label[state[:active]], LAST)
        return [out[a:b] for a, b in zip(places[:-1], places[1:], strict=True)]


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches (m, name, segment, least) in the order of m, with the shard that each belongs to."""
    total, shard = 0, 0
    for batch in batches:
        shards = []
        for m, segment in zip(batch["m"].to_pylist(), batch["segment"].to_pylist(), strict=True):
            words = segment.count(b" ") + 1
            if not total or total + words > SHARD_WORDS:
                # The name of a shard needs only be its own: its first stretch stands in no other.
                shard, total = int.from_bytes(hashlib.blake2b(segment, digest_size=8, key=m.to_bytes(8, "little", signed=True)).digest(), "little", signed=True), 0
            total += words
            shards.append(shard)
        yield pa.record_batch([pa.array(shards, pa.int64()), *batch.columns], ["shard", *batch.schema.names])


class _Shard:
    """The reference of one shard: its stretches as they come, and their automaton once it is asked."""

    def __init__(self, number: int):
        self.number, self.numbers = number, {}
        self.names: list[bytes] = []
        self.sequences: list[list[int]] = []
        self.labels: list[int] = []
        self.automaton: SuffixAutomaton | None = None

    def add(self, rows: pa.RecordBatch) -> None:
        numbers = self.numbers
        self.names += rows["name"].to_pylist()
        self.sequences += [[numbers.setdefault(w, len(numbers)) for w in s.split(b" ")] for s in rows["segment"].to_pylist()]
        self.labels += rows["least"].to_pylist()

    def found(self, names: list[bytes], sequences: list, size: int) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(names), BATCH_SEGMENTS):
            found = self.automaton.least([np.asarray(s, np.int64) for s in sequences[at : at + BATCH_SEGMENTS]], size)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            yield pa.record_batch([pa.array(names[at : at + BATCH_SEGMENTS], pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))], ["name", "firsts"])

    def own(self, size: int) -> Iterator[pa.RecordBatch]:
        """The shard's own stretches, streamed through its automaton."""
        if self.automaton is None:
            self.automaton = SuffixAutomaton.of(self.sequences, self.labels)
            names, sequences = self.names, self.sequences
            self.names, self.sequences, self.labels = [], [], []
            yield from self.found(names, sequences, size)

    def asked(self, rows: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
        """Stretches of other shards."""
        yield from self.own(size)
        get = self.numbers.get
        yield from self.found(rows["name"].to_pylist(), [[get(w, -1) for w in s.split(b" ")] for s in rows["segment"].to_pylist()], size)


def _stream(size: int):
    """Of rows in the order of their shard, its reference first: (name, firsts) of all its stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: _Shard | None = None
        for batch in batches:
            shards, asked = batch["shard"].to_numpy(), batch["is_query"].to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((shards[1:] != shards[:-1]) | (asked[1:] != asked[:-1])) + 1).tolist(), len(shards)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if shard is None or shard.number != int(shards[a]):
                    if shard is not None:
                        yield from shard.own(size)
                    shard = _Shard(int(shards[a]))
                if asked[a]:
                    yield from shard.asked(batch.slice(a, b - a), size)
                else:
                    shard.add(batch.slice(a, b - a))
        if shard is not None:
            yield from shard.own(size)

    return run


def _remove(size: int):
    """Of rows with the windows to remove: n_removed and the kept words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, texts in _texts(whole):
                kept, removed = [], []
                for text, spans in zip(texts, batch["spans"].to_pylist(), strict=True):
                    words = text.split()
                    edges = np.zeros(len(words) + 1, np.int64)
                    starts = np.array([s for span in spans for s in span], np.int64)
                    np.add.at(edges, starts, 1)
                    np.add.at(edges, starts + size, -1)
                    out = np.cumsum(edges)[:-1] > 0
                    removed.append(int(out.sum()))
                    kept.append(b" ".join([w for w, gone in zip(words, out.tolist(), strict=True) if not gone]))
                yield pa.record_batch([batch["digest"], pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], ["digest", "n_removed", "kept"])

    return run


# ---- the operator ---------------------------------------------------------------------------------------------


def remove_repeats(docs: DataFrame, size: int = 50, text: str = "text", order: str = "doc_id", with_text: bool = False) -> DataFrame:
    """One row for each row of ``docs``: ``order``, n_words, n_removed, kept_sha256 (and ``kept_text``).

    A word is removed if a window of ``size`` words over it stands, word for word, also in a row with a smaller
    ``order`` (an integer; null counts as larger than all).  Windows are judged on the input.  ``kept_sha256`` is of
    the kept words joined by one space.  Texts of fewer than ``size`` words, null and empty ones too, lose nothing;
    texts may be of any length.  Rows with equal ``order`` remove nothing from each other, so repeated rows have equal
    results.  An empty table gives no rows; other columns are not read.

    Rows of the same words (by SHA-256) are judged once, as the one with the smallest order: what that one keeps, all
    of that order keep, and those of a larger order keep nothing, as all their windows stand in it.
    """
    kind = docs.schema[order].dataType.simpleString()
    rows = docs.select(column(order).cast("long").alias("id"), row_key(column(order), column(text)).alias("row"), F.coalesce(column(text), F.lit("")).cast("binary").alias("text"))
    scanned = rows.select(F.monotonically_increasing_id().alias("rid"), "id", "row", "text")
    base = materialise(scanned.mapInArrow(_scan(size), "rid long, id long, row binary, n_words long, digest binary, runs array<struct<m:long,start:int,count:int>>"), "runs")
    spark = docs.sparkSession

    placed = F.struct(F.coalesce("id", F.lit(LAST)).alias("id"), "rid")
    tops = base.where(F.col("n_words") >= size).groupBy("digest").agg(F.min(placed).alias("top"), F.count("*").alias("n"))
    tops = materialise(tops.select("digest", "top.id", "top.rid", "n"), "texts")

    own = base.where(F.size("runs") > 0).select("rid", "runs").join(tops.select("rid"), "rid", "left_semi")
    runs = materialise(own.select("rid", F.explode("runs").alias("r")).select("rid", "r.m", "r.start", "r.count"), "own-runs")
    shared = runs.groupBy("m").agg(F.min("rid").alias("x"), F.max("rid").alias("y")).where("x <> y").select("m")
    near = runs.join(materialise(shared, "minimizers"), "m").groupBy("rid").agg(F.collect_set(F.struct("m", "start", "count")).alias("runs"))
    named = near.join(tops.select("rid", "id", "digest"), "rid").join(base.select("rid", "row"), "rid")
    candidates = materialise(one_of_each(rows.select("row", "text"), named, base.select("row")), "candidates")

    windows = candidates.mapInArrow(_window_hashes(size), "rid long, m long, start int, hashes array<long>")
    windows = materialise(windows.select("rid", "m", "start", F.posexplode("hashes").alias("i", "hash")).select("rid", "m", (F.col("start") + F.col("i")).alias("start"), "hash"), "windows")
    twice = windows.groupBy("hash").agg(F.min("rid").alias("x"), F.max("rid").alias("y")).where("x <> y").select("hash")
    held = windows.join(materialise(twice, "hashes"), "hash").groupBy("rid").agg(F.collect_set(F.struct("start", "m")).alias("windows"))
    cut = candidates.select("rid", "id", "text").join(held, "rid").select("rid", "id", "text", "windows")
    segments = materialise(cut.mapInArrow(_segments(size), "rid long, id long, start int, m long, segment binary, name binary"), "segments")

    first = segments.groupBy("name").agg(F.min("id").alias("least"), F.first("m").alias("m"), F.first("segment").alias("segment"))
    distinct = materialise(first.withColumn("n", F.size(F.split(F.col("segment").cast("string"), " "))), "distinct-segments")
    words = distinct.agg(F.sum("n")).first()[0] or 0
    tasks = tasks_for(spark, words, TASK_SHARDS * SHARD_WORDS)

    # Shards are cut from stretches in the order of their minimizers; one that has more than a shard's words is dealt
    # to several tasks.
    large = distinct.groupBy("m").agg(F.sum("n").alias("n")).where(F.col("n") > SHARD_WORDS).select("m", F.ceil(F.col("n") / SHARD_WORDS).cast("int").alias("salts"))
    salted = distinct.join(materialise(large, "large-minimizers"), "m", "left").withColumn("salt", F.pmod(F.xxhash64("name"), F.coalesce("salts", F.lit(1))))
    ordered = salted.repartition(tasks, "m", "salt").sortWithinPartitions("m", "salt").select("m", "name", "segment", "least")
    dealt = materialise(ordered.mapInArrow(_deal, "shard long, m long, name binary, segment binary, least long"), "shards")

    # A shard's own stretches ask its automaton, and so do those of others that share a minimizer with it.
    where = dealt.select(F.col("shard").alias("to"), "m").distinct()
    others = dealt.join(where, "m").where("shard <> to").select(F.col("to").alias("shard"), F.lit(True).alias("is_query"), "name", "segment", "least")
    met = dealt.select("shard", F.lit(False).alias("is_query"), "name", "segment", "least").unionByName(others)
    met = met.repartition(tasks, "shard").sortWithinPartitions("shard", "is_query")
    answers = met.mapInArrow(_stream(size), "name binary, firsts array<long>").groupBy("name").agg(F.collect_list("firsts").alias("all"))
    both = F.aggregate(F.slice("all", 2, F.size("all")), F.get("all", F.lit(0)), lambda a, b: F.zip_with(a, b, lambda x, y: F.least(x, y)))
    # Stored, so that the join of a stretch that many documents have can be split.
    least = materialise(answers.select("name", both.alias("firsts")), "matched")
    hits = segments.join(least, "name").select("rid", F.filter(F.transform("firsts", lambda x, i: F.when(x < F.col("id"), F.col("start") + i)), lambda x: x.isNotNull()).alias("span"))
    spans = hits.where(F.size("span") > 0).groupBy("rid").agg(F.collect_list("span").alias("spans"))
    partly = candidates.select("rid", "digest", "text").join(spans, "rid").mapInArrow(_remove(size), "digest binary, n_removed long, kept binary")
    partly = partly.select("digest", "n_removed", F.sha2("kept", 256).alias("changed"), *[F.col("kept").cast("string").alias("kept_text")] * with_text).dropDuplicates(["digest"])

    # Of each text that stands several times or loses words: the smallest order, and what its row keeps.
    results = tops.join(partly, "digest", "left").where("n > 1 or n_removed is not null").select("digest", F.col("id").alias("least"), "n_removed", "changed", *["kept_text"] * with_text)
    out = base.select("id", "row", "n_words", "digest").join(materialise(results, "changed"), "digest", "left")
    later = F.coalesce(F.coalesce("id", F.lit(LAST)) > F.col("least"), F.lit(False))
    removed = F.when(later, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long")
    nothing = hashlib.sha256(b"").hexdigest()
    sha = F.when(later, F.lit(nothing)).otherwise(F.coalesce("changed", F.lower(F.hex("digest"))))
    result = out.select(F.col("id").cast(kind).alias(order), "row", "n_words", removed.alias("n_removed"), sha.alias("kept_sha256"), *[F.when(later, "").otherwise(F.col("kept_text")).alias("kept_text")] * with_text)
    if with_text:
        whole = docs.select(row_key(column(order), column(text)).alias("row"), column(text).alias("__text")).dropDuplicates(["row"])
        words_again = F.array_join(F.filter(F.split(F.coalesce("__text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != ""), " ")
        result = result.join(whole, "row").withColumn("kept_text", F.coalesce("kept_text", words_again)).drop("__text")
    return result.drop("row")

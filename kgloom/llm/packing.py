"""Packing token sequences by non-negative least squares.

Documents are tokenised once.  Each is cut into whole windows, which are sequences of their own, and a rest shorter
than a window.  Rests are binned by length.  Shallow combinations of bins (up to three different lengths, each as
often as it fits) that fill a window exactly are enumerated, and non-negative least squares finds how often to repeat
each of them so that they use up the histogram of bins.  Repeat counts are rounded down.  What is left over, together
with a share of the rests that is held back for it, is packed greedily: as one stream of tokens it first fills the
gaps that rounding lengths up to bins has left, a fragment each, and then windows of its own.
"""

from __future__ import annotations

import codecs
import json
import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, number_within, running_total

#: Different lengths in a combination.
DEPTH = 3
#: Bins of a window.
BINS = 64
#: Chunks of text whose tokens a worker remembers.
CACHE = 400_000

_GAP = re.compile(r"[\x20\x09-\x0D]+")


# ---- tokens ---------------------------------------------------------------------------------------------------


#: The normaliser and pre-tokenizer that the short way below stands for.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_ASCII_SPLIT = re.compile(_SPLIT.replace(r"[\p{L}]", "[a-z]").replace(r"[\p{N}]", "[0-9]").replace(r"[^\s\p{L}\p{N}]", r"[^\x20\x09-\x0Da-z0-9]"))


def _byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in a byte-level vocabulary: visible ones for themselves, the others above 255."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(others)}


class ChunkTokenizer(dict):
    """Tokens of whole texts, from the remembered tokens of their chunks between white space (chunk -> ids as bytes).

    It holds for tokenizers that drop white space and never join what stands on both sides of it.  With the normaliser
    and pre-tokenizer named above, a chunk of letters, or of ASCII, goes to the vocabulary's own merges without them.
    """

    def __init__(self, definition: str, limit: int = CACHE):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_str(definition)
        self.width = "<u2" if self.inner.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"
        self.size = np.dtype(self.width).itemsize
        self.limit = limit
        said = json.loads(definition)
        steps = (said.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        self.short = said.get("normalizer") == _NORMALIZER and steps[0].get("pattern") == {"Regex": _SPLIT} and steps[-1].get("type") == "ByteLevel"
        self.marks = [t["content"] for t in said.get("added_tokens", [])]
        letters = _byte_letters()
        self.letters = "".join([letters[b] for b in range(256)])
        self.merge = self.inner.model.tokenize
        last = max(self.inner.get_vocab(with_added_tokens=True).values(), default=-1)
        self.bytes_of = [i.to_bytes(self.size, "little") for i in range(last + 1)]

    def __missing__(self, chunk: str) -> bytes:
        if len(self) > self.limit:
            self.clear()
        tail = chunk[-1] if chunk[-1] in ".," else ""
        core = chunk[: len(chunk) - len(tail)]
        # As the normaliser does, so letters that it takes apart aren't letters alone any more.
        low = core.lower() if core.isascii() else unicodedata.normalize("NFC", core).lower()
        # A final sigma depends on what stands around it; other letters fall to lower case one by one.
        plain = low.isascii() or "\u03c2" not in low and "\u03c3" not in low and unicodedata.is_normalized("NFC", low)
        if self.short and low.isalpha() and plain:
            if low != chunk:
                out = self[low] + self[tail] if tail else self[low]
            else:
                out = self._ids(self.merge(codecs.charmap_decode(low.encode(), "strict", self.letters)[0]))
        elif self.short and chunk.isascii() and chunk.isprintable() and not any(m in chunk for m in self.marks):
            out = b"".join([self._ids(self.merge(part)) for part in _ASCII_SPLIT.findall(chunk.lower())])
        else:
            out = np.array(self.inner.encode_batch_fast([chunk], add_special_tokens=False)[0].ids, self.width).tobytes()
        self[chunk] = out
        return out

    def _ids(self, tokens: list) -> bytes:
        bytes_of = self.bytes_of
        return b"".join([bytes_of[t.id] for t in tokens])

    def texts(self, texts: list[str | None]) -> list[bytes]:
        return [b"".join(map(self.__getitem__, _chunks(t))) if t else b"" for t in texts]


def _chunks(text: str) -> list[str]:
    # str.split also parts at 0x1C to 0x1F, which are no white space to a tokenizer.
    if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
        return [c for c in _GAP.split(text) if c]
    return text.split()


_TOKENIZERS: dict[int, ChunkTokenizer] = {}


def _tokenise(definition: Broadcast, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = hash(definition.value)
        if name not in _TOKENIZERS:
            _TOKENIZERS.clear()
            _TOKENIZERS[name] = ChunkTokenizer(definition.value)
        tokenizer = _TOKENIZERS[name]
        last = np.array([end], tokenizer.width).tobytes()
        size = len(last)
        for batch in batches:
            for part in _slices(batch, 256):
                ids = [x + last for x in tokenizer.texts(part["text"].to_pylist())]
                yield pa.record_batch([part["rid"], part["doc_id"], pa.array([len(x) // size for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["rid", "doc_id", "n", "ids"])

    return run


def _slices(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def tokenise(docs: DataFrame, tokenizer_path: str, end: int) -> tuple[DataFrame, str]:
    """(rid, doc_id, n, ids) of ``docs`` (doc_id, text), stored, and the number type of ``ids``.

    Every row has a number ``rid`` of its own, repeated ones too; a text of any length is one row, held by one task.

    The tokenizer's file is read by the driver and broadcast (a few MB that don't depend on the data).
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        definition = file.read()
    width = ChunkTokenizer(definition).width
    sent = docs.sparkSession.sparkContext.broadcast(definition)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text")
    return materialise(rows.mapInArrow(_tokenise(sent, end), f"rid long, doc_id {kind}, n long, ids binary"), "tokens"), width


# ---- the plan -------------------------------------------------------------------------------------------------


def combinations(bins: int, depth: int = DEPTH) -> np.ndarray:
    """All ways to write ``bins`` as a sum with at most ``depth`` different summands: rows of counts by summand - 1."""
    found: list[dict[int, int]] = []

    def extend(rest: int, least: int, left: int, chosen: dict[int, int]) -> None:
        if rest == 0:
            found.append(dict(chosen))
            return
        if left == 0:
            return
        if left == 1:
            for a in range(least, rest + 1):
                if rest % a == 0:
                    found.append({**chosen, a: rest // a})
            return
        for a in range(least, rest + 1):
            for times in range(1, rest // a + 1):
                chosen[a] = times
                extend(rest - a * times, a + 1, left - 1, chosen)
                del chosen[a]

    extend(bins, 1, depth, {})
    out = np.zeros((len(found), bins))
    for i, x in enumerate(found):
        for a, times in x.items():
            out[i, a - 1] = times
    return out


def nnls(matrix: np.ndarray, target: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """argmin |matrix x - target| over x >= 0, by Lawson and Hanson's active set method."""
    x = np.zeros(matrix.shape[1])
    active: list[int] = []
    tolerance = 1e-9 * max(1.0, float(np.abs(target).max(initial=0.0))) * max(1.0, float(np.abs(matrix).max(initial=0.0)))
    for _ in range(rounds):
        gradient = matrix.T @ (target - matrix @ x)
        gradient[active] = -np.inf
        best = int(np.argmax(gradient))
        if gradient[best] <= tolerance:
            break
        active.append(best)
        while True:
            solved = np.linalg.lstsq(matrix[:, active], target, rcond=None)[0]
            if solved.min() > 0:
                break
            now = x[active]
            low = solved <= 0
            step = np.min(now[low] / np.maximum(now[low] - solved[low], 1e-300))
            moved = now + step * (solved - now)
            x[:] = 0
            keep = moved > 1e-12
            x[np.array(active)[keep]] = moved[keep]
            active = [a for a, k in zip(active, keep, strict=True) if k]
            if not active:
                break
        if active:
            x[:] = 0
            x[active] = solved if len(solved) == len(active) else x[active]
    return x


def plan_sequences(counts: np.ndarray, tokens: np.ndarray, window: int) -> list[tuple[np.ndarray, int]]:
    """(counts by bin, repeats) of the combinations to use for ``counts[b]`` rests of bin b + 1 with ``tokens[b]`` tokens.

    As many rests are held back as fill the gaps that the others will leave.
    """
    bins = len(counts)
    room = counts @ (np.arange(bins) + 1) * (window // bins)
    gaps, total = float(room - tokens.sum()), float(tokens.sum())
    wanted = np.floor(counts * (total / (total + gaps) if total else 0))
    shapes = combinations(bins)
    weight = np.sqrt(np.arange(bins) + 1.0)
    repeats = np.floor(nnls((shapes * weight).T, wanted * weight) + 1e-6).astype(np.int64)
    left, out = counts.astype(np.int64).copy(), []
    for i in np.argsort(-repeats, kind="stable"):
        need = shapes[i].astype(np.int64)
        times = min([int(repeats[i]), *(int(left[b] // need[b]) for b in np.flatnonzero(need))])
        if times > 0:
            left -= times * need
            out.append((need, times))
    return out


# ---- packing --------------------------------------------------------------------------------------------------


def pack(docs: DataFrame, tokenizer_path: str, window: int = 4096, end: int = 2, bins: int = BINS) -> DataFrame:
    """Pieces of all ``docs`` (doc_id, text), packed into sequences of at most ``window`` tokens.

    A document's tokens are those of its whole text and then ``end``; a null text is empty, so every row has at
    least one token.  Returned is a row for each piece: doc_id, start (the document's tokens before it), length,
    ids (the piece's tokens, little-endian unsigned 32-bit), doc_tokens, sequence_id and offset (gapless from 0 in
    a sequence).  Every token lies in exactly one piece.  Repeated rows are separate documents; an empty table gives
    no rows; other columns are not read.  ``window`` must be a multiple of ``bins``.

    All sequences are full but the last one of the greedy stream, and those whose gaps found no tokens when there are
    too few rests to hold any back.
    """
    spark = docs.sparkSession
    tokens, width = tokenise(docs, tokenizer_path, end)
    rests = tokens.select("rid", (F.col("n") - F.col("n") % window).alias("start"), (F.col("n") % window).cast("long").alias("length")).where("length > 0")
    rests = rests.withColumn("bin", F.ceil(F.col("length") / (window // bins)).cast("int"))
    counts, sums = np.zeros(bins, np.int64), np.zeros(bins, np.int64)
    for r in rests.groupBy("bin").agg(F.count("*").alias("n"), F.sum("length").alias("t")).collect():
        counts[r.bin - 1], sums[r.bin - 1] = r.n, r.t

    # Ranks [low, high) of a bin go to sequences first, first + 1, ...: ``times`` rests each.
    taken, first, ranges = [0] * bins, 0, []
    for need, repeats in plan_sequences(counts, sums, window):
        for b in np.flatnonzero(need):
            times = int(need[b])
            ranges.append((int(b) + 1, taken[b], taken[b] + times * repeats, times, first))
            taken[b] += times * repeats
        first += repeats
    table = F.broadcast(spark.createDataFrame(ranges, "bin int, low long, high long, times int, first long"))
    ranked = number_within(rests, "bin", ["rid"], "rank")
    placed = ranked.join(table, (ranked["bin"] == table["bin"]) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")), "left")
    sequence = F.col("first") + F.floor((F.col("rank") - F.col("low")) / F.col("times")).cast("long")
    placed = materialise(placed.select("rid", "start", "length", sequence.alias("sequence_id")), "placed")

    inside = Window.partitionBy("sequence_id").orderBy(F.col("length").desc(), "rid")
    before = F.coalesce(F.sum("length").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    combined = placed.where("sequence_id is not null").withColumn("offset", before.cast("long"))
    gaps = placed.where("sequence_id is not null").groupBy("sequence_id").agg(F.sum("length").alias("used")).withColumn("gap", window - F.col("used")).where("gap > 0")
    gaps = materialise(gaps, "open-gaps")
    gaps = materialise(running_total(gaps, "gap", "sequence_id", "at"), "gaps")
    stream = materialise(running_total(placed.where("sequence_id is null").drop("sequence_id"), "length", "rid", "at"), "stream")
    room = gaps.agg(F.sum("gap")).first()[0] or 0
    length = stream.agg(F.sum("length")).first()[0] or 0

    # The stream's first ``room`` tokens fill gaps: both lie on one line, in buckets of a window.
    def buckets(df: DataFrame, size: str) -> DataFrame:
        return df.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("at") / window), F.floor((F.col("at") + F.col(size) - 1) / window))))

    g = buckets(gaps, "gap").select("bucket", F.col("at").alias("g_at"), "gap", "used", "sequence_id")
    low, high = F.greatest("at", "g_at"), F.least(F.col("at") + F.col("length"), F.col("g_at") + F.col("gap"))
    filled = buckets(stream.where(F.col("at") < room), "length").join(g, "bucket").where((low < high) & (F.col("bucket") == F.floor(low / window)))
    filled = filled.select("rid", (F.col("start") + low - F.col("at")).alias("start"), (high - low).alias("length"), "sequence_id", (F.col("used") + low - F.col("g_at")).alias("offset"))

    # What follows is cut into windows.
    own = stream.where(F.col("at") + F.col("length") > room).withColumns({"from": F.greatest("at", F.lit(room)) - room, "to": F.col("at") + F.col("length") - room})
    own = own.withColumn("w", F.explode(F.sequence(F.floor(F.col("from") / window), F.floor((F.col("to") - 1) / window))))
    low, high = F.greatest("from", F.col("w") * window), F.least("to", (F.col("w") + 1) * window)
    windows = own.select("rid", (F.col("start") + low + room - F.col("at")).alias("start"), (high - low).alias("length"), (F.col("w") + first).alias("sequence_id"), (low - F.col("w") * window).alias("offset"))

    base = first + -(-max(0, length - room) // window)
    long = tokens.select("rid", F.floor(F.col("n") / window).cast("long").alias("whole")).where("whole > 0")
    whole = running_total(long, "whole", "rid", "at").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)))
    whole = whole.select("rid", (F.col("i") * window).alias("start"), F.lit(window).cast("long").alias("length"), (F.col("at") + F.col("i") + base).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    names = ["start", "length", "sequence_id", "offset"]
    pieces = whole.unionByName(combined.select("rid", *names)).unionByName(filled).unionByName(windows)
    grouped = pieces.groupBy("rid").agg(F.collect_list(F.struct(*[F.col(c).cast("long").alias(c) for c in names])).alias("pieces"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return tokens.join(grouped, "rid").select("doc_id", "n", "ids", "pieces").mapInArrow(_cut(width), schema)


def _cut(width: str):
    size = np.dtype(width).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole, 256):
                lists = batch["pieces"]
                owner = pc.list_parent_indices(lists)
                start, length, sequence, offset = lists.flatten().flatten()
                blobs = batch["ids"].to_pylist()
                cut = [np.frombuffer(blobs[d], width, n, s * size).astype("<u4").tobytes() for d, s, n in zip(owner.to_pylist(), start.to_pylist(), length.to_pylist(), strict=True)]
                yield pa.record_batch(
                    [batch["doc_id"].take(owner), start, length, pa.array(cut, pa.binary()), batch["n"].take(owner), sequence, offset],
                    ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
                )

    return run

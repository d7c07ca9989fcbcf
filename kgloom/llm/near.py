"""Near duplicates by SetSketch registers.

A document is the set of its distinct five-word shingles.  Of each set a sketch is kept: for every register the
minimum of a hash over the set, turned into an exponential variable and truncated to a 16-bit step of an exponential
scale.  Registers merge by maximum, and two sets agree in a register with about their Jaccard similarity, so bands of
registers find candidates.  The joint likelihood of two sketches then estimates the similarity of a candidate, and
pairs that it doesn't rule out are verified on the whole sets.  Linked sets form components.

Equal sets are one node from the start.  Within a bucket no list of all pairs is made: every member's sketch is first
compared with that of one centre of the bucket.  Members outside of the largest component that this leaves are then
sent to all blocks of the bucket; what leaves a block are the edges of a forest over the plausible pairs.  Its trees are
clusters, in which every plausible pair lies.  A cluster's whole sets are compared in blocks too, each node only with
those that no link joins to it yet, and again only a forest of links leaves a block.  Where more than FEW members are
outside of the largest component, they aren't sent to all blocks: the group is dealt again by a further band, as often
as that takes, since a pair that is worth looking at shares many bands.  So rows grow with the members of a group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import column, fresh, materialise, one_of_each, row_key, tasks_for
from .words import KEY, batches_of, mix, window_hashes, word_hashes

SHINGLE = 5
#: Links have 100 * |intersection| >= LINK * |union|.
LINK = 75
#: Bands and registers of a band.  A link is missed by all bands with probability (1 - 0.75**4)**52 < 3e-9.
BANDS, ROWS = 52, 4
REGISTERS = BANDS * ROWS
#: The exponential scale: base and rate; registers hold 0 to 65535.
BASE, RATE = 1.001, 20.0
#: Candidates estimated below this are dropped: five standard deviations (0.03) below the similarity of a link.
ESTIMATE = 0.60
#: Members of a block of a bucket or of a cluster, elements of a block of a cluster (a block holds one set at least),
#: and members that are compared with all others at once.
BLOCK, ELEMENTS, SLICE = 1024, 2_000_000, 32
#: Members outside of a group's largest component that are sent to all of its blocks.
FEW = 4 * BLOCK
#: Rows for a task that compares sketches or sets: their cost grows with comparisons, not with bytes.
TASK_ROWS = 4_000
#: Bytes of text that a worker hashes at once, and pairs that it estimates at once.
BATCH_BYTES, BATCH_PAIRS = 1_000_000, 2_000

_SEEDS = mix(np.arange(1, REGISTERS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)

_SALT = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
#: Equal registers that an estimate of ``ESTIMATE`` needs at least: registers agree no less often than sets do.
LEAST_EQUAL = int(0.9 * ESTIMATE * REGISTERS)


# ---- sketches -------------------------------------------------------------------------------------------------


def shingle_sets(texts: list[bytes | None], key: int = KEY) -> list[np.ndarray]:
    """For each text its set: sorted distinct 64-bit keyed hashes of its shingles, with A-Z lower-cased.

    A text of fewer than five words has its whole sequence as one element; one without words has none.
    """
    hashes, _, _, bounds = word_hashes([(t or b"").lower() for t in texts], key)
    shingles = window_hashes(hashes, SHINGLE)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            ordered = np.sort(shingles[a : b - SHINGLE + 1])
            out.append(ordered[np.concatenate([[True], ordered[1:] != ordered[:-1]])])
        elif b > a:
            out.append(window_hashes(hashes[a:b], b - a) ^ np.uint64(b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_key(elements: np.ndarray) -> bytes:
    return hashlib.blake2b(elements.tobytes(), digest_size=16).digest()


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """A row of register values for each set, none of which is empty."""
    every = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    lowest = np.empty((len(sets), REGISTERS), np.float64)
    scratch = np.empty_like(every)
    for j, seed in enumerate(_SEEDS):
        np.multiply(every, seed, out=scratch)
        lowest[:, j] = np.minimum.reduceat(scratch, starts)
    exponential = -np.log1p(-np.minimum((lowest + 0.5) * 2.0**-64, 1 - 2.0**-53)) / RATE
    return np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, 65535).astype("<u2")


def _sketch(secret: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, sets in _sets_of(whole, secret):
                full = [i for i, s in enumerate(sets) if len(s)]
                sketches: list[bytes | None] = [None] * len(sets)
                if full:
                    for i, row in zip(full, registers([sets[i] for i in full]), strict=True):
                        sketches[i] = row.tobytes()
                keys = [set_key(s) if len(s) else None for s in sets]
                yield pa.record_batch(
                    [batch["rid"], batch["id"], batch["row"], pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(sketches, pa.binary())],
                    ["rid", "id", "row", "n", "key", "sketch"],
                )

    return run


def _sets_of(whole: pa.RecordBatch, secret: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    sizes = pc.binary_length(whole["text"]).to_numpy(zero_copy_only=False)
    for a, b in batches_of(sizes, BATCH_BYTES):
        batch = whole.slice(a, b - a)
        yield batch, shingle_sets(batch["text"].to_pylist(), secret)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            values = np.frombuffer(b"".join(batch["sketch"].to_pylist()), "<u8").reshape(-1, BANDS)
            buckets = mix(mix(values) + _SALT).view(np.int64)
            yield pa.record_batch([pa.array(buckets.ravel()), pa.array(np.repeat(batch["node"].to_numpy(), BANDS))], ["bucket", "node"])


# ---- estimates ------------------------------------------------------------------------------------------------


def estimate(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """The most likely Jaccard similarity of pairs of sets with known sizes, from rows of registers.

    With u and v the shares of the two sizes, a register of the first is larger with probability p(u - v J) and of
    the second with p(v - u J), where p(x) = -log_base(1 - x (base - 1) / base).  The likelihood of the three counts
    has one maximum in J, found by golden sections.
    """
    more, less = (a > b).sum(axis=1).astype(float), (a < b).sum(axis=1).astype(float)
    same = a.shape[1] - more - less
    u = size_a / (size_a + size_b)
    v = 1 - u

    def likelihood(j: np.ndarray) -> np.ndarray:
        p = -np.log1p(-np.maximum(u - v * j, 0) * (BASE - 1) / BASE) / np.log(BASE)
        q = -np.log1p(-np.maximum(v - u * j, 0) * (BASE - 1) / BASE) / np.log(BASE)
        tiny = 1e-300
        return more * np.log(p + tiny) + less * np.log(q + tiny) + same * np.log(np.maximum(1 - p - q, 0) + tiny)

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    ratio = (np.sqrt(5) - 1) / 2
    for _ in range(28):
        c, d = high - ratio * (high - low), low + ratio * (high - low)
        left = likelihood(c) > likelihood(d)
        high, low = np.where(left, d, high), np.where(left, low, c)
    return (low + high) / 2


def _plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, BATCH_PAIRS):
            batch = whole.slice(at, BATCH_PAIRS)
            n_a, n_b = batch["n_a"].to_numpy(), batch["n_b"].to_numpy()
            a, b = (np.frombuffer(b"".join(batch[c].to_pylist()), "<u2").reshape(-1, REGISTERS) for c in ("s_a", "s_b"))
            keep = pa.array(estimate(a, b, n_a, n_b) >= ESTIMATE)
            yield pa.record_batch([batch["a"].filter(keep), batch["b"].filter(keep)], ["a", "b"])


def _elements(secret: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, sets in _sets_of(whole, secret):
                yield pa.record_batch([batch["node"], pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "elements"])

    return run


# ---- the operator ---------------------------------------------------------------------------------------------


def near_duplicates(docs: DataFrame, text: str = "text", order: str = "doc_id", with_row: bool = False, secret: int = KEY) -> DataFrame:
    """One row for each row of ``docs``: ``order``, n_shingles, component_id, kept.

    Documents are linked when their sets are similar enough; ``component_id`` is the smallest ``order`` reachable by
    links, the row itself included, and ``kept`` says whether it is the row's own.  Texts without words (null and
    empty ones too) are linked with nothing.  Repeated rows (equal in order and text) are one document given several
    times: they share everything, ``kept`` too.  Other rows with the smallest order of their component are kept as
    well.  Null orders count as larger than all others.  Texts may be of any length: a document's set is held by one
    task, 8 bytes an element.  An empty table gives no rows; other columns are not read.

    Elements are 64-bit hashes keyed with ``secret``; who has to fear texts made to collide keeps it to himself.
    ``with_row`` adds ``row``, the key that ``common.row_key`` makes of ``order`` and ``text``.
    """
    kind = docs.schema[order].dataType.simpleString()
    body = F.coalesce(column(text), F.lit("")).cast("binary")
    rows = docs.select(column(order).alias("id"), row_key(column(order), column(text)).alias("row"), body.alias("text"))
    first = rows.select(F.monotonically_increasing_id().alias("rid"), "id", "row", "text")
    base = materialise(first.mapInArrow(_sketch(secret), f"rid long, id {kind}, row binary, n long, key binary, sketch binary"), "sketches")

    tops = base.where("n > 0").groupBy("key").agg(F.min("rid").alias("node"), F.min("id").alias("id"))
    nodes = materialise(tops, "nodes")
    own = base.join(nodes.select(F.col("node").alias("rid")), "rid").select(F.col("rid").alias("node"), "row", "n", "key", "sketch")
    own = materialise(own, "node-sketches")
    bands = own.select("sketch", "node").mapInArrow(_bands, "bucket long, node long")
    shared = bands.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1").select("bucket")
    members = materialise(bands.join(materialise(shared, "buckets"), "bucket"), "members")

    # Plausible pairs: members with their bucket's centre, then members of buckets that these leave apart.
    plausible = _across(members, materialise(_likely(_stars(members), own), "stars"), own)

    # Links: in each block of a cluster, and then between the blocks of clusters that are still in parts.
    clusters = _components(plausible).withColumnRenamed("component", "cluster")
    wanted = own.join(clusters, "node").select("node", "cluster", "row")
    found = one_of_each(rows.select("row", "text"), wanted.select("node", "row"), base.select("row")).select("node", "text").mapInArrow(_elements(secret), "node long, elements binary")
    sets = materialise(found, "sets")
    labels = _components(_links(wanted.select(F.col("cluster").alias("group"), "node", F.array().cast("array<bigint>").alias("path")), sets, members))

    joined = nodes.join(labels, "node", "left").select("key", F.coalesce("component", "node").alias("component"), "id")
    joined = materialise(joined, "labels")
    least = joined.groupBy("component").agg(F.min("id").alias("component_id"))
    final = materialise(joined.join(least, "component").select("key", "component_id"), "classes")
    out = base.select("id", "row", "n", "key").join(final, "key", "left").withColumn("component_id", F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id")))
    return out.select(F.col("id").alias(order), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"), *["row"] * with_row)


def drop_duplicates(docs: DataFrame, text: str = "text", order: str = "doc_id") -> DataFrame:
    """``docs`` without the rows that ``near_duplicates`` doesn't keep: repeated rows stay or go together.

    All columns are kept, whatever their names; an empty table stays empty.
    """
    key = fresh(docs.columns, "__row")
    kept = near_duplicates(docs, text, order, with_row=True).where("kept").select(F.col("row").alias(key)).distinct()
    keyed = docs.withColumn(key, row_key(column(order), column(text)))
    return keyed.join(materialise(kept, "kept"), key, "left_semi").drop(key)


def _components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, component) of all nodes of ``edges``, and of other ``nodes`` as components of their own."""
    ends = edges.toDF("src", "dst")
    labels = connected_components(ends, lambda df: materialise(df, "components"))
    if nodes is None:
        return labels
    return materialise(nodes.join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component")), "labels")


def _stars(members: DataFrame) -> DataFrame:
    """Pairs of one member of each bucket, the same one of a group in most of its buckets, with the other members."""
    centres = members.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("node").alias("h"), "node")).alias("c"))
    pairs = members.join(materialise(centres.select("bucket", F.col("c.node").alias("centre")), "centres"), "bucket").where("centre <> node")
    return pairs.select(F.least("centre", "node").alias("a"), F.greatest("centre", "node").alias("b")).distinct()


def _open(placed: DataFrame) -> DataFrame:
    """Of the groups of ``placed`` (group, node, component) that are in several components: (group, main, size, few),
    the largest component, all members, and those outside of it."""
    parts = placed.groupBy("group", "component").agg(F.count("*").alias("n"))
    tops = parts.groupBy("group").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("size"))
    return materialise(tops.select("group", F.col("top.component").alias("main"), "size", (F.col("size") - F.col("top.n")).alias("few")).where("few > 0"), "open")


def _finer(groups: DataFrame, members: DataFrame) -> DataFrame:
    """``groups`` (group, node, path) dealt again: a group for each further bucket of a member, which joins the path."""
    further = groups.join(members, "node").where(~F.array_contains("path", F.col("bucket")))
    dealt = further.select(F.when(F.size("path") > 0, F.lit(None).cast("long")).otherwise(F.col("group")).alias("root"), "node", F.array_sort(F.concat("path", F.array("bucket"))).alias("path")).distinct()
    return materialise(dealt.select(F.xxhash64("root", "path").alias("group"), "node", "path"), "finer")


def _links(groups: DataFrame, sets: DataFrame, members: DataFrame) -> DataFrame:
    """A forest (src, dst) of the links between members of the same ``groups`` (group, node, path)."""
    links = None
    while True:
        rows = materialise(groups, "groups")
        mass = F.greatest(F.count("*") / BLOCK, F.sum("mass") / ELEMENTS)
        weighed = rows.join(sets.select("node", (F.octet_length("elements") / 8).alias("mass")), "node")
        blocks = weighed.groupBy("group").agg(F.ceil(mass).cast("int").alias("parts"))
        dealt = rows.join(blocks, "group").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        known = F.col("node") if links is None else F.coalesce("component", "node")
        dealt = (dealt if links is None else dealt.join(_components(links), "node", "left")).withColumn("component", known)
        dealt = materialise(dealt.select("group", "node", "path", "parts", "part", "component"), "parts")
        found = materialise(_settled(dealt.select("group", "node", "part", F.lit(0).alias("turn"), F.lit(True).alias("asks"), "component"), sets), "links")
        links = found if links is None else materialise(links.union(found), "all-links")
        large = dealt.where("parts > 1").drop("component")
        if large.isEmpty():
            return links
        now = materialise(large.join(_components(links), "node", "left").withColumn("component", F.coalesce("component", "node")), "rest")
        open_ = _open(now.select("group", "node", "component"))
        few = open_.where(F.col("few") <= FEW)
        if not few.isEmpty():
            links = materialise(links.union(_settled(_rest(now.join(few, "group")), sets)), "all-links")
        many = open_.where(F.col("few") > FEW).select("group")
        if many.isEmpty():
            return links
        groups = _finer(now.join(many, "group", "left_semi").select("group", "node", "path"), members)


def _rest(told: DataFrame) -> DataFrame:
    """How groups of several blocks are dealt again: those outside of a group's largest component ask, in turns, all
    members of all parts."""
    turns = F.ceil(F.col("few") / BLOCK).cast("int")
    told = told.withColumn("turns", turns).withColumn("own", F.pmod(F.xxhash64("node", F.lit("turn")), F.col("turns")).cast("int"))
    answers = told.select("group", "node", "part", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"), F.lit(False).alias("asks"), "component")
    asking = told.where("component <> main").select("group", "node", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("own").alias("turn"), F.lit(True).alias("asks"), "component")
    return answers.union(asking)


def _settled(dealt: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (src, dst) between the rows of each (group, part, turn) that ``dealt`` (group, node, part, turn, asks,
    component) makes."""
    rows = dealt.join(sets, "node").select("group", "part", "turn", "asks", "node", "component", "elements")
    tasks = tasks_for(dealt.sparkSession, sets.count(), TASK_ROWS)
    return rows.repartition(tasks, "group", "part", "turn").sortWithinPartitions("group", "part", "turn").mapInArrow(_link, "src long, dst long")


def _runs(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[pa.Table]:
    """The groups of rows that stand next to each other and agree in ``names``."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch[c].to_numpy() for c in names])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(keys[:, a].tolist())
            if held and key != last:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


class _Forest:
    """Disjoint sets of the rows of a group, and the edges that joined them."""

    def __init__(self, components: np.ndarray):
        self.root = np.unique(components, return_inverse=True)[1].astype(np.int64)
        self.edges: list[tuple[int, int]] = []

    def join(self, a: int, b: int) -> None:
        x, y = self.root[a], self.root[b]
        if x != y:
            self.root[self.root == x] = y
            self.edges.append((a, b))

    def result(self, nodes: np.ndarray, names: list[str]) -> pa.RecordBatch:
        ends = np.array(self.edges, np.int64).reshape(-1, 2)
        pairs = np.sort(nodes[ends], axis=1)
        return pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names)


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A forest of links of each group: rows that ask are compared, by their whole sets, with all rows that aren't
    joined to them yet."""
    for rows in _runs(batches, "group", "part", "turn"):
        nodes = rows["node"].to_numpy()
        sets = [np.frombuffer(x, "<u8") for x in rows["elements"].to_pylist()]
        sizes = np.array([len(x) for x in sets])
        starts = np.concatenate([[0], np.cumsum(sizes)])
        names, codes = np.unique(np.concatenate(sets), return_inverse=True)
        mark = np.zeros(len(names), bool)
        forest = _Forest(rows["component"].to_numpy())
        for i in np.flatnonzero(rows["asks"].to_numpy(zero_copy_only=False)).tolist():
            apart = forest.root != forest.root[i]
            if not apart.any():
                continue
            own = codes[starts[i] : starts[i + 1]]
            mark[own] = True
            common = np.add.reduceat(mark[codes], starts[:-1], dtype=np.int64)
            mark[own] = False
            for j in np.flatnonzero(apart & (100 * common >= LINK * (sizes + sizes[i] - common))).tolist():
                forest.join(i, j)
        if forest.edges:
            yield forest.result(nodes, ["src", "dst"])


def _across(members: DataFrame, plausible: DataFrame, own: DataFrame) -> DataFrame:
    """``plausible`` pairs (a, b), and those of members of a bucket that these leave in different components."""
    groups = members.select(F.col("bucket").alias("group"), "node", F.array("bucket").alias("path"))
    nodes = materialise(members.select("node").distinct(), "member-nodes")
    while True:
        placed = materialise(groups.join(_components(plausible, nodes), "node").select("group", "node", "path", "component"), "placed")
        open_ = _open(placed)
        plausible = materialise(plausible.union(_compared(placed, open_.where(F.col("few") <= FEW), own).distinct()), "plausible")
        many = open_.where(F.col("few") > FEW).select("group")
        if many.isEmpty():
            return plausible
        groups = _finer(placed.join(many, "group", "left_semi").select("group", "node", "path"), members)
        plausible = materialise(plausible.union(_likely(_stars(groups.select(F.col("group").alias("bucket"), "node")), own)).distinct(), "plausible")


def _compared(placed: DataFrame, open_: DataFrame, own: DataFrame) -> DataFrame:
    """Plausible pairs (a, b) of members of a group, one of them outside of the largest component: that one goes to
    every block of the group."""
    rows = placed.join(open_.withColumn("parts", F.ceil(F.col("size") / BLOCK).cast("int")), "group")
    mine, asks = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"), F.col("component") != F.col("main")
    parts = F.when(asks, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(mine))
    dealt = rows.select("group", "node", "component", asks.alias("asks"), mine.alias("own"), F.explode(parts).alias("part"))
    dealt = dealt.select("group", "part", "node", "component", "asks", (F.col("own") == F.col("part")).alias("answers"))
    n = open_.agg(F.sum(F.col("size") + F.col("few") * F.col("size") / BLOCK)).first()[0] or 0
    groups = dealt.join(own.select("node", "n", "sketch"), "node").repartition(tasks_for(placed.sparkSession, int(n), TASK_ROWS), "group", "part").sortWithinPartitions("group", "part")
    return groups.select("group", "part", "node", "component", "asks", "answers", "n", "sketch").mapInArrow(_compare, "a long, b long")


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A forest of the plausible pairs of each (group, part): of a member that asks with one that answers."""
    for rows in _runs(batches, "group", "part"):
        node, component, n = (rows[c].to_numpy() for c in ("node", "component", "n"))
        asks, answers = (rows[c].to_numpy(zero_copy_only=False) for c in ("asks", "answers"))
        forest = _Forest(component)
        sketch = np.frombuffer(b"".join(rows["sketch"].to_pylist()), "<u2").reshape(-1, REGISTERS)
        few, all_ = np.flatnonzero(asks), np.flatnonzero(answers)
        for start in range(0, len(few), SLICE):
            some = few[start : start + SLICE]
            fits = forest.root[some][:, None] != forest.root[all_]
            # Two that ask are compared where the larger one answers.
            fits &= ~asks[all_] | (node[some][:, None] < node[all_])
            fits &= 100 * np.minimum(n[some][:, None], n[all_]) >= LINK * np.maximum(n[some][:, None], n[all_])
            x, y = np.nonzero(fits)
            for at in range(0, len(x), BATCH_PAIRS):
                p, q = some[x[at : at + BATCH_PAIRS]], all_[y[at : at + BATCH_PAIRS]]
                keep = (sketch[p] == sketch[q]).sum(axis=1) >= LEAST_EQUAL
                p, q = p[keep], q[keep]
                keep = estimate(sketch[p], sketch[q], n[p], n[q]) >= ESTIMATE
                for a, b in zip(p[keep].tolist(), q[keep].tolist(), strict=True):
                    forest.join(a, b)
        if forest.edges:
            yield forest.result(node, ["a", "b"])


def _likely(pairs: DataFrame, own: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sizes allow a link and whose sketches make it plausible."""
    one = own.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a"))
    two = own.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("s_b"))
    sized = pairs.join(one, "a").join(two, "b").where((100 * F.least("n_a", "n_b") >= LINK * F.greatest("n_a", "n_b")))
    return sized.select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(_plausible, "a long, b long")

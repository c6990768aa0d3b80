"""Connected components, and candidate buckets whose keys travel packed.

Buckets: map tasks send, for each of many parts, one binary value with (key, node) pairs, so a pair costs 16 bytes and
no row. The task that gets a part keeps the keys that at least two nodes have; it holds one part at a time.

Components: rounds of min-label hooking, pointer jumping and contraction on tables; every group is only ever summed up
(min), never gathered. Edges shrink each round until none is left.

resolve() finds the components of the links among bucket mates. First each node is tried with the centre that the most of
its buckets have (twice, with other centres, where pairs are verified outside the buckets). Buckets that hold one component after that are done: mates in one component need no trial. Buckets of two nodes can come as pairs, so
that a pair is tried once however many keys it shares. In each
other bucket, mates of different components are compared by bitmaps, without making a row for any pair that the bitmaps
rule out: a set's bitmap has a bit for each token's hash, so two sets differ in at least as many tokens as bits. A pair
that shares several buckets counts in one of them: each node carries its `LOW` smallest keys, and a bucket leaves out
pairs that have a smaller one in common, as they meet there. So no link that would change a component is missed, and a
pair is made once rather than once a bucket. Where nodes carry what verifies a pair, a task also verifies, and makes rows
for links between components only: fewer than it has nodes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellspan.llm.common import cut, discard, mix, released, text_bytes


def n_parts(spark: SparkSession) -> int:
    return 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


class Packer:
    """Gathers (key, node) pairs and yields them as (part, blob) batches."""

    def __init__(self, parts: int, flush: int = 1 << 20):
        self.parts, self.flush, self.n = parts, flush, 0
        self.keys: list[np.ndarray] = []
        self.nodes: list[np.ndarray] = []

    def add(self, keys: np.ndarray, nodes: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.keys.append(keys), self.nodes.append(nodes)
        self.n += len(keys)
        if self.n >= self.flush:
            yield from self.drain()

    def drain(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        k, v = np.concatenate(self.keys), np.concatenate(self.nodes).view(np.uint64)
        self.keys, self.nodes, self.n = [], [], 0
        part = ((k >> np.uint64(32)) * np.uint64(self.parts) >> np.uint64(32)).astype(np.int32)
        order = np.argsort(part.astype(np.uint16) if self.parts <= 1 << 16 else part, kind="stable")  # by radix
        part, both = part[order], np.stack([k[order], v[order]], axis=1)
        ids, first = np.unique(part, return_index=True)
        blobs = [b.tobytes() for b in np.split(both, first[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "blob"])


PACKED = "part int, blob binary"


def by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.Buffer]]]:
    """Each part and its blobs, of (part, blob) batches in the order of parts."""
    now, held = None, []
    for batch in batches:
        for p, b in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if p != now:
                if held:
                    yield now, held
                now, held = p, []
            held.append(b.as_buffer())
    if held:
        yield now, held


def dealt(packed: DataFrame) -> DataFrame:
    """PACKED rows by part, in the order of parts."""
    n = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return packed.repartition(n, "part").sortWithinPartitions("part")


def shared(blobs: list[pa.Buffer]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """key, node and place of the key's first row for the keys that several nodes have; a key's first node is its centre."""
    both = np.concatenate([np.frombuffer(b, np.uint64) for b in blobs]).reshape(-1, 2)
    k, v = both[:, 0], both[:, 1]
    order = np.argsort(k)
    k, v = k[order], v[order]
    again = np.zeros(len(k), bool)
    again[1:] = k[1:] == k[:-1]
    again[:-1] |= again[1:]
    k, v = k[again], v[again]
    order = np.lexsort((mix(v), k))  # the node whose hash is the smallest is the centre
    k, v = k[order], v[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (v[1:] != v[:-1])
    k, v = k[new], v[new]
    again = np.zeros(len(k), bool)
    again[1:] = k[1:] == k[:-1]
    again[:-1] |= again[1:]
    k, v = k[again], v[again]
    first = np.ones(len(k), bool)
    first[1:] = k[1:] != k[:-1]
    return k.view(np.int64), v.view(np.int64), np.flatnonzero(first)[np.cumsum(first) - 1]


def buckets_of(packed: DataFrame) -> DataFrame:
    """(key, node, centre) of the keys that several nodes have, from PACKED rows; centre is one of the key's nodes."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blobs in by_part(released(batches)):
            k, v, first = shared(blobs)
            if len(k):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k, v, v[first])], names=["key", "node", "centre"])

    return dealt(packed).mapInArrow(unpack, "key long, node long, centre long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of edges (a, b); root is the smallest node of the component."""
    ordered = lambda e: e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    e = cut(ordered(edges))
    labels = None
    while not e.isEmpty():
        up = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a").agg(F.min("b").alias("b"))
        up = up.select(F.col("a").alias("node"), F.least("a", "b").alias("up"))
        over = up.select(F.col("node").alias("up"), F.col("up").alias("over"))
        up = cut(up.join(over, "up").select("node", F.col("over").alias("up")))
        last, before = labels, e
        if last is None:
            labels = cut(up.select("node", F.col("up").alias("root")))
        else:
            labels = cut(last.join(up.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("up", "root").alias("root")))
        ends = e.join(up.select(F.col("node").alias("a"), F.col("up").alias("ua")), "a").join(up.select(F.col("node").alias("b"), F.col("up").alias("ub")), "b")
        e = cut(ordered(ends.select(F.col("ua").alias("a"), F.col("ub").alias("b"))))
        discard(up, last, before)
    discard(e)
    return edges.sparkSession.createDataFrame([], "node long, root long") if labels is None else labels


def joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """Components (node, root) after more links (a, b)."""
    side = lambda c: found.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    own = links.join(side("a"), "a", "left").join(side("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    top = components(own)
    moved = found.join(top.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    out = cut(moved.unionAll(top.join(found.select("node"), "node", "left_anti")))
    discard(top, found)
    return out


def pruned(buckets: DataFrame, need: DataFrame, rounds: int = 1) -> DataFrame:
    """buckets without nodes that share fewer keys than they need (node, need), and keys of one node.

    The centre of a bucket becomes the node that shares the most keys: of a group of edited copies, the least edited.
    """
    for _ in range(rounds):
        able = buckets.groupBy("node").agg(F.count(F.lit(1)).alias("n")).join(need, "node").where("n >= need").select("node", "n")
        rest = cut(buckets.select("key", "node").join(able, "node"))
        several = rest.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.max_by("node", F.struct("n", F.xxhash64("node"))).alias("centre")).where("lo <> hi")
        slim = cut(rest.select("key", "node").join(several.select("key", "centre"), "key"))
        discard(buckets, rest)
        buckets = slim
    return buckets


SKETCH_WORDS = 16
LOW = 8
_NONE = np.iinfo(np.int64).max


def bitmap(tokens: np.ndarray, words: int = SKETCH_WORDS) -> bytes:
    """A set's bitmap of 64 * words bits."""
    bits = np.zeros(64 * words, np.uint8)
    bits[(tokens >> np.uint64(20)) % np.uint64(64 * words)] = 1
    return np.packbits(bits).tobytes()


def differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The number of bits by which rows of words differ."""
    return np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)


class Whole:
    """Whether the bitmaps of two sets allow a similarity. Sizes may be off by two, as those of sets of short hashes may be."""

    def __init__(self, similarity: Fraction):
        self.similarity = similarity

    def longest(self, size: np.ndarray) -> np.ndarray:
        """The size that no similar set of size or above exceeds."""
        return self.similarity.denominator * (size + 2) // self.similarity.numerator + 2

    def __call__(self, size_x: np.ndarray, size_y: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        less, more = (self.similarity.denominator + k * self.similarity.numerator for k in (-1, 1))
        return more * differing(x[:, :SKETCH_WORDS], y[:, :SKETCH_WORDS]) <= less * (size_x + size_y + 4)


def _padded(lists: pa.ListArray) -> np.ndarray:
    """The first LOW values of each list."""
    at, values = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy()
    out = np.full((len(lists), LOW), _NONE)
    for k in range(LOW):
        has = at[1:] - at[:-1] > k
        out[has, k] = values[at[:-1][has] + k]
    return out


class Bucketed:
    """Rows (key, node, root, size, sketch, low and perhaps payload) of whole buckets."""

    def __init__(self, t: pa.Table):
        t = t.combine_chunks()
        key, size = t.column(0).to_numpy(), t.column(3).to_numpy()
        order = np.lexsort((size, key))
        self.key, self.size, self.node = key[order], size[order], t.column(1).to_numpy()[order]
        self.label, at = np.unique(t.column(2).to_numpy(), return_inverse=True)
        self.label, self.at = np.arange(len(self.label)), at[order]
        self.sketch = text_bytes(t.column(4))[0].reshape(t.num_rows, -1).view(np.uint64)[order]
        low = t.column(5).chunk(0) if t.num_rows else t.column(5).combine_chunks()
        self.low = _padded(low)[order]
        self.payload = t.column(6).to_pylist() if t.num_columns > 6 else None
        self.order = order

    def pairs(self, allow: Whole) -> Iterator[np.ndarray]:
        """Places (x, y) of pairs of one key and two components, which the bitmaps allow and no smaller key has."""
        key, size, low = self.key, self.size, self.low
        end, most = np.searchsorted(key, key, "right"), allow.longest(size)
        at, d = np.arange(len(key)), 0
        while len(at):  # each row with the d-th after it, while that has its key and isn't too long
            d += 1
            at = at[at + d < end[at]]
            at = at[size[at + d] <= most[at]]
            for i in range(0, len(at), 1 << 14):
                x = at[i : i + (1 << 14)]
                x = x[self.label[self.at[x]] != self.label[self.at[x + d]]]
                x = x[allow(size[x], size[x + d], self.sketch[x], self.sketch[x + d])]
                if len(x):
                    p, q = low[x], low[x + d]
                    met = ((p[:, :, None] == q[:, None, :]).any(axis=2) & (p < key[x][:, None])).any(axis=1)
                    x = x[~met]
                if len(x):
                    yield np.stack([x, x + d])

    def links(self, allow: Whole, same: Callable) -> Iterator[np.ndarray]:
        """The pairs that same() confirms, as far as they join components."""
        for both in self.pairs(allow):
            for i in range(0, both.shape[1], 512):
                x, y = both[:, i : i + 512]
                apart = self.label[self.at[x]] != self.label[self.at[y]]
                x, y = x[apart], y[apart]
                if not len(x):
                    continue
                ok = same(*([self.payload[k] for k in self.order[z]] for z in (x, y)))
                keep = []
                for k in np.flatnonzero(ok).tolist():
                    p, q = self.label[self.at[x[k]]], self.label[self.at[y[k]]]
                    if p != q:
                        self.label[self.label == p] = q
                        keep.append(k)
                if keep:
                    yield np.stack([x[keep], y[keep]])


def near(rows: DataFrame, allow: Whole, same: Callable | None = None, flush: int = 1 << 15) -> DataFrame:
    """(a, b) of rows (key, node, root, size, sketch, low, and payload if same is given) that may link, or do by same()."""

    def of(t: pa.Table) -> Iterator[pa.RecordBatch]:
        b = Bucketed(t)
        for x, y in b.links(allow, same) if same else b.pairs(allow):
            p, q = b.node[x], b.node[y]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in released(batches):
            held.append(batch)
            n += batch.num_rows
            if n >= flush:
                t = pa.Table.from_batches(held)
                done = int(np.searchsorted(t.column(0).to_numpy(), t.column(0)[n - 1].as_py()))
                if done:
                    yield from of(t.slice(0, done))
                    t = t.slice(done)
                    held, n = t.to_batches(), t.num_rows
        if n:
            yield from of(pa.Table.from_batches(held))

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = ["key", "node", "root", "size", "sketch", "low", *(["payload"] if same else [])]
    return rows.select(*columns).repartition(n, "key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def resolve(buckets: DataFrame, verify: Callable[[DataFrame], DataFrame], marks: DataFrame, allow: Whole, same: Callable | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """(node, root) of the components of links among bucket mates, and among pairs (a, b) that are all tried.

    buckets: (key, node, centre). verify maps (a, b) to the pairs that link. marks: (node, size, sketch, low, and payload
    if same is given), where low has a node's LOW smallest keys in order.
    """
    ends = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))

    def most_shared(rows: DataFrame) -> DataFrame:
        """Each node with the centre that the most of its buckets have."""
        each = rows.groupBy("node", "centre").agg(F.count(F.lit(1)).alias("n")).groupBy("node").agg(F.max(F.struct("n", "centre")).alias("s"))
        return each.select(*ends(F.col("node"), F.col("s.centre"))).distinct()

    def still_open(rows: DataFrame) -> DataFrame:
        """(key, node, root) of the buckets with several components."""
        at = rows.join(found, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
        mixed = at.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
        return cut(at.join(mixed, "key", "left_semi"))

    centres = most_shared(buckets.where("node <> centre"))
    tried = cut(centres if pairs is None else centres.unionAll(pairs).distinct())
    found = components(verify(tried))
    rest = still_open(buckets.select("key", "node"))
    if same is None:  # another centre, as each pair that the bitmaps leave is verified elsewhere
        other = rest.groupBy("key").agg(F.min_by(F.struct("node", "root"), F.xxhash64(F.lit(1), "node")).alias("c"))
        again = rest.join(other, "key").where("c.root <> root").select("node", F.col("c.node").alias("centre"))
        again = cut(most_shared(again).join(tried, ["a", "b"], "left_anti"))
        found = joined(found, verify(again))
        before, rest = rest, still_open(rest.select("key", "node"))
        tried = tried.unionAll(again)
        discard(before)
    more = near(rest.join(marks, "node"), allow, same)
    if same is None:
        more = verify(cut(more.distinct().join(tried, ["a", "b"], "left_anti")))
    found = joined(found, more)
    discard(rest)
    return found

"""N-gram Jaccard self-join with prefix filters under several global token orders.

A document's set holds its distinct k-word shingles, named by 64-bit hashes. Documents with the same set are one node.
If two sets reach similarity t, their n - ceil(t n) + m first tokens under any global order share m, for any m. Here m
is n / 20 (at least 1), and of two sets the smaller m holds; so sets that only share a passage don't meet. Each order puts
last the shingles that are frequent in the corpus (by the power of two of their count), before them the others by the
product of their words' frequencies, and breaks ties by a hash of the order's own. Pairs must share a prefix token under
the first order to meet. Before any set is fetched, each other order filters them: bitmaps of the prefixes under it must
not differ in more places than prefixes that share m tokens do. Pairs that pass every order are verified: m shared prefix
tokens under each, then the sets' exact intersection decides.

Frequent shingles and words are found by merging what each map task sees in at least a share `frequent` of its shingles
or `common` of its words; only those of at least half that share overall are kept, so the tables have at most
2 / frequent and 2 / common entries. The order need not be exact to lose nothing: any order is a valid one.

Prefix tokens travel packed; sets travel only for nodes that share a prefix token, and once for each pair tried (see
linking.resolve).

Cases: null text or text without words has an empty set and links with nothing. With fewer than k words, the whole
sequence is one shingle. Repeated rows link. Null ids: a component's id is its smallest id that isn't null. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellspan.llm.common import cut, discard, documents, filed, free_name, mix, numbered, pieces, released, shingle_hashes, text_bytes, words_of
from cellspan.llm.linking import LOW, PACKED, SKETCH_WORDS, Packer, Whole, bitmap, buckets_of, differing, n_parts, pruned, resolve

_BITS = np.uint64((1 << 20) - 1)


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, k: int, order: Orders | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The sorted distinct shingle hashes of each row, and their levels in the orders."""
    words, row, n = _rows(buf, offsets)
    h, r = shingle_hashes(words, row, n, k)
    first = np.searchsorted(r, np.arange(n + 1))
    level = order.shingle_levels(h, r, words, row, k) if order else np.zeros(len(h), np.uint8)
    for i in range(n):
        s, at = np.unique(h[first[i] : first[i + 1]], return_index=True)
        yield s, level[first[i] : first[i + 1]][at]


def set_name(tokens: np.ndarray) -> int:
    """A 64-bit name of a sorted set."""
    if not len(tokens):
        return 0
    a = np.bitwise_xor.reduce(mix(tokens + np.uint64(0x51ED270B0A1F39C1)), keepdims=True)
    b = np.add.reduce(mix(tokens ^ np.uint64(0x7FB5D329728EA185)), keepdims=True)
    return int(mix(a + mix(b + np.uint64(len(tokens)))).view(np.int64)[0])


def shared_tokens(n: int) -> int:
    """Prefix tokens that a set of n has in common with similar sets of its size or above."""
    return max(1, n // 20)


PREFIX_WORDS = 4


class Filters(Whole):
    """Whole, and for each order but the first whether the prefixes' bitmaps allow that they share enough tokens."""

    def __init__(self, similarity: Fraction, orders: int):
        super().__init__(similarity)
        self.orders = orders

    def __call__(self, size_x: np.ndarray, size_y: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        t = self.similarity
        prefix = lambda n: n - -(-t.numerator * n // t.denominator) + np.maximum(1, n // 20)
        most = prefix(size_x) + prefix(size_y) - 2 * np.maximum(1, np.minimum(size_x, size_y) // 20)
        ok = super().__call__(size_x, size_y, x, y)
        for o in range(self.orders - 1):
            own = slice(SKETCH_WORDS + o * PREFIX_WORDS, SKETCH_WORDS + (o + 1) * PREFIX_WORDS)
            ok &= differing(x[:, own], y[:, own]) <= most
        return ok


class Table:
    """Sorted 64-bit keys with a level each; look-ups of other keys give 0."""

    def __init__(self, keys: np.ndarray, levels: np.ndarray):
        by = np.argsort(keys)
        self.keys, self.levels = keys[by], levels[by].astype(np.uint8)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.keys & _BITS).astype(np.int64)] = True

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), np.uint8)
        at = np.flatnonzero(self.maybe[(keys & _BITS).astype(np.int64)])
        if len(at) and len(self.keys):
            spot = np.minimum(np.searchsorted(self.keys, keys[at]), len(self.keys) - 1)
            hit = self.keys[spot] == keys[at]
            out[at[hit]] = self.levels[spot[hit]]
        return out


class Orders:
    """Global token orders that put frequent tokens last."""

    def __init__(self, counted: dict[str, tuple[np.ndarray, np.ndarray, int]], orders: int, similarity: Fraction, k: int):
        keys, counts, _ = counted["shingle"]
        self.frequent = Table(keys, np.minimum(255, 128 + np.log2(np.maximum(counts, 1))))
        keys, counts, total = counted["word"]
        least = counts.min(initial=1)
        self.common = Table(keys, np.minimum(127 // k, 1 + (2 if k <= 3 else 1) * np.log2(np.maximum(counts, 1) / max(1, least))))
        self.seeds = mix(np.arange(1, orders + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.similarity = similarity

    def size(self, n: int) -> int:
        return n - -(-self.similarity.numerator * n // self.similarity.denominator) + shared_tokens(n)

    def shingle_levels(self, h: np.ndarray, r: np.ndarray, words: np.ndarray, row: np.ndarray, k: int) -> np.ndarray:
        """Levels of shingles: of words as their sum, of frequent shingles by count."""
        own = self.common(words).astype(np.int64)
        sums = np.zeros(len(own) + 1, np.int64)
        np.cumsum(own, out=sums[1:])
        n_words, n_shingles = (np.bincount(x, minlength=int(row.max(initial=-1)) + 1) for x in (row, r))
        first = np.repeat(np.cumsum(n_words) - n_words, n_shingles)
        at = first + np.arange(len(h)) - np.repeat(np.cumsum(n_shingles) - n_shingles, n_shingles)
        end = np.minimum(at + k, first + np.repeat(n_words, n_shingles))
        return np.maximum(self.frequent(h), (sums[end] - sums[at]).astype(np.uint8))

    def prefix(self, tokens: np.ndarray, order: int, level: np.ndarray) -> np.ndarray:
        p = self.size(len(tokens))
        key = level.astype(np.uint64) << np.uint64(56) | mix(tokens ^ self.seeds[order]) >> np.uint64(8)
        return tokens if p >= len(tokens) else tokens[np.argpartition(key, p - 1)[:p]]


def frequent_tokens(texts: DataFrame, k: int, frequent: float, common: float, flush: int = 1 << 21) -> dict[str, tuple[np.ndarray, np.ndarray, int]]:
    """Shingles (words) that make up at least half of `frequent` (`common`) of all, their counts (from below), and the total."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {"shingle": [], "word": []}
        n = 0

        def emit() -> Iterator[pa.RecordBatch]:
            for kind, share in (("shingle", frequent), ("word", common)):
                values, counts = np.unique(np.concatenate(held[kind]), return_counts=True)
                big = counts >= max(3, share * counts.sum())
                values, counts = np.append(values[big], np.uint64(0)), np.append(counts[big], counts.sum())
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(values)), pa.array(values.view(np.int64)), pa.array(counts)], names=["kind", "token", "n"])

        for batch in batches:
            buf, off = text_bytes(batch.column(0))
            for i, j in pieces(off):
                words, row, m = _rows(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                held["word"].append(words), held["shingle"].append(shingle_hashes(words, row, m, k)[0])
                n += len(words)
                if n >= flush:
                    yield from emit()
                    held, n = {"shingle": [], "word": []}, 0
        if n:
            yield from emit()

    sums = cut(texts.mapInArrow(run, "kind string, token long, n long").groupBy("kind", "token").agg(F.sum("n").alias("n")))
    totals = dict(sums.where("token = 0").select("kind", "n").collect())
    out = {}
    for kind, share in (("shingle", frequent), ("word", common)):
        rows = sums.where((F.col("kind") == kind) & (F.col("token") != 0) & (F.col("n") >= max(3, share * totals.get(kind, 0) / 2))).toArrow()
        out[kind] = rows["token"].to_numpy().view(np.uint64), rows["n"].to_numpy(), totals.get(kind, 0)
    return out


def _rows(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    _, _, row, words = words_of(buf, offsets, lower=True)
    return words, row, len(offsets) - 1


def similar_groups(
    docs: DataFrame, k: int, similarity: Fraction, id_col: str = "doc_id", text_col: str = "text", orders: int = 3, frequent: float = 4e-6, common: float = 1e-5,
) -> DataFrame:
    """__cs_rid (see common.numbered), id, n_shingles, root (names the component; null for empty sets) and component_id of each row of docs."""
    spark, docs = docs.sparkSession, filed(docs)
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    base = numbered(slim).select("__cs_rid", "id", "text")
    order = Orders(frequent_tokens(slim.select("text"), k, frequent, common), orders, similarity, k)
    shared = spark.sparkContext.broadcast(order)
    parts = n_parts(spark)

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            buf, off = text_bytes(batch.column(2))
            n, name = [], []
            for i, j in pieces(off):
                for s, _ in shingle_sets(buf[off[i] : off[j]], off[i : j + 1] - off[i], k):
                    n.append(len(s)), name.append(set_name(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(name, pa.int64())], names=["__cs_rid", "id", "n_shingles", "node"]
            )

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, seen = Packer(parts), set()
        for batch in released(batches):
            buf, off = text_bytes(batch.column(0))
            for i, j in pieces(off):
                for s, level in shingle_sets(buf[off[i] : off[j]], off[i : j + 1] - off[i], k, shared.value):
                    if len(s) and (name := set_name(s)) not in seen:
                        if len(seen) < 1 << 20:
                            seen.add(name)
                        first = shared.value.prefix(s, 0, level)
                        yield from packer.add(first, np.full(len(first), name, np.int64))
        yield from packer.drain()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            buf, off = text_bytes(batch.column(1))
            for i, j in pieces(off):
                blobs, size, sketch, low = [], [], [], []
                for s, v in shingle_sets(buf[off[i] : off[j]], off[i : j + 1] - off[i], k, shared.value):
                    blobs.append(s.tobytes() + v.tobytes()), size.append(len(s))
                    sketch.append(bitmap(s) + b"".join(bitmap(shared.value.prefix(s, o, v), PREFIX_WORDS) for o in range(1, orders)))
                    low.append(np.sort(shared.value.prefix(s, 0, v).view(np.int64))[:LOW])
                columns = [batch.column(0)[i:j], pa.array(blobs, pa.binary()), pa.array(size, pa.int64()), pa.array(sketch, pa.binary()), pa.array(low, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "tokens", "size", "sketch", "low"])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                keep.append(links(stored(x.as_buffer()), stored(y.as_buffer()), shared.value, orders))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    kind = base.schema["id"].dataType.simpleString()
    named = cut(base.mapInArrow(names, f"__cs_rid long, id {kind}, n_shingles long, node long"))
    buckets = cut(buckets_of(slim.select("text").mapInArrow(prefixes, PACKED)))
    # a similar set has t n tokens at least, and of two sets the smaller number of shared tokens holds
    least = F.greatest(F.lit(1).cast("long"), F.expr(f"({similarity.numerator}L * n_shingles) div {similarity.denominator} div 20"))
    need = named.where("node IS NOT NULL").groupBy("node").agg(F.max(least).alias("need"))
    buckets = pruned(buckets, need)
    owner = named.join(buckets.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min("__cs_rid").alias("__cs_rid"))
    held = base.select("__cs_rid", "text").join(owner.hint("shuffle_hash"), "__cs_rid").select("node", "text")
    tokens = cut(held.mapInArrow(sets, "node long, tokens binary, size long, sketch binary, low array<long>"))

    def verify(pairs: DataFrame) -> DataFrame:
        side = lambda c: tokens.select(F.col("node").alias(c), F.col("tokens").alias(f"tokens_{c}"))
        both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "tokens_a", "tokens_b")
        return both.mapInArrow(linked, "a long, b long")

    found = resolve(buckets, verify, tokens.select("node", "size", "sketch", "low"), Filters(similarity, orders))
    discard(buckets, tokens)
    rooted = named.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least_id = rooted.where("root IS NOT NULL").groupBy("root").agg(F.min("id").alias("component_id"))
    return rooted.join(least_id, "root", "left").select("__cs_rid", "id", "n_shingles", "root", F.coalesce("component_id", "id").alias("component_id"))


def stored(blob: pa.Buffer) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and levels of a set, 9 bytes each."""
    n = blob.size // 9
    return np.frombuffer(blob, np.uint64, n), np.frombuffer(blob, np.uint8, n, 8 * n)


def links(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], order: Orders, orders: int) -> bool:
    """Whether two sets pass the length filter, the prefix filter of each order, and the exact test."""
    t, (x, lx), (y, ly) = order.similarity, a, b
    if t.numerator * max(len(x), len(y)) > t.denominator * min(len(x), len(y)):
        return False
    for o in range(1, orders):
        if len(np.intersect1d(order.prefix(x, o, lx), order.prefix(y, o, ly), assume_unique=True)) < shared_tokens(min(len(x), len(y))):
            return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return t.denominator * both >= t.numerator * (len(x) + len(y) - both)


def drop_similar(docs: DataFrame, k: int = 5, similarity: Fraction = Fraction(4, 5), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs of which one of each group of similar ones stays: the one with the smallest id (nulls last)."""
    docs = filed(docs)
    groups = cut(similar_groups(docs, k, similarity, id_col, text_col))
    first = F.min(F.struct(F.col("id").isNull().alias("z"), F.col("id"), F.col("__cs_rid")))
    stay = groups.where("root IS NOT NULL").groupBy("root").agg(first.alias("f")).select("f.__cs_rid")
    gone = groups.where("root IS NOT NULL").select("__cs_rid").join(stay, "__cs_rid", "left_anti")
    name = free_name(docs, "__cs_rid")[0]
    return numbered(docs, name).join(gone.withColumnRenamed("__cs_rid", name), name, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = similar_groups(documents(spark, sf_dir).select("doc_id", "text"), 3, Fraction(9, 10))
    return groups.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, hash(w[i], w[i + 1], w[i + 2]) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)
  UNION SELECT doc_id, hash(array_to_string(w, ' ')) AS g FROM d WHERE len(w) BETWEEN 1 AND 2
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), df AS (SELECT g, count(*) AS c FROM s GROUP BY g
), ranked AS (
  SELECT s.doc_id, s.g, n.n, row_number() OVER (PARTITION BY s.doc_id ORDER BY df.c, s.g) AS r FROM s JOIN df USING (g) JOIN n USING (doc_id)
), prefix AS (SELECT doc_id, g, n FROM ranked WHERE r <= n - (9 * n + 9) // 10 + 1
), cand AS (
  SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb FROM prefix a JOIN prefix b ON a.g = b.g AND a.doc_id < b.doc_id
  WHERE 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
), sized AS (
  SELECT c.a, c.b, c.na, c.nb, count(*) AS i FROM cand c JOIN s x ON x.doc_id = c.a JOIN s y ON y.doc_id = c.b AND y.g = x.g GROUP BY ALL
), link AS (
  SELECT a, b FROM sized WHERE 100 * i >= 90 * (na + nb - i) UNION ALL SELECT b, a FROM sized WHERE 100 * i >= 90 * (na + nb - i)
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN link l ON l.a = r.other
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, r.c AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(other) AS c FROM reach GROUP BY doc_id) r USING (doc_id)
"""

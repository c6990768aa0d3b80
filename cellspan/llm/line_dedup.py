"""Fuzzy line deduplication by MinHash.

Lines count as equal by their words, ASCII lower-cased. Distinct lines get a MinHash signature of their character
5-shingles, cut into bands. Lines that share a band are candidates; exact Jaccard similarity of the shingle sets
decides (0.8 or more links); connected components of equal or linked lines keep their first line (smallest id, then
place) and lose the others.

With 24 bands of 6 rows, a pair at similarity 0.8 meets in a band with probability 0.999, at 0.85 and above nearly always
(measured for lines of 16 to 480 shingles, 1,500 pairs each: 0.997 or more near 0.8, no pair lost at 0.85). Lines of SHORT
distinct shingles or more get one-permutation signatures, one permutation for each row with a bin for each band, so bins
are far fewer than shingles; bins that stay empty take the next full one's value. Lines of fewer than SHORT / 0.8 get one
hash function for each place. Those between get both, so similar lines always have signatures of one kind in common.

Lines are named by 64-bit hashes. One pass over the texts makes hashes and band keys. Band keys travel packed and are
dropped by map tasks that have sent the same line before; texts of lines travel only for lines that share a band. Bands
that two lines share are pairs, each tried once; only larger ones are kept as buckets. Documents are joined twice, to
fetch those lines and to drop lines, by hashing the small side.

Cases: lines without a word stay and are not compared. Null text stays null, with no lines. Null ids come last in the
order. Repeated rows are documents of their own, so the later one loses its lines. Lines under 5 characters only equal
exact copies. An empty table gives an empty result. Other columns are passed on; n_lines and n_removed replace input
columns of those names.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellspan.llm.common import _LOWER, cut, discard, documents, filed, free_name, mix, numbered, pieces, powers, released, text_bytes, words_of
from cellspan.llm.linking import LOW, PACKED, SKETCH_WORDS, Packer, Whole, by_part, dealt, n_parts, resolve, shared

SHINGLE = 5
SHORT = 64
MANY = SHORT * 5 // 4  # a line similar to one of fewer than SHORT has fewer
BLOCK = 1 << 15
_MULT = (mix(np.arange(1, SHINGLE + 1, dtype=np.uint64)) | np.uint64(1)).astype(np.uint32)
_EMPTY = np.uint32(0xFFFFFFFF)


def parted(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The rows' bytes, lower-cased, each row ended by a line feed."""
    out = np.full(len(buf) + len(offsets) - 1, 10, np.uint8)
    for r, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        out[a + r : b + r] = buf[a:b]
    return _LOWER[out]


class Lines:
    r"""The \n-split lines of some rows: row, hash (by its words, lower-cased) and whether it has a word."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        self.buf = parted(buf, offsets)
        self.brk = np.flatnonzero(self.buf == 10)
        self.row = np.searchsorted(offsets[1:] + np.arange(1, len(offsets)), self.brk + 1, "left")
        start, self.end, _, h = words_of(self.buf, np.array([0, len(self.buf)]))
        self.line = np.searchsorted(self.brk, start)
        self.first = np.searchsorted(self.line, np.arange(len(self.brk) + 1))
        p, q = powers(len(h) + 1)
        sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * p[: len(h)], out=sums[1:])
        self.has = self.first[1:] > self.first[:-1]
        self.hash = mix((sums[self.first[1:]] - sums[self.first[:-1]]) * q[self.first[:-1]])
        self.start = start

    def text(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the wanted lines (all with a word), words parted by one space and lines ended by a line feed; their ends."""
        keep = np.zeros(len(self.buf) + 1, np.int8)
        use = wanted[self.line]
        keep[self.start[use]] = 1
        keep[self.end[use] + 1] -= 1  # a word and the byte behind it
        out = self.buf[np.cumsum(keep[:-1], dtype=np.int8) > 0]
        size = self.end[use] - self.start[use] + 1
        gap = np.cumsum(size) - 1
        last = np.ones(len(gap), bool)
        line = self.line[use]
        last[:-1] = line[1:] != line[:-1]
        out[gap] = np.where(last, 10, 32).astype(np.uint8)
        return out, gap[last] + 1


def code_points(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of lines that end in line feeds, lines under SHINGLE characters filled up to it, and the number of each line's shingles."""
    points = np.frombuffer(text.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    brk = np.flatnonzero(points == 10)
    size = np.diff(brk, prepend=-1) - 1
    if size.min(initial=SHINGLE) < SHINGLE:  # pad short lines in front with their own length
        short = size < SHINGLE
        begin = brk - size
        points = np.insert(points, np.repeat(begin[short], SHINGLE - size[short]), np.repeat(size[short], SHINGLE - size[short]).astype(np.uint32) + np.uint32(0x110000))
        size = np.maximum(size, SHINGLE)
    return points, size - SHINGLE + 1


def exact_shingles(text: np.ndarray) -> tuple[np.ndarray | None, np.ndarray]:
    """Like shingles(), with a number for each different shingle instead of a hash; None for those of texts of over 4,096 different characters."""
    points, counts = code_points(text)
    kinds, rank = np.unique(points, return_inverse=True)
    if len(kinds) > 1 << 12:
        return None, counts
    m = max(0, len(points) - SHINGLE + 1)
    code, whole, no_brk = np.zeros(m, np.uint64), np.ones(m, bool), points != 10
    for d in range(SHINGLE):
        code |= rank[d : d + m].astype(np.uint64) << np.uint64(12 * d)
        whole &= no_brk[d : d + m]
    return np.unique(code[whole], return_inverse=True)[1].astype(np.uint32), counts


def shingles(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of the character shingles of lines that end in line feeds, and the number of each line's shingles.

    A line of fewer characters is one shingle.
    """
    points, counts = code_points(text)
    m = max(0, len(points) - SHINGLE + 1)
    h = np.zeros(m, np.uint32)
    whole = np.ones(m, bool)
    no_brk = points != 10
    for d in range(SHINGLE):
        h += points[d : d + m] * _MULT[d]
        whole &= no_brk[d : d + m]
    h = h[whole]
    h ^= h >> np.uint32(16)
    h *= np.uint32(0x7FEB352D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x846CA68B)
    h ^= h >> np.uint32(16)
    return h, counts


def sets(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sorted distinct (line, shingle) pairs, 32 bits each."""
    both = np.repeat(np.arange(len(counts), dtype=np.uint64) << np.uint64(32), counts) | h
    both.sort()  # np.unique is slow on such keys
    return both[np.append(True, both[1:] != both[:-1])[: len(both)]]


def overlap(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For lines x and y (shingles and their numbers) side by side: distinct shingles in common, and those of x and of y."""
    n = len(x[1])
    own = lambda h, counts, side: np.repeat(np.arange(n, dtype=np.uint64) << np.uint64(33), counts) | h.astype(np.uint64) << np.uint64(1) | np.uint64(side)
    v = np.concatenate([own(*x, 0), own(*y, 1)])
    v.sort()
    v = v[np.append(True, v[1:] != v[:-1])[: len(v)]]
    edge = np.searchsorted(v, np.arange(n + 1, dtype=np.uint64) << np.uint64(33))
    met = np.append(0, np.cumsum((v[1:] ^ v[:-1]) == np.uint64(1)))  # the same line and shingle, of x and then of y
    last = np.maximum(edge - 1, 0)
    return met[last[1:]] - met[last[:-1]], np.diff(edge)


def distinct(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The number of distinct shingles of each line."""
    return np.bincount((sets(h, counts) >> np.uint64(32)).astype(np.int64), minlength=len(counts))


def one_permutation(h: np.ndarray, base: np.ndarray, n: int, bins: int) -> np.ndarray:
    """Lines x bins one-permutation signatures, empty bins filled from the next full one; base is each shingle's line * bins."""
    sig = np.full(n * bins, _EMPTY)
    place = h >> np.uint32(16)
    place *= np.uint32(bins)
    place >>= np.uint32(16)
    np.minimum.at(sig, base + place, h)
    sig = sig.reshape(n, bins)
    gaps = np.flatnonzero((sig == _EMPTY).any(axis=1))
    if len(gaps):
        some = sig[gaps]
        at = np.where(np.concatenate([some, some], axis=1) != _EMPTY, np.arange(2 * bins, dtype=np.int16), np.int16(4 * bins))
        nxt = np.minimum.accumulate(at[:, ::-1], axis=1)[:, ::-1][:, :bins]
        sig[gaps] = np.take_along_axis(some, nxt.astype(np.int64) % bins, axis=1) + (nxt - np.arange(bins)).astype(np.uint32) * np.uint32(0x9E3779B1)
    return sig


def multipliers(n: int) -> np.ndarray:
    """Odd numbers; shingles are mixed already, so each of them times h is a permutation of its own."""
    return (mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)).astype(np.uint32)


def some_permutations(h: np.ndarray, counts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Lines x (rows * bands) signatures: for each row a permutation of its own, with a bin for each band."""
    base = np.repeat(np.arange(0, len(counts) * bands, bands), counts)
    return np.concatenate([one_permutation(h * m, base, len(counts), bands) for m in multipliers(rows)], axis=1)


def many_permutations(h: np.ndarray, counts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Lines x (rows * bands) signatures with a hash function for each place.

    Lines of like length are laid side by side, shingles downwards and the last one repeated (which leaves the minimum
    as it is), in blocks that stay in a core's cache.
    """
    places, first = bands * rows, np.cumsum(counts) - counts
    mult = multipliers(places)
    out = np.empty((len(counts), places), np.uint32)
    order = np.argsort(counts, kind="stable")
    a = 0
    while a < len(order):
        b = min(len(order), a + max(1, BLOCK // int(counts[order[a]])))
        while b - a > 1 and (b - a) * int(counts[order[b - 1]]) > 2 * BLOCK:
            b = (a + b + 1) // 2
        use = order[a:b]
        down = np.minimum(np.arange(counts[use[-1]])[:, None], counts[use] - 1)
        block = h[first[use] + down]
        v, sig = np.empty_like(block), np.empty((places, b - a), np.uint32)
        for k in range(places):
            np.multiply(block, mult[k], out=v)
            np.minimum.reduce(v, axis=0, out=sig[k])
        out[use] = sig.T
        a = b
    return out


def keys_of(sig: np.ndarray, bands: int, kind: int) -> np.ndarray:
    """Lines x bands keys; a band takes every bands-th place."""
    v = np.tile(np.arange(1, bands + 1, dtype=np.uint64) + np.uint64(1000 * kind), (len(sig), 1))
    for r in range(sig.shape[1] // bands):
        v = mix(v * np.uint64(0xD6E8FEB86659FD93) + sig[:, r * bands : (r + 1) * bands])
    return v


def surely(h: np.ndarray, counts: np.ndarray, least: int) -> np.ndarray:
    """Which lines have least different shingles or more among their first 2 * least; others may have them too."""
    out, first = np.zeros(len(counts), bool), np.cumsum(counts) - counts
    use = np.flatnonzero(counts >= 2 * least)
    some = np.sort(h[first[use][:, None] + np.arange(2 * least)], axis=1)
    out[use] = np.count_nonzero(some[:, 1:] != some[:, :-1], axis=1) + 1 >= least
    return out


def band_keys(text: np.ndarray, names: np.ndarray, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Band keys of lines, and the names of their lines."""
    h, counts = shingles(text)
    long = surely(h, counts, MANY)
    rest = ~long
    few = sets(h[np.repeat(rest, counts)], counts[rest])  # repeated shingles change the kind, and cost time
    size = np.full(len(counts), MANY)
    size[rest] = np.bincount((few >> np.uint64(32)).astype(np.int64), minlength=int(rest.sum()))
    few = few.astype(np.uint32)  # the shingles, line by line
    keys, owners = [], []
    if (use := size >= SHORT).any():
        keys.append(keys_of(some_permutations(h[np.repeat(use, counts)], counts[use], bands, rows), bands, 0)), owners.append(names[use])
    if (use := size < MANY).any():
        own = few[np.repeat(use[rest], size[rest])]
        keys.append(keys_of(many_permutations(own, size[use], bands, rows), bands, 1)), owners.append(names[use])
    return np.concatenate([k.ravel() for k in keys]), np.concatenate([np.repeat(o, bands) for o in owners])


def packed_lines(docs: DataFrame, bands: int, rows: int, parts: int) -> DataFrame:
    """From (__cs_rid, id, text), in one pass: PACKED (band key, line hash) of lines, and (__cs_rid, id, lines) of documents.

    lines has the hashes of a document's lines, null for lines without a word; these rows have a part above the others.
    A task sends a line's keys once, as far as it remembers (the first 2**20 lines).
    """
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, seen, names = Packer(parts), set(), ["part", "blob", "__cs_rid", "id", "lines"]
        like = [pa.int64(), None, pa.list_(pa.int64())]

        def sent(packed: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in packed:
                yield pa.RecordBatch.from_arrays([*b.columns, *(pa.nulls(b.num_rows, t) for t in like)], names=names)

        for batch in released(batches):
            like[1] = batch.column(1).type
            buf, off = text_bytes(batch.column(2))
            for i, j in pieces(off):
                own = Lines(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                ends = np.searchsorted(own.row, np.arange(j - i + 1)).astype(np.int32)
                lines = pa.ListArray.from_arrays(pa.array(ends), pa.array(own.hash.view(np.int64), mask=~own.has))
                rid = batch.column(0)[i:j]
                part = parts + ((mix(rid.to_numpy().view(np.uint64)) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.nulls(j - i, pa.binary()), rid, batch.column(1)[i:j], lines], names=names)
                ids, first = np.unique(own.hash[own.has], return_index=True)
                new = np.array([x not in seen for x in ids.tolist()], bool)
                if not new.any():
                    continue
                if len(seen) < 1 << 20:
                    seen.update(ids[new].tolist())
                wanted = np.zeros(len(own.has), bool)
                wanted[np.flatnonzero(own.has)[first[new]]] = True
                yield from sent(packer.add(*band_keys(own.text(wanted)[0], own.hash[wanted].view(np.int64), bands, rows)))
        yield from sent(packer.drain())

    return docs.mapInArrow(run, f"{PACKED}, __cs_rid long, id {kind}, lines array<long>")


def unpacked_lines(packed: DataFrame) -> DataFrame:
    """From packed_lines(): (key, node, centre) of the keys that three nodes or more have, (node, centre) of those that two have, and the documents' rows."""
    kind = packed.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, like, docs = ["key", "node", "centre", "__cs_rid", "id", "lines"], [], []

        def blobs() -> Iterator[pa.RecordBatch]:
            for batch in released(batches):
                n = batch.num_rows - batch.column(1).null_count  # documents come last
                like[:] = [c.type for c in batch.columns[2:]]
                docs.append(batch.slice(n))
                yield batch.slice(0, n)

        def waiting() -> Iterator[pa.RecordBatch]:
            while docs:
                b = docs.pop()
                if b.num_rows:
                    yield pa.RecordBatch.from_arrays([*(pa.nulls(b.num_rows, pa.int64()) for _ in range(3)), *b.columns[2:]], names=names)

        for _, held in by_part(blobs()):
            yield from waiting()
            k, v, first = shared(held)
            if len(k):
                at = np.arange(len(k))
                two = np.bincount(first, minlength=len(k))[first] == 2
                use = ~two | (first != at)
                rows = [pa.array(k[use], mask=two[use]), pa.array(v[use]), pa.array(v[first][use])]
                yield pa.RecordBatch.from_arrays([*rows, *(pa.nulls(int(use.sum()), t) for t in like)], names=names)
        yield from waiting()

    return dealt(packed).mapInArrow(run, f"key long, node long, centre long, __cs_rid long, id {kind}, lines array<long>")


def line_texts(wanted: DataFrame) -> DataFrame:
    """(node, line, size, sketch) of the lines named by (text, places, nodes, big): their normal text, ended by a line feed.

    Only big ones, which are in buckets, get a size and a sketch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            buf, off = text_bytes(batch.column(0))
            place, node = batch.column(1), batch.column(2)
            at = place.offsets.to_numpy()
            for i, j in pieces(off):
                part, begin, end = buf[off[i] : off[j]], off[i:j] - off[i], off[i + 1 : j + 1] - off[i]
                brk = np.flatnonzero(part == 10)
                row = np.repeat(np.arange(j - i), np.diff(at[i : j + 1]))
                nth = np.searchsorted(brk, begin)[row] + place.values.to_numpy()[at[i] : at[j]]
                begin = np.maximum(begin[row], np.append(-1, brk)[nth] + 1)
                end = np.minimum(end[row], np.append(brk, len(part))[nth])
                spans = [part[x:y] for x, y in zip(begin.tolist(), end.tolist(), strict=True)]
                own = Lines(np.concatenate([part[:0], *spans]), np.append(0, np.cumsum(end - begin)))
                text, ends = own.text(own.has)
                ends = np.append(0, ends).astype(np.int32)
                lines = pa.StringArray.from_buffers(len(spans), pa.py_buffer(ends), pa.py_buffer(text))
                marked = batch.column(3).values.to_numpy(zero_copy_only=False)[at[i] : at[j]]
                size, sketch = np.zeros(len(spans), np.int64), np.full(len(spans), None)
                if marked.any():
                    size[marked], sketch[marked] = sketches(text[np.repeat(marked, np.diff(ends))])
                columns = [pa.array(node.values.to_numpy()[at[i] : at[j]]), lines, pa.array(size, mask=~marked), pa.array(sketch, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "line", "size", "sketch"])

    return wanted.mapInArrow(run, "node long, line string, size long, sketch binary")


def sketches(text: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """The number of distinct shingles and the bitmap of each line."""
    h, counts = shingles(text)
    n, width = len(counts), 64 * SKETCH_WORDS
    line = np.repeat(np.arange(n), counts)
    size = distinct(h, counts)
    bits = np.zeros((n, width), np.uint8)
    bits[line, h % np.uint32(width)] = 1
    return size.astype(np.int64), [b.tobytes() for b in np.packbits(bits, axis=1)]


def shingle_set(line: str) -> frozenset[str]:
    line = line.removesuffix("\n")
    return frozenset(line[i : i + SHINGLE] for i in range(max(1, len(line) - SHINGLE + 1)))


class Same:
    """Whether lines' shingle sets are similar, by pairs."""

    def __init__(self, similarity: Fraction):
        self.similarity = similarity

    def over(self, both: np.ndarray, all_: np.ndarray) -> np.ndarray:
        """How far pairs are over the bound (0 or more: similar), by their shingles in common and those of both sides."""
        return self.similarity.denominator * both - self.similarity.numerator * (all_ - both)

    def exactly(self, xs: list[str], ys: list[str]) -> np.ndarray:
        h, counts = exact_shingles(np.frombuffer("".join(xs + ys).encode(), np.uint8))
        if h is not None:
            n = len(xs)
            at = int(counts[:n].sum())
            return self.over(*overlap((h[:at], counts[:n]), (h[at:], counts[n:]))) >= 0
        sides = [(shingle_set(x), shingle_set(y)) for x, y in zip(xs, ys, strict=True)]
        return self.over(np.array([len(p & q) for p, q in sides]), np.array([len(p) + len(q) for p, q in sides])) >= 0

    def __call__(self, xs: list[str], ys: list[str], most: int = 1 << 18) -> np.ndarray:
        """Sets of 32-bit hashes decide unless they are within two shingles of the bound; there, the shingles do."""
        out, a = np.zeros(len(xs), bool), 0
        while a < len(xs):
            b, n = a, 0
            while b < len(xs) and (b == a or n < most):
                n += len(xs[b]) + len(ys[b])
                b += 1
            over = self.over(*overlap(*(shingles(np.frombuffer("".join(v[a:b]).encode(), np.uint8)) for v in (xs, ys))))
            out[a:b] = over >= 0
            near = (a + np.flatnonzero(np.abs(over) <= 2 * (self.similarity.numerator + self.similarity.denominator))).tolist()
            if near:
                out[near] = self.exactly([xs[k] for k in near], [ys[k] for k in near])
            a = b
        return out


def similar(pairs: DataFrame, same: Same) -> DataFrame:
    """The (a, b) of (a, b, line_a, line_b) whose shingle sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            keep = same(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(run, "a long, b long")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, bands: int = 24, rows: int = 6) -> DataFrame:
    """docs with the repeated lines taken out of their texts, n_lines (with words, before) and n_removed."""
    spark, docs = docs.sparkSession, filed(docs)
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    base = numbered(slim).select("__cs_rid", "id", "text")
    both = cut(unpacked_lines(packed_lines(base, bands, rows, n_parts(spark))))
    lines = both.where("__cs_rid IS NOT NULL").select("__cs_rid", "id", "lines")
    buckets = both.where("key IS NOT NULL").select("key", "node", "centre")
    pairs = both.where("key IS NULL AND node IS NOT NULL").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b"))
    pairs = cut(pairs.distinct())
    spots = lines.select("__cs_rid", "id", F.posexplode("lines").alias("place", "node")).where("node IS NOT NULL")
    order = F.struct(F.col("id").isNull().alias("z"), F.col("id"), F.col("__cs_rid"), F.col("place"))
    each = spots.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    mates = pairs.select(F.explode(F.array("a", "b")).alias("node"), F.lit(False).alias("big")).unionAll(buckets.select("node", F.lit(True).alias("big")))
    each = cut(each.join(mates.groupBy("node").agg(F.max("big").alias("big")), "node", "left").where("n > 1 OR big IS NOT NULL"))

    low = buckets.groupBy("node").agg(F.slice(F.sort_array(F.collect_list("key")), 1, LOW).alias("low"))
    asked = each.where("big IS NOT NULL").groupBy("first.__cs_rid").agg(F.collect_list(F.struct("first.place", "node", "big")).alias("l"))
    wanted = base.select("__cs_rid", "text").join(asked.hint("shuffle_hash"), "__cs_rid")
    texts = cut(line_texts(wanted.select("text", "l.place", "l.node", "l.big")))
    same = Same(Fraction(similarity).limit_denominator(1000))

    def verify(pairs: DataFrame) -> DataFrame:
        side = lambda n: texts.select(F.col("node").alias(n), F.col("line").alias(f"line_{n}"))
        return similar(pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "line_a", "line_b"), same)

    marks = texts.join(low, "node").select("node", "size", "sketch", "low", F.col("line").alias("payload"))
    linked = resolve(buckets, verify, marks, Whole(same.similarity), same, pairs)
    discard(pairs, texts)
    many = each.drop("big").join(linked, "node", "left").where("n > 1 OR root IS NOT NULL").withColumn("root", F.coalesce("root", "node"))
    best = many.groupBy("root").agg(F.min("first").alias("best"))
    keeper = cut(many.join(best, "root").select("node", "best"))
    gone = spots.join(keeper, "node").where(~((F.col("best.__cs_rid") == F.col("__cs_rid")) & (F.col("best.place") == F.col("place"))))
    by_doc = gone.groupBy("__cs_rid").agg(F.collect_list("place").alias("gone"))
    counts = lines.select("__cs_rid", F.size(F.array_compact("lines")).cast("long").alias("lines"))

    rid, n_lines, away, split = free_name(docs, "__cs_rid", "__cs_lines", "__cs_gone", "__cs_split")
    per_doc = counts.join(by_doc, "__cs_rid", "left").select(F.col("__cs_rid").alias(rid), F.col("lines").alias(n_lines), F.col("gone").alias(away))
    text = F.col(f"`{text_col}`")
    joined = numbered(docs, rid).join(per_doc.hint("shuffle_hash"), rid).withColumn(split, F.when(F.col(away).isNotNull(), F.split(text, "\n")))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col(away)), lambda i: F.get(F.col(split), i))
    kept_text = F.when(F.col(away).isNull(), text).otherwise(F.array_join(kept, "\n"))
    keep = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    return joined.select(
        *[(kept_text.alias(c) if c == text_col else F.col(f"`{c}`")) for c in keep],
        F.col(n_lines).alias("n_lines"),
        F.coalesce(F.size(away), F.lit(0)).cast("long").alias("n_removed"),
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))

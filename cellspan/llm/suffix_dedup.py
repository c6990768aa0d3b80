"""Suffix-array deduplication: every byte under a string of `least` bytes that also starts earlier is removed.

Sparse suffix arrays by content-chosen anchors. In every `least`-byte string, the k-mer with the smallest hash (the
leftmost of equal ones) is its anchor, so equal strings have equal anchors at equal places, and anchors are some 40
bytes apart. Anchors travel packed; those whose k-mer stands once are dropped. Around each other anchor, the bytes of
the strings it is the anchor of go to the k-mer's part. There, intervals of anchors are expanded breadth first, one byte
a level, and an anchor alone in its interval leaves the search:

* on the reversed text, backward extension by the next byte: level r holds the anchors that share r bytes from the
  anchor on with others, so common prefixes come out by increasing value;
* on the text, backward extension by the byte before (the Burrows-Wheeler column): at level l, anchors whose interval is
  still shared and that share least - l bytes from the anchor on start equal strings l bytes before it. The search stops
  where the strings have the minimum length.

All but the first of equal strings are marked; marks go back to their documents, where their union is removed.

Before bytes travel, a task marks all but the first of identical pieces of a batch by itself (their bytes are compared),
and sends that one alone; texts that are copies of an earlier text as a whole are marked by their digest. So common
passages, long runs and groups of copies reach a part at most once per batch. A task holds one part at a time. Documents
are joined twice by row number, with one shuffle of the texts that both joins read.

Cases: null text counts as no bytes. Texts under `least` bytes keep all bytes. Ids are integers; equal ids are ordered
by row, and null ids come last. Matches don't cross documents. An empty table gives an empty result; other columns,
whatever their names, are left out. With keep_text=True the remaining bytes come as `kept` (binary). `least` below 48 or
above 8192 is refused.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellspan.llm.common import documents, filed, mix, numbered, pieces, powers, prefix_sums, released, span_hashes, text_bytes
from cellspan.llm.linking import PACKED, by_part, dealt, n_parts

KMER = 24
_LAST = np.iinfo(np.int64).max


def anchors(buf: np.ndarray, offsets: np.ndarray, least: int, k: int = KMER) -> tuple[np.ndarray, ...]:
    """k-mer hash, row, place, first and last string start of each anchor; places count from the row's start."""
    none = tuple(np.zeros(0, d) for d in (np.uint64, np.int64, np.int64, np.int64, np.int64))
    if len(buf) < least:
        return none
    sums, m = prefix_sums(buf), len(buf) - k + 1
    _, q = powers(len(sums))
    h = mix((sums[k:] - sums[:m]) * q[:m])
    del sums
    low = np.uint64((1 << max(20, len(buf).bit_length())) - 1)
    v = (h & ~low) | np.arange(m, dtype=np.uint64)
    width, w = 1, least - k + 1
    while 2 * width <= w:
        v = np.minimum(v[:-width], v[width:])
        width *= 2
    if w > width:
        v = np.minimum(v[: len(v) - (w - width)], v[w - width :])
    valid, new = np.ones(len(v), bool), np.ones(len(v), bool)
    place = v & low
    new[1:] = place[1:] != place[:-1]
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        valid[max(a, b - least + 1) : b] = False
        if a < len(new):
            new[a] = True
    first = np.flatnonzero(new & valid)
    if not len(first):
        return none
    stop = np.append(np.flatnonzero(new | ~valid), len(v))
    last = stop[np.searchsorted(stop, first, "right")] - 1
    row = np.searchsorted(offsets, first, "right") - 1
    at, base = place[first].astype(np.int64), offsets[row]
    return h[at], row, at - base, first - base, last - base


def sent(columns: list[np.ndarray], part: np.ndarray, data: np.ndarray | None = None, size: np.ndarray | None = None) -> pa.RecordBatch:
    """PACKED rows: per part the number of entries, their 8-byte columns, and their bytes."""
    order = np.argsort(part, kind="stable")
    ids, first = np.unique(part[order], return_index=True)
    ends = np.append(first[1:], len(part))
    if data is not None:
        begin = np.cumsum(size) - size
    blobs = []
    for a, b in zip(first, ends, strict=True):
        o = order[a:b]
        blob = b"".join([np.int64(b - a).tobytes(), *(c[o].tobytes() for c in columns)])
        if data is not None:
            m = size[o]
            src = np.repeat(begin[o] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
            blob += data[src].tobytes()
        blobs.append(blob)
    return pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), pa.array(blobs, pa.binary())], names=["part", "blob"])


def received(blob: bytes | memoryview, columns: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns and bytes of a blob."""
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    return np.frombuffer(blob, np.int64, n * columns, 8).reshape(columns, n), np.frombuffer(blob, np.uint8, offset=8 * (1 + n * columns))


def by_row(rid: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """One (rid, blob) row per document with its entries."""
    order = np.argsort(rid, kind="stable")
    rid, both = rid[order], np.stack([c[order] for c in columns], axis=1)
    ids, begin = np.unique(rid, return_index=True)
    blobs = [b.tobytes() for b in np.split(both, begin[1:])] if len(ids) else []
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(blobs, pa.binary())], names=["__cs_rid", "blob"])


def _windows(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Rows of bytes data[begin : begin + size], filled up with zeros."""
    width = max(1, int(size.max(initial=0)))
    padded = np.concatenate([data, np.zeros(width, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, width)[begin]
    rows *= np.arange(width) < size[:, None]
    return rows


def _expand(interval: np.ndarray, active: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """The active ones that share their interval's extension by a byte with others; interval gets the new ones."""
    _, cls, counts = np.unique(interval[active] * 256 + byte, return_inverse=True, return_counts=True)
    shared = counts[cls] > 1
    active = active[shared]
    interval[active] = cls[shared]
    return active


def repeated_strings(
    ident: np.ndarray, rid: np.ndarray, place: np.ndarray, far: np.ndarray, near: np.ndarray, anchor: np.ndarray, data: np.ndarray, least: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """rid, first and last start of runs of strings that equal an earlier one.

    Entry i stands at place[i] of its text and at anchor[i] of data, which has the bytes from far[i] before it to the end
    of the string that starts near[i] before it.
    """
    by = np.lexsort((place, rid, ident))
    rid, place, far, near, anchor = rid[by], place[by], far[by], near[by], anchor[by]
    n, most = len(by), int(far.max())
    reach = least - near
    right = _windows(data, anchor, reach)
    left = _windows(data[::-1], len(data) - anchor, far)
    prefix = np.full((least + 1, n), -1, np.int32)  # by level: the interval of anchors with that common prefix
    interval, active = np.zeros(n, np.int64), np.arange(n)
    for r in range(1, right.shape[1] + 1):
        active = active[reach[active] >= r]
        active = _expand(interval, active, right[active, r - 1])
        if not len(active):
            break
        prefix[r, active] = interval[active]
    active = np.flatnonzero(prefix[KMER] >= 0)
    interval[active] = prefix[KMER, active]
    found = np.zeros((n, most + 3), np.int8)  # by level, with a column before and one behind
    for level in range(most + 1):
        if level:
            active = active[far[active] >= level]
            active = _expand(interval, active, left[active, level - 1])
        if not len(active):
            break
        own = active[(near[active] <= level) & (prefix[least - level, active] >= 0)]
        if not len(own):
            continue
        key = interval[own] * (n + 1) + prefix[least - level, own]
        sort = np.argsort(key, kind="stable")
        again = sort[1:][key[sort[1:]] == key[sort[:-1]]]
        found[own[again], level + 1] = 1
    edge = np.diff(found, axis=1)
    (row, low), (_, high) = np.nonzero(edge > 0), np.nonzero(edge < 0)
    return rid[row], place[row] - high + 1, place[row] - low


def by_kmer(anchor: np.ndarray, data: np.ndarray, most: int = 8192) -> Iterator[np.ndarray]:
    """Entries in groups of about most, none parted from others of the same k-mer."""
    key = _windows(data, anchor, np.full(len(anchor), 8)).view(np.uint64)[:, 0]
    order = np.argsort(key, kind="stable")
    key = key[order]
    a = 0
    while a < len(key):
        b = min(len(key), a + most)
        b = int(np.searchsorted(key, key[b - 1], "right"))
        yield order[a:b]
        a = b


def gathered(entries: Iterable[tuple[np.ndarray, ...]], flush: int = 1 << 20) -> Iterator[list[np.ndarray]]:
    """Entries (arrays of one length) put together up to about flush."""
    held, n = [], 0
    for x in entries:
        held.append(x)
        n += len(x[0])
        if n >= flush:
            yield [np.concatenate(c) for c in zip(*held, strict=True)]
            held, n = [], 0
    if n:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def kept_bytes(raw: np.ndarray, blobs: list[bytes], least: int) -> tuple[np.ndarray, int, int]:
    """What stays of a document, the bytes removed and their maximal runs."""
    if not blobs or len(raw) < least:
        return raw, 0, 0
    both = np.concatenate([np.frombuffer(b, np.int64).reshape(-1, 2) for b in blobs])
    step = np.zeros(len(raw) + 1, np.int64)
    np.add.at(step, both[:, 0], 1)
    np.add.at(step, np.minimum(both[:, 1], len(raw) - least) + least, -1)
    gone = np.cumsum(step[:-1]) > 0
    return raw[~gone], int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 100, keep_text: bool = False) -> DataFrame:
    """id, n_bytes, n_removed, n_spans and kept_sha256 of each row of docs."""
    if not 2 * KMER <= least <= 8192:
        raise ValueError(f"least is {least}; it must be from {2 * KMER} to 8192")
    spark = docs.sparkSession
    slim = filed(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    base = numbered(slim).select("__cs_rid", F.coalesce(F.col("id").cast("long"), F.lit(int(_LAST))).alias("ident"), "id", "text")
    parts = n_parts(spark)
    # anchors have the smallest hashes of their windows, so parts go by a hash of those
    to_part = lambda key: ((mix(key.view(np.uint64)) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        for batch in released(batches):
            buf, off = text_bytes(batch.column(2))
            rid, ident = (batch.column(c).to_numpy() for c in (0, 1))
            use = np.zeros(batch.num_rows, bool)
            for r in np.lexsort((rid, ident)):  # of equal texts, the first by id
                if off[r + 1] - off[r] < least:
                    continue
                name = hashlib.blake2b(buf[off[r] : off[r + 1]], digest_size=16).digest()
                if seen.get(name, _LAST) >= ident[r]:
                    use[r] = name not in seen or seen[name] > ident[r]
                    seen[name] = int(ident[r])
            for i, j in pieces(off, 1 << 20):
                key, row, place, s0, s1 = anchors(buf[off[i] : off[j]], off[i : j + 1] - off[i], least)
                row = row + i
                keep = use[row] if len(row) else np.zeros(0, bool)
                key, row, place, s0, s1 = (x[keep] for x in (key, row, place, s0, s1))
                if len(key):
                    yield sent([key.view(np.int64), rid[row], place << 32 | (place - s0) << 16 | (place - s1)], to_part(key))

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of(blobs: list[pa.Buffer]) -> tuple[np.ndarray, ...]:
            key, rid, where = np.concatenate([received(b, 3)[0] for b in blobs], axis=1)
            order = np.argsort(key, kind="stable")
            key = key[order]
            again = np.zeros(len(key), bool)
            again[1:] = key[1:] == key[:-1]
            again[:-1] |= again[1:]
            return rid[order[again]], where[order[again]]

        for own in gathered(of(blobs) for _, blobs in by_part(released(batches))):
            yield sent(own, to_part(own[0]))

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blobs in by_part(released(batches)):
            yield by_row(*np.concatenate([received(b, 2)[0] for b in blobs], axis=1))

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            buf, off = text_bytes(batch.column(3))
            rid, ident = (batch.column(c).to_numpy() for c in (0, 1))
            blobs = [b"".join(x) if x else b"" for x in batch.column(4).to_pylist()]
            upto = np.cumsum([0, *(len(b) // 8 for b in blobs)])
            a = 0
            while a < len(blobs):  # some 40,000 anchors at a time
                b = max(a + 1, int(np.searchsorted(upto, upto[a] + 40_000)))
                if upto[b := min(b, len(blobs))] > upto[a]:
                    where = np.frombuffer(b"".join(blobs[a:b]), np.int64)
                    row = np.repeat(np.arange(a, b), np.diff(upto[a : b + 1]))
                    place, far, near = where >> 32, where >> 16 & 65535, where & 65535
                    size, begin = far - near + least, off[row] - off[a] + place - far
                    data = _windows(buf[off[a] : off[b]], begin, size)
                    sums = prefix_sums(buf[off[a] : off[b]])
                    key = span_hashes(sums, begin + far, begin + far + KMER)
                    name = span_hashes(sums, begin, begin + size) ^ (far << 16 | near).astype(np.uint64)
                    order = np.lexsort((place, rid[row], ident[row], name))
                    near_equal = np.flatnonzero(name[order[1:]] == name[order[:-1]])
                    p, q = order[near_equal], order[near_equal + 1]
                    dup = np.zeros(len(name), bool)
                    dup[q[(far[p] == far[q]) & (near[p] == near[q]) & (data[p] == data[q]).all(axis=1)]] = True
                    if dup.any():  # parts below 0 hold marks
                        yield sent([rid[row[dup]], place[dup] - far[dup], place[dup] - near[dup]], -1 - to_part(key[dup]))
                    k = ~dup
                    own = data[k][np.arange(data.shape[1]) < size[k][:, None]]
                    yield sent([ident[row[k]], rid[row[k]], place[k], far[k], near[k]], to_part(key[k]), own, size[k])
                a = b

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of(part: int, blobs: list[pa.Buffer]) -> Iterator[tuple[np.ndarray, ...]]:
            if part < 0:
                yield tuple(np.concatenate([received(b, 3)[0] for b in blobs], axis=1))
                return
            got = [received(b, 5) for b in blobs]
            ident, rid, place, far, near = np.concatenate([g[0] for g in got], axis=1)
            data = np.concatenate([g[1] for g in got])
            size = far - near + least
            anchor = np.cumsum(size) - size + far
            for k in by_kmer(anchor, data):
                yield repeated_strings(*(x[k] for x in (ident, rid, place, far, near, anchor)), data, least)

        for own in gathered(x for part, blobs in by_part(released(batches)) for x in of(part, blobs)):
            yield sent(own, to_part(own[0]))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blobs in by_part(released(batches)):
            rid, first, last = np.concatenate([received(b, 3)[0] for b in blobs], axis=1)
            order = np.lexsort((first, rid))
            rid, first, last = rid[order], first[order], last[order]
            last = np.maximum.accumulate(last + (np.cumsum(np.diff(rid, prepend=rid[:1]) != 0) << 33)) & ((1 << 33) - 1)  # within a document
            new = np.ones(len(rid), bool)
            new[1:] = (rid[1:] != rid[:-1]) | (first[1:] > last[:-1] + 1)
            at = np.flatnonzero(new)
            yield by_row(rid[at], first[at], last[np.append(at[1:], len(rid)) - 1])

    kind = base.schema["id"].dataType.simpleString()

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            buf, off = text_bytes(batch.column(3))
            rest = [kept_bytes(buf[off[r] : off[r + 1]], b or [], least) for r, b in enumerate(batch.column(4).to_pylist())]
            columns = [batch.column(2), pa.array(np.diff(off), pa.int64()), pa.array([x[1] for x in rest], pa.int64()), pa.array([x[2] for x in rest], pa.int64())]
            columns.append(pa.array([hashlib.sha256(x[0]).hexdigest() for x in rest], pa.string()))
            if keep_text:
                columns.append(pa.array([x[0].tobytes() for x in rest], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: len(columns)])

    # both joins have the same left side, columns included, so that its texts are shuffled once
    with_blobs = lambda df: base.join(df.groupBy("__cs_rid").agg(F.collect_list("blob").alias("blobs")), "__cs_rid", "left").select("__cs_rid", "ident", "id", "text", "blobs")
    spots = dealt(dealt(base.select("__cs_rid", "ident", "text").mapInArrow(find, PACKED)).mapInArrow(repeated, PACKED)).mapInArrow(back, "__cs_rid long, blob binary")
    marked = dealt(dealt(with_blobs(spots).mapInArrow(cut_out, PACKED)).mapInArrow(mark, PACKED)).mapInArrow(merge, "__cs_rid long, blob binary")

    digests = base.where(F.octet_length("text") >= least).select("__cs_rid", "ident", F.sha2("text", 256).alias("sha"))
    first = digests.groupBy("sha").agg(F.min(F.struct("ident", "__cs_rid")).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1")
    whole = F.lit(np.array([0, _LAST - 2 * least], np.int64).tobytes())
    copies = digests.join(first, "sha").where("f.__cs_rid <> __cs_rid").select("__cs_rid", whole.alias("blob"))
    schema = f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text
    return with_blobs(marked.unionAll(copies)).mapInArrow(finish, schema)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))

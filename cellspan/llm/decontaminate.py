"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

Texts and items are sequences of words (ASCII lower-cased, ASCII punctuation dropped). A document is hit by an item if
some stretch of it is within `share` of the item's length in word edits.

1. Windows. At `d` edits, an item of n words keeps a run of at least ceil((n - d) / (d + 1)) words unchanged
   (pigeonhole), so windows are laid only where a run of that length (4 at most) also stands in the item, at the place
   the run gives them and `shifts` words around it. That leaves out no hit.
2. Embedding. Each of `walks` CGK random walks reads a window of the item's size: at a step it writes the current word,
   and moves on if a random bit of (walk, step, word) is set, until the item is read. Equal beginnings walk alike and
   meet again after an edit, so an edit distance becomes a Hamming distance. What is behind a window's end agrees with
   nothing.
3. LSH. `tables` times a walk, `bits` sampled steps before the item's end must agree with the item's walk. Simulated
   (300 pairs a size, words by a Zipf law): windows with 20 % edits agree in 54 % (16 words) to 38 % (60 words) of the
   steps and pass at 100 % to 98.7 % with 16 walks, 16 tables and 5 bits; unrelated windows agree in 2 % and pass at 0.3 %
   at most; windows that share a run of 4 words alone pass at 21 % (16 words), 0.7 % (30) and 0 % (60).
4. Verification. Candidates are aligned exactly (word edit distance to the best stretch around the window).

Items are the stated query set; they are read in blocks of `block_items`, whose index is small whatever the corpus.
Documents are scanned where they are read, in whole, once per block; nothing but hits leaves a task.

Cases: null or empty texts hit nothing, and an item without words is never hit; items under 5 words are found when
exact. Repeated rows and items give repeated hits, one for each pair of rows; of equally near stretches the first counts.
An empty table gives an empty result. Other columns, whatever their names, are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellspan.llm.common import _LOWER, documents, mix, pieces, released, shingle_hashes, text_bytes, words_of

_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def plain(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes without ASCII punctuation, lower-cased, and the rows' new offsets."""
    keep = ~_PUNCTUATION[buf]
    before = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(keep, out=before[1:])
    return _LOWER[buf[keep]], before[offsets]


def most_edits(n: int, share: float) -> int:
    return int(n * share + 1e-9)


def run_length(n: int, share: float, most: int = 4) -> int:
    """Words of an unchanged run that any hit has."""
    d = most_edits(n, share)
    return min(most, n, -(-(n - d) // (d + 1)))


class Items:
    """The index of a block of items."""

    def __init__(self, texts: list[str | None], share: float, walks: int, tables: int, bits: int, seed: int):
        buf, off = text_bytes(pa.array(texts, pa.large_string()))
        buf, off = plain(buf, off)
        _, _, row, words = words_of(buf, off)
        first = np.searchsorted(row, np.arange(len(texts) + 1))
        self.words = [words[first[i] : first[i + 1]] for i in range(len(texts))]
        self.n = np.array([len(w) for w in self.words], np.int64)
        self.d = np.array([most_edits(int(n), share) for n in self.n], np.int64)
        self.runs: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        q = np.array([run_length(int(n), share) if n else 0 for n in self.n])
        for k in sorted({int(x) for x in q if x}):
            keys, item, place = [], [], []
            for i in np.flatnonzero(q == k):
                h, _ = shingle_hashes(self.words[i], np.zeros(self.n[i], np.int64), 1, k, short_whole=False)
                keys.append(h), item.append(np.full(len(h), i)), place.append(np.arange(len(h)))
            key, item, place = np.concatenate(keys), np.concatenate(item), np.concatenate(place)
            order = np.argsort(key, kind="stable")
            bitmap = np.zeros(1 << 20, bool)
            bitmap[(key & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            self.runs[k] = key[order], item[order], place[order], bitmap
        rng = np.random.default_rng(seed)
        self.longest = int(self.n.max(initial=0))
        self.coins = rng.integers(0, 1 << 63, (walks, 3 * self.longest), np.uint64)
        self.samples = rng.random((walks, tables, bits))
        self.padded = np.zeros((len(texts), self.longest), np.uint64)
        for i, w in enumerate(self.words):
            self.padded[i, : len(w)] = w
        self.steps = np.zeros((walks, len(texts)), np.int16)  # before the item's end
        for w in range(walks):
            j = np.zeros(len(texts), np.int64)
            for t in range(3 * self.longest):
                inside = j < self.n
                self.steps[w] += inside
                j += inside & self.moves(self.padded[np.arange(len(j)), np.minimum(j, self.longest - 1)], w, t)

    def moves(self, word: np.ndarray, walk: int, step: int) -> np.ndarray:
        return (mix(word ^ self.coins[walk, step]) >> np.uint64(17)) & np.uint64(1) == 1

    def agree(self, flat: np.ndarray, start: np.ndarray, stop: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Whether windows of flat, from start and before stop, fall in one bucket with their items in some table."""
        found = np.zeros(len(start), bool)
        for w in range(len(self.coins)):
            todo = np.flatnonzero(~found)
            if not len(todo):
                break
            of, nn = item[todo], self.n[item[todo]]
            at, end = start[todo], np.minimum(stop[todo], start[todo] + nn)
            j, steps = np.zeros(len(todo), np.int64), self.steps[w, of].astype(np.int64)
            same = np.zeros((len(todo), int(steps.max(initial=0))), bool)
            for t in range(same.shape[1]):
                a = flat[np.minimum(at, len(flat) - 1)]
                b = self.padded[of, np.minimum(j, self.longest - 1)]
                same[:, t] = (a == b) & (at < end)
                at = at + self.moves(a, w, t)
                j += self.moves(b, w, t)
            sampled = (self.samples[w][None] * steps[:, None, None]).astype(np.int64)
            found[todo] = same[np.arange(len(todo))[:, None, None], sampled].all(axis=2).any(axis=1)
        return found


def stretch_distance(item: np.ndarray, text: np.ndarray) -> int:
    """Word edits between item and the nearest stretch of text."""
    row, at = np.zeros(len(text) + 1, np.int64), np.arange(len(text) + 1)
    for k, w in enumerate(item, 1):
        best = np.minimum(row[1:] + 1, row[:-1] + (text != w))
        row = np.minimum.accumulate(np.concatenate([[k], best]) - at) + at
    return int(row.min())


def hits_in(items: Items, words: np.ndarray, row: np.ndarray, n_rows: int, shifts: int) -> list[tuple[int, int, int, int]]:
    """(row, item, edits, first word of the window) of each hit row and item."""
    if not len(words):
        return []
    first = np.searchsorted(row, np.arange(n_rows + 1))
    cand: list[np.ndarray] = []
    for k, (key, item, place, bitmap) in items.runs.items():
        h, r = shingle_hashes(words, row, n_rows, k, short_whole=False)
        valid = np.zeros(len(words), bool)
        left = max(0, len(words) - k + 1)
        valid[:left] = row[k - 1 :] == row[:left]
        pos = np.flatnonzero(valid)
        maybe = np.flatnonzero(bitmap[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
        lo, hi = np.searchsorted(key, h[maybe], "left"), np.searchsorted(key, h[maybe], "right")
        m = hi - lo
        maybe, lo, m = maybe[m > 0], lo[m > 0], m[m > 0]
        if not len(maybe):
            continue
        which = np.repeat(np.arange(len(maybe)), m)
        entry = lo[which] + np.arange(len(which)) - np.repeat(np.cumsum(m) - m, m)
        at = pos[maybe][which] - place[entry]
        for s in range(-shifts, shifts + 1):
            cand.append(np.stack([r[maybe][which], item[entry], np.clip(at + s, first[r[maybe][which]], first[r[maybe][which] + 1] - 1)], axis=1))
    if not cand:
        return []
    c = np.unique(np.concatenate(cand), axis=0)
    c = c[np.argsort(items.n[c[:, 1]], kind="stable")]  # windows of a size walk together
    out: dict[tuple[int, int], tuple[int, int]] = {}
    end = first[c[:, 0] + 1]
    for a in range(0, len(c), 4096):
        part, stop = c[a : a + 4096], end[a : a + 4096]
        inside = part[:, 2] + items.n[part[:, 1]] <= stop + items.d[part[:, 1]]
        part, stop = part[inside], stop[inside]
        if not len(part):
            continue
        for r, i, s in part[items.agree(words, part[:, 2], stop, part[:, 1])].tolist():
            lo, hi = max(first[r], s - int(items.d[i])), min(first[r + 1], s + int(items.n[i] + items.d[i]))
            dist = stretch_distance(items.words[i], words[lo:hi])
            if dist <= items.d[i] and ((r, i) not in out or (dist, s) < out[r, i]):
                out[r, i] = (dist, s)
    return [(r, i, dist, s - int(first[r])) for (r, i), (dist, s) in sorted(out.items())]


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    share: float = 0.2, walks: int = 16, tables: int = 16, bits: int = 5, shifts: int = 1, seed: int = 5, block_items: int = 20_000,
) -> DataFrame:
    """doc id, item id, edits and at (the first word of the window) of each hit."""
    n_items = benchmark.count()
    blocks = max(1, -(-n_items // block_items))
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, `{item_col}` {benchmark.schema[item_col].dataType.simpleString()}, edits int, at long"
    out = None
    for b in range(blocks):
        own = benchmark.select(item_col, item_text_col)
        if blocks > 1:
            own = own.where(F.pmod(F.xxhash64(item_col, item_text_col), F.lit(blocks)) == b)
        rows = own.collect()
        ids, texts = [r[0] for r in rows], [r[1] for r in rows]

        def run(batches: Iterator[pa.RecordBatch], ids: list = ids, texts: list = texts) -> Iterator[pa.RecordBatch]:
            items = Items(texts, share, walks, tables, bits, seed)
            for batch in released(batches):
                buf, off = text_bytes(batch.column(1))
                found = []
                for i, j in pieces(off):
                    part, o = plain(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                    _, _, row, words = words_of(part, o)
                    found += [(i + r, *rest) for r, *rest in hits_in(items, words, row, j - i, shifts)]
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array([f[0] for f in found], pa.int64())),
                            pa.array([ids[f[1]] for f in found]),
                            pa.array([f[2] for f in found], pa.int32()),
                            pa.array([f[3] for f in found], pa.int64()),
                        ],
                        names=[id_col, item_col, "edits", "at"],
                    )

        part = slim.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))

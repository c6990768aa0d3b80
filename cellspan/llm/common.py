"""What the corpus operators share: reading, cutting lineage, and byte-level text kernels."""

from __future__ import annotations

import atexit
import ctypes
import hashlib
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that end a word, as a Java, DuckDB and Python regular-expression class.
SPACE_CLASS = r"\x20\x09-\x0D"
WORD_SPLIT = r"[ \t-\r]+"

_fallback: dict[str, str] = {}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where that is unset (tests).

    Off a local master there is no such local folder, so there the setting is asked for.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "dir" not in _fallback:
        _fallback["dir"] = tempfile.mkdtemp(prefix="cellspan-")
        atexit.register(shutil.rmtree, _fallback["dir"], ignore_errors=True)
    return f"file://{_fallback['dir']}"


def _on_disk(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and lost executors cost no recomputation.

    The files go with discard(), or when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cellspan-{uuid.uuid4().hex}"
    df.write.parquet(path)
    store, hadoop = _on_disk(spark, path)
    store.deleteOnExit(hadoop)
    out = spark.read.schema(df.schema).parquet(path)
    out._cellspan_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete the files of cut tables that nothing reads any more."""
    for t in tables:
        if path := getattr(t, "_cellspan_path", None):
            store, hadoop = _on_disk(t.sparkSession, path)
            store.delete(hadoop, True)


def _file_scan(docs: DataFrame) -> bool:
    """Whether docs is a deterministic projection or selection of Parquet files."""
    plan = docs._jdf.queryExecution().analyzed()
    if not plan.deterministic():
        return False
    while plan.getClass().getSimpleName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().apply(0)
    if plan.getClass().getSimpleName() != "LogicalRelation":
        return False
    relation = plan.relation()
    return relation.getClass().getSimpleName() == "HadoopFsRelation" and "Parquet" in relation.fileFormat().getClass().getSimpleName()


def filed(docs: DataFrame) -> DataFrame:
    """docs, cut first if they are no deterministic scan of Parquet files."""
    return docs if _file_scan(docs) else cut(docs)


FILE_BITS, ROW_BITS = 36, 27


def numbered(docs: DataFrame, name: str = "__cs_rid") -> DataFrame:
    """docs with a row number that any scan of the same files gives again, however they are split into tasks.

    It is made of the file's name (36 bits of a digest, with a salt under which the input's files differ) and the row's
    place in the file (27 bits; more rows in a file are an error). docs: as filed() returns them, or selected from that.
    """
    place = docs.metadataColumn("_metadata")
    files = [unquote(re.sub("^([a-z0-9]+):/*", r"\1:", f)) for f in docs.inputFiles()]
    salt = next(s for s in map(str, range(1000)) if len({hashlib.md5((s + f).encode()).hexdigest()[: FILE_BITS // 4] for f in files}) == len(files))
    own = F.concat(F.lit(salt), F.regexp_replace(place["file_path"], "^([a-z0-9]+):/*", "$1:"))
    digest = F.conv(F.substring(F.md5(own), 1, FILE_BITS // 4), 16, 10).cast("long")
    row = F.when(place["row_index"] < 1 << ROW_BITS, place["row_index"]).otherwise(F.raise_error(F.lit("a file has too many rows to number")).cast("long"))
    return docs.select("*", (F.shiftleft(digest, ROW_BITS) + row).alias(name))


def free_name(df: DataFrame, *wanted: str) -> list[str]:
    """Column names starting as wanted that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_array(text: Column) -> Column:
    """Words of a text, an empty array for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_SPLIT), lambda w: w != "")


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """batches; at their end the worker's freed memory goes back to the system, as workers are kept for later tasks."""
    yield from batches
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


# --- byte kernels on Arrow string columns ---------------------------------------------------------------------------

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_powers: dict[str, np.ndarray] = {"p": np.ones(1, np.uint64), "q": np.ones(1, np.uint64)}
_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits (a well-known finalizer)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i modulo 2**64, for i < n."""
    if len(_powers["p"]) < n:
        base = int(_BASE)
        for key, b in (("p", base), ("q", pow(base, -1, 1 << 64))):
            steps = np.full(n, np.uint64(b))
            steps[0] = 1
            _powers[key] = np.cumprod(steps)
    return _powers["p"][:n], _powers["q"][:n]


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    """Sums S with S[j] - S[i] = the polynomial of buf[i:j], times B**i."""
    p, _ = powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * p[: len(buf)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end)."""
    _, q = powers(len(sums))
    return mix((sums[end] - sums[start]) * q[start])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    off = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return buf[off[0] : off[-1]] if len(off) else buf[:0], (off - off[0]) if len(off) else np.zeros(1, np.int64)


def pieces(offsets: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about most bytes each; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words_of(buf: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """start, end, row and hash of each word; offsets are those of the rows in buf."""
    if lower:
        buf = _LOWER[buf]
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(np.uint64)
    inside = np.zeros(len(buf) + 1, bool)
    inside[:-1] = _IS_WORD[buf]
    first = inside[:-1].copy()
    first[1:] &= ~inside[:-2]
    last = inside[:-1] & ~inside[1:]
    edges = offsets[:-1][(offsets[:-1] < len(buf)) & (np.diff(offsets) > 0)]
    first[edges] = inside[edges]
    inner = edges[edges > 0]
    last[inner - 1] = inside[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.searchsorted(offsets, start, "right") - 1
    return start, end, row, span_hashes(prefix_sums(buf), start, end)


def shingle_hashes(words: np.ndarray, row: np.ndarray, n_rows: int, k: int, short_whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles and their rows; a row of fewer words is one shingle if short_whole."""
    m = len(words)
    h = words.copy()
    valid = np.ones(m, bool)
    for d in range(1, k):
        left = max(0, m - d)
        nxt = np.zeros(m, np.uint64)
        nxt[:left] = words[d:]
        same = np.zeros(m, bool)
        same[:left] = row[d:] == row[:left]
        h = mix(h * np.uint64(0xD6E8FEB86659FD93) + nxt)
        valid &= same
    out, rows = h[valid], row[valid]
    if short_whole and m:
        counts = np.bincount(row, minlength=n_rows)
        first = np.zeros(n_rows + 1, np.int64)
        np.cumsum(counts, out=first[1:])
        short = np.flatnonzero((counts > 0) & (counts < k))
        if len(short):
            extra = np.empty(len(short), np.uint64)
            for x, r in enumerate(short):
                v = np.array([counts[r]], np.uint64)
                for at in range(first[r], first[r + 1]):
                    v = mix(v * np.uint64(0xA0761D6478BD642F) + words[at : at + 1])
                extra[x] = v[0]
            out, rows = np.concatenate([out, extra]), np.concatenate([rows, short])
            order = np.argsort(rows, kind="stable")
            out, rows = out[order], rows[order]
    return out, rows

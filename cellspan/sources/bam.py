"""BAM as a Spark data source: spark.dataSource.register(BamSource); spark.read.format("bam").load(path).

Each file is split at BGZF block boundaries. A split begins with the first record that starts in its blocks; it is
found by testing candidate places for a chain of plausible records. Files are opened where tasks run.
"""

from __future__ import annotations

import glob
import os
import struct
import zlib
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Letters of the BAM encoding.
SEQ_LETTERS, CIGAR_LETTERS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
_ARRAY = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


def _block(f, at: int) -> tuple[bytes, int]:
    """The bytes of the block at a file place, and the next block's place."""
    f.seek(at)
    head = f.read(18)
    if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
        return b"", -1
    size = struct.unpack_from("<H", head, 16)[0] + 1
    return zlib.decompress(f.read(size - 18)[:-8], -15), at + size


def _is_block(f, at: int) -> bool:
    f.seek(at)
    head = f.read(18)
    if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04" or head[12:16] != b"BC\x02\x00":
        return False
    f.seek(at + struct.unpack_from("<H", head, 16)[0] + 1)
    nxt = f.read(4)
    return nxt in (b"", b"\x1f\x8b\x08\x04")


def _first_block(f, at: int, size: int) -> int:
    """The place of the first block at or after a file place."""
    while at < size:
        f.seek(at)
        chunk = f.read(1 << 17)
        k = chunk.find(b"\x1f\x8b\x08\x04")
        while k >= 0:
            if _is_block(f, at + k):
                return at + k
            k = chunk.find(b"\x1f\x8b\x08\x04", k + 1)
        at += max(1, len(chunk) - 3)
    return size


def read_header(path: str) -> tuple[str, list[tuple[str, int]], int, int]:
    """Header text, references, and where the records begin: block place and offset."""
    with open(path, "rb") as f:
        data, at, ends = b"", 0, []

        def need(n: int) -> None:
            nonlocal data, at
            while len(data) < n:
                start = at
                more, at = _block(f, at)
                if at < 0:
                    raise ValueError("the header is cut off")
                ends.append((len(data), start))
                data += more

        need(12)
        if data[:4] != b"BAM\x01":
            raise ValueError("not a BAM file")
        n = struct.unpack_from("<i", data, 4)[0]
        need(12 + n)
        text, k = data[8 : 8 + n].decode().rstrip("\0"), 12 + n
        refs = []
        for _ in range(struct.unpack_from("<i", data, 8 + n)[0]):
            need(k + 4)
            m = struct.unpack_from("<i", data, k)[0]
            need(k + 8 + m)
            refs.append((data[k + 4 : k + 3 + m].decode(), struct.unpack_from("<i", data, k + 4 + m)[0]))
            k += 8 + m
        for begin, place in reversed(ends):
            if begin <= k:
                return text, refs, place, k - begin
        return text, refs, 0, k


def _plausible(data: bytes, k: int, n_refs: int) -> int:
    """The record's end if one may begin at k, else -1."""
    if k + 36 > len(data):
        return -1
    size, ref, pos, l_name, _, _, n_cigar, flag, l_seq, mate = struct.unpack_from("<iiiBBHHHii", data, k)
    least = 32 + l_name + 4 * n_cigar + (l_seq + 1) // 2 + l_seq
    if not (l_name >= 2 and l_seq >= 0 and -1 <= ref < n_refs and -1 <= mate < n_refs and pos >= -1 and flag < 1 << 12 and least <= size < 1 << 26):
        return -1
    if k + 36 + l_name <= len(data) and data[k + 35 + l_name] != 0:
        return -1
    return k + 4 + size


def _tags(data: bytes, k: int, end: int) -> list[str]:
    out = []
    while k < end:
        name, kind = data[k : k + 2].decode(), chr(data[k + 2])
        k += 3
        if kind in "ZH":
            stop = data.index(b"\0", k)
            out.append(f"{name}:{kind}:{data[k:stop].decode()}")
            k = stop + 1
        elif kind == "A":
            out.append(f"{name}:A:{chr(data[k])}")
            k += 1
        elif kind == "B":
            sub, n = chr(data[k]), struct.unpack_from("<i", data, k + 1)[0]
            code = f"<{n}{_ARRAY[sub]}"
            out.append(f"{name}:B:{sub}," + ",".join(f"{v:g}" if sub == "f" else str(v) for v in struct.unpack_from(code, data, k + 5)))
            k += 5 + struct.calcsize(code)
        else:
            v = struct.unpack_from("<" + _ARRAY[kind], data, k)[0]
            out.append(f"{name}:f:{v:g}" if kind == "f" else f"{name}:i:{v}")
            k += struct.calcsize("<" + _ARRAY[kind])
    return out


def record(data: bytes, k: int, refs: list[tuple[str, int]]) -> tuple:
    """SAM fields of the record at k."""
    size, ref, pos, l_name, mapq, _, n_cigar, flag, l_seq, mate, pnext, tlen = struct.unpack_from("<iiiBBHHHiiii", data, k)
    at, end = k + 36, k + 4 + size
    name = data[at : at + l_name - 1].decode()
    at += l_name
    cigar = "".join(f"{c >> 4}{CIGAR_LETTERS[c & 15]}" for c in struct.unpack_from(f"<{n_cigar}I", data, at)) or "*"
    at += 4 * n_cigar
    half = data[at : at + (l_seq + 1) // 2]
    seq = "".join(SEQ_LETTERS[b >> 4] + SEQ_LETTERS[b & 15] for b in half)[:l_seq] or "*"
    at += len(half)
    qual = data[at : at + l_seq]
    text = "*" if not l_seq or qual[0] == 255 else "".join(chr(q + 33) for q in qual)
    rname = refs[ref][0] if ref >= 0 else "*"
    rnext = "*" if mate < 0 else "=" if mate == ref else refs[mate][0]
    return (name, flag, rname, pos + 1, mapq, cigar, rnext, pnext + 1, tlen, seq, text, _tags(data, at + l_seq, end))


def files_of(path: str) -> list[str]:
    path = path.removeprefix("file://")
    return sorted(glob.glob(os.path.join(path, "*.bam"))) if os.path.isdir(path) else [path]


def bam_header(path: str) -> str:
    """The header text of a BAM file, or of the first one in a folder."""
    files = files_of(path)
    return read_header(files[0])[0].rstrip("\0") if files else ""


class BamReader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int):
        self.path, self.split = path.removeprefix("file://"), split_bytes

    def partitions(self) -> list[Range]:
        return [Range(f, a, min(a + self.split, size)) for f in files_of(self.path) for size in (os.path.getsize(f),) for a in range(0, size, self.split)]

    def read(self, partition: Range) -> Iterator[tuple]:
        _, refs, first, offset = read_header(partition.path)
        with open(partition.path, "rb") as f:
            size = os.path.getsize(partition.path)
            at = _first_block(f, partition.start, size)
            if at >= partition.end:
                return
            data, base = b"", []  # base: (offset in data, block place)
            k, known = 0, at <= first
            if known:
                at, k = first, offset
                if not partition.start <= first < partition.end:
                    return
            while True:
                start = at
                more, at = _block(f, at) if at < size else (b"", -1)
                if at < 0:
                    break
                base.append((len(data), start))
                data += more
                if not known:
                    if len(data) < 1 << 17 and at < size:
                        continue
                    k = next((p for p in range(len(data)) if self._chain(data, p, len(refs), at >= size)), len(data))
                    known = True
                while k + 4 <= len(data):
                    stop = k + 4 + struct.unpack_from("<i", data, k)[0]
                    place = next(p for b, p in reversed(base) if b <= k)
                    if place >= partition.end:
                        return
                    if stop > len(data):
                        break
                    b = next(b for b, p in base if p == place)
                    yield (place << 16 | (k - b), *record(data, k, refs))
                    k = stop
                # keep what isn't read yet
                drop = next((b for b, _ in reversed(base) if b <= k), 0)
                if drop:
                    data, k, base = data[drop:], k - drop, [(b - drop, p) for b, p in base if b >= drop]

    @staticmethod
    def _chain(data: bytes, k: int, n_refs: int, ended: bool, least: int = 5) -> bool:
        for _ in range(least):
            k = _plausible(data, k, n_refs)
            if k < 0:
                return False
            if k >= len(data) - 36:
                return ended and k == len(data) or not ended
        return True


class BamSource(DataSource):
    """Options: split_bytes (64 MB)."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return "rec_id long, qname string, flag int, rname string, pos int, mapq int, cigar string, rnext string, pnext int, tlen int, seq string, qual string, tags array<string>"

    def reader(self, schema) -> BamReader:
        return BamReader(self.options["path"], int(self.options.get("split_bytes", 64 << 20)))

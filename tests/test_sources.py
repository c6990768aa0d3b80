from __future__ import annotations

import gzip
import random
import struct
import zlib

from pyspark.sql import functions as F

from cellspan.functions.session import observed
from cellspan.sources import text as S
from cellspan.plans.programs import match_barcodes
from cellspan.sources.bam import BamSource, read_header

SAM = "@HD\tVN:1.6\n@SQ\tSN:c\tLN:1000\n@SQ\tSN:d\tLN:500\nq1\t99\tc\t1\t60\t10M\t=\t91\t100\tACGTACGTAC\tIIIIIIIIII\tCB:Z:AA\tNM:i:0\nq2\t4\t*\t0\t0\t*\t*\t0\t0\tAC\tII\n"


def test_sam_round_trip(spark, tmp_path):
    (tmp_path / "a.sam").write_text(SAM)
    path = str(tmp_path / "a.sam")
    reads, header = S.read_sam(spark, path), S.read_sam_header(spark, path)
    assert [(r.qname, r.tags) for r in reads.orderBy("rec_id").collect()] == [("q1", ["CB:Z:AA", "NM:i:0"]), ("q2", [])]
    assert [tuple(r) for r in S.reference_lengths(header).orderBy("ref_idx").collect()] == [(0, "c", 1000), (1, "d", 500)]
    S.write_sam(reads, header, str(tmp_path / "out"))
    parts = sorted((tmp_path / "out").glob("part-*"))
    assert "".join(p.read_text() for p in parts) == SAM


def test_fastq_round_trip(spark, tmp_path):
    text = "@a x\nACGT\n+\n@III\n@b\nAC\n+\nI@\n@c\nA\n+\n@\n"
    (tmp_path / "a.fastq").write_text(text)
    reads = S.read_fastq(spark, str(tmp_path / "a.fastq"))
    assert [tuple(r) for r in reads.orderBy("rec_id").collect()] == [(0, "@a x", "ACGT", "@III"), (1, "@b", "AC", "I@"), (2, "@c", "A", "@")]
    S.write_fastq(reads, str(tmp_path / "out"))
    assert "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*"))) == text


def test_lists_bed_gtf_mtx(spark, tmp_path):
    (tmp_path / "l").write_text("AA\t5\n\nBB\nAA\n")
    assert [r.barcode for r in S.read_list(spark, str(tmp_path / "l")).orderBy("line").collect()] == ["AA", "BB"]
    (tmp_path / "b").write_text("c\t1\t5\tn\t0\t-\n")
    assert tuple(S.read_bed(spark, str(tmp_path / "b")).first()) == ("c", 1, 5, "n", "0", "-")
    (tmp_path / "g").write_text('#x\nc\ts\tCDS\t11\t20\t.\t+\t0\tgene_id "G1"; gene_type "protein_coding";\nc\ts\tgene\t1\t99\t.\t+\t.\tgene_id "L"; gene_biotype "lncRNA";\n')
    gtf = S.read_gtf(spark, str(tmp_path / "g"))
    assert sorted(map(tuple, S.gene_classes(gtf).collect())) == [("c", 0, 99, "lncRNA"), ("c", 10, 20, "pc_cds")]
    (tmp_path / "m").write_text("%%MatrixMarket\n2 2 2\n1 2 7\n2 1 3\n")
    (tmp_path / "f").write_text("g1\ng2\n")
    (tmp_path / "c").write_text("A\nB\n")
    assert sorted(map(tuple, S.read_mtx(spark, *(str(tmp_path / x) for x in "mcf")).collect())) == [("g1", "B", 7), ("g2", "A", 3)]


def bgzf(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def bam_record(name, pos, seq, tag):
    n = len(seq)
    packed = bytes(("=ACMGRSVTWYHKDBN".index(a) << 4) | "=ACMGRSVTWYHKDBN".index(b) for a, b in zip(seq[::2], (seq + "=")[1::2]))
    body = struct.pack("<iiBBHHHiiii", 0, pos - 1, len(name) + 1, 60, 0, 1, 99, n, 0, pos, 100) + name.encode() + b"\0" + struct.pack("<I", n << 4) + packed + bytes([40] * n) + b"CBZ" + tag.encode() + b"\0NMC\x03"
    return struct.pack("<i", len(body)) + body


def test_bam_in_splits(spark, tmp_path):
    rng = random.Random(3)
    want = [(f"read{i}", 1 + rng.randrange(900), "".join(rng.choice("ACGT") for _ in range(rng.randrange(30, 90))), f"B{i}") for i in range(6000)]
    text = b"@SQ\tSN:c\tLN:1000\n"
    data = b"BAM\x01" + struct.pack("<i", len(text)) + text + struct.pack("<i", 1) + struct.pack("<i", 2) + b"c\0" + struct.pack("<i", 1000) + b"".join(bam_record(*w) for w in want)
    blocks = [bgzf(data[i : i + 30000]) for i in range(0, len(data), 30000)] + [bgzf(b"")]
    (tmp_path / "a.bam").write_bytes(b"".join(blocks))
    assert read_header(str(tmp_path / "a.bam"))[:2] == (text.decode(), [("c", 1000)])
    spark.dataSource.register(BamSource)
    for split in (1 << 30, 40_000):
        got = spark.read.format("bam").option("split_bytes", split).load(str(tmp_path / "a.bam")).orderBy("rec_id").collect()
        assert [(r.qname, r.pos, r.seq, r.tags[0][5:]) for r in got] == want
    assert (got[0].cigar, got[0].tags[1], got[0].qual[:2], got[0].rnext) == (f"{len(want[0][2])}M", "NM:i:3", "II", "=")
    put = lambda n, t: (tmp_path / n).write_text(t) and str(tmp_path / n)
    match_barcodes(spark, str(tmp_path / "a.bam"), put("at", "B17\n"), put("gx", "GG\n"), str(tmp_path / "out"), tag="CB")
    rows = [x for p in sorted((tmp_path / "out").glob("part-*")) for x in p.read_text().splitlines()]
    assert rows[0] == text.decode().strip() and [x.split("\t")[0] for x in rows[1:]] == ["read17"]


def test_fastq_of_many_splits(spark, tmp_path):
    want = []
    for n, name in enumerate(("a.fq", "b.fq.gz")):
        reads = [(f"@r{n}_{i} x", "ACGT" * (i % 5 + 1), "@+I@" * (i % 5 + 1)) for i in range(60)]
        text = "".join(f"{a}\n{b}\n+\n{c}\n" for a, b, c in reads) + ("@cut\nAC\n" if n else "")
        (tmp_path / name).write_bytes(gzip.compress(text.encode()) if n else text.encode())
        want += reads
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        got = [tuple(r) for r in S.read_fastq(spark, str(tmp_path)).orderBy("rec_id").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [(i, *r) for i, r in enumerate(want)]


def test_fragment_table_and_counts(spark, tmp_path):
    rows = [("c2", 5, 9, "A", 1), ("c1", 7, 9, "B", 2), ("c1", 2, 4, "A", 1)]
    df, seen = observed(spark.createDataFrame(rows, "chrom string, start long, end long, barcode string, count long"), "fragments", twice=F.col("count") > 1)
    S.write_fragments(df, str(tmp_path / "f"))
    S.write_fragment_table(df, str(tmp_path / "t"))
    assert (seen.get["rows"], seen.get["twice"]) == (3, 1)
    back = spark.read.parquet(str(tmp_path / "t")).select("chrom", "start", "end", "barcode", "count")
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    assert {p.name for p in (tmp_path / "t").iterdir() if p.is_dir()} == {"chrom=c1", "chrom=c2"}


def test_sam_compressed(spark, tmp_path):
    (tmp_path / "a.sam").write_text(SAM)
    reads, header = S.read_sam(spark, str(tmp_path / "a.sam")), S.read_sam_header(spark, str(tmp_path / "a.sam"))
    S.write_sam(reads, header, str(tmp_path / "out"), "gzip")
    parts = sorted((tmp_path / "out").glob("part-*.gz"))
    assert "".join(gzip.decompress(p.read_bytes()).decode() for p in parts) == SAM
    assert sorted(r.qname for r in S.read_sam(spark, str(tmp_path / "out")).collect()) == ["q1", "q2"]

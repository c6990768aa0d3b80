from __future__ import annotations

from cellspan.plans import programs as M

READS = [("y", "AA", 1), ("y", "BB", 201), ("z", "AA", 401)]
SAM = "@SQ\tSN:c\tLN:1000\n" + "".join(
    f"i:n:f:l:t:x:{y}:{b}\t{f}\tc\t{p}\t60\t10M\t=\t{q}\t{t}\t*\t*\tCB:Z:{b}\n"
    for y, b, s in READS
    for f, p, q, t in ((99, s, s + 90, 100), (147, s + 90, s, -100))
)


def lines(path):
    return [x for p in sorted(path.glob("part-*")) for x in p.read_text().splitlines()]


def test_files(spark, tmp_path):
    put = lambda n, t: (tmp_path / n).write_text(t) and str(tmp_path / n)
    sam, listed, bed = put("a.sam", SAM), put("l", "AA\nBB\nCC\n"), put("r.bed", "c\t50\t60\tr1\nc\t250\t260\tr2\n")
    out = lambda n: str(tmp_path / n)
    M.fragments_table(spark, sam, out("f"))
    assert sorted(lines(tmp_path / "f")) == ["c\t204\t295\tBB\t1", "c\t4\t95\tAA\t1", "c\t404\t495\tAA\t1"]
    M.count_barcodes(spark, sam, out("c"), least=1)
    assert lines(tmp_path / "c") == ["AA\t2", "BB\t1"]
    M.count_matrix(spark, sam, listed, bed, out("m"))
    assert [x for x in lines(tmp_path / "m") if x[0] == "r"] == ["r1\t1\t0\t0", "r2\t0\t1\t0"]
    M.region_shares(spark, sam, listed, bed, out("i"))
    assert lines(tmp_path / "i") == ["AA\t2\t1", "BB\t1\t1", "CC\t0\t0"]
    M.filter_by_barcode(spark, sam, put("one", "BB\n"), out("b"))
    assert lines(tmp_path / "b") == [x for x in SAM.splitlines() if x[0] == "@" or "BB" in x]
    M.match_barcodes(spark, put("t.tsv", "k,AA\nk,ZZ\n"), put("at", "AA\n"), put("gx", "GG\n"), out("k"), delimiter=",", field=1)
    assert lines(tmp_path / "k") == ["k,GG"]
    M.fragment_depth(spark, sam, listed, out("d"))
    assert [x for x in lines(tmp_path / "d") if x[:2] == "c\t"] == ["c\t0\t100\t1\t0\t0", "c\t200\t300\t0\t1\t0", "c\t400\t500\t1\t0\t0"]

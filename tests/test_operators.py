from __future__ import annotations

import pytest

from cellspan.operators import cells as C
from cellspan.operators import fragments as G
from cellspan.operators import post as P
from cellspan.operators import regions as R
from cellspan.sources import text as S

HEAD = "i:n:f:l:t:x:y:"


def read(rec, name, flag, pos, cigar="10M", mapq=60, rname="c", tags=(), seq="*"):
    return (rec, name, flag, rname, pos, mapq, cigar, "=", 0, 0, seq, "*", list(tags))


@pytest.fixture(scope="module")
def alignments(spark):
    return spark.createDataFrame(
        [
            read(0, HEAD + "AA", 99, 1), read(1, HEAD + "AA", 147, 91),  # [0, 100)
            read(2, HEAD + "AA", 99 + 1024, 1),  # a duplicate without its mate
            read(3, HEAD + "BB", 99, 101, "5S10M", tags=["CB:Z:QQ"]), read(4, HEAD + "BB", 147, 191, "5M2D3M", mapq=5),
            read(5, "short:name", 99, 5), read(6, "short:name", 147, 50),
            read(7, HEAD + "ZZ", 99, 1, rname="d"), read(8, HEAD + "ZZ", 147, 31, rname="d"),
        ],
        S.ALIGNMENT_SCHEMA,
    )


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def listed(spark, *names):
    return frame(spark, [(n,) for n in names], "barcode string")


def test_pairs(alignments):
    got = sorted((r.qname[-2:], r.chrom, r.start, r.end, r.barcode) for r in G.pairs(alignments).collect())
    assert got == [("AA", "c", 0, 100, "AA"), ("BB", "c", 100, 200, "BB"), ("ZZ", "d", 0, 40, "ZZ"), ("me", "c", 4, 59, None)]
    assert {r.qname[-2:] for r in G.pairs(alignments, min_mapq=10).collect()} == {"AA", "ZZ", "me"}  # a low mate drops the pair
    assert {r.barcode for r in G.pairs(alignments, tag="CB").collect()} == {None, "QQ"}


def test_fragments_and_counts(spark, alignments):
    pairs = G.pairs(alignments)
    got = sorted(map(tuple, G.fragments_file(pairs, barcodes=listed(spark, "AA", "NO", "")).collect()))
    assert got == [("c", 4, 95, "AA", 1)]
    assert len(G.fragments_file(pairs).collect()) == 3
    assert [tuple(r) for r in G.barcode_counts(pairs, least=1).collect()] == [("AA", 1), ("BB", 1), ("ZZ", 1)]
    assert [r.barcode for r in G.barcode_counts(pairs, least=1, whitelist=listed(spark, "TT"), reverse=True).collect()] == ["AA"]


def test_flagstat(spark, alignments):
    row = {r.barcode: r for r in C.flagstat(alignments, listed(spark, "AA", "NO")).collect()}
    assert (row["AA"].total, row["AA"].read_1, row["AA"].read_2, row["AA"].duplicates) == (3, 2, 1, 1)
    assert row["NO"].total == 0
    compat = {r.barcode: r for r in C.flagstat(alignments, listed(spark, "AA"), compat=True).collect()}
    assert compat["AA"].read_2 == 2


def pairs_of(spark, *items):
    return frame(spark, [(f"q{i}", "c", s, e, b, e - s) for i, (s, e, b) in enumerate(items)], "qname string, chrom string, start long, end long, barcode string, length long")


def test_region_counts(spark):
    pairs = pairs_of(spark, (0, 10, "A"), (5, 25, "A"), (12, 14, "A"), (0, 2000, "A"))
    regions = frame(spark, [("c", 0, 8, "r1"), ("c", 20, 30, "r2")], "chrom string, start long, end long, name string")
    assert sorted(map(tuple, R.region_counts(pairs, regions).collect())) == [("r1", "A", 1)]  # two names or none: uncounted; too long: out
    assert [tuple(r) for r in R.in_region(pairs, regions, listed(spark, "A", "B")).orderBy("barcode").collect()] == [("A", 4, 3), ("B", 0, 0)]
    with pytest.raises(ValueError):
        R.unique_names(regions.unionAll(regions))
    assert [tuple(r)[1:3] for r in R.flanked(regions, 5).orderBy("start").collect()] == [(0, 13), (15, 35)]


def test_tss_mirror(spark):
    pairs = pairs_of(spark, (100, 103, "A"))
    for strand, want in (("+", [48, 49, 50]), ("-", [50, 51, 52])):
        tss = frame(spark, [("c", 102, 103, "t", strand)], "chrom string, start long, end long, name string, strand string")
        got = [r.offset for r in R.tss_counts(pairs, tss, listed(spark, "A"), flank=50).where("n > 0").orderBy("offset").collect()]
        assert got == want
    with pytest.raises(ValueError):
        R.tss_counts(pairs, tss, listed(spark, "A"), flank=49)


def test_metagene_bins(spark):
    blocks = frame(spark, [("c", 0, 4, "F", "-"), ("c", 10, 16, "F", "-")], "chrom string, start long, end long, feature string, strand string")
    got = sorted((r.start, r.end, r.bin) for r in R.feature_bins(blocks, 5).collect())
    assert got == [(0, 2, 4), (2, 4, 3), (10, 12, 2), (12, 14, 1), (14, 16, 0)]


def test_first_seen_and_mismatch_order(spark, alignments):
    tagged = frame(spark, [read(i, "n", 0, p, tags=["UB:Z:u"]) + ("A",) for i, p in ((3, 9), (1, 7), (2, 8))], "rec_id long, qname string, flag int, rname string, pos int, mapq int, cigar string, rnext string, pnext int, tlen int, seq string, qual string, tags array<string>, barcode string")
    assert [r.pos for r in G.first_seen(tagged, "UB").collect()] == [7]
    counts = frame(spark, [("A", "c", 1, b, 2) for b in "CGTA"] + [("A", "c", 2, "N", 2)], "barcode string, chrom string, site long, base string, n long")
    depth = frame(spark, [("A", "c", 1, 8), ("A", "c", 2, 2)], "barcode string, chrom string, site long, depth long")
    assert [tuple(r) for r in C.mismatch_sites(counts, depth).collect()] == [("A", "c", 1, "A", 0.25)]


def test_mismatches_from_x_and_md(spark):
    reads = frame(spark, [read(0, "n", 0, 1, "2=1X2=", seq="ACGTA", tags=["CB:Z:K"]), read(1, "n", 0, 11, "5M", seq="ACGTA", tags=["CB:Z:K", "MD:Z:1A3"])], S.ALIGNMENT_SCHEMA)
    hit, sites = C.mismatches(reads)
    assert sorted((r.site, r.base) for r in hit.collect()) == [(2, "G"), (11, "C")]
    assert sites.count() == 10


def test_match_and_tag(spark, alignments):
    table = G.translation(frame(spark, [(0, "AA"), (1, "BB"), (2, "AA")], "line long, barcode string"), frame(spark, [(0, "x"), (1, "y"), (2, "z")], "line long, barcode string"))
    got = sorted({r.qname.split(":")[7] for r in G.match_field(alignments, "qname", table, ":", 7, "-1").collect()})
    assert got == ["y-1", "z-1"]  # the last of repeated ATAC barcodes, others dropped
    assert [r.tags for r in G.name_to_tag(alignments.where("rec_id = 0"), suffix="-1").collect()] == [["CB:Z:AA-1"]]


def test_fastq_names(spark):
    reads = frame(spark, [(0, "@a b", "AC", "II"), (1, "@a", "AC", "II")], "rec_id long, name string, seq string, qual string")
    codes = frame(spark, [(0, "@x", "ACGT", "IIII"), (1, "@x", "ACGT", "IIII")], "rec_id long, name string, seq string, qual string")
    names = lambda **k: [r.name for r in P.fastq_with_barcode(reads, codes, **k).orderBy("rec_id").collect()]
    assert names(column=0, first=1) == ["@a:CGT  b", "@a:CGT "]
    assert names(column=1, split=1) == ["@b:A+CGT a "]


def test_bins_follow_from_offsets(spark):
    """Bins of fragments and reads against every base; the blocks' side is never multiplied by the bins."""
    spans = [("F", 0, 4, "-"), ("F", 10, 16, "-"), ("G", 20, 23, "+"), ("G", 40, 90_000, "+"), ("H", 5, 7, "+")]
    blocks = frame(spark, [("c", s, e, f, d) for f, s, e, d in spans], "chrom string, start long, end long, feature string, strand string")
    pairs = pairs_of(spark, (0, 12, "A"), (3, 60, "A"), (22, 900, "B"), (89_990, 90_010, "B"))
    groups = frame(spark, [("A", "g"), ("B", "h")], "barcode string, `group` string")
    bins, want, first = 7, {}, {}
    for f, strand in (("F", "-"), ("G", "+"), ("H", "+")):
        bases = [b for n, s, e, _ in spans if n == f for b in range(s, e)]
        for o, b in enumerate(bases):
            k = (len(bases) - 1 - o if strand == "-" else o) * bins // len(bases)
            for s, e, g in ((0, 12, "g"), (3, 60, "g"), (22, 900, "h"), (89_990, 90_010, "h")):
                if s <= b < e:
                    want[g, f, k] = want.get((g, f, k), 0) + 1
                if s == b:
                    first[{"g": "A", "h": "B"}[g], k] = first.get(({"g": "A", "h": "B"}[g], k), 0) + 1
    counts = R.metagene(pairs, groups, blocks, bins)
    assert {(r.group, r.feature, r.bin): r.bases for r in counts.collect()} == want
    filled = R.metagene_filled(counts, groups, blocks, bins).collect()
    assert len(filled) == 2 * 3 * bins and {(r.group, r.feature, r.bin): r.bases for r in filled if r.bases} == want
    reads = pairs.selectExpr("barcode", "chrom AS rname", "cast(start + 1 AS int) AS pos")
    got = R.genebody(reads, blocks, listed(spark, "A", "B"), bins)
    assert {(r.barcode, r.bin): r.n for r in got.collect() if r.n} == first
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in (counts, got)]
    assert [p.split("Join Inner, (")[-1].count("explode(sequence(0") for p in plans] == [0, 0]


def test_metagene_profile_without_windows_over_features(spark):
    counts = frame(spark, [("g", "F", 0, 2), ("g", "F", 1, 2), ("g", "G", 0, 4), ("h", "G", 1, 5)], "`group` string, feature string, bin int, bases long")
    got = lambda **k: sorted((r.group, r.bin, round(r.bpm, 6)) for r in P.metagene_profile(counts, **k).collect())
    assert got() == [("g", 0, 375000.0), ("g", 1, 250000.0), ("h", 1, 1000000.0)]
    assert got(features=frame(spark, [("F",)], "feature string")) == [("g", 0, 250000.0), ("g", 1, 250000.0)]
    plan = P.metagene_profile(counts)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.index("Aggregate")


def test_mismatches_stay_with_their_read(spark):
    """Two reads of one rec_id keep their own MD sites; nothing is joined, and only mismatches are laid out."""
    rows = [read(7, "n", 0, 1, "3M1D2M", seq="ACGTA", tags=["CB:Z:K", "MD:Z:1A1^T0C1"]), read(7, "m", 0, 3, "5M", seq="CCCCC", tags=["CB:Z:L", "MD:Z:0A4"]), read(8, "o", 0, 1, "1X0M1=", seq="TA", tags=["CB:Z:L", "MD:Z:0A1"])]
    hit, sites = C.mismatches(frame(spark, rows, S.ALIGNMENT_SCHEMA))
    assert sorted((r.barcode, r.site, r.base) for r in hit.collect()) == [("K", 1, "C"), ("K", 4, "T"), ("L", 0, "T"), ("L", 2, "C")]
    assert sites.count() == 12
    assert "Join" not in hit._jdf.queryExecution().optimizedPlan().toString()


def test_atac_composition_in_one_pass(spark):
    """Pieces of one class count a fragment once, over bins too; fragments outside are intergenic; the pairs are read once."""
    pairs = pairs_of(spark, (0, 100, "A"), (4000, 4200, "A"), (500, 600, "A"), (-1, 9, "B"), (0, 10, "N"))
    classes = frame(spark, [("c", 10, 20, "x"), ("c", 30, 35, "x"), ("c", 15, 40, "y"), ("c", 4090, 4100, "x")], "chrom string, start long, end long, class string")
    out = C.atac_composition(pairs, classes, listed(spark, "A", "B", "C"))
    got = sorted(map(tuple, out.collect()))
    assert got == [("A", "intergenic", 1, 100.0, 100, 3), ("A", "x", 2, 150.0, 25, 3), ("A", "y", 1, 100.0, 25, 3), ("B", "intergenic", 1, 10.0, 10, 1)]
    assert sorted(map(tuple, C.atac_features(pairs, classes, listed(spark, "A", "B", "C")).collect())) == [r[:5] for r in got]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD [qname") == 1


def test_peaks_read_pairs_by_one_plan(spark):
    pairs = pairs_of(spark, (0, 10, "A"), (5, 25, "A"), (5, 25, "B"), (50, 60, "B"))
    peaks = frame(spark, [("c", 0, 8, "p"), ("c", 20, 30, "q")], "chrom string, start long, end long, name string")
    out = R.any_overlap_counts(pairs, peaks, least_cells=2, least_peaks=2)
    assert sorted(map(tuple, out.select("name", "barcode", "n").collect())) == [("p", "A", 2), ("p", "B", 1), ("q", "A", 1), ("q", "B", 1)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD [qname") == 3
    assert R.any_overlap_counts(pairs, peaks, least_fragments=3).count() == 0


def test_tss_grid_is_laid_after_the_join(spark):
    tss = frame(spark, [("c", 102, 103, "t", "+")], "chrom string, start long, end long, name string, strand string")
    out = R.tss_enrichment(R.tss_counts(pairs_of(spark, (100, 103, "A")), tss, listed(spark, "A", "B"), flank=50), 50, 10)
    assert out.count() == 2 * 101 and out.where("enrichment <> 0").count() == 0
    joins = [x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x]
    assert not any("offset" in x for x in joins) and sum("Inner" in x for x in joins) == 1

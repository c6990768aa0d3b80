"""File to file: one function for each task, from alignment files and lists to text tables.

Inputs are SAM or BAM (by suffix), BED, GTF and plain lists; outputs are folders of text part files in order. Options
are named for their meaning, so no letter means two things. Wide tables have a column for each listed barcode (the list
comes to the driver for that) and are made only here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellspan.functions import alignment as A
from cellspan.functions.intervals import joint_coverage
from cellspan.operators import cells as C
from cellspan.operators import fragments as G
from cellspan.operators import post as P
from cellspan.operators import regions as R
from cellspan.sources import text as S
from cellspan.sources.bam import BamSource, bam_header

ATAC = {"min_mapq": 0, "require": A.ATAC_REQUIRE, "exclude": A.ATAC_EXCLUDE}
GEX = {"min_mapq": 0, "require": A.GEX_REQUIRE, "exclude": A.GEX_EXCLUDE}
NAME = {"tag": None, "delimiter": A.NAME_DELIMITER, "field": A.NAME_FIELD}


def read_alignments(spark: SparkSession, path: str) -> DataFrame:
    if path.endswith(".bam"):
        spark.dataSource.register(BamSource)
        return spark.read.format("bam").load(path)
    return S.read_sam(spark, path)


def read_header_lines(spark: SparkSession, path: str) -> DataFrame:
    """rec_id and line of the header of SAM or BAM alignments; of a folder of BAM files, the first one's."""
    if path.endswith(".bam"):
        lines = bam_header(path).splitlines()
        return spark.createDataFrame(list(enumerate(lines)), "rec_id long, line string")
    return S.read_sam_header(spark, path)


def _pairs(spark: SparkSession, path: str, qc: dict, barcode: dict) -> DataFrame:
    return G.pairs(read_alignments(spark, path), **{**ATAC, **qc}, **{**NAME, **barcode})


def _table(df: DataFrame, path: str, header: bool = True) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", header=header, nullValue="")


def _names(listed: DataFrame, column: str = "barcode") -> list[str]:
    return [r[0] for r in listed.orderBy("line").select(column).collect()]


def _wide(long: DataFrame, row: list[str], value: str, columns: list[str], path: str, by: str = "barcode", fill: object = 0) -> None:
    wide = long.groupBy(*row).pivot(by, columns).agg(F.first(value))
    wide = wide.na.fill(fill) if fill is not None else wide
    _table(wide.orderBy(*row), path)


def barcode_fastq(spark: SparkSession, reads: str, barcodes: str, out: str, mates: str | None = None, column: int = 0, first: int = 0, split: int = 0, joiner: str = "+") -> None:
    """FASTQ with the barcode in the read names; of mates too."""
    codes = S.read_fastq(spark, barcodes)
    for n, path in enumerate([reads, *([mates] if mates else [])], 1):
        S.write_fastq(P.fastq_with_barcode(S.read_fastq(spark, path), codes, column, first, split, joiner), f"{out}_{n}" if mates else out)


def count_barcodes(spark: SparkSession, alignments: str, out: str, least: int = 1000, whitelist: str | None = None, reverse: bool = False, qc: dict = {}, barcode: dict = {}) -> None:  # noqa: B006
    white = S.read_list(spark, whitelist) if whitelist else None
    _table(G.barcode_counts(_pairs(spark, alignments, qc, barcode), least, white, reverse), out, header=False)


def base_depth(spark: SparkSession, alignments: str, barcodes: str, out: str, qc: dict = {}, tag: str | None = None) -> None:  # noqa: B006
    """Depth of aligned bases: a column for each barcode, rows cut wherever a depth changes."""
    listed = S.read_list(spark, barcodes)
    used = G.only_listed(read_alignments(spark, alignments).where(A.passes_qc(**{**ATAC, **qc})).withColumn("barcode", A.barcode(tag)), listed)
    blocks = used.select("barcode", F.col("rname").alias("chrom"), F.explode(A.aligned_blocks(F.col("pos"), F.col("cigar"))).alias("b"))
    _wide(joint_coverage(blocks.select("chrom", "barcode", "b.start", "b.end"), "barcode"), ["chrom", "start", "end"], "depth", _names(listed), out)


def fragment_depth(spark: SparkSession, alignments: str, barcodes: str, out: str, qc: dict = {}, barcode: dict = {}) -> None:  # noqa: B006
    listed = S.read_list(spark, barcodes)
    used = G.only_listed(_pairs(spark, alignments, qc, barcode), listed)
    _wide(joint_coverage(used.select("chrom", "barcode", "start", "end"), "barcode"), ["chrom", "start", "end"], "depth", _names(listed), out)


def atac_composition(spark: SparkSession, alignments: str, barcodes: str, gtf: str, out: str, tsr: str | None = None, enhancers: str | None = None, least: int = 0, most: int | None = None, qc: dict = {}, barcode: dict = {}) -> None:  # noqa: B006
    """Fragments, mean lengths and bases by class: out_counts, out_lengths, out_bases."""
    listed = S.read_list(spark, barcodes)
    classes = S.gene_classes(S.read_gtf(spark, gtf))
    for path, name in ((tsr, "TSR"), (enhancers, "enhancer")):
        if path:
            classes = classes.unionByName(S.read_bed(spark, path, 3).withColumn("class", F.lit(name)))
    pairs = _pairs(spark, alignments, qc, barcode)
    long = C.atac_features(pairs, classes, listed, least, most)
    names = sorted(r[0] for r in long.select("class").distinct().collect())
    total = G.only_listed(pairs, listed).groupBy("barcode").agg(F.count(F.lit(1)).alias("count"))
    for value, end in (("n", "counts"), ("mean_length", "lengths"), ("bases", "bases")):
        wide = long.groupBy("barcode").pivot("class", names).agg(F.first(value)).na.fill(0)
        _table(listed.join(total, "barcode", "left").join(wide, "barcode", "left").na.fill(0).orderBy("line").select("barcode", "count", *[f"`{n}`" for n in names]), f"{out}_{end}")


def flag_counts(spark: SparkSession, alignments: str, barcodes: str, out: str, min_mapq: int = 0, tag: str | None = None, compat: bool = False) -> None:
    listed = S.read_list(spark, barcodes)
    counts = C.flagstat(read_alignments(spark, alignments), listed, min_mapq, tag, compat)
    _table(listed.join(counts, "barcode").orderBy("line").select(*counts.columns), out)


def fragment_lengths(spark: SparkSession, alignments: str, barcodes: str, out: str, most: int = 600, qc: dict = {}, barcode: dict = {}) -> None:  # noqa: B006
    """Fractions, counts, and the sample's fractions: out_fractions, out_counts, out_sample."""
    listed = S.read_list(spark, barcodes)
    counts = C.length_counts(_pairs(spark, alignments, qc, barcode), listed, most)
    filled = C.length_distribution(counts, listed, most)
    for value, end in (("fraction", "fractions"), ("n", "counts")):
        _table(filled.groupBy("barcode").pivot("length", list(range(1, most + 1))).agg(F.first(value)).orderBy("barcode"), f"{out}_{end}")
    _table(C.length_of_sample(counts, most).orderBy("length"), f"{out}_sample")


def region_shares(spark: SparkSession, alignments: str, barcodes: str, regions: str, out: str, flank: int = 0, qc: dict = {}, barcode: dict = {}) -> None:  # noqa: B006
    listed = S.read_list(spark, barcodes)
    got = R.in_region(_pairs(spark, alignments, qc, barcode), S.read_bed(spark, regions, 3), listed, flank)
    _table(listed.join(got, "barcode").orderBy("line").select("barcode", "total", "in_region"), out, header=False)


def mismatch_similarity(spark: SparkSession, alignments: str, barcodes: str, out: str, least_depth: int = 1, least_share: float = 0.0, min_mapq: int = 0, tag: str = A.BARCODE_TAG) -> None:
    """Mismatch bases by site and cell (empty where there is none), and pairwise similarity: out_matrix, out_jaccard."""
    listed = S.read_list(spark, barcodes)
    hit, sites = C.mismatches(read_alignments(spark, alignments), min_mapq, tag)
    count = lambda df, keys, n: G.only_listed(df, listed).groupBy(*keys).agg(F.count(F.lit(1)).alias(n))
    place = ["barcode", "chrom", "site"]
    best = C.mismatch_sites(count(hit, [*place, "base"], "n"), count(sites, place, "depth"), least_depth, least_share)
    _wide(best, ["chrom", "site"], "base", _names(listed), f"{out}_matrix", fill=None)
    _table(C.mismatch_jaccard(best).orderBy("a", "b"), f"{out}_jaccard")


def count_matrix(spark: SparkSession, alignments: str, barcodes: str, regions: str, out: str, flank: int = 0, least: int = 0, most: int | None = 1024, qc: dict = {}, barcode: dict = {}) -> None:  # noqa: B006
    """Every region and listed barcode, in the order of the region names."""
    listed, bed = S.read_list(spark, barcodes), R.unique_names(S.read_bed(spark, regions, 4))
    counts = R.region_counts(_pairs(spark, alignments, qc, barcode), bed, listed, flank, least, most)
    wide = counts.groupBy("name").pivot("barcode", _names(listed)).agg(F.first("n"))
    _table(bed.select("name").join(wide, "name", "left").na.fill(0).orderBy("name"), out)


def tag_names(spark: SparkSession, alignments: str, out: str, tag: str = A.BARCODE_TAG, kind: str = "Z", suffix: str = "", delimiter: str = A.NAME_DELIMITER, field: int = A.NAME_FIELD) -> None:
    header = read_header_lines(spark, alignments)
    S.write_sam(G.name_to_tag(read_alignments(spark, alignments), tag, kind, suffix, delimiter, field), header, out)


def pseudobulk(spark: SparkSession, alignments: str, groups: str, regions: str, out: str, flank: int = 0, least: int = 0, most: int | None = 1024, qc: dict = {}, barcode: dict = {}) -> None:  # noqa: B006
    """Coverage by group, cut wherever a depth changes, and totals: out_coverage, out_counts."""
    named = S.read_pairs(spark, groups)
    touching = R.pseudobulk_fragments(_pairs(spark, alignments, qc, barcode), named, S.read_bed(spark, regions, 3), flank, least, most)
    names = sorted(r[0] for r in named.select("group").distinct().collect())
    _wide(joint_coverage(touching.select("chrom", "group", "start", "end"), "group"), ["chrom", "start", "end"], "depth", names, f"{out}_coverage", by="group")
    _table(R.pseudobulk_counts(touching).orderBy("group"), f"{out}_counts")


def gex_composition(spark: SparkSession, alignments: str, barcodes: str, gtf: str, out: str, tag: str = A.BARCODE_TAG, umi_tag: str | None = None, qc: dict = {}) -> None:  # noqa: B006
    listed = S.read_list(spark, barcodes)
    reads = read_alignments(spark, alignments).where(A.passes_qc(**{**GEX, **qc})).withColumn("barcode", A.tag_value(tag)).where("barcode IS NOT NULL")
    long = C.gex_features(G.first_seen(reads, umi_tag), S.gene_classes(S.read_gtf(spark, gtf)), listed)
    wide = long.groupBy("barcode").pivot("class", [*C.GEX_CLASSES, "intergenic"]).agg(F.first("bases")).na.fill(0)
    sums = wide.withColumn("bases", sum((F.col(c) for c in [*C.GEX_CLASSES, "intergenic"]), F.lit(0)))
    _table(listed.join(sums, "barcode", "left").na.fill(0).orderBy("line").select("barcode", "bases", *C.GEX_CLASSES, "intergenic"), out)


def tss_profile(spark: SparkSession, alignments: str, tss: str, out: str, barcodes: str | None = None, flank: int = 1000, least: int = 1, most: int | None = 1000, qc: dict = {}, barcode: dict = {}) -> None:  # noqa: B006
    """Raw bases, enrichment and norm factors: out_raw, out_enrichment, out_norm. Without barcodes, one bulk sample."""
    pairs = _pairs(spark, alignments, qc, barcode)
    if barcodes is None:
        pairs, samples = R.bulk(pairs, "bulk"), spark.createDataFrame([("bulk",)], "barcode string")
    else:
        samples = S.read_list(spark, barcodes)
        pairs = G.only_listed(pairs, samples)
    counts = R.tss_counts(pairs, R.unique_names(S.read_bed(spark, tss)), samples, flank, least, most)
    offsets = list(range(2 * flank + 1))
    _wide(counts, ["barcode"], "n", offsets, f"{out}_raw", by="offset")
    _wide(R.tss_enrichment(counts, flank), ["barcode"], "enrichment", offsets, f"{out}_enrichment", by="offset")
    _table(R.tss_norm_factor(counts, flank).orderBy("barcode"), f"{out}_norm")


def filter_by_barcode(spark: SparkSession, alignments: str, barcodes: str, out: str, qc: dict = {}, barcode: dict = {}) -> None:  # noqa: B006
    header = read_header_lines(spark, alignments)
    S.write_sam(G.filter_alignments(read_alignments(spark, alignments), S.read_list(spark, barcodes), **{**ATAC, **qc}, **{**NAME, **barcode}), header, out)


def metagene_profile(spark: SparkSession, alignments: str, groups: str, blocks: str, out: str, bins: int = 100, least: int = 0, most: int | None = 1024, qc: dict = {}, barcode: dict = {}) -> None:  # noqa: B006
    """Bases by group, feature and bin, and normalisers: out_metagene, out_normalization."""
    named, bed = S.read_pairs(spark, groups), S.read_bed(spark, blocks).withColumnRenamed("name", "feature")
    pairs = _pairs(spark, alignments, qc, barcode)
    filled = R.metagene_filled(R.metagene(pairs, named, bed, bins, least, most), named, bed, bins)
    _wide(filled, ["group", "feature"], "bases", list(range(bins)), f"{out}_metagene", by="bin")
    _table(R.metagene_normalization(pairs, named, bed, least, most).orderBy("group"), f"{out}_normalization")


def fragments_table(spark: SparkSession, alignments: str, out: str, barcodes: str | None = None, left_shift: int = 4, right_shift: int = -5, qc: dict = {}, barcode: dict = {}) -> None:  # noqa: B006
    listed = S.read_list(spark, barcodes) if barcodes else None
    S.write_fragments(G.fragments_file(_pairs(spark, alignments, qc, barcode), left_shift, right_shift, listed), out)


def match_barcodes(spark: SparkSession, rows: str, atac: str, gex: str, out: str, reverse: bool = False, delimiter: str = A.NAME_DELIMITER, field: int = A.NAME_FIELD, tag: str | None = None, suffix: str = "", rewrite_tag: bool = False) -> None:
    """Alignments or delimited rows with ATAC barcodes replaced by GEX ones; others go."""
    table = G.translation(S.read_matched_list(spark, atac), S.read_matched_list(spark, gex), reverse)
    if rows.endswith((".sam", ".bam")):
        reads = read_alignments(spark, rows)
        header = read_header_lines(spark, rows)
        S.write_sam(G.match_tag(reads, table, tag, suffix, rewrite_tag) if tag else G.match_field(reads, "qname", table, delimiter, field, suffix), header, out)
    else:
        lines = spark.read.text(rows).withColumn("place", F.monotonically_increasing_id())
        G.match_field(lines, "value", table, delimiter, field, suffix).orderBy("place").select("value").write.mode("overwrite").text(out)


def gene_body(spark: SparkSession, alignments: str, barcodes: str, blocks: str, out: str, bins: int = 100, tag: str = A.BARCODE_TAG, umi_tag: str | None = None, qc: dict = {}) -> None:  # noqa: B006
    listed = S.read_list(spark, barcodes)
    reads = read_alignments(spark, alignments).where(A.passes_qc(**{**GEX, **qc})).withColumn("barcode", A.tag_value(tag)).where("barcode IS NOT NULL")
    counts = R.genebody(G.first_seen(reads, umi_tag), S.read_bed(spark, blocks).withColumnRenamed("name", "feature"), listed, bins)
    _wide(counts, ["barcode"], "n", list(range(bins)), out, by="bin")

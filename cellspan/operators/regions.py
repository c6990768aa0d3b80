"""Fragments against regions: count matrices, in-region fractions, coverage, TSS, metagene and gene-body profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellspan.functions import alignment as A
from cellspan.functions.intervals import BIN, LEVELS, coverage, joint_coverage, merged, overlap_join, overlap_length
from cellspan.operators.fragments import of_length, only_listed, with_group


def flanked(regions: DataFrame, flank: int = 0) -> DataFrame:
    """Regions widened on both sides, not below 0."""
    return regions.withColumns({"start": F.greatest(F.lit(0).cast("long"), F.col("start") - flank), "end": F.col("end") + flank})


def unique_names(regions: DataFrame) -> DataFrame:
    """regions, checked to have no name twice."""
    twice = regions.groupBy("name").count().where("count > 1").limit(3).collect()
    if twice:
        raise ValueError(f"region names must be unique: {[r[0] for r in twice]}")
    return regions


def region_counts(pairs: DataFrame, regions: DataFrame, barcodes: DataFrame | None = None, flank: int = 0, least: int = 0, most: int | None = 1024, levels: tuple[int, ...] = (1, 64, 4096)) -> DataFrame:
    """name, barcode, n: fragments that overlap exactly one region name. Cells without fragments have no row."""
    used = of_length(only_listed(pairs, barcodes), least, most)
    hits = overlap_join(used, flanked(regions, flank).select("chrom", "start", "end", "name"), levels=levels)
    one = hits.groupBy("qname", "barcode").agg(F.min("r_name").alias("name"), F.max("r_name").alias("other")).where("name = other")
    return one.groupBy("name", "barcode").agg(F.count(F.lit(1)).alias("n"))


def any_overlap_counts(fragments: DataFrame, peaks: DataFrame, least_cells: int = 0, least_peaks: int = 0, least_fragments: int = 0) -> DataFrame:
    """name, barcode, n: fragments that overlap a peak, for cells and peaks that reach the minima."""
    used = fragments.where("barcode IS NOT NULL")
    if least_fragments > 1:  # a cell that is there has one fragment at least, and needs no count
        used = used.join(used.groupBy("barcode").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= least_fragments).select("barcode"), "barcode", "left_semi")
    counts = overlap_join(used.select("barcode", "chrom", "start", "end"), peaks.select("chrom", "start", "end", "name").where("name IS NOT NULL")).groupBy(F.col("r_name").alias("name"), "barcode").agg(F.count(F.lit(1)).alias("n"))
    # n is above 0; reading it in all three places keeps the counts one plan, whose exchange is reused
    own = lambda key, other, at_least: counts.groupBy(key).agg(F.count(other).alias("c"), F.sum("n").alias("s")).where((F.col("c") >= at_least) & (F.col("s") > 0)).select(key)
    names, full = own("name", "barcode", least_cells), own("barcode", "name", least_peaks)
    return counts.join(names, "name", "left_semi").join(full, "barcode", "left_semi")


def in_region(pairs: DataFrame, regions: DataFrame, barcodes: DataFrame, flank: int = 0) -> DataFrame:
    """barcode, total, in_region for each listed barcode."""
    used = only_listed(pairs, barcodes)
    hit = overlap_join(used, merged(flanked(regions.select("chrom", "start", "end"), flank), []), how="left_semi", levels=(1,))
    inside = hit.groupBy("barcode").agg(F.count(F.lit(1)).alias("i"))
    total = used.groupBy("barcode").agg(F.count(F.lit(1)).alias("t"))
    zero = F.lit(0).cast("long")
    listed = barcodes.select("barcode").distinct().join(total, "barcode", "left").join(inside, "barcode", "left")
    return listed.select("barcode", F.coalesce("t", zero).alias("total"), F.coalesce("i", zero).alias("in_region"))


def aligned(alignments: DataFrame, barcodes: DataFrame | None, min_mapq: int = 0, require: int = A.ATAC_REQUIRE, exclude: int = A.ATAC_EXCLUDE, tag: str | None = None) -> DataFrame:
    """chrom, barcode, start, end of the aligned blocks of records that pass."""
    used = only_listed(alignments.where(A.passes_qc(min_mapq, require, exclude)).withColumn("barcode", A.barcode(tag)), barcodes)
    blocks = A.each_block(used, "barcode", F.col("rname").alias("chrom"))
    return blocks.select("chrom", "barcode", "b.start", "b.end")


def base_coverage(alignments: DataFrame, barcodes: DataFrame | None, joint: bool = False, **qc) -> DataFrame:
    """Depth of aligned blocks by barcode, in maximal segments; joint: cut wherever any barcode's depth changes. qc: see aligned()."""
    blocks = aligned(alignments, barcodes, **qc)
    return joint_coverage(blocks, "barcode") if joint else coverage(blocks, ["barcode"])


def fragment_coverage(pairs: DataFrame, barcodes: DataFrame | None) -> DataFrame:
    return coverage(only_listed(pairs, barcodes), ["barcode"])


def pseudobulk_fragments(pairs: DataFrame, groups: DataFrame, regions: DataFrame, flank: int = 0, least: int = 0, most: int | None = 1024) -> DataFrame:
    """Fragments with a group, of a length in range, that touch a region; whole, not clipped."""
    used = of_length(with_group(pairs, groups), least, most)
    return overlap_join(used, merged(flanked(regions.select("chrom", "start", "end"), flank), []), how="left_semi", levels=(1,))


def pseudobulk_coverage(touching: DataFrame, joint: bool = False) -> DataFrame:
    return joint_coverage(touching, "group") if joint else coverage(touching, ["group"])


def pseudobulk_counts(touching: DataFrame) -> DataFrame:
    return touching.groupBy("group").agg(F.count(F.lit(1)).alias("fragments"), F.sum("length").alias("bases"))


def tss_counts(pairs: DataFrame, tss: DataFrame, samples: DataFrame, flank: int = 1000, least: int = 1, most: int | None = 1000) -> DataFrame:
    """barcode, offset (0 to 2 flank), n: bases of fragments around TSSs, minus strand mirrored.

    Each fragment and TSS gives one range of offsets, so nothing is expanded by base; samples (barcode) are filled.
    """
    if 2 * flank < 99:
        raise ValueError("the flank must be 50 or more")
    s = flank
    around = tss.select("chrom", F.greatest(F.lit(0).cast("long"), F.col("start") - s).alias("start"), (F.col("end") + s + 1).alias("end"), F.col("start").alias("tss"), "name", "strand")
    hits = overlap_join(of_length(pairs, least, most), around, levels=(1,) if 2 * s < 16 * BIN else LEVELS)
    lo = F.expr(f"CASE WHEN r_strand = '-' THEN greatest(0, {s} - (end - 1) + r_tss) ELSE greatest(0, start - r_tss + {s}) END")
    hi = F.expr(f"CASE WHEN r_strand = '-' THEN least({2 * s}, {s} - start + r_tss) ELSE least({2 * s}, end - 1 - r_tss + {s}) END")
    ranges = hits.select("barcode", lo.cast("long").alias("lo"), hi.cast("long").alias("hi")).where("lo <= hi")
    events = ranges.select("barcode", F.explode(F.expr("array(struct(lo AS offset, 1 AS d), struct(hi + 1 AS offset, -1 AS d))")).alias("x"))
    steps = events.where(f"x.offset <= {2 * s}").groupBy("barcode", "x.offset").agg(F.sum("x.d").alias("d"))
    known = steps.groupBy("barcode").agg(F.collect_list(F.struct("offset", "d")).alias("known"))
    # offsets without steps are laid after the join, so that they are not shuffled
    grid = f"transform(sequence(0L, {2 * s}L), o -> struct(o AS offset, 0L AS d))"
    each = samples.select("barcode").distinct().join(known, "barcode", "left").select("barcode", F.explode(F.expr(f"if(known IS NULL, {grid}, concat(known, {grid}))")).alias("x"))
    filled = each.groupBy("barcode", "x.offset").agg(F.sum("x.d").alias("d"))
    return filled.select("barcode", "offset", F.expr("sum(d) OVER (PARTITION BY barcode ORDER BY offset)").alias("n"))


def bulk(pairs: DataFrame, name: str) -> DataFrame:
    """All fragments as one sample."""
    return pairs.withColumn("barcode", F.lit(name))


def tss_norm_factor(counts: DataFrame, flank: int = 1000, edge: int = 100) -> DataFrame:
    """barcode, norm_factor: the bases at the first and last `edge` offsets."""
    far = (F.col("offset") < edge) | (F.col("offset") > 2 * flank - edge)
    return counts.groupBy("barcode").agg(F.sum(F.when(far, F.col("n")).otherwise(0)).alias("norm_factor"))


def tss_enrichment(counts: DataFrame, flank: int = 1000, edge: int = 100) -> DataFrame:
    """barcode, offset, enrichment: bases over the norm factor, 0 where that is 0."""
    far = f"offset < {edge} OR offset > {2 * flank - edge}"
    both = counts.where("barcode IS NOT NULL").withColumn("norm_factor", F.expr(f"sum(if({far}, n, 0)) OVER (PARTITION BY barcode)"))
    return both.select("barcode", "offset", F.coalesce(A.ratio(F.col("n"), F.col("norm_factor")), F.lit(0.0)).alias("enrichment"))


def tss_score(enrichment: DataFrame) -> DataFrame:
    return enrichment.groupBy("barcode").agg(F.max("enrichment").alias("score"))


def laid_blocks(blocks: DataFrame) -> DataFrame:
    """blocks with c0, the bases of the feature before the block in genomic order, and total, the feature's bases."""
    w = "PARTITION BY feature"
    before = f"coalesce(sum(end - start) OVER ({w} ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    return blocks.selectExpr("*", f"{before} AS c0", f"sum(end - start) OVER ({w}) AS total")


def _up(x: str, bins: int, total: str = "total") -> str:
    """SQL for the offset at which bin x of a feature begins."""
    return f"((({x}) * {total} + {bins - 1}) div {bins})"


def feature_bins(blocks: DataFrame, bins: int = 100) -> DataFrame:
    """chrom, start, end, feature, bin: the genomic intervals of each feature's equal bins, 5' to 3'."""
    each = laid_blocks(blocks).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    each = each.withColumns({"b0": F.expr(_up("bin", bins)), "b1": F.expr(_up("bin + 1", bins))})
    each = each.withColumns({"t0": F.expr("if(strand = '-', total - b1, b0)"), "t1": F.expr("if(strand = '-', total - b0, b1)")})
    clip = lambda x: f"start + greatest(0L, least(end - start, {x} - c0))"
    return each.selectExpr("chrom", f"{clip('t0')} AS s", f"{clip('t1')} AS e", "feature", "bin").where("s < e").withColumnsRenamed({"s": "start", "e": "end"})


def feature_offsets(intervals: DataFrame, blocks: DataFrame) -> DataFrame:
    """intervals that overlap a block of a feature, with r_feature, r_total and o0, o1: the offsets they cover, 5' to 3'.

    Blocks are joined whole and bins follow from offsets by arithmetic, so the blocks' side is as large as the blocks.
    """
    spots = laid_blocks(blocks).selectExpr("chrom", "greatest(start, 0L) AS start", "end", "feature", "strand", "total", "c0 - start AS shift")
    hits = overlap_join(intervals, spots).withColumns({"g0": F.expr("greatest(start, r_start) + r_shift"), "g1": F.expr("least(end, r_end) + r_shift")})
    turned = {"o0": F.expr("if(r_strand = '-', r_total - g1, g0)"), "o1": F.expr("if(r_strand = '-', r_total - g0, g1)")}
    return hits.withColumns(turned).drop("g0", "g1")


def metagene(pairs: DataFrame, groups: DataFrame, blocks: DataFrame, bins: int = 100, least: int = 0, most: int | None = 1024) -> DataFrame:
    """group, feature, bin, bases: fragment bases in each bin that has some."""
    used = of_length(with_group(pairs, groups), least, most).select("group", "chrom", "start", "end")
    hits = feature_offsets(used, blocks).select("group", F.col("r_feature").alias("feature"), F.col("r_total").alias("total"), "o0", "o1")
    each = hits.withColumn("bin", F.explode(F.expr(f"sequence(cast(o0 * {bins} div total AS int), cast((o1 - 1) * {bins} div total AS int))")))
    bases = f"least(o1, {_up('bin + 1', bins)}) - greatest(o0, {_up('bin', bins)})"
    return each.select("group", "feature", "bin", F.expr(bases).alias("bases")).where("bases > 0").groupBy("group", "feature", "bin").agg(F.sum("bases").alias("bases"))


def metagene_filled(counts: DataFrame, groups: DataFrame, blocks: DataFrame, bins: int = 100) -> DataFrame:
    """The counts with zeros: every group, feature and bin. A feature's bins of a group travel as one row, the zeros not at all."""
    known = counts.groupBy("group", "feature").agg(F.map_from_entries(F.collect_list(F.struct("bin", "bases"))).alias("known"))
    grid = groups.select("group").distinct().crossJoin(blocks.select("feature").distinct()).join(known, ["group", "feature"], "left")
    each = grid.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return each.select("group", "feature", "bin", F.expr("coalesce(try_element_at(known, bin), 0L)").alias("bases"))


def metagene_normalization(pairs: DataFrame, groups: DataFrame, blocks: DataFrame, least: int = 0, most: int | None = 1024) -> DataFrame:
    """Fragments and bases by group: all, of a length in range, and in features (bases: each covered base once)."""
    own = with_group(pairs, groups)
    fits = (F.col("length") >= least) & (F.lit(True) if most is None else F.col("length") <= most)
    sums = own.groupBy("group").agg(
        F.count(F.lit(1)).alias("all_fragments"), F.sum("length").alias("all_bases"),
        F.count_if(fits).alias("length_fragments"), F.sum(F.when(fits, F.col("length")).otherwise(0)).alias("length_bases"),
    )
    hits = overlap_join(own.where(fits), merged(blocks, []), levels=(1,)).groupBy("group", "qname").agg(F.sum(overlap_length()).alias("b"))
    inside = hits.groupBy("group").agg(F.count(F.lit(1)).alias("f"), F.sum("b").alias("b"))
    zero = F.lit(0).cast("long")
    return sums.join(inside, "group", "left").select(*sums.columns, F.coalesce("f", zero).alias("region_fragments"), F.coalesce("b", zero).alias("region_bases"))


def genebody(reads: DataFrame, blocks: DataFrame, barcodes: DataFrame, bins: int = 100) -> DataFrame:
    """barcode, bin, n for each listed barcode and bin: reads whose first base is in the bin of a feature.

    reads: barcode, rname, pos, after QC and first_seen().
    """
    points = only_listed(reads, barcodes).select("barcode", F.col("rname").alias("chrom"), (F.col("pos") - 1).cast("long").alias("start"), F.col("pos").cast("long").alias("end"))
    counts = feature_offsets(points, blocks).groupBy("barcode", F.expr(f"cast(o0 * {bins} div r_total AS int)").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = barcodes.select("barcode").distinct().select("barcode", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return grid.join(counts, ["barcode", "bin"], "left").select("barcode", "bin", F.coalesce("n", F.lit(0).cast("long")).alias("n"))

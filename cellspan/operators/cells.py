"""Per-cell statistics: flag counts, fragment lengths, feature composition, mismatches and similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellspan.functions import alignment as A
from cellspan.functions.intervals import BIN, first_class, merged, overlap_join, overlap_length
from cellspan.operators.fragments import only_listed

GEX_CLASSES = ["chrM_protein_coding", "pc_cds", "pc_utr", "pc_intron", "lncRNA"]


def flagstat(alignments: DataFrame, barcodes: DataFrame, min_mapq: int = 0, tag: str | None = None, compat: bool = False) -> DataFrame:
    """13 counters for each listed barcode. compat=True counts first-in-pair reads as read_2 too."""
    bit = lambda m: F.col("flag").bitwiseAND(F.lit(m)) != 0
    mapped, primary = ~bit(0x4), ~bit(0x900)
    both = bit(0x1) & mapped & ~bit(0x8)
    counters = {
        "total": F.lit(True),
        "primary": primary,
        "secondary": bit(0x100),
        "supplementary": bit(0x800),
        "duplicates": bit(0x400),
        "mapped": mapped,
        "primary_mapped": primary & mapped,
        "paired": bit(0x1),
        "read_1": bit(0x1) & bit(0x40),
        "read_2": bit(0x1) & bit(0x40 if compat else 0x80),
        "properly_paired": bit(0x1) & bit(0x2) & mapped,
        "both_mapped": both,
        "singletons": bit(0x1) & mapped & bit(0x8),
    }
    used = alignments.where(F.col("mapq") >= min_mapq).withColumn("barcode", A.barcode(tag))
    counts = used.where("barcode IS NOT NULL").groupBy("barcode").agg(*[F.count_if(c).alias(n) for n, c in counters.items()])
    listed = barcodes.select("barcode").distinct().join(counts, "barcode", "left")
    return listed.select("barcode", *[F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in counters])


def length_counts(pairs: DataFrame, barcodes: DataFrame, most: int = 600) -> DataFrame:
    """barcode, length, n: fragments of 1 to `most` bases of listed barcodes, where there are some."""
    return only_listed(pairs, barcodes).where(f"length BETWEEN 1 AND {most}").groupBy("barcode", "length").agg(F.count(F.lit(1)).alias("n"))


def length_distribution(counts: DataFrame, barcodes: DataFrame, most: int = 600) -> DataFrame:
    """barcode, length, n, fraction for every listed barcode and length; fraction is null for cells without fragments."""
    grid = barcodes.select("barcode").distinct().select("barcode", F.explode(F.expr(f"sequence(1L, {most}L)")).alias("length"))
    filled = grid.join(counts, ["barcode", "length"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return filled.withColumn("fraction", A.ratio(F.col("n"), F.expr("sum(n) OVER (PARTITION BY barcode)")))


def length_of_sample(counts: DataFrame, most: int = 600) -> DataFrame:
    """length, n, fraction of all listed cells together, for every length."""
    sums = counts.groupBy("length").agg(F.sum("n").alias("n"))
    total = sums.agg(F.sum("n").alias("total"))
    grid = counts.sparkSession.range(1, most + 1).withColumnRenamed("id", "length")
    filled = grid.join(sums, "length", "left").crossJoin(F.broadcast(total))
    return filled.select("length", F.coalesce("n", F.lit(0).cast("long")).alias("n"), A.ratio(F.coalesce("n", F.lit(0)), F.col("total")).alias("fraction"))


def length_two_levels(pairs: DataFrame, barcodes: DataFrame, most: int = 600) -> DataFrame:
    """barcode (null: the sample), length, n, in one pass."""
    used = only_listed(pairs, barcodes).where(f"length BETWEEN 1 AND {most}").select("barcode", "length")
    return used.groupingSets([["barcode", "length"], ["length"]], "barcode", "length").agg(F.count(F.lit(1)).alias("n"))


def atac_features(pairs: DataFrame, classes: DataFrame, barcodes: DataFrame, least: int = 0, most: int | None = None) -> DataFrame:
    """barcode, class, n, mean_length, bases: fragments once for each class they overlap, "intergenic" if none.

    bases: fragment bases under the class; of intergenic fragments, all.
    """
    return atac_composition(pairs, classes, barcodes, least, most).drop("total")


def atac_composition(pairs: DataFrame, classes: DataFrame, barcodes: DataFrame, least: int = 0, most: int | None = None) -> DataFrame:
    """atac_features with total, the barcode's fragments. The pairs are read once: all of them pass through one outer join."""
    used = only_listed(pairs, barcodes).where(F.col("length") >= least)
    used = used if most is None else used.where(F.col("length") <= most)
    # unions of a class don't overlap: bins are bounded by the genome
    flat = class_unions(classes).withColumn("r_bin", F.explode(F.expr(f"sequence(start div {BIN}, (end - 1) div {BIN})"))).withColumnsRenamed({c: f"r_{c}" for c in ("chrom", "class", "start", "end")})
    spots = F.expr(f"if(start >= 0 AND start < end, sequence(start div {BIN}, (end - 1) div {BIN}), array(-1L))")
    laid = used.select("qname", "barcode", "chrom", "start", "end", "length", F.explode_outer(spots).alias("bin"))
    on = (F.col("chrom") == F.col("r_chrom")) & (F.col("bin") == F.col("r_bin")) & (F.col("start") < F.col("r_end")) & (F.col("r_start") < F.col("end"))
    own = F.col("bin") == F.expr(f"greatest(start, r_start) div {BIN}")
    piece = F.when(F.col("r_class").isNotNull(), F.struct(F.col("r_class").alias("class"), overlap_length().alias("b")))
    met = laid.join(flat, on & own, "left").groupBy("qname", "barcode", "length").agg(F.collect_list(piece).alias("known"))
    # a row for each piece, the first of its class counting the fragment, and one without a class for the fragment itself
    whole = lambda name: f"struct(cast({name} AS string) AS class, length AS b)"
    rows = F.expr(f"if(size(known) = 0, array({whole(chr(39) + 'intergenic' + chr(39))}, {whole('NULL')}), array_append(known, {whole('NULL')}))")
    each = met.select("barcode", "length", F.col("known.class").alias("names"), F.posexplode(rows).alias("at", "x"))
    first = F.expr("x.class IS NULL OR size(names) = 0 OR array_position(names, x.class) = at + 1")
    one = each.select("barcode", "x.class", "x.b", first.alias("first"), "length")
    sums = one.groupBy("barcode", "class").agg(F.count_if("first").alias("n"), F.sum(F.when(F.col("first"), F.col("length"))).alias("l"), F.sum("b").alias("bases"))
    total = F.expr("max(if(class IS NULL, n, NULL)) OVER (PARTITION BY barcode)")
    return sums.withColumn("total", total).where("class IS NOT NULL").select("barcode", "class", "n", A.ratio(F.col("l"), F.col("n")).alias("mean_length"), "bases", "total")


def class_unions(classes: DataFrame) -> DataFrame:
    """Each class's own union of intervals."""
    return merged(classes.select("chrom", "class", "start", "end"), ["class"])


def gex_features(reads: DataFrame, classes: DataFrame, barcodes: DataFrame, precedence: list[str] | None = None) -> DataFrame:
    """barcode, class, bases: aligned bases by the first class in precedence, the others intergenic.

    reads: barcode, rname, pos, cigar, after QC and first_seen().
    """
    used = A.each_block(only_listed(reads, barcodes), "barcode", F.col("rname").alias("chrom"))
    blocks = used.select("barcode", "chrom", "b.start", "b.end")
    # classes don't overlap, so a bin of them is one row of BIN segments at most, and each piece of a read meets one row
    cut = lambda df: df.withColumn("bin", F.explode(F.expr(f"sequence(start div {BIN}, (end - 1) div {BIN})"))).withColumns(
        {"start": F.greatest("start", F.expr(f"bin * {BIN}")), "end": F.least("end", F.expr(f"(bin + 1) * {BIN}"))}
    )
    bins = cut(first_class(classes, precedence or GEX_CLASSES)).groupBy("chrom", "bin").agg(F.collect_list(F.struct("start", "end", "class")).alias("parts"))
    met = cut(blocks.where("start >= 0 AND start < end")).join(bins, ["chrom", "bin"], "left")
    known = "transform(filter(parts, p -> p.start < end AND start < p.end), p -> struct(p.class AS class, least(p.end, end) - greatest(p.start, start) AS bases))"
    each = met.select("barcode", (F.col("end") - F.col("start")).alias("length"), F.coalesce(F.expr(known), F.expr("cast(array() AS array<struct<class: string, bases: bigint>>)")).alias("known"))
    rest = "struct('intergenic' AS class, length - aggregate(known, 0L, (t, p) -> t + p.bases) AS bases)"
    rows = each.select("barcode", F.explode(F.expr(f"array_append(known, {rest})")).alias("x")).select("barcode", "x.class", "x.bases")
    return rows.groupBy("barcode", "class").agg(F.sum("bases").alias("bases")).where("bases > 0")


def mismatches(alignments: DataFrame, min_mapq: int = 0, tag: str = A.BARCODE_TAG) -> tuple[DataFrame, DataFrame]:
    """Mismatched bases (barcode, chrom, site, base) and aligned sites (barcode, chrom, site), from X and MD.

    Positions of X operations are mismatches; where MD is given, so are the positions it names.
    """
    used = alignments.where(A.passes_qc(min_mapq, A.MISMATCH_REQUIRE, A.MISMATCH_EXCLUDE)).withColumn("barcode", A.tag_value(tag)).where("barcode IS NOT NULL")
    chrom = F.col("rname").alias("chrom")
    # only mismatches are laid out, from the read itself; an MD site outside the aligned blocks is none
    blocks = A.each_block(used.withColumn("md", F.array_distinct(_md_sites())), "barcode", chrom, "seq", "md")
    found = F.expr("if(b.op = 'X', sequence(b.start, b.end - 1), filter(md, p -> p >= b.start AND p < b.end))")
    hits = blocks.where("b.start < b.end").select("barcode", "chrom", "seq", "b", F.explode_outer(found).alias("site")).where("site IS NOT NULL")
    base = F.expr("substring(seq, cast(b.at + site - b.start + 1 AS int), 1)")
    hit = hits.select("barcode", "chrom", "site", base.alias("base")).where("base IN ('A', 'C', 'G', 'T')")
    every = A.each_block(used, "barcode", chrom).where("b.start < b.end")
    return hit, every.select("barcode", "chrom", F.explode(F.expr("sequence(b.start, b.end - 1)")).alias("site"))


def _md_sites() -> Column:
    """0-based reference sites that the MD tag says differ."""
    parts = F.regexp_extract_all(F.coalesce(A.tag_value("MD"), F.lit("")), F.lit(r"(\d+|\^[A-Z]+|[A-Z])"), F.lit(1))
    start = F.struct((F.col("pos") - 1).cast("long").alias("p"), F.expr("cast(array() AS array<bigint>)").alias("s"))

    def step(acc: Column, x: Column) -> Column:
        gone = F.when(x.rlike(r"^\d"), F.try_to_number(x, F.lit("999999999")).cast("long")).when(x.startswith("^"), F.length(x) - 1).otherwise(F.lit(1)).cast("long")
        return F.struct((acc["p"] + gone).alias("p"), F.when(x.rlike("^[A-Z]"), F.array_append(acc["s"], acc["p"])).otherwise(acc["s"]).alias("s"))

    none = F.expr("cast(array() AS array<bigint>)")
    return F.when(A.tag_value("MD").isNull(), none).otherwise(F.aggregate(parts, start, step, lambda acc: acc["s"]))


def mismatch_sites(counts: DataFrame, depth: DataFrame, least_depth: int = 1, least_share: float = 0.0) -> DataFrame:
    """barcode, chrom, site, base, vaf: the most frequent mismatch of each site (A before T, G, C on ties).

    counts: barcode, chrom, site, base, n; depth: barcode, chrom, site, depth.
    """
    rank = F.instr(F.lit("ATGC"), F.col("base"))
    best = counts.where("base IN ('A', 'T', 'G', 'C')").groupBy("barcode", "chrom", "site").agg(F.max(F.struct("n", (-rank).alias("r"), "base")).alias("m"))
    both = best.join(depth, ["barcode", "chrom", "site"]).where(F.col("depth") >= least_depth)
    return both.select("barcode", "chrom", "site", F.col("m.base").alias("base"), A.ratio(F.col("m.n"), F.col("depth")).alias("vaf")).where(F.col("vaf") >= least_share)


def mismatch_jaccard(sites: DataFrame, width: int = 1) -> DataFrame:
    """a, b, jaccard of each pair of cells that share a base at a site (a < b); other pairs are 0."""
    size = sites.groupBy("barcode").agg((F.count(F.lit(1)) * width).alias("size"))
    left, right = (sites.select("chrom", "site", "base", F.col("barcode").alias(c)) for c in ("a", "b"))
    both = left.join(right, ["chrom", "site", "base"]).where("a < b").groupBy("a", "b").agg((F.count(F.lit(1)) * width).alias("i"))
    sized = both.join(size.select(F.col("barcode").alias("a"), F.col("size").alias("sa")), "a").join(size.select(F.col("barcode").alias("b"), F.col("size").alias("sb")), "b")
    return sized.select("a", "b", A.ratio(F.col("i"), F.col("sa") + F.col("sb") - F.col("i")).alias("jaccard"))

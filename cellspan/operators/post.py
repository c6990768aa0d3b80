"""Post-processing of per-cell tables, and preparation steps around the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellspan.functions import alignment as A
from cellspan.functions.intervals import merged, overlap_join


def flagstat_ratios(flagstat: DataFrame) -> DataFrame:
    """Shares of the primary alignments."""
    part = lambda c: A.ratio(F.col(c), F.col("primary"))
    return flagstat.select("barcode", part("primary_mapped").alias("mapped"), part("duplicates").alias("duplicates"), part("properly_paired").alias("properly_paired"), part("singletons").alias("singletons"))


def long_form(wide: DataFrame, key: str = "barcode") -> DataFrame:
    """key, name, value of a wide table's other columns."""
    rest = [c for c in wide.columns if c != key]
    return wide.select(key, *[F.col(c).cast("double").alias(c) for c in rest]).unpivot(key, rest, "name", "value")


def histogram(long: DataFrame, width: float) -> DataFrame:
    """name, bin (lower edge), n of a long table."""
    return long.where("value IS NOT NULL").groupBy("name", (F.floor(F.col("value") / width) * width).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def cluster_quartiles(long: DataFrame, clusters: DataFrame) -> DataFrame:
    """name, cluster, low, q1, median, q3, high, n over the cells of each cluster."""
    q = F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    sums = long.join(clusters, "barcode").where("value IS NOT NULL").groupBy("name", "cluster")
    sums = sums.agg(F.min("value").alias("low"), q.alias("q"), F.max("value").alias("high"), F.count(F.lit(1)).alias("n"))
    return sums.select("name", "cluster", "low", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "high", "n")


def row_percent(counts: DataFrame, value: str, total: str | None = None, key: str = "barcode") -> DataFrame:
    """counts with percent: of the column `total`, or of the key's sum of value."""
    base = F.col(total) if total else F.expr(f"sum({value}) OVER (PARTITION BY {key})")
    return counts.withColumn("percent", 100 * A.ratio(F.col(value), base))


def length_window(lengths: DataFrame, least: int, most: int) -> DataFrame:
    return lengths.where((F.col("length") >= least) & (F.col("length") <= most))


def metagene_profile(counts: DataFrame, groups: DataFrame | None = None, features: DataFrame | None = None) -> DataFrame:
    """group, bin, bpm: bases per million of the group, averaged over features.

    groups are chosen before the bases are related to their sum, features after.
    """
    own = counts if groups is None else counts.join(groups.select("group"), "group", "left_semi")
    chosen = own.withColumn("__in", F.lit(True)) if features is None else own.join(features.select("feature").distinct().withColumn("__in", F.lit(True)), "feature", "left")
    sums = chosen.groupBy("group", "bin").agg(F.sum("bases").alias("all"), F.sum(F.when(F.col("__in"), F.col("bases"))).alias("b"), F.count_if("__in").alias("n"))
    # sums by group and bin are few, so no window or second pass runs over the features
    million = sums.withColumn("total", F.expr("sum(all) OVER (PARTITION BY `group`)")).where("n > 0")
    return million.select("group", "bin", (1e6 * A.ratio(F.col("b"), F.col("total")) / F.col("n")).alias("bpm"))


def tss_by_cluster(scores: DataFrame, clusters: DataFrame) -> DataFrame:
    """Scores with clusters, best first, limited to the 1 % and 99 % quantiles."""
    scores = scores.repartition("barcode", "score")  # an exchange that both uses of the scores read; by the barcode alone it'd be left out
    ends = scores.agg(F.percentile("score", F.array(F.lit(0.01), F.lit(0.99))).alias("q"))
    both = scores.join(clusters, "barcode", "left").crossJoin(F.broadcast(ends))
    return both.select("barcode", "cluster", "score", F.least(F.greatest("score", F.col("q")[0]), F.col("q")[1]).alias("limited")).orderBy(F.desc("score"), "barcode")


def randhex_collapse(counts: DataFrame, primers: DataFrame, wells: DataFrame, samples: DataFrame, least: int = 0, listed: DataFrame | None = None) -> DataFrame:
    """feature, cell, sample, n: random-hexamer counts added to the poly-T barcodes of the same well.

    counts: feature, barcode, n, with the barcode being three parts of 8 (third, second, first round). primers: line,
    sequence, well, kind ("T" or "R"), paired by their order within a kind; a hexamer barcode moves to its partner. wells:
    position (2, 3), sequence, index. samples: well, sample. Cells under `least` counts go, or those not listed.
    """
    if listed is not None:
        kept = counts.join(listed.select("barcode"), "barcode", "left_semi")
    else:
        kept = counts.join(counts.groupBy("barcode").agg(F.sum("n").alias("c")).where(F.col("c") >= least).select("barcode"), "barcode", "left_semi")
    order = primers.withColumn("place", F.expr("row_number() OVER (PARTITION BY kind ORDER BY line)"))
    t, r = (order.where(F.col("kind") == k).select("place", F.col("sequence").alias(f"{k}_seq"), F.col("well").alias(f"{k}_well")) for k in "TR")
    pairs = t.join(r, "place").select(F.col("R_seq").alias("first"), F.col("T_seq").alias("to"))
    parts = kept.select("feature", "n", F.substring("barcode", 1, 8).alias("third"), F.substring("barcode", 9, 8).alias("second"), F.substring("barcode", 17, 8).alias("first"))
    moved = parts.join(pairs, "first", "left").withColumn("first", F.coalesce("to", "first")).drop("to")
    sums = moved.groupBy("feature", "third", "second", "first").agg(F.sum("n").alias("n"))
    one = order.where("kind = 'T'").select(F.col("sequence").alias("first"), "well", F.col("line").alias("i1"))
    two, three = (wells.where(F.col("position") == p).select(F.col("sequence").alias(n), F.col("index").alias(i)) for p, n, i in ((2, "second", "i2"), (3, "third", "i3")))
    named = sums.join(one, "first").join(two, "second").join(three, "third").join(samples, "well", "left")
    pad = lambda c: F.lpad(F.col(c).cast("string"), 2, "0")
    return named.select("feature", F.concat_ws("_", pad("i1"), pad("i2"), pad("i3")).alias("cell"), "sample", "n")


def contingency(rows: DataFrame, a: str, b: str) -> DataFrame:
    """a, b, n: rows for each pair of values that occurs."""
    return rows.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def coordinate_sorted(alignments: DataFrame, references: DataFrame | None = None) -> DataFrame:
    """Alignments by reference, place and record; references (chrom, ref_idx) give the order, else names do. Unplaced ones come last."""
    if references is None:
        return alignments.orderBy(F.expr("nullif(rname, '*')").asc_nulls_last(), "pos", "rec_id")
    order = references.select(F.col("chrom").alias("rname"), F.col("ref_idx").alias("__ref"))
    return alignments.join(order, "rname", "left").orderBy(F.col("__ref").asc_nulls_last(), "pos", "rec_id").select(*alignments.columns)


def merge_sublibraries(parts: list[DataFrame], names: list[str]) -> DataFrame:
    """Long count tables of sub-libraries as one, with the library's name put before the cell's."""
    out = None
    for df, name in zip(parts, names, strict=True):
        own = df.withColumn("barcode", F.concat(F.lit(f"{name}_"), F.col("barcode")))
        out = own if out is None else out.unionByName(own)
    return out


def exon_blocks(exons: DataFrame) -> DataFrame:
    """chrom, start, end, strand, gene: exons merged by strand, without blocks that hold several genes."""
    blocks = merged(exons.select("chrom", "strand", "start", "end"), ["strand"])
    keyed = blocks.withColumn("chrom", F.concat("chrom", F.lit("\t"), "strand"))
    own = exons.select(F.concat("chrom", F.lit("\t"), "strand").alias("chrom"), "start", "end", "gene")
    hits = overlap_join(own, keyed).groupBy(F.col("r_chrom").alias("c"), F.col("r_start").alias("start"), F.col("r_end").alias("end")).agg(F.collect_set("gene").alias("g"))
    return hits.where("size(g) = 1").select(F.split("c", "\t")[0].alias("chrom"), "start", "end", F.split("c", "\t")[1].alias("strand"), F.col("g")[0].alias("gene"))


def fastq_with_barcode(reads: DataFrame, barcodes: DataFrame, column: int = 0, first: int = 0, split: int = 0, joiner: str = "+") -> DataFrame:
    """Reads whose name has the barcode read's sequence: the token `column` gets ":" and the barcode, and comes first.

    reads and barcodes (rec_id, name, seq, qual) are matched by record. With split > 0, the barcode is its first
    `split` bases, the joiner and the rest; else it starts at base `first`. The other tokens follow, each with a space
    before it, and with the gap that the moved token leaves.
    """
    bc = F.col("b_seq")
    code = F.concat(F.substring(bc, 1, split), F.lit(joiner), F.substring(bc, split + 1, 1 << 30)) if split > 0 else F.substring(bc, first + 1, 1 << 30)
    both = reads.join(barcodes.select("rec_id", F.col("seq").alias("b_seq")), "rec_id")
    tokens = F.split(F.regexp_replace("name", "^@", ""), " ")
    head = F.concat(F.get(tokens, F.lit(column)), F.lit(":"), code)
    rest = F.array_join(F.transform(tokens, lambda t, i: F.concat(F.lit(" "), F.when(i == column, F.lit("")).otherwise(t))), "")
    return both.select("rec_id", F.concat(F.lit("@"), head, rest).alias("name"), "seq", "qual").where("name IS NOT NULL")

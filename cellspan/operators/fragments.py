"""From alignments to barcodes and fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellspan.functions import alignment as A


def pairs(alignments: DataFrame, min_mapq: int = 0, require: int = A.ATAC_REQUIRE, exclude: int = A.ATAC_EXCLUDE, tag: str | None = None, delimiter: str = A.NAME_DELIMITER, field: int = A.NAME_FIELD) -> DataFrame:
    """Read pairs of which both mates pass: qname, chrom, start, end, barcode, length.

    Mates meet in one aggregation by name. Chromosome and tag barcode are those of read 1; a pair without a barcode
    has null.
    """
    passed = A.with_operations(alignments.where(A.passes_qc(min_mapq, require, exclude)).where(F.col("flag").bitwiseAND(F.lit(0x900)) == 0))
    one = A.has_bits(0x40)
    seen = passed.select("qname", (F.col("pos") - 1).cast("long").alias("s"), A.operations_end().alias("e"), one.alias("one"), A.has_bits(0x80).alias("two"), F.when(one, F.col("rname")).alias("chrom"), *([F.when(one, A.tag_value(tag)).alias("b")] if tag else []))
    mates = seen.groupBy("qname").agg(
        F.max("chrom").alias("chrom"), F.min("s").alias("start"), F.max("e").alias("end"), F.bool_or("one").alias("one"), F.bool_or("two").alias("two"),
        *([F.max("b").alias("barcode")] if tag else []),
    ).where("one AND two")
    named = mates if tag else mates.withColumn("barcode", A.name_field(F.col("qname"), delimiter, field))
    return named.select("qname", "chrom", "start", "end", "barcode", (F.col("end") - F.col("start")).alias("length"))


def only_listed(df: DataFrame, barcodes: DataFrame | None) -> DataFrame:
    """Rows whose barcode is listed, or has one at all where there is no list."""
    has = df.where("barcode IS NOT NULL")
    return has if barcodes is None else has.join(barcodes.select("barcode").where("barcode <> ''").distinct(), "barcode", "left_semi")


def with_group(df: DataFrame, groups: DataFrame) -> DataFrame:
    return df.join(groups.select("barcode", "group").dropDuplicates(["barcode"]), "barcode")


def of_length(df: DataFrame, least: int = 0, most: int | None = 1024) -> DataFrame:
    return df.where((F.col("length") >= least) & (F.lit(True) if most is None else F.col("length") <= most))


def fragments_file(pairs_: DataFrame, left_shift: int = 4, right_shift: int = -5, barcodes: DataFrame | None = None) -> DataFrame:
    """The fragments table: chrom, start, end, barcode, count."""
    return only_listed(pairs_, barcodes).select("chrom", (F.col("start") + left_shift).alias("start"), (F.col("end") + right_shift).alias("end"), "barcode", F.lit(1).cast("long").alias("count"))


def barcode_counts(pairs_: DataFrame, least: int = 1000, whitelist: DataFrame | None = None, reverse: bool = False) -> DataFrame:
    """Pairs by barcode, at least `least`, of whitelisted barcodes where there is a whitelist (reverse: of its complements)."""
    counts = pairs_.where("barcode IS NOT NULL").groupBy("barcode").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    if whitelist is not None:
        own = whitelist.select((A.reverse_complement(F.col("barcode")) if reverse else F.col("barcode")).alias("barcode")).distinct()
        counts = counts.join(own, "barcode", "left_semi")
    return counts.orderBy(F.desc("n"), "barcode")


def filter_alignments(alignments: DataFrame, barcodes: DataFrame, min_mapq: int = 0, require: int = A.ATAC_REQUIRE, exclude: int = A.ATAC_EXCLUDE, tag: str | None = None, delimiter: str = A.NAME_DELIMITER, field: int = A.NAME_FIELD) -> DataFrame:
    """Alignments that pass and have a listed barcode, unchanged."""
    found = alignments.where(A.passes_qc(min_mapq, require, exclude)).withColumn("barcode", A.barcode(tag, delimiter, field))
    return only_listed(found, barcodes).select(*alignments.columns)


def name_to_tag(alignments: DataFrame, tag: str = A.BARCODE_TAG, kind: str = "Z", suffix: str = "", delimiter: str = A.NAME_DELIMITER, field: int = A.NAME_FIELD) -> DataFrame:
    """Alignments with TAG:kind:value appended, the value being a field of the name (none if the name is too short)."""
    value = A.name_field(F.col("qname"), delimiter, field)
    added = F.when(value.isNotNull(), F.array_append("tags", F.concat(F.lit(f"{tag}:{kind}:"), value, F.lit(suffix)))).otherwise(F.col("tags"))
    return alignments.withColumn("tags", added)


def translation(atac: DataFrame, gex: DataFrame, reverse: bool = False) -> DataFrame:
    """(atac, gex) of two line-matched lists with (line, barcode); of a repeated ATAC barcode, the last line counts."""
    left = atac.select("line", (A.reverse_complement(F.col("barcode")) if reverse else F.col("barcode")).alias("atac"))
    both = left.join(gex.select("line", F.col("barcode").alias("gex")), "line")
    return both.groupBy("atac").agg(F.max_by("gex", "line").alias("gex"))


def match_field(rows: DataFrame, column: str, table: DataFrame, delimiter: str, field: int, suffix: str = "") -> DataFrame:
    """Rows whose delimited field has a translation, with the field replaced."""
    parts = A.split_exact(F.col(column), delimiter)
    found = rows.withColumn("__atac", F.get(parts, F.lit(field))).join(table.withColumnRenamed("atac", "__atac"), "__atac")
    new = F.transform(parts, lambda x, i: F.when(i == field, F.concat(F.col("gex"), F.lit(suffix))).otherwise(x))
    return found.withColumn(column, F.concat_ws(delimiter, new)).select(*rows.columns)


def match_tag(alignments: DataFrame, table: DataFrame, tag: str, suffix: str = "", rewrite: bool = False) -> DataFrame:
    """Alignments whose tag has a translation; rewrite=False leaves the tag as it was."""
    found = alignments.withColumn("__atac", A.tag_value(tag)).join(table.withColumnRenamed("atac", "__atac"), "__atac")
    if rewrite:
        new: Column = F.transform("tags", lambda t: F.when(t.startswith(f"{tag}:"), F.concat(F.substring(t, 1, len(tag) + 3), F.col("gex"), F.lit(suffix))).otherwise(t))
        found = found.withColumn("tags", new)
    return found.select(*alignments.columns)


def first_seen(alignments: DataFrame, umi_tag: str | None) -> DataFrame:
    """The earliest record (rec_id) of each barcode and UMI; without a UMI tag, all records. A missing UMI is one value."""
    if umi_tag is None:
        return alignments
    keyed = alignments.withColumn("umi", F.coalesce(A.tag_value(umi_tag), F.lit("")))
    cols = [c for c in alignments.columns if c != "barcode"]
    return keyed.groupBy("barcode", "umi").agg(F.min_by(F.struct(*cols), "rec_id").alias("r")).select("barcode", *[F.col(f"r.{c}") for c in cols])


def mark_duplicates(pairs_: DataFrame, alignments_quality: str = "quality") -> DataFrame:
    """pairs with `duplicate`: another pair of the same barcode and ends has more quality, or the same and a smaller name."""
    order = f"PARTITION BY barcode, chrom, start, end ORDER BY {alignments_quality} DESC, qname"
    return pairs_.withColumn("duplicate", F.expr(f"row_number() OVER ({order}) > 1"))


def sorted_fragments(fragments: DataFrame) -> DataFrame:
    return fragments.orderBy("chrom", "start", "end", "barcode")

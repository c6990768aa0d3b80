"""Text formats: SAM, FASTQ, BED, GTF, lists, Matrix Market; readers give DataFrames, writers take them.

Record numbers are Spark's increasing row numbers of one scan: they follow the order of the lines in a file and stay the
same after any shuffle. Of several files, the order is that of Spark's splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAM_COLUMNS = ["qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual"]
SAM_TYPES = {"flag": "int", "pos": "int", "mapq": "int", "pnext": "int", "tlen": "int"}


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """line and rec_id, in file order."""
    return spark.read.text(path).select(F.col("value").alias("line"), F.monotonically_increasing_id().alias("rec_id"))


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignment records of SAM text."""
    body = _lines(spark, path).where(~F.col("line").startswith("@") & (F.col("line") != ""))
    f = F.split("line", "\t")
    named = [F.get(f, F.lit(i)).cast(SAM_TYPES.get(c, "string")).alias(c) for i, c in enumerate(SAM_COLUMNS)]
    return body.select("rec_id", *named, F.slice(f, 12, F.greatest(F.size(f) - 11, F.lit(0))).alias("tags"))


def read_sam_header(spark: SparkSession, path: str) -> DataFrame:
    """Header lines in order."""
    return _lines(spark, path).where(F.col("line").rlike("^@[A-Z][A-Z]\t|^@CO"))


def reference_lengths(header: DataFrame) -> DataFrame:
    """ref_idx, chrom, length of the @SQ lines."""
    sq = header.where(F.col("line").startswith("@SQ")).select("rec_id", F.regexp_extract("line", r"\tSN:([^\t]+)", 1).alias("chrom"), F.regexp_extract("line", r"\tLN:(\d+)", 1).cast("long").alias("length"))
    return sq.select(F.expr("row_number() OVER (ORDER BY rec_id) - 1").cast("long").alias("ref_idx"), "chrom", "length")


def sam_lines(alignments: DataFrame) -> DataFrame:
    """rec_id and SAM text of alignment records."""
    fixed = F.concat_ws("\t", *[F.col(c).cast("string") for c in SAM_COLUMNS])
    return alignments.select("rec_id", F.when(F.size("tags") > 0, F.concat_ws("\t", fixed, F.array_join("tags", "\t"))).otherwise(fixed).alias("line"))


def write_sam(alignments: DataFrame, header: DataFrame | None, path: str, compression: str = "none") -> None:
    """SAM text in record order, the header first (part files in order); compression: none or gzip, say."""
    lines = sam_lines(alignments).select(F.lit(1).alias("k"), "rec_id", "line")
    if header is not None:
        lines = header.select(F.lit(0).alias("k"), "rec_id", "line").unionByName(lines)
    lines.orderBy("k", "rec_id").select("line").write.mode("overwrite").text(path, compression=compression)


def _numbered_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(file, n, line) with the line's number in its file, and (file, lines), each split being numbered by itself.

    A line's number is its place in its split plus the lines of the splits before it. Lines and counts come from two
    scans; a split is named by its place and length, so if the scans were ever split differently, the query fails.
    """
    split = ["file", "at", "size"]
    raw = spark.read.text(path).selectExpr("_metadata.file_path AS file", "_metadata.file_block_start AS at", "_metadata.file_block_length AS size", "value AS line")
    counts = raw.groupBy(*split).agg(F.count(F.lit(1)).alias("c"))
    before = counts.select(*split, F.expr("sum(c) OVER (PARTITION BY file ORDER BY at) - c").alias("before"))
    placed = raw.withColumn("m", F.monotonically_increasing_id()).withColumn("i", F.expr(f"row_number() OVER (PARTITION BY {', '.join(split)} ORDER BY m) - 1"))
    known = F.when(F.col("before").isNull(), F.raise_error(F.lit("the scans of a file were split differently; run again")).cast("long")).otherwise(F.col("before"))
    return placed.join(before, split, "left").select("file", (known + F.col("i")).alias("n"), "line"), counts.groupBy("file").agg(F.sum("c").alias("lines"))


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """rec_id, name, seq, qual of records of four lines; compressed files too. Files follow each other by path.

    A last record without its quality line is dropped.
    """
    lines, files = _numbered_lines(spark, path)
    earlier = files.select("file", F.expr("coalesce(sum(lines div 4) OVER (ORDER BY file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)").alias("earlier"))
    part = lambda k: F.max(F.when(F.col("n") % 4 == k, F.col("line")))
    records = lines.groupBy("file", F.expr("n div 4").alias("r")).agg(part(0).alias("name"), part(1).alias("seq"), part(3).alias("qual")).where("qual IS NOT NULL")
    return records.join(earlier, "file").select((F.col("earlier") + F.col("r")).alias("rec_id"), "name", "seq", "qual")


def write_fastq(reads: DataFrame, path: str) -> None:
    reads.orderBy("rec_id").select(F.concat_ws("\n", "name", "seq", F.lit("+"), "qual").alias("line")).write.mode("overwrite").text(path)


def read_bed(spark: SparkSession, path: str, columns: int = 6) -> DataFrame:
    names = ["chrom", "start", "end", "name", "score", "strand"][:columns]
    kinds = {"start": "long", "end": "long"}
    return spark.read.csv(path, sep="\t", comment="#", schema=", ".join(f"`{n}` {kinds.get(n, 'string')}" for n in names))


def read_fragments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", comment="#", schema="chrom string, start long, end long, barcode string, count long")


def write_fragments(fragments: DataFrame, path: str, compression: str = "none") -> None:
    fragments.select("chrom", "start", "end", "barcode", "count").write.mode("overwrite").csv(path, sep="\t", compression=compression)


def write_fragment_table(fragments: DataFrame, path: str) -> None:
    """Fragments as Parquet by chromosome, sorted within files, so that a region's reader prunes by folder and statistics."""
    ranged = fragments.repartitionByRange("chrom", "start").sortWithinPartitions("chrom", "start", "end", "barcode")
    ranged.write.mode("overwrite").partitionBy("chrom").parquet(path)


def gtf_attribute(name: str) -> Column:
    return F.nullif(F.regexp_extract("attributes", rf'(?:^|; *){name} "([^"]*)"', 1), F.lit(""))


def read_gtf(spark: SparkSession, path: str) -> DataFrame:
    """Annotation rows with 0-based half-open intervals and gene_id, gene_type."""
    raw = spark.read.csv(path, sep="\t", comment="#", quote="", schema="chrom string, source string, feature string, s long, end long, score string, strand string, frame string, attributes string")
    kind = F.coalesce(gtf_attribute("gene_type"), gtf_attribute("gene_biotype"))
    return raw.select("chrom", "source", "feature", (F.col("s") - 1).alias("start"), "end", "strand", gtf_attribute("gene_id").alias("gene"), kind.alias("gene_type"), "attributes")


def gene_classes(gtf: DataFrame, mitochondrial: str = "chrM") -> DataFrame:
    """chrom, start, end, class for the composition operators; introns are genes, exons and CDS winning over them."""
    coding = F.col("gene_type") == "protein_coding"
    named = (
        F.when(coding & (F.col("chrom") == mitochondrial) & (F.col("feature") == "gene"), "chrM_protein_coding")
        .when(coding & (F.col("feature") == "CDS"), "pc_cds")
        .when(coding & (F.col("feature").isin("exon", "UTR", "five_prime_utr", "three_prime_utr")), "pc_utr")
        .when(coding & (F.col("feature") == "gene"), "pc_intron")
        .when((F.col("gene_type") == "lncRNA") & (F.col("feature") == "gene"), "lncRNA")
    )
    return gtf.select("chrom", "start", "end", named.alias("class")).where("class IS NOT NULL")


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """line and barcode: the first column of each line that isn't blank, the first of repeated ones."""
    rows = _lines(spark, path).select(F.col("rec_id").alias("line"), F.split("line", "\t")[0].alias("barcode")).where("barcode <> ''")
    return rows.groupBy("barcode").agg(F.min("line").alias("line")).select("line", "barcode")


def read_matched_list(spark: SparkSession, path: str) -> DataFrame:
    """line (0-based) and barcode of every line, for line-matched lists."""
    return _lines(spark, path).select(F.expr("row_number() OVER (ORDER BY rec_id) - 1").cast("long").alias("line"), F.split("line", "\t")[0].alias("barcode"))


def read_pairs(spark: SparkSession, path: str, value: str = "group") -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=f"barcode string, `{value}` string")


def read_mtx(spark: SparkSession, matrix: str, barcodes: str, features: str) -> DataFrame:
    """feature, barcode, n of a Matrix Market trio."""
    body = _lines(spark, matrix).where(~F.col("line").startswith("%"))
    first = body.agg(F.min("rec_id").alias("f"))
    f = F.split("line", r"\s+")
    cells = body.join(F.broadcast(first), F.col("rec_id") > F.col("f")).select(f[0].cast("long").alias("i"), f[1].cast("long").alias("j"), f[2].cast("long").alias("n"))
    order = lambda p, c, n: read_matched_list(spark, p).select((F.col("line") + 1).alias(c), F.col("barcode").alias(n))
    return cells.join(order(features, "i", "feature"), "i").join(order(barcodes, "j", "barcode"), "j").select("feature", "barcode", "n")


def write_wide(long: DataFrame, row: str, column: str, value: str, columns: list[str], path: str, header: bool = True) -> None:
    """A tab-separated matrix with the given columns; missing cells are 0."""
    wide = long.groupBy(row).pivot(column, columns).agg(F.first(value)).na.fill(0)
    wide.write.mode("overwrite").csv(path, sep="\t", header=header)


ALIGNMENT_SCHEMA = T.StructType(
    [T.StructField("rec_id", T.LongType()), *[T.StructField(c, T.IntegerType() if c in SAM_TYPES else T.StringType()) for c in SAM_COLUMNS], T.StructField("tags", T.ArrayType(T.StringType()))]
)

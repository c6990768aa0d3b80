"""Queries that write the derived tables as files of each format and read them back."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellspan.operators import fragments as G
from cellspan.plans import fixtures as X
from cellspan.plans.catalog import BASE, ORACLES, QUERIES, query
from cellspan.sources import text as S

__all__ = ["ORACLES", "QUERIES"]


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of spark.checkpoint.dir; where that is unset, a temporary one on a local master.

    Its files go when the driver's JVM ends.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = f"file://{tempfile.gettempdir()}"
    base = f"{shared.rstrip('/')}/cellspan-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(base)
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(place)
    store.deleteOnExit(place)
    return f"{base}/{name}"


def _text(lines: DataFrame, path: str) -> str:
    """lines (k, line) in the order of k, as one file."""
    lines.repartition(1).sortWithinPartitions("k", "line").select("line").write.text(path)
    return path


@query("sam_file", BASE + r""" SELECT qname, flag::INT AS flag, chrom AS rname, pos::INT AS pos, mapq::INT AS mapq, (['50M', '20M5D25M', '10S40M10N', '25M2I25M'])[ln % 4 + 1] AS cigar,
  pnext::INT AS pnext, tlen::INT AS tlen, 'CB:Z:' || barcode || ' UB:Z:' || (ok % 97) AS tags FROM al""")  # fmt: skip
def sam_file(spark: SparkSession, sf: str) -> DataFrame:
    path = folder(spark, "alignments.sam")
    S.write_sam(X.alignments(spark, sf), None, path, "gzip")
    return S.read_sam(spark, path).select("qname", "flag", "rname", "pos", "mapq", "cigar", "pnext", "tlen", F.array_join("tags", " ").alias("tags"))


@query("sam_file_fragments", BASE + ' SELECT chrom, fs + 4 AS start, fe - 5 AS "end", barcode, 1::BIGINT AS count FROM f')
def sam_file_fragments(spark: SparkSession, sf: str) -> DataFrame:
    """Alignments read from a file, and their fragments written and read once more."""
    sam, out = folder(spark, "alignments.sam"), folder(spark, "fragments.tsv")
    S.write_sam(X.alignments(spark, sf), None, sam, "gzip")
    S.write_fragments(G.fragments_file(G.pairs(S.read_sam(spark, sam), min_mapq=30)), out, "gzip")
    return S.read_fragments(spark, out)


@query("fastq_file", "SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS rec_id, '@R' || p_partkey || ' 1:N:0' AS name, repeat('ACGTN', (p_size % 7 + 1)::INT) AS seq, repeat('@+I#A', (p_size % 7 + 1)::INT) AS qual FROM part")
def fastq_file(spark: SparkSession, sf: str) -> DataFrame:
    reads = spark.read.parquet(f"{sf}/part.parquet").selectExpr(
        "p_partkey AS rec_id", "concat('@R', p_partkey, ' 1:N:0') AS name", "repeat('ACGTN', cast(p_size % 7 + 1 AS int)) AS seq", "repeat('@+I#A', cast(p_size % 7 + 1 AS int)) AS qual"
    )
    path = folder(spark, "reads.fastq")
    S.write_fastq(reads, path)
    return S.read_fastq(spark, path)


@query("gtf_file", """SELECT 'chr' || (p_partkey % 5 + 1) AS chrom, p_partkey * 75 AS start, p_partkey * 75 + p_size * 10 AS "end",
  (['pc_intron', 'pc_utr', 'pc_cds', 'lncRNA'])[p_partkey % 4 + 1] AS class FROM part""")  # fmt: skip
def gtf_file(spark: SparkSession, sf: str) -> DataFrame:
    line = F.expr(
        "concat_ws('\t', concat('chr', p_partkey % 5 + 1), 'x', element_at(array('gene', 'exon', 'CDS', 'gene'), cast(p_partkey % 4 + 1 AS int)), p_partkey * 75 + 1, p_partkey * 75 + p_size * 10,"
        " '.', '+', '.', concat('gene_id \"g', p_partkey, '\"; gene_type \"', if(p_partkey % 4 = 3, 'lncRNA', 'protein_coding'), '\";'))"
    )
    path = folder(spark, "genes.gtf")
    spark.read.parquet(f"{sf}/part.parquet").select(line.alias("line")).write.text(path)
    return S.gene_classes(S.read_gtf(spark, path))


@query("bed_file", """SELECT 'chr' || (p_partkey % 5 + 1) AS chrom, p_partkey * 75 AS start, p_partkey * 75 + p_size * 10 AS "end", 'peak' || p_partkey AS name, '0' AS score, CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand FROM part""")
def bed_file(spark: SparkSession, sf: str) -> DataFrame:
    path = folder(spark, "peaks.bed")
    X.regions(spark, sf).select("chrom", "start", "end", "name", "score", "strand").write.csv(path, sep="\t")
    return S.read_bed(spark, path)


@query("mtx_file", "SELECT 'g' || (l_partkey % 50) AS feature, 'BC' || lpad(l_suppkey::VARCHAR, 5, '0') AS barcode, count(*) AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL")
def mtx_file(spark: SparkSession, sf: str) -> DataFrame:
    listed = X.barcodes(spark, sf).select(F.col("line").alias("k"), F.col("barcode").alias("line"))
    place = listed.select(F.col("line").alias("barcode"), F.expr("row_number() OVER (ORDER BY k)").alias("j"))
    features = spark.range(50).selectExpr("id AS k", "concat('g', id) AS line")
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr("l_partkey % 50 + 1 AS i", "concat('BC', lpad(cast(l_suppkey AS string), 5, '0')) AS barcode")
    cells = rows.join(place, "barcode").groupBy("i", "j").agg(F.count(F.lit(1)).alias("n")).selectExpr("2 AS k", "concat_ws(' ', i, j, n) AS line")
    head = spark.createDataFrame([(0, "%%MatrixMarket matrix coordinate integer general"), (1, "50 0 0")], "k int, line string")
    trio = [_text(df, folder(spark, name)) for df, name in ((head.unionByName(cells), "matrix.mtx"), (listed, "barcodes.tsv"), (features, "features.tsv"))]
    return S.read_mtx(spark, *trio)

"""Single-cell tables derived from the star-schema tables (see FIXTURES.md, part B)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellspan.operators.fragments import pairs as make_pairs


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two mates for each lineitem row, with CB and UB tags."""
    base = _read(spark, sf_dir, "lineitem").selectExpr(
        "concat('Q:', l_orderkey, ':', l_partkey, ':', l_suppkey, ':', l_linenumber, ':0:0:BC', lpad(cast(l_suppkey AS string), 5, '0')) AS qname",
        "concat('chr', l_partkey % 5 + 1) AS rname",
        "l_orderkey * 10 + l_linenumber * 7 AS fs",
        "l_orderkey * 10 + l_linenumber * 7 + cast(floor(l_quantity) AS bigint) * 8 + 60 AS fe",
        "element_at(array('50M', '20M5D25M', '10S40M10N', '25M2I25M'), cast(l_linenumber % 4 + 1 AS int)) AS cigar",
        "cast(l_partkey % 61 AS int) AS mapq",
        "if(l_discount > 0.085, 1024, 0) + if(l_tax > 0.075, 256, 0) + if(l_returnflag = 'R' AND l_linestatus = 'F' AND l_linenumber = 7, 12, 0) AS x",
        "array(concat('CB:Z:BC', lpad(cast(l_suppkey AS string), 5, '0')), concat('UB:Z:', l_orderkey % 97)) AS tags",
        "(((l_orderkey * 20000 + l_partkey) * 1000 + l_suppkey) * 8 + l_linenumber) * 2 AS rec",
    )
    mates = base.withColumn("m", F.explode(F.array(F.lit(0), F.lit(1))))
    return mates.selectExpr(
        "rec + m AS rec_id", "qname", "cast(3 + if(m = 0, 96, 144) + x AS int) AS flag", "rname", "cast(if(m = 0, fs + 1, fe - 49) AS int) AS pos", "mapq", "cigar",
        "'=' AS rnext", "cast(if(m = 0, fe - 49, fs + 1) AS int) AS pnext", "cast(if(m = 0, fe - fs, fs - fe) AS int) AS tlen", "'*' AS seq", "'*' AS qual", "tags",
    )


def substituted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alignments as reads with one substitution: by an X operation, or by the MD tag."""
    x = "rec_id % 4 < 2"
    return alignments(spark, sf_dir).withColumns(
        {
            "cigar": F.expr(f"if({x}, '20=1X29=', '50M')"),
            "seq": F.expr("substring(repeat('ACGT', 13), 1, 50)"),
            "tags": F.expr(f"if({x}, tags, array_append(tags, 'MD:Z:10A39'))"),
        }
    )


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return make_pairs(alignments(spark, sf_dir), min_mapq=30)


def barcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "supplier").selectExpr("s_suppkey AS line", "concat('BC', lpad(cast(s_suppkey AS string), 5, '0')) AS barcode", "s_nationkey", "s_suppkey")


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return barcodes(spark, sf_dir).selectExpr("barcode", "concat('G', s_nationkey) AS `group`")


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return barcodes(spark, sf_dir).selectExpr("barcode", "cast(s_nationkey % 5 AS string) AS cluster")


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "part").selectExpr(
        "concat('chr', p_partkey % 5 + 1) AS chrom", "p_partkey * 75 AS start", "p_partkey * 75 + p_size * 10 AS end", "concat('peak', p_partkey) AS name", "'0' AS score",
        "if(p_partkey % 2 = 0, '+', '-') AS strand", "element_at(array('pc_cds', 'pc_utr', 'pc_intron', 'lncRNA'), cast(p_partkey % 4 + 1 AS int)) AS class",
    )


def tss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "part").where("p_partkey % 10 = 0").selectExpr(
        "concat('chr', p_partkey % 5 + 1) AS chrom", "p_partkey * 75 AS start", "p_partkey * 75 + 1 AS end", "concat('tss', p_partkey) AS name", "if((p_partkey div 10) % 2 = 0, '+', '-') AS strand"
    )


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "part").selectExpr(
        "concat('chr', p_partkey % 5 + 1) AS chrom", "p_partkey * 75 AS start", "p_partkey * 75 + p_size * 7 AS end", "concat('F', (p_partkey div 10) * 5 + p_partkey % 5) AS feature", "if((p_partkey div 10) % 2 = 0, '+', '-') AS strand"
    )


def mismatch_counts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(barcode, chrom, site, base, n) and (barcode, chrom, site, depth) of 50-base segments."""
    sites = pairs(spark, sf_dir).selectExpr("barcode", "chrom", "start - start % 50 AS site", "substring('ATGC', cast(split(qname, ':')[4] AS int) % 4 + 1, 1) AS base")
    return sites.groupBy("barcode", "chrom", "site", "base").agg(F.count(F.lit(1)).alias("n")), sites.groupBy("barcode", "chrom", "site").agg(F.count(F.lit(1)).alias("depth"))

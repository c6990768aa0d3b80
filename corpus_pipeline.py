"""A corpus pipeline of five stages, each an operator of cellspan.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet to the shared folder and
reads it again as the next stage's docs. All but the last return the columns of documents.

Cases, for every stage: an empty table gives an empty result; columns other than those of documents are dropped, whatever
their names; rows with a null id are documents like others; repeated rows are documents of their own unless the stage's
docstring says otherwise; texts of any length are read in whole.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellspan.llm import decontaminate, jaccard_join, language_id, line_dedup, token_mix
from cellspan.llm.common import WORD_SPLIT, cut, discard, filed, numbered

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; what language ID rejects goes: null texts, texts without a letter, and narrow margins."""
    return language_id.identify(docs, language_id.learned_from(docs)).where("NOT rejected").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier one has (the smaller id is earlier, nulls last, then the row).

    Those that have lost lines and have no word left go; of repeated rows one stays. Null and empty texts stay as they are.
    """
    kept = line_dedup.dedup_lines(docs)
    words = F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), WORD_SPLIT), ""))
    kept = kept.where((F.col("n_removed") == 0) | (words > 0))
    return kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is linked by five-word shingles at a similarity of 0.8 or more: the smallest id, nulls last.

    Of repeated rows one stays. Documents without a word are alike to none and stay.
    """
    return jaccard_join.drop_similar(docs, 5, Fraction(4, 5)).select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage; null and empty texts stay, and so does everything if the benchmark is empty."""
    base = numbered(filed(docs.select(*COLUMNS)))
    hits = decontaminate.find_leaks(base, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="__cs_rid")
    return base.join(cut(hits.select("__cs_rid").distinct()), "__cs_rid", "left_anti").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: size, source_size, target and taken (words, repeats counted) of each document; null texts have size 0, a null source is a source."""
    return token_mix.mix_sources(docs).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("language_id", keep_identified),
    ("line_dedup", drop_repeated_lines),
    ("jaccard_join", keep_one_of_each_group),
    ("decontaminate", drop_leaks),
    ("token_mix", mix),
]

#: SQL can't express compression, MinHash or the knapsack; tests/llm compare the operators with plain versions of them, and run the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        before, docs = docs, cut(stage(spark, docs, sf_dir))
        discard(before)
    return docs

"""Column expressions over alignment records (qname, flag, rname, pos, mapq, cigar, seq, tags)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Default flag masks and barcode places of the two assays.
ATAC_REQUIRE, ATAC_EXCLUDE = 3, 3340
GEX_REQUIRE, GEX_EXCLUDE = 0, 2308
MISMATCH_REQUIRE, MISMATCH_EXCLUDE = 0, 2052
NAME_DELIMITER, NAME_FIELD, BARCODE_TAG = ":", 7, "CB"


def passes_qc(min_mapq: int = 0, require: int = ATAC_REQUIRE, exclude: int = ATAC_EXCLUDE) -> Column:
    """Mapping quality reached, all required flag bits set, no excluded one set."""
    flag = F.col("flag")
    return (F.col("mapq") >= min_mapq) & (flag.bitwiseAND(F.lit(require)) == require) & (flag.bitwiseAND(F.lit(exclude)) == 0)


def has_bits(mask: int) -> Column:
    return F.col("flag").bitwiseAND(F.lit(mask)) == mask


def split_exact(c: Column, delimiter: str) -> Column:
    """Split at a one-character delimiter, keeping empty fields."""
    return F.split(c, re.escape(delimiter), -1)


def name_field(name: Column, delimiter: str = NAME_DELIMITER, field: int = NAME_FIELD) -> Column:
    """A field of a read name; null if it has too few, or if the field is empty."""
    return F.nullif(F.get(split_exact(name, delimiter), F.lit(field)), F.lit(""))


def tag_value(tag: str) -> Column:
    """The value of the first TAG:type:value; null if absent or empty."""
    found = F.get(F.filter("tags", lambda t: t.startswith(f"{tag}:")), F.lit(0))
    return F.nullif(F.substring(found, len(tag) + 4, 1 << 30), F.lit(""))


def barcode(tag: str | None = None, delimiter: str = NAME_DELIMITER, field: int = NAME_FIELD) -> Column:
    return tag_value(tag) if tag else name_field(F.col("qname"), delimiter, field)


def reverse_complement(c: Column) -> Column:
    """The complement in reverse, letter case kept; letters other than ACGT become N."""
    return F.reverse(F.translate(F.regexp_replace(c, "[^ACGTacgt]", "N"), "ACGTacgt", "TGCAtgca"))


def _plain(cigar: Column) -> Column:
    """Whether a CIGAR is a single match, as most are; those need no walk."""
    return cigar.rlike(r"^\d+M$")


def _plain_length(cigar: Column) -> Column:
    return F.substring(cigar, F.lit(1), F.length(cigar) - 1).cast("long")


def cigar_ops(cigar: Column) -> Column:
    """array<struct<n, op>> of a CIGAR string."""
    pattern = F.lit(r"(\d+)([MIDNSHP=X])")
    pairs = F.arrays_zip(F.regexp_extract_all(cigar, pattern, F.lit(1)).alias("n"), F.regexp_extract_all(cigar, pattern, F.lit(2)).alias("op"))
    return F.transform(pairs, lambda p: F.struct(p["n"].cast("long").alias("n"), p["op"].alias("op")))


def reference_span(cigar: Column) -> Column:
    """Bases of the reference from first to last aligned base."""
    walked = F.aggregate(cigar_ops(cigar), F.lit(0).cast("long"), lambda a, p: a + F.when(p["op"].isin("M", "D", "N", "=", "X"), p["n"]).otherwise(F.lit(0)))
    return F.when(_plain(cigar), _plain_length(cigar)).otherwise(walked)


def reference_end(pos: Column, cigar: Column) -> Column:
    """0-based exclusive end."""
    return pos - 1 + reference_span(cigar)


def aligned_blocks(pos: Column, cigar: Column) -> Column:
    """array<struct<start, end, op, at>>: the 0-based reference blocks of M, = and X, and where they start in the read."""
    start = F.struct((pos - 1).cast("long").alias("p"), F.lit(0).cast("long").alias("r"), F.expr("cast(array() as array<struct<start:bigint,end:bigint,op:string,at:bigint>>)").alias("b"))
    n0 = F.lit(0).cast("long")

    def step(acc: Column, op: Column) -> Column:
        covers = op["op"].isin("M", "=", "X")
        block = F.struct(acc["p"].alias("start"), (acc["p"] + op["n"]).alias("end"), op["op"].alias("op"), acc["r"].alias("at"))
        return F.struct(
            (acc["p"] + F.when(covers | op["op"].isin("D", "N"), op["n"]).otherwise(n0)).alias("p"),
            (acc["r"] + F.when(covers | op["op"].isin("I", "S"), op["n"]).otherwise(n0)).alias("r"),
            F.when(covers, F.concat(acc["b"], F.array(block))).otherwise(acc["b"]).alias("b"),
        )

    first = (pos - 1).cast("long")
    whole = F.array(F.struct(first.alias("start"), (first + _plain_length(cigar)).alias("end"), F.lit("M").alias("op"), n0.alias("at")))
    return F.when(_plain(cigar), whole).otherwise(F.aggregate(cigar_ops(cigar), start, step, lambda acc: acc["b"]))


#: CIGARs of up to so many operations are read by compiled expressions; longer ones are walked, with the same results.
SHORT_CIGAR = 6


def with_operations(alignments: DataFrame) -> DataFrame:
    """alignments with __op and __n, the operations and lengths of a short CIGAR; __n is null for others.

    Characters are translated and split at spaces, as patterns cost several times as much.
    """
    letters = "MIDNSHP=X"
    parts = alignments.withColumns({"__op": F.translate("cigar", "0123456789", ""), "__sp": F.translate("cigar", letters, " " * len(letters))})
    known = (F.length("__op").between(1, SHORT_CIGAR)) & (F.translate("__op", letters, "") == "")
    whole = F.col("__sp").endswith(" ") & ~F.col("__sp").startswith(" ") & ~F.col("__sp").contains("  ")
    return parts.withColumn("__n", F.when(known & whole, F.split("__sp", " "))).drop("__sp")


def _operation(k: int) -> Column:
    return F.substring("__op", k + 1, 1)


def _advance(k: int, ops: str) -> Column:
    """Bases that operation k adds, if it is one of ops."""
    return F.when(_operation(k).isin(*ops), F.get("__n", F.lit(k)).cast("long")).otherwise(F.lit(0).cast("long"))


def operations_end() -> Column:
    """reference_end of rows that have with_operations()."""
    span = sum((_advance(k, "MDN=X") for k in range(1, SHORT_CIGAR)), _advance(0, "MDN=X"))
    return F.when(F.col("__n").isNotNull(), F.col("pos") - 1 + span).otherwise(reference_end(F.col("pos"), F.col("cigar")))


def each_block(alignments: DataFrame, *columns: str | Column) -> DataFrame:
    """columns and b, a row for each of aligned_blocks() of alignments."""
    n = range(SHORT_CIGAR)
    steps = {f"__{name}{k}": _advance(k, ops) for name, ops in (("r", "MDN=X"), ("q", "MIS=X")) for k in n}
    before = lambda name, k: sum((F.col(f"__{name}{j}") for j in range(k)), F.lit(0).cast("long"))
    blocks = []
    for k in n:
        op, start = _operation(k), (F.col("pos") - 1).cast("long") + before("r", k)
        block = F.struct(start.alias("start"), (start + F.col(f"__r{k}")).alias("end"), op.alias("op"), before("q", k).alias("at"))
        blocks.append(F.when(op.isin("M", "=", "X"), block))
    found = F.when(F.col("__n").isNotNull(), F.array(*blocks)).otherwise(aligned_blocks(F.col("pos"), F.col("cigar")))
    # outer, so that no filter is inferred that evaluates the blocks a second time
    return with_operations(alignments).withColumns(steps).select(*columns, F.explode_outer(found).alias("b")).where("b IS NOT NULL")


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))

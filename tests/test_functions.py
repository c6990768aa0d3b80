from __future__ import annotations

import random

from pyspark.sql import functions as F

from cellspan.functions import alignment as A
from cellspan.functions.intervals import coverage, first_class, joint_coverage, merged, overlap_join

INTERVAL = "chrom string, start long, end long, name string"


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_expressions(spark):
    df = spark.createDataFrame([("a:b:c", "10S20M5D3I4=2X7N1M2H", 11, ["XX:i:3", "CB:Z:AC:GT"], 99, 30)], "qname string, cigar string, pos int, tags array<string>, flag int, mapq int")
    out = df.select(
        A.name_field(F.col("qname"), ":", 1).alias("f"), A.name_field(F.col("qname"), ":", 7).alias("none"), A.tag_value("CB").alias("cb"), A.tag_value("UB").alias("ub"),
        A.reference_end(F.col("pos"), F.col("cigar")).alias("e"), A.aligned_blocks(F.col("pos"), F.col("cigar")).alias("b"), A.passes_qc(30).alias("ok"), A.passes_qc(31).alias("low"),
    ).first()
    assert (out.f, out.none, out.cb, out.ub, out.e, out.ok, out.low) == ("b", None, "AC:GT", None, 49, True, False)
    assert [(b.start, b.end, b.op, b.at) for b in out.b] == [(10, 30, "M", 10), (35, 39, "=", 33), (39, 41, "X", 37), (48, 49, "M", 39)]
    rc = spark.createDataFrame([("ACGTN",), ("aacx",), ("",), (None,)], "s string").select(A.reverse_complement(F.col("s")).alias("r")).collect()
    assert [r.r for r in rc] == ["NACGT", "Ngtt", "", None]


def test_split_keeps_empty_fields_and_quotes_the_delimiter(spark):
    df = spark.createDataFrame([("a.b..",)], "s string")
    assert df.select(A.split_exact(F.col("s"), ".").alias("p")).first().p == ["a", "b", "", ""]


def test_overlap_edges(spark):
    left = spark.createDataFrame([("c", 0, 10, "touch"), ("c", 9, 11, "one"), ("c", 5, 5, "empty"), ("d", 0, 100, "other")], INTERVAL)
    right = spark.createDataFrame([("c", 10, 20, "r")], INTERVAL)
    assert rows(overlap_join(left, right, 4), "name", "r_name") == [("one", "r")]


def test_overlap_equals_the_plain_join(spark):
    rng = random.Random(1)
    make = lambda n, most: spark.createDataFrame([("c" + str(rng.randrange(2)), s := rng.randrange(3000), s + rng.randrange(most), str(i)) for i in range(n)], INTERVAL)
    left, right = make(150, 60), make(60, 2500)
    plain = left.join(right.select(*[F.col(c).alias("r_" + c) for c in right.columns]), (F.col("chrom") == F.col("r_chrom")) & (F.col("start") < F.col("r_end")) & (F.col("r_start") < F.col("end")) & (F.col("start") < F.col("end")) & (F.col("r_start") < F.col("r_end")))
    for width in (3, 64, 4096):
        assert rows(overlap_join(left, right, width), "name", "r_name") == rows(plain, "name", "r_name")
    assert rows(overlap_join(left, right, 16, "left_semi"), "name") == sorted(set(rows(plain, "name")))


def per_base(data):
    depth = {}
    for c, s, e, k in data:
        for b in range(s, e):
            depth[c, k, b] = depth.get((c, k, b), 0) + 1
    return depth


def test_coverage_over_tiles(spark):
    rng = random.Random(2)
    data = [("c", s := rng.randrange(200), s + rng.randrange(1, 60), rng.choice("xy")) for _ in range(60)] + [("c", 300, 340, "x")]
    df = spark.createDataFrame(data, INTERVAL)
    want = per_base(data)
    results = []
    for tile in (7, 32, 10_000):
        out = coverage(df, ["name"], tile).collect()
        got = {(r["chrom"], r["name"], b): r["depth"] for r in out for b in range(r["start"], r["end"])}
        assert got == want
        results.append(sorted((r["name"], r["start"], r["end"], r["depth"]) for r in out))
    assert results[0] == results[1] == results[2]  # maximal segments, whatever the tiles


def test_joint_coverage_over_tiles(spark):
    data = [("c", 0, 50, "x"), ("c", 20, 70, "y"), ("c", 64, 100, "x"), ("c", 200, 300, "y")]
    df = spark.createDataFrame(data, INTERVAL)
    want = sorted([(0, 20, "x", 1), (20, 50, "x", 1), (20, 50, "y", 1), (50, 64, "y", 1), (64, 70, "x", 1), (64, 70, "y", 1), (70, 100, "x", 1), (200, 300, "y", 1)])
    for tile in (64, 128, 1 << 12):
        assert rows(joint_coverage(df, "name", tile), "start", "end", "name", "depth") == want


def test_merged_and_first_class(spark):
    df = spark.createDataFrame([("c", 0, 10, "b"), ("c", 10, 12, "b"), ("c", 5, 8, "a"), ("c", 20, 21, "z")], INTERVAL)
    assert rows(merged(df, []), "start", "end") == [(0, 12), (20, 21)]
    got = rows(first_class(df.withColumnRenamed("name", "class"), ["a", "b"]), "start", "end", "class")
    bases = {b: c for s, e, c in got for b in range(s, e)}
    assert bases == {b: ("a" if 5 <= b < 8 else "b") for b in range(12)}


def test_short_cigars_as_walked(spark):
    cigars = ["50M", "20M5D25M", "10S40M10N", "25M2I25M", "2=1X2=", "1X0M1=", "3H2S4M1P5M2H", "1M1I1M1I1M1I1M", "*", "", None, "5Q", "M5", "5M3", "5MM", "1M 2M"]
    df = spark.createDataFrame([(i, 11, c) for i, c in enumerate(cigars)], "i int, pos int, cigar string")
    got, want = A.with_operations(df).select("i", A.operations_end()), df.select("i", A.reference_end(F.col("pos"), F.col("cigar")))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    walked = df.select("i", F.explode(A.aligned_blocks(F.col("pos"), F.col("cigar"))).alias("b"))
    assert sorted((r.i, *r.b) for r in A.each_block(df, "i").collect()) == sorted((r.i, *r.b) for r in walked.collect())


def test_joint_coverage_of_many(spark):
    """Random intervals against every base, over blocks and tiles; segments meet no other segments."""
    rng = random.Random(5)
    data = [("c", s := rng.randrange(400), s + rng.randrange(1, 90), rng.choice("xyz")) for _ in range(70)] + [("d", 4096, 8192, "x"), ("d", 8192, 9000, "x")]
    depth = per_base(data)
    turns = {(c, b) for c, k, b in depth if depth.get((c, k, b - 1), 0) != depth[c, k, b]} | {(c, b + 1) for c, k, b in depth if (c, k, b + 1) not in depth}
    df = spark.createDataFrame(data, INTERVAL)
    for tile in (16, 64, 1 << 14):
        out = joint_coverage(df, "name", tile)
        cut = [(r["chrom"], r["name"], r["start"], r["end"], r["depth"]) for r in out.collect()]
        assert {(c, k, b): d for c, k, s, e, d in cut for b in range(s, e)} == depth and sum(e - s for _, _, s, e, _ in cut) == len(depth)
        assert all((c, s) in turns and (c, e) in turns and not any((c, b) in turns for b in range(s + 1, e)) for c, _, s, e, _ in cut)
    joins = [x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in x]
    assert joins and not any(" < " in x for x in joins)


def test_coverage_finds_edges_without_a_second_sweep(spark):
    df = spark.createDataFrame([("c", 0, 40, "x"), ("c", 3, 9, "y"), ("c", 10, 20, "y")], INTERVAL)
    out = coverage(df, ["name"], 16)
    assert rows(out, "start", "end", "name", "depth") == [(0, 40, "x", 1), (3, 9, "y", 1), (10, 20, "y", 1)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("AS near") == 1 and plan.count("RepartitionByExpression") == 2

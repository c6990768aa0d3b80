"""Interval joins and coverage over half-open intervals (chrom, start, end).

Interval overlap is an equi-join on (chrom, level, bin): both sides are laid on bins, and a pair is kept in the one bin
that holds the larger of the two starts. Long intervals of the right side use a coarser level, so they don't fill many
bins. Catalyst picks the join; nothing is broadcast by hand.

Coverage is a sweep over +1/-1 events in tiles of the chromosome, so no window holds a whole chromosome; segments that
touch a tile's edge are then joined up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BIN = 4096
LEVELS = (1, 64, 4096)
TILE = 1 << 22


def overlap_join(left: DataFrame, right: DataFrame, bin_width: int = BIN, how: str = "inner", levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """Pairs of left and right rows whose intervals overlap by a base or more.

    Both sides have chrom, start and end; right columns come out as r_<name>. how is "inner" or "left_semi" (which
    also makes repeated left rows one). levels: the widths of bins, in units of bin_width. Left rows are laid only on the
    levels that some right interval uses, found by a scalar subquery over the right side; give (1,) to spare it where no
    right interval is longer than some bins. Empty intervals and negative starts overlap nothing.
    """
    right = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns]).where("r_start >= 0 AND r_start < r_end")
    left = left.where("start >= 0 AND start < end")
    widths = [bin_width * k for k in levels]
    level = F.lit(len(levels) - 1)
    for k in reversed(range(len(levels) - 1)):
        level = F.when(F.expr("r_end - r_start") <= 16 * widths[k], k).otherwise(level)
    r = right.withColumn("__r_level", level).withColumn("__w", F.element_at(F.array(*[F.lit(w).cast("long") for w in widths]), F.col("__r_level") + 1))
    r = r.withColumn("__r_bin", F.explode(F.expr("sequence(r_start div __w, (r_end - 1) div __w)"))).drop("__w")
    spots = [F.expr(f"transform(sequence(start div {w}, (end - 1) div {w}), b -> struct({k} AS level, {w}L AS width, b AS bin))") for k, w in enumerate(widths)]
    if len(widths) > 1:
        used = right.select(F.bit_or(F.call_function("shiftleft", F.lit(1), level)).alias("m")).scalar()
        left = left.withColumn("__m", F.coalesce(used, F.lit(0)))
        spots = [F.when(F.col("__m").bitwiseAND(F.lit(1 << k)) != 0, s).otherwise(F.slice(s, 1, 0)) for k, s in enumerate(spots)]
    l = left.withColumn("__x", F.explode(F.concat(*spots))).drop("__m")
    on = (
        (F.col("chrom") == F.col("r_chrom")) & (F.col("__x.level") == F.col("__r_level")) & (F.col("__x.bin") == F.col("__r_bin"))
        & (F.col("start") < F.col("r_end")) & (F.col("r_start") < F.col("end"))
    )
    if how == "left_semi":
        return l.join(r, on, "left_semi").drop("__x").distinct()
    own = F.col("__x.bin") == F.expr("greatest(start, r_start) div __x.width")
    return l.join(r, on & own).drop("__x", "__r_level", "__r_bin")


def overlap_length() -> Column:
    return F.least("end", "r_end") - F.greatest("start", "r_start")


def _cut(intervals: DataFrame, by: list[str], tile: int) -> DataFrame:
    """*by, tile, s, e: the intervals, cut at tile edges."""
    used = intervals.where("start >= 0 AND start < end")
    cut = used.select(*by, "start", "end", F.explode(F.expr(f"sequence(start div {tile}, (end - 1) div {tile})")).alias("tile"))
    return cut.select(*by, "tile", F.greatest("start", F.expr(f"tile * {tile}")).alias("s"), F.least("end", F.expr(f"(tile + 1) * {tile}")).alias("e"))


def _ends(cut: DataFrame, by: list[str]) -> DataFrame:
    """*by, tile, pos, d: where cut intervals begin (1) and end (-1)."""
    return cut.select(*by, "tile", F.explode(F.expr("array(struct(s AS pos, 1 AS d), struct(e AS pos, -1 AS d))")).alias("x")).select(*by, "tile", "x.pos", "x.d")


def _events(intervals: DataFrame, by: list[str], tile: int) -> DataFrame:
    return _ends(_cut(intervals, by, tile), by)


def _across_tiles(runs: DataFrame, by: list[str], tile: int, value: str | None = None, touching: DataFrame | None = None) -> DataFrame:
    """Segments (*by, start, end, value) with those joined up that meet at a tile's edge and have the same value.

    Only segments at an edge, two a tile at most, are in a window of their own keys. touching: runs that hold at least
    those at an edge, where these are cheaper to find than by sweeping all once more.
    """
    cols = ", ".join(by)
    edge = f"(start % {tile} = 0 OR end % {tile} = 0)"
    w = f"PARTITION BY {cols} ORDER BY start"
    same = f" AND lag({value}) OVER ({w}) = {value}" if value else ""
    at_edge = (runs if touching is None else touching).where(edge).withColumn("fresh", F.expr(f"CASE WHEN lag(end) OVER ({w}) = start{same} THEN 0 ELSE 1 END"))
    islands = at_edge.withColumn("island", F.expr(f"sum(fresh) OVER ({w})")).groupBy(*by, "island")
    joined = islands.agg(F.min("start").alias("start"), F.max("end").alias("end"), *([F.first(value).alias(value)] if value else [])).drop("island")
    return runs.where(f"NOT {edge}").unionByName(joined)


def coverage(intervals: DataFrame, keys: list[str], tile: int = TILE) -> DataFrame:
    """Maximal segments of constant depth above 0: chrom, *keys, start, end, depth.

    Intervals are dealt once by key and tile; the sweep for segments at edges sees only those keys and tiles that have an
    interval at one.
    """
    by = ["chrom", *keys]
    w = f"PARTITION BY {', '.join(by)}, tile"
    cut = _cut(intervals, by, tile).repartition(*by, "tile")
    at_edge = cut.withColumn("near", F.expr(f"max(s % {tile} = 0 OR e % {tile} = 0) OVER ({w})")).where("near")

    def runs(part: DataFrame) -> DataFrame:
        steps = _ends(part, by).groupBy(*by, "tile", "pos").agg(F.sum("d").alias("d")).where("d <> 0")
        return steps.selectExpr(*by, "pos AS start", f"lead(pos) OVER ({w} ORDER BY pos) AS end", f"sum(d) OVER ({w} ORDER BY pos) AS depth").where("depth > 0")

    return _across_tiles(runs(cut), by, tile, "depth", runs(at_edge))


def joint_coverage(intervals: DataFrame, key: str, tile: int = TILE) -> DataFrame:
    """Segments cut wherever any key's depth changes: chrom, start, end, key, depth (above 0).

    Segments meet the cuts of their bins in one aggregation, and take them by their places in the bin's sorted array, so
    the work is that of the rows that come out; nothing is compared with all segments of a bin.
    """
    width = max(1, tile // 8192)
    many = max(1, tile // 16 // width)
    own = coverage(intervals, [key], tile).where("chrom IS NOT NULL")
    laid = own.withColumn("bin", F.explode(F.expr(f"sequence(start div {width}, end div {width})"))).withColumn("block", F.expr(f"bin div {many}")).where("block IS NOT NULL").repartition("chrom", "block")
    here = lambda c: F.expr(f"if({c} div {width} = bin, {c}, NULL)")
    # the first cut of the next block in use ends the last piece of a block
    # (the hash of the other columns and the checks for nulls keep both reads of laid the same, so that one exchange serves them)
    firsts = laid.groupBy("chrom", "block").agg(F.min(F.least(here("start"), here("end"))).alias("first"), F.max(F.xxhash64(key, "depth")).alias("h")).where("first IS NOT NULL AND h IS NOT NULL")
    later = firsts.select("chrom", "block", F.expr("lead(first) OVER (PARTITION BY chrom ORDER BY block)").alias("later"))
    cuts = F.sort_array(F.array_union(F.collect_set(here("start")), F.collect_set(here("end"))))
    bins = laid.groupBy("chrom", "block", "bin").agg(cuts.alias("cuts"), F.collect_list(F.struct(F.col(key).alias("key"), "start", "end", "depth")).alias("own")).where("size(cuts) > 0")
    ahead = bins.withColumn("next", F.expr("lead(cuts[0]) OVER (PARTITION BY chrom, block ORDER BY bin)")).join(later, ["chrom", "block"])
    all_cuts = ahead.select("chrom", "bin", F.expr("array_append(cuts, coalesce(next, later))").alias("cuts"), F.expr("cast(size(cuts) AS bigint)").alias("n"), F.explode("own").alias("x"))
    span = all_cuts.select("chrom", "cuts", "x", F.expr(f"if(x.start div {width} = bin, array_position(cuts, x.start), 1L)").alias("i"), F.expr(f"if(x.end div {width} = bin, array_position(cuts, x.end) - 1, n)").alias("j"))
    pieces = span.where("i <= j").select("chrom", "cuts", "x", F.explode(F.expr("sequence(cast(i AS int), cast(j AS int))")).alias("k"))
    return pieces.select("chrom", F.expr("cuts[k - 1]").alias("start"), F.expr("cuts[k]").alias("end"), F.col("x.key").alias(key), F.col("x.depth").alias("depth"))


def merged(intervals: DataFrame, keys: list[str], tile: int = TILE) -> DataFrame:
    """Union of intervals: chrom, *keys, start, end; intervals that touch are one."""
    by = ["chrom", *keys]
    steps = _events(intervals, by, tile).groupBy(*by, "tile", "pos").agg(F.sum("d").alias("d")).where("d <> 0")
    w = f"PARTITION BY {', '.join(by)}, tile ORDER BY pos"
    turns = steps.withColumn("depth", F.expr(f"sum(d) OVER ({w})")).where("depth = 0 OR depth = d")
    runs = turns.selectExpr(*by, "pos AS start", f"lead(pos) OVER ({w}) AS end", "depth").where("depth > 0").drop("depth")
    return _across_tiles(runs, by, tile)


def first_class(intervals: DataFrame, precedence: list[str], tile: int = TILE) -> DataFrame:
    """Disjoint intervals (chrom, start, end, class) that give each base the first of its classes in precedence.

    One sweep with a depth for each class. Intervals are cut at tile edges, and where the class changes.
    """
    ranks = range(len(precedence))
    known = intervals.where(F.col("class").isin(precedence)).select("chrom", "start", "end", "class")
    steps = _events(known, ["chrom", "class"], tile).groupBy("chrom", "tile", "pos").agg(*[F.sum(F.when(F.col("class") == precedence[k], F.col("d")).otherwise(0)).alias(f"d{k}") for k in ranks])
    w = "PARTITION BY chrom, tile ORDER BY pos"
    depth = steps.selectExpr("chrom", "tile", "pos", *[f"sum(d{k}) OVER ({w}) AS d{k}" for k in ranks])
    best = depth.select("chrom", "tile", "pos", F.coalesce(*[F.when(F.col(f"d{k}") > 0, F.lit(precedence[k])) for k in ranks], F.lit(None).cast("string")).alias("class"))
    turns = best.withColumn("before", F.expr(f"lag(class) OVER ({w})")).where("NOT class <=> before")
    return turns.selectExpr("chrom", "pos AS start", f"lead(pos) OVER ({w}) AS end", "class").where("class IS NOT NULL")

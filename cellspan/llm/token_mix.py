"""Mixing sources to target weights by subset-sum budget fitting.

Sources get targets by water-filling: weights share the total, and what a source can't fill (`most_repeats` times its
size) is shared again. A target is met by whole copies of the source and a rest below one copy. For the rest, documents
are counted by exact length; a proportional share of each length is taken, a greedy step brings the remaining budget
down to `knapsack_budget` words, and a bounded-knapsack dynamic programme over the counts left (reachable sums as a bit
set) fits what remains exactly, or as near below as any choice can. Documents of a length are then picked in the order
of a seeded hash, so reruns agree.

Only the table of sources (one row each) comes to the driver. The fit of a source sees its distinct lengths alone, at
most the square root of twice its words. Picking ranks documents within 256 hash ranges of each (source, length), so a
length that many documents share is no single group.

Cases: null text has size 0 and isn't taken; a null source is a source, last in order; null ids and repeated rows are
documents of their own; an empty table gives an empty result. Results replace input columns of the same name.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellspan.llm.common import WORD_SPLIT, cut, documents

ADDED = ["size", "source_size", "target", "taken"]


def cycle_weights(ordinal: int) -> float:
    """1, 2, 3, repeating."""
    return float(ordinal % 3 + 1)


def water_fill(sizes: list[int], weights: list[float], total: float, most_repeats: int) -> list[float]:
    """Shares of total by weight, none above most_repeats times its size."""
    target, open_, rest = [0.0] * len(sizes), list(range(len(sizes))), float(total)
    while open_:
        unit = rest / sum(weights[i] for i in open_)
        over = [i for i in open_ if unit * weights[i] > most_repeats * sizes[i]]
        for i in over or open_:
            target[i] = float(most_repeats * sizes[i]) if over else unit * weights[i]
        if not over:
            break
        rest -= sum(target[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return target


def fit(lengths: list[int], counts: list[int], budget: int, knapsack_budget: int = 1 << 16) -> list[int]:
    """How many documents of each length to take, so that their lengths add up to budget or as near below as possible.

    Above knapsack_budget, the proportional and greedy steps come first; the exact fit is over what they leave.
    """
    total = sum(n * c for n, c in zip(lengths, counts, strict=True))
    if budget >= total:
        return list(counts)
    take = [0] * len(lengths)
    if budget > knapsack_budget:
        take = [c * (budget - knapsack_budget) // total for c in counts]
    rest = budget - sum(n * k for n, k in zip(lengths, take, strict=True))
    by_length = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    for i in by_length:
        k = min(counts[i] - take[i], max(0, rest - knapsack_budget) // lengths[i])
        take[i] += k
        rest -= k * lengths[i]
    reach, mask, steps = 1, (1 << (rest + 1)) - 1, []
    for i in by_length:
        left, part = min(counts[i] - take[i], rest // lengths[i]), 1
        while left > 0 and not reach >> rest & 1:
            k = min(part, left)
            steps.append((i, k, reach))
            reach |= (reach << (k * lengths[i])) & mask
            left, part = left - k, 2 * part
    at = reach.bit_length() - 1
    for i, k, before in reversed(steps):
        if not before >> at & 1:
            take[i] += k
            at -= k * lengths[i]
    return take


def mix_sources(
    docs: DataFrame, weights: Callable[[int], float] = cycle_weights, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    most_repeats: int = 3, knapsack_budget: int = 1 << 16, seed: int = 11, most_sources: int = 1_000_000,
) -> DataFrame:
    """docs without their texts, with size, source_size, target, and taken: the words the mix takes, repeats counted."""
    spark = docs.sparkSession
    keep = [c for c in docs.columns if c != text_col and c.lower() not in ADDED]
    words = F.size(F.array_remove(F.split(F.coalesce(F.col(text_col), F.lit("")), WORD_SPLIT), ""))
    seen = cut(
        docs.select(
            *[F.col(f"`{c}`") for c in keep],
            words.cast("long").alias("__cs_size"),
            F.coalesce(F.concat(F.lit("v"), F.col(source_col)), F.lit("n")).alias("__cs_key"),
            F.xxhash64(F.lit(seed), F.col(id_col)).alias("__cs_h"),
        ).withColumn("__cs_sub", F.shiftrightunsigned("__cs_h", 56).cast("int"))
    )
    sources = seen.groupBy("__cs_key").agg(F.sum("__cs_size").alias("n")).limit(most_sources + 1).collect()
    if len(sources) > most_sources:
        raise ValueError(f"more than {most_sources} sources: group them first")
    sources.sort(key=lambda r: (r[0] == "n", r[0]))
    sizes = [r[1] for r in sources]
    targets = water_fill(sizes, [weights(i) for i in range(len(sizes))], sum(sizes), most_repeats)
    plan = [(r[0], s, t, (copies := int(round(t) // s) if s else 0), round(t) - copies * s) for r, s, t in zip(sources, sizes, targets, strict=True)]
    table = spark.createDataFrame(plan, "__cs_key string, source_size long, target double, __cs_copies long, __cs_rest long")

    def fitted(g: pd.DataFrame) -> pd.DataFrame:
        took = fit(g["__cs_size"].tolist(), g["n"].tolist(), int(g["__cs_rest"].iloc[0]), knapsack_budget)
        return pd.DataFrame({"__cs_key": g["__cs_key"], "__cs_size": g["__cs_size"], "__cs_k": took})

    cells = seen.where("__cs_size > 0").groupBy("__cs_key", "__cs_size", "__cs_sub").agg(F.count(F.lit(1)).alias("n"))
    histogram = cells.groupBy("__cs_key", "__cs_size").agg(F.sum("n").alias("n"))
    chosen = (
        histogram.join(table.where("__cs_rest > 0"), "__cs_key")
        .groupBy("__cs_key")
        .applyInPandas(fitted, "__cs_key string, __cs_size long, __cs_k long")
        .where("__cs_k > 0")
    )
    before = F.expr("coalesce(sum(n) OVER (PARTITION BY __cs_key, __cs_size ORDER BY __cs_sub ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)")
    quota = (
        cells.withColumn("__cs_before", before)
        .join(chosen, ["__cs_key", "__cs_size"])
        .where("__cs_k > __cs_before")
        .select("__cs_key", "__cs_size", "__cs_sub", (F.col("__cs_k") - F.col("__cs_before")).alias("__cs_quota"))
    )
    rank = F.expr(f"row_number() OVER (PARTITION BY __cs_key, __cs_size, __cs_sub ORDER BY __cs_h, `{id_col}`)")
    ranked = seen.join(quota, ["__cs_key", "__cs_size", "__cs_sub"], "left").withColumn("__cs_rank", rank)
    once_more = F.when(F.col("__cs_rank") <= F.coalesce("__cs_quota", F.lit(0)), 1).otherwise(0)
    return ranked.join(table, "__cs_key").select(
        *[F.col(f"`{c}`") for c in keep],
        F.col("__cs_size").alias("size"),
        "source_size",
        "target",
        (F.col("__cs_size") * (F.col("__cs_copies") + once_more)).alias("taken"),
    )


def op4_token_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir).select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")

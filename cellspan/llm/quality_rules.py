"""Quality rules whose cutoffs follow the corpus.

Each document gets integer measures. Per language and source, each measure is gathered in a mergeable quantile sketch:
counts by logarithmic bucket (16 sub-buckets per power of two, relative error 1/16), which merge by addition. The
fence of a measure is the third quartile plus `reach` interquartile ranges plus a slack (mean word length: also a
lower fence). Groups of fewer than `least_group` documents take the merged sketch of their language, and if that is
small too, the one of the whole corpus. Documents are then joined with their group's fences.

All of it is DataFrame code. The measures are cut to a table once, since the sketches and the filter both need them.

Cases: null text counts as empty (no words, base_failed). Null language or source is a group of its own. Repeated rows
are judged each. An empty table gives an empty result. Extra input columns are kept out of the way: only `id_col` and
the columns below are returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellspan.llm.common import WORD_SPLIT, cut, documents

#: measure -> (has a lower fence, slack)
MEASURES = {"symbol_pm": (False, 100), "dup_line_pm": (False, 500), "repeat_pm": (False, 300), "mean_len_pc": (True, 150)}


def measured(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """id, group keys, and the measures of each document's whole text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    split = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.concat(F.lit("v"), F.col(lang_col)), F.lit("n")).alias("l_key"),
        F.coalesce(F.concat(F.lit("v"), F.col(source_col)), F.lit("n")).alias("s_key"),
        text.alias("text"),
        F.array_remove(F.split(text, WORD_SPLIT), "").alias("words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t-\r]")).alias("lines"),
    )
    counted = split.select(
        "id", "l_key", "s_key",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr("slice(transform(words, (w, i) -> xxhash64(w, get(words, i + 1), get(words, i + 2))), 1, greatest(size(words) - 2, 0))").alias("h"),
    )
    repeats = counted.withColumn(
        "sorted", F.expr("CASE WHEN size(array_distinct(h)) < size(h) THEN sort_array(transform(h, (x, i) -> struct(x AS x, i AS i))) END")
    ).drop("h")
    starts = repeats.withColumn(
        "starts",
        F.expr("sort_array(transform(filter(sorted, (s, j) -> coalesce(s.x = get(sorted, j - 1).x, false) OR coalesce(s.x = get(sorted, j + 1).x, false)), s -> s.i))"),
    ).drop("sorted")
    covered = F.expr(
        "coalesce(aggregate(starts, named_struct('n', 0L, 'last', -3), (a, i) -> named_struct('n', a.n + least(3, i - a.last), 'last', i), a -> a.n), 0L)"
    )
    done = starts.withColumn("n_repeat_words", covered).drop("starts")
    per = lambda a, b, k: F.when(F.col(b) > 0, F.expr(f"({k} * {a}) div {b}")).otherwise(F.lit(0).cast("long"))
    return done.withColumns(
        {
            "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
            "symbol_pm": per("n_symbols", "word_chars", 1000),
            "dup_line_pm": per("n_dup_lines", "n_lines", 1000),
            "repeat_pm": per("n_repeat_words", "n_words", 1000),
            "mean_len_pc": per("word_chars", "n_words", 100),
        }
    )


def bucket(v: Column) -> Column:
    """The sketch's bucket of a non-negative integer."""
    e = F.length(F.bin(v)) - 5
    return F.when(v < 16, v).otherwise(e * 16 + F.call_function("shiftright", v, e)).cast("int")


def bucket_top(b: str) -> str:
    """SQL for the largest value of a bucket."""
    return f"CASE WHEN {b} < 32 THEN CAST({b} AS BIGINT) ELSE shiftleft(CAST({b} - 16 * ({b} div 16 - 1) + 1 AS BIGINT), {b} div 16 - 1) - 1 END"


def sketches(rows: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Bucket counts by group and measure; they merge by summing n."""
    melted = rows.select(*keys, F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), bucket(F.col(m)).alias("b")) for m in measures])).alias("x"))
    return melted.groupBy(*keys, "x.measure", "x.b").agg(F.count(F.lit(1)).alias("n"))


def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Group size and quartiles by group and measure."""
    by = ", ".join([*keys, "measure"])
    run = sketch.withColumns(
        {"upto": F.expr(f"sum(n) OVER (PARTITION BY {by} ORDER BY b)"), "total": F.expr(f"sum(n) OVER (PARTITION BY {by})")}
    )
    return run.groupBy(*keys, "measure").agg(
        F.max("total").alias("total"),
        F.expr(f"min(CASE WHEN 100 * upto >= 25 * total THEN {bucket_top('b')} END)").alias("q1"),
        F.expr(f"min(CASE WHEN 100 * upto >= 75 * total THEN {bucket_top('b')} END)").alias("q3"),
    )


def fences(rows: DataFrame, least_group: int, reach: int) -> DataFrame:
    """low and high of each measure for each group."""
    fine = sketches(rows.where("NOT base_failed"), ["l_key", "s_key"], list(MEASURES))
    merged = lambda keys: fine.groupBy(*keys, "measure", "b").agg(F.sum("n").alias("n"))
    own = quartiles(fine, ["l_key", "s_key"])
    lang = quartiles(merged(["l_key"]), ["l_key"]).select("l_key", "measure", *[F.col(c).alias(f"l_{c}") for c in ("total", "q1", "q3")])
    whole = quartiles(merged([]), []).select("measure", *[F.col(c).alias(f"w_{c}") for c in ("q1", "q3")])
    both = own.join(lang, ["l_key", "measure"]).join(whole, "measure")
    pick = lambda q: F.when(F.col("total") >= least_group, F.col(q)).when(F.col("l_total") >= least_group, F.col(f"l_{q}")).otherwise(F.col(f"w_{q}"))
    q = both.select("l_key", "s_key", "measure", pick("q1").alias("q1"), pick("q3").alias("q3"))
    slack = F.create_map(*[F.lit(x) for m, (_, s) in MEASURES.items() for x in (m, s)])[F.col("measure")]
    q = q.withColumns({"high": F.col("q3") + reach * (F.col("q3") - F.col("q1")) + slack, "low": F.col("q1") - reach * (F.col("q3") - F.col("q1")) - slack})
    return q.groupBy("l_key", "s_key").agg(
        *[F.max(F.when(F.col("measure") == m, F.col(end))).alias(f"{m}_{end}") for m, (both_ends, _) in MEASURES.items() for end in (["high", "low"] if both_ends else ["high"])]
    )


def judge_quality(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
    least_group: int = 200, reach: int = 3,
) -> DataFrame:
    """id, counts, base_failed, kept, and the measures behind them; one row per input row."""
    rows = cut(measured(docs, id_col, text_col, lang_col, source_col))
    joined = rows.join(fences(rows, least_group, reach), ["l_key", "s_key"], "left")
    inside = F.lit(True)
    for m, (both_ends, _) in MEASURES.items():
        inside &= F.coalesce(F.col(m) <= F.col(f"{m}_high"), F.lit(True))
        if both_ends:
            inside &= F.coalesce(F.col(m) >= F.col(f"{m}_low"), F.lit(True))
    return joined.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & inside).alias("kept"), *MEASURES,
    )


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(documents(spark, sf_dir)).drop(*MEASURES)


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce('v' || lang, 'n') AS lk, coalesce('v' || source, 'n') AS sk, coalesce(text, '') AS text
  FROM documents
), t AS (
  SELECT rid, doc_id, lk, sk, text,
         list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
         list_filter(string_split(text, chr(10)), lambda w: regexp_matches(w, '[^\x20\x09-\x0D]')) AS lines
  FROM d
), w3 AS (
  SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
  FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM t WHERE len(words) >= 3)
), again AS (
  SELECT rid, i FROM w3 QUALIFY count(*) OVER (PARTITION BY rid, g) > 1
), covered AS (
  SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM again) GROUP BY rid
), m AS (
  SELECT t.rid, doc_id, lk, sk, len(words)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
         len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM t LEFT JOIN covered ON t.rid = covered.rid
), f AS (
  SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
         CASE WHEN word_chars > 0 THEN 1000 * n_symbols // word_chars ELSE 0 END AS symbol_pm,
         CASE WHEN n_lines > 0 THEN 1000 * n_dup_lines // n_lines ELSE 0 END AS dup_line_pm,
         CASE WHEN n_words > 0 THEN 1000 * n_repeat_words // n_words ELSE 0 END AS repeat_pm,
         CASE WHEN n_words > 0 THEN 100 * word_chars // n_words ELSE 0 END AS mean_len_pc
  FROM m
), melted AS (
  SELECT lk, sk, measure, CASE WHEN v < 16 THEN v ELSE (length(bin(v)) - 5) * 16 + (v >> (length(bin(v)) - 5)) END AS b
  FROM (SELECT lk, sk, unnest(['symbol_pm', 'dup_line_pm', 'repeat_pm', 'mean_len_pc']) AS measure,
               unnest([symbol_pm, dup_line_pm, repeat_pm, mean_len_pc]) AS v FROM f WHERE NOT base_failed)
), leveled AS (
  SELECT 0 AS lvl, lk, sk, measure, b FROM melted
  UNION ALL SELECT 1, lk, '', measure, b FROM melted
  UNION ALL SELECT 2, '', '', measure, b FROM melted
), runs AS (
  SELECT lvl, lk, sk, measure, b, sum(count(*)) OVER (PARTITION BY lvl, lk, sk, measure ORDER BY b) AS upto,
         sum(count(*)) OVER (PARTITION BY lvl, lk, sk, measure) AS total
  FROM leveled GROUP BY lvl, lk, sk, measure, b
), q AS (
  SELECT lvl, lk, sk, measure, max(total) AS total,
         min(CASE WHEN 100 * upto >= 25 * total THEN CASE WHEN b < 32 THEN b ELSE ((b - 16 * (b // 16 - 1) + 1) << (b // 16 - 1)::INT) - 1 END END) AS q1,
         min(CASE WHEN 100 * upto >= 75 * total THEN CASE WHEN b < 32 THEN b ELSE ((b - 16 * (b // 16 - 1) + 1) << (b // 16 - 1)::INT) - 1 END END) AS q3
  FROM runs GROUP BY lvl, lk, sk, measure
), picked AS (
  SELECT a.lk, a.sk, a.measure,
         CASE WHEN a.total >= 200 THEN a.q1 WHEN l.total >= 200 THEN l.q1 ELSE w.q1 END AS q1,
         CASE WHEN a.total >= 200 THEN a.q3 WHEN l.total >= 200 THEN l.q3 ELSE w.q3 END AS q3,
         CASE a.measure WHEN 'symbol_pm' THEN 100 WHEN 'mean_len_pc' THEN 150 WHEN 'dup_line_pm' THEN 500 ELSE 300 END AS slack
  FROM q a JOIN q l ON l.lvl = 1 AND l.lk = a.lk AND l.measure = a.measure JOIN q w ON w.lvl = 2 AND w.measure = a.measure
  WHERE a.lvl = 0
), g AS (
  SELECT lk, sk,
         max(CASE WHEN measure = 'symbol_pm' THEN q3 + 3 * (q3 - q1) + slack END) AS sy,
         max(CASE WHEN measure = 'dup_line_pm' THEN q3 + 3 * (q3 - q1) + slack END) AS du,
         max(CASE WHEN measure = 'repeat_pm' THEN q3 + 3 * (q3 - q1) + slack END) AS re,
         max(CASE WHEN measure = 'mean_len_pc' THEN q3 + 3 * (q3 - q1) + slack END) AS hi,
         max(CASE WHEN measure = 'mean_len_pc' THEN q1 - 3 * (q3 - q1) - slack END) AS lo
  FROM picked GROUP BY lk, sk
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(symbol_pm <= sy, true) AND coalesce(dup_line_pm <= du, true) AND coalesce(repeat_pm <= re, true)
       AND coalesce(mean_len_pc <= hi, true) AND coalesce(mean_len_pc >= lo, true) AS kept
FROM f LEFT JOIN g ON f.lk = g.lk AND f.sk = g.sk
"""

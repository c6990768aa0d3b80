"""Quality classification with hierarchical empirical Bayes over sites.

A logistic regression over `FEATURES` of a document's whole text is fitted on a bounded, seeded sample of labelled
documents (`sample_docs`). Its probability is a document's own evidence; its log odds are bounded by `evidence_cap`, so
that a fit to separable labels can't outvote every site. Labels, and the evidence where there is no label, are summed by
path (site and path columns) and by site. Each site's rate is shrunk toward the global rate, and each path's toward its
site's, by Beta priors. Their strengths come from the spread of the rates beyond what sampling explains (analysis of
variance: the mean square between groups less the one within), so sites of few documents, and sites that differ no more
than chance makes them, stay near their parents. A document's own label or evidence is left out of the rates it is
judged by. Its score adds its own log odds to those of its path, relative to the global ones.

Features are computed where texts are read; after that only numbers move. Sums by path are partial first, so a hot
site costs no more than others.

Cases: null text has no words and its features are zeros. Null sites and paths are groups of their own. Documents
without labels take part; without any usable labels every evidence is 0.5. Repeated rows are scored each; labels that
are repeated are averaged. An empty table gives an empty result. Only the columns named in the result are returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellspan.llm.common import cut, documents, mix, pieces, text_bytes, words_of

FEATURES = ["log_words", "word_length", "symbols", "upper", "digits", "distinct", "repeat_pairs", "repeat_lines", "high_bytes", "short"]
_SYMBOL, _UPPER, _DIGIT = (np.zeros(256, bool) for _ in range(3))
_SYMBOL[[ord(c) for c in "#*$%&|<>{}[]=_\\^~!@"]] = True
_UPPER[65:91] = True
_DIGIT[48:58] = True


def features(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows x FEATURES of texts, each between 0 and about 1."""
    n = len(offsets) - 1
    start, end, row, h = words_of(buf, offsets, lower=True)
    words = np.bincount(row, minlength=n)
    some = np.maximum(words, 1)
    size = np.maximum(np.diff(offsets), 1)

    def share(mask: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(buf) + 1, np.int64)
        np.cumsum(mask[buf], out=sums[1:])
        return (sums[offsets[1:]] - sums[offsets[:-1]]) / size

    def repeats(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
        order = np.lexsort((values, rows))
        v, r = values[order], rows[order]
        again = (v[1:] == v[:-1]) & (r[1:] == r[:-1])
        return np.bincount(r[1:][again], minlength=n) / np.maximum(np.bincount(rows, minlength=n), 1)

    pairs = h[:-1] * np.uint64(3) + h[1:] if len(h) > 1 else h[:0]
    same = row[:-1] == row[1:] if len(h) > 1 else np.zeros(0, bool)
    brk = np.append(buf == 10, True)[end] if len(end) else np.zeros(0, bool)
    line = np.cumsum(brk) - brk
    edge = np.flatnonzero(np.append((line[1:] != line[:-1]) | (row[1:] != row[:-1]), True)) if len(h) else np.zeros(0, np.int64)
    first = np.append(0, edge[:-1] + 1) if len(edge) else edge
    first_of = np.repeat(first, edge - first + 1)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mix(h + (np.arange(len(h)) - first_of).astype(np.uint64)), out=sums[1:])
    lines = sums[edge + 1] - sums[first] if len(edge) else h[:0]
    high = np.zeros(256, bool)
    high[128:] = True
    return np.stack(
        [
            np.log1p(words) / 8, np.bincount(row, end - start, minlength=n) / some / 10, share(_SYMBOL) * 5, share(_UPPER) * 2, share(_DIGIT) * 5,
            1 - repeats(h, row), repeats(pairs[same], row[:-1][same]) if len(pairs) else np.zeros(n),
            repeats(lines, row[edge]) if len(edge) else np.zeros(n), share(high), (words < 50) * 1.0,
        ], axis=1,
    )


def described(docs: DataFrame) -> DataFrame:
    """(id, site, path, x) of rows (id, site, path, text)."""
    kinds = [docs.schema[c].dataType.simpleString() for c in ("id", "site", "path")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = text_bytes(batch.column(3))
            for i, j in pieces(off):
                x = features(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[i:j] for c in range(3)), lists], names=["id", "site", "path", "x"])

    return docs.mapInArrow(run, f"id {kinds[0]}, site {kinds[1]}, path {kinds[2]}, x array<double>")


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Weights and bias of a ridge-penalised logistic regression, by Newton's method."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w, eye = np.zeros(x.shape[1]), np.eye(x.shape[1]) * ridge
    eye[-1, -1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + eye, x.T @ (p - y) + eye @ w)
    return w


def strength(mu: float, squares: float, parents: float, groups: float, n: int, n_parents: int, n_groups: int, spare: float, most: float = 1e6) -> float:
    """The Beta prior's strength for groups within parents: mu (1 - mu) / variance between - 1, from 1 to most.

    squares is the sum of squared values; parents and groups are the sums of (sum squared / size) by parent and by group;
    spare is n less the sum over parents of (sum of squared group sizes / parent size).
    """
    if n_groups <= n_parents or spare <= 0:
        return most
    whole = max(1e-12, squares / n - mu * mu)
    within = (squares - groups) / (n - n_groups) if n > n_groups else whole * n / max(1, n - 1)
    between = ((groups - parents) / (n_groups - n_parents) - within) * (n_groups - n_parents) / spare
    return float(min(most, max(1.0, mu * (1 - mu) / between - 1))) if between > 1e-9 else most


def judge_sites(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", path_col: str = "lang", label_col: str = "quality",
    sample_docs: int = 20_000, seed: int = 9, threshold: float = 0.5, evidence_cap: float = 8.0,
) -> DataFrame:
    """id, evidence, site_rate and path_rate (without the row itself), score and kept of each row."""
    known = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.avg(label_col).alias("y"))
    slim = docs.select(F.col(id_col).alias("id"), F.col(site_col).alias("site"), F.col(path_col).alias("path"), F.col(text_col).alias("text"))
    rows = cut(described(slim).join(known, "id", "left"))
    n = rows.where("y IS NOT NULL").count()
    share = int(min(1.0, sample_docs / max(1, n)) * (1 << 30))
    train = rows.where("y IS NOT NULL").where(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 30)) < share).select("x", "y").limit(2 * sample_docs).collect()
    w = fit(np.array([r[0] for r in train]), np.array([r[1] for r in train])) if train else np.zeros(len(FEATURES) + 1)
    linear = sum((F.col("x")[i] * F.lit(float(v)) for i, v in enumerate(w[:-1])), F.lit(float(w[-1])))
    bounded = F.greatest(F.lit(-evidence_cap), F.least(F.lit(evidence_cap), linear))
    own = rows.select("id", F.coalesce(F.concat(F.lit("v"), F.col("site").cast("string")), F.lit("n")).alias("s"), F.coalesce(F.concat(F.lit("v"), F.col("path").cast("string")), F.lit("n")).alias("p"), "y", bounded.alias("z"))
    own = own.withColumn("evidence", 1 / (1 + F.exp(-F.col("z")))).withColumn("v", F.coalesce("y", "evidence"))
    paths = cut(own.groupBy("s", "p").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("k"), F.sum(F.col("v") * F.col("v")).alias("q")))
    sites = paths.groupBy("s").agg(F.sum("n").alias("sn"), F.sum("k").alias("sk"), F.sum("q").alias("sq"), F.sum(F.col("n") * F.col("n")).alias("squares"), F.count(F.lit(1)).alias("n_paths"))
    sums = sites.agg(
        F.sum("sn").alias("n"), F.sum("sk").alias("k"), F.sum("sq").alias("q"), F.count(F.lit(1)).alias("sites"), F.sum("n_paths").alias("paths"),
        F.sum(F.col("sk") * F.col("sk") / F.col("sn")).alias("site_part"), F.sum(F.col("sn") * F.col("sn")).alias("site_squares"), F.sum(F.col("squares") / F.col("sn")).alias("path_squares"),
    ).first()
    path_part = paths.agg(F.sum(F.col("k") * F.col("k") / F.col("n"))).first()[0]
    total = sums.n or 1
    mu = (sums.k or 0.0) / total
    m_site = m_path = 0.0
    if sums.n:
        m_site = strength(mu, sums.q, sums.k**2 / total, sums.site_part, total, 1, sums.sites, total - sums.site_squares / total)
        m_path = strength(mu, sums.q, sums.site_part, path_part, total, sums.sites, sums.paths, total - sums.path_squares)
    joined = own.join(paths.join(sites.select("s", "sn", "sk"), "s").select("s", "p", "n", "k", "sn", "sk"), ["s", "p"])
    joined = joined.withColumn("site_rate", (F.col("sk") - F.col("v") + m_site * mu) / (F.col("sn") - 1 + m_site))
    joined = joined.withColumn("path_rate", (F.col("k") - F.col("v") + m_path * F.col("site_rate")) / (F.col("n") - 1 + m_path))
    clip = lambda c: F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), c))
    odds = lambda c: F.log(clip(c) / (1 - clip(c)))
    score = 1 / (1 + F.exp(-(F.col("z") + odds(F.col("path_rate")) - odds(F.lit(mu)))))
    out = joined.withColumn("score", score)
    return out.select(F.col("id").alias(id_col), "evidence", "site_rate", "path_rate", "score", (F.col("score") >= threshold).alias("kept"))


def op6_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_sites(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))

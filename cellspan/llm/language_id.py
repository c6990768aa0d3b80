"""Language identification by compression.

For each language, a raw-content zstandard dictionary is made from a bounded, seeded sample of labelled rows: of
`sample_docs` different texts at most, each from a seeded place, an equal share of `dictionary_bytes` (`sample_chars`
characters at most). Texts are compared by their letters: ASCII is lower-cased, and what else is in ASCII becomes single spaces. A text
is cut into blocks of `block_bytes`, each block is compressed with each language's dictionary, and the sums over the
whole text are compared: the smallest wins. If the runner-up needs less than `least_margin` more bytes
(as a share of what the dictionaries save at best), the result is `rejected`.

The dictionaries are a few hundred KB whatever the corpus size; texts are compressed where they are read, so nothing
is shuffled.

Cases: null text or text without a letter is `und` with score 0 and rejected. Ties go to the language that is first in
code-point order. Where nothing can be learned, every text is `und`. Repeated rows are judged each; an empty table
gives an empty result. Results are added to the input's columns, and replace input columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellspan.llm.common import documents, text_bytes

_LETTER = regex.compile(r"\p{L}")
_PLAIN = np.full(256, 32, np.uint8)
_PLAIN[97:123] = _PLAIN[65:91] = np.arange(97, 123)
_PLAIN[128:] = np.arange(128, 256)
ADDED = ["lang_pred", "score", "rejected"]


def held_out(id_col: Column) -> Column:
    """Whether a row is kept out of training: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))


def learn(
    train: DataFrame, text_col: str = "text", lang_col: str = "lang", seed: int = 7,
    sample_docs: int = 300, sample_chars: int = 2000, dictionary_bytes: int = 110_000,
) -> dict[str, bytes]:
    """A dictionary for each language of the training rows, from a seeded sample bounded by the parameters."""
    rows = train.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(lang_col).alias("l"), F.col(text_col).alias("t"), F.pmod(F.xxhash64(F.lit(seed), text_col), F.lit(1 << 40)).alias("h"))
    counts = dict(rows.where("t <> ''").groupBy("l").agg(F.approx_count_distinct("h", 0.02)).collect())
    if not counts:
        return {}
    share = F.create_map(*[F.lit(x) for l, n in counts.items() for x in (l, int(min(1.0, 2 * sample_docs / max(1, n)) * (1 << 40)))])[F.col("l")]
    picked = (
        rows.where("t <> ''").where(F.col("h") < share)
        .select("l", "h", F.expr(f"substring(t, CAST(1 + h % greatest(1, length(t) - {sample_chars} + 1) AS INT), {sample_chars})").alias("s"))
        .dropDuplicates(["l", "h"])
    )
    by: dict[str, list[tuple[int, str]]] = {}
    for l, h, s in picked.collect():
        by.setdefault(l, []).append((h, s))
    each = lambda v: max(1, dictionary_bytes // min(len(v), sample_docs) - 1)
    return {l: b"\n".join(s.encode()[: each(v)] for _, s in sorted(v)[:sample_docs]) for l, v in sorted(by.items())}


def letters(buf: np.ndarray) -> bytes:
    """The bytes that are compared."""
    plain = _PLAIN[buf]
    keep = np.ones(len(plain), bool)
    keep[1:] = (plain[1:] != 32) | (plain[:-1] != 32)
    return plain[keep].tobytes()


class Sizes:
    """Compressed sizes of a text under each dictionary."""

    def __init__(self, dictionaries: dict[str, bytes], block_bytes: int):
        self.block = block_bytes
        self.langs = list(dictionaries)
        self.with_dict = []
        how = zstandard.ZstdCompressionParameters.from_level(
            5, min_match=3, strategy=zstandard.STRATEGY_GREEDY, write_content_size=False, write_checksum=False, write_dict_id=False
        )
        for raw in dictionaries.values():
            d = zstandard.ZstdCompressionDict(letters(np.frombuffer(raw, np.uint8)), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=how)
            self.with_dict.append(zstandard.ZstdCompressor(dict_data=d, compression_params=how))

    def of(self, raw: bytes) -> list[int]:
        blocks = [raw[i : i + self.block] for i in range(0, len(raw), self.block)]
        return [sum(len(c.compress(b)) for b in blocks) for c in self.with_dict]


def identify(
    docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text", least_margin: float = 0.01, block_bytes: int = 4096,
) -> DataFrame:
    """docs with lang_pred, score (the winner's margin over the runner-up, 0 to 1) and rejected."""
    keep = [c for c in docs.columns if c.lower() not in ADDED]
    schema = T.StructType([*(docs.select(*keep).schema.fields), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    at, langs = docs.columns.index(text_col), list(dictionaries)
    keep_at = [docs.columns.index(c) for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(dictionaries, block_bytes)
        for batch in batches:
            buf, off = text_bytes(batch.column(at))
            pred, score, rejected = [], [], []
            for i in range(batch.num_rows):
                part = buf[off[i] : off[i + 1]]
                if not langs or not _LETTER.search(part.tobytes().decode("utf-8", "replace")):
                    pred.append("und"), score.append(0.0), rejected.append(True)
                    continue
                s = sizes.of(letters(part))
                order = sorted(range(len(s)), key=lambda k: (s[k], langs[k]))
                margin = (s[order[1]] - s[order[0]]) / max(1, s[order[1]]) if len(s) > 1 else 1.0
                pred.append(langs[order[0]]), score.append(margin), rejected.append(margin < least_margin)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in keep_at), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                names=[f.name for f in schema.fields],
            )

    return docs.mapInArrow(run, schema)


def learned_from(docs: DataFrame, **options) -> dict[str, bytes]:
    """Dictionaries from the rows that held_out() leaves."""
    return learn(docs.where(~held_out(F.col("doc_id"))), **options)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    slim = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return identify(slim, learned_from(docs)).select("doc_id", "held_out", "lang_pred", "score", "rejected")

"""Every query over the derived tables, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellspan.functions import alignment as A
from cellspan.functions.intervals import joint_coverage, merged
from cellspan.operators import cells as C
from cellspan.operators import fragments as G
from cellspan.operators import post as P
from cellspan.operators import regions as R
from cellspan.plans import fixtures as X
from cellspan.sources import text as S
from cellspan.streaming import events as E

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: What the SQL of several queries begins with: all rows (h), QC-passing fragments (f), listed barcodes (bc).
BASE = r"""
WITH RECURSIVE h AS (
  SELECT 'Q:' || l_orderkey || ':' || l_partkey || ':' || l_suppkey || ':' || l_linenumber || ':0:0:BC' || lpad(l_suppkey::VARCHAR, 5, '0') AS qname,
         'chr' || (l_partkey % 5 + 1) AS chrom, l_orderkey * 10 + l_linenumber * 7 AS fs,
         l_orderkey * 10 + l_linenumber * 7 + floor(l_quantity)::BIGINT * 8 + 60 AS fe,
         'BC' || lpad(l_suppkey::VARCHAR, 5, '0') AS barcode, (l_partkey % 61) AS mapq, l_linenumber AS ln, l_suppkey AS sk, l_orderkey AS ok, l_partkey AS pk,
         CASE WHEN l_discount > 0.085 THEN 1024 ELSE 0 END + CASE WHEN l_tax > 0.075 THEN 256 ELSE 0 END
         + CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' AND l_linenumber = 7 THEN 12 ELSE 0 END AS x
  FROM lineitem
), f AS (SELECT *, fe - fs AS len FROM h WHERE mapq >= 30 AND x = 0
), al AS (
  SELECT *, 99 + x AS flag, fs + 1 AS pos, fe - 49 AS pnext, fe - fs AS tlen, (((ok * 20000 + pk) * 1000 + sk) * 8 + ln) * 2 AS rec_id FROM h
  UNION ALL SELECT *, 147 + x, fe - 49, fs + 1, fs - fe, (((ok * 20000 + pk) * 1000 + sk) * 8 + ln) * 2 + 1 FROM h
), bc AS (SELECT 'BC' || lpad(s_suppkey::VARCHAR, 5, '0') AS barcode, s_suppkey AS sk, 'G' || s_nationkey AS grp, (s_nationkey % 5)::VARCHAR AS cluster FROM supplier
), reg AS (
  SELECT 'chr' || (p_partkey % 5 + 1) AS chrom, p_partkey * 75 AS rs, p_partkey * 75 + p_size * 10 AS re, 'peak' || p_partkey AS name, p_partkey % 4 AS cls FROM part
), tss AS (
  SELECT 'chr' || (p_partkey % 5 + 1) AS chrom, p_partkey * 75 AS ts, CASE WHEN (p_partkey // 10) % 2 = 0 THEN '+' ELSE '-' END AS strand FROM part WHERE p_partkey % 10 = 0
), blk AS (
  SELECT 'chr' || (p_partkey % 5 + 1) AS chrom, p_partkey * 75 AS bs, p_partkey * 75 + p_size * 7 AS be,
         'F' || ((p_partkey // 10) * 5 + p_partkey % 5) AS feature, CASE WHEN (p_partkey // 10) % 2 = 0 THEN '+' ELSE '-' END AS strand FROM part
), bases AS (  -- every base of every feature, with its bin of 100 (of 10: bin10)
  SELECT chrom, feature, base, CASE WHEN strand = '-' THEN total - 1 - o ELSE o END * 100 // total AS bin, CASE WHEN strand = '-' THEN total - 1 - o ELSE o END * 10 // total AS bin10
  FROM (SELECT chrom, feature, strand, base, row_number() OVER (PARTITION BY feature ORDER BY base) - 1 AS o, count(*) OVER (PARTITION BY feature) AS total
        FROM (SELECT chrom, feature, strand, unnest(range(bs, be)) AS base FROM blk))
)"""


def query(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def sweep(source: str, keys: str) -> str:
    """SQL for maximal segments of constant depth of source (keys, s, e)."""
    return f""", ev AS (SELECT {keys}, s AS pos, 1 AS d FROM ({source}) UNION ALL SELECT {keys}, e, -1 FROM ({source})
), st AS (SELECT {keys}, pos, sum(d) AS d FROM ev GROUP BY ALL HAVING sum(d) <> 0
), runs AS (SELECT {keys}, pos AS start, lead(pos) OVER (PARTITION BY {keys} ORDER BY pos) AS "end", (sum(d) OVER (PARTITION BY {keys} ORDER BY pos))::BIGINT AS depth FROM st)"""


@query("fragments", BASE + ' SELECT chrom, fs + 4 AS start, fe - 5 AS "end", barcode, 1::BIGINT AS count FROM f')
def fragments(spark: SparkSession, sf: str) -> DataFrame:
    return G.fragments_file(X.pairs(spark, sf))


@query("sort_fragments", BASE + ' SELECT chrom, fs + 4 AS start, fe - 5 AS "end", barcode, 1::BIGINT AS count FROM f ORDER BY ALL')
def sort_fragments(spark: SparkSession, sf: str) -> DataFrame:
    return G.sorted_fragments(fragments(spark, sf))


@query("barcode_count", BASE + " SELECT barcode, count(*) AS n FROM f GROUP BY barcode HAVING count(*) >= 20")
def barcode_count(spark: SparkSession, sf: str) -> DataFrame:
    return G.barcode_counts(X.pairs(spark, sf), least=20)


@query("barcode_count_whitelist", BASE + " SELECT barcode, count(*) AS n FROM f WHERE sk % 2 = 0 GROUP BY barcode HAVING count(*) >= 20")
def barcode_count_whitelist(spark: SparkSession, sf: str) -> DataFrame:
    return G.barcode_counts(X.pairs(spark, sf), least=20, whitelist=X.barcodes(spark, sf).where("s_suppkey % 2 = 0"))


@query("barcode_match", BASE + " SELECT regexp_replace(qname, 'BC[0-9]+$', 'GX' || lpad((sk * 7 % 100000)::VARCHAR, 5, '0') || '-1') AS qname, flag, pos FROM al WHERE sk % 2 = 0")
def barcode_match(spark: SparkSession, sf: str) -> DataFrame:
    lists = X.barcodes(spark, sf).where("s_suppkey % 2 = 0")
    table = G.translation(lists, lists.selectExpr("line", "concat('GX', lpad(cast(s_suppkey * 7 % 100000 AS string), 5, '0')) AS barcode"))
    return G.match_field(X.alignments(spark, sf), "qname", table, A.NAME_DELIMITER, A.NAME_FIELD, "-1").select("qname", "flag", "pos")


@query("barcode_match_tag", BASE + " SELECT qname, flag, 'CB:Z:GX' || lpad((sk * 7 % 100000)::VARCHAR, 5, '0') AS tag FROM al WHERE sk % 2 = 0")
def barcode_match_tag(spark: SparkSession, sf: str) -> DataFrame:
    lists = X.barcodes(spark, sf).where("s_suppkey % 2 = 0")
    table = G.translation(lists, lists.selectExpr("line", "concat('GX', lpad(cast(s_suppkey * 7 % 100000 AS string), 5, '0')) AS barcode"))
    return G.match_tag(X.alignments(spark, sf), table, "CB", rewrite=True).select("qname", "flag", F.col("tags")[0].alias("tag"))


@query("filter_alignments", BASE + " SELECT qname, flag, pos FROM al WHERE mapq >= 30 AND x = 0 AND sk % 3 = 0")
def filter_alignments(spark: SparkSession, sf: str) -> DataFrame:
    return G.filter_alignments(X.alignments(spark, sf), X.barcodes(spark, sf).where("s_suppkey % 3 = 0"), min_mapq=30).select("qname", "flag", "pos")


@query("name_to_tag", BASE + " SELECT qname, flag, 'XB:Z:' || barcode || '-1' AS tag FROM al")
def name_to_tag(spark: SparkSession, sf: str) -> DataFrame:
    return G.name_to_tag(X.alignments(spark, sf), tag="XB", suffix="-1").select("qname", "flag", F.element_at("tags", -1).alias("tag"))


@query("sam_text", BASE + r""" SELECT rec_id, concat_ws(chr(9), qname, flag, chrom, pos, mapq, (['50M', '20M5D25M', '10S40M10N', '25M2I25M'])[ln % 4 + 1], '=', pnext, tlen, '*', '*',
  'CB:Z:' || barcode, 'UB:Z:' || (ok % 97)) AS line FROM al""")  # fmt: skip
def sam_text(spark: SparkSession, sf: str) -> DataFrame:
    return S.sam_lines(X.alignments(spark, sf))


_FLAG = lambda m, n: f"coalesce(sum(CASE WHEN {m} THEN 1 ELSE 0 END), 0)::BIGINT AS {n}"
_FLAGSTAT = ", ".join(
    _FLAG(m, n)
    for n, m in {
        "total": "a.flag IS NOT NULL", "primary": "a.flag & 2304 = 0", "secondary": "a.flag & 256 > 0", "supplementary": "a.flag & 2048 > 0", "duplicates": "a.flag & 1024 > 0",
        "mapped": "a.flag & 4 = 0", "primary_mapped": "a.flag & 2308 = 0", "paired": "a.flag & 1 > 0", "read_1": "a.flag & 64 > 0", "read_2": "a.flag & 128 > 0",
        "properly_paired": "a.flag & 2 > 0 AND a.flag & 4 = 0", "both_mapped": "a.flag & 12 = 0", "singletons": "a.flag & 4 = 0 AND a.flag & 8 > 0",
    }.items()
).replace("AS primary,", "AS \"primary\",")
_FLAGS = BASE + f", fl AS (SELECT bc.barcode, {_FLAGSTAT} FROM bc LEFT JOIN (SELECT * FROM al WHERE mapq >= 30) a ON a.barcode = bc.barcode GROUP BY bc.barcode)"


@query("flagstat", _FLAGS + " SELECT * FROM fl")
def flagstat(spark: SparkSession, sf: str) -> DataFrame:
    return C.flagstat(X.alignments(spark, sf), X.barcodes(spark, sf), min_mapq=30)


_RATIOS = _FLAGS + """, ra AS (SELECT barcode, primary_mapped::DOUBLE / nullif("primary", 0) AS mapped, duplicates::DOUBLE / nullif("primary", 0) AS duplicates,
  properly_paired::DOUBLE / nullif("primary", 0) AS properly_paired, singletons::DOUBLE / nullif("primary", 0) AS singletons FROM fl)"""


@query("flagstat_ratios", _RATIOS + " SELECT * FROM ra")
def flagstat_ratios(spark: SparkSession, sf: str) -> DataFrame:
    return P.flagstat_ratios(flagstat(spark, sf))


_LONG = _RATIOS + ", lo AS (UNPIVOT ra ON mapped, duplicates, properly_paired, singletons INTO NAME name VALUE value)"


@query("cluster_quartiles", _LONG + """ SELECT name, cluster, min(value) AS low, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
  quantile_cont(value, 0.75) AS q3, max(value) AS high, count(*) AS n FROM lo JOIN bc USING (barcode) GROUP BY name, cluster""")  # fmt: skip
def cluster_quartiles(spark: SparkSession, sf: str) -> DataFrame:
    return P.cluster_quartiles(P.long_form(flagstat_ratios(spark, sf)), X.clusters(spark, sf))


@query("ratio_histogram", _LONG + " SELECT name, floor(value / 0.125) * 0.125 AS bin, count(*) AS n FROM lo GROUP BY ALL")
def ratio_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return P.histogram(P.long_form(flagstat_ratios(spark, sf)), 0.125)


_LEN = BASE + ", lc AS (SELECT barcode, len AS length, count(*) AS n FROM f WHERE len BETWEEN 1 AND 600 GROUP BY ALL), grid AS (SELECT unnest(range(1, 601)) AS length)"


@query("frag_len_cell", _LEN + """ SELECT bc.barcode, grid.length, coalesce(n, 0) AS n, coalesce(n, 0)::DOUBLE / nullif((sum(n) OVER (PARTITION BY bc.barcode)), 0)::DOUBLE AS fraction
  FROM bc CROSS JOIN grid LEFT JOIN lc ON lc.barcode = bc.barcode AND lc.length = grid.length""")  # fmt: skip
def frag_len_cell(spark: SparkSession, sf: str) -> DataFrame:
    listed = X.barcodes(spark, sf)
    return C.length_distribution(C.length_counts(X.pairs(spark, sf), listed), listed)


@query("frag_len_sample", _LEN + """ SELECT length, coalesce(sum(n), 0)::BIGINT AS n, coalesce(sum(n), 0)::DOUBLE / (SELECT sum(n) FROM lc)::DOUBLE AS fraction FROM grid LEFT JOIN lc USING (length) GROUP BY length""")
def frag_len_sample(spark: SparkSession, sf: str) -> DataFrame:
    return C.length_of_sample(C.length_counts(X.pairs(spark, sf), X.barcodes(spark, sf)))


@query("frag_len_window", _LEN + " SELECT * FROM lc WHERE length BETWEEN 100 AND 200")
def frag_len_window(spark: SparkSession, sf: str) -> DataFrame:
    return P.length_window(C.length_counts(X.pairs(spark, sf), X.barcodes(spark, sf)), 100, 200)


@query("frag_len_grouping_sets", _LEN + " SELECT barcode, length, sum(n)::BIGINT AS n FROM lc GROUP BY GROUPING SETS ((barcode, length), (length))")
def frag_len_grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    return C.length_two_levels(X.pairs(spark, sf), X.barcodes(spark, sf))


_ONE = BASE + ", one AS (SELECT qname, f.barcode, min(name) AS name FROM f JOIN reg ON f.chrom = reg.chrom AND fs < re AND rs < fe WHERE len <= 1024 GROUP BY ALL HAVING count(DISTINCT name) = 1)"


@query("region_count_matrix", _ONE + " SELECT name, barcode, count(*) AS n FROM one GROUP BY ALL")
def region_count_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return R.region_counts(X.pairs(spark, sf), X.regions(spark, sf), X.barcodes(spark, sf), levels=(1,))


@query("peak_matrix", BASE + """, hits AS (SELECT name, barcode, count(*) AS n FROM f JOIN reg ON f.chrom = reg.chrom AND fs < re AND rs < fe GROUP BY ALL),
  nm AS (SELECT name FROM hits GROUP BY name HAVING count(*) >= 3), ce AS (SELECT barcode FROM hits GROUP BY barcode HAVING count(*) >= 10)
  SELECT * FROM hits WHERE name IN (SELECT name FROM nm) AND barcode IN (SELECT barcode FROM ce)""")  # fmt: skip
def peak_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return R.any_overlap_counts(X.pairs(spark, sf), X.regions(spark, sf), least_cells=3, least_peaks=10)


@query("in_region", BASE + """ SELECT bc.barcode, count(f.qname) AS total, count(CASE WHEN EXISTS (SELECT 1 FROM reg WHERE reg.chrom = f.chrom AND f.fs < re + 50 AND greatest(0, rs - 50) < f.fe) THEN 1 END) AS in_region
  FROM bc LEFT JOIN f ON f.barcode = bc.barcode GROUP BY bc.barcode""")  # fmt: skip
def in_region(spark: SparkSession, sf: str) -> DataFrame:
    return R.in_region(X.pairs(spark, sf), X.regions(spark, sf), X.barcodes(spark, sf), flank=50)


_BLOCKS = """SELECT chrom, barcode, pos - 1 AS s, pos - 1 + (CASE ln % 4 WHEN 0 THEN 50 WHEN 1 THEN 20 WHEN 2 THEN 40 ELSE 50 END) AS e FROM al WHERE mapq >= 30 AND x = 0
  UNION ALL SELECT chrom, barcode, pos + 24, pos + 49 FROM al WHERE mapq >= 30 AND x = 0 AND ln % 4 = 1"""


@query("base_coverage", BASE + sweep(_BLOCKS, "chrom, barcode") + ' SELECT chrom, barcode, start, "end", depth FROM runs WHERE depth > 0')
def base_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return R.base_coverage(X.alignments(spark, sf), X.barcodes(spark, sf), min_mapq=30)


_JOINT = """, own AS (SELECT * FROM runs WHERE depth > 0), cuts AS (SELECT DISTINCT chrom, start AS pos FROM own UNION SELECT chrom, "end" FROM own),
  parts AS (SELECT chrom, pos AS a, lead(pos) OVER (PARTITION BY chrom ORDER BY pos) AS b FROM cuts)
  SELECT parts.chrom, a AS start, b AS "end", {key}, depth FROM parts JOIN own ON own.chrom = parts.chrom AND own.start <= a AND b <= own."end" """


@query("base_coverage_joint", BASE + sweep(_BLOCKS, "chrom, barcode") + _JOINT.format(key="barcode"))
def base_coverage_joint(spark: SparkSession, sf: str) -> DataFrame:
    return R.base_coverage(X.alignments(spark, sf), X.barcodes(spark, sf), joint=True, min_mapq=30)


_FC = BASE + sweep("SELECT chrom, barcode, fs AS s, fe AS e FROM f", "chrom, barcode")


@query("fragment_coverage", _FC + ' SELECT chrom, barcode, start, "end", depth FROM runs WHERE depth > 0')
def fragment_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return R.fragment_coverage(X.pairs(spark, sf), X.barcodes(spark, sf))


@query("fragment_coverage_joint", _FC + _JOINT.format(key="barcode"))
def fragment_coverage_joint(spark: SparkSession, sf: str) -> DataFrame:
    return joint_coverage(G.only_listed(X.pairs(spark, sf), X.barcodes(spark, sf)), "barcode")


_PB = BASE + ", pb AS (SELECT f.*, grp FROM f JOIN bc USING (barcode) WHERE len <= 300 AND EXISTS (SELECT 1 FROM reg WHERE reg.chrom = f.chrom AND f.fs < re AND rs < f.fe))"


@query("pseudobulk_coverage", _PB + sweep("SELECT chrom, grp, fs AS s, fe AS e FROM pb", "chrom, grp") + ' SELECT chrom, grp AS "group", start, "end", depth FROM runs WHERE depth > 0')
def pseudobulk_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return R.pseudobulk_coverage(_touching(spark, sf))


@query("pseudobulk_coverage_joint", _PB + sweep("SELECT chrom, grp, fs AS s, fe AS e FROM pb", "chrom, grp") + _JOINT.format(key='grp AS "group"'))
def pseudobulk_coverage_joint(spark: SparkSession, sf: str) -> DataFrame:
    return R.pseudobulk_coverage(_touching(spark, sf), joint=True)


def _touching(spark: SparkSession, sf: str) -> DataFrame:
    return R.pseudobulk_fragments(X.pairs(spark, sf), X.groups(spark, sf), X.regions(spark, sf), most=300)


@query("pseudobulk_counts", _PB + ' SELECT grp AS "group", count(*) AS fragments, sum(len)::BIGINT AS bases FROM pb GROUP BY grp')
def pseudobulk_counts(spark: SparkSession, sf: str) -> DataFrame:
    return R.pseudobulk_counts(_touching(spark, sf))


_AT = """, ar AS (SELECT barcode, CASE WHEN strand = '-' THEN 500 - (j - ts) ELSE j - ts + 500 END AS o
  FROM (SELECT barcode, ts, strand, unnest(range(greatest(fs, ts - 500), least(fe, ts + 501))) AS j FROM f JOIN tss ON f.chrom = tss.chrom AND fs < ts + 501 AND greatest(0, ts - 500) < fe WHERE len BETWEEN 1 AND 1000)),
  n AS (SELECT {sample} AS barcode, o, count(*) AS n FROM ar GROUP BY ALL),
  raw AS (SELECT b.barcode, g.o AS "offset", coalesce(n.n, 0)::BIGINT AS n FROM {samples} b CROSS JOIN (SELECT unnest(range(0, 1001)) AS o) g LEFT JOIN n ON n.barcode = b.barcode AND n.o = g.o),
  nf AS (SELECT barcode, sum(CASE WHEN "offset" < 100 OR "offset" > 900 THEN n ELSE 0 END)::BIGINT AS norm_factor FROM raw GROUP BY barcode),
  en AS (SELECT barcode, "offset", coalesce(n::DOUBLE / nullif(norm_factor, 0)::DOUBLE, 0) AS enrichment FROM raw JOIN nf USING (barcode))"""
_TSS = BASE + _AT.format(sample="barcode", samples="bc")


def _tss_counts(spark: SparkSession, sf: str) -> DataFrame:
    return R.tss_counts(X.pairs(spark, sf), X.tss(spark, sf), X.barcodes(spark, sf), flank=500)


@query("tss_raw", _TSS + " SELECT * FROM raw")
def tss_raw(spark: SparkSession, sf: str) -> DataFrame:
    return _tss_counts(spark, sf)


@query("tss_norm_factor", _TSS + " SELECT * FROM nf")
def tss_norm_factor(spark: SparkSession, sf: str) -> DataFrame:
    return R.tss_norm_factor(_tss_counts(spark, sf), 500)


@query("tss_enrichment", _TSS + " SELECT * FROM en")
def tss_enrichment(spark: SparkSession, sf: str) -> DataFrame:
    return R.tss_enrichment(_tss_counts(spark, sf), 500)


@query("tss_score", _TSS + " SELECT barcode, max(enrichment) AS score FROM en GROUP BY barcode")
def tss_score(spark: SparkSession, sf: str) -> DataFrame:
    return R.tss_score(tss_enrichment(spark, sf))


@query("tss_by_cluster", _TSS + """, sc AS (SELECT barcode, max(enrichment) AS score FROM en GROUP BY barcode), q AS (SELECT quantile_cont(score, 0.01) AS a, quantile_cont(score, 0.99) AS b FROM sc)
  SELECT barcode, cluster, score, least(greatest(score, a), b) AS limited FROM sc JOIN bc USING (barcode) CROSS JOIN q""")  # fmt: skip
def tss_by_cluster(spark: SparkSession, sf: str) -> DataFrame:
    return P.tss_by_cluster(tss_score(spark, sf), X.clusters(spark, sf))


@query("tss_bulk", BASE + _AT.format(sample="'bulk'", samples="(SELECT 'bulk' AS barcode)") + " SELECT * FROM en")
def tss_bulk(spark: SparkSession, sf: str) -> DataFrame:
    samples = spark.createDataFrame([("bulk",)], "barcode string")
    return R.tss_enrichment(R.tss_counts(R.bulk(X.pairs(spark, sf), "bulk"), X.tss(spark, sf), samples, flank=500), 500)


_MG = BASE + """, fb AS (SELECT qname, grp, chrom, unnest(range(fs, fe)) AS base FROM f JOIN bc USING (barcode) WHERE len <= 1024),
  mg AS (SELECT grp AS "group", feature, bin10::INT AS bin, count(*) AS bases FROM fb JOIN bases USING (chrom, base) GROUP BY ALL)"""


def _metagene(spark: SparkSession, sf: str) -> DataFrame:
    return R.metagene(X.pairs(spark, sf), X.groups(spark, sf), X.blocks(spark, sf), bins=10)


@query("metagene", _MG + """ SELECT g.grp AS "group", e.feature, b.bin::INT AS bin, coalesce(mg.bases, 0)::BIGINT AS bases FROM (SELECT DISTINCT grp FROM bc) g CROSS JOIN (SELECT DISTINCT feature FROM blk) e
  CROSS JOIN (SELECT unnest(range(10)) AS bin) b LEFT JOIN mg ON mg."group" = g.grp AND mg.feature = e.feature AND mg.bin = b.bin""")  # fmt: skip
def metagene(spark: SparkSession, sf: str) -> DataFrame:
    return R.metagene_filled(_metagene(spark, sf), X.groups(spark, sf), X.blocks(spark, sf), bins=10)


@query("metagene_norm", _MG + """, s AS (SELECT grp, count(*) AS a, sum(len) AS b, count(CASE WHEN len <= 1024 THEN 1 END) AS c, sum(CASE WHEN len <= 1024 THEN len ELSE 0 END) AS d FROM f JOIN bc USING (barcode) GROUP BY grp),
  r AS (SELECT grp, count(DISTINCT qname) AS e, count(*) AS g FROM fb WHERE (chrom, base) IN (SELECT (chrom, base) FROM bases) GROUP BY grp)
  SELECT s.grp AS "group", a AS all_fragments, b::BIGINT AS all_bases, c AS length_fragments, d::BIGINT AS length_bases, coalesce(e, 0) AS region_fragments, coalesce(g, 0) AS region_bases FROM s LEFT JOIN r USING (grp)""")  # fmt: skip
def metagene_norm(spark: SparkSession, sf: str) -> DataFrame:
    return R.metagene_normalization(X.pairs(spark, sf), X.groups(spark, sf), X.blocks(spark, sf))


@query("metagene_bpm", _MG + """ SELECT "group", bin, avg(bpm) AS bpm FROM (SELECT *, 1e6 * bases::DOUBLE / (sum(bases) OVER (PARTITION BY "group"))::DOUBLE AS bpm FROM mg) WHERE feature <> 'F0' GROUP BY ALL""")
def metagene_bpm(spark: SparkSession, sf: str) -> DataFrame:
    return P.metagene_profile(_metagene(spark, sf), features=X.blocks(spark, sf).select("feature").distinct().where("feature <> 'F0'"))


_GB = BASE + """, rd AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY rec_id) AS r FROM al WHERE mapq >= 30 AND flag & 2308 = 0),
  n AS (SELECT barcode, bin, count(*) AS n FROM rd JOIN bases ON bases.chrom = rd.chrom AND bases.base = rd.pos - 1 WHERE r = 1 GROUP BY ALL)
  SELECT bc.barcode, g.bin::INT AS bin, coalesce(n.n, 0)::BIGINT AS n FROM bc CROSS JOIN (SELECT unnest(range(100)) AS bin) g LEFT JOIN n ON n.barcode = bc.barcode AND n.bin = g.bin"""


def _reads(spark: SparkSession, sf: str, umi: str | None) -> DataFrame:
    passed = X.alignments(spark, sf).where(A.passes_qc(30, A.GEX_REQUIRE, A.GEX_EXCLUDE)).withColumn("barcode", A.tag_value("CB"))
    return G.first_seen(passed, umi)


@query("genebody", _GB.format(key="rec_id"))
def genebody(spark: SparkSession, sf: str) -> DataFrame:
    return R.genebody(_reads(spark, sf, None), X.blocks(spark, sf), X.barcodes(spark, sf))


@query("genebody_umi", _GB.format(key="barcode, ok % 97"))
def genebody_umi(spark: SparkSession, sf: str) -> DataFrame:
    return R.genebody(_reads(spark, sf, "UB"), X.blocks(spark, sf), X.barcodes(spark, sf))


@query("genebody_percent", _GB.format(key="rec_id").replace("  SELECT bc.barcode", "  , z AS (SELECT bc.barcode") + ") SELECT *, 100 * n::DOUBLE / nullif(sum(n) OVER (PARTITION BY barcode), 0)::DOUBLE AS percent FROM z")
def genebody_percent(spark: SparkSession, sf: str) -> DataFrame:
    return P.row_percent(genebody(spark, sf), "n")


_NAMES = "(['pc_cds', 'pc_utr', 'pc_intron', 'lncRNA'])[cls + 1]"


_ATAC = BASE + f""", hit AS (SELECT qname, barcode, len, {_NAMES} AS class, sum(least(fe, re) - greatest(fs, rs)) AS b FROM f JOIN reg ON f.chrom = reg.chrom AND fs < re AND rs < fe GROUP BY ALL),
  every AS (SELECT * FROM hit UNION ALL SELECT qname, barcode, len, 'intergenic', len FROM f WHERE qname NOT IN (SELECT qname FROM hit))"""


@query("atac_features", _ATAC + "  SELECT barcode, class, count(*) AS n, avg(len) AS mean_length, sum(b)::BIGINT AS bases FROM every GROUP BY ALL")
def atac_features(spark: SparkSession, sf: str) -> DataFrame:
    return C.atac_features(X.pairs(spark, sf), X.regions(spark, sf), X.barcodes(spark, sf))


@query("atac_percent", _ATAC + ", ac AS (SELECT barcode, class, count(*) AS n FROM every GROUP BY ALL) SELECT barcode, class, n, 100 * n::DOUBLE / nullif(total, 0)::DOUBLE AS percent FROM ac JOIN (SELECT barcode, count(*) AS total FROM f GROUP BY barcode) USING (barcode)")
def atac_percent(spark: SparkSession, sf: str) -> DataFrame:
    found = C.atac_composition(X.pairs(spark, sf), X.regions(spark, sf), X.barcodes(spark, sf))
    return P.row_percent(found, "n", "total").select("barcode", "class", "n", "percent")


@query("atac_length_by_cluster", _ATAC + """, ml AS (SELECT barcode, class AS name, avg(len) AS value FROM every GROUP BY ALL)
  SELECT name, cluster, min(value) AS low, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3, max(value) AS high, count(*) AS n FROM ml JOIN bc USING (barcode) GROUP BY name, cluster""")  # fmt: skip
def atac_length_by_cluster(spark: SparkSession, sf: str) -> DataFrame:
    long = atac_features(spark, sf).select("barcode", F.col("class").alias("name"), F.col("mean_length").alias("value"))
    return P.cluster_quartiles(long, X.clusters(spark, sf))


_GEX = BASE + f""", cl AS (SELECT chrom, base, min(cls) AS cls FROM (SELECT chrom, cls, unnest(range(rs, re)) AS base FROM reg) GROUP BY ALL),
  bl AS (SELECT barcode, chrom, unnest(range(s, e)) AS base FROM ({_BLOCKS.replace("x = 0", "x & 260 = 0")})),
  gx AS (SELECT barcode, coalesce({_NAMES}, 'intergenic') AS class, count(*) AS bases FROM bl LEFT JOIN cl USING (chrom, base) GROUP BY ALL)"""


@query("gex_features", _GEX + " SELECT * FROM gx")
def gex_features(spark: SparkSession, sf: str) -> DataFrame:
    return C.gex_features(_reads(spark, sf, None), X.regions(spark, sf), X.barcodes(spark, sf))


_UMI = _GEX.replace("  bl AS (", """  du AS (SELECT *, row_number() OVER (PARTITION BY barcode, ok % 97 ORDER BY rec_id) AS r FROM al WHERE mapq >= 30 AND x & 260 = 0),
  bl AS (""").replace("FROM al WHERE mapq >= 30 AND x & 260 = 0\n", "FROM du WHERE r = 1\n").replace("FROM al WHERE mapq >= 30 AND x & 260 = 0 AND ln", "FROM du WHERE r = 1 AND ln")


@query("gex_features_umi", _UMI + " SELECT * FROM gx")
def gex_features_umi(spark: SparkSession, sf: str) -> DataFrame:
    return C.gex_features(_reads(spark, sf, "UB"), X.regions(spark, sf), X.barcodes(spark, sf))


@query("feature_percent", _GEX + " SELECT barcode, class, bases, 100 * bases::DOUBLE / (sum(bases) OVER (PARTITION BY barcode))::DOUBLE AS percent FROM gx")
def feature_percent(spark: SparkSession, sf: str) -> DataFrame:
    return P.row_percent(gex_features(spark, sf), "bases")


_MM = BASE + """, sb AS (SELECT barcode, chrom, fs - fs % 50 AS site, substr('ATGC', ln % 4 + 1, 1) AS base, count(*) AS n FROM f GROUP BY ALL),
  dp AS (SELECT barcode, chrom, site, sum(n) AS depth FROM sb GROUP BY ALL),
  ms AS (SELECT sb.barcode, sb.chrom, sb.site, base, n::DOUBLE / depth::DOUBLE AS vaf FROM sb JOIN dp USING (barcode, chrom, site)
         QUALIFY row_number() OVER (PARTITION BY sb.barcode, sb.chrom, sb.site ORDER BY n DESC, strpos('ATGC', base)) = 1)"""


@query("mismatch_sites", _MM + " SELECT * FROM ms WHERE vaf >= 0.5")
def mismatch_sites(spark: SparkSession, sf: str) -> DataFrame:
    return C.mismatch_sites(*X.mismatch_counts(spark, sf), least_share=0.5)


@query("mismatch_jaccard", _MM + """, z AS (SELECT barcode, count(*) AS size FROM ms GROUP BY barcode), i AS (SELECT a.barcode AS a, b.barcode AS b, count(*) AS i FROM ms a JOIN ms b USING (chrom, site, base) WHERE a.barcode < b.barcode GROUP BY ALL)
  SELECT i.a, i.b, i::DOUBLE / (x.size + y.size - i)::DOUBLE AS jaccard FROM i JOIN z x ON x.barcode = i.a JOIN z y ON y.barcode = i.b""")  # fmt: skip
def mismatch_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return C.mismatch_jaccard(C.mismatch_sites(*X.mismatch_counts(spark, sf)), width=50)


@query("mismatch_extraction", BASE + """ SELECT barcode, chrom, pos - 1 + CASE WHEN rec_id % 4 < 2 THEN 20 ELSE 10 END AS site, CASE WHEN rec_id % 4 < 2 THEN 'A' ELSE 'G' END AS base, count(*) AS n
  FROM al WHERE mapq >= 30 AND x & 4 = 0 GROUP BY ALL""")  # fmt: skip
def mismatch_extraction(spark: SparkSession, sf: str) -> DataFrame:
    hit, _ = C.mismatches(X.substituted(spark, sf), min_mapq=30)
    return hit.groupBy("barcode", "chrom", "site", "base").agg(F.count(F.lit(1)).alias("n"))


@query("merge_intervals", BASE + """, m AS (SELECT chrom, rs, re, max(re) OVER (PARTITION BY chrom ORDER BY rs, re ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM reg),
  g AS (SELECT chrom, rs, re, sum(CASE WHEN before >= rs THEN 0 ELSE 1 END) OVER (PARTITION BY chrom ORDER BY rs, re) AS i FROM m)
  SELECT chrom, min(rs) AS start, max(re) AS "end" FROM g GROUP BY chrom, i""")  # fmt: skip
def merge_intervals(spark: SparkSession, sf: str) -> DataFrame:
    return merged(X.regions(spark, sf), [])


@query("exon_blocks", BASE + """, e AS (SELECT 'chr' || (p_partkey % 5 + 1) AS chrom, p_partkey * 75 AS rs, p_partkey * 75 + p_size * 7 AS re, CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand, 'g' || (p_partkey // 30) AS gene FROM part),
  m AS (SELECT *, max(re) OVER (PARTITION BY chrom, strand ORDER BY rs, re ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e),
  g AS (SELECT *, sum(CASE WHEN before >= rs THEN 0 ELSE 1 END) OVER (PARTITION BY chrom, strand ORDER BY rs, re) AS i FROM m)
  SELECT chrom, min(rs) AS start, max(re) AS "end", strand, min(gene) AS gene FROM g GROUP BY chrom, strand, i HAVING count(DISTINCT gene) = 1""")  # fmt: skip
def exon_blocks(spark: SparkSession, sf: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf}/part.parquet")
    exons = parts.selectExpr("concat('chr', p_partkey % 5 + 1) AS chrom", "p_partkey * 75 AS start", "p_partkey * 75 + p_size * 7 AS end", "if(p_partkey % 2 = 0, '+', '-') AS strand", "concat('g', p_partkey div 30) AS gene")
    return P.exon_blocks(exons)


@query("mark_duplicates", BASE + """, d AS (SELECT qname, barcode, chrom, fs - fs % 400 AS s, fe - fe % 400 AS e, mapq FROM f)
  SELECT qname, row_number() OVER (PARTITION BY barcode, chrom, s, e ORDER BY mapq DESC, qname) > 1 AS duplicate FROM d""")  # fmt: skip
def mark_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    quality = F.expr("cast(split(qname, ':')[2] AS bigint) % 61")
    coarse = X.pairs(spark, sf).withColumns({"start": F.expr("start - start % 400"), "end": F.expr("end - end % 400"), "quality": quality})
    return G.mark_duplicates(coarse).select("qname", "duplicate")


@query("merge_sublibraries", BASE + " SELECT 'lib' || (1 + CASE WHEN sk % 2 = 0 THEN 0 ELSE 1 END) || '_' || barcode AS barcode, count(*) AS n FROM f GROUP BY ALL")
def merge_sublibraries(spark: SparkSession, sf: str) -> DataFrame:
    counts = G.barcode_counts(X.pairs(spark, sf), least=1)
    odd = F.substring("barcode", 3, 5).cast("long") % 2
    return P.merge_sublibraries([counts.where(odd == 0), counts.where(odd == 1)], ["lib1", "lib2"])


@query("reverse_complement", "SELECT p_partkey, reverse(translate(regexp_replace(p_name, '[^ACGTacgt]', 'N', 'g'), 'ACGTacgt', 'TGCAtgca')) AS rc FROM part")
def reverse_complement(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", A.reverse_complement(F.col("p_name")).alias("rc"))


@query("fastq_barcode", "SELECT p_partkey AS rec_id, '@1:N:0:' || lpad(p_partkey::VARCHAR, 6, '0')[1:2] || '+' || lpad(p_partkey::VARCHAR, 6, '0')[3:] || ' R' || p_partkey || ' ' AS name, p_name AS seq, p_name AS qual FROM part")
def fastq_barcode(spark: SparkSession, sf: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf}/part.parquet")
    reads = parts.selectExpr("p_partkey AS rec_id", "concat('@R', p_partkey, ' 1:N:0') AS name", "p_name AS seq", "p_name AS qual")
    codes = parts.selectExpr("p_partkey AS rec_id", "'x' AS name", "lpad(cast(p_partkey AS string), 6, '0') AS seq", "'' AS qual")
    return P.fastq_with_barcode(reads, codes, column=1, split=2)


@query("randhex_collapse", """WITH c AS (SELECT 'g' || (l_partkey % 50) AS feature, 'CCCCCC' || lpad((l_linenumber)::VARCHAR, 2, '0') AS third, 'BBBBBB' || lpad((l_orderkey % 5)::VARCHAR, 2, '0') AS second, l_suppkey % 8 AS k FROM lineitem),
  b AS (SELECT feature, third, second, k % 4 AS k, count(*) AS n FROM c GROUP BY ALL)
  SELECT feature, lpad((k + 1)::VARCHAR, 2, '0') || '_' || lpad((second[7:]::INT + 10)::VARCHAR, 2, '0') || '_' || lpad((third[7:]::INT + 20)::VARCHAR, 2, '0') AS cell, 's' || (k % 2) AS sample, n FROM b""")  # fmt: skip
def randhex_collapse(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr(
        "concat('g', l_partkey % 50) AS feature",
        "concat('CCCCCC', lpad(cast(l_linenumber AS string), 2, '0'), 'BBBBBB', lpad(cast(l_orderkey % 5 AS string), 2, '0'), 'AAAAAA', lpad(cast(l_suppkey % 8 AS string), 2, '0')) AS barcode",
    )
    primers = spark.range(8).selectExpr("id + 1 AS line", "concat('AAAAAA', lpad(cast(id AS string), 2, '0')) AS sequence", "concat('W', id % 4) AS well", "if(id < 4, 'T', 'R') AS kind")
    two = spark.range(5).selectExpr("2 AS position", "concat('BBBBBB', lpad(cast(id AS string), 2, '0')) AS sequence", "id + 10 AS index")
    three = spark.range(10).selectExpr("3 AS position", "concat('CCCCCC', lpad(cast(id AS string), 2, '0')) AS sequence", "id + 20 AS index")
    samples = spark.range(4).selectExpr("concat('W', id) AS well", "concat('s', id % 2) AS sample")
    counts = rows.groupBy("feature", "barcode").agg(F.count(F.lit(1)).alias("n"))
    return P.randhex_collapse(counts, primers, two.unionByName(three), samples)


@query("sample_contingency", "SELECT 'W' || (l_suppkey % 8 % 4) AS well, 's' || (l_suppkey % 4 % 2) AS sample, count(*) AS n FROM lineitem GROUP BY ALL")
def sample_contingency(spark: SparkSession, sf: str) -> DataFrame:
    cells = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr("concat('W', l_suppkey % 8 % 4) AS well", "concat('s', l_suppkey % 4 % 2) AS sample")
    return P.contingency(cells, "well", "sample")


@query("coordinate_sort", BASE + " SELECT qname, flag, chrom AS rname, pos::INT AS pos FROM al ORDER BY chrom, pos, rec_id")
def coordinate_sort(spark: SparkSession, sf: str) -> DataFrame:
    return P.coordinate_sorted(X.alignments(spark, sf)).select("qname", "flag", "rname", "pos")


@query("stream_event_counts", "SELECT time_bucket(INTERVAL 1 hour, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_event_counts(spark: SparkSession, sf: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf}/events*.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return E.run_once(E.windowed_counts(stream, "ts", ["event_type"]), "cellspan_event_counts").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("stream_first_seen", "SELECT user_id, event_type, count(DISTINCT 1) AS n FROM events GROUP BY ALL")
def stream_first_seen(spark: SparkSession, sf: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf}/events*.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    once = E.first_seen(stream, "ts", ["user_id", "event_type"], delay="3650 days").select("user_id", "event_type", F.lit(1).cast("long").alias("n"))
    return E.run_once(once, "cellspan_first_seen", "append")

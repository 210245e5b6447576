"""All queries of the engine's own operators, by name, with the SQL that DuckDB runs for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import seq as sq
from ..operators import align, asm, bases, coverage, epiread, fastq, fragments, kmers, methbed, pileup, readqc, scan, seeds
from ..sinks import text as sink
from ..sources import bam, sequences, store
from ..sources import fixtures as fx
from ..sources import genome as gn
from . import oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, *needs: str):
    """Registers a query; ``sql`` may use the common tables that it ``needs``."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = oracle.with_tables(sql, *needs) if needs else sql
        return f

    return add


# -- genome --------------------------------------------------------------------------------------------------------


@query("genome_cpg_sites", "SELECT chrom, pos1 - 1 AS beg0, pos1 + 1 AS \"end\" FROM site WHERE ref = 'C' AND substr(five, 4, 1) = 'G'", "site")
def genome_cpg_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gn.cpg_sites(fx.genome(spark, sf_dir))


@query("gc_windows", """SELECT chrom, k * 100 AS beg0, (k + 1) * 100 AS "end", length(w) - length(translate(w, 'GC', '')) AS gc FROM
 (SELECT chrom, k, substr(seq, k * 100 + 1, 100) AS w FROM (SELECT chrom, seq, CAST(unnest(range(0, length(seq) // 100)) AS BIGINT) AS k FROM genome))""", "genome")
def gc_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gn.gc_windows(fx.genome(spark, sf_dir))


@query("aligned_columns", "SELECT rid, op, col, qpos, rpos, qb, bq, rb, five FROM px", "px")
def aligned_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = bases.with_slice(fx.alignments(spark, sf_dir), fx.genome(spark, sf_dir))
    return bases.columns(reads, ("rid",)).drop("pos1", "sid")


@query("read_filter_pass", "SELECT rid, chrom, pos1, mapq, cigar, seq FROM kept", "kept")
def read_filter_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bases.keep_reads(fx.alignments(spark, sf_dir)).select("rid", "chrom", "pos1", "mapq", "cigar", "seq")


# -- pileup --------------------------------------------------------------------------------------------------------

oracle.define("coded", """SELECT *, CASE WHEN bss = 0 AND qb = 'T' THEN 'Y' WHEN bss = 1 AND qb = 'A' THEN 'R' ELSE qb END AS code,
 CASE WHEN bss = 0 AND rb = 'C' AND qb = 'C' OR bss = 1 AND rb = 'G' AND qb = 'G' THEN 'R' WHEN bss = 0 AND rb = 'C' AND qb = 'T' OR bss = 1 AND rb = 'G' AND qb = 'A' THEN 'C' ELSE 'N' END AS meth FROM good""", "good")
_N = ", ".join(f"count(*) FILTER (code = '{b}') AS n_{b}" for b in "ACGTYR")
oracle.define("plp0", f"SELECT chrom, rpos AS pos1, sid, count(*) FILTER (meth = 'R') AS n_ret, count(*) FILTER (meth = 'C') AS n_conv, {_N} FROM coded GROUP BY ALL", "coded")
_Z = ", ".join(f"coalesce(n_{b}, 0) AS n_{b}" for b in ("ret", "conv", *"ACGTYR"))
oracle.define("plp", f"""SELECT chrom, pos1, sid, ref, five, dp, {_Z} FROM (SELECT chrom, rpos AS pos1, sid, any_value(rb) AS ref, any_value(five) AS five, count(*) AS dp FROM base WHERE rb <> 'N' GROUP BY chrom, rpos, sid)
 LEFT JOIN plp0 USING (chrom, pos1, sid)""", "base", "plp0")
oracle.define("red0", """SELECT *, sum(n_A) OVER s AS t_a, sum(n_C) OVER s AS t_c, sum(n_G) OVER s AS t_g, sum(n_T) OVER s AS t_t FROM plp WINDOW s AS (PARTITION BY chrom, pos1)""", "plp")
oracle.define("red1", """SELECT *, (ref = 'T' OR t_t > 0) AND t_c = 0 AND ref <> 'C' AS y2t, (ref = 'C' OR t_c > 0) AND t_t = 0 AND ref <> 'T' AS y2c,
 (ref = 'A' OR t_a > 0) AND t_g = 0 AND ref <> 'G' AS r2a, (ref = 'G' OR t_g > 0) AND t_a = 0 AND ref <> 'A' AS r2g FROM red0""", "red0")
oracle.define("red", """SELECT chrom, pos1, sid, ref, five, dp, n_ret, n_conv, n_A + CASE WHEN r2a THEN n_R ELSE 0 END AS n_A, n_C + CASE WHEN y2c THEN n_Y ELSE 0 END AS n_C, n_G + CASE WHEN r2g THEN n_R ELSE 0 END AS n_G,
 n_T + CASE WHEN y2t THEN n_Y ELSE 0 END AS n_T, CASE WHEN y2t OR y2c THEN 0 ELSE n_Y END AS n_Y, CASE WHEN r2a OR r2g THEN 0 ELSE n_R END AS n_R,
 CASE WHEN n_A + n_C + n_G + n_T + n_Y + n_R = 0 THEN '.' ELSE
 concat(CASE WHEN ref = 'A' AND n_A > 0 THEN 'A' || n_A WHEN ref = 'C' AND n_C > 0 THEN 'C' || n_C WHEN ref = 'G' AND n_G > 0 THEN 'G' || n_G WHEN ref = 'T' AND n_T > 0 THEN 'T' || n_T END,
 CASE WHEN ref <> 'A' AND n_A > 0 THEN 'A' || n_A END, CASE WHEN ref <> 'C' AND n_C > 0 THEN 'C' || n_C END, CASE WHEN ref <> 'G' AND n_G > 0 THEN 'G' || n_G END, CASE WHEN ref <> 'T' AND n_T > 0 THEN 'T' || n_T END,
 CASE WHEN n_Y > 0 THEN 'Y' || n_Y END, CASE WHEN n_R > 0 THEN 'R' || n_R END) END AS sp FROM red1""", "red1")
oracle.define("mut0", "SELECT chrom, pos1, any_value(ref) AS ref, sum(n_ret + n_conv) AS meth, " + ", ".join(f"sum(n_{b}) AS {b}" for b in "ACGTYR") + " FROM red GROUP BY chrom, pos1", "red")
oracle.define("mut", """SELECT chrom, pos1, meth, (SELECT b FROM (VALUES ('A', 0, "A"), ('C', 1, "C"), ('G', 2, "G"), ('T', 3, "T"), ('Y', 5, CASE WHEN ref IN ('C', 'T') THEN 0 ELSE "Y" END), ('R', 6, CASE WHEN ref IN ('A', 'G') THEN 0 ELSE "R" END)) v(b, k, n)
 WHERE n > 0 AND b <> ref ORDER BY n DESC, k LIMIT 1) AS alt FROM mut0""", "mut0")
oracle.define("call0", """SELECT red.*, alt, CASE ref WHEN 'A' THEN n_A WHEN 'C' THEN n_C WHEN 'G' THEN n_G WHEN 'T' THEN n_T END AS nref,
 CASE alt WHEN 'A' THEN n_A WHEN 'C' THEN n_C WHEN 'G' THEN n_G WHEN 'T' THEN n_T WHEN 'Y' THEN n_Y WHEN 'R' THEN n_R ELSE 0 END AS nalt,
 CASE WHEN ref = 'G' THEN reverse(translate(five, 'ACGTN', 'TGCAN')) ELSE five END AS n5x,
 n_ret + n_conv > 0 AND (ref = 'C' AND (n_T = 0 OR n_C > 0 AND n_T / n_C < 0.05) OR ref = 'G' AND (n_A = 0 OR n_G > 0 AND n_A / n_G < 0.05)) AS callable
 FROM red JOIN mut USING (chrom, pos1) WHERE alt IS NOT NULL OR meth > 0""", "red", "mut")
oracle.define("call1", """SELECT *, ln(1.0 / 3) + nref * ln(0.99) + nalt * ln(0.01) AS g0, ln(1.0 / 3) + (nref + nalt) * ln(0.5) AS g1, ln(1.0 / 3) + nref * ln(0.01) + nalt * ln(0.99) AS g2 FROM call0""", "call0")
oracle.define("call2", """SELECT *, CASE WHEN g0 > g1 AND g0 > g2 THEN 0 WHEN g0 > g1 THEN 2 WHEN g1 > g2 THEN 1 ELSE 2 END AS best, greatest(g0, g1, g2) AS top FROM call1""", "call1")
oracle.define("call3", """SELECT *, ln(exp(least(g0 - top, 0)) + exp(g1 - top) + exp(g2 - top)) AS z, CASE best WHEN 0 THEN exp(g1 - top) + exp(g2 - top) WHEN 1 THEN exp(g0 - top) + exp(g2 - top) ELSE exp(g0 - top) + exp(g1 - top) END AS rest FROM call2""", "call2")
oracle.define("call", """SELECT chrom, pos1, sid, ref, alt, n_ret, n_conv, n_A, n_C, n_G, n_T, n_Y, n_R, dp, sp, callable, nref, nalt,
 CASE WHEN ref NOT IN ('C', 'G') THEN NULL WHEN contains(n5x, 'N') THEN 'CN' WHEN substr(n5x, 4, 1) = 'G' THEN 'CG' WHEN substr(n5x, 5, 1) = 'G' THEN 'CHG' ELSE 'CHH' END AS cx,
 CASE WHEN ref IN ('C', 'G') THEN n5x END AS n5, CASE WHEN callable THEN n_ret / (n_ret + n_conv) END AS beta, CASE WHEN callable THEN n_ret + n_conv ELSE 0 END AS cov,
 CASE WHEN nref + nalt = 0 THEN './.' WHEN best = 0 THEN '0/0' WHEN best = 1 THEN '0/1' ELSE '1/1' END AS gt,
 CASE WHEN nref + nalt > 0 THEN g0 END AS gl0, CASE WHEN nref + nalt > 0 THEN g1 END AS gl1, CASE WHEN nref + nalt > 0 THEN g2 END AS gl2,
 CASE WHEN nref + nalt = 0 THEN 0.0 ELSE least(1000.0, greatest(0.0, -10 * (ln(rest) - z) / ln(10))) END AS gq,
 CASE WHEN alt IS NOT NULL THEN nref + nalt END AS ac, CASE WHEN alt IS NOT NULL AND nref + nalt > 0 THEN nalt / (nref + nalt) END AS af1 FROM call3""", "call3")


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pileup.site_bases(fx.alignments(spark, sf_dir), fx.genome(spark, sf_dir))


def _calls(spark: SparkSession, sf_dir: str, o: pileup.Options = pileup.Options()) -> DataFrame:
    return pileup.calls(pileup.counts(pileup.site_bases(fx.alignments(spark, sf_dir), fx.genome(spark, sf_dir), o), dealt=True), o)


@query("pileup_meth", "SELECT chrom, pos1, sid, n_ret, n_conv FROM plp WHERE n_ret + n_conv > 0", "plp")
def pileup_meth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pileup.counts(_rows(spark, sf_dir)).where("n_ret + n_conv > 0").select("chrom", "pos1", "sid", "n_ret", "n_conv")


@query("pileup_base_counts", 'SELECT chrom, pos1, sid, ref, dp, n_A AS "n_A", n_C AS "n_C", n_G AS "n_G", n_T AS "n_T", n_Y AS "n_Y", n_R AS "n_R" FROM plp', "plp")
def pileup_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pileup.counts(_rows(spark, sf_dir)).drop("five", "n_ret", "n_conv")


@query("pileup_redistribute", 'SELECT chrom, pos1, sid, n_A AS "n_A", n_C AS "n_C", n_G AS "n_G", n_T AS "n_T", n_Y AS "n_Y", n_R AS "n_R" FROM red', "red")
def pileup_redistribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pileup.redistributed(pileup.counts(_rows(spark, sf_dir), dealt=True)).drop("blk", "ref", "five", "dp", "n_ret", "n_conv")


@query("pileup_top_allele", "SELECT chrom, pos1, sid, ref, alt, ac, af1, sp FROM call WHERE alt IS NOT NULL", "call")
def pileup_top_allele(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calls(spark, sf_dir).where("alt is not null").select("chrom", "pos1", "sid", "ref", "alt", "ac", "af1", "sp")


@query("pileup_callable_beta", "SELECT chrom, pos1, sid, cx, n5, beta, cov, dp FROM call WHERE callable", "call")
def pileup_callable_beta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calls(spark, sf_dir).where("callable").select("chrom", "pos1", "sid", "cx", "n5", "beta", "cov", "dp")


@query("pileup_genotype", """SELECT chrom, pos1, sid, gt, round(gl0, 6) AS gl0, round(gl1, 6) AS gl1, round(gl2, 6) AS gl2, round(gq, 4) AS gq, CAST(floor(round(min(gq) OVER s, 6)) AS INTEGER) AS qual, round(min(gq) OVER s, 6) > 5 AS pass
 FROM call WINDOW s AS (PARTITION BY chrom, pos1)""", "call")
def pileup_genotype(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = lambda c, k: F.round(c, k).alias(c)
    return _calls(spark, sf_dir).select("chrom", "pos1", "sid", "gt", r("gl0", 6), r("gl1", 6), r("gl2", 6), r("gq", 4), "qual", "pass")


@query("meth_average_rollup", """SELECT sid, chrom, cx, n, round(s / n, 9) AS mean_beta FROM (SELECT *, max(CASE WHEN cx = 'CG' THEN n END) OVER (PARTITION BY sid, chrom) AS m FROM
 (SELECT sid, chrom, cx, count(*) AS n, sum(beta) AS s FROM (SELECT sid, chrom, cx, beta FROM call WHERE callable AND cx <> 'CN' UNION ALL SELECT sid, chrom, 'CH', beta FROM call WHERE callable AND cx IN ('CHG', 'CHH'))
 GROUP BY GROUPING SETS ((sid, chrom, cx), (sid, cx)))) WHERE m > 0""", "call")
def meth_average_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pileup.average_methylation(_calls(spark, sf_dir)).withColumn("mean_beta", F.round("mean_beta", 9))


@query("pileup_diagnostics", """SELECT chrom, rpos AS pos1, sid, bss, string_agg(code, '' ORDER BY rid, qpos) AS bs, string_agg(meth, '' ORDER BY rid, qpos) AS sta, string_agg(chr(CAST(bq + 33 AS INTEGER)), '' ORDER BY rid, qpos) AS bq,
 string_agg(CASE WHEN flag & 16 <> 0 THEN '-' ELSE '+' END, '' ORDER BY rid, qpos) AS str, string_agg(CAST(qpos AS VARCHAR), ',' ORDER BY rid, qpos) AS pos FROM coded GROUP BY chrom, rpos, sid, bss""", "coded")
def pileup_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pileup.diagnostics(_rows(spark, sf_dir))


@query("pileup_retention_per_read", "SELECT rid, count(*) FILTER (bss = 1 AND rb = 'C' AND qb = 'C' OR bss = 0 AND rb = 'G' AND qb = 'G') AS n_retained FROM base GROUP BY rid", "base")
def pileup_retention_per_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pileup.read_retention(_rows(spark, sf_dir)).drop("sid")


@query("pileup_max_retention", """SELECT * FROM (SELECT chrom, rpos AS pos1, sid, count(*) FILTER (meth = 'R') AS n_ret, count(*) FILTER (meth = 'C') AS n_conv FROM coded
 WHERE rid IN (SELECT rid FROM base GROUP BY rid HAVING count(*) FILTER (bss = 1 AND rb = 'C' AND qb = 'C' OR bss = 0 AND rb = 'G' AND qb = 'G') <= 10) GROUP BY chrom, rpos, sid) WHERE n_ret + n_conv > 0""", "coded", "base")
def pileup_max_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = pileup.Options(bases.Filters(max_retention=10))
    return pileup.counts(pileup.site_bases(fx.alignments(spark, sf_dir), fx.genome(spark, sf_dir), o)).where("n_ret + n_conv > 0").select("chrom", "pos1", "sid", "n_ret", "n_conv")


# -- reads ---------------------------------------------------------------------------------------------------------

oracle.define("mapped", "SELECT * FROM aln JOIN (SELECT rid, c2t, g2a, bss, tag, own FROM strand) USING (rid) WHERE flag & 4 = 0", "aln", "strand")
oracle.define("cyt0", """SELECT px.*, bss, CASE WHEN rb = 'G' THEN reverse(translate(five, 'ACGTN', 'TGCAN')) ELSE five END AS n5 FROM px JOIN strand USING (rid)
 WHERE op = 'M' AND flag & 4 = 0 AND (bss = 0 AND rb = 'C' OR bss = 1 AND rb = 'G')""", "px", "strand")
oracle.define("cyt", """SELECT *, CASE WHEN qb = rb THEN 'R' WHEN rb = 'C' AND qb = 'T' OR rb = 'G' AND qb = 'A' THEN 'C' ELSE 'N' END AS state FROM cyt0""", "cyt0")
oracle.define("conv", "SELECT rid, " + ", ".join(f"count(n5) FILTER (state = '{s.upper()}' AND substr(n5, 4, 1) = '{b.upper()}') AS c{b}_{s}" for b in "acgt" for s in "rc") + " FROM (SELECT rid FROM mapped) LEFT JOIN cyt USING (rid) GROUP BY rid", "mapped", "cyt")


def _strands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readqc.strands(fx.alignments(spark, sf_dir), fx.genome(spark, sf_dir))


@query("bsstrand_resolve", "SELECT rid, bss, tag FROM mapped", "mapped")
def bsstrand_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = fx.alignments(spark, sf_dir).where(~bases.has(bases.UNMAPPED))
    return bases.with_strand(bases.with_slice(reads, fx.genome(spark, sf_dir))).select("rid", "bss", bases.strand_tag().alias("tag"))


@query("bsstrand_infer", "SELECT rid, c2t, g2a, own FROM mapped", "mapped")
def bsstrand_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _strands(spark, sf_dir).select("rid", "c2t", "g2a", "own")


@query("bsstrand_correct", "SELECT rid, own AS \"YD\", c2t AS \"YC\", g2a AS \"YG\" FROM mapped", "mapped")
def bsstrand_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readqc.corrected(_strands(spark, sf_dir), counts=True).select("rid", "YD", "YC", "YG")


@query("bsstrand_confusion", "SELECT tag, own, count(*) AS n FROM mapped GROUP BY tag, own", "mapped")
def bsstrand_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readqc.confusion(_strands(spark, sf_dir))


@query("strand_table", "SELECT CASE WHEN flag & 64 <> 0 THEN 1 ELSE 2 END AS mate, flag & 16 <> 0 AS reverse, tag, count(*) AS n FROM mapped GROUP BY ALL", "mapped")
def strand_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readqc.strand_table(_strands(spark, sf_dir))


@query("flip_strands", "SELECT rid, xor(flag, 16) AS flag FROM aln", "aln")
def flip_strands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readqc.flip_strands(fx.alignments(spark, sf_dir)).select("rid", "flag")


@query("cinread_long", """SELECT rid, qname, CASE WHEN flag & 128 <> 0 THEN 2 ELSE 1 END AS qpair, CASE WHEN flag & 16 <> 0 THEN '-' ELSE '+' END AS strand, CASE WHEN bss = 1 THEN '-' ELSE '+' END AS bsstrand, mapq,
 pos1 AS qbeg, pos1 + span - 1 AS qend, chrom, rpos AS crpos, CASE WHEN substr(n5, 4, 1) <> 'G' THEN -1 WHEN rb = 'C' THEN rpos ELSE rpos - 1 END AS cgrpos, qpos AS cqpos, rb AS crbase,
 CASE WHEN substr(n5, 4, 1) = 'G' THEN 'CG' WHEN substr(n5, 5, 1) = 'G' THEN 'CHG' ELSE 'CHH' END AS cctxt, qb AS cqbase, state AS cretention FROM cyt WHERE NOT contains(n5, 'N')""", "cyt")
def cinread_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readqc.cytosines(fx.alignments(spark, sf_dir), fx.genome(spark, sf_dir), readqc.Cytosines("c")).drop("sid", "rlen", "flag")


@query("cinread_gch", "SELECT rid, rpos AS crpos, state AS cretention, CASE WHEN substr(n5, 2, 1) = 'G' THEN 'GCH' END AS cctxt FROM cyt WHERE NOT contains(n5, 'N') AND substr(n5, 2, 1) = 'G' AND substr(n5, 4, 1) <> 'G'", "cyt")
def cinread_gch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readqc.cytosines(fx.alignments(spark, sf_dir), fx.genome(spark, sf_dir), readqc.Cytosines("gch", True)).select("rid", "crpos", "cretention", "cctxt")


@query("cinread_targets", """SELECT target, cretention, count(*) AS n FROM (SELECT state AS cretention, substr(n5, 4, 1) = 'G' AS g, substr(n5, 2, 1) = 'G' AS h FROM cyt WHERE NOT contains(n5, 'N')),
 (VALUES ('cg'), ('ch'), ('hcg'), ('hch')) v(target) WHERE CASE target WHEN 'cg' THEN g WHEN 'ch' THEN NOT g WHEN 'hcg' THEN g AND NOT h ELSE NOT g AND NOT h END GROUP BY ALL""", "cyt")
def cinread_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readqc.target_counts(fx.alignments(spark, sf_dir), fx.genome(spark, sf_dir), ("cg", "ch", "hcg", "hch"))


@query("retention_by_readpos", """SELECT CASE WHEN flag & 128 <> 0 THEN 2 ELSE 1 END AS mate, CASE WHEN flag & 16 <> 0 THEN 50 - qpos + 1 ELSE qpos END AS qpos, state, count(*) AS n
 FROM cyt WHERE NOT contains(n5, 'N') AND state <> 'N' GROUP BY ALL""", "cyt")
def retention_by_readpos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readqc.retention_by_position(readqc.cytosines(fx.alignments(spark, sf_dir), fx.genome(spark, sf_dir), readqc.Cytosines("c")))


@query("bsconv_counts", "SELECT * FROM conv", "conv")
def bsconv_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readqc.conversion_counts(fx.alignments(spark, sf_dir), fx.genome(spark, sf_dir)).drop("sid")


@query("bsconv_filter", """SELECT rid, concat('CA_R', ca_r, 'C', ca_c, ',CC_R', cc_r, 'C', cc_c, ',CG_R', cg_r, 'C', cg_c, ',CT_R', ct_r, 'C', ct_c) AS "ZN" FROM conv
 WHERE NOT (ca_r + cc_r + ct_r > 3 OR cc_r + ct_r > 2 OR ca_r + cc_r + ct_r + ca_c + cc_c + ct_c > 0 AND (ca_r + cc_r + ct_r) / (ca_r + cc_r + ct_r + ca_c + cc_c + ct_c) > 0.5)""", "conv")
def bsconv_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = readqc.Conversion(max_cph=3, max_cpy=2, max_cph_fraction=0.5)
    return readqc.conversion_filter(fx.alignments(spark, sf_dir), fx.genome(spark, sf_dir), o).select("rid", "ZN")


@query("bsconv_inverted", """SELECT rid FROM conv JOIN aln USING (rid) WHERE cc_r + ct_r + cc_c + ct_c > 0 AND CAST((cc_r + ct_r) / (cc_r + ct_r + cc_c + ct_c) AS FLOAT) > 0.25 OR coalesce(YD = 'u', false)""", "conv", "aln")
def bsconv_inverted(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = readqc.Conversion(max_cpy_fraction=0.25, drop_unknown=True, invert=True)
    return readqc.conversion_filter(fx.alignments(spark, sf_dir), fx.genome(spark, sf_dir), o).select("rid")


@query("bsconv_summary", "SELECT (SELECT count(*) FROM aln) AS n_processed, (SELECT count(*) FROM conv WHERE ca_r + cc_r + ct_r <= 3) AS n_remaining", "aln", "conv")
def bsconv_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readqc.conversion_summary(fx.alignments(spark, sf_dir), fx.genome(spark, sf_dir), readqc.Conversion(max_cph=3))


@query("conversion_by_read", """SELECT context, retained, converted, retained / (retained + converted) AS rate FROM (SELECT unnest(['CA', 'CC', 'CG', 'CT']) AS context, unnest([sum(ca_r), sum(cc_r), sum(cg_r), sum(ct_r)]) AS retained,
 unnest([sum(ca_c), sum(cc_c), sum(cg_c), sum(ct_c)]) AS converted FROM conv JOIN aln USING (rid) WHERE flag & 1024 = 0 AND flag & 1 <> 0 AND flag & 2 <> 0 AND flag & 256 = 0 AND mapq >= 40)""", "conv", "aln")
def conversion_by_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readqc.read_average_conversion(fx.alignments(spark, sf_dir), fx.genome(spark, sf_dir))


@query("mapq_hist", """SELECT k AS mapq, count(rid) AS n FROM (SELECT CAST(unnest(range(0, 61)) AS VARCHAR) AS k UNION ALL SELECT 'unmapped') LEFT JOIN
 (SELECT rid, CASE WHEN flag & 4 <> 0 THEN 'unmapped' ELSE CAST(mapq AS VARCHAR) END AS k FROM aln WHERE flag & 256 = 0) USING (k) GROUP BY k""", "aln")
def mapq_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readqc.mapq_histogram(fx.alignments(spark, sf_dir))


@query("isize_hist", "SELECT isize, count(*) AS n, count(*) / sum(count(*)) OVER () AS fraction FROM aln WHERE flag & 2 <> 0 AND flag & 256 = 0 AND mapq >= 40 AND isize BETWEEN 0 AND 1000 GROUP BY isize", "aln")
def isize_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readqc.insert_histogram(fx.alignments(spark, sf_dir))


@query("dup_report", """SELECT count(*) AS n, count(*) FILTER (flag & 1024 <> 0) AS n_dup, count(*) FILTER (mapq >= 40) AS n_q40, count(*) FILTER (flag & 1024 <> 0 AND mapq >= 40) AS n_q40_dup
 FROM aln WHERE flag & 256 = 0 AND flag & 4 = 0""", "aln")
def dup_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readqc.duplicate_report(fx.alignments(spark, sf_dir))


# -- methylation tables --------------------------------------------------------------------------------------------

_BED = "chrom, pos1 - 1 AS beg0, pos1 AS \"end\", sid, beta, cov"
oracle.define("bed1", f"""SELECT {_BED}, CAST(floor(beta * cov + 0.5) AS INTEGER) AS m, cov - CAST(floor(beta * cov + 0.5) AS INTEGER) AS u, ref, cx, substr(n5, 3, 2) AS ctx2, n5 FROM
 (SELECT *, max(cov) OVER (PARTITION BY chrom, pos1) AS most FROM call WHERE cx IS NOT NULL) WHERE most >= 1""", "call")
oracle.define("cpg1", """SELECT b.chrom, b.beg0, b.sid, b.beta, b.cov, ref, CASE WHEN ref = 'C' THEN b.beg0 ELSE b.beg0 - 1 END AS cpg, s.five FROM bed1 b JOIN (SELECT chrom, pos1, five FROM site) s ON s.chrom = b.chrom AND s.pos1 = b.beg0 + 1
 WHERE cx = 'CG'""", "bed1", "site")
_MERGE = """SELECT chrom, beg0, beg0 + 2 AS "end", sid, CASE WHEN c_cov + g_cov > 0 THEN (CASE WHEN c_cov > 0 THEN round_even(CAST(CAST(c_beta AS FLOAT) * CAST(c_cov AS FLOAT) AS DOUBLE), 0) ELSE 0 END
 + CASE WHEN g_cov > 0 THEN round_even(CAST(CAST(g_beta AS FLOAT) * CAST(g_cov AS FLOAT) AS DOUBLE), 0) ELSE 0 END) / (c_cov + g_cov) END AS beta, c_cov + g_cov AS cov, c_beta, c_cov, g_beta, g_cov FROM
 (SELECT chrom, cpg AS beg0, sid, max(beta) FILTER (ref = 'C') AS c_beta, coalesce(max(cov) FILTER (ref = 'C'), 0) AS c_cov, max(beta) FILTER (ref = 'G') AS g_beta, coalesce(max(cov) FILTER (ref = 'G'), 0) AS g_cov FROM cpg1 {} GROUP BY chrom, cpg, sid)"""


def _bed(spark: SparkSession, sf_dir: str, target: str, min_cov: int = 1) -> DataFrame:
    return methbed.vcf2bed(_calls(spark, sf_dir), target, min_cov)


@query("vcf2bed_cg", "SELECT * FROM bed1 WHERE cx = 'CG'", "bed1")
def vcf2bed_cg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bed(spark, sf_dir, "cg")


@query("vcf2bed_ch", "SELECT * FROM bed1 WHERE cx IN ('CHG', 'CHH')", "bed1")
def vcf2bed_ch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bed(spark, sf_dir, "ch")


@query("vcf2bed_gch", "SELECT * FROM bed1 WHERE cx IN ('CHG', 'CHH') AND substr(n5, 2, 1) = 'G'", "bed1")
def vcf2bed_gch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bed(spark, sf_dir, "gch")


@query("vcf2bed_hcg", "SELECT * FROM bed1 WHERE cx = 'CG' AND substr(n5, 2, 1) <> 'G'", "bed1")
def vcf2bed_hcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bed(spark, sf_dir, "hcg")


@query("vcf2bed_snp", """SELECT chrom, pos1 - 1 AS beg0, pos1 AS "end", ref, CASE WHEN alt IN ('Y', 'R') THEN 'N' ELSE alt END AS alt, sid, gt, sp, ac, af1 FROM
 (SELECT *, max(ac) OVER s AS most, max(af1) OVER s AS af FROM call WHERE alt IS NOT NULL WINDOW s AS (PARTITION BY chrom, pos1)) WHERE most >= 1 AND af > 0""", "call")
def vcf2bed_snp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return methbed.vcf2bed_snp(_calls(spark, sf_dir), 1)


@query("mergecg", _MERGE.format(""), "cpg1")
def mergecg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return methbed.mergecg(_bed(spark, sf_dir, "cg"))


@query("mergecg_nome", _MERGE.format("WHERE ref = 'C' AND substr(five, 2, 1) <> 'G' AND substr(five, 5, 1) <> 'C' OR ref = 'G' AND substr(five, 1, 1) <> 'G' AND substr(five, 4, 1) <> 'C'"), "cpg1")
def mergecg_nome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return methbed.mergecg(_bed(spark, sf_dir, "cg"), nome=True)


@query("mergecg_by_genome", _MERGE.format(""), "cpg1")
def mergecg_by_genome(spark: SparkSession, sf_dir: str) -> DataFrame:
    bed = _bed(spark, sf_dir, "cg").select("chrom", "beg0", "end", "sid", "beta", "cov")  # the short form, without contexts
    return methbed.mergecg(bed, fx.genome(spark, sf_dir))


@query("mergecg_deep", "SELECT * EXCLUDE (most) FROM (SELECT *, max(cov) OVER (PARTITION BY chrom, beg0) AS most FROM (" + _MERGE.format("") + ")) WHERE most >= 2", "cpg1")
def mergecg_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return methbed.mergecg(_bed(spark, sf_dir, "cg"), min_depth=2)


@query("base_conversion", """SELECT ctx2, count(*) AS n, CASE WHEN count(*) < 20 THEN -1 ELSE round(avg(beta), 9) END AS mean_beta FROM bed1 WHERE cov > 0 AND beta IS NOT NULL AND ctx2 IN ('CA', 'CC', 'CG', 'CT') GROUP BY ctx2""", "bed1")
def base_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return methbed.base_conversion(_bed(spark, sf_dir, "c")).withColumn("mean_beta", F.round("mean_beta", 9))


@query("methylkit_export", """SELECT sid, chrom || '.' || "end" AS "chrBase", chrom AS chr, "end" AS base, CASE WHEN ref = 'C' THEN 'F' ELSE 'R' END AS strand, cov AS coverage, 100 * beta AS "freqC", 100 * (1 - beta) AS "freqT" FROM bed1 WHERE cov > 0 AND cx = 'CG'""", "bed1")
def methylkit_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return methbed.methylkit(_bed(spark, sf_dir, "cg"))


# -- coverage ------------------------------------------------------------------------------------------------------

oracle.define("covered", """SELECT chrom, CAST(rpos AS BIGINT) AS pos1, count(*) AS d FROM px WHERE op IN ('M', 'D') AND flag & 4 = 0 AND flag & 256 = 0 AND flag & 512 = 0 AND mapq >= 40 GROUP BY chrom, rpos""", "px")
oracle.define("perbase", "SELECT chrom, pos1, ref, five, coalesce(d, 0) AS depth FROM site LEFT JOIN covered USING (chrom, pos1)", "site", "covered")
oracle.define("gcw", """SELECT chrom, k * 100 AS beg0, (k + 1) * 100 AS "end", length(w) - length(translate(w, 'GC', '')) AS gc FROM
 (SELECT chrom, k, substr(seq, k * 100 + 1, 100) AS w FROM (SELECT chrom, seq, CAST(unnest(range(0, length(seq) // 100)) AS BIGINT) AS k FROM genome))""", "genome")


def _depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    contigs = fx.genome(spark, sf_dir).select("chrom", F.length("seq").alias("clen"))
    return coverage.depth(coverage.reads_for(fx.alignments(spark, sf_dir), "q40"), contigs)


@query("coverage_depth", """SELECT chrom, min(pos1) - 1 AS beg0, max(pos1) AS "end", any_value(depth) AS depth FROM (SELECT chrom, pos1, depth, pos1 - row_number() OVER (PARTITION BY chrom, depth ORDER BY pos1) AS run FROM perbase) GROUP BY chrom, depth, run""", "perbase")
def coverage_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _depth(spark, sf_dir)


@query("depth_histogram", "SELECT chrom, depth, count(*) AS n FROM perbase GROUP BY ALL", "perbase")
def depth_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.total_depth(_depth(spark, sf_dir))


@query("cpg_min_depth", """SELECT chrom, pos1 - 1 AS beg0, pos1 + 1 AS "end", least(depth, after) AS depth FROM (SELECT chrom, pos1, ref, depth, lead(depth) OVER w AS after, lead(ref) OVER w AS nxt FROM perbase WINDOW w AS (PARTITION BY chrom ORDER BY pos1)) WHERE ref = 'C' AND nxt = 'G'""", "perbase")
def cpg_min_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.least_depth(gn.cpg_sites(fx.genome(spark, sf_dir)), _depth(spark, sf_dir))


@query("depth_moments", "SELECT count(*) AS n, round(avg(depth), 9) AS mean, round(stddev_pop(depth), 6) AS sd, round(stddev_pop(depth) / avg(depth), 6) AS cv FROM perbase", "perbase")
def depth_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    hist = coverage.total_depth(_depth(spark, sf_dir)).groupBy("depth").agg(F.sum("n").alias("n"))
    return coverage.moments(hist).select("n", F.round("mean", 9).alias("mean"), F.round("sd", 6).alias("sd"), F.round("cv", 6).alias("cv"))


_VARIANTS = (("all", "true"), ("q40", "mapq >= 40"), ("dup", "flag & 1024 <> 0"), ("q40_dup", "mapq >= 40 AND flag & 1024 <> 0"))
oracle.define("covered4", " UNION ALL ".join(f"SELECT '{v}' AS variant, chrom, CAST(rpos AS BIGINT) AS pos1, count(*) AS depth FROM px WHERE op IN ('M', 'D') AND flag & 4 = 0 AND flag & 256 = 0 AND flag & 512 = 0 AND {w} GROUP BY chrom, rpos" for v, w in _VARIANTS), "px")


@query("depth_variants", """SELECT variant, depth, count(*) AS n FROM covered4 GROUP BY variant, depth UNION ALL SELECT variant, 0, CAST((SELECT sum(length(seq)) FROM genome) AS BIGINT) - count(*) FROM covered4 GROUP BY variant""", "covered4", "genome")
def depth_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    contigs, found = fx.genome(spark, sf_dir).select("chrom", F.length("seq").alias("clen")), None
    for v in coverage.VARIANTS:
        rows = coverage.total_depth(coverage.depth(coverage.reads_for(fx.alignments(spark, sf_dir), v), contigs)).groupBy(F.lit(v).alias("variant"), "depth").agg(F.sum("n").alias("n"))
        found = rows if found is None else found.unionByName(rows)
    return found


_DECILE = """SELECT chrom, beg0, "end", gc FROM (SELECT *, row_number() OVER (ORDER BY gc {0}, chrom || chr(9) || beg0 || chr(9) || "end" {0}) AS k, count(*) OVER () AS n FROM gcw) WHERE k <= floor(n * 0.1 + 0.5)"""


@query("gc_decile_top", _DECILE.format("DESC"), "gcw")
def gc_decile_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.decile(gn.gc_windows(fx.genome(spark, sf_dir)), top=True)


@query("gc_decile_bottom", _DECILE.format("ASC"), "gcw")
def gc_decile_bottom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.decile(gn.gc_windows(fx.genome(spark, sf_dir)), top=False)


oracle.define("decile2", " UNION ALL ".join(f"SELECT '{r}' AS region, chrom, beg0 // 100 AS k FROM ({_DECILE.format(d)})" for r, d in (("top", "DESC"), ("bottom", "ASC"))), "gcw")
oracle.define("perbase2", " UNION ALL ".join(f"SELECT '{v}' AS reads, site.chrom, site.pos1, ref, coalesce(depth, 0) AS depth FROM site LEFT JOIN (SELECT * FROM covered4 WHERE variant = '{v}') USING (chrom, pos1)" for v in ("all", "q40")), "site", "covered4")
oracle.define("cpg2", """SELECT reads, chrom, pos1, least(depth, after) AS depth FROM (SELECT *, lead(depth) OVER w AS after, lead(ref) OVER w AS nxt FROM perbase2 WINDOW w AS (PARTITION BY reads, chrom ORDER BY pos1)) WHERE ref = 'C' AND nxt = 'G'""", "perbase2")


@query("depth_report", """SELECT reads, unit, region, count(*) AS n, round(avg(depth), 9) AS mean, round(stddev_pop(depth), 6) AS sd, round(stddev_pop(depth) / avg(depth), 6) AS cv FROM
 (SELECT reads, 'base' AS unit, 'all' AS region, depth FROM perbase2 UNION ALL SELECT reads, 'cpg', 'all', depth FROM cpg2 UNION ALL SELECT reads, 'base', region, depth FROM perbase2 b JOIN decile2 d ON b.chrom = d.chrom AND (pos1 - 1) // 100 = k
 UNION ALL SELECT reads, 'cpg', region, depth FROM cpg2 b JOIN decile2 d ON b.chrom = d.chrom AND k BETWEEN (pos1 - 1) // 100 AND pos1 // 100) GROUP BY ALL""", "perbase2", "cpg2", "decile2")
def depth_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = fx.genome(spark, sf_dir)
    found = coverage.depth_report(fx.alignments(spark, sf_dir), g, gn.gc_windows(g))
    return found.withColumns({"mean": F.round("mean", 9), "sd": F.round("sd", 6), "cv": F.round("cv", 6)})


@query("interval_overlaps", """SELECT a.chrom, a.beg0, a."end", a.gc, c.pos1 - 1 AS b_beg0, c.pos1 + 1 AS b_end FROM gcw a JOIN (SELECT chrom, pos1 FROM site WHERE ref = 'C' AND substr(five, 4, 1) = 'G') c ON a.chrom = c.chrom AND a.beg0 < c.pos1 + 1 AND c.pos1 - 1 < a."end" """, "gcw", "site")
def interval_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = fx.genome(spark, sf_dir)
    return coverage.overlaps(gn.gc_windows(g), gn.cpg_sites(g))


# -- epireads ------------------------------------------------------------------------------------------------------

oracle.define("snp", """SELECT chrom, pos1, ref, translate(ref, 'ACGT', 'CGTA') AS alt, (pos1 % 10) / 100.0 AS af FROM site WHERE (tid * 31 + pos1) % 97 = 0""", "site")
oracle.define("snpc", """SELECT chrom, pos1 AS p, CASE ref WHEN 'C' THEN alt <> 'T' OR af < 0.05 WHEN 'G' THEN alt <> 'A' OR af < 0.05 ELSE false END AS ok FROM snp""", "snp")
oracle.define("epc", """SELECT px.rid, qname, flag, px.chrom, px.pos1, bss, op, col, rpos, qb, rb, five, bq, snpc.ok AS snp_ok,
 op = 'M' AND bq >= 20 AND qpos > 3 AND qpos + 3 <= 50 AND NOT (flag & 128 <> 0 AND rpos >= greatest(px.pos1, mpos1) AND rpos <= least(px.pos1 + span - 1, mpos1 + mspan - 1)) AS good,
 op = 'M' AND (bss = 1 AND rb = 'G' AND substr(five, 2, 1) = 'C' OR bss = 0 AND rb = 'C' AND substr(five, 4, 1) = 'G') AS cpg,
 CASE WHEN qb = rb THEN 'C' WHEN rb = 'C' AND qb = 'T' OR rb = 'G' AND qb = 'A' THEN 'T' ELSE 'N' END AS call,
 op = 'M' AND (bss = 1 AND rb = 'G' AND substr(five, 2, 1) = 'C' AND substr(five, 4, 1) NOT IN ('C', 'N') OR bss = 0 AND rb = 'C' AND substr(five, 2, 1) NOT IN ('G', 'N') AND substr(five, 4, 1) = 'G') AS hcg,
 op = 'M' AND (bss = 1 AND rb = 'G' AND substr(five, 2, 1) NOT IN ('C', 'N') AND substr(five, 4, 1) = 'C' OR bss = 0 AND rb = 'C' AND substr(five, 2, 1) = 'G' AND substr(five, 4, 1) NOT IN ('G', 'N')) AS gch
 FROM px JOIN strand USING (rid) LEFT JOIN snpc ON snpc.chrom = px.chrom AND snpc.p = px.rpos AND op = 'M' WHERE px.rid IN (SELECT rid FROM kept)""", "px", "strand", "snpc", "kept")
_CH = "CASE op WHEN 'S' THEN 'P' WHEN 'D' THEN '{d}' WHEN 'I' THEN {i} ELSE CASE WHEN NOT good THEN 'F' ELSE {x} END END"
_X = "CASE WHEN {c} AND call <> 'N' AND coalesce(snp_ok, true) THEN CASE WHEN call = 'C' THEN '{m}' ELSE '{u}' END ELSE 'x' END"
_CG, _HCG, _GCH = (_CH.format(d="d", i="'i'", x=_X.format(c=c, m=m, u=u)) for c, m, u in (("cpg", "M", "U"), ("hcg", "M", "U"), ("gch", "O", "S")))
_VR = _CH.format(d="D", i="lower(qb)", x="CASE WHEN snp_ok IS NULL THEN 'x' WHEN bss = 1 AND qb = 'A' THEN 'R' WHEN bss = 0 AND qb = 'T' THEN 'Y' ELSE qb END")
oracle.define("ch", f"SELECT rid, col, 'cg' AS ch, {_CG} AS v FROM epc UNION ALL SELECT rid, col, 'vr', {_VR} FROM epc UNION ALL SELECT rid, col, 'hcg', {_HCG} FROM epc UNION ALL SELECT rid, col, 'gch', {_GCH} FROM epc", "epc")
_RLE = """SELECT rid, ch, string_agg(v || CASE WHEN n > 1 THEN CAST(n AS VARCHAR) ELSE '' END, '' ORDER BY spot) AS s, bool_and(v IN ('F', 'x', 'P')) AS empty FROM
 (SELECT rid, ch, v, min(col) AS spot, count(*) AS n FROM (SELECT *, col - row_number() OVER (PARTITION BY rid, ch, v ORDER BY col) AS run FROM {ch}) GROUP BY rid, ch, v, run) GROUP BY rid, ch"""
oracle.define("rle", _RLE.format(ch="ch"), "ch")
_EPIBED = """SELECT rid, chrom, pos1 - CASE WHEN cigar LIKE '5S%' THEN 5 ELSE 0 END - 1 AS start0, pos1 - CASE WHEN cigar LIKE '5S%' THEN 5 ELSE 0 END - 1 + 50 + CASE WHEN cigar LIKE '%2D%' THEN 2 ELSE 0 END - CASE WHEN cigar LIKE '%3I%' THEN 3 ELSE 0 END AS "end",
 qname, CASE WHEN flag & 128 <> 0 THEN '2' ELSE '1' END AS mate, CASE WHEN bss = 1 THEN '-' ELSE '+' END AS strand, c.s AS cg, {gc} AS gc, v.s AS vr FROM kept JOIN strand USING (rid) JOIN rle c USING (rid) JOIN rle v USING (rid) {join}
 WHERE c.ch = '{cg}' AND v.ch = 'vr' AND NOT (c.empty AND v.empty {more}) AND pos1 - CASE WHEN cigar LIKE '5S%' THEN 5 ELSE 0 END >= 1"""


def _states(spark: SparkSession, sf_dir: str, o: epiread.Options = epiread.Options()) -> DataFrame:
    return epiread.states(fx.alignments(spark, sf_dir), fx.genome(spark, sf_dir), fx.snps(spark, sf_dir), o)


@query("epibed_rle", _EPIBED.format(gc="'.'", join="", cg="cg", more=""), "kept", "strand", "rle")
def epibed_rle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return epiread.epibed(_states(spark, sf_dir)).drop("sid")


@query("epibed_nome", _EPIBED.format(gc="g.s", join="JOIN rle g USING (rid)", cg="hcg", more="AND g.empty") + " AND g.ch = 'gch'", "kept", "strand", "rle")
def epibed_nome(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = epiread.Options(nome=True)
    return epiread.epibed(_states(spark, sf_dir, o), o).drop("sid")


oracle.define("mods", """SELECT rid, base, CAST(spots[n] AS BIGINT) AS qpos, (m + 0.5) / 256 AS p FROM
 (SELECT rid, base, CASE WHEN flag & 16 <> 0 THEN list_reverse(spots) ELSE spots END AS spots, unnest(CASE WHEN rid % 2 = 0 THEN [1, 3, 4] ELSE [2, 3] END) AS n,
  unnest(CASE WHEN rid % 2 = 0 THEN [rid * 17 % 256, (rid * 29 + 13) % 256, (rid * 5 + 250) % 256] ELSE [rid * 13 % 256, (rid * 7 + 128) % 256] END) AS m FROM
  (SELECT *, list_filter(range(1, 51), lambda i: substr(seq, i, 1) = base) AS spots FROM (SELECT *, CASE WHEN (rid % 2 = 0) = (flag & 16 = 0) THEN 'C' ELSE 'G' END AS base FROM aln))) WHERE spots[n] IS NOT NULL""", "aln")
oracle.define("epm", """SELECT epc.rid, epc.col, epc.op, epc.qb, 0 AS bss, snp_ok, good, coalesce(p IS NOT NULL AND base = epc.qb AND epc.rb = epc.qb AND (epc.rb = 'C' AND substr(epc.five, 4, 1) = 'G' OR epc.rb = 'G' AND substr(epc.five, 2, 1) = 'C'), false) AS cpg,
 CASE WHEN p > 0.9 THEN 'C' WHEN p < 0.1 THEN 'T' ELSE 'N' END AS call FROM epc JOIN px ON px.rid = epc.rid AND px.col = epc.col LEFT JOIN mods ON mods.rid = px.rid AND mods.qpos = px.qpos""", "epc", "px", "mods")
oracle.define("chm", f"SELECT rid, col, 'cg' AS ch, {_CG} AS v FROM epm UNION ALL SELECT rid, col, 'vr', {_VR} FROM epm", "epm")
oracle.define("rlem", _RLE.format(ch="chm"), "chm")
_EPIBED_TAGS = _EPIBED.format(gc="'.'", join="", cg="cg", more="").replace("CASE WHEN bss = 1 THEN '-' ELSE '+' END", "'+'").replace("JOIN strand USING (rid) ", "").replace("JOIN rle ", "JOIN rlem ")


@query("epibed_modified", _EPIBED_TAGS, "kept", "rlem")
def epibed_modified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads whose MM and ML tags follow from their ids: C+m for even ones, G-m for odd ones."""
    aln, e = fx.alignments(spark, sf_dir), F.col("rid")
    marks = F.when(e % 2 == 0, F.array(e * 17 % 256, (e * 29 + 13) % 256, (e * 5 + 250) % 256)).otherwise(F.array(e * 13 % 256, (e * 7 + 128) % 256))
    aln = aln.withColumn("MM", F.when(e % 2 == 0, "C+m,0,1,0;").otherwise("G-m,1,0;")).withColumn("ML", marks.cast("array<int>"))
    o = epiread.Options(modified=0.9)
    return epiread.epibed(epiread.states(aln, fx.genome(spark, sf_dir), fx.snps(spark, sf_dir), o), o).drop("sid")


oracle.define("old", """SELECT rid, chrom, any_value(qname) AS qname, CASE WHEN any_value(flag) & 128 <> 0 THEN '2' ELSE '1' END AS mate, CASE WHEN any_value(bss) = 1 THEN '-' ELSE '+' END AS strand,
 coalesce(string_agg(CAST(rpos - 1 - CASE WHEN bss = 1 THEN 1 ELSE 0 END AS VARCHAR), ',' ORDER BY col) FILTER (cpg), '.') AS cg_pos0, coalesce(string_agg(CASE WHEN good THEN call ELSE 'N' END, '' ORDER BY col) FILTER (cpg), '.') AS cg,
 coalesce(string_agg(CAST(rpos - 1 AS VARCHAR), ',' ORDER BY col) FILTER (snp_ok IS NOT NULL AND good), '.') AS snp_pos0, coalesce(string_agg(qb, '' ORDER BY col) FILTER (snp_ok IS NOT NULL AND good), '.') AS snp
 FROM epc GROUP BY rid, chrom HAVING count(*) FILTER (cpg) > 0""", "epc")
oracle.define("prw", """SELECT s.rid, s.chrom, s.rpos AS snp1, c.rpos - CASE WHEN c.bss = 1 THEN 1 ELSE 0 END AS cg1, s.qb AS snp_base, CASE WHEN c.good THEN c.call ELSE 'N' END AS cg_call FROM epc s JOIN epc c USING (rid)
 WHERE s.snp_ok IS NOT NULL AND s.good AND c.cpg""", "epc")


@query("epiread_legacy", "SELECT * FROM old", "old")
def epiread_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return epiread.legacy(_states(spark, sf_dir), all_positions=True).drop("sid")


@query("epiread_pairwise", "SELECT * FROM prw", "prw")
def epiread_pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return epiread.pairwise(_states(spark, sf_dir)).drop("sid")


@query("rectangle_pad", """SELECT rid, chrom, cg, rpad(repeat('N', CAST(k - k0 AS INTEGER)) || cg, CAST(k1 - k0 AS INTEGER), 'N') AS padded FROM (SELECT *, min(k) OVER w AS k0, max(k + length(cg)) OVER w AS k1 FROM old JOIN
 (SELECT chrom AS c, CAST(pos1 - 1 AS VARCHAR) AS p, row_number() OVER (PARTITION BY chrom ORDER BY pos1) AS k FROM site WHERE ref = 'C' AND substr(five, 4, 1) = 'G') ON c = chrom AND p = split_part(cg_pos0, ',', 1) WINDOW w AS (PARTITION BY chrom))""", "old", "site")
def rectangle_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = epiread.legacy(_states(spark, sf_dir)).select("rid", "chrom", "cg_pos0", "cg")
    return epiread.rectangle(reads, fx.genome(spark, sf_dir)).drop("cg_pos0")


@query("epiread_pairs", """SELECT chrom, qname, count(*) AS n, min(start0) AS start0, max("end") AS "end" FROM (""" + _EPIBED.format(gc="'.'", join="", cg="cg", more="") + ") GROUP BY chrom, qname", "kept", "strand", "rle")
def epiread_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = epiread.paired(epiread.epibed(_states(spark, sf_dir)))
    n = F.col("r1").isNotNull().cast("int") + F.col("r2").isNotNull().cast("int")
    return both.select("chrom", "qname", n.cast("long").alias("n"), F.least("r1.start0", "r2.start0").alias("start0"), F.greatest("r1.end", "r2.end").alias("end"))


# -- allele-specific methylation -------------------------------------------------------------------------------------

# alleles and calls of made-up pairs of sites: every order line is a read
oracle.define("asmp", """SELECT 'chr' || CAST(l_partkey % 50 AS VARCHAR) AS chrom, l_suppkey % 7 + 1 AS snp1, l_linenumber * 3 AS cg1, substr('ACGTN', CAST((l_orderkey * 7 + l_linenumber) % 5 + 1 AS BIGINT), 1) AS snp_base,
 substr('CTTCN', CAST((l_orderkey + CAST(l_quantity AS BIGINT)) % 5 + 1 AS BIGINT), 1) AS cg_call FROM lineitem""")
oracle._NEEDS["asmp"] = ()
# the pairs of real epireads are spread too thin for a test, so places are folded together, and calls that are not known left out
oracle.define("asfp", "SELECT 'chr' || CAST(snp1 % 11 AS VARCHAR) AS chrom, snp1 % 7 + 1 AS snp1, cg1 % 5 + 10 AS cg1, snp_base, cg_call FROM prw WHERE cg_call <> 'N'", "prw")


def _define_asm(p: str) -> None:
    """The tables of a set of pairs ``{p}p``, by steps, up to ``{p}x``."""
    oracle.define(f"{p}c", "SELECT chrom, snp1, cg1, " + ", ".join(f"count(*) FILTER (snp_base = '{a}' AND cg_call = '{b}') AS m{i}{j}" for i, a in enumerate("ACGTN") for j, b in enumerate("ACGTN")) + " FROM {p}p GROUP BY ALL".format(p=p), f"{p}p")
    oracle.define(f"{p}0", "SELECT *, [" + ", ".join("+".join(f"m{i}{j}" for j in range(5)) for i in range(5)) + "] AS rs, [" + ", ".join("+".join(f"m{i}{j}" for i in range(5)) for j in range(5)) + "] AS cs, 1 AS ra, 2 AS rb, 1 AS ca, 2 AS cb, ["
      + ", ".join(f"m{i}{j}" for i in range(5) for j in range(5)) + "] AS m FROM " + p + "c", f"{p}c")
    for _i in (3, 4, 5):
        oracle.define(f"{p}{_i - 2}", f"""SELECT * EXCLUDE (ra, rb, ca, cb), CASE WHEN rs[ra] < rs[rb] AND rs[{_i}] >= rs[ra] THEN {_i} ELSE ra END AS ra, CASE WHEN rs[ra] >= rs[rb] AND rs[{_i}] >= rs[rb] THEN {_i} ELSE rb END AS rb,
 CASE WHEN cs[ca] < cs[cb] AND cs[{_i}] >= cs[ca] THEN {_i} ELSE ca END AS ca, CASE WHEN cs[ca] >= cs[cb] AND cs[{_i}] >= cs[cb] THEN {_i} ELSE cb END AS cb FROM {p}{_i - 3}""", f"{p}{_i - 3}")
    oracle.define(f"{p}t", f"""SELECT chrom, snp1, cg1, substr('ACGTN', ra, 1) AS allele1, substr('ACGTN', rb, 1) AS allele2, substr('ACGTN', ca, 1) AS call1, substr('ACGTN', cb, 1) AS call2, m[(ra - 1) * 5 + ca] AS n11, m[(ra - 1) * 5 + cb] AS n12, m[(rb - 1) * 5 + ca] AS n21, m[(rb - 1) * 5 + cb] AS n22
 FROM {p}3 WHERE rs[ra] > 0 AND rs[rb] > 0 AND cs[ca] > 0 AND cs[cb] > 0 AND snp1 <> cg1 AND ca <> 5 AND cb <> 5""", f"{p}3")
    # Fisher's test by the gamma function: all tables with the same margins that are no likelier
    oracle.define(f"{p}x", f"""SELECT *, unnest(range(greatest(0, n11 + n21 - n21 - n22), least(n11 + n12, n11 + n21) + 1)) AS x FROM {p}t""", f"{p}t")


for _p in ("asm", "asf"):
    _define_asm(_p)
_LF = "lgamma({} + 1)"
_LP = " - ".join(["(" + " + ".join(_LF.format(t) for t in ("n11 + n12", "n21 + n22", "n11 + n21", "n12 + n22")) + " - lgamma(n11 + n12 + n21 + n22 + 1))", _LF.format("{x}"), _LF.format("n11 + n12 - {x}"), _LF.format("n11 + n21 - {x}"), _LF.format("n22 - n11 + {x}")])


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    c = F.col
    return li.select(
        F.concat(F.lit("chr"), (c("l_partkey") % 50).cast("string")).alias("chrom"), (c("l_suppkey") % 7 + 1).alias("snp1"), (c("l_linenumber") * 3).alias("cg1"),
        F.substr(F.lit("ACGTN"), ((c("l_orderkey") * 7 + c("l_linenumber")) % 5 + 1).cast("int"), F.lit(1)).alias("snp_base"), F.substr(F.lit("CTTCN"), ((c("l_orderkey") + c("l_quantity").cast("long")) % 5 + 1).cast("int"), F.lit(1)).alias("cg_call"),
    )


@query("asm_counts", "SELECT * FROM asmt", "asmt")
def asm_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asm.tables(_pairs(spark, sf_dir))


@query("asm_fisher", f"SELECT chrom, snp1, cg1, round(least(1.0, sum(exp({_LP.format(x='x')})) FILTER ({_LP.format(x='x')} <= {_LP.format(x='n11')} + 1e-7)), 8) AS p_fisher FROM asmx GROUP BY ALL", "asmx")
def asm_fisher(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asm.tests(asm.tables(_pairs(spark, sf_dir))).select("chrom", "snp1", "cg1", F.round("p_fisher", 8).alias("p_fisher"))


# erfc(sqrt(x / 2)) by erf's series of positive terms
_CHI = """CASE WHEN chi IS NULL OR chi <= 0 THEN 1.0 ELSE round(1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 300), lambda k: exp((2 * k + 1) * ln(sqrt(chi / 2)) + 2 * k * ln(2) + lgamma(k + 1) - lgamma(2 * k + 2) - chi / 2))), 8) END"""


@query("asm_pvalues", f"""SELECT t.*, f.p_fisher, {_CHI} AS p_chisq FROM (SELECT *, (n11 + n12 + n21 + n22) * pow(CAST(n11 AS DOUBLE) * n22 - CAST(n12 AS DOUBLE) * n21, 2) / nullif(CAST(n11 + n12 AS DOUBLE) * (n21 + n22) * (n11 + n21) * (n12 + n22), 0) AS chi FROM asft) t
 JOIN (SELECT chrom, snp1, cg1, round(least(1.0, sum(exp({_LP.format(x='x')})) FILTER ({_LP.format(x='x')} <= {_LP.format(x='n11')} + 1e-7)), 8) AS p_fisher FROM asfx GROUP BY ALL) f USING (chrom, snp1, cg1)""".replace("SELECT t.*,", "SELECT t.* EXCLUDE (chi),"), "asft", "asfx")
def asm_pvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = epiread.pairwise(_states(spark, sf_dir)).where("cg_call <> 'N'")
    folded = pairs.select(F.concat(F.lit("chr"), (F.col("snp1") % 11).cast("string")).alias("chrom"), (F.col("snp1") % 7 + 1).alias("snp1"), (F.col("cg1") % 5 + 10).alias("cg1"), "snp_base", "cg_call")
    return asm.tests(asm.tables(folded)).withColumns({"p_fisher": F.round("p_fisher", 8), "p_chisq": F.round("p_chisq", 8)})


# -- raw reads -----------------------------------------------------------------------------------------------------

oracle.define("fq", "SELECT rid AS ord, qname || ':' || rid AS name, seq AS seq1, qual AS qual1, translate(seq, 'ACGT', 'TGCA') AS seq2, reverse(qual) AS qual2 FROM aln", "aln")


@query("barcode_extract", "SELECT ord, name || '_' || substr(seq1, 4, 8) || '_AAAAAAAA' AS name, substr(seq1, 1, 3) || substr(seq1, 12) AS seq1, substr(qual1, 1, 3) || substr(qual1, 12) AS qual1, seq2, qual2 FROM fq", "fq")
def barcode_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fastq.extract_barcode(fx.fastq(spark, sf_dir), start=4)


_ADAPTOR = "GATC"


@query("adaptor_clip", f"SELECT ord, CASE WHEN instr(seq1, '{_ADAPTOR}') > 0 THEN 50 - instr(seq1, '{_ADAPTOR}') + 1 WHEN seq1 LIKE '%GAT' THEN 3 WHEN seq1 LIKE '%GA' THEN 2 WHEN seq1 LIKE '%G' THEN 1 ELSE 0 END AS l_adaptor FROM fq", "fq")
def adaptor_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.fastq(spark, sf_dir).select("ord", fastq.adaptor_length(F.col("seq1"), _ADAPTOR).alias("l_adaptor"))


@query("quality_clip", """SELECT ord, coalesce(lo, 50) AS clip5, CASE WHEN lo IS NULL THEN 0 ELSE 50 - hi END AS clip3 FROM
 (SELECT ord, min(i) FILTER (ascii(substr(qual1, i, 1)) - 33 >= 25) - 1 AS lo, max(i) FILTER (ascii(substr(qual1, i, 1)) - 33 >= 25) AS hi FROM (SELECT ord, qual1, CAST(unnest(range(1, 51)) AS BIGINT) AS i FROM fq) GROUP BY ord)""", "fq")
def quality_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    five, three = fastq.quality_ends(F.col("qual1"), 25)
    return fx.fastq(spark, sf_dir).select("ord", five.alias("clip5"), three.alias("clip3"))


@query("smart_pairing", """SELECT ord, name, CASE WHEN spot % 2 = 1 AND spot < n THEN 1 WHEN spot % 2 = 0 THEN 2 ELSE 0 END AS kind FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY ord) AS spot, count(*) OVER (PARTITION BY run) AS n FROM
 (SELECT *, sum(new) OVER (ORDER BY ord) AS run FROM (SELECT row_number() OVER (ORDER BY rid) AS ord, qname AS name, CASE WHEN qname = lag(qname) OVER (ORDER BY rid) THEN 0 ELSE 1 END AS new FROM aln)))""", "aln")
def smart_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = store.once(spark, ("stream", sf_dir), lambda: store.numbered(fx.alignments(spark, sf_dir).select("rid", "qname"), "ord", F.col("rid")).select("ord", F.col("qname").alias("name")))  # the fixture's places
    return fastq.smart_pairs(reads)


@query("barcode_from_name", "SELECT rid, CASE WHEN rid % 3 > 0 THEN 'B' || CAST(rid % 7 AS VARCHAR) END AS barcode, CASE WHEN rid % 3 > 0 THEN 'U' || CAST(rid % 5 AS VARCHAR) END AS umi FROM aln", "aln")
def barcode_from_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("rid") % 3 > 0, F.concat(F.col("qname"), F.lit("_x_B"), (F.col("rid") % 7).cast("string"), F.lit("_U"), (F.col("rid") % 5).cast("string"))).otherwise(F.col("qname"))
    barcode, umi = sq.barcode_of(name)
    return fx.alignments(spark, sf_dir).select("rid", barcode.alias("barcode"), umi.alias("umi"))


# -- alignment -----------------------------------------------------------------------------------------------------


def _index(spark: SparkSession, sf_dir: str) -> scan.Text:
    """None is made: it is many times the genome, and matches are many times the reads, so both are met where their texts are."""
    return scan.Text(fx.genome(spark, sf_dir))


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.alignments(spark, sf_dir).select("rid", F.when(bases.has(bases.READ2), 2).otherwise(1).alias("mate"), "seq")


oracle.define("gblk", """SELECT chrom, seq, reverse(translate(seq, 'ACGT', 'TGCA')) AS rc, length(seq) AS n FROM genome""", "genome")
oracle.define("kidx", """SELECT 1 AS parent, 0 AS reverse, translate(substr(seq, p + 1, 19), 'C', 'T') AS w, chrom, p AS at0 FROM (SELECT *, CAST(unnest(range(0, n - 18)) AS BIGINT) AS p FROM gblk)
 UNION ALL SELECT 0, 0, translate(substr(seq, p + 1, 19), 'G', 'A'), chrom, p FROM (SELECT *, CAST(unnest(range(0, n - 18)) AS BIGINT) AS p FROM gblk)
 UNION ALL SELECT 1, 1, translate(substr(rc, p + 1, 19), 'C', 'T'), chrom, n - p - 19 FROM (SELECT *, CAST(unnest(range(0, n - 18)) AS BIGINT) AS p FROM gblk)
 UNION ALL SELECT 0, 1, translate(substr(rc, p + 1, 19), 'G', 'A'), chrom, n - p - 19 FROM (SELECT *, CAST(unnest(range(0, n - 18)) AS BIGINT) AS p FROM gblk)""", "gblk")
oracle.define("kmet", """SELECT rid, CASE WHEN flag & 128 <> 0 THEN 2 ELSE 1 END AS mate, parent, reverse, chrom, CASE WHEN reverse = 1 THEN at0 - (length(seq) - i - 19) ELSE at0 - i END AS diag0, i FROM
 (SELECT rid, flag, seq, parent, i, translate(substr(seq, i + 1, 19), CASE parent WHEN 1 THEN 'C' ELSE 'G' END, CASE parent WHEN 1 THEN 'T' ELSE 'A' END) AS w
  FROM (SELECT *, CAST(unnest(range(0, length(seq) - 18)) AS BIGINT) AS i FROM aln), (VALUES (1), (0)) v(parent)) JOIN kidx USING (parent, w)""", "aln", "kidx")
oracle.define("maxi", """SELECT rid, mate, parent, reverse, chrom, diag0, min(i) AS qb, max(i) + 19 AS qe FROM (SELECT *, i - row_number() OVER (PARTITION BY rid, mate, parent, reverse, chrom, diag0 ORDER BY i) AS island FROM kmet)
 GROUP BY rid, mate, parent, reverse, chrom, diag0, island""", "kmet")
oracle.define("stretch", "SELECT rid, mate, parent, qb, qe, count(*) AS occ FROM maxi GROUP BY ALL", "maxi")


_SEEDS = """SELECT rid, mate, parent, reverse, chrom, CASE WHEN reverse = 1 THEN at0 - (50 - i - 19) ELSE at0 - i END AS diag0, count(*) AS n FROM
 (SELECT rid, CASE WHEN flag & 128 <> 0 THEN 2 ELSE 1 END AS mate, parent, i, translate(substr(seq, i + 1, 19), CASE parent WHEN 1 THEN 'C' ELSE 'G' END, CASE parent WHEN 1 THEN 'T' ELSE 'A' END) AS w
  FROM (SELECT *, CAST(unnest(range(0, 32, 5)) AS BIGINT) AS i FROM aln), (VALUES (1), (0)) v(parent)) JOIN kidx USING (parent, w) GROUP BY ALL"""


@query("seed_join", _SEEDS, "aln", "kidx")
def seed_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.seeds(_reads(spark, sf_dir), _index(spark, sf_dir))


@query("seed_join_bucketed", _SEEDS, "aln", "kidx")
def seed_join_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same seeds by bucketed tables, which a cluster's runs share; the index does not move."""
    path = store.fresh(spark, "index")
    kmers.write(fx.genome(spark, sf_dir), path)
    return align.seeds(_reads(spark, sf_dir), kmers.read(spark, path))


@query("maximal_seeds", "SELECT * FROM maxi", "maxi")
def maximal_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeds.maximal(_reads(spark, sf_dir), _index(spark, sf_dir)).drop("rlen")


@query("super_maximal_seeds", """SELECT rid, mate, parent, qb, qe, occ FROM stretch s WHERE NOT EXISTS (SELECT 1 FROM stretch t WHERE t.rid = s.rid AND t.mate = s.mate AND t.parent = s.parent AND t.qb <= s.qb AND t.qe >= s.qe AND (t.qb < s.qb OR t.qe > s.qe))""", "stretch")
def super_maximal_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeds.super_maximal(seeds.counted(_reads(spark, sf_dir), _index(spark, sf_dir)))


@query("seed_stretches")
def seed_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What seeds each read, by all three rules; tests hold it against their plain definitions."""
    of = store.written(seeds.counted(_reads(spark, sf_dir), _index(spark, sf_dir)), "stretches")  # read thrice; a checkpoint would not be compressed
    return seeds.chosen_of(of, _reads(spark, sf_dir))


@query("align_best_hit")
def align_best_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(_reads(spark, sf_dir), fx.genome(spark, sf_dir), idx=_index(spark, sf_dir))


oracle.define("planted", """SELECT rid FROM (SELECT tid AS rid, translate(substr(seq, CAST(tid * 131 % (length(seq) - 400) + 1 AS BIGINT), 260), 'C', 'T') AS s FROM genome WHERE length(seq) >= 600)
 WHERE len(list_filter(range(1, 31), lambda d: substr(s, d + 1, 60 - d) = substr(s, 1, 60 - d) OR substr(s, 201 + d, 60 - d) = substr(s, 201, 60 - d))) = 0""", "genome")


@query("paired_alignment", "SELECT rid, mate, true AS found, true AS sure_is_right, true AS proper_is_whole FROM planted, (VALUES (1), (2)) v(mate)", "planted")
def paired_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pair of each long contig, 260 bases from end to end and converted on the parent strand, aligned against all contigs; contigs where a mate is a copy of itself up to 30 bases further, which has no one
    place, are left out. Every mate has a record; one of quality 20 or more lies where it was taken from, and has, in a
    proper pair, an insert of 260 bases."""
    genome = fx.genome(spark, sf_dir)
    p = F.col("tid") * 131 % (F.length("seq") - 400)
    # a generator's row: the text is cut once and not again for each distance that it is compared at
    cut = F.explode(F.array(sq.convert(F.substr("seq", p.cast("int") + 1, F.lit(260)), True))).alias("s")
    plant = genome.where(F.length("seq") >= 600).select(F.col("tid").alias("rid"), F.col("chrom").alias("own"), p.cast("int").alias("p"), cut)
    shifted = lambda d, a: F.substr("s", d + a, F.lit(60) - d) == F.substr("s", F.lit(a), F.lit(60) - d)
    plant = plant.where(~F.exists(F.sequence(F.lit(1), F.lit(30)), lambda d: shifted(d, 1) | shifted(d, 201)))
    side = lambda m, s, at: plant.select("rid", F.lit(m).alias("mate"), s.alias("seq"), "own", (F.col("p") + at).alias("at"))
    both = store.written(side(1, F.substring("s", 1, 60), 1).unionByName(side(2, sq.revcomp(F.substring("s", 201, 60)), 201)), "planted-pairs")
    reads = both.select("rid", "mate", "seq")
    o = align.Options(directional=True)
    got = align.pair_up(reads, align.hits(reads, genome, o, _index(spark, sf_dir)), genome, (100, 500, 260.0, 20.0), o)
    told = both.join(got.select("rid", "mate", "chrom", "pos1", "mapq", "isize", "flag"), ["rid", "mate"], "left")
    right = (F.col("chrom") == F.col("own")) & (F.col("pos1") == F.col("at"))
    proper = (F.col("flag").bitwiseAND(2) != 0) & (F.col("mapq") >= 20)
    return told.select("rid", "mate", F.col("chrom").isNotNull().alias("found"), F.coalesce((F.col("mapq") < 20) | right, F.lit(True)).alias("sure_is_right"), F.coalesce(~proper | (F.abs("isize") == 260), F.lit(True)).alias("proper_is_whole"))


@query("insert_size_model", """SELECT n, p25, p50, p75, round(mean, 9) AS mean, round(sd, 6) AS sd, CAST(greatest(1, least(trunc(p25 - 3.0 * (p75 - p25) + 0.499), trunc(mean - 4 * sd + 0.499))) AS INTEGER) AS low, CAST(greatest(trunc(p75 + 3.0 * (p75 - p25) + 0.499), trunc(mean + 4 * sd + 0.499)) AS INTEGER) AS high FROM
 (SELECT any_value(n) AS n, any_value(p25) AS p25, any_value(p50) AS p50, any_value(p75) AS p75, avg(isize) AS mean, stddev_pop(isize) AS sd FROM (SELECT *, l[CAST(floor(0.25 * n + 0.499) AS BIGINT) + 1] AS p25, l[CAST(floor(0.5 * n + 0.499) AS BIGINT) + 1] AS p50, l[CAST(floor(0.75 * n + 0.499) AS BIGINT) + 1] AS p75 FROM
 (SELECT isize, count(*) OVER () AS n, list_sort(list(isize) OVER ()) AS l FROM kept WHERE flag & 2 <> 0 AND isize BETWEEN 1 AND 5000)) WHERE isize >= greatest(1, trunc(p25 - 2.0 * (p75 - p25) + 0.499)) AND isize <= trunc(p75 + 2.0 * (p75 - p25) + 0.499))""", "kept")
def insert_size_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bases.keep_reads(fx.alignments(spark, sf_dir)).where(bases.has(bases.PROPER))
    return align.insert_model(rows.select("isize")).withColumns({"mean": F.round("mean", 9), "sd": F.round("sd", 6)})


# -- files -----------------------------------------------------------------------------------------------------------

_BAM_COLUMNS = ["sid", "qname", "flag", "chrom", "pos1", "mapq", "cigar", "mpos1", "isize", "seq", "qual", "NM", "AS", "MC", "YD", "ZS", "XG"]


@query("bam_round_trip", "SELECT " + ", ".join(f'"{c}"' for c in _BAM_COLUMNS) + " FROM aln", "aln")
def bam_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reads written as BAM, a folder a sample, and read back by splits of 256 kB."""
    aln = fx.alignments(spark, sf_dir)
    contigs = gn.lengths(fx.genome(spark, sf_dir))
    found = None
    for sid in (0, 1):
        path = store.fresh(spark, f"bam-{sid}")
        bam.write(aln.where(F.col("sid") == sid), path, contigs)
        one = bam.read(spark, path, sid, split=1 << 18)
        found = one if found is None else found.unionByName(one)
    return found.select(*_BAM_COLUMNS)


@query("fastq_round_trip", "SELECT row_number() OVER (ORDER BY ord) - 1 AS ord, name, seq1 AS seq, qual1 AS qual FROM fq", "fq")
def fastq_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First mates written as FASTQ, a file a range of ordinals, and read back by splits of 256 kB."""
    path = store.fresh(spark, "fastq")
    sink.write(sink.fastq_lines(fx.fastq(spark, sf_dir)), path, ("ord",))
    return sequences.fastq(spark, path, split=1 << 18).select("ord", "name", "seq", "qual")


def _fasta_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The genome written as FASTA with 60 bases a line, and read back in pieces of 4,096 bases by splits of 256 kB."""
    path = store.fresh(spark, "fasta")
    lines = F.concat(F.lit(">"), "chrom", F.lit(" contig\n"), F.regexp_replace("seq", "(.{60})(?=.)", "$1\n"))
    fx.genome(spark, sf_dir).select(lines.alias("value")).write.text(path)
    return sequences.fasta(spark, path, split=1 << 18, piece=4096, flank=4096)


@query("fasta_cpg_sites", "SELECT chrom, pos1 - 1 AS beg0, pos1 + 1 AS \"end\" FROM site WHERE ref = 'C' AND substr(five, 4, 1) = 'G'", "site")
def fasta_cpg_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gn.cpg_sites(_fasta_pieces(spark, sf_dir))


@query("fasta_conversion", "SELECT * FROM conv", "conv")
def fasta_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversion counts of reads against pieces of contigs."""
    return readqc.conversion_counts(fx.alignments(spark, sf_dir), _fasta_pieces(spark, sf_dir)).drop("sid")


oracle.define("mated", """SELECT rid // (2 * n) * n + rid % n AS g, (rid // n) % 2 AS m, chrom, pos1 - 1 AS b, flag & 16 <> 0 AS back, coalesce("NM", 0) AS nm, s, q FROM aln JOIN
 (SELECT rid, string_agg(CASE WHEN op = 'D' THEN 'N' ELSE qb END, '' ORDER BY rpos) AS s, string_agg(CASE WHEN op = 'D' THEN 'B' ELSE chr(CAST(bq + 33 AS INTEGER)) END, '' ORDER BY rpos) AS q FROM px WHERE op IN ('M', 'D') GROUP BY rid) USING (rid),
 (SELECT count(*) AS n FROM documents) WHERE flag & 4 = 0 AND flag & 256 = 0 AND flag & 512 = 0 AND flag & 1024 = 0""", "aln", "px")
oracle.define("frag", """SELECT x.chrom, 'f' || CAST(g AS VARCHAR) AS qname, x.nm + y.nm AS nm, x.back, CASE WHEN x.back THEN y.b ELSE x.b END AS beg0, CASE WHEN x.back THEN x.b + length(x.s) ELSE y.b + length(y.s) END AS "end",
 CASE WHEN x.back THEN x.b - y.b - length(y.s) ELSE y.b - x.b - length(x.s) END AS gap, CASE WHEN x.back THEN reverse(translate(x.s, 'ACGTN', 'TGCAN')) ELSE x.s END AS xs, CASE WHEN x.back THEN reverse(translate(y.s, 'ACGTN', 'TGCAN')) ELSE y.s END AS ys,
 CASE WHEN x.back THEN reverse(x.q) ELSE x.q END AS xq, CASE WHEN x.back THEN reverse(y.q) ELSE y.q END AS yq FROM mated x JOIN mated y USING (g) WHERE x.m = 0 AND y.m = 1 AND x.chrom = y.chrom""", "mated")


@query("fragment_merge", """SELECT chrom, beg0, "end", qname, nm, CASE WHEN back THEN '-' ELSE '+' END AS strand, substr(xs, 1, "end" - beg0) || repeat('N', greatest(gap, 0)) || substr(ys, greatest(-gap, 0) + 1) AS seq,
 substr(xq, 1, "end" - beg0) || repeat('B', greatest(gap, 0)) || substr(yq, greatest(-gap, 0) + 1) AS qual FROM frag WHERE "end" - beg0 BETWEEN 1 AND 2000""", "frag")
def fragment_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of one contig, in the order of their numbers, as mates."""
    n, e = spark.read.parquet(f"{sf_dir}/documents.parquet").count(), F.col("rid")
    name = F.concat(F.lit("f"), (F.floor(e / (2 * n)) * n + e % n).cast("string"))
    mate = F.when(F.floor(e / n) % 2 == 0, 64).otherwise(128)
    aln = fx.alignments(spark, sf_dir).withColumns({"qname": name, "flag": (F.col("flag").bitwiseAND(~192) + mate).cast("int")}).drop("sid")
    return fragments.merged(aln, longest=2000)


# -- two samples whose reads have the same numbers -------------------------------------------------------------------


def _two_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.alignments(spark, sf_dir).withColumns({"sid": (F.col("rid") % 2).cast("int"), "rid": F.floor(F.col("rid") / 2)})


@query("two_samples_conversion", "SELECT rid % 2 AS sid, rid // 2 AS rid, * EXCLUDE (rid) FROM conv", "conv")
def two_samples_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readqc.conversion_counts(_two_samples(spark, sf_dir), fx.genome(spark, sf_dir))


@query("two_samples_pairwise", "SELECT rid % 2 AS sid, rid // 2 AS rid, * EXCLUDE (rid) FROM prw", "prw")
def two_samples_pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return epiread.pairwise(epiread.states(_two_samples(spark, sf_dir), fx.genome(spark, sf_dir), fx.snps(spark, sf_dir)))


@query("two_samples_max_retention", """SELECT * FROM (SELECT chrom, rpos AS pos1, rid % 2 AS sid, count(*) FILTER (meth = 'R') AS n_ret, count(*) FILTER (meth = 'C') AS n_conv FROM coded
 WHERE rid IN (SELECT rid FROM base GROUP BY rid HAVING count(*) FILTER (bss = 1 AND rb = 'C' AND qb = 'C' OR bss = 0 AND rb = 'G' AND qb = 'G') <= 10) GROUP BY chrom, rpos, rid % 2) WHERE n_ret + n_conv > 0""", "coded", "base")
def two_samples_max_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = pileup.Options(bases.Filters(max_retention=10))
    return pileup.counts(pileup.site_bases(_two_samples(spark, sf_dir), fx.genome(spark, sf_dir), o)).where("n_ret + n_conv > 0").select("chrom", "pos1", "sid", "n_ret", "n_conv")


# -- tumour and normal -----------------------------------------------------------------------------------------------

oracle.define("som", """SELECT chrom, pos1, max(ref) AS ref, max(gt) FILTER (sid = 1) AS n_gt, """ + ", ".join(f"coalesce(max(n_{b}) FILTER (sid = {s}), 0) AS {p}{b}" for s, p in ((0, "t"), (1, "n")) for b in "ACGTYR") + " FROM call WHERE alt IS NOT NULL GROUP BY chrom, pos1", "call")


oracle.define("sommut", """SELECT chrom, pos1, ref, n_gt, alt_t, CASE ref WHEN 'A' THEN tA WHEN 'C' THEN tC WHEN 'G' THEN tG ELSE tT END AS ref_t, CASE ref WHEN 'A' THEN nA WHEN 'C' THEN nC WHEN 'G' THEN nG ELSE nT END AS ref_n,
 CASE alt_t WHEN 'A' THEN tA WHEN 'C' THEN tC WHEN 'G' THEN tG WHEN 'T' THEN tT WHEN 'Y' THEN tY WHEN 'R' THEN tR ELSE 0 END AS mut_t, CASE alt_t WHEN 'A' THEN nA WHEN 'C' THEN nC WHEN 'G' THEN nG WHEN 'T' THEN nT WHEN 'Y' THEN nY WHEN 'R' THEN nR ELSE 0 END AS mut_n FROM
 (SELECT *, (SELECT b FROM (VALUES ('A', 0, tA), ('C', 1, tC), ('G', 2, tG), ('T', 3, tT), ('Y', 5, CASE WHEN ref IN ('C', 'T') THEN 0 ELSE tY END), ('R', 6, CASE WHEN ref IN ('A', 'G') THEN 0 ELSE tR END)) v(b, k, n) WHERE n > 0 AND b <> ref ORDER BY n DESC, k LIMIT 1) AS alt_t FROM som)""", "som")


@query("somatic_mutant", "SELECT * EXCLUDE (n_gt) FROM sommut", "sommut")
def somatic_mutant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pileup.somatic(_calls(spark, sf_dir)).drop("ss", "sc")


def _somatic_sql() -> str:
    """Normal and tumour genotypes 0/0, 0/1, 1/1 in all pairs; a pair is somatic if the normal is 0/0 and the tumour is not."""
    rates, normal, mu = (0.01, 0.5, 0.99), (1 - 1.5 * 0.001, 0.001, 0.001 / 2), 0.001
    lp = {(n, t): f"ref_n * ln({1 - rates[n]!r}) + mut_n * ln({rates[n]!r}) + ref_t * ln({1 - rates[t]!r}) + mut_t * ln({rates[t]!r}) + ln({normal[n] * (1 - 2 * mu if n == t else mu)!r})" for n in range(3) for t in range(3)}
    pairs = ", ".join(f"{x} AS p{n}{t}" for (n, t), x in lp.items())
    part = lambda want: " + ".join(f"exp(p{n}{t} - top)" for n, t in lp if (n == 0 and t > 0) == want)
    top = "greatest(" + ", ".join(f"p{n}{t}" for n, t in lp) + ")"
    score = f"CASE WHEN alt_t IS NULL THEN 0.0 ELSE CASE WHEN no > 0 THEN least(1000.0, greatest(0.0, -10 * log10(no / (no + yes)))) ELSE 1000.0 END END"
    return f"""SELECT chrom, pos1, ref, alt_t, ref_t, mut_t, ref_n, mut_n, CASE WHEN alt_t IS NULL THEN 5 WHEN round(sc, 6) > 1 THEN 2 WHEN n_gt LIKE '%1' THEN 1 ELSE 0 END AS ss, round(sc, 4) AS sc FROM
 (SELECT *, {score} AS sc FROM (SELECT *, {part(True)} AS yes, {part(False)} AS no FROM (SELECT *, {top} AS top FROM (SELECT *, {pairs} FROM sommut))))"""


@query("somatic_status", _somatic_sql(), "sommut")
def somatic_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pileup.somatic(_calls(spark, sf_dir)).withColumn("sc", F.round("sc", 4))

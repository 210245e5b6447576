"""Methylation tables: from called sites to BED rows, both strands of a CpG merged, averages by context, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources import genome as gn


def _wanted(kind: str) -> Column:
    n5, cx = F.col("n5"), F.col("cx")
    cg, gc = F.substring(n5, 4, 1) == "G", F.substring(n5, 2, 1) == "G"
    known = cx.isNotNull() & (cx != "CN")
    return {"c": F.col("cx").isNotNull(), "cg": known & cg, "ch": known & ~cg, "hcg": known & cg & ~gc, "gch": known & gc & ~cg}[kind]


def vcf2bed(called: DataFrame, target: str = "cg", min_cov: int = 3) -> DataFrame:
    """(chrom, beg0, end, sid, beta, cov, m, u, ref, cx, ctx2, n5) of sites with enough coverage in any sample; samples that are not callable have a null beta and cov 0."""
    any_cov = F.max("cov").over(W.partitionBy("chrom", "pos1"))
    rows = called.where(_wanted(target)).withColumn("_any", any_cov).where(F.col("_any") >= max(min_cov, 1))
    m = F.floor(F.col("beta") * F.col("cov") + 0.5).cast("int")
    return rows.select("chrom", (F.col("pos1") - 1).alias("beg0"), F.col("pos1").alias("end"), "sid", "beta", "cov", m.alias("m"), (F.col("cov") - m).alias("u"), "ref", "cx", F.substring("n5", 3, 2).alias("ctx2"), "n5")


def vcf2bed_snp(called: DataFrame, min_cov: int = 3) -> DataFrame:
    """(chrom, beg0, end, ref, alt, sid, gt, sp, ac, af1) of sites with an alternative allele: largest AC at least min_cov and largest AF above 0."""
    s = W.partitionBy("chrom", "pos1")
    rows = called.where("alt is not null").withColumn("_ac", F.max("ac").over(s)).withColumn("_af", F.max("af1").over(s)).where((F.col("_ac") >= min_cov) & (F.col("_af") > 0))
    return rows.select("chrom", (F.col("pos1") - 1).alias("beg0"), F.col("pos1").alias("end"), "ref", F.when(F.col("alt").isin("Y", "R"), "N").otherwise(F.col("alt")).alias("alt"), "sid", "gt", "sp", "ac", "af1")


def mergecg(meth: DataFrame, genome: DataFrame | None = None, nome: bool = False, min_depth: int = 0) -> DataFrame:
    """(chrom, beg0, end, sid, beta, cov, c_beta, c_cov, g_beta, g_cov): the C and the G of each CpG as one row of two bases.

    ``meth`` has chrom, beg0, sid, beta, cov; rows off CpGs are left out. With ``nome`` only CpGs that no G precedes and no C follows count. Counts are
    beta times cov in single precision, rounded half to even. Each row knows its CpG, so the merge is one
    aggregation by CpG and needs no order along the contig. Rows with ref and n5 need no genome; others (chrom, beg0, sid, beta, cov alone) look their base up there.
    """
    if {"ref", "n5"} <= set(meth.columns):
        ok = F.substring("n5", 4, 1) == "G"
        if nome:
            ok &= (F.substring("n5", 2, 1) != "G") & (F.substring("n5", 5, 1) != "C")
        return _merged(meth.where(ok).withColumn("side", F.col("ref")), min_depth)
    if genome is None:
        raise ValueError("rows without ref and n5 need the genome")
    pairs = gn.cpg_sites(genome, beside=nome)
    if nome:
        pairs = pairs.where((F.col("before") != "G") & (F.col("behind") != "C"))
    # two rows a CpG, none for other bases
    site = pairs.select("chrom", F.inline(F.array(F.struct(F.col("beg0").alias("beg0"), F.lit("C").alias("side")), F.struct((F.col("beg0") + 1).alias("beg0"), F.lit("G").alias("side")))))
    return _merged(meth.join(site, ["chrom", "beg0"]), min_depth)


def _merged(rows: DataFrame, min_depth: int) -> DataFrame:
    rows = rows.withColumn("cpg", F.when(F.col("side") == "C", F.col("beg0")).otherwise(F.col("beg0") - 1))
    beta, cov = (lambda s: F.max(F.when(F.col("side") == s, F.col("beta")))), (lambda s: F.coalesce(F.max(F.when(F.col("side") == s, F.col("cov"))), F.lit(0)))
    both = rows.groupBy("chrom", F.col("cpg").alias("beg0"), "sid").agg(beta("C").alias("c_beta"), cov("C").alias("c_cov"), beta("G").alias("g_beta"), cov("G").alias("g_cov"))
    m = lambda s: F.when(F.col(f"{s}_cov") > 0, F.rint((F.col(f"{s}_beta").cast("float") * F.col(f"{s}_cov").cast("float")).cast("float").cast("double"))).otherwise(0.0)
    total = F.col("c_cov") + F.col("g_cov")
    deep = both.withColumn("_any", F.max(total).over(W.partitionBy("chrom", "beg0"))).where(F.col("_any") >= min_depth)
    return deep.select("chrom", "beg0", (F.col("beg0") + 2).alias("end"), "sid", F.when(total > 0, (m("c") + m("g")) / total).alias("beta"), total.alias("cov"), "c_beta", "c_cov", "g_beta", "g_cov")


def base_conversion(bed: DataFrame, least: int = 20) -> DataFrame:
    """(ctx2, n, mean_beta): mean beta by cytosine and following base; -1 for fewer than ``least`` sites. ``bed`` comes from :func:`vcf2bed` with target c."""
    got = bed.where("cov > 0 and beta is not null").groupBy("ctx2").agg(F.count("*").alias("n"), F.avg("beta").alias("b"))
    return got.where(F.col("ctx2").isin("CA", "CC", "CG", "CT")).select("ctx2", "n", F.when(F.col("n") < least, -1.0).otherwise(F.col("b")).alias("mean_beta"))


def methylkit(bed: DataFrame) -> DataFrame:
    """(chrBase, chr, base, strand, coverage, freqC, freqT) of the rows with coverage."""
    strand = F.when(F.col("ref") == "C", "F").otherwise("R")
    return bed.where("cov > 0").select("sid", F.concat_ws(".", "chrom", F.col("end").cast("string")).alias("chrBase"), F.col("chrom").alias("chr"), F.col("end").alias("base"), strand.alias("strand"), F.col("cov").alias("coverage"), (100 * F.col("beta")).alias("freqC"), (100 * (1 - F.col("beta"))).alias("freqT"))


def wide(bed: DataFrame, samples: list[int]) -> DataFrame:
    """One row a site with beta and cov of each sample, as the text format has it."""
    pick = lambda c, s: F.max(F.when(F.col("sid") == s, F.col(c))).alias(f"{c}_{s}")
    return bed.groupBy("chrom", "beg0", "end").agg(*[pick(c, s) for s in samples for c in ("beta", "cov")])

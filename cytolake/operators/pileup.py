"""Pileup: bases of many reads brought together by site, and what follows from their counts.

One shuffle brings a site together (partial sums on the map side first, so a deep site is no burden); everything after is arithmetic on
its one row. Sites are kept long, a row a sample; figures over all samples of a site come from a second aggregation joined on the same key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import seq as sq
from ..functions import stats
from ..sources import genome as gn
from . import bases

READ = ("rid", "sid", "chrom", "blk", "flag", "mpos1", "mspan", "span", "bss", "rlen")
CODES = ("A", "C", "G", "T", "Y", "R")
#: Below this share of unconverted-looking T (A) beside C (G), a cytosine still counts as callable.
CONFLICT = 0.05


@dataclass(frozen=True)
class Options:
    filters: bases.Filters = bases.Filters()
    redistribute: bool = True
    nome: bool = False
    verbose: bool = False


def stranded(aln: DataFrame, genome: DataFrame, f: bases.Filters) -> DataFrame:
    """Kept reads, dealt to the blocks that they touch."""
    return bases.with_mate_span(bases.with_strand(bases.with_slice(bases.keep_reads(aln, f), genome, max_span=f.max_span, dealt=True))).withColumn("rlen", F.length("seq"))


def read_retention(rows: DataFrame) -> DataFrame:
    """([sid,] rid, n_retained): unchanged bases on the strand that conversion does not touch; what ``max_retention`` limits."""
    kept = ((F.col("bss") == 1) & (F.col("rb") == "C") & (F.col("qb") == "C")) | ((F.col("bss") == 0) & (F.col("rb") == "G") & (F.col("qb") == "G"))
    return rows.groupBy(*bases.key(rows)).agg(F.count_if(kept).alias("n_retained"))


def site_bases(aln: DataFrame, genome: DataFrame, o: Options = Options()) -> DataFrame:
    """One row per aligned base of a kept read: site, sample, base and state codes, and whether it counts."""
    f = o.filters
    reads = stranded(aln, genome, f)
    if f.max_retention < 999_999:  # counted in the read's row, which has its whole slice in every block
        kept = F.when(F.col("bss") == 1, bases.same_bases("C")).otherwise(bases.same_bases("G"))
        reads = reads.withColumn("_kept", F.explode(F.array(kept))).where(F.col("_kept") <= f.max_retention).drop("_kept")
    rows = bases.own_bases(bases.aligned(reads, READ), max_span=f.max_span)
    if f.drop_contig_end:
        ends = gn.lengths(genome).withColumnRenamed("n", "clen")
        rows = rows.join(ends, "chrom").where(F.col("rpos") < F.col("clen")).drop("clen")
    counts = bases.base_passes(f, F.col("rlen"))
    if f.drop_double:
        counts = counts & ~bases.counted_twice()
    return coded(rows).withColumn("good", counts)


def coded(rows: DataFrame) -> DataFrame:
    """Adds code (base with the ambiguity that conversion leaves) and meth (R, C or N)."""
    w, c, rb, qb = F.col("bss") == 0, F.col("bss") == 1, F.col("rb"), F.col("qb")
    code = F.when(w & (qb == "T"), "Y").when(c & (qb == "A"), "R").otherwise(qb)
    meth = F.when((w & (rb == "C") & (qb == "C")) | (c & (rb == "G") & (qb == "G")), "R").when((w & (rb == "C") & (qb == "T")) | (c & (rb == "G") & (qb == "A")), "C").otherwise("N")
    return rows.withColumn("code", code).withColumn("meth", meth)


def counts(rows: DataFrame, dealt: bool = False) -> DataFrame:
    """(chrom[, blk], pos1, sid, ref, five, n_ret, n_conv, dp, n_A .. n_R): dp counts all bases of kept reads, the rest those that pass.

    With ``dealt`` sites keep the block by which they lie together, and what sums over their samples needs no shuffle. A place has one reference base and one context, so both are keys: texts in the sums' stead would have every base sorted before it is counted."""
    good = F.col("good")
    sites = rows.where(F.col("rb") != "N").groupBy(*_dealt(rows), F.col("rpos").alias("pos1"), "sid", F.col("rb").alias("ref"), "five").agg(
        F.count_if(good & (F.col("meth") == "R")).alias("n_ret"), F.count_if(good & (F.col("meth") == "C")).alias("n_conv"), F.count("*").alias("dp"),
        *[F.count_if(good & (F.col("code") == b)).alias(f"n_{b}") for b in CODES],
    )
    return sites if dealt else sites.drop("blk")


def _dealt(rows: DataFrame) -> list[str]:
    """By what bases and sites lie together: the contig and, where reads were dealt to blocks, the block. It is in every key, so that one shuffle, that of the reads, serves all."""
    return ["chrom", "blk"] if "blk" in rows.columns else ["chrom"]


def site(sites: DataFrame) -> W:
    return W.partitionBy(*_dealt(sites), "pos1")


def redistributed(sites: DataFrame) -> DataFrame:
    """Moves Y to T or C, and R to A or G, where all samples together show only one of the two; all rules look at the counts before."""
    all_of = {b: F.sum(f"n_{b}").over(site(sites)) for b in "ACGT"}
    seen = sites.select("*", *[x.alias(f"_all_{b}") for b, x in all_of.items()])

    def only(b: str, other: str) -> Column:
        return ((F.col("ref") == b) | (F.col(f"_all_{b}") > 0)) & (F.col(f"_all_{other}") == 0) & (F.col("ref") != other)

    to_t, to_c, to_a, to_g = only("T", "C"), only("C", "T"), only("A", "G"), only("G", "A")
    part = lambda cond, n: F.when(cond, F.col(n)).otherwise(0)
    return seen.select(
        *[c for c in sites.columns if not c.startswith("n_") or c in ("n_ret", "n_conv")],
        (F.col("n_A") + part(to_a, "n_R")).alias("n_A"), (F.col("n_C") + part(to_c & ~to_t, "n_Y")).alias("n_C"), (F.col("n_G") + part(to_g & ~to_a, "n_R")).alias("n_G"), (F.col("n_T") + part(to_t, "n_Y")).alias("n_T"),
        part(~to_t & ~to_c, "n_Y").alias("n_Y"), part(~to_a & ~to_g, "n_R").alias("n_R"),
    )


def top_mutant(count_of: dict[str, Column], ref: Column) -> Column:
    """The base other than the reference's with the highest count, ties to the lower code; null if none. R and Y do not count against a reference they include."""
    best = F.lit(None).cast("struct<n:bigint,k:int,b:string>")
    for k, b in enumerate("ACGTNYR"):
        if b == "N":
            continue
        usable = (count_of[b] > 0) & (ref != b)
        if b == "R":
            usable &= ~ref.isin("A", "G")
        if b == "Y":
            usable &= ~ref.isin("C", "T")
        one = F.when(usable, F.struct(count_of[b].cast("bigint").alias("n"), F.lit(-k).alias("k"), F.lit(b).alias("b")))
        best = F.greatest(best, one)
    return best["b"]


def callable_(n_ret: Column, n_conv: Column, ref: Column, count_of: dict[str, Column]) -> Column:
    def clean(base: str, change: str) -> Column:
        return (ref == base) & ((count_of[change] == 0) | ((count_of[base] > 0) & (count_of[change] / count_of[base] < CONFLICT)))

    return (n_ret + n_conv > 0) & (clean("C", "T") | clean("G", "A"))


def _n(prefix: str = "n_") -> dict[str, Column]:
    return {b: F.col(f"{prefix}{b}") for b in CODES}


def calls(sites: DataFrame, o: Options = Options()) -> DataFrame:
    """All that a site's line needs, a row per sample: mutant over all samples, context, callable, beta, cov, genotype, depth, support, AC, AF, site quality."""
    support = _support(F.col("ref"), _n())
    told = sites.withColumn("sp", support)
    if not o.verbose:  # most sites show the reference alone; they go before the sums over samples
        told = told.withColumn("_any", F.max((F.col("n_ret") + F.col("n_conv") > 0) | _other(F.col("ref"), _n())).over(site(told))).where("_any").drop("_any")
    if o.redistribute:
        told = redistributed(told)
    total = {b: F.sum(f"n_{b}").over(site(told)) for b in CODES}
    told = told.select("*", *[x.alias(f"_t_{b}") for b, x in total.items()], F.sum(F.col("n_ret") + F.col("n_conv")).over(site(told)).alias("_meth"))
    told = told.withColumn("alt", top_mutant(_n("_t_"), F.col("ref")))
    if not o.verbose:
        told = told.where(F.col("alt").isNotNull() | (F.col("_meth") > 0))
    five = sq.oriented(F.col("five"), F.col("ref"))
    pick = lambda b: F.coalesce(*[F.when(b == x, F.col(f"n_{x}")) for x in CODES], F.lit(0))
    told = told.withColumn("nref", pick(F.col("ref"))).withColumn("nalt", F.when(F.col("alt").isNull(), 0).otherwise(pick(F.col("alt"))))
    told = stats.with_genotype(told)
    told = told.select("*", F.min("gq").over(site(told)).alias("_least"), callable_(F.col("n_ret"), F.col("n_conv"), F.col("ref"), _n()).alias("callable"))
    out = told.select(
        "chrom", "pos1", "sid", "ref", "alt", F.when(F.col("ref").isin("C", "G"), sq.context(five, F.col("ref"), o.nome)).alias("cx"), F.when(F.col("ref").isin("C", "G"), five).alias("n5"),
        "n_ret", "n_conv", *[f"n_{b}" for b in CODES], "dp", "sp", "callable", F.when(F.col("callable"), F.col("n_ret") / (F.col("n_ret") + F.col("n_conv"))).alias("beta"),
        F.when(F.col("callable"), F.col("n_ret") + F.col("n_conv")).otherwise(0).alias("cov"), "gt", "gl0", "gl1", "gl2", "gq",
        F.when(F.col("alt").isNotNull(), F.col("nref") + F.col("nalt")).alias("ac"), F.when(F.col("alt").isNotNull() & (F.col("nref") + F.col("nalt") > 0), F.col("nalt") / (F.col("nref") + F.col("nalt"))).alias("af1"),
        F.floor(F.round("_least", 6)).cast("int").alias("qual"), (F.round("_least", 6) > 5).alias("pass"),
    )
    return out


def _other(ref: Column, count_of: dict[str, Column]) -> Column:
    """Whether a row has a base that the reference's, converted or not, does not explain; without one, and without a cytosine's state, a site has no mutant whatever Y and R are taken for."""
    found = F.lit(False)
    for b, n in count_of.items():
        found |= (n > 0) & (ref != b) & ~ref.isin(*{"Y": ("C", "T"), "R": ("A", "G")}.get(b, (b,)))
    return found


def _support(ref: Column, count_of: dict[str, Column]) -> Column:
    """Counts before redistribution: the reference base first, then codes in order; "." if none."""
    first = F.concat(*[F.when((ref == b) & (n > 0), F.concat(F.lit(b), n.cast("string"))).otherwise("") for b, n in count_of.items()])
    rest = F.concat(*[F.when((ref != b) & (count_of[b] > 0), F.concat(F.lit(b), count_of[b].cast("string"))).otherwise("") for b in CODES])
    both = F.concat(first, rest)
    return F.when(both == "", ".").otherwise(both)


def somatic(called: DataFrame, tumour: int = 0, normal: int = 1) -> DataFrame:
    """(chrom, pos1, ref, alt_t, ss, sc): one row a site with a mutant. ss is 2 for somatic, 1 where the normal carries the allele, 0 where it does not, 5 where the
    tumour shows none."""
    keep = ("n_ret", "gt", *[f"n_{b}" for b in CODES])
    side = lambda s, p: called.where((F.col("sid") == s) & F.col("alt").isNotNull()).select("chrom", "pos1", F.col("ref").alias(f"{p}ref"), *[F.col(c).alias(p + c) for c in keep])
    both = side(tumour, "t_").join(side(normal, "n_"), ["chrom", "pos1"], "full")
    ref = F.coalesce("t_ref", "n_ref")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    mutant = top_mutant({b: zero(f"t_n_{b}") for b in CODES}, ref)
    both = both.withColumn("ref", ref).withColumn("alt_t", mutant)
    pick = lambda p, b: F.coalesce(*[F.when(b == x, zero(f"{p}n_{x}")) for x in CODES], F.lit(0))
    both = both.select("*", pick("t_", F.col("ref")).alias("ref_t"), pick("t_", F.col("alt_t")).alias("mut_t"), pick("n_", F.col("ref")).alias("ref_n"), pick("n_", F.col("alt_t")).alias("mut_n"))
    both = stats.with_somatic_quality(both, "ref_t", "mut_t", "ref_n", "mut_n").withColumn("sc", F.when(F.col("alt_t").isNotNull(), F.col("sq")).otherwise(0.0))
    ss = F.when(F.col("alt_t").isNull(), 5).when(F.round("sc", 6) > 1, 2).when(F.coalesce(F.col("n_gt"), F.lit("./.")).endswith("1"), 1).otherwise(0)
    return both.select("chrom", "pos1", "ref", "alt_t", "ref_t", "mut_t", "ref_n", "mut_n", ss.alias("ss"), "sc")


def average_methylation(called: DataFrame, nome: bool = False) -> DataFrame:
    """(sid, chrom, cx, n, mean_beta): by sample, contig and context, and over the whole genome (chrom null); CHG and CHH also as CH. Contigs without a CG are left out."""
    rows = called.where(F.col("callable") & (F.col("cx") != "CN"))
    main = "HCG" if nome else "CG"
    both = rows.withColumn("cx", F.explode(F.when(F.col("cx").isin("CHG", "CHH"), F.array("cx", F.lit("CH"))).when(F.col("cx").isin("HCHG", "HCHH"), F.array("cx", F.lit("HCH"))).when(F.col("cx").isin("GCG", "GCH"), F.array(F.lit("GC"))).otherwise(F.array("cx"))))
    sums = both.groupBy("sid", "chrom", "cx").agg(F.count("*").alias("n"), F.sum("beta").alias("s"))
    rolled = sums.unionByName(sums.groupBy("sid", "cx").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).withColumn("chrom", F.lit(None).cast("string")))
    has_main = F.max(F.when(F.col("cx") == main, F.col("n"))).over(W.partitionBy("sid", "chrom"))
    return rolled.withColumn("_m", has_main).where(F.col("_m") > 0).select("sid", "chrom", "cx", "n", (F.col("s") / F.col("n")).alias("mean_beta"))


def diagnostics(rows: DataFrame) -> DataFrame:
    """Strings of all counted bases of a site by sample and strand, in order of reads: base, state, quality, orientation and position."""
    one = F.struct("rid", "qpos", "code", "meth", F.char(F.col("bq") + 33).alias("q"), F.when(F.col("flag").bitwiseAND(16) != 0, "-").otherwise("+").alias("o"))
    got = rows.where("good").groupBy("chrom", F.col("rpos").alias("pos1"), "sid", "bss").agg(F.array_sort(F.collect_list(one)).alias("x"))
    text = lambda k: F.array_join(F.transform("x", lambda v: v[k].cast("string")), "," if k == "qpos" else "")
    return got.select("chrom", "pos1", "sid", "bss", text("code").alias("bs"), text("meth").alias("sta"), text("q").alias("bq"), text("o").alias("str"), text("qpos").alias("pos"))

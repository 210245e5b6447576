"""Allele-specific methylation: for each SNP and CpG, whether the allele of a read goes with its call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats

CODES = "ACGTN"


def two_largest(v: Column) -> Column:
    """Indices (from 0) of the two largest of an array, as struct(a, b), starting from the first two: each later value takes the smaller one's slot (the second's on
    equality) if it is no less."""
    kind = "struct<a:int,b:int>"

    def step(s: Column, i: Column) -> Column:
        va, vb, x = F.element_at(v, s["a"] + 1), F.element_at(v, s["b"] + 1), F.element_at(v, i + 1)
        first = va < vb
        return F.struct(F.when(first & (x >= va), i).otherwise(s["a"]).alias("a"), F.when(~first & (x >= vb), i).otherwise(s["b"]).alias("b")).cast(kind)

    return F.aggregate(F.sequence(F.lit(2), F.lit(len(CODES) - 1)), F.struct(F.lit(0).alias("a"), F.lit(1).alias("b")).cast(kind), step)


def tables(pairs: DataFrame) -> DataFrame:
    """(chrom, snp1, cg1, allele1, allele2, call1, call2, n11, n12, n21, n22) of (chrom, snp1, cg1, snp_base, cg_call), over all rows of a pair of sites."""
    code = lambda c: F.greatest(F.lit(0), F.when(F.position(F.col(c), F.lit(CODES)) > 0, F.position(F.col(c), F.lit(CODES)) - 1).otherwise(4))
    cell = (code("snp_base") * 5 + code("cg_call")).cast("int")
    counts = pairs.groupBy("chrom", "snp1", "cg1").agg(F.array(*[F.count_if(cell == k) for k in range(25)]).alias("m"))
    at = lambda r, c: F.element_at("m", (r * 5 + c + 1).cast("int") if isinstance(r, Column) else r * 5 + c + 1)
    total = lambda cells: sum((F.element_at("m", k + 1) for k in cells), F.lit(0))
    sums = counts.select("*", F.array(*[total(range(5 * r, 5 * r + 5)) for r in range(5)]).alias("rs"), F.array(*[total(range(c, 25, 5)) for c in range(5)]).alias("cs"))
    top = sums.select("*", two_largest(F.col("rs")).alias("r"), two_largest(F.col("cs")).alias("c"))
    pos = lambda v, k: F.element_at(v, F.col(k) + 1) > 0
    good = top.where(pos("rs", "r.a") & pos("rs", "r.b") & pos("cs", "c.a") & pos("cs", "c.b") & (F.col("snp1") != F.col("cg1")) & (F.col("c.a") != 4) & (F.col("c.b") != 4))
    letter = lambda k: F.substr(F.lit(CODES), F.col(k) + 1, F.lit(1))
    n = lambda r, c: at(F.col(f"r.{r}"), F.col(f"c.{c}"))
    return good.select("chrom", "snp1", "cg1", letter("r.a").alias("allele1"), letter("r.b").alias("allele2"), letter("c.a").alias("call1"), letter("c.b").alias("call2"), n("a", "a").alias("n11"), n("a", "b").alias("n12"), n("b", "a").alias("n21"), n("b", "b").alias("n22"))


def tests(found: DataFrame) -> DataFrame:
    """Adds p_fisher (two-sided) and p_chisq (no correction) to :func:`tables`."""
    n = [F.col(k).cast("int") for k in ("n11", "n12", "n21", "n22")]
    x = found.select("*", stats.chi_square(*n).alias("_x"))
    return x.select(*found.columns, stats.fisher_two_sided(*n).alias("p_fisher"), F.coalesce(stats.chi_square_p(F.col("_x")), F.lit(1.0)).alias("p_chisq"))

"""Likelihoods and exact tests from their textbook definitions, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Priors of genotypes 0/0, 0/1 and 1/1, base error, contamination; somatic mutation rates.
PRIORS, ERROR, CONTAMINATION = (1 / 3, 1 / 3, 1 / 3), 0.001, 0.01
MU, MU_SOMATIC = 0.001, 0.001
#: Phred values stop here.
MAX_PHRED = 1000.0


def alt_rates(error: float = ERROR, contamination: float = CONTAMINATION) -> tuple[float, float, float]:
    """Chance that a read shows the other allele, by genotype."""
    low = max(error, contamination)
    return low, 0.5, 1 - low


def log_likelihood(nref: Column, nalt: Column, rate: float) -> Column:
    """Binomial, without the coefficient that all genotypes share."""
    return nref * math.log(1 - rate) + nalt * math.log(rate)


def phred(p: Column) -> Column:
    """-10 log10 p, held between 0 and MAX_PHRED."""
    return F.least(F.lit(MAX_PHRED), F.greatest(F.lit(0.0), F.when(p > 0, -10 * F.log10(p)).otherwise(MAX_PHRED)))


def with_genotype(df: DataFrame, nref: str = "nref", nalt: str = "nalt") -> DataFrame:
    """Adds gl0, gl1, gl2 (natural logs with priors), gt and gq; likelihoods are null without reads.

    In steps of plain columns, since one nested expression would be too large for generated code. The best genotype has the greatest
    likelihood, so the others' share of the posterior is their sum relative to it.
    """
    n, m = F.col(nref), F.col(nalt)
    out = df.select("*", *[(math.log(p) + log_likelihood(n, m, r)).alias(f"_g{k}") for k, (p, r) in enumerate(zip(PRIORS, alt_rates(), strict=True))])
    g = [F.col(f"_g{k}") for k in range(3)]
    out = out.select("*", F.when(g[0] > g[1], F.when(g[0] > g[2], 0).otherwise(2)).when(g[1] > g[2], 1).otherwise(2).alias("_best"), F.greatest(*g).alias("_top"))
    out = out.select("*", sum((F.when(F.col("_best") == k, 0.0).otherwise(F.exp(g[k] - F.col("_top"))) for k in range(3)), F.lit(0.0)).alias("_rest"))
    seen = n + m > 0
    gt = F.when(~seen, "./.").otherwise(F.element_at(F.array(F.lit("0/0"), F.lit("0/1"), F.lit("1/1")), F.col("_best") + 1))
    gq = F.when(seen, phred(F.col("_rest") / (1 + F.col("_rest")))).otherwise(0.0)
    return out.select(*df.columns, *[F.when(seen, x).alias(f"gl{k}") for k, x in enumerate(g)], gt.alias("gt"), gq.alias("gq"))


def with_somatic_quality(df: DataFrame, ref_t: str, alt_t: str, ref_n: str, alt_n: str) -> DataFrame:
    """Adds sq: phred of the chance that a pair is not somatic, that is normal 0/0 and tumour with the allele, among all genotype pairs."""
    rates = alt_rates()
    normal = (1 - 1.5 * MU, MU, MU / 2)
    c = F.col
    out = df.select("*", *[log_likelihood(c(ref_n), c(alt_n), r).alias(f"_n{k}") for k, r in enumerate(rates)], *[log_likelihood(c(ref_t), c(alt_t), r).alias(f"_m{k}") for k, r in enumerate(rates)])
    pairs = [(n, t, math.log(normal[n] * (1 - 2 * MU_SOMATIC if t == n else MU_SOMATIC))) for n in range(3) for t in range(3)]
    out = out.select("*", *[(c(f"_n{n}") + c(f"_m{t}") + p).alias(f"_p{n}{t}") for n, t, p in pairs])
    out = out.select("*", F.greatest(*[c(f"_p{n}{t}") for n, t, _ in pairs]).alias("_top"))
    part = lambda want: sum((F.exp(c(f"_p{n}{t}") - c("_top")) for n, t, _ in pairs if (n == 0 and t > 0) == want), F.lit(0.0))
    out = out.select("*", part(True).alias("_yes"), part(False).alias("_no"))
    return out.select(*df.columns, phred(c("_no") / (c("_no") + c("_yes"))).alias("sq"))


#: ln n! of small n; larger ones follow from Stirling's series, whose first term left out is below 1e-15 from here on.
_LOG_FACTORIALS = [math.lgamma(n + 1) for n in range(33)]


def log_factorials(n: Column) -> Column:
    """ln n!, at the same cost for any n."""
    x = F.greatest(n, F.lit(1)).cast("double")
    series = x * F.log(x) - x + F.log(2 * math.pi * x) / 2 + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x) - 1 / (1680 * x * x * x * x * x * x * x)
    small = F.array(*map(F.lit, _LOG_FACTORIALS))
    return F.when(n >= len(_LOG_FACTORIALS), series).otherwise(F.element_at(small, F.greatest(n, F.lit(0)).cast("int") + 1))


def fisher_two_sided(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Two-sided p: all tables with the same margins that are no likelier than the one seen."""
    r1, r2, c1 = a + b, c + d, a + c
    n = r1 + r2
    lf = log_factorials
    const = lf(r1) + lf(r2) + lf(c1) + lf(n - c1) - lf(n)
    # successive tables differ by a ratio, so a fold over the first cell needs no more factorials
    lo, hi = F.greatest(F.lit(0), c1 - r2), F.least(r1, c1)
    lp = lambda x: const - lf(x) - lf(r1 - x) - lf(c1 - x) - lf(r2 - c1 + x)
    # the table seen and the first one go with the fold: within the lambda they would be worked out again at each step
    kind = "struct<lp:double,seen:double,p:double>"
    first = F.struct(lp(lo).alias("lp"), (lp(a) + 1e-7).alias("seen"), F.lit(0.0).alias("p")).cast(kind)
    real = lambda x: x.cast("double")  # noqa: E731  # products of counts are beyond an int

    def step(s: Column, x: Column) -> Column:
        now = s["lp"] + F.log(real(r1 - x + 1) * real(c1 - x + 1)) - F.log(real(x) * real(r2 - c1 + x))
        return F.struct(now.alias("lp"), s["seen"].alias("seen"), (s["p"] + F.when(now <= s["seen"], F.exp(now)).otherwise(0.0)).alias("p")).cast(kind)

    rest = F.when(hi > lo, F.sequence(lo + 1, hi)).otherwise(F.array().cast("array<int>"))
    return F.least(F.lit(1.0), F.aggregate(rest, first, step, lambda s: s["p"] + F.when(lp(lo) <= s["seen"], F.exp(lp(lo))).otherwise(0.0)))


#: A published rational fit of erfc(x) for x >= 0, relative error below 1.2e-7, powers of t = 1 / (1 + x / 2) from 0 on.
_ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def erfc(x: Column) -> Column:
    """Complementary error function of x >= 0."""
    t = 1 / (1 + x / 2)
    p = F.lit(_ERFC[-1])
    for c in reversed(_ERFC[:-1]):
        p = p * t + c
    return t * F.exp(p - x * x)


def chi_square(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Pearson's statistic of a 2x2 table, without continuity correction; null where a row or column is empty."""
    n = (a + b + c + d).cast("double")
    diff = a.cast("double") * d - b.cast("double") * c
    return F.try_divide(n * diff * diff, (a + b).cast("double") * (c + d) * (a + c) * (b + d))


def chi_square_p(x: Column) -> Column:
    """Upper tail with one degree of freedom, erfc(sqrt(x/2)): a series near 0, a continued fraction beyond."""
    z2 = x / 2
    z = F.sqrt(z2)
    scale = 2 / math.sqrt(math.pi)
    kind = "struct<t:double,s:double>"
    term = lambda s, k: F.struct((s["t"] * z2 / (k + 0.5)).alias("t"), (s["s"] + s["t"] * z2 / (k + 0.5)).alias("s")).cast(kind)
    # erf(z) = 2/sqrt(pi) * z * exp(-z^2) * sum of (2z^2)^k / (1*3*...*(2k+1))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")).cast(kind), term, lambda s: s["s"])
    fraction = F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), F.lit(0.0), lambda s, k: (k / 2.0) / (z + s))
    return F.when(x <= 0, 1.0).when(x < 8, 1 - scale * z * F.exp(-z2) * series).otherwise(F.exp(-z2) / math.sqrt(math.pi) / (z + fraction))

"""Both mates of a pair as one stretch of the reference: the sequenced fragment, from where read 1 begins to where read 2 does."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cigar as cg
from ..functions import seq as sq
from . import bases

# What stands for bases that were not read, and their quality.
UNKNOWN, LOW = "N", "B"


def on_reference(text: Column, fill: str) -> Column:
    """A read's bases (or qualities), one for each place of the reference that it spans: none for insertions and clips, ``fill`` for deletions. Needs cigar and pos1."""
    part = lambda b: F.when(b["op"].isin("M", "=", "X"), F.substr(text, b["q"], b["n"])).when(b["op"] == "D", F.repeat(F.lit(fill), b["n"])).otherwise("")
    return F.array_join(F.transform(cg.blocks(F.col("cigar"), F.col("pos1")), part), "")


def merged(aln: DataFrame, longest: int = 10_000, least: int = 1) -> DataFrame:
    """([sid,] chrom, beg0, end, qname, nm, strand, seq, qual): a row a pair, in the direction of read 1.

    Mapped primary reads that passed their filters and are no duplicates. Where both mates have a base read 1's counts; what neither has is N; what lies behind the other mate's start is cut. Names that do not have exactly
    one read 1 and one read 2, mates on different contigs, and fragments of more than ``longest`` or fewer than ``least`` bases are left out. One shuffle, by name.
    """
    bad = bases.has(bases.UNMAPPED) | bases.has(bases.QCFAIL) | bases.has(bases.DUPLICATE) | bases.has(bases.SECONDARY)
    own = [c for c in ("sid",) if c in aln.columns]
    rows = aln.where(~bad).select(*own, "qname", "flag", "chrom", "NM", (F.col("pos1") - 1).alias("b"), on_reference(F.col("seq"), UNKNOWN).alias("s"), on_reference(F.col("qual"), LOW).alias("q"))
    rows = rows.withColumn("e", F.col("b") + F.length("s"))
    one = F.struct("chrom", "b", "e", "s", "q", "NM", bases.has(bases.REVERSE).alias("reverse"))
    side = lambda bit: F.any_value(F.when(bases.has(bit), one), True)
    two = rows.groupBy(*own, "qname").agg(side(bases.READ1).alias("x"), side(bases.READ2).alias("y"), F.count("*").alias("n"), F.count_if(bases.has(bases.READ1) & ~bases.has(bases.READ2)).alias("n1"))
    two = two.where((F.col("n") == 2) & (F.col("n1") == 1) & F.col("y").isNotNull() & (F.col("x.chrom") == F.col("y.chrom")))
    back = F.col("x.reverse")
    two = two.withColumn("beg0", F.when(back, F.col("y.b")).otherwise(F.col("x.b"))).withColumn("end", F.when(back, F.col("x.e")).otherwise(F.col("y.e")))
    n = F.col("end") - F.col("beg0")
    gap = F.when(back, F.col("x.b") - F.col("y.e")).otherwise(F.col("y.b") - F.col("x.e"))

    def joined(first: Column, second: Column, fill: str) -> Column:
        # the second mate begins ``gap`` behind the first, or that many of its bases are the first one's too
        return F.concat(F.substr(first, F.lit(1), n), F.repeat(F.lit(fill), F.greatest(gap, F.lit(0))), F.substr(second, F.greatest(-gap, F.lit(0)) + 1, F.length(second)))

    turned = lambda c: F.when(back, sq.revcomp(F.col(c))).otherwise(F.col(c))
    over = lambda c: F.when(back, F.reverse(F.col(c))).otherwise(F.col(c))
    return two.where(n.between(least, longest)).select(
        *own, F.col("x.chrom").alias("chrom"), "beg0", "end", "qname", (F.coalesce("x.NM", F.lit(0)) + F.coalesce("y.NM", F.lit(0))).alias("nm"), F.when(back, "-").otherwise("+").alias("strand"),
        joined(turned("x.s"), turned("y.s"), UNKNOWN).alias("seq"), joined(over("x.q"), over("y.q"), LOW).alias("qual"),
    )

"""Reads: filters, strand tags, and the aligned columns of each read beside the reference.

Order of work, cheapest first: read filters (pushed to the scan), the reference slice of each read (one equi-join with genome
blocks), then one row per column. A contig's sequence never travels with a base.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cigar as cg
from ..sources import genome as gn

#: Flag bits.
PAIRED, PROPER, UNMAPPED, REVERSE, READ1, READ2, SECONDARY, QCFAIL, DUPLICATE = 0x1, 0x2, 0x4, 0x10, 0x40, 0x80, 0x100, 0x200, 0x400

#: Longest reference span of a read that its block's sequence is sure to cover. A longer read is an error; long-read tables need a larger ``max_span``.
MAX_SPAN = 2048
BLOCK = 4096


@dataclass(frozen=True)
class Filters:
    """Read and base filters with their default values."""

    min_mapq: int = 40
    min_length: int = 10
    min_score: int = 40
    max_nm: int = 999_999
    max_retention: int = 999_999
    min_qual: int = 20
    min_dist5: int = 3
    min_dist3: int = 3
    drop_secondary: bool = True
    drop_duplicate: bool = True
    drop_qcfail: bool = True
    drop_improper: bool = True
    drop_double: bool = True
    drop_contig_end: bool = False
    #: Longest reference span of a read.
    max_span: int = MAX_SPAN


def key(rows: DataFrame) -> list[str]:
    """What tells reads apart: the sample's number too, where there is one. Tables of different samples may number their reads alike."""
    return ["sid", "rid"] if "sid" in rows.columns else ["rid"]


def has(bit: int) -> Column:
    return F.col("flag").bitwiseAND(bit) != 0


def read_passes(f: Filters) -> Column:
    """Everything that flags, scores and tags decide; a missing tag passes."""
    ok = ~has(UNMAPPED) & (F.col("mapq") >= f.min_mapq) & (F.length("seq") >= f.min_length)
    if f.drop_secondary:
        ok &= ~has(SECONDARY)
    if f.drop_duplicate:
        ok &= ~has(DUPLICATE)
    if f.drop_improper:
        ok &= ~has(PAIRED) | has(PROPER)
    if f.drop_qcfail:
        ok &= ~has(QCFAIL)
    return ok & F.coalesce(F.col("NM") <= f.max_nm, F.lit(True)) & F.coalesce(F.col("AS") >= f.min_score, F.lit(True))


def keep_reads(aln: DataFrame, f: Filters = Filters()) -> DataFrame:
    return aln.where(read_passes(f))


def tagged_strand(unknown: bool = False) -> Column:
    """0 or 1 from the tags in order YD, ZS, XG; null where none tells. 2 for YD = u if ``unknown``."""
    yd = F.when(F.col("YD").startswith("f"), 0).when(F.col("YD").startswith("r"), 1)
    if unknown:
        yd = yd.when(F.col("YD").startswith("u"), 2)
    zs = F.when(F.col("ZS").startswith("+"), 0).when(F.col("ZS").startswith("-"), 1)
    return F.coalesce(yd, zs, F.when(F.col("XG") == "CT", 0).when(F.col("XG") == "GA", 1))


def strand_tag() -> Column:
    """f, r, c or u from the tags in order ZS, YD, XG."""
    zs = F.when(F.col("ZS").startswith("+"), "f").when(F.col("ZS").startswith("-"), "r")
    first = F.substring("YD", 1, 1)
    return F.coalesce(zs, F.when(first.isin("f", "r", "c", "u"), first), F.when(F.col("XG") == "CT", "f").when(F.col("XG") == "GA", "r"), F.lit("u"))


def with_slice(aln: DataFrame, genome: DataFrame, block: int = BLOCK, max_span: int = MAX_SPAN, beside: DataFrame | None = None, dealt: bool = False) -> DataFrame:
    """Adds ``slice``: the reference from two bases before the read to two behind it, N beyond the contig, and ``span``.

    Reads meet the block that their first base lies in; blocks overlap by ``max_span``. The join key is (contig, block), so neither contigs nor deep
    places gather in one task more than their reads do. A read that spans more is an error, never a short slice, and so is a read on a contig that the genome lacks or beyond its end. A read without
    a place (no CIGAR) has no slice. ``beside`` has one more column for (chrom, blk), which reads get with their block.

    With ``dealt`` a read goes to every block that it touches, and has its number as ``blk``: all bases of a site are then together by (chrom, blk) without another shuffle (:func:`own_bases` leaves each base to one copy).
    """
    own = gn.blocks(genome, max(block, max_span), max_span).select(F.col("chrom").alias("_c"), F.col("blk").alias("_b"), F.col("beg1").alias("_beg"), F.col("seq").alias("_seq"))
    size = max(block, max_span)
    if beside is not None:
        own = own.join(beside.withColumnsRenamed({"chrom": "_c", "blk": "_b"}), ["_c", "_b"], "left")
    reads = aln.withColumn("span", cg.reference_length(F.col("cigar"))).withColumn("_k", F.floor((F.col("pos1") - 1) / size).cast("int"))
    if dealt:
        last = F.floor((F.col("pos1") - 2 + F.greatest(F.lit(1), F.coalesce("span", F.lit(0)))) / size).cast("int")
        reads = reads.withColumn("_k", F.explode_outer(F.sequence("_k", last)))
        # the number of tasks is given: a read becomes a row a base, which Spark's sizes do not tell
        n = int(aln.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        reads, own = reads.repartition(n, "chrom", "_k"), own.repartition(n, "_c", "_b")
    met = reads.join(own, (F.col("chrom") == F.col("_c")) & (F.col("_k") == F.col("_b")), "left")
    at = F.col("pos1") - F.col("_beg") + 1 + max_span
    # a filter, which no reader of the result leaves out as it may a column
    lost = F.raise_error(F.format_string("a read at %s:%d, which the genome does not have", "chrom", "pos1")).cast("boolean")
    long = F.raise_error(F.format_string("a read spans %d bases of the reference, more than max_span", "span")).cast("boolean")
    placed = F.coalesce("span", F.lit(0)) > 0
    met = met.where(F.when(placed & F.col("_seq").isNull(), lost).when(F.col("span") > max_span, long).otherwise(True))
    whole = F.substr("_seq", at - 2, F.col("span") + 4)
    if dealt:  # a read as long as a flank may lack two bases before its first one, which is another block's
        lacks = 3 - at
        whole = F.when(lacks > 0, F.concat(F.repeat(F.lit("N"), lacks), F.substr("_seq", F.lit(1), F.col("span") + 4 - lacks))).otherwise(whole)
    met = met.withColumn("slice", F.when(placed, whole)).drop("_c", "_b", "_beg", "_seq")
    return met.withColumnRenamed("_k", "blk") if dealt else met.drop("_k")


def own_bases(rows: DataFrame, block: int = BLOCK, max_span: int = MAX_SPAN) -> DataFrame:
    """The columns of dealt reads that lie in their copy's own block: each base of a read once."""
    return rows.where(F.floor((F.col("rpos") - 1) / max(block, max_span)).cast("int") == F.col("blk"))


def columns(reads: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per column of each read: op, col (from 1), qpos (from 1), rpos, rb, qb, bq, five, with the read's ``keep`` columns (the sample
    beside the read's number).

    Deletions have no base of the read, insertions and soft clips none of the reference.
    """
    b = F.col("b")
    keep = (*key(reads), *(k for k in keep if k not in ("sid", "rid"))) if "rid" in keep else keep
    # in a generator's row first: Spark takes a filter on the size of what is exploded from it, which would walk the CIGAR again
    rows = reads.select(*keep, "seq", "qual", "pos1", "slice", F.explode(F.array(cg.blocks(F.col("cigar"), F.col("pos1")))).alias("_bs"))
    rows = rows.select(*keep, "seq", "qual", "pos1", "slice", F.explode("_bs").alias("b")).where(b["op"].isin("M", "=", "X", "I", "D", "S"))
    rows = rows.select(*keep, "seq", "qual", "pos1", "slice", "b", F.explode(F.sequence(F.lit(0), b["n"] - 1)).alias("j"))
    in_query, in_ref = b["op"] != "D", ~b["op"].isin("I", "S")
    q, r = b["q"] + F.col("j"), b["r"] + F.col("j")
    return rows.select(
        *[F.col(k) for k in keep if k != "pos1"], "pos1", b["op"].alias("op"), (b["c"] + F.col("j")).alias("col"), F.when(in_query, q).alias("qpos"), F.when(in_ref, r).alias("rpos"),
        F.when(in_query, F.substr("seq", q, F.lit(1))).alias("qb"), F.when(in_query, F.ascii(F.substr("qual", q, F.lit(1))) - 33).alias("bq"),
        F.when(in_ref, F.substr("slice", r - F.col("pos1") + 3, F.lit(1))).alias("rb"), F.when(in_ref, F.substr("slice", r - F.col("pos1") + 1, F.lit(5))).alias("five"),
    )


def column_array() -> Column:
    """The columns of a read with its slice, as :func:`columns` has them, in an array of its own row."""

    def one(b: Column, j: Column) -> Column:
        in_query, in_ref = b["op"] != "D", ~b["op"].isin("I", "S")
        q, r = b["q"] + j, b["r"] + j
        return F.struct(
            b["op"].alias("op"), (b["c"] + j).alias("col"), F.when(in_query, q).alias("qpos"), F.when(in_ref, r).alias("rpos"), F.when(in_query, F.substr("seq", q, F.lit(1))).alias("qb"),
            F.when(in_query, F.ascii(F.substr("qual", q, F.lit(1))) - 33).alias("bq"), F.when(in_ref, F.substr("slice", r - F.col("pos1") + 3, F.lit(1))).alias("rb"), F.when(in_ref, F.substr("slice", r - F.col("pos1") + 1, F.lit(5))).alias("five"),
        )

    there = F.filter(cg.blocks(F.col("cigar"), F.col("pos1")), lambda b: b["op"].isin("M", "=", "X", "I", "D", "S"))
    return F.flatten(F.transform(there, lambda b: F.transform(F.sequence(F.lit(0), b["n"] - 1), lambda j: one(b, j))))


def aligned(reads: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns of :func:`columns` that have both a base of the read and one of the reference."""
    return columns(reads, keep).where(F.col("op").isin("M", "=", "X"))


def base_passes(f: Filters, length: Column, at: Callable[[str], Column] = F.col) -> Column:
    """Base quality and distance from both ends of the read, in sequence order. ``at`` gives a base's columns by name."""
    return (at("bq") >= f.min_qual) & (at("qpos") > f.min_dist5) & (at("qpos") + f.min_dist3 <= length)


def counted_twice(at: Callable[[str], Column] = F.col) -> Column:
    """A base of read 2 where its mate covers the reference too; needs flag, mpos1 and mspan (span of the mate)."""
    lo, hi = F.greatest("pos1", "mpos1"), F.least(F.col("pos1") + F.col("span") - 1, F.col("mpos1") + F.col("mspan") - 1)
    return has(READ2) & (at("rpos") >= lo) & (at("rpos") <= hi)


def same_bases(base: str) -> Column:
    """How many aligned columns of a read with its slice have this base in the read and in the reference. For a generator's row: a filter would have the slice cut out again for each column."""
    there = F.filter(cg.blocks(F.col("cigar"), F.col("pos1")), lambda b: b["op"].isin("M", "=", "X") & (b["n"] > 0))

    def in_block(b: Column) -> Column:
        ref, got = F.substr("slice", b["r"] - F.col("pos1") + 3, b["n"]), F.substr("seq", b["q"], b["n"])
        return F.size(F.filter(F.sequence(F.lit(1), b["n"]), lambda j: (F.substr(ref, j, F.lit(1)) == base) & (F.substr(got, j, F.lit(1)) == base)))

    return F.aggregate(F.transform(there, in_block), F.lit(0), lambda s, x: s + x)


def with_mate_span(reads: DataFrame) -> DataFrame:
    """The mate's reference length from its CIGAR (MC), else the read's own."""
    return reads.withColumn("mspan", F.coalesce(cg.reference_length(F.col("MC")), F.col("span")))


def inferred_counts(aligned_rows: DataFrame, min_qual: int = 0) -> DataFrame:
    """([sid,] rid, c2t, g2a) per read."""
    ok = F.col("bq") >= min_qual
    return aligned_rows.groupBy(*key(aligned_rows)).agg(F.count_if(ok & (F.col("rb") == "C") & (F.col("qb") == "T")).alias("c2t"), F.count_if(ok & (F.col("rb") == "G") & (F.col("qb") == "A")).alias("g2a"))


def with_inferred(reads: DataFrame, min_qual: int = 0, needed: Column | None = None) -> DataFrame:
    """Adds c2t and g2a, counted within each read's row: no shuffle. Needs the slice. Reads that are not ``needed`` are not looked at and have nulls."""
    only = (lambda c: c) if needed is None else (lambda c: F.when(needed, c))
    b = only(cg.blocks(F.col("cigar"), F.col("pos1")))

    def count(ref: str, got: str):
        def in_block(x):
            hit = lambda j: ((F.substr("slice", x["r"] - F.col("pos1") + 3 + j, F.lit(1)) == ref) & (F.substr("seq", x["q"] + j, F.lit(1)) == got) & (F.ascii(F.substr("qual", x["q"] + j, F.lit(1))) - 33 >= min_qual)).cast("int")
            return F.when(x["op"].isin("M", "=", "X"), F.aggregate(F.sequence(F.lit(0), x["n"] - 1), F.lit(0), lambda s, j: s + hit(j))).otherwise(0)

        return only(F.aggregate(F.transform(F.col("_b"), in_block), F.lit(0), lambda s, v: s + v))

    return reads.withColumn("_b", b).withColumn("c2t", count("C", "T")).withColumn("g2a", count("G", "A")).drop("_b")


def with_strand(reads: DataFrame, min_qual: int = 0, unknown: bool = False) -> DataFrame:
    """Adds bss: the tags' strand, else the one that its own bases suggest (0 unless G-to-A changes outnumber C-to-T). Bases are counted only where tags are silent."""
    found = with_inferred(reads.withColumn("_tagged", tagged_strand(unknown)), min_qual, F.col("_tagged").isNull())
    return found.withColumn("bss", F.coalesce("_tagged", F.when(F.col("c2t") >= F.col("g2a"), 0).otherwise(1))).drop("c2t", "g2a", "_tagged")

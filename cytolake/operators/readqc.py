"""Per-read and per-base quality control: strands, conversion, retention, and the report tables.

Counts of a read are taken inside its own row wherever one number is wanted; tables keyed by position come from one partial aggregation.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cigar as cg
from ..functions import seq as sq
from . import bases

MAX_READ_POS = 300
MAX_ISIZE = 1000


# -- strands -------------------------------------------------------------------------------------------------------


def own_strand() -> Column:
    """f, r, c or u from a read's own changes. The ratio of the two counts is taken in whole numbers, so only equal counts conflict."""
    return F.when((F.col("c2t") == 0) & (F.col("g2a") == 0), "u").when(F.col("c2t") == F.col("g2a"), "c").when(F.col("c2t") > F.col("g2a"), "f").otherwise("r")


def strands(aln: DataFrame, genome: DataFrame) -> DataFrame:
    """Mapped reads with tag (f/r/c/u from tags), own (from the bases), c2t and g2a."""
    reads = bases.with_inferred(bases.with_slice(aln.where(~bases.has(bases.UNMAPPED)), genome))
    return reads.withColumn("tag", bases.strand_tag()).withColumn("own", own_strand())


def corrected(found: DataFrame, counts: bool = False) -> DataFrame:
    """Reads with YD made to agree with what their bases say; YC and YG on request."""
    out = found.withColumn("YD", F.col("own"))
    return out.withColumnsRenamed({"c2t": "YC", "g2a": "YG"}) if counts else out.drop("c2t", "g2a")


def confusion(found: DataFrame) -> DataFrame:
    return found.groupBy("tag", "own").agg(F.count("*").alias("n"))


def strand_table(found: DataFrame) -> DataFrame:
    """(mate, reverse, tag, n): anything that is not read 1 counts as read 2."""
    mate = F.when(bases.has(bases.READ1), 1).otherwise(2)
    return found.groupBy(mate.alias("mate"), bases.has(bases.REVERSE).alias("reverse"), "tag").agg(F.count("*").alias("n"))


# -- cytosines in reads ---------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Cytosines:
    target: str = "cg"
    nome: bool = False


def _target(kind: str, five: Column) -> Column:
    cg_, gc = F.substring(five, 4, 1) == "G", F.substring(five, 2, 1) == "G"
    return {"c": F.lit(True), "cg": cg_, "ch": ~cg_, "hcg": cg_ & ~gc, "gch": gc & ~cg_, "hch": ~gc & ~cg_}[kind]


def own_cytosines(aln: DataFrame, genome: DataFrame) -> DataFrame:
    """One row per cytosine of the read's own strand without N around it: n5 is its five bases on that strand, cretention its state. They are looked for in the read's row, so other bases make no rows."""
    keep = ("qname", "flag", "mapq", "chrom", "bss", "rlen", "span", "pos1", "seq", "slice")
    reads = bases.with_strand(bases.with_slice(aln.where(~bases.has(bases.UNMAPPED)), genome)).withColumn("rlen", F.length("seq")).withColumn("_own", F.when(F.col("bss") == 0, "C").otherwise("G"))

    def hits(b: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), b["n"] - 1), lambda j: F.substr("slice", b["r"] - F.col("pos1") + 3 + j, F.lit(1)) == F.col("_own"))
        return F.transform(at, lambda j: F.struct((b["q"] + j).alias("q"), (b["r"] + j).alias("r")))

    there = F.filter(cg.blocks(F.col("cigar"), F.col("pos1")), lambda b: b["op"].isin("M", "=", "X") & (b["n"] > 0))
    # a generator's row first: Spark takes a filter on a generator's size from it, which would look for them again
    found = reads.select(F.inline(F.array(F.struct(*bases.key(reads), *keep, F.col("_own").alias("rb"), F.flatten(F.transform(there, hits)).alias("_hits")))))
    rows = found.select(*bases.key(reads), *keep, "rb", F.inline("_hits").alias("qpos", "rpos"))
    rows = rows.withColumn("qb", F.substr("seq", F.col("qpos"), F.lit(1))).withColumn("five", F.substr("slice", F.col("rpos") - F.col("pos1") + 1, F.lit(5))).drop("seq", "slice")
    state = F.when(F.col("qb") == F.col("rb"), "R").when(F.col("qb") == F.when(F.col("rb") == "C", "T").otherwise("A"), "C").otherwise("N")
    rows = rows.where(~F.contains("five", F.lit("N"))).withColumn("n5", sq.oriented(F.col("five"), F.col("rb")))
    return rows.withColumn("cretention", state)


def cytosines(aln: DataFrame, genome: DataFrame, o: Cytosines = Cytosines()) -> DataFrame:
    """One row per cytosine of the read's own strand, with all columns that a report may select."""
    rows = own_cytosines(aln, genome).where(_target(o.target, F.col("n5")))
    is_cg = F.substring("n5", 4, 1) == "G"
    return rows.select(
        *bases.key(rows), "qname", F.when(bases.has(bases.READ2), 2).otherwise(1).alias("qpair"), F.when(bases.has(bases.REVERSE), "-").otherwise("+").alias("strand"), F.when(F.col("bss") == 1, "-").otherwise("+").alias("bsstrand"), "mapq",
        F.col("pos1").alias("qbeg"), (F.col("pos1") + F.col("span") - 1).alias("qend"), "chrom", F.col("rpos").alias("crpos"),
        F.when(is_cg, F.when(F.col("rb") == "C", F.col("rpos")).otherwise(F.col("rpos") - 1)).otherwise(-1).alias("cgrpos"), F.col("qpos").alias("cqpos"), F.col("rb").alias("crbase"),
        sq.context(F.col("n5"), F.col("rb"), o.nome).alias("cctxt"), F.col("qb").alias("cqbase"), "cretention", "rlen", "flag",
    )


def target_counts(aln: DataFrame, genome: DataFrame, targets: tuple[str, ...]) -> DataFrame:
    """(target, cretention, n): cytosines by state under several targets, in one pass over the reads."""
    kinds = own_cytosines(aln, genome).groupBy(*[_target(t, F.col("n5")).alias(t) for t in targets], "cretention").agg(F.count("*").alias("n"))
    each = kinds.select(F.explode(F.array_compact(F.array(*[F.when(F.col(t), F.lit(t)) for t in targets]))).alias("target"), "cretention", "n")
    return each.groupBy("target", "cretention").agg(F.sum("n").alias("n"))


def retention_by_position(rows: DataFrame, top: int = MAX_READ_POS) -> DataFrame:
    """(mate, qpos, state, n): positions count from the read's start as sequenced, reverse reads from the other end."""
    at = F.when(F.col("strand") == "-", F.col("rlen") - F.col("cqpos") + 1).otherwise(F.col("cqpos"))
    used = rows.where(F.col("cretention").isin("C", "R")).withColumn("qpos", at).where(F.col("qpos") <= top)
    return used.groupBy(F.col("qpair").alias("mate"), "qpos", F.col("cretention").alias("state")).agg(F.count("*").alias("n"))


# -- conversion ----------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Conversion:
    """Limits on retained cytosines of a read; None sets no limit."""

    max_cpa: int | None = None
    max_cpc: int | None = None
    max_cpt: int | None = None
    max_cph: int | None = None
    max_cpy: int | None = None
    max_cph_fraction: float = 1.0
    max_cpy_fraction: float = 1.0
    drop_unknown: bool = False
    invert: bool = False


def conversion_counts(aln: DataFrame, genome: DataFrame) -> DataFrame:
    """([sid,] rid, ca_r, ca_c, .. ct_r, ct_c): retained and converted cytosines of mapped reads by the base that follows; reads without any have zeros."""
    reads = bases.with_strand(bases.with_slice(aln.where(~bases.has(bases.UNMAPPED)), genome))
    rows = bases.aligned(reads, ("rid", "bss"))
    after = F.substring(sq.oriented(F.col("five"), F.col("rb")), 4, 1)
    own = ((F.col("bss") == 0) & (F.col("rb") == "C")) | ((F.col("bss") == 1) & (F.col("rb") == "G"))
    kept, turned = own & (F.col("qb") == F.col("rb")), own & (F.col("qb") == F.when(F.col("rb") == "C", "T").otherwise("A"))
    return rows.groupBy(*bases.key(rows)).agg(*[F.count_if((kept if s == "r" else turned) & (after == b)).alias(f"c{b.lower()}_{s}") for b in "ACGT" for s in "rc"])


def conversion_fails(o: Conversion) -> Column:
    c = F.col
    h, y = c("ca_r") + c("cc_r") + c("ct_r"), c("cc_r") + c("ct_r")
    hc, yc = c("ca_c") + c("cc_c") + c("ct_c"), c("cc_c") + c("ct_c")
    bad = F.lit(False)
    for most, n in ((o.max_cpa, c("ca_r")), (o.max_cpc, c("cc_r")), (o.max_cpt, c("ct_r")), (o.max_cph, h), (o.max_cpy, y)):
        if most is not None:
            bad |= n > most
    for most, n, m in ((o.max_cph_fraction, h, hc), (o.max_cpy_fraction, y, yc)):
        if most < 1.0:
            bad |= (n + m > 0) & ((n / (n + m)).cast("float") > most)
    return bad


def conversion_filter(aln: DataFrame, genome: DataFrame, o: Conversion = Conversion()) -> DataFrame:
    """Mapped reads that meet the limits (those that do not, if inverted), with their counts and the ZN text."""
    text = F.concat_ws(",", *[F.format_string(f"C{b}_R%dC%d", F.col(f"c{b.lower()}_r"), F.col(f"c{b.lower()}_c")) for b in "ACGT"])
    found = aln.join(conversion_counts(aln, genome), bases.key(aln))
    bad = conversion_fails(o)
    if o.drop_unknown:
        bad |= F.coalesce(F.col("YD") == "u", F.lit(False))
    return found.where(bad if o.invert else ~bad).withColumn("ZN", text)


def conversion_summary(aln: DataFrame, genome: DataFrame, o: Conversion = Conversion()) -> DataFrame:
    """(n_processed, n_remaining): unmapped reads are processed and never remain."""
    kept = conversion_filter(aln, genome, o).agg(F.count("*").alias("n_remaining"))
    return aln.agg(F.count("*").alias("n_processed")).join(kept, how="cross")  # one row each


def read_average_conversion(aln: DataFrame, genome: DataFrame, compat: bool = False) -> DataFrame:
    """(context, retained, converted, rate) over primary, proper, unduplicated reads of mapq 40 or more. ``compat`` drops reads with any retained CpC or CpT."""
    ok = ~bases.has(bases.DUPLICATE) & bases.has(bases.PAIRED) & bases.has(bases.PROPER) & ~bases.has(bases.SECONDARY) & ~bases.has(bases.UNMAPPED) & (F.col("mapq") >= 40)
    counts = conversion_counts(aln.where(ok), genome)
    if compat:
        counts = counts.where(F.col("cc_r") + F.col("ct_r") == 0)
    sums = counts.agg(*[F.sum(c).alias(c) for c in counts.columns if c not in ("sid", "rid")])
    rows = sums.select(F.inline(F.array(*[F.struct(F.lit(f"C{b}").alias("context"), F.col(f"c{b.lower()}_r").alias("retained"), F.col(f"c{b.lower()}_c").alias("converted")) for b in "ACGT"])))
    return rows.withColumn("rate", F.try_divide(F.col("retained").cast("double"), F.col("retained") + F.col("converted")))


# -- report tables ---------------------------------------------------------------------------------------------------


def mapq_histogram(aln: DataFrame) -> DataFrame:
    """(mapq, n) for 0 to 60 and "unmapped", primary reads."""
    key = F.when(bases.has(bases.UNMAPPED), "unmapped").otherwise(F.col("mapq").cast("string"))
    got = aln.where(~bases.has(bases.SECONDARY)).groupBy(key.alias("mapq")).agg(F.count("*").alias("n"))
    every = aln.sparkSession.range(61).select(F.col("id").cast("string").alias("mapq")).unionByName(aln.sparkSession.range(1).select(F.lit("unmapped").alias("mapq")))
    return every.join(got, "mapq", "left").select("mapq", F.coalesce("n", F.lit(0)).alias("n"))


def insert_histogram(aln: DataFrame, top: int = MAX_ISIZE) -> DataFrame:
    """(isize, n, fraction) of proper primary pairs of mapq 40 or more."""
    ok = bases.has(bases.PROPER) & ~bases.has(bases.SECONDARY) & (F.col("mapq") >= 40) & F.col("isize").between(0, top)
    got = aln.where(ok).groupBy("isize").agg(F.count("*").alias("n"))
    total = got.agg(F.sum("n").alias("total"))
    return got.join(F.broadcast(total), how="cross").select("isize", "n", (F.col("n") / F.col("total")).alias("fraction"))  # one row


def duplicate_report(aln: DataFrame) -> DataFrame:
    """Primary mapped reads and their duplicates, all and of mapq 40 or more."""
    dup, q40 = bases.has(bases.DUPLICATE), F.col("mapq") >= 40
    rows = aln.where(~bases.has(bases.SECONDARY) & ~bases.has(bases.UNMAPPED))
    return rows.agg(F.count("*").alias("n"), F.count_if(dup).alias("n_dup"), F.count_if(q40).alias("n_q40"), F.count_if(dup & q40).alias("n_q40_dup"))


def flip_strands(aln: DataFrame) -> DataFrame:
    """Every read's reverse flag turned over, as libraries of the opposite strand need."""
    return aln.withColumn("flag", F.col("flag").bitwiseXOR(bases.REVERSE))


def span(cigar: str = "cigar") -> Column:
    return cg.reference_length(F.col(cigar))

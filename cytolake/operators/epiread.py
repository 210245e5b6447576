"""Read-level epialleles: one string per read and channel, in three formats.

Reads meet their SNPs and their slice of the reference by (contig, block), in one shuffle; a read's columns are an array in its own row, so no row per base is ever sorted, spilled or shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import seq as sq
from ..sources import genome as gn
from . import bases

# Letters of the channels.
METHYLATED, UNMETHYLATED, OPEN, SHUT, FILTERED, IGNORED, CLIPPED = "M", "U", "O", "S", "F", "x", "P"
DELETED_BASE, DELETED, INSERTED, AMBIGUOUS_GA, AMBIGUOUS_CT = "D", "d", "i", "R", "Y"


@dataclass(frozen=True)
class Options:
    filters: bases.Filters = bases.Filters()
    nome: bool = False
    drop_empty: bool = True
    #: Calls come from the reads' MM and ML tags, methylated above this probability, unmethylated below its complement; such reads have no strand of conversion.
    modified: float | None = None


def snp_table(snps: DataFrame) -> DataFrame:
    """(chrom, pos1, callable) of (chrom, pos1, ref, alt, af): whether a SNP leaves methylation readable."""
    rare = F.col("af") < 0.05
    ok = F.when(F.col("ref") == "C", (F.col("alt") != "T") | rare).when(F.col("ref") == "G", (F.col("alt") != "A") | rare).otherwise(False)
    return snps.select("chrom", "pos1", ok.alias("callable"))


def by_block(snps: DataFrame, size: int, reach: int) -> DataFrame:
    """(chrom, blk, _snps): the SNPs that reads beginning in a block of ``size`` bases and reaching ``reach`` bases may span."""
    at = F.col("pos1") - 1
    blk = F.array_distinct(F.array(F.floor(at / size).cast("int"), F.floor(F.greatest(at - reach, F.lit(0)) / size).cast("int")))
    each = snp_table(snps).select("chrom", F.explode(blk).alias("blk"), F.struct(F.col("pos1").cast("int").alias("p"), "callable").alias("_snp"))
    return each.groupBy("chrom", "blk").agg(F.collect_set("_snp").alias("_snps"))


READ = ("rid", "qname", "flag", "chrom", "bss", "rlen", "pos1")


def states(aln: DataFrame, genome: DataFrame, snps: DataFrame | None, o: Options = Options()) -> DataFrame:
    """A row a kept read, its columns in the array ``x``: channels cg, gc and vr, and the calls (kind, at, call) that the older formats list."""
    f = o.filters
    tagged = o.modified is not None
    near = None if snps is None else by_block(snps, max(bases.BLOCK, f.max_span), f.max_span)
    reads = bases.with_slice(bases.keep_reads(aln, f), genome, max_span=f.max_span, beside=near)
    reads = with_modifications(reads).withColumn("bss", F.lit(0)) if tagged else bases.with_strand(reads)
    reads = bases.with_mate_span(reads).withColumn("rlen", F.length("seq"))
    last = F.col("pos1") + F.greatest(F.col("span"), F.lit(1)) - 1
    own = F.lit(None) if snps is None else F.map_from_entries(F.filter("_snps", lambda s: s["p"].between(F.col("pos1"), last)))
    reads = reads.withColumn("snps", own.cast("map<int,boolean>"))
    keep = [*bases.key(reads), *[c for c in READ if c != "rid"], "seq", "qual", "cigar", "slice", "span", "mpos1", "mspan", "snps", *(("mods", "mod_base") if tagged else ())]
    # a generator's rows are worked out before the lambdas below read them, once a read and not once a base
    reads = reads.where(F.col("cigar").rlike("[0-9][MIDS=X]")).select(F.inline(F.array(F.struct(*keep))))
    w = F.col("bss") == 0

    def called(v: Column) -> Column:
        ok = bases.base_passes(f, F.col("rlen"), lambda k: v[k])
        if f.drop_double:
            ok = ok & ~bases.counted_twice(lambda k: v[k])
        rb, qb = v["rb"], v["qb"]
        before, after = F.substring(v["five"], 2, 1), F.substring(v["five"], 4, 1)
        on_g, on_c = (F.col("bss") == 1) & (rb == "G"), w & (rb == "C")
        gpc = F.lit(False)
        if o.nome:
            cpg = (on_g & (before == "C") & ~after.isin("C", "N")) | (on_c & ~before.isin("G", "N") & (after == "G"))
            gpc = (on_g & ~before.isin("C", "N") & (after == "C")) | (on_c & (before == "G") & ~after.isin("G", "N"))
        else:
            cpg = (on_g & (before == "C")) | (on_c & (after == "G"))
        call = F.when(qb == rb, "C").when(qb == F.when(rb == "C", "T").otherwise("A"), "T").otherwise("N")
        told = F.when(cpg, "cg").when(gpc, "gc")
        if tagged:
            p = F.try_element_at("mods", v["qpos"])
            cpg = p.isNotNull() & (qb == F.col("mod_base")) & (qb == rb) & (((rb == "C") & (after == "G")) | ((rb == "G") & (before == "C")))
            call = F.when(cpg & (p > o.modified), "C").when(cpg & (p >= 0) & (p < 1 - o.modified), "T").otherwise("N")
            # the older formats list every base that the tags name, and filtered ones by the reference
            told = F.when(F.when(ok, p.isNotNull()).otherwise(on_c & (after == "G")), "cg")
        site = F.when(cpg & on_g, v["rpos"] - 1).otherwise(v["rpos"])  # reads with tags are never on G: their bss is 0
        parts = dict(op=v["op"], col=v["col"], rpos=v["rpos"], qb=qb, ok=ok, cpg=cpg, gpc=gpc, call=call, told=told, site=site, snp=F.try_element_at("snps", v["rpos"]), aligned=v["op"].isin("M", "=", "X"))
        return F.struct(*[x.alias(k) for k, x in parts.items()])

    def told_of(v: Column) -> Column:
        qb, ok, call = v["qb"], v["ok"], v["call"]
        is_snp = v["aligned"] & v["snp"].isNotNull()
        seen = (call != "N") & F.coalesce(v["snp"], F.lit(True))
        cg = F.when(v["cpg"] & seen, F.when(call == "C", METHYLATED).otherwise(UNMETHYLATED)).otherwise(IGNORED)
        gc = F.when(v["gpc"] & seen, F.when(call == "C", OPEN).otherwise(SHUT)).otherwise(IGNORED)
        vr = F.when(~is_snp, IGNORED).when((F.col("bss") == 1) & (qb == "A"), AMBIGUOUS_GA).when(w & (qb == "T"), AMBIGUOUS_CT).otherwise(qb)
        channel = lambda x, deleted, inserted: F.when(v["op"] == "S", CLIPPED).when(v["op"] == "D", deleted).when(v["op"] == "I", inserted).when(~ok, FILTERED).otherwise(x)
        return F.struct(
            v["op"].alias("op"), v["col"].alias("col"), channel(cg, DELETED, INSERTED).alias("cg"), channel(gc, DELETED, INSERTED).alias("gc"), channel(vr, DELETED_BASE, F.lower(qb)).alias("vr"),
            F.when(v["aligned"], v["told"]).alias("kind"), v["site"].alias("at"), F.when(ok, call).otherwise("N").alias("call"), F.when(is_snp & ok, v["rpos"]).alias("snp_at"), F.when(is_snp & ok, qb).alias("snp_base"),
        )

    x = F.transform(F.transform(bases.column_array(), called), told_of)
    return reads.select(F.inline(F.array(F.struct(*bases.key(reads), *[c for c in READ if c != "rid"], x.alias("x")))))  # nor is x worked out again by filters on what follows from it


def epibed(rows: DataFrame, o: Options = Options()) -> DataFrame:
    """(chrom, start0, end, qname, mate, strand, cg, gc, vr) of :func:`states`, run-length encoded."""
    number = lambda op: F.size(F.filter("x", lambda v: v["op"] == op))
    part = rows.select("*", number("D").alias("nd"), number("I").alias("ni"))
    text = lambda k: F.array_join(F.transform("x", lambda v: v[k]), "")
    clip = F.coalesce(F.array_position(F.transform("x", lambda v: v["op"] == "S"), False) - 1, F.lit(0))
    out = part.select("*", text("cg").alias("cg"), text("gc").alias("gc"), text("vr").alias("vr"), (F.col("pos1") - F.when(clip < 0, F.size("x")).otherwise(clip) - 1).cast("int").alias("start0"))
    out = out.where(F.col("start0") >= 0)
    if o.drop_empty:
        empty = F.col("cg").rlike("^[FxP]*$") & F.col("vr").rlike("^[FxP]*$")
        out = out.where(~(empty & F.col("gc").rlike("^[FxP]*$")) if o.nome else ~empty)
    gc = sq.run_lengths(F.col("gc")) if o.nome else F.lit(".")
    return out.select(*bases.key(rows), "chrom", "start0", (F.col("start0") + F.col("rlen") + F.col("nd") - F.col("ni")).cast("int").alias("end"), "qname", F.when(bases.has(bases.READ2), "2").otherwise("1").alias("mate"), F.when(F.col("bss") == 1, "-").otherwise("+").alias("strand"), sq.run_lengths(F.col("cg")).alias("cg"), gc.alias("gc"), sq.run_lengths(F.col("vr")).alias("vr"))


def legacy(rows: DataFrame, nome: bool = False, all_positions: bool = False) -> DataFrame:
    """(chrom, qname, mate, strand, cg_pos0, cg, [gc_pos0, gc,] snp_pos0, snp): reads with a CpG (or, in NOMe mode, a GpC); positions are texts, the first only or all."""
    at = lambda cond, pos, v: F.transform(F.filter("x", cond), lambda c: F.struct((c[pos] - 1).alias("p"), c[v].alias("v")))
    part = rows.select("*", at(lambda c: c["kind"] == "cg", "at", "call").alias("cgs"), at(lambda c: c["kind"] == "gc", "at", "call").alias("gcs"), at(lambda c: c["snp_at"].isNotNull(), "snp_at", "snp_base").alias("snps"))

    def pair(c: str, name: str) -> list[Column]:
        places = F.array_join(F.transform(c, lambda v: v["p"].cast("string")), ",") if all_positions else F.try_element_at(F.transform(c, lambda v: v["p"].cast("string")), F.lit(1))
        return [F.when(F.size(c) > 0, places).otherwise(".").alias(f"{name}_pos0"), F.when(F.size(c) > 0, F.array_join(F.transform(c, lambda v: v["v"]), "")).otherwise(".").alias(name)]

    there = F.size("cgs") + F.size("gcs") > 0
    return part.where(there).select(*bases.key(rows), "chrom", "qname", F.when(bases.has(bases.READ2), "2").otherwise("1").alias("mate"), F.when(F.col("bss") == 1, "-").otherwise("+").alias("strand"), *pair("cgs", "cg"), *(pair("gcs", "gc") if nome else []), *pair("snps", "snp"))


def pairwise(rows: DataFrame) -> DataFrame:
    """([sid,] rid, chrom, snp1, cg1, snp_base, cg_call): each SNP of a read beside each cytosine call of the same read."""
    both = rows.select(*bases.key(rows), "chrom", F.filter("x", lambda v: v["snp_at"].isNotNull()).alias("_s"), F.filter("x", lambda v: v["kind"].isNotNull()).alias("_c")).where((F.size("_s") > 0) & (F.size("_c") > 0))
    each = both.select(*bases.key(rows), "chrom", F.explode("_s").alias("_s"), "_c").select(*bases.key(rows), "chrom", "_s", F.explode("_c").alias("_c"))
    return each.select(*bases.key(rows), "chrom", F.col("_s.snp_at").alias("snp1"), F.col("_c.at").alias("cg1"), F.col("_s.snp_base").alias("snp_base"), F.col("_c.call").alias("cg_call")).select(*bases.key(rows), "chrom", "snp1", "cg1", "snp_base", "cg_call")


def cpg_ordinals(genome: DataFrame, size: int = 1 << 16) -> DataFrame:
    """(chrom, beg0, k): number of each CpG along its contig, from 0. CpGs are counted by stretch, then within it."""
    at = gn.cpg_sites(genome).withColumn("part", F.floor(F.col("beg0") / size))
    sums = at.groupBy("chrom", "part").agg(F.count("*").alias("n"))
    before = sums.select("chrom", "part", F.coalesce(F.sum("n").over(W.partitionBy("chrom").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.row_number().over(W.partitionBy("chrom", "part").orderBy("beg0")) - 1
    return at.join(before, ["chrom", "part"]).select("chrom", "beg0", (F.col("before") + inside).alias("k"))


def rectangle(epireads: DataFrame, genome: DataFrame) -> DataFrame:
    """Adds ``padded`` to (rid, chrom, cg_pos0, cg): calls of all reads of a contig in one frame of CpGs, N where a read has none.

    The frame begins at the contig's first CpG that a read has; a read without calls is N throughout.
    """
    first = epireads.withColumn("_p", F.when(F.col("cg_pos0") != ".", F.substring_index("cg_pos0", ",", 1).cast("int")))
    k = cpg_ordinals(genome).select(F.col("chrom").alias("_c"), F.col("beg0").alias("_b"), "k")
    placed = first.join(k, (F.col("chrom") == F.col("_c")) & (F.col("_p") == F.col("_b")), "left")
    frame = placed.groupBy("chrom").agg(F.min("k").alias("k0"), F.max(F.col("k") + F.when(F.col("_p").isNotNull(), F.length("cg"))).alias("k1"))
    both = placed.join(frame, "chrom")
    width = F.coalesce(F.col("k1") - F.col("k0"), F.lit(0)).cast("int")
    own = F.when(F.col("_p").isNull(), "").otherwise(F.concat(F.repeat(F.lit("N"), (F.col("k") - F.col("k0")).cast("int")), F.col("cg")))
    return both.select(*epireads.columns, F.rpad(own, width, "N").alias("padded"))


def paired(bed: DataFrame) -> DataFrame:
    """Both records of a read name of a sample on one row; single ones have nulls for the second."""
    side = lambda m: F.max(F.when(F.col("mate") == m, F.struct("start0", "end", "strand", "cg", "vr")))
    return bed.groupBy(*[c for c in ("sid",) if c in bed.columns], "chrom", "qname").agg(side("1").alias("r1"), side("2").alias("r2"))


def with_modifications(reads: DataFrame) -> DataFrame:
    """Adds mods (place in the stored sequence, from 1, to the probability of its modification; -1 without ML) and mod_base (the stored base that they fall on), from MM and ML.

    MM lists how many of the base to skip before each modified one, along the sequenced strand; reverse reads count from the other end on the complement. With ``?`` bases that are
    skipped are of unknown state and have the probability -1. Reads without MM have no entries. More than one modification, another one than m, or a base other than C or G is an error.
    """
    form = r"^([CG])([+-])m([?.]?)((?:,[0-9]+)*);?$"
    part = lambda k: F.regexp_extract("MM", form, k)
    kind, reverse = part(1), bases.has(bases.REVERSE)
    none = F.coalesce(F.col("MM"), F.lit("")) == ""
    sound = F.when(none, "").when(F.col("MM").rlike(form), kind).otherwise(F.raise_error(F.concat(F.lit("not one methylation of C or G: MM is "), F.substring("MM", 1, 80))))
    # bases of C are called on the strand sequenced, those of G on the other one
    fits = ((kind == "C") & (part(2) == "+")) | ((kind == "G") & (part(2) == "-"))
    skips = F.transform(F.filter(F.split(part(4), ","), lambda x: x != ""), lambda x: x.cast("int"))
    rows = reads.withColumn("_kind", sound).withColumn("_base", F.when(F.col("_kind") != "", F.when(reverse, F.translate("_kind", "CG", "GC")).otherwise(F.col("_kind")))).withColumn("_skips", skips)
    spots = F.filter(F.sequence(F.lit(1), F.length("seq")), lambda i: F.substr("seq", i, F.lit(1)) == F.col("_base"))
    spots = F.when((F.length("seq") > 0) & F.col("_base").isNotNull(), F.when(reverse, F.reverse(spots)).otherwise(spots)).otherwise(F.array().cast("array<int>"))
    upto = lambda s, x: F.concat(s, F.array(F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(0)) + x + 1))
    rows = rows.withColumn("_at", spots).withColumn("_nth", F.aggregate("_skips", F.array().cast("array<int>"), upto))
    named = F.transform("_nth", lambda n, k: F.struct(F.try_element_at("_at", n).alias("q"), F.coalesce(sq.mod_probability(F.try_element_at("ML", k + 1)), F.lit(-1.0)).alias("p")))
    named = F.map_from_entries(F.filter(named, lambda x: x["q"].isNotNull()))
    unknown = F.map_from_entries(F.transform(F.array_except("_at", F.map_keys("_named")), lambda q: F.struct(q.alias("q"), F.lit(-1.0).alias("p"))))
    rows = rows.withColumn("_named", named)
    mods = F.when(part(3) == "?", F.map_concat("_named", unknown)).otherwise(F.col("_named"))
    return rows.withColumn("mods", mods).withColumn("mod_base", F.when(fits, F.col("_base"))).drop("_kind", "_base", "_skips", "_at", "_nth", "_named")


def modified_bases(reads: DataFrame, probability: float = 0.9) -> DataFrame:
    """([sid,] rid, q, prob, call) for each base that MM and ML name (:func:`with_modifications`)."""
    out = with_modifications(reads).select(*bases.key(reads), F.explode("mods").alias("q", "prob"))
    return out.withColumn("call", F.when(F.col("prob") > probability, METHYLATED).when((F.col("prob") >= 0) & (F.col("prob") < 1 - probability), UNMETHYLATED).otherwise(IGNORED))

"""Coverage along the genome, intervals, and the spread of depths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import cigar as cg
from ..sources import store
from . import bases

#: Bases of a bin in which CpGs, and windows, meet runs of depth. Deep places have a run for nearly every base, and each in a bin is compared with each CpG of it, so bins are about as long as what meets them.
CPG_BIN, WINDOW_BIN = 64, 256

VARIANTS = {"all": "true", "q40": "mapq >= 40", "dup": "flag & 1024 <> 0", "q40_dup": "mapq >= 40 and flag & 1024 <> 0"}


def reads_for(aln: DataFrame, variant: str = "all") -> DataFrame:
    """Mapped reads of one of the report's four variants; qcfail and secondary ones are left out."""
    return aln.where(~bases.has(bases.UNMAPPED) & ~bases.has(bases.SECONDARY) & ~bases.has(bases.QCFAIL)).where(VARIANTS[variant])


def depth(reads: DataFrame, contigs: DataFrame, bin_size: int = 1 << 20) -> DataFrame:
    """(chrom, beg0, end, depth): runs of equal depth, zero included, over the whole of each contig (chrom, clen). Only aligned blocks cover.

    Blocks become a +1 and a -1 event, summed by position before anything is ordered. The running sum goes by bins of a contig: bins' sums are added up first, so
    that even the longest contig is many tasks.
    """
    b = F.explode(cg.blocks(F.col("cigar"), F.col("pos1"))).alias("b")
    spans = reads.select("chrom", b).where(F.col("b.op").isin("M", "=", "X", "D")).select("chrom", (F.col("b.r") - 1).alias("beg0"), (F.col("b.r") + F.col("b.n") - 1).alias("end"))
    events = spans.select("chrom", F.inline(F.array(F.struct(F.col("beg0").alias("p"), F.lit(1).alias("d")), F.struct(F.col("end").alias("p"), F.lit(-1).alias("d")))))
    edges = contigs.select("chrom", F.inline(F.array(F.struct(F.lit(0).alias("p"), F.lit(0).alias("d")), F.struct(F.col("clen").cast("int").alias("p"), F.lit(0).alias("d")))))
    steps = events.unionByName(edges).groupBy("chrom", "p").agg(F.sum("d").alias("d")).withColumn("bin", F.floor(F.col("p") / bin_size))
    steps = store.written(steps, "depth-steps")  # read for the bins' sums and for the runs
    sums = steps.groupBy("chrom", "bin").agg(F.sum("d").alias("s"), F.min("p").alias("first"))
    along = W.partitionBy("chrom").orderBy("bin")
    starts = sums.select("chrom", "bin", F.coalesce(F.sum("s").over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.lead("first").over(along).alias("next_bin"))
    own = W.partitionBy("chrom", "bin").orderBy("p")
    run = steps.join(starts, ["chrom", "bin"]).select("chrom", "bin", "p", (F.col("before") + F.sum("d").over(own)).alias("depth"), F.coalesce(F.lead("p").over(own), F.col("next_bin")).alias("end"), "d")
    # a step of zero continues the run before it unless it begins a contig or a bin; runs of equal depth are joined across them
    rows = run.where(F.col("end").isNotNull())
    return merge_runs(rows.select("chrom", F.col("p").alias("beg0"), "end", F.col("depth").cast("long").alias("depth")), bin_size)


def merge_runs(rows: DataFrame, bin_size: int) -> DataFrame:
    """Joins neighbouring runs of equal depth: within bins first, then the first and last run of each bin along the contig."""
    bins = rows.withColumn("bin", F.floor(F.col("beg0") / bin_size))
    new = lambda w: F.when((F.lag("depth").over(w) == F.col("depth")) & (F.lag("end").over(w) == F.col("beg0")), 0).otherwise(1)
    span = (F.min("beg0").alias("beg0"), F.max("end").alias("end"), F.first("depth").alias("depth"))
    inside, along = W.partitionBy("chrom", "bin").orderBy("beg0"), W.partitionBy("chrom").orderBy("beg0")
    runs = bins.withColumn("new", new(inside)).withColumn("run", F.sum("new").over(inside)).groupBy("chrom", "bin", "run").agg(*span)
    runs = runs.withColumn("last", F.max("run").over(W.partitionBy("chrom", "bin")))
    at_border = (F.col("run") == 1) | (F.col("run") == F.col("last"))
    border = runs.where(at_border).select("chrom", "beg0", "end", "depth")
    border = border.withColumn("new", new(along)).withColumn("run", F.sum("new").over(along)).groupBy("chrom", "run").agg(*span)
    out = ["chrom", "beg0", "end", "depth"]
    return runs.where(~at_border).select(*out).unionByName(border.select(*out))


def total_depth(rows: DataFrame) -> DataFrame:
    """(chrom, depth, n) number of bases at each depth; the same whatever runs are split."""
    return rows.groupBy("chrom", "depth").agg(F.sum(F.col("end") - F.col("beg0")).alias("n"))


def overlaps(a: DataFrame, b: DataFrame, bin_size: int = 4096) -> DataFrame:
    """Pairs of intervals (chrom, beg0, end, other columns) that share a base. An equi-join on bins; each pair is found in the bin where its overlap begins, once."""
    binned = lambda d: d.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("beg0") / bin_size), F.floor((F.col("end") - 1) / bin_size))))
    right = binned(b).select(F.col("chrom").alias("_c"), "_bin", *[F.col(c).alias(f"b_{c}") for c in b.columns if c != "chrom"]).withColumnRenamed("_bin", "_b")
    met = binned(a).join(right, (F.col("chrom") == F.col("_c")) & (F.col("_bin") == F.col("_b")) & (F.col("beg0") < F.col("b_end")) & (F.col("b_beg0") < F.col("end")))
    first = F.floor(F.greatest("beg0", "b_beg0") / bin_size)
    return met.where(first == F.col("_bin")).drop("_bin", "_b", "_c")


def least_depth(intervals: DataFrame, runs: DataFrame, bin_size: int = CPG_BIN) -> DataFrame:
    """(chrom, beg0, end, depth): the least depth anywhere in each interval. Longer intervals than CpGs should have longer bins."""
    return overlaps(intervals.select("chrom", "beg0", "end"), runs.select("chrom", "beg0", "end", "depth"), bin_size).groupBy("chrom", "beg0", "end").agg(F.min("b_depth").alias("depth"))


def moments(hist: DataFrame, *by: str) -> DataFrame:
    """([by,] n, mean, sd, cv) of a histogram ([by,] depth, n): population figures."""
    d, n = F.col("depth").cast("double"), F.col("n")
    s = hist.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(d * n).alias("s1"), F.sum(d * d * n).alias("s2"))
    mean = F.try_divide("s1", "n")
    sd = F.sqrt(F.greatest(F.lit(0.0), F.try_divide("s2", "n") - mean * mean))
    return s.select(*by, "n", mean.alias("mean"), sd.alias("sd"), F.try_divide(sd, mean).alias("cv"))


def depth_report(aln: DataFrame, genome: DataFrame, windows: DataFrame, bin_size: int = 1 << 20) -> DataFrame:
    """(reads, unit, region, n, mean, sd, cv): the summaries of a coverage report, over bases and CpGs, all reads and those of mapq 40 or more, everywhere and in the tenth of the ``windows`` (chrom, beg0, end,
    gc) of most and of least gc; nulls where there is nothing to sum up.

    Runs of depth and depths of CpGs are each made once and written; then all of them meet the windows of both regions in one join and one aggregate sums them up.
    """
    from ..sources import genome as gn
    from ..sources import store

    contigs = gn.lengths(genome).withColumnRenamed("n", "clen")
    runs = [depth(reads_for(aln, kind), contigs, bin_size).select(F.lit(kind).alias("reads"), "chrom", "beg0", "end", "depth") for kind in ("all", "q40")]
    runs = store.written(runs[0].unionByName(runs[1]), "depth-runs")
    met = overlaps(gn.cpg_sites(genome).select("chrom", "beg0", "end"), runs, CPG_BIN)
    cpgs = store.written(met.groupBy(F.col("b_reads").alias("reads"), "chrom", "beg0", "end").agg(F.min("b_depth").alias("depth")), "depth-cpgs")
    tenth = lambda name, top: decile(windows, top).select("chrom", "beg0", "end", F.lit(name).alias("region"))
    regions = store.written(tenth("top", True).unionByName(tenth("bottom", False)), "depth-regions")
    rows = runs.withColumn("unit", F.lit("base")).unionByName(cpgs.withColumn("unit", F.lit("cpg")))
    # a CpG counts in each window that it shares a base with, a run by the bases it shares
    shared = overlaps(rows, regions, WINDOW_BIN)
    inside = shared.select("reads", "unit", F.col("b_region").alias("region"), "depth", (F.least("end", "b_end") - F.greatest("beg0", "b_beg0")).alias("bases"))
    every = rows.select("reads", "unit", F.lit("all").alias("region"), "depth", (F.col("end") - F.col("beg0")).alias("bases")).unionByName(inside)
    hist = every.groupBy("reads", "unit", "region", "depth").agg(F.sum(F.when(F.col("unit") == "cpg", 1).otherwise(F.col("bases"))).alias("n"))
    each = [(r, u, g) for r in ("all", "q40") for u in ("base", "cpg") for g in ("all", "top", "bottom")]
    names = aln.sparkSession.createDataFrame(each, "reads string, unit string, region string")
    return names.join(moments(hist, "reads", "unit", "region"), ["reads", "unit", "region"], "left")


def decile(windows: DataFrame, top: bool, share: float = 0.1) -> DataFrame:
    """The tenth of the windows of highest or lowest gc; ties go by the text of the row, as a line-based sort has it.

    A histogram over the few values of gc finds the value at the border; of the windows of that very value whole contigs fill what is left, and one contig is ranked.
    """
    hist = sorted((r.gc, r.n) for r in windows.groupBy("gc").agg(F.count("*").alias("n")).collect())  # at most width + 1 rows
    left = int(sum(n for _, n in hist) * share + 0.5)
    line = F.concat_ws("\t", "chrom", F.col("beg0").cast("string"), F.col("end").cast("string"))
    taken, border = [], None
    for gc, n in reversed(hist) if top else hist:
        if n > left:
            border = gc
            break
        taken.append(gc)
        left -= n
    whole = windows.where(F.col("gc").isin(taken)) if taken else windows.where(F.lit(False))
    if border is None or not left:
        return whole
    some = windows.where(F.col("gc") == border).withColumn("_line", line)
    # whole contigs first; only the contig at the border is ranked
    way = F.desc if top else F.asc
    per = some.groupBy("chrom").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(F.lit(0)).orderBy(way("chrom")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row a contig
    some = some.join(per.withColumn("_take", F.lit(left) - before).where("_take > 0"), "chrom")
    last = some.where("_take < _n").withColumn("_k", F.row_number().over(W.partitionBy("chrom").orderBy(way("_line")))).where("_k <= _take")
    return whole.unionByName(some.where("_take >= _n").select(*windows.columns)).unionByName(last.select(*windows.columns))

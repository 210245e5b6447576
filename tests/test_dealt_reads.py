"""Reads are dealt to the blocks that they touch, so that sites are counted without a shuffle of bases."""

from pyspark.sql import functions as F

from cytolake.operators import bases, pileup
from cytolake.plans import registry
from cytolake.sources import fixtures as fx

SF = "/root/testdata/sf0.001"
LOOSE = bases.Filters(min_mapq=0, min_length=1, min_score=0, min_qual=0, min_dist5=0, min_dist3=0)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_reads_alone_are_shuffled(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("pileup_genotype", "pileup_max_retention"):
            # reads and genome blocks
            assert plan(registry.QUERIES[name](spark, SF)).count("Exchange hashpartitioning") == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_bases_beside_borders(spark):
    """Every base of reads over the borders of blocks counts once, whatever the reads' length."""
    size = bases.BLOCK
    text = ("ACGGT" * (3 * size // 5))[: 3 * size - 700]
    rows = [(k, beg, n) for k, (beg, n) in enumerate([(size - 30, 50), (size - 49, 50), (size + 1, 50), (size - 2046, 2048), (size - 2047, 2048), (2 * size - 10, 2048), (len(text) - 49, 50)])]
    reads = spark.createDataFrame(
        [(k, 0, f"r{k}", 0, "c", b, 60, f"{n}M", text[b - 1 : b - 1 + n], "I" * n, None, None, None, None, "f", None, None) for k, b, n in rows],
        "rid long, sid int, qname string, flag int, chrom string, pos1 int, mapq int, cigar string, seq string, qual string, mpos1 int, NM int, AS int, MC string, YD string, ZS string, XG string",
    )
    genome = spark.createDataFrame([("c", text)], "chrom string, seq string")
    sites = pileup.counts(pileup.site_bases(reads, genome, pileup.Options(LOOSE))).collect()
    depth = {p: sum(b <= p < b + n for _, b, n in rows) for p in range(1, len(text) + 1)}
    assert {r.pos1: r.dp for r in sites} == {p: d for p, d in depth.items() if d} and len(sites) == sum(d > 0 for d in depth.values())
    around = "NN" + text + "NN"
    assert all(r.ref == text[r.pos1 - 1] and r.five == around[r.pos1 - 1 : r.pos1 + 4] for r in sites)
    # a read is kept or dropped whole, by the bases of all its blocks
    same = [text[b - 1 : b - 1 + n].count("G") for _, b, n in rows]
    few = pileup.site_bases(reads.withColumn("YD", F.lit("r")), genome, pileup.Options(bases.Filters(**{**LOOSE.__dict__, "max_retention": 25})))
    assert {r.rid for r in few.select("rid").distinct().collect()} == {k for k, n in enumerate(same) if n > 25} ^ set(range(len(rows)))


def test_sites_without_a_change_go_first(spark):
    called = pileup.calls(pileup.counts(pileup.site_bases(fx.alignments(spark, SF), fx.genome(spark, SF))))
    verbose = pileup.calls(pileup.counts(pileup.site_bases(fx.alignments(spark, SF), fx.genome(spark, SF))), pileup.Options(verbose=True))
    meth = F.sum(F.col("n_ret") + F.col("n_conv")).over(pileup.W.partitionBy("chrom", "pos1"))
    want = verbose.withColumn("_m", meth).where("alt is not null or _m > 0").drop("_m")
    assert called.exceptAll(want).count() == want.exceptAll(called).count() == 0
    assert "_any" in plan(called)

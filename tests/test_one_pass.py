"""Reports that look at the reads once, and lookups without a row for each base."""

from cytolake.operators import methbed
from cytolake.plans import registry
from cytolake.sources import genome as gn

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_targets_in_one_pass(spark):
    assert plan(registry.QUERIES["cinread_targets"](spark, SF)).count("Join LeftOuter") == 1


def test_cigar_walked_once(spark):
    """Once for the span and once for the columns; filters that Spark takes from a generator do not walk it again."""
    assert plan(registry.QUERIES["aligned_columns"](spark, SF)).count("regexp_extract_all(cigar") == 2


def test_merge_looks_up_cpgs_only(spark):
    g = spark.createDataFrame([("c", "ACGTGCGCACGGTACG"), ("d", "CG")], "chrom string, seq string")
    every = [("c", k, 0, 0.5, 4) for k in range(16)] + [("d", k, 0, 0.5, 4) for k in range(2)]
    meth = spark.createDataFrame(every, "chrom string, beg0 long, sid int, beta double, cov long")
    got = methbed.mergecg(meth, g)
    assert "sequence(0, (n" not in plan(got)
    assert sorted((r.chrom, r.beg0, r.c_cov, r.g_cov) for r in got.collect()) == [("c", k, 4, 4) for k in (1, 5, 9, 14)] + [("d", 0, 4, 4)]
    # neither a G before nor a C behind
    assert sorted((r.chrom, r.beg0) for r in methbed.mergecg(meth, g, nome=True).collect()) == [("c", 1), ("c", 9), ("c", 14), ("d", 0)]
    assert sorted(map(tuple, gn.cpg_sites(g, beside=True).where("chrom = 'c'").select("beg0", "before", "behind").collect())) == [(1, "A", "T"), (5, "G", "C"), (9, "A", "G"), (14, "A", "N")]

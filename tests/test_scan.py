"""Matches found in the genome's own text are those of the index, wherever blocks, batches and steps end, and no k-mer and no match is shuffled."""

import random

import pytest
from pyspark.sql import functions as F

from cytolake.operators import align, scan, seeds
from cytolake.plans import registry

SF = "/root/testdata/sf0.001"


def rows(df, like):
    return sorted(map(str, df.select(sorted(like.columns)).collect()))


@pytest.fixture(scope="module")
def data(spark):
    rnd = random.Random(3)
    text = lambda n: "".join(rnd.choice("ACGT") for _ in range(n))
    passage = text(70)
    long = "".join(text(rnd.randrange(20, 900)) + passage[: rnd.randrange(30, 70)] for _ in range(24))
    contigs = [("a", passage + long + "N" + passage), ("b", text(40) + passage * 3), ("c", passage[10:40]), ("d", "ACG")]
    cuts = [(0, 50), (4096 - 30, 4096 + 40), (8192 - 49, 8192 + 1), (len(long) // 2, len(long) // 2 + 64)]
    texts = [contigs[0][1][a:b] for a, b in cuts] + [passage[:45] + "N" + passage[46:], passage[20:69].replace("C", "T"), passage[:60][::-1].translate(str.maketrans("ACGT", "TGCA")), "ACGT", "T" * 30]
    genome = spark.createDataFrame(contigs, "chrom string, seq string")
    return genome, spark.createDataFrame([(k, 1 + k % 2, s) for k, s in enumerate(texts)] + [(99, 1, None)], "rid long, mate int, seq string")


@pytest.mark.parametrize("small", [False, True])
@pytest.mark.parametrize("options", [{}, {"k": 9}, {"directional": True}, {"strand": 1, "k": 11}, {"single": 0, "stride": 3}])
def test_as_by_an_index(spark, data, monkeypatch, small, options):
    if small:
        for name, n in (("GENOME_BASES", 3000), ("READ_BASES", 100), ("STEP", 50), ("PAIRS", 3)):
            monkeypatch.setattr(scan, name, n)
    genome, reads = data
    o = align.Options(**options)
    of, idx = scan.Text(genome), align.index(genome, o).cache()
    want = seeds.maximal(reads, idx, o, veto=True).cache()
    assert want.count() > 5
    assert rows(seeds.maximal(reads, of, o, veto=True), want) == rows(want, want)
    bare = seeds.maximal(reads, idx, o)
    assert rows(seeds.maximal(reads, of, o), bare) == rows(bare, bare)
    plain = align.seeds(reads, idx, o)
    assert rows(align.seeds(reads, of, o), plain) == rows(plain, plain)
    counts = seeds.stretches(want)
    assert rows(seeds.counted(reads, of, o, veto=True), counts) == rows(counts, counts)
    by = seeds.seeded(reads, idx, o)
    assert rows(seeds.seeded(reads, of, o), by) == rows(by, by)
    few = align.Options(**options, max_occ=1)
    repeats = align.repeated(reads, align.frequent(idx, few), few)
    every = align.Options(k=o.k, stride=o.stride, max_occ=1)
    assert rows(align.repeated_in(reads, scan.stretches(reads, of, every, False), few), repeats) == rows(repeats, repeats)


@pytest.mark.parametrize("name", ["seed_join", "maximal_seeds", "super_maximal_seeds"])
def test_no_match_is_shuffled(spark, name):
    """Below what finds the matches are texts; above it nothing is exchanged but counts of stretches."""
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan
    above = plan[: plan.index("MapInArrow")]
    assert above.count("Aggregate") == (name == "super_maximal_seeds")
    assert "xxhash64(_w" not in plan  # no row a k-mer


def test_longer_k_mers_have_an_index(spark, data):
    genome, reads = data
    o = align.Options(k=scan.MAX_K + 2)
    want = seeds.maximal(reads, align.index(genome, o), o)
    assert want.count() and rows(seeds.maximal(reads, scan.Text(genome), o), want) == rows(want, want)
    assert seeds.counted(reads, scan.Text(genome), o).count() == want.select("rid", "mate", "parent", "qb", "qe").distinct().count()
    assert align.align(reads, genome, o).where(F.col("rid") == 0).first().pos1 == 1

"""Which hits stay and how they are ranked, against the rules written out."""

import random

import pytest
from pyspark.sql import functions as F

from cytolake.functions import seq
from cytolake.operators import align
from cytolake.sinks import text as sinks


def hit(rid, chrom, pos1, score, left, n, total=100, reverse=0):
    cigar = (f"{left}S" if left else "") + f"{n}M" + (f"{total - left - n}S" if left + n < total else "")
    return (rid, 1, chrom, 1, reverse, pos1, score, cigar, 0, "", 0, 0, reverse)


@pytest.fixture(scope="module")
def hits(spark):
    rnd = random.Random(31)
    rows = []
    for rid in range(80):
        for _ in range(rnd.randrange(1, 9)):
            left = rnd.choice([0, 0, 10, 40, 60])
            rows.append(hit(rid, rnd.choice(["chr1", "chr2", "chr1_alt", "chr9_alt"]), rnd.choice([10, 11, 12, 40, 500]), rnd.randrange(40, 50), left, rnd.choice([40, 39, 100 - left]), reverse=rnd.randrange(2)))
    return rows


def order(x):
    return (-x["score"], x["chrom"], x["pos1"], x["reverse"], x["cigar"])


def spans(r):
    lead = int(r["cigar"].split("S")[0]) if "S" in r["cigar"].split("M")[0] else 0
    n = int(r["cigar"].split("M")[0].split("S")[-1])
    tail = 100 - lead - n
    return (tail, tail + n) if r["reverse"] else (lead, lead + n)


def mark(some, overlap=0.5):
    """The first kept hit that each repeats, from the best down."""
    kept, under = [], {}
    for x in some:
        over = [y for y in kept if (s := min(x["q"][1], y["q"][1]) - max(x["q"][0], y["q"][0])) > 0 and s >= overlap * min(x["q"][1] - x["q"][0], y["q"][1] - y["q"][0])]
        under[id(x)] = over[0] if over else None
        if not over:
            kept.append(x)
    return under


def test_alternate_contigs_do_not_lower_others(spark, hits):
    df = spark.createDataFrame(hits, align.RESULT)
    alternates = spark.createDataFrame([("chr1_alt",), ("chr9_alt",)], "chrom string")
    got = {(r.rid, r.chrom, r.pos1, r.reverse, r.cigar): r for r in align.marked(df, alternates=alternates).collect()}
    reads = {}
    for r in df.dropDuplicates(["rid", "mate", "chrom", "pos1", "reverse", "parent", "cigar"]).collect():
        reads.setdefault(r.rid, []).append(r.asDict() | {"q": spans(r.asDict()), "alt": r.chrom.endswith("_alt")})
    # where equal hits differ in score alone, either may stay
    for rid, some in reads.items():
        for x in some:
            x["score"] = got[rid, x["chrom"], x["pos1"], x["reverse"], x["cigar"]].score
        together = mark(sorted(some, key=lambda x: (-x["score"], x["alt"], *order(x)[1:])))
        apart = mark(sorted((x for x in some if not x["alt"]), key=order))
        final = sorted(some, key=lambda x: (x["alt"], *order(x)))
        rank = {id(x): k + 1 for k, x in enumerate(final)}
        for x in some:
            r = got[rid, x["chrom"], x["pos1"], x["reverse"], x["cigar"]]
            over = (together if x["alt"] else apart)[id(x)]
            assert (r.k, r.alt, r.under) == (rank[id(x)], x["alt"], rank[id(over)] if over else 0)
            first = together[id(x)]
            assert r.over_alt == (first["score"] if first and first["alt"] and not x["alt"] else None)


def test_tags_of_hits_on_alternate_contigs(spark):
    rows = [hit(0, "chr1", 10, 90, 0, 100), hit(0, "chr1_alt", 10, 95, 0, 100), hit(0, "chr2", 7, 85, 0, 100), hit(1, "chr1_alt", 5, 99, 0, 100), hit(1, "chr2", 5, 99, 0, 100)]
    names = spark.createDataFrame([(f"chr{k}",) for k in range(1, 23)] + [("chr1_alt",)], "chrom string")
    alternates = seq.with_alternates(names).where("alternate")
    found = align.records(spark.createDataFrame(rows, align.RESULT), alternates=alternates).cache()
    got = {(r.rid, r.chrom): r for r in found.collect()}
    one = got[0, "chr1"]
    assert set(got) == {(0, "chr1"), (0, "chr1_alt"), (1, "chr2"), (1, "chr1_alt")} or set(got) == {(0, "chr1"), (1, "chr2"), (0, "chr1_alt")}
    assert (one.flag, one.XS, one.XB, one.XA) == (0, 85, "1,0", "chr2,+7,100M,0;")
    assert abs(one.PA - 90 / 95) < 1e-12
    assert (got[1, "chr2"].XS, got[1, "chr2"].flag) == (None, 0) and got[1, "chr2"].mapq == 60
    plain = {(r.rid, r.chrom): r for r in align.records(spark.createDataFrame(rows, align.RESULT)).collect()}
    assert set(plain) == {(0, "chr1_alt"), (1, "chr1_alt")} and plain[1, "chr1_alt"].mapq == 0 and plain[0, "chr1_alt"].PA is None
    reads = spark.createDataFrame([(k, 1, f"q{k}", "A" * 100, "I" * 100) for k in (0, 1)], "rid long, mate int, qname string, seq string, qual string")
    lines = [r.value for r in sinks.sam_lines(align.sam_rows(found, reads)).collect() if "\tchr1\t" in r.value]
    assert len(lines) == 1 and "PA:f:0.947" in lines[0] and "XB:Z:1,0" in lines[0]


def test_repeated_hits_go(spark, hits):
    df = spark.createDataFrame(hits, align.RESULT).dropDuplicates(["rid", "chrom", "pos1", "reverse", "cigar"]).cache()
    got = {(r.rid, r.chrom, r.pos1, r.reverse, r.cigar) for r in align.without_repeats(df).collect()}
    groups = {}
    for r in df.collect():
        x = r.asDict() | {"q": spans(r.asDict())}
        x["r"] = (x["pos1"], x["pos1"] + x["q"][1] - x["q"][0])
        groups.setdefault((r.rid, r.chrom, r.reverse), []).append(x)
    want = set()
    for some in groups.values():
        kept = []
        for x in sorted(some, key=lambda x: (-x["score"], x["pos1"], x["cigar"])):
            shared = lambda y, k: min(x[k][1], y[k][1]) - max(x[k][0], y[k][0])  # noqa: E731, B023
            least = lambda y, k: min(x[k][1] - x[k][0], y[k][1] - y[k][0])  # noqa: E731, B023
            if not any(all(shared(y, k) > 0.95 * least(y, k) for k in "qr") for y in kept):
                kept.append(x)
        want |= {(x["rid"], x["chrom"], x["pos1"], x["reverse"], x["cigar"]) for x in kept}
    assert got == want and len(want) < df.count()


def test_a_long_deletion_is_one_hit(spark):
    rnd = random.Random(2)
    text = "".join(rnd.choice("ACGT") for _ in range(3000))
    reads = [(0, 1, text[500:600] + text[630:730]), (1, 1, text[1000:1090] + text[1000:1010] + text[1090:1180]), (2, 1, text[2000:2100] + "GATTACAGGCATCCGATCAGTTACGCAAGT" + text[2100:2200])]
    genome = spark.createDataFrame([("c", text)], "chrom string, seq string")
    got = {r.rid: (r.pos1, r.cigar, r.score) for r in align.align(spark.createDataFrame(reads, "rid long, mate int, seq string"), genome).collect()}
    assert got[0][0] == 501 and got[0][1].count("D") == 1 and "30D" in got[0][1] and got[0][2] == 200 - 36
    assert got[1][1].count("I") == 1 and "10I" in got[1][1] and got[2][0] == 2001 and "30I" in got[2][1]
    found = align.extend(spark.createDataFrame(reads, "rid long, mate int, seq string"), spark.createDataFrame([(0, 1, "c", 1, 0, 500, (100, 0)), (0, 1, "c", 1, 0, 530, (100, 100))], "rid long, mate int, chrom string, parent int, reverse int, diag0 int, seed struct<n:int,b:int>"), genome)
    assert found.count() == 2 and align.without_repeats(found).count() == 1  # both chains of the read come to the same hit
    assert found.where(F.col("pos1") == 501).count() == 2

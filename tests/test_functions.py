"""Expressions and single operators on hand-written cases."""

import math
import random

import numpy as np

import pytest
from pyspark.sql import functions as F

from cytolake.functions import cigar, seq, stats
from cytolake.operators import align, asm, bases, coverage, epiread, fastq, methbed, pileup, readqc, seeds, view
from cytolake.sinks import text as sink
from cytolake.sources import genome as gn


def one(spark, col, **values):
    df = spark.createDataFrame([tuple(values.values())] if values else [(0,)], list(values) or ["_"])
    return df.select(col.alias("x")).first().x


GENOME = [("c1", "ACGTTCGAACCGGTTACGCA"), ("c2", "NNCGN")]
READ = "sid int, rid long, qname string, flag int, chrom string, pos1 int, mapq int, cigar string, mpos1 int, isize int, seq string, qual string, NM int, `AS` int, MC string, YD string, ZS string, XG string"
LOOSE = bases.Filters(min_mapq=0, min_length=1, min_score=0, min_qual=0, min_dist5=0, min_dist3=0)


def reads(spark, *rows):
    out = []
    for k, r in enumerate(rows):
        d = dict(sid=0, rid=k, qname=f"r{k}", flag=0, chrom="c1", pos1=1, mapq=60, cigar="4M", mpos1=0, isize=0, seq="ACGT", qual="IIII", NM=None, AS=None, MC=None, YD="f", ZS=None, XG=None) | r
        out.append(tuple(d.values()))
    return spark.createDataFrame(out, READ)


@pytest.fixture(scope="module")
def genome(spark):
    return spark.createDataFrame(GENOME, "chrom string, seq string")


@pytest.mark.parametrize(("s", "want"), [("A", "A"), ("AA", "A2"), ("ABBA", "AB2A"), ("", ""), ("x" * 12 + "M", "x12M")])
def test_run_lengths(spark, s, want):
    assert one(spark, seq.run_lengths(F.col("s")), s=s) == want


def test_revcomp_and_convert(spark):
    assert one(spark, seq.revcomp(F.col("s")), s="ACGTN") == "NACGT"
    assert one(spark, seq.convert(F.col("s"), True), s="ACGT") == "ATGT"
    assert one(spark, seq.convert(F.col("s"), False), s="ACGT") == "ACAT"


def test_cigar(spark):
    assert one(spark, cigar.reference_length(F.col("c")), c="5S20M2D10M3I5M4H") == 37
    assert one(spark, cigar.query_length(F.col("c")), c="5S20M2D10M3I5M4H") == 43
    got = one(spark, cigar.blocks(F.col("c"), F.lit(101)), c="2S3M1D2I2M")
    assert [(b.op, b.n, b.q, b.r, b.c) for b in got] == [("S", 2, 1, 101, 1), ("M", 3, 3, 101, 3), ("D", 1, 6, 104, 6), ("I", 2, 6, 105, 7), ("M", 2, 8, 105, 9)]


@pytest.mark.parametrize("size", [2, 3, 7, 64])
def test_blocks_do_not_depend_on_their_size(spark, genome, size):
    want = {(c, i + 1, b, ("NN" + s + "NN")[i : i + 5]) for c, s in GENOME for i, b in enumerate(s)}
    assert {tuple(r) for r in gn.positions(genome, size).collect()} == want


def test_cpg_sites_and_contexts(spark, genome):
    assert sorted((r.chrom, r.beg0) for r in gn.cpg_sites(genome).collect()) == [("c1", 1), ("c1", 5), ("c1", 10), ("c1", 16), ("c2", 2)]
    five = seq.oriented(F.col("five"), F.col("ref"))
    got = {(r.chrom, r.pos1): r.x for r in gn.positions(genome).select("chrom", "pos1", seq.context(five, F.col("ref")).alias("x")).collect()}
    assert got["c1", 2] == "CN" and got["c1", 6] == "CG" and got["c1", 7] == "CG" and got["c1", 10] == "CHG" and got["c2", 3] == "CN" and got["c1", 1] == "CN"


def test_strand_tags_have_two_orders_of_priority(spark, genome):
    rows = reads(spark, dict(YD="r", ZS="++"), dict(YD="u", ZS="-+", XG="CT"), dict(YD=None, XG="GA"), dict(YD=None, seq="ATGT"), dict(YD=None, seq="ACAT"))
    found = bases.with_strand(bases.with_slice(rows, genome)).withColumn("tag", bases.strand_tag())
    assert [(r.bss, r.tag) for r in found.orderBy("rid").collect()] == [(1, "f"), (1, "r"), (1, "r"), (0, "u"), (1, "u")]


def test_equal_changes_conflict_and_none_are_unknown(spark, genome):
    rows = reads(spark, dict(seq="ATAT"), dict(), dict(seq="ATGT"))
    assert [r.own for r in readqc.strands(rows, genome).orderBy("rid").collect()] == ["c", "u", "f"]


def test_overlapping_mates_count_once(spark, genome):
    pair = dict(flag=1 | 2 | 128, pos1=3, mpos1=1)
    a = pileup.site_bases(reads(spark, pair | dict(MC="3M")), genome, pileup.Options(LOOSE))
    assert sorted((r.rpos, r.good) for r in a.collect()) == [(3, False), (4, True), (5, True), (6, True)]
    b = pileup.site_bases(reads(spark, pair), genome, pileup.Options(LOOSE))
    assert sorted((r.rpos, r.good) for r in b.collect()) == [(3, False), (4, False), (5, True), (6, True)]


def test_read_past_the_contig_and_last_base(spark, genome):
    got = pileup.site_bases(reads(spark, dict(pos1=19, seq="CA", qual="II", cigar="2M")), genome, pileup.Options(LOOSE)).collect()
    assert sorted(r.rpos for r in got) == [19, 20]
    compat = bases.Filters(**(LOOSE.__dict__ | {"drop_contig_end": True}))
    got = pileup.site_bases(reads(spark, dict(pos1=19, seq="CA", qual="II", cigar="2M")), genome, pileup.Options(compat)).collect()
    assert [r.rpos for r in got] == [19]


def sites(spark, *rows):
    base = dict(chrom="c", pos1=1, sid=0, ref="C", five="AACGA", n_ret=1, n_conv=0, dp=9, n_A=0, n_C=0, n_G=0, n_T=0, n_Y=0, n_R=0)
    return spark.createDataFrame([tuple((base | r).values()) for r in rows], "chrom string, pos1 int, sid int, ref string, five string, n_ret long, n_conv long, dp long, n_A long, n_C long, n_G long, n_T long, n_Y long, n_R long")


@pytest.mark.parametrize(("t", "want"), [(0, True), (4, True), (5, False)])
def test_callable_limit(spark, t, want):
    df = sites(spark, dict(n_C=100, n_T=t))
    assert pileup.calls(df).first().callable is want


def test_redistribution_looks_at_all_samples(spark):
    got = pileup.redistributed(sites(spark, dict(ref="A", n_Y=3), dict(ref="A", sid=1, n_T=2, n_Y=1))).orderBy("sid").collect()
    assert [(r.n_T, r.n_Y) for r in got] == [(3, 0), (3, 0)]
    both = pileup.redistributed(sites(spark, dict(ref="A", n_C=1, n_Y=3), dict(ref="A", sid=1, n_T=2))).collect()
    assert sorted(r.n_Y for r in both) == [0, 3]


def test_top_mutant_ties_go_to_the_lower_code(spark):
    assert pileup.calls(sites(spark, dict(n_A=2, n_T=2, n_C=9))).first().alt == "A"
    assert pileup.calls(sites(spark, dict(n_Y=5, n_C=9))).first().alt is None


def test_genotype_probabilities(spark):
    def gt(nref, nalt):
        return stats.with_genotype(spark.createDataFrame([(nref, nalt)], "nref long, nalt long")).first()

    assert gt(20, 0).gt == "0/0" and gt(10, 10).gt == "0/1" and gt(0, 20).gt == "1/1" and gt(0, 0).gt == "./."
    ls = [math.log(1 / 3) + 3 * math.log(1 - r) + math.log(r) for r in stats.alt_rates()]
    top = max(ls)
    rest = sum(math.exp(x - top) for x in ls) - 1
    assert gt(3, 1).gq == pytest.approx(-10 * math.log10(rest / (1 + rest)))


@pytest.mark.parametrize("t", [(3, 1, 1, 3), (10, 0, 0, 10), (1, 0, 0, 1), (12, 5, 29, 2), (0, 5, 5, 0)])
def test_fisher_and_chi_square(spark, t):
    a, b, c, d = t
    n, r1, c1 = sum(t), a + b, a + c
    p = lambda x: math.comb(r1, x) * math.comb(n - r1, c1 - x) / math.comb(n, c1)
    want = sum(p(x) for x in range(max(0, c1 - (n - r1)), min(r1, c1) + 1) if p(x) <= p(a) * (1 + 1e-7))
    got = asm.tests(spark.createDataFrame([t], "n11 int, n12 int, n21 int, n22 int")).first()
    assert got.p_fisher == pytest.approx(min(1, want), rel=1e-9)
    chi = n * (a * d - b * c) ** 2 / (r1 * (n - r1) * c1 * (n - c1))
    assert got.p_chisq == pytest.approx(math.erfc(math.sqrt(chi / 2)), rel=1e-9)


def test_fisher_of_large_counts(spark):
    """Products of margins are beyond an int, and the cost of a table does not grow with the square of its counts."""
    t = a, b, c, d = 40_100, 29_900, 24_000, 18_200
    lg = lambda *v: sum(math.lgamma(x + 1) for x in v)
    lp = lambda x: lg(a + b, c + d, a + c, b + d) - lg(a + b + c + d, x, a + b - x, a + c - x, d - a + x)
    want = sum(math.exp(lp(x)) for x in range(max(0, a - d), min(a + b, a + c) + 1) if lp(x) <= lp(a) + 1e-7)
    got = spark.createDataFrame([t], "a int, b int, c int, d int").select(stats.fisher_two_sided(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).first()[0]
    assert got == pytest.approx(want, rel=1e-7)


@pytest.mark.parametrize(("v", "want"), [([5, 4, 3, 2, 1], (0, 1)), ([1, 1, 1, 0, 0], (0, 2)), ([0, 0, 0, 0, 0], (0, 4)), ([1, 2, 3, 4, 5], (3, 4))])
def test_two_largest(spark, v, want):
    def plain(v):
        m = [0, 1]
        for i in range(2, len(v)):
            k = 0 if v[m[0]] < v[m[1]] else 1
            if v[i] >= v[m[k]]:
                m[k] = i
        return tuple(m)

    got = one(spark, asm.two_largest(F.col("v")), v=v)
    assert (got.a, got.b) == plain(v)
    assert sorted(plain(v)) == sorted(want)


def test_mergecg(spark, genome):
    rows = [("c1", 1, 0, 0.5, 4), ("c1", 2, 0, 1.0, 1), ("c1", 5, 0, 0.25, 4), ("c1", 11, 0, 1.0, 3), ("c1", 16, 0, 0.0, 2), ("c1", 0, 0, 1.0, 9)]
    meth = spark.createDataFrame(rows, "chrom string, beg0 int, sid int, beta double, cov int")
    got = {r.beg0: (r.beta, r.cov) for r in methbed.mergecg(meth, genome).collect()}
    assert got == {1: (0.6, 5), 5: (0.25, 4), 10: (1.0, 3), 16: (0.0, 2)}
    assert {r.beg0 for r in methbed.mergecg(meth, genome, nome=True).collect()} == {1, 5, 10}
    assert {r.beg0 for r in methbed.mergecg(meth, genome, min_depth=5).collect()} == {1}


def test_depth_covers_whole_contigs_and_ignores_bin_size(spark, genome):
    aln = reads(spark, dict(pos1=2), dict(pos1=4, cigar="2M1D2M"), dict(pos1=6))
    contigs = genome.select("chrom", F.length("seq").alias("clen"))
    flat = lambda d: {(r.chrom, p): r.depth for r in d.collect() for p in range(r.beg0, r.end)}
    want = {(c, p): 0 for c, s in GENOME for p in range(len(s))}
    for beg, n in ((2, 4), (4, 5), (6, 4)):
        for p in range(beg - 1, beg - 1 + n):
            want["c1", p] += 1
    assert flat(coverage.depth(aln, contigs)) == want == flat(coverage.depth(aln, contigs, 3))
    assert sorted(map(tuple, coverage.depth(aln, contigs).collect())) == sorted(map(tuple, coverage.depth(aln, contigs, 3).collect()))


def test_decile_takes_whole_contigs_then_ranks_one(spark):
    rows = [(c, 100 * k, 100 * k + 100, 50 if k < 8 else 60) for c in ("c1", "c2", "c10") for k in range(10)]
    df = spark.createDataFrame(rows, "chrom string, beg0 int, end int, gc int")
    for top in (True, False):
        for share in (0.1, 0.4, 0.5, 0.9):
            n = int(len(rows) * share + 0.5)
            want = sorted(rows, key=lambda r: (r[3], f"{r[0]}\t{r[1]}\t{r[2]}"), reverse=top)[:n]
            assert sorted(map(tuple, coverage.decile(df, top, share).collect())) == sorted(want)


def test_depth_report(spark, genome):
    from cytolake.sources import genome as gn

    aln = reads(spark, dict(pos1=2), dict(pos1=4, mapq=10))
    got = {(r.reads, r.unit, r.region): r for r in coverage.depth_report(aln, genome, gn.gc_windows(genome, 4)).collect()}
    assert len(got) == 12
    bases_ = sum(len(s) for _, s in GENOME)
    assert got["all", "base", "all"].n == bases_ and abs(got["all", "base", "all"].mean - 8 / bases_) < 1e-12
    assert abs(got["q40", "base", "all"].mean - 4 / bases_) < 1e-12
    assert got["all", "base", "top"].n % 4 == 0 and got["all", "base", "top"].n > 0


def test_overlaps_once(spark):
    a = spark.createDataFrame([("c", 0, 100), ("c", 95, 300)], "chrom string, beg0 int, end int")
    b = spark.createDataFrame([("c", 50, 250), ("c", 300, 310)], "chrom string, beg0 int, end int")
    assert sorted((r.beg0, r.b_beg0) for r in coverage.overlaps(a, b, 10).collect()) == [(0, 50), (95, 50)]


def test_barcode_at_the_read_end(spark):
    df = spark.createDataFrame([(0, "a/1", "ACGTACGT", "IIIIIIII", None, None), (1, "b", "ACGTACG", "IIIIIII", None, None)], "ord long, name string, seq1 string, qual1 string, seq2 string, qual2 string")
    got = fastq.extract_barcode(df, start=5, length=4).collect()
    assert [(r.name, r.seq1, r.qual1) for r in got] == [("a_ACGT_AAAAAAAA", "ACGT", "IIII")]


@pytest.mark.parametrize(("s", "want"), [("AAGATC", 4), ("GATCAA", 6), ("AAAGA", 2), ("AAAA", 0), ("", 0)])
def test_adaptor(spark, s, want):
    assert one(spark, fastq.adaptor_length(F.col("s"), "GATC"), s=s) == want


@pytest.mark.parametrize(("q", "want"), [("##II#", (2, 1)), ("III", (0, 0)), ("###", (3, 0)), ("", (0, 0))])
def test_quality_ends(spark, q, want):
    a, b = fastq.quality_ends(F.col("q"), 20)
    assert one(spark, F.struct(a.alias("a"), b.alias("b")), q=q) == want


def test_epibed_of_clips_and_indels(spark, genome):
    rows = reads(spark, dict(pos1=2, cigar="1S2M1I1D3M", seq="TCGATCG", qual="IIIIIII"))
    got = epiread.epibed(epiread.states(rows, genome, None, epiread.Options(LOOSE))).first()
    assert (got.start0, got.end, got.cg, got.vr) == (0, 7, "PMxidxMx", "Px2aDx3")


def test_modified_bases(spark):
    rows = spark.createDataFrame([(0, 0, "ACCGC", "C+m,1,0;", [250, 3])], "rid long, flag int, seq string, MM string, ML array<int>")
    assert [(r.q, r.call) for r in epiread.modified_bases(rows).orderBy("q").collect()] == [(3, "M"), (5, "U")]
    back = spark.createDataFrame([(0, 16, "ACCGC", "C+m,0;", [250])], "rid long, flag int, seq string, MM string, ML array<int>")
    assert [r.q for r in epiread.modified_bases(back).collect()] == [4]


MODIFIED = "rid long, flag int, seq string, MM string, ML array<int>"


def test_bases_of_modification_tags(spark):
    rows = [
        (0, 0, "CCGCA", "C+m?,1;", [250]),  # the skipped C is of unknown state
        (1, 16, "CCGGC", "G-m,1;", [9]),  # Gs of the sequenced strand are stored Cs, from the right
        (2, 0, "CCGCA", "C+m,0,5;", [250, 1]),  # a base that the read does not have
        (3, 0, "CCGCA", "C+m.,2;", None),
        (4, 0, "CCGCA", None, None),
        (5, 0, "", "C+m,0;", [1]),
        (6, 0, "CCGCA", "C+m;", []),
    ]
    got = {r.rid: r for r in epiread.with_modifications(spark.createDataFrame(rows, MODIFIED)).collect()}
    near = lambda k: {q: round(p, 3) for q, p in got[k].mods.items()}
    assert near(0) == {1: -1.0, 2: 0.979, 4: -1.0}
    assert (near(1), got[1].mod_base) == ({2: 0.037}, "C")
    assert near(2) == {1: 0.979} and near(3) == {4: -1.0}
    assert not any(got[k].mods for k in (4, 5, 6))


@pytest.mark.parametrize("tag", ["C+h,0;", "C+mh,0;", "C+m,0;C+h,0;", "A+m,0;"])
def test_other_modifications_are_errors(spark, tag):
    with pytest.raises(Exception, match="not one methylation"):
        epiread.with_modifications(spark.createDataFrame([(0, 0, "ACCGC", tag, [1, 2])], MODIFIED)).collect()


def test_alternates_need_the_main_contigs(spark):
    main = [f"chr{k}" for k in range(1, 20)]
    names = lambda x: {r.chrom for r in seq.with_alternates(spark.createDataFrame([(c,) for c in x], "chrom string")).where("alternate").collect()}
    others = ["chrUn_1", "chr6_hap2", "chr1_random", "chr1_x_alt", "scaffold"]
    assert names(main + others + ["chr1"]) == set() and names(others) == set()
    assert names(main + others + ["chrx"]) == set(others) - {"scaffold"}


def test_restricted_strands_and_sam_rows(spark):
    rnd = random.Random(8)
    contig = "".join(rnd.choice("ACGT") for _ in range(3000))
    plus = contig[500:600].replace("C", "T")  # parent of the forward strand
    minus = plus.translate(str.maketrans("ACGT", "TGCA"))[::-1]  # and its complement, the daughter
    reads = spark.createDataFrame([(0, 1, "a", plus, "I" * 99 + "#", "UMI"), (1, 1, "b", minus, "I" * 99 + "#", None)], "rid long, mate int, qname string, seq string, qual string, RX string")
    genome = spark.createDataFrame([("c", contig)], "chrom string, seq string")
    hits = lambda **o: {(r.rid, r.parent, r.bss, r.pos1) for r in align.align(reads, genome, align.Options(**o)).collect()}
    assert hits() == {(0, 1, 0, 501), (1, 0, 0, 501)}
    assert hits(single=1) == {(0, 1, 0, 501)} and hits(single=0) == {(1, 0, 0, 501)}
    assert hits(strand=0) == hits() and hits(strand=1) == set()
    idx = align.index(genome)
    records = align.records(align.extend(reads, align.kept_chains(align.chains(seeds.seeded(reads, idx))), genome))
    lines = [r.value.split("\t") for r in sink.sam_lines(align.sam_rows(records, reads, "g1")).orderBy("value").collect()]
    assert [x[:6] for x in lines] == [["a", "0", "c", "501", "60", "100M"], ["b", "16", "c", "501", "60", "100M"]]
    assert all(x[9] == plus for x in lines) and [x[10][0] for x in lines] == ["I", "#"]
    assert {"XL:i:100", "YD:A:f", "RG:Z:g1", "NM:i:0", "AS:i:100", "RX:Z:UMI"} <= set(lines[0]) and not any(x.startswith("RX") for x in lines[1])


def test_planted_reads_align_where_they_came_from(spark):
    import random

    rnd = random.Random(3)
    contig = "".join(rnd.choice("ACGT") for _ in range(5000))
    comp = str.maketrans("ACGT", "TGCA")
    rows, want = [], {}
    for k in range(60):
        at = rnd.randrange(0, 4900)
        s = contig[at : at + 100]
        if k % 4 == 3:
            s = s[:50] + "ACT" + s[50:]
        if k % 2:  # the other strand's read
            s = s.translate(comp)[::-1]
        s = "".join("T" if c == "C" and rnd.random() < 0.9 else c for c in s)
        rows.append((k, 1, s))
        want[k] = (at + 1, k % 2)
    df = spark.createDataFrame(rows, "rid long, mate int, seq string")
    got = {r.rid: (r.pos1, r.reverse) for r in align.align(df, spark.createDataFrame([("c", contig)], "chrom string, seq string")).collect()}
    assert sum(got.get(k) == v for k, v in want.items()) >= 57


def test_frequent_seeds_are_kept(spark):
    import random

    rnd = random.Random(9)
    text = lambda n: "".join(rnd.choice("ACGT") for _ in range(n))
    passage, whole = text(60), text(120)
    contigs = [(f"p{k}", text(30) + passage + text(30)) for k in range(6)] + [(f"w{k}", whole) for k in range(7)] + [("z", text(200))]
    genome = spark.createDataFrame(contigs, "chrom string, seq string")
    reads = spark.createDataFrame([(0, 1, passage[:50].replace("C", "T")), (1, 1, whole[20:70].replace("C", "T")), (2, 1, contigs[-1][1][10:60].replace("C", "T"))], "rid long, mate int, seq string")
    o = align.Options(max_occ=4)
    idx = align.index(genome, o)
    got = {r.rid: (r.chrom, r.pos1, r.XS, r.mapq) for r in align.align(reads, genome, o).collect()}
    assert got[0] == ("p0", 31, 50, 0) and got[1] == ("w0", 21, 50, 0) and got[2][:2] == ("z", 11) and got[2][3] > 0
    plain, dealt = (sorted(map(tuple, align.seeds(reads, idx, o, hot).collect())) for hot in (None, align.frequent(idx, o)))
    assert plain == dealt and len(plain) == 14
    assert {tuple(r) for r in align.align(reads, genome, o, idx).collect()} == {tuple(r) for r in align.align(reads, genome, o).collect()}


def hit(rid, mate, pos1, score, cigar, reverse=0, chrom="c", nm=0):
    return (rid, mate, chrom, 1, reverse, pos1, score, cigar, nm, "", 0, 0, reverse)


def test_kept_hits_are_primary_and_supplementary(spark):
    rows = [hit(0, 1, 10, 90, "60M40S"), hit(0, 1, 500, 38, "60S40M"), hit(0, 1, 900, 80, "55M45S", nm=1), hit(0, 1, 700, 30, "65M35S", 1), hit(1, 1, 5, 100, "100M")]
    got = {(r.rid, r.pos1): r for r in align.records(spark.createDataFrame(rows, align.RESULT)).collect()}
    assert {k: r.flag for k, r in got.items()} == {(0, 10): 0, (0, 500): 2048, (1, 5): 0}
    assert got[0, 10].XA == "c,+900,55M45S,1;" and got[0, 10].XS == 80 and got[0, 500].XA is None
    assert got[0, 10].SA == "c,500,+,60S40M,0;" and got[0, 500].SA == "c,10,+,60M40S,0;" and got[1, 5].SA is None
    assert got[0, 500].mapq <= got[0, 10].mapq


def test_mates_are_rescued_and_paired(spark, tmp_path):
    import random

    rnd = random.Random(5)
    contig = "".join(rnd.choice("ACGT") for _ in range(4000))
    comp = str.maketrans("ACGT", "TGCA")
    rows = []
    for k in range(6):
        at = 200 + 500 * k
        one_, two = contig[at : at + 80], contig[at + 170 : at + 250]
        if k % 2:  # a change in every 12 bases leaves no seed
            two = "".join({"A": "C", "C": "A", "G": "T", "T": "G"}[c] if 9 < j < 70 and j % 12 == 6 else c for j, c in enumerate(two))
        one_, two = one_.replace("C", "T"), two.replace("C", "T").translate(comp)[::-1]
        rows += [(k, 1, one_), (k, 2, two)]
    df = spark.createDataFrame(rows, "rid long, mate int, seq string")
    genome = spark.createDataFrame([("c", contig)], "chrom string, seq string")
    align.write_index(genome, str(tmp_path / "idx"))
    idx = align.read_index(spark, str(tmp_path / "idx"))
    o = align.Options(min_score=20)
    found = align.extend(df, align.kept_chains(align.chains(seeds.seeded(df, idx, o), o), o), genome, o).persist()
    assert {(r.rid, r.mate) for r in found.collect() if r.mate == 2} == {(k, 2) for k in (0, 2, 4)}
    got = {(r.rid, r.mate): r for r in align.pair_up(df, found, genome, (150, 400, 250.0, 20.0), o).collect()}
    assert len(got) == 12
    for k in range(6):
        a, b = got[k, 1], got[k, 2]
        assert a.pos1 == 201 + 500 * k and (a.flag, b.flag) == (99, 147) and (a.isize, b.isize) == (250, -250)
        assert a.mpos1 == b.pos1 and a.MC == b.cigar and b.bss == a.bss
    lone = align.pair_up(df.where("mate = 1 or rid <> 1"), found.where("rid = 1"), genome, (150, 400, 250.0, 20.0), o).collect()
    assert [(r.rid, r.mate, r.flag & 11) for r in lone] == [(1, 1, 9)]


def test_pileup_is_additive(spark, genome):
    from cytolake.streaming.pileup import merge

    o = pileup.Options(LOOSE)
    a, b = reads(spark, dict(), dict(pos1=5)), reads(spark, dict(pos1=2, rid=9))
    whole = pileup.counts(pileup.site_bases(a.unionByName(b), genome, o))
    parts = merge(pileup.counts(pileup.site_bases(a, genome, o)), pileup.counts(pileup.site_bases(b, genome, o)))
    assert {tuple(r) for r in whole.select(sorted(whole.columns)).collect()} == {tuple(r) for r in parts.select(sorted(parts.columns)).collect()}


def test_view_packs_lines(spark, genome):
    got = view.rows(reads(spark, dict(pos1=1), dict(pos1=3), dict(pos1=6)), genome, "c1", 1, 20).select("rid", "line").distinct().collect()
    assert {r.rid: r.line for r in got} == {0: 0, 1: 1, 2: 0}


def test_empty_inputs(spark, genome):
    none = reads(spark, dict()).where("false")
    assert pileup.calls(pileup.counts(pileup.site_bases(none, genome))).count() == 0
    assert epiread.epibed(epiread.states(none, genome, None)).count() == 0
    assert readqc.conversion_counts(none, genome).count() == 0


def plain_local(ref, read, m, o):
    """Score of the best local alignment, cell by cell."""
    low, first, more = -(10**9), o.gap_open + o.gap_extend, o.gap_extend
    h = [[0] * (len(ref) + 1) for _ in range(len(read) + 1)]
    e = [[low] * (len(ref) + 1) for _ in range(len(read) + 1)]
    f = [[low] * (len(ref) + 1) for _ in range(len(read) + 1)]
    for i in range(1, len(read) + 1):
        for j in range(1, len(ref) + 1):
            e[i][j] = max(h[i - 1][j] - first, e[i - 1][j] - more)
            f[i][j] = max(h[i][j - 1] - first, f[i][j - 1] - more)
            h[i][j] = max(0, h[i - 1][j - 1] + m[ref[j - 1], read[i - 1]], e[i][j], f[i][j])
    return max(map(max, h))


@pytest.mark.parametrize("gaps", [align.Options(), align.Options(mismatch=1, gap_open=1, gap_extend=1)])
def test_banded_alignment_is_the_local_one(gaps):
    rnd = random.Random(3)
    code = {b: k for k, b in enumerate("ACGTN")}
    for _ in range(60):
        read = "".join(rnd.choice("ACGT") for _ in range(rnd.randint(20, 60)))
        body = list(read)
        for _ in range(rnd.randint(0, 4)):
            k = rnd.randrange(len(body))
            body[k : k + rnd.choice([0, 1, 2])] = rnd.choices("ACGT", k=rnd.choice([0, 1, 3]))
        ref = "".join(rnd.choices("ACGT", k=16)) + "".join(body) + "".join(rnd.choices("ACGT", k=16))
        m, a, b = align.scores(True, gaps), np.array([code[x] for x in ref]), np.array([code[x] for x in read])
        want = plain_local(a, b, m, gaps)
        for width in (None, len(ref)):
            score, j, i, end, pieces = align.banded(a, b, m, gaps, width)
            assert score == (want if width is None else score) and score <= want
            at_i, at_j, total = i, j, 0
            for op, n in pieces:
                if op == "M":
                    total += sum(int(m[a[at_j + k], b[at_i + k]]) for k in range(n))
                    at_i, at_j = at_i + n, at_j + n
                else:
                    total -= gaps.gap_open + n * gaps.gap_extend
                    at_i, at_j = at_i + n * (op == "I"), at_j + n * (op == "D")
            assert total == score and at_i == end


def test_erfc(spark):
    from cytolake.functions import stats

    xs = [0.0, 0.1, 0.5, 1.0, 2.0, 4.0, 6.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", stats.erfc(F.col("x")).alias("y")).collect()
    assert all(r.y == pytest.approx(math.erfc(r.x), rel=2e-7) for r in got)


def test_chains_and_their_filter(spark):
    o = align.Options(k=10, band=5)
    rows = [
        (1, 1, 1, 0, "a", 100, 3, [0, 5, 20], [100, 105, 120]), (1, 1, 1, 0, "a", 103, 1, [40], [143]),  # one chain of two diagonals
        (1, 1, 1, 0, "b", 7, 2, [0, 5], [7, 12]),  # in the first one's place, much lighter: first shadowed, stays
        (1, 1, 1, 0, "c", 9, 1, [10], [19]),  # likewise, but not the first: goes
        (1, 1, 1, 0, "d", 9, 2, [60, 65], [69, 74]),  # elsewhere in the read
    ]
    found = spark.createDataFrame(rows, "rid long, mate int, parent int, reverse int, chrom string, diag0 int, n long, at array<int>, on array<int>")
    got = {r.chrom: (r.diag0, r.weight, r.qb, r.qe) for r in align.chains(found, o).collect()}
    assert got == {"a": (100, 35, 0, 50), "b": (7, 15, 0, 15), "c": (9, 10, 10, 20), "d": (9, 15, 60, 75)}
    assert {r.chrom for r in align.kept_chains(align.chains(found, o), o).collect()} == {"a", "b", "d"}


def test_seeds_against_the_original_bases(spark):
    """A read with a C where the reference has a T cannot be that place's parent strand; a T for a C can."""
    rnd = random.Random(8)
    text = "".join(rnd.choices("ACGT", k=200))
    k = text.index("T", 60)
    read, turned = text[40:90], text[40:90].replace("C", "T")
    wrong = read[: k - 40] + "C" + read[k - 39 :]
    genome = spark.createDataFrame([("c", text)], "chrom string, seq string")
    reads = spark.createDataFrame([(1, 1, read), (2, 1, turned), (3, 1, wrong)], "rid long, mate int, seq string")
    o = align.Options(stride=1)
    idx = align.index(genome, o)
    own = {r.rid: (r.n, r.at) for r in align.seeds(reads, idx, o, veto=True).where("parent = 1 and reverse = 0 and diag0 = 40").collect()}
    every = list(range(32))
    assert own[1] == (32, every) and own[2] == (32, every)
    assert own[3][1] == [i for i in every if not i <= k - 40 < i + 19]


def test_reads_longer_than_a_block(spark):
    rnd = random.Random(4)
    text = "".join(rnd.choices("ACGT", k=12_000))
    reads = spark.createDataFrame([(1, 1, text[3000:6000]), (2, 1, text[500:5600])], "rid long, mate int, seq string")
    got = {r.rid: (r.pos1, r.cigar) for r in align.align(reads, spark.createDataFrame([("c", text)], "chrom string, seq string"), align.Options(band=4)).collect()}
    assert got == {1: (3001, "3000M"), 2: (501, "5100M")}


def test_spans_beyond_the_limit_are_an_error(spark):
    genome = spark.createDataFrame([("c", "ACGT" * 3000)], "chrom string, seq string")
    read = spark.createDataFrame([("c", 1, "9100M", "A" * 9100)], "chrom string, pos1 int, cigar string, seq string")
    with pytest.raises(Exception, match="more than max_span"):
        bases.with_slice(read, genome).collect()
    assert len(bases.with_slice(read, genome, max_span=10_000).first().slice) == 9104


def test_more_than_five_equal_places(spark):
    """Seven places equal after conversion: the one that the read's own bases fit is found, whatever its contig is called."""
    rnd = random.Random(6)
    core = "".join(rnd.choices("AGT", k=60))
    at = core.index("T", 25)
    contigs = []
    for k in range(7):
        side = ["".join(rnd.choices("ACGT", k=80)) for _ in range(2)]
        contigs.append((f"c{k}", side[0] + (core if k < 6 else core[:at] + "C" + core[at + 1 :]) + side[1]))
    reads = spark.createDataFrame([(1, 1, core[:at] + "C" + core[at + 1 :])], "rid long, mate int, seq string")
    got = align.align(reads, spark.createDataFrame(contigs, "chrom string, seq string"), align.Options(directional=True)).first()
    assert got.chrom == "c6" and got.pos1 == 81


def test_lone_reads_of_a_longer_file(spark):
    from cytolake.operators import fastq

    one = spark.createDataFrame([(k, f"r{k}/1", "AC", "II") for k in range(3)], "ord long, name string, seq string, qual string")
    two = spark.createDataFrame([(k, f"r{k}/2" if k else "x/2", "GT", "II") for k in range(2)], "ord long, name string, seq string, qual string")
    got = {r.ord: (r.mismatch, r.alone, r.seq2) for r in fastq.mate_join(one, two).collect()}
    assert got == {0: (True, None, "GT"), 1: (False, None, "GT"), 2: (None, 1, None)}


def test_columns_of_a_read_stay_in_its_row(spark):
    """No row per base is made that a fold would have to sort and spill."""
    genome = spark.createDataFrame(GENOME, "chrom string, seq string")
    read = (0, 7, "q", 0, "c1", 2, 60, "3S6M", 2, 0, "AAACGTTCG", "I" * 9, 0, 60, None, "f", None, None)
    snps = spark.createDataFrame([("c1", 4, "T", "G", 0.5), ("c1", 9, "C", "A", 0.5)], "chrom string, pos1 int, ref string, alt string, af double")
    rows = epiread.states(spark.createDataFrame([read], READ), genome, snps, epiread.Options(LOOSE))
    got = rows.collect()
    assert len(got) == 1 and [v.col for v in got[0].x] == list(range(1, 10)) and [v.snp_at for v in got[0].x if v.snp_at] == [4]
    for bed in (epiread.epibed(rows), epiread.legacy(rows), epiread.pairwise(rows)):
        assert "collect_list" not in bed._jdf.queryExecution().optimizedPlan().toString()

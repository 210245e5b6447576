"""Reads of several samples that are numbered alike, reads that the genome has no place for, and the readers of small tables."""

import gzip
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cytolake.operators import bases, epiread, pileup, readqc, view
from cytolake.sinks import text as sinks
from cytolake.sources import text


@pytest.fixture(scope="module")
def reference(spark):
    rnd = random.Random(4)
    return spark.createDataFrame([(c, "".join(rnd.choice("ACGT") for _ in range(n))) for c, n in (("c1", 900), ("c2", 300))], "chrom string, seq string")


def sam_file(path, reference, seed, n=40):
    rnd = random.Random(seed)
    seqs = {r.chrom: r.seq for r in reference.collect()}
    lines = ["@HD\tVN:1.6"]
    for k in range(n):
        chrom = rnd.choice(["c1", "c2"])
        at = rnd.randrange(len(seqs[chrom]) - 40)
        seq = "".join("T" if b == "C" and rnd.random() < 0.6 else b for b in seqs[chrom][at : at + 40])
        lines.append(f"q{k}\t{99 if k % 2 else 147}\t{chrom}\t{at + 1}\t60\t40M\t=\t{at + 1}\t0\t{seq}\t{'I' * 40}\tNM:i:0\tAS:i:40\tMC:Z:40M\tYD:A:f")
    path.write_text("\n".join(lines) + "\n")
    return str(path)


@pytest.fixture(scope="module")
def samples(spark, reference, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sams")
    paths = [sam_file(folder / f"{k}.sam", reference, k) for k in (1, 2)]
    return [text.sam(spark, p, sid=k) for k, p in enumerate(paths)], paths


def rows(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


def test_ids_of_two_scans_differ(spark, samples):
    one, two = samples[0]
    both = one.unionByName(two)
    assert both.select("rid").distinct().count() == both.count() == 80
    lanes = text.sam(spark, samples[1], sid=3)  # two files of one sample in one scan
    assert lanes.select("rid").distinct().count() == 80
    again = one.unionByName(text.sam(spark, samples[1][1], sid=0, scan=7))
    assert again.select("rid").distinct().count() == 80 and again.select("sid").distinct().count() == 1
    with pytest.raises(ValueError, match="1022"):
        text.sam(spark, samples[1][0], scan=1023)


def test_two_samples_are_the_sum_of_the_single_ones(spark, reference, samples):
    # tables that number their reads alike, as a user may have them
    one, two = (s.withColumn("rid", F.col("rid").bitwiseAND((1 << 53) - 1)).cache() for s in samples[0])
    both = one.unionByName(two)
    snps = spark.createDataFrame([("c1", p, "A", "G", 0.4) for p in range(1, 900, 7)], "chrom string, pos1 int, ref string, alt string, af double")
    limit = pileup.Options(bases.Filters(max_retention=8))
    for f in (
        lambda a: pileup.counts(pileup.site_bases(a, reference)),
        lambda a: pileup.counts(pileup.site_bases(a, reference, limit)),
        lambda a: pileup.read_retention(pileup.site_bases(a, reference)),
        lambda a: readqc.conversion_counts(a, reference),
        lambda a: readqc.conversion_filter(a, reference, readqc.Conversion(max_cph=4)).select("sid", "rid", "ZN"),
        lambda a: readqc.cytosines(a, reference),
        lambda a: epiread.epibed(epiread.states(a, reference, snps)),
        lambda a: epiread.legacy(epiread.states(a, reference, snps)),
        lambda a: epiread.pairwise(epiread.states(a, reference, snps)),
        lambda a: epiread.paired(epiread.epibed(epiread.states(a, reference, None))),
        lambda a: bases.inferred_counts(bases.aligned(bases.with_slice(a, reference), ("rid",))),
    ):
        want = sorted(rows(f(one)) + rows(f(two)))
        assert want and rows(f(both)) == want
    assert view.rows(both, reference, "c1", 1, 300).groupBy("sid", "rid").agg(F.countDistinct("line").alias("n")).where("n > 1").count() == 0
    assert view.rows(both, reference, "c1", 1, 300).select("sid").distinct().count() == 2


def test_a_read_that_the_genome_lacks_is_an_error(spark, reference, samples):
    good = samples[0][0]
    for chrom, pos1, only in (("c9", 5, 4), ("c2", 5000, 1)):
        bad = good.withColumns({"chrom": F.when(F.col("qname") == "q3", chrom).otherwise(F.col("chrom")), "pos1": F.when(F.col("qname") == "q3", pos1).otherwise(F.col("pos1"))})
        for f in (lambda a: pileup.counts(pileup.site_bases(a, reference)), lambda a: readqc.conversion_counts(a, reference), lambda a: readqc.conversion_summary(a, reference), lambda a: epiread.epibed(epiread.states(a, reference, None)))[:only]:
            with pytest.raises(PySparkException, match="which the genome does not have"):
                f(bad).collect()
    # filtered and unmapped reads need no place
    unmapped = good.withColumns({"flag": F.when(F.col("qname") == "q3", 4).otherwise(F.col("flag")), "chrom": F.when(F.col("qname") == "q3", "*").otherwise(F.col("chrom"))})
    assert readqc.conversion_summary(unmapped, reference).first().n_processed == 40


def test_small_tables(spark, tmp_path):
    (tmp_path / "snp.bed").write_text("c1\t9\t10\tC\tT\t0/1\t3\t4\t0.25\nc1\t9\t10\tC\tT\n\nc2\t0\t1\tG\tA\t1/1\t.\t.\t.\n")
    assert [tuple(r) for r in text.snp_bed(spark, str(tmp_path / "snp.bed")).collect()] == [("c1", 10, "C", "T", "0/1", "3", 4, 0.25), ("c2", 1, "G", "A", "1/1", ".", None, None)]
    (tmp_path / "pairs.tsv").write_text("c1\t10\t12\tA\tC\nc2\t3\t4\tG\tT\n")
    assert [tuple(r) for r in text.pairwise_tsv(spark, str(tmp_path / "pairs.tsv")).collect()] == [("c1", 10, 12, "A", "C"), ("c2", 3, 4, "G", "T")]
    (tmp_path / "old.tsv").write_text("c1\tq\t1\t+\t4,8\tCT\t.\t.\n")
    assert [tuple(r) for r in text.epiread_tsv(spark, str(tmp_path / "old.tsv")).collect()] == [("c1", "q", "1", "+", "4,8", "CT", ".", ".")]
    assert [tuple(r) for r in text.literal_reads(spark, "ACG", "TT").collect()] == [(0, 1, "inputread", "ACG", "III"), (0, 2, "inputread", "TT", "II")]
    assert text.literal_reads(spark, "ACG").count() == 1


def test_fastq_gz_round_trip(spark, tmp_path):
    rnd = random.Random(9)
    reads = [(k, f"r{k}", "", "".join(rnd.choice("ACGTN") for _ in range(20)), "".join(chr(33 + rnd.randrange(40)) for _ in range(20))) for k in range(50)]
    df = spark.createDataFrame(reads, "ord long, name string, comment string, seq1 string, qual1 string")
    path = str(tmp_path / "out")
    sinks.write(sinks.fastq_lines(df), path, ("ord",), "gzip")
    assert all(p.read_bytes()[:2] == b"\x1f\x8b" for p in (tmp_path / "out").glob("part-*"))
    assert b"".join(gzip.open(p).read() for p in (tmp_path / "out").glob("part-*")).count(b"\n") == 200
    back = text.fastq(spark, path)
    assert sorted((r.name, r.seq, r.qual) for r in back.collect()) == sorted((r[1], r[3], r[4]) for r in reads)

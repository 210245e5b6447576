"""Text formats there and back."""

from cytolake.operators import pileup
from cytolake.sinks import text as sink
from cytolake.sources import fixtures as fx
from cytolake.sources import text

SF = "/root/testdata/sf0.001"


def test_fasta(spark, tmp_path):
    (tmp_path / "g.fa").write_text(">c1 first\nACGT\nac\n>c2\nNNA\n")
    assert {tuple(r) for r in text.fasta(spark, str(tmp_path / "g.fa")).collect()} == {("c1", "ACGTAC"), ("c2", "NNA")}


def test_fastq(spark, tmp_path):
    (tmp_path / "r.fq").write_text("@a/1 x y\nACGT\n+\nIIII\n@b\nAC\n+\n@@\n")
    got = [tuple(r) for r in text.fastq(spark, str(tmp_path / "r.fq")).orderBy("ord").collect()]
    assert got == [(0, "a", "x y", "ACGT", "IIII"), (1, "b", "", "AC", "@@")]


def test_sam_round_trip(spark, tmp_path):
    aln = fx.alignments(spark, SF).limit(50)
    sink.write(sink.sam_lines(aln), str(tmp_path / "s"), ("chrom", "pos1"))
    back = text.sam(spark, str(tmp_path / "s"))
    cols = ["qname", "flag", "chrom", "pos1", "mapq", "cigar", "mpos1", "isize", "seq", "qual", "NM", "AS", "MC", "YD", "ZS", "XG"]
    assert sorted(map(repr, back.select(cols).collect())) == sorted(map(repr, aln.select(cols).collect()))


def test_region(spark):
    assert text.parse_region("chr1:1,000-2000") == ("chr1", 1000, 2000)
    assert text.parse_region("chr1") == ("chr1", None, None)
    aln = fx.alignments(spark, SF)
    got = text.in_region(aln, "chr1", 100, 200)
    assert got.where("pos1 > 200").count() == 0


def test_vcf_round_trip(spark, tmp_path):
    called = pileup.calls(pileup.counts(pileup.site_bases(fx.alignments(spark, SF), fx.genome(spark, SF))))
    head = sink.vcf_header([("chr1", 10)], ["t", "n"])
    lines = [r.value for r in sink.vcf_lines(called, 2).orderBy("chrom", "pos1").collect()]
    (tmp_path / "x.vcf").write_text("\n".join([*head, *lines]) + "\n")
    back = text.vcf(spark, str(tmp_path / "x.vcf"))
    got = {(r.chrom, r.pos1, r.sample): r.fmt.get("CV") for r in back.collect()}
    want = {(r.chrom, r.pos1, "tn"[r.sid]): str(r.cov) for r in called.where("callable").collect()}
    assert want and all(got[k] == v for k, v in want.items())


def test_meth_bed(spark, tmp_path):
    (tmp_path / "m.bed").write_text("c\t1\t2\t0.5\t4\t.\t0\nc\t5\t6\tC\tCG\tCG\tAACGA\t1.000\t3\n")
    got = sorted(((r.beg0, r.sid, r.beta, r.cov, r.cx) for r in text.meth_bed(spark, str(tmp_path / "m.bed")).collect()), key=str)
    assert got == [(1, 0, 0.5, 4, None), (1, 1, None, 0, None), (5, 0, 1.0, 3, "CG")]


def test_meth_bed_lines(spark):
    bed = spark.createDataFrame([("c", 1, 2, 0, 0.5, 4), ("c", 1, 2, 1, None, 0)], "chrom string, beg0 int, end int, sid int, beta double, cov int")
    for k in ("ref", "cx", "ctx2", "n5"):
        from pyspark.sql import functions as F

        bed = bed.withColumn(k, F.lit("C"))
    assert sink.meth_bed_lines(bed, [0, 1]).first().value == "c\t1\t2\t0.500\t4\t.\t0"
    assert sink.meth_bed_lines(bed, [0, 1], context=True, counts=True).first().value == "c\t1\t2\tC\tC\tC\tC\t50\t2\t2\t.\t0\t0"


def test_average_lines(spark):
    called = spark.createDataFrame([(0, "c", "HCG", True, 0.5), (0, "c", "GCH", True, 1.0), (0, "c", "GCH", True, 0.0), (0, "c", "GCG", True, 0.5)], "sid int, chrom string, cx string, callable boolean, beta double")
    rows = pileup.average_methylation(called, nome=True)
    got = [r.value for r in sink.average_lines(rows, ["s"], nome=True).orderBy("sid", "whole", "chrom").collect()]
    assert got == [f"s\t{c}\t1\t50.000%\t0\tnan%\t0\tnan%\t0\tnan%\t3\t50.000%" for c in ("c", "WholeGenome")]


def test_reports(spark):
    lines = lambda d: [r.value for r in d.orderBy("k").collect()]
    mapq = spark.createDataFrame([("10", 2), ("unmapped", 1), ("9", 4)], "mapq string, n long")
    assert lines(sink.mapq_report(mapq))[1:] == ["MapQ\tCount", "unmapped\t1", "9\t4", "10\t2"]
    tags = spark.createDataFrame([(1, False, "f", 3), (2, True, "r", 5), (2, True, "u", 9)], "mate int, reverse boolean, tag string, n long")
    assert lines(sink.strand_lines(tags))[2:] == ["R1 (f)\t3\t0", "R1 (r)\t0\t0", "R2 (f)\t0\t0", "R2 (r)\t0\t5"]
    assert lines(sink.duplicate_lines(spark.createDataFrame([(9, 2, 7, 1)], "n long, n_dup long, n_q40 long, n_q40_dup long")))[1:] == ["Number of duplicate reads:\t2", "Number of reads:\t9", "Number of duplicate q40-reads:\t1", "Number of q40-reads:\t7"]
    got = sink.quality_reports(fx.alignments(spark, SF), fx.genome(spark, SF))
    assert len(got) == 7 and all(set(d.columns) == {"k", "value"} for d in got.values())
    assert lines(got["_isize_table.txt"])[1] == "InsertSize\tFraction\tReadCount"


def test_read_level_lines(spark):
    row = spark.createDataFrame([(1, "c", "q", "1", "+", "7,9", "CT", ".", ".")], "rid long, chrom string, qname string, mate string, strand string, cg_pos0 string, cg string, snp_pos0 string, snp string")
    assert sink.epiread_lines(row).first().value == "c\tq\t1\t+\t7,9\tCT\t.\t."
    pair = spark.createDataFrame([(1, "c", 3, 7, "A", "C")], "rid long, chrom string, snp1 long, cg1 long, snp_base string, cg_call string")
    assert sink.pairwise_lines(pair).first().value == "c\t3\t7\tA\tC"


def test_printf_rounding(spark):
    df = spark.createDataFrame([(0.8125,), (0.125,), (2.675,)], "x double")
    assert [r.a for r in df.select(sink.fixed(df.x, 3).alias("a")).collect()] == ["0.812", "0.125", "2.675"]
    assert [r.a for r in df.select(sink.fixed(df.x, 2).alias("a")).collect()] == ["0.81", "0.12", "2.67"]


def test_stream_counts_once(spark, tmp_path):
    from cytolake.streaming import pileup as sp

    aln, genome = fx.alignments(spark, SF), fx.genome(spark, SF)
    aln.repartition(3).write.parquet(str(tmp_path / "in"))
    q = sp.start(sp.read_stream(spark, str(tmp_path / "in"), aln.schema, 1), genome, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    whole = pileup.counts(pileup.site_bases(aln, genome))
    got = sp.current(spark, str(tmp_path / "out"))
    cols = sorted(whole.columns)
    assert {tuple(r) for r in got.select(cols).collect()} == {tuple(r) for r in whole.select(cols).collect()}

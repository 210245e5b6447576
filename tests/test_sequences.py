"""FASTQ and FASTA by splits: any split size gives the same rows."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from cytolake.operators import bases, pileup
from cytolake.sources import fixtures as fx
from cytolake.sources import genome as gn
from cytolake.sources import sequences

SF = "/root/testdata/sf0.001"


def fastq_rows(rnd, n):
    out = []
    for k in range(n):
        size = rnd.choice([0, 1, 3, 40, 150])
        qual = "".join(rnd.choice("@+!IA") for _ in range(size))  # qualities that look like headers and separators
        out.append((f"r{k}", "1:N:0" if k % 3 else "", "".join(rnd.choice("ACGTN") for _ in range(size)), qual))
    return out


def fastq_text(rows, end="\n"):
    return "".join(f"@{n}{' ' + c if c else ''}{end}{s}{end}+{n if k % 2 else ''}{end}{q}{end}" for k, (n, c, s, q) in enumerate(rows))


def got(df):
    return [(r.ord, r.name, r.comment, r.seq, r.qual) for r in df.orderBy("ord").collect()]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_fastq_any_split(spark, tmp_path, end):
    rows = fastq_rows(random.Random(3), 60)
    path = tmp_path / "r.fq"
    path.write_text(fastq_text(rows, end), newline="")
    want = [(k, *r) for k, r in enumerate(rows)]
    size = path.stat().st_size
    for split in (61, 200, 1024, size, size + 1):
        assert got(sequences.fastq(spark, str(path), split=split)) == want, split


def test_fastq_every_cut():
    """Without Spark: each place as the border of two splits."""
    import tempfile

    rows = fastq_rows(random.Random(5), 12)
    with tempfile.NamedTemporaryFile("w", suffix=".fq") as f:
        f.write(fastq_text(rows))
        f.flush()
        size = len(fastq_text(rows))
        for cut in range(1, size):
            found = []
            for k, (a, b) in enumerate(((0, cut), (cut, size))):
                for lines in sequences.records(sequences.Part(f.name, 0, k, a, b, None)):
                    found += [x.decode() for x in lines[1::4]]
            assert found == [r[2] for r in rows], cut


def test_fastq_folders_compression_and_ends(spark, tmp_path):
    rows = fastq_rows(random.Random(7), 30)
    folder = tmp_path / "d"
    folder.mkdir()
    (folder / "_SUCCESS").write_text("")
    (folder / "a.fq.gz").write_bytes(gzip.compress(fastq_text(rows[:7]).encode()) + gzip.compress(fastq_text(rows[7:10]).encode()))  # two members
    (folder / "b.fq").write_text(fastq_text(rows[10:]) + "\n\n\n\n\n")
    (folder / "c.fq").write_text("")
    assert got(sequences.fastq(spark, str(folder), split=300)) == [(k, *r) for k, r in enumerate(rows)]
    (tmp_path / "e.fq").write_text("@a\nAC\n+\nII")
    assert got(sequences.fastq(spark, str(tmp_path / "e.fq"))) == [(0, "a", "", "AC", "II")]
    (tmp_path / "none.fq").write_text("")
    assert got(sequences.fastq(spark, str(tmp_path / "none.fq"))) == []


@pytest.mark.parametrize("bad", ["@a\nAC\n+\nI\n", "@a\nAC\n+\n", "a\nAC\n+\nII\n", "@a\nAC\nII\n+\n"])
def test_fastq_damage_is_an_error(spark, tmp_path, bad):
    (tmp_path / "x.fq").write_text(bad)
    with pytest.raises(Exception, match="record"):
        sequences.fastq(spark, str(tmp_path / "x.fq")).collect()


def test_fastq_shuffles_no_text(spark, tmp_path):
    (tmp_path / "r.fq").write_text(fastq_text(fastq_rows(random.Random(9), 20)))
    plan = sequences.fastq(spark, str(tmp_path / "r.fq"), split=256)._jdf.queryExecution().executedPlan().toString()
    for line in plan.split("\n"):
        if "Exchange" in line and "Broadcast" not in line:
            assert "seq" not in line and "head" not in line


def contigs(rnd):
    return [(f"c{k}", "".join(rnd.choice("ACGTN") for _ in range(n))) for k, n in enumerate([0, 1, 7, 64, 65, 500, 3, 1000, 128])]


def fasta_text(rows, width, end="\n"):
    body = lambda s: "".join(s[k : k + width].lower() + end for k in range(0, len(s), width))
    return "".join(f">{c} a > b{end}{body(s)}" for c, s in rows)


def pieces_of(rows, piece, flank):
    return sorted((c, k + 1, s[max(0, k - flank) : k], s[k : k + piece], s[k + piece : k + piece + flank]) for c, s in rows for k in range(0, len(s), piece))


@pytest.mark.parametrize("width,end", [(60, "\n"), (7, "\r\n"), (5000, "\n")])
def test_fasta_any_split(spark, tmp_path, width, end):
    rows = contigs(random.Random(11))
    path = tmp_path / "g.fa"
    path.write_text(fasta_text(rows, width, end), newline="")
    for split in (37, 400, 1 << 20):
        found = sorted(map(tuple, sequences.fasta(spark, str(path), split=split, piece=64, flank=20).collect()))
        assert found == pieces_of(rows, 64, 20), split


def test_fasta_places_inside_headers(spark, tmp_path):
    rows = [("c" * 90, "ACGT" * 30), ("d" * 300, "GGC" * 50), ("e", "")]
    (tmp_path / "g.fa").write_text("junk\nAC\n" + fasta_text(rows, 11))
    for split in (16, 50, 129):
        assert sorted(map(tuple, sequences.fasta(spark, str(tmp_path / "g.fa"), split=split, piece=32, flank=32).collect())) == pieces_of(rows, 32, 32), split


def test_fasta_compressed_and_folders(spark, tmp_path):
    rows = contigs(random.Random(13))
    folder = tmp_path / "d"
    folder.mkdir()
    (folder / "a.fa.gz").write_bytes(gzip.compress(fasta_text(rows[:6], 60).encode()))
    (folder / "b.fa").write_text(fasta_text(rows[6:], 60))
    assert sorted(map(tuple, sequences.fasta(spark, str(folder), split=100, piece=64, flank=64).collect())) == pieces_of(rows, 64, 64)


def test_blocks_of_pieces(spark, tmp_path):
    rows = contigs(random.Random(15))
    (tmp_path / "g.fa").write_text(fasta_text(rows, 60))
    whole = spark.createDataFrame(rows, "chrom string, seq string")
    cut = sequences.fasta(spark, str(tmp_path / "g.fa"), split=333, piece=128, flank=40)
    plain = lambda df: sorted(map(tuple, df.collect()))
    for size, flank, beyond in ((64, 40, "N"), (128, 2, "$"), (32, 32, "N")):
        assert plain(gn.blocks(cut, size, flank, beyond)) == plain(gn.blocks(whole, size, flank, beyond))
    assert plain(gn.cpg_sites(cut, 64)) == plain(gn.cpg_sites(whole, 64))
    assert plain(gn.lengths(cut)) == plain(gn.lengths(whole.where("seq <> ''")))
    assert plain(gn.positions(cut)) == plain(gn.positions(whole))
    with pytest.raises(Exception, match="begin with a block"):
        gn.blocks(cut, 100, 10).collect()
    with pytest.raises(Exception, match="flanks of less"):
        gn.blocks(cut, 128, 50).collect()


def test_pileup_from_fasta(spark, tmp_path):
    genome = fx.genome(spark, SF)
    rows = [(r.chrom, r.seq) for r in genome.select("chrom", "seq").collect()]
    (tmp_path / "g.fa").write_text(fasta_text(rows, 60))
    pieces = sequences.fasta(spark, str(tmp_path / "g.fa"), split=5000, piece=1 << 14, flank=1 << 12)
    o = pileup.Options(bases.Filters())
    told = lambda g: sorted(map(str, pileup.counts(pileup.site_bases(fx.alignments(spark, SF), g, o)).select("chrom", "pos1", "sid", "n_ret", "n_conv").collect()))
    want = told(genome)
    assert want and told(pieces) == want
    assert gn.gc_windows(sequences.fasta(spark, str(tmp_path / "g.fa")), 100).exceptAll(gn.gc_windows(genome, 100)).count() == 0
    assert gn.gc_windows(sequences.fasta(spark, str(tmp_path / "g.fa")), 100).select(F.sum("gc")).first() == gn.gc_windows(genome, 100).select(F.sum("gc")).first()

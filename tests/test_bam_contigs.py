"""BAM of very many contigs: headers do not grow with all of them, and are read once a process."""

import pyarrow.fs as pafs

from cytolake.sources import bam


def test_files_name_their_own_contigs(spark, tmp_path):
    names = [f"c{k:04d}" for k in range(600)]
    rows = [(k, f"q{k}", 0, names[k * 7 % 600], 1 + k % 50, 60, "10M", names[k * 11 % 600] if k % 3 else "*", 5,  # a mate's place may be told without its contig
              "ACGTACGTAC", "IIIIIIIIII") for k in range(900)] + [(901, "u", 4, "*", 0, 0, "*", "*", 0, "ACG", "III")]
    reads = spark.createDataFrame(rows, "rid long, qname string, flag int, chrom string, pos1 int, mapq int, cigar string, mchrom string, mpos1 int, seq string, qual string").selectExpr("0 as sid", "*")
    table = spark.createDataFrame([(c, 100 + k) for k, c in enumerate(names)], "chrom string, n int")
    bam.write(reads.repartition(2), str(tmp_path), table)
    files = sorted(x.path for x in pafs.LocalFileSystem().get_file_info(pafs.FileSelector(str(tmp_path))) if x.path.endswith(".bam"))
    columns = ["qname", "flag", "chrom", "pos1", "mapq", "cigar", "mchrom", "mpos1", "seq", "qual"]
    for split in (1 << 26, 500):
        got = bam.read(spark, str(tmp_path), split=split).select(*columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, reads.select(*columns).collect()))
    lengths = dict(zip(names, range(100, 700), strict=True))
    for f in files:
        _, contigs, _, _ = bam.header(bam.File("file://" + f))
        assert contigs == sorted(contigs) and all(lengths[c] == n for c, n in contigs)
    one = bam.read(spark, str(tmp_path), region="c0007:1-60").select("qname").collect()
    assert {r.qname for r in one} == {f"q{k}" for k in range(900) if k * 7 % 600 == 7}


def test_header_is_read_once(spark, tmp_path, monkeypatch):
    reads = spark.createDataFrame([(f"q{k}", "c", 1 + k, "5M", "ACGTA", "IIIII") for k in range(4000)], "qname string, chrom string, pos1 int, cigar string, seq string, qual string")
    full = reads.selectExpr("0 as sid", "*", "0 as flag", "9 as mapq", "0 as mpos1")
    bam.write(full.coalesce(1), str(tmp_path), [("c", 9000)], in_order=False)
    reader = bam.BamReader({"path": "file://" + str(tmp_path), "split": "3000"})
    parts, calls = reader.partitions(), []
    original = bam.header
    monkeypatch.setattr(bam, "header", lambda f: calls.append(1) or original(f))
    assert len(parts) > 3
    assert sum(b.num_rows for p in parts for b in reader.read(p)) == 4000
    assert len(calls) == 1

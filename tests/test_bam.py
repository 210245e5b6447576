"""BAM: round trips, any split size, and regions by the index."""

import gzip
import random
import struct

import pytest

from cytolake.operators import bases, readqc
from cytolake.sources import bam, text

CONTIGS = [("c1", 200_000), ("c2", 90_000), ("c3", 500)]


@pytest.fixture(scope="module")
def reads(spark):
    rnd = random.Random(14)
    out = []
    for k in range(1500):
        chrom, n = rnd.choice(CONTIGS)
        n_bases = rnd.choice([30, 51, 100]) if k % 50 else 9000  # some records are longer than a block
        cigar = rnd.choice([f"{n_bases}M", f"5S{n_bases - 5}M", f"{n_bases - 10}M3I7M", f"10M4D{n_bases - 10}M", "10M2000N" + f"{n_bases - 10}M"])
        placed = k % 40 != 7
        seq, qual = "".join(rnd.choice("ACGTN") for _ in range(n_bases)), "".join(chr(33 + rnd.randrange(60)) for _ in range(n_bases))
        out.append((
            0, k, f"q{k // 2}", (0 if placed else 4) + 64, chrom if placed else "*", rnd.randrange(1, n + 1) if placed else 0, rnd.randrange(61), cigar if placed else "*", "c2" if k % 3 else "*", 17 if k % 3 else 0, rnd.randrange(-500, 500), seq if k % 97 else "*",
            "*" if k % 31 == 0 or k % 97 == 0 else qual, k % 5 if k % 4 else None, 90 if k % 2 else None, "30M" if k % 6 else None, "MD5" if k % 7 else None, "f" if k % 3 == 0 else None, "++" if k % 5 == 0 else None, None, "C+m,0,1;" if k % 9 == 0 else None, [1, 255] if k % 9 == 0 else None,
        ))
    return spark.createDataFrame(out, bam.SCHEMA).cache()


@pytest.fixture(scope="module")
def files(spark, reads, tmp_path_factory):
    one, many = (str(tmp_path_factory.mktemp(n)) for n in ("one", "many"))
    bam.write(reads.coalesce(1), one, CONTIGS, in_order=False)
    bam.write(reads, many, CONTIGS)
    return one, many


def rows(df):
    return sorted((tuple(map(str, r)) for r in df.drop("rid").collect()))


def test_round_trip(spark, reads, files):
    want = rows(reads)
    for path in files:
        got = bam.read(spark, path)
        assert rows(got) == want
        assert got.select("rid").distinct().count() == len(want)
    assert set(bam.read(spark, files[0]).dtypes) == set(text.sam(spark, files[0]).dtypes)
    assert {r.sid for r in bam.read(spark, files[0], sid=5).select("sid").distinct().collect()} == {5}


@pytest.mark.parametrize("split", [1 << 30, 200_000, 40_000, 7_001, 1_500])
def test_any_split_gives_the_same_rows(spark, files, split):
    key = lambda df: sorted((r.rid, r.qname, r.flag, r.seq) for r in df.collect())
    got = bam.read(spark, files[0], split=split)
    assert key(got) == key(bam.read(spark, files[0]))
    if split < 10_000:
        assert got.rdd.getNumPartitions() > 20


def test_regions_by_the_index(spark, reads, files):
    all_ = reads.collect()
    for region in ("c1:20000-21000", "c1:1-10", "c2", "c3:400-500", "c1:190000-300000", "c1:199999", "c9:1-5"):
        chrom, beg, end = text.parse_region(region)
        own = [r for r in all_ if r.chrom == chrom and r.pos1 <= (end or 1 << 31) and r.pos1 + max(1, bam.span_of(r.cigar)) > (beg or 1)]
        want = sorted(tuple(map(str, (r.sid, *r[2:]))) for r in own)
        for path in files:
            assert rows(bam.read(spark, path, region=region)) == want, (region, path)


def test_a_region_reads_in_proportion(spark, tmp_path):
    rnd = random.Random(2)
    n = 30_000
    seq = ["".join(rnd.choice("ACGT") for _ in range(100)) for _ in range(300)]
    rows_ = [(0, k, f"q{k}", 0, "c", 1 + k * 100, 60, "100M", "*", 0, 0, seq[rnd.randrange(300)], "".join(chr(40 + rnd.randrange(30)) for _ in range(100)), *[None] * 9) for k in range(n)]
    bam.write(spark.createDataFrame(rows_, bam.SCHEMA).coalesce(1), str(tmp_path), [("c", n * 100 + 100)], in_order=False)
    path = next(str(p) for p in tmp_path.glob("*.bam"))
    reader = bam.BamReader({"path": path, "region": "c:1500000-1510000"})
    parts = reader.partitions()
    size = (tmp_path / path).stat().st_size
    assert sum(p.end - p.start for p in parts) < 0.03 * size
    seen = []
    original = bam.File.read
    try:
        bam.File.read = lambda self, at, k: seen.append(k) or original(self, at, k)
        got = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    finally:
        bam.File.read = original
    assert [r["pos1"] for r in got] == [p for p in range(1, n * 100, 100) if p <= 1_510_000 and p + 99 >= 1_500_000]
    assert sum(seen) < 0.2 * size


def test_format_of_a_written_file(spark, reads, files):
    """Read by the letter of the format, without the reader."""
    import pathlib

    raw = gzip.decompress(next(pathlib.Path(files[0]).glob("*.bam")).read_bytes())
    assert raw[:4] == b"BAM\1"
    n = struct.unpack_from("<i", raw, 4)[0]
    assert raw[8 : 8 + n].decode().count("@SQ") == 3
    assert raw.count(b"c2\0") >= 1 and struct.unpack_from("<i", raw, 8 + n)[0] == 3
    at, count = 12 + n, 0
    for name, length in CONTIGS:
        k = struct.unpack_from("<i", raw, at)[0]
        assert raw[at + 4 : at + 3 + k].decode() == name and struct.unpack_from("<i", raw, at + 4 + k)[0] == length
        at += 8 + k
    while at < len(raw):
        at += 4 + struct.unpack_from("<i", raw, at)[0]
        count += 1
    assert at == len(raw) and count == 1500


def test_odd_files(spark, reads, tmp_path):
    bam.write(reads.where("false"), str(tmp_path / "none"), CONTIGS)
    assert bam.read(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="bases and 1 qualities"):
        bam.write(reads.limit(3).selectExpr("* except (seq, qual)", "'ACG' as seq", "'I' as qual"), str(tmp_path / "bad"), CONTIGS)
    assert not list((tmp_path / "bad").glob("*.bam"))
    (tmp_path / "x.bam").write_bytes(b"nothing of the kind")
    with pytest.raises(Exception, match="no block|not a BAM"):
        bam.read(spark, str(tmp_path / "x.bam")).count()


def test_reads_of_a_file_feed_the_operators(spark, reads, files):
    got = bam.read(spark, files[1])
    assert sorted(map(tuple, readqc.mapq_histogram(got).collect())) == sorted(map(tuple, readqc.mapq_histogram(reads).collect()))
    assert bases.keep_reads(got).count() == bases.keep_reads(reads).count()

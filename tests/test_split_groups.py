"""Small splits are read by few tasks, and split by split as before."""

from cytolake.sources import sequences as sq


def test_groups():
    part = lambda k, n, codec=None: sq.Part("f", k, 0, 0, n, codec)
    got = sq.grouped([part(k, 1 << 18) for k in range(10_000)])
    assert sq.TASKS <= len(got) <= sq.TASKS + 1 and [p.file for g in got for p in g.parts] == list(range(10_000))
    assert [len(g.parts) for g in sq.grouped([part(k, sq.SPLIT) for k in range(300)])] == [1] * 300
    assert [[p.file for p in g.parts] for g in sq.grouped([part(0, 1 << 62, "gzip"), part(1, 5), part(2, 1 << 62, "gzip")])] == [[0], [1], [2]]
    assert sq.grouped([]) == []


def test_few_tasks(spark, tmp_path):
    records = [(f"r{k}", "ACGT" * (k % 9), "@III" * (k % 9)) for k in range(9000)]
    (tmp_path / "a.fq").write_text("".join(f"@{n} x\n{s}\n+\n{q}\n" for n, s, q in records[:5000]))
    (tmp_path / "b.fq").write_text("".join(f"@{n} x\n{s}\n+\n{q}\n" for n, s, q in records[5000:]))
    got = sq.fastq(spark, str(tmp_path), split=500)
    assert len(sq.parts(f"file://{tmp_path}", 500)) > 5 * sq.TASKS and got.rdd.getNumPartitions() < 2 * sq.TASKS
    assert [(r.name, r.seq, r.qual) for r in sorted(got.collect(), key=lambda r: r.ord)] == records

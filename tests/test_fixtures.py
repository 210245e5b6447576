"""The derived reads by their plain definition, and without work per base."""

from cytolake.sources import fixtures as fx

SF = "/root/testdata/sf0.001"


def plain(e, tid, pos1, seq):
    span, bs, out = {2: 45, 3: 52, 4: 47}.get(e % 5, 50), e // 2 % 2, ""
    for i in range(span):
        b, p = seq[pos1 - 1 + i], pos1 + i
        if (tid * 31 + p) % 97 == 0 and (e + p) % 2 == 0:
            b = b.translate(str.maketrans("ACGT", "CGTA"))
        elif (e + p) % 3 and b == "CG"[bs]:
            b = "TA"[bs]
        out += b
    return {2: "ACGTA" + out, 3: out[:20] + out[22:], 4: out[:25] + "GTC" + out[25:]}.get(e % 5, out)


def test_reads_by_definition(spark):
    contigs = {r.chrom: (r.tid, r.seq) for r in fx.genome(spark, SF).collect()}
    rows = fx.alignments(spark, SF).select("rid", "chrom", "pos1", "seq", "qual").collect()
    assert len(rows) > 900
    for r in rows:
        assert r.seq == plain(r.rid, contigs[r.chrom][0], r.pos1, contigs[r.chrom][1])
        assert r.qual == "".join(chr(43 + (r.rid * 3 + i * 7) % 31) for i in range(1, 51))


def test_no_expression_a_base(spark):
    for derive in (fx.genome, fx.alignments):
        assert "lambdafunction" not in derive.__wrapped__(spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_snps_take_no_row_a_base(spark):
    """SNPs are found where they are: bases are neither joined with their contigs' numbers nor shuffled."""
    plan = fx.snps.__wrapped__(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan

"""CpGs meet runs of depth in bins of their own length's order, whatever borders cut."""

from cytolake.operators import coverage


def test_least_depth_in_short_bins(spark):
    runs = [("a", k, k + 1, k % 7) for k in range(300)] + [("a", 300, 9000, 2)]
    depth = [d for _, b, e, d in runs for _ in range(b, e)]
    at = [*range(0, 400, 3), 63, 127, 4095, 8998]
    got = coverage.least_depth(spark.createDataFrame([("a", b, b + 2) for b in sorted(set(at))], 'chrom string, beg0 int, end int'), spark.createDataFrame(runs, 'chrom string, beg0 int, end int, depth long'))
    assert {r.beg0: r.depth for r in got.collect()} == {b: min(depth[b : b + 2]) for b in at}
    assert "4096" not in got._jdf.queryExecution().optimizedPlan().toString()

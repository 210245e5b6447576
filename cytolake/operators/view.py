"""What a viewer of alignments shows, as rows: reads packed into lines, each base classed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import bases


def rows(aln: DataFrame, genome: DataFrame, chrom: str, beg1: int, end1: int, most: int = 50) -> DataFrame:
    """(line, [sid,] rid, rpos, qb, kind) of the reads over a region; at most ``most`` reads that start at one place (it is a view), lines filled first-fit by start.

    kind: retention, conversion, mismatch or match. First-fit over reads sorted by start equals giving each read the lowest line that is free again, and a region is
    a screen, so the reads are placed in one task."""
    from ..sources.text import in_region

    reads = bases.with_strand(bases.with_slice(in_region(aln.where(~bases.has(bases.UNMAPPED)), chrom, beg1, end1), genome))
    key = bases.key(aln)
    rank = F.row_number().over(W.partitionBy("pos1").orderBy(*key))
    reads = reads.withColumn("_k", rank).where(F.col("_k") <= most).drop("_k")
    order = F.array_sort(F.collect_list(F.struct("pos1", F.struct(*key).alias("read"), "span")))
    read = reads.select(F.struct(*key).alias("read")).schema["read"].dataType.simpleString()
    kind = f"struct<ends:array<int>,lines:array<struct<read:{read},line:int>>>"

    def step(s, x):
        free = F.array_position(F.transform(s["ends"], lambda e: e < x["pos1"]), True)
        line = F.when(free > 0, free - 1).otherwise(F.size(s["ends"])).cast("int")
        end = (x["pos1"] + x["span"]).cast("int")
        ends = F.when(line < F.size(s["ends"]), F.transform(s["ends"], lambda e, i: F.when(i == line, end).otherwise(e))).otherwise(F.concat(s["ends"], F.array(end)))
        return F.struct(ends.alias("ends"), F.concat(s["lines"], F.array(F.struct(x["read"].alias("read"), line.alias("line")))).alias("lines")).cast(kind)

    start = F.struct(F.array().cast("array<int>").alias("ends"), F.array().cast(f"array<struct<read:{read},line:int>>").alias("lines")).cast(kind)
    lines = reads.agg(order.alias("r")).select(F.inline(F.aggregate("r", start, step)["lines"])).select("read.*", "line")
    own = bases.aligned(reads, ("rid", "bss")).where(F.col("rpos").between(beg1, end1))
    on = ((F.col("bss") == 0) & (F.col("rb") == "C")) | ((F.col("bss") == 1) & (F.col("rb") == "G"))
    turned = F.col("qb") == F.when(F.col("rb") == "C", "T").otherwise("A")
    what = F.when(on & (F.col("qb") == F.col("rb")), "retention").when(on & turned, "conversion").when(F.col("qb") == F.col("rb"), "match").otherwise("mismatch")
    return own.join(lines, key).select("line", *key, "rpos", "qb", what.alias("kind"))

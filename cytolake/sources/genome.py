"""Reference sequences as tables, whole or in blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def blocks(genome: DataFrame, size: int = 1024, flank: int = 2, beyond: str = "N") -> DataFrame:
    """(chrom, blk, beg1, n, seq) of (chrom, seq): positions beg1 .. beg1 + n - 1, with ``flank`` further bases on both sides, ``beyond`` beyond the ends.

    Contigs are cut by one linear pass, so long ones cost no more per base than short ones. A genome may also be the pieces of contigs that :func:`cytolake.sources.sequences.fasta` reads; their length has to be a multiple
    of a block's, their flanks at least as long as a block's.
    """
    if not 0 < flank <= size:
        raise ValueError("a flank must be at least 1 and no longer than a block")
    if "left" in genome.columns:
        return _cut_pieces(genome, size, flank, beyond)
    parts = F.regexp_extract_all(F.upper("seq"), F.lit(f".{{1,{size}}}"), F.lit(0))
    pad = beyond * flank
    cut = genome.select("chrom", parts.alias("parts"))
    before = lambda k: F.when(k > 0, F.right(F.element_at("parts", k), F.lit(flank))).otherwise(pad)
    after = lambda k: F.rpad(F.coalesce(F.left(F.try_element_at("parts", k + 2), F.lit(flank)), F.lit("")), flank, beyond)
    # a short last block may leave its predecessor's right flank short as well: what it lacks is beyond the contig's end
    each = F.transform(F.sequence(F.lit(0), F.size("parts") - 1), lambda k: F.struct(k.alias("blk"), F.element_at("parts", k + 1).alias("own"), before(k).alias("left"), after(k).alias("right")))
    rows = cut.where(F.size("parts") > 0).select("chrom", F.inline(each))
    return rows.select("chrom", "blk", (F.col("blk") * size + 1).alias("beg1"), F.length("own").alias("n"), F.concat("left", "own", "right").alias("seq"))


def lengths(genome: DataFrame) -> DataFrame:
    """(chrom, n) of contigs, whole or in pieces."""
    if "left" in genome.columns:
        return genome.groupBy("chrom").agg(F.max(F.col("beg1") - 1 + F.length("seq")).alias("n"))
    return genome.select("chrom", F.length("seq").alias("n"))


def _cut_pieces(pieces: DataFrame, size: int, flank: int, beyond: str) -> DataFrame:
    first = F.col("beg1") - 1
    checked = F.when(first % size != 0, F.raise_error(F.lit(f"pieces do not begin with a block of {size} bases"))).when((first > 0) & (F.length("left") < flank), F.raise_error(F.lit(f"pieces have flanks of less than {flank} bases"))).otherwise(first)
    cut = pieces.select("chrom", checked.alias("_at"), F.regexp_extract_all(F.upper("seq"), F.lit(f".{{1,{size}}}"), F.lit(0)).alias("parts"), F.lpad(F.right("left", F.lit(flank)), flank, beyond).alias("left"), F.left("right", F.lit(flank)).alias("right"))
    before = lambda k: F.when(k > 0, F.right(F.element_at("parts", k), F.lit(flank))).otherwise(F.col("left"))
    # a last block that is short has the piece's right flank behind it, if the piece has one
    after = lambda k: F.rpad(F.left(F.concat(F.coalesce(F.try_element_at("parts", k + 2), F.lit("")), "right"), F.lit(flank)), flank, beyond)
    each = F.transform(F.sequence(F.lit(0), F.size("parts") - 1), lambda k: F.struct(k.alias("k"), F.element_at("parts", k + 1).alias("own"), before(k).alias("l"), after(k).alias("r")))
    rows = cut.where(F.size("parts") > 0).select("chrom", "_at", F.inline(each))
    blk = (F.floor(F.col("_at") / size) + F.col("k")).cast("int")
    return rows.select("chrom", blk.alias("blk"), (F.col("_at") + F.col("k") * size + 1).cast("int").alias("beg1"), F.length("own").alias("n"), F.concat("l", "own", "r").alias("seq"))


def spread(cut: DataFrame) -> DataFrame:
    """Blocks over all tasks. A genome is a few long records that one task may read; its blocks are dealt out before positions or k-mers multiply them.

    The number of tasks is given, so that small texts that become many rows are not gathered again."""
    return cut.repartition(int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions")), "chrom", "blk")


def positions(genome: DataFrame, size: int = 128) -> DataFrame:
    """(chrom, pos1, ref, five) of every position; five is the position with two bases on each side. Taking a base out of a block costs as much as the bases before it, so blocks are short."""
    rows = spread(blocks(genome, size, 2)).select("chrom", "beg1", "seq", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    return rows.select("chrom", (F.col("beg1") + F.col("i")).alias("pos1"), F.substr("seq", F.col("i") + 3, F.lit(1)).alias("ref"), F.substr("seq", F.col("i") + 1, F.lit(5)).alias("five"))


def cpg_sites(genome: DataFrame, size: int = 1024, beside: bool = False) -> DataFrame:
    """(chrom, beg0, end[, before, behind]) of every CpG, with the bases on both sides of it if they are asked for. Places are found within a block, so there is a row per CpG and none per base."""
    own = spread(blocks(genome, size, 2)).select("chrom", "beg1", "seq", F.substr("seq", F.lit(3), F.col("n") + 1).alias("s"))
    gaps = F.transform(F.split("s", "CG"), lambda x: F.length(x))  # bases before each CG, and after the last
    kind = "struct<at:int,hits:array<int>>"
    step = lambda s, n: F.struct((s["at"] + n + 2).alias("at"), F.concat(s["hits"], F.array(s["at"] + n)).alias("hits")).cast(kind)
    hits = F.aggregate(F.slice("gaps", F.lit(1), F.size("gaps") - 1), F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("hits")).cast(kind), step, lambda s: s["hits"])
    at = own.select("chrom", "beg1", "seq", gaps.alias("gaps")).where(F.size("gaps") > 1).select("chrom", "beg1", "seq", F.explode(F.array(hits)).alias("hits")).select("chrom", "beg1", "seq", F.explode("hits").alias("i"))
    sides = [F.substr("seq", F.col("i") + 2, F.lit(1)).alias("before"), F.substr("seq", F.col("i") + 5, F.lit(1)).alias("behind")] if beside else []
    return at.select("chrom", (F.col("beg1") - 1 + F.col("i")).alias("beg0"), (F.col("beg1") + 1 + F.col("i")).alias("end"), *sides)


WINDOWS_BLOCK = 12_800


def gc_windows(genome: DataFrame, width: int = 100) -> DataFrame:
    """(chrom, beg0, end, gc) of full windows without N; gc counts G and C."""
    # windows do not cross blocks, so a contig's are counted by many tasks; pieces of contigs are a multiple of the block for widths that divide it
    size = width * max(1, WINDOWS_BLOCK // width)
    own = spread(blocks(genome, size, 1)).select("chrom", "beg1", F.substr("seq", F.lit(2), F.col("n")).alias("s"))
    full = own.select("chrom", "beg1", F.posexplode(F.regexp_extract_all("s", F.lit(f".{{{width}}}"), F.lit(0))).alias("k", "w")).where(~F.contains("w", F.lit("N")))
    beg0 = F.col("beg1") - 1 + F.col("k") * width
    return full.select("chrom", beg0.alias("beg0"), (beg0 + width).alias("end"), (width - F.length(F.translate("w", "GC", ""))).alias("gc"))

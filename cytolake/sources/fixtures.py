"""A genome and reads derived from the driver's tables by integer arithmetic, the same in any engine.

Contigs are the letters of documents mapped to bases; reads are events: strand, position, clips, indels, qualities, flags and tags all follow from
``event_id``. :mod:`cytolake.plans.oracle` has the same in SQL. Each table is derived once an application and written, as reads and genomes are Parquet tables where the
operators are used.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store

LETTERS, MAPPED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ACGTACGTACGTACGTACGTACGTCG"


def _stored(derive):
    """The table that ``derive`` makes, written by the first query that reads it."""

    @wraps(derive)
    def read(spark: SparkSession, sf_dir: str) -> DataFrame:
        return store.once(spark, ("fixture", derive.__name__, sf_dir), lambda: derive(spark, sf_dir))

    return read


@_stored
def genome(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    letters = F.upper(F.regexp_replace("text", "[^A-Za-z]+", ""))
    # a generator's row: letters are worked out once and not again for the filter
    long = docs.select(F.col("doc_id").alias("tid"), F.concat(F.lit("chr"), F.col("doc_id").cast("string")).alias("chrom"), F.explode(F.array(letters)).alias("seq")).where(F.length("seq") >= 100)
    return long.withColumn("seq", F.translate("seq", LETTERS, MAPPED)).repartition("chrom")


@_stored
def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    g = genome(spark, sf_dir).select("tid", "chrom", "seq", F.length("seq").alias("clen"))
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("e"))
    j = events.withColumn("tid", F.col("e") * 7919 % n).join(g, "tid")
    e = F.col("e")
    j = j.withColumn("pos1", (e * 37 % (F.col("clen") - 60) + 1).cast("int")).withColumn("bs", (F.floor(e / 2) % 2).cast("int")).withColumn("pat", (e % 5).cast("int"))
    span = F.when(F.col("pat") == 2, 45).when(F.col("pat") == 3, 52).when(F.col("pat") == 4, 47).otherwise(50)
    j = j.withColumn("span", span).withColumn("ref", F.substr("seq", F.col("pos1"), F.col("span"))).drop("seq")
    # every third base is not converted, those whose place and number make a multiple of 3: with so many bases before that they begin triplets, they are marked by a small letter (text functions, no expression a base)
    before = ((e + F.col("pos1")) % 3).cast("int")
    whole = F.concat(F.repeat(F.lit("N"), before), "ref", F.lit("NN"))

    def turned(b: str, to: str):
        marked = F.regexp_replace(whole, rf"\G((?:[^{b}]..)*+){b}(..)", f"$1{b.lower()}$2")
        return F.substr(F.translate(marked, b + b.lower(), to + b), before + 1, F.col("span"))

    # the first place of a changed base from the read's beginning on; the next one is 97 further, beyond any read
    snp = F.pmod(-(F.col("tid") * 31 + F.col("pos1")), F.lit(97)).cast("int")
    s = F.col("s")
    j = j.withColumn("s", F.when(F.col("bs") == 0, turned("C", "T")).otherwise(turned("G", "A")))
    changed = F.concat(F.left(s, snp), F.translate(F.substr("ref", snp + 1, F.lit(1)), "ACGT", "CGTA"), F.substr(s, snp + 2))
    j = j.withColumn("s", F.when((snp < F.col("span")) & ((e + F.col("pos1") + snp) % 2 == 0), changed).otherwise(s))
    seq = F.when(F.col("pat") == 2, F.concat(F.lit("ACGTA"), s)).when(F.col("pat") == 3, F.concat(F.substring(s, 1, 20), F.substring(s, 23, 30))).when(F.col("pat") == 4, F.concat(F.substring(s, 1, 25), F.lit("GTC"), F.substring(s, 26, 22))).otherwise(s)
    # qualities begin at one of 31 places of a cycle
    qual = F.element_at(F.array(*[F.lit("".join(chr(43 + (k + i * 7) % 31) for i in range(1, 51))) for k in range(31)]), (e * 3 % 31).cast("int") + 1)
    yes = lambda c, v: F.when(c, v).otherwise(0)
    flag = 1 + yes(e % 11 != 0, 2) + yes(F.col("bs") == 1, 16) + yes(e % 2 == 0, 64) + yes(e % 2 == 1, 128) + yes(e % 17 == 0, 256) + yes(e % 19 == 0, 512) + yes(e % 13 == 0, 1024) + yes(e % 23 == 0, 4)
    return j.select(
        e.alias("rid"), (F.floor(e / 4) % 2).cast("int").alias("sid"), F.concat(F.lit("r"), F.floor(e / 2).cast("string")).alias("qname"), flag.cast("int").alias("flag"), "chrom", "pos1",
        (e * 7 % 61).cast("int").alias("mapq"), F.element_at(F.array(*map(F.lit, ("50M", "50M", "5S45M", "20M2D30M", "25M3I22M"))), F.col("pat") + 1).alias("cigar"),
        F.greatest(F.lit(1), F.col("pos1") + (e % 41).cast("int") - 20).alias("mpos1"), (e * 11 % 1200 - 100).cast("int").alias("isize"), seq.alias("seq"), qual.alias("qual"),
        F.when(e % 3 > 0, (e % 4).cast("int")).alias("NM"), F.when(e % 5 > 0, (35 + e % 21).cast("int")).alias("AS"), F.when(e % 2 == 0, F.lit("48M")).alias("MC"),
        F.when(e % 8 == 0, "f").when(e % 8 == 1, "r").when(e % 8 == 2, "u").when(e % 8 == 3, "c").alias("YD"), F.when(e % 8 == 4, "++").when(e % 8 == 3, "-+").alias("ZS"), F.when(e % 8 == 5, "CT").when(e % 8 == 6, "GA").alias("XG"),
    )


@_stored
def snps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chrom, pos1, ref, alt, af) at the sites where the reads' bases are changed: every 97th of a contig. Only those become rows, and a contig's number goes with its name, so no base is shuffled or joined."""
    from .genome import blocks, spread

    named = genome(spark, sf_dir).select(F.struct("tid", "chrom").alias("chrom"), "seq")
    own = spread(blocks(named, 1024, 2)).select("chrom.tid", "chrom.chrom", "beg1", "n", "seq")
    first = F.pmod(-(F.col("tid") * 31 + F.col("beg1")), F.lit(97)).cast("int")
    each = own.select("chrom", "beg1", "seq", F.explode(F.when(first < F.col("n"), F.sequence(first, F.col("n") - 1, F.lit(97)))).alias("i"))
    at = each.select("chrom", (F.col("beg1") + F.col("i")).alias("pos1"), F.substr("seq", F.col("i") + 3, F.lit(1)).alias("ref"))
    return at.select("chrom", "pos1", "ref", F.translate("ref", "ACGT", "CGTA").alias("alt"), (F.col("pos1") % 10 / 100.0).alias("af"))


@_stored
def fastq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ord, name, seq1, qual1, seq2, qual2): pairs of reads with a barcode in read 1."""
    a = alignments(spark, sf_dir)
    comp = F.translate("seq", "ACGT", "TGCA")
    return a.select(F.col("rid").alias("ord"), F.concat("qname", F.lit(":"), F.col("rid").cast("string")).alias("name"), F.col("seq").alias("seq1"), F.col("qual").alias("qual1"), comp.alias("seq2"), F.reverse("qual").alias("qual2"))

"""Readers of the text formats: FASTA, FASTQ, SAM, VCF, BED and read-level tables. All are Spark text or CSV scans, compressed or not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, seq): records are split at ">", the name ends at the first white space, bases are upper-cased.

    A record is a row, so one contig must fit a task; :func:`cytolake.sources.sequences.fasta` reads longer ones in pieces, which every operator takes as well."""
    rows = spark.read.text(path, lineSep=">").where("value <> ''")
    head = F.regexp_extract("value", r"^([^\r\n]*)", 1)
    body = F.expr("substr(value, length(regexp_extract(value, '^([^\\r\\n]*)', 1)) + 1)")
    return rows.select(F.regexp_extract(head, r"^(\S*)", 1).alias("chrom"), F.upper(F.regexp_replace(body, r"\s", "")).alias("seq")).where("chrom <> ''")


def fastq(spark: SparkSession, path: str) -> DataFrame:
    """(ord, name, comment, seq, qual), as :func:`cytolake.sources.sequences.fastq` reads them."""
    from .sequences import fastq

    return fastq(spark, path)


def _tag(tags: Column, name: str, kind: str) -> Column:
    hit = F.filter(tags, lambda t: F.startswith(t, F.lit(f"{name}:{kind}:")))
    return F.substring(F.try_element_at(hit, F.lit(1)), 6, 1 << 30)


def numbered(scan: int) -> Column:
    """Numbers of the rows of one scan; those of scans with different numbers (0 to 1022) differ. A scan has a million splits at most."""
    if not 0 <= scan < 1023:
        raise ValueError("the number of a scan is from 0 to 1022")
    own = F.monotonically_increasing_id()
    return F.when(own < 1 << 53, own + F.lit(scan * (1 << 53)).cast("long")).otherwise(F.raise_error(F.lit("a scan has more than 2^20 splits")))


def sam(spark: SparkSession, path: str | list[str], sid: int = 0, scan: int | None = None) -> DataFrame:
    """Alignments with the hot tags as columns; header lines are left out. ``rid`` is the line's place in the scan and the number of the scan, by default the sample's, so equal records are two reads and
    samples that are read one by one can be put together. Several files of one sample are a list of paths, or scans with numbers of their own."""
    c = F.when(~F.startswith("value", F.lit("@")), F.split("value", "\t"))  # no field of a header line is read, whatever the order of filters
    rows = _numbered_text(spark, path, sid if scan is None else scan).where(~F.startswith("value", F.lit("@"))).where("value <> ''").select("rid", c.alias("c"), F.slice(c, 12, 1 << 20).alias("t"))
    at = lambda k: F.col("c")[k]
    tag = lambda n, k: _tag(F.col("t"), n, k)
    return rows.select(
        F.lit(sid).alias("sid"), F.col("rid"), at(0).alias("qname"), at(1).cast("int").alias("flag"), at(2).alias("chrom"), at(3).cast("int").alias("pos1"), at(4).cast("int").alias("mapq"), at(5).alias("cigar"),
        F.when(at(6) == "=", at(2)).otherwise(at(6)).alias("mchrom"), at(7).cast("int").alias("mpos1"), at(8).cast("int").alias("isize"), at(9).alias("seq"), at(10).alias("qual"),
        *[tag(n, "i").cast("int").alias(n) for n in ("NM", "AS")], *[F.coalesce(tag(n, "Z"), tag(n, "A")).alias(n) for n in ("MC", "MD", "YD", "ZS", "XG", "MM")],
        F.transform(F.split(F.regexp_replace(tag("ML", "B"), "^C,?", ""), ","), lambda x: x.try_cast("int")).alias("ML"),
    )


def _numbered_text(spark: SparkSession, path: str | list[str], scan: int) -> DataFrame:
    return spark.read.text(path).withColumn("rid", numbered(scan))


def in_region(aln: DataFrame, chrom: str, beg1: int | None = None, end1: int | None = None) -> DataFrame:
    """Reads that overlap chrom:beg1-end1. The test on chrom and pos1 reaches a Parquet scan; the read's end is tested after."""
    from ..functions.cigar import reference_length

    out = aln.where(F.col("chrom") == chrom)
    if end1 is not None:
        out = out.where(F.col("pos1") <= end1)
    if beg1 is not None:
        out = out.where(F.col("pos1") + reference_length(F.col("cigar")) - 1 >= beg1)
    return out


def parse_region(text: str) -> tuple[str, int | None, int | None]:
    """chrom, beg1, end1 of "chr:beg-end"; the whole contig if there is no range."""
    chrom, colon, span = text.rpartition(":")
    beg, dash, end = span.replace(",", "").partition("-")
    if not colon or not beg.isdigit() or (dash and not end.isdigit()):
        return text, None, None
    return chrom, int(beg), int(end) if dash else None


def vcf(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, pos1, ref, alt, qual, filter, info, sample, fmt): long, a row a sample; info and fmt are maps. Sample names come from the header."""
    lines = spark.read.text(path)
    head = lines.where(F.startswith("value", F.lit("#CHROM"))).limit(1).collect()  # one line
    names = head[0].value.split("\t")[9:] if head else []
    c = F.split("value", "\t")
    rows = lines.where(~F.startswith("value", F.lit("#"))).where("value <> ''").select(c.alias("c"))
    at = lambda k: F.col("c")[k]
    info = F.map_from_entries(F.transform(F.split(at(7), ";"), lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.when(F.contains(x, F.lit("=")), F.regexp_replace(x, "^[^=]*=", "")).alias("v"))))
    each = rows.select(at(0).alias("chrom"), at(1).cast("int").alias("pos1"), at(3).alias("ref"), at(4).alias("alt"), at(5).try_cast("int").alias("qual"), at(6).alias("filter"), info.alias("info"), F.split(at(8), ":").alias("f"), F.posexplode(F.slice("c", 10, 1 << 20)).alias("k", "v"))
    sample = F.element_at(F.array(*map(F.lit, names)), F.col("k") + 1) if names else F.col("k").cast("string")
    pad = lambda v: F.slice(F.concat(v, F.array_repeat(F.lit(None).cast("string"), F.size("f"))), F.lit(1), F.size("f"))
    return each.select("chrom", "pos1", "ref", "alt", "qual", "filter", "info", sample.alias("sample"), F.map_from_arrays("f", pad(F.split("v", ":"))).alias("fmt"))


def meth_bed(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, beg0, end, [ref, cx, ctx2, n5,] sid, beta, cov): long; four context columns are there if the fourth is C or G."""
    c = F.split("value", "\t")
    rows = spark.read.text(path).where("value <> ''").select(c.alias("c"))
    full = F.col("c")[3].isin("C", "G")
    lead = F.when(full, 7).otherwise(3)
    rows = rows.withColumn("lead", lead).withColumn("n", F.floor((F.size("c") - F.col("lead")) / 2).cast("int")).where("n > 0")
    each = rows.select("c", "lead", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("sid"))
    at = lambda k: F.element_at("c", k)
    context = [F.when(F.col("lead") == 7, F.col("c")[k]).alias(n) for k, n in ((3, "ref"), (4, "cx"), (5, "ctx2"), (6, "n5"))]
    return each.select(F.col("c")[0].alias("chrom"), F.col("c")[1].cast("int").alias("beg0"), F.col("c")[2].cast("int").alias("end"), *context, "sid", at(F.col("lead") + 2 * F.col("sid") + 1).try_cast("double").alias("beta"), F.coalesce(at(F.col("lead") + 2 * F.col("sid") + 2).try_cast("int"), F.lit(0)).alias("cov"))


def snp_bed(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, pos1, ref, alt, gt, sp, ac, af) of rows with exactly nine columns."""
    c = F.split("value", "\t")
    rows = spark.read.text(path).select(c.alias("c")).where(F.size("c") == 9)
    at = lambda k: F.col("c")[k]
    return rows.select(at(0).alias("chrom"), (at(1).cast("int") + 1).alias("pos1"), at(3).alias("ref"), at(4).alias("alt"), at(5).alias("gt"), at(6).alias("sp"), at(7).try_cast("int").alias("ac"), at(8).try_cast("double").alias("af"))


def pairwise_tsv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="chrom string, snp1 long, cg1 long, snp_base string, cg_call string")


def epiread_tsv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="chrom string, qname string, mate string, strand string, cg_pos0 string, cg string, snp_pos0 string, snp string")


def literal_reads(spark: SparkSession, seq1: str, seq2: str | None = None) -> DataFrame:
    """A read given as text, or a pair."""
    rows = [(0, m, "inputread", s, "I" * len(s)) for m, s in ((1, seq1), (2, seq2)) if s]
    return spark.createDataFrame(rows, "rid long, mate int, name string, seq string, qual string")

"""Text renderings: VCF, BED, SAM, FASTQ, epireads and report tables. Rows are range-sorted over all tasks, never gathered in one.

Numbers are rounded as C's printf does, half to even on the exact binary value.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fixed(x: Column, digits: int) -> Column:
    """``%.{digits}f`` of a double, null for null. Only text sinks use it; no built-in function rounds the exact binary value."""

    @F.pandas_udf("string")
    def text(v: pd.Series) -> pd.Series:
        return v.map(lambda a: None if a is None or a != a else f"{a:.{digits}f}")

    return text(x.cast("double"))


def ordered(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.orderBy(*keys)


def vcf_header(contigs: list[tuple[str, int]], samples: list[str], reference: str = "", program: str = "cytolake") -> list[str]:
    """Contigs come sorted by name."""
    out = ["##fileformat=VCFv4.1", f"##reference={reference}", f"##source={program}"]
    out += [f"##contig=<ID={c},length={n}>" for c, n in sorted(contigs)]
    out += [f"##program=<cmd={program}>", '##FILTER=<ID=PASS,Description="All filters passed">', '##FILTER=<ID=LowQual,Description="Genotype quality smaller than 5">']
    out += [f'##INFO=<ID={k},Number=1,Type={t},Description="{d}">' for k, t, d in (("NS", "Integer", "Number of samples"), ("CX", "String", "Cytosine context"), ("N5", "String", "Five bases around the cytosine"), ("SS", "Integer", "Somatic status"), ("SC", "Integer", "Somatic score"), ("AB", "String", "Ambiguous alternative"))]
    out += [f'##FORMAT=<ID={k},Number={n},Type={t},Description="{d}">' for k, n, t, d in (("GT", 1, "String", "Genotype"), ("GL1", 3, "Integer", "Log likelihoods"), ("GQ", 1, "Float", "Genotype quality"), ("DP", 1, "Integer", "Depth"), ("SP", 1, "String", "Allele support"), ("AC", 1, "Integer", "Reads for both alleles"), ("AF1", 1, "Float", "Share of the alternative"), ("CV", 1, "Integer", "Cytosine coverage"), ("BT", 1, "Float", "Methylation fraction"))]
    return out + ["\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *samples])]


def vcf_lines(called: DataFrame, n_samples: int) -> DataFrame:
    """(chrom, pos1, value): a line per site of :func:`cytolake.operators.pileup.calls`."""
    c = F.col
    any_callable = F.max("callable")
    gl = F.concat_ws(",", *[F.when(c("gq") > 0, fixed(F.greatest(F.lit(-1000.0), c(f"gl{k}")), 0)).otherwise(".") for k in range(3)])
    lead = F.concat_ws(":", F.when(c("gq") > 0, c("gt")).otherwise("./."), gl, F.when(c("gq") > 0, fixed(c("gq"), 0)).otherwise("0"), c("dp").cast("string"), c("sp"))
    ac = F.when(c("alt").isNotNull(), F.concat(F.lit(":"), c("ac").cast("string"), F.lit(":"), F.coalesce(fixed(c("af1"), 2), F.lit("."))))
    cv = F.when(c("callable"), F.concat(F.lit(":"), c("cov").cast("string"), F.lit(":"), fixed(c("beta"), 3))).otherwise(":0:.")
    one = F.struct(c("sid"), F.concat(lead, F.coalesce(ac, F.lit(""))).alias("a"), cv.alias("b"))
    sites = called.groupBy("chrom", "pos1").agg(F.first("ref").alias("ref"), F.first("alt").alias("alt"), F.first("qual").alias("qual"), F.first("pass").alias("pass"), F.first("cx").alias("cx"), F.first("n5").alias("n5"), any_callable.alias("any"), F.collect_list(one).alias("s"))
    empty = F.concat(F.lit("./.:.,.,.:0:0:."), F.when(c("alt").isNotNull(), ":0:.").otherwise(""), F.when(c("any"), ":0:.").otherwise(""))
    cell = lambda k: F.coalesce(F.try_element_at(F.transform(F.filter("s", lambda x: x["sid"] == k), lambda x: F.concat(x["a"], F.when(c("any"), x["b"]).otherwise(""))), F.lit(1)), empty)
    ambiguous = c("alt").isin("Y", "R")
    info = F.concat_ws(";", F.lit(f"NS={n_samples}"), F.when(c("cx").isNotNull(), F.concat(F.lit("CX="), c("cx"))), F.when(c("cx").isNotNull(), F.concat(F.lit("N5="), c("n5"))), F.when(ambiguous, F.concat(F.lit("AB="), c("alt"))))
    fmt = F.concat(F.lit("GT:GL1:GQ:DP:SP"), F.when(c("alt").isNotNull(), ":AC:AF1").otherwise(""), F.when(c("any"), ":CV:BT").otherwise(""))
    line = F.concat_ws("\t", "chrom", c("pos1").cast("string"), F.lit("."), "ref", F.when(ambiguous, "N").otherwise(F.coalesce("alt", F.lit("."))), c("qual").cast("string"), F.when(c("pass"), "PASS").otherwise("LowQual"), info, fmt, *[cell(k) for k in range(n_samples)])
    return sites.select("chrom", "pos1", line.alias("value"))


def meth_bed_lines(bed: DataFrame, samples: list[int], context: bool = False, counts: bool = False) -> DataFrame:
    """(chrom, beg0, value) of :func:`cytolake.operators.methbed.vcf2bed`: beta and cov of each sample, or percentage, M and U; "." without coverage."""
    def cell(s: int) -> list[Column]:
        b, n = F.col(f"b{s}"), F.coalesce(F.col(f"n{s}"), F.lit(0))
        if counts:
            m = F.floor(b * n + 0.5)
            return [F.coalesce(F.floor(100 * b + 0.5).cast("string"), F.lit(".")), F.coalesce(m.cast("string"), F.lit("0")), F.coalesce((n - m).cast("string"), F.lit("0"))]
        return [F.coalesce(fixed(b, 3), F.lit(".")), n.cast("string")]

    extra = [F.first(k).alias(k) for k in ("ref", "cx", "ctx2", "n5")]
    own = [F.max(F.when(F.col("sid") == s, F.col(c))).alias(f"{c[0] if c == 'beta' else 'n'}{s}") for s in samples for c in ("beta", "cov")]
    rows = bed.groupBy("chrom", "beg0", "end").agg(*extra, *own)
    lead = ["ref", "cx", "ctx2", "n5"] if context else []
    return rows.select("chrom", "beg0", F.concat_ws("\t", "chrom", F.col("beg0").cast("string"), F.col("end").cast("string"), *lead, *[x for s in samples for x in cell(s)]).alias("value"))


def epibed_lines(bed: DataFrame) -> DataFrame:
    return bed.select("chrom", "start0", F.concat_ws("\t", "chrom", F.col("start0").cast("string"), F.col("end").cast("string"), "qname", "mate", "strand", "cg", "gc", "vr").alias("value"))


def epiread_lines(rows: DataFrame) -> DataFrame:
    """(chrom, cg_pos0, value) of :func:`cytolake.operators.epiread.legacy`; reads with GpC columns have these two more."""
    names = [c for c in ("chrom", "qname", "mate", "strand", "cg_pos0", "cg", "gc_pos0", "gc", "snp_pos0", "snp") if c in rows.columns]
    return rows.select("chrom", F.substring_index("cg_pos0", ",", 1).try_cast("long").alias("cg_pos0"), F.concat_ws("\t", *names).alias("value"))


def pairwise_lines(rows: DataFrame) -> DataFrame:
    """(chrom, snp1, cg1, value) of :func:`cytolake.operators.epiread.pairwise`."""
    return rows.select("chrom", "snp1", "cg1", F.concat_ws("\t", "chrom", F.col("snp1").cast("string"), F.col("cg1").cast("string"), "snp_base", "cg_call").alias("value"))


#: Context columns of the average table, in its order.
AVERAGES, AVERAGES_NOME = ("CG", "CHG", "CHH", "CH"), ("HCG", "HCHG", "HCHH", "HCH", "GC")


def average_lines(rows: DataFrame, samples: list[str], nome: bool = False) -> DataFrame:
    """(sid, whole, chrom, value) of :func:`cytolake.operators.pileup.average_methylation`: count and percentage of each context; the whole genome comes last."""
    kinds = AVERAGES_NOME if nome else AVERAGES
    pick = lambda c, k: F.max(F.when(F.col("cx") == k, F.col(c)))
    own = [x for k in kinds for x in (F.coalesce(pick("n", k), F.lit(0)).alias(f"n_{k}"), (100 * pick("mean_beta", k)).alias(f"b_{k}"))]
    wide = rows.groupBy("sid", "chrom").agg(*own)
    cells = [x for k in kinds for x in (F.col(f"n_{k}").cast("string"), F.concat(F.coalesce(fixed(F.col(f"b_{k}"), 3), F.lit("nan")), F.lit("%")))]
    sample = F.element_at(F.array(*map(F.lit, samples)), F.col("sid") + 1)
    name = F.coalesce("chrom", F.lit("WholeGenome"))
    return wide.select("sid", F.col("chrom").isNull().alias("whole"), name.alias("chrom"), F.concat_ws("\t", sample, name, *cells).alias("value"))


# Report tables: their rows are few by nature (values of mapq, insert sizes, read positions), so each is one small file. A table is (k, value): lines in order of k.


def _report(spark, head: list[str], body: DataFrame) -> DataFrame:
    lead = spark.createDataFrame([(k - len(head), x) for k, x in enumerate(head)], "k long, value string")
    return lead.unionByName(body.select(F.col("k").cast("long").alias("k"), "value"))


def mapq_report(rows: DataFrame) -> DataFrame:
    k = F.when(F.col("mapq") == "unmapped", -1).otherwise(F.col("mapq").try_cast("long")) + 1
    return _report(rows.sparkSession, ["Mapping Quality Table", "MapQ\tCount"], rows.select(k.alias("k"), F.concat_ws("\t", "mapq", F.col("n").cast("string")).alias("value")))


def insert_report(rows: DataFrame) -> DataFrame:
    line = F.concat_ws("\t", F.col("isize").cast("string"), fixed(F.col("fraction"), 8), F.col("n").cast("string"))
    return _report(rows.sparkSession, ["Insert Size Table", "InsertSize\tFraction\tReadCount"], rows.select(F.col("isize").alias("k"), line.alias("value")))


def duplicate_lines(rows: DataFrame) -> DataFrame:
    parts = (("Number of duplicate reads:", "n_dup"), ("Number of reads:", "n"), ("Number of duplicate q40-reads:", "n_q40_dup"), ("Number of q40-reads:", "n_q40"))
    each = F.array(*[F.struct(F.lit(k).alias("k"), F.concat_ws("\t", F.lit(t), F.col(c).cast("string")).alias("value")) for k, (t, c) in enumerate(parts)])
    return _report(rows.sparkSession, ["Read Duplication Table"], rows.select(F.inline(each)))


def strand_lines(rows: DataFrame) -> DataFrame:
    """Of (mate, reverse, tag, n): a line for each mate and direction, with the reads of either strand tag."""
    names = [(m, r) for m in (1, 2) for r in (False, True)]
    count = lambda m, r, t: F.coalesce(F.sum(F.when((F.col("mate") == m) & (F.col("reverse") == r) & (F.col("tag") == t), F.col("n"))), F.lit(0)).cast("string")
    each = F.array(*[F.struct(F.lit(k).alias("k"), F.concat_ws("\t", F.lit(f"R{m} ({'r' if r else 'f'})"), count(m, r, "f"), count(m, r, "r")).alias("value")) for k, (m, r) in enumerate(names)])
    return _report(rows.sparkSession, ["Strand Table", "strand\tBSW (f)\tBSC (r)"], rows.agg(each.alias("x")).select(F.inline("x")))


def conversion_report(rows: DataFrame) -> DataFrame:
    cells = [F.coalesce(fixed(F.col(f"r{b}"), 8), F.lit("nan")) for b in "ACGT"]
    wide = rows.agg(*[F.max(F.when(F.col("context") == f"C{b}", F.col("rate"))).alias(f"r{b}") for b in "ACGT"])
    return _report(rows.sparkSession, ["Conversion Rate by Read Average Table", "CpA\tCpC\tCpG\tCpT"], wide.select(F.lit(0).alias("k"), F.concat_ws("\t", *cells).alias("value")))


def position_report(rows: DataFrame, kind: str) -> DataFrame:
    """``kind`` is CpG or CpH."""
    line = F.concat_ws("\t", F.col("mate").cast("string"), F.col("qpos").cast("string"), "state", F.col("n").cast("string"))
    k = (F.col("mate") * 100_000 + F.col("qpos")) * 2 + (F.col("state") == "R").cast("int")
    return _report(rows.sparkSession, [f"{kind} Retention by Read Position Table", "ReadInPair\tPosition\tConversion/Retention\tCount"], rows.select(k.alias("k"), line.alias("value")))


def quality_reports(aln: DataFrame, genome: DataFrame, single_end: bool = False) -> dict[str, DataFrame]:
    """The report's tables by the ending of their file names, each as lines (k, value)."""
    from ..operators import readqc

    positions = lambda t: readqc.retention_by_position(readqc.cytosines(aln, genome, readqc.Cytosines(t)))
    out = {
        "_mapq_table.txt": mapq_report(readqc.mapq_histogram(aln)),
        "_dup_report.txt": duplicate_lines(readqc.duplicate_report(aln)),
        "_strand_table.txt": strand_lines(readqc.strand_table(readqc.strands(aln, genome))),
        "_totalReadConversionRate.txt": conversion_report(readqc.read_average_conversion(aln, genome)),
        "_CpGRetentionByReadPos.txt": position_report(positions("cg"), "CpG"),
        "_CpHRetentionByReadPos.txt": position_report(positions("ch"), "CpH"),
    }
    if not single_end:
        out["_isize_table.txt"] = insert_report(readqc.insert_histogram(aln))
    return out


def sam_header(contigs: list[tuple[str, int]], read_group: str | None = None, program: str = "cytolake", by_name: bool = True) -> list[str]:
    out = [f"@SQ\tSN:{c}\tLN:{n}" for c, n in (sorted(contigs) if by_name else contigs)]
    return out + ([read_group.replace("\\t", "\t")] if read_group else []) + [f"@PG\tID:{program}\tPN:{program}"]


def sam_lines(aln: DataFrame) -> DataFrame:
    """(chrom, pos1, value); tags that a row lacks are left out."""
    tag = lambda n, k: F.when(F.col(n).isNotNull(), F.concat(F.lit(f"{n}:{k}:"), F.col(n).cast("string"))) if n in aln.columns else F.lit(None).cast("string")
    core = [F.col("qname"), F.col("flag").cast("string"), F.col("chrom"), F.col("pos1").cast("string"), F.col("mapq").cast("string"), F.col("cigar"), F.coalesce("mchrom", F.lit("*")) if "mchrom" in aln.columns else F.lit("="), F.coalesce(F.col("mpos1"), F.lit(0)).cast("string"), F.coalesce(F.col("isize"), F.lit(0)).cast("string"), F.col("seq"), F.col("qual")]
    tags = [tag(n, k) for n, k in (("NM", "i"), ("MD", "Z"), ("ZC", "i"), ("ZR", "i"), ("AS", "i"), ("XS", "i"), ("RG", "Z"), ("SA", "Z"), ("XL", "i"), ("XA", "Z"), ("XB", "Z"), ("CB", "Z"), ("RX", "Z"), ("MC", "Z"), ("MQ", "i"), ("XG", "Z"), ("ZS", "Z"), ("YD", "A"), ("ZN", "Z"), ("YC", "i"), ("YG", "i"))]
    if "PA" in aln.columns:
        tags.append(F.when(F.col("PA").isNotNull(), F.format_string("PA:f:%.3f", "PA")))
    return aln.select("chrom", "pos1", F.concat_ws("\t", *core, *tags).alias("value"))


def fastq_lines(reads: DataFrame, seq: str = "seq1", qual: str = "qual1") -> DataFrame:
    return reads.select("ord", F.concat(F.lit("@"), F.col("name"), F.lit("\n"), F.col(seq), F.lit("\n+\n"), F.col(qual)).alias("value"))


def write(lines: DataFrame, path: str, keys: tuple[str, ...], compression: str | None = None) -> None:
    """Lines of (keys, value) in order, a file a range of keys."""
    lines.orderBy(*keys).select("value").write.text(path, compression=compression or "none")

"""Expressions over bases and contexts. All are built-in functions, so they stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters of base codes 0-6 and of methylation states, as the text formats print them.
BASES = "ACGTNYR"
METH = "RCN"
#: Context names, by whether the base before is a G; NA is "CN".
CONTEXTS = ("CG", "CHG", "CHH")
NOME_H = ("HCG", "HCHG", "HCHH")
NOME_G = ("GCG", "GCH", "GCH")


def revcomp(s: Column) -> Column:
    return F.reverse(F.translate(s, "ACGTN", "TGCAN"))


def base_code(b: Column) -> Column:
    return F.position(b, F.lit(BASES)) - 1


def convert(s: Column, parent: Column | bool) -> Column:
    """In-silico bisulfite conversion: C to T for the parent strand, G to A for the daughter."""
    c2t, g2a = F.translate(s, "C", "T"), F.translate(s, "G", "A")
    if isinstance(parent, bool):
        return c2t if parent else g2a
    return F.when(parent, c2t).otherwise(g2a)


def oriented(five: Column, ref: Column) -> Column:
    """The five bases around a position, read on the strand of its cytosine."""
    return F.when(ref == "G", revcomp(five)).otherwise(five)


def context(five: Column, ref: Column, nome: bool = False) -> Column:
    """Context of a cytosine from the five bases around it, already oriented; "CN" off cytosines and next to an N."""
    after = F.when(F.substring(five, 4, 1) == "G", 0).when(F.substring(five, 5, 1) == "G", 1).otherwise(2)
    names = lambda v: F.element_at(F.array(*map(F.lit, v)), after + 1)
    kind = F.when(F.substring(five, 2, 1) == "G", names(NOME_G)).otherwise(names(NOME_H)) if nome else names(CONTEXTS)
    return F.when(~ref.isin("C", "G") | F.contains(five, F.lit("N")), "CN").otherwise(kind)


def run_lengths(s: Column) -> Column:
    """Run-length encoding; a run of one carries no count."""
    runs = F.regexp_extract_all(s, F.lit(r"((.)\2*)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.when(F.length(r) > 1, F.concat(F.substring(r, 1, 1), F.length(r).cast("string"))).otherwise(r)), "")


def barcode_of(name: Column) -> tuple[Column, Column]:
    """Barcode and UMI: the last two of at least three tokens of a read name, between underscores."""
    part = F.split(name, "_")
    there = F.size(part) >= 3
    return F.when(there, F.element_at(part, -2)), F.when(there, F.element_at(part, -1))


def mod_probability(q: Column) -> Column:
    """Probability of a base modification from its 8-bit value; -1 where there is none."""
    return F.when(q < 0, F.lit(-1.0)).otherwise((q + 0.5) / 256)


def is_main_contig(name: Column) -> Column:
    return name.rlike(r"^chr(\d{1,2}|M|X|Y)$")


def is_alternate(name: Column) -> Column:
    return name.rlike(r"^chrUn|_random|_hap|_alt")


#: Fixed value: so many of chr1 to chr22, X, Y and M make a genome of which alternates are known by name.
MAIN_CONTIGS = 20


def with_alternates(contigs: DataFrame) -> DataFrame:
    """Adds ``alternate`` to a table of contigs (chrom): named as one, in a genome that has at least 20 of chr1 to chr22, X, Y and M. A table without such names has none."""
    number = F.regexp_extract("chrom", r"^chr(\d{1,2})$", 1).try_cast("int")
    letter = F.upper(F.regexp_extract("chrom", "^chr([XYMxym])$", 1))
    main = F.when(number.between(1, 22), number.cast("string")).when(letter != "", letter)
    found = contigs.select(main.alias("_m")).agg((F.count_distinct("_m") >= MAIN_CONTIGS).alias("_whole"))
    return contigs.join(F.broadcast(found)).withColumn("alternate", F.col("_whole") & is_alternate(F.col("chrom"))).drop("_whole")  # one row

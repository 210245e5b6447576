"""Raw reads: barcodes, adaptors, quality ends, pairs in an interleaved stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def plain_name(name: Column) -> Column:
    """Without a read number at the end."""
    return F.regexp_replace(name, r"/[0-9]$", "")


def extract_barcode(pairs: DataFrame, mate: int = 1, start: int = 1, length: int = 8) -> DataFrame:
    """(ord, name, seq1, qual1, seq2, qual2) with the barcode (``start`` from 1) cut out of one mate and added to the name; pairs whose read is too short are left out.

    Single reads have null mates."""
    s, q = f"seq{mate}", f"qual{mate}"
    kept = pairs.where(F.length(s) >= start - 1 + length)
    cut = lambda c: F.concat(F.substring(c, 1, start - 1), F.substring(c, start + length, 1 << 30)) if start > 1 else F.substring(c, start + length, 1 << 30)
    name = F.concat(plain_name(F.col("name")), F.lit("_"), F.substring(s, start, length), F.lit("_AAAAAAAA"))
    return kept.withColumn("name", name).withColumns({s: cut(s), q: cut(q)})


def adaptor_length(seq: Column, adaptor: str) -> Column:
    """Bases to cut from the end: from the first whole occurrence on, else the longest end of the read that begins the adaptor."""
    whole = F.instr(seq, adaptor)
    part = F.coalesce(*[F.when(F.endswith(seq, F.lit(adaptor[:k])), k) for k in range(len(adaptor) - 1, 0, -1)], F.lit(0))
    return F.when(whole > 0, F.length(seq) - whole + 1).otherwise(part)


def quality_ends(qual: Column, least: int, fixed5: int = 0, fixed3: int = 0) -> tuple[Column, Column]:
    """Bases to cut at both ends: fixed ones, then on to the first of quality ``least`` or more; together no more than the read has."""
    n = F.length(qual)
    inner = F.substr(qual, F.lit(fixed5 + 1), F.greatest(F.lit(0), n - fixed5 - fixed3))
    low = f"[{_class(33, 32 + least)}]"
    if least <= 0:
        five = three = F.lit(0)
    else:
        five = F.length(F.regexp_extract(inner, f"^{low}*", 0))
        three = F.when(five == F.length(inner), 0).otherwise(F.length(F.regexp_extract(inner, f"{low}*$", 0)))
    left = F.least(n, fixed5 + five)
    return left, F.least(n - left, fixed3 + three)


def _class(lo: int, hi: int) -> str:
    return f"\\x{lo:02x}-\\x{hi:02x}"


def clip(reads: DataFrame, adaptor: str | None, least: int, fixed5: int = 0, fixed3: int = 0) -> DataFrame:
    """Adds clip5, clip3 and l_adaptor to (seq1, qual1), and cuts both."""
    cut = adaptor_length(F.col("seq1"), adaptor) if adaptor else F.lit(0)
    out = reads.withColumn("l_adaptor", cut)
    qual = F.substr("qual1", F.lit(1), F.length("qual1") - F.col("l_adaptor"))
    five, three = quality_ends(qual, least, fixed5, fixed3)
    out = out.withColumns({"clip5": five, "clip3": three})
    n = F.length("seq1") - F.col("l_adaptor") - F.col("clip5") - F.col("clip3")
    return out.withColumns({c: F.substr(c, F.col("clip5") + 1, n) for c in ("seq1", "qual1")})


def smart_pairs(reads: DataFrame) -> DataFrame:
    """(ord, name, kind): in an interleaved stream two neighbours of equal name are a pair (1 and 2), others single (0).

    A run of equal names at successive places (``ord`` has no gaps) pairs up from its beginning. Reads are dealt by name, so no task holds the whole stream.
    """
    named = reads.withColumn("_name", plain_name(F.col("name")))
    w = W.partitionBy("_name").orderBy("ord")
    # reads of one name at successive places form a run: place minus rank is constant along it
    ranked = named.withColumn("_run", F.col("ord") - F.row_number().over(w))
    r = W.partitionBy("_name", "_run")
    at = F.row_number().over(r.orderBy("ord"))
    size = F.count("*").over(r)
    kind = F.when((at % 2 == 1) & (at < size), 1).when(at % 2 == 0, 2).otherwise(0)
    return ranked.select("ord", "name", kind.alias("kind"))


def mate_join(first: DataFrame, second: DataFrame) -> DataFrame:
    """Mates of two files by place; a name that differs is told in ``mismatch``. Where one file is shorter, the other's reads stay, with null mates and the number of the file that
    has them in ``alone``."""
    b = second.select("ord", F.col("name").alias("name2"), F.col("seq").alias("seq2"), F.col("qual").alias("qual2"))
    a = first.select("ord", "name", F.col("seq").alias("seq1"), F.col("qual").alias("qual1"))
    both = a.join(b, "ord", "full").withColumn("mismatch", plain_name(F.col("name")) != plain_name(F.col("name2")))
    return both.withColumn("alone", F.when(F.col("seq2").isNull(), 1).when(F.col("seq1").isNull(), 2)).withColumn("name", F.coalesce("name", "name2")).drop("name2")

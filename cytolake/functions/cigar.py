"""CIGAR strings as arrays of blocks, walked once per read.

A hard clip takes no base of the stored sequence; a skip (N) moves along the reference without columns; padding does nothing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_OP = r"[0-9]+[MIDNSHP=X]"
QUERY, REFERENCE, COLUMNS = "M=XIS", "M=XDN", "M=XIDS"


def ops(cigar: Column) -> Column:
    """array<struct<op, n>>"""
    one = lambda x: F.struct(F.right(x, F.lit(1)).alias("op"), F.left(x, F.length(x) - 1).cast("int").alias("n"))
    return F.transform(F.regexp_extract_all(cigar, F.lit(_OP), F.lit(0)), one)


def _sum(cigar: Column, kinds: str) -> Column:
    return F.aggregate(ops(cigar), F.lit(0), lambda s, x: s + F.when(F.contains(F.lit(kinds), x["op"]), x["n"]).otherwise(0))


def reference_length(cigar: Column) -> Column:
    return _sum(cigar, "M=XD")


def query_length(cigar: Column) -> Column:
    return _sum(cigar, QUERY)


def blocks(cigar: Column, pos: Column) -> Column:
    """array<struct<op, n, q, r, c>>: first base in the read (from 1), on the reference (from pos) and column (from 1) of each block."""
    kind = "struct<done:array<struct<op:string,n:int,q:int,r:int,c:int>>,q:int,r:int,c:int>"
    start = F.struct(F.array().cast("array<struct<op:string,n:int,q:int,r:int,c:int>>").alias("done"), F.lit(1).alias("q"), pos.cast("int").alias("r"), F.lit(1).alias("c")).cast(kind)

    def step(s: Column, x: Column) -> Column:
        moves = lambda kinds: F.when(F.contains(F.lit(kinds), x["op"]), x["n"]).otherwise(0)
        block = F.struct(x["op"].alias("op"), x["n"].alias("n"), s["q"].alias("q"), s["r"].alias("r"), s["c"].alias("c"))
        return F.struct(F.concat(s["done"], F.array(block)).alias("done"), (s["q"] + moves(QUERY)).alias("q"), (s["r"] + moves(REFERENCE)).alias("r"), (s["c"] + moves(COLUMNS)).alias("c")).cast(kind)

    return F.aggregate(ops(cigar), start, step, lambda s: s["done"])

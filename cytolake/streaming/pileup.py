"""Incremental pileup: sums over sites are additive, so each micro-batch adds its own counts and nothing is counted again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import pileup

#: A place has one reference base and one context, so both are keys: as texts in the sums' stead they would have all rows sorted.
KEYS = ("chrom", "pos1", "sid", "ref", "five")
SUMS = ("n_ret", "n_conv", "dp", *[f"n_{b}" for b in pileup.CODES])


def merge(*counts: DataFrame) -> DataFrame:
    """Counts of disjoint sets of reads, added up."""
    both = counts[0]
    for c in counts[1:]:
        both = both.unionByName(c)
    return both.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS])


def read_stream(spark: SparkSession, folder: str, schema, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def start(reads: DataFrame, genome: DataFrame, out: str, checkpoint: str, o: pileup.Options = pileup.Options()) -> StreamingQuery:
    """Writes each batch's counts below ``out`` in a folder of the batch's number, overwritten if the batch is run again, so a restart counts nothing twice."""

    def add(batch: DataFrame, number: int) -> None:
        pileup.counts(pileup.site_bases(batch, genome, o)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return reads.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, out: str) -> DataFrame:
    """The counts of all batches so far."""
    return merge(spark.read.parquet(out).drop("batch"))

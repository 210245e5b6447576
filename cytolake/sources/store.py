"""Tables written once and read by several plans, and places along an order."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_LOCAL: list[tempfile.TemporaryDirectory] = []
_KNOWN: dict[tuple[str, ...], tuple[str, object]] = {}


def folder(spark: SparkSession) -> str:
    """A folder that driver and executors share: ``spark.checkpoint.dir``. A local one stands in for it only on a local master."""
    told = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return f"{told.rstrip('/')}/cytolake-{spark.sparkContext.applicationId}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share: tables that several plans read are written there")
    if not _LOCAL:
        _LOCAL.append(tempfile.TemporaryDirectory(prefix="cytolake-", ignore_cleanup_errors=True))
        atexit.register(_LOCAL[0].cleanup)
    return "file://" + _LOCAL[0].name


def fresh(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Written as Parquet and read back: several readers cost one computation, a lost executor costs none, and the plan is cut."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def once(spark: SparkSession, key: tuple[str, ...], make) -> DataFrame:
    """The table of ``make()``, written by the first call of an application for this key."""
    key = (spark.sparkContext.applicationId, *key)
    if key not in _KNOWN:
        df = make()
        path = f"{folder(spark)}/{'-'.join(k.replace('/', '_').replace(':', '_') for k in key[1:])}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        _KNOWN[key] = path, df.schema
    path, schema = _KNOWN[key]
    return spark.read.schema(schema).parquet(path)


def numbered(df: DataFrame, name: str, *order: Column, per_task: int = 1_000_000) -> DataFrame:
    """Adds a column of places, from 1, along a total order. Rows are range-partitioned and counted by partition, so no task sees more than its share."""
    n = max(1, -(-df.count() // per_task))
    dealt = written(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "numbered")
    before = W.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # a row a task
    starts = dealt.groupBy("_part").agg(F.count("*").alias("_n")).select(F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.col("_start") + F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return dealt.join(F.broadcast(starts), F.col("_part") == F.col("_p")).withColumn(name, place.cast("long")).select(*df.columns, name)

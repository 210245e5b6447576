"""What the corpus operators share: ASCII words, the shared folder, cut lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Words of every contract here are maximal runs of anything but these six characters.
WORD_BREAKS = " \t\n\r\x0b\x0c"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def words(text: str | None) -> list[bytes]:
    """UTF-8 words; ``bytes.split`` breaks at exactly the six characters of WORD_BREAKS."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}
_BEFORE: dict[str, dict[str, str]] = {}


def prepare(spark: SparkSession) -> None:
    """Bounds the Arrow batches that reach Python: rows of text vary from 0 to many MB. Plans take the bounds when they run, which is after the operator
    has returned, so they stay set until :func:`restore`."""
    _BEFORE.setdefault(spark.sparkContext.applicationId, {k: spark.conf.get(k) for k in _BATCHES})
    for k, v in _BATCHES.items():
        spark.conf.set(k, v)


def restore(spark: SparkSession) -> None:
    """Gives the session's Arrow options back, once no plan of these operators is to run any more."""
    for k, v in _BEFORE.pop(spark.sparkContext.applicationId, {}).items():
        spark.conf.set(k, v)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``. A local one stands in for it only where that is unset and driver and executors are one machine (tests)."""
    told = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not told:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share: intermediate tables, archives and token files go there")
        own = _own_dir()
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(own)
        told = own
    return qualified(spark, told).rstrip("/") + "/cytolake-" + spark.sparkContext.applicationId


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, so that executors open the same store that Spark does."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    full = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return "file://" + full.removeprefix("file:") if full.startswith("file:/") and not full.startswith("file://") else full


_OWN: list[tempfile.TemporaryDirectory] = []


def _own_dir() -> str:
    if not _OWN:
        _OWN.append(tempfile.TemporaryDirectory(prefix="cytolake-", ignore_cleanup_errors=True))
        atexit.register(_OWN[0].cleanup)
    return "file://" + _OWN[0].name


_MADE: list[str] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def materialize(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Written to the shared folder as Parquet and read back: a lost executor costs no recomputation and the plan is cut."""
    spark = df.sparkSession
    path = path or fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, *paths: str) -> None:
    """Deletes folders below the shared one through Hadoop's file system, whatever store that is."""
    jvm = spark.sparkContext._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clean(spark: SparkSession) -> None:
    """Removes everything that this application has left in the shared folder."""
    drop(spark, shared_dir(spark))
    _MADE.clear()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Drops the intermediate tables made inside at its end. What is written inside under a path from :func:`fresh_path` taken before stays; frames that read the dropped ones are of no use after."""
    at = len(_MADE)
    yield
    drop(spark, *_MADE[at:])
    del _MADE[at:]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shards(rows: int, per_shard: int, least: int = 1) -> int:
    return max(least, -(-rows // per_shard))


def n_words(col) -> F.Column:
    """Words of a text, on the JVM."""
    return F.coalesce(F.regexp_count(col, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, in whatever case."""
    taken = {c.lower() for c in df.columns}
    name = f"__{name}"
    while any(c.startswith(name.lower()) for c in taken):
        name += "_"
    return name


def running(df: DataFrame, order: list[Column], sums: dict[str, Column], per_task: int = 1_000_000) -> DataFrame:
    """Adds exclusive running sums along a total order, in two levels: rows are range-partitioned, partitions summed, and each partition's start added to its own sums.
    At most ``per_task`` rows are one level in one task."""
    n = shards(df.count(), per_task)
    if n == 1:
        one = W.partitionBy(F.lit(0)).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)  # at most per_task rows
        return df.select("*", *[F.coalesce(F.sum(c.cast("long")).over(one), F.lit(0)).alias(name) for name, c in sums.items()])
    dealt = df.repartitionByRange(n, *order)
    dealt = materialize(dealt.select("*", F.spark_partition_id().alias("_part"), *[c.cast("long").alias(f"_s{k}") for k, c in enumerate(sums.values())]), "running-dealt")
    parts = dealt.groupBy("_part").agg(*[F.sum(f"_s{k}").alias(f"_t{k}") for k in range(len(sums))])
    before = W.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # a row a task
    parts = parts.select(F.col("_part").alias("_p"), *[F.coalesce(F.sum(f"_t{k}").over(before), F.lit(0)).alias(f"_t{k}") for k in range(len(sums))])
    own = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    got = dealt.join(F.broadcast(parts), F.col("_part") == F.col("_p"))
    return got.select(*df.columns, *[(F.col(f"_t{k}") + F.coalesce(F.sum(f"_s{k}").over(own), F.lit(0))).alias(name) for k, name in enumerate(sums)])

"""Operator 10: token counts from flat, unindexed token files by a separator scan.

A token file is nothing but unsigned little-endian ids, each document ended by a separator id. Files are read in blocks of fixed
size by as many tasks as there are blocks; in each block the separators are found by one vectorised comparison. A document that crosses blocks is stitched by
a prefix scan over the blocks' summaries (how many separators, where the last one was): an exclusive sum numbers the documents, an
exclusive maximum tells where the first document of a block began. Only separators and summaries are shuffled.

:func:`write` makes such files from documents, for the query: each task tokenises its rows and writes files below the shared folder, under
names of its attempt. What it returns (file, number, id) is used after the scan to name the documents.

Defined results: a null or empty text has no tokens and its separator alone. Tokens after a file's last separator are a document that is not closed. Bytes short
of a whole id at a file's end are left out. Repeated rows and equal ids count each. An empty table gives an empty result; an empty file has no documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import files, tokens
from .common import fresh_path, materialize, prepare

#: Ids are 16 bits wide where the vocabulary allows it, and so are the files.
WIDTH = 2
SEPARATOR = 50_256
BLOCK_BYTES = 8 << 20
FILE_BYTES = 1 << 30


# -- writing -------------------------------------------------------------------------------------------------------


def write(docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text", path: str | None = None, separator: int = SEPARATOR, width: int = WIDTH, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes token files below ``folder``; returns (file, number, doc_id): the documents of each file in order. A vocabulary that ``width`` bytes cannot hold is an error."""
    prepare(docs.sparkSession)
    path = path or tokens.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = files.system(folder)
        fs.create_dir(base, recursive=True)
        encoder = tokens.encoder(path)
        if max(encoder.size, separator + 1) > 1 << 8 * width:
            raise ValueError(f"ids up to {max(encoder.size - 1, separator)} do not fit into {width} bytes")
        kind, tail = np.dtype(f"<u{width}"), np.array([separator], f"<u{width}")
        out, name, number, size, count = None, "", 0, 0, 0
        for b in batches:
            names, numbers = [], []
            for t in b.column(1).to_pylist():
                if out is None or size >= file_bytes:
                    if out is not None:
                        out.close()
                    name = files.attempt_path(folder, "tokens", count, ".bin")
                    out, number, size, count = fs.open_output_stream(files.system(name)[1], compression=None), 0, 0, count + 1
                ids = np.concatenate([encoder.ordinary(t).astype(kind), tail])  # a separator's string in a text is ordinary text
                out.write(ids.tobytes())
                names.append(name)
                numbers.append(number)
                number, size = number + 1, size + len(ids) * width
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(numbers, pa.int64()), b.column(0)], names=["file", "number", "doc_id"])
        if out is not None:
            out.close()

    some = docs.select(doc_id, text)
    return materialize(some.mapInArrow(run, f"file string, number long, doc_id {some.schema[doc_id].dataType.simpleString()}"), "token-files")


# -- scanning ------------------------------------------------------------------------------------------------------


def block_table(names: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, block, start, n): all blocks of all files given by (file); start and n count ids."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column(0).to_pylist()
            n = []
            for f in at:
                fs, path = files.system(f)
                n.append(fs.get_file_info(path).size // width)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["file", "ids"])

    each = block_bytes // width
    rows = names.select("file").distinct().mapInArrow(sizes, "file string, ids long").where("ids > 0")
    rows = rows.select("file", "ids", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("ids") - 1) / each))).alias("block"))
    return rows.select("file", "block", (F.col("block") * each).alias("start"), F.least(F.lit(each), F.col("ids") - F.col("block") * each).alias("n"))


def scan_blocks(blocks: DataFrame, separator: int = SEPARATOR, width: int = WIDTH) -> DataFrame:
    """(file, block, k, at): place of each block's k-th separator in the file, and a row with k = -1: the number of separators
    in ``at``, the last one's place in ``last`` and the block's end in ``edge``."""
    schema = "file string, block long, k long, at long, last long, edge long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = np.dtype({2: "<u2", 4: "<u4"}[width])
        for b in batches:
            for f, block, start, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                fs, path = files.system(f)
                with fs.open_input_file(path) as source:
                    ids = np.frombuffer(source.read_at(n * width, start * width), kind)
                at = np.flatnonzero(ids == separator) + start
                m = len(at)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([f] * (m + 1), pa.string()),
                        pa.array(np.full(m + 1, block)),
                        pa.array(np.arange(-1, m)),
                        pa.array(np.r_[m, at]),
                        pa.array([int(at[-1]) if m else None] + [None] * m, pa.int64()),
                        pa.array([start + n] + [None] * m, pa.int64()),
                    ],
                    names=["file", "block", "k", "at", "last", "edge"],
                )

    n = max(1, min(blocks.count(), 20_000))
    return blocks.repartition(n, "file", "block").mapInArrow(run, schema)


def documents(names: DataFrame, separator: int = SEPARATOR, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, number, start, n_tokens, closed) of every document in the files given by (file)."""
    prepare(names.sparkSession)
    found = materialize(scan_blocks(materialize(block_table(names, width, block_bytes), "token-blocks"), separator, width), "token-separators")
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy("file")
    sums = found.where("k = -1").select(
        "file", "block",
        F.coalesce(F.sum("at").over(before), F.lit(0)).alias("first"),
        F.coalesce(F.max("last").over(before), F.lit(-1)).alias("carry"),
        F.sum("at").over(whole).alias("closed_ones"), F.coalesce(F.max("last").over(whole), F.lit(-1)).alias("final"), F.max("edge").over(whole).alias("ids"),
        (F.col("block") == F.max("block").over(whole)).alias("is_last"),
    )
    sums = materialize(sums, "token-prefix")
    at = found.where("k >= 0").select("file", "block", "k", "at")
    lag = F.lag("at").over(W.partitionBy("file", "block").orderBy("k"))
    inside = at.withColumn("previous", lag).join(sums.select("file", "block", "first", "carry"), ["file", "block"])
    start = F.coalesce("previous", "carry") + 1
    closed = inside.select("file", (F.col("first") + F.col("k")).alias("number"), start.alias("start"), (F.col("at") - start).alias("n_tokens"), F.lit(True).alias("closed"))
    rest = sums.where(F.col("is_last") & (F.col("final") + 1 < F.col("ids"))).select("file", F.col("closed_ones").alias("number"), (F.col("final") + 1).alias("start"), (F.col("ids") - F.col("final") - 1).alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionByName(rest)


def count_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, number, start, n_tokens) of every row: written to token files, counted by the scan alone."""
    written = write(docs, fresh_path(docs.sparkSession, "tokens"), doc_id, text, path)
    counted = documents(written.select("file"))
    return written.join(counted, ["file", "number"]).select("doc_id", "number", "start", "n_tokens")

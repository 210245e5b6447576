"""Operator 8: best-fit packing of tokenised documents into sequences by the sum-of-squares rule.

A document is its token ids and the end id. Only a document longer than a sequence is cut: all its pieces but the first fill a
sequence each, so the first is the only one that has to be placed. Placement keeps, for each residual gap, the number of open
sequences N(gap); a piece goes into the open sequence with which the sum of N(gap) squared over all gaps becomes smallest. A new
sequence is no choice of the rule: it is opened where no open one has room. Pieces
are placed from long to short, which lets the short ones close what the long ones left open.

Only (document, lengths, checksums) is shuffled, never text or ids. Pieces are dealt to shards of about SHARD pieces by a
hash of document and row, and each shard is packed by itself: a shard loses at most its last open sequences.

Defined results: a null or empty text is the end id alone. Repeated rows and equal ids are packed once for each row. An empty
table gives an empty result. Columns other than the id and the text are not read by :func:`pack`.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import materialize, prepare, shards

SEQUENCE, END_ID = 2048, 0
#: Pieces of a shard: enough that the shard's last open sequences do not count, few enough for one short task.
SHARD = 100_000


def pieces(n: int, size: int = SEQUENCE) -> list[tuple[int, int]]:
    """(start, length) of each piece of n tokens; the first takes what whole sequences leave over."""
    if n <= size:
        return [(0, n)]
    first = n % size or size
    return [(0, first), *((k, size) for k in range(first, n, size))]


def cut(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, size: int = SEQUENCE, end: int = END_ID) -> DataFrame:
    """(doc_id, row, piece, start, length, ids_crc32): all pieces of all documents; row tells apart rows of equal ids."""
    prepare(docs.sparkSession)
    path = path or tokens.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(path).encode
        tail = np.array([end], "<u4").tobytes()
        for b in batches:
            place, out = [], []
            for k, t in enumerate(b.column(2).to_pylist()):
                ids = encode(t) + tail
                for piece, (start, length) in enumerate(pieces(len(ids) // 4, size)):
                    place.append(k)
                    out.append((piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
            at = pa.array(place, pa.int64())
            cols = zip(*out, strict=True) if out else ([], [], [], [])
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), *(pa.array(c, kind) for c, kind in zip(cols, kinds, strict=True))], names=["doc_id", "row", "piece", "start", "length", "ids_crc32"])

    some = docs.select(F.col(doc_id).alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text).alias("text"))
    return some.mapInArrow(run, f"doc_id {some.schema['doc_id'].dataType.simpleString()}, row long, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(lengths: np.ndarray, size: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset for each length, in the order given.

    Moving a piece from gap g to gap g - n changes the sum of squares by 2 * (N(g-n) - N(g)) + 2, less one where g = n, since
    a full sequence adds no square. The least change wins, then the smallest gap. A sequence is opened only if none open has
    room: as pieces come from long to short, this leaves fewer open at the end than opening by the same rule would.
    """
    count = np.zeros(size + 1, np.int64)  # open sequences by gap; index 0 (full) stays 0
    stacks: list[list[int]] = [[] for _ in range(size + 1)]
    used: list[int] = []
    seq, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for k, n in enumerate(lengths.tolist()):
        best, here = 0, count[n:size]
        if here.any():
            change = np.where(here > 0, 2 * (count[: size - n] - here) + 2, np.iinfo(np.int64).max)
            change[0] -= here[0] > 0
            best = int(change.argmin()) + n
            s = stacks[best].pop()
            count[best] -= 1
        else:
            s, best = len(used), size
            used.append(0)
        seq[k], offset[k] = s, used[s]
        used[s] += n
        if best > n:
            stacks[best - n].append(s)
            count[best - n] += 1
    return seq, offset


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, size: int = SEQUENCE, end: int = END_ID, shard: int = SHARD) -> DataFrame:
    """One row per piece: doc_id, row, piece, start, length, ids_crc32, sequence_id, offset."""
    return place(materialize(cut(docs, doc_id, text, path, size, end), "pieces"), size, shard)


def place(cuts: DataFrame, size: int = SEQUENCE, shard: int = SHARD) -> DataFrame:
    """Packs the pieces of :func:`cut`, which must be a written table."""
    n = shards(cuts.count(), shard)
    dealt = cuts.withColumn("shard", F.pmod(F.xxhash64("doc_id", "row", "piece"), F.lit(n)).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts = None, []

        def close() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(parts)
            seq, offset = sum_of_squares(rows.column("length").to_numpy(), size)
            rows = rows.drop_columns(["shard"]).append_column("sequence_id", pa.array(seq + (np.int64(key) << 32))).append_column("offset", pa.array(offset))
            yield from rows.to_batches()

        for b in batches:
            of = b.column("shard").to_numpy()
            edges = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1), len(of)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if hi > lo:
                    if of[lo] != key:
                        if parts:
                            yield from close()
                        key, parts = int(of[lo]), []
                    parts.append(b.slice(lo, hi - lo))
        if parts:
            yield from close()

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cuts.schema)
    ordered = dealt.repartitionByRange(n, "shard").sortWithinPartitions("shard", F.desc("length"), "doc_id", "row", "piece")
    return ordered.mapInArrow(run, kinds + ", sequence_id long, offset long")

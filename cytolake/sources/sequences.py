"""FASTQ and FASTA as Spark data sources, split anywhere: no line of text is shuffled, and a contig is read by as many tasks as it has splits.

A FASTQ record belongs to the split in which its first byte lies. The first one of a split is told by two lines: one that begins with "@" and, two lines on, one that begins with "+". A quality line may begin with "@",
but the line two behind it is a sequence, which never begins with "+". Ordinals are a record's place in its split and the records of all splits before, which are counted in a scan of their own that gives a row a split.

FASTA is read in pieces of ``piece`` bases with ``flank`` more on both sides, which :func:`cytolake.sources.genome.blocks` cuts further. A first scan gives a row a split (the bases before its first header, its last
header and the bases behind it); their running sums tell each split in which contig and at which base it begins. That table is written, so that a second scan, or a task that is run again, reads the same places. A piece
belongs to the split that has its first base. A contig may be one line; a header has 64 kB at most.

Compressed files are one split each.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import store
from .bam import _uri

#: Bytes of a split, and of what is read at a time.
SPLIT, CHUNK = 64 << 20, 1 << 20
#: Least bytes read at a time, bytes read behind a split for its last record, and tasks that small splits are dealt to.
LEAST, LINE, TASKS = 1 << 16, 1 << 12, 96
#: Bases of a piece, and beside it. Blocks of a size that divides a piece can be cut from it.
PIECE, FLANK = 1_638_400, 1 << 14
HEADER = 1 << 16
CODECS = {".gz": "gzip", ".bgz": "gzip", ".bz2": "bz2", ".zst": "zstd"}
_BLANK = b" \t\r\n\v\f"


class Part(InputPartition):
    """Bytes ``start`` to ``end`` of a file; ``chrom`` and ``before`` are the contig at ``start`` and how many of its bases lie before."""

    def __init__(self, uri: str, file: int, split: int, start: int, end: int, codec: str | None):
        self.uri, self.file, self.split, self.start, self.end, self.codec = uri, file, split, start, end, codec
        self.chrom, self.before = None, 0


def parts(uri: str, split: int) -> list[Part]:
    """The splits of a file, or of the files of a folder in the order of their names; those that begin with "." or "_" are none."""
    fs, path = pafs.FileSystem.from_uri(uri)
    scheme = uri[: len(uri) - len(path)] if uri.endswith(path) else uri.partition("://")[0] + "://"
    info = fs.get_file_info(path)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(uri)
    found = [info] if info.type == pafs.FileType.File else sorted((x for x in fs.get_file_info(pafs.FileSelector(path)) if x.type == pafs.FileType.File and x.base_name[0] not in "._"), key=lambda x: x.path)
    out = []
    for k, x in enumerate(found):
        codec = next((c for end, c in CODECS.items() if x.path.endswith(end)), None)
        step = max(1, x.size) if codec else split
        out += [Part(scheme + x.path, k, s, at, 1 << 62 if codec else min(at + step, x.size), codec) for s, at in enumerate(range(0, x.size, step))]
    return out


class Parts(InputPartition):
    """Splits that one task reads, one behind the other. A split of a few kilobytes costs less than the task that reads it."""

    def __init__(self, parts: list[Part]):
        self.parts = parts


def grouped(found: list[Part]) -> list[Parts]:
    """Splits in their order, dealt to tasks: at least ``TASKS`` if there are so many splits, and of no more than ``SPLIT`` bytes unless one split has more. A compressed file is a task's only split."""
    size = min(SPLIT, max(1, -(-sum(p.end - p.start for p in found if p.codec is None) // TASKS)))
    out, held = [], 0
    for p in found:
        n = p.end - p.start
        if p.codec or not out or held + n > size or out[-1].parts[-1].codec:
            out.append(Parts([]))
            held = 0
        out[-1].parts.append(p)
        held += n
    return out


def chunks(part: Part, at: int) -> Iterator[bytes]:
    """The file's bytes from a place on, little more than the split's own at first."""
    fs, path = pafs.FileSystem.from_uri(part.uri)
    if part.codec:
        with fs.open_input_stream(path, compression=part.codec) as f:
            while got := f.read(CHUNK):
                yield got
        return
    with fs.open_input_file(path) as f:
        f.seek(at)
        size = LEAST
        while got := f.read(size := min(CHUNK, max(LEAST, part.end - at + LINE) if at < part.end else 2 * size)):
            at += len(got)
            yield got


# -- FASTQ -----------------------------------------------------------------------------------------------------------


def _begins(lines: list[bytes]) -> int | None:
    """Which of the lines is a record's first one, if they tell."""
    return next((k for k in range(min(4, len(lines) - 2)) if lines[k][:1] == b"@" and lines[k + 2][:1] == b"+"), None)


def records(part: Part) -> Iterator[list[bytes]]:
    """Lines of the split's records, four a record."""
    # from the byte before, so that a split that begins with a line has it
    at = part.start - 1 if part.start else 0
    held, lines, synced = b"", [], part.start == 0
    skip = not synced
    for piece in chunks_then_end(part, at):
        held = held + piece if piece is not None else held
        *new, rest = held.split(b"\n")
        if piece is None and rest:
            new, rest = [*new, rest], b""
        held = rest
        if skip:
            if not new:
                continue
            at, new, skip = at + len(new[0]) + 1, new[1:], False
        lines += new
        if not synced:
            if len(lines) < 6 and piece is not None:
                continue
            k = _begins(lines)
            if k is None:
                if any(x.strip() for x in lines[4:]):
                    raise ValueError(f"{part.uri}: no record in the lines from byte {at} on")
                if piece is None:  # the end of the last record, and blank lines
                    return
                continue
            at, lines, synced = at + sum(len(x) + 1 for x in lines[:k]), lines[k:], True
        if at >= part.end:
            return
        if piece is None:
            lines = _tail(part, lines)
        n = len(lines) // 4 * 4
        while n and not any(x.strip() for x in lines[n - 4 : n]):  # blank lines may be the file's last ones
            n -= 4
        size = sum(map(len, lines[:n])) + n
        if at + size > part.end:  # some may belong to the next split
            to = at
            for k in range(0, n, 4):
                if to >= part.end:
                    n, size = k, to - at
                    break
                to += sum(map(len, lines[k : k + 4])) + 4
        own = [x.rstrip(b"\r") for x in lines[:n]]
        for k in range(0, n, 4):
            if own[k][:1] != b"@" or own[k + 2][:1] != b"+" or len(own[k + 1]) != len(own[k + 3]):
                raise ValueError(f"{part.uri}: no record of four lines at {own[k][:80]!r}")
        if own:
            yield own
        at, lines = at + size, lines[n:]
        if at >= part.end:
            return


def chunks_then_end(part: Part, at: int) -> Iterator[bytes | None]:
    yield from chunks(part, at)
    yield None


def _tail(part: Part, lines: list[bytes]) -> list[bytes]:
    """The last lines of a file: blank ones behind the last record are none, an empty read may lack its empty quality."""
    whole = list(lines)
    while whole and len(whole) % 4 and not whole[-1].strip():
        whole.pop()
    if len(whole) % 4 == 3 and whole[-1][:1] == b"+" and not whole[-2].strip():
        whole.append(b"")
    while len(whole) >= 4 and not any(x.strip() for x in whole[-4:]):
        del whole[-4:]
    if len(whole) % 4:
        raise ValueError(f"{part.uri}: the last record is cut off")
    return whole


class FastqSource(DataSource):
    """``format("cytolake_fastq")``: options path, split, and count for a row a split."""

    @classmethod
    def name(cls) -> str:
        return "cytolake_fastq"

    def schema(self) -> str:
        return "file int, split int, n long" if self.options.get("count") else "file int, split int, k long, head string, seq string, qual string"

    def reader(self, schema) -> DataSourceReader:
        return FastqReader(self.options)


class FastqReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.split, self.count = options["path"], int(options.get("split", SPLIT)), bool(options.get("count"))

    def partitions(self) -> list[Parts]:
        return grouped(parts(self.path, self.split))

    def read(self, some: Parts | None) -> Iterator[pa.RecordBatch]:
        for part in some.parts if some is not None else ():
            yield from self._read(part)

    def _read(self, part: Part) -> Iterator[pa.RecordBatch]:
        own, k = lambda n: [pa.array([part.file] * n, pa.int32()), pa.array([part.split] * n, pa.int32())], 0
        for lines in records(part):
            n = len(lines) // 4
            if not self.count:
                texts = [pa.array(lines[j::4], pa.binary()).cast(pa.string()) for j in (0, 1, 3)]
                yield pa.RecordBatch.from_arrays([*own(n), pa.array(range(k, k + n), pa.int64()), *texts], names=["file", "split", "k", "head", "seq", "qual"])
            k += n
        if self.count:
            yield pa.RecordBatch.from_arrays([*own(1), pa.array([k], pa.int64())], names=["file", "split", "n"])


def fastq(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """(ord, name, comment, seq, qual) of a file, or of the files of a folder one behind the other; ord counts from 0 without a gap. A record of other than four lines, or with a quality of another length, is an error."""
    spark.dataSource.register(FastqSource)
    scan = spark.read.format("cytolake_fastq").option("path", _uri(spark, path)).option("split", split)
    before = W.partitionBy(F.lit(0)).orderBy("file", "split").rowsBetween(W.unboundedPreceding, -1)  # a row a split
    starts = scan.option("count", 1).load().select("file", "split", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    rows = spark.read.format("cytolake_fastq").option("path", _uri(spark, path)).option("split", split).load()
    name = F.regexp_replace(F.regexp_extract("head", r"^@(\S*)", 1), r"/[0-9]$", "")
    rows = rows.join(F.broadcast(starts), ["file", "split"])
    return rows.select((F.col("_before") + F.col("k")).alias("ord"), name.alias("name"), F.trim(F.regexp_extract("head", r"^@\S*\s*(.*)$", 1)).alias("comment"), "seq", "qual")


# -- FASTA -----------------------------------------------------------------------------------------------------------


def _behind(part: Part, at: int) -> bytes:
    """The bytes before a place that tell whether it lies in a header."""
    fs, path = pafs.FileSystem.from_uri(part.uri)
    with fs.open_input_file(path) as f:
        return f.read_at(min(at, HEADER), at - min(at, HEADER))


def runs(part: Part, start: int, end: int) -> Iterator[tuple[str | None, bytes]]:
    """(name, b"") of each header that begins between two places, and (None, bases) of the bases between them."""
    fresh = True  # at the beginning of a line
    inside = None  # what is known of the header that the place is in
    if start:
        back = _behind(part, start)
        cut = back.rfind(b"\n")
        fresh = cut == len(back) - 1
        if not fresh and (cut >= 0 or start <= HEADER) and back[cut + 1 : cut + 2] == b">":
            inside = b""
    told = inside is not None  # the split before has that header
    at = start
    for piece in chunks(part, start):
        k = 0
        while k < len(piece):
            if inside is not None:
                to = piece.find(b"\n", k)
                inside += piece[k : to if to >= 0 else len(piece)]
                if len(inside) > HEADER:
                    raise ValueError(f"{part.uri}: a header of more than {HEADER} bytes")
                if to < 0:
                    break
                if not told:
                    yield (inside.split(None, 1) or [b""])[0].decode() if inside[:1].strip() else "", b""
                inside, told, fresh, k = None, False, True, to + 1
                continue
            if at + k >= end:
                return
            if fresh and piece[k : k + 1] == b">":
                inside, k = b"", k + 1
                continue
            to = piece.find(b"\n>", k)
            stop = min(len(piece) if to < 0 else to + 1, end - at)
            yield None, piece[k:stop].translate(None, _BLANK).upper()
            fresh, k = piece[stop - 1 : stop] == b"\n", stop
        at += len(piece)
        if inside is None and at >= end:
            return
    if inside is not None and not told:
        yield (inside.split(None, 1) or [b""])[0].decode() if inside[:1].strip() else "", b""


def bases_before(part: Part, n: int) -> bytes:
    """The last n bases before a split, all of the contig in which it begins."""
    fs, path = pafs.FileSystem.from_uri(part.uri)
    with fs.open_input_file(path) as f:
        size = n + HEADER
        while True:
            size = min(size, part.start)
            raw = f.read_at(size, part.start - size)
            cut = raw.rfind(b"\n")
            if raw[cut + 1 : cut + 2] == b">":  # the split begins inside a header
                return b""
            got = raw.translate(None, _BLANK).upper()
            if len(got) >= n or size == part.start:
                return got[len(got) - n :] if n else b""
            size *= 2


class FastaSource(DataSource):
    """``format("cytolake_fasta")``: options path, split, and either piece, flank and starts (the written table of the splits' beginnings), or nothing more for a row a split."""

    @classmethod
    def name(cls) -> str:
        return "cytolake_fasta"

    def schema(self) -> str:
        return "chrom string, beg1 int, left string, seq string, right string" if self.options.get("starts") else "file int, split int, lead long, last string, tail long"

    def reader(self, schema) -> DataSourceReader:
        return FastaReader(self.options)


class FastaReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.split, self.starts = options["path"], int(options.get("split", SPLIT)), options.get("starts")
        self.piece, self.flank = int(options.get("piece", PIECE)), int(options.get("flank", FLANK))

    def partitions(self) -> list[Parts]:
        out = parts(self.path, self.split)
        if self.starts:
            fs, path = pafs.FileSystem.from_uri(self.starts)
            at = {(r["file"], r["split"]): r for r in pq.read_table(path, filesystem=fs).to_pylist()}  # a row a split
            for p in out:
                p.chrom, p.before = at[p.file, p.split]["chrom"], at[p.file, p.split]["before"]
        return grouped(out)

    def read(self, some: Parts | None) -> Iterator[pa.RecordBatch]:
        for part in some.parts if some is not None else ():
            yield from self._batches(self._pieces(part)) if self.starts else self._sums(part)

    @staticmethod
    def _batches(pieces: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        """Pieces put together, about a megabyte at a time."""
        kinds, names, held, size = (pa.string(), pa.int32(), *[pa.string()] * 3), ["chrom", "beg1", "left", "seq", "right"], [], 0
        put = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
        for x in pieces:
            held.append(x)
            size += sum(map(len, x[2:]))
            if size >= CHUNK:
                yield put()
                held, size = [], 0
        if held:
            yield put()

    @staticmethod
    def _sums(part: Part) -> Iterator[pa.RecordBatch]:
        lead, last, tail = 0, None, 0
        for name, own in runs(part, part.start, part.end):
            if name is not None:
                last, tail = name, 0
            elif last is None:
                lead += len(own)
            else:
                tail += len(own)
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((part.file, part.split, lead, last, tail), kinds, strict=True)], names=["file", "split", "lead", "last", "tail"])

    def _pieces(self, part: Part) -> Iterator[tuple[str, int, str, str, str]]:
        size, flank = self.piece, self.flank
        chrom, low = part.chrom, part.before
        held = bytearray(bases_before(part, min(flank, low)) if chrom is not None and low else b"")
        base = low - len(held)  # the place of held's first base in its contig
        at = -(-low // size) * size  # the next piece's first base

        def cut(last: bool, high: int) -> Iterator[tuple[str, int, str, str, str]]:
            """Pieces that begin before ``high`` and are whole, or all of them at a contig's end."""
            nonlocal at, base
            while chrom and at < high and (last or at + size + flank <= base + len(held)):
                k = at - base
                texts = (held[max(0, k - flank) : k], held[k : k + size], held[k + size : k + size + flank])
                yield chrom, at + 1, *(x.decode("ascii") for x in texts)
                at += size
            if (spare := max(0, min(at, base + len(held)) - flank - base)) > 0:
                del held[:spare]
                base += spare

        for name, own in runs(part, part.start, part.end):
            if name is not None:
                yield from cut(True, base + len(held))
                chrom, base, at = name, 0, 0
                held.clear()
            elif chrom:
                held += own
                yield from cut(False, base + len(held))
        high = base + len(held)
        if chrom and at < high and part.codec is None:
            for name, own in runs(part, part.end, 1 << 62):
                if name is not None:
                    break
                held += own
                yield from cut(False, high)
                if at >= high:
                    return
        yield from cut(True, high)


def fasta(spark: SparkSession, path: str, split: int = SPLIT, piece: int = PIECE, flank: int = FLANK) -> DataFrame:
    """(chrom, beg1, left, seq, right): the contigs of a file, or of the files of a folder, in pieces of ``piece`` bases (fewer at a contig's end) with the ``flank`` bases on both sides, which are fewer at its ends.
    Bases are upper-cased, the name ends at the first white space; what lies before a file's first header, and contigs without a name, are left out."""
    if not 0 < flank <= piece:
        raise ValueError("a flank must be at least 1 and no longer than a piece")
    spark.dataSource.register(FastaSource)
    scan = lambda: spark.read.format("cytolake_fasta").option("path", _uri(spark, path)).option("split", split)
    own = W.partitionBy("file").orderBy("split")  # a row a split
    runs_ = scan().load().withColumn("_run", F.count("last").over(own))  # splits since the same header, that of its own among them
    bases = F.sum(F.when(F.col("last").isNull(), F.col("lead")).otherwise(F.col("tail"))).over(W.partitionBy("file", "_run").orderBy("split"))
    ended = runs_.withColumn("_chrom", F.last("last", ignorenulls=True).over(own)).withColumn("_bases", bases)
    starts = ended.select("file", "split", F.lag("_chrom").over(own).alias("chrom"), F.coalesce(F.lag("_bases").over(own), F.lit(0)).alias("before"))
    at = store.fresh(spark, "fasta-starts")
    starts.coalesce(1).write.parquet(at)
    return scan().option("starts", _uri(spark, at)).option("piece", piece).option("flank", flank).load()

"""BAM files as a Spark data source, split anywhere, with a linear index for regions.

A file is cut into splits of compressed bytes. In each, the next compressed block is looked for (its header, that it unpacks, and that another follows it), and in what it unpacks to the first place from which sound
records follow one another. A record belongs to the split in which the block of its first byte begins, so every split size gives the same rows. ``rid`` is made of the file's number, the block's place and the record's
place in it, and does not depend on splits either; it is unique within a sample (operators tell reads apart by sample and number).

Written files are sorted within themselves if the rows are. A sorted one has an index beside it: for every 16,384 bases of a contig, the place of the first record that overlaps them or begins behind. A region's splits begin
and end there; a file without an index is read whole. Files get their names when all tasks have ended well, so a task that is run again leaves nothing twice.
"""

from __future__ import annotations

import json
import struct
import tempfile
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Compressed bytes of a split; bytes of a block before compression; bases of an entry of the index.
SPLIT, BLOCK, WINDOW = 64 << 20, 0xFF00, 1 << 14
INDEX = ".lidx"
ROWS = 4096
#: So many sound records in a row, or the end of the file, tell that the first one is one.
SOUND = 8

SCHEMA = (
    "sid int, rid long, qname string, flag int, chrom string, pos1 int, mapq int, cigar string, mchrom string, mpos1 int, isize int, seq string, qual string, "
    "NM int, AS int, MC string, MD string, YD string, ZS string, XG string, MM string, ML array<int>"
)
_NUMBERS, _TEXTS = ("NM", "AS"), ("MC", "MD", "YD", "ZS", "XG", "MM")
_ARROW = pa.schema([
    *((n, pa.int32() if k == "int" else pa.int64() if k == "long" else pa.list_(pa.int32()) if k == "array<int>" else pa.string()) for n, k in (x.split() for x in SCHEMA.split(", ")))
])

# Fixed values of the format.
MAGIC, EMPTY = b"BAM\1", bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
OPS = "MIDNSHP=X"
BASES = "=ACMGRSVTWYHKDBN"
_SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
_CODES = {"A": "c", "c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
_LETTERS = str.maketrans("0123456789abcdef", BASES)
_NIBBLES = str.maketrans(BASES, "0123456789abcdef")
_UP = bytes((q + 33) & 0xFF for q in range(256))
_DOWN = bytes((q - 33) & 0xFF for q in range(256))


# -- compressed blocks -----------------------------------------------------------------------------------------------


class File:
    """Random access to a file, in pieces that are read once while they are in turn."""

    def __init__(self, uri: str, piece: int = 1 << 20):
        self.fs, path = pafs.FileSystem.from_uri(uri)
        info = self.fs.get_file_info(path)
        self.length, self.changed = info.size, info.mtime_ns
        self.file, self.piece = self.fs.open_input_file(path), piece
        self.at, self.held, self.bytes_read = 0, b"", 0

    def read(self, start: int, n: int) -> bytes:
        if not (self.at <= start and start + n <= self.at + len(self.held)):
            self.at, self.held = start, self.file.read_at(max(n, self.piece), start)
            self.bytes_read += len(self.held)
        return self.held[start - self.at : start - self.at + n]


def block_at(f: File, at: int) -> tuple[bytes, int] | None:
    """What the block at a place unpacks to, and where the next one begins; None if there is no sound block."""
    head = f.read(at, 18)
    if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
        return None
    extra = struct.unpack_from("<H", head, 10)[0]
    fields, k, size = f.read(at + 12, extra), 0, None
    while k + 4 <= len(fields):
        n = struct.unpack_from("<H", fields, k + 2)[0]
        if fields[k : k + 2] == b"BC" and n == 2 and k + 6 <= len(fields):
            size = struct.unpack_from("<H", fields, k + 4)[0] + 1
        k += 4 + n
    if size is None or size < extra + 20:
        return None
    raw = f.read(at, size)
    if len(raw) < size:
        return None
    try:
        out = zlib.decompress(raw[12 + extra : size - 8], -15)
    except zlib.error:
        return None
    crc, n = struct.unpack_from("<II", raw, size - 8)
    return (out, at + size) if n == len(out) and crc == zlib.crc32(out) else None


def next_block(f: File, at: int, end: int) -> int | None:
    """The first place from ``at`` on and before ``end`` where a block begins."""
    while at < end:
        piece = f.read(at, min(1 << 16, f.length - at))
        k = piece.find(b"\x1f\x8b\x08\x04")
        if k < 0:
            at += max(1, len(piece) - 3)
            continue
        at += k
        if at < end and (found := block_at(f, at)) is not None and (found[1] >= f.length or block_at(f, found[1]) is not None):
            return at
        at += 1
    return None


def packed(raw: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(raw) + z.flush()
    return struct.pack("<BBBBIBBHBBHH", 0x1F, 0x8B, 8, 4, 0, 0, 0xFF, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(raw), len(raw))


class Stream:
    """The unpacked bytes from a block on, with the block of each place."""

    def __init__(self, f: File, at: int):
        self.f, self.next, self.data, self.starts = f, at, bytearray(), []  # starts: (place in data, block)
        self.base = 0  # bytes that were dropped before data

    def fill(self, upto: int) -> bool:
        """Whether bytes up to a place are there."""
        while self.base + len(self.data) < upto and self.next < self.f.length:
            found = block_at(self.f, self.next)
            if found is None:
                raise ValueError(f"no block at byte {self.next}")
            if found[0]:
                self.starts.append((self.base + len(self.data), self.next))
            self.data += found[0]
            self.next = found[1]
        return self.base + len(self.data) >= upto

    def get(self, at: int, n: int) -> bytes:
        return bytes(self.data[at - self.base : at - self.base + n])

    def block(self, at: int) -> tuple[int, int]:
        """The block in which a place lies, and where in it."""
        while len(self.starts) > 1 and self.starts[1][0] <= at:
            self.starts.pop(0)
        return self.starts[0][1], at - self.starts[0][0]

    def drop(self, at: int) -> None:
        if at - self.base > 1 << 20:
            del self.data[: at - self.base]
            self.base = at


# -- records ---------------------------------------------------------------------------------------------------------


def header(f: File) -> tuple[str, list[tuple[str, int]], int, int]:
    """The header's text, (name, length) of the contigs, and the block and the place in it of the first record."""
    s = Stream(f, 0)
    if not s.fill(8) or s.get(0, 4) != MAGIC:
        raise ValueError("not a BAM file")
    n = struct.unpack("<i", s.get(4, 4))[0]
    s.fill(12 + n)
    text, at = s.get(8, n).rstrip(b"\0").decode(), 12 + n
    contigs = []
    for _ in range(struct.unpack("<i", s.get(8 + n, 4))[0]):
        s.fill(at + 4)
        k = struct.unpack("<i", s.get(at, 4))[0]
        s.fill(at + 8 + k)
        contigs.append((s.get(at + 4, k - 1).decode(), struct.unpack("<i", s.get(at + 4 + k, 4))[0]))
        at += 8 + k
    if not s.fill(at + 1):
        return text, contigs, f.length, 0
    return text, contigs, *s.block(at)


#: Headers of files that this process read last, by place, length and time; a file's splits share one.
_HEADERS: OrderedDict[tuple[str, int, int | None], tuple[str, list[tuple[str, int]], int, int]] = OrderedDict()


def known_header(uri: str, f: File) -> tuple[str, list[tuple[str, int]], int, int]:
    key = (uri, f.length, f.changed)
    if key not in _HEADERS:
        _HEADERS[key] = header(f)
        while len(_HEADERS) > 4:
            _HEADERS.popitem(last=False)
    return _HEADERS[key]


def _sound(s: Stream, at: int, contigs: list[tuple[str, int]]) -> int | None:
    """Where the record at a place ends, if its fields agree with one another."""
    if not s.fill(at + 36):
        return None
    size, tid, pos, name, _, _, ops, _, length, mtid, mpos, _ = struct.unpack("<iiiBBHHHiiii", s.get(at, 36))
    # a place without a contig (a mate's, where only the place is told) has no bound
    fits = lambda c, at: -1 <= c < len(contigs) and at >= -1 and (c < 0 or at <= contigs[c][1] + 1)
    if not (name > 0 and length >= 0 and fits(tid, pos) and fits(mtid, mpos)):
        return None
    if size < 32 + name + 4 * ops + (length + 1) // 2 + length or not s.fill(at + 36 + name + 4 * ops):
        return None
    text = s.get(at + 36, name)
    if text[-1] != 0 or not all(33 <= c <= 126 for c in text[:-1]):
        return None
    if any(x & 15 >= len(OPS) for x in struct.unpack(f"<{ops}I", s.get(at + 36 + name, 4 * ops))):
        return None
    return at + 4 + size


def first_record(s: Stream, contigs: list[tuple[str, int]], end: int) -> int | None:
    """The first place in the blocks before ``end`` from which sound records follow one another."""
    at = 0
    while s.fill(at + 1) and s.block(at)[0] < end:
        to, n = at, 0
        while n < SOUND and to is not None and s.fill(to + 1):
            to, n = _sound(s, to, contigs), n + 1
        if to is not None and s.fill(to):  # one that ends beyond the file is none
            return at
        at += 1
    return None


def _tags(raw: bytes) -> dict:
    out, k = {}, 0
    while k + 3 <= len(raw):
        name, kind = raw[k : k + 2].decode("ascii", "replace"), chr(raw[k + 2])
        k += 3
        if kind in "ZH":
            end = raw.index(b"\0", k)
            out[name], k = raw[k:end].decode("utf-8", "replace"), end + 1
        elif kind == "B":
            sub, n = chr(raw[k]), struct.unpack_from("<i", raw, k + 1)[0]
            out[name] = list(struct.unpack_from(f"<{n}{_CODES[sub]}", raw, k + 5))
            k += 5 + n * _SIZES[sub]
        elif kind == "A":
            out[name], k = chr(raw[k]), k + 1
        else:
            out[name], k = struct.unpack_from("<" + _CODES[kind], raw, k)[0], k + _SIZES[kind]
    return out


def decode(raw: bytes, contigs: list[tuple[str, int]], sid: int, rid: int) -> tuple:
    """A row of ``SCHEMA`` of a record without its size."""
    tid, pos, name, mapq, _, ops, flag, length, mtid, mpos, isize = struct.unpack_from("<iiBBHHHiiii", raw)
    k = 32 + name
    qname = raw[32 : k - 1].decode()
    cigar = "".join(f"{x >> 4}{OPS[x & 15]}" for x in struct.unpack_from(f"<{ops}I", raw, k)) or "*"
    k += 4 * ops
    seq = raw[k : k + (length + 1) // 2].hex().translate(_LETTERS)[:length] or "*"
    k += (length + 1) // 2
    qual = raw[k : k + length]
    qual = "*" if not length or qual[0] == 0xFF else qual.translate(_UP).decode("latin-1")
    tags = _tags(raw[k + length :])
    contig = lambda t: contigs[t][0] if t >= 0 else "*"
    return (
        sid, rid, qname, flag, contig(tid), pos + 1, mapq, cigar, contig(mtid), mpos + 1, isize, seq, qual,
        *(tags.get(n) if isinstance(tags.get(n), int) else None for n in _NUMBERS), *(tags.get(n) if isinstance(tags.get(n), str) else None for n in _TEXTS), tags.get("ML") if isinstance(tags.get("ML"), list) else None,
    )


def _bin(beg: int, end: int) -> int:
    """The number of the smallest of nested bins (16 kb to 512 Mb) that holds a span."""
    end -= 1
    for shift, first in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if beg >> shift == end >> shift:
            return first + (beg >> shift)
    return 0


def span_of(cigar: str | None) -> int:
    n, out = 0, 0
    for c in cigar if cigar and cigar != "*" else "":
        if c.isdigit():
            n = 10 * n + int(c)
        else:
            out, n = out + (n if c in "MDN=X" else 0), 0
    return out


def encode(row: dict, ids: dict[str, int]) -> bytes:
    """A record with its size."""
    tid, mtid = (ids.get(row.get(c) or "*", -1) for c in ("chrom", "mchrom"))
    pos, name = (row["pos1"] or 0) - 1, (row["qname"] or "*").encode() + b"\0"
    ops, n = [], 0
    for c in row["cigar"] if row["cigar"] and row["cigar"] != "*" else "":
        if c.isdigit():
            n = 10 * n + int(c)
        else:
            ops.append(n << 4 | OPS.index(c))
            n = 0
    seq = "" if row["seq"] in (None, "*") else row["seq"].upper()
    nibbles = bytes.fromhex("".join(c if c in BASES else "N" for c in seq).translate(_NIBBLES) + "0" * (len(seq) % 2))
    qual = b"\xff" * len(seq) if row["qual"] in (None, "*") else row["qual"].encode("latin-1").translate(_DOWN)
    if len(qual) != len(seq):
        raise ValueError(f"read {row['qname']}: {len(seq)} bases and {len(qual)} qualities")
    tags = b"".join(n.encode() + b"i" + struct.pack("<i", row[n]) for n in _NUMBERS if row.get(n) is not None)
    tags += b"".join(n.encode() + (b"A" + row[n].encode() if n == "YD" and len(row[n]) == 1 else b"Z" + row[n].encode() + b"\0") for n in _TEXTS if row.get(n) is not None)
    if row.get("ML") is not None:
        tags += b"MLBC" + struct.pack("<i", len(row["ML"])) + bytes(row["ML"])
    beg = max(pos, 0)
    body = struct.pack("<iiBBHHHiiii", tid, pos, len(name), row["mapq"] or 0, _bin(beg, beg + max(1, span_of(row["cigar"]))), len(ops), row["flag"] or 0, len(seq), mtid, (row["mpos1"] or 0) - 1, row["isize"] or 0)
    body += name + struct.pack(f"<{len(ops)}I", *ops) + nibbles + qual + tags
    return struct.pack("<i", len(body)) + body


# -- the data source -------------------------------------------------------------------------------------------------


class Split(InputPartition):
    def __init__(self, uri: str, file: int, start: int, end: int, first: tuple[int, int] | None):
        self.uri, self.file, self.start, self.end, self.first = uri, file, start, end, first


def _region(text: str) -> tuple[str, int, int]:
    from .text import parse_region

    chrom, beg, end = parse_region(text)
    return chrom, beg or 1, end or 1 << 31


class BamSource(DataSource):
    """``format("cytolake_bam")``: options path (a file or a folder of .bam files), sid, split, region; for writing level and contigs (JSON of names and lengths; without it a file has the contigs that its rows name, with their lengths in
    the columns _n and _mn)."""

    @classmethod
    def name(cls) -> str:
        return "cytolake_bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return BamReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return BamWriter(self.options)


class BamReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.sid, self.split = options["path"], int(options.get("sid", 0)), int(options.get("split", SPLIT))
        self.region = _region(options["region"]) if options.get("region") else None

    def partitions(self) -> list[Split]:
        fs, path = pafs.FileSystem.from_uri(self.path)
        info = fs.get_file_info(path)
        scheme = self.path[: len(self.path) - len(path)] if self.path.endswith(path) else self.path.partition("://")[0] + "://"
        found = [info] if info.type == pafs.FileType.File else sorted((x for x in fs.get_file_info(pafs.FileSelector(path)) if x.path.endswith(".bam")), key=lambda x: x.path)
        if len(found) > 1 << 12:
            raise ValueError("more than 4,096 files in one scan")
        out = []
        for k, x in enumerate(found):
            uri = scheme + x.path
            f = File(uri)
            _, contigs, block, within = header(f)
            beg, end = (block, within), f.length
            if self.region and (cut := self._bounds(fs, x.path, contigs)) is not None:
                if cut[0] is None:
                    continue
                beg, end = max(beg, cut[0]), min(end, cut[1])
            start = beg[0]
            while start < end:
                to = min(end, (start // self.split + 1) * self.split)
                out.append(Split(uri, k, start, to, beg if start == beg[0] else None))
                start = to
        return out

    def _bounds(self, fs, path: str, contigs: list[tuple[str, int]]) -> tuple[tuple[int, int] | None, int] | None:
        """The first record's place and the last byte that a region's records can begin at, from the index; None without one."""
        if fs.get_file_info(path + INDEX).type != pafs.FileType.File:
            return None
        with fs.open_input_stream(path + INDEX, compression=None) as f:
            index = json.loads(f.read())
        chrom, beg1, end1 = self.region
        own, first, last = index.get(chrom, []), (beg1 - 1) // WINDOW, (end1 - 1) // WINDOW
        if first >= len(own):
            return None, 0
        if last + 1 < len(own):
            stop = own[last + 1][0] + 1
        else:
            later = [index[c][0] for c, _ in contigs[[c for c, _ in contigs].index(chrom) + 1 :] if index.get(c)]
            stop = (min(later)[0] + 1) if later else 1 << 62
        return tuple(own[first]), stop

    def read(self, part: Split | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # no split at all
            return
        f = File(part.uri, min(1 << 20, max(1 << 16, self.split)))
        _, contigs, _, _ = known_header(part.uri, f)
        at_block = part.first[0] if part.first else next_block(f, part.start, part.end)
        if at_block is None:
            return
        s = Stream(f, at_block)
        at = part.first[1] if part.first else first_record(s, contigs, part.end)
        rows, of, number = [], -1, 0
        while at is not None and s.fill(at + 4):
            block, within = s.block(at)
            if block >= part.end:
                break
            size = struct.unpack("<i", s.get(at, 4))[0]
            if size < 32 or not s.fill(at + 4 + size):
                raise ValueError(f"{part.uri}: the record at byte {block} is cut off")
            # a record has 36 bytes or more, so 11 bits tell those of a block apart
            row = decode(s.get(at + 4, size), contigs, self.sid, part.file << 51 | block << 11 | within // 36)
            at += 4 + size
            s.drop(at)
            if self.region is None or self._wanted(row):
                rows.append(row)
            if len(rows) >= ROWS:
                yield self._batch(rows)
                rows = []
        if rows:
            yield self._batch(rows)

    def _wanted(self, row: tuple) -> bool:
        chrom, beg1, end1 = self.region
        return row[4] == chrom and row[5] <= end1 and row[5] + max(1, span_of(row[7])) - 1 >= beg1

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)


class Written(WriterCommitMessage):
    def __init__(self, paths: list[str]):
        self.paths = paths


class BamWriter(DataSourceArrowWriter):
    def __init__(self, options):
        self.path, self.contigs = options["path"], [tuple(x) for x in json.loads(options["contigs"])] if options.get("contigs") else None
        self.level, self.text = int(options.get("level", 6)), options.get("header")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        fs, path = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(path, recursive=True)
        out, index, place, held = None, {}, 0, bytearray()
        in_order, before = True, (0, 0)
        temp = f"{path}/.part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}"

        def flush(all_: bool) -> None:
            nonlocal place, held
            while len(held) >= BLOCK or (all_ and held):
                raw = packed(bytes(held[:BLOCK]), self.level)
                out.write(raw)
                del held[:BLOCK]
                place += len(raw)

        contigs, records = self._named(iterator) if self.contigs is not None else self._own(iterator)
        for raw in records:
            if out is None:
                out = fs.open_output_stream(temp, compression=None)
                text = (self.text or "@HD\tVN:1.6\tSO:unknown\n" + "".join(f"@SQ\tSN:{c}\tLN:{n}\n" for c, n in contigs)).encode()
                held += MAGIC + struct.pack("<i", len(text)) + text + struct.pack("<i", len(contigs))
                for c, n in contigs:
                    held += struct.pack("<i", len(c.encode()) + 1) + c.encode() + b"\0" + struct.pack("<i", n)
                flush(True)  # records begin with a block of their own
            tid, pos, name, _, _, ops = struct.unpack_from("<iiBBHH", raw, 4)
            spot = (tid if tid >= 0 else 1 << 31, pos)
            in_order, before = in_order and spot >= before, spot
            if tid >= 0:
                span = sum(x >> 4 for x in struct.unpack_from(f"<{ops}I", raw, 36 + name) if OPS[x & 15] in "MDN=X")
                own, last = index.setdefault(contigs[tid][0], []), (max(pos, 0) + max(1, span) - 1) // WINDOW
                while len(own) <= last:
                    own.append((place, len(held)))
            held += raw
            flush(False)
        if out is None:
            return Written([])
        flush(True)
        out.write(EMPTY)
        out.close()
        if in_order:
            with fs.open_output_stream(temp + INDEX, compression=None) as f:
                f.write(json.dumps(index).encode())
        return Written([temp])

    def _named(self, iterator: Iterator[pa.RecordBatch]) -> tuple[list[tuple[str, int]], Iterator[bytes]]:
        """The given contigs, and the records."""
        ids = {c: k for k, (c, _) in enumerate(self.contigs)}
        return self.contigs, (encode(row, ids) for batch in iterator for row in batch.to_pylist())

    def _own(self, iterator: Iterator[pa.RecordBatch]) -> tuple[list[tuple[str, int]], Iterator[bytes]]:
        """The contigs that the rows name, in order, and the records. A header comes before its records, so these are kept in a file of the task until all contigs are known."""
        ids, sizes, kept = {}, {}, tempfile.TemporaryFile()
        for batch in iterator:
            for row in batch.to_pylist():
                for c, n in ((row["chrom"], row["_n"]), (row["mchrom"], row["_mn"])):
                    if n is not None and c not in ids:
                        ids[c], sizes[c] = len(ids), n
                kept.write(encode(row, ids))
        contigs = sorted(sizes.items())
        place = {ids[c]: k for k, (c, _) in enumerate(contigs)} | {-1: -1}

        def records() -> Iterator[bytes]:
            with kept:
                kept.seek(0)
                while len(head := kept.read(4)) == 4:
                    body = bytearray(kept.read(struct.unpack("<i", head)[0]))
                    for at in (0, 20):  # contig of the read and of its mate
                        struct.pack_into("<i", body, at, place[struct.unpack_from("<i", body, at)[0]])
                    yield head + bytes(body)

        return contigs, records()

    def commit(self, messages: list[Written | None]) -> None:
        fs, _ = pafs.FileSystem.from_uri(self.path)
        for m in messages:
            for temp in m.paths if m else []:
                folder, _, name = temp.rpartition("/")
                if fs.get_file_info(temp + INDEX).type == pafs.FileType.File:
                    fs.move(temp + INDEX, f"{folder}/{name[1:]}.bam{INDEX}")
                fs.move(temp, f"{folder}/{name[1:]}.bam")

    def abort(self, messages: list[Written | None]) -> None:
        fs, _ = pafs.FileSystem.from_uri(self.path)
        for m in messages:
            for temp in m.paths if m else []:
                for x in (temp, temp + INDEX):
                    if fs.get_file_info(x).type == pafs.FileType.File:
                        fs.delete_file(x)


def _uri(spark: SparkSession, path: str) -> str:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    full = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return "file://" + full.removeprefix("file:") if full.startswith("file:/") and not full.startswith("file://") else full


def read(spark: SparkSession, path: str, sid: int = 0, region: str | None = None, split: int = SPLIT) -> DataFrame:
    """Alignments of a file or a folder of files, with the columns of :func:`cytolake.sources.text.sam`; of a region (chrom, or chrom:beg-end) only, if one is given."""
    spark.dataSource.register(BamSource)
    out = spark.read.format("cytolake_bam").option("path", _uri(spark, path)).option("sid", sid).option("split", split)
    return (out.option("region", region) if region else out).load()


def write(aln: DataFrame, path: str, contigs: list[tuple[str, int]] | DataFrame, level: int = 6, in_order: bool = True) -> None:
    """Files below ``path``, a file a task; ``in_order`` sorts by contig (in the order given) and place first, unplaced reads last, so that indexes are of use.

    A list of contigs is the dictionary of every file. Contigs may also be a table (chrom, n), for assemblies of so many that a copy in each file would outgrow the reads: then a file's dictionary has those that its
    reads and their mates lie on, sorted by name, and neither driver nor tasks hold them all."""
    spark = aln.sparkSession
    spark.dataSource.register(BamSource)
    rows = aln.select(*[F.col(x.split()[0]) if x.split()[0] in aln.columns else F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in SCHEMA.split(", ")])
    listed = not isinstance(contigs, DataFrame)
    if not listed:
        rows = rows.join(contigs.select(F.col("chrom").alias("_c"), F.col("n").cast("int").alias("_n")), F.col("chrom") == F.col("_c"), "left").drop("_c")
        if "mchrom" in aln.columns:
            rows = rows.join(contigs.select(F.col("chrom").alias("_c"), F.col("n").cast("int").alias("_mn")), F.col("mchrom") == F.col("_c"), "left").drop("_c")
        else:
            rows = rows.withColumn("_mn", F.lit(None).cast("int"))
        if in_order:
            rows = rows.withColumn("_off", F.col("_n").isNull())
            rows = rows.repartitionByRange("_off", "chrom", "pos1").sortWithinPartitions("_off", "chrom", "pos1", "qname", "flag").drop("_off")
    elif in_order:
        order = spark.createDataFrame([(c, k) for k, (c, _) in enumerate(contigs)], "_c string, _tid int")
        rows = rows.join(order, F.col("chrom") == F.col("_c"), "left").withColumn("_tid", F.coalesce("_tid", F.lit(1 << 30)))
        rows = rows.repartitionByRange("_tid", "pos1").sortWithinPartitions("_tid", "pos1", "qname", "flag").drop("_c", "_tid")
    out = rows.write.format("cytolake_bam").mode("append").option("path", _uri(spark, path)).option("level", level)
    (out.option("contigs", json.dumps(contigs)) if listed else out).save()

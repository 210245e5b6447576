"""Operator 9: WARC archives, written with revisit records and read back by a salvage reader.

Writing: each record is a gzip member of its own. Of pages with equal payloads of at least ``REVISIT_BYTES`` the one of the largest id is the
response; the rest are revisits that refer to it and carry no payload. Only digests are shuffled to find them; where at most
``SENT_LEADS`` payloads repeat (counted first), what is known of them is broadcast, else joined by a shuffle. Tasks write files of about ``FILE_BYTES`` to
the shared folder under names of their attempt, and only the names that successful tasks return are read.

Reading: a record is accepted after its checks (gzip checksum, version line, header form, length, block digest). When one fails, the
reader searches for the next gzip member that opens with a version line, or in plain files the next version line, goes on
there, and logs the bytes between as a quarantined gap; records and gaps come of one pass. Memory is bounded by the largest record that holds, not by the file or by what a damaged
length claims.

Defined results: a null payload is an empty one. Rows without an id are written, and never referred to. Rows that repeat an id and a payload are
each what their id is. An empty table gives an empty result. Other columns than id, url and payload are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import files
from .common import fresh_path, materialize, prepare

REVISIT_BYTES = 1000
FILE_BYTES = 128 << 20
#: So many repeated payloads are broadcast at most (about 100 bytes each); more are joined by a shuffle.
SENT_LEADS = 300_000
#: Pages of one payload that one key of that shuffle has, about at most.
COPIES = 50_000
LEVEL = 6
DATE = "2020-01-01T00:00:00Z"
#: A header is read by steps of so many bytes until it ends; a block of more than HELD_BYTES of a plain file is checked before it is held.
HEADER_BYTES, HELD_BYTES = 1 << 16, 1 << 26
#: Longest header: none longer is written, and none longer is held when read.
HEADER_MOST = 1 << 25
#: Bytes that end a record.
TAIL = 4
VERSION = b"WARC/1."
MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_label(raw: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest_hex: str, refers_to: int | None) -> bytes:
    """A whole record, as bytes before compression."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    name = lambda x: f"<urn:x-page:{'' if x is None else x}>"
    head = [("WARC-Type", kind), ("WARC-Record-ID", name(page_id)), ("WARC-Date", DATE), ("WARC-Target-URI", re.sub(r"[\r\n]", "", url or ""))]
    head += [("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest_hex)).decode()), ("WARC-Block-Digest", sha1_label(block))]
    if kind == "revisit":
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", name(refers_to))]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    told = b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode("utf-8", "surrogatepass") + b"\r\n"
    if len(told) > HEADER_MOST:
        raise ValueError(f"the header of page {page_id} has {len(told)} bytes, more than {HEADER_MOST}")
    return told + block + b"\r\n\r\n"


def member(raw: bytes, level: int = LEVEL) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


# -- writing -------------------------------------------------------------------------------------------------------


def marked(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", sent_leads: int = SENT_LEADS, copies: int = COPIES) -> DataFrame:
    """(page_id, url, html, sha1, refers_to): refers_to is null for responses.

    More repeated payloads than ``sent_leads`` meet their pages by a shuffle, in which one of over ``copies`` pages is dealt out to as many keys as keep each of them
    small; how many is broadcast, as there are few such (the table's rows divided by ``copies`` at most)."""
    text = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), text.alias("html"), F.sha1(text.cast("binary")).alias("sha1"), F.octet_length(text).alias("bytes"))
    leads = rows.where(F.col("bytes") >= REVISIT_BYTES).groupBy("sha1", "bytes").agg(F.max("page_id").alias("lead"), F.count("*").alias("n"))
    leads = materialize(leads.where("n > 1 and lead is not null").select(F.col("sha1").alias("s"), F.col("bytes").alias("b"), "lead", F.ceil(F.col("n") / copies).cast("int").alias("parts")), "warc-leads")
    same = (F.col("sha1") == F.col("s")) & (F.col("bytes") == F.col("b"))
    if leads.count() <= sent_leads:
        met = rows.join(F.broadcast(leads), same, "left")
    else:
        hot = leads.where("parts > 1").select(F.col("s").alias("hs"), F.col("parts").alias("hp"))
        part = F.coalesce(F.pmod(F.xxhash64("page_id", "url", F.monotonically_increasing_id()), F.col("hp")).cast("int"), F.lit(0))
        dealt = rows.join(F.broadcast(hot), F.col("sha1") == F.col("hs"), "left").withColumn("part", part)
        leads = leads.withColumn("p", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        met = dealt.join(leads.hint("merge"), same & (F.col("part") == F.col("p")), "left")
    return met.select("page_id", "url", "html", "sha1", F.when(~F.col("page_id").eqNullSafe(F.col("lead")), F.col("lead")).alias("refers_to"))


def write(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", file_bytes: int = FILE_BYTES, level: int = LEVEL, sent_leads: int = SENT_LEADS) -> DataFrame:
    """Writes archives below ``folder``; returns (path, records, bytes) of each."""
    prepare(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = files.system(folder)
        fs.create_dir(base, recursive=True)
        out, n, size, number, path = None, 0, 0, 0, ""

        def done() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"path": [path], "records": [n], "bytes": [size]})

        for b in batches:
            for page, link, text, digest, refers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    path = files.attempt_path(folder, "pages", number, ".warc.gz")
                    out, n, size, number = fs.open_output_stream(files.system(path)[1], compression=None), 0, 0, number + 1
                kind = "response" if refers is None else "revisit"
                raw = member(record(kind, page, link, text.encode("utf-8", "surrogatepass"), digest, refers), level)
                out.write(raw)
                n, size = n + 1, size + len(raw)
                if size >= file_bytes:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    rows = marked(pages, page_id, url, html, sent_leads)
    return materialize(rows.mapInArrow(run, "path string, records long, bytes long"), "warc-files")


# -- reading -------------------------------------------------------------------------------------------------------


@dataclass
class Record:
    start: int
    end: int
    headers: dict[str, str]
    block: bytes

    def page(self) -> int | None:
        return _page(self.headers.get("warc-record-id", ""))

    def refers_to(self) -> int | None:
        return _page(self.headers.get("warc-refers-to", ""))

    def payload_digest(self) -> str | None:
        label, _, value = self.headers.get("warc-payload-digest", "").partition(":")
        return base64.b32decode(value).hex() if label == "sha1" and len(value) == 32 else None

    def payload(self) -> bytes:
        return self.block.partition(b"\r\n\r\n")[2]

    def payload_bytes(self) -> int | None:
        """Of the full payload, which a revisit's HTTP header still tells."""
        if self.headers.get("warc-type") != "revisit":
            return len(self.payload())
        m = re.search(rb"(?im)^content-length:[ \t]*(\d+)", self.block)
        return int(m[1]) if m else None


@dataclass
class Gap:
    start: int
    end: int
    reason: str


def _page(urn: str) -> int | None:
    m = re.fullmatch(r"<urn:x-page:(-?\d+)>", urn)
    return int(m[1]) if m else None


class Bad(Exception):
    pass


@dataclass
class Reader:
    """Records and gaps of one archive, in order of place.

    Nothing that a damaged length claims is read before it holds: a header is held up to ``HEADER_MOST``, a member is expanded by steps and no further than its own header says. A block of a plain file
    is checked against its digest (by steps, if it is long), or else, at any size, by what follows it: the end of the file or of the record and another record. Where the record ends as it should but no
    other follows (that one may be the damaged one), the block must not hold a version line.
    """

    source: files.Blocks
    gaps: list[Gap] = field(default_factory=list)
    ahead: dict[bytes, int] = field(default_factory=dict)  # the next place of each mark, from where it was last looked for

    def records(self) -> Iterator[Record]:
        for x in self.everything():
            if isinstance(x, Record):
                yield x

    def everything(self) -> Iterator[Record | Gap]:
        at = 0
        while at < self.source.length:
            try:
                r = self._gzip(at) if self.source.read(at, 3) == MAGIC else self._plain(at)
            except Bad as e:
                to = self._next(at + 1)
                self.gaps.append(Gap(at, to, str(e)))
                yield self.gaps[-1]
                at = to
                continue
            yield r
            at = r.end

    def _gzip(self, at: int) -> Record:
        z, raw, used, whole, head = zlib.decompressobj(31), bytearray(), 0, None, None
        try:
            for part in self.source.stream(at):
                used += len(part)
                full = True
                while (part or full) and not z.eof:  # a full step may have left bytes behind that need no further input
                    most = HEADER_BYTES if whole is None else max(1, min(whole + 1 - len(raw), HELD_BYTES))
                    raw += (out := z.decompress(part, most))
                    part, full = z.unconsumed_tail, len(out) == most
                    if not raw:
                        continue
                    if whole is None:
                        head = _begun(raw, "member without a version line")
                        whole = head[1] + head[2] + TAIL if head else None
                    if whole is not None and len(raw) > whole:
                        raise Bad("member is longer than its header says")
                if z.eof:
                    break
        except zlib.error as e:
            raise Bad(f"gzip: {e}") from None
        if not z.eof:
            raise Bad("gzip: member is cut off")
        if head is None:
            raise Bad("header does not end" if raw.startswith(VERSION) else "member without a version line")
        headers, start, length = head
        block = bytes(raw[start : start + length])
        _check(headers, block, length)
        if raw[start + length :].strip(b"\r\n"):
            raise Bad("bytes after the record")
        return Record(at, at + used - len(z.unused_data), headers, block)

    def _plain(self, at: int) -> Record:
        raw, found = bytearray(), None
        while found is None:
            part = self.source.read(at + len(raw), HEADER_BYTES)
            raw += part
            found = _begun(raw, "no version line", len(part))
            if found is None and not part:
                raise Bad("header does not end")
        headers, start, length = found
        start += at
        if start + length > self.source.length:
            raise Bad("block is cut off")
        if not headers.get("warc-block-digest", "").startswith("sha1:"):
            self._followed(start, length)
        elif length > HELD_BYTES:
            digest = hashlib.sha1()
            for lo in range(start, start + length, HEADER_BYTES):
                digest.update(self.source.read(lo, min(HEADER_BYTES, start + length - lo)))
            if headers["warc-block-digest"] != "sha1:" + base64.b32encode(digest.digest()).decode():
                raise Bad("block digest differs")
        block = self.source.read(start, length)
        _check(headers, block, length)
        tail = self.source.read(start + length, TAIL)
        return Record(at, start + length + len(tail) - len(tail.lstrip(b"\r\n")), headers, block)

    def _followed(self, start: int, length: int) -> None:
        tail = self.source.read(start + length, TAIL + len(VERSION))
        behind = tail.lstrip(b"\r\n")
        if not behind or behind.startswith((VERSION, MAGIC)) or VERSION.startswith(behind):
            return
        if not tail.startswith(b"\r\n\r\n") or self.source.find(b"\r\n" + VERSION, start, start + length) >= 0:
            raise Bad("no record after the block")

    def _mark(self, what: bytes, at: int) -> int:
        """The next place of a mark, found once for all places before it, so that a search goes over the file once whatever the number of gaps."""
        if self.ahead.get(what, -1) < at:
            place = self.source.find(what, at)
            self.ahead[what] = place if place >= 0 else self.source.length
        return self.ahead[what]

    def _next(self, at: int) -> int:
        """The next place where a record may start: a member that opens with a version line, or a version line; else the end."""
        while at < self.source.length:
            gz, line = self._mark(MAGIC, at), self._mark(VERSION, at)
            at = min(gz, line)
            if at >= self.source.length:
                break
            if at == line and (at == 0 or self.source.read(at - 1, 1) == b"\n"):
                return at
            if at == gz:
                try:
                    if zlib.decompressobj(31).decompress(self.source.read(at, 4096), len(VERSION)).startswith(VERSION):
                        return at
                except zlib.error:
                    pass
            at += 1
        return self.source.length


def _begun(raw: bytearray, without: str, new: int = HEADER_BYTES) -> tuple[dict[str, str], int, int] | None:
    """:func:`_head` of what has been read of a record, of which the last ``new`` bytes at most were not looked at before."""
    if raw[: len(VERSION)] != VERSION[: len(raw)] or not raw:
        raise Bad(without)
    over = raw.find(b"\r\n\r\n", max(0, len(raw) - new - 3))
    if over < 0:
        if len(raw) > HEADER_MOST:
            raise Bad("header does not end")
        return None
    return _head(bytes(raw[: over + 4]))


def _head(raw: bytes) -> tuple[dict[str, str], int, int] | None:
    """Headers, where the block begins, and its length; None if the header does not end here."""
    over = raw.find(b"\r\n\r\n")
    if over < 0:
        return None
    headers = {}
    for line in raw[:over].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not re.fullmatch(rb"[!-9;-~]+", name):
            raise Bad("header line without a name")
        headers[name.decode().lower()] = value.strip().decode("utf-8", "surrogateescape")
    length = headers.get("content-length", "")
    if not length.isascii() or not length.isdigit():
        raise Bad("no length")
    return headers, over + 4, int(length)


def _check(headers: dict[str, str], block: bytes, length: int) -> None:
    if len(block) < length:
        raise Bad("block is cut off")
    told = headers.get("warc-block-digest")
    if told and told.startswith("sha1:") and told != sha1_label(block):
        raise Bad("block digest differs")


def _paths(archives: DataFrame, *columns: str) -> DataFrame:
    """One task for each few archives."""
    n = archives.count()
    return archives.select("path", *columns).repartition(max(1, min(n, 10_000)), "path")


FIELDS = "path string, start long, end long, gap string, record_type string, page_id long, payload_bytes long, payload_digest string, refers_to long"


def scan(archives: DataFrame, whole: bool = False) -> DataFrame:
    """Records and gaps of archives given by (path), in one pass: place, type, page, length and digest of the full payload, page referred to; ``gap`` tells why bytes were
    left out and is null for records. ``whole``: archives as :func:`write` returns them, of which fewer or more records than written are an error."""
    names = [x.split()[0] for x in FIELDS.split(", ")]
    kinds = [pa.string() if x.endswith("string") else pa.int64() for x in FIELDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, path in enumerate(b.column(0).to_pylist()):
                source, rows, n = files.Blocks(path), [], 0
                for x in Reader(source).everything():
                    if isinstance(x, Gap):
                        rows.append((path, x.start, x.end, x.reason, None, None, None, None, None))
                    else:
                        n += 1
                        digest = hashlib.sha1(x.payload()).hexdigest() if x.headers.get("warc-type") == "response" else x.payload_digest()
                        rows.append((path, x.start, x.end, None, x.headers.get("warc-type"), x.page(), x.payload_bytes(), digest, x.refers_to()))
                    if len(rows) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows = []
                source.close()
                if whole and n != b.column(1)[k].as_py():
                    raise ValueError(f"{path}: {n} records read of {b.column(1)[k].as_py()} written")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return _paths(archives, *["records"] * whole).mapInArrow(run, FIELDS)


def salvage(archives: DataFrame, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """Records, and the log of quarantined bytes (path, start, end, reason), of one pass over the archives."""
    found = materialize(scan(archives, whole), "warc-records")
    return found.where("gap is null").drop("gap"), found.where("gap is not null").select("path", "start", "end", F.col("gap").alias("reason"))


def round_trip(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", sent_leads: int = SENT_LEADS) -> DataFrame:
    """Writes every page and reads the archives back. Records read are counted against those written, and a byte that had to be left out is an error here."""
    archives = write(pages, fresh_path(pages.sparkSession, "warc"), page_id, url, html, sent_leads=sent_leads)
    records, gaps = salvage(archives, whole=True)
    if not gaps.isEmpty():
        raise ValueError(f"bytes of own archives were left out: {gaps.first()}")
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")

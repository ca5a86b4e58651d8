"""WARC archives: a writer with revisit records and a reader that salvages damaged archives.

Each record is a gzip member of its own. The reader checks every member and record (gzip checksum, version line,
header, block length, payload digest). After a failed check it searches for the next valid member or version line,
also inside a member that holds several records, goes on there, and reports the bytes between as a quarantined gap.
Both sides stream: neither an archive nor a member is ever held whole.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratapanel.llm.common import materialised, short_batches

#: An archive is closed once it has so many bytes.
ARCHIVE_BYTES = 8_000_000
#: Smallest payload that a revisit record stands for.
REVISIT_BYTES = 0
#: Bytes of a page that a reader holds; a header that is longer than this is taken as damaged.
PAGE_BYTES, HEADER_BYTES = 1 << 18, 1 << 18
#: Files that the list of written archives is kept in.
MANIFEST_FILES = 8
#: Rows of a batch that the reader returns, and bytes of payloads after which a batch is closed.
READ_ROWS, READ_BYTES = 500, 8 << 20
_END = b"\r\n\r\n"
_MAGIC, _VERSION = b"\x1f\x8b\x08", re.compile(rb"WARC/1\.[01]\r\n")


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header_text(value: str) -> str:
    """A header value on one line; control characters are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in value)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """An uncompressed response record, or a revisit record (HTTP header only) if ``refers_to`` is given."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d%s" % (len(payload), _END)
    revisit = refers_to is not None
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header_text(url)}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(lines).encode("utf-8", "replace") + _END + block + _END


def member(data: bytes) -> bytes:
    """``data`` as one gzip member; the header has no time, so equal records give equal bytes."""
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


@dataclass
class Record:
    """``payload`` is held only where it is asked for; ``inner`` is the place in the unpacked member."""

    headers: dict[str, str]
    payload: bytes | None
    payload_bytes: int
    start: int = 0
    inner: int = 0
    checked: bool = False


@dataclass
class Gap:
    """Bytes that were quarantined, and why; within a member that unpacks, ``inner`` is the span of unpacked bytes."""

    start: int
    end: int
    reason: str
    inner: tuple[int, int] | None = None


class _Pages:
    """A seekable file read in pages, of which the last few are kept."""

    def __init__(self, file: BinaryIO):
        self.file, self.held = file, {}
        self.size = file.seek(0, 2) or file.tell()

    def piece(self, at: int, most: int) -> bytes:
        """Up to ``most`` bytes from ``at``, within one page."""
        page = at // PAGE_BYTES
        if page not in self.held:
            if len(self.held) > 3:
                del self.held[next(iter(self.held))]
            self.file.seek(page * PAGE_BYTES)
            self.held[page] = self.file.read(PAGE_BYTES)
        begin = at - page * PAGE_BYTES
        return self.held[page][begin : begin + most]

    def peek(self, at: int, n: int) -> bytes:
        """The ``n`` bytes from ``at`` on, or as many as there are."""
        out = b""
        while len(out) < n and at + len(out) < self.size:
            out += self.piece(at + len(out), n - len(out))
        return out

    def find(self, at: int) -> int:
        """The next place from ``at`` on of a gzip header or a version line; the size of the file if there is none."""
        while at < self.size:
            piece = self.piece(at, PAGE_BYTES)
            piece += self.peek(at + len(piece), 16)
            packed, plain = piece.find(_MAGIC), _VERSION.search(piece)
            found = min([x for x in (packed, plain.start() if plain else -1) if x >= 0], default=-1)
            if found >= 0:
                return at + found
            at += max(len(piece) - 16, 1)
        return self.size


def _deflated(pages: _Pages, at: int) -> int:
    """Where the packed data of the gzip member at ``at`` begin, after its header."""
    head = pages.peek(at, HEADER_BYTES if pages.peek(at + 3, 1) not in (b"", b"\0") else 10)
    flags, place = head[3] if len(head) > 3 else 0, 10
    if flags & 4:
        place += 2 + int.from_bytes(head[10:12], "little")
    for flag in (8, 16):
        if flags & flag:
            place = head.find(b"\0", place) + 1 or HEADER_BYTES
    return at + place + (2 if flags & 2 else 0)


class _Bytes:
    """The bytes of a file from a place on, unpacked if that is a gzip member. A mark can be returned to.

    With ``unchecked`` the member's checksum is left out, so that what stands before the damage can be read.
    """

    def __init__(self, pages: _Pages, at: int, packed: bool, unchecked: bool = False):
        self.pages, self.next, self.unpacker = pages, at, zlib.decompressobj(-15 if unchecked else 31) if packed else None
        self.data, self.at, self.tail = b"", 0, b""
        self.step, self.most_step = (256, 256) if unchecked else (4096, PAGE_BYTES)
        if unchecked:
            self.next = _deflated(pages, at)

    def more(self) -> bool:
        """Reads on; False at the end. A damaged or cut member raises ValueError."""
        if self.unpacker is None:
            piece = self.pages.piece(self.next, self.step) if self.next < self.pages.size else b""
            self.next, out = self.next + len(piece), piece
        else:
            out = b""
            while not out and not self.unpacker.eof:
                piece = self.tail or (self.pages.piece(self.next, self.step) if self.next < self.pages.size else b"")
                if not piece:
                    raise ValueError("gzip member is cut off")
                self.next += 0 if self.tail else len(piece)
                try:
                    out = self.unpacker.decompress(piece, PAGE_BYTES)
                except zlib.error:
                    raise ValueError("gzip member is damaged") from None
                self.tail = self.unpacker.unconsumed_tail
        self.step = min(self.step * 2, self.most_step)
        self.data += out
        return bool(out)

    def has(self, n: int) -> bool:
        while len(self.data) < n:
            if not self.more():
                return False
        return True

    def skip(self, n: int) -> None:
        self.data, self.at = self.data[n:], self.at + n

    def until(self, mark: bytes, most: int) -> int:
        """Where ``mark`` is next, or -1 if not within ``most`` bytes."""
        seen = 0
        while True:
            found = self.data.find(mark, seen)
            if 0 <= found <= most:
                return found
            seen = max(len(self.data) - len(mark) + 1, 0)
            if found >= 0 or seen > most or not self.more():
                return -1

    def next_version(self) -> bool:
        """Goes to the next version line after this place; False if there is none."""
        self.skip(1)
        while not (found := _VERSION.search(self.data)):
            self.skip(max(len(self.data) - 16, 0))
            if not self.more():
                self.skip(len(self.data))
                return False
        self.skip(found.start())
        return True

    def mark(self) -> tuple:
        return self.next, self.unpacker and self.unpacker.copy(), self.data, self.at, self.step, self.tail

    def back(self, mark: tuple) -> None:
        self.next, self.unpacker, self.data, self.at, self.step, self.tail = mark
        self.unpacker = self.unpacker and self.unpacker.copy()

    def end(self) -> int:
        """The place in the file after what was read; of a member, after its last byte."""
        return self.next - (len(self.unpacker.unused_data) if self.unpacker else len(self.data))


def _record(source: _Bytes, keep: bool) -> Record:
    """The record at this place, whose payload is hashed as it is read; ValueError with the reason if a check fails."""
    start = source.at
    version = source.has(10) and _VERSION.match(source.data)
    if not version:
        raise ValueError("no version line")
    end = source.until(_END, HEADER_BYTES)
    if end < 0:
        raise ValueError("header has no end")
    headers = {}
    for line in source.data[version.end() : end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon or not name:
            raise ValueError("bad header line")
        headers[name.decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
    length = headers.get("content-length", "")
    if not re.fullmatch(r"[0-9]{1,18}", length):
        raise ValueError("no content length")
    source.skip(end + 4)
    left, head = int(length), b""
    if "application/http" in headers.get("content-type", ""):
        cut = source.until(_END, min(left, HEADER_BYTES))
        if cut < 0 or cut + 4 > left:
            raise ValueError("HTTP header has no end")
        head = source.data[:cut]
        source.skip(cut + 4)
        left -= cut + 4
    n, sha, held = left, hashlib.sha1(), []
    while left:
        if not source.has(1):
            raise ValueError("block is not closed")
        piece = source.data[:left]
        sha.update(piece)
        if keep:
            held.append(piece)
        source.skip(len(piece))
        left -= len(piece)
    if not source.has(4) or source.data[:4] != _END:
        raise ValueError("block is not closed")
    source.skip(4)
    digest, checked = headers.get("warc-payload-digest", ""), False
    if headers.get("warc-type") == "revisit":
        told = re.search(rb"(?i)^content-length:\s*([0-9]{1,18})\s*$", head, re.M)
        n = int(told[1]) if told else 0
    elif digest.startswith("sha1:"):
        if digest[5:] != base64.b32encode(sha.digest()).decode():
            raise ValueError("payload digest differs")
        checked = True
    return Record(headers, b"".join(held) if keep else None, n, inner=start, checked=checked)


def _sound(pages: _Pages, at: int) -> str | None:
    """Why a gzip member can't be unpacked as a whole; None if it can."""
    source = _Bytes(pages, at, True)
    try:
        while source.more():
            source.skip(len(source.data))
    except ValueError as error:
        return str(error)
    return None


def _member_events(pages: _Pages, at: int, keep: bool, broken: bool) -> Iterator[Record | Gap | int]:
    """Records and inner gaps of the gzip member at ``at``, then its end; -1 if it is broken.

    After a bad record the next version line within the member is looked for. Of a member that fails its own
    checksum only records count whose payload digest is right.
    """
    source, bad = _Bytes(pages, at, True, broken), None
    try:
        while source.has(1):
            mark = source.mark()
            try:
                one = _record(source, keep)
                if broken and not one.checked:
                    raise ValueError("not checked")
            except ValueError as error:
                source.back(mark)
                bad = bad or (source.at, str(error))
                source.next_version()
                continue
            if bad and not broken:
                yield Gap(at, at, bad[1], (bad[0], one.inner))
            bad = None
            one.start = at
            yield one
        if bad and not broken:
            yield Gap(at, at, bad[1], (bad[0], source.at))
    except ValueError:
        broken = True
    yield -1 if broken else source.end()


def scan(data: bytes | BinaryIO, keep: bool = True) -> Iterator[Record | Gap]:
    """The records that pass all checks and the gaps between them, in order; payloads are held only with ``keep``.

    Handles archives of gzip members and plain ones, also in turn. An empty archive has neither. A broken member is a
    gap, but records in it with a right digest count. It reads on in pages: memory holds a few of them, and with
    ``keep`` a payload, however long the archive or a member is.
    """
    pages = _Pages(io.BytesIO(data) if isinstance(data, bytes) else data)
    at, bad = 0, None
    while at < pages.size:
        if pages.peek(at, 3) == _MAGIC:
            reason = _sound(pages, at)
            events = _member_events(pages, at, keep, reason is not None)
        else:
            source = _Bytes(pages, at, False)
            try:
                one, reason = _record(source, keep), None
                one.start = at
                events = iter((one, source.end()))
            except ValueError as error:
                events, reason = iter((-1,)), str(error)
        for event in events:
            if isinstance(event, int):
                end = event
                continue
            if bad:
                yield Gap(bad[0], at, bad[1])
                bad = None
            yield event
        if end < 0:
            bad, end = bad or (at, reason or "gzip member is damaged"), pages.find(at + 1)
        elif bad:
            yield Gap(bad[0], at, bad[1])
            bad = None
        at = end
    if bad:
        yield Gap(bad[0], pages.size, bad[1])


def with_revisits(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, url, payload, refers_to): of equal payloads the largest page_id is kept, others refer to it.

    Payloads shorter than ``least`` bytes never refer, nor do rows without a page_id. Repeated rows of the largest
    page_id are all responses. Only (page_id, digest) pairs are grouped and joined; the payloads move once.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    keyed = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    narrow = keyed.where((F.octet_length("payload") >= least) & F.col("page_id").isNotNull()).select("page_id", "digest")
    kept = narrow.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "refers_to")
    refers = narrow.join(kept, "digest").where("page_id <> refers_to").distinct()
    return keyed.join(refers, ["page_id", "digest"], "left").select("page_id", "url", "payload", "refers_to", "digest")


def _files(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pyarrow.fs.FileSystem.from_uri(path)
    return pyarrow.fs.LocalFileSystem(), path


def write(rows: DataFrame, path: str) -> DataFrame:
    """Writes (page_id, url, payload, refers_to) to archives below ``path``; (archive, records, bytes) of each.

    A task writes its rows in order of id, so a repeated task writes the same files again; each file appears by
    a rename once it is whole. Members go to the file as they are made. An empty table writes nothing.
    """
    short_batches(rows.sparkSession)
    rows = rows.sortWithinPartitions("page_id", "digest").select("page_id", "url", "payload", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _files(path)
        files.create_dir(root, recursive=True)
        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        done: list[tuple[str, int, int]] = []
        out, n, size = None, 0, 0

        def close() -> None:
            nonlocal out, n, size
            if out:
                name = f"part-{part:06d}-{len(done):04d}.warc.gz"
                out.close()
                files.move(f"{root}/_{len(done)}.{part}.{attempt}", f"{root}/{name}")
                done.append((name, n, size))
                out, n, size = None, 0, 0

        for batch in batches:
            for i in range(batch.num_rows):
                out = out or files.open_output_stream(f"{root}/_{len(done)}.{part}.{attempt}")
                data = member(record(*(c[i].as_py() for c in batch.columns)))
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= ARCHIVE_BYTES:
                    close()
        close()
        names, counts, sizes = zip(*done, strict=True) if done else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], ["archive", "records", "bytes"])

    manifest = rows.mapInArrow(run, "archive string, records bigint, bytes bigint")
    return materialised(manifest.repartition(MANIFEST_FILES))


_ROW = pa.schema([("archive", pa.string()), ("start", pa.int64()), ("page_id", pa.int64()), ("record_type", pa.string()), ("url", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("gap_end", pa.int64()), ("gap_reason", pa.string()), ("payload", pa.binary())])


def _page(value: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?[0-9]+)>", value or "")
    return int(found[1]) if found else None


def read(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """A row for each record of the archives below ``path``, and one for each gap (``gap_end`` is not null).

    ``payloads`` adds the bytes of response records. Spark lists the archives; a task reads one at a time, in pages. A
    gap within a member that unpacks has the member's place as its end, and its reason names the unpacked bytes.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path")

    def row(name: str, found: Record | Gap) -> dict:
        if isinstance(found, Gap):
            within = f" (unpacked bytes {found.inner[0]} to {found.inner[1]})" if found.inner else ""
            return {"archive": name, "start": found.start, "gap_end": found.end, "gap_reason": found.reason + within}
        header = found.headers.get
        return {
            "archive": name, "start": found.start, "page_id": _page(header("warc-record-id")), "record_type": header("warc-type"), "url": header("warc-target-uri"),
            "payload_digest": header("warc-payload-digest", "").removeprefix("sha1:"), "payload_bytes": found.payload_bytes, "refers_to": _page(header("warc-refers-to")), "payload": found.payload,
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                source, place = _files(name)
                with source.open_input_file(place) as file:
                    rows, held = [], 0
                    for event in scan(file, payloads):
                        rows.append(row(name, event))
                        held += len(rows[-1].get("payload") or b"")
                        if len(rows) >= READ_ROWS or held >= READ_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, schema=_ROW)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=_ROW)

    kinds = "archive string, start bigint, page_id bigint, record_type string, url string, payload_digest string, payload_bytes bigint, refers_to bigint, gap_end bigint, gap_reason string, payload binary"
    return files.mapInArrow(run, kinds)


def complete(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` of ``read``, if every record of the manifest of ``write`` was read and there is no gap; else an error that names archives.

    The manifest has a row an archive and the comparison is a join, so an archive that is missing, or cut off at a
    member's end, is seen too. ``found`` is kept in the shared folder, without payloads.
    """
    rows = materialised(found.drop("payload"), narrow=True)
    archive = F.substring_index("archive", "/", -1).alias("archive")
    read_of = rows.groupBy(archive).agg(F.count(F.when(F.col("gap_end").isNull(), 1)).alias("read"), F.max("gap_reason").alias("gap"))
    wrong = manifest.join(read_of, "archive", "full").where("coalesce(records, 0) <> coalesce(read, 0) or gap is not null")
    lost = wrong.orderBy("archive").limit(5).collect()
    if lost:
        raise ValueError("damaged archives: " + "; ".join(f"{r['archive']}: {r['read'] or 0} of {r['records'] or 0} records, {r['gap'] or 'no gap'}" for r in lost))
    return rows

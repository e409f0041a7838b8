"""WARC archives: deduplicating writer, and a salvage reader that skips damage and logs the gaps."""

from __future__ import annotations

import base64
import hashlib
import io
import logging
import re
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Compressed bytes after which a task begins its next archive.
ARCHIVE_BYTES = 8 << 20
#: Bytes of an archive that are read at a time, and of a member that are unpacked at a time.
WINDOW_BYTES, PIECE_BYTES = 1 << 20, 16 << 10
_MAGIC, _VERSION, _END = b"\x1f\x8b\x08", b"WARC/1.", b"\r\n\r\n"
_MARK, _FIRST_LINE = re.compile(re.escape(_MAGIC) + b"[\\x00-\\x1f]|" + re.escape(_VERSION)), re.compile(re.escape(_VERSION) + rb"\d\r\n")
_log = logging.getLogger(__name__)
_EPOCH = "1970-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str = _EPOCH) -> bytes:
    """One WARC record: the HTTP response with its payload, or a revisit that has the headers alone.

    A revisit keeps the payload's digest and, in its HTTP headers, the payload's length.
    """
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    name = "none" if page_id is None else str(page_id)
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or f"urn:page:{name}")
    head = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:page:{name}>"), ("WARC-Date", date), ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"), ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    if revisit:
        head += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + _END


@dataclass
class Found:
    """What a place of an archive holds: a record, or a gap with the reason why its bytes were set aside."""

    start: int
    end: int
    headers: dict[str, str] = field(default_factory=dict)
    http: bytes = b""
    payload: bytes = b""
    gap: str | None = None


class _Damaged(Exception):
    """A check that failed; ``until``: no version line before that place passes either."""

    def __init__(self, reason: str, until: int = 0):
        super().__init__(reason)
        self.until = until


class Source:
    """The bytes of an archive, read by offset in windows; where a search went is remembered, so that it isn't gone again."""

    def __init__(self, file: BinaryIO, size: int):
        self.file, self.size = file, size
        self.start, self.window = 0, b""
        self.known: dict[tuple[bytes, str], tuple[int, int]] = {}

    def _hold(self, at: int, size: int) -> None:
        """Has the window hold ``size`` bytes from ``at`` on, or all that there are."""
        if not self.start <= at <= min(at + size, self.size) <= self.start + len(self.window):
            self.file.seek(at)
            self.start, self.window = at, self.file.read(max(0, min(max(size, WINDOW_BYTES), self.size - at)))

    def read(self, at: int, size: int) -> bytes:
        """Up to ``size`` bytes from ``at`` on; a few bytes elsewhere don't move the window."""
        if size <= 64 and not self.start <= at <= at + size <= self.start + len(self.window):
            self.file.seek(at)
            return self.file.read(min(size, max(0, self.size - at)))
        self._hold(at, size)
        return self.window[at - self.start : at - self.start + size]

    def find(self, what: bytes, at: int, search: str = "") -> int:
        """Where ``what`` comes next, from ``at`` on; the size if nowhere. Each named ``search`` goes forward on its own."""
        if at >= self.size:
            return self.size
        since, found = self.known.get((what, search), (0, -1))
        if not since <= at <= found:
            found = self._search(re.compile(re.escape(what)), at, len(what))
            self.known[what, search] = at, found
        return found

    def mark(self, at: int) -> int:
        """The next place that may begin a member or a record."""
        return self._search(_MARK, at, len(_VERSION))

    def _search(self, pattern: re.Pattern[bytes], at: int, width: int) -> int:
        while at < self.size:
            self._hold(at, width)
            found = pattern.search(self.window, at - self.start)
            if found:
                return self.start + found.start()
            at = max(at + 1, self.start + len(self.window) - width + 1)
        return self.size


def _headers(data: Source, at: int) -> tuple[int, dict[str, str]]:
    """Where the header of the record at ``at`` ends, and its fields, names in lower case; lines are read up to the first that is none."""
    if not _FIRST_LINE.match(data.read(at, 16)):
        raise _Damaged("no header")
    stop = data.find(_END, at)
    if stop >= data.size:
        raise _Damaged("no header", data.size)
    headers: dict[str, str] = {}
    here = data.find(b"\r\n", at) + 2
    while here < stop + 2:
        after = data.find(b"\r\n", here)
        name, colon, value = data.read(here, after - here).partition(b":")
        try:
            field_name = name.decode().strip().lower()
            if not colon or (field_name in headers and field_name != "warc-concurrent-to"):
                raise _Damaged("bad header", here)
            headers[field_name] = value.decode().strip()
        except UnicodeDecodeError as e:
            raise _Damaged("bad header", here) from e
        here = after + 2
    return stop + 4, headers


def _parse(data: Source, at: int) -> tuple[int, dict[str, str], bytes]:
    """The record at ``at``: where it ends, its headers and its block; raises where a check fails.

    A header may have any length. The length that it states is held against what is there, and the
    record's end is looked at, before the block is read.
    """
    begin, headers = _headers(data, at)
    if not (headers.get("content-length") or "").isdecimal():
        raise _Damaged("bad header", begin if "content-length" not in headers else 0)
    size = int(headers["content-length"])
    end = begin + size
    if end + 4 > data.size or data.read(end, 4) != _END:
        raise _Damaged("bad length")
    block = data.read(begin, size)
    if headers.get("warc-block-digest", (sha := f"sha1:{base32_sha1(block)}")) != sha:
        raise _Damaged("bad digest")
    return end + 4, headers, block


def _deflated(data: Source, at: int) -> int:
    """Where the deflate stream of the gzip member at ``at`` begins; raises if its header's fields can't be those of one."""
    head = data.read(at, 12)
    if len(head) < 10 or head[3] & 0xE0:
        raise _Damaged("bad member")
    here = at + 10
    if head[3] & 4:
        here += 2 + int.from_bytes(data.read(here, 2), "little")
    for flag in (8, 16):
        if head[3] & flag:
            here = data.find(b"\0", here, f"{head[3] & 12}, {flag}") + 1
    here += 2 * (head[3] >> 1 & 1)
    if here >= data.size:
        raise _Damaged("bad member")
    return here


def _member(data: Source, at: int, begin: int) -> tuple[int, bytes]:
    """The gzip member at ``at`` whose deflate stream begins at ``begin``: where it ends and its content; its checksum is checked."""
    opened, pieces, here = zlib.decompressobj(-15), [], begin
    crc = size = 0
    take = 256  # a false mark fails within few bytes
    while not opened.eof:
        part, take = data.read(here, take), min(2 * take, PIECE_BYTES)
        if not part:
            raise _Damaged("cut member")
        try:
            piece = opened.decompress(part)
        except zlib.error as e:
            raise _Damaged("bad member") from e
        pieces.append(piece)
        crc, size = zlib.crc32(piece, crc), size + len(piece)
        here += len(part) - len(opened.unused_data)
    if data.read(here, 8) != crc.to_bytes(4, "little") + (size & 0xFFFFFFFF).to_bytes(4, "little"):
        raise _Damaged("bad member")
    return here + 8, b"".join(pieces)


def _record(start: int, end: int, headers: dict[str, str], block: bytes) -> Found:
    http, _, payload = block.partition(_END)
    if headers.get("warc-type") == "response" and headers.get("warc-payload-digest", (sha := f"sha1:{base32_sha1(payload)}")) != sha:
        raise _Damaged("bad payload digest")
    return Found(start, end, headers, http, payload)


def _inside(content: bytes, start: int, end: int) -> list[Found]:
    """The sound records of a sound member that lies from ``start`` to ``end``; one gap of that place if any of it is damaged."""
    data = Source(io.BytesIO(content), len(content))
    found, at, reason = [], 0, ""
    while at < data.size:
        try:
            after, headers, block = _parse(data, at)
            found.append(_record(start, end, headers, block))
            at = after
        except _Damaged as e:
            reason = reason or str(e)
            at = data.find(_VERSION, max(at + 1, e.until))
    if not found:
        raise _Damaged(reason or "no record")
    return [*found, Found(start, end, gap=f"in member: {reason}")] if reason else found


def salvage(data: bytes | Source) -> Iterator[Found]:
    """Every sound record of an archive, and a gap for each stretch of bytes that isn't one.

    Plain records and gzip members may alternate. After a failed check the search goes on one byte
    further for the next member or version line that passes all checks; a mark inside a payload
    that passes none is stepped over. No byte is left out: records and gaps cover the archive. In a
    member that holds several records the sound ones around a damaged one are found too.

    Damage costs about as much as sound bytes: a mark is held against the form of a member's or a
    record's head first, marks whose heads lead to the same deflate stream try it once, and where a
    header's lines end badly no version line before that place is tried.
    """
    data = data if isinstance(data, Source) else Source(io.BytesIO(data), len(data))
    at, lost, reason, barred = 0, -1, "", 0
    tried: set[int] = set()
    while at < data.size:
        each = None
        try:
            if data.read(at, 3) == _MAGIC:
                begin = _deflated(data, at)
                if begin in tried:
                    raise _Damaged("bad member")
                tried.add(begin)
                end, content = _member(data, at, begin)
                each = _inside(content, at, end)
            elif at < barred:
                raise _Damaged("bad header")
            else:
                end, headers, block = _parse(data, at)
                each = [_record(at, end, headers, block)]
        except _Damaged as e:
            barred = max(barred, e.until)
            if lost < 0:
                lost, reason = at, str(e)
        if each is None:
            at = data.mark(at + 1)
            continue
        tried.clear()
        if lost >= 0:
            yield Found(lost, at, gap=reason)
            lost = -1
        yield from each
        at = end
    if lost >= 0:
        yield Found(lost, at, gap=reason)


def with_references(pages: DataFrame, payload: str = "html", min_bytes: int = 0) -> DataFrame:
    """``pages`` with ``refers_to`` and ``revisit``.

    Of rows with equal payloads of at least ``min_bytes`` bytes the smallest page_id is the response
    (and any row that repeats it); the others revisit it. A null page_id comes after all others.
    Payloads are grouped by SHA-1 and length; only digests are shuffled for that, pre-aggregated.
    """
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    keyed = pages.select("page_id", F.sha1(body).alias("_sha"), F.octet_length(body).alias("_size")).where(F.col("_size") >= min_bytes)
    first = keyed.groupBy("_sha", "_size").agg(F.min("page_id").alias("_first"), F.count("*").alias("_held")).where("_held > 1 and _first is not null")
    again = keyed.join(first, ["_sha", "_size"]).where(~F.col("page_id").eqNullSafe(F.col("_first"))).select(F.col("page_id").alias("_page"), "_sha", "_size", F.col("_first").alias("refers_to")).distinct()
    rows = pages.drop("refers_to", "revisit").withColumns({"_own_sha": F.sha1(body), "_own_size": F.octet_length(body)})
    same = F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("_own_sha") == F.col("_sha")) & (F.col("_own_size") == F.col("_size"))
    return rows.join(again, same, "left").withColumn("revisit", F.col("refers_to").isNotNull()).drop("_page", "_sha", "_size", "_own_sha", "_own_size")


def _writing(folder: str) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        number, held, records, done = 0, [], 0, []

        def put() -> None:
            nonlocal held, records, number
            if held:
                # Rows come in a fixed order, so that a task that runs again writes the same archives; moving puts a whole one in place.
                final, own = f"{top}/part-{task.partitionId():06d}-{number:04d}.warc.gz", f"{top}/.{uuid.uuid4().hex}"
                data = b"".join(held)
                with store.open_output_stream(own) as out:
                    out.write(data)
                store.move(own, final)
                done.append((final.rsplit("/", 1)[1], records, len(data)))
                number, held, records = number + 1, [], 0

        size = 0
        for batch in batches:
            for page, url, payload, refers_to, revisit in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to", "revisit")), strict=True):
                packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                held.append(packer.compress(record(page, url, (payload or "").encode(), refers_to, revisit)) + packer.flush())
                size, records = size + len(held[-1]), records + 1
                if size >= ARCHIVE_BYTES:
                    put()
                    size = 0
        put()
        names, counts, sizes = zip(*done, strict=True) if done else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], ["archive", "records", "bytes"])

    return run


def write_archives(pages: DataFrame, folder: str, payload: str = "html", url: str = "url", min_bytes: int = 0) -> int:
    """Writes a gzip member per row of ``pages`` to archives in ``folder`` (a URI that all executors reach); the number of records.

    Null payloads are empty; a missing or null url is replaced by the page's name. Of ties the
    smallest page_id is the response; rows that repeat it are responses too. Long payloads are one
    record each, in memory in proportion to them. An empty table writes no archive. Other columns
    are ignored, whatever their names.
    """
    store, top = fs.FileSystem.from_uri(folder)
    store.create_dir(top, recursive=True)
    rows = with_references(pages.select("page_id", (F.col(url) if url in pages.columns else F.lit(None).cast("string")).alias("url"), F.col(payload).alias("payload")), "payload", min_bytes)
    rows = rows.select("page_id", "url", "payload", "refers_to", "revisit").sortWithinPartitions("page_id", "url", "payload")
    return rows.mapInArrow(_writing(folder), "archive string, records bigint, bytes bigint").agg(F.sum("records")).first()[0] or 0


_FIELDS = pa.schema([
    ("archive", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("gap", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()),
    ("url", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()),
])


def _number(name: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", name or "")
    return int(found[1]) if found else None


def _row(archive: str, x: Found) -> tuple:
    if x.gap:
        _log.warning("%s: bytes %d to %d set aside: %s", archive, x.start, x.end, x.gap)
        return archive, x.start, x.end, x.gap, None, None, None, None, None, None, None
    size = re.search(rb"(?i)\r\nContent-Length: *(\d+)", x.http)
    h = x.headers
    # A revisit has no payload of its own to take the digest of.
    digest = h.get("warc-payload-digest") or (None if h.get("warc-type") == "revisit" else base32_sha1(x.payload))
    return (
        archive, x.start, x.end, None, h.get("warc-type"), _number(h.get("warc-record-id")), h.get("warc-target-uri"), _number(h.get("warc-refers-to")),
        int(size[1]) if size else len(x.payload), digest and digest.removeprefix("sha1:"), x.payload,
    )


def _reading(payloads: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size in zip(*(batch.column(c).to_pylist() for c in ("path", "length")), strict=True):
                store, place = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
                rows, held = [], 0
                with store.open_input_file(place) as file:
                    for x in salvage(Source(file, size)):
                        rows.append(_row(path, x)[: None if payloads else -1])
                        held += 256 + payloads * len(x.payload)
                        if held > 4 << 20:
                            yield _batch(rows, payloads)
                            rows, held = [], 0
                yield _batch(rows, payloads)

    return run


def _batch(rows: list[tuple], payloads: bool) -> pa.RecordBatch:
    fields = [*_FIELDS][: None if payloads else -1]
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=pa.schema(fields))


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """A row per record and per gap of all archives in ``folder``, a URI that all executors reach.

    Gaps have ``gap`` (the reason), ``start`` and ``stop`` (the archive's bytes set aside) and no
    other fields, and are logged by the executors; records have ``gap`` null. ``payloads`` false leaves
    that column out. Header names may have any case, headers and URLs any length. A record without
    a payload digest gets its payload's own, a revisit without one has null.

    An archive is read in order by one task, in windows by offset, so that it may be larger than
    memory; a record is held whole. Records that repeat and archives with the same records are all
    there; rows have the reader's columns alone, so that no name clashes. No archives give no rows.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(folder).select("path", "length")
    kinds = {pa.string(): "string", pa.int64(): "bigint", pa.binary(): "binary"}
    return files.mapInArrow(_reading(payloads), ", ".join(f"{f.name} {kinds[f.type]}" for f in [*_FIELDS][: None if payloads else -1]))

"""Salvage of damaged archives: long headers, false marks, missing digests, archives larger than a window."""

import base64
import gzip
import hashlib
import io
import random
import time
import zlib

import pytest

from panelwright.llm import warc
from panelwright.llm.runtime import new_folder


def numbers(found):
    return [warc._number(x.headers["warc-record-id"]) for x in found if not x.gap]


def test_pages_with_urls_of_any_length_come_back(spark):
    rows = [(1, "http://x/" + "u" * 70_000, "one"), (2, "http://y/" + "v" * 1_000_000, "two"), (3, "http://z/WARC/1.0 \x1f", "three")]
    folder = new_folder(spark, "warc")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), folder)
    got = {r["page_id"]: (len(r["url"]), r["payload"].decode(), r["gap"]) for r in warc.read_archives(spark, folder).collect()}
    assert got == {1: (70_009, "one", None), 2: (1_000_009, "two", None), 3: (23, "three", None)}
    assert "payload" not in warc.read_archives(spark, folder, payloads=False).columns


@pytest.mark.parametrize(
    "noise",
    [b"\x1f\x8b\x08", b"\x1f\x8b\x08\x00", b"\x1f\x8b\x08\x08abcdefg", b"\x1f\x8b\x08\x1f", b"WARC/1.0\r\n", b"WARC/1.1\r\nA: b\r\n", b"x:WARC/1.0\r\n", b"WARC/1.", b"WARC/1.0\r\nContent-Length: 99999999999\r\n\r\n", b"\x1f\x8b\x08\x00" + b"\x00" * 6 + b"\x00\x05\x00\xfa\xffhello"],
)
def test_a_megabyte_of_false_marks(noise):
    sound = warc.record(7, "http://x", b"body", None, False)
    seconds = []
    for size in (1 << 15, 1 << 20):
        junk = noise * (size // len(noise))
        began = time.thread_time()
        found = [*warc.salvage(junk + sound + gzip.compress(sound))]
        seconds.append(time.thread_time() - began)
    assert seconds[1] < 10 and seconds[1] < 100 * seconds[0]
    assert numbers(found)[-2:] == [7, 7] and found[0].gap and found[-1].end == len(junk) + len(sound) + len(gzip.compress(sound))


def test_time_by_megabyte_of_damaged_archives():
    draw = random.Random(3)
    seconds = []
    for n in (400, 3200):
        parts = [bytearray(gzip.compress(warc.record(i, "http://x", draw.randbytes(3000), None, False))) for i in range(n)]
        for part in parts[::3]:
            part[draw.randrange(20, len(part))] ^= 255
        data = b"".join(parts)
        began = time.thread_time()
        found = [*warc.salvage(data)]
        seconds.append((time.thread_time() - began) / n)
        assert [i for i in range(n) if i % 3] == [k for k in numbers(found) if k % 3]
        assert [(a.end, b.start) for a, b in zip(found, found[1:], strict=False)] == [(b.start, b.start) for b in found[1:]]
    assert seconds[1] < 3 * seconds[0]


def test_digests_that_other_writers_leave_out():
    body = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:9>\r\nContent-Length: 24\r\n\r\nHTTP/1.1 200 OK\r\n\r\nhello\r\n\r\n"
    (found,) = warc.salvage(body)
    row = warc._row("a", found)
    assert row[9] == base64.b32encode(hashlib.sha1(b"hello").digest()).decode() and row[8] == 5
    revisit = body.replace(b"response", b"revisit")
    assert warc._row("a", next(iter(warc.salvage(revisit))))[9] is None


def test_an_archive_is_read_in_windows(monkeypatch):
    """The widest read of an archive of many windows is a record, or a window."""
    records = [gzip.compress(warc.record(i, "http://x", random.Random(i).randbytes(200_000), None, False)) for i in range(40)]
    data = b"junk" * 500_000 + b"".join(records)
    widest = []

    class File(io.BytesIO):
        def read(self, n=-1):
            widest.append(n)
            return super().read(n)

    found = [*warc.salvage(warc.Source(File(data), len(data)))]
    assert numbers(found) == [*range(40)] and max(widest) <= warc.WINDOW_BYTES and sum(widest) < 3 * len(data)


def test_member_checks():
    member = bytearray(gzip.compress(warc.record(1, "http://x", b"body" * 50, None, False)))
    for place in (-1, -5):  # the length's and the checksum's bytes
        spoilt = bytearray(member)
        spoilt[place] ^= 1
        assert [x.gap for x in warc.salvage(bytes(spoilt))] == ["bad member"]
    named = io.BytesIO()
    with gzip.GzipFile("name.warc", "wb", fileobj=named) as out:
        out.write(warc.record(2, "http://x", b"named", None, False))
    assert numbers(warc.salvage(named.getvalue())) == [2]
    raw = zlib.compressobj(9, zlib.DEFLATED, 31)
    assert numbers(warc.salvage(raw.compress(warc.record(3, "u", b"", None, False)) + raw.flush())) == [3]

"""WARC archives: writing them, and reading them by byte ranges.

**Writing.**  Each page is a record in a gzip member of its own.  Of the pages
with the same payload (at least ``revisit_from`` bytes, compared by SHA-1) the
one with the largest page_id is a response; the others are revisits, which name
it and hold no payload.  Each task writes one archive under a name of its own
in the shared folder.  The list of archives is what the tasks that succeeded
have returned: files of failed or doubled attempts are never read.

**Reading.**  A gzip file has no index, so a task that is given a byte range
scans it for the gzip magic and takes a place for a record's start only if
decoding gives a WARC version line there and the member ends with a right
checksum where another member or the end of the file follows.  It owns all
records that *start* in its range, reads the last one past the range's end, and
leaves the record it starts within to the task before.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantops.llm.common import materialise, shared_path, whole_text

MAGIC = b"\x1f\x8b\x08"
CRLF = b"\r\n"
STEP = 1 << 20
NO_DATE = "1970-01-01T00:00:00Z"


def _open_fs(path: str):
    """A file system for a path or URI that executors share, and the path there."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:/") else (fs.LocalFileSystem(), path)


# ---- writing ------------------------------------------------------------

def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = NO_DATE) -> bytes:
    """One record as a gzip member.  ``digest``: lower-case hex SHA-1 of the
    payload; ``refers_to``: set for a revisit, whose block is the HTTP header
    alone (its Content-Length still tells the payload's).  ``date``: WARC-Date."""
    http = CRLF.join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(payload), b"", b""])
    block = http if refers_to is not None else http + payload
    head = [b"WARC/1.1", b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"), b"WARC-Record-ID: <urn:page:%s>" % str(page_id).encode(), b"WARC-Date: " + date.encode(),
            b"WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)), b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    if url is not None:
        head.append(b"WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url).encode())
    if refers_to is not None:
        head += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"WARC-Refers-To: <urn:page:%d>" % refers_to]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(CRLF.join([*head, b"", b""]) + block + CRLF + CRLF) + pack.flush()


def write_pages(pages: DataFrame, folder: str, revisit_from: int = 1000, date: str = NO_DATE) -> DataFrame:
    """Writes the archives below ``folder``; (path, bytes, records) of each.

    Null html is an empty payload.  A null page_id never stands for others and
    its row is always a response.  Of rows that share the largest page_id of a
    group each is a response; a null url leaves out the header.  ``date`` is
    the WARC-Date of all records, as pages carry no time of capture."""
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), whole_text("html").alias("html"))
    src = src.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    long_enough = (F.octet_length("html") >= revisit_from) & F.col("page_id").isNotNull()
    first = (src.where(long_enough).groupBy(F.col("digest").alias("__digest")).agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    first = materialise(first, "keepers")  # then the join is one of two plain shuffles, which AQE splits at a hot payload
    with_keeper = src.join(first, F.col("digest") == F.col("__digest"), "left").select(
        "page_id", "url", "html", "digest", F.when(long_enough & (F.col("keeper") > F.col("page_id")), F.col("keeper")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]):
        out, path, size, n = None, "", 0, 0
        for rb in batches:
            for page_id, url, html, digest, refers in zip(*(c.to_pylist() for c in rb.columns)):
                if out is None:
                    path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                    fs, at = _open_fs(path)
                    fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
                    out = fs.open_output_stream(at, compression=None)
                raw = record(page_id, url, html.encode(), digest, refers, date)
                out.write(raw)
                size, n = size + len(raw), n + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size]), pa.array([n])], names=["path", "bytes", "records"])

    return materialise(with_keeper.mapInArrow(run, "path string, bytes bigint, records bigint"), "archives")


# ---- reading ------------------------------------------------------------

class Member:
    """Decodes the gzip member at ``at``, keeping no more than one step of
    compressed bytes beside the record itself."""

    def __init__(self, f, at: int, size: int):
        self.f, self.at, self.size = f, at, size

    def decode(self, only_head: bool = False) -> tuple[bytes, int] | None:
        """(bytes, place behind the member), or None if it is no whole member.
        ``only_head``: stop after the first bytes."""
        unpack, out, at = zlib.decompressobj(31), [], self.at
        step = 256 if only_head else 1 << 16
        try:
            while not unpack.eof:
                self.f.seek(at)
                raw = self.f.read(min(step, self.size - at))
                if not raw:
                    return None
                at += len(raw)
                out.append(unpack.decompress(raw))
                if only_head and sum(map(len, out)) >= 16:
                    return b"".join(out), at
        except zlib.error:
            return None
        return b"".join(out), at - len(unpack.unused_data)


def is_start(f, at: int, size: int) -> bool:
    """Whether a record starts at ``at``: its header decodes to a WARC version
    line, and the member is whole and followed by another or by the end."""
    head = Member(f, at, size).decode(only_head=True)
    if head is None or not head[0].startswith(b"WARC/1."):
        return False
    whole = Member(f, at, size).decode()
    if whole is None:
        return False
    f.seek(whole[1])
    return whole[1] == size or f.read(3) == MAGIC


def first_start(f, start: int, end: int, size: int) -> int | None:
    """The first record's start in [start, end)."""
    at = start
    while at < end:
        f.seek(at)
        raw = f.read(min(STEP, size - at) if at < size else 0)
        i = raw.find(MAGIC)
        while i >= 0 and at + i < end:
            if is_start(f, at + i, size):
                return at + i
            i = raw.find(MAGIC, i + 1)
        if at + len(raw) >= size or not raw:
            return None
        at += max(1, len(raw) - 2)  # the magic may lie across two steps
    return None


def records(f, start: int, end: int, size: int) -> Iterator[tuple[int, bytes]]:
    """(place, bytes) of the records that start in [start, end).

    Damage raises ValueError: a member that cannot be decoded, or bytes between
    two members.  Whoever decodes a member also looks at what follows it, so a
    damaged first member of a range is noticed by the range before, and one at
    the beginning of the file by the first range."""
    at = first_start(f, start, end, size)
    if start == 0 and at != 0 and size:
        raise ValueError("no whole record at byte 0")
    while at is not None and at < min(end, size):
        got = Member(f, at, size).decode()
        if got is None or not got[0].startswith(b"WARC/1."):
            raise ValueError(f"no whole record at byte {at}")
        yield at, got[0]
        at = got[1]
    if at is not None and at < size and not is_start(f, at, size):
        raise ValueError(f"no whole record at byte {at}")


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of a record."""
    def fields(part: bytes) -> dict[str, str]:
        return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in part.decode("utf-8", "replace").split("\r\n")[1:])}
    head, _, rest = raw.partition(CRLF * 2)
    warc = fields(head)
    http, _, payload = rest[:int(warc.get("content-length", "0"))].partition(CRLF * 2)
    return warc, fields(http), payload


def _number(urn: str | None) -> int | None:
    digits = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits.lstrip("-").isdigit() else None


def read_pages(archives: DataFrame, split_bytes: int = 8 << 20) -> DataFrame:
    """Records of the listed archives: page_id, url, payload (null for a
    revisit), payload_bytes, payload_digest, record_type, refers_to.  The
    digest of a response is computed from the payload that was read; one that
    differs from its header raises, and so does a damaged or shortened archive."""
    ranges = archives.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))).alias("start"))
    # a set number of partitions: by the few bytes of these rows they would be merged into one task
    n = archives.agg(F.sum(F.ceil(F.col("bytes") / split_bytes))).first()[0] or 1
    ranges = ranges.repartition(int(n), "path", "start")
    schema = "page_id bigint, url string, payload string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def run(batches):
        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        rows, held = [], 0
        for rb in batches:
            for path, size, start in zip(*(c.to_pylist() for c in rb.columns)):
                fs, at = _open_fs(path)
                with fs.open_input_file(at) as f:
                    if f.size() != size:
                        raise ValueError(f"{path} has {f.size()} bytes, not {size}")
                    for place, raw in records(f, start, start + split_bytes, size):
                        warc, http, payload = parse(raw)
                        said = base64.b32decode(warc["warc-payload-digest"].removeprefix("sha1:")).hex()
                        response = warc["warc-type"] == "response"
                        if response and hashlib.sha1(payload).hexdigest() != said:
                            raise ValueError(f"{path}, byte {place}: the payload does not have the digest {said}")
                        rows.append((_number(warc.get("warc-record-id")), warc.get("warc-target-uri"), payload.decode("utf-8", "replace") if response else None,
                                     len(payload) if response else int(http["content-length"]), said, warc["warc-type"], _number(warc.get("warc-refers-to"))))
                        held += len(payload)
                        if held > 4 << 20 or len(rows) >= 2000:
                            yield batch(rows)
                            rows, held = [], 0
        if rows:
            yield batch(rows)

    return ranges.mapInArrow(run, schema)


def archive_round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes all pages to new archives in the shared folder and reads them back."""
    return read_pages(write_pages(pages, shared_path(spark, "warc")))

"""Legacy archive conversion (ARC to WARC) with payload revisits.

``pages_to_arc`` writes ARC 1 or 2 text, ``read_arc`` parses it by the version block, the
version's header line and the declared lengths, ``arc_to_warc`` synthesises what WARC has and
ARC lacks: record ids, ISO dates, record types and digests. ``read_warc`` reads WARC again.

``archive_pages`` runs the whole way for a table of pages: ARC in the task, WARC files in the
shared folder (gzip, at most ``records_per_file`` records and about ``file_bytes`` bytes each), and
those files read back, a record at a time.

An ARC header line may hold a content type with blanks, or bytes that are not UTF-8: fields are
counted from both ends, and such bytes are percent-encoded in a url and replaced elsewhere. A date
that is not 14 digits is filled up with its least values. Wrong lengths and unknown versions are
errors.

Defined results: null html is an empty payload; a null url becomes ``urn:page:<id>``; white
space and control characters of a url are percent-encoded; null page_id rows are responses and
are referred to by nobody; rows that repeat the referred page_id with an equal payload are
responses too; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import broadcast_if_small, new_path, released, small_batches, stored

ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
_SPACE = re.compile(r"[\x00-\x20\x7f]")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def arc_version_block(name: str, version: int, date: str = "20240101000000") -> bytes:
    body = f"{version} 0 tessera\n{ARC_FIELDS[version]}\n".encode()
    tail = f"{len(body)}\n" if version == 1 else f"200 - - 0 {name} {len(body)}\n"
    return f"filedesc://{name} 0.0.0.0 {date} text/plain {tail}".encode() + body + b"\n"


def arc_record(page_id: int | None, url: str | None, payload: bytes, version: int = 1, date: str = "20240101000000", name: str = "pages.arc") -> bytes:
    """One ARC record: its header line, then the HTTP message with the payload as its body."""
    url = _SPACE.sub(lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page_id}"
    own = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}Content-Length: {len(payload)}\r\n\r\n".encode() + payload
    extra = "" if version == 1 else f"200 {base32_sha1(payload)} - 0 {name} "
    return f"{url} 0.0.0.0 {date} text/html {extra}{len(block)}\n".encode() + block + b"\n"


def read_arc(data: bytes) -> Iterator[dict]:
    """Records of an ARC file. The version block says which fields a header line has; a record
    ends where its declared length says, whatever its bytes are."""
    at, fields = 0, None
    while at < len(data):
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError(f"header line at byte {at} has no end")
        if end == at:  # separator between records
            at += 1
            continue
        parts = data[at:end].rstrip(b"\r").split(b" ")
        size = int(parts[-1])
        block = data[end + 1 : end + 1 + size]
        if len(block) < size:
            raise ValueError(f"record at byte {at} declares {size} bytes and has {len(block)}")
        at = end + 1 + size
        if parts[0].startswith(b"filedesc://"):
            version = int(block.split(b" ", 1)[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"unknown ARC version {version}")
            fields = block.split(b"\n")[1].decode().split(" ")
            continue
        if fields is None:
            raise ValueError("no version block before the first record")
        if len(parts) < len(fields):
            raise ValueError(f"header line has {len(parts)} fields, its version {len(fields)}")
        more, kind = len(parts) - len(fields), fields.index("Content-type")
        parts[kind : kind + more + 1] = [b" ".join(parts[kind : kind + more + 1])]
        values = [p.decode("utf-8", "replace") for p in parts]
        try:
            values[0] = parts[0].decode()
        except UnicodeDecodeError:
            values[0] = "".join(chr(x) if x < 128 else f"%{x:02X}" for x in parts[0])
        yield dict(zip(fields, values, strict=True)) | {"block": block}


def _http(block: bytes) -> tuple[bytes, dict[str, str], bytes]:
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"HTTP/"):
        return b"", {}, block
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return head + gap, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, body


def record_id(page_id: int | str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def arc_to_warc(record: dict, refers_to: int | None = None) -> bytes:
    """The WARC record for an ARC record: ``response``, or ``revisit`` of page ``refers_to``,
    whose block keeps the HTTP head only. The caller knows of equal payloads; ARC does not."""
    head, http, body = _http(record["block"])
    date = re.sub("[^0-9].*", "", record["Archive-date"])[:14]
    date += "00000101000000"[len(date) :]
    own = http.get("x-page-id", f"{record['URL']} {date}")
    lines = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(own)}",
        f"WARC-Date: {date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z",
        f"WARC-Target-URI: {record['URL']}",
        f"WARC-IP-Address: {record['IP-address']}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(body)}",
    ]
    block = record["block"]
    if refers_to is not None:
        block = head
        lines += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}", f"X-Refers-To-Page-Id: {refers_to}"]
    lines += [f"WARC-Block-Digest: sha1:{base32_sha1(block)}", f"Content-Type: {'application/http; msgtype=response' if head else record['Content-type']}", f"Content-Length: {len(block)}"]
    return ("WARC/1.0\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def read_warc(chunks: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record of a file that comes in chunks; what
    is held is one record."""
    data, chunks, start = bytearray(), iter(chunks), 0

    def filled(n: int) -> bool:
        """Whether there are ``n`` more bytes."""
        while len(data) < n:
            more = next(chunks, None)
            if more is None:
                return False
            data.extend(more)
        return True

    while filled(1):
        look = 0
        while (end := data.find(b"\r\n\r\n", look)) < 0:
            look = max(0, len(data) - 3)
            if not filled(len(data) + 1):
                raise ValueError(f"header at byte {start} has no end")
        version, *lines = data[:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC version at byte {start}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(head["content-length"])
        if not filled(end + 8 + size) or data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"record at byte {start} ends without its mark")
        yield head, bytes(data[end + 4 : end + 4 + size])
        del data[: end + 8 + size]
        start += end + 8 + size


def unzipped(data: pa.Buffer) -> Iterator[bytes]:
    """The contents of a gzip file of one or more members, some at a time."""
    view, reader = memoryview(data), zlib.decompressobj(31)
    for at in range(0, len(view), 1 << 16):
        rest = bytes(view[at : at + (1 << 16)])
        while rest:
            if reader.eof:
                reader = zlib.decompressobj(31)
            yield reader.decompress(rest, 1 << 20)
            rest = reader.unconsumed_tail or reader.unused_data
    yield reader.flush()


def page_row(head: dict[str, str], block: bytes) -> tuple:
    """What ``archive_pages`` returns of a record; a response's digest is taken anew."""
    _, http, body = _http(block)
    revisit = head["warc-type"] == "revisit"
    digest = head["warc-payload-digest"].removeprefix("sha1:")
    if not revisit and digest != base32_sha1(body):
        raise ValueError(f"payload of {head['warc-record-id']} does not match its digest")
    own, other = http.get("x-page-id"), head.get("x-refers-to-page-id")
    return (int(own) if own is not None else None, int(http["content-length"]) if revisit else len(body), digest, head["warc-type"], int(other) if other is not None else None, head["warc-record-id"], head["warc-target-uri"])


def _to_warc(version: int):
    def convert(batches):
        first = arc_version_block("pages.arc", version)
        for batch in batches:
            out = []
            for page_id, url, html, refers in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "html", "refers")), strict=True):
                arc = first + arc_record(page_id, url, html or b"", version)
                # the text writer adds the last CR LF
                out += [arc_to_warc(r, refers)[:-2] for r in read_arc(arc)]
            yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.binary())})

    return convert


_ROW = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string()), ("target_uri", pa.string())])


def _from_warc(batches):
    for batch in batches:
        for content in batch["content"]:
            rows = [page_row(*r) for r in read_warc(unzipped(content.as_buffer()))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(_ROW), _ROW, strict=True)], schema=_ROW)


def archive_pages(pages: DataFrame, version: int = 1, records_per_file: int = 1000, file_bytes: int = 128 << 20, min_revisit_bytes: int = 0, broadcast_rows: int = 50_000) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as WARC converted from ARC, and read the files back.

    Only digests that occur more than once are joined to the pages; that side is broadcast when
    it has at most ``broadcast_rows`` rows, else the join shuffles and adaptive execution splits
    a digest that holds many rows.
    """
    spark = pages.sparkSession
    small_batches(spark)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("html"))
    rows = rows.withColumn("sha", F.sha1("html"))
    shared = stored(rows.filter(F.octet_length("html") >= min_revisit_bytes).groupBy("sha").agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).filter("n > 1").select("sha", "kept"), "warc-shared")
    joined = rows.join(broadcast_if_small(shared, broadcast_rows), "sha", "left")
    refers = F.when(F.col("page_id") != F.col("kept"), F.col("kept"))
    archive = new_path(spark, "warc")
    longest = rows.agg(F.max(F.octet_length("html"))).first()[0] or 0
    records_per_file = max(1, min(records_per_file, file_bytes // (longest + 1000)))
    (
        joined.select("page_id", "url", "html", refers.alias("refers"))
        .mapInArrow(released(_to_warc(version)), "value binary")
        .select(F.col("value").cast("string").alias("value"))
        .write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(archive)
    )
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(archive)
    return files.select("content").mapInArrow(released(_from_warc), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, target_uri string")

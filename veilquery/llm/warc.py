"""Web archives: ARC writing, conversion of ARC to WARC, and reading WARC back.

Archives are written by Spark's own text writer, one file a row, so that they land
on any file system Spark knows and survive lost tasks.  An ARC record ends with a line
feed and a WARC record with two CR LF, which the writer sets behind the last one;
inside a file records are found by their declared lengths alone.

The converter parses the header lines of versions 1 (URL, IP, date, type, length) and
2 (URL, IP, date, type, result code, checksum, location, offset, file name, length)
as the file's own version block names them, takes the payload by the declared length,
and synthesises WARC-Record-ID (a name-based UUID of URL, date and block), WARC-Date,
WARC-Type, and SHA-1 block and payload digests.  A revisit names the response's id, URL and date.  Payloads are bytes
of any kind.  Malformed ARC records fail the job or, by option, are skipped.  A file is written and read as one value
of at most ``file_bytes`` (32 MB by default); a record above that gets a file of its own.

Pages: null html is an empty payload, null or blank URLs become "urn:none", white space
and control characters in a URL are percent-encoded in header lines.  Repeated rows are
archived as often as they occur (with one record id where page_id, URL and payload are equal).  With equal payloads the largest page_id is the
response; rows that share that page_id are all responses.  An empty table makes no
records.  Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilquery.llm._common import shared_folder

#: Fixed by the formats: fields of an ARC header line by version; record ends.
ARC_FIELDS = {
    "1": "URL IP-address Archive-date Content-type Archive-length",
    "2": "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
ARC_END, WARC_END = "\n", "\r\n\r\n"
FILE_BYTES = 1 << 25


def _url(url: str | None) -> str:
    url = re.sub(r"[\x00-\x20\x7f\s]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), (url or "").strip())
    return url or "urn:none"


def _http(page_id, payload: bytes) -> bytes:
    lines = ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + payload


def arc_version_block(version: str, date: str) -> bytes:
    body = f"{version} 0 archive\n{ARC_FIELDS[version]}\n".encode()
    head = ["filedesc://pages.arc", "0.0.0.0", date, "text/plain"] + (["200", "-", "-", "0", "pages.arc"] if version == "2" else [])
    return " ".join([*head, str(len(body))]).encode() + b"\n" + body


def arc_record(version: str, url: str | None, ip: str, date: str, block: bytes) -> bytes:
    head = [_url(url), ip, date, "text/html"]
    if version == "2":
        head += ["200", hashlib.md5(block).hexdigest(), "-", "0", "pages.arc"]
    return " ".join([*head, str(len(block))]).encode() + b"\n" + block


def arc_header(line: bytes, fields: list[str]) -> dict[str, str] | None:
    """Fields of a header line, or None if it does not fit.  A content type may hold spaces; all other fields cannot, so the
    line is read from both ends."""
    parts = line.decode("utf-8", "replace").split(" ")
    if len(parts) < len(fields) or not parts[-1].isdigit() or not re.fullmatch(r"\d{14}", parts[2]):
        return None
    kind = fields.index("Content-type")
    behind = len(fields) - kind - 1
    values = [*parts[:kind], " ".join(parts[kind : len(parts) - behind]), *parts[len(parts) - behind :]]
    return dict(zip(fields, values, strict=True))


def parse_arc(data: bytes, *, malformed: str = "fail") -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record after the version block.  With ``malformed="skip"`` lines that are no header are passed
    over up to the next that is one, and a record that is cut short is left out; else either raises ValueError."""
    at, fields = 0, None
    while at < len(data):
        if data[at : at + 1] == b"\n":
            at += 1
            continue
        end = data.find(b"\n", at)
        line = data[at : end if end >= 0 else len(data)]
        if line.startswith(b"filedesc:") and line.rpartition(b" ")[2].isdigit():
            block = data[end + 1 : end + 1 + int(line.rpartition(b" ")[2])]
            named = block.decode("utf-8", "replace").split("\n")
            if len(named) > 1 and ARC_FIELDS.get(named[0].split(" ")[0]) == named[1]:
                fields, at = named[1].split(" "), end + 1 + len(block)
                continue
            raise ValueError(f"unknown ARC version block {named[:2]}")
        header = arc_header(line, fields) if fields else None
        length = int(header["Archive-length"]) if header else 0
        if header is None or end < 0 or end + 1 + length > len(data):
            if malformed != "skip":
                raise ValueError(f"ARC record at {at} is cut short" if header else f"ARC header line at {at} does not fit its version")
            at += len(line) + 1
            continue
        at = end + 1 + length
        yield header, data[end + 1 : at]


def split_http(block: bytes) -> tuple[bytes, dict[str, str], bytes]:
    """Head, header fields and payload; a block that is no HTTP response is all payload.  Names are kept as they are written;
    lines without a colon are no fields."""
    if not block.startswith(b"HTTP/"):
        return b"", {}, block
    end = re.search(rb"\r?\n\r?\n", block)
    at = end.end() if end else len(block)
    lines = block[:at].decode("utf-8", "replace").splitlines()[1:]
    fields = {k.strip(): v.strip() for k, colon, v in (x.partition(":") for x in lines) if colon}
    return block[:at], fields, block[at:]


def sha1_label(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*names) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join(map(str, names)))}>"


def warc_record(kind: str, url: str, date: str, block: bytes, payload_digest: str | None, more: dict[str, str], own_id: str | None = None) -> bytes:
    """A record without its end.  Unless it is given, the id is a UUID named by what the record holds."""
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}",
        f"WARC-Record-ID: {own_id or record_id(kind, url, date, sha1_label(block), *more.values())}",
        f"WARC-Date: {date}", f"WARC-Block-Digest: {sha1_label(block)}",
    ]
    if kind == "warcinfo":
        lines.append("Content-Type: application/warc-fields")
    else:
        lines += [f"WARC-Target-URI: {url}", "Content-Type: application/http; msgtype=response"]
    if payload_digest:
        lines.append(f"WARC-Payload-Digest: {payload_digest}")
    lines += [f"{k}: {v}" for k, v in more.items()]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        length = int(fields["Content-Length"])
        block = data[end + 4 : end + 4 + length]
        if len(block) != length or data[end + 4 + length : end + 8 + length] != b"\r\n\r\n":
            raise ValueError(f"WARC record at {at} is cut short")
        yield fields, block
        at = end + 8 + length


class _Files:
    """Collects records to files: each is one row of the text writer and begins with a record of its own."""

    def __init__(self, end: str, file_bytes: int, begin: Callable[[int], bytes]):
        """``begin`` makes the first record of the file of a number."""
        self.end, self.file_bytes, self.begin = end.encode(), file_bytes, begin
        self.records: list[bytes] = []
        self.size = self.written = 0

    def add(self, record: bytes) -> Iterator[pa.RecordBatch]:
        """Take a record; yields the file before it when that is full."""
        if self.records and self.size + len(self.end) + len(record) > self.file_bytes:
            yield from self.close()
        if not self.records:
            self.records = [self.begin(self.written)]
            self.size = len(self.records[0])
        self.records.append(record)
        self.size += len(self.end) + len(record)

    def close(self) -> Iterator[pa.RecordBatch]:
        """The file so far.  Its bytes need not be UTF-8; the text writer takes and writes them as they are."""
        if self.records:
            value = self.end.join(self.records)
            self.records, self.size, self.written = [], 0, self.written + 1
            yield pa.RecordBatch.from_arrays([pa.array([value], pa.binary()).cast(pa.string(), safe=False)], ["value"])


def _write(files: DataFrame, end: str, path: str) -> None:
    out = files.write.option("lineSep", end).option("maxRecordsPerFile", 1)
    out.option("compression", "gzip").option("zlib.compress.level", "FOUR").text(path)


def _as_arc(version: str, date: str, ip: str, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Files(ARC_END, file_bytes, lambda _: arc_version_block(version, date))
        for batch in batches:
            for page_id, url, html in zip(*(batch.column(i) for i in range(3)), strict=True):
                block = _http(page_id.as_py(), (html.as_py() or "").encode())
                yield from files.add(arc_record(version, url.as_py(), ip, date, block))
        yield from files.close()

    return run


def write_arc(
    pages: DataFrame, path: str, *, version: str = "1", date: str = "20240101000000", ip: str = "0.0.0.0", file_bytes: int = FILE_BYTES
) -> None:
    """ARC files of at most ``file_bytes`` before compression (or one record), each with its version block."""
    files = pages.select("page_id", "url", "html").mapInArrow(_as_arc(version, date, ip, file_bytes), "value string")
    _write(files, ARC_END, path)


def _from_arc(malformed: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "url", "date", "bytes", "digest", "block"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    for batch in batches:
        for file in batch.column(0):
            rows: list[list] = [[] for _ in names]
            for fields, block in parse_arc(file.as_buffer().to_pybytes(), malformed=malformed):
                _, http, payload = split_http(block)
                page = http.get("X-Page-Id", "")
                values = (int(page) if re.fullmatch(r"-?\d{1,18}", page) else None, fields["URL"], fields["Archive-date"], len(payload), hashlib.sha1(payload).hexdigest(), block)
                for column, v in zip(rows, values, strict=True):
                    column.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names
            )


def read_arc(spark: SparkSession, path: str, *, malformed: str = "fail") -> DataFrame:
    """page_id (null where a record names none), url, date, bytes and digest (SHA-1 hex) of the payload, block."""
    files = spark.read.text(path, wholetext=True)
    return files.mapInArrow(partial(_from_arc, malformed), "page_id long, url string, date string, bytes long, digest string, block binary")


def _iso(date: str) -> str:
    return f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"


def _as_warc(file_bytes: int, conversion: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, written, when = TaskContext.get().partitionId(), 0, ""
        about = b"format: WARC File Format 1.1\r\nconformsTo: converted from ARC\r\n"
        files = _Files(WARC_END, file_bytes, lambda n: warc_record("warcinfo", "", when, about, None, {}, record_id(conversion, task, "file", n)))
        for batch in batches:
            for page_id, url, date, digest, block, size, refers, target_url, target_date in zip(*(batch.column(i) for i in range(9)), strict=True):
                page_id, url, date, digest, refers = (x.as_py() for x in (page_id, url, date, digest, refers))
                when, block = _iso(date), block.as_buffer().to_pybytes()
                label = "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
                own = {} if page_id is None else {"X-Page-Id": str(page_id)}
                if refers is None:
                    # a record without a page id is known by its place, as nothing refers to it
                    name = record_id(conversion, page_id, url, date, digest) if page_id is not None else record_id(conversion, task, written)
                    record = warc_record("response", url, when, block, label, own, name)
                else:
                    target_url, target_date = target_url.as_py(), target_date.as_py()
                    own |= {
                        "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_id(conversion, refers, target_url, target_date, digest),
                        "WARC-Refers-To-Target-URI": target_url, "WARC-Refers-To-Date": _iso(target_date), "X-Refers-To-Page": str(refers), "X-Payload-Bytes": str(size.as_py()),
                    }
                    record = warc_record("revisit", url, when, split_http(block)[0], label, own, record_id(conversion, task, written))
                yield from files.add(record)
                written += 1
        yield from files.close()

    return run


def convert_arc(spark: SparkSession, arc_path: str, warc_path: str, *, least_bytes: int = 1000, file_bytes: int = FILE_BYTES, malformed: str = "fail") -> None:
    """WARC files from ARC files.  Of records with equal payloads of at least ``least_bytes`` the largest
    page_id stays a response and the others become revisits of it; the choice is one small aggregation of
    digests, joined back to the records without moving other payloads than Spark must."""
    records = read_arc(spark, arc_path, malformed=malformed)
    groups = (
        records.where(f"bytes >= {least_bytes}").groupBy("digest", "bytes")
        .agg(F.max("page_id").alias("target"), F.max_by(F.struct("url", "date"), "page_id").alias("at"), F.count("*").alias("n")).where("n > 1")
        .select("digest", "bytes", "target", F.col("at.url").alias("target_url"), F.col("at.date").alias("target_date"))
    )
    joined = records.join(groups, ["digest", "bytes"], "left").select(
        "page_id", "url", "date", "digest", "block", "bytes", F.when(~F.col("target").eqNullSafe(F.col("page_id")), F.col("target")).alias("refers"), "target_url", "target_date"
    )
    _write(joined.mapInArrow(_as_warc(file_bytes, uuid.uuid4().hex), "value string"), WARC_END, warc_path)


def _from_warc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "url", "date", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    for batch in batches:
        for file in batch.column(0):
            rows: list[list] = [[] for _ in names]
            for fields, block in parse_warc(file.as_buffer().to_pybytes()):
                kind = fields["WARC-Type"]
                if kind == "warcinfo":
                    continue
                if sha1_label(block) != fields["WARC-Block-Digest"]:
                    raise ValueError(f"block digest of {fields['WARC-Record-ID']} does not fit")
                _, http, payload = split_http(block)
                digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                    raise ValueError(f"payload digest of {fields['WARC-Record-ID']} does not fit")
                page, target = fields.get("X-Page-Id"), fields.get("X-Refers-To-Page")
                size = len(payload) if kind == "response" else int(fields.get("X-Payload-Bytes", http.get("Content-Length", 0)))
                values = (
                    None if page is None else int(page), fields["WARC-Target-URI"], fields["WARC-Date"], size, digest, kind,
                    None if target is None else int(target),
                )
                for column, v in zip(rows, values, strict=True):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, date, payload_bytes, payload_digest, record_type, refers_to; digests are verified."""
    files = spark.read.text(path, wholetext=True)
    return files.mapInArrow(
        _from_warc, "page_id long, url string, date string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    )


def archive_and_read(pages: DataFrame, *, version: str = "1", folder: str | None = None) -> DataFrame:
    """Pages to ARC, ARC to WARC, WARC to rows; the archives stay in a new folder below ``folder``
    (the session's checkpoint folder by default)."""
    spark = pages.sparkSession
    base = f"{folder or shared_folder(spark)}/archives-{uuid.uuid4().hex}"
    write_arc(pages, f"{base}/arc", version=version)
    convert_arc(spark, f"{base}/arc", f"{base}/warc")
    return read_warc(spark, f"{base}/warc")

"""Legacy archive converter: ARC records become WARC records, which are written, deduplicated and read back.

An ARC file starts with a version block; its version says which fields a record's header line has. A record's declared
length, not its content, ends it. From these fields the converter synthesises what WARC asks for: record identifiers, ISO
timestamps, record types and digests. Records with equal payloads are written once, as ``response``; the others refer to it.
Archives are written by Spark's own writer (committed per task, so a lost executor leaves no half archive) into the
shared folder, one gzip stream a file.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotlens.llm.common import fresh_path, materialise, ship

#: Header fields of a URL record by ARC version.
FIELDS = {
    b"1": ("url", "ip", "date", "type", "length"),
    b"2": ("url", "ip", "date", "type", "status", "checksum", "location", "offset", "filename", "length"),
}
LINES = {
    b"1": b"URL IP-address Archive-date Content-type Archive-length",
    b"2": b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
RECORD = "record_id string, record_type string, uri string, date string, ip string, media string, http binary, payload_bytes long, payload_digest string, page_id long, cut boolean"


#: An own header field (readers skip what they don't know) for the payload's bytes, which a revisit's block doesn't show.
LENGTH = "X-Payload-Length"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


class _Stream:
    """Bytes of a file, gzip ones (of one member or many) unpacked piece by piece."""

    def __init__(self, data: bytes, piece: int = 1 << 18):
        packed = data[:2] == b"\x1f\x8b"
        self.data, self.piece, self.at, self.left, self.z = data if packed else b"", piece, 0, b"" if packed else data, zlib.decompressobj(31)
        self.from_ = 0  # of what is left, unread from here on

    def more(self) -> bool:
        while True:
            if self.z.eof:  # archives may have a gzip member for each record
                self.at -= len(self.z.unused_data)
                self.z = zlib.decompressobj(31)
            if self.at >= len(self.data):
                return False
            part = self.data[self.at : self.at + self.piece]
            self.at += len(part)
            got = self.z.decompress(part)
            if got:
                self.left, self.from_ = self.left[self.from_ :] + got, 0
                return True

    def until(self, mark: bytes) -> bytes | None:
        """What comes before the next mark, which is passed over; None, with nothing read, without one."""
        seen = 0
        while (end := self.left.find(mark, self.from_ + seen)) < 0:
            seen = max(0, len(self.left) - self.from_ - len(mark))
            if not self.more():
                return None
        out, self.from_ = self.left[self.from_ : end], end + len(mark)
        return out

    def some(self, n: int) -> bytes:
        """The next n bytes, or all that are left."""
        parts, have = [], 0
        while True:
            part = self.left[self.from_ : self.from_ + n - have]
            parts.append(part)
            have, self.from_ = have + len(part), self.from_ + len(part)
            if have == n or not self.more():
                return b"".join(parts)

    def take(self, n: int) -> bytes:
        out = self.some(n)
        if len(out) < n:
            raise ValueError("archive ends within a record")
        return out


def split_http(content: bytes) -> tuple[bytes, bytes]:
    """(HTTP header with the empty line that ends it, what follows); lines may end in LF alone. No such line: all of it follows."""
    end = re.search(rb"\r?\n\r?\n", content)
    return (content[: end.end()], content[end.end() :]) if end else (b"", content)


# --- ARC ---


def write_arc(records: list[tuple[str, str, str, str, bytes]], version: bytes, name: str) -> bytes:
    """An ARC file of (url, ip, 14-digit date, content type, content) records."""
    about = version + b" 0 lotlens\n" + LINES[version] + b"\n"
    head = [f"filedesc://{name}", "0.0.0.0", "20000101000000", "text/plain"]
    out = [" ".join([*head, *([] if version == b"1" else ["200", "-", "-", "0", name]), str(len(about))]).encode() + b"\n" + about + b"\n"]
    at = len(out[0])
    for url, ip, date, kind, content in records:
        url = re.sub(r"[\s\x00-\x1f]", lambda m: f"%{ord(m[0]):02X}", url) or "-"
        more = [] if version == b"1" else ["200", sha1_base32(content), "-", str(at), name]
        out.append(" ".join([url, ip, date, kind, *more, str(len(content))]).encode() + b"\n" + content + b"\n")
        at += len(out[-1])
    return b"".join(out)


def as_text(line: bytes) -> str:
    """A header line; bytes that are not UTF-8 become percent escapes."""
    try:
        return line.decode()
    except UnicodeDecodeError:
        return re.sub(rb"[\x80-\xff]", lambda m: b"%%%02X" % m[0][0], line).decode()


#: How a header line goes on after the address: its IP and date are told by their form, as addresses and content types may hold spaces.
_ANCHOR = r"(?P<url>.+?) (?P<ip>\d{1,3}(?:\.\d{1,3}){3}|[0-9A-Fa-f]*:[0-9A-Fa-f:.]+|-) (?P<date>\d{4,17}) (?P<type>.*?)"
HEADER = {
    b"1": re.compile(_ANCHOR + r" (?P<length>\d+)"),
    b"2": re.compile(_ANCHOR + r" (?P<status>\S+) (?P<checksum>\S+) (?P<location>\S+) (?P<offset>\S+) (?P<filename>\S+) (?P<length>\d+)"),
}


def header_fields(line: str, version: bytes) -> dict[str, str] | None:
    """The fields of a header line; where IP and date don't have their form, it is split from the right. None: no header."""
    if m := HEADER[version].fullmatch(line):
        return m.groupdict()
    names = FIELDS[version]
    parts = line.rsplit(" ", len(names) - 1)
    return dict(zip(names, parts, strict=True)) if len(parts) == len(names) and parts[-1].isdigit() else None


def parse_arc(data: bytes, lenient: bool = False) -> Iterator[tuple[dict[str, str], bytes, bool]]:
    """(header fields, content, whether the file ends early) of each record after the version block of an ARC file, packed by gzip or not.

    A line that is no header or has no length, and a file without a version block, are errors; if lenient, a record with the one
    field ``bad``, the line, stands for them, and reading goes on at the next line whose IP and date have their form.
    """
    s = _Stream(data)
    first = (s.until(b"\n") or b"").rstrip(b"\r")
    told = first.split(b" ")
    about = s.some(int(told[-1])) if first.startswith(b"filedesc://") and told[-1].isdigit() else b""
    version = about[:1]
    if version not in FIELDS:
        if not lenient:
            raise ValueError(f"unknown ARC version {version!r}" if about else "not an ARC file: no version block")
        yield {"bad": as_text(first)}, b"", False
        return
    lost = False
    while True:
        raw = s.until(b"\n")
        last = raw is None
        line = as_text((s.some(1 << 16) if last else raw).rstrip(b"\r"))
        if not line:
            if last:
                return
            continue
        head = None if last else HEADER[version].fullmatch(line) if lost else header_fields(line, version)
        if head is None:
            if not lenient:
                raise ValueError(f"bad ARC header line: {line[:80]!r}")
            if not lost:
                yield {"bad": line}, b"", last
            lost = True
            if last:
                return
            continue
        head, lost = head if isinstance(head, dict) else head.groupdict(), False
        content = s.some(int(head["length"]))
        yield head, content, len(content) < int(head["length"])


def as_warc(head: dict[str, str], content: bytes, cut: bool) -> tuple[tuple, bytes]:
    """(fields of RECORD, payload) that stand for an ARC record.

    Content that starts with an HTTP status line is a response, its payload what follows the HTTP header, whose bytes are kept
    as they are; other content is a resource of the record's content type. A bad line has type ``bad``, and the line as its address.
    """
    if "bad" in head:
        return (None, "bad", head["bad"], None, None, None, b"", 0, None, None, cut), b""
    http, payload = split_http(content) if content.startswith(b"HTTP/") else (b"", content)
    d = (head["date"] + "00000101000000"[len(head["date"]) :])[:14] if head["date"].isdigit() else "19700101000000"
    page = re.search(rb"(?im)^x-page-id: (-?\d+)\r?$", http)
    digest = sha1_base32(payload)
    name = uuid.uuid5(uuid.NAMESPACE_URL, "\n".join([head["url"], d, digest, http.decode("latin-1")]))
    media = "application/http; msgtype=response" if http else head["type"] if "/" in head["type"] else "application/octet-stream"
    fields = (f"<urn:uuid:{name}>", "response" if http else "resource", head["url"], f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:]}Z", head["ip"], media, http, len(payload), digest, int(page[1]) if page else None, cut)
    return fields, payload


def arc_to_warc(arcs: DataFrame, content_col: str = "content", payloads: bool = True, lenient: bool = False) -> DataFrame:
    """WARC record fields, and the payload (binary) if asked for, of whole ARC files such as the ``binaryFile`` source reads, packed by gzip or not.

    A file is held by one task at a time, unpacked piece by piece; an empty or null one has no records. A record that its file cuts
    short is marked. A bad header line fails the job, or, if lenient, becomes a row of type ``bad`` with the line as its uri: leave these
    out before writing. Other columns than the content aren't read, whatever their names; an empty table gives an empty result.
    """
    ship(arcs.sparkSession)
    names = [x.split()[0] for x in RECORD.split(", ")] + ["payload"] * payloads

    def convert(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for data in f["content"]:
                rows = [(*fields, payload) if payloads else fields for fields, payload in (as_warc(*r) for r in parse_arc(bytes(data), lenient))] if data else []
                yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64"})

    return arcs.select(F.col(content_col).alias("content")).mapInPandas(convert, RECORD + ", payload binary" * payloads)


# --- WARC ---


def mark_revisits(records: DataFrame, with_payload: DataFrame, few: int = 100_000) -> DataFrame:
    """``with_payload`` with refers_to: null for the record that keeps its payload, else that record's identifier.

    Of equal payloads (digest and length), the record of the smallest page_id keeps it, null ones last, then the smallest
    identifier; repeats of the same capture share an identifier and all keep it. Only digests meet to find that out; a payload that a
    third of all records hold is one of them. Up to ``few`` repeated payloads are then sent to the records, which stay where they are;
    more of them are joined, the partition of a very common one split by Spark at run time. Columns named like an output column or
    ``first`` are replaced; no records give an empty result.
    """
    key = ["payload_digest", "payload_bytes"]
    order = F.struct(F.col("page_id").isNull().alias("n"), "page_id", "record_id", "uri", "date")
    first = records.groupBy(*key).agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies")
    first = materialise(first, "repeated")
    if first.count() <= few:
        first = F.broadcast(first)
    again = F.col("first.record_id") != F.col("record_id")
    return with_payload.drop("first", "refers_to", "refers_uri", "refers_date").join(first, key, "left").withColumns({
        "record_type": F.when(again, "revisit").otherwise(F.col("record_type")),
        "refers_to": F.when(again, F.col("first.record_id")),
        "refers_uri": F.when(again, F.col("first.uri")),
        "refers_date": F.when(again, F.col("first.date")),
    }).drop("first")


def write_warc(records: DataFrame, path: str, records_per_file: int) -> None:
    """Write records (with payload and the columns of ``mark_revisits``) as gzip WARC files of at most so many records.

    Bytes of HTTP headers and payloads are written as they are, whatever their encoding. A revisit has its HTTP header, if any, and no payload.
    """
    crlf = F.lit("\r\n")
    revisit = F.col("refers_to").isNotNull()
    http = F.col("http")
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    line = lambda name, col: F.when(col.isNotNull(), F.concat(F.lit(name + ": "), col, crlf)).otherwise("")
    head = F.concat(
        F.lit("WARC/1.0\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", F.col("record_id")),
        line("WARC-Date", F.col("date")),
        line("WARC-Target-URI", F.col("uri")),
        line("WARC-IP-Address", F.col("ip")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        line("WARC-Refers-To", F.col("refers_to")),
        line("WARC-Refers-To-Target-URI", F.col("refers_uri")),
        line("WARC-Refers-To-Date", F.col("refers_date")),
        line("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"))),
        line("WARC-Truncated", F.when(F.col("cut"), F.lit("length"))),
        line(LENGTH, F.col("payload_bytes").cast("string")),
        line("Content-Type", F.col("media")),
        line("Content-Length", F.octet_length(block).cast("string")),
        crlf,
    )
    # The writer ends each record with the line separator, after the one that is written here.
    record = F.concat(head.cast("binary"), block, crlf.cast("binary")).cast("string")
    records.select(record.alias("value")).write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields by lower-case name, block) of each record of a gzip WARC file."""
    s = _Stream(data)
    while (head := s.until(b"\r\n\r\n")) is not None:
        lines = as_text(head.lstrip(b"\r\n")).split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:60]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        yield fields, s.take(int(fields["content-length"]))
        if s.take(4) != b"\r\n\r\n":
            raise ValueError("a record's length is wrong")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, record_type, uri, date, page_id, payload_bytes, payload_digest, refers_to, block_bytes) of all records in a folder.

    A payload that is there is measured, and its digest checked if it is a base-32 SHA-1 (one that is missing or of another kind
    is replaced by it). A revisit's length comes from its own header fields, those of HTTP last; if neither has it, it is null
    here, and that of the record it refers to in ``resolve_revisits``. Records of any type are read, also without a content type.
    """
    ship(spark)
    schema = "record_id string, record_type string, uri string, date string, page_id long, payload_bytes long, payload_digest string, refers_to string, block_bytes long"

    def row(f: dict[str, str], block: bytes) -> tuple:
        http, payload = split_http(block) if f.get("content-type", "").startswith("application/http") else (b"", block)
        told, n = f.get("warc-payload-digest"), len(payload)
        digest = told.removeprefix("sha1:") if told and re.fullmatch("sha1:[A-Z2-7]{32}", told) else None
        if f.get("warc-type") == "revisit":
            length = f.get(LENGTH.lower()) or (m[1] if (m := re.search(rb"(?im)^content-length:\s*(\d+)", http)) else None)
            n = None if length is None else int(length)
        elif digest is None or not f.get("warc-truncated"):
            own = sha1_base32(payload)
            if digest not in (None, own):
                raise ValueError(f"digest of {f.get('warc-record-id')} is wrong")
            digest = own
        page = re.search(rb"(?im)^x-page-id: (-?\d+)", http)
        return f.get("warc-record-id"), f.get("warc-type"), f.get("warc-target-uri"), f.get("warc-date"), int(page[1]) if page else None, n, digest, f.get("warc-refers-to"), len(block)

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in schema.split(", ")]
        for f in frames:
            for data in f["content"]:
                yield pd.DataFrame([row(*r) for r in parse_warc(bytes(data))], columns=names).astype({"page_id": "Int64", "payload_bytes": "Int64"})

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(path).select("content").mapInPandas(read, schema)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """What ``read_warc`` gives, with refers_to_page, and payload_bytes and payload_digest of the record referred to where a revisit lacks its own.

    A revisit of a record that isn't there keeps nulls. Spark splits the partition of a record that very many refer to.
    """
    kept = records.where("record_type <> 'revisit'").groupBy(F.col("record_id").alias("refers_to")).agg(
        F.min("page_id").alias("refers_to_page"), F.min("payload_bytes").alias("__bytes"), F.min("payload_digest").alias("__digest"))
    out = records.join(kept, "refers_to", "left")
    return out.withColumns({"payload_bytes": F.coalesce("payload_bytes", "__bytes"), "payload_digest": F.coalesce("payload_digest", "__digest")}).drop("__bytes", "__digest")


def pages_as_arcs(pages: DataFrame, records: int = 256, bytes_limit: int = 4 << 20) -> DataFrame:
    """(content): ARC files in both versions that hold the pages as they were served; each at most so many records and bytes, or one record."""
    ship(pages.sparkSession)

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, n = [], 0, 0

        def flush():
            nonlocal held, size, n
            n += 1
            out = pd.DataFrame({"content": [write_arc(held, (b"1", b"2")[n % 2], f"pages-{n}.arc")]})
            held, size = [], 0
            return out

        for f in frames:
            for i, url, html in zip(f["page_id"].astype("object").where(f["page_id"].notna(), None), f["url"], f["html"], strict=True):
                body = (html or "").encode()
                mark = "" if i is None else f"X-Page-Id: {int(i)}\r\n"
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{mark}Content-Length: {len(body)}\r\n\r\n".encode()
                held.append((url or "-", "0.0.0.0", "20240101000000", "text/html", http + body))
                size += len(body)
                if len(held) >= records or size >= bytes_limit:
                    yield flush()
        if held:
            yield flush()

    return pages.select("page_id", "url", "html").mapInPandas(pack, "content binary")


def archive_pages(pages: DataFrame, archive_bytes: int = 64 << 20) -> DataFrame:
    """Pages by way of ARC files into WARC archives and back: what ``read_warc`` gives, with refers_to_page.

    Null html is an empty payload, a null url ``-``; equal payloads of any length (also none) are written once. An empty table
    gives an empty result. Archives hold about ``archive_bytes`` each before packing.
    """
    spark = pages.sparkSession
    arcs = pages_as_arcs(pages)
    thin = arc_to_warc(arcs, payloads=False)
    size = pages.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(F.octet_length("html")), F.lit(0.0)).alias("b")).first()
    path = fresh_path(spark, "warc")
    write_warc(mark_revisits(thin, arc_to_warc(arcs)), path, max(1, int(archive_bytes // (size["b"] + 600))))
    if not size["n"]:
        return spark.createDataFrame([], "record_id string, record_type string, uri string, date string, page_id long, payload_bytes long, payload_digest string, refers_to string, block_bytes long, refers_to_page long")
    return resolve_revisits(read_warc(spark, path))

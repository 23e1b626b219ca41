"""Legacy archives to WARC: parse ARC header lines and declared lengths, synthesise WARC records.

``parse_arc`` reads the version block, takes the field list of version 1 (five fields) or 2 (ten) and
then one record per header line, by its declared length. ``to_warc`` gives each record a type, an
identifier derived from what it says (so a repeated task writes the same one), a date, and digests of
block and payload. ``read_warc`` reads such archives back by declared lengths.

Archives are written with Spark's text writer, whose line end is the end of a WARC record: files
commit as any other output does, to any file system. A file ends with the record that takes it to
FILE_BYTES, so readers, which take whole files, need bounded memory. ``revisit`` records keep the HTTP
header and not the payload, and name the record that has it.

A version block is known by its place (the first line of an archive) or, where archives were joined, by
its text; a page may have any url, also one that looks like a version block's.

Defined cases: a null html is an empty payload, a null url becomes ``urn:page:<id>``; a null page_id
stays null and is never what others refer to; repeated rows of the smallest page_id are all response;
a record longer than what is left is kept and marked truncated; header lines that do not parse are skipped to
the next line; an empty table gives an empty result; of further columns none is read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexitide.llm.common import Scratch, broadcast_if_small

V1 = ("url", "ip", "date", "type", "length")
V2 = ("url", "ip", "date", "type", "status", "checksum", "location", "offset", "file", "length")
END = "\r\n\r\n"
#: Payloads shorter than this are stored again instead of being referred to.
LEAST = 100
#: Bytes at which a file ends.
FILE_BYTES = 16 << 20


@dataclass
class Arc:
    url: str
    ip: str
    date: str
    type: str
    body: bytes
    version: int = 1
    truncated: bool = False
    head: bool = False  # the version block
    extra: dict = field(default_factory=dict)


def write_arc(records: list[Arc], version: int = 1, name: str = "pages.arc", date: str = "20240101000000") -> bytes:
    """An ARC file of the version, with its version block."""
    fields = V1 if version == 1 else V2
    titles = "URL IP-address Archive-date Content-type Archive-length" if version == 1 else "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
    out, at = [], 0
    head = f"{version} 0 lexitide\n{titles}\n".encode()
    for r in [Arc(f"filedesc://{name}", "0.0.0.0", date, "text/plain", head), *records]:
        values = {"url": re.sub(r"\s", "%20", r.url), "ip": r.ip, "date": r.date, "type": r.type, "status": r.extra.get("status", "200"), "checksum": hashlib.md5(r.body).hexdigest(), "location": "-", "offset": str(at), "file": name, "length": str(len(r.body))}
        line = " ".join(values[f] for f in fields).encode() + b"\n"
        out += [line, r.body, b"\n"]
        at += len(line) + len(r.body) + 1
    return b"".join(out)


_VERSION = re.compile(rb"\s*[12] \d+ [^\n]*\nURL IP-address ")


def parse_arc(data: bytes) -> Iterator[Arc]:
    """The records of an ARC file, its version block first. The url may hold spaces: the other fields count from the right."""
    at, fields, version = 0, V1, 1
    while at < len(data):
        begin, stop = at, data.find(b"\n", at)
        if stop < 0:
            return
        line, at = data[at:stop].decode("utf-8", "replace").rstrip("\r"), stop + 1
        if not line:
            continue
        first = line.startswith("filedesc://") and (begin == 0 or _VERSION.match(data, at) is not None)
        tries = (V2, V1) if first else (fields,)
        for names in tries:
            parts = line.rsplit(" ", len(names) - 1)
            if len(parts) == len(names) and parts[-1].isdigit() and re.fullmatch(r"\d{4,14}", parts[2]):
                break
        else:
            continue
        values = dict(zip(names, parts, strict=True))
        length = int(values["length"])
        body = data[at : at + length]
        at += length
        if first:
            version = 2 if body.lstrip()[:1] == b"2" else 1
            fields = V2 if version == 2 else V1
        yield Arc(values["url"], values["ip"], values["date"], values["type"], body, version, len(body) < length, first, {k: v for k, v in values.items() if k not in V1})


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """(header with its empty line, payload); no header if the block is not an HTTP message."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    found = [(i + len(e), i) for e in (b"\r\n\r\n", b"\n\n") if (i := block.find(e)) >= 0]
    stop = min(found, key=lambda x: x[1])[0] if found else len(block)
    return block[:stop], block[stop:]


def iso_date(date: str) -> str:
    """A 14-digit date, shorter ones filled up to the earliest instant they may mean."""
    d = date + "00000101000000"[len(date) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(*parts) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(map(str, parts)))}>"


def to_warc(arc: Arc, extra: dict[str, str] | None = None, refers: dict[str, str] | None = None, known_as: str | None = None) -> bytes:
    """A WARC/1.1 record without its closing line ends. refers: headers naming the record a revisit repeats; known_as: its own identifier."""
    header, payload = split_http(arc.body)
    digest = hashlib.sha256(payload).hexdigest()
    kind, content = "resource", arc.type or "application/octet-stream"
    if arc.head:
        kind, content = "warcinfo", "application/warc-fields"
    elif header:
        kind, content = "response", "application/http; msgtype=response"
    elif arc.url.startswith("dns:"):
        kind, content = "response", "text/dns"
    block = b"software: lexitide\r\nformat: WARC File Format 1.1\r\n" if kind == "warcinfo" else arc.body
    if refers is not None:
        kind, block = "revisit", header
    fields = {"WARC-Type": kind, "WARC-Record-ID": known_as or record_id(arc.url, arc.date, digest, *(extra or {}).values()), "WARC-Date": iso_date(arc.date)}
    if kind != "warcinfo":
        fields |= {"WARC-Target-URI": arc.url, "WARC-IP-Address": arc.ip, "WARC-Payload-Digest": f"sha256:{digest}"}
    if refers is not None:
        fields |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"} | refers
    if arc.truncated:
        fields["WARC-Truncated"] = "length"
    fields |= {"WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}", "Content-Type": content, "Content-Length": str(len(block))} | (extra or {})
    fields = {k: re.sub(r"[\r\n]+", " ", v) for k, v in fields.items()}
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n").encode() + block


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record, by declared lengths."""
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        stop = data.find(b"\r\n\r\n", at)
        if stop < 0:
            return
        head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in data[at:stop].decode("utf-8", "replace").split("\r\n")[1:])
        at = stop + 4 + int(head["Content-Length"])
        yield head, data[stop + 4 : at]
        at += len(END)


def _archive(crawl: str, ip: str, file_bytes: int):
    """Rows of joined records, each a file of its own; only the last of a task is smaller than file_bytes."""

    def run(batches):
        end = END.encode()
        info, out, size = True, [], 0
        for n, batch in enumerate(batches):
            pages, urls, html, heads = batch.columns[:4]
            at = 0
            while at < batch.num_rows:  # an archive of about file_bytes at a time
                arcs, ids, held = [], [], 0
                while at < batch.num_rows and held < file_bytes:
                    page, url, body = pages[at].as_py(), urls[at].as_py(), html[at].as_py() or b""
                    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
                    arcs.append(Arc(url or f"urn:page:{page}", ip, crawl, "text/html", http + body))
                    ids.append((page, heads[at].as_py()))
                    held += len(body)
                    at += 1
                head, *records = parse_arc(write_arc(arcs, 1 + n % 2, date=crawl))
                if info:
                    out.append(to_warc(head))
                    info = False
                for given, arc, (page, first) in zip(arcs, records, ids, strict=True):
                    if arc.body != given.body:
                        raise ValueError(f"page {page} did not come back from its archive")
                    extra = {"X-Page-Id": "" if page is None else str(page), "X-Arc-Version": str(arc.version)}
                    refers = None if first is None or first == page else {"WARC-Refers-To": record_id("page", first, crawl), "X-Refers-To-Page-Id": str(first)}
                    out.append(to_warc(arc, extra, refers, record_id("page", page, crawl) if page is not None else None))
                    size += len(out[-1])
                    if size >= file_bytes:
                        yield pa.RecordBatch.from_arrays([pa.array([end.join(out)], pa.binary())], ["value"])
                        out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([end.join(out)], pa.binary())], ["value"])

    return run


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, warc_date string, arc_version int"


def _read(batches):
    names = [x.split()[0] for x in READ.split(", ")]
    for batch in batches:
        for content in batch.column(0):
            rows = []
            for head, block in read_warc(content.as_py()):
                if head["WARC-Type"] == "warcinfo":
                    continue
                header, payload = split_http(block)
                if head["WARC-Type"] == "revisit":
                    size, digest = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", header)[1]), head["WARC-Payload-Digest"].removeprefix("sha256:")
                else:
                    size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                    if f"sha256:{digest}" != head["WARC-Payload-Digest"]:
                        raise ValueError(f"the payload of {head['WARC-Record-ID']} does not have its digest")
                page, refers = head["X-Page-Id"], head.get("X-Refers-To-Page-Id")
                rows.append((int(page) if page else None, size, digest, head["WARC-Type"], int(refers) if refers else None, head["WARC-Record-ID"], head["WARC-Date"], int(head["X-Arc-Version"])))
            if rows:
                types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def write_pages(pages: DataFrame, path: str, scratch: Scratch, crawl: str = "20240101000000", ip: str = "0.0.0.0", file_bytes: int = FILE_BYTES) -> None:
    """Writes pages(page_id, url, html) as WARC files of file_bytes and one record more at most; equal payloads of LEAST bytes or more are stored once."""
    body = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", body.alias("body"), F.sha2(body, 256).alias("digest"))
    groups = pages.where(F.length("body") >= LEAST).groupBy("digest").agg(F.min("page_id").alias("head"), F.count("*").alias("n"))
    heads = scratch.save(groups.where("n > 1 AND head IS NOT NULL").select("digest", "head"), "heads")
    few = broadcast_if_small(heads, heads.count(), 160)
    rows = pages.join(few, "digest", "left").select("page_id", "url", "body", "head")
    records = rows.mapInArrow(_archive(crawl, ip, file_bytes), "value binary").select(F.col("value").cast("string").alias("value"))
    records.write.mode("overwrite").option("lineSep", END).option("maxRecordsPerFile", 1).text(path)


def read_pages(spark, path: str) -> DataFrame:
    """One row per page record of the WARC files under path, payloads checked against their digests."""
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_read, READ)


def op3(spark, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    write_pages(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), scratch.path("archive"), scratch)
    return read_pages(spark, scratch.path("archive")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op3_warc": op3}
ORACLES = {
    "op3_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha256(b) AS payload_digest FROM p),
h AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS head FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND head <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND head <> page_id THEN head END AS refers_to
FROM h"""
}

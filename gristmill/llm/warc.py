"""WARC archives: writing captures, reading them back, and assembling transactions.

A capture is a request, a response (or a revisit of an equal payload) and a metadata record; request and
metadata name the response by WARC-Concurrent-To. Assembly joins the three and emits one nested row per capture.

Files are written by Spark's text writer, so they work on any file system that Spark knows. Each record is a gzip
member of its own, as readers that seek in archives expect; the writer's line separator is an empty member. A file
ends after about VOLUME_BYTES of records, whatever their number. Files are read by the binaryFile source, one member
at a time, so a task holds a compressed file and one record; payload digests are checked.

Cases: a null payload is empty; a null url becomes an empty target; a null page id is never a group's largest,
and a group of equal payloads without any page id is all responses; rows that repeat the largest page id are
all responses; requests or metadata without a capture are emitted with a null response; columns of pages other
than the three named ones are ignored; a payload of any length is one record; an empty table gives no archive and an
empty result; a damaged archive or a payload that doesn't fit its digest raises.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm.common import HOT, cut, ensure_checkpoint_dir, look_up, table

#: Bytes of records, before compression, after which a task begins another file.
VOLUME_BYTES = 16_000_000
#: An empty gzip member.
SEPARATOR = b"\x1f\x8b\x08" + bytes(6) + b"\xff\x03" + bytes(9)
DATE = "2024-01-01T00:00:00Z"


def record(kind: str, name: str, uri: str, block: str, ctype: str, *headers: tuple[str, str]) -> str:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {DATE}", *([f"WARC-Target-URI: {uri}"] if uri else []), *[f"{k}: {v}" for k, v in headers], f"Content-Type: {ctype}", f"Content-Length: {len(block.encode())}"]
    return "\r\n".join(lines) + "\r\n\r\n" + block + "\r\n\r\n"


def member(text: str) -> bytes:
    """The text as one gzip member."""
    packer = zlib.compressobj(6, wbits=31)
    return packer.compress(text.encode()) + packer.flush()


def capture_records(name: str, page: int | None, url: str, html: str, digest: str, original: int | None) -> Iterator[str]:
    """The three records of a capture; original: the page with the payload that this one revisits."""
    ids = [f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}/{k}')}" for k in ("response", "request", "metadata")]
    uri = re.sub(r"\s", "%20", url)
    m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)([^#]*)", uri)
    host, path = (m[1], m[2] or "/") if m else ("", uri or "/")
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html.encode())}\r\n\r\n"
    told = ("WARC-Payload-Digest", f"sha1:{digest}")
    if original is None:
        yield record("response", ids[0], uri, head + html, "application/http; msgtype=response", told)
    else:
        yield record("revisit", ids[0], uri, head, "application/http; msgtype=response", told, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To-Date", DATE))
    near = ("WARC-Concurrent-To", f"<{ids[0]}>")
    yield record("request", ids[1], uri, f"GET {path} HTTP/1.1\r\nHost: {host}\r\n\r\n", "application/http; msgtype=request", near)
    fields = [f"page-id: {'' if page is None else page}"] + ([] if original is None else [f"refers-to-page: {original}"])
    yield record("metadata", ids[2], uri, "\r\n".join(fields) + "\r\n", "application/warc-fields", near)


#: Groups of equal payloads that are broadcast at most. Beyond it only hot ones are, which are HOT at most, and the
#: others meet their pages by a shuffle on the digest.
BROADCAST_GROUPS = 100_000


def decide(pages: DataFrame, least: int = 0) -> DataFrame:
    """pages: page_id, url, html. Adds sha1 (hex) and original: the largest page id with an equal payload of at
    least `least` bytes, null for responses."""
    raw = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    named = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"), F.sha1(raw).alias("sha1"), (F.octet_length(raw) >= least).alias("_shared"))
    # only groups of two or more matter to a row; they are light
    groups = named.filter("_shared").groupBy("sha1").agg(F.max("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    groups = cut(groups)
    if groups.count() <= BROADCAST_GROUPS:
        first = F.broadcast(groups.select(F.col("sha1").alias("_sha1"), "_first"))
        joined = named.join(first, F.col("_shared") & (F.col("sha1") == F.col("_sha1")), "left")
    else:
        total = groups.agg(F.sum("_n")).first()[0]
        # a page's own place is its id; pages of a hot group go by it
        place = F.concat(F.lit("~"), F.xxhash64("page_id", "url").cast("string"))
        keyed = named.withColumn("_key", F.when(F.col("_shared"), F.col("sha1")))
        joined = look_up(keyed, "_key", groups.select(F.col("sha1").alias("_key"), "_first"), groups.filter(F.col("_n") * HOT > total).select(F.col("sha1").alias("_key")), place)
    original = F.when(~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first"))
    return joined.select("page_id", "url", "html", "sha1", original.alias("original"))


def write_warc(pages: DataFrame, path: str, least: int = 0) -> None:
    """Writes the captures of pages (page_id, url, html) as gzipped WARC files under path, a folder for each volume."""
    kinds = pa.schema([("value", pa.binary()), ("volume", pa.string())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, volume, full = TaskContext.get().partitionId(), 0, 0, 0
        for batch in it:
            out, held, name = [], 0, f"{part:06d}-{volume:06d}"
            for row in batch.to_pylist():
                n += 1
                for text in capture_records(f"{part}/{n}/{row['page_id']}", row["page_id"], row["url"], row["html"], base64.b32encode(bytes.fromhex(row["sha1"])).decode(), row["original"]):
                    out.append((member(text), name))
                    held += len(out[-1][0])
                    full += len(text)
                if full > VOLUME_BYTES:  # a capture's records stay in one file
                    volume, full = volume + 1, 0
                    name = f"{part:06d}-{volume:06d}"
                if held > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds.types, strict=True)], schema=kinds)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds.types, strict=True)], schema=kinds)

    records = decide(pages, least).mapInArrow(run, "value binary, volume string").withColumn("value", F.col("value").cast("string"))
    # bytes pass the text writer as they are
    records.write.option("encoding", "ISO-8859-1").option("lineSep", SEPARATOR.decode("latin-1")).partitionBy("volume").text(path)


def members(raw: bytes) -> Iterator[bytes]:
    """What each member of a gzip file holds; for other files, the whole."""
    if raw[:2] != b"\x1f\x8b":
        yield raw
        return
    view, at = memoryview(raw), 0
    while at < len(raw):
        opened, data = zlib.decompressobj(wbits=31), []
        while not opened.eof:
            piece = view[at : at + 4096]  # what a member leaves of it is copied, so it is short
            if not piece:
                raise ValueError("the archive ends within a member")
            data.append(opened.decompress(piece))
            at += len(piece) - len(opened.unused_data)
        if any(data):
            yield b"".join(data)


def parse_records(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers in lower case, block) of each record; raises if the archive is damaged."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        start, n = end + 4, int(headers["content-length"])
        if data[start + n : start + n + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} doesn't end where its length says")
        yield at, headers, data[start : start + n]
        at = start + n + 4


RECORDS = "file string, offset long, record_type string, record_id string, concurrent_to string, uri string, date string, payload_bytes long, payload_digest string, fields map<string,string>, payload binary"


def read_warc(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """The records of the archives under path; offsets are in the bytes that records hold unpacked. payload_bytes and payload_digest of a response are computed from
    its bytes, of a revisit taken from its headers; payload is null unless asked for; fields: those of metadata."""

    def row(file: str, offset: int, h: dict[str, str], block: bytes) -> dict:
        kind, size, digest, payload, fields = h.get("warc-type"), None, None, None, None
        head, _, body = block.partition(b"\r\n\r\n")
        if kind == "response":
            size, digest, payload = len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), body if with_payload else None
            if (told := h.get("warc-payload-digest", "")).startswith("sha1:") and told != f"sha1:{digest}":
                raise ValueError(f"the payload of record {h.get('warc-record-id')} doesn't fit its digest")
        elif kind == "revisit":
            told = re.search(rb"(?im)^content-length:\s*(\d+)", head)
            size, digest = int(told[1]) if told else None, h.get("warc-payload-digest", "").removeprefix("sha1:") or None
        elif kind == "metadata":
            fields = [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in block.decode("utf-8", "replace").split("\r\n") if x)]
        return {"file": file, "offset": offset, "record_type": kind, "record_id": h.get("warc-record-id", "").strip("<>"), "concurrent_to": (h.get("warc-concurrent-to") or "").strip("<>") or None, "uri": h.get("warc-target-uri"), "date": h.get("warc-date"), "payload_bytes": size, "payload_digest": digest, "fields": fields, "payload": payload}

    kinds = pa.schema([("file", pa.string()), ("offset", pa.int64()), *[(c, pa.string()) for c in ("record_type", "record_id", "concurrent_to", "uri", "date")], ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for file, content in zip(batch.column(0), batch.column(1), strict=True):
                out, held, at = [], 0, 0
                for data in members(content.as_py()):
                    for offset, headers, block in parse_records(data):
                        out.append(row(file.as_py(), at + offset, headers, block))
                        held += len(out[-1]["payload"] or b"")
                        if len(out) >= 2000 or held > 4_000_000:
                            yield pa.RecordBatch.from_pylist(out, schema=kinds)
                            out, held = [], 0
                    at += len(data)
                yield pa.RecordBatch.from_pylist(out, schema=kinds)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(run, RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, response, request, metadata (an array: a capture may have many)."""
    cols = [c for c in records.columns if c != "concurrent_to"]
    whole = F.struct(*cols)
    kind = lambda *k: records.filter(F.col("record_type").isin(*k))
    response = kind("response", "revisit").select(F.col("record_id").alias("capture_id"), whole.alias("response"))
    request = kind("request").select(F.col("concurrent_to").alias("_to"), whole.alias("request"))
    metadata = kind("metadata").groupBy(F.col("concurrent_to").alias("_of")).agg(F.collect_list(whole).alias("metadata"))
    both = response.join(request, F.col("capture_id") == F.col("_to"), "full_outer").withColumn("capture_id", F.coalesce("capture_id", "_to")).drop("_to")
    return both.join(metadata, F.col("capture_id") == F.col("_of"), "full_outer").withColumn("capture_id", F.coalesce("capture_id", "_of")).drop("_of")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4()}"
    write_warc(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    fields = F.col("metadata")[0].fields
    number = lambda k: F.nullif(fields[k], F.lit("")).cast("long")
    got = assemble(read_warc(spark, path).drop("payload"))
    return got.select(number("page-id").alias("page_id"), "response.payload_bytes", "response.payload_digest", "response.record_type", number("refers-to-page").alias("refers_to"))


QUERIES = {"op7_warc": op7_warc}
SQL: dict[str, str] = {}

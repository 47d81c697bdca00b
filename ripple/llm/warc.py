"""
WARC archives: captures are written as request, response or revisit, and metadata records, and read back as transactions.

Writing gives each task one archive (gzip members, a record each) in the shared folder; only archives of tasks that ended
are in the manifest, so a repeated or lost attempt leaves no record behind in the result. Reading parses archives in
parallel and gives each record's headers and its place. Requests and metadata find their response through WARC-Concurrent-To, revisits theirs through
WARC-Refers-To: joins on record ids, which assemble one nested row for each capture wherever its records lie. The joins move no payload: it is read from its
place in the archive into the nested row afterwards, and its size and digest are those of what was read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shipping import ship
from . import common

DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of records in one Arrow batch when reading.
BATCH = 4 << 20

RECORD = "archive string, start long, stop long, type string, record_id string, concurrent_to string, refers_to string, target_uri string, date string, payload_digest string, fields map<string,string>"
#: Bytes of a url that go into a request, a bound for odd inputs.
_SAFE = bytes(range(33, 127))


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id, payload_digest: str, occurrence: int) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{payload_digest}/{occurrence}').urn}>"


def record(kind: str, rid: str, block: bytes, headers: list[tuple[str, str | None]]) -> bytes:
    """One record as a gzip member. Line ends in header values become spaces, so that no value can end its header."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {rid}", f"WARC-Date: {DATE}"]
    lines += [f"{k}: {' '.join(v.split(chr(10))).replace(chr(13), ' ')}" for k, v in headers if v is not None]
    head = "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode()
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(head + block + b"\r\n\r\n") + z.flush()


def request(url: str | None) -> bytes:
    """The request's head: path and query as target (bytes that are not printable ASCII are percent-encoded), Host if the url has one."""
    _, found, rest = (url or "").partition("://")
    rest = rest.partition("#")[0] if found else ""
    host = re.match(r"[^/?]*", rest)[0]
    target = "".join(chr(b) if b in _SAFE else f"%{b:02X}" for b in rest[len(host) :].encode("utf-8", "replace"))
    lines = [f"GET {target if target.startswith('/') else '/' + target} HTTP/1.1", *([f"Host: {''.join(host.split())}"] if host else [])]
    return "\r\n".join([*lines, "", ""]).encode("utf-8", "replace")


def capture(page_id, url: str | None, payload: bytes, occurrence: int, revisit_of) -> bytes:
    """The records of one capture. revisit_of: the page_id of the response that has the payload, for a revisit."""
    d = digest(payload)
    rid = record_id(page_id, d, occurrence)
    related = lambda kind: f"<{uuid.uuid5(uuid.NAMESPACE_URL, rid + kind).urn}>"
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    about = [("WARC-Target-URI", url), ("WARC-Concurrent-To", rid)]
    if revisit_of is None:
        main = record("response", rid, head + payload, [("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{d}"), ("Content-Type", "application/http; msgtype=response")])
    else:
        refers = record_id(revisit_of[0], d, 1)
        main = record("revisit", rid, head, [("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{d}"), ("WARC-Profile", REVISIT), ("WARC-Refers-To", refers), ("Content-Type", "application/http; msgtype=response")])
    asked = record("request", related("request"), request(url), [*about, ("Content-Type", "application/http; msgtype=request")])
    fields = b"".join(b"%s: %s\r\n" % (k.encode(), str(v).encode()) for k, v in (("page-id", page_id), ("occurrence", occurrence)) if v is not None)
    return asked + main + record("metadata", related("metadata"), fields, [*about, ("Content-Type", "application/warc-fields")])


def open_file(path: str, write: bool = False):
    """A stream of a file in the shared folder, wherever that is."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    if write:
        system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
        return system.open_output_stream(inner, compression=None)
    return system.open_input_stream(inner, compression=None, buffer_size=1 << 20)


def random_file(path: str):
    """A file in the shared folder that can be read at any place."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def members(stream) -> Iterator[tuple[int, int, bytes]]:
    """(start, stop, record) for one gzip member after another; the archive is never in memory as a whole."""
    z, got, data, start, seen = zlib.decompressobj(31), [], b"", 0, 0
    while True:
        if not data:
            data = stream.read(1 << 20)
            seen += len(data)
            if not data:
                if got:
                    raise ValueError("archive ends within a record")
                return
        got.append(z.decompress(data))
        data = b""
        if z.eof:
            data = z.unused_data
            stop = seen - len(data)
            yield start, stop, b"".join(got)
            z, got, start = zlib.decompressobj(31), [], stop


def split_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers by lower-case name, block). Raises ValueError where the block is cut off."""
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    size = int(headers["content-length"])
    if size > len(rest):
        raise ValueError("record is cut off")
    return headers, rest[:size]


def parsed(data: bytes) -> dict:
    """A record's columns but its place."""
    h, block = split_record(data)
    kind = h.get("warc-type", "")
    fields = dict((k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in block.decode("utf-8", "replace").split("\r\n")) if k) if kind == "metadata" else {}
    return {
        "type": kind, "record_id": h.get("warc-record-id"), "concurrent_to": h.get("warc-concurrent-to"), "refers_to": h.get("warc-refers-to"), "target_uri": h.get("warc-target-uri"),
        "date": h.get("warc-date"), "payload_digest": (h.get("warc-payload-digest") or "").removeprefix("sha1:") or None, "fields": fields,
    }


def with_roles(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """
    page_id, url, payload, occurrence (1, 2, ... among rows with equal page_id and payload), head (page_id of the response of
    its payload) and is_response. Of rows with equal payloads of at least ``least_bytes`` bytes, the one with the largest
    page_id is the response (the first by url, of repeated rows); null ids come last. Smaller ones are all responses.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    # pk: the id without nulls, so that the join and the numbering below share one exchange of the payloads
    rows = pages.select("page_id", "url", payload.alias("payload"), F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("pk")).withColumn("key", F.sha1("payload"))
    n = pages.count()
    narrow = common.written(rows.groupBy("key", "pk", "page_id").agg(F.max(F.octet_length("payload")).alias("bytes")), "narrow", n)
    heads = narrow.groupBy("key").agg(F.max("page_id").alias("head"), F.count("*").alias("pages"))
    roles = common.written(common.join_split(narrow, heads, ["key"], "pages", n), "roles", n).select("key", "pk", "head", "bytes")
    # joined by (payload, page): a payload that a third of all pages share is many keys here
    joined = rows.join(roles, ["key", "pk"])
    nth = F.row_number().over(Window.partitionBy("key", "pk").orderBy(F.col("url").asc_nulls_last()))
    first = F.col("page_id").eqNullSafe(F.col("head")) & (F.col("occurrence") == 1)
    return joined.withColumn("occurrence", nth).withColumn("is_response", first | (F.col("bytes") < least_bytes)).select("page_id", "url", "payload", "occurrence", "head", "is_response")


def write_archives(roles: DataFrame, directory: str) -> DataFrame:
    """Writes rows of ``with_roles`` as archives below ``directory``. The manifest: archive, captures, bytes."""

    def run(batches):
        path, out, n, size = f"{directory}/part-{uuid.uuid4().hex}.warc.gz", None, 0, 0
        for batch in batches:
            for page_id, url, payload, nth, head, is_response in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    out = open_file(path, write=True)
                    out.write(record("warcinfo", f"<{uuid.uuid4().urn}>", b"software: ripple\r\n", [("Content-Type", "application/warc-fields")]))
                data = capture(page_id, url, payload, nth, None if is_response else (head,))
                out.write(data)
                n, size = n + 1, size + len(data)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], ["archive", "captures", "bytes"])

    return common.written(ship(roles).mapInArrow(run, "archive string, captures long, bytes long"), "manifest")


def read_archives(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """All records of the manifest's archives: their headers, the fields of metadata, and their places (archive, start, stop)."""
    files = manifest.count()
    strings = ("type", "record_id", "concurrent_to", "refers_to", "target_uri", "date", "payload_digest")
    schema = pa.schema([("archive", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), *((n, pa.string()) for n in strings), ("fields", pa.map_(pa.string(), pa.string()))])

    def run(batches):
        rows: list[dict] = []
        for batch in batches:
            for archive in batch.column("archive").to_pylist():
                with open_file(archive) as stream:
                    for start, stop, data in members(stream):
                        rows.append({"archive": archive, "start": start, "stop": stop} | parsed(data))
                        if len(rows) >= 4096:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    return ship(manifest).select("archive").repartition(max(1, files)).mapInArrow(run, RECORD)


def transactions(records: DataFrame) -> DataFrame:
    """
    One row for each response or revisit: record_id, capture (its own columns and its place), request and metadata (structs of the records that are
    concurrent to it, null where missing). Records of other types, and those concurrent to nothing that exists, are in no capture.
    """
    part = lambda kind: records.where(F.col("type") == kind).groupBy("concurrent_to").agg(F.min_by(F.struct("record_id", "target_uri", "date", F.map_entries("fields").alias("fields")), "record_id").alias(kind))
    got = records.where(F.col("type").isin("response", "revisit")).select("record_id", F.struct("type", "record_id", "refers_to", "target_uri", "date", "payload_digest", "archive", "start", "stop").alias("capture"))
    for kind in ("request", "metadata"):
        got = got.join(part(kind).withColumnRenamed("concurrent_to", "record_id"), "record_id", "left")
    return got


def with_payloads(captures: DataFrame, archives: int) -> DataFrame:
    """
    ``captures`` of ``transactions`` with response: payload (what follows the HTTP header), payload_bytes and found_digest of what the archive has, and
    http, that header; null for a revisit. Rows are dealt out by their places, so each task reads parts of archives in order, 4 MB of payloads a batch.
    """
    dealt = captures.withColumn("place", F.struct("capture.archive", "capture.start", "capture.stop", (F.col("capture.type") == "response").alias("has")))
    dealt = dealt.repartitionByRange(max(1, archives), "place").sortWithinPartitions("place")
    schema = pa.struct([("payload", pa.binary()), ("payload_bytes", pa.int64()), ("found_digest", pa.string()), ("http", pa.string())])

    def fetch(stream, start: int, stop: int) -> dict:
        stream.seek(start)
        head, _, payload = split_record(zlib.decompress(stream.read(stop - start), 31))[1].partition(b"\r\n\r\n")
        return {"payload": payload, "payload_bytes": len(payload), "found_digest": digest(payload), "http": head.decode("utf-8", "replace")}

    def run(batches):
        name, stream = None, None
        for batch in batches:
            held, size, lo = [], 0, 0
            for k, place in enumerate(batch.column("place").to_pylist()):
                if place["has"] and place["archive"] != name:
                    if stream is not None:
                        stream.close()
                    name, stream = place["archive"], random_file(place["archive"])
                held.append(fetch(stream, place["start"], place["stop"]) if place["has"] else None)
                size += held[-1]["payload_bytes"] if place["has"] else 0
                if size >= BATCH or k + 1 == batch.num_rows:
                    part = batch.slice(lo, k + 1 - lo).drop_columns(["place"])
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(held, schema)], [*part.schema.names, "response"])
                    held, size, lo = [], 0, k + 1
        if stream is not None:
            stream.close()

    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in captures.schema)
    return ship(dealt).mapInArrow(run, names + ", response struct<payload:binary,payload_bytes:bigint,found_digest:string,http:string>")


def op10_warc(spark, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages")
    manifest = write_archives(with_roles(pages), common.new_path(spark, "archives"))
    # archives are parsed once, not once for each kind of record
    records = common.written(read_archives(spark, manifest), "records")
    nested = with_payloads(transactions(records), manifest.count())
    page = F.element_at(F.map_from_entries("metadata.fields"), "page-id").cast("long")
    got = common.written(nested.select("record_id", "capture.type", "capture.refers_to", "response.payload_bytes", "response.found_digest", page.alias("page_id")), "captures")
    # a revisit has no payload: size, digest and page are those of the response that it refers to; many may refer to one
    responses, revisits = got.where("type = 'response'"), got.where("type = 'revisit'").select("page_id", "refers_to")
    asked = revisits.groupBy("refers_to").agg(F.count("*").alias("n"))
    original = responses.select(F.col("record_id").alias("refers_to"), "payload_bytes", "found_digest", F.col("page_id").alias("of_page")).join(asked, "refers_to")
    found = common.join_split(revisits, original, ["refers_to"], "n", revisits.count())
    columns = ["page_id", "payload_bytes", F.col("found_digest").alias("payload_digest")]
    return responses.select(*columns, F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to")).unionByName(
        found.select(*columns, F.lit("revisit").alias("record_type"), F.col("of_page").alias("refers_to"))
    )


#: The same rows in DuckDB: base32 by groups of five hexadecimal digits.
ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
     d AS (SELECT *, array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
             ((('0x' || substr(hex, CAST(5 * (k // 4) + 1 AS INT), 5))::BIGINT >> CAST(15 - 5 * (k % 4) AS INT)) & 31)::INT + 1, 1)), '') AS payload_digest FROM p),
     h AS (SELECT hex, max(page_id) AS head FROM d GROUP BY hex)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = head THEN NULL ELSE head END AS refers_to
FROM d JOIN h USING (hex)
"""

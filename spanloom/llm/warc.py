"""WARC archives: writing captures, reading records, and assembling transactions by concurrent-to identifiers.

A capture is a request, a response (or a revisit, if an equal payload is archived already) and a metadata record. Request
and metadata name the response in WARC-Concurrent-To. Records are written by Spark's text writer, whose commits survive
lost executors: a record ends in CR LF CR LF, and the writer's line end is the last of these bytes. Payloads may be any
bytes. Files are of bounded size, read whole, by Spark, and cut by Content-Length, so nothing in a payload can look like a record.

Assembly: a record that names another joins that one's capture, over at most two steps (metadata that names a request
that names the response); then one nested row is emitted per capture.

Cases: a null payload is empty; a null url leaves out WARC-Target-URI; repeated rows of one page_id are captures of their
own, told apart by a digest and a running number; a null page_id is kept as null. Page ids come back as whole numbers. Records without a response are captures with a null response.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import new_path, stage

_EPOCH = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "record_id string, record_type string, concurrent_to array<string>, refers_to string, target_uri string, payload_digest string, payload_length long, fields map<string,string>, payload binary"


def _urn(kind: str, *key: Column) -> Column:
    """A name-based identifier: the same capture gets the same records whenever it is written."""
    h = F.md5(F.concat_ws("/", F.lit(kind), *[F.coalesce(k.cast("string"), F.lit("null")) for k in key]))
    return F.concat(F.lit("<urn:uuid:"), *[x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.substring(h, a, n), F.lit("-" if a < 21 else ">"))])


def base32(hexed: Column) -> Column:
    """The base32 form of 40 hexadecimal digits: twenty bits are five of these and four of those."""
    digits = "0123456789abcdefghijklmnopqrstuv"
    out = []
    for k in range(8):
        five = F.conv(F.substring(hexed, 5 * k + 1, 5), 16, 32)
        out.append(F.lpad(F.lower(five), 4, "0"))
    return F.translate(F.concat(*out), digits, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record(kind: str, record_id: Column, block: Column, headers: list[tuple[str, Column | str]], kind_of: str) -> Column:
    lines = [F.lit("WARC/1.1\r\nWARC-Type: "), F.lit(kind), F.lit("\r\nWARC-Record-ID: "), record_id, F.lit(f"\r\nWARC-Date: {_EPOCH}\r\n")]
    for name, value in headers:
        value = F.lit(value) if isinstance(value, str) else value
        lines.append(F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit("")))
    lines += [F.lit(f"Content-Type: {kind_of}\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block, F.lit("\r\n\r")]
    return F.concat(*lines)


def records(captures: DataFrame, *, least_bytes: int = 0) -> DataFrame:
    """The records of captures (page_id, url, payload string) as text rows. Of equal payloads of at least `least_bytes` bytes only that of the smallest page_id is stored."""
    rows = captures.withColumns({
        "_n": F.octet_length("payload").cast("long"), "_sha": F.sha1(F.col("payload").cast("binary")),
        "_uri": F.regexp_replace("url", r"[\x00-\x20]", "%20"),
    })
    few = rows.select("_sha", "_n", "page_id", "_copy").filter(F.col("_n") >= least_bytes)
    key = F.struct(F.col("page_id").isNull().alias("last"), "page_id", "_copy")
    firsts = few.groupBy("_sha", "_n").agg(F.min(key).alias("_first"), F.count("*").alias("_many")).filter("_many > 1")
    rows = rows.join(firsts, ["_sha", "_n"], "left")
    copy = F.col("_first").isNotNull() & ~F.col("_first").eqNullSafe(key)
    response = _urn("response", F.col("page_id"), F.col("_copy"))
    digest = F.concat(F.lit("sha1:"), base32(F.col("_sha")))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("_n").cast("string"), F.lit("\r\n\r\n"))
    host = F.regexp_extract(F.coalesce("_uri", F.lit("")), r"^[^:]*://([^/?#]*)", 1)
    target = F.regexp_extract(F.coalesce("_uri", F.lit("")), r"^[^:]*://[^/?#]*([^#]*)", 1)
    asked_for = F.when(target.startswith("/"), target).otherwise(F.concat(F.lit("/"), target))
    ask = F.concat(F.lit("GET "), asked_for, F.lit(" HTTP/1.1\r\nHost: "), host, F.lit("\r\n\r\n"))
    page = F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("\r\n"))
    uri, about = ("WARC-Target-URI", F.col("_uri")), ("WARC-Concurrent-To", response)
    payload = ("WARC-Payload-Digest", digest)
    original = _urn("response", F.col("_first.page_id"), F.col("_first._copy"))
    main = F.when(copy, _record("revisit", response, http, [uri, payload, ("WARC-Refers-To", original), ("WARC-Profile", PROFILE)], "application/http;msgtype=response")).otherwise(
        _record("response", response, F.concat(http, F.col("payload")), [uri, payload], "application/http;msgtype=response")
    )
    asked = _record("request", _urn("request", F.col("page_id"), F.col("_copy")), ask, [uri, about], "application/http;msgtype=request")
    told = _record("metadata", _urn("metadata", F.col("page_id"), F.col("_copy")), page, [uri, about], "application/warc-fields")
    return rows.select(F.concat(asked, F.lit("\n"), main, F.lit("\n"), told).alias("value"))


def captures_of(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, payload, _copy): _copy is empty where an id is there once; rows that share an id, or have none, are told apart by a digest of url and payload, and equal rows by a running number."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("payload"))
    ids = stage(rows.groupBy("page_id").agg(F.count("*").alias("n")).filter("n > 1 or page_id is null").select("page_id"), "repeated")
    if ids.isEmpty():
        return rows.withColumn("_copy", F.lit(""))
    many = ids.withColumnRenamed("page_id", "_id")
    same = F.col("page_id").eqNullSafe(F.col("_id"))
    digest = F.sha1(F.concat_ws("\n", F.coalesce("url", F.lit("\t")), "payload").cast("binary"))
    # equal rows are counted and made again, so no task holds the rows of an id
    told = rows.join(many, same, "left_semi").withColumn("_digest", digest).groupBy("page_id", "_digest").agg(F.first("url").alias("url"), F.first("payload").alias("payload"), F.count("*").alias("_n"))
    again = told.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), "_n"))).select("page_id", "url", "payload", F.concat_ws("/", "_digest", "_k").alias("_copy"))
    return rows.join(many, same, "left_anti").withColumn("_copy", F.lit("")).unionByName(again)


def write(captures: DataFrame, path: str, *, file_bytes: int = 64 << 20, **how) -> None:
    """Writes gzip-compressed WARC files to a folder, of some `file_bytes` each before compression."""
    size = captures.agg(F.sum(F.octet_length("payload")).alias("b"), F.count("*").alias("n")).first()
    many = max(1, file_bytes * size["n"] // max(1, (size["b"] or 0) + 1200 * size["n"]))  # files are read whole
    records(captures, **how).write.option("lineSep", "\n").option("compression", "gzip").option("maxRecordsPerFile", many).text(path)


def parse(content: bytes):
    """(headers, block) of each record of an uncompressed WARC file."""
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        lines = content[at:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers: list[tuple[str, str]] = []
        for line in lines[1:]:
            if line[:1] in " \t" and headers:  # a folded header
                headers[-1] = (headers[-1][0], f"{headers[-1][1]} {line.strip()}")
            else:
                name, _, value = line.partition(":")
                headers.append((name.strip().lower(), value.strip()))
        size = int(dict(headers)["content-length"])
        yield headers, content[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def _row(headers: list[tuple[str, str]], block: bytes) -> tuple:
    h = dict(headers)
    kind, about, payload, length, fields = h.get("warc-type"), h.get("content-type", ""), block, None, {}
    if about.startswith("application/http"):
        head, _, payload = block.partition(b"\r\n\r\n")
        if m := re.search(rb"(?im)^content-length:\s*(\d+)", head):
            length = int(m[1])
    elif about.startswith("application/warc-fields"):
        for line in block.decode("utf-8", "replace").splitlines():
            name, sep, value = line.partition(":")
            if sep:
                fields[name.strip()] = value.strip()
    if kind == "revisit":
        digest = h.get("warc-payload-digest", "").rpartition(":")[2] or None
        payload = b""
    else:
        digest, length = base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload)
    return h.get("warc-record-id"), kind, [v for k, v in headers if k == "warc-concurrent-to"], h.get("warc-refers-to"), h.get("warc-target-uri"), digest, length, list(fields.items()), payload


def read(spark: SparkSession, path: str, *, with_payload: bool = True) -> DataFrame:
    """One row per record of a folder's WARC files, gzip-compressed (whole or record by record) or not. Digests and lengths are taken from stored payloads; those of revisits from their headers."""
    import gzip

    types = [pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.string(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary()]
    names = [x.split()[0] for x in RECORDS.split(", ")]
    k = len(names) - (not with_payload)

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                data = content.as_buffer().to_pybytes()
                if data[:2] == b"\x1f\x8b":
                    data = gzip.decompress(data)
                rows, size = [], 0
                for headers, block in parse(data):
                    rows.append(_row(headers, block)[:k])
                    size += len(block)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=False)], names=names[:k])
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=False)], names=names[:k])

    schema = ", ".join(RECORDS.split(", ")[:k])
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(run, schema)


def assemble(recs: DataFrame) -> DataFrame:
    """One nested row per capture: (capture_id, response, request, metadata), the latter two as arrays of records."""
    body = [c for c in recs.columns if c != "concurrent_to"]
    main = F.col("record_type").isin("response", "revisit", "resource")
    link = recs.filter(~main).select("record_id", F.explode("concurrent_to").alias("target"))
    hop = link.select(F.col("record_id").alias("via"), F.col("target").alias("further"))
    ends = link.join(hop, link.target == hop.via, "left").groupBy("record_id").agg(F.min(F.coalesce("further", "target")).alias("_end"))
    back = recs.filter(main).select(F.col("record_id").alias("_end"), F.explode("concurrent_to").alias("record_id"))  # a response may name its request instead
    side = recs.filter(~main).join(ends.unionByName(back).groupBy("record_id").agg(F.min("_end").alias("_end")), "record_id", "left")
    rows = recs.filter(main).select(F.col("record_id").alias("capture_id"), *body).unionByName(side.select(F.coalesce("_end", "record_id").alias("capture_id"), *body))
    whole = F.struct(*body)
    pick = lambda kind: F.collect_list(F.when(F.col("record_type") == kind, whole))  # noqa: E731  the few records of one capture
    return rows.groupBy("capture_id").agg(F.min_by(F.when(main, whole), F.when(main, F.col("record_id"))).alias("response"), pick("request").alias("request"), pick("metadata").alias("metadata"))


def round_trip(pages: DataFrame, *, least_bytes: int = 0) -> DataFrame:
    """Writes pages as WARC files to the shared folder, reads them back, assembles captures, and tells of each page what was read."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write(captures_of(pages), path, least_bytes=least_bytes)
    got = stage(assemble(stage(read(spark, path, with_payload=False), "records")), "captures")
    flat = got.select(
        "capture_id", F.get("metadata", 0)["fields"]["page-id"].try_cast("long").alias("page_id"), F.col("response.payload_length").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"), F.col("response.record_type").alias("record_type"), F.col("response.refers_to").alias("_of"),
    )
    wanted = flat.filter("_of is not null").select(F.col("_of").alias("capture_id")).distinct()
    first = flat.join(wanted, "capture_id", "left_semi").select(F.col("capture_id").alias("_of"), F.col("page_id").alias("refers_to"))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kind = flat.schema["page_id"].dataType
    rest = flat.filter("_of is null").withColumn("refers_to", F.lit(None).cast(kind)).select(*columns)  # responses refer to nothing and need no join
    return rest.unionByName(flat.filter("_of is not null").join(first, "_of", "left").select(*columns))

"""WARC archives: writing captures, reading records, and transaction assembly.

A capture is three records: the response (or, for a payload that another response holds, a revisit), its request and
its metadata; the latter two name the first in ``WARC-Concurrent-To``.  Records are text in UTF-8 that ends in two line
ends, so Spark's text writer writes the archives wherever Spark can write, gzipped, and closes a file after so many records
as make about ``FILE_BYTES`` on average.  Files are inflated and parsed a piece at a time, each record by its content
length, and every file is read once.  :func:`assembled` brings the records of a capture together by the concurrent-to
identifier, one nested row each; where it leaves bodies out, file, offset and length lead back to them (:func:`record_at`).

Null html is an empty payload, null url an empty one.  Payloads shorter than ``least`` bytes never make revisits.  Rows
that repeat an id with the same payload are all captures: those with the smallest id are all responses.  Rows without
id revisit the smallest id, and are responses if no row of their payload has one.  Ids are percent-encoded in metadata, so
they may hold any characters.  No pages make no records.  A very long page is one record, held by one task.  Only the named
columns are read, so others may have any names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from plurigrade.llm.common import drop_stored, shared_dir, small_batches, stored

#: Parts that rows of one payload are dealt to.
SALTS = 16
#: Bytes of content of an archive file, about; most of its records; bytes of content that the parser hands on, and that are inflated, at once.
FILE_BYTES, RECORDS, CHUNK, PIECE = 64 << 20, 60_000, 8 << 20, 1 << 20
DATE = "2024-01-01T00:00:00Z"
RECORD = "type string, id string, concurrent_to string, refers_to string, uri string, date string, payload_digest string, content_type string, content string, payload_bytes long, payload_sha256 string, file string, offset long, length long"


def record_id(kind: str, *parts: Column) -> Column:
    """A record's URN, the same whenever it is made from the same parts."""
    h = F.md5(F.concat_ws("\x1f", F.lit(kind), *(F.coalesce(p.cast("string"), F.lit("\x1e")) for p in parts)))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)), F.lit(">"))


def record(kind: str, name: Column, fields: list[tuple[str, Column | str]], content: Column) -> Column:
    """One record less the two line ends that the writer adds; fields that are null are left out."""
    head = [F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Date: {DATE}\r\nWARC-Record-ID: "), name]
    for k, v in fields:
        head.append(F.coalesce(F.concat(F.lit(f"\r\n{k}: "), v if isinstance(v, Column) else F.lit(v)), F.lit("")))
    return F.concat(*head, F.lit("\r\nContent-Length: "), F.octet_length(content).cast("string"), F.lit("\r\n\r\n"), content)


def _rows(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    body = F.coalesce(F.col(html), F.lit(""))
    return pages.select(F.col(key).alias("key"), F.regexp_replace(F.coalesce(F.col(url), F.lit("")), r"[\r\n]", " ").alias("url"), body.alias("html"), F.sha2(body, 256).alias("digest"), F.octet_length(body).cast("long").alias("n"))


def repeated(rows: DataFrame, least: int) -> tuple[DataFrame, int]:
    """``digest, first, first_url`` of the payloads that stand more than once, stored, and the bytes of an average page."""
    seen = Observation()
    narrow = rows.observe(seen, F.count("*").alias("pages"), F.coalesce(F.sum("n"), F.lit(0)).alias("bytes")).where(F.col("n") >= least)
    shared = narrow.groupBy("digest").agg(F.min(F.when(F.col("key").isNotNull(), F.struct("key", "url"))).alias("first"), F.count("*").alias("copies")).where("copies > 1")
    kept = stored(shared.select("digest", F.col("first.key").alias("first"), F.col("first.url").alias("first_url")), "payloads")
    return kept, seen.get["bytes"] // max(1, seen.get["pages"])


def deduplicated(rows: DataFrame, shared: DataFrame) -> DataFrame:
    """``key, url, html, digest, n, first, first_url, nth``: ``first`` is the smallest id of an equal payload, ``nth`` tells repeated rows apart."""
    spread = shared.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    # A row's salt follows from its id, so that copies spread but repeated rows stay together.
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("key", "url"), F.lit(SALTS)).cast("int"))
    found = dealt.join(spread, ["digest", "salt"], "left")
    return found.withColumn("nth", F.row_number().over(Window.partitionBy("digest", "salt", "key", "url").orderBy("digest")))


def records_of(found: DataFrame) -> DataFrame:
    """``value``: the three records of each page of :func:`deduplicated`."""
    rows = found
    again = F.col("first").isNotNull() & ~F.coalesce(F.col("key") == F.col("first"), F.lit(False))
    own = record_id("capture", F.col("key"), F.col("url"), F.col("digest"), F.col("nth"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit("\r\n\r\n"))
    said = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), F.url_encode(value.cast("string")), F.lit("\r\n")), F.lit(""))
    about = F.concat(said("page-id", F.col("key")), said("refers-to-page-id", F.when(again, F.col("first"))), said("payload-bytes", F.col("n")))
    rows = rows.select("*", own.alias("id"), again.alias("again"), http.alias("http"), about.alias("about"))
    target, digest = ("WARC-Target-URI", F.col("url")), ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest")))
    whole = record("response", F.col("id"), [target, digest, ("Content-Type", "application/http; msgtype=response")], F.concat("http", "html"))
    profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    response = record_id("capture", F.col("first"), F.col("first_url"), F.col("digest"), F.lit(1))
    revisit = record("revisit", F.col("id"), [target, digest, ("WARC-Refers-To", response), ("WARC-Profile", profile), ("Content-Type", "application/http; msgtype=response")], F.col("http"))
    request = record("request", record_id("request", F.col("id")), [("WARC-Concurrent-To", F.col("id")), target, ("Content-Type", "application/http; msgtype=request")], F.concat(F.lit("GET "), F.col("url"), F.lit(" HTTP/1.1\r\n\r\n")))
    metadata = record("metadata", record_id("metadata", F.col("id")), [("WARC-Concurrent-To", F.col("id")), target, ("Content-Type", "application/warc-fields")], F.col("about"))
    return rows.select(F.explode(F.array(F.when(F.col("again"), revisit).otherwise(whole), request, metadata)).alias("value"))


def write_warc(pages: DataFrame, path: str, least: int = 100, key: str = "page_id", url: str = "url", html: str = "html") -> None:
    """The archives of the pages, as gzipped files at ``path``."""
    rows = _rows(pages, key, url, html)
    shared, size = repeated(rows, least)
    # A page's three records have about a kilobyte beside the body.
    records = min(RECORDS, 3 * max(1, FILE_BYTES // (size + 1000)))
    records_of(deduplicated(rows, shared)).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", records).text(path)
    drop_stored(shared)


def inflated(data: bytes) -> Iterator[bytes]:
    """The content of a file of one or more gzip members, or of a plain one, some bytes at a time."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    while data:
        member = zlib.decompressobj(31)
        while not member.eof:
            piece = member.decompress(data, PIECE)
            if not piece and not member.unconsumed_tail and not member.eof:
                raise ValueError("archive ends inside a gzip member")
            yield piece
            data = member.unconsumed_tail
        data = member.unused_data


def parse(pieces: Iterator[bytes]) -> Iterator[dict[str, str | int | None]]:
    """The records of one archive, with offset and length of their content in what is inflated; raises if it is damaged."""
    held, before = bytearray(), 0

    def more(what: str) -> None:
        piece = next(pieces, None)
        if piece is None:
            raise ValueError(f"{what} at byte {before}")
        held.extend(piece)

    while True:
        while not held:
            piece = next(pieces, None)
            if piece is None:
                return
            held.extend(piece)
        looked = 0
        while (end := held.find(b"\r\n\r\n", looked)) < 0:
            looked = max(0, len(held) - 3)
            more("no record")
        lines = held[:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {before}")
        head = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        start = end + 4
        stop = start + int(head["content-length"])
        while len(held) < stop + 4:
            more("a record is cut short")
        if held[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"a record is cut short at byte {before}")
        content = bytes(held[start:stop])
        # The body of a response is measured here, so that what follows need not carry it along.
        body = memoryview(content)[content.find(b"\r\n\r\n") + 4 :] if head.get("warc-type") == "response" else None
        yield {
            "type": head.get("warc-type"), "id": head.get("warc-record-id"), "concurrent_to": head.get("warc-concurrent-to"), "refers_to": head.get("warc-refers-to"), "uri": head.get("warc-target-uri"),
            "date": head.get("warc-date"), "payload_digest": head.get("warc-payload-digest"), "content_type": head.get("content-type"), "content": content,
            "payload_bytes": None if body is None else len(body), "payload_sha256": None if body is None else hashlib.sha256(body).hexdigest(), "offset": before + start, "length": len(content),
        }
        del held[: stop + 4]
        before += stop + 4


def _parsed(batches: Iterator[pa.RecordBatch], bodies: bool) -> Iterator[pa.RecordBatch]:
    names = [x.split(" ") for x in RECORD.split(", ")]
    schema = pa.schema([(n, pa.int64() if kind == "long" else pa.string()) for n, kind in names])

    def handed(held: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in held], schema.field(n).type) for n in schema.names], schema=schema)

    for batch in batches:
        for i in range(batch.num_rows):
            file, held, n = batch.column(0)[i].as_py(), [], 0
            for r in parse(inflated(batch.column(1)[i].as_py())):
                r["file"] = file
                r["content"] = r["content"].decode("utf-8", "replace") if bodies or r["concurrent_to"] else None
                held.append(r)
                n += len(r["content"] or "") + 500
                if n >= CHUNK:
                    yield handed(held)
                    held, n = [], 0
            yield handed(held)


def read_warc(spark: SparkSession, path: str, bodies: bool = True) -> DataFrame:
    """The records of all archives at ``path``: the columns of ``RECORD``, among them the size and digest of a response's body, and where the content lies.

    Without ``bodies`` the content of records that name no capture is null.
    """
    small_batches(spark)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(lambda it: _parsed(it, bodies), RECORD)


def record_at(spark: SparkSession, file: str, offset: int, length: int) -> bytes:
    """The content of one record, read back from its archive; inflated up to there, no further."""
    data = spark.read.format("binaryFile").load(file).select("content").first()[0]
    out, at = bytearray(), 0
    for piece in inflated(data):
        out += piece[max(0, offset - at) : max(0, offset + length - at)]
        at += len(piece)
        if at >= offset + length:
            break
    return bytes(out)


def assembled(records: DataFrame) -> DataFrame:
    """``id, uri, capture, request, metadata``: one nested row for each response or revisit.

    The records meet by the identifier that they are concurrent to, or by their own, in one aggregation.  Of several
    requests or metadata records that name one capture, that with the smallest id is taken.  A capture that none names has
    nulls; records that name no capture are in :func:`orphans`.
    """
    whole = F.struct("id", "uri", "type", "date", "payload_digest", "content_type", "content", "payload_bytes", "payload_sha256", "file", "offset", "length")
    part = F.struct("id", "date", "content_type", "content")
    taken = F.col("type").isin("response", "revisit")
    named = lambda kind: F.min(F.when((F.col("type") == kind) & F.col("concurrent_to").isNotNull(), part)).alias(kind)
    met = records.groupBy(F.when(taken, F.col("id")).otherwise(F.coalesce("concurrent_to", "id")).alias("__capture")).agg(F.min(F.when(taken, whole)).alias("capture"), named("request"), named("metadata"))
    held = met.where(F.col("capture").isNotNull())
    return held.select("capture.id", "capture.uri", F.col("capture").dropFields("id", "uri").alias("capture"), "request", "metadata")


def orphans(records: DataFrame) -> DataFrame:
    """Requests and metadata records whose capture is in no archive."""
    captures = records.where(F.col("type").isin("response", "revisit")).select(F.col("id").alias("concurrent_to"))
    return records.where(F.col("type").isin("request", "metadata")).join(captures, "concurrent_to", "left_anti")


def warc_field(content: Column, name: str) -> Column:
    """A percent-encoded field of a metadata record, null if it has none."""
    return F.when(content.rlike(rf"(?m)^{name}: "), F.url_decode(F.regexp_extract(content, rf"(?m)^{name}: ([^\r\n]*)", 1)))


def captures(pages: DataFrame, least: int = 100, key: str = "page_id", url: str = "url", html: str = "html", path: str | None = None) -> DataFrame:
    """The contract's columns, read back from archives written at ``path``, by default in the cluster's shared folder."""
    spark = pages.sparkSession
    path = path or shared_dir(spark, "warc")
    write_warc(pages, path, least, key, url, html)
    kind = pages.schema[key].dataType
    rows = assembled(read_warc(spark, path, bodies=False))
    revisit = F.col("capture.type") == "revisit"
    about = F.col("metadata.content")
    # A revisit has no body; its metadata tell the size of the one that it revisits.
    return rows.select(
        warc_field(about, "page-id").cast(kind).alias(key),
        F.when(revisit, warc_field(about, "payload-bytes").cast("long")).otherwise(F.col("capture.payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.replace(F.col("capture.payload_digest"), F.lit("sha256:"), F.lit(""))).otherwise(F.col("capture.payload_sha256")).alias("payload_digest"),
        F.col("capture.type").alias("record_type"),
        F.when(revisit, warc_field(about, "refers-to-page-id").cast(kind)).alias("refers_to"),
        F.col("uri").alias("target_uri"),
        F.regexp_extract("request.content", r"^GET (.*) HTTP/1\.1", 1).alias("request_target"),
    )

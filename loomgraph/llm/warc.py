"""WARC archives: writing captures, reading records, assembling transactions."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm._shared import materialise, new_path, scrap, ship, shuffles_dropped

END = "\r\n\r\n"
#: Payload bytes of one archive file, about; a single larger record is a file's own.
ARCHIVE_BYTES = 64 << 20
#: The digits of base 32 in both notations.
CONV_DIGITS, BASE32_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base-32 SHA-1 of a binary column: 160 bits as four groups of eight digits."""
    digest = F.upper(F.sha1(payload))
    parts = [F.lpad(F.conv(F.substring(digest, k, 10), 16, 32), 8, "0") for k in (1, 11, 21, 31)]
    return F.translate(F.concat(*parts), CONV_DIGITS, BASE32_DIGITS)


def _bytes(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def _header(name: str, value: Column) -> Column:
    """A header line, or nothing when the value is null; line ends inside a value become spaces."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), F.regexp_replace(value.cast("string"), r"[\r\n]+", " "), F.lit("\r\n")), F.lit(""))


def _record(kind: Column, record_id: Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    """The bytes of a record up to the end of its block (the writer's line separator ends it)."""
    lines = [F.lit("WARC/1.1\r\n"), _header("WARC-Type", kind), _header("WARC-Record-ID", record_id)]
    lines += [_header(k, v) for k, v in headers]
    lines += [_header("Content-Length", F.length(block)), F.lit("\r\n")]
    return F.concat(_bytes(F.concat(*lines)), block)


def captures(pages: DataFrame, min_revisit_bytes: int = 0) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Captures (page_id, key, url, payload) of ``pages`` (page_id, url, html), repeated ones (k, first_key), and the tables these read.

    ``key`` is a digest of all of a capture, so it names the same rows however
    often ``pages`` is read and however it is split.  Of rows with equal payloads
    of at least ``min_revisit_bytes`` bytes one with the largest page_id is the
    response, of several the one with the largest key; the rows of the other
    keys, and all but one of its own key, revisit it.  Null html is an empty
    payload; a null page_id counts as smaller than any other.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("content", F.sha2("payload", 256))
    rows = rows.withColumn("key", F.sha2(_bytes(F.to_json(F.struct("page_id", "url", "content"))), 256))
    # Digests alone go through the grouping; the written table lets Spark split a hot digest in the join.
    with shuffles_dropped(pages.sparkSession):
        narrow = materialise(rows.select("page_id", "key", F.length("payload").alias("size"), "content"), "captures")
        order = F.struct(F.col("page_id").isNotNull().alias("k"), "page_id", "key")
        best = narrow.where(F.col("size") >= min_revisit_bytes).groupBy("content").agg(F.max(order).alias("b"), F.count("*").alias("n")).where("n > 1")
        best = materialise(best.select(F.col("content").alias("c"), F.col("b.key").alias("first_key")), "first-captures")
    repeated = narrow.join(best, F.col("content") == F.col("c")).select(F.col("key").alias("k"), "first_key").distinct()
    return rows.drop("content"), repeated, [narrow, best]


def urn(kind: str, key: Column, copy: Column) -> Column:
    """A record id made of the capture's key and its number among equal ones, so a rerun writes the same one."""
    h = F.md5(F.concat(F.lit(f"{kind}:"), key, F.lit(":"), copy.cast("string")))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def write_archives(pages: DataFrame, path: str, min_revisit_bytes: int = 0) -> None:
    """Write a request, a response (or revisit) and a metadata record per row of ``pages``.

    Requests and metadata name the response in WARC-Concurrent-To.  A revisit
    has no block and names the record it repeats in WARC-Refers-To.  The files
    are gzipped; their number follows the payload bytes.  Nulls are empty payloads
    and urls, and absent page ids; repeated rows are records of their own; an
    empty table writes no records; other columns are ignored.
    """
    spark = pages.sparkSession
    rows, repeated, read = captures(pages, min_revisit_bytes)
    with shuffles_dropped(spark):
        total = rows.agg(F.coalesce(F.sum(F.length("payload")), F.lit(0))).first()[0]
    files = max(1, min(rows.rdd.getNumPartitions(), -(-total // (1 << 20))), -(-total // ARCHIVE_BYTES))
    # Payloads move once: dealt by key into as many parts as there are to be files, which the join and the numbering of equal rows keep.
    marked = rows.repartition(int(files), "key").join(repeated.hint("shuffle_hash"), F.col("key") == F.col("k"), "left")
    marked = marked.withColumn("copy", F.row_number().over(Window.partitionBy("key").orderBy("key")))
    is_revisit = F.col("first_key").isNotNull() & ((F.col("key") != F.col("first_key")) | (F.col("copy") > 1))
    own = (F.col("key"), F.col("copy"))
    response, url = urn("response", *own), F.coalesce("url", F.lit(""))
    http = F.concat(_bytes(F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.length("payload").cast("string"), F.lit(END))), F.when(is_revisit, _bytes(F.lit(""))).otherwise(F.col("payload")))
    common = [("WARC-Target-URI", url), ("X-Page-ID", F.col("page_id"))]
    records = F.array(
        _record(F.lit("request"), urn("request", *own), [*common, ("WARC-Concurrent-To", response), ("Content-Type", F.lit("application/http; msgtype=request"))], _bytes(F.concat(F.lit("GET "), url, F.lit(" HTTP/1.1" + END)))),
        _record(
            F.when(is_revisit, "revisit").otherwise("response"),
            response,
            [
                *common,
                ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_sha1(F.col("payload")))),
                ("WARC-Refers-To", F.when(is_revisit, urn("response", F.col("first_key"), F.lit(1)))),
                ("WARC-Profile", F.when(is_revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
                ("WARC-Truncated", F.when(is_revisit, "length")),
                ("Content-Type", F.lit("application/http; msgtype=response")),
            ],
            http,
        ),
        _record(F.lit("metadata"), urn("metadata", *own), [*common, ("WARC-Concurrent-To", response), ("Content-Type", F.lit("application/warc-fields"))], _bytes(F.concat(F.lit("page: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("\r\n")))),
    )
    # A binary cast to string keeps its bytes, and the text sink writes them as they are.
    lines = marked.select(F.explode(records).alias("record")).select(F.col("record").cast("string").alias("value"))
    with shuffles_dropped(spark):  # the payloads are in the archives then, and needn't lie in a shuffle while they are read back
        lines.write.option("lineSep", END).option("compression", "gzip").text(path)
    scrap(spark, *read)


RECORDS = "file string, place long, type string, record_id string, concurrent_to array<string>, refers_to string, uri string, page_id long, digest string, fields array<struct<name:string,value:string>>, http_head string, payload binary, payload_bytes long"


def parse(data: bytes):
    """(offset, headers, block) of each record; blocks are taken by Content-Length, whatever they hold."""
    at, line = 0, re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)\r\n")
    while True:
        while data[at : at + 2] == b"\r\n":
            at += 2
        if at >= len(data):
            return
        if data[at : at + 5] != b"WARC/":
            raise ValueError(f"no record starts at byte {at}")
        head = data.index(b"\r\n\r\n", at)
        headers: dict[str, list[str]] = {}
        for m in line.finditer(data, data.index(b"\r\n", at) + 2, head + 2):
            headers.setdefault(m[1].decode().lower(), []).append(m[2].decode("utf-8", "replace"))
        size = int(headers["content-length"][0])
        block = data[head + 4 : head + 4 + size]
        if len(block) < size:
            raise ValueError(f"the record at byte {at} is cut short")
        yield at, headers, block
        at = head + 4 + size


def _read(with_payload: bool):
    kinds = [("file", pa.string()), ("place", pa.int64()), ("type", pa.string()), ("record_id", pa.string()), ("concurrent_to", pa.list_(pa.string())), ("refers_to", pa.string()), ("uri", pa.string()), ("page_id", pa.int64()), ("digest", pa.string()), ("fields", pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))), ("http_head", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64())]

    def run(batches):
        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), kinds, strict=True)], names=[k for k, _ in kinds])

        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                raw = content.as_buffer().to_pybytes()
                data = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
                rows, held = [], 0
                for at, h, block in parse(data):
                    one = lambda k, h=h: h.get(k, [None])[0]
                    head, payload = None, block
                    if (one("content-type") or "").startswith("application/http"):
                        head, _, payload = block.partition(b"\r\n\r\n")
                        head = head.decode("utf-8", "replace")
                    kind = one("warc-type")
                    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode() if kind == "response" else (one("warc-payload-digest") or "").removeprefix("sha1:") or None
                    fields = [dict(zip(("name", "value"), x.split(": ", 1), strict=True)) for x in payload.decode("utf-8", "replace").split("\r\n") if ": " in x] if kind == "metadata" else None
                    page = one("x-page-id")
                    rows.append((path, at, kind, one("warc-record-id"), h.get("warc-concurrent-to", []), one("warc-refers-to"), one("warc-target-uri"), int(page) if page else None, digest, fields, head, payload if with_payload and kind == "response" else None, len(payload)))
                    held += len(payload)
                    if len(rows) >= 2000 or held > 1 << 23:
                        yield out(rows)
                        rows, held = [], 0
                if rows:
                    yield out(rows)

    return run


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """A row per record of the archives under ``path`` (gzipped or plain); see RECORDS.

    ``payload_bytes`` and, for responses, ``digest`` are computed from the bytes
    read; ``payload`` itself is left null without ``with_payload``.  A file is
    read whole by one task, a record leaves as it is met; headers that are absent
    are null; no files give no rows; a file that isn't a WARC or ends within a
    record is an error.
    """
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{gz,txt,warc}").load(path).select("path", "content")
    return files.mapInArrow(_read(with_payload), RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: (capture_id, response, request, metadata).

    Requests and metadata records join the record that they name in
    WARC-Concurrent-To.  ``response`` is the response or revisit; ``request`` the first request by
    record id, or null; ``metadata`` an array in order of record id, empty if
    there are none.  Records that name no known capture form no row.  A record id
    met again counts once, that with the smallest (file, place).  Every capture
    has few records, so groups stay small whatever the payloads repeat.  Records
    without an id or names are in no row; no records give no rows; other columns
    are ignored.
    """
    record = F.struct("file", "place", "type", "record_id", "refers_to", "uri", "page_id", "digest", "fields", "http_head", "payload", "payload_bytes")
    capture = F.when(F.col("type").isin("response", "revisit"), F.array("record_id")).when(F.col("type").isin("request", "metadata"), F.col("concurrent_to"))
    groups = records.select(F.explode(capture).alias("capture_id"), record.alias("record")).groupBy("capture_id").agg(F.array_sort(F.collect_list("record")).alias("all"))

    def of(*kinds: str) -> Column:
        return F.filter("all", lambda r: r["type"].isin(*kinds))

    shaped = groups.select("capture_id", of("response", "revisit").alias("h"), of("request").alias("q"), of("metadata").alias("metadata"))
    by_id = lambda a: F.sort_array(F.transform(a, lambda r: F.struct(r["record_id"].alias("k"), r.alias("r"))))
    unique = lambda a: F.filter(by_id(a), lambda x, i: (i == 0) | (x["k"] != by_id(a)[i - 1]["k"]))
    return shaped.where("size(h) > 0").select(
        "capture_id",
        F.col("h")[0].alias("response"),
        F.try_element_at(F.transform(by_id(F.col("q")), lambda x: x["r"]), F.lit(1)).alias("request"),
        F.transform(unique(F.col("metadata")), lambda x: x["r"]).alias("metadata"),
    )


def resolve_revisits(found: DataFrame) -> DataFrame:
    """Add (payload_bytes, payload_digest, refers_to) of the full payload: a revisit takes its response's.

    The referred captures are a written table, so Spark can split a response
    that a third of all captures revisit.  A revisit whose response is unknown
    keeps its own digest and null bytes.
    """
    with shuffles_dropped(found.sparkSession):
        own = materialise(found, "transactions")
    known = materialise(own.where("response.type = 'response'").select(F.col("capture_id").alias("k"), F.col("response.page_id").alias("first_id"), F.col("response.payload_bytes").alias("bytes"), F.col("response.digest").alias("d")), "responses")
    joined = own.join(known, F.col("response.refers_to") == F.col("k"), "left")
    revisit = F.col("response.type") == "revisit"
    return joined.select(
        *own.columns,
        F.when(revisit, F.col("bytes")).otherwise(F.col("response.payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.coalesce("d", "response.digest")).otherwise(F.col("response.digest")).alias("payload_digest"),
        F.when(revisit, F.col("first_id")).alias("refers_to"),
    )


def attach_payloads(found: DataFrame, records: DataFrame) -> DataFrame:
    """``found`` (see ``assemble``) with the payload of each response in ``response.payload``.

    Captures are put together from narrow records; payloads move in this one
    join, to the place of their record, so a payload that many captures revisit
    is met once.
    """
    own = records.where("type = 'response'").select(F.col("file").alias("f"), F.col("place").alias("o"), F.col("payload").alias("body"))
    joined = found.hint("shuffle_hash").join(own, (F.col("response.file") == F.col("f")) & (F.col("response.place") == F.col("o")), "left")
    return joined.withColumn("response", F.col("response").withField("payload", F.col("body"))).select(*found.columns)


def round_trip(pages: DataFrame, min_revisit_bytes: int = 0, with_payload: bool = True) -> DataFrame:
    """Write ``pages`` as archives in the shared folder, read them back and assemble the captures.

    Null html is an empty payload, a null url an empty one and a null page_id is
    left out of its headers; repeated rows are captures of their own that revisit
    one of them; a very long page is an archive's record like others.  An empty
    table gives an empty result; other columns of ``pages`` are ignored.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(pages, path, min_revisit_bytes)
    found = resolve_revisits(assemble(read_archives(spark, path, False)))
    return attach_payloads(found, read_archives(spark, path)) if with_payload else found

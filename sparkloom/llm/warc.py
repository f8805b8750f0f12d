"""WARC archives: writing captures, reading records, assembling transactions.

Each page becomes a request, a response (or revisit) and a metadata record. The
files are written by Spark's text writer, whose line separator is the two line
ends that close a record, and read back whole by its binary reader, so both reach
any store that Spark reaches. Records are cut by their Content-Length, whatever the
payload holds. Captures are assembled by joining the three records through their
WARC-Concurrent-To identifiers.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.arrow import small_batches
from sparkloom.llm.skew import lookup
from sparkloom.plans.tables import discard, materialize

#: Payload bytes of one archive file at most, unless one payload has more: a file is read as one value.
FILE_BYTES = 64 << 20
#: Sizes of payloads (at most) that share a file.
SIZES = (32 << 10, 2 << 20, 64 << 20, None)
DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(hex40: Column) -> Column:
    """Upper-case base32 of 40 hexadecimal digits."""
    parts = [F.lpad(F.conv(F.substring(hex40, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_id(kind: str, page_id: Column, digest: Column) -> Column:
    """A URN that depends on the kind of record, the page and its payload alone."""
    h = F.md5(F.encode(F.concat(F.lit(kind + ":"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(":"), digest), "UTF-8"))
    cuts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def decisions(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, html, payload_bytes, payload_digest, refers_to`` for every row.

    Payloads are equal when their SHA-1, SHA-256 and lengths are. Of equal payloads
    of at least ``min_bytes`` bytes the largest page_id is the response and the
    others refer to it; rows that repeat that page_id are responses too. Null html
    is an empty payload. A null page_id never is a response that others refer to.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"))
    digests = rows.withColumn("payload", F.encode("html", "UTF-8")).withColumn("payload_bytes", F.octet_length("html").cast("long"))
    digests = digests.withColumn("sha1", F.sha1("payload")).withColumn("same", F.unhex(F.concat("sha1", F.sha2("payload", 256), F.lpad(F.hex("payload_bytes"), 16, "0")))).drop("payload")
    groups = digests.where(F.col("payload_bytes") >= min_bytes).groupBy("same").agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = materialize(groups, "warc-groups")
    total = groups.agg(F.sum("n")).first()[0] or 0
    found = lookup(digests, groups, "same", "n", total, "page_id")
    refers = F.when(F.col("page_id").eqNullSafe(F.col("first_id")), None).otherwise(F.col("first_id"))
    return found.select("page_id", "url", "html", "payload_bytes", base32(F.col("sha1")).alias("payload_digest"), refers.alias("refers_to"))


def _record(kind: Column | str, headers: list[tuple[str, Column]], block: Column) -> Column:
    """One record without its closing line ends. Headers whose value is null are left out."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind)]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in headers]
    lines += [F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), block)


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0, compression: str = "gzip", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write a request, a response or revisit and a metadata record for every row.

    A revisit holds the HTTP head and no payload. White space and control characters
    in a URL, and a null URL, are percent-encoded in the target; the metadata record
    has the page_id. A null page_id is written without that field. Payloads of like
    size share files, so that no file holds more than ``FILE_BYTES`` of payloads or one
    payload.
    """
    rows = decisions(pages, min_bytes, id_col, url_col, html_col)
    page, again = F.col("page_id"), F.col("refers_to").isNotNull()
    uri = F.regexp_replace(F.coalesce("url", F.lit("urn:unknown")), "[\\x00-\\x20\\x7F]", "%20")
    date, target = ("WARC-Date", F.lit(DATE)), ("WARC-Target-URI", uri)
    request, response, metadata = (record_id(kind, page, F.col("payload_digest")) for kind in ("request", "response", "metadata"))
    asked = F.concat(F.lit("GET / HTTP/1.1\r\nUser-Agent: sparkloom\r\nX-Target: "), uri, F.lit("\r\n\r\n"))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest")))
    one = _record("request", [("WARC-Record-ID", request), date, target, ("Content-Type", F.lit("application/http;msgtype=request"))], asked)
    two = _record(
        F.when(again, "revisit").otherwise("response"),
        [("WARC-Record-ID", response), date, target, ("WARC-Concurrent-To", request), digest, ("WARC-Refers-To", F.when(again, record_id("response", F.col("refers_to"), F.col("payload_digest")))), ("WARC-Profile", F.when(again, F.lit(_PROFILE))), ("Content-Type", F.lit("application/http;msgtype=response"))],
        F.when(again, head).otherwise(F.concat(head, F.col("html"))),
    )
    fields = F.concat_ws("\r\n", F.concat(F.lit("page-id: "), page.cast("string")), F.lit("via: sparkloom"))
    three = _record("metadata", [("WARC-Record-ID", metadata), date, target, ("WARC-Concurrent-To", response), ("Content-Type", F.lit("application/warc-fields"))], F.concat(fields, F.lit("\r\n")))
    out = rows.select(F.concat_ws("\r\n\r\n", one, two, three).alias("value"), "payload_bytes")
    low = -1
    for k, high in enumerate(SIZES):
        # the bound is pushed down to the pages: each is read, and otherwise handled in one of the writes
        some = out.where((F.col("payload_bytes") > low) & (F.col("payload_bytes") <= high if high else F.lit(True))).select("value")
        some.write.option("lineSep", "\r\n\r\n").option("compression", compression).option("maxRecordsPerFile", max(1, FILE_BYTES // high) if high else 1).text(f"{path}/size-{k}")
        low = high


RECORD = "record_id string, type string, concurrent_to string, refers_to string, uri string, date string, digest string, page_id long, http_bytes long, payload binary"


def parse(data: bytes) -> Iterator[tuple]:
    """Rows of ``RECORD`` in one archive, plain or gzipped whole or by record.

    Broken headers raise ValueError, an empty archive has no rows, and repeated records
    come out repeatedly. The payload is null but for responses.
    """
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while at < len(data):
        if data[at : at + 2] == b"\r\n":
            at += 2
            continue
        end = data.find(b"\r\n\r\n", at)
        lines = data[at:end].split(b"\r\n")
        if end < 0 or not lines[0].startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.decode().partition(":") for x in lines[1:])}
        start = end + 4
        block = data[start : start + int(head["content-length"])]
        at = start + len(block)
        kind, page, size, payload = head["warc-type"], None, None, None
        if kind == "metadata":
            own = dict(x.split(": ", 1) for x in block.decode().split("\r\n") if ": " in x)
            page = int(own["page-id"]) if "page-id" in own else None
        elif kind in ("response", "revisit"):
            top, _, body = block.partition(b"\r\n\r\n")
            sizes = [x.split(b":", 1)[1] for x in top.split(b"\r\n") if x.lower().startswith(b"content-length:")]
            size = int(sizes[0]) if sizes else None
            payload = body if kind == "response" else None
        yield head["warc-record-id"], kind, head.get("warc-concurrent-to"), head.get("warc-refers-to"), head.get("warc-target-uri"), head.get("warc-date"), head.get("warc-payload-digest"), page, size, payload


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives in ``path``; payload digests and lengths are taken from the payloads read."""
    small_batches(spark)
    names = [x.split()[0] for x in RECORD.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["content"]:
                rows = list(parse(data))
                for start in range(0, len(rows), 300):
                    frame = pd.DataFrame(rows[start : start + 300], columns=names)
                    yield frame.astype({"page_id": "Int64", "http_bytes": "Int64"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path).select("content")
    rows = files.mapInPandas(run, RECORD)
    return rows.withColumn("payload_bytes", F.coalesce(F.length("payload").cast("long"), F.col("http_bytes"))).withColumn("payload_digest", F.coalesce(base32(F.sha1("payload")), F.regexp_replace("digest", "^sha1:", "")))


def captures(records: DataFrame) -> DataFrame:
    """One nested row per response or revisit: ``request, response, metadata`` structs.

    A record without its partner gives a null struct; requests and metadata that no
    response belongs to are left out. Where pages were written repeatedly, their
    records share ids: each repeated response gives a capture with one request and one
    metadata record.
    """
    responses = records.where(F.col("type").isin("response", "revisit"))
    response = responses.select(F.struct(*[c for c in ("record_id", "type", "refers_to", "uri", "date", "payload_bytes", "payload_digest", "payload") if c in records.columns]).alias("response"), F.col("record_id").alias("_id"), F.col("concurrent_to").alias("_request"))
    request = records.where("type = 'request'").select(F.col("record_id").alias("_request"), F.struct("record_id", "uri", "date").alias("request")).dropDuplicates(["_request"])
    metadata = records.where("type = 'metadata'").select(F.col("concurrent_to").alias("_id"), F.struct("record_id", "page_id").alias("metadata")).dropDuplicates(["_id"])
    return response.join(request, "_request", "left").join(metadata, "_id", "left").select("request", "response", "metadata")


def archive_round_trip(pages: DataFrame, path: str, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to archives in ``path``, read them back and resolve revisits to the page_id of their response."""
    write_warc(pages, path, min_bytes)
    spark = pages.sparkSession
    # archives are parsed once; the joins need no payloads
    records = materialize(read_records(spark, path).drop("payload"), "warc-records")
    whole = F.col("request").isNotNull() & F.col("metadata").isNotNull()
    rows = captures(records).select(
        F.when(whole, F.col("metadata.page_id")).otherwise(F.raise_error(F.lit("a capture lacks its request or metadata record")).cast("long")).alias("page_id"), F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"), F.col("response.record_id").alias("record_id"), F.col("response.refers_to").alias("ref"),
    )
    rows = materialize(rows, "warc-captures")
    wanted = rows.where("ref is not null").groupBy("ref").agg(F.count(F.lit(1)).alias("n"))
    targets = materialize(rows.where("record_type = 'response'").select(F.col("record_id").alias("ref"), F.col("page_id").alias("refers_to")).distinct().join(wanted, "ref"), "warc-targets")
    discard(records)
    total = targets.agg(F.sum("n")).first()[0] or 0
    return lookup(rows, targets, "ref", "n", total, "page_id").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")

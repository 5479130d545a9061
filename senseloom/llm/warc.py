"""WARC archives: write records, read them back, reassemble segmented ones.

Archives are gzip files of bounded size. Long blocks are cut into segments: a first record and continuation records that name it as their origin.
Reading parses files in parallel by Content-Length, groups segments by origin, orders them by number, verifies the total length and decodes chunked
transfer framing. Records are written as text in UTF-8, so segments and chunks are cut between characters; reading works on bytes and takes any cut.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from senseloom.llm.common import materialize, maybe_broadcast, new_path

SEGMENT_CHARS = 32_768
CHUNK_CHARS = 8_192
FILE_RECORDS = 5_000
#: Copies of one row that one task numbers.
COPY_ROWS = 10_000
CRLF = "\r\n"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def sha1_base32(text: Column) -> Column:
    """SHA-1 of a string's UTF-8 bytes in upper-case base32, by built-in functions: five hex digits make four letters."""
    hexed = F.sha1(text.cast("binary"))
    letters = []
    for i in range(1, 41, 5):
        bits = F.conv(F.substring(hexed, i, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(_BASE32), F.shiftright(bits, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def url_key() -> Column:
    """A url as a key that tells null from empty and puts null first."""
    return F.coalesce(F.concat(F.lit("1"), "url"), F.lit("0"))


def row_key() -> Column:
    """What tells a page's row from others: id, payload and url."""
    return F.concat_ws(":", F.coalesce(F.col("page_id").cast("string"), F.lit("null")), "payload_digest", F.md5(url_key()))


def classify(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """One narrow row per page: page_id, url, payload_bytes, payload_digest, record_type, refers_to, copy, alike.

    ``pages`` has page_id, url and payload. Of pages with equal payloads of at least ``min_bytes`` bytes the one with the largest page_id (null last; of those the first url, null first) is the response and
    the others are revisits that refer to it; smaller payloads are all responses. Rows alike in all
    columns are told apart by ``copy``, ``alike`` counts them. Payloads are compared by digest and length; the largest id of a payload is a partial aggregate.
    """
    narrow = pages.select(F.col("page_id").cast("long"), "url", F.octet_length("payload").cast("long").alias("payload_bytes"), sha1_base32(F.col("payload")).alias("payload_digest"))
    rows = materialize(narrow.groupBy("page_id", "url", "payload_bytes", "payload_digest").agg(F.count("*").alias("n")), "pages")
    key = ["payload_digest", "payload_bytes"]
    first = rows.groupBy(*key).agg(F.min(place()).alias("first"), F.max("page_id").alias("best"))
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(COPY_ROWS).cast("long")))
    # Very many copies of one row are numbered by several tasks.
    told = rows.join(first, key).withColumn("_from", chunk)
    told = told.where("n <= " + str(COPY_ROWS)).union(told.where("n > " + str(COPY_ROWS)).repartition("payload_digest", "_from"))
    told = told.withColumn("copy", F.explode(F.sequence("_from", F.least(F.col("_from") + COPY_ROWS, "n") - 1)))
    response = ((place() == F.col("first")) & (F.col("copy") == 0)) | (F.col("payload_bytes") < min_bytes)
    return told.select("page_id", "url", *key, F.when(response, "response").otherwise("revisit").alias("record_type"), F.when(~response, F.col("best")).alias("refers_to"), "copy", F.col("n").alias("alike"))


def place() -> Column:
    """Order of a payload's pages: the largest page_id first, null last, then by url."""
    return F.struct(F.coalesce(-F.col("page_id"), F.lit((1 << 63) - 1)).alias("down"), url_key().alias("url"))


def record_texts(records: DataFrame, segment_chars: int = SEGMENT_CHARS, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """WARC records as text, one row (value) per segment. ``records`` has the columns of :func:`classify` and ``payload`` (of responses).

    Payloads of more than ``chunk_chars`` characters are framed as chunks, blocks of more than ``segment_chars`` become segments. A revisit has the HTTP header alone.
    """
    n = F.char_length("payload")
    cut = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / chunk_chars).cast("int")), lambda i: F.substring("payload", i * chunk_chars + 1, F.lit(chunk_chars)))
    chunks = F.array_join(F.transform(cut, lambda c: F.concat(F.lower(F.hex(F.octet_length(c))), F.lit(CRLF), c, F.lit(CRLF))), "")
    chunked = (F.col("record_type") == "response") & (n > chunk_chars)
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}"), F.when(chunked, f"Transfer-Encoding: chunked{CRLF}").otherwise(F.concat(F.lit("Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF))), F.lit(CRLF))
    body = F.when(F.col("record_type") == "revisit", "").when(chunked, F.concat(chunks, F.lit(f"0{CRLF}{CRLF}"))).otherwise(F.col("payload"))
    urn = F.concat(F.lit("<urn:page:"), row_key(), F.lit(":"), F.col("copy").cast("string"))
    blocks = records.select("*", F.concat(http, body).alias("block"), urn.alias("urn"))
    pieces = F.greatest(F.lit(1), F.ceil(F.char_length("block") / segment_chars).cast("int"))
    parts = blocks.withColumn("segments", pieces).withColumn("segment", F.explode(F.sequence(F.lit(1), F.col("segments"))))
    parts = parts.withColumn("part", F.when(F.col("segments") == 1, F.col("block")).otherwise(F.substring("block", (F.col("segment") - 1) * segment_chars + 1, F.lit(segment_chars))))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF))
    first, split = F.col("segment") == 1, F.col("segments") > 1
    maybe = lambda when, text: F.coalesce(F.when(when, text), F.lit(""))
    return parts.select(
        F.concat(
            F.lit(f"WARC/1.1{CRLF}"),
            line("WARC-Type", F.when(first, F.col("record_type")).otherwise("continuation")),
            line("WARC-Record-ID", F.concat("urn", F.when(first, ">").otherwise(F.concat(F.lit(":"), F.col("segment"), F.lit(">"))))),
            F.lit(f"WARC-Date: 1970-01-01T00:00:00Z{CRLF}"),
            maybe(first, line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest"))),
            maybe(first, line("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20]", ""))),
            maybe(first, line("Page-Id", F.col("page_id"))),
            maybe(first, line("Refers-To-Page-Id", F.col("refers_to"))),
            maybe(first & (F.col("record_type") == "revisit"), F.lit(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}")),
            maybe(split, line("WARC-Segment-Number", F.col("segment"))),
            maybe(~first, line("WARC-Segment-Origin-ID", F.concat("urn", F.lit(">")))),
            maybe(split & (F.col("segment") == F.col("segments")), line("WARC-Segment-Total-Length", F.octet_length("block"))),
            F.lit(f"Content-Type: application/http; msgtype=response{CRLF}"),
            line("Content-Length", F.octet_length("part")),
            F.lit(CRLF), "part", F.lit("\r\n\r"),
        ).alias("value")
    )


def write(records: DataFrame, path: str, segment_chars: int = SEGMENT_CHARS, chunk_chars: int = CHUNK_CHARS, file_records: int = FILE_RECORDS) -> None:
    """Write records as gzip archives of at most ``file_records`` records each."""
    record_texts(records, segment_chars, chunk_chars).write.option("lineSep", "\n").option("compression", "gzip").option("maxRecordsPerFile", file_records).text(path)


def inflated(data: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """Contents of an archive in parts of about ``step`` bytes; members of gzip are read one after another, and what is broken or cut off ends the data."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    z = zlib.decompressobj(31)
    while data:
        try:
            yield z.decompress(data, step)
        except zlib.error:
            return
        data = z.unconsumed_tail
        if z.eof:
            data, z = z.unused_data.lstrip(b"\0"), zlib.decompressobj(31)
        elif not data:
            yield z.flush()


def parse(parts: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Header fields (names in lower case) and block of each record, read from the parts of an archive; no more than one record and one part are held.

    The block is None where the header states no length or the archive ends before it. Bytes between records are skipped; after a record without a usable length the
    next one is looked for.
    """
    parts, held = iter(parts), bytearray()

    def more() -> bool:
        part = next(parts, None)
        held.extend(part or b"")
        return part is not None

    while True:
        while (at := held.find(b"WARC/")) < 0:
            del held[: max(0, len(held) - 4)]
            if not more():
                return
        del held[:at]
        while (end := held.find(b"\r\n\r\n")) < 0 and more():
            pass
        fields = {}
        for line in held[: end if end >= 0 else len(held)].decode("utf-8", "replace").split(CRLF)[1:]:
            name, _, value = line.partition(":")
            fields[name.strip().lower()] = value.strip()
        stated = fields.get("content-length", "")
        if end < 0 or not (stated.isascii() and stated.isdigit()):
            yield fields, None
            del held[: end + 4 if end >= 0 else 5]
            continue
        stop = end + 4 + int(stated)
        while len(held) < stop and more():
            pass
        yield fields, bytes(held[end + 4 : stop]) if len(held) >= stop else None
        del held[:stop]


def dechunk(body: bytes) -> bytes | None:
    """Decode chunked transfer framing; None if it is broken or cut off."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        try:
            size = int(body[at:end].split(b";")[0], 16) if end >= 0 else -1
        except ValueError:
            return None
        if size < 0 or end + 2 + size > len(body):
            return None
        if not size:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size


def payload_of(block: bytes) -> tuple[bytes | None, int | None]:
    """Payload of an HTTP block (None if its framing is broken) and the length that its header states."""
    head, _, body = block.partition(b"\r\n\r\n")
    fields = dict(x.lower().split(b":", 1) for x in head.split(b"\r\n")[1:] if b":" in x)
    stated = int(fields[b"content-length"]) if fields.get(b"content-length", b"").strip().isdigit() else None
    return (dechunk(body) if b"chunked" in fields.get(b"transfer-encoding", b"") else body), stated


_SEGMENTS = "record_id string, origin string, segment int, total long, record_type string, uri string, page_id long, refers_to long, digest string, block binary"
_RECORDS = "record_id string, record_type string, uri string, page_id long, refers_to long, payload_bytes long, payload_digest string, payload binary, complete boolean"


def read(spark: SparkSession, path: str) -> DataFrame:
    """Read archives (*.gz or *.warc) back: one row per record, its segments reassembled.

    ``complete`` is false and ``payload`` null where a segment is missing, the total length differs, the framing is broken, or the archive is cut off or damaged there; fields that the
    header lacks are null. A revisit has no payload; its
    ``payload_bytes`` and ``payload_digest`` are those its header states. Digests of responses are computed anew. Only segmented records are shuffled. An archive is unpacked record by record.
    """
    number = lambda x: int(x) if x and x.lstrip("-").isdigit() else None

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content"):
                rows, held = [], 0
                for f, block in parse(inflated(content.as_py())):
                    if f.get("warc-type") not in ("response", "revisit", "resource", "continuation"):
                        continue
                    segment = number(f.get("warc-segment-number"))
                    rows.append((f.get("warc-record-id"), f.get("warc-segment-origin-id", f.get("warc-record-id")), segment, number(f.get("warc-segment-total-length")), f["warc-type"], f.get("warc-target-uri"), number(f.get("page-id")), number(f.get("refers-to-page-id")), f.get("warc-payload-digest", "").removeprefix("sha1:"), block))
                    held += len(block or b"")
                    if held > 4 << 20:
                        yield batch(rows, segment_types)
                        rows, held = [], 0
                if rows:
                    yield batch(rows, segment_types)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                parts = [p for i, p in enumerate(r["parts"]) if p["segment"] is None or p != r["parts"][i - 1] or i == 0]  # a segment may be there twice
                whole = all(p["block"] is not None for p in parts)
                whole = whole and ([p["segment"] for p in parts] == list(range(1, len(parts) + 1)) or len(parts) == 1 and parts[0]["segment"] is None)
                block = b"".join(p["block"] or b"" for p in parts)
                whole = whole and (parts[0]["segment"] is None or r["total"] == len(block))
                payload, stated = payload_of(block) if whole else (None, None)
                revisit = r["record_type"] == "revisit"
                whole = whole and (revisit or payload is not None and (stated is None or stated == len(payload)))
                if revisit:
                    size, digest, payload = stated, r["digest"], None
                else:
                    payload = payload if whole else None
                    size, digest = (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()) if whole else (None, None)
                rows.append((r["record_id"], r["record_type"], r["uri"], r["page_id"], r["refers_to"], size, digest, payload, whole))
            yield batch(rows, record_types)

    text, long = pa.string(), pa.int64()
    segment_types = pa.schema([("record_id", text), ("origin", text), ("segment", pa.int32()), ("total", long), ("record_type", text), ("uri", text), ("page_id", long), ("refers_to", long), ("digest", text), ("block", pa.binary())])
    record_types = pa.schema([("record_id", text), ("record_type", text), ("uri", text), ("page_id", long), ("refers_to", long), ("payload_bytes", long), ("payload_digest", text), ("payload", pa.binary()), ("complete", pa.bool_())])
    batch = lambda rows, schema: pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
    parsed = spark.read.format("binaryFile").option("pathGlobFilter", "*.{gz,warc}").load(path).select("content").mapInArrow(split, _SEGMENTS)
    part = F.struct("segment", "block")
    single = parsed.where("segment IS NULL").select("record_id", "record_type", "uri", "page_id", "refers_to", "digest", "total", F.array(part).alias("parts"))
    head = lambda c: F.max(F.when(F.col("record_type") != "continuation", F.col(c))).alias(c)
    grouped = parsed.where("segment IS NOT NULL").groupBy(F.col("origin").alias("record_id")).agg(*(head(c) for c in ("record_type", "uri", "page_id", "refers_to", "digest")), F.max("total").alias("total"), F.array_sort(F.collect_list(part)).alias("parts"))
    return single.unionByName(grouped).mapInArrow(finish, _RECORDS)


def archive(pages: DataFrame, path: str, min_bytes: int = 0, segment_chars: int = SEGMENT_CHARS, chunk_chars: int = CHUNK_CHARS) -> None:
    """Write one record per row of ``pages`` (page_id, url, html; other columns are ignored) to ``path``.

    A null html is an empty payload. Pages find out from a narrow table of the payloads that occur again whether they are responses; where that table
    is small enough to be broadcast, payloads go from the scan into the archive without a shuffle. Revisits never carry theirs.
    """
    held = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("payload"))
    records = materialize(classify(held, min_bytes), "records")
    key = ["payload_digest", "payload_bytes"]
    # Pages that lose against another one of their payload, by the place of the winner; and winners that are several rows alike.
    winners = records.where("record_type = 'revisit' AND copy = 0").select(*key).distinct().join(records.where(F.col("record_type") == "response").withColumn("_first", place()), key).select(*key, "_first")
    winners = materialize(winners.distinct(), "winners")
    alike = records.where("record_type = 'response' AND alike > 1")
    told = held.withColumns({"payload_digest": sha1_base32(F.col("payload")), "payload_bytes": F.octet_length("payload").cast("long")})
    known = told.join(maybe_broadcast(winners), key, "left").where(F.col("_first").isNull() | (F.col("_first") == place())).drop("_first")
    none = F.lit(None).cast("long")
    if several := alike.count():
        # One of the rows alike stands for all; a small payload of which all are responses is written once for each copy.
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("page_id", "url", *key)]
        match = same[0] & same[1] & (F.col("payload_digest") == F.col("_payload_digest")) & (F.col("payload_bytes") == F.col("_payload_bytes"))
        copies = maybe_broadcast(alike.select("copy", *(F.col(c).alias(f"_{c}") for c in ("page_id", "url", *key))), several)
        once = known.join(copies.select("_page_id", "_url", "_payload_digest", "_payload_bytes").distinct(), match, "left_semi").dropDuplicates(["page_id", "url", *key])
        single = known.join(copies, match, "left_anti").withColumn("copy", F.lit(0).cast("long"))
        known = single.unionByName(once.join(copies, match).select("page_id", "url", "payload", *key, "copy"))
    else:
        known = known.withColumn("copy", F.lit(0).cast("long"))
    responses = known.withColumns({"record_type": F.lit("response"), "refers_to": none})
    revisits = records.where("record_type = 'revisit'").drop("alike").withColumn("payload", F.lit(""))
    write(responses.unionByName(revisits), path, segment_chars, chunk_chars)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Archive pages in the shared folder and read the archives back; see :func:`read` for the columns. An empty table gives no rows."""
    path = new_path(pages.sparkSession, "warc")
    archive(pages, path, min_bytes)
    return read(pages.sparkSession, path)


ROUND_TRIP_SQL = r"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT *, row_number() OVER (PARTITION BY h, payload_bytes ORDER BY page_id DESC NULLS LAST, url NULLS FIRST) AS nth, max(page_id) OVER (PARTITION BY h, payload_bytes) AS best FROM p)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, (i // 4 * 5 + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::INT, 1)), '') AS payload_digest,
  CASE WHEN nth = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN nth > 1 THEN best END AS refers_to
FROM d
"""

"""WARC archives of pages: written by Spark's text sink, read back by reassembling segments.

A page is one HTTP response whose body is sent in chunks.  Of pages with equal
payloads the one with the largest id is written as a ``response``, the others
as ``revisit`` records without a payload.  A response block longer than
``SEGMENT`` bytes is cut: the first record carries segment number 1, the rest
follow as ``continuation`` records that name the first one as their origin, and
the last of them states the total length.  Every record ends with two line
ends, which is the sink's line separator, so a file that Spark commits is a
WARC file (gzip).  Chunks and segments end between characters, never inside one.

Reading takes any WARC files, compressed whole or record by record: records are
parsed by their stated length, segments are grouped by origin, ordered by their
number and held against the total length, and chunked framing is undone.

Scale.  Payloads are matched by their SHA-256: one row per distinct payload
after map-side maxima, joined back by it (a payload that a third of all pages
share is a skewed join key, which adaptive execution splits).  Files hold at most
``PER_FILE`` records of at most ``SEGMENT`` bytes.  Only segmented records are
shuffled when reading, one record to a group.

Edge cases.  Null html is an empty payload.  A null url or id leaves its header
out and reads back as null; a null id never is the largest, unless all are null:
then all are responses.  Rows that repeat both the payload and the largest id
are all responses.  Control characters and blanks in urls are percent-encoded.
Other columns are ignored.  Empty tables give no rows.  A record with missing
segments or another length or digest than stated reads back with ``complete``
false and no payload.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most bytes of a record's block, of a chunk, and most records of a file.
SEGMENT = 32 * 1024
CHUNK = 8 * 1024
PER_FILE = 8192

END = b"\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
SEPARATOR = "\r\n\r\n"
_BLANK = SEPARATOR.encode()
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")

RECORD = "record_id string, record_type string, target_uri string, date string, page_id long, refers_to long, payload_digest string, fields map<string,string>"
PARSED = f"{RECORD}, segment int, total_length long, origin string, blocks array<binary>"
READ = f"{RECORD}, payload binary, payload_bytes long, complete boolean"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def cuts(data: bytes, size: int) -> Iterator[bytes]:
    """Consecutive pieces of at most ``size`` bytes (4 at least) that end between UTF-8 characters."""
    at, size = 0, max(size, 4)
    while at < len(data):
        to = min(at + size, len(data))
        while to < len(data) and data[to] & 0xC0 == 0x80:
            to -= 1
        yield data[at:to]
        at = to


def chunked(payload: bytes, size: int) -> bytes:
    return b"".join(b"%x\r\n%s\r\n" % (len(c), c) for c in cuts(payload, size)) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; raises ValueError where the framing is broken."""
    out, at = [], 0
    while True:
        line = body.index(END, at)
        size = int(body[at:line].split(b";")[0], 16)
        at = line + 2
        if size == 0:
            return b"".join(out)
        if body[at + size : at + size + 2] != END:
            raise ValueError("chunk without an end")
        out.append(body[at : at + size])
        at += size + 2


def record(kind: str, block: bytes, **fields: object) -> bytes:
    """A WARC record without its closing line ends; fields that are None stay out."""
    lines = [b"WARC/1.1", b"WARC-Type: " + kind.encode()]
    lines += [f"{k.replace('_', '-')}: {v}".encode() for k, v in fields.items() if v is not None]
    return END.join(lines) + b"\r\nContent-Length: %d\r\n\r\n" % len(block) + block


def _urn() -> str:
    return f"<urn:uuid:{uuid.uuid4()}>"


def page_records(page_id: int | None, url: str | None, html: bytes, winner: int | None, date: str, segment: int, chunk: int) -> Iterator[bytes]:
    uri = None if url is None else _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url)
    named = {"WARC_Record_ID": _urn(), "WARC_Date": date, "WARC_Target_URI": uri, "WARC_Payload_Digest": f"sha1:{digest(html)}", "Page_ID": page_id}
    if page_id != winner:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        yield record("revisit", b"", **named, WARC_Profile=profile, Refers_To_Page_ID=winner)
        return
    kind = "application/http;msgtype=response"
    block = HTTP + chunked(html, chunk)
    pieces = list(cuts(block, segment))
    if len(pieces) == 1:
        yield record("response", block, **named, Content_Type=kind)
        return
    yield record("response", pieces[0], **named, Content_Type=kind, WARC_Segment_Number=1)
    for n, piece in enumerate(pieces[1:], 2):
        total = len(block) if n == len(pieces) else None
        yield record("continuation", piece, WARC_Record_ID=_urn(), WARC_Date=date, WARC_Target_URI=uri, WARC_Segment_Origin_ID=named["WARC_Record_ID"], WARC_Segment_Number=n, WARC_Segment_Total_Length=total)


def write(pages: DataFrame, folder: str, segment: int = SEGMENT, chunk: int = CHUNK, per_file: int = PER_FILE, date: str | None = None) -> None:
    """Write ``pages(page_id, url, html)`` as WARC files into a new ``folder``."""
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), "url", html.cast("binary").alias("html"), F.sha2(html, 256).alias("sha"))
    winners = rows.groupBy("sha").agg(F.max("page_id").alias("winner"))

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
                for r in page_records(*row, date, segment, chunk):
                    held.append(r.decode())
                    size += len(r)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["value"])
                        held, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["value"])

    lines = rows.join(winners, "sha").select("page_id", "url", "html", "winner").mapInArrow(written, "value string")
    lines.write.option("lineSep", SEPARATOR).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(folder)


def inflated(data: bytes, step: int = 1 << 18) -> Iterator[bytes]:
    """The file's bytes in steps; one gzip member, many, or none."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    while data:
        z = zlib.decompressobj(31)
        while not z.eof and data:
            yield z.decompress(data, step)
            data = z.unconsumed_tail or z.unused_data
        yield z.flush()
        if not data.startswith(b"\x1f\x8b"):
            return


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Named fields (lower case) and block of every record of a file; raises ValueError where a record is cut short."""
    source, held = inflated(data), bytearray()

    def until(have) -> bool:
        while not have():
            if (more := next(source, None)) is None:
                return False
            held.extend(more)
        return True

    while until(lambda: len(held) >= 2):
        if held.startswith(END):
            del held[:2]
            continue
        if not until(lambda: _BLANK in held):
            raise ValueError("a record's header has no end")
        to = held.index(_BLANK)
        first, *lines = re.sub(rb"\r\n[ \t]+", b" ", bytes(held[:to])).split(END)
        del held[: to + 4]
        if not first.startswith(b"WARC/"):
            raise ValueError("no WARC record")
        fields = {k.strip().lower().decode(): v.strip().decode() for k, _, v in (x.partition(b":") for x in lines)}
        size = int(fields["content-length"])
        if not until(lambda: len(held) >= size):
            raise ValueError("a record's block is shorter than stated")
        yield fields, bytes(held[:size])
        del held[:size]


def payload(fields: dict[str, str], block: bytes) -> bytes:
    """What a record delivers: the HTTP body with its framing undone, or the block."""
    if not fields.get("content-type", "").startswith("application/http"):
        return block
    head, _, body = block.partition(_BLANK)
    return unchunked(body) if re.search(rb"(?im)^transfer-encoding:\s*chunked\s*$", head.replace(END, b"\n")) else body


def decoded(fields: dict[str, str], blocks: list[bytes] | None) -> tuple[bytes | None, bool]:
    """Payload and whether it is complete: framing and digest as stated."""
    try:
        found = payload(fields, b"".join(blocks or ()))
    except ValueError:
        return None, False
    stated = fields.get("warc-payload-digest")
    return (found, True) if not stated or not stated.startswith("sha1:") or stated[5:] == digest(found) else (None, False)


def _described(f: dict[str, str]) -> list:
    whole = lambda k: int(f[k]) if k in f else None
    stated = f.get("warc-payload-digest", "").removeprefix("sha1:") or None
    return [f.get("warc-record-id"), f.get("warc-type"), f.get("warc-target-uri"), f.get("warc-date"), whole("page-id"), whole("refers-to-page-id"), stated, list(f.items())]


def _read(fields: dict[str, str], blocks: list[bytes] | None, sound: bool, keep: bool) -> list:
    row = _described(fields)
    if row[1] == "revisit":
        return [*row, None, None, True]
    found, complete = decoded(fields, blocks) if sound else (None, False)
    if found is not None:
        row[6] = digest(found)
    return [*row, found if keep else None, None if found is None else len(found), complete]


def _batches(rows: Iterator[list], schema: pa.Schema, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 500 + sum(len(x) for x in row if isinstance(x, bytes)) + sum(map(len, row[-1] if isinstance(row[-1], list) else ()))
        if size > most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema.names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema.names)


_RECORD = [("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("fields", pa.map_(pa.string(), pa.string()))]
_PARSED = pa.schema([*_RECORD, ("segment", pa.int32()), ("total_length", pa.int64()), ("origin", pa.string()), ("blocks", pa.list_(pa.binary()))])
_READ = pa.schema([*_RECORD, ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("complete", pa.bool_())])


def read(spark: SparkSession, folder: str, keep_payload: bool = True) -> DataFrame:
    """Every record of the WARC files in ``folder`` but continuations, which are part of their origin.

    ``payload_digest`` is computed from the payload; revisits have the one
    that their header states and neither payload nor length.
    """
    files = spark.read.format("binaryFile").load(folder).select("content")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict[str, str], bytes]]:
        for batch in batches:
            for data in batch.column(0):
                yield from records(data.as_py())

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches((_read(f, [b], True, keep_payload) for f, b in each(batches) if "warc-segment-number" not in f), _READ)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(([*_described(f), int(f["warc-segment-number"]), int(f["warc-segment-total-length"]) if "warc-segment-total-length" in f else None, f.get("warc-segment-origin-id", f.get("warc-record-id")), [b]] for f, b in each(batches) if "warc-segment-number" in f), _PARSED)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in range(4))))
        return _batches((_read(dict(f), blocks, sound, keep_payload) for f, blocks, sound, has in rows if has), _READ)

    part = F.struct("segment", F.col("blocks")[0].alias("block"), "total_length", "fields")
    groups = files.mapInArrow(segments, PARSED).groupBy("origin").agg(F.collect_list(part).alias("parts"))
    ordered = F.array_sort("parts", lambda a, b: (a["segment"] - b["segment"]).cast("int"))
    # numbers run from 1 without gaps or repeats, and the last states the sum of all lengths
    parts = groups.select(ordered.alias("parts"))
    sound = (F.transform("parts", lambda p: p["segment"]) == F.sequence(F.lit(1), F.size("parts"))) & F.coalesce(
        F.element_at("parts", -1)["total_length"] == F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + F.length(p["block"])), F.lit(False)
    )
    origin = F.element_at("parts", 1)
    assembled = parts.select(origin["fields"].alias("fields"), F.transform("parts", lambda p: p["block"]).alias("blocks"), sound.alias("sound"), (origin["segment"] == 1).alias("has"))
    return files.mapInArrow(whole, READ).unionByName(assembled.mapInArrow(joined, READ))


def inventory(read_back: DataFrame) -> DataFrame:
    """One row per page: payload length and digest, record type, and for revisits the response's page.

    A revisit takes the length from the response that it names, by id and digest.
    """
    rows = read_back.where(F.col("record_type").isin("response", "revisit")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "complete")
    held = rows.where("record_type = 'response'").groupBy(F.col("page_id").alias("of"), F.col("payload_digest").alias("its")).agg(F.max("payload_bytes").alias("length"))
    linked = rows.join(held, (F.col("refers_to") == F.col("of")) & (F.col("payload_digest") == F.col("its")), "left")
    return linked.select("page_id", F.coalesce("payload_bytes", "length").alias("payload_bytes"), "payload_digest", "record_type", "refers_to", "complete")

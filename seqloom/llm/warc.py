"""WARC archives with segmented records.

Writing: a record per row. Payloads go into HTTP entities, in chunks of `chunk` bytes where they are longer. Blocks
beyond `segment` bytes are cut: the first record carries segment number 1, continuation records name it as their origin,
and the last one has the total length. Of equal payloads of at least `dedupe` bytes only one is written, the others
are revisits of it. Spark's text writer writes the records with CRLF CRLF behind each, to any file system.

Reading: files are parsed by Content-Length, continuations are grouped by origin, ordered by number and joined, their
number and total length are verified, and chunked framing is decoded. A record that fails has an error and no payload.

Defined results: a null payload is empty; a null target is left out; line breaks in a target are percent-encoded;
rows that repeat an identifier are records of their own; a revisit refers to the largest identifier of its payload; an
empty table gives archives without records. One record's segments are gathered in one task, never more.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.common import spread_join, stored, utf8

DATE = "2024-01-01T00:00:00Z"
HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


def cut(data: bytes, most: int) -> Iterator[bytes]:
    """Pieces of UTF-8 text of at most `most` bytes that don't part a character."""
    at = 0
    while at < len(data):
        end = min(len(data), at + most)
        while end < len(data) and end > at + 1 and data[end] & 0xC0 == 0x80:
            end -= 1
        yield data[at:end]
        at = end


def entity(payload: bytes, chunk: int) -> bytes:
    if len(payload) <= chunk:
        return f"{HEAD}Content-Length: {len(payload)}\r\n\r\n".encode() + payload
    parts = [f"{HEAD}Transfer-Encoding: chunked\r\n\r\n".encode()]
    for piece in cut(payload, chunk):
        parts += (f"{len(piece):x}\r\n".encode(), piece, b"\r\n")
    return b"".join([*parts, b"0\r\n\r\n"])


def records(page: int | None, part: str, target: str | None, sha1: str, payload: bytes, keep: int | None, chunk: int, segment: int) -> Iterator[bytes]:
    """The records of one row without the line breaks behind them. keep: the row that a revisit refers to."""
    name, digest = f"urn:page:{page}:{part}", base64.b32encode(bytes.fromhex(sha1)).decode()
    target = "" if target is None else "WARC-Target-URI: " + target.replace("\r", "%0D").replace("\n", "%0A") + "\r\n"
    same = f"WARC-Date: {DATE}\r\n{target}"

    def record(kind: str, block: bytes, id: str, more: str) -> bytes:
        return f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{id}>\r\n{same}{more}Content-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block

    told = f"WARC-Payload-Digest: sha1:{digest}\r\n"
    if keep is not None:
        yield record("revisit", (HEAD + "\r\n").encode(), name, f"{told}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:{keep}>\r\n")
        return
    block = entity(payload, chunk)
    if len(block) <= segment:
        yield record("response", block, name, told)
        return
    pieces = list(cut(block, segment))
    for i, piece in enumerate(pieces, 1):
        total = f"WARC-Segment-Total-Length: {len(block)}\r\n" if i == len(pieces) else ""
        number = f"WARC-Segment-Number: {i}\r\n"
        yield record("response", piece, name, told + number + total) if i == 1 else record("continuation", piece, f"{name}:{i}", f"WARC-Segment-Origin-ID: <{name}>\r\n{number}{total}")


def write(
    rows: DataFrame,
    path: str,
    id: str = "page_id",
    target: str = "url",
    payload: str = "html",
    dedupe: int = 1000,
    chunk: int = 4096,
    segment: int = 16384,
    file_bytes: int = 32 << 20,
) -> None:
    """The rows as archives in a folder. A file has about file_bytes at most, as far as records are of usual size."""
    raw = utf8(payload)
    small = stored(rows.select(F.col(f"`{id}`").cast("bigint").alias("id"), F.sha1(raw).alias("sha1"), F.octet_length(raw).cast("bigint").alias("n")), "payloads")
    again = small.filter(F.col("n") >= dedupe).groupBy("sha1").agg(F.max("id").alias("keep"), F.count("*").alias("times")).filter("times > 1 and keep is not null").drop("times")
    n, total = small.agg(F.count("*"), F.sum(F.least("n", F.lit(segment)) + 600)).first()
    per_file = max(64, file_bytes * n // max(total or 1, 1))
    left = rows.select(F.col(f"`{id}`").cast("bigint").alias("id"), F.col(f"`{target}`").cast("string").alias("target"), F.sha1(raw).alias("sha1"), raw.alias("payload"))
    joined = spread_join(left, again, "sha1", F.xxhash64("id", "target")).select("id", "target", "sha1", F.when(F.col("keep").isNull() | F.col("keep").eqNullSafe(F.col("id")), F.col("payload")).alias("payload"), F.when(~F.col("keep").eqNullSafe(F.col("id")), F.col("keep")).alias("keep"))

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        for b in batches:
            out, held = [], 0
            for row in zip(*(c.to_pylist() for c in b.columns)):
                made += 1
                page, target, sha1, payload, keep = row
                for r in records(page, f"{part}.{made}", target, sha1, payload or b"", keep, chunk, segment):
                    out.append(r)
                    held += len(r)
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).cast(pa.string())], ["value"])
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).cast(pa.string())], ["value"])

    joined.mapInArrow(lines, "value string").write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", per_file).text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The headers, with names in lower case, and the block of each record."""
    at = 0
    while (at := data.find(b"WARC/1.", at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        headers = {}
        for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            headers[name.strip().lower()] = value.strip()
        size = int(headers.get("content-length", 0))
        yield headers, data[end + 4 : end + 4 + size]
        at = end + 4 + size


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP response, chunked framing taken off. Raises ValueError for framing that doesn't fit."""
    head, sep, body = block.partition(b"\r\n\r\n")
    if not sep:
        raise ValueError("no end of the HTTP headers")
    lines = [x.lower() for x in head.split(b"\r\n")]
    if not any(x.startswith(b"transfer-encoding:") and b"chunked" in x for x in lines):
        sizes = [int(x.split(b":", 1)[1]) for x in lines if x.startswith(b"content-length:")]
        if sizes and sizes[0] != len(body):
            raise ValueError(f"{len(body)} bytes of {sizes[0]}")
        return body
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("no size of a chunk")
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(parts)
        if body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("a chunk of another length")
        parts.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size


def _bare(value: str | None) -> str | None:
    return value.strip("<>") if value else None


def _page(urn: str | None) -> int | None:
    lead = (urn or "").split(":")[2:3]
    return int(lead[0]) if lead and lead[0].lstrip("-").isdigit() else None


RECORD = "page_id bigint, record_type string, target string, refers_to bigint, digest string, payload binary, error string"


def _out(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [c.split()[0] for c in RECORD.split(", ")])


def _record(headers: dict[str, str], block: bytes, error: str | None = None) -> tuple:
    kind, payload = headers.get("warc-type"), None
    if kind == "response" and not error:
        try:
            payload = payload_of(block)
        except ValueError as e:
            error = str(e)
    told = headers.get("warc-payload-digest", "")
    digest = base64.b32decode(told[5:]).hex() if told.startswith("sha1:") else None
    return _page(_bare(headers.get("warc-record-id"))), kind, headers.get("warc-target-uri"), _page(_bare(headers.get("warc-refers-to"))), digest, payload, error


def read(spark: SparkSession, path: str) -> DataFrame:
    """A row per record of the archives in a folder, continuations joined to their first record: see RECORD."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path).select("content")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                rows, held = [], 0
                for headers, block in parse(data.as_py()):
                    if "warc-segment-number" not in headers:
                        rows.append(_record(headers, block))
                        held += len(block)
                    if held > 8 << 20:
                        yield _out(rows)
                        rows, held = [], 0
                if rows:
                    yield _out(rows)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                rows = []
                for headers, block in parse(data.as_py()):
                    if number := headers.get("warc-segment-number"):
                        origin = _bare(headers.get("warc-segment-origin-id") or headers.get("warc-record-id"))
                        head = "\n".join(f"{k}\t{v}" for k, v in headers.items()) if "warc-segment-origin-id" not in headers else None
                        rows.append((origin, int(number), int(headers.get("warc-segment-total-length", -1)), head, block))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.int32(), pa.int64(), pa.string(), pa.binary()))], ["origin", "number", "total", "head", "block"])

    def reassemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for origin, parts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                head = next((p["head"] for p in parts if p["head"]), None)
                headers = dict(x.split("\t", 1) for x in head.split("\n")) if head else {"warc-type": "response", "warc-record-id": origin}
                block, total = b"".join(p["block"] for p in parts), max(p["total"] for p in parts)
                error = None
                if [p["number"] for p in parts] != list(range(1, len(parts) + 1)) or head is None:
                    error = f"segments {[p['number'] for p in parts]}"
                elif total != len(block):
                    error = f"{len(block)} bytes of {total}" if total >= 0 else "no last segment"
                rows.append(_record(headers, block, error))
            if rows:
                yield _out(rows)

    groups = files.mapInArrow(segments, "origin string, number int, total bigint, head string, block binary").groupBy("origin")
    joined = groups.agg(F.sort_array(F.collect_list(F.struct("number", "total", "head", "block"))).alias("parts")).mapInArrow(reassemble, RECORD)
    return files.mapInArrow(whole, RECORD).unionByName(joined)


def digests(read_back: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each record; a revisit's from the record it refers to. A payload that doesn't
    match its header has no digest."""
    facts = stored(read_back.select("page_id", "record_type", "refers_to", "digest", F.octet_length("payload").cast("bigint").alias("n"), F.sha1("payload").alias("sha1")), "records")
    first = facts.filter("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), F.col("sha1").alias("digest")).agg(F.max("n").alias("n2"))
    out = facts.join(first, ["refers_to", "digest"], "left")
    size = F.when(F.col("record_type") == "response", F.col("n")).otherwise(F.col("n2"))
    found = F.when(F.col("record_type") == "response", F.col("sha1")).when(F.col("n2").isNotNull(), F.col("digest"))
    return out.select("page_id", size.alias("payload_bytes"), F.when(found == F.col("digest"), found).alias("payload_digest"), "record_type", "refers_to")

"""WARC archives: write records, normalise monolithic gzip files, index them, read them back.

A monolithic file is one gzip stream over many records, which no reader can seek in. The normaliser
inflates such a stream once, from front to back, rewrites every record as a gzip member of its own
and lists the members' offsets in a sidecar index. It holds one record at a time, and also takes
files of several members or none compressed.

Of pages with equal payloads the one with the largest page_id is a response, the others are revisits
that name it and carry the HTTP header alone. Archives are rows of a table (archive, content, index),
so they lie wherever Spark writes; ``export`` writes them as files to a folder of this machine.

Defined results: a null html is an empty payload, a null url an empty one; control characters and
blanks of a url are percent-encoded; repeated rows of one page_id are a record each; an empty table
gives no archive; other columns are ignored. A record that breaks the format raises ``WarcError``.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import bounded, release
from .store import keep

#: Bytes of records of one archive; a longer record has an archive of its own.
ARCHIVE = 8_000_000
#: Revisits, of about 100 bytes each, up to which they are broadcast to the pages.
BROADCAST_ROWS = 100_000
#: Pages of one payload from which they are joined by a broadcast.
HOT = 10_000
#: Payloads from so many bytes on are told apart by digest.
LEAST = 0

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
INDEX = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string()), ("type", pa.string()), ("uri", pa.string()), ("digest", pa.string())]))
INDEX_DDL = "array<struct<offset:bigint,length:bigint,record_id:string,type:string,uri:string,digest:string>>"


class WarcError(ValueError):
    """The bytes are no sequence of WARC records."""


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None = None) -> bytes:
    """A response record, or a revisit record if ``refers_to`` is given."""
    block = HTTP.format(len(payload)).encode() + (payload if refers_to is None else b"")
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    head = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", "WARC-Date: 2000-01-01T00:00:00Z", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest(payload)}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(["WARC/1.1", *head, "", ""]).encode() + block + b"\r\n\r\n"


def inflate(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """The plain bytes of a gzip file of one or more members, or of a file that is not compressed."""
    tool, fresh, plain, head = zlib.decompressobj(31), True, None, b""
    for chunk in chunks:
        if plain is None:
            chunk = head = head + chunk
            if len(head) < 2:
                continue
            plain = not head.startswith(b"\x1f\x8b")
        if plain:
            yield chunk
            continue
        while chunk:
            if tool.eof:
                tool, fresh = zlib.decompressobj(31), True
            try:
                out = tool.decompress(chunk)
            except zlib.error as e:
                raise WarcError(f"gzip: {e}") from e
            fresh = False
            yield out
            chunk = tool.unused_data
    if plain is None:
        yield head
    if plain is False and not tool.eof and not fresh:
        raise WarcError("the gzip stream is cut off")


def fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise WarcError(f"no WARC record: {lines[0][:40]!r}")
    out: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out[name.strip().lower()] = value.strip()
    return out


def records(chunks: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, the whole record) of a plain stream."""
    held = bytearray()
    chunks = iter(chunks)

    def more() -> bool:
        for chunk in chunks:
            if chunk:
                held.extend(chunk)
                return True
        return False

    while True:
        while held[:2] == b"\r\n":
            del held[:2]
        seen = 0
        while (at := held.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(held)
            if not more():
                if held.strip():
                    raise WarcError("the last record is cut off")
                return
            while held[:2] == b"\r\n":
                del held[:2]
                seen = 0
        head = fields(bytes(held[:at]))
        try:
            size = at + 4 + int(head["content-length"]) + 4
        except (KeyError, ValueError) as e:
            raise WarcError("a record without a Content-Length") from e
        while len(held) < size:
            if not more():
                raise WarcError("the last record is cut off")
        if held[size - 4 : size] != b"\r\n\r\n":
            raise WarcError("a record does not end where its length says")
        yield head, bytes(held[:size])
        del held[:size]


def normalise(chunks: Iterable[bytes], level: int = 6) -> tuple[bytes, list[dict]]:
    """The file with every record as its own gzip member, and the index of the members."""
    out, index = bytearray(), []
    for head, whole in records(inflate(chunks)):
        tool = zlib.compressobj(level, zlib.DEFLATED, 31)
        member = tool.compress(whole) + tool.flush()
        name = lambda k: head.get(k)
        index.append({"offset": len(out), "length": len(member), "record_id": name("warc-record-id"), "type": name("warc-type"), "uri": name("warc-target-uri"), "digest": name("warc-payload-digest")})
        out += member
    return bytes(out), index


def read_record(member: bytes) -> tuple[int | None, int, str, str, int | None]:
    """(page_id, payload bytes, digest, type, refers_to) of one member; a response's digest is tested."""
    (head, whole), *rest = records(inflate([member]))
    if rest:
        raise WarcError("a member holds more than one record")
    block = whole[len(whole) - 4 - int(head["content-length"]) : -4]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda k: None if (m := re.search(r"-?\d+", head.get(k, ""))) is None else int(m[0])
    size = int(re.search(rb"(?i)content-length: (\d+)", http)[1])
    found = head["warc-payload-digest"].removeprefix("sha1:")
    if head["warc-type"] == "response" and (len(payload) != size or digest(payload) != found):
        raise WarcError("a payload does not have its digest")
    return number("warc-record-id"), size, found, head["warc-type"], number("warc-refers-to")


def _payload() -> Column:
    return F.encode(F.coalesce("html", F.lit("")), "UTF-8")


def revisits(pages: DataFrame, least: int = LEAST, hot: int = HOT) -> DataFrame:
    """(page_id, sha1, refers_to) of the pages whose payload a page with a larger page_id has too.

    Payloads that over ``hot`` pages share are joined by a broadcast, so that their pages don't meet in one
    task; ``hot`` doubles until there are at most BROADCAST_ROWS of them.
    """
    own = keep(pages.select("page_id", F.sha1(_payload()).alias("sha1"), F.length(_payload()).alias("bytes")).filter(F.col("bytes") >= least), "digests")
    many = own.groupBy("sha1", "bytes").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    many = keep(many, "shared")
    while many.filter(F.col("n") > hot).count() > BROADCAST_ROWS:
        hot *= 2
    top, rest = many.filter(F.col("n") > hot).drop("n"), many.filter(F.col("n") <= hot).drop("n")
    named = own.join(F.broadcast(top.withColumnRenamed("refers_to", "_top")), ["sha1", "bytes"], "left")
    found = named.filter("_top IS NOT NULL").withColumnRenamed("_top", "refers_to").unionByName(named.filter("_top IS NULL").drop("_top").join(rest, ["sha1", "bytes"]))
    return found.filter("page_id < refers_to").select("page_id", "sha1", "refers_to").distinct()


def write_archives(pages: DataFrame, size: int = ARCHIVE, level: int = 1) -> DataFrame:
    """(archive, content) of the pages (page_id, url, html), each a monolithic gzip stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        tool, parts, held = zlib.compressobj(level, zlib.DEFLATED, 31), [], 0

        def close() -> pa.RecordBatch:
            nonlocal tool, parts, held, n
            content = b"".join([*parts, tool.flush()])
            tool, parts, held, n = zlib.compressobj(level, zlib.DEFLATED, 31), [], 0, n + 1
            return pa.RecordBatch.from_arrays([pa.array([f"part-{task:06d}-{n:06d}"]), pa.array([content], pa.binary())], ["archive", "content"])

        for batch in batches:
            texts = batch.column("html").cast(pa.large_binary())
            for page, url, to, k in zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), batch.column("refers_to").to_pylist(), range(batch.num_rows)):
                data = record(page, url or "", texts[k].as_py() or b"", to)
                if held and held + len(data) > size:
                    yield close()
                parts.append(tool.compress(data))
                held += len(data)
        if held:
            yield close()
        release()

    again = keep(revisits(pages), "revisits")
    few = again.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS  # else the join shuffles the pages
    rows = bounded(pages).select("page_id", "url", "html", F.sha1(_payload()).alias("sha1")).join(F.broadcast(again) if few else again, ["page_id", "sha1"], "left")
    return keep(rows.select("page_id", "url", "html", "refers_to").mapInArrow(run, "archive string, content binary"), "archives")


def normalise_archives(archives: DataFrame, level: int = 6) -> DataFrame:
    """(archive, content, index) with a gzip member for each record and the sidecar index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                content = memoryview(batch.column("content")[k].as_buffer())
                out, index = normalise((bytes(content[i : i + 65536]) for i in range(0, len(content), 65536)), level)
                yield pa.RecordBatch.from_arrays([batch.column("archive").slice(k, 1), pa.array([out], pa.binary()), pa.array([index], INDEX)], ["archive", "content", "index"])

    return keep(archives.select("archive", "content").mapInArrow(run, f"archive string, content binary, index {INDEX_DDL}"), "members")


def read_archives(archives: DataFrame) -> DataFrame:
    """One row per record, each found by its offset in the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                content = memoryview(batch.column("content")[k].as_buffer())
                rows = [read_record(bytes(content[x["offset"] : x["offset"] + x["length"]])) for x in batch.column("index")[k].as_py()]
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return archives.select("content", "index").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def export(archives: DataFrame, folder: str) -> None:
    """Write each normalised archive and its index (offset, length, record_id, type, uri, digest, by tabs) to a folder that this machine and all executors share."""

    def run(rows) -> None:
        for r in rows:
            (Path(folder) / f"{r['archive']}.warc.gz").write_bytes(r["content"])
            (Path(folder) / f"{r['archive']}.idx").write_text("".join("\t".join(str(v) for v in x) + "\n" for x in r["index"]))

    Path(folder).mkdir(parents=True, exist_ok=True)
    archives.foreachPartition(run)


#: The query's rows in DuckDB's SQL; five hexadecimal digits of a digest are four of base 32.
ORACLE = """
WITH d AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS x FROM pages),
k AS (SELECT *, max(page_id) OVER (PARTITION BY x) AS last FROM d),
b AS (SELECT *, [CAST('0x' || substr(x, CAST(5 * g + 1 AS INT), 5) AS INT) FOR g IN range(8)] AS v FROM k)
SELECT page_id, payload_bytes, list_aggregate([list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((n >> s) & 31) + 1, 1) FOR s IN [15, 10, 5, 0]], 'string_agg', '') FOR n IN v], 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to
FROM b
"""

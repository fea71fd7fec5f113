"""WARC archives: one gzip member per record, written by tasks and read back as streams.

Writing: each task writes its rows as records into archives of bounded size in a shared
folder. A file appears under its name only when whole, and a task that runs again writes
the same file. Of records with equal payloads of at least ``least_bytes``, the one with
the largest page id is a response and the others are revisits that refer to it.

Reading: an archive is read front to back in small blocks, whatever its size. A record
is framed by its Content-Length and has to end where its gzip member ends; its block and
payload digests are computed while it passes and compared with the headers. Archives
that are cut short, framed wrongly or altered raise ``WarcError``.

Null html is an empty payload; a null url is written as the record's own name and comes
back null. Rows with a null page id are written as ``null`` and come back null; they are
responses. Repeated rows are repeated records: of equal payloads every row with the
largest id is a response. No rows: no archives and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewise.llm.common import SharedFiles, lookup_join
from sitewise.session import checkpointed

BLOCK = 1 << 18
LARGEST_HEADER = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


@dataclass(frozen=True)
class WarcParams:
    least_bytes: int = 1000
    date: str = "2000-01-01T00:00:00Z"
    archive_bytes: int = 64 << 20
    level: int = 5


class WarcError(ValueError):
    """An archive that is not what its headers say."""


@dataclass
class Record:
    headers: dict[str, str]
    http: dict[str, str] = field(default_factory=dict)
    payload: bytes = b""


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _named(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _page(name: str | None) -> int | None:
    text = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text.lstrip("-").isdigit() else None


def member(headers: list[tuple[str, str]], block: bytes, level: int) -> bytes:
    """One record as one gzip member with a fixed header, so equal records are equal bytes."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("WARC-Block-Digest", _digest(block)), ("Content-Length", str(len(block)))])
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(b"WARC/1.1\r\n" + lines.encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n") + pack.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, params: WarcParams) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    target = _named(page_id)[1:-1] if url is None else "".join(c if c.isprintable() and c != " " else f"%{ord(c):02X}" for c in url)
    headers = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _named(page_id)), ("WARC-Date", params.date),
               ("WARC-Target-URI", target), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", _digest(payload))]
    if refers_to is not None:
        return member([*headers, ("WARC-Profile", PROFILE), ("WARC-Refers-To", _named(refers_to))], http, params.level)
    return member(headers, http + payload, params.level)


def _info(name: str, params: WarcParams) -> bytes:
    headers = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:archive:{name}>"), ("WARC-Date", params.date),
               ("WARC-Filename", name), ("Content-Type", "application/warc-fields")]
    return member(headers, b"format: WARC File Format 1.1\r\n", params.level)


def with_references(pages: DataFrame, params: WarcParams) -> DataFrame:
    """Add ``refers_to``. Only digests are grouped; only payloads that occur again are joined back."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    sized = pages.select("page_id", "url", "html", F.when(F.octet_length(payload) >= params.least_bytes, F.sha2(payload, 256)).alias("_sha"))
    again = sized.where("_sha is not null and page_id is not null").groupBy("_sha") \
        .agg(F.max("page_id").alias("_top"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_sha", "_top")
    return lookup_join(sized, again, ["_sha"]).select(
        "page_id", "url", "html", F.when(F.col("page_id") < F.col("_top"), F.col("_top")).alias("refers_to"))


def _whole(value) -> int | None:
    return None if pd.isna(value) else int(value)


def _written(batches: Iterator[pd.DataFrame], folder: str, params: WarcParams) -> Iterator[pd.DataFrame]:
    files, part, number, rows = SharedFiles(folder), TaskContext.get().partitionId(), 0, _pages(batches)
    row = next(rows, None)
    while row is not None:
        name, size, records = f"part-{part:06d}-{number:04d}.warc.gz", 0, 0
        with files.write(name) as out:
            out.write(_info(name, params))
            while row is not None and size < params.archive_bytes:
                data = page_record(*row, params)
                out.write(data)
                size, records, row = size + len(data), records + 1, next(rows, None)
        number += 1
        yield pd.DataFrame({"archive": [name], "records": [records], "bytes": [size]})


def _pages(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    for batch in batches:
        for page_id, url, html, refers_to in zip(batch["page_id"], batch["url"], batch["html"], batch["refers_to"]):
            yield _whole(page_id), url, (html or "").encode("utf-8", "surrogatepass"), _whole(refers_to)


def write_archives(pages: DataFrame, folder: str, params: WarcParams = WarcParams()) -> DataFrame:
    """Write ``page_id, url, html`` and return ``archive, records, bytes`` per archive."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    rows = with_references(pages, params).withColumns({c: F.col(c).cast("decimal(20,0)") for c in ("page_id", "refers_to")})
    return checkpointed(rows.mapInPandas(lambda batches: _written(batches, folder, params), "archive string, records long, bytes long"))


def records(stream) -> Iterator[Record]:
    """The records of an archive, front to back."""
    waiting = b""
    while True:
        waiting = waiting or stream.read(BLOCK)
        if not waiting:
            return
        unpack = zlib.decompressobj(31)
        pending = bytearray()

        def more() -> bool:
            nonlocal waiting
            if unpack.eof:
                return False
            data = waiting or stream.read(BLOCK)
            waiting = b""
            if not data:
                raise WarcError("the archive ends inside a record")
            try:
                pending.extend(unpack.decompress(data))
            except zlib.error as fault:
                raise WarcError(f"not a gzip member: {fault}") from fault
            waiting = unpack.unused_data if unpack.eof else b""
            return True

        yield _record(pending, more)


def _record(pending: bytearray, more) -> Record:
    while (end := pending.find(b"\r\n\r\n")) < 0:
        if len(pending) > LARGEST_HEADER or not more():
            raise WarcError("a record without a whole header")
    first, *lines = bytes(pending[:end]).decode("utf-8", "surrogatepass").split("\r\n")
    if not first.startswith("WARC/1."):
        raise WarcError(f"not a record: {first[:40]!r}")
    headers = dict(line.split(": ", 1) for line in lines if ": " in line)
    if not headers.get("Content-Length", "").isdigit():
        raise WarcError("a record without a length")
    length = int(headers["Content-Length"])
    del pending[:end + 4]
    block, left, digest = bytearray(), length, hashlib.sha1()
    while True:
        piece = bytes(pending[:left])
        digest.update(piece)
        block.extend(piece)
        del pending[:len(piece)]
        left -= len(piece)
        if not left:
            break
        if not more():
            raise WarcError("a member that ends inside its block")
    while more():
        pass
    if pending != b"\r\n\r\n":
        raise WarcError("a block that is not as long as its header says")
    _same(headers.get("WARC-Block-Digest"), digest.digest(), "block")
    record = Record(headers, payload=bytes(block))
    if headers.get("Content-Type", "").startswith("application/http"):
        head, _, payload = record.payload.partition(b"\r\n\r\n")
        record.http = dict(x.split(": ", 1) for x in head.decode("latin-1").split("\r\n")[1:] if ": " in x)
        record.payload = payload
        if headers["WARC-Type"] == "response":
            _same(headers.get("WARC-Payload-Digest"), hashlib.sha1(payload).digest(), "payload")
    return record


def _same(said: str | None, found: bytes, what: str) -> None:
    if said and said != "sha1:" + base64.b32encode(found).decode():
        raise WarcError(f"the {what} digest is not that of the {what}")


def _read(batches: Iterator[pd.DataFrame], folder: str, with_payload: bool) -> Iterator[pd.DataFrame]:
    files = SharedFiles(folder)
    for batch in batches:
        for name in batch["archive"]:
            with files.read(name) as stream:
                rows, size = [], 0
                for r in records(stream):
                    if r.headers["WARC-Type"] not in ("response", "revisit"):
                        continue
                    rows.append(_row(r, with_payload))
                    size += len(r.payload) if with_payload else 100
                    if size > 8 << 20:
                        yield _frame(rows)
                        rows, size = [], 0
                if rows:
                    yield _frame(rows)


def _row(r: Record, with_payload: bool) -> tuple:
    kind, uri = r.headers["WARC-Type"], r.headers.get("WARC-Target-URI")
    digest = r.headers.get("WARC-Payload-Digest", "").removeprefix("sha1:")
    own = r.headers.get("WARC-Record-ID", "")
    return (_page(own), None if uri == own[1:-1] else uri, kind, _page(r.headers.get("WARC-Refers-To")),
            len(r.payload) if kind == "response" else int(r.http["Content-Length"]), base64.b32decode(digest).hex(), r.payload if with_payload else None)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"])
    return out.astype({"page_id": "Int64", "refers_to": "Int64"})


def list_archives(spark: SparkSession, folder: str) -> DataFrame:
    """``archive, bytes`` of the archives in a folder; their contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
    return found.select(F.regexp_extract("path", r"[^/]+$", 0).alias("archive"), F.col("length").alias("bytes"))


def read_archives(archives: DataFrame, folder: str, with_payload: bool = False, tasks: int | None = None) -> DataFrame:
    """A row per response or revisit of the named archives; every archive is a stream of its own."""
    names = archives.select("archive")
    dealt = names.repartition(tasks) if tasks else names.repartition("archive")
    return dealt.mapInPandas(lambda batches: _read(batches, folder, with_payload), RECORD)

"""WARC archives: a deterministic sharded writer, and the reader of what it commits."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.llm.common import running_total, shuffle_width

MIN_REVISIT_BYTES = 1000
FILE_BYTES = 32 << 20
SHARD_BYTES = 64 << 20
MOST_SHARDS = 65536
NO_ID = -(2**63)
WHEN = "2024-01-01T00:00:00Z"
MANIFEST = "shard int, file string, records long, bytes long, sha1 string"
RECORD = ("page_id long, url string, record_type string, payload_bytes long, "
          "payload_digest string, refers_to long")
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    if "://" in folder or folder.startswith("file:"):
        return fs.FileSystem.from_uri(folder)
    return fs.LocalFileSystem(), folder


def _sha1(data: bytes) -> bytes:
    return hashlib.sha1(data, usedforsecurity=False).digest()


def _record_id(page_id: int | None, digest: bytes) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest.hex()}')}>"


def encode_record(
    page_id: int | None, url: str | None, payload: bytes | None, digest: bytes, length: int,
    refers_to: int | None,
) -> bytes:
    """One record, as bytes before compression; ``payload`` is None for a revisit."""
    label = base64.b32encode(digest).decode()
    block = b"" if payload is None else HTTP_HEAD % length + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if payload is None else 'response'}",
        f"WARC-Record-ID: {_record_id(page_id, digest)}",
        f"WARC-Date: {WHEN}",
        f"WARC-Payload-Digest: sha1:{label}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(_sha1(block)).decode()}",
        f"X-Payload-Length: {length}",
    ]
    if url is not None:
        # only what would end the header line, or be taken as an escape, is quoted
        head.append("WARC-Target-URI: " + quote(url, safe="".join(
            chr(c) for c in range(33, 127) if chr(c) != "%")))
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if payload is None:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {_record_id(refers_to, digest)}",
            f"X-Refers-To-Page-Id: {refers_to}",
        ]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _gzip(record: bytes) -> bytes:
    squeeze = zlib.compressobj(6, wbits=31)
    return squeeze.compress(record) + squeeze.flush()


class _Shard:
    """The files of one shard: written under temporary names, renamed when they are whole."""

    def __init__(self, folder: str, shard: int, file_bytes: int) -> None:
        self.store, self.path = _store(folder)
        self.shard, self.file_bytes, self.count = shard, file_bytes, 0
        self.out = None

    def add(self, member: bytes) -> Iterator[tuple]:
        if self.out is None:
            self.name = f"shard-{self.shard:05d}-{self.count:04d}.warc.gz"
            self.temp = f"{self.path}/_tmp-{uuid.uuid4().hex}"
            self.out = self.store.open_output_stream(self.temp, compression=None)
            self.records = self.size = 0
            self.hash = hashlib.sha1(usedforsecurity=False)
        self.out.write(member)
        self.hash.update(member)
        self.records += 1
        self.size += len(member)
        if self.size >= self.file_bytes:
            yield from self.roll()

    def roll(self) -> Iterator[tuple]:
        if self.out is not None:
            self.out.close()
            self.store.move(self.temp, f"{self.path}/{self.name}")
            yield self.shard, self.name, self.records, self.size, self.hash.hexdigest()
            self.count, self.out = self.count + 1, None


def _write(folder: str, file_bytes: int):
    names = [c.strip().split(" ")[0] for c in MANIFEST.split(",")]
    types = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names
        )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen_by, original = None, None, None
        for rows in batches:
            for r in rows.to_pylist():
                page = (r["page_id"], r["digest"])
                if r["member"] is None:  # the page's decision comes before its records
                    seen_by, original = page, r["refers_to"]
                    continue
                if now is None or now.shard != r["shard"]:
                    if now is not None and (done := list(now.roll())):
                        yield batch(done)
                    now = _Shard(folder, r["shard"], file_bytes)
                member = r["member"]
                if page == seen_by:
                    member = _gzip(encode_record(
                        r["page_id"], r["url"], None, bytes.fromhex(r["digest"]),
                        r["payload_bytes"], original,
                    ))
                if done := list(now.add(member)):
                    yield batch(done)
        if now is not None and (done := list(now.roll())):
            yield batch(done)

    return write


def write_warc(
    pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES, shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """Write one record per row of ``pages`` (page_id, url, html) and return the manifest.

    Records are sorted by (page_id, digest) and cut into shards of about ``shard_bytes`` of
    payload at fixed places of that order, so a rerun makes the same files whatever the
    partitioning, and rows that share a page_id, or have none, are cut as well. A
    shard's files roll at ``file_bytes`` compressed; a retried or doubled task renames equal
    bytes onto the same name. What the manifest table in ``folder`` lists is committed, and
    nothing else is.

    Of records with equal payloads of at least 1000 bytes that with the largest page_id is the
    response and the others are revisits of it; smaller ones are all responses. A null html is
    an empty payload, a null url has no target header. Rows that share a page_id are written
    one by one (of equal payloads under one largest id, all are responses); a null page_id
    sorts first and is never referred to. An empty table gives an empty manifest.
    """
    spark = pages.sparkSession
    store, path = _store(folder)
    store.create_dir(path, recursive=True)
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumns({
        "payload_bytes": F.octet_length("html").cast("long"),
        "digest": F.sha1(F.encode("html", "UTF-8")),
    })
    sizes = rows.groupBy("page_id", "digest").agg(F.sum("payload_bytes").alias("payload_bytes"))
    placed = running_total(sizes, ["page_id", "digest"], "payload_bytes", "warc-order")
    total = placed.agg(F.sum("payload_bytes")).first()[0] or 0
    shard_bytes = max(shard_bytes, -(-total // MOST_SHARDS))  # bounds the list of cuts
    starts = [
        (NO_ID if r.start.page_id is None else r.start.page_id, r.start.digest)
        for r in placed.groupBy(F.floor(F.col("before") / shard_bytes).alias("shard"))
        .agg(F.min(F.struct("page_id", "digest")).alias("start")).orderBy("shard").collect()
    ]

    kept = (
        rows.where(F.col("payload_bytes") >= MIN_REVISIT_BYTES).groupBy("digest", "payload_bytes")
        .agg(F.max("page_id").alias("kept"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1 AND kept IS NOT NULL").drop("copies")
    )
    # What is a revisit is decided on ids and digests; a hot digest's rows are split by
    # adaptive execution. Decisions then travel along with the records.
    revisits = rows.drop("html", "url").join(kept, ["digest", "payload_bytes"]).where(
        ~F.col("page_id").eqNullSafe(F.col("kept"))
    ).select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"),
             "digest", "kept").distinct()
    none = F.lit(None)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            out = []
            for page_id, url, html, digest, original in zip(
                *(rows.column(k).to_pylist() for k in range(5))
            ):
                key = NO_ID if page_id is None else page_id
                if html is None:
                    shard = max(0, bisect_right(starts, (key, digest)) - 1)
                    out.append((shard, page_id, None, digest, None, original, None))
                    continue
                payload = html.encode("utf-8", "surrogatepass")
                sha = _sha1(payload)
                shard = max(0, bisect_right(starts, (key, sha.hex())) - 1)
                record = encode_record(page_id, url, payload, sha, len(payload), None)
                out.append((shard, page_id, url, sha.hex(), len(payload), None, _gzip(record)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in out], t) for k, t in enumerate((
                    pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(),
                    pa.binary()))],
                names=["shard", "page_id", "url", "digest", "payload_bytes", "refers_to", "member"],
            )

    manifest = (
        rows.select("page_id", "url", "html", none.cast("string").alias("digest"),
                    none.cast("long").alias("kept"))
        .unionByName(revisits)
        .mapInArrow(encode, "shard int, page_id long, url string, digest string, "
                            "payload_bytes long, refers_to long, member binary")
        .repartitionById(max(1, len(starts)), "shard")  # a task per shard
        .sortWithinPartitions("shard", "page_id", "digest", F.col("member").isNotNull(), "url")
        .mapInArrow(_write(folder, file_bytes), MANIFEST)
    )
    manifest.write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def _members(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The records of a file: its gzip members one by one."""
    data, unzip, parts = stream.read(chunk), zlib.decompressobj(wbits=31), []
    while data:
        parts.append(unzip.decompress(data))
        if unzip.eof:
            yield b"".join(parts)
            data, unzip, parts = unzip.unused_data, zlib.decompressobj(wbits=31), []
            data = data or stream.read(chunk)
        else:
            data = stream.read(chunk)
    if parts and any(parts):
        raise ValueError("the archive ends within a record")


def decode_record(record: bytes) -> tuple[dict[str, str], bytes | None]:
    """Headers and payload (None for a revisit); a damaged block or payload raises."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[:int(headers["Content-Length"])]
    if "sha1:" + base64.b32encode(_sha1(block)).decode() != headers["WARC-Block-Digest"]:
        raise ValueError(f"damaged block of {headers['WARC-Record-ID']}")
    if headers["WARC-Type"] == "revisit":
        return headers, None
    payload = block.partition(b"\r\n\r\n")[2]
    if "sha1:" + base64.b32encode(_sha1(payload)).decode() != headers["WARC-Payload-Digest"]:
        raise ValueError(f"damaged payload of {headers['WARC-Record-ID']}")
    return headers, payload


def read_warc(spark: SparkSession, folder: str, payload: bool = False) -> DataFrame:
    """The records of the committed files; with ``payload`` also their payloads (binary)."""
    from urllib.parse import unquote

    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").select("file")
    names = [c.strip().split(" ")[0] for c in RECORD.split(",")] + ["payload"] * payload
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    types += [pa.binary()] * payload

    def number(headers: dict[str, str], key: str) -> int | None:
        return int(headers[key]) if key in headers else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _store(folder)
        rows, size = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names
            )

        for files in batches:
            for name in files.column("file").to_pylist():
                with store.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for record in _members(stream):
                        h, body = decode_record(record)
                        url = h.get("WARC-Target-URI")
                        digest = base64.b32decode(h["WARC-Payload-Digest"].removeprefix("sha1:"))
                        rows.append((
                            number(h, "X-Page-Id"), url if url is None else unquote(url),
                            h["WARC-Type"], number(h, "X-Payload-Length"), digest.hex(),
                            number(h, "X-Refers-To-Page-Id"), body,
                        ))
                        size += len(body or b"") if payload else 0
                        if len(rows) >= 10_000 or size >= 16 << 20:
                            yield batch()
                            rows, size = [], 0
        if rows:
            yield batch()

    files = manifest.repartition(shuffle_width(spark), "file")
    return files.mapInArrow(read, RECORD + (", payload binary" if payload else ""))

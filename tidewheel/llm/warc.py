"""Operator 8: deterministic WARC archives of web pages, written in shards and read back.

Records are sorted by page id and a hash of the payload, and dealt over tasks by ranges of both of about
``RANGE_BYTES`` of payload. The ranges come from counts of bytes and from keys drawn by a hash of
themselves, so they are the same however the input's files and partitions lie. Each task rolls its file
when its compressed size reaches a limit. Headers, digests and record ids are made from the row alone
and the gzip members carry no time, so the same rows give the same files, byte by byte. Files are
written by attempt-unique temporary names, a manifest (a Parquet table, committed atomically) says which
of them count and what they are to be called, and a second, repeatable step renames them; it fails
where neither a temporary file nor the whole final one is there.

Of records with equal payloads of at least ``least`` bytes the one of the smallest page id is a
response and the others revisit it; smaller ones are all responses. A revisit record keeps the HTTP
header alone, so its Content-Length and both digests still tell of the whole payload.

Null html is an empty payload; a very long one is one record. Many rows of one id are cut apart by their
payloads; those that are repeated as a whole share a task, which streams them. Other columns are ignored,
whatever their names. Of rows repeated with the smallest id each is a response; rows of null
id come first, and revisit the smallest id of their payload, if there is one. A null url becomes a URN
of the id; control characters in it are percent-encoded. An empty table gives an empty manifest.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MOST_TASKS, fresh_path, open_store, range_bounds, shard_of, slices, split_join, stage, table

FILE_BYTES = 64 << 20
LEAST = 0
RANGE_BYTES = 8 << 20
LOWEST = -(1 << 63)
LEVEL = 5
DATE = "2024-01-01T00:00:00Z"
SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:x-page")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "temp string, file string, records long, bytes long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _uri(url: str | None, page_id: int | None) -> str:
    url = url or f"urn:x-page:{page_id}"
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record(page_id: int | None, url: str | None, html: str | None, refers_to: int | None = None, revisit: bool = False) -> bytes:
    """One WARC record, uncompressed."""
    payload = (html or "").encode("utf-8", "surrogatepass")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block, sha = http if revisit else http + payload, digest(payload)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(SPACE, f'{page_id}:{url}:{sha}')}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_uri(url, page_id)}",
        f"WARC-Payload-Digest: sha1:{sha}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if url is None:
        head.append("X-No-Url: 1")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page-Id: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _info(name: str) -> bytes:
    block = b"format: WARC File Format 1.1\r\n"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(SPACE, name)}>\r\nWARC-Date: {DATE}\r\nWARC-Filename: {name}\r\nWARC-Block-Digest: sha1:{digest(block)}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    packed = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packed.compress(data) + packed.flush()


def members(source, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The contents of a file's gzip members, one at a time."""
    data = source.read(chunk)
    while data:
        unzip, parts = zlib.decompressobj(31), []
        while not unzip.eof:
            if not data:
                data = source.read(chunk)
                if not data:
                    raise ValueError("the archive ends within a record")
            parts.append(unzip.decompress(data))
            data = unzip.unused_data
        yield b"".join(parts)
        data = data or source.read(chunk)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, block) of a record, its block digest checked."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if fields["WARC-Block-Digest"] != f"sha1:{digest(block)}":
        raise ValueError(f"{fields['WARC-Record-ID']}: its block digest is wrong")
    return fields, block


def _keyed(pages: DataFrame) -> DataFrame:
    return pages.withColumns({"at": F.coalesce("page_id", F.lit(LOWEST)), "tie": F.xxhash64("html")})


def payloads(pages: DataFrame) -> DataFrame:
    """(page_id, at, tie, sha, bytes) of every page, staged."""
    return stage(_keyed(pages).select("page_id", "at", "tie", F.sha1(F.col("html").cast("binary")).alias("sha"), F.octet_length("html").cast("long").alias("bytes")), "payloads")


def revisits(sums: DataFrame, least: int = LEAST) -> DataFrame:
    """(page_id, at, tie, sha, refers_to) of the pages whose payload a smaller page id has, staged."""
    sums = sums.filter(F.col("bytes") >= least)
    first = sums.groupBy("sha").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1 AND refers_to IS NOT NULL")
    found = split_join(sums, stage(first, "first_payloads"), ["sha"]).filter(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    return stage(found.select("page_id", "at", "tie", "sha", "refers_to").distinct(), "revisits")


def write_archives(pages: DataFrame, out: str, least: int = LEAST, file_bytes: int = FILE_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html) below ``out``; returns the manifest."""
    spark = pages.sparkSession
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    sums = payloads(pages)
    bounds = range_bounds(sums, ["at", "tie"], range_bytes)
    none = F.lit(None).cast("string")
    rows = revisits(sums, least).select("page_id", "at", "tie", F.lit(0).alias("kind"), F.col("sha").alias("url"), none.alias("html"), "refers_to")
    rows = rows.unionByName(_keyed(pages).select("page_id", "at", "tie", F.lit(1).alias("kind"), "url", "html", F.lit(None).cast("long").alias("refers_to")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made, sink, size, records = TaskContext.get().partitionId(), [], None, 0, 0
        store, base = open_store(out)
        at, known = (), {}

        def close():
            sink.close()
            made.append({"temp": temp, "file": name, "records": records, "bytes": size})

        for batch in slices(batches, 256):
            for page_id, tie, kind, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (page_id, tie) != at:
                    at, known = (page_id, tie), {}
                if kind == 0:
                    known[url] = refers_to
                    continue
                target = known.get(hashlib.sha1(html.encode("utf-8", "surrogatepass")).hexdigest()) if known else None
                if sink is None:
                    name, temp = f"part-{part:06d}-{len(made):04d}.warc.gz", f"_temporary/{uuid.uuid4().hex}"
                    store.create_dir(f"{base}/_temporary", recursive=True)
                    sink = store.open_output_stream(f"{base}/{temp}", compression=None)
                    first = _member(_info(name))
                    sink.write(first)
                    size, records = len(first), 0
                packed = _member(record(page_id, url, html, target, target is not None))
                sink.write(packed)
                size, records = size + len(packed), records + 1
                if size >= file_bytes:
                    close()
                    sink = None
        if sink is not None:
            close()
        yield pa.RecordBatch.from_pylist(made, schema=_ARROW_MANIFEST)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = open_store(out)
        for batch in batches:
            for row in batch.to_pylist():
                final, temp = store.get_file_info([f"{base}/archive/{row['file']}", f"{base}/{row['temp']}"])
                if temp.type != fs.FileType.NotFound:
                    store.create_dir(f"{base}/archive", recursive=True)
                    store.move(temp.path, final.path)
                elif final.type == fs.FileType.NotFound or final.size != row["bytes"]:  # else done by an earlier attempt
                    raise OSError(f"{row['file']}: neither the file that was written nor the one it was to be is there")
            yield batch

    dealt = rows.repartitionById(len(bounds) + 1, shard_of(["at", "tie"], bounds)).sortWithinPartitions("at", "tie", "kind", "page_id", "url", "html")
    dealt.select("page_id", "tie", "kind", "url", "html", "refers_to").mapInArrow(run, MANIFEST).write.parquet(f"{out}/_written")
    written = spark.read.schema(MANIFEST).parquet(f"{out}/_written")
    written.repartition(max(1, min(written.count(), MOST_TASKS)), "file").mapInArrow(settle, MANIFEST).write.parquet(f"{out}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{out}/manifest")


_ARROW_MANIFEST = pa.schema([("temp", pa.string()), ("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
_ARROW_RECORDS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def read_archives(spark: SparkSession, out: str) -> DataFrame:
    """A row for each record of the archives that the manifest lists; digests are checked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(out)
        for batch in batches:
            for row in batch.to_pylist():
                rows = []
                with store.open_input_stream(f"{base}/archive/{row['file']}", compression=None) as source:
                    for data in members(source):
                        fields, block = parse(data)
                        if fields["WARC-Type"] == "warcinfo":
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        n = int(http.rsplit(b"Content-Length: ", 1)[1])
                        sha, again = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"] == "revisit"
                        if not again and (digest(payload) != sha or len(payload) != n):
                            raise ValueError(f"{fields['WARC-Record-ID']}: its payload digest is wrong")
                        key, refers = fields.get("X-Page-Id"), fields.get("X-Refers-To-Page-Id")
                        url = None if "X-No-Url" in fields else fields["WARC-Target-URI"]
                        rows.append({"page_id": None if key is None else int(key), "url": url, "payload_bytes": n, "payload_digest": sha, "record_type": fields["WARC-Type"], "refers_to": None if refers is None else int(refers)})
                        if len(rows) == 4096:
                            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW_RECORDS)
                            rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW_RECORDS)

    files = spark.read.schema(MANIFEST).parquet(f"{out}/manifest")
    return files.repartition(max(1, min(files.count(), MOST_TASKS)), "file").mapInArrow(run, RECORDS)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fresh_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), out)
    return read_archives(spark, out).drop("url")


#: DuckDB has no sha1 to base32; hex digits are regrouped by five bits.
SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (
  SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS low FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string([ 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
     1 + CAST(((('0x' || x[1 + 10 * (i // 8) : 10 + 10 * (i // 8)])::BIGINT >> (35 - 5 * (i % 8))) & 31) AS INTEGER)] for i in range(32)], '') AS payload_digest,
  CASE WHEN low < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN low < page_id THEN low END AS refers_to
FROM q
"""

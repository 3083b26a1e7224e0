"""Deterministic sharded WARC writer and reader.

Records are dealt to shards by ranges of the page id. The ranges come from a
histogram of payload bytes over at most ``CELLS`` equal cells of the id range,
so they depend on the data alone. A task sorts its shards, regenerates all
headers, digests and record ids from the row, compresses each record as a gzip
member of its own and rolls to a new file when ``roll_bytes`` compressed bytes
are reached. It writes to temporary names that carry the attempt; the rows it
returns go through Spark's own commit into a manifest, so a lost task or a
second attempt leaves at most unnamed temporary files. A second pass over the
manifest renames the files (again possible after a loss), and the final
manifest is written last; readers open only what it names.

Of records with equal payloads of at least ``revisit_bytes`` bytes the one with
the smallest page id is a response, the others are revisits of it without a
payload. Digests are grouped as (digest, smallest id) by partial aggregation;
payloads are moved once, to their shard.

Defined results: null html is an empty payload; null url gives an empty target;
rows with a null id come first and are never referred to unless all copies
have none (then all are responses); of repeated rows with one id and payload
the first is the response, the others revisit it; an empty table gives an
empty manifest. Other columns are not stored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import scratch

CELLS = 4096
#: Archive bytes (compressed) that a task reads, where there are more files than cores.
READ_BYTES = 64 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "shard int, seq int, temporary string, name string, records bigint, bytes bigint, sha256 string, first_id {id}, last_id {id}"
_BAD = re.compile(r"[\x00-\x20\x7f]")


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else re.sub(r"^file:/*", "file:///", path) if path.startswith("file:") else "file://" + path)


def record_id(page_id, digest: str, ordinal: int = 0) -> str:
    name = hashlib.sha256(f"{page_id}|{digest}|{ordinal}".encode()).digest()
    return f"<urn:uuid:{uuid.UUID(bytes=name[:16])}>"


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to=None, ordinal: int = 0, date: str = "1970-01-01T00:00:00Z",
           revisit: bool = False) -> bytes:
    """One WARC record, headers and digests made from the row."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = _BAD.sub(lambda m: f"%{ord(m[0]):02X}", url or "")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest, ordinal)}",
            f"WARC-Date: {date}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha256:{digest}",
            f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", "Content-Type: application/http; msgtype=response",
            f"Content-Length: {len(block)}"]
    if page_id is not None:
        head.append(f"WARC-Page-ID: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}"]
        if refers_to is not None:
            head.append(f"WARC-Refers-To-Page-ID: {refers_to}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Shard:
    """Writes the files of one shard."""

    def __init__(self, fs, root: str, shard: int, attempt: str, roll_bytes: int, level: int):
        self.fs, self.root, self.shard, self.attempt, self.roll, self.level = fs, root, shard, attempt, roll_bytes, level
        self.seq, self.out, self.done = 0, None, []

    def _open(self) -> None:
        self.name = f"pages-{self.shard:05d}-{self.seq:05d}.warc.gz"
        self.temporary = f"_temporary/{self.attempt}-{self.name}"
        self.out = self.fs.open_output_stream(f"{self.root}/{self.temporary}")
        self.sha, self.size, self.records, self.first = hashlib.sha256(), 0, 0, None
        info = b"software: drapery\r\nformat: WARC File Format 1.1\r\n"
        self._write(b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: " + record_id(self.name, "warcinfo").encode()
                    + b"\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Filename: " + self.name.encode()
                    + b"\r\nContent-Type: application/warc-fields\r\nContent-Length: " + str(len(info)).encode() + b"\r\n\r\n" + info + b"\r\n\r\n")

    def _write(self, data: bytes) -> None:
        c = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        data = c.compress(data) + c.flush()
        self.out.write(data)
        self.sha.update(data)
        self.size += len(data)

    def add(self, page_id, data: bytes) -> None:
        if self.out is None:
            self._open()
        if not self.records:
            self.first = page_id
        self._write(data)
        self.records, self.last = self.records + 1, page_id
        if self.size >= self.roll:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.shard, self.seq, self.temporary, self.name, self.records, self.size, self.sha.hexdigest(), self.first, self.last))
            self.out, self.seq = None, self.seq + 1


def _write_shards(path: str, roll_bytes: int, level: int, schema: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _fs(path)
        context = TaskContext.get()
        attempt = f"{context.partitionId()}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        shard, at_id, refers, seen = None, None, {}, {}
        for batch in batches:
            for r in batch.to_pylist():
                if shard is None or r["shard"] != shard.shard:
                    if shard is not None:
                        shard.close()
                        yield from emit(shard)
                    shard, at_id, refers, seen = _Shard(fs, root, r["shard"], attempt, roll_bytes, level), None, {}, {}
                if r["page_id"] != at_id:
                    at_id, refers, seen = r["page_id"], {}, {}
                if r["kind"] == 0:  # what this id's payloads refer to comes before its pages
                    refers[r["digest"]] = r["refers_to"]
                    continue
                payload, digest = (r["html"] or "").encode("utf-8", "replace"), r["digest"]
                again = seen.get(digest, 0)
                seen[digest] = again + 1
                to = refers.get(digest, at_id)
                revisit = to is not None and r["may_revisit"] and (to != at_id or again > 0)
                shard.add(at_id, record(at_id, r["url"], payload, digest, to, again, revisit=revisit))
        if shard is not None:
            shard.close()
            yield from emit(shard)

    def emit(shard: _Shard) -> Iterator[pa.RecordBatch]:
        if shard.done:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, row)) for row in shard.done], schema=schema)
    return run


def _rename(path: str) -> Callable:
    def run(batches):
        from pyarrow.fs import FileType

        fs, root = _fs(path)
        for batch in batches:
            for r in batch.select(["temporary", "name"]).to_pylist():
                if fs.get_file_info(f"{root}/{r['temporary']}").type != FileType.NotFound:  # else an earlier attempt has moved it
                    fs.move(f"{root}/{r['temporary']}", f"{root}/{r['name']}")
            yield batch
    return run


def write_warc(pages: DataFrame, path: str, revisit_bytes: int = 100, shard_bytes: int = 256 << 20, min_shards: int | None = None,
               roll_bytes: int = 64 << 20, level: int = 3, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write one record per row of ``pages`` under ``path`` (a folder all executors see).

    A shard holds about ``shard_bytes`` of payload; small tables get ``min_shards`` (the session's shuffle
    partitions by default) so that all executors write.
    """
    spark = pages.sparkSession
    fs, root = _fs(path)
    fs.create_dir(f"{root}/_temporary", recursive=True)
    html = F.coalesce(F.col(html_col), F.lit(""))
    p = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), html.alias("html"),
                     F.octet_length(html).cast("long").alias("size"), F.sha2(html.cast("binary"), 256).alias("digest"))
    kind = p.schema["page_id"].dataType.simpleString()
    low, high, total = p.agg(F.min("page_id"), F.max("page_id"), F.coalesce(F.sum("size"), F.lit(0)) + F.count("*") * 512).first()
    low, width = low or 0, max(1, -(-((high or 0) - (low or 0) + 1) // CELLS))
    least = min_shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    target = max(1, min(shard_bytes, -(-total // least)))
    cell = F.coalesce(F.floor((F.col("page_id") - low) / width), F.lit(0)).cast("int")
    cells = p.groupBy(cell.alias("cell")).agg((F.sum("size") + F.count("*") * 512).alias("bytes"))  # at most CELLS rows
    before = F.coalesce(F.sum("bytes").over(W.orderBy("cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shards = F.broadcast(cells.select("cell", F.floor(before / target).cast("int").alias("shard")))
    big = p.select("page_id", "digest", "size").filter(F.col("size") >= revisit_bytes)
    firsts = big.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 AND first IS NOT NULL")
    refers = (big.join(firsts, "digest").filter(~F.col("page_id").eqNullSafe(F.col("first")))
              .groupBy("page_id", "digest").agg(F.first("first").alias("refers_to")))
    none = F.lit(None)
    rows = (p.select("page_id", F.lit(1).alias("kind"), "digest", "url", "html", none.cast(kind).alias("refers_to"),
                     (F.col("size") >= revisit_bytes).alias("may_revisit"))
            .unionByName(refers.select("page_id", F.lit(0).alias("kind"), "digest", none.cast("string").alias("url"),
                                       none.cast("string").alias("html"), "refers_to", F.lit(False).alias("may_revisit"))))
    rows = (rows.withColumn("cell", cell).join(shards, "cell").drop("cell").repartition("shard")
            .sortWithinPartitions("shard", "page_id", "kind", "url", "digest"))
    ddl = MANIFEST.format(id=kind)
    arrow = pa.schema([("shard", pa.int32()), ("seq", pa.int32()), ("temporary", pa.string()), ("name", pa.string()), ("records", pa.int64()),
                       ("bytes", pa.int64()), ("sha256", pa.string()), ("first_id", _arrow_id(kind)), ("last_id", _arrow_id(kind))])
    rows.mapInArrow(_write_shards(path, roll_bytes, level, arrow), ddl).write.parquet(f"{path}/_temporary/manifest")
    written = spark.read.schema(ddl).parquet(f"{path}/_temporary/manifest")
    written.mapInArrow(_rename(path), ddl).drop("temporary").write.parquet(f"{path}/manifest")
    fs.delete_dir(f"{root}/_temporary")  # our own folder: unnamed files of lost attempts


def _arrow_id(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


def _headers(f) -> dict[str, str] | None:
    line = f.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/1."):
        raise ValueError(f"not a WARC record: {line[:40]!r}")
    out = {}
    while (line := f.readline().rstrip(b"\r\n")):
        k, _, v = line.partition(b":")
        out[k.decode().lower()] = v.strip().decode("utf-8", "replace")
    return out


def parse(f) -> Iterator[dict]:
    """The response and revisit records of an archive, checked against their digests."""
    while (h := _headers(f)) is not None:
        block = f.read(int(h["content-length"]))
        f.read(4)
        if h["warc-type"] not in ("response", "revisit"):
            continue
        if hashlib.sha256(block).hexdigest() != h["warc-block-digest"].removeprefix("sha256:"):
            raise ValueError(f"block digest of {h['warc-record-id']}")
        http, _, payload = block.partition(b"\r\n\r\n")
        size = int(re.search(rb"(?mi)^content-length:\s*(\d+)", http)[1])
        digest = h["warc-payload-digest"].removeprefix("sha256:")
        if h["warc-type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
            raise ValueError(f"payload digest of {h['warc-record-id']}")
        yield {"page_id": h.get("warc-page-id"), "url": h["warc-target-uri"], "payload": payload if h["warc-type"] == "response" else None,
               "payload_bytes": size, "payload_digest": digest, "record_type": h["warc-type"], "refers_to": h.get("warc-refers-to-page-id")}


def _read_files(path: str, payloads: bool) -> Callable:
    schema = pa.schema([("page_id", pa.string()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
                        ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string())])

    def run(batches):
        fs, root = _fs(path)
        for batch in batches:
            for entry in batch.to_pylist():
                with fs.open_input_stream(f"{root}/{entry['name']}") as raw, io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 18) as f:
                    rows, size, n = [], 0, 0
                    for r in parse(f):
                        n += 1
                        size += len(r["payload"] or b"")
                        if not payloads:
                            r["payload"] = None
                        rows.append(r)
                        if size > 4 << 20 or len(rows) >= 2000:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                if n != entry["records"]:
                    raise ValueError(f"{entry['name']}: {n} records, the manifest has {entry['records']}")
    return run


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per response or revisit of the archives that the manifest names."""
    files = spark.read.parquet(f"{path}/manifest")
    kind = files.schema["first_id"].dataType.simpleString()
    n, size = files.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    tasks = max(1, min(n, max(-(-size // READ_BYTES), spark.sparkContext.defaultParallelism)))
    files = files.select("name", "records").repartition(tasks, "name")  # a stated number isn't coalesced; a task takes whole files
    out = files.mapInArrow(_read_files(path, payloads), "page_id string, url string, payload binary, payload_bytes bigint, "
                           "payload_digest string, record_type string, refers_to string")
    return out.withColumn("page_id", F.col("page_id").cast(kind)).withColumn("refers_to", F.col("refers_to").cast(kind))


def archive(pages: DataFrame, **kwargs) -> str:
    """Write to a fresh folder in the shared space; returns its path."""
    path = scratch(pages.sparkSession, "warc")
    write_warc(pages, path, **kwargs)
    return path


ORACLE = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT p.page_id, payload_bytes, p.payload_digest, CASE WHEN f.first IS NULL OR f.first = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN f.first <> p.page_id THEN f.first END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest
"""

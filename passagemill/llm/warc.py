"""Deterministic sharded WARC archives: written by shard and key, committed by renaming, listed in a manifest, read back.

Shard bounds are quantiles of the keys, from keys chosen by their hash, so they depend on the rows alone and not on how
Spark has cut them. A shard is one task: it streams its sorted records into gzip members, rolls the file by its compressed
size and regenerates every header and digest. A file is written under a temporary name and renamed when it is whole; a
task that runs again writes the same bytes to the same names. The manifest is written last, and readers open only files
that it lists.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import itertools
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill.llm.tables import apart, hashed_share

SHARD_BYTES = 32 << 20  # payload of a shard, about
ROLL_BYTES = 16 << 20  # compressed size at which a file is closed
REVISIT_BYTES = 1000
KEYS_PER_SHARD = 64
DATE = "1970-01-01T00:00:00Z"


def payloads(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    html = F.coalesce(F.col(html_col), F.lit(""))
    return pages.select(
        F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"),
        F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).cast("bigint").alias("bytes"),
    )


def revisits(records: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """``page_id``, ``digest`` and ``refers_to`` of the records whose payload a larger page id has too.

    Counted before the shuffle: a payload of a third of all pages is one row per task.
    """
    small = records.select("page_id", "digest", "bytes").where((F.col("bytes") >= least))
    keep = small.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.min(F.coalesce("page_id", F.lit(-(1 << 63)))).alias("least"))
    keep = keep.where("least < refers_to").select("digest", "refers_to")
    return small.join(apart(keep, "digest"), "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "digest", "refers_to").distinct()


def shard_bounds(records: DataFrame, shards: int, rows: int) -> list[int]:
    """Page ids that cut the table into ``shards`` of about equal payload."""
    chosen = (
        records.where(F.col("page_id").isNotNull()).where(hashed_share(F.col("page_id"), rows, KEYS_PER_SHARD * shards))
        .groupBy("page_id").agg(F.sum(F.col("bytes") + 500).alias("bytes")).orderBy("page_id").collect()
    )
    whole, done, bounds = sum(row.bytes for row in chosen), 0, []
    for row in chosen:
        if done >= whole * (len(bounds) + 1) / shards and len(bounds) < shards - 1:
            bounds.append(row.page_id)
        done += row.bytes
    return bounds


def shard_of(bounds: list[int], shards: int) -> Column:
    """By range of the page id; records without one are dealt by their digest."""
    place = F.size(F.filter(F.array(*map(F.lit, bounds)).cast("array<bigint>"), lambda bound: bound <= F.col("page_id")))
    return F.when(F.col("page_id").isNull(), F.pmod(F.crc32(F.col("digest").cast("binary")), F.lit(shards))).otherwise(place).cast("int")


def record(page_id: int | None, url: str | None, html: str, digest: str, refers_to: int | None, copy: int) -> bytes:
    payload = html.encode()
    sha = hashlib.sha1(payload)
    if sha.hexdigest() != digest:
        raise ValueError("the payload does not have its digest")
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload if refers_to is None else head

    def name(page: int | None, number: int) -> str:
        return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}/{digest}/{number}')}>"

    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {name(page_id, copy)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url, safe='%/:=&?~#+!$,;@()*[]') if url else f'urn:page:{page_id}'}",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(sha.digest()).decode()}",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: {name(refers_to, 0)}", f"X-Refers-To-Page: {refers_to}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _File:
    """An archive under a temporary name; ``commit`` renames it, replacing what an earlier attempt left."""

    def __init__(self, folder: str, name: str):
        self.fs, base = arrow_fs.FileSystem.from_uri(folder)
        self.name, self.final, self.temporary = name, f"{base}/{name}", f"{base}/_tmp-{uuid.uuid4().hex}-{name}"
        self.stream, self.sha, self.bytes, self.records = self.fs.open_output_stream(self.temporary, compression=None), hashlib.sha1(), 0, 0

    def add(self, member: bytes) -> None:
        self.stream.write(member)
        self.sha.update(member)
        self.bytes += len(member)
        self.records += 1

    def commit(self) -> tuple:
        self.stream.close()
        if self.fs.get_file_info(self.final).type != arrow_fs.FileType.NotFound:
            self.fs.delete_file(self.final)
        self.fs.move(self.temporary, self.final)
        return self.name, self.records, self.bytes, self.sha.hexdigest()


def _writer(folder: str, roll: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 64):
                yield from batch.slice(begin, 64).to_pylist()

    def out(entries: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(column, kind) for column, kind in zip(zip(*entries), (pa.string(), pa.int64(), pa.int64(), pa.string()))],
            ["file", "records", "bytes", "sha1"],
        )

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, members in itertools.groupby(rows(batches), key=lambda row: row["shard"]):
            file, number, same, refers_to, copy = None, 0, None, None, 0
            for row in members:
                if same != (row["page_id"], row["digest"]):
                    same, refers_to, copy = (row["page_id"], row["digest"]), None, 0
                if row["html"] is None:  # the note that comes before a record that is a revisit
                    refers_to = row["refers_to"]
                    continue
                data = record(row["page_id"], row["url"], row["html"], row["digest"], refers_to, copy)
                copy += 1
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = packer.compress(data) + packer.flush()
                if file and file.bytes + len(member) > roll:
                    yield out([file.commit()])
                    file, number = None, number + 1
                file = file or _File(folder, f"shard-{shard:05d}-{number:04d}.warc.gz")
                file.add(member)
            if file:
                yield out([file.commit()])

    return kernel


def write_archives(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, least: int = REVISIT_BYTES,
) -> DataFrame:
    """Writes one record per row into ``folder`` and returns the manifest: ``file``, ``records``, ``bytes``, ``sha1``.

    Of records with equal payloads of at least ``least`` bytes, those with the largest page id are responses and the others
    revisits without the payload; smaller ones are all responses. A null payload is empty; records without a page id are
    written too, and are revisits where an equal payload has an id, else responses. Repeated rows are records of their own.
    An empty table gives an empty manifest; other columns are ignored. A folder that has a manifest is refused.
    """
    spark = pages.sparkSession
    records = payloads(pages, id_col, url_col, html_col)
    size = records.agg(F.count("*").alias("rows"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    shards = max(16, min(1 << 16, -(-size.bytes // shard_bytes)))
    shard = shard_of(shard_bounds(records, shards, size.rows), shards)
    notes = revisits(records, least).select(
        shard.alias("shard"), "page_id", "digest", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "refers_to"
    )
    rows = records.select(shard.alias("shard"), "page_id", "digest", "url", "html", F.lit(None).cast("bigint").alias("refers_to"))
    target = _hadoop(spark, f"{folder}/manifest")
    if target[0].exists(target[1]):
        raise ValueError(f"{folder} has a manifest already")
    target[0].mkdirs(target[1].getParent())
    manifest = (
        rows.unionByName(notes).repartitionById(shards, "shard")
        .sortWithinPartitions("shard", "page_id", "digest", F.col("html").isNotNull(), "url")
        .mapInArrow(_writer(folder, roll_bytes), "file string, records bigint, bytes bigint, sha1 string")
    )
    temporary = _hadoop(spark, f"{folder}/_manifest-{uuid.uuid4().hex}")[1]
    manifest.write.parquet(temporary.toString())
    if not target[0].rename(temporary, target[1]):
        raise OSError(f"the manifest of {folder} could not be committed")
    return spark.read.parquet(f"{folder}/manifest")


def _hadoop(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _headers(stream) -> dict[str, str] | None:
    first = stream.readline()
    if not first:
        return None
    headers = {"": first.decode().strip()}
    for line in iter(stream.readline, b"\r\n"):
        name, _, value = line.decode().partition(":")
        headers[name.strip().lower()] = value.strip()
    return headers


def _records(stream) -> Iterator[tuple]:
    """Of each record: page id, payload bytes, payload digest, type, what it refers to. Digests are recomputed and compared."""
    while (headers := _headers(stream)) is not None:
        block = stream.read(int(headers["content-length"]))
        stream.read(4)
        if base64.b32encode(hashlib.sha1(block).digest()).decode() != headers["warc-block-digest"].removeprefix("sha1:"):
            raise ValueError("a block does not have its digest")
        head, _, payload = block.partition(b"\r\n\r\n")
        declared = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:")).hex()
        size = int(next(line for line in head.split(b"\r\n") if line.lower().startswith(b"content-length:")).split(b":")[1])
        if headers["warc-type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != declared):
            raise ValueError("a payload does not have its digest")
        page, refers = headers.get("x-page-id"), headers.get("x-refers-to-page")
        yield page and int(page), size, declared, headers["warc-type"], refers and int(refers)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of the files in the manifest: ``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``."""
    files = spark.read.parquet(f"{folder}/manifest").select("file")
    kinds = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = arrow_fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                with store.open_input_stream(f"{base}/{name}", compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    found = _records(stream)
                    while some := list(itertools.islice(found, 1000)):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(column, kind) for column, (_, kind) in zip(zip(*some), kinds)], [name for name, _ in kinds]
                        )

    count = max(1, files.count())
    return files.repartition(min(count, 4096), "file").mapInArrow(
        kernel, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    )

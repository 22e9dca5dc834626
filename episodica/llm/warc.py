"""WARC archives: a deterministic sharded writer and a reader."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episodica.llm.common import Scratch, mapped

#: Slices of the id range from which shard borders are chosen; their counts are all that reaches the driver.
SLICES = 1 << 14
#: Files are read by so many tasks at most, each of which reads its own one after another.
MOST_READERS = 100_000
RECORD_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL name space of RFC 4122
MANIFEST = "file string, bytes long, records long, sha256 string, temporary string"


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI, as a worker opens it."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(RECORD_SPACE, f'{page}/{digest}')}>"


def member(page: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One gzip member that holds the record of a page; every header follows from the row alone."""
    digest = digest32(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    headers = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page, digest)}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{digest32(block)}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url:
        headers.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if page is not None:
        headers.append(f"X-Page-ID: {page}")
    if refers_to is not None:
        headers += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_id(refers_to, digest)}",
            f"X-Refers-To-Page: {refers_to}",
        ]
    return gzip.compress("\r\n".join(headers).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def shard_slices(pages: DataFrame, id_col: str, rows_per_shard: int | None) -> tuple[int, int, list[tuple[int, int]]]:
    """Low end and width of the id slices, and (slice, shard): from exact counts, so the same rows give the same shards.

    By default shards are a quarter of a shuffle partition's share of the rows, 500 to 50,000 each.
    """
    low, high, n = pages.agg(F.min(id_col), F.max(id_col), F.count(id_col)).first()
    if not n:
        return 0, 1, []
    if rows_per_shard is None:
        rows_per_shard = min(50_000, max(500, n // (4 * int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    width = (high - low) // SLICES + 1
    counts = pages.where(F.col(id_col).isNotNull()).groupBy(F.floor((F.col(id_col) - low) / width).alias("slice")).agg(F.count("*").alias("n")).collect()
    slices, shard, held = [], 0, 0
    for row in sorted(counts, key=lambda r: r["slice"]):
        if held >= rows_per_shard:
            shard, held = shard + 1, 0
        slices.append((row["slice"], shard))
        held += row["n"]
    return low, width, slices


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url: str = "url", html: str = "html", roll_bytes: int = 32 << 20, rows_per_shard: int | None = None, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes a record per row under folder and returns the manifest, also kept as folder/manifest.

    Of rows whose payloads are equal and at least least_bytes long, the one with the largest id is a response and the others are revisits that refer to it.
    Null html is an empty payload, a null url has no target header, a null id comes first and is always a response. Rows that repeat an id are
    records of their own, each judged by its own payload. Rows are
    sorted by id within shards of an id range; a shard's file is closed once it holds roll_bytes of compressed records, so a shard of any
    size needs the memory of one record. Equal rows in give equal bytes out. Files are written under temporary names that name the attempt, renamed once all
    tasks have ended, and count only when the manifest lists them; a lost executor leaves at most unlisted files. Extra columns are not archived.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url).alias("url"), payload.alias("payload"))
    digests = scratch.write(rows.select("page", F.unhex(F.sha1("payload")).alias("digest"), F.length("payload").alias("size")), "digests")
    groups = digests.where(f"page IS NOT NULL AND size >= {least_bytes}").groupBy("digest").agg(F.max("page").alias("largest"), F.count("*").alias("n")).where("n > 1")
    groups = scratch.write(groups.select("digest", "largest"), "groups")
    revisits = digests.join(groups, "digest").where("page < largest").select("page", "digest", F.col("largest").alias("refers_to")).distinct()
    revisits = scratch.write(revisits, "revisits")
    low, width, slices = shard_slices(digests, "page", rows_per_shard)
    shards = spark.createDataFrame(slices, "slice long, shard int")  # at most SLICES rows, so it may be broadcast
    rows = rows.withColumn("slice", F.floor((F.col("page") - low) / width)).join(F.broadcast(shards), "slice", "left")
    rows = rows.withColumn("shard", F.coalesce("shard", F.lit(0))).withColumn("digest", F.unhex(F.sha1("payload")))
    rows = rows.join(revisits, ["page", "digest"], "left")  # by both, as rows that repeat an id may differ in payload
    n_shards = slices[-1][1] + 1 if slices else 1
    sorted_rows = rows.repartition(n_shards, "shard").sortWithinPartitions("shard", F.asc_nulls_first("page"), "url", "payload").select("shard", "page", "url", "payload", "refers_to")
    temporary = f"{folder}/_temporary"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, place = open_store(temporary)
        store.create_dir(place, recursive=True)
        attempt = f"{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        done, current, part, out = [], None, 0, None
        size = count = 0
        check = hashlib.sha256()

        def close() -> None:
            nonlocal out, size, count, check, part
            if out is not None:
                out.close()
                done.append((f"part-{current:06d}-{part:05d}.warc.gz", size, count, check.hexdigest(), name))
                out, size, count, check, part = None, 0, 0, hashlib.sha256(), part + 1

        name = ""
        for batch in batches:
            for shard_, page, address, body, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard_ != current:
                    close()
                    current, part = shard_, 0
                data = member(page, address, body, refers, date)
                if out is None:
                    name = f"{current:06d}-{part:05d}-{attempt}"
                    out = store.open_output_stream(f"{place}/{name}", compression=None)
                out.write(data)
                check.update(data)
                size, count = size + len(data), count + 1
                if size >= roll_bytes:
                    close()
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["file", "bytes", "records", "sha256", "temporary"])

    written = scratch.write(mapped(sorted_rows, write, MANIFEST), "written")

    def publish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, place = open_store(folder)
        for batch in batches:
            for row in batch.to_pylist():
                old, new = f"{place}/_temporary/{row['temporary']}", f"{place}/{row['file']}"
                if store.get_file_info(old).type != pafs.FileType.NotFound:  # else an earlier attempt has renamed it
                    store.move(old, new)
            yield batch

    mapped(written, publish, MANIFEST).drop("temporary").write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def parse_members(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a .warc.gz stream, one record in memory at a time."""
    pending = b""
    while True:
        inflate, text = zlib.decompressobj(31), io.BytesIO()
        while not inflate.eof:
            data = pending or stream.read(1 << 20)
            pending = b""
            if not data:
                if text.tell():
                    raise EOFError("the archive ends within a record")
                return
            text.write(inflate.decompress(data))
        pending = inflate.unused_data
        head, _, rest = text.getvalue().partition(b"\r\n\r\n")
        headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        yield headers, rest[: int(headers["Content-Length"])]


def read_warc(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url[, payload]) of every record of the files that the manifest lists.

    Block digests are checked, and of responses the payload's digest and length too; a revisit has its payload's from
    its headers. Each file is read by one task. Records come as they were written, repeated ones too; a manifest without files gives no rows.
    """
    files = spark.read.parquet(f"{folder}/manifest").select("file")
    fields = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string" + ", payload binary" * payloads

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, place = open_store(folder)
        names = [f.split()[0] for f in fields.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()][: len(names)]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open_input_stream(f"{place}/{name}", compression=None) as stream:
                    rows = []
                    for h, block in parse_members(stream):
                        if h["WARC-Block-Digest"] != f"sha1:{digest32(block)}":
                            raise ValueError(f"damaged record {h['WARC-Record-ID']} in {name}")
                        body = block.partition(b"\r\n\r\n")[2]
                        digest, size = h["WARC-Payload-Digest"].removeprefix("sha1:"), int(h["X-Payload-Length"])
                        if h["WARC-Type"] == "response" and (digest32(body) != digest or len(body) != size):
                            raise ValueError(f"damaged payload in {name}")
                        page, refers = h.get("X-Page-ID"), h.get("X-Refers-To-Page")
                        row = (page and int(page), size, digest, h["WARC-Type"], refers and int(refers), h.get("WARC-Target-URI"))
                        rows.append((*row, body) if payloads else row)
                        if len(rows) == 512:
                            yield batch_of(rows)
                            rows = []
                    if rows:
                        yield batch_of(rows)

    # the number is given, so that a few bytes of names are not taken for one task's work
    return mapped(files.repartition(max(1, min(files.count(), MOST_READERS)), "file"), read, fields)

"""WARC archives compressed record by record with a Zstandard dictionary in a leading skippable frame."""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.llm.common import new_folder, ship, stored
from quadloom.llm.lsm_dedup import spread_join

#: Fixed values of the formats: magic of the skippable frame for dictionaries, profile of revisits.
DICT_MAGIC = 0x184D2A5D
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMES = uuid.UUID("5b2f3f0e-6d0c-4a39-9c0e-0d6f0f5f9a11")


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMES, str(page_id))}>"


def make_record(page_id, url: str | None, payload: bytes, digest: str, size: int, refers_to) -> bytes:
    """One record. A revisit has the HTTP header of the full payload, but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Identified-Payload-Name: {'' if page_id is None else page_id}", f"WARC-Payload-Digest: sha256:{digest}"]
    if url:
        head.append("WARC-Target-URI: " + quote(url, safe=":/?#[]@!$&'()*+,;=%~-._", errors="replace"))
    if revisit:
        head += [f"WARC-Profile: {SAME_PAYLOAD}", f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Refers-To-Name: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train(records: list[bytes], dict_bytes: int = 65_536, sample_bytes: int = 4 << 20) -> bytes:
    """A dictionary from whole records, evenly spaced, whose bytes sum to sample_bytes at most.

    Where they are too few or too alike for training, the dictionary is their raw content, so an archive of any record
    has one.
    """
    sizes = list(map(len, records))
    step = max(1, sum(sizes) // sample_bytes)
    sample, held = [], 0
    for start in range(step):
        for r in records[start::step]:
            if held + len(r) <= sample_bytes:
                sample.append(r)
                held += len(r)
        if 2 * held > sample_bytes:
            break
    try:
        return zstandard.train_dictionary(min(dict_bytes, max(256, held // 8)), sample).as_bytes()
    except zstandard.ZstdError:
        share = max(1, dict_bytes // max(1, len(records)))
        return b"".join(r[:share] for r in (sample or records))[:dict_bytes]


def write_archive(records: list[bytes], out, level: int = 6) -> None:
    """Skippable frame with the dictionary, then a frame for each record."""
    made = train(records)
    out.write(struct.pack("<II", DICT_MAGIC, len(made)) + made)
    packer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(made), write_checksum=True)
    for r in records:
        out.write(packer.compress(r))


def read_archive(data, step: int = 16_384) -> Iterator[bytes]:
    """The records of an archive, a file-like object or bytes, one after another; `step` bytes are looked at at a time."""
    data = data if isinstance(data, bytes) else data.read()
    made, at = None, 0
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICT_MAGIC:
        n = struct.unpack_from("<I", data, 4)[0]
        made, at = zstandard.ZstdCompressionDict(data[8 : 8 + n]), 8 + n
    view, unpacker = memoryview(data), zstandard.ZstdDecompressor(dict_data=made)
    while at < len(data):
        one, parts = unpacker.decompressobj(), []
        while not one.eof:
            if at >= len(data):
                raise ValueError("the archive ends within a record")
            piece = view[at : at + step]
            parts.append(one.decompress(piece))
            at += len(piece)
        at -= len(one.unused_data)
        yield b"".join(parts)


def parse_record(record: bytes) -> dict:
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    return {"fields": fields, "payload": payload, "size": size}


def open_shared(uri: str):
    """(file system, path) of a folder or file; the schemes that only Hadoop knows for S3 are read as s3."""
    from pyarrow import fs

    scheme, mark, rest = uri.partition("://")
    return fs.FileSystem.from_uri(f"s3://{rest}" if mark and scheme in ("s3a", "s3n") else uri)


def decide(pages: DataFrame, min_bytes: int = 100) -> DataFrame:
    """pages with payload_bytes, payload_digest and refers_to: of equal payloads of min_bytes or more, the smallest page_id."""
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha2("payload", 256))
    key = F.when(F.col("payload_bytes") >= min_bytes, F.unhex("payload_digest"))
    groups = rows.select(key.alias("key"), "page_id").where("key is not null").groupBy("key").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    groups = stored(groups.where("n > 1"), "warc-groups")
    total = groups.agg(F.sum("n")).first()[0] or 0
    met = spread_join(rows.withColumn("key", key), groups, "key", "n", total, F.xxhash64("page_id", "payload_digest"))
    other = F.coalesce(F.col("page_id") != F.col("first_id"), F.col("page_id").isNull())
    return met.withColumn("refers_to", F.when(other, F.col("first_id"))).drop("key", "first_id", "n")


def write_archives(decided: DataFrame, folder: str, archive_bytes: int = 16 << 20) -> DataFrame:
    """Each task writes its rows to archives of about archive_bytes before compression and returns (archive, records).

    A file's name has the task's attempt, so attempts never write the same file; the manifest, which has the rows of the
    attempts that Spark counts, alone says which archives exist.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        store, base = open_shared(folder)
        store.create_dir(base, recursive=True)
        held, size, number = [], 0, 0

        def flush() -> pd.DataFrame:
            name = f"part-{part:06d}-{number:06d}-{attempt}.warc.zst"
            with store.open_output_stream(f"{base}/{name}", compression=None) as out:
                write_archive(held, out)
            return pd.DataFrame({"archive": [f"{folder}/{name}"], "records": [len(held)]})

        for batch in batches:
            for page, url, payload, n, digest, ref in zip(batch.page_id, batch.url, batch.payload, batch.payload_bytes, batch.payload_digest, batch.refers_to, strict=True):
                r = make_record(None if pd.isna(page) else int(page), url, payload, digest, int(n), None if pd.isna(ref) else int(ref))
                held.append(r)
                size += len(r)
                if size >= archive_bytes:
                    yield flush()
                    held, size, number = [], 0, number + 1
        if held:
            yield flush()

    ship(decided.sparkSession)
    # A revisit needs no payload: only its digest and length are written.
    rows = decided.withColumn("payload", F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise(F.lit(b"")))
    return stored(rows.mapInPandas(write, "archive string, records long"), "warc-manifest")


def read_archives(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """The archives' records: page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to.

    A response's length and digest are made from the payload that was read, and a digest unlike the header's is an error.
    """

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name in batch.archive:
                store, path = open_shared(name)
                with store.open_input_stream(path, compression=None) as f:
                    data = f.read()
                rows: list[tuple] = []
                held = 0
                for record in read_archive(data):
                    x = parse_record(record)
                    h = x["fields"]
                    digest, kind = h["WARC-Payload-Digest"].removeprefix("sha256:"), h["WARC-Type"]
                    if kind == "response" and (digest != hashlib.sha256(x["payload"]).hexdigest() or x["size"] != len(x["payload"])):
                        raise ValueError(f"payload of {h['WARC-Record-ID']} in {name} isn't what was written")
                    page, ref = h["WARC-Identified-Payload-Name"], h.get("WARC-Refers-To-Name")
                    rows.append((int(page) if page else None, h.get("WARC-Target-URI"), x["payload"] if kind == "response" else None, x["size"], digest, kind, int(ref) if ref else None))
                    held += len(x["payload"])
                    if held > 8 << 20:
                        yield frame(rows)
                        rows, held = [], 0
                yield frame(rows)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"])
        return out.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64"})

    ship(spark)
    n = max(1, manifest.count())
    return manifest.repartitionByRange(min(n, 10_000), "archive").mapInPandas(load, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_pages(pages: DataFrame, min_bytes: int = 100, folder: str | None = None) -> DataFrame:
    """Writes a record per row of pages, reads the archives back and returns what read_archives does, without texts.

    Null html is an empty payload; payloads below min_bytes are always responses. Repeated rows get a record each: those
    with the smallest id of their payload are responses. A row without an id refers to the smallest id of its payload;
    if none has an id, all are responses. An empty table gives no archives and no rows. Other columns are ignored.
    """
    spark = pages.sparkSession
    made = write_archives(decide(pages, min_bytes), folder or new_folder(spark, "warc"))
    return read_archives(spark, made).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


__all__ = ["archive_pages", "decide", "make_record", "parse_record", "read_archive", "read_archives", "train", "write_archive", "write_archives"]

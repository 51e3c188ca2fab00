"""WARC archives compressed record by record with a dictionary of their own."""

from __future__ import annotations

import base64
import hashlib
import struct

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackloom.llm._storage import settle, shared_folder

#: Skippable frame that holds the dictionary, as first in an archive, and an empty one, as last.
_DICTIONARY_MAGIC = struct.pack("<I", 0x184D2A5D)
_EMPTY_FRAME = struct.pack("<II", 0x184D2A50, 0).decode("ascii")


def _record(page: dict) -> bytes:
    digest = "sha1:" + base64.b32encode(bytes.fromhex(page["payload_digest"])).decode()
    name = f"{'null' if page['page_id'] is None else page['page_id']}:{page['place']}"
    head = [
        "WARC/1.1", f"WARC-Type: {page['record_type']}", f"WARC-Record-ID: <urn:x-page:{name}>", "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Payload-Digest: {digest}", f"X-Payload-Length: {page['payload_bytes']}",
    ]
    if page["url"]:
        head.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in page["url"]))
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if page["record_type"] == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:x-page:{page['refers_to']}:{page['refers_place']}>"]
        block = f"{http}\r\n".encode()
    else:
        block = f"{http}Content-Length: {page['payload_bytes']}\r\n\r\n".encode() + (page["html"] or "").encode()
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def build_archive(records: list[bytes], dictionary_bytes: int = 64 << 10, level: int = 3) -> bytes:
    """One archive: a skippable frame with a dictionary built from ``records``, then one frame a record.

    Where the records are too few or too short to build one, their beginning serves as the dictionary.
    """
    samples = [r[: 32 << 10] for r in records]
    try:
        dictionary = zstandard.train_dictionary(dictionary_bytes, samples[:: max(1, len(samples) // 2000)], level=level)
    except zstandard.ZstdError:
        dictionary = zstandard.ZstdCompressionDict(b"".join(samples)[:dictionary_bytes] or b"WARC/1.1", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    raw = dictionary.as_bytes()
    compressor = zstandard.ZstdCompressor(level=level, dict_data=dictionary, write_checksum=True)
    return b"".join([_DICTIONARY_MAGIC, struct.pack("<I", len(raw)), raw, *[compressor.compress(r) for r in records]])


def read_archive(data: bytes):
    """The records of an archive, one after another."""
    if data[:4] != _DICTIONARY_MAGIC:
        raise ValueError("the archive does not begin with a dictionary frame")
    at = 8 + struct.unpack("<I", data[4:8])[0]
    raw = data[8:at]
    kind = zstandard.DICT_TYPE_FULLDICT if raw[:4] == struct.pack("<I", 0xEC30A437) else zstandard.DICT_TYPE_RAWCONTENT
    decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=kind))
    view = memoryview(data)
    while at < len(data):
        if 0x184D2A50 <= struct.unpack("<I", data[at : at + 4])[0] <= 0x184D2A5F:
            at += 8 + struct.unpack("<I", data[at + 4 : at + 8])[0]
            continue
        reader = decompressor.decompressobj()
        record = reader.decompress(view[at:])
        at = len(data) - len(reader.unused_data)
        yield record


def parse_record(record: bytes) -> dict:
    """Fields of one record; a response's payload is measured and digested again, a revisit's are its headers'."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    digest = base64.b32decode(fields["WARC-Payload-Digest"].split(":")[1]).hex()
    size, payload = int(fields["X-Payload-Length"]), None
    if fields["WARC-Type"] == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if len(payload) != size or hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"damaged record {fields['WARC-Record-ID']}")

    def page(value: str | None) -> int | None:
        value = value and value.removeprefix("<urn:x-page:").partition(":")[0]
        return None if value in (None, "null") else int(value)

    return {"page_id": page(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": page(fields.get("WARC-Refers-To")), "payload": payload}


def _decided(pages: DataFrame, least_bytes: int) -> DataFrame:
    """Each page with the record it becomes. Its place among the rows tells its record from those of the same page_id."""
    page = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"), F.monotonically_increasing_id().alias("place"))
    page = page.withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn("payload_digest", F.sha1(F.col("html").cast("binary")))
    long = page.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(F.max(F.struct("page_id", "place")).alias("last"), F.count("*").alias("copies"))
    repeated = settle(long.where("copies > 1 and last.page_id is not null").select("payload_digest", F.col("last.page_id").alias("first"), F.col("last.place").alias("first_place")), "payloads")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    joined = page.join(repeated, "payload_digest", "left")  # small by its written size: broadcast; else sorted, skewed digests split
    return joined.select("page_id", "place", F.when(revisit, F.col("first_place")).alias("refers_place"), "url", "html", "payload_bytes", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"))


def write_warc(pages: DataFrame, path: str, least_bytes: int = 1000, archive_bytes: int = 16 << 20) -> None:
    """Archive ``pages(page_id, url, html)`` below ``path``, a record a row, archives of about ``archive_bytes`` payload.

    Of rows with equal payloads of at least ``least_bytes`` bytes, those with the largest page_id
    are response records and the others revisit it; shorter ones are all responses. A null html
    is an empty payload, a null url no target; a null page_id never is the one revisited, and
    where all of equal payload are null, all are responses; repeated rows that tie for the largest
    page_id are all responses; other columns are not read. Record ids are page_id and the row's place, so
    rows that repeat have ids of their own; a revisit refers to the id of one response.

    Each archive is one row for Spark's text sink, so its commit protocol decides which files
    count; the separator that the sink appends is an empty skippable frame, which readers skip.
    """

    def run(batches):
        records, size = [], 0
        for batch in batches:
            for page in batch.to_pylist():
                records.append(_record(page))
                size += len(records[-1])
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([build_archive(records)], pa.binary())], ["value"])
                    records, size = [], 0
        if records:
            yield pa.RecordBatch.from_arrays([pa.array([build_archive(records)], pa.binary())], ["value"])

    archives = _decided(pages, least_bytes).mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    archives.write.option("lineSep", _EMPTY_FRAME).option("maxRecordsPerFile", 1).text(path)


_FIELDS = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()),
    T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType()), T.StructField("payload", T.BinaryType()),
])


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record of the archives below ``path``; payload is null for revisits."""
    schema = _FIELDS if with_payload else T.StructType(_FIELDS[:-1].fields)
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def run(batches):
        for batch in batches:
            for data in batch.column("content"):
                rows, size = [], 0
                for record in read_archive(data.as_py()):
                    rows.append(parse_record(record))
                    size += len(record) if with_payload else 200
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], t) for f, t in zip(schema, types, strict=False)], schema.names)
                        rows, size = [], 0
                yield pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], t) for f, t in zip(schema, types, strict=False)], schema.names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read the records' fields back."""
    spark = pages.sparkSession
    path = shared_folder(spark, "warc")
    write_warc(pages, path)
    return read_warc(spark, path, with_payload=False)

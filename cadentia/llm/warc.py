"""WARC archives of Zstandard frames: one frame per record after a leading dictionary frame.

The archives are written and read through Spark's own file sources, so any store that Spark reaches will do.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import struct

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh_path, own_ids

#: Magic of the skippable frame that holds the dictionary, and of the empty one that ends an archive.
DICTIONARY_MAGIC = 0x184D2A5D
#: Line separator of the text sink: eight bytes that are an empty skippable frame.
EMPTY_FRAME = "P*M\x18\0\0\0\0"
#: Bytes of records that one archive holds at most (one longer record gets an archive of its own).
ARCHIVE_BYTES = 8 << 20
DICTIONARY_BYTES, DICTIONARY_SAMPLES = 16 << 10, 200


class WarcError(ValueError):
    """An archive or a record that breaks the format."""


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | str, url: str, payload: bytes, refers_to: int | str | None) -> bytes:
    """A response record, or a revisit record without the payload if refers_to is given.

    Pages are named by their ids, or by id:row where ids are null (then empty) or repeat.
    """
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {url}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def archive(records: list[bytes]) -> bytes:
    """Zstandard frames of the records behind a skippable frame with their dictionary.

    The dictionary is trained on a sample of the records; where they are too few or too alike to learn from it is the beginning
    of the first one, as raw content.
    """
    trained = records[0][:DICTIONARY_BYTES] if records else b""
    if len(records) >= 16:
        step = max(1, len(records) // DICTIONARY_SAMPLES)
        with contextlib.suppress(zstandard.ZstdError):
            trained = zstandard.train_dictionary(DICTIONARY_BYTES, [r[:32768] for r in records[::step]], k=64, d=8).as_bytes()
    shared = zstandard.ZstdCompressionDict(trained) if trained else None
    pack = zstandard.ZstdCompressor(level=3, dict_data=shared, write_checksum=True, write_content_size=True)
    packed = zstandard.ZstdCompressor(level=3).compress(trained)
    return b"".join([struct.pack("<II", DICTIONARY_MAGIC, len(packed)), packed, *map(pack.compress, records)])


def _frame_end(data: bytes, at: int) -> int:
    """Where the Zstandard frame at a place ends, by the sizes of its blocks."""
    kind = zstandard.get_frame_parameters(data[at : at + 18])
    pos, last = at + zstandard.frame_header_size(data[at : at + 18]), False
    while not last:
        if pos + 3 > len(data):
            raise WarcError("a frame is cut off")
        block = int.from_bytes(data[pos : pos + 3], "little")
        last = bool(block & 1)
        pos += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)  # a run-length block holds one byte
    pos += 4 * kind.has_checksum
    if pos > len(data):
        raise WarcError("a frame is cut off")
    return pos


def frames(data: bytes):
    """The record of each frame of an archive."""
    if len(data) < 8 or struct.unpack_from("<I", data)[0] != DICTIONARY_MAGIC:
        raise WarcError("no dictionary frame leads the archive")
    size = struct.unpack_from("<I", data, 4)[0]
    if 8 + size > len(data):
        raise WarcError("the dictionary frame is cut off")
    try:
        trained = zstandard.ZstdDecompressor().decompress(data[8 : 8 + size])
        shared = zstandard.ZstdCompressionDict(trained) if trained else None
        unpack = zstandard.ZstdDecompressor(dict_data=shared)
        at = 8 + size
        while at < len(data):
            if len(data) - at >= 8 and 0x184D2A50 <= struct.unpack_from("<I", data, at)[0] <= 0x184D2A5F:
                at += 8 + struct.unpack_from("<I", data, at + 4)[0]
                if at > len(data):
                    raise WarcError("a skippable frame is cut off")
                continue
            end = _frame_end(data, at)
            one = unpack.decompressobj()
            out = one.decompress(data[at:end])
            if not one.eof:
                raise WarcError("a frame is cut off")
            at = end
            yield out
    except zstandard.ZstdError as e:
        raise WarcError(f"not a Zstandard archive: {e}") from e


def _fields(lines: list[bytes]) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or not name or name != name.strip():
            raise WarcError(f"bad header line {line[:80]!r}")
        if (key := name.decode("ascii", "replace").lower()) in out:
            raise WarcError(f"header {key} is repeated")
        out[key] = value.strip().decode()
    return out


def parse(data: bytes) -> dict:
    """A record's fields, with its version, required headers, lengths and digests validated."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise WarcError("no WARC version line")
    h = _fields(lines[1:])
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in h:
            raise WarcError(f"header {name} is missing")
    if not h["content-length"].isdigit() or len(rest) != (n := int(h["content-length"])) + 4 or rest[n:] != b"\r\n\r\n":
        raise WarcError("Content-Length does not match the block")
    block = rest[:n]
    if h.get("warc-block-digest", "").removeprefix("sha1:") not in ("", base32_sha1(block)):
        raise WarcError("the block digest does not match")
    http, gap, payload = block.partition(b"\r\n\r\n")
    if not gap or not http.startswith(b"HTTP/1."):
        raise WarcError("no HTTP head")
    size = _fields(http.split(b"\r\n")[1:]).get("content-length", "")
    if not size.isdigit():
        raise WarcError("no HTTP Content-Length")
    digest = h.get("warc-payload-digest", "").removeprefix("sha1:")
    if h["warc-type"] == "response":
        if len(payload) != int(size) or digest != base32_sha1(payload):
            raise WarcError("the payload does not match its length or digest")
    elif h["warc-type"] == "revisit":
        if payload or "warc-refers-to" not in h or len(digest) != 32:
            raise WarcError("a revisit needs an empty payload, a digest and a target")

    def number(name: str) -> int | None:
        own = name.removeprefix("<urn:page:").removesuffix(">").partition(":")[0]
        return int(own) if own else None

    return {
        "page_id": number(h["warc-record-id"]),
        "url": h.get("warc-target-uri", ""),
        "payload": payload,
        "payload_bytes": int(size),
        "payload_digest": digest,
        "record_type": h["warc-type"],
        "refers_to": number(h["warc-refers-to"]) if "warc-refers-to" in h else None,
    }


def revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(row, refers_to: row, refers_page) of the rows of pages(row, page_id, html) whose payload, of at least least_bytes, an earlier row has.

    Digests aggregate before any join, which carries only ids and digests.
    """
    light = cut(
        pages.select("row", "page_id", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("b"))
        .where(F.octet_length("b") >= least_bytes)
        .select("row", "page_id", F.unhex(F.sha1("b")).alias("digest")),
        "digests",
    )
    first = light.groupBy("digest").agg(F.min(F.struct("row", "page_id")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return light.join(first, "digest").where("not (page_id <=> first.page_id)").select("row", F.col("first.row").alias("refers_to"), F.col("first.page_id").alias("refers_page"))


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Write pages(page_id, url, html) as archives of bounded size under path; null html is empty.

    Every archive is one row of the text sink with a file of its own; its line separator is an
    empty skippable frame, so the file is a valid Zstandard stream to its last byte.
    Control characters in a url are percent-encoded. Every row is a page of its own, also where its page_id is null or
    repeats: of equal payloads the row with the smallest page_id (nulls last) is the response, and so is each of several such rows.
    An empty table gives no archive.
    """
    picked = pages.select("page_id", F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    picked, plain = own_ids(picked, "page_id", "row", [F.xxhash64("url", "html")])
    name = lambda page, row: F.col(page).cast("string") if plain else F.concat(F.coalesce(F.col(page).cast("string"), F.lit("")), F.lit(":"), F.col(row).cast("string"))
    both = picked.join(revisits(picked, least_bytes), "row", "left").select(
        name("page_id", "row").alias("page"), "url", "html", F.when(F.col("refers_to").isNotNull(), name("refers_page", "refers_to")).alias("first")
    )

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for page, url, html, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                url = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)
                one = record(page, url, html.encode(), first)
                if held and size + len(one) > ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([archive(held)], pa.binary())], ["archive"])
                    held, size = [], 0
                held.append(one)
                size += len(one)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([archive(held)], pa.binary())], ["archive"])

    made = both.mapInArrow(run, "archive binary")
    made.select(F.col("archive").cast("string").alias("value")).write.option("lineSep", EMPTY_FRAME).option("maxRecordsPerFile", 1).option("compression", "none").text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives under path: page_id, url, payload, payload_bytes, payload_digest,
    record_type, refers_to. A broken frame, header, length or digest raises WarcError."""

    def run(batches):
        names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            for data in batch.column(0):
                rows = [parse(x) for x in frames(data.as_py())]
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame) -> DataFrame:
    """pages written as archives to the shared folder and read back."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_archives(pages, path)
    return read_archives(spark, path)

"""Operator 6 - WARC records in seekable Zstandard bundles.

Each task writes its records to bundles of its own: records are gathered into independent
Zstandard frames of about ``frame_bytes``, a bundle ends after ``bundle_bytes`` with a seek
table in a skippable frame (the published seekable format), and an index row maps every record
to bundle, frame and the offset inside the frame. A reader takes a frame's place from the bundle's
seek table and reads that one frame.

Which pages revisit others is decided on ids and digests alone; payloads meet that decision by page
and digest, so a large group of equal pages is no group of payloads in any task.

Records with equal payloads of at least ``least`` bytes are written once: the smallest page id
holds the response, the others are revisits that refer to it. Bundles have unique names, and
the index names only those of tasks that ended well, so a repeated task leaves no wrong rows.

Defined cases: a null payload is empty; a null id is never the one that others refer to unless
all ids of a group are null, and then all are responses; rows that repeat the smallest id of a
group are responses too. Line breaks in addresses are escaped. Very long payloads are records of
their own frame. A batch of pages is bounded by ``spark.sql.execution.arrow.maxBytesPerBatch`` and
``maxRecordsPerBatch``; lower them for pages of many megabytes. Empty tables write no bundle; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import itertools
import struct
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.staging import scratch, stage

#: Fixed values of the seekable format: skippable frame, end of the seek table.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
INDEX = "page_id string, bundle string, frame int, frame_at long, frame_size long, record_at long, record_size long"


def record(page_id: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None, revisit: bool, date: str) -> bytes:
    """One record with its closing line breaks."""
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {date}",
        f"WARC-Target-URI: {(url or '').replace(chr(13), '%0D').replace(chr(10), '%0A')}", f"WARC-Payload-Digest: sha256:{digest}",
    ]
    http = b""
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
    else:
        head.append("Content-Type: application/http; msgtype=response")
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head.append(f"Content-Length: {len(http) + len(payload)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http + payload + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2] if fields["WARC-Type"] == "response" else block


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """Skippable frame with compressed and plain size of every frame, and the footer."""
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def place(path: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system for a folder as Spark names it, and the path there. ``s3a`` and ``s3n``,
    the names of Hadoop's clients, are Arrow's ``s3``; ``hdfs`` needs libhdfs on the executors; other
    schemes are Arrow's own, or an error that says so."""
    scheme, sep, rest = path.partition("://")
    try:
        return pafs.FileSystem.from_uri(f"s3://{rest}" if sep and scheme in ("s3a", "s3n") else path)
    except pa.ArrowInvalid as e:
        raise ValueError(f"bundles can't be kept under {path}: Arrow has no file system for it") from e


def read_seek_table(path: str) -> list[tuple[int, int]]:
    """(compressed, plain) sizes from the end of a bundle."""
    fs, at = place(path)
    with fs.open_input_file(at) as f:
        f.seek(f.size() - 9)
        n, _, magic = struct.unpack("<IBI", f.read(9))
        if magic != SEEKABLE:
            raise ValueError(f"no seek table in {path}")
        f.seek(f.size() - 9 - 8 * n)
        return list(struct.iter_unpack("<II", f.read(8 * n)))


class Bundle:
    """A bundle that is being written."""

    def __init__(self, folder: str, level: int):
        self.path = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        fs, at = place(self.path)
        fs.create_dir(at.rpartition("/")[0], recursive=True)
        self.out, self.zstd = fs.open_output_stream(at, compression=None), zstandard.ZstdCompressor(level=level)
        self.frames: list[tuple[int, int]] = []
        self.size, self.plain, self.waiting = 0, bytearray(), []

    def add(self, page_id: str | None, raw: bytes) -> None:
        self.waiting.append((page_id, len(self.plain), len(raw)))
        self.plain += raw

    def cut(self) -> list[tuple]:
        """Ends the frame; its index rows."""
        packed = self.zstd.compress(bytes(self.plain))
        self.out.write(packed)
        rows = [(i, self.path, len(self.frames), self.size, len(packed), at, n) for i, at, n in self.waiting]
        self.frames.append((len(packed), len(self.plain)))
        self.size += len(packed)
        self.plain, self.waiting = bytearray(), []
        return rows

    def close(self) -> None:
        self.out.write(seek_table(self.frames))
        self.out.close()


def _writer(folder: str, frame_bytes: int, bundle_bytes: int, level: int, date: str):
    columns = [c.split()[0] for c in INDEX.split(", ")]
    frame = lambda rows: pd.DataFrame(rows, columns=columns)

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bundle = None
        for p in parts:
            rows: list[tuple] = []
            for r in p.itertuples(index=False):
                bundle = bundle or Bundle(folder, level)
                page_id, first = r.page_id, r.first  # ids are text here: pandas would round nullable numbers
                payload = b"" if r.revisit else (r.html or "").encode("utf-8", "replace")
                bundle.add(page_id, record(page_id, r.url, payload, r.digest, first, r.revisit, date))
                if len(bundle.plain) >= frame_bytes:
                    rows += bundle.cut()
                    if bundle.size >= bundle_bytes:
                        bundle.close()
                        bundle = None
            yield frame(rows)
        if bundle:
            yield frame(bundle.cut() if bundle.waiting else [])
            bundle.close()

    return write


def write(pages: DataFrame, folder: str, *, least: int = 100, frame_bytes: int = 1 << 18, bundle_bytes: int = 1 << 26, level: int = 3, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes ``pages`` (page_id, url, html) to bundles under ``folder`` and returns the index."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).alias("html"))
    p = p.withColumns({"digest": F.sha2("html", 256), "size": F.octet_length("html").cast("long")})
    thin = p.filter(F.col("size") >= least).select("page_id", "digest")
    twice = thin.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter((F.col("n") > 1) & F.col("first").isNotNull()).select("digest", "first")
    again = thin.join(twice, "digest").filter(~F.col("page_id").eqNullSafe(F.col("first"))).distinct()
    again = stage(again.select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "first"), "revisits")
    rows = p.join(again, p["page_id"].eqNullSafe(again["p"]) & (p["digest"] == again["d"]), "left")
    revisit = F.col("first").isNotNull()
    rows = rows.select(F.col("page_id").cast("string").alias("page_id"), "url", F.when(~revisit, F.col("html")).alias("html"), "digest", F.col("first").cast("string").alias("first"), revisit.alias("revisit"))
    index = rows.mapInPandas(_writer(folder, frame_bytes, bundle_bytes, level, date), INDEX)
    return stage(index.withColumn("page_id", F.col("page_id").cast("long")), "warc_index")


@lru_cache(64)
def _frame_places(bundle: str) -> list[tuple[int, int]]:
    """Where each frame of a bundle starts and how long it is, by its seek table."""
    sizes = [packed for packed, _ in read_seek_table(bundle)]
    return list(zip(itertools.accumulate(sizes, initial=0), sizes, strict=False))


def _frames(parts: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, list[bytes]]]:
    """Index rows with their raw records; a frame is read once for rows that follow each other."""
    last, plain = None, b""
    for p in parts:
        raws = []
        for r in p.itertuples(index=False):
            if last != (r.bundle, r.frame):
                start, size = _frame_places(r.bundle)[r.frame]
                fs, at = place(r.bundle)
                with fs.open_input_file(at) as f:
                    f.seek(start)
                    plain = zstandard.ZstdDecompressor().decompress(f.read(size))
                last = (r.bundle, r.frame)
            raws.append(plain[r.record_at : r.record_at + r.record_size])
        yield p, raws


def read(index: DataFrame) -> DataFrame:
    """Records of the index: page_id, url, record_type, digest as said in the record, refers_to,
    payload (null for revisits)."""

    def parsed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p, raws in _frames(parts):
            got = [parse(r) for r in raws]
            refers = [h.get("WARC-Refers-To", "<urn:page:>")[10:-1] for h, _ in got]
            yield pd.DataFrame({
                "page_id": p["page_id"], "url": [h["WARC-Target-URI"] for h, _ in got], "record_type": [h["WARC-Type"] for h, _ in got],
                "digest": [h["WARC-Payload-Digest"][7:] for h, _ in got], "refers_to": [x or None for x in refers],
                "payload": [b if h["WARC-Type"] == "response" else None for h, b in got],
            })

    texts = index.withColumn("page_id", F.col("page_id").cast("string")).mapInPandas(parsed, "page_id string, url string, record_type string, digest string, refers_to string, payload binary")
    return texts.withColumns({c: F.col(c).cast("long") for c in ("page_id", "refers_to")})


def op6_warc(spark, sf_dir: str) -> DataFrame:
    """Writes all ``pages`` to bundles, reads them back and looks revisits up."""
    folder = scratch(spark, "warc")
    index = write(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    got = read(index).select("page_id", "record_type", "refers_to", "digest", F.octet_length("payload").cast("long").alias("bytes"), F.sha2("payload", 256).alias("true"))
    got = stage(got, "warc_read")
    own = got.filter(F.col("record_type") == "response").select("page_id", F.col("bytes").alias("payload_bytes"), F.col("true").alias("payload_digest"), "record_type", "refers_to")
    held = own.select(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("digest"), "payload_bytes").distinct()
    back = got.filter(F.col("record_type") == "revisit").join(stage(held, "warc_held"), ["refers_to", "digest"], "left")
    size = F.coalesce("payload_bytes", F.raise_error(F.concat(F.lit("no response for page "), F.col("page_id").cast("string"))).cast("long"))
    return own.unionByName(back.select("page_id", size.alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to"))


OP6_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS DISTINCT FROM page_id AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM f
"""

"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent frames and frames into bundles. A bundle ends with a seek table in a skippable frame (the
public seekable format), so a reader opens any frame without the ones before it; the index maps each record's id to a frame and
an offset inside that frame's content. Bundles are the rows of a Parquet table in the shared folder: a task that fails leaves
none, a task that runs twice counts once. `export` writes them as .warc.zst files.

Of records with equal payloads of at least MIN_REVISIT bytes the one with the smallest id is a response and the others revisit
it; rows that repeat that smallest id are responses as well. Null payloads are empty; rows with null id are revisits where an
id shares their payload, else responses. Null urls give the target urn:none. Every row gives one record.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.llm.common import looked_up, staged, table

MIN_REVISIT = 100
FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 8 << 20
# Fixed values of the seekable format: skippable frame, footer; and the date that all records carry.
SKIPPABLE, SEEK_TABLE, FOOTER = 0x184D2A5E, 0x8F92EAB1, 9
DATE = "2020-01-01T00:00:00Z"
URN = "urn:page:"
BUNDLES = "bundle string, body binary, record_ids array<string>, frames array<int>, offsets array<int>, lengths array<int>"
PAGES = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, bundle string, frame int, offset int"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record with its HTTP block; a revisit has the headers alone."""
    body = b"" if refers_to is not None else payload
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{URN}{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {re.sub(r'[\x00-\x20\x7f]', lambda m: f'%{ord(m[0]):02X}', url) if url else 'urn:none'}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{URN}{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(http) + len(body)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + http + body + b"\r\n\r\n"


def seekable(frames: list[bytes], level: int = 3) -> bytes:
    packer = zstandard.ZstdCompressor(level=level)
    packed = [packer.compress(f) for f in frames]
    entries = b"".join(struct.pack("<II", len(p), len(f)) for p, f in zip(packed, frames, strict=True))
    return b"".join(packed) + struct.pack("<II", SKIPPABLE, len(entries) + FOOTER) + entries + struct.pack("<IBI", len(frames), 0, SEEK_TABLE)


class Reader:
    """Opens single frames of a bundle by its seek table."""

    def __init__(self, body: bytes) -> None:
        count, _, magic = struct.unpack("<IBI", body[-FOOTER:])
        if magic != SEEK_TABLE:
            raise ValueError("no seek table")
        at, self.spans = 0, []
        for size, full in struct.iter_unpack("<II", body[-FOOTER - 8 * count : -FOOTER]):
            self.spans.append((at, size, full))
            at += size
        self.body, self.last = body, (-1, b"")

    def frame(self, n: int) -> bytes:
        if self.last[0] != n:
            at, size, full = self.spans[n]
            self.last = n, zstandard.ZstdDecompressor().decompress(self.body[at : at + size], max_output_size=max(1, full))
        return self.last[1]


def parsed(raw: bytes) -> dict:
    """Fields of a record. Of a response size and digest are those of the payload found, of a revisit those it states."""
    head, _, block = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    http, _, payload = block[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    own = lambda key: int(x) if (x := fields.get(key, "")[1 + len(URN) : -1]) else None
    response = fields["WARC-Type"] == "response"
    return {
        "page_id": own("WARC-Record-ID"), "payload_bytes": len(payload) if response else int(re.search(rb"Content-Length: (\d+)", http)[1]),
        "payload_digest": hashlib.sha256(payload).hexdigest() if response else fields["WARC-Payload-Digest"].partition(":")[2],
        "record_type": fields["WARC-Type"], "refers_to": own("WARC-Refers-To"), "url": fields["WARC-Target-URI"],
    }


def decided(pages: DataFrame, id_col: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """page_id, url, payload, digest, refers_to. Only digests that repeat are joined, spread by id so that none is hot."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.encode(F.coalesce(F.col(payload).cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    long = rows.where(F.length("payload") >= MIN_REVISIT)
    firsts = long.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first")
    found = looked_up(rows, firsts, ["digest"], F.coalesce("page_id", F.lit(0)))
    return found.select("page_id", "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def bundles(rows: DataFrame) -> DataFrame:
    """Bundles of about BUNDLE_BYTES of records; one task writes its records in the order in which they reach it."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames: list[bytes] = []
        open_frame: list[bytes] = []
        index: list[tuple[str, int, int, int]] = []
        filled = done = 0

        def closed() -> pd.DataFrame:
            nonlocal frames, open_frame, index, filled, done
            frames += [b"".join(open_frame)] * bool(open_frame)
            body = seekable(frames)
            columns = [list(x) for x in zip(*index, strict=True)]
            out = pd.DataFrame([[hashlib.sha256(body).hexdigest()[:32], body, *columns]], columns=["bundle", "body", "record_ids", "frames", "offsets", "lengths"])
            frames, open_frame, index, filled, done = [], [], [], 0, 0
            return out

        for batch in batches:
            for page_id, url, payload, digest, refers_to in zip(*(batch[c] for c in ("page_id", "url", "payload", "digest", "refers_to")), strict=True):
                number = lambda x: None if pd.isna(x) else int(x)
                raw = record(number(page_id), url, bytes(payload), digest, number(refers_to))
                index.append(("" if pd.isna(page_id) else str(int(page_id)), len(frames), filled, len(raw)))
                open_frame.append(raw)
                filled += len(raw)
                done += len(raw)
                if filled >= FRAME_BYTES:
                    frames.append(b"".join(open_frame))
                    open_frame, filled = [], 0
                if done >= BUNDLE_BYTES:
                    yield closed()
        if index:
            yield closed()

    ids = rows.withColumns({c: F.col(c).cast("decimal(20,0)") for c in ("page_id", "refers_to")})  # exact where a column has nulls
    return ids.mapInPandas(write, BUNDLES)


def read_back(stored: DataFrame) -> DataFrame:
    """A row for each record, each found through the index and the seek table."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for bundle, body, frames, offsets, lengths in zip(*(batch[c] for c in ("bundle", "body", "frames", "offsets", "lengths")), strict=True):
                reader = Reader(bytes(body))
                got = [parsed(reader.frame(f)[o : o + n]) | {"bundle": bundle, "frame": f, "offset": o} for f, o, n in zip(frames, offsets, lengths, strict=True)]
                out = pd.DataFrame(got)
                yield out.assign(**{c: out[c].astype("Int64") for c in ("page_id", "refers_to")})

    return stored.mapInPandas(read, PAGES)


def lookup(stored: DataFrame, ids: DataFrame) -> DataFrame:
    """The records of ids (record_id string), read_back's columns: the index leads to frames, and only these are opened.

    ids may be a table of any size; bundles without a hit are not read.
    """
    entry = F.explode(F.arrays_zip("record_ids", "frames", "offsets", "lengths"))
    hits = stored.select("bundle", entry.alias("e")).select("bundle", "e.*").join(ids.select(F.col("record_id").alias("record_ids")).distinct(), "record_ids", "left_semi")
    own = hits.groupBy("bundle").agg(F.array_sort(F.collect_list(F.struct("frames", "offsets", "lengths"))).alias("hits"))
    found = own.join(stored.select("bundle", "body"), "bundle")
    return read_back(found.select("bundle", "body", *[F.col(f"hits.{c}").alias(c) for c in ("frames", "offsets", "lengths")]))


def export(stored: DataFrame, folder: str) -> DataFrame:
    """Writes every bundle as <bundle>.warc.zst under folder, a URI that pyarrow's file systems open; returns the paths."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            for bundle, body in zip(batch["bundle"], batch["body"], strict=True):
                path = f"{root}/{bundle}.warc.zst"  # named by its content: a second attempt writes the same bytes
                with store.open_output_stream(path, compression=None) as out:  # by its name it would be compressed again
                    out.write(bytes(body))
                yield pd.DataFrame({"path": [path], "bytes": [len(body)]})

    return stored.select("bundle", "body").mapInPandas(write, "path string, bytes long")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = staged(bundles(decided(table(spark, sf_dir, "pages"))), "warc")
    return read_back(stored).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = """
with p as (select page_id, coalesce(html, '') h from pages),
d as (select page_id, strlen(h) b, sha256(h) s from p),
f as (select s, min(page_id) m from d where b >= 100 group by s)
select d.page_id, d.b::bigint payload_bytes, d.s payload_digest,
       case when m is not null and m <> page_id then 'revisit' else 'response' end record_type,
       case when m is not null and m <> page_id then m end refers_to
from d left join f on d.s = f.s and d.b >= 100
"""

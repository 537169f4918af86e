"""WARC archives as chunked record tables.

An archive is a table of rows (record, chunk, n_chunks, digest, data): the bytes of a
record, cut in chunks of bounded size, digest the SHA-256 of the payload up to the end of the
chunk.  The chunks of all records strung together are a WARC/1.1 file.

A payload is cut into chunks before Python sees it, as many rows of a generator in the
JVM; the writer carries a digest from chunk to chunk and never holds more than one.  As a
record's header states the digest of all that follows, payloads pass twice: once for
digests and lengths, once to be written.  The reader streams in the same way.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MAX_BROADCAST_KEYS, is_scan, materialise

#: Bytes of a chunk, and of a batch of them that leaves the writer.
CHUNK_BYTES, BATCH_BYTES = 256 * 1024, 4 << 20
#: Shorter payloads are never stored as revisits.
REVISIT_FROM = 100
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HEAD_LIMIT = 1 << 26


def _urn(page_id: int | None, row: int) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{row}>"


def head(page_id: int | None, row: int, url: str | None, size: int, digest: str, refers: tuple[int | None, int] | None) -> bytes:
    """What goes before a record's payload; refers: page and row of the response that a revisit stands for."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if refers else 'response'}", f"WARC-Record-ID: {_urn(page_id, row)}", f"WARC-Date: {DATE}"]
    if url:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers:
        lines += [f"WARC-Refers-To: {_urn(*refers)}", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (0 if refers else size)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def pieces(rows: DataFrame, chunk_bytes: int) -> DataFrame:
    """rows with payload (binary) cut: piece (from 0), n_pieces and data instead; an empty payload is one empty piece."""
    n = F.greatest(F.ceil(F.octet_length("payload") / chunk_bytes), F.lit(1)).cast("int")
    cut = rows.withColumn("n_pieces", n).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 1)))
    return cut.withColumn("data", F.substring("payload", F.col("piece") * chunk_bytes + 1, F.lit(chunk_bytes))).drop("payload")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces (page_id, row, piece, n_pieces, data) in order -> (page_id, row, size, digest) of each record."""
    sha, size = None, 0
    for batch in batches:
        out = []
        for page_id, row, piece, n, data in zip(*(batch[c] for c in ("page_id", "row", "piece", "n_pieces", "data")), strict=True):
            if piece.as_py() == 0:
                sha, size = hashlib.sha256(), 0
            view = data.as_buffer()
            sha.update(view)
            size += view.size
            if piece.as_py() == n.as_py() - 1:
                out.append((page_id.as_py(), row.as_py(), size, sha.hexdigest()))
        if out:
            p, r, z, d = zip(*out, strict=True)
            yield pa.RecordBatch.from_pydict({"page_id": pa.array(p, pa.int64()), "row": pa.array(r, pa.int64()), "size": pa.array(z, pa.int64()), "digest": pa.array(d, pa.string())})


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order, with url (in the first), size, digest and whom they refer to -> chunks of records.

    Of a revisit only the first piece comes.  A chunk is a piece with the header before it
    or the end of the record behind it; long headers are chunks of their own.
    """
    out: list[tuple] = []
    held, sha = 0, None

    def batch_of():
        r, c, n, g, d = zip(*out, strict=True)
        return pa.RecordBatch.from_pydict({"record": pa.array(r, pa.int64()), "chunk": pa.array(c, pa.int32()), "n_chunks": pa.array(n, pa.int32()), "digest": pa.array(g, pa.string()), "data": pa.array(d, pa.binary())})

    for batch in batches:
        names = ("page_id", "row", "url", "piece", "n_pieces", "data", "size", "digest", "refers_to", "refers_row")
        for page_id, row, url, piece, n, data, size, digest, refers_to, refers_row in zip(*(batch[c] for c in names), strict=True):
            row, piece, n = row.as_py(), piece.as_py(), n.as_py()
            refers = (refers_to.as_py(), refers_row.as_py()) if refers_row.is_valid else None
            view = memoryview(b"") if refers else memoryview(data.as_buffer())
            if piece == 0:
                sha, place = hashlib.sha256(), 0
                start = head(page_id.as_py(), row, url.as_py(), size.as_py(), digest.as_py(), refers)
                starts = [start[i : i + CHUNK_BYTES] for i in range(0, len(start), CHUNK_BYTES)]
                total = n + len(starts) - 1
            else:
                starts = [b""]
            sha.update(view)
            last = piece == n - 1
            parts = [*starts[:-1], b"".join((starts[-1], view, b"\r\n\r\n" if last else b""))]
            for i, part in enumerate(parts):
                out.append((row, place, total, digest.as_py() if refers else sha.hexdigest() if i == len(parts) - 1 else hashlib.sha256().hexdigest(), part))
                place += 1
                held += len(part)
            if held >= BATCH_BYTES:
                yield batch_of()
                out, held = [], 0
    if out:
        yield batch_of()


def write(pages: DataFrame) -> DataFrame:
    """The archive table of all pages, written to the shared folder and read back.

    A record per row of pages (page_id, url, html), its payload the html in UTF-8 (null:
    empty).  Of rows with equal payloads of REVISIT_FROM bytes or more, the one with the
    least page_id (of equal ids one row) is a response and the others revisit it; null
    ids come after all others.  Shorter payloads are responses.  An empty table gives
    no rows; other columns are ignored.
    """
    if not is_scan(pages):
        pages = materialise(pages.select("page_id", "url", "html"), "pages")
    rows = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"), F.monotonically_increasing_id().alias("row"))
    keyed = pieces(rows.drop("url"), CHUNK_BYTES).select("page_id", "row", "piece", "n_pieces", "data")
    keyed = materialise(keyed.mapInArrow(_digests, "page_id long, row long, size long, digest string"), "digests")
    least = F.min(F.struct(F.col("page_id").isNull().alias("no_id"), F.col("page_id"), F.col("row")))
    first = keyed.where(F.col("size") >= REVISIT_FROM).groupBy("digest").agg(least.alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    revisits = keyed.join(first, "digest").where("row != first.row").select("row", F.col("first.page_id").alias("refers_to"), F.col("first.row").alias("refers_row"))
    revisits = materialise(revisits, "revisits")
    if revisits.limit(MAX_BROADCAST_KEYS + 1).count() <= MAX_BROADCAST_KEYS:
        revisits = F.broadcast(revisits)
    # a header needs digest and length: taken again in the scan, which is cheaper than to bring them back by a shuffle of payloads
    whole = rows.withColumn("size", F.octet_length("payload").cast("long")).withColumn("digest", F.sha2("payload", 256)).join(revisits, "row", "left")
    whole = whole.withColumn("payload", F.when(F.col("refers_row").isNull(), F.col("payload")).otherwise(F.lit(b"")))
    cut = pieces(whole, CHUNK_BYTES).withColumn("url", F.when(F.col("piece") == 0, F.col("url")))
    cut = cut.select("page_id", "row", "url", "piece", "n_pieces", "data", "size", "digest", "refers_to", "refers_row")
    return materialise(cut.mapInArrow(_write, "record long, chunk int, n_chunks int, digest string, data binary"), "archive")


class Reader:
    """Takes the chunks of one record in order: header, HTTP header, then the payload into a digest."""

    def __init__(self) -> None:
        self.held = bytearray()
        self.warc: dict[str, str] | None = None
        self.http: dict[str, str] | None = None
        self.sha = hashlib.sha256()
        self.left = self.payload = 0

    def _head(self) -> dict[str, str] | None:
        end = self.held.find(b"\r\n\r\n")
        if end < 0:
            if len(self.held) > _HEAD_LIMIT:
                raise ValueError("a header without end")
            return None
        lines = self.held[:end].decode().split("\r\n")
        del self.held[: end + 4]
        return {"": lines[0]} | {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}

    def feed(self, data: bytes) -> None:
        if self.http is None:
            self.held += data
            if self.warc is None:
                self.warc = self._head()
                if self.warc is None:
                    return
                if not self.warc[""].startswith("WARC/"):
                    raise ValueError("not a WARC record")
                self.left = int(self.warc["content-length"])
            before = len(self.held)
            self.http = self._head()
            if self.http is None:
                return
            self.left -= before - len(self.held)
            data, self.held = bytes(self.held), bytearray()
        part = memoryview(data)[: self.left]
        self.sha.update(part)
        self.payload += len(part)
        self.left -= len(part)

    def close(self) -> tuple[int | None, int, str, str, int | None]:
        """(page_id, payload bytes, digest, type, page referred to)"""
        if self.http is None or self.left:
            raise ValueError("a record that breaks off")

        def page(urn):
            x = urn.strip("<>").split(":")[2]
            return int(x) if x else None

        stated = self.warc["warc-payload-digest"].removeprefix("sha256:")
        kind = self.warc["warc-type"]
        if kind == "revisit":  # its payload is in the response; length and digest are stated
            return page(self.warc["warc-record-id"]), int(self.http["content-length"]), stated, kind, page(self.warc["warc-refers-to"])
        if self.sha.hexdigest() != stated:
            raise ValueError(f"record {self.warc['warc-record-id']} is damaged")
        return page(self.warc["warc-record-id"]), self.payload, stated, kind, None


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    record, reader = None, None

    def batch_of(out):
        cols = zip(*out, strict=True)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    for batch in batches:
        out = []
        for r, data in zip(batch["record"].to_pylist(), batch["data"], strict=True):
            if r != record:
                if reader is not None:
                    out.append(reader.close())
                record, reader = r, Reader()
            reader.feed(data.as_buffer())
        if out:
            yield batch_of(out)
    if reader is not None:
        yield batch_of([reader.close()])


def read(archive: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record of an archive table.

    Length and digest are those of the full payload; they are counted and checked on
    the way, and a damaged or incomplete record raises an error.  Records of one chunk
    are read where they lie; the chunks of longer ones are brought together in order.
    """
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    short = archive.where("n_chunks = 1").select("record", "data").mapInArrow(_read, schema)
    long = archive.where("n_chunks > 1").repartition("record").sortWithinPartitions("record", "chunk").select("record", "data").mapInArrow(_read, schema)
    return short.unionByName(long)


def export(archive: DataFrame, path: str) -> None:
    """Plain .warc files, one per partition, in a folder that all executors have mounted."""
    import os

    os.makedirs(path, exist_ok=True)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name = f"{path}/part-{TaskContext.get().partitionId():05d}.warc"
        n = 0
        with open(f"{name}.{TaskContext.get().taskAttemptId()}", "wb") as f:
            for batch in batches:
                for data in batch["data"]:
                    f.write(data.as_buffer())
                    n += 1
        os.replace(f.name, name)
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    archive.repartitionByRange("record").sortWithinPartitions("record", "chunk").mapInArrow(put, "n long").agg(F.sum("n")).collect()

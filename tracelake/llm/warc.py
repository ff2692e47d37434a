"""WARC archives: writing captures with revisits, and assembling transactions on reading.

A capture is three WARC/1.1 records: the response (or a revisit of an equal payload), its
request and its metadata; the latter two name the first in WARC-Concurrent-To.  Each
record is a gzip member of its own, so a reader can begin at any of them, and each kind
has archives of its own, so each is read once.  Reading unpacks archives record by record
and joins the three kinds by that identifier into one nested row.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from base64 import b32encode
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.common import Workspace, broadcast_if_small

#: An archive is closed, and a batch of read records passed on, beyond so many bytes.
ARCHIVE_BYTES = 256 << 20
BATCH_BYTES = 4 << 20
READ_BYTES = 1 << 20
#: Pages of an Arrow batch: a page may have megabytes, and a batch 2 GB at most.
BATCH_ROWS = 32
CRLF = "\r\n"
MAIN, REQUEST, METADATA = "main", "request", "metadata"
DATE = "2024-01-01T00:00:00Z"

RECORD_SCHEMA = (
    "record_type string, record_id string, concurrent_to string, refers_to string, refers_to_id long, target_uri string, "
    "payload_digest string, page_id long, payload_bytes long, payload binary"
)
MANIFEST = "kind string, path string, records long, bytes long"


def _urn(*parts: Column) -> Column:
    """A name-based uuid urn of some values."""
    h = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def captures(pages: DataFrame, workspace: Workspace, id_col: str = "page_id", min_revisit_bytes: int = 0) -> DataFrame:
    """Decide response or revisit for each row: page_id, url, html, refers_to and record ids.

    Of rows with equal payloads of at least ``min_revisit_bytes``, the one with the
    smallest id is the response.  A null html is an empty payload.  Rows that repeat both
    that id and the payload are all responses; a null id is larger than others.  Ids are
    cast to whole numbers; other columns are not read; pages of any length stay whole.

    Payloads that occur once are decided by a narrow table of digests: pages themselves
    are not shuffled while the table of repeated digests is small enough to broadcast.
    """
    digest = F.sha1(F.coalesce("html", F.lit("")).cast("binary"))
    own = F.col(id_col).cast("long")
    size = F.coalesce(F.octet_length("html"), F.lit(0))
    each = pages.where(size >= min_revisit_bytes).groupBy(digest.alias("_digest"), own.alias("page_id")).agg(F.count("*").alias("n"))
    copied = each.groupBy("_digest").agg(F.min("page_id").alias("first_id"), F.sum("n").alias("n"), (F.max("n") > 1).alias("twice")).where("n > 1").drop("n")
    copied = workspace.keep("copied", copied)
    rows = pages.select(own.alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"), digest.alias("_digest"))
    joined = rows.join(broadcast_if_small(copied, 120), "_digest", "left")
    same = Window.partitionBy("_digest", "page_id").orderBy("url")
    twice = F.coalesce("twice", F.lit(False))
    numbered = joined.where(~twice).withColumn("_n", F.lit(1)).unionByName(joined.where(twice).withColumn("_n", F.row_number().over(same)))
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return numbered.select(
        "page_id", "url", "html", F.when(revisit, F.col("first_id")).alias("refers_to"),
        _urn(F.lit("capture"), F.col("page_id"), F.col("_digest"), F.col("_n")).alias("record_id"),
        F.when(revisit, _urn(F.lit("capture"), F.col("first_id"), F.col("_digest"), F.lit(1))).alias("refers_to_record"),
    )


def sha1_base32(data: bytes) -> str:
    """Bare upper-case base32 of the SHA-1 (160 bits, so no padding)."""
    return b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, record_id: str, uri: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member."""
    every = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", DATE), ("WARC-Target-URI", uri), *headers, ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}{CRLF}" for k, v in every) + CRLF
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode()) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def transaction(page: int | None, url: str, html: bytes, refers_to: int | None, record_id: str, refers_to_record: str | None) -> list[tuple[str, bytes]]:
    """The three records of a capture by kind of archive."""
    uri = "".join(c if c > " " else "%20" for c in url)
    http, revisit = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n", refers_to_record is not None
    headers = [("WARC-Payload-Digest", f"sha1:{sha1_base32(html)}")]
    if revisit:
        headers += [("WARC-Refers-To", refers_to_record), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    headers.append(("Content-Type", "application/http;msgtype=response"))
    with_main = [("WARC-Concurrent-To", record_id)]
    own = lambda kind: f"<urn:uuid:{'-'.join((h := hashlib.md5(f'{kind}|{record_id}'.encode()).hexdigest())[a:b] for a, b in itertools.pairwise((0, 8, 12, 16, 20, 32)))}>"
    fields = [("pageId", page), ("payloadLength", len(html)), ("refersToPage", refers_to)]
    told = "".join(f"{k}: {v}{CRLF}" for k, v in fields if v is not None).encode()
    return [
        (MAIN, record("revisit" if revisit else "response", record_id, uri, headers, http if revisit else http + html)),
        (REQUEST, record("request", own("request"), uri, [*with_main, ("Content-Type", "application/http;msgtype=request")], f"GET {uri} HTTP/1.1\r\nUser-Agent: tracelake\r\n\r\n".encode())),
        (METADATA, record("metadata", own("metadata"), uri, [*with_main, ("Content-Type", "application/warc-fields")], told)),
    ]


def write(captured: DataFrame, workspace: Workspace) -> DataFrame:
    """Write captures as gzip archives in the workspace; returns the manifest (MANIFEST), one row per archive.

    Tasks write archives under names of their own and close them beyond ARCHIVE_BYTES; only
    those of the manifest count, which Spark commits task by task, so what a lost or
    repeated attempt has written is never read.
    """
    folder = workspace.path("archives")

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        open_now: dict[str, list] = {}
        done, numbers = [], itertools.count()

        def close(kind: str) -> None:
            stream, name, n, size = open_now.pop(kind)
            stream.close()
            done.append((kind, f"{folder}/{name}", n, size))

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for kind, data in transaction(*row):
                    if kind not in open_now:
                        name = f"{kind}-{context.partitionId():06d}-{context.taskAttemptId()}-{next(numbers):04d}.warc.gz"
                        open_now[kind] = [fs.open_output_stream(f"{base}/{name}", compression=None), name, 0, 0]
                    held = open_now[kind]
                    held[0].write(data)
                    held[2] += 1
                    held[3] += len(data)
                    if held[3] >= ARCHIVE_BYTES:
                        close(kind)
        for kind in list(open_now):
            close(kind)
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True) if done else [[]] * 4, kinds, strict=True)], names=["kind", "path", "records", "bytes"])

    rows = captured.select("page_id", "url", F.col("html").cast("binary").alias("html"), "refers_to", "record_id", "refers_to_record")
    return workspace.keep("manifest", rows.mapInArrow(written, MANIFEST), BATCH_ROWS)


def members(stream) -> Iterator[bytes]:
    """Unpacked gzip members of a stream one by one; no more than one is held."""
    data = stream.read(READ_BYTES)
    while data:
        member, parts = zlib.decompressobj(31), []
        while not member.eof:
            if not data and not (data := stream.read(READ_BYTES)):
                raise ValueError("an archive ends inside a record")
            parts.append(member.decompress(data))
            data = member.unused_data if member.eof else b""
        yield b"".join(parts)
        data = data or stream.read(READ_BYTES)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record of a gzip member, usually one."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode("utf-8").split(CRLF)
        if not version.startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
        start, length = end + 4, int(headers["content-length"])
        yield headers, data[start : start + length]
        at = start + length + 4


def _row(h: dict[str, str], block: bytes) -> tuple:
    kind, digest = h["warc-type"], h.get("warc-payload-digest", "").removeprefix("sha1:") or None
    payload, page, length, refers = None, None, None, None
    if kind == "response":
        payload = block[block.index(b"\r\n\r\n") + 4 :]
        length = len(payload)
        if sha1_base32(payload) != digest:
            raise ValueError("a payload differs from its digest")
    elif kind == "metadata":
        fields = dict(x.split(": ", 1) for x in block.decode().split(CRLF) if x)
        page, length, refers = (int(fields[k]) if k in fields else None for k in ("pageId", "payloadLength", "refersToPage"))
    return kind, h["warc-record-id"], h.get("warc-concurrent-to"), h.get("warc-refers-to"), refers, h.get("warc-target-uri"), digest, page, length, payload


def read_records(manifest: DataFrame, kind: str, types: tuple[str, ...]) -> DataFrame:
    """Records of some types of the archives of a kind; an archive is a task's work, a record what it holds of it."""

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, place = pafs.FileSystem.from_uri(path)
                rows, held = [], 0
                with fs.open_input_stream(place, compression=None) as stream:
                    for headers, block in (x for member in members(stream) for x in parse(member)):
                        if headers["warc-type"] in types:
                            rows.append(_row(headers, block))
                            held += len(block) + 400
                        if held >= BATCH_BYTES:
                            yield packed(rows)
                            rows, held = [], 0
                if rows:
                    yield packed(rows)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    files = manifest.where(F.col("kind") == kind).select("path")
    return files.repartitionByRange(max(1, files.count()), "path").mapInArrow(parsed, RECORD_SCHEMA)  # by range, so that no two large archives meet


def transactions(manifest: DataFrame) -> DataFrame:
    """One nested row per capture: record_id, target_uri, request, response, metadata structs.

    Request and metadata are found through their WARC-Concurrent-To; a capture without
    one of them has a null there.  A manifest without archives gives no rows.
    """
    main = read_records(manifest, MAIN, ("response", "revisit")).select(
        "record_id", "target_uri", F.struct("record_type", "payload_digest", F.col("refers_to").alias("refers_to_record"), "payload_bytes", "payload").alias("response")
    )
    request = read_records(manifest, REQUEST, ("request",)).select(
        F.col("concurrent_to").alias("record_id"), F.struct(F.col("record_id").alias("request_id"), F.col("target_uri").alias("requested")).alias("request")
    )
    metadata = read_records(manifest, METADATA, ("metadata",)).select(
        F.col("concurrent_to").alias("record_id"), F.struct(F.col("record_id").alias("metadata_id"), "page_id", "payload_bytes", F.col("refers_to_id").alias("refers_to")).alias("metadata")
    )
    return main.join(request, "record_id", "left").join(metadata, "record_id", "left")

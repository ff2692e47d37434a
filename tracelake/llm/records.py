"""Length-delimited binary records of token ids, with a separate offset index.

A record file holds, per sequence: payload length (u64), masked checksum of those eight
bytes (u32), payload, masked checksum of the payload (u32), all little-endian.  A payload
is the document id (i64), the bytes per token (u8) and the ids.  The index file beside it
has one entry of three i64 per record (document id, offset of its frame, tokens), so a
shuffled reader can seek to any record.  Files are numbered in ascending document order.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import textvec
from tracelake.llm.common import small_batches
from tracelake.llm.library_bpe import LibraryEncoder

NULL_ID = -(1 << 63)
MASK_DELTA = 0xA282EAD8
PREFIX = 32
OPEN_FILES = 64

HEAD, TAIL, OWN, ENTRY = "<QI", "<I", "<qB", "<qqq"
HEAD_BYTES, TAIL_BYTES, OWN_BYTES, ENTRY_BYTES = map(struct.calcsize, (HEAD, TAIL, OWN, ENTRY))


def masked(data: bytes) -> int:
    """CRC-32 rotated right by 15 bits plus a constant, so checksums of checksums stay strong."""
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack(TAIL, masked(length)), payload, struct.pack(TAIL, masked(payload))))


def frames(stream) -> Iterator[bytes]:
    """Payloads of a record file, each checked against both checksums."""
    while head := stream.read(HEAD_BYTES):
        if len(head) < HEAD_BYTES:
            raise ValueError("a record file ends inside a frame")
        length, check = struct.unpack(HEAD, head)
        if masked(head[:8]) != check:
            raise ValueError("the length of a record is damaged")
        payload = stream.read(length)
        tail = stream.read(TAIL_BYTES)
        if len(tail) < TAIL_BYTES or masked(payload) != struct.unpack(TAIL, tail)[0]:
            raise ValueError("a record is damaged")
        yield payload


_loaded: dict[str, LibraryEncoder] = {}


def _encoder(path: str) -> LibraryEncoder:
    if path not in _loaded:
        _loaded[path] = LibraryEncoder(path)
    return _loaded[path]


def _open(uri: str):
    return pafs.FileSystem.from_uri(uri)


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> list[dict]:
    """Encode, append ``end_id``, and write record and index files under ``folder`` (a URI).

    Rows are range-partitioned by id, one file per partition.  A task writes under names of
    its attempt's own, and the manifest names the files of attempts that ended; what others
    have written is never read.  Returns the manifest, one entry per file: part, path,
    docs, tokens.  Ids are cast to whole numbers; other columns are not read.  A null text is empty (the end
    id alone); a null id sorts first; equal ids follow in order of their text, and may be
    cut between files by its first PREFIX characters, so one id does not make one file.
    """

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part = context.partitionId()
        fs, base = _open(folder)
        fs.create_dir(base, recursive=True)
        name = f"part-{part:06d}-{context.taskAttemptId()}"
        encoder = _encoder(tokenizer)
        end = int(end_id).to_bytes(encoder.width, "little")
        n_docs = n_tokens = offset = 0
        with fs.open_output_stream(f"{base}/{name}.rec") as records, fs.open_output_stream(f"{base}/{name}.idx") as index:
            for batch in batches:
                docs = batch.column(0).to_pylist()
                for chunk in textvec.chunks(batch.column(1)):
                    ids, counts = encoder.encode(chunk)
                    coded = ids.astype(f"<u{encoder.width}").tobytes()
                    out, entries, at = [], [], 0
                    for doc, count in zip(docs[chunk.first_row : chunk.first_row + chunk.n_docs], counts.tolist(), strict=True):
                        doc = NULL_ID if doc is None else doc
                        upto = at + count * encoder.width
                        framed = frame(struct.pack(OWN, doc, encoder.width) + coded[at:upto] + end)
                        entries.append(struct.pack(ENTRY, doc, offset, count + 1))
                        out.append(framed)
                        offset, at = offset + len(framed), upto
                    n_docs, n_tokens = n_docs + chunk.n_docs, n_tokens + len(ids) + chunk.n_docs
                    records.write(b"".join(out))
                    index.write(b"".join(entries))
        row = [[part], [f"{folder}/{name}.rec"], [n_docs], [n_tokens]]
        yield pa.RecordBatch.from_arrays([pa.array(row[0], pa.int32()), pa.array(row[1]), *[pa.array(x, pa.int64()) for x in row[2:]]], names=["part", "path", "docs", "tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    ordered = rows.repartitionByRange("id", F.substring("text", 1, PREFIX)).sortWithinPartitions("id", "text")
    with small_batches(docs.sparkSession):
        manifest = ordered.mapInArrow(written, "part int, path string, docs long, tokens long").collect()
    return [r.asDict() for r in sorted(manifest, key=lambda r: r["part"])]


def read(spark: SparkSession, manifest: list[dict], id_col: str = "doc_id") -> DataFrame:
    """Read record files back: id, start (ids before it in all files), ids array<int>."""
    return _read(spark, manifest, id_col, False)


def read_digests(spark: SparkSession, manifest: list[dict], id_col: str = "doc_id") -> DataFrame:
    """Read record files back, keeping counts and CRC-32 of the ids as u32: id, start, n_tokens, ids_crc32."""
    return _read(spark, manifest, id_col, True)


def _read(spark: SparkSession, manifest: list[dict], id_col: str, digest: bool) -> DataFrame:
    files, start = [], 0
    for entry in manifest:
        if entry["docs"]:
            files.append((entry["path"], start))
        start += entry["tokens"]

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, begin in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, place = _open(path)
                docs, starts, values, held = [], [], [], 0
                with fs.open_input_stream(place, buffer_size=1 << 20) as stream:
                    for payload in frames(stream):
                        doc, width = struct.unpack_from(OWN, payload)
                        ids = np.frombuffer(payload, f"<u{width}", offset=OWN_BYTES)
                        docs.append(None if doc == NULL_ID else doc)
                        starts.append(begin)
                        values.append((len(ids), zlib.crc32(ids.astype("<u4").tobytes())) if digest else ids.astype(np.int32))
                        begin += len(ids)
                        held += len(ids)
                        if held >= 1 << 20:
                            yield packed(docs, starts, values)
                            docs, starts, values, held = [], [], [], 0
                if docs:
                    yield packed(docs, starts, values)

    def packed(docs: list, starts: list, values: list) -> pa.RecordBatch:
        first = [pa.array(docs, pa.int64()), pa.array(starts, pa.int64())]
        if digest:
            rest = [pa.array([v[i] for v in values], pa.int64()) for i in (0, 1)]
            return pa.RecordBatch.from_arrays([*first, *rest], names=[id_col, "start", "n_tokens", "ids_crc32"])
        return pa.RecordBatch.from_arrays([*first, pa.array(values, pa.list_(pa.int32()))], names=[id_col, "start", "ids"])

    rest = "n_tokens long, ids_crc32 long" if digest else "ids array<int>"
    listed = spark.createDataFrame(files, "path string, begin long").repartition(max(1, len(files)))
    return listed.mapInArrow(parsed, f"`{id_col}` long, start long, {rest}")


def lookup(folder_entry: dict, number: int) -> list[int]:
    """Ids of one record by its place in a file, through the index (random access)."""
    fs, place = _open(folder_entry["path"])
    with fs.open_input_file(place.removesuffix(".rec") + ".idx") as index:
        index.seek(number * ENTRY_BYTES)
        _, offset, _ = struct.unpack(ENTRY, index.read(ENTRY_BYTES))
    with fs.open_input_file(place) as records:
        records.seek(offset)
        payload = next(frames(records))
    return np.frombuffer(payload, f"<u{struct.unpack_from(OWN, payload)[1]}", offset=OWN_BYTES).tolist()


def index(spark: SparkSession, manifest: list[dict]) -> DataFrame:
    """The offset index as rows: path of the record file, doc_id, offset of the frame, n_tokens."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, place = _open(path)
                with fs.open_input_stream(place.removesuffix(".rec") + ".idx") as stream:
                    while data := stream.read(ENTRY_BYTES << 16):
                        entries = np.frombuffer(data, "<i8").reshape(-1, 3)
                        doc = pa.array(entries[:, 0], mask=entries[:, 0] == NULL_ID)
                        yield pa.RecordBatch.from_arrays([pa.array([path] * len(entries)), doc, pa.array(entries[:, 1]), pa.array(entries[:, 2])], names=["path", "doc_id", "offset", "n_tokens"])

    files = [(e["path"],) for e in manifest if e["docs"]]
    return spark.createDataFrame(files, "path string").repartition(max(1, len(files))).mapInArrow(listed, "path string, doc_id long, offset long, n_tokens long")


def read_shuffled(spark: SparkSession, manifest: list[dict], seed: int, parts: int | None = None) -> DataFrame:
    """All records in an order drawn from ``seed``: place (a hash, ascending in each partition), doc_id, ids array<int>.

    Only index entries are shuffled; tasks seek to the records of theirs, so sequences
    are read once and never move between machines.
    """
    entries = index(spark, manifest).withColumn("place", F.xxhash64("path", "offset", F.lit(seed)))
    dealt = (entries.repartition(parts, "place") if parts else entries.repartition("place")).sortWithinPartitions("place")

    def sought(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple] = {}
        try:
            for batch in batches:
                docs, places, values = [], [], []
                for path, offset, place in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    if path not in held:
                        if len(held) >= OPEN_FILES:
                            held.pop(next(iter(held))).close()
                        fs, at = _open(path)
                        held[path] = fs.open_input_file(at)
                    held[path].seek(offset)
                    payload = next(frames(held[path]))
                    doc, width = struct.unpack_from(OWN, payload)
                    docs.append(None if doc == NULL_ID else doc)
                    places.append(place)
                    values.append(np.frombuffer(payload, f"<u{width}", offset=OWN_BYTES).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array(docs, pa.int64()), pa.array(values, pa.list_(pa.int32()))], names=["place", "doc_id", "ids"])
        finally:
            for stream in held.values():
                stream.close()

    return dealt.select("path", "offset", "place").mapInArrow(sought, "place long, doc_id long, ids array<int>")

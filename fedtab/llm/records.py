"""Token ids as length-delimited binary records with a separate offset index.

Data file: records one after the other, each ``length u64 | masked crc of the length u32 | payload | masked crc
of the payload u32``, little-endian. The checksum is CRC-32, masked as ``rotate_right(crc, 15) + 0xa282ead8``
so that checksums of data that holds checksums stay sound. Payload: ``doc_id i64 | known u8 | ids u16 or u32``
(u16 when the vocabulary fits). Index file: per record ``offset u64 | length u32 | doc_id i64``.

Each task writes files of its own and returns a manifest row for each; only files named by the manifest (which
comes from tasks that succeeded) are read, so a repeated task leaves at most an unread file behind. The folder
must be one that all executors share; it may be any URI that pyarrow's file systems open.

Defined results: null text is the empty text (only the end id); a null identifier sorts first and comes back
as null; an empty table gives no file and no row; a file is closed at ``max_file_bytes``, and a longer record
has a file of its own.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fedtab.functions.common import new_path, stage
from fedtab.llm.encode import Encoder, load
from fedtab.llm.order import in_id_order

END_ID = 2
MAX_FILE_BYTES = 256 << 20
READ_BYTES = 4 << 20
_HEAD, _TAIL, _DOC = "<QI", "<I", "<qB"
_HEAD_SIZE, _DOC_SIZE = struct.calcsize(_HEAD), struct.calcsize(_DOC)
INDEX = np.dtype([("offset", "<u8"), ("length", "<u4"), ("doc_id", "<i8")])
MANIFEST = ("part int, seq int, data string, index string, width int, docs bigint, tokens bigint, bytes bigint")


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack(_TAIL, masked_crc(size)), payload, struct.pack(_TAIL, masked_crc(payload))))


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


class _Files:
    """The files one task writes."""

    def __init__(self, folder: str, width: int, limit: int):
        self.fs, self.at = open_fs(folder)
        self.folder, self.width, self.limit = folder, width, limit
        self.part, self.seq, self.data = TaskContext.get().partitionId(), -1, None

    def _open(self) -> None:
        self.seq += 1
        self.name = f"part-{self.part:06d}-{self.seq:04d}-{uuid.uuid4().hex}"
        self.fs.create_dir(self.at, recursive=True)
        self.data = self.fs.open_output_stream(f"{self.at}/{self.name}.rec", buffer_size=1 << 20)
        self.entries, self.offset, self.tokens = [], 0, 0

    def add(self, doc_id: int | None, ids: bytes) -> Iterator[dict]:
        """Appends a record; yields the manifest row of a file that this closed."""
        if self.data is not None and self.offset + len(ids) > self.limit:
            yield self.close()
        if self.data is None:
            self._open()
        tokens = len(ids) // 4
        if self.width == 2:
            ids = np.frombuffer(ids, "<u4").astype("<u2").tobytes()
        record = frame(struct.pack(_DOC, doc_id or 0, doc_id is not None) + ids)
        self.data.write(record)
        self.entries.append((self.offset, len(record), doc_id or 0))
        self.offset += len(record)
        self.tokens += tokens

    def close(self) -> dict:
        self.data.close()
        with self.fs.open_output_stream(f"{self.at}/{self.name}.idx") as f:
            f.write(np.asarray(self.entries, INDEX).tobytes())
        base = f"{self.folder}/{self.name}"
        row = dict(part=self.part, seq=self.seq, data=f"{base}.rec", index=f"{base}.idx", width=self.width,
                   docs=len(self.entries), tokens=self.tokens, bytes=self.offset)
        self.data = None
        return row


def write_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = END_ID, id_col: str = "doc_id",
                  text_col: str = "text", max_file_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """Encodes every text, appends ``end_id`` and writes the ids in identifier order; returns the manifest."""
    end = b"" if end_id is None else struct.pack("<I", end_id)
    width = 2 if max(load(tokenizer).get_vocab_size(), end_id or 0) < 1 << 16 else 4

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, encoder = _Files(folder, width, max_file_bytes), Encoder(tokenizer)
        schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("data", pa.string()), ("index", pa.string()),
                            ("width", pa.int32()), ("docs", pa.int64()), ("tokens", pa.int64()), ("bytes", pa.int64())])
        rows = []
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for doc_id, encoded in zip(ids, encoder.encode(x.as_py() for x in batch.column("text"))):
                rows.extend(files.add(doc_id, encoded + end))
        if files.data is not None:
            rows.append(files.close())
        yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return stage(in_id_order(docs, id_col, text_col).mapInArrow(write, MANIFEST))


def scan(data: str, width: int) -> Iterator[tuple[int | None, bytes]]:
    """Records of a data file in order: identifier and ids (32-bit bytes); checks every checksum."""
    fs, at = open_fs(data)
    with fs.open_input_stream(at, buffer_size=READ_BYTES) as f:
        while head := f.read(_HEAD_SIZE):
            size, crc = struct.unpack(_HEAD, head)
            if masked_crc(head[:8]) != crc:
                raise ValueError(f"{data}: length of a record is damaged")
            yield unpack(f.read(size + 4), width, data)


def unpack(body: bytes, width: int, name: str) -> tuple[int | None, bytes]:
    payload = body[:-4]
    if len(body) < 4 or struct.unpack(_TAIL, body[-4:])[0] != masked_crc(payload):
        raise ValueError(f"{name}: a record is damaged")
    doc_id, known = struct.unpack_from(_DOC, payload)
    ids = payload[_DOC_SIZE:]
    return (doc_id if known else None), ids if width == 4 else np.frombuffer(ids, "<u2").astype("<u4").tobytes()


def read_index(index: str) -> np.ndarray:
    fs, at = open_fs(index)
    with fs.open_input_stream(at) as f:
        return np.frombuffer(f.read(), INDEX)


def _spread(manifest: DataFrame) -> DataFrame:
    """One task a file."""
    return manifest.repartition(max(1, manifest.count()))


def read_records(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids (bytes) of every record, read from the files."""
    before = F.sum("tokens").over(Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1))
    files = manifest.select("data", "width", F.coalesce(before, F.lit(0)).alias("start"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])
        for batch in batches:
            for row in batch.to_pylist():
                rows, held, start = [], 0, row["start"]
                for doc_id, ids in scan(row["data"], row["width"]):
                    rows.append((doc_id, start, ids))
                    start += len(ids) // 4
                    held += len(ids)
                    if held > READ_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return _spread(files).mapInArrow(read, "doc_id bigint, start bigint, ids binary")


def read_shuffled(manifest: DataFrame, seed: int) -> DataFrame:
    """doc_id and ids of every record in an order drawn from ``seed``, fetched through the offset index."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                e = read_index(row["index"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["data"]] * len(e)), pa.array(np.full(len(e), row["width"], np.int32)),
                     pa.array(e["offset"].astype(np.int64)), pa.array(e["length"].astype(np.int64))],
                    names=["data", "width", "offset", "length"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files: dict = {}
            got = []
            for row in batch.to_pylist():
                if row["data"] not in files:
                    fs, at = open_fs(row["data"])
                    files[row["data"]] = fs.open_input_file(at)
                f = files[row["data"]]
                f.seek(row["offset"] + _HEAD_SIZE)
                got.append(unpack(f.read(row["length"] - _HEAD_SIZE), row["width"], row["data"]))
            for f in files.values():
                f.close()
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in got], pa.int64()), pa.array([x for _, x in got], pa.binary())],
                                             names=["doc_id", "ids"])

    index = _spread(manifest.select("data", "index", "width")).mapInArrow(
        entries, "data string, width int, offset bigint, length bigint")
    order = F.xxhash64(F.lit(seed), "data", "offset")
    return index.repartitionByRange(order).sortWithinPartitions(order).mapInArrow(fetch, "doc_id bigint, ids binary")


def digest(records: DataFrame) -> DataFrame:
    """n_tokens and CRC-32 of the id bytes of every record."""
    return records.select("doc_id", "start", (F.length("ids") / 4).cast("bigint").alias("n_tokens"),
                          F.crc32("ids").alias("ids_crc32"))


def op7_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = write_records(docs, new_path(spark, "records"), public_tokenizers.path("byte_bpe_50k.json"))
    return digest(read_records(manifest))

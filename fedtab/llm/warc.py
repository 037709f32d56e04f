"""WARC archives as a Python data source, and a writer with revisit records.

``spark.read.format("warc").load(folder)`` plans partitions of whole files, takes predicates on record type and
header columns down to the parser, reads the header block of a record first and skips the block of a record
that they rule out, or whose payload is not asked for (a read schema without ``payload``), by seeking in plain
files and by discarding in gzip files (one member a record). ``df.write.format("warc").save(folder)`` writes
one series of files a task; the commit lists the files of the tasks that succeeded in a ``_files-*.json`` of its
own and only the files of all listings are read, so repeated tasks do no harm. Append adds a listing (the first one also
lists archives of other origin that it finds); overwrite writes one that replaces those before it and then deletes
them and their files. The folder must be shared by all executors.

Predicate pushdown of Python data sources is a setting of Spark, off by default; ``register`` turns it on.

Defined results: null html is the empty payload; a null page_id sorts after every other and reads back as
null; of repeated rows one is the response; an empty table gives an empty archive and no rows. Line breaks in a
url are percent-encoded in its header.
"""

from __future__ import annotations

import gzip
import io
import json
import re
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, In,
                                    InputPartition, IsNotNull, IsNull, Not, StringContains, StringEndsWith, StringStartsWith,
                                    WriterCommitMessage)

from fedtab.functions.common import new_path, stage
from fedtab.llm.exact import BROADCAST_KEYS, located
from fedtab.llm.records import open_fs

#: Column by header.
HEADERS = {"warc_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "date": "WARC-Date",
           "content_type": "Content-Type", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To",
           "payload_length": "X-Payload-Length"}
SCHEMA = ", ".join(f"{c} string" for c in HEADERS) + ", payload binary"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
LISTING = re.compile(r"_files(-[0-9a-f]{32})?\.json")
PART = re.compile(r"part-[0-9a-f]{32}\.warc(\.gz)?")
ARCHIVES = (".warc", ".warc.gz")
FILE_BYTES = 256 << 20
PARTITION_BYTES = 32 << 20
BATCH_BYTES = 4 << 20
LEAST_REVISITED = 100


@dataclass
class Files(InputPartition):
    paths: list[str]


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


def _predicate(f: Filter) -> tuple[str, Callable] | None:
    """Column and test of a filter that header values decide, else None."""
    negate = isinstance(f, Not)
    inner = f.child if negate else f
    path = getattr(inner, "attribute", ())
    if len(path) != 1 or path[0] not in HEADERS:
        return None
    value = getattr(inner, "value", None)
    # Never null, also where the header is missing.
    plain = {EqualNullSafe: lambda v: v == value, IsNull: lambda v: v is None, IsNotNull: lambda v: v is not None}.get(type(inner))
    if plain is not None:
        return path[0], (lambda v: not plain(v)) if negate else plain
    if value is None or isinstance(inner, In) and None in value:  # null in place of false: left to Spark
        return None
    test = {EqualTo: lambda v: v == value, In: lambda v: v in value, StringStartsWith: lambda v: v.startswith(value),
            StringEndsWith: lambda v: v.endswith(value), StringContains: lambda v: value in v}.get(type(inner))
    if test is None:
        return None
    return path[0], lambda v: v is not None and test(v) != negate  # of null, NOT is null as well


def _listings(fs: pafs.FileSystem, at: str, names: Iterable[str]) -> dict[str, list[str]]:
    """Files by listing that no other one replaces."""
    found, replaced = {}, set()
    for n in names:
        if LISTING.fullmatch(n):
            with fs.open_input_stream(f"{at}/{n}") as f:
                got = json.loads(f.read())
            found[n] = got["files"] if isinstance(got, dict) else got
            replaced.update(got["replaces"] if isinstance(got, dict) else ())
    return {n: files for n, files in found.items() if n not in replaced}


def parse(stream: io.BufferedIOBase, wanted: Callable[[dict[str, str]], bool], with_payload: bool) -> Iterator[tuple[dict, bytes | None]]:
    """Headers and payload of the records whose headers are wanted; other blocks are passed over unread."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:60]!r}")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        size = int(headers.get("content-length", 0))
        if not wanted(headers) or not with_payload:
            stream.seek(size, io.SEEK_CUR)
            if wanted(headers):
                yield headers, None
            continue
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("a WARC record is cut short")
        if headers.get("content-type", "").startswith("application/http"):
            block = block.partition(b"\r\n\r\n")[2]
        yield headers, block


class WarcReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.columns = schema.fieldNames()
        self.folder = options["path"]
        self.target = int(options.get("partitionbytes", PARTITION_BYTES))
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if _predicate(f) is None:
                yield f
            else:
                self.filters.append(f)

    def partitions(self) -> Sequence[Files]:
        """Whole files, small ones together."""
        fs, at = open_fs(self.folder)
        infos = {x.base_name: x for x in fs.get_file_info(pafs.FileSelector(at)) if x.is_file}
        if listings := _listings(fs, at, infos):
            names = sorted({n for files in listings.values() for n in files})
        else:
            names = sorted(n for n in infos if n.endswith(ARCHIVES))
        out, size = [Files([])], 0
        for n in names:
            if out[-1].paths and size + infos[n].size > self.target:
                out.append(Files([]))
                size = 0
            out[-1].paths.append(f"{self.folder}/{n}")
            size += infos[n].size
        return out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        tests = [(HEADERS[c].lower(), t) for c, t in map(_predicate, self.filters)]
        kinds = [pa.binary() if c == "payload" else pa.string() for c in self.columns]

        def wanted(headers: dict[str, str]) -> bool:
            return all(t(headers.get(h)) for h, t in tests)

        rows: list[tuple] = []
        held = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=self.columns)

        for path in partition.paths:
            fs, at = open_fs(path)
            with fs.open_input_file(at) as raw:
                stream = gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else io.BufferedReader(raw, 1 << 20)
                for headers, payload in parse(stream, wanted, "payload" in self.columns):
                    rows.append(tuple(payload if c == "payload" else headers.get(HEADERS[c].lower()) for c in self.columns))
                    held += 500 + len(payload or b"")
                    if held > BATCH_BYTES:
                        yield batch()
                        rows.clear()
                        held = 0
        if rows:
            yield batch()


def record(kind: str, headers: dict[str, str | None], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}"]
    lines += [f"{k}: {v}" for k, v in headers.items() if v is not None]
    lines += [f"Content-Length: {len(block)}", "", ""]
    return b"".join(("\r\n".join(lines).encode(), block, b"\r\n\r\n"))


def _one_line(value: str | None) -> str | None:
    return None if value is None else value.replace("\r", "%0D").replace("\n", "%0A")


class WarcWriter(DataSourceArrowWriter):
    """Writes rows of record_id, warc_type, target_uri, date, refers_to, payload_digest, payload_length, payload."""

    def __init__(self, options: dict, overwrite: bool):
        self.folder = options["path"]
        self.overwrite = overwrite
        self.gzip = options.get("compression", "gzip") == "gzip"
        self.limit = int(options.get("filebytes", FILE_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, at = open_fs(self.folder)
        fs.create_dir(at, recursive=True)
        pack = (lambda b: gzip.compress(b, 5, mtime=0)) if self.gzip else (lambda b: b)
        names: list[str] = []
        out, size = None, 0
        for batch in iterator:
            at_row = {n: batch.column(n) for n in batch.schema.names}
            for i in range(batch.num_rows):
                row = {n: c[i].as_py() for n, c in at_row.items()}
                if out is None or size > self.limit:
                    if out is not None:
                        out.close()
                    names.append(f"part-{uuid.uuid4().hex}.warc" + ".gz" * self.gzip)
                    out, size = fs.open_output_stream(f"{at}/{names[-1]}", compression=None, buffer_size=1 << 20), 0
                    info = b"software: fedtab\r\nformat: WARC File Format 1.1\r\n"
                    size += out.write(pack(record("warcinfo", {"WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": row.get("date"),
                                                               "Content-Type": "application/warc-fields"}, info))) or 0
                revisit = row["warc_type"] == "revisit"
                block = HTTP_HEAD + (b"" if revisit else row["payload"] or b"")
                data = pack(record(row["warc_type"], {
                    "WARC-Record-ID": row["record_id"], "WARC-Date": row.get("date"), "WARC-Target-URI": _one_line(row["target_uri"]),
                    "Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": row["payload_digest"],
                    "X-Payload-Length": row["payload_length"], "WARC-Profile": REVISIT_PROFILE if revisit else None,
                    "WARC-Refers-To": row["refers_to"]}, block))
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        fs, at = open_fs(self.folder)
        fs.create_dir(at, recursive=True)
        there = [x.base_name for x in fs.get_file_info(pafs.FileSelector(at)) if x.is_file]
        before, listings = _listings(fs, at, there), sorted(n for n in there if LISTING.fullmatch(n))
        other = [] if before else [n for n in there if n.endswith(ARCHIVES) and not PART.fullmatch(n)]
        files = [n for m in messages if m for n in m.names]
        listing = {"files": sorted(files if self.overwrite else files + other), "replaces": listings if self.overwrite else []}
        name = f"_files-{uuid.uuid4().hex}.json"
        with fs.open_output_stream(f"{at}/{name}.new", compression=None) as f:
            f.write(json.dumps(listing).encode())
        fs.move(f"{at}/{name}.new", f"{at}/{name}")
        if self.overwrite:  # the listing above settled it; what is left behind is not read
            for n in {n for old in before.values() for n in old}.union(other) & set(there):
                fs.delete_file(f"{at}/{n}")
            for n in listings:
                fs.delete_file(f"{at}/{n}")

    def abort(self, messages: list[Written | None]) -> None:
        """Without a listing nothing that the tasks left is a committed archive."""


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> WarcReader:
        return WarcReader(schema, self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def archive_rows(pages: DataFrame, date: str = "1970-01-01T00:00:00Z", least: int = LEAST_REVISITED, id_col: str = "page_id",
                 url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows for the writer. Of equal payloads of at least ``least`` bytes the one with the smallest identifier
    is the response. Which payloads repeat is settled on light rows; their number is checked before they are
    broadcast, beyond the bound they are joined by shuffle."""
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    pages = located(pages).select(F.col(id_col).cast("bigint").alias("id"), F.col(url_col).alias("target_uri"),
                                  payload.alias("payload"), "__file", "__row")
    pages = pages.withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload"))
    me = F.struct(F.col("id").isNull().alias("unknown"), "id", "__file", "__row")
    first = (pages.filter(F.col("size") >= least).groupBy("digest").agg(F.min(me).alias("first"), F.count(F.lit(1)).alias("n"))
             .filter("n > 1").select("digest", "first"))
    first = stage(first)
    if first.count() <= BROADCAST_KEYS:
        first = F.broadcast(first)
    revisit = F.col("first").isNotNull() & (me != F.col("first"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("unknown")), F.lit(">"))
    return pages.join(first, "digest", "left").select(
        urn(F.col("id")).alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("warc_type"), "target_uri",
        F.lit(date).alias("date"), F.when(revisit, urn(F.col("first.id"))).alias("refers_to"),
        F.concat(F.lit("sha256:"), "digest").alias("payload_digest"), F.col("size").cast("string").alias("payload_length"),
        F.when(~revisit, F.col("payload")).alias("payload"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the pages to an archive and reads it back. What a response holds is measured on its payload, what
    a revisit stands for is told by its header."""
    register(spark)
    folder = new_path(spark, "warc")
    archive_rows(spark.read.parquet(f"{sf_dir}/pages.parquet")).write.format("warc").mode("append").save(folder)
    back = spark.read.format("warc").load(folder).filter(F.col("warc_type").isin("response", "revisit"))
    revisit = F.col("warc_type") == "revisit"
    number = lambda c: F.regexp_extract(c, r"<urn:page:(-?\d+)>", 1).try_cast("bigint")
    return back.select(number("record_id").alias("page_id"),
                       F.when(revisit, F.col("payload_length").cast("bigint")).otherwise(F.octet_length("payload")).cast("bigint").alias("payload_bytes"),
                       F.when(revisit, F.substring("payload_digest", 8, 64)).otherwise(F.sha2("payload", 256)).alias("payload_digest"),
                       F.col("warc_type").alias("record_type"), number("refers_to").alias("refers_to"))


SQL = """
SELECT page_id, size::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN size >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN size >= 100 AND page_id > first THEN first END AS refers_to
FROM (SELECT page_id, strlen(coalesce(html, '')) AS size, sha256(coalesce(html, '')) AS digest,
             min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)"""

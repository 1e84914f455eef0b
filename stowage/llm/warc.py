"""WARC archives as a Spark data source.

``spark.read.format("stowage_warc")`` plans byte-balanced groups of archive
files as partitions. Filters on record_type, target_uri, record_id, page_id and
payload_digest are taken over by the reader: it parses the headers of a record
first, and inflates, decodes and returns a payload only if the record passes and
the query asks for payloads (option ``payload``). Skipped payloads of plain
archives are seeked over; those of gzip archives run through the inflater in
fixed-size blocks and are dropped.

Archives hold one gzip member per record. They are written by tasks under names
of their own, and a list of the names that were committed makes them part of the
archive; files of failed or repeated attempts are not on it. Files are opened
through pyarrow's file systems, so the folder may be in any store they reach.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    StringStartsWith,
    WriterCommitMessage,
)

#: Bytes of archive files that one partition reads together, and the block in which files are read.
PARTITION_BYTES, BLOCK = 32 << 20, 1 << 20
#: Payloads below so many bytes are always stored.
LEAST_REVISIT = 100
LIST = "_archive.json"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = (
    "page_id long, record_type string, record_id string, target_uri string, payload_digest string, payload_bytes long, "
    "refers_to long, payload binary"
)


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        if path.startswith("file:/") and not path.startswith("file://"):
            path = "file://" + path[5:]
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def record(
    page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, refers_to_uri: str | None,
    revisit: bool, size: int,
) -> bytes:
    """One WARC record: an HTTP response, or a revisit that keeps the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    clean = lambda s: (s or "").replace("\r", " ").replace("\n", " ")
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {digest}')}>",
        "WARC-Date: 2000-01-01T00:00:00Z", f"WARC-Target-URI: {clean(url)}", f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To-Target-URI: {clean(refers_to_uri)}"]
        if refers_to is not None:
            head.append(f"X-Refers-To-Page-Id: {refers_to}")
    block = http if revisit else http + payload
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    name: str | None
    size: int


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = _open(self.path)
        name, out = f"{uuid.uuid4().hex}.warc.gz", None
        for batch in iterator:
            for r in zip(*[batch.column(i).to_pylist() for i in range(batch.num_columns)], strict=True):
                page_id, url, payload, digest, refers_to, uri, revisit, size = r
                if out is None:
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                press = zlib.compressobj(6, zlib.DEFLATED, 31)
                out.write(press.compress(record(page_id, url, payload or b"", digest, refers_to, uri, revisit, size)) + press.flush())
        if out is None:
            return Written(None, 0)
        out.close()
        return Written(name, store.get_file_info(f"{root}/{name}").size)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _open(self.path)
        with store.open_output_stream(f"{root}/{LIST}") as f:
            f.write(json.dumps([[m.name, m.size] for m in messages if m and m.name]).encode())

    def abort(self, messages: list[Written | None]) -> None:
        store, root = _open(self.path)
        for m in messages:
            if m and m.name:
                store.delete_file(f"{root}/{m.name}")


class Stream:
    """Bytes of an archive file, inflated member by member, read in blocks."""

    def __init__(self, file, packed: bool):
        self.file, self.packed, self.held, self.ended = file, packed, bytearray(), False
        self.inflater = zlib.decompressobj(31) if packed else None
        self.rest = b""

    def _more(self) -> bool:
        if self.ended:
            return False
        if not self.packed:
            data = self.file.read(BLOCK)
            self.ended = not data
            self.held += data
            return bool(data)
        while True:
            data = self.rest or self.file.read(BLOCK)
            if not data:
                self.ended = True
                return False
            new = self.inflater.decompress(data, BLOCK)
            self.rest = self.inflater.unconsumed_tail
            if self.inflater.eof:
                self.rest, self.inflater = self.inflater.unused_data, zlib.decompressobj(31)
            if new:
                self.held += new
                return True

    def head(self) -> bytes | None:
        """The next record's header block, or None at the end."""
        looked = 0
        while (end := self.held.find(b"\r\n\r\n", max(0, looked - 3))) < 0:
            looked = len(self.held)
            if not self._more():
                return None
        out = bytes(self.held[:end])
        del self.held[: end + 4]
        return out

    def take(self, n: int) -> bytes:
        while len(self.held) < n and self._more():
            pass
        out = bytes(self.held[:n])
        del self.held[:n]
        return out

    def skip(self, n: int) -> None:
        while n > 0:
            if not self.held:
                if not self.packed:
                    self.file.seek(n, 1)
                    return
                if not self._more():
                    return
            gone = min(n, len(self.held))
            del self.held[:gone]
            n -= gone


def fields(head: bytes) -> dict[str, str]:
    """Header names in lower case, and values."""
    lines = head.decode("utf-8", "replace").replace("\r\n ", " ").replace("\r\n\t", " ").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


@dataclass
class Files(InputPartition):
    names: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool):
        self.path, self.payload = path, payload
        self.wanted: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]):
        """Take over equality, IN and prefix tests on header fields; hand back the others."""
        own = {"record_type", "target_uri", "record_id", "page_id", "payload_digest"}
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in own and isinstance(f, EqualTo):
                self.wanted.append((column, "in", {f.value}))
            elif column in own and isinstance(f, In):
                self.wanted.append((column, "in", set(f.value)))
            elif column in own and isinstance(f, StringStartsWith):
                self.wanted.append((column, "prefix", f.value))
            else:
                yield f

    def partitions(self) -> list[Files]:
        """Committed files in groups of about PARTITION_BYTES; without a list, all archive files of the folder."""
        store, root = _open(self.path)
        if store.get_file_info(f"{root}/{LIST}").type != fs.FileType.NotFound:
            with store.open_input_stream(f"{root}/{LIST}") as f:
                found = json.loads(f.read())
        else:
            infos = store.get_file_info(fs.FileSelector(root, recursive=True))
            found = [[i.path[len(root) :].lstrip("/"), i.size] for i in infos if i.path.endswith((".warc", ".warc.gz"))]
        groups, size = [], 0
        for name, n in sorted(found):
            if not groups or size + n > PARTITION_BYTES:
                groups.append([])
                size = 0
            groups[-1].append(name)
            size += n
        return [Files(g) for g in groups or [[]]]

    def passes(self, row: dict) -> bool:
        for column, how, value in self.wanted:
            have = row[column]
            if have is None or (how == "in" and have not in value) or (how == "prefix" and not have.startswith(value)):
                return False
        return True

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, root = _open(self.path)
        held, size = [], 0
        for name in partition.names:
            with store.open_input_file(f"{root}/{name}") as file:
                for row in self.records(Stream(file, name.endswith(".gz"))):
                    held.append(row)
                    size += len(row["payload"] or b"") + 200
                    if size > BLOCK * 4:
                        yield pa.RecordBatch.from_pylist(held, schema=_ARROW)
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=_ARROW)

    def records(self, stream: Stream) -> Iterator[dict]:
        while (head := stream.head()) is not None:
            f = fields(head.lstrip(b"\r\n"))
            length = int(f.get("content-length", 0))
            number = lambda k: int(f[k]) if f.get(k, "").lstrip("-").isdigit() else None
            row = {
                "page_id": number("x-page-id"), "record_type": f.get("warc-type"), "record_id": f.get("warc-record-id"),
                "target_uri": f.get("warc-target-uri"), "payload_digest": (f.get("warc-payload-digest") or "").partition(":")[2] or None,
                "refers_to": number("x-refers-to-page-id"), "payload_bytes": None, "payload": None,
            }
            if not self.passes(row):
                stream.skip(length)
            elif f.get("content-type", "").startswith("application/http") and length:
                before = len(http) + 4 if (http := stream.head()) is not None else 0
                inner = fields(http or b"")
                row["payload_bytes"] = int(inner.get("content-length", length - before))
                if self.payload and row["record_type"] == "response":
                    row["payload"] = stream.take(length - before)
                else:
                    stream.skip(length - before)
                yield row
            else:
                row["payload_bytes"] = length
                if self.payload:
                    row["payload"] = stream.take(length)
                else:
                    stream.skip(length)
                yield row
            # The blank lines after a record; the next header search starts behind them.
            stream.take(4)


_ARROW = pa.schema(
    [
        ("page_id", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()),
        ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary()),
    ]
)


class WarcSource(DataSource):
    """Options: path, payload ("true" to return payloads)."""

    @classmethod
    def name(cls) -> str:
        return "stowage_warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() == "true")

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        store, root = _open(self.options["path"])
        store.create_dir(root, recursive=True)
        return WarcWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def write_archives(pages: DataFrame, path: str) -> None:
    """Write a record per row of ``pages`` (page_id, url, html) into a new folder.

    A null html is the empty payload. Rows with equal payloads of at least
    LEAST_REVISIT bytes point to the smallest page_id among them: its rows are
    responses, all others revisits. If all their ids are null, all are
    responses. Only digests that occur more than once are joined back.
    """
    register(pages.sparkSession)
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    base = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"),
    )
    own = F.when(F.octet_length("payload") >= LEAST_REVISIT, F.col("digest"))
    shared = (
        base.select(own.alias("_digest"), "page_id", "url").filter("_digest IS NOT NULL")
        .groupBy("_digest").agg(F.count("*").alias("_n"), F.min("page_id").alias("_first"), F.min_by("url", "page_id").alias("_uri"))
        .filter("_n > 1").drop("_n")
    )
    joined = base.join(shared, own == F.col("_digest"), "left")
    revisit = F.coalesce(F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first")), F.lit(False))
    out = joined.select(
        "page_id", "url", F.when(revisit, F.lit(None)).otherwise(F.col("payload")).alias("payload"), "digest",
        F.when(revisit, F.col("_first")).alias("refers_to"), F.when(revisit, F.col("_uri")).alias("refers_to_uri"), revisit.alias("revisit"),
        F.octet_length("payload").cast("bigint").alias("size"),
    )
    out.write.format("stowage_warc").mode("append").option("path", path).save()


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of a folder of archives."""
    register(spark)
    return spark.read.format("stowage_warc").option("path", path).option("payload", str(payload).lower()).load()

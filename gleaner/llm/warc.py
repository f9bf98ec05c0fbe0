"""Web archives (WARC 1.1): a writer that stores equal payloads once, and a data source that reads them.

Writing is a Spark job: the records are strings, written by Spark's text writer with the record end as line separator,
so any file system and the usual commit protocol serve. Reading is a Python data source: it deals whole archive files out
to partitions by size, takes equality predicates on header columns, reads headers first and passes over the blocks of
records that the predicates rule out, or whose payload is not asked for, without decoding them.

Results for odd input: a null payload is an empty one; repeated rows give a record each; a row without an id has no source id;
of equal payloads the smallest id is the response (all rows that carry it), if no row has an id, all are; line ends in addresses
are percent-encoded; an empty table gives an archive without records; columns beyond the three named ones are not looked at.
"""

from __future__ import annotations

import gzip
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

END = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8" + END
SCHEMA = (
    "record_type string, record_id string, target_uri string, source_id string, refers_to string, payload_digest string, "
    "payload_length long, payload binary"
)
#: Header of each column.
HEADERS = {
    "record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "source_id": "source-id",
    "refers_to": "refers-to-source-id", "payload_digest": "warc-payload-digest", "payload_length": "payload-length",
}


def with_originals(rows: DataFrame, key: str, digest: str, length: str, min_bytes: int) -> DataFrame:
    """Adds ``original``: the smallest key among rows with the same digest, null for short payloads.

    The keys are aggregated per digest before they are shuffled, and rows come to their original by a join that adaptive
    execution can split, so a payload that a third of all pages share is no bottleneck.
    """
    first = (
        rows.where(F.col(length) >= min_bytes).groupBy(F.col(digest).alias("_digest")).agg(F.min(key).alias("original"), F.count("*").alias("_n"))
        .where("_n > 1").drop("_n")
    )
    return rows.join(first, (rows[digest] == first["_digest"]) & (rows[length] >= min_bytes), "left").drop("_digest")


def write_archive(df: DataFrame, path: str, key: str = "page_id", uri: str = "url", payload: str = "html",
                  min_bytes: int = 100, date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes a record per row below ``path``: ``response`` records, and ``revisit`` records without payload for copies."""
    body = F.coalesce(F.col(payload), F.lit("")).cast("string")
    rows = df.select(F.col(key).alias("key"), F.col(uri).alias("uri"), body.alias("body"))
    rows = rows.withColumn("digest", F.sha2(F.col("body").cast("binary"), 256)).withColumn("bytes", F.octet_length("body"))
    rows = with_originals(rows, "key", "digest", "bytes", min_bytes)
    revisit = F.col("original").isNotNull() & ~F.col("key").eqNullSafe(F.col("original"))
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"\r\n{name}: "), value), F.lit(""))
    safe = F.replace(F.replace(F.col("uri"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    block = F.when(revisit, F.lit(HTTP)).otherwise(F.concat(F.lit(HTTP), F.col("body")))
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        line("WARC-Record-ID", F.concat(F.lit("<urn:row:"), F.coalesce(F.col("key").cast("string"), F.lit("none")), F.lit(">"))),
        F.lit(f"\r\nWARC-Date: {date}"),
        line("WARC-Target-URI", safe),
        line("Source-ID", F.col("key").cast("string")),
        line("Refers-To-Source-ID", F.when(revisit, F.col("original").cast("string"))),
        line("WARC-Refers-To", F.when(revisit, F.concat(F.lit("<urn:row:"), F.col("original").cast("string"), F.lit(">")))),
        line("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        line("Payload-Length", F.col("bytes").cast("string")),
        F.lit("\r\nContent-Type: application/http;msgtype=response"),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(END), block,
    )
    rows.select(record.alias("value")).write.option("lineSep", END).option("compression", "gzip").text(path)


class Files(InputPartition):
    """Archive files that one task reads."""

    def __init__(self, paths: list[str]):
        super().__init__(paths)
        self.paths = paths


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))


class WarcReader(DataSourceReader):
    """Options: ``path`` (a file or folder), ``payload`` (false: headers only), ``partition_bytes`` (files per task by size)."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.partition_bytes = int(options.get("partition_bytes", 32 << 20))
        self.wanted: dict[str, set[str]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                values = f.value if isinstance(f, In) else [f.value]
                name = HEADERS[f.attribute[0]]
                own = {f"sha256:{v}" if name == "warc-payload-digest" else str(v) for v in values if v is not None}
                self.wanted[name] = self.wanted[name] & own if name in self.wanted else own
            else:
                yield f

    def partitions(self) -> list[Files]:
        system, path = _filesystem(self.path)
        info = system.get_file_info(path)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=True))
        files = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))
        parts, size = [[]], 0
        for name, n in files:
            if parts[-1] and size + n > self.partition_bytes:
                parts.append([])
                size = 0
            parts[-1].append(name)
            size += n
        return [Files(p) for p in parts]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = _filesystem(self.path)
        schema = pa.schema([(c, pa.string()) for c in list(HEADERS)[:-1]] + [("payload_length", pa.int64()), ("payload", pa.binary())])
        rows, size = [], 0
        for path in partition.paths:
            with system.open_input_file(path) as raw:
                stream = io.BufferedReader(gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else raw, 1 << 20)
                for row in records(stream, self.wanted, self.payload):
                    rows.append(row)
                    size += 500 + len(row["payload"] or b"")
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


def records(stream, wanted: dict[str, set[str]], payload: bool) -> Iterator[dict]:
    """Records of one archive whose headers have the wanted values; blocks of all others are passed over."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record begins here: {line[:40]!r}")
        headers = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.decode().partition(":")
            headers[name.strip().lower()] = value.strip()
        size = int(headers["content-length"])
        if any(headers.get(name) not in values for name, values in wanted.items()):
            _skip(stream, size)
            continue
        row = {c: headers.get(h) for c, h in HEADERS.items()}
        row["payload_digest"] = (row["payload_digest"] or "").removeprefix("sha256:") or None
        row["payload_length"] = int(row["payload_length"]) if row["payload_length"] else None
        row["payload"] = None
        if payload and row["record_type"] == "response":
            block = stream.read(size)
            http = headers.get("content-type", "").startswith("application/http")
            row["payload"] = block.partition(END.encode())[2] if http else block
        else:
            _skip(stream, size)
        yield row


def _skip(stream, size: int) -> None:
    """Passes over a block in bounded reads."""
    while size > 0:
        got = len(stream.read(min(size, 1 << 20)))
        if not got:
            raise ValueError("the archive ends within a record")
        size -= got


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)


def read_archive(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The records below ``path``; equality filters on header columns reach the reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").options(path=path, **options).load()

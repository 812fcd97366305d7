"""WARC archives: a writer on Spark's own text sink and a reader as a PySpark Python data source (operator 10).

Writing needs no Python on the executors: a record is one string, and CRLFCRLF, which ends each record of the format, is
the sink's line separator; so archives appear, like any output of Spark, whole or not at all, in any store it writes to.

Reading plans partitions by file. Predicates on record type and other headers are pushed into the reader, which parses a
record's headers first and seeks past the block of any record that they rule out; without option payload=true it
seeks past every body.
"""

from __future__ import annotations

import gzip
import io
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith

from .base import cut, ship

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = "\r\n\r\n"
#: Shared payloads up to which their table is broadcast.
BROADCAST_SHARED = 200_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Column of the source: the header that it holds.
HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "date": "warc-date", "target_uri": "warc-target-uri", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to", "content_type": "content-type"}
SCHEMA = "record_type string, record_id string, date string, target_uri string, payload_digest string, refers_to string, content_type string, content_length bigint, payload_length bigint, payload binary, file string, offset bigint"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in upper-case base 32: each 5 hexadecimal digits are 4 characters."""
    digits = F.sha1(payload)
    parts = []
    for k in range(0, 40, 5):
        group = F.conv(F.substring(digits, k + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            parts.append(F.substring(F.lit(ALPHABET), F.shiftright(group, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)))
    return F.concat(*parts)


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0) -> DataFrame:
    """Per row: id, url, payload, payload_bytes, payload_digest, refers_to (null for a response).

    Of rows whose payloads of at least `least` bytes are equal, those with the largest id are responses and the others
    revisit it; smaller payloads are responses. A null payload is empty. A row without an id revisits the others of its
    payload; rows without an id alone are responses.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    rows = rows.select("*", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"))
    # Partial aggregation meets a payload that many rows share before the shuffle; only shared ones are joined.
    shared = cut(rows.where(F.col("payload_bytes") >= least).groupBy("payload_digest", "payload_bytes").agg(F.max("id").alias("newest"), F.count("*").alias("n")).where("n > 1 AND newest IS NOT NULL").drop("n"))
    # Payloads are shuffled only where more are shared than a broadcast of some 20 MB holds.
    near = F.broadcast if shared.count() <= BROADCAST_SHARED else lambda x: x
    joined = rows.join(near(shared), ["payload_digest", "payload_bytes"], "left")
    older = F.col("newest").isNotNull() & ~F.col("id").eqNullSafe(F.col("newest"))
    return joined.select("id", "url", "payload", "payload_bytes", "payload_digest", F.when(older, F.col("newest")).alias("refers_to"))


def write_warc(records: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", prefix: str = "urn:page:", records_per_file: int = 50_000) -> None:
    """Write rows of plan_records() as archives below path. A revisit keeps the HTTP headers and omits the payload."""
    crlf = "\r\n"
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), F.regexp_replace(value, r"[\r\n]+", " "), F.lit(crlf))).otherwise(F.lit(""))
    urn = lambda c: F.concat(F.lit(f"<{prefix}"), c.cast("string"), F.lit(">"))
    first = F.col("refers_to").isNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{crlf}Content-Type: text/html; charset=utf-8{crlf}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    block = F.concat(http, F.when(first, F.col("payload")).otherwise(F.lit("")))
    record = F.concat(
        F.lit(f"WARC/1.1{crlf}"),
        line("WARC-Type", F.when(first, F.lit("response")).otherwise(F.lit("revisit"))),
        line("WARC-Record-ID", urn(F.col("id"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("WARC-Refers-To", urn(F.col("refers_to"))),
        line("WARC-Profile", F.when(~first, F.lit(PROFILE))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        F.lit("Content-Length: "),
        F.octet_length(block).cast("string"),
        F.lit(END),
        block,
    )
    records.select(record.alias("value")).write.mode("overwrite").option("lineSep", END).option("maxRecordsPerFile", records_per_file).text(path)


class Files(InputPartition):
    def __init__(self, files: list[str]):
        self.files = files


class WarcDataSource(DataSource):
    """spark.read.format("warc").load(path): options payload (false), splitBytes (33554432) of small files together."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options, schema.names)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]):
        self.path, self.columns = options["path"], columns
        self.want_payload = str(options.get("payload", "false")).lower() == "true"
        self.split = int(options.get("splitbytes", options.get("splitBytes", 32 << 20)))
        self.held: list[tuple[str, str, Any]] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name not in HEADERS:
                yield f
            elif isinstance(f, EqualTo):
                self.held.append((HEADERS[name], "in", (f.value,)))
            elif isinstance(f, In):
                self.held.append((HEADERS[name], "in", tuple(f.value)))
            elif isinstance(f, StringStartsWith):
                self.held.append((HEADERS[name], "starts", f.value))
            elif isinstance(f, IsNotNull):
                self.held.append((HEADERS[name], "there", None))
            else:
                yield f

    def partitions(self) -> list[Files]:
        store, path = filesystem(self.path)
        info = store.get_file_info(path)
        infos = [info] if info.type == pafs.FileType.File else store.get_file_info(pafs.FileSelector(path, recursive=True))
        sized = sorted((i.size, i.path) for i in infos if i.type == pafs.FileType.File and i.size and i.base_name[0] not in "_.")
        plans, total = [], 0
        for size, name in sized:
            if not plans or total + size > self.split:
                plans.append([])
                total = 0
            plans[-1].append(name)
            total += size
        return [Files(x) for x in plans] or [Files([])]

    def wanted(self, headers: dict[str, str]) -> bool:
        for name, how, value in self.held:
            own = clean(name, headers.get(name))
            if own is None or how == "in" and own not in value or how == "starts" and not own.startswith(value):
                return False
        return True

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = filesystem(self.path)
        rows: list[tuple] = []
        held = 0
        for name in partition.files:
            with opened(store, name) as f:
                for row in self.records(f, name):
                    rows.append(row)
                    held += 400 + len(row[9] or b"")
                    if held > 8 << 20:
                        yield self.batch(rows)
                        rows, held = [], 0
        if rows:
            yield self.batch(rows)

    def batch(self, rows: list[tuple]) -> pa.RecordBatch:
        names = [x.split(" ")[0] for x in SCHEMA.split(", ")]
        kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
        columns = {n: pa.array(c, kinds[x.split(" ")[1]]) for n, x, c in zip(names, SCHEMA.split(", "), zip(*rows, strict=True), strict=True)}
        return pa.RecordBatch.from_arrays([columns[n] for n in self.columns], self.columns)

    def records(self, f: io.BufferedIOBase, name: str) -> Iterator[tuple]:
        while True:
            at = f.tell()
            line = f.readline()
            if not line:
                return
            if line in (b"\r\n", b"\n"):
                continue  # between records
            if not line.startswith(b"WARC/"):
                raise ValueError(f"{name}: no record at byte {at}")
            headers = header_lines(f)
            length = int(headers.get("content-length", 0))
            if not self.wanted(headers):
                f.seek(length, io.SEEK_CUR)
                continue
            size, payload = length, None
            if headers.get("content-type", "").startswith("application/http"):
                start = f.tell()
                f.readline()
                http = header_lines(f)
                rest = length - (f.tell() - start)
                size = int(http.get("content-length", rest))
            else:
                rest = length
            if self.want_payload:
                payload = f.read(rest)
            else:
                f.seek(rest, io.SEEK_CUR)
            yield (*(clean(h, headers.get(h)) for h in HEADERS.values()), length, size, payload, name, at)


def clean(name: str, value: str | None) -> str | None:
    """A header's value as the columns have it: ids without angle brackets, digests without the algorithm's name."""
    if value is None:
        return None
    if name in ("warc-record-id", "warc-refers-to"):
        return value.strip("<>")
    return value.removeprefix("sha1:") if name == "warc-payload-digest" else value


def header_lines(f: io.BufferedIOBase) -> dict[str, str]:
    out: dict[str, str] = {}
    last = None
    while (line := f.readline()) not in (b"\r\n", b"\n", b""):
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[:1] in (" ", "\t") and last:
            out[last] += " " + text.strip()  # a folded line
        else:
            last, _, value = text.partition(":")
            last = last.strip().lower()
            out[last] = value.strip()
    return out


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    if re.match(r"file:/", path):
        path = "/" + path[5:].lstrip("/")
    if path.startswith("/"):
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(path)


def opened(store: pafs.FileSystem, name: str):
    raw = open(name, "rb") if isinstance(store, pafs.LocalFileSystem) else io.BufferedReader(store.open_input_file(name), 1 << 20)  # noqa: SIM115
    return gzip.GzipFile(fileobj=raw) if name.endswith(".gz") else raw


def read_warc(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    ship(spark)
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def archive(pages: DataFrame, path: str, least: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", prefix: str = "urn:page:") -> DataFrame:
    """Write a record for each row below path, read the archives back, and return of each: page_id, payload_bytes,
    payload_digest, record_type, refers_to, target_uri.

    Of a response, bytes and digest are those of the payload read back; of a revisit, those that its headers keep of the
    full payload. An empty table gives an empty result; repeated rows give a record each; other columns are not read.
    """
    write_warc(plan_records(pages, id_col, url_col, payload_col, least), path, prefix=prefix)
    spark, kind = pages.sparkSession, pages.schema[id_col].dataType.simpleString()
    number = lambda c: F.expr(f"substring({c}, {len(prefix) + 1})").cast(kind)
    same = [F.lit(None).cast(kind).alias("refers_to"), "target_uri"]
    responses = read_warc(spark, path, True).where("record_type = 'response'").select(number("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"), "record_type", *same)
    revisits = read_warc(spark, path).where("record_type = 'revisit'").select(number("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type", number("refers_to").alias("refers_to"), "target_uri")
    return responses.unionByName(revisits)

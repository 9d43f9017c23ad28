"""WARC 1.1 archives as a PySpark Python data source ("warc"), read and write.

Reading plans partitions over files, parses a record's headers first, and decodes a payload only if the record passes
the filters pushed down (record type and header columns: equality, IN, prefix, null tests) and payloads are wanted
(option ``payload``). Plain files are skipped over by seeking, gzip members by inflating without keeping. Writing makes
one gzip-membered file a task and publishes the files of successful tasks in a manifest, so retried, speculative or
lost tasks leave nothing that is read.

``archive`` writes each page as a response, or as a revisit of the page with the smallest id and the same payload.
Null html is an empty payload, null urls and ids are left out of the headers, pages with a null id revisit but are never
revisited, repeated rows of one id are all responses; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import datasource as ds

from .common import joined, materialise, work_dir

#: Payloads shorter than this are stored again rather than revisited.
LEAST_REVISIT = 100
#: Digests (about 100 bytes each) that may be broadcast to mark revisits; more are joined by a shuffle.
BROADCAST_DIGESTS = 100_000
#: Bytes of archives a read partition.
PARTITION_BYTES = 64 << 20
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

COLUMNS = "record_id string, record_type string, target_uri string, date string, refers_to string, payload_digest string, content_length bigint, http_length bigint, headers map<string,string>, payload binary"
#: Columns that come straight from a header.
HEADER_OF = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}
MANIFEST = "_committed.json"


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def passes(headers: dict[str, str], filters: list[tuple]) -> bool:
    for kind, column, value in filters:
        x = headers.get(HEADER_OF[column])
        if kind == "null":
            ok = (x is None) == value
        elif x is None:
            ok = False
        else:
            ok = x == value if kind == "eq" else x in value if kind == "in" else x.startswith(value)
        if not ok:
            return False
    return True


class _Plain:
    """Bytes of an uncompressed archive; unwanted ones are skipped by seeking."""

    def __init__(self, file):
        self.file, self.buffer = file, b""

    def header(self) -> bytes | None:
        while (end := self.buffer.find(b"\r\n\r\n")) < 0 or not self.buffer.lstrip(b"\r\n"):
            more = self.file.read(1 << 16)
            if not more:
                return None
            self.buffer = self.buffer.lstrip(b"\r\n") + more if not self.buffer.strip(b"\r\n") else self.buffer + more
        head = self.buffer.lstrip(b"\r\n")
        end = head.find(b"\r\n\r\n")
        if end < 0:
            self.buffer = head
            return self.header()
        self.buffer = head[end + 4 :]
        return head[:end]

    def body(self, n: int) -> bytes:
        out = self.buffer[:n]
        self.buffer = self.buffer[n:]
        return out + self.file.read(n - len(out)) if len(out) < n else out

    def skip(self, n: int) -> None:
        held = min(n, len(self.buffer))
        self.buffer = self.buffer[held:]
        if n > held:
            self.file.seek(self.file.tell() + n - held)


class _Gzip:
    """One gzip member a record; an unwanted payload is inflated in pieces and dropped."""

    def __init__(self, file):
        self.file, self.raw, self.member, self.text = file, b"", None, b""

    def _more(self) -> bool:
        """Inflate a piece into ``text``; False at the end of the member."""
        if self.member.eof:
            return False
        data = self.member.unconsumed_tail or self.raw or self.file.read(1 << 16)
        if not data:
            return False
        self.raw = b""
        self.text += self.member.decompress(data, 1 << 18)
        if self.member.eof:
            self.raw = self.member.unused_data
        return True

    def header(self) -> bytes | None:
        if self.member is not None:
            while self._more():
                self.text = b""
        self.raw = self.raw or self.file.read(1 << 16)
        if not self.raw:
            return None
        self.member, self.text = zlib.decompressobj(31), b""
        while (end := self.text.find(b"\r\n\r\n")) < 0:
            if not self._more():
                return None
        head, self.text = self.text[:end], self.text[end + 4 :]
        return head

    def body(self, n: int) -> bytes:
        pieces, have = [self.text], len(self.text)
        self.text = b""
        while have < n and self._more():
            pieces.append(self.text)
            have += len(self.text)
            self.text = b""
        return b"".join(pieces)[:n]

    def skip(self, n: int) -> None:
        self.text = b""


def parse_headers(head: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        out[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return out


def records(stream, filters: list[tuple], payload: bool) -> Iterator[tuple]:
    """Rows of an open archive: headers first, then the block of records that pass."""
    while (head := stream.header()) is not None:
        headers = parse_headers(head)
        length = int(headers.get("content-length", 0))
        if not passes(headers, filters):
            stream.skip(length)
            continue
        body = http = None
        is_http = headers.get("content-type", "").startswith("application/http")
        if payload or is_http and headers.get("warc-type") == "revisit":
            body = stream.body(length)
            if is_http:
                http_head, _, body = body.partition(b"\r\n\r\n")
                http = int(parse_headers(http_head).get("content-length", len(body)))
            if headers.get("warc-type") == "revisit" or not payload:
                body = None
        else:
            stream.skip(length)
        yield (*(headers.get(h) for h in HEADER_OF.values()), length, http, headers, body)


class WarcDataSource(ds.DataSource):
    """format("warc"): options ``path`` (a folder or file) and ``payload`` ("false" leaves payloads out)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema) -> ds.DataSourceReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> ds.DataSourceWriter:
        return WarcWriter(self.options, overwrite)


class WarcFiles(ds.InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class WarcReader(ds.DataSourceReader):
    def __init__(self, options):
        self.path, self.payload, self.filters = options["path"], str(options.get("payload", "true")).lower() != "false", []

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column not in HEADER_OF:
                yield f
            elif isinstance(f, ds.EqualTo) and isinstance(f.value, str):
                self.filters.append(("eq", column, f.value))
            elif isinstance(f, ds.In) and all(isinstance(v, str) for v in f.value):
                self.filters.append(("in", column, tuple(f.value)))
            elif isinstance(f, ds.StringStartsWith):
                self.filters.append(("prefix", column, f.value))
            elif isinstance(f, (ds.IsNull, ds.IsNotNull)):
                self.filters.append(("null", column, isinstance(f, ds.IsNull)))
            else:
                yield f

    def partitions(self) -> list[WarcFiles]:
        """Files of the manifest (or all archives of the folder), put together up to PARTITION_BYTES."""
        store, path = _filesystem(self.path)
        info = store.get_file_info(path)
        if info.type == fs.FileType.File:
            found = [info]
        else:
            found = [x for x in store.get_file_info(fs.FileSelector(path, recursive=True)) if x.path.endswith((".warc", ".warc.gz"))]
            if store.get_file_info(f"{path}/{MANIFEST}").type == fs.FileType.File:
                with store.open_input_stream(f"{path}/{MANIFEST}") as f:
                    committed = set(json.loads(f.read()))
                found = [x for x in found if x.base_name in committed]
        out, held, size = [], [], 0
        for x in sorted(found, key=lambda x: -x.size):
            if held and size + x.size > PARTITION_BYTES:
                out.append(WarcFiles(held))
                held, size = [], 0
            held.append(x.path)
            size += x.size
        return [*out, WarcFiles(held)] if held else out or [WarcFiles([])]

    def read(self, partition: WarcFiles) -> Iterator[tuple]:
        store, _ = _filesystem(self.path)
        for path in partition.paths:
            with store.open_input_file(path) as f:
                yield from records(_Gzip(f) if path.endswith(".gz") else _Plain(f), self.filters, self.payload)


class WarcCommit(ds.WriterCommitMessage):
    def __init__(self, file: str | None):
        self.file = file


def record_bytes(record_id: str | None, record_type: str, target_uri: str | None, refers_to: str | None, digest: str, payload: bytes, date: str, level: int = 1) -> bytes:
    """One record as a gzip member; a revisit keeps the HTTP headers, with the full payload's length, and no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if record_type == "revisit" else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: {record_id or f'<urn:uuid:{uuid.uuid4()}>'}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha256:{digest}"]
    if target_uri is not None:
        lines.append("WARC-Target-URI: " + target_uri.replace("\r", "%0D").replace("\n", "%0A"))
    if record_type == "revisit":
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {refers_to}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    member = zlib.compressobj(level, zlib.DEFLATED, 31)
    return member.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n") + member.flush()


class WarcWriter(ds.DataSourceArrowWriter):
    """Rows need record_id, record_type, target_uri, refers_to, payload_digest (hex) and payload."""

    def __init__(self, options, overwrite: bool):
        self.path = options["path"]
        if overwrite:
            store, path = _filesystem(self.path)
            if store.get_file_info(path).type != fs.FileType.NotFound:
                store.delete_dir_contents(path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WarcCommit:
        store, path = _filesystem(self.path)
        file, out = f"part-{uuid.uuid4().hex}.warc.gz", None
        date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
        for batch in iterator:
            if out is None:
                store.create_dir(path, recursive=True)
                out = store.open_output_stream(f"{path}/{file}", compression=None)
            for row in zip(*(batch.column(c).to_pylist() for c in ("record_id", "record_type", "target_uri", "refers_to", "payload_digest", "payload"))):
                out.write(record_bytes(*row, date))
        if out is None:
            return WarcCommit(None)
        out.close()
        return WarcCommit(file)

    def commit(self, messages: list[WarcCommit | None]) -> None:
        store, path = _filesystem(self.path)
        store.create_dir(path, recursive=True)
        committed = []
        if store.get_file_info(f"{path}/{MANIFEST}").type == fs.FileType.File:
            with store.open_input_stream(f"{path}/{MANIFEST}") as f:
                committed = json.loads(f.read())
        with store.open_output_stream(f"{path}/{MANIFEST}") as f:
            f.write(json.dumps(committed + [m.file for m in messages if m and m.file]).encode())

    def abort(self, messages: list[WarcCommit | None]) -> None:
        store, path = _filesystem(self.path)
        for m in messages:
            if m and m.file and store.get_file_info(f"{path}/{m.file}").type == fs.FileType.File:
                store.delete_file(f"{path}/{m.file}")


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def archive(pages: DataFrame, path: str, least_revisit: int = LEAST_REVISIT) -> None:
    """Write pages (page_id, url, html) as response and revisit records."""
    register(pages.sparkSession)
    p = pages.select("page_id", F.col("url").alias("target_uri"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload")).withColumn("payload_digest", F.sha2("payload", 256))
    shared = p.where(F.length("payload") >= least_revisit).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("c")).where("c > 1 and first is not null")
    shared = materialise(shared, "digests")
    if shared.count() <= BROADCAST_DIGESTS:
        p = p.join(F.broadcast(shared.drop("c")), "payload_digest", "left")
    else:  # the digests' groups meet without payloads; payloads travel by page, of which none is frequent
        of = joined(p.select("page_id", "payload_digest"), shared, "payload_digest").distinct()
        of = of.select(F.col("page_id").alias("_page"), F.col("payload_digest").alias("_digest"), "first")
        p = p.join(of, p["page_id"].eqNullSafe(of["_page"]) & (p["payload_digest"] == of["_digest"]), "left").drop("_page", "_digest")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.col(c).cast("string"), F.lit(">"))
    rows = p.select(urn("page_id").alias("record_id"), F.when(again, "revisit").otherwise("response").alias("record_type"), "target_uri", F.when(again, urn("first")).alias("refers_to"), "payload_digest", "payload")
    rows.write.format("warc").mode("append").save(path)


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and url of every record; responses' digests are taken anew."""
    register(spark)
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1)
    number = lambda c: F.when(page(c) != "", page(c).cast("bigint"))
    r = spark.read.format("warc").load(path).where(F.col("record_type").isin("response", "revisit"))
    response = F.col("record_type") == "response"
    return r.select(
        number("record_id").alias("page_id"), F.when(response, F.length("payload").cast("bigint")).otherwise(F.col("http_length")).alias("payload_bytes"),
        F.when(response, F.sha2("payload", 256)).otherwise(F.regexp_extract("payload_digest", "^sha256:([0-9a-f]+)$", 1)).alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"), F.col("target_uri").alias("url"),
    )


def op1(pages: DataFrame) -> DataFrame:
    path = work_dir(pages.sparkSession) + "/warc"
    archive(pages, path)
    return read_back(pages.sparkSession, path)


ORACLE = """
with p as (select page_id, url, coalesce(html, '') as h, strlen(coalesce(html, '')) as n, sha256(coalesce(html, '')) as d from pages),
f as (select d, min(page_id) as first from p where n >= 100 group by d having count(*) > 1)
select page_id, n::bigint as payload_bytes, d as payload_digest, case when first is not null and page_id is distinct from first then 'revisit' else 'response' end as record_type,
case when first is not null and page_id is distinct from first then first end as refers_to, url
from p left join f using (d)
"""

"""WARC archives: a writer over Spark's text sink and a Python data source that reads them.

The reader plans partitions of whole files (small files together), takes equality and IN
predicates on header columns, parses a record's headers first and steps over the block of a
record that no predicate keeps, or whose payload isn't asked for, without decoding it.
"""

from __future__ import annotations

import gzip
import os
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from .common import columns_of, shared_path, table

SCHEMA = "record_id string, record_type string, target_uri string, date string, content_type string, payload_digest string, refers_to string, payload_bytes long, headers map<string,string>, payload binary"
#: Column → header, for those that are one header as it stands.
_HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date", "content_type": "content-type", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
_ARROW = pa.schema([*((c, pa.string()) for c in _HEADERS), ("payload_bytes", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])
_BATCH_BYTES = 4 << 20
_PLAN_BYTES = 16 << 20
_COPY = 1 << 20


def _opened(path: str):
    """(file system, path) for pyarrow; local paths and file: URIs need none."""
    parsed = urlparse(path)
    if parsed.scheme in ("", "file"):
        return None, unquote(parsed.path) if parsed.scheme else path
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _listed(path: str) -> list[tuple[str, int]]:
    system, place = _opened(path)
    keep = lambda name: not name.startswith(("_", "."))
    if system is None:
        if os.path.isfile(place):
            return [(path, os.path.getsize(place))]
        found = [os.path.join(folder, name) for folder, _, names in os.walk(place) for name in names if keep(name)]
        return sorted((p, os.path.getsize(p)) for p in found)
    from pyarrow import fs

    parsed = urlparse(path)
    # Object stores name the bucket in the path that pyarrow gives, other file systems name the host beside it.
    root = f"{parsed.scheme}://" if place.lstrip("/").startswith(parsed.netloc) and parsed.netloc else f"{parsed.scheme}://{parsed.netloc}/"
    found = system.get_file_info(fs.FileSelector(place, recursive=True)) if system.get_file_info(place).type == fs.FileType.Directory else [system.get_file_info(place)]
    return sorted((f"{root}{f.path.lstrip('/')}", f.size) for f in found if f.is_file and keep(f.base_name))


def _stream(path: str):
    system, place = _opened(path)
    raw = open(place, "rb") if system is None else system.open_input_stream(place, compression=None)
    return gzip.open(raw, "rb") if path.endswith(".gz") else raw


def _skip(stream, n: int) -> None:
    while n > 0:
        got = len(stream.read(min(n, _COPY)))
        if not got:
            raise EOFError("a WARC record ends before its Content-Length")
        n -= got


def records(stream, wanted, payload: bool) -> Iterator[tuple[dict[str, str], dict[str, str], bytes | None]]:
    """(WARC headers, HTTP headers, payload or None) of the records whose headers `wanted` accepts."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers = _headers(stream)
        length = int(headers.get("content-length", "0"))
        if not wanted(headers):
            _skip(stream, length)
            continue
        http: dict[str, str] = {}
        at = 0
        if headers.get("content-type", "").startswith("application/http"):
            status = stream.readline()
            http, used = _headers(stream, counted=True)
            at = len(status) + used
        if payload:
            body = stream.read(length - at)
            yield headers, http, body
        else:
            _skip(stream, length - at)
            yield headers, http, None


def _headers(stream, counted: bool = False):
    out, used, last = {}, 0, None
    for line in iter(stream.readline, b""):
        used += len(line)
        if line in (b"\r\n", b"\n"):
            break
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[:1] in " \t" and last:
            out[last] += f" {text.strip()}"
            continue
        last, _, value = text.partition(":")
        last = last.strip().lower()
        out[last] = value.strip()
    return (out, used) if counted else out


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.tests: list[tuple[str, tuple]] = []

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if column in _HEADERS:
                self.tests.append((_HEADERS[column], tuple(f.value) if isinstance(f, In) else (f.value,)))
            else:
                yield f

    def partitions(self):
        out, size = [[]], 0
        for path, n in _listed(self.path):
            if out[-1] and size + n > _PLAN_BYTES:
                out.append([])
                size = 0
            out[-1].append(path)
            size += n
        return [Files(p) for p in out]

    def read(self, partition):
        keep = lambda h: all(h.get(name) in values for name, values in self.tests)
        rows, size = [], 0
        for path in partition.paths:
            with _stream(path) as stream:
                for headers, http, body in records(stream, keep, self.payload):
                    long = int(http["content-length"]) if "content-length" in http else int(headers.get("content-length", "0")) if not http else None
                    rows.append((*(headers.get(h) for h in _HEADERS.values()), long, list(headers.items()), body))
                    size += len(body or b"") + 500
                    if size > _BATCH_BYTES:
                        yield _batch(rows)
                        rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


class WarcDataSource(DataSource):
    """spark.read.format("warc").option("payload", "false").load(folder)"""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # without it Spark refuses a source that takes filters
    spark.dataSource.register(WarcDataSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def _once(value, use):
    """use(value), with value evaluated once a row: in a branch or a filter Spark evaluates it at each mention."""
    return F.transform(F.array(value), use)[0]


def base32(digits):
    """Base32 of a column of 40 hex digits, in built-in functions."""
    alphabet = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    letters = lambda v: F.concat(*[F.substring(alphabet, F.shiftright(v, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)])
    # 5 hex digits are 20 bits are 4 letters
    return F.concat(*[_once(F.conv(F.substring(digits, 5 * g + 1, 5), 16, 10).cast("int"), letters) for g in range(8)])


def base32_sha1(binary):
    """Bare upper-case base32 of the SHA-1 of a binary column, which is hashed once."""
    return _once(F.sha1(binary), base32)


#: Ways in which one payload's rows are dealt, so that a common payload doesn't fill one task.
SALTS = 16


def write_warc(pages: DataFrame, path: str, least: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """One record per row of (page_id, url, html), gzip-compressed.

    Of rows whose UTF-8 payloads are equal and of at least `least` bytes, those with the smallest
    page_id are responses and the rest revisit them; all others are responses. Null html is an
    empty payload, a null url an empty target; a null page_id is larger than any other. Line
    breaks in a url are percent-encoded.
    """
    rows = columns_of(pages, ["page_id", "url", "html"]).select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("n", F.octet_length("html").cast("long")).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    shared = rows.where(F.col("n") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("rows")).where("rows > 1")
    shared = shared.select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(shared, ["digest", "salt"], "left")
    revisit = (F.col("n") >= least) & F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    crlf = "\r\n"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{crlf}Content-Type: text/html; charset=utf-8{crlf}Content-Length: "), F.col("n"), F.lit(crlf + crlf))
    ident = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    head = F.concat(
        F.lit(f"WARC/1.1{crlf}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit(f"{crlf}WARC-Record-ID: "), ident("page_id"),
        F.lit(f"{crlf}WARC-Date: {date}{crlf}WARC-Target-URI: "), F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")),
        F.lit(f"{crlf}WARC-Payload-Digest: sha1:"), base32(F.col("digest")),
        F.when(revisit, F.concat(F.lit(f"{crlf}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{crlf}WARC-Refers-To: "), ident("first"))).otherwise(""),
        F.lit(f"{crlf}Content-Type: application/http; msgtype=response{crlf}Content-Length: "), F.octet_length("block"), F.lit(crlf + crlf),
    )
    out = rows.withColumn("block", block).select(F.concat(head, "block", F.lit(crlf)).alias("value"))
    out.write.option("lineSep", crlf).option("compression", "gzip").text(path)


def page_of(column: str):
    return F.regexp_extract(column, r"^<urn:x-page:(-?\d+)>$", 1)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the archives, then reads them back: a response's figures come from its payload, a revisit's from its headers."""
    path = shared_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    back = read_warc(spark, path).where(F.col("record_type").isin("response", "revisit"))
    held = F.col("record_type") == "response"
    number = lambda c: F.when(page_of(c) != "", page_of(c).try_cast("long"))
    return back.select(
        number("record_id").alias("page_id"),
        F.when(held, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(held, base32_sha1(F.col("payload"))).otherwise(F.regexp_replace("payload_digest", "^sha1:", "")).alias("payload_digest"),
        "record_type",
        F.when(~held, number("refers_to")).alias("refers_to"),
    )

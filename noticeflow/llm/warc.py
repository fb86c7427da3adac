"""WARC archives: a Spark writer, and a Python data source that reads them.

Writing.  Payloads are compared by their SHA-256.  Of those with equal payloads of at least
``min_bytes`` the one with the smallest id is a ``response``; the others are ``revisit``
records that refer to it and hold no payload.  Records are rows of text, cut by the CRLF
that ends a record, so Spark's own text writer makes the (gzip) archives: they go where the
path says, and survive lost executors by the usual commit.

Reading.  ``partitions()`` lists the archives and deals them, largest first, to partitions
of about equal size.  Equality and IN predicates on ``record_type`` and on the indexed
headers are pushed down: the reader parses the header block first, and where it fails, or
where no payload is asked for, the block is skipped by its length and never decoded.

Null payloads are empty.  Rows with equal ids and payloads keep one record each.  An empty
table gives an archive folder without records, which reads as an empty table.
"""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

SCHEMA = (
    "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, "
    "payload_bytes bigint, page_id bigint, block_bytes bigint, payload binary"
)
#: Columns that come from headers, and the header each comes from.
HEADERS = {
    "record_id": b"warc-record-id",
    "record_type": b"warc-type",
    "target_uri": b"warc-target-uri",
    "refers_to": b"warc-refers-to",
    "payload_digest": b"warc-payload-digest",
    "payload_bytes": b"x-payload-length",
    "page_id": b"x-page-id",
}
_LONGS = {"payload_bytes", "page_id"}
SALTS = 16


def with_revisits(pages: DataFrame, key: str, payload: Column, min_bytes: int) -> DataFrame:
    """``pages`` with _payload, _bytes, _digest and _first (the response's key for revisits).

    The least key of each digest is found by partial aggregation.  Rows meet it under
    salted digests, as narrow rows, so that no group of copies is one task's work; payloads
    are moved once, by their own key.
    """
    marked = (
        pages.withColumn("_payload", F.coalesce(payload.cast("binary"), F.lit("").cast("binary")))
        .withColumn("_bytes", F.octet_length("_payload").cast("long"))
        .withColumn("_digest", F.sha2("_payload", 256))
    )
    light = marked.where(F.col("_bytes") >= min_bytes).select(F.col(key).alias("_key"), F.col("_digest").alias("_sum"))
    copies = light.groupBy("_sum").agg(F.min("_key").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    spread = copies.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("_sum", "_own")
    salted = light.withColumn("_salt", F.pmod(F.xxhash64("_key"), F.lit(SALTS)).cast("int"))
    revisits = (
        salted.join(spread, (F.col("_sum") == F.col("_own")) & (salted["_salt"] == spread["_salt"]))
        .where(F.col("_key") != F.col("_first"))
        .select("_key", "_sum", "_first")
        .distinct()
    )
    return marked.join(revisits.hint("shuffle_hash"), (F.col(key) == F.col("_key")) & (F.col("_digest") == F.col("_sum")), "left").drop("_key", "_sum")


def _record_id(key: Column, digest: Column) -> Column:
    h = F.sha2(F.concat_ws("|", key.cast("string"), digest), 256)
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(F.substring(h, 1, 32), r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def records(pages: DataFrame, key: str = "page_id", url: str = "url", payload: Column | None = None, *, min_bytes: int = 100, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """One column ``value`` per row: a whole WARC record less its last CRLF."""
    body = payload if payload is not None else F.col("html")
    # Only these columns go on, so that no other column can clash with the helpers.
    pages = pages.select(F.col(key).alias("_id"), F.col(url).alias("_url"), body.alias("_body"))
    key, url = "_id", "_url"
    rows = with_revisits(pages, key, F.col("_body"), min_bytes)
    again = F.col("_first").isNotNull()
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise("")
    uri = F.regexp_replace(F.col(url), r"[\x00-\x20\x7f]", "%20")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("_bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.octet_length(http) + F.when(again, 0).otherwise(F.col("_bytes"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", _record_id(F.col(key), F.col("_digest"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", uri),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("_digest"))),
        line("WARC-Profile", F.when(again, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        line("WARC-Refers-To", F.when(again, _record_id(F.col("_first"), F.col("_digest")))),
        line("X-Refers-To-Page", F.col("_first").cast("string")),
        line("X-Page-ID", F.col(key).cast("string")),
        line("X-Payload-Length", F.col("_bytes").cast("string")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", block.cast("string")),
        F.lit("\r\n"),
        http,
    )
    empty = F.lit("").cast("binary")
    whole = F.concat(F.encode(head, "UTF-8"), F.when(again, empty).otherwise(F.col("_payload")), F.lit("\r\n").cast("binary"))
    return rows.select(whole.cast("string").alias("value"))


def write(pages: DataFrame, path: str, **options) -> None:
    """Archives of ``pages`` (see ``records``) in a new folder, gzip-compressed."""
    records(pages, **options).write.option("lineSep", "\r\n").option("compression", "gzip").text(path)


class _Files(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if re.match(r"\w+:", path) else f"file://{path}")


class WarcReader(DataSourceReader):
    """Reads the archives of a folder; see the module's text."""

    def __init__(self, options) -> None:
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() != "false"
        self.size = int(options.get("partitionbytes", 64 << 20))
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else ""
            if name in HEADERS and isinstance(f, EqualTo | In):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[name] = self.wanted.get(name, values) & values
            else:
                yield f

    def partitions(self) -> list[_Files]:
        from pyarrow import fs

        system, base = _filesystem(self.path)
        found = system.get_file_info(fs.FileSelector(base, recursive=True))
        files = sorted((f for f in found if f.is_file and not re.search(r"(^|/)[._][^/]*$", f.path) and f.size), key=lambda f: (-f.size, f.path))
        total = sum(f.size for f in files)
        bins: list[list] = [[0, []] for _ in range(max(1, min(len(files), -(-total // self.size))))]
        for f in files:
            least = min(bins, key=lambda b: b[0])
            least[0] += f.size
            least[1].append(f.path)
        return [_Files(paths) for _, paths in bins]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        system, _ = _filesystem(self.path)
        rows, held = [], 0
        for path in partition.paths:
            with system.open_input_file(path) as raw:
                stream = gzip.open(raw) if path.endswith(".gz") else raw
                for row in parse(stream, self.payload, self.wanted):
                    rows.append(row)
                    held += 512 + len(row[-1] or b"")
                    if held > 8 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64() if n in _LONGS or n == "block_bytes" else pa.string() for n in (*HEADERS, "block_bytes")] + [pa.binary()]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[*HEADERS, "block_bytes", "payload"])


def parse(stream, payload: bool = True, wanted: dict[str, set] | None = None) -> Iterator[tuple]:
    """Tuples in the order of SCHEMA; blocks of unwanted records are passed over by length."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {line[:40]!r}")
        head = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.partition(b":")
            head[name.strip().lower()] = value.strip()
        size = int(head[b"content-length"])
        row = []
        for name, header in HEADERS.items():
            value = head.get(header)
            text = None if value is None else value.decode("utf-8", "replace")
            if name == "payload_digest" and text:
                text = text.partition(":")[2].lower()
            if name == "refers_to":
                text = head[b"x-refers-to-page"].decode() if b"x-refers-to-page" in head else text
            row.append(int(text) if name in _LONGS and text is not None else text)
        fits = all(row[list(HEADERS).index(n)] in values for n, values in (wanted or {}).items())
        body = None
        if fits and payload and row[1] != "revisit":
            block = stream.read(size)
            body = block.partition(b"\r\n\r\n")[2] if head.get(b"content-type", b"").startswith(b"application/http") else block
        else:
            stream.seek(size, 1)
        if fits:
            yield (*row, size, body)


class WarcSource(DataSource):
    """``spark.read.format("warc")``; options path, payload (true/false), partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options)


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records of the archives in a folder, with predicates on headers pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def round_trip(pages: DataFrame, path: str, **options) -> DataFrame:
    """Writes the archives, reads them back: page_id, sizes, digests and record types.

    Sizes and digests of responses are taken from the payloads that were read.
    """
    write(pages, path, **options)
    rows = read(pages.sparkSession, path)
    first = F.col("record_type") == "response"
    return rows.select(
        "page_id",
        F.when(first, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(first, F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        F.when(~first, F.col("refers_to").cast("long")).alias("refers_to"),
    )

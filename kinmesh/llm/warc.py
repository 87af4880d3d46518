"""WARC archives: written by Spark's text writer, read back whole, and assembled into captures.

A page becomes three records: request, response (or revisit, for a payload that another capture keeps) and metadata.
Request and metadata name the response's record in WARC-Concurrent-To.  A record ends with two line ends, which is
the writer's separator, so any file system of Spark's holds the archives and its commit protocol guards them.

Reading goes by Content-Length.  Assembly joins the records through WARC-Concurrent-To, and a revisit with the
capture that its WARC-Refers-To names, into one nested row per capture.
"""

from __future__ import annotations

import hashlib
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmesh.operators.skew import join_hot

from .common import scratch_path, stash, table

_END = "\r\n"
RECORD = (
    "type string, record_id string, concurrent_to string, refers_to string, target_uri string, date string, "
    "content_type string, declared_digest string, block_bytes long, http_bytes long, fields map<string,string>, "
    "http_head string, payload_bytes long, payload_digest string, payload binary"
)


def _uuid(kind: str, *parts: Column) -> Column:
    h = F.md5(F.concat_ws("\x1f", F.lit(kind), *(F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts)))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _header(*pairs: tuple[str, Column | str]) -> Column:
    """A header of named fields; those whose value is null are left out."""
    lines = [F.concat(F.lit(f"{k}: "), v if isinstance(v, Column) else F.lit(v)) for k, v in pairs]
    return F.concat(F.concat_ws(_END, F.lit("WARC/1.1"), *lines), F.lit(_END + _END))


def records(pages: DataFrame, *, least: int = 1000, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """One column `value`: three WARC records of each row of pages.

    Of rows with equal payloads of at least `least` bytes, that with the largest page_id (then url) is the response
    and the others revisit it; other rows are responses.  Null html is empty; rows equal in all columns are written
    each, under the same identifiers.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    # line ends within a url would end its field
    url = F.regexp_replace(F.col("url").cast("string"), r"[\r\n]", "")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), html.alias("html"))
    rows = rows.withColumns({"digest": F.sha1(F.col("html").cast("binary")), "n": F.octet_length("html").cast("long")})
    equal = rows.where(F.col("n") >= least).groupBy("digest")
    equal = equal.agg(F.max(F.struct("page_id", "url")).alias("keeper"), F.count("*").alias("count")).where("count > 1")
    equal = stash(equal.withColumnRenamed("digest", "__key"), "warc-equal")
    # small payloads have keys of their own, so that blank pages are not all one key
    own = F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string"))
    rows = rows.withColumn("__key", F.when(F.col("n") >= least, F.col("digest")).otherwise(own))
    if equal.count() <= 100_000:
        rows = rows.join(F.broadcast(equal), "__key", "left")
    else:
        rows = join_hot(rows, equal, ["__key"], n="count", how="left")
    rows = rows.drop("__key", "count")
    revisit = F.col("keeper").isNotNull() & ~F.struct("page_id", "url").eqNullSafe(F.col("keeper"))
    rows = rows.withColumns(
        {
            "revisit": revisit,
            "id": _uuid("response", F.col("page_id"), F.col("url"), F.col("digest")),
            "refers": F.when(revisit, _uuid("response", F.col("keeper.page_id"), F.col("keeper.url"), F.col("digest"))),
        }
    )
    uri = F.coalesce("url", F.lit("urn:none"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit(_END + _END)
    )
    path = F.regexp_replace(uri, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*|#.*$", "")
    host = F.regexp_extract(uri, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    get = F.concat(F.lit("GET "), F.when(path == "", "/").otherwise(path), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(_END + _END))
    about = F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(_END + "has-url: "), F.col("url").isNotNull().cast("string"), F.lit(_END))

    def size(block: Column, more: Column | int = 0) -> Column:
        return (F.octet_length(block) + more).cast("string")

    same = [("WARC-Target-URI", uri), ("WARC-Date", date)]
    digest = F.concat(F.lit("sha1:"), F.col("digest"))
    profile = F.when(F.col("revisit"), "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    response = F.concat(
        _header(
            ("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")), ("WARC-Record-ID", F.col("id")), *same,
            ("WARC-Payload-Digest", digest), ("WARC-Profile", profile), ("WARC-Refers-To", F.col("refers")),
            ("Content-Type", "application/http; msgtype=response"),
            ("Content-Length", size(http, F.when(F.col("revisit"), 0).otherwise(F.col("n")))),
        ),
        http, F.when(F.col("revisit"), "").otherwise(F.col("html")),
    )

    def beside(kind: str, of: str, block: Column) -> Column:
        key = _uuid(kind, F.col("page_id"), F.col("url"), F.col("digest"))
        return F.concat(
            _header(
                ("WARC-Type", kind), ("WARC-Record-ID", key), *same, ("WARC-Concurrent-To", F.col("id")), ("Content-Type", of),
                ("Content-Length", size(block)),
            ),
            block,
        )

    kinds = F.array(beside("request", "application/http; msgtype=request", get), response, beside("metadata", "application/warc-fields", about))
    return rows.select(F.explode(kinds).alias("value"))


#: Payload bytes up to which pages are written together, and the records of such a file, three for each page: some 350 MB at
#: most.  Larger ones have a file for each page.
FILES = ((1 << 15, 30_000), (1 << 20, 900), (1 << 24, 57))


def write_archives(pages: DataFrame, path: str, *, compression: str = "gzip", records_per_file: int = 30_000, **how) -> None:
    """Write WARC files of the pages to a folder; a file has at most `records_per_file` records, and fewer of large pages.

    Each size of FILES is a folder, written if there are such pages.
    """
    size = F.coalesce(F.octet_length(F.col("html").cast("string")), F.lit(0))
    low = -1
    largest = pages.agg(F.max(size)).first()[0] or 0
    for most, n in (*FILES, (None, 3)):
        part = pages.where((size > low) & (size <= most) if most else size > low)
        if low <= largest:
            out = records(part, **how).write.option("lineSep", _END + _END).option("compression", compression)
            out.option("maxRecordsPerFile", min(n, records_per_file)).text(f"{path}/to-{most or 'any'}")
        low = most or low


class _Stream:
    """Bytes of a file that may be gzipped, in one or many members."""

    def __init__(self, raw: bytes):
        self.raw, self.at, self.held = memoryview(raw), 0, bytearray()
        self.zip = zlib.decompressobj(31) if bytes(raw[:2]) == b"\x1f\x8b" else None

    def _more(self) -> bool:
        if self.zip is None:
            self.held += self.raw[self.at :]
            done, self.at = self.at >= len(self.raw), len(self.raw)
            return not done
        if self.zip.eof:
            rest = self.zip.unused_data
            self.at -= len(rest)
            if not self.raw[self.at : self.at + 2].tobytes() == b"\x1f\x8b":
                return False
            self.zip = zlib.decompressobj(31)
        part = self.raw[self.at : self.at + (1 << 20)]
        self.at += len(part)
        self.held += self.zip.decompress(part)
        return bool(len(part)) or self.zip.eof

    def until(self, mark: bytes) -> bytes | None:
        """What comes before the mark, which is passed; None at the end."""
        start = 0
        while (k := self.held.find(mark, start)) < 0:
            start = max(0, len(self.held) - len(mark))
            if not self._more():
                return None
        out = bytes(self.held[:k])
        del self.held[: k + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self._more():
                raise ValueError("a WARC record is cut off")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def _fields(head: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in head.split("\r\n"):
        name, colon, value = line.partition(":")
        if colon:
            out[name.strip().lower()] = value.strip()
    return out


def parse(raw: bytes, payload: bool):
    """The records of one archive as tuples in the order of RECORD."""
    stream = _Stream(raw)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        text = head.decode("utf-8", "replace").lstrip("\r\n")
        if not text:
            continue
        if not text.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {text[:60]!r}")
        f = _fields(text)
        block = stream.take(int(f["content-length"]))
        kind, of = f.get("warc-type", ""), f.get("content-type", "")
        http_head, body, http_bytes = None, block, None
        if of.startswith("application/http"):
            top, _, body = block.partition(b"\r\n\r\n")
            http_head = top.decode("utf-8", "replace")
            told = _fields(http_head).get("content-length")
            http_bytes = int(told) if told and told.isdigit() else None
        fields = _fields(block.decode("utf-8", "replace")) if of.startswith("application/warc-fields") else {}
        has = kind in ("response", "resource", "conversion")
        yield (
            kind, f.get("warc-record-id"), f.get("warc-concurrent-to"), f.get("warc-refers-to"), f.get("warc-target-uri"),
            f.get("warc-date"), of, (f.get("warc-payload-digest") or "").removeprefix("sha1:") or None, len(block), http_bytes,
            list(fields.items()), http_head, len(body) if has else None, hashlib.sha1(body).hexdigest() if has else None,
            body if has and payload else None,
        )


def read_archives(spark: SparkSession, path: str, *, payload: bool = True) -> DataFrame:
    """All records of the WARC files (plain or gzipped) under a path.  A file is read by one task, so keep files to some 100 MB."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")

    def scan(batches):
        import pyarrow as pa

        schema = pa.schema(kind)
        held, n = [], 0
        for batch in batches:
            for value in batch.column("content"):
                for r in parse(value.as_py(), payload):
                    held.append(r)
                    n += r[8]
                    if n > 1 << 23 or len(held) >= 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
                        held, n = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    kind = _arrow_kinds()
    return files.mapInArrow(scan, RECORD)


def _arrow_kinds():
    import pyarrow as pa

    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "map<string,string>": pa.map_(pa.string(), pa.string())}
    return [(name, kinds[of]) for name, of in (x.split() for x in RECORD.split(", "))]


def captures(found: DataFrame) -> DataFrame:
    """One nested row for each response or revisit record: with its request and metadata, and the response that a revisit refers to.

    Missing partners are null.  Of several requests or metadata records of one capture, that of the smallest
    record id is taken.  A capture that was archived several times under one id comes out as often.
    """
    main = found.where(F.col("type").isin("response", "revisit"))

    def beside(kind: str) -> DataFrame:
        own = found.where((F.col("type") == kind) & F.col("concurrent_to").isNotNull())
        one = F.struct(F.col("record_id").alias("id"), "target_uri", "date", "http_head", F.to_json("fields").alias("fields"))
        own = own.select(F.col("concurrent_to").alias("record_id"), one.alias(kind))
        return own.groupBy("record_id").agg(F.min(kind).alias(kind))

    out = main.join(beside("request"), "record_id", "left").join(beside("metadata"), "record_id", "left")
    kept = out.where("type = 'response'").groupBy(F.col("record_id").alias("refers_to"))
    kept = kept.agg(F.min(F.struct("record_id", "target_uri", "payload_bytes", "payload_digest", F.col("metadata.fields").alias("fields"))).alias("original"))
    # a response meets its own row, so that captures without a reference are not all one key
    asked = main.where(F.col("refers_to").isNotNull()).groupBy("refers_to").agg(F.count("*").alias("__n"))
    kept = stash(kept.join(asked, "refers_to", "left").fillna(0, ["__n"]).withColumnRenamed("refers_to", "__key"), "warc-originals")
    met = join_hot(out.withColumn("__key", F.coalesce("refers_to", "record_id")), kept, ["__key"], n="__n", how="left").drop("__n")
    return met.withColumn("original", F.when(F.col("refers_to").isNotNull(), F.col("original"))).drop("__key")


def _page_id(fields: str) -> Column:
    return F.get_json_object(F.col(fields), "$.page-id").cast("long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: every page archived, read back and assembled."""
    path = scratch_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    got = captures(stash(read_archives(spark, path, payload=False).drop("payload"), "warc-records"))
    return got.select(
        _page_id("metadata.fields").alias("page_id"),
        F.when(F.col("type") == "revisit", F.col("original.payload_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(F.col("type") == "revisit", F.col("original.payload_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.when(F.col("type") == "revisit", _page_id("original.fields")).alias("refers_to"),
    )


#: The query in DuckDB's SQL.
ORACLE_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
k AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS keeper FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> keeper THEN keeper END AS refers_to FROM k
"""

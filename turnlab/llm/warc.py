"""WARC archives as a Spark data source, and pages written to and read from them.

``spark.read.format("warc").load(folder)`` plans partitions of whole files, packed by size. A record's header is
parsed first; one that fails a pushed-down predicate on its type or headers is passed over without decoding its payload
(and without inflating it, where its gzip member names its own length, as those written here do). Without a
``payload`` column in a given schema no payload is decoded at all.
"""

import struct
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo,
                                    GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan,
                                    LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith,
                                    WriterCommitMessage)
from pyspark.sql.pandas.types import to_arrow_schema

from turnlab.llm.common import local_path, scratch, small_batches

SCHEMA = ("warc_type string, record_id string, target_uri string, date string, content_type string, "
          "payload_digest string, refers_to string, http_length long, headers map<string,string>, payload binary")
LEAST_REVISIT = 100     # bytes of a payload from which equal ones are stored once
PARTITION_BYTES = 64 << 20
_BATCH_BYTES = 8 << 20
_PIECE = 1 << 16

#: Header lines of the format behind the columns.
FIELDS = {"warc_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI",
          "date": "WARC-Date", "content_type": "Content-Type", "payload_digest": "WARC-Payload-Digest",
          "refers_to": "WARC-Refers-To"}
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class BadRecord(ValueError):
    """An archive that breaks off, or a record without a length."""


def _lines(headers):
    return "".join(f"{k}: {' '.join(str(v).split())}\r\n" for k, v in headers if v is not None)


def record_bytes(row):
    """One record: a dict of the columns; the payload follows an HTTP header, which a revisit keeps without it."""
    payload = row.get("payload") or b""
    length = row.get("http_length")
    http = ("HTTP/1.1 200 OK\r\n" + _lines([("Content-Type", "text/html; charset=utf-8"),
                                            ("Content-Length", len(payload) if length is None else length)])
            + "\r\n").encode()
    block = http if row["warc_type"] == "revisit" else http + payload
    head = [(name, row.get(column)) for column, name in FIELDS.items()]
    head += [("WARC-Profile", IDENTICAL if row["warc_type"] == "revisit" else None), ("Content-Length", len(block))]
    head += [(k, v) for k, v in (row.get("headers") or ()) if k not in dict(head)]
    return ("WARC/1.1\r\n" + _lines(head) + "\r\n").encode() + block + b"\r\n\r\n"


def gzip_member(data, level=4):
    """A gzip member whose extra field ``sl`` holds its own length and that of its content."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    total = 12 + 12 + len(body) + 8
    return (b"\x1f\x8b\x08\x04" + b"\0" * 6 + struct.pack("<H2sHII", 12, b"sl", 8, total, len(data) & 0xFFFFFFFF)
            + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF))


class _Plain:
    """Bytes of an uncompressed archive from where the file stands."""

    def __init__(self, file):
        self.file = file

    def more(self):
        return self.file.read(_PIECE)

    def skip(self, n):
        self.file.seek(n, 1)

    def unread(self, data):
        self.file.seek(-len(data), 1)


class _Member:
    """Bytes of one gzip member."""

    def __init__(self, file):
        self.file, self.at, self.inflate = file, file.tell(), zlib.decompressobj(31)
        head = file.read(24)
        self.length = None
        if len(head) == 24 and head[3] & 4 and head[12:14] == b"sl":
            self.length = struct.unpack("<I", head[16:20])[0]
        file.seek(self.at)
        self.kept = b""

    def more(self):
        if self.inflate.eof:
            return b""
        data = self.kept or self.file.read(_PIECE)
        if not data:
            raise BadRecord("a gzip member breaks off")
        out = self.inflate.decompress(data, 4 * _PIECE)
        self.kept = self.inflate.unconsumed_tail
        if self.inflate.eof:
            self.file.seek(-len(self.inflate.unused_data), 1)
        return out or self.more()

    def end(self):
        """Put the file behind the member."""
        if self.length:
            self.file.seek(self.at + self.length)
        else:
            while self.more():
                pass


def records(file, wanted, with_payload=True):
    """Rows (dicts of the columns) of an open archive that satisfy ``wanted``, a function of the header's columns."""
    while magic := file.read(2):
        file.seek(-len(magic), 1)
        if magic in (b"\r\n", b"\n\r", b"\n"):
            file.read(len(magic))
            continue
        packed = magic == b"\x1f\x8b"
        source = _Member(file) if packed else _Plain(file)
        data = b""
        while (stop := data.find(b"\r\n\r\n")) < 0:
            piece = source.more()
            if not piece:
                raise BadRecord("a header breaks off")
            data += piece
        row, headers = _parsed(data[:stop])
        if "Content-Length" not in headers:
            raise BadRecord("a record without Content-Length")
        length, rest = int(headers["Content-Length"]), data[stop + 4:]
        if wanted(row):
            parts, have = [rest], len(rest)
            while have < length and (with_payload or b"\r\n\r\n" not in b"".join(parts)):
                piece = source.more()
                if not piece:
                    raise BadRecord("a record breaks off")
                parts.append(piece)
                have += len(piece)
            block = b"".join(parts)
            _http(row, headers, block[:length], with_payload)
            passed = len(block)
            yield row
        else:
            passed = len(rest)
        if packed:
            source.end()
        else:
            source.skip(length + 4 - passed)


def _parsed(raw):
    lines = raw.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise BadRecord(f"no record: {lines[0][:40]!r}")
    headers = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    known = {k.lower(): v for k, v in headers.items()}
    row = {column: known.get(name.lower()) for column, name in FIELDS.items()}
    headers = {"Content-Length" if k.lower() == "content-length" else k: v for k, v in headers.items()}
    return row | {"headers": list(headers.items()), "http_length": None, "payload": None}, headers


def _http(row, headers, block, with_payload):
    if (row["content_type"] or "").startswith("application/http"):
        head, _, block = block.partition(b"\r\n\r\n")
        for line in head.split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            if name.strip().lower() == b"content-length" and value.strip().isdigit():
                row["http_length"] = int(value)
    if with_payload and row["warc_type"] != "revisit":
        row["payload"] = block


_TESTS = {
    EqualTo: lambda v, x: v is not None and v == x, EqualNullSafe: lambda v, x: v == x,
    In: lambda v, x: v is not None and v in x, IsNotNull: lambda v, x: v is not None,
    GreaterThan: lambda v, x: v is not None and v > x, GreaterThanOrEqual: lambda v, x: v is not None and v >= x,
    LessThan: lambda v, x: v is not None and v < x, LessThanOrEqual: lambda v, x: v is not None and v <= x,
    StringStartsWith: lambda v, x: v is not None and v.startswith(x),
    StringEndsWith: lambda v, x: v is not None and v.endswith(x),
    StringContains: lambda v, x: v is not None and x in v,
}


@dataclass
class Files(InputPartition):
    paths: tuple


@dataclass
class Written(WriterCommitMessage):
    name: str | None


class Reader(DataSourceReader):
    def __init__(self, path, schema):
        self.path, self.schema, self.tests = path, schema, []

    def pushFilters(self, filters):
        for f in filters:
            if type(f) in _TESTS and len(f.attribute) == 1 and f.attribute[0] in FIELDS:
                self.tests.append((type(f), f.attribute[0], getattr(f, "value", None)))
            else:
                yield f

    def partitions(self):
        parts, size = [[]], 0
        for path, n in archive_files(self.path):
            if parts[-1] and size + n > PARTITION_BYTES:
                parts.append([])
                size = 0
            parts[-1].append(path)
            size += n
        return [Files(tuple(p)) for p in parts]

    def read(self, partition):
        schema = to_arrow_schema(self.schema)
        tests = [(_TESTS[kind], column, value) for kind, column, value in self.tests]
        system, _ = local_path(self.path)
        rows, size = [], 0
        for path in partition.paths:
            with system.open_input_file(path) as file:
                for row in records(file, lambda r: all(t(r[c], v) for t, c, v in tests), "payload" in schema.names):
                    rows.append(row)
                    size += 500 + len(row["payload"] or b"")
                    if size > _BATCH_BYTES:
                        yield _batch(rows, schema)
                        rows, size = [], 0
        if rows:
            yield _batch(rows, schema)


def _batch(rows, schema):
    return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in schema], schema=schema)


def archive_files(uri):
    """(path, bytes) of the archives in a folder, by name: those its manifests list, or all where there is none."""
    from pyarrow import fs
    system, folder = local_path(uri)
    found = sorted((x for x in system.get_file_info(fs.FileSelector(folder)) if x.is_file), key=lambda x: x.path)
    lists = [x for x in found if x.base_name.startswith("_manifest-")]
    named = set()
    for x in lists:
        with system.open_input_stream(x.path) as stream:
            named.update(stream.read().decode().split())
    return [(x.path, x.size) for x in found
            if (x.base_name in named if lists else x.base_name.endswith((".warc", ".warc.gz")))]


class Writer(DataSourceArrowWriter):
    """One archive of gzip members for each task; a manifest lists those of the tasks that count."""

    def __init__(self, path, overwrite):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator):
        system, folder = local_path(self.path)
        name, stream = f"part-{uuid.uuid4().hex}.warc.gz", None
        for batch in iterator:
            for i in range(batch.num_rows):  # a row at a time: payloads are large
                row = {k: v[0] for k, v in batch.slice(i, 1).to_pydict().items()}
                if stream is None:
                    system.create_dir(folder, recursive=True)
                    stream = system.open_output_stream(f"{folder}/{name}", compression=None)
                stream.write(gzip_member(record_bytes(row)))
        if stream is not None:
            stream.close()
        return Written(name if stream is not None else None)

    def commit(self, messages):
        from pyarrow import fs
        system, folder = local_path(self.path)
        system.create_dir(folder, recursive=True)
        old = [x.path for x in system.get_file_info(fs.FileSelector(folder)) if x.base_name.startswith("_manifest-")]
        with system.open_output_stream(f"{folder}/_manifest-{uuid.uuid4().hex}") as stream:
            stream.write("".join(f"{m.name}\n" for m in messages if m and m.name).encode())
        for path in old if self.overwrite else ():
            system.delete_file(path)

    def abort(self, messages):
        """Nothing to undo: archives that no manifest lists don't count."""


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return Reader(self.options["path"], schema)

    def writer(self, schema, overwrite):
        return Writer(self.options["path"], overwrite)


def register(spark):
    """Make the format ``warc`` known to a session and let it take filters."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    small_batches(spark)


def read(spark, folder, schema=SCHEMA):
    register(spark)
    return spark.read.format("warc").schema(schema).load(folder)


_ID = "urn:page:"


def to_records(pages, page_id="page_id", url="url", html="html", date="2024-01-01T00:00:00Z"):
    """Rows of the data source for pages: of equal payloads of LEAST_REVISIT bytes or more the one with the smallest
    page_id is a response, the others are revisits of it; smaller payloads are all responses.

    A null html is empty. Rows that repeat the smallest id are responses each; a row without an id revisits an
    equal one that has an id, else it is a response.
    """
    rows = pages.select(F.col(page_id).cast("string").alias("id"), F.col(page_id).alias("number"),
                        F.col(url).alias("target_uri"),
                        F.encode(F.coalesce(html, F.lit("")), "utf-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("http_length", F.length("payload").cast("long"))
    repeated = (rows.where(F.col("http_length") >= LEAST_REVISIT).groupBy("digest")
                .agg(F.min("number").alias("first"), F.count("*").alias("n"))
                .where("n > 1 AND first IS NOT NULL").select(F.col("digest").alias("of"), "first"))
    rows = rows.join(repeated, F.col("digest") == F.col("of"), "left")
    revisit = F.col("first").isNotNull() & ~F.col("number").eqNullSafe(F.col("first"))
    name = F.coalesce(F.concat(F.lit("<" + _ID), "id", F.lit(">")), F.lit("<urn:page->"))
    return rows.select(
        F.when(revisit, "revisit").otherwise("response").alias("warc_type"), name.alias("record_id"), "target_uri",
        F.lit(date).alias("date"), F.lit("application/http;msgtype=response").alias("content_type"),
        F.concat(F.lit("sha256:"), "digest").alias("payload_digest"),
        F.when(revisit, F.concat(F.lit("<" + _ID), F.col("first").cast("string"), F.lit(">"))).alias("refers_to"),
        "http_length", F.lit(None).cast("map<string,string>").alias("headers"),
        F.when(~revisit, F.col("payload")).alias("payload"))


def write(records, folder):
    """Write rows of the data source to archives in ``folder``."""
    register(records.sparkSession)
    records.write.format("warc").mode("append").save(folder)


def archived(pages):
    """The folder of the shared directory whose archives hold ``pages``."""
    folder = scratch(pages.sparkSession, "warc")
    write(to_records(pages), folder)
    return folder


def page_number(column):
    return F.regexp_extract(column, rf"<{_ID}(-?\d+)>", 1).try_cast("long")


def digest(spark, folder):
    """The contract's columns from archives: responses by their payloads, revisits by their headers alone."""
    payload = read(spark, folder).where(F.col("warc_type") == "response").select(
        page_number("record_id").alias("page_id"), F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"), F.col("warc_type").alias("record_type"),
        F.lit(None).cast("long").alias("refers_to"))
    headers = read(spark, folder, SCHEMA.replace(", payload binary", "")).where(
        F.col("warc_type") == "revisit").select(
        page_number("record_id").alias("page_id"), F.col("http_length").alias("payload_bytes"),
        F.regexp_replace("payload_digest", "^sha256:", "").alias("payload_digest"),
        F.col("warc_type").alias("record_type"), page_number("refers_to").alias("refers_to"))
    return payload.union(headers)


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n,
                  sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first != page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (d)
"""

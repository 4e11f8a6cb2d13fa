"""WARC archives as a Python data source, for reading and for writing.

A record is a gzip member of its own.  The writer notes the member's length in
the extra field of the gzip header, so the reader parses the record's headers
from the first few hundred bytes and jumps over payloads that nobody asks for;
members without the note (archives of other tools) are unpacked to find their
end.  Uncompressed archives are read as well.

Files are planned into partitions of about ``partition_bytes``; a file is not
split.  The writer starts a new file after ``max_file_bytes``, and its files
count only once the list of them is written at the end: a task that died leaves
files that no reader looks at.

Columns of a record: ``record_type`` (response, revisit, ...), ``record_id``,
``target_uri``, ``refers_to`` (the record id a revisit points to),
``payload_digest`` (as stored, without the name of the method), ``payload_bytes``
(of the whole payload, also for revisits) and ``payload`` (null for revisits, and
for all records under ``payload=false``).  Null fields are left out of the headers
and come back as null; an empty payload comes back as empty.
"""

import json
import struct
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)

SCHEMA = T.StructType(
    [
        T.StructField("record_type", T.StringType()),
        T.StructField("record_id", T.StringType()),
        T.StructField("target_uri", T.StringType()),
        T.StructField("refers_to", T.StringType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload", T.BinaryType()),
    ]
)
ARROW = pa.schema(
    [
        ("record_type", pa.string()),
        ("record_id", pa.string()),
        ("target_uri", pa.string()),
        ("refers_to", pa.string()),
        ("payload_digest", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload", pa.binary()),
    ]
)
# Header of each column that the reader can decide a predicate by.
HEADERS = {
    "record_type": "warc-type",
    "record_id": "warc-record-id",
    "target_uri": "warc-target-uri",
    "refers_to": "warc-refers-to",
    "payload_digest": "warc-payload-digest",
}
DATE = "1970-01-01T00:00:00Z"
EOL = b"\r\n"
HEAD_BYTES = 4096
SKIP_FIELD = b"sl"  # subfield of the gzip header: length of the member


def file_system(path):
    """File system and path in it; Spark's ``s3a`` is ``s3`` elsewhere."""
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    path = path.replace("s3a://", "s3://", 1)
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[len("file:") :].lstrip("/")
    return pafs.FileSystem.from_uri(path)


# --- records -----------------------------------------------------------------


def _clean(value):
    """A header value on one line."""
    return str(value).replace("\r", " ").replace("\n", " ")


def encode_record(row):
    """Bytes of a record: WARC headers, HTTP headers and, unless a revisit, the payload."""
    payload = row["payload"] or b""
    size = row["payload_bytes"] if row["payload_bytes"] is not None else len(payload)
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    block += b"Content-Length: %d\r\n\r\n" % size
    if row["record_type"] != "revisit":
        block += payload
    fields = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", row["record_id"])]
    fields += [("WARC-Date", DATE), ("WARC-Target-URI", row["target_uri"])]
    if row["payload_digest"] is not None:
        fields.append(("WARC-Payload-Digest", f"sha256:{row['payload_digest']}"))
    if row["record_type"] == "revisit":
        fields.append(("WARC-Refers-To", row["refers_to"]))
        fields.append(
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        )
    fields.append(("Content-Type", "application/http; msgtype=response"))
    fields.append(("Content-Length", len(block)))
    head = "".join(f"{name}: {_clean(value)}\r\n" for name, value in fields if value is not None)
    return b"WARC/1.1\r\n" + head.encode("utf-8", "surrogatepass") + EOL + block + EOL + EOL


def gzip_member(data, level=6):
    """One gzip member that tells its own length in the extra field."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    size = 12 + 8 + len(body) + 8
    extra = SKIP_FIELD + struct.pack("<HI", 4, size)
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def parse_headers(data):
    """``({lower-case name: value}, length of the header part)``."""
    end = data.find(EOL + EOL)
    if end < 0 or not data.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    headers = {}
    for line in data[:end].split(EOL)[1:]:
        name, _, value = line.partition(b":")
        headers[name.strip().lower().decode("ascii", "replace")] = value.strip().decode(
            "utf-8", "surrogatepass"
        )
    return headers, end + 4


def member_length(head):
    """Length that the extra field tells, None without the note."""
    if len(head) < 20 or not head[3] & 4:
        return None
    extra, at = head[12 : 12 + struct.unpack("<H", head[10:12])[0]], 0
    while at + 4 <= len(extra):
        name, size = extra[at : at + 2], struct.unpack("<H", extra[at + 2 : at + 4])[0]
        if name == SKIP_FIELD and size == 4:
            return struct.unpack("<I", extra[at + 4 : at + 8])[0]
        at += 4 + size
    return None


def read_records(stream, wanted, payload=True):
    """Records of an open archive whose headers pass ``wanted``, as tuples."""
    while True:
        at = stream.tell()
        head = stream.read(HEAD_BYTES)
        if not head:
            return
        if head[:2] == b"\x1f\x8b":
            record = _packed_record(stream, at, head, wanted, payload)
        else:
            record = _plain_record(stream, at, head, wanted, payload)
        if record is not None:
            yield record


def _packed_record(stream, at, head, wanted, payload):
    length = member_length(head)
    unpacker = zlib.decompressobj(31)
    data = unpacker.decompress(head)
    while EOL + EOL not in data and not unpacker.eof:
        more = stream.read(HEAD_BYTES)
        if not more:
            break
        data += unpacker.decompress(more)
    headers, start = parse_headers(data)
    keep = wanted(headers)
    needs_block = keep and (payload or headers.get("warc-type") == "revisit")
    if not unpacker.eof and (needs_block or length is None or keep):
        # Without the note the end is known only after unpacking.
        http_ends = EOL + EOL in data[start:]
        data = bytearray(data)
        while not unpacker.eof and (needs_block or length is None or not http_ends):
            more = stream.read(1 << 16)
            if not more:
                raise ValueError("archive ends inside a record")
            piece = unpacker.decompress(more)
            if keep:
                # Only what is new can hold the end, or complete it.
                seen = max(start, len(data) - len(EOL + EOL) + 1)
                data += piece
                http_ends = http_ends or data.find(EOL + EOL, seen) >= 0
        data = bytes(data)
    if length is None:
        length = stream.tell() - at - len(unpacker.unused_data)
    stream.seek(at + length)
    return _row(headers, data[start:], payload) if keep else None


def _plain_record(stream, at, head, wanted, payload):
    data = head
    while EOL + EOL not in data:
        more = stream.read(HEAD_BYTES)
        if not more:
            break
        data += more
    headers, start = parse_headers(data)
    size = int(headers["content-length"])
    keep = wanted(headers)
    block = b""
    if keep:
        stream.seek(at + start)
        block = stream.read(size if payload else min(size, HEAD_BYTES))
    stream.seek(at + start + size + 4)
    return _row(headers, block, payload) if keep else None


def _row(headers, block, payload):
    http, gap, body = block.partition(EOL + EOL)
    size = None
    for line in http.split(EOL):
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length":
            size = int(value)
    revisit = headers.get("warc-type") == "revisit"
    if payload and gap and not revisit:
        size = size if size is not None else int(headers["content-length"]) - len(http) - 4
        body = body[:size]
    else:
        body = None
    digest = headers.get("warc-payload-digest")
    return (
        headers.get("warc-type"),
        headers.get("warc-record-id"),
        headers.get("warc-target-uri"),
        headers.get("warc-refers-to"),
        digest.rpartition(":")[2] if digest is not None else None,
        size,
        body,
    )


# --- data source ---------------------------------------------------------------


@dataclass
class Archives(InputPartition):
    paths: list


@dataclass
class Written(WriterCommitMessage):
    names: list


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.payload = str(options.get("payload", "true")).lower() != "false"
        self.partition_bytes = int(options.get("partition_bytes", 64 << 20))
        self.tests = [(c, set(v)) for c, v in json.loads(options.get("headers", "{}")).items()]

    def partitions(self):
        system, root = file_system(self.path)
        found = system.get_file_info(pafs.FileSelector(root, recursive=True))
        lists = [f for f in found if f.base_name.startswith("_files-")]
        archives = {f.base_name: f for f in found if f.base_name.endswith((".warc", ".warc.gz"))}
        if lists:
            names = set()
            for f in lists:
                with system.open_input_stream(f.path) as stream:
                    names.update(json.loads(stream.read()))
            archives = {name: archives[name] for name in names}
        groups, size = [[]], 0
        for f in sorted(archives.values(), key=lambda f: f.path):
            if groups[-1] and size + f.size > self.partition_bytes:
                groups.append([])
                size = 0
            groups[-1].append(f.path)
            size += f.size
        return [Archives(group) for group in groups]

    def _wanted(self, headers):
        for column, values in self.tests:
            value = headers.get(HEADERS[column])
            if value is not None and column == "payload_digest":
                value = value.rpartition(":")[2]
            if value not in values:
                return False
        return True

    def read(self, partition):
        system, _ = file_system(self.path)
        rows, size = [], 0
        for path in partition.paths:
            with system.open_input_file(path) as stream:
                for record in read_records(stream, self._wanted, self.payload):
                    rows.append(record)
                    size += 200 + len(record[-1] or b"")
                    if size > 4 << 20:
                        yield _batch(rows)
                        rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows):
    columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), ARROW)]
    return pa.RecordBatch.from_arrays(columns, schema=ARROW)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options, overwrite):
        self.path = options["path"]
        self.max_file_bytes = int(options.get("max_file_bytes", 1 << 30))
        self.level = int(options.get("level", 6))
        if overwrite:
            raise ValueError("archives are only added to; choose a new path")

    def write(self, iterator):
        system, root = file_system(self.path)
        system.create_dir(root, recursive=True)
        names, out, size = [], None, 0
        try:
            for batch in iterator:
                for start in range(0, batch.num_rows, 256):
                    for row in batch.slice(start, 256).to_pylist():
                        if out is None or size >= self.max_file_bytes:
                            if out is not None:
                                out.close()
                            names.append(f"{uuid.uuid4().hex}.warc.gz")
                            # Without compression=None the name alone would have it packed twice.
                            out = system.open_output_stream(f"{root}/{names[-1]}", compression=None)
                            size = 0
                        member = gzip_member(encode_record(row), self.level)
                        out.write(member)
                        size += len(member)
        finally:
            if out is not None:
                out.close()
        return Written(names)

    def commit(self, messages):
        system, root = file_system(self.path)
        system.create_dir(root, recursive=True)
        names = [name for message in messages if message is not None for name in message.names]
        with system.open_output_stream(f"{root}/_files-{uuid.uuid4().hex}") as out:
            out.write(json.dumps(names).encode())

    def abort(self, messages):
        """Files of a failed write stay unlisted, so nobody reads them."""


class WarcSource(DataSource):
    """``spark.read.format("warc")`` and ``df.write.format("warc")``, once registered."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options, overwrite)


def register(spark):
    """Make the format known to the session."""
    spark.dataSource.register(WarcSource)


def read_warc(spark, path, payload=True, where=None, **options):
    """Records of all archives below ``path``.

    ``where`` names the values wanted of header columns, a value (null: no such header)
    or a list of them per column: ``{"record_type": "response", "target_uri": [a, b]}``.
    The reader decides them by the headers alone and skips what follows them.  They are
    options of one reader, not filters that the planner hands down: Spark keeps those
    with the relation, and a frame that is read with a filter and then without one, or
    both in one plan, would lose rows.
    """
    register(spark)
    wanted = {
        column: list(values) if isinstance(values, (list, tuple, set)) else [values]
        for column, values in (where or {}).items()
    }
    unknown = sorted(set(wanted) - set(HEADERS))
    if unknown:
        raise ValueError(f"no header decides {', '.join(unknown)}; filter the records instead")
    reader = spark.read.format("warc").option("payload", str(payload).lower())
    return reader.option("headers", json.dumps(wanted)).options(**options).load(path)


def write_warc(records, path, **options):
    """Write records (columns of ``SCHEMA``, others are left out) as archives below ``path``."""
    register(records.sparkSession)
    columns = [F.col(f.name).cast(f.dataType) for f in SCHEMA]
    records.select(columns).write.format("warc").mode("append").options(**options).save(path)


def page_records(pages, min_revisit_bytes=100):
    """A record per page; equal payloads of some size are stored once.

    Of the pages with the same payload of ``min_revisit_bytes`` or more, that with
    the smallest id is a response and the others revisit it; smaller payloads are
    all responses.  A null payload is empty.  Rows that repeat the smallest id are
    responses too, and a page without an id is a response only if no page with
    the same payload has one.  Digests are compared in one aggregation; only those
    seen twice are joined back, by the adaptive join that splits hot digests.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(
        F.col("page_id").cast("long"), F.col("url").alias("target_uri"), payload.alias("payload")
    ).select(
        "*",
        F.sha2("payload", 256).alias("payload_digest"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
    )
    firsts = (
        rows.where(F.col("payload_bytes") >= min_revisit_bytes)
        .groupBy("payload_digest")
        .agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_copies"))
        .where("_copies > 1 and _first is not null")
        .drop("_copies")
    )
    revisit = F.coalesce(~F.col("page_id").eqNullSafe(F.col("_first")), F.lit(False)) & F.col(
        "_first"
    ).isNotNull()

    def record_id(column):
        return F.format_string("<urn:page:%s>", F.coalesce(column.cast("string"), F.lit("")))

    return rows.join(firsts, "payload_digest", "left").select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        record_id(F.col("page_id")).alias("record_id"),
        "target_uri",
        F.when(revisit, record_id(F.col("_first"))).alias("refers_to"),
        "payload_digest",
        "payload_bytes",
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def page_id_of(record_id):
    """The page id inside a record id of ``page_records``, null where there was none."""
    return F.expr(f"try_cast(regexp_extract({record_id}, '<urn:page:(-?[0-9]+)>', 1) as bigint)")
